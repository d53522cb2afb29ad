"""Toxicity of documents: disguised words are restored by a noisy-channel decoder, then restored text is scored.

Characters of a disguised word (digits and signs for letters, letters set apart, letters drawn out) span a lattice of the
letters they may stand for. A character language model, counted over all documents, weighs the paths with the costs of
each disguise, and Viterbi's algorithm takes the best. Plain words have one path and stay as they are. Words that occur
more often in toxic labelled documents get a weight; a document's weights give its score by a calibrated logistic model.

Words are runs of Unicode letters and their marks in every script, in lower case and composed form. In the letter model an
accented Latin letter counts as its base letter; letters of other scripts have one path and a fixed cost.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstrata.llm import labelled, words
from gridstrata.llm.common import Memo, as_text

FOLDS, LEFT, CUT = 3, 1, 0.7
#: Most words that carry a weight.
LEXICON = 5_000
#: Share of the toxic labelled documents (and three of them) that a word must stand in to carry a weight.
RARE = 0.01
#: Letters that signs may stand for (fixed values).
LOOKS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il",
    "+": "t", "(": "c", "<": "c", "*": "aeiouc", "#": "aeiouh", "%": "aeiou", "?": "aeiou",
}
_LOOKS_COST, _DROP_COST, _EDGE_COST, _OTHER_COST = 1.0, 0.5, 8.0, 4.0
_CELLS = 27**3
_SIGNS = "".join(LOOKS)
_L = r"[^\W\d_]"  # a letter of any script
_ANY = re.escape(_SIGNS)
#: Letters set apart, one at a time, by runs of blanks and of characters that stand for no letter.
_APART = re.compile(rf"(?<![^\W_])(?:(?:{_L}|[{_ANY}])(?:[^\w{_ANY}]|_)+){{2,}}(?:{_L}|[{_ANY}])(?![^\W_])")
_BETWEEN = re.compile(rf"(?:[^\w{_ANY}]|_)+")
#: Inside a word: a sign before or after a letter, separators between letters or signs, the same letter thrice.
_SPOT = re.compile(rf"[{_ANY}](?={_L})|(?<={_L})(?:[0-9@$|+(<*#%]|[!?]+(?=[{_ANY}]|{_L})|[-._]+(?=[{_ANY}]|{_L}))|(?i:({_L})\1\1)")
_DRAWN = re.compile(rf"({_L})\1\1", re.I)
_JOINTS = re.compile("[-._]+")
_LONG = re.compile(r"(.)\1{3,}", re.S)  # three copies of a drawn-out letter decode as any larger number of them


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point whether it lies between words, and its letter in the model: 1 to 26, 0 for the edge of a word."""
    gap, letter = np.ones(0x110000, bool), np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LM":
            gap[c] = False
        if kind == "L":
            base = unicodedata.normalize("NFKD", chr(c)).lower()[0]
            letter[c] = ord(base) - 96 if "a" <= base <= "z" else 0
    return gap, letter


def folded(text: str) -> str:
    """Lower case and composed form."""
    return unicodedata.normalize("NFC", text.lower())


def _slices(texts: list[str]) -> Iterator[tuple[int, str, np.ndarray, np.ndarray]]:
    """Slices of texts: first text, the folded texts in a row, their code points, places at which texts begin and end."""
    at = 0
    while at < len(texts):
        own, size, to = [], 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) <= 1 << 21):
            own.append(folded(texts[to]))
            size += len(texts[to])
            to += 1
        row = "".join(own)
        yield at, row, np.frombuffer(row.encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, own)])
        at = to


def letters(texts: pa.Array) -> np.ndarray:
    """Counts of all runs of three letters of all texts, Latin letters without case and accents; everything else is an edge."""
    total = np.zeros(_CELLS, np.int64)
    for _, _, codes, places in _slices(texts.to_pylist()):
        for lo in range(0, len(codes), 1 << 21):
            c = _tables()[1][codes[max(0, lo - 2) : lo + (1 << 21)]]
            edge = np.zeros(len(c) + 1, bool)
            inner = places[(places > max(0, lo - 2)) & (places < lo + (1 << 21))] - max(0, lo - 2)
            edge[inner] = True
            a, b, d = c[:-2].copy(), c[1:-1].copy(), c[2:]
            cut = edge[2 : len(c)]  # the third character begins another text
            a[edge[1 : len(c) - 1]] = 0
            a[cut], b[cut] = 0, 0
            a[b == 0] = 0  # nothing before an edge is known
            total += np.bincount((a * 27 + b) * 27 + d, minlength=_CELLS)
    return total


def _count_letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(_CELLS, np.int64)
    for batch in batches:
        total += letters(as_text(batch.column(0)))
    cells = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])


def language_model(docs: DataFrame) -> np.ndarray:
    """Negative log chance of each letter after two others, from all documents; 27³ numbers whatever the corpus."""
    rows = docs.select(F.col("text").cast("string")).mapInArrow(_count_letters, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(_CELLS)
    for r in rows:
        counts[r.cell] = r.n
    three = counts.reshape(27, 27, 27)
    two = three.sum(axis=0) + 0.5
    one = two.sum(axis=0)
    back = 0.9 * two / two.sum(axis=1, keepdims=True) + 0.1 * one / one.sum()
    chance = (three + 5 * back[None]) / (three.sum(axis=2, keepdims=True) + 5)
    return -np.log(chance)


def lattice(seen: str) -> list[tuple[dict[str, float], float | None]]:
    """Per observed character the letters it may be with their costs, and the cost of leaving it out (None: it stays)."""
    out = []
    gap, _ = _tables()
    for i, ch in enumerate(seen):
        before, after = seen[i - 1 : i], seen[i + 1 : i + 2]
        plain = not gap[ord(ch)]
        if not plain and ch not in LOOKS:
            out.append(({}, 0.0))
            continue
        options = {ch: 0.0} if plain else {x: _LOOKS_COST + 0.3 * (len(LOOKS[ch]) > 2) for x in LOOKS[ch]}
        drop = None
        if ch == before:  # a letter drawn out loses copies easily, a double letter does not
            drop = _DROP_COST if ch == after or seen[max(0, i - 2) : max(0, i - 1)] == ch else _EDGE_COST
        elif not plain and not (before and after):
            drop = _EDGE_COST
        out.append((options, drop))
    return out


def decode(seen: str, model: np.ndarray) -> str:
    """The letters most likely meant by an observed string."""
    letter = _tables()[1]
    states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}  # the word as links from its last letter back
    for options, drop in lattice(_LONG.sub(r"\1\1\1", folded(seen))):
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, word) in states.items():
            if drop is not None:
                old = new.get((a, b))
                if old is None or cost + drop < old[0]:
                    new[a, b] = cost + drop, word
            for ch, price in options.items():
                at = int(letter[ord(ch)])
                own = cost + price + (model[a, b, at] if at else _OTHER_COST)
                state = (b, at) if at else (0, 0)
                old = new.get(state)
                if old is None or own < old[0]:
                    new[state] = own, (word, ch)
        states = new or states
    word, out = min((cost + model[a, b, 0], i, word) for i, ((a, b), (cost, word)) in enumerate(states.items()))[2], []
    while word:
        word, ch = word
        out.append(ch)
    return "".join(reversed(out))


def _piece(text: str, at: int) -> tuple[int, int]:
    """The run of letters, signs and separators around a place, without separators at its ends."""
    gap, _ = _tables()
    inside = lambda c: c in LOOKS or c in "-._" or not gap[ord(c)]
    lo = hi = at
    while lo and inside(text[lo - 1]):
        lo -= 1
    while hi < len(text) and inside(text[hi]):
        hi += 1
    while lo < hi and text[lo] in "-._":
        lo += 1
    while lo < hi and text[hi - 1] in "-._":
        hi -= 1
    return lo, hi


def _bodies(text: str, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """The readings of a piece that are disguised: with the signs at its ends as letters, and without them."""
    while lo < hi and text[hi - 1] in "!?":
        hi -= 1
    start = hi  # the last character and its copies before it
    while start > lo and text[start - 1] == text[hi - 1]:
        start -= 1
    if hi - start > 1 and not text[start].isalnum():
        hi = start
    closed = text[lo : lo + 1] in ("(", "<") and text[hi : hi + 1] in (")", ">")
    own = text[lo:hi]
    bare = own.strip("@$!|+(<*#%?")
    at = lo + own.find(bare) if bare else lo
    for a, b in {(at, at + len(bare)), (at, at + len(bare)) if closed else (lo, hi)}:
        body = text[a:b]
        if len(body) > 2 and (not body.isalpha() or _DRAWN.search(body)) and re.search(_L, body):
            yield a, b


def disguised(text: str) -> Iterator[tuple[int, int]]:
    """Places of strings that may be disguised words; what separators join is read in one and part by part."""
    for m in _APART.finditer(text):
        joints = list(_BETWEEN.finditer(text, *m.span()))
        least = min(j.end() - j.start() for j in joints)
        wide = [j.span() for j in joints if j.end() - j.start() > least]  # words set apart by more than their letters
        ends = [m.start(), *(x for j in wide for x in j), m.end()]
        for lo, hi in {m.span(), *zip(ends[::2], ends[1::2])}:
            if hi - lo > 4 and sum(map(str.isalpha, set(text[lo:hi].lower()))) > 1:
                yield lo, hi
    at = 0
    while m := _SPOT.search(text, at):
        lo, hi = _piece(text, m.start())
        at = max(hi, m.end())
        yield from _bodies(text, lo, hi)
        joints = [j.span() for j in _JOINTS.finditer(text, lo, hi)]
        if joints:
            ends = [lo, *(x for j in joints for x in j), hi]
            for a, b in zip(ends[::2], ends[1::2]):
                yield from _bodies(text, a, b)


@lru_cache(maxsize=1)
def _decoder(key: bytes) -> Memo:
    model = np.frombuffer(key).reshape(27, 27, 27)
    return Memo(lambda s: decode(s, model), 50_000)


def restore(text: str, decoder) -> list[tuple[int, int, str]]:
    """Disguised strings of a text: start, end and the word restored."""
    return [(a, b, decoder[text[a:b]]) for a, b in sorted(set(disguised(text)))]


def _plain(texts: list[str]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices: folded texts in a row, code points, starts and ends of runs of letters, text of each run."""
    gap, _ = _tables()
    for at, row, codes, places in _slices(texts):
        starts, ends, counts = words.spans(codes, places, gap)
        yield row, codes, starts, ends, np.repeat(np.arange(at, at + len(counts)), counts)


#: Lengths in characters of word beginnings that count as words of their own (marked by a star), so that endings do not hide a stem.
STEMS = (4, 5, 6)
_STEM = np.uint64(0x5851F42D4C957F2D)


def with_stems(own: set[str]) -> set[str]:
    return own | {w[:k] + "*" for w in own for k in STEMS if len(w) > k}


def hashed(names: list[str]) -> np.ndarray:
    data, places = words.buffers(pa.array([n.rstrip("*") for n in names], pa.string()))
    star = np.array([n.endswith("*") for n in names], bool)
    return words.hashes(data, places[:-1], places[1:]) ^ np.where(star, _STEM, np.uint64(0))


def _words_of(key: bytes):
    """Distinct words of each labelled document, restored ones included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(key)
        for batch in batches:
            out, label, texts = [], [], as_text(batch.column(0)).to_pylist()
            seen = [{w for *_, w in restore(text, decoder) if w} for text in texts]
            for row, _, starts, ends, doc in _plain(texts):
                for i, lo, hi in zip(doc.tolist(), starts.tolist(), ends.tolist()):
                    seen[i].add(row[lo:hi])
            for own, y in zip(map(with_stems, seen), batch.column(1).to_pylist()):
                out += own
                label += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array(label, pa.int32())], ["word", "label"])

    return run


def features(texts: pa.Array, lexicon: tuple[np.ndarray, np.ndarray], decoder) -> tuple[np.ndarray, list[list[tuple[int, int, str]]]]:
    """Per text the largest weight, the sum of weights of its words and how many words carry one; and what was restored."""
    names, weights = lexicon
    own = texts.to_pylist()
    found = [restore(t, decoder) for t in own]
    top, total, hits = np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))

    def add(doc: np.ndarray, h: np.ndarray) -> None:
        if not len(names) or not len(h):
            return
        at = np.minimum(np.searchsorted(names, h), len(names) - 1)
        hit = names[at] == h
        np.maximum.at(top, doc[hit], weights[at[hit]])
        np.add.at(total, doc[hit], weights[at[hit]])
        np.add.at(hits, doc[hit], 1)

    for row, codes, starts, ends, doc in _plain(own):
        data = np.frombuffer(row.encode(), np.uint8)
        place = np.cumsum(np.concatenate([[0], 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)]))  # of each character in UTF-8
        add(doc, words.hashes(data, place[starts], place[ends]))
        for k in STEMS:
            long = np.flatnonzero(ends - starts > k)
            add(doc[long], words.hashes(data, place[starts[long]], place[starts[long] + k]) ^ _STEM)
    restored = [(i, w) for i, spans in enumerate(found) for word in {w for *_, w in spans if w} for w in with_stems({word})]
    if restored:
        add(np.array([i for i, _ in restored]), hashed([w for _, w in restored]))
    return np.stack([top, np.log1p(total), np.log1p(hits)], axis=1), found


def _features(key: bytes, lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, _ = features(as_text(batch.column(0)), lexicon.value, _decoder(key))
            yield pa.RecordBatch.from_arrays([batch.column(1), *map(pa.array, x.T)], ["label", "a", "b", "c"])

    return run


def _scores(key: bytes, lexicon, net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("word", pa.string())]))
        for batch in batches:
            x, found = features(as_text(batch.column(1)), lexicon.value, _decoder(key))
            score = np.full(len(x), net) if isinstance(net, float) else net.scores(x)
            spans = pa.array([[{"start": a, "end": b, "word": w} for a, b, w in own] for own in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), spans, pa.array(score)], ["row", "restored", "score"])

    return run


def lexicon_of(rows: DataFrame, key: bytes, size: int = LEXICON) -> list[tuple[str, float]]:
    """Words with the largest log-odds for label 1 among labelled rows (text, label), at most ``size`` of them."""
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, fine = n.get(1, 0), n.get(0, 0)
    if not bad or not fine:
        return []
    seen = rows.select("text", "label").mapInArrow(_words_of(key), "word string, label int").groupBy("word")
    seen = seen.agg(F.sum("label").alias("bad"), (F.count(F.lit(1)) - F.sum("label")).alias("fine")).where(F.col("bad") >= max(3.0, RARE * bad))
    odds = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("fine") + 0.5) / (fine + 1))
    top = seen.withColumn("weight", odds).where("weight > 2").orderBy(F.desc(F.col("weight") * F.log1p("bad")), "word").limit(size)
    return [(r.word, float(r.weight)) for r in top.collect()]


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """Rows (row, restored, score): a struct of the columns of ``docs``, the disguised places with the words restored, and
    the chance of label 1 from the text alone.

    Null and empty texts restore nothing and get the score of a document without weighted words. Repeated rows are
    scored alike. Without usable labels the score is one half, with a single class its smoothed share. An empty table
    gives no rows.
    """
    context = docs.sparkSession.sparkContext
    key = language_model(docs).astype(np.float64).tobytes()
    sample = labelled.sample(docs, labels, label, FOLDS, LEFT)
    found = lexicon_of(sample, key)
    h = hashed([w for w, _ in found])
    order = np.argsort(h)
    lexicon = context.broadcast((h[order], np.array([w for _, w in found])[order]))
    rows = sample.select("text", "label").mapInArrow(_features(key, lexicon), "label int, a double, b double, c double").collect()
    net: labelled.Net | float = 0.5
    if rows:
        x, y = np.array([(r.a, r.b, r.c) for r in rows]), np.array([r.label for r in rows], float)
        order = np.lexsort((*x.T, y))
        net = labelled.Net(x[order], y[order], 8, 20) if y.min() < y.max() else float((y.sum() + 1) / (len(y) + 2))
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    kind = whole.schema["row"].dataType.simpleString()
    return whole.mapInArrow(_scores(key, lexicon, net), f"row {kind}, restored array<struct<start:int,end:int,word:string>>, score double")
