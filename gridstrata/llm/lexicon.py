"""Byte-level BPE encoding and decoding with a lexicon of frequent words in a minimal acyclic transducer.

Words are counted over all documents; the most frequent ones (``LEXICON`` of them at most) are compiled into a minimal
automaton: equal suffixes share their states, and each arc carries how many words lie before it, so that the outputs
along a path add up to the word's number and thereby to its ids. The automaton is one file of flat arrays; Spark hands
it to the executors, where tasks memory-map it and walk all distinct words of a batch at once. Words that are not in it
are merged exactly, by the vocabulary's own merges. Ids do not depend on which words the lexicon holds.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstrata.llm import vocab
from gridstrata.llm.common import Memo, as_text, checkpoint, list_column
from gridstrata.session import shared_dir

VOCABULARY = "byte_bpe_50k.json"
#: Most words that the transducer holds; about 40 bytes each.
LEXICON = 100_000
#: Distinct words that a counting task holds before it passes them on.
_DISTINCT = 150_000
#: Documents whose words and ids a task holds at once.
_SLICE = 700
#: Pieces whose ids a task keeps in each of two generations, about 150 bytes each.
_KEPT = 300_000
#: The split of the byte vocabulary for text whose blanks are single blanks before words (fixed by the vocabulary file).
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+| ?[0-9]+| ?[^\\sA-Za-z0-9\xc0-\xd6\xd8-\xf6\xf8-\xff]+")

#: Coarse pieces that this split cuts as the library does.
_PLAIN_PIECE = re.compile(" ?[\x21-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]+\\Z")


class Transducer:
    """Arcs sorted by (state, byte) with target and output; states 0 (start) on, and which states end words."""

    def __init__(self, keys: np.ndarray, targets: np.ndarray, outputs: np.ndarray, final: np.ndarray, ends: np.ndarray, ids: np.ndarray):
        self.keys, self.targets, self.outputs, self.final, self.ends, self.ids = keys, targets, outputs, final, ends, ids

    @classmethod
    def build(cls, words: list[bytes], ids: list[list[int]]) -> Transducer:
        """From distinct words in ascending order."""
        known: dict[tuple, int] = {}
        states: list[tuple[bool, tuple]] = []

        def settle(node) -> int:
            key = node[0], tuple(node[1])
            if key not in known:
                known[key] = len(states)
                states.append(key)
            return known[key]

        path: list[list] = [[False, []]]
        last = b""
        for word in words:
            same = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                same += 1
            while len(path) > same + 1:
                target = settle(path.pop())
                path[-1][1].append((last[len(path) - 1], target))
            path += [[False, []] for _ in word[same:]]
            path[-1][0] = True
            last = word
        while len(path) > 1:
            target = settle(path.pop())
            path[-1][1].append((last[len(path) - 1], target))
        root = settle(path[0])
        count = np.zeros(len(states), np.int64)  # words that begin at a state; targets settle before their sources
        for s, (end, arcs) in enumerate(states):
            count[s] = end + sum(count[t] for _, t in arcs)
        place = (np.arange(len(states)) - root) % max(1, len(states))  # the start becomes state 0
        keys, targets, outputs = [], [], []
        for s, (end, arcs) in enumerate(states):
            before = int(end)
            for label, t in arcs:
                keys.append(int(place[s]) << 8 | label)
                targets.append(int(place[t]))
                outputs.append(before)
                before += int(count[t])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        final = np.zeros(len(states), np.int32)
        final[place] = [end for end, _ in states]
        pick = lambda x, kind: np.array(x, kind)[order]
        return cls(pick(keys, np.int64), pick(targets, np.int32), pick(outputs, np.int32), final, np.cumsum([0, *map(len, ids)]).astype(np.int32), np.array([i for x in ids for i in x], np.uint32))

    def to_bytes(self) -> bytes:
        parts = [np.ascontiguousarray(x) for x in (self.keys, self.targets, self.outputs, self.final, self.ends, self.ids)]
        return np.array([len(p) for p in parts], np.int64).tobytes() + b"".join(p.tobytes() for p in parts)

    @classmethod
    def open(cls, path: str) -> Transducer:
        raw = np.memmap(path, np.uint8, "r")
        sizes, at, parts = raw[:48].view(np.int64), 48, []
        for n, kind in zip(sizes.tolist(), (np.int64, np.int32, np.int32, np.int32, np.int32, np.uint32)):
            width = np.dtype(kind).itemsize
            parts.append(raw[at : at + n * width].view(kind))
            at += n * width
        return cls(*parts)

    def find(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, −1 if it is not in the lexicon; one step for all words per byte."""
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys) or not words:
            return out
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        live = np.flatnonzero(size)
        state, number, step = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), 0
        while len(live):
            key = state << 8 | data[start[live] + step]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[arc] == key
            live, arc = live[ok], arc[ok]
            state, number, step = self.targets[arc].astype(np.int64), number[ok] + self.outputs[arc], step + 1
            done = size[live] == step
            ends = done & (self.final[state] == 1)
            out[live[ends]] = number[ends]
            live, state, number = live[~done], state[~done], number[~done]
        return out


@lru_cache(maxsize=2)
def _merged(path: str) -> Memo:
    """Ids of a fine piece, as bytes, by the vocabulary's merges."""
    model = vocab.tokenizer(path).model
    forth = {b: c for c, b in vocab._byte_values().items()}
    table = {i: "".join(forth[b] for b in chr(i).encode()) for i in range(256)}
    blank, tokenize = forth[32], model.tokenize

    def merge(piece: str) -> bytes:
        # in the byte alphabet a piece of printable characters differs from itself by its blank alone
        letters = piece.replace(" ", blank) if piece.isascii() else piece.translate(table)
        return array("I", [t.id for t in tokenize(letters)]).tobytes()

    return Memo(merge, 100_000)


def _found(words: list[str], lexicon: Transducer) -> list[bytes | None]:
    """Ids of words, as bytes, by the lexicon alone."""
    number = lexicon.find([w.encode() for w in words])
    raw = memoryview(lexicon.ids).cast("B")  # the file stays mapped; only the words' own ids are copied
    first, last = lexicon.ends[number].tolist(), lexicon.ends[number + 1].tolist()
    return [raw[4 * a : 4 * b].tobytes() if n >= 0 else None for a, b, n in zip(first, last, number.tolist())]


def _fine(w: str) -> list[str] | None:
    """Fine pieces of a coarse piece as the library cuts it; None for those that it has to cut itself."""
    if w.isascii():  # a word and the signs behind it, by far the most
        body = w.rstrip(",.;:!?%#*&$")
        if body[w[0] == " " :].isalpha():
            return [body, w[len(body) :]] if len(body) < len(w) else [w]
    return _SPLIT.findall(w) if _PLAIN_PIECE.match(w) and "<|" not in w else None


def piece_ids(words: list[str], lexicon: Transducer, path: str) -> dict[str, bytes]:
    """Ids of distinct coarse pieces, as bytes: by the lexicon, else from their fine pieces, looked up or merged."""
    known, several = {}, []
    merged = _merged(path)
    for w, ids in zip(words, _found(words, lexicon)):
        if ids is None:
            fine = _fine(w)
            if fine and len(fine) > 1:
                several.append((w, fine))
                continue
            if fine:
                ids = merged.make(w)
            else:
                ids = array("I", vocab.tokenizer(path).encode(w, add_special_tokens=False).ids).tobytes()
        known[w] = ids
    parts = list({q for _, fine in several for q in fine})
    table = {q: merged[q] if ids is None else ids for q, ids in zip(parts, _found(parts, lexicon))}
    for w, fine in several:
        known[w] = b"".join([table[q] for q in fine])
    return known


class Pieces:
    """Ids of coarse pieces, kept from slice to slice: two generations of at most ``limit`` short pieces each."""

    def __init__(self, lexicon: Transducer, path: str, limit: int = _KEPT):
        self.lexicon, self.path, self.limit = lexicon, path, limit
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long: list[str] = []

    def of(self, words: set[str]) -> dict[str, bytes]:
        """A table that holds all of ``words``, until the next call."""
        for w in self.long:
            del self.new[w]
        if len(self.new) >= self.limit:
            self.old, self.new = self.new, {}
        new, old, missing = self.new, self.old, []
        for w in words.difference(new):
            ids = old.get(w)
            if ids is None:
                missing.append(w)
            else:
                new[w] = ids
        new.update(piece_ids(missing, self.lexicon, self.path))
        self.long = [w for w in missing if len(w) > 64]
        return new


def coarse(text: str, special: re.Pattern | None) -> list[str] | None:
    """Pieces of a text between which no token reaches; none for texts that only the library can cut."""
    if vocab.ODD_BLANKS.search(text):
        return None
    if special is None or "<|" not in text:
        return vocab.BYTE_COARSE.findall(text)
    out = []
    for i, part in enumerate(special.split(text)):
        out += [part] if i % 2 else vocab.BYTE_COARSE.findall(part)
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words between blanks, with a blank before them, as most of them stand in a text."""

    def out(seen: Counter) -> pa.RecordBatch:
        often = [(f" {w}", n) for w, n in seen.items() if n > 1]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], ["word", "n"])

    seen: Counter = Counter()
    for batch in batches:
        for text in as_text(batch.column(0)):
            seen.update(text.as_py().split())
            if len(seen) > _DISTINCT:
                yield out(seen)
                seen = Counter()
    yield out(seen)


def frequent_words(docs: DataFrame, size: int = LEXICON) -> DataFrame:
    """At most ``size`` words, the most frequent of all texts, counted wherever they stand twice or more in a stretch of documents."""
    rows = docs.select(F.col("text").cast("string")).mapInArrow(_counts, "word string, n long")
    counts = checkpoint(rows.groupBy("word").agg(F.sum("n").alias("n")).withColumn("band", F.floor(F.log2("n") * 64).cast("int")))
    # some thousand bands of counts say where to cut, so that no more than ``size`` words ever leave their tasks
    total, least = 0, 1 << 30
    for band, words in counts.groupBy("band").count().orderBy(F.desc("band")).collect():
        total += words
        if total > size:
            break
        least = band
    return counts.where(F.col("band") >= least).select("word", "n")


def publish(spark: SparkSession, transducer: Transducer) -> str:
    """Write the automaton into the shared folder and hand it to all executors; returns its name there."""
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    place = f"{shared_dir(spark).rstrip('/')}/{name}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(place)
    stream = path.getFileSystem(conf).create(path)
    stream.write(bytearray(transducer.to_bytes()))
    stream.close()
    spark.sparkContext.addFile(path.getFileSystem(conf).makeQualified(path).toString())
    return name


def compile_lexicon(docs: DataFrame, vocabulary: str | None = None, size: int = LEXICON) -> str:
    """Count, compile and publish; returns the name for ``encode``. At most ``size`` words come to the driver."""
    path = vocabulary or vocab.vocabulary(VOCABULARY)
    words = sorted((r.word.encode(), r.word) for r in frequent_words(docs, size).collect())
    known = piece_ids([w for _, w in words], Transducer.build([], []), path)
    ids = [np.frombuffer(known[w], "<u4").tolist() for _, w in words]
    return publish(docs.sparkSession, Transducer.build([b for b, _ in words], ids))


@lru_cache(maxsize=4)
def _opened(name: str) -> Transducer:
    from pyspark import SparkFiles

    return Transducer.open(SparkFiles.get(name))


def encode_texts(texts: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and how many each text has."""
    path = pieces.path
    special = vocab.specials(path)
    cut = [coarse(t, special) for t in texts]
    known = pieces.of(set(chain.from_iterable(own for own in cut if own)))
    parts = []
    for text, own in zip(texts, cut):
        if own is None:
            parts.append(np.array(vocab.tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes())
        else:
            parts.append(b"".join(map(known.__getitem__, own)))
    return np.frombuffer(b"".join(parts), "<u4"), np.array([len(p) // 4 for p in parts], np.int64)


def _encode(name: str, path: str, back: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(_opened(name), path)
        for whole in batches:
            for lo in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(lo, _SLICE)
                ids, n = encode_texts(as_text(batch.column(1)).to_pylist(), pieces)
                columns, names = [batch.column(0), list_column(pa.array(ids.astype(np.int32)), n)], ["doc_id", "ids"]
                if back:
                    columns, names = [*columns, pa.array(decode_ids(ids, n, path), pa.string())], [*names, "text"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, lexicon: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """Rows (doc_id, ids array<int>), one per row of ``docs``: ids as the library gives them, no special tokens added.

    Null and empty texts have an empty array. Repeated rows, null ids and other columns change nothing; an empty table
    gives no rows. ``lexicon`` is a name from ``compile_lexicon``, made from ``docs`` if not given.
    """
    path = vocabulary or vocab.vocabulary(VOCABULARY)
    name = lexicon or compile_lexicon(docs, path)
    return _rows(docs).mapInArrow(_encode(name, path, False), "doc_id long, ids array<int>")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def round_trip(docs: DataFrame, lexicon: str | None = None, vocabulary: str | None = None) -> DataFrame:
    """Rows (doc_id, ids, text): ``encode`` and ``decode`` of its ids in one pass; rows as ``encode`` gives them."""
    path = vocabulary or vocab.vocabulary(VOCABULARY)
    name = lexicon or compile_lexicon(docs, path)
    return _rows(docs).mapInArrow(_encode(name, path, True), "doc_id long, ids array<int>, text string")


def decode_ids(ids: np.ndarray, counts: np.ndarray, path: str) -> list[str]:
    """Texts of ids, special strings included; bytes that are not UTF-8 become U+FFFD."""
    data, start, length = vocab.id_bytes(path)
    sizes = length[ids]
    total = np.concatenate([[0], np.cumsum(sizes)])
    raw = data[np.arange(int(total[-1])) - np.repeat(total[:-1] - start[ids], sizes)].tobytes()
    at = total[np.concatenate([[0], np.cumsum(counts)])].tolist()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:])]


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            for lo in range(0, n, _SLICE):
                part = batch.slice(lo, _SLICE)
                lists = part.column(1).fill_null([]) if part.column(1).null_count else part.column(1)
                counts = lists.value_lengths().to_numpy().astype(np.int64)
                texts = decode_ids(lists.flatten().to_numpy(), counts, path)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return run


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Rows (doc_id, ids, text): the text of each array of ids, as the library decodes it with special tokens kept.

    Null and empty arrays give an empty text; other columns are not read.
    """
    path = vocabulary or vocab.vocabulary(VOCABULARY)
    rows = encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>"))
    return rows.mapInArrow(_decode(path), "doc_id long, ids array<int>, text string")
