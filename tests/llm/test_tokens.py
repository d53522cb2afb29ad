"""Token counts, encoding and packing against the tokenizers library on whole texts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from gridstrata.llm import encode, lexicon, packing, tokencount, vocab
from gridstrata.llm.queries import QUERIES
from gridstrata.sources.tables import table

WORD, BYTE = vocab.vocabulary("word_bpe_49k.json"), vocab.vocabulary("byte_bpe_50k.json")
PARTS = ["a", "B", "é", "É", "ß", "İ", "é", " ", "  ", "\n", "\t", "\x1c", "'s", "'LL", ",", "..", "1", "23", "²", "<|endoftext|>", "<|", "日本", " ", " ", "Σ", "😀", "_", "\x00", "ª", "\x85", "\r\n", "᠎", "Ǆ", "​"]


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(7)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(3000)]


def test_word_ids_equal_the_library(odd):
    want = [e.ids for e in Tokenizer.from_file(WORD).encode_batch(odd, add_special_tokens=False)]
    assert [np.frombuffer(encode.word_ids(t, WORD), "<u4").tolist() for t in odd] == want


def test_ids_of_texts_together_equal_the_library(odd, monkeypatch):
    words = ["a", "ab.", "It's", "A'", "b,", "Zürich", "x9", "<|endoftext|>.", "endoftext|", "q\x7f", "\x00", "日本", "Ab-", "$$"]
    rng = random.Random(3)
    texts = odd + [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(500)]
    want = [e.ids for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]
    for size in (1, 200, 1 << 22):
        monkeypatch.setattr(encode, "AT_ONCE", size)
        assert [np.frombuffer(ids, "<u4").tolist() for ids in encode.texts_ids(iter(texts), WORD)] == want
    assert list(encode.texts_ids([], WORD)) == []


def test_counts_equal_the_library(make, odd, hard):
    rows = hard + list(enumerate(odd, 100))
    tok = Tokenizer.from_file(WORD)
    want = Counter((i, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    assert Counter(tuple(r) for r in tokencount.token_counts(make(rows)).collect()) == want
    assert tokencount.token_counts(make([])).count() == 0


def test_encoding_and_decoding_equal_the_library(make, odd, hard):
    rows = hard + list(enumerate(odd, 100))
    tok = Tokenizer.from_file(BYTE)
    ids = [tok.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    want = Counter((i, tuple(x), tok.decode(x, skip_special_tokens=False)) for (i, _), x in zip(rows, ids))
    assert Counter((r.doc_id, tuple(r.ids), r.text) for r in lexicon.decode(lexicon.encode(make(rows))).collect()) == want
    assert lexicon.encode(make([])).count() == 0


def test_any_lexicon_gives_the_same_ids(odd):
    words = sorted({w for t in odd for w in lexicon.coarse(t, vocab.specials(BYTE)) or ()})[::3]
    words = sorted(w.encode() for w in words)
    tok = Tokenizer.from_file(BYTE)
    ids = [tok.encode(w.decode(), add_special_tokens=False).ids for w in words]
    full = lexicon.Transducer.build(words, ids)
    assert full.find(words).tolist() == list(range(len(words)))
    assert len(full.final) < sum(map(len, words))  # suffixes are shared
    one, none = (lexicon.encode_texts(odd, lexicon.Pieces(t, BYTE)) for t in (full, lexicon.Transducer.build([], [])))
    assert np.array_equal(one[0], none[0]) and np.array_equal(one[1], none[1])


def test_transducer_is_minimal_and_exact():
    words = sorted({a + b for a in (b"st", b"sp", b"str", b"r") for b in (b"ing", b"ong", b"ings", b"")})
    t = lexicon.Transducer.build(words, [[i] for i in range(len(words))])
    languages = defaultdict(set)
    for w in words:
        for k in range(len(w) + 1):
            languages[w[:k]] |= {x[k:] for x in words if x.startswith(w[:k])}
    assert len(t.final) == len({frozenset(x) for x in languages.values()})
    assert t.find([b"st", b"strings", b"s", b"", b"x"]).tolist() == [words.index(b"st"), words.index(b"strings"), -1, -1, -1]


def test_level_has_the_smallest_sum_of_squares():
    rng = random.Random(3)
    p = packing.Packer(16)
    for i in range(2000):
        s = rng.randint(1, 15)
        best = None
        for h in range(16 - s + 1):
            if not h or p.count[h]:
                c = p.count.copy()
                c[h] -= h > 0
                c[h + s] += h + s < 16
                best = min(best or ((1 << 60), 0), (int((c**2).sum()), -h))
        assert p.level(s) == -best[1]
        p.add((i, 0, bytes(4 * s), s), s)


def check_pieces(rows, texts, window=4096):
    tok = Tokenizer.from_file(WORD)
    docs = Counter()
    for t in texts:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        docs[ids.tobytes()] += 1
    sequences, own = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        own[r.doc_id].append(r)
        assert r.length == len(r.ids) // 4 > 0
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    return docs, own, sequences


def test_packing_holds_every_id_once(make, hard):
    rows = [(i, t) for i, t in hard if i not in (None, 9, 10)] + [(100 + i, "word " * (i * 37 % 900)) for i in range(300)]
    got = packing.pack(make(rows)).collect()
    docs, own, sequences = check_pieces(got, [t for _, t in rows])
    whole = Counter()
    for pieces in own.values():
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces[:-1]]]).tolist()
        whole[b"".join(bytes(r.ids) for r in pieces)] += 1
        assert sum(r.length for r in pieces) == pieces[0].doc_tokens
    assert whole == docs
    full = [s for s in sequences.values() if sum(n for _, n in s) == 4096]
    assert len(sequences) - len(full) <= 8  # one for each task at most
    assert packing.pack(make([])).count() == 0 and packing.pack(make(hard)).count() >= len(hard)


def test_queries_on_the_given_table(base, small):
    texts = {r.doc_id: r.text or "" for r in table(base, small, "documents").collect()}
    word, byte = Tokenizer.from_file(WORD), Tokenizer.from_file(BYTE)
    for r in QUERIES["op1_token_counts"](base, small).collect():
        n = len(word.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)
    for r in QUERIES["op9_bpe_lexicon"](base, small).collect():
        ids = byte.encode(texts[r.doc_id], add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(byte.decode(ids, skip_special_tokens=False)))
    for r in QUERIES["op7_packing"](base, small).collect():
        ids = np.array(word.encode(texts[r.doc_id], add_special_tokens=False).ids + [2], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
