"""Token ids of whole texts for the word vocabulary: ids of each piece between blanks are kept and joined."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa

from gridstrata.llm import vocab
from gridstrata.llm.common import Memo, kept

#: Characters of texts that are encoded at once.
AT_ONCE = 1 << 22
#: What a chunk of letters, with one sign behind them or not, can hold of a special string.
_SIMPLE = re.compile("[A-Za-z]*[!-~]?\\Z")


@kept
def _memos(path: str) -> Memo:
    tok, bare, special = vocab.tokenizer(path), vocab.bare(path), vocab.specials(path)
    pack = lambda ids: np.array(ids, "<u4").tobytes()
    four = [pack([i]) for i in range(tok.get_vocab_size(with_added_tokens=True))]
    whole = lambda s: pack(tok.encode(s, add_special_tokens=False).ids)
    word = Memo(lambda w: b"".join([four[t.id] for t in bare.model.tokenize(w)]), 300_000)
    simple = not any(_SIMPLE.match(t.content) for t in tok.get_added_tokens_decoder().values())

    def chunk(c: str) -> bytes:
        if simple and c.isascii():  # ASCII letters are one piece, and so is one sign behind them
            if c.isalpha():
                return word[c.lower()]
            if (head := c[:-1]).isalpha() and c.isprintable():
                return word[head.lower()] + word[c[-1]]
        if special and special.search(c) or not vocab.PLAIN.match(c):
            return whole(c)
        return b"".join([word[p] for p in vocab.word_pieces(c, path)])

    return Memo(chunk, 300_000)


def word_ids(text: str, path: str) -> bytes:
    """The ids that the library gives for the whole text, as little-endian 32-bit numbers, without added special tokens."""
    if vocab.ODD_BLANKS.search(text):
        return np.array(vocab.tokenizer(path).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    return b"".join(map(_memos(path).__getitem__, text.split()))


def texts_ids(texts: Iterable[str], path: str) -> Iterator[bytes]:
    """``word_ids`` of each text, in order; the words of some texts are looked up together, each distinct one once."""
    some, size = [], 0
    for text in texts:
        some.append(text)
        size += len(text)
        if size >= AT_ONCE:
            yield from _together(some, path)
            some, size = [], 0
    yield from _together(some, path)


def _together(texts: list[str], path: str) -> Iterator[bytes]:
    odd = {i for i, text in enumerate(texts) if vocab.ODD_BLANKS.search(text)}
    words = [[] if i in odd else text.split() for i, text in enumerate(texts)]
    coded = pa.array(chain.from_iterable(words), pa.large_string()).dictionary_encode()
    parts = list(map(_memos(path).__getitem__, coded.dictionary.to_pylist()))
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    codes = coded.indices.to_numpy()
    n = lengths[codes]
    ends = np.r_[0, np.cumsum(n)]
    places = np.repeat((np.cumsum(lengths) - lengths)[codes] - ends[:-1], n) + np.arange(ends[-1])
    ids = np.frombuffer(b"".join(parts), "<u4")[places]
    at = ends[np.cumsum([0, *map(len, words)])]
    for i, text in enumerate(texts):
        yield word_ids(text, path) if i in odd else ids[at[i] : at[i + 1]].tobytes()
