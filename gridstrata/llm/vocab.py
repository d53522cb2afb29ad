"""Public tokenizer files and the pieces into which they cut texts before they merge.

The given files are read by the tokenizers library; its path is a parameter everywhere. A text is first cut into coarse
pieces between which no token reaches (blank-separated for the word vocabulary, with their leading blank for the byte
vocabulary), so that ids of a piece hold wherever it stands and can be kept.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Characters that Python counts as blank and the library's patterns do not; texts with them go to the library whole.
ODD_BLANKS = re.compile("[\x1c-\x1f]")
#: Characters whose normal form and lower case Python and the library agree on: printable ASCII, letters of Latin-1.
PLAIN = re.compile("[\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*\\Z")
#: The split of the word vocabulary for such text in lower case (fixed by the vocabulary file).
WORD_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\\sa-z0-9\xdf-\xf6\xf8-\xff]+")
#: Coarse pieces of the byte vocabulary: what its split leaves together around blanks.
BYTE_COARSE = re.compile(r" ?\S+|\s+(?!\S)|\s+")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The library's tokenizer of a file, without truncation and padding."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


@lru_cache(maxsize=4)
def bare(path: str):
    """The same merges for pieces that are already normalised and split."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    tok.normalizer = normalizers.Sequence([])
    tok.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    return tok


@lru_cache(maxsize=4)
def specials(path: str) -> re.Pattern | None:
    """A pattern of the special strings, in one group so that a split keeps them."""
    names = sorted((t.content for t in tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None


def word_pieces(chunk: str, path: str) -> list[str]:
    """Normalised pre-tokens, in the byte alphabet, of one piece without blanks and special strings."""
    if PLAIN.match(chunk):
        low = chunk.lower()
        return [p if p.isascii() else p.translate(_latin()) for p in WORD_SPLIT.findall(low)]
    return pieces_by_library(tokenizer(path), chunk)


def pieces_by_library(tok, text: str) -> list[str]:
    """Pre-tokens of a text without special strings as the library finds them."""
    text = tok.normalizer.normalize_str(text) if tok.normalizer else text
    return [p for p, _ in tok.pre_tokenizer.pre_tokenize_str(text)]


@lru_cache(maxsize=1)
def _latin() -> dict[int, str]:
    """Letters of Latin-1 in the byte alphabet."""
    forth = {b: c for c, b in _byte_values().items()}
    return {i: "".join(forth[b] for b in chr(i).encode()) for i in range(0xC0, 0x100)}


@lru_cache(maxsize=1)
def _byte_values() -> dict[str, int]:
    """The byte alphabet of byte-level vocabularies: printable bytes stand for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=4)
def id_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all ids in a row, with the place and length of each id's bytes; special strings stand as they are."""
    tok, back = tokenizer(path), _byte_values()
    special = tok.get_added_tokens_decoder()
    size = tok.get_vocab_size(with_added_tokens=True)
    parts = []
    for i in range(size):
        if i in special:
            parts.append(special[i].content.encode())
        else:
            parts.append(bytes(back[c] for c in tok.id_to_token(i)))
    lengths = np.array([len(p) for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths
