"""Token counts of whole texts: each distinct pre-token is cut into pieces once, frequencies per document are joined to it.

A task turns an Arrow batch of documents (a block) into one row per distinct pre-token, with the block's documents that
hold it and how often: two arrays of 16-bit numbers, so that a word in a third of all documents is a row per block.
After a shuffle by pre-token, every distinct pre-token is one run of rows; its pieces are counted once and multiplied
into the documents' sums. Sums go back by block, where the block's own row names the documents. No ids are made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstrata.llm import vocab, words
from gridstrata.llm.common import Memo, as_text, spread, task_block

VOCABULARY = "word_bpe_49k.json"
_ROWS = "key long, piece string, block long, docs binary, times binary"
_SUMS = "block long, own boolean, docs binary, sums binary"
_FLUSH = 2_000_000


def _parts(text: str, special) -> list[str]:
    """Pieces between blanks, special strings apart."""
    if special is None or "<|" not in text:
        return text.split()
    out = []
    for i, part in enumerate(special.split(text)):
        out += [part] if i % 2 else part.split()
    return out


def frequencies(texts: list[str], path: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens of the texts, and (pre-token, text, times) in the order of pre-token and text."""
    special, tok = vocab.specials(path), vocab.tokenizer(path)
    chunks: dict[str, int] = {}
    number = Memo(lambda c: chunks.setdefault(c, len(chunks)), 1 << 60)
    at, length, odd = [], np.zeros(len(texts), np.int64), {}
    for i, text in enumerate(texts):
        if vocab.ODD_BLANKS.search(text):  # the library itself cuts the rare texts whose blanks mean two things
            odd[i] = [p for j, s in enumerate(special.split(text) if special else [text]) for p in ([s] if j % 2 else vocab.pieces_by_library(tok, s))]
            continue
        own = list(map(number.__getitem__, _parts(text, special)))
        length[i] = len(own)
        at.append(np.array(own, np.int32))
    pieces: dict[str, int] = {}
    named = lambda p: pieces.setdefault(p, len(pieces))
    cut = [[named(c)] if special and special.fullmatch(c) else [named(p) for p in vocab.word_pieces(c, path)] for c in chunks]
    sizes = np.array([len(c) for c in cut], np.int64)
    flat = np.array([p for c in cut for p in c], np.int64)
    starts = np.cumsum(sizes) - sizes
    seen = np.concatenate(at).astype(np.int64) if at else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), length)
    n = sizes[seen]
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    inside += np.repeat(starts[seen], n)
    piece, doc = flat[inside], np.repeat(doc, n)
    del at, seen, n, inside
    if odd:
        extra = [(named(p), i) for i, own in odd.items() for p in own]
        piece = np.concatenate([piece, np.array([p for p, _ in extra], np.int64)])
        doc = np.concatenate([doc, np.array([i for _, i in extra], np.int64)])
    piece *= max(1, len(texts))
    piece += doc
    del doc
    pair, times = np.unique(piece, return_counts=True)
    return list(pieces), pair // max(1, len(texts)), pair % max(1, len(texts)), times


def _split_counts(piece, doc, times):
    """Numbers of times in 16 bits: larger ones come in several parts."""
    while (over := times > 65535).any():
        piece, doc = np.concatenate([piece, piece[over]]), np.concatenate([doc, doc[over]])
        times = np.concatenate([np.where(over, 65535, times), times[over] - 65535])
        order = np.lexsort((doc, piece))
        piece, doc, times = piece[order], doc[order], times[order]
    return piece, doc, times


def _blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])


def _map(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for whole in batches:
            for lo in range(0, whole.num_rows, 60_000):
                batch, block = whole.slice(lo, 60_000), task_block(at)
                at += 1
                text = as_text(batch.column(1))
                pieces, piece, doc, times = frequencies(text.to_pylist(), path)
                piece, doc, times = _split_counts(piece, doc, times)
                ends = np.searchsorted(piece, np.arange(len(pieces)), "right")
                name = pa.array(pieces, pa.string())
                key = words.hashes(*_strings(name)).view(np.int64) if pieces else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), name, pa.array(np.full(len(pieces), block)), _blobs(doc.astype("<u2"), ends), _blobs(times.astype("<u2"), ends)],
                    ["key", "piece", "block", "docs", "times"])
                size = np.diff(words.buffers(text)[1]).astype("<i8")
                ids = batch.column(0)
                rows = [ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes() + ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(), size.tobytes()]
                own = words.mix(np.array([block], np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([None], pa.string()), pa.array([block]), pa.array([rows[0]], pa.binary()), pa.array([rows[1]], pa.binary())], ["key", "piece", "block", "docs", "times"])

    return run


def _strings(names: pa.Array):
    data, places = words.buffers(names)
    return data, places[:-1], places[1:]


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = vocab.specials(path)
        model = vocab.bare(path).model
        known, kept = None, 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n = 0

        def flush():
            if not held:
                return
            block, doc, total = (np.concatenate([h[i] for h in held]) for i in range(3))
            blocks, place = np.unique(block, return_inverse=True)
            pair, at = np.unique(place.astype(np.int64) << 32 | doc, return_inverse=True)
            sums = np.bincount(at, total).astype("<i8")
            ends = np.searchsorted(pair >> 32, np.arange(len(blocks)), "right")
            cols = [pa.array(blocks), pa.array(np.zeros(len(blocks), bool)), _blobs((pair & 0xFFFF).astype("<u2"), ends), _blobs(sums, ends)]
            yield pa.RecordBatch.from_arrays(cols, ["block", "own", "docs", "sums"])

        for batch in batches:
            names = batch.column(1)
            head = names.is_null().to_numpy(zero_copy_only=False)
            if head.any():
                own = batch.filter(pa.array(head))
                cols = [own.column(2), pa.array(np.ones(own.num_rows, bool)), own.column(3), own.column(4)]
                yield pa.RecordBatch.from_arrays(cols, ["block", "own", "docs", "sums"])
                batch = batch.filter(pa.array(~head))
                names = batch.column(1)
            if not batch.num_rows:
                continue
            count = np.empty(batch.num_rows, np.int64)
            for i, name in enumerate(names.to_pylist()):
                if name != known:
                    known, kept = name, 1 if special and special.fullmatch(name) else len(model.tokenize(name))
                count[i] = kept
            docs, times = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").astype(np.int64) for k in (3, 4))
            sizes = np.diff(np.frombuffer(batch.column(3).buffers()[1], np.int32)[batch.column(3).offset :][: batch.num_rows + 1]) // 2
            held.append((np.repeat(batch.column(2).to_numpy(), sizes), docs, times * np.repeat(count, sizes)))
            n += len(docs)
            if n > _FLUSH:
                yield from flush()
                held, n = [], 0
        yield from flush()

    return run


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of their block, the block's own row among them."""
    block, sums, own = None, None, None

    def out():
        ids, sizes = own
        n = len(sizes)
        doc, null = np.frombuffer(ids[: 8 * n], "<i8"), np.frombuffer(ids[8 * n :], np.uint8).astype(bool)
        total = np.zeros(n, np.int64)
        total[: len(sums)] = sums[:n]
        return pa.RecordBatch.from_arrays([pa.array(doc, mask=null), pa.array(sizes), pa.array(total)], ["doc_id", "n_bytes", "n_tokens"])

    for batch in batches:
        for b, first, docs, values in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if b != block:
                if block is not None:
                    yield out()
                block, sums, own = b, np.zeros(65536, np.int64), None
            if first:
                own = docs, np.frombuffer(values, "<i8")
            else:
                sums[np.frombuffer(docs, "<u2")] += np.frombuffer(values, "<i8")
    if block is not None:
        yield out()


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Rows (doc_id, n_bytes, n_tokens), one per row of ``docs``; a null text is empty and has no tokens.

    Counts are those of the library for the whole text without added special tokens; special strings inside texts count
    one each. Repeated rows and null ids are counted row by row. Other columns are not read; an empty table gives none.
    """
    path = vocabulary or vocab.vocabulary(VOCABULARY)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_map(path), _ROWS)
    sums = spread(rows, "key", "piece").mapInArrow(_count(path), _SUMS)
    return spread(sums, "block").mapInArrow(_sum, "doc_id long, n_bytes long, n_tokens long")

