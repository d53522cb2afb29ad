"""Quality of documents: random-indexing word vectors, pooled per document, and a small calibrated network.

Every word falls into one of ``BUCKETS`` buckets by hash and has a shape (first and last character, capitals, whether it
repeats the word before it). Buckets and shapes have fixed random index vectors with a few entries of ±1. A pass over all
documents adds to each bucket's vector the index vectors of the words before and after, so the table has a fixed
size while what is summed into it grows with the corpus. A document is the mean of its words' vectors and of its words'
shape vectors; a two-layer network fitted on a bounded sample of labelled rows gives the score.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstrata.llm import labelled, words
from gridstrata.llm.common import as_text, drop_kept

BUCKETS = 8192
DIM = 64
FOLDS, LEFT, CUT = 4, 2, 0.7
_NONZERO = 4
_STRIPE = 256
_CHUNK = 1 << 18
_DOCS = 256
_SHAPES = 5 * 7 * 2 * 2

_rng = np.random.default_rng(33)
_PLACE = np.array([_rng.choice(DIM, _NONZERO, replace=False) for _ in range(BUCKETS + _SHAPES)])
_SIGN = _rng.choice([-1, 1], (BUCKETS + _SHAPES, _NONZERO)).astype(float)
_INDEX = np.zeros((BUCKETS + _SHAPES, DIM), np.float32)
np.put_along_axis(_INDEX, _PLACE, _SIGN.astype(np.float32), 1)

_CLASS = np.full(256, 3, np.uint8)  # symbols
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 4
_END = np.full(256, 4, np.int64)
_END[97:123], _END[65:91], _END[48:58], _END[128:] = 0, 1, 2, 6
_END[[44, 46, 58, 59]], _END[33] = 3, 5


def _inside(hit: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many bytes of each word are hit."""
    total = np.zeros(len(hit) + 1, np.int32)  # an Arrow string is shorter than 2^31
    np.cumsum(hit, out=total[1:])
    return total[ends] - total[starts]


def _words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of texts: first text, words per text, bucket and shape of each word."""
    data, places = words.buffers(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(places, places[at] + (1 << 22), "right")) - 1)
        own = data[places[at] : places[to]]
        starts, ends, counts = words.spans(own, places[at : to + 1] - places[at])
        h = words.hashes(own, starts, ends)
        shape = np.zeros(0, np.int64)
        if len(starts):
            kind = _CLASS[own]
            upper, lower = _inside(kind == 1, starts, ends), _inside(kind == 0, starts, ends)
            again = np.zeros(len(h), bool)
            again[1:] = h[1:] == h[:-1]
            first = np.cumsum(counts) - counts
            again[first[counts > 0]] = False
            shape = ((kind[starts].astype(np.int64) * 7 + _END[own[ends - 1]]) * 2 + ((upper > 1) & (lower == 0))) * 2 + again
        yield at, counts, (h % np.uint64(BUCKETS)).astype(np.int64), shape
        at = to


def contexts(texts: pa.Array, table: np.ndarray) -> None:
    """Add to ``table`` (buckets × dimensions) the index vectors of each word's neighbours in its text."""
    for _, counts, bucket, shape in _words(texts):
        inner = np.ones(len(bucket), bool)
        inner[(np.cumsum(counts) - counts)[counts > 0]] = False
        pair = np.flatnonzero(inner)  # a word and the word before it
        for lo in range(0, len(pair), _CHUNK):
            b = pair[lo : lo + _CHUNK]
            a = b - 1
            for word, near in ((a, b), (b, a)):
                row = (bucket[word] * DIM)[:, None]
                for names in (bucket[near], BUCKETS + shape[near]):
                    table += np.bincount((row + _PLACE[names]).ravel(), _SIGN[names].ravel(), BUCKETS * DIM).astype(np.int64).reshape(BUCKETS, DIM)


def _sum_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    drop_kept()
    table = np.zeros((BUCKETS, DIM), np.int64)
    for batch in batches:
        contexts(as_text(batch.column(0)), table)
    stripes = range(0, BUCKETS, _STRIPE)
    packed = [zlib.compress(table[i : i + _STRIPE].astype("<i4").tobytes(), 1) for i in stripes]
    yield pa.RecordBatch.from_arrays([pa.array([i for i in stripes], pa.int32()), pa.array(packed, pa.binary())], ["stripe", "sums"])


def _merge(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(s), "<i4").astype(np.int64) for s in rows.column("sums").to_pylist())
    return pa.table({"stripe": pa.array([rows.column("stripe")[0].as_py()], pa.int32()), "sums": [total.astype("<i8").tobytes()]})


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Vectors of all buckets, of length one; the driver gets one table of fixed size."""
    parts = docs.select(F.col("text").cast("string")).mapInArrow(_sum_contexts, "stripe int, sums binary")
    rows = parts.groupBy("stripe").applyInArrow(_merge, "stripe int, sums binary").collect()
    table = np.zeros((BUCKETS, DIM), np.float64)
    for r in rows:
        table[r.stripe : r.stripe + _STRIPE] = np.frombuffer(bytes(r.sums), "<i8").reshape(-1, DIM)
    length = np.sqrt((table * table).sum(axis=1, keepdims=True))
    return (table / np.maximum(length, 1)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One row per text: means of word vectors and of shape vectors, and the logarithm of its number of words."""
    out = np.zeros((len(texts), 2 * DIM + 1))
    for at, counts, bucket, shape in _words(texts):
        ends = np.concatenate([[0], np.cumsum(counts)])
        for lo in range(0, len(counts), _DOCS):
            own = counts[lo : lo + _DOCS]
            cut = slice(ends[lo], ends[lo + len(own)])
            doc = np.repeat(np.arange(len(own)), own)
            rows, n = slice(at + lo, at + lo + len(own)), np.maximum(own, 1)[:, None]
            for names, size, table, cols in ((bucket, BUCKETS, vectors, slice(0, DIM)), (shape, _SHAPES, _INDEX[BUCKETS:], slice(DIM, 2 * DIM))):
                times = np.bincount(doc * size + names[cut], minlength=len(own) * size).reshape(len(own), size)
                out[rows, cols] = times.astype(np.float32) @ table / n
        out[at : at + len(counts), -1] = np.log1p(counts)
    return out


def _features(vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        for batch in batches:
            rows = pooled(as_text(batch.column(0)), vectors.value)
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([r.tobytes() for r in rows], pa.binary())], ["label", "x"])

    return run


def _scores(model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_kept()
        vectors, net = model.value
        for batch in batches:
            x = pooled(as_text(batch.column(batch.num_columns - 1)), vectors)
            score = net.scores(x) if not isinstance(net, float) else np.full(len(x), net)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score)], [*names, "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality"):
    """Word vectors of all ``docs`` and the network fitted on labelled rows; a constant if there is one label or none."""
    vectors = word_vectors(docs)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)
    rows = labelled.sample(docs, labels, label, FOLDS, LEFT).select("text", "label").mapInArrow(_features(sent), "label int, x binary").collect()
    if not rows:
        return vectors, 0.5
    x, y = np.stack([np.frombuffer(bytes(r.x)) for r in rows]), np.array([r.label for r in rows], float)
    order = np.lexsort((*x.T[:3], y))  # the same order however the rows arrive
    x, y = x[order], y[order]
    if y.min() == y.max():
        return vectors, float((y.sum() + 1) / (len(y) + 2))
    return vectors, labelled.Net(x, y)


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", fitted=None) -> DataFrame:
    """Rows (row, score): ``row`` is a struct of the columns of ``docs``, score the chance of label 1 from the text alone.

    Null and empty texts get the score of a document without words. Repeated rows are scored alike. Without usable
    labels the score is one half, with a single class its smoothed share. An empty table gives no rows. ``fitted`` is what
    ``fit`` gave, if it is at hand.
    """
    model = docs.sparkSession.sparkContext.broadcast(fitted or fit(docs, labels, label))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_scores(model, ["row"]), f"row {kind}, score double")
