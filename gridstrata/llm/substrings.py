"""Removal of repeated passages: windows of 20 words that also start earlier, found by a count-min prefilter.

Pass 1 reads every window of every text. Each task keeps one sketch per shard of the hash space: one row of 2^28
counters, held sparsely (touched counters, counts up to two). Sketches are merged by shard; a merged counter is never
less than the number of its windows. Each block of documents gets back those of its own counters that reach two.
Pass 2 reads the texts again, drops windows whose counter says once, and groups the rest exactly by 96 bits of
hash, with the block's first place of each: the first place of all blocks is what stays. Pass 3 cuts the covered words.

A window in a third of all texts is one counter per task and one entry per block in both groupings.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstrata.llm import words
from gridstrata.llm.common import as_text, checkpoint, partitions

WINDOW = 20
_CELLS = 28
_LAST = np.iinfo(np.int64).max
_SLICE = 1 << 22


def windows(texts: pa.Array, size: int) -> Iterator[tuple]:
    """Slices of the texts: first text, bytes, word starts, ends, words per text, window hashes (two), text and start of each."""
    data, places = words.buffers(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(places, places[at] + _SLICE, "right")) - 1)
        own = data[places[at] : places[to]]
        starts, ends, counts = words.spans(own, places[at : to + 1] - places[at])
        h = words.hashes(own, starts, ends)
        one, first = words.runs(h, counts, size)
        two, _ = words.runs(h, counts, size, 1)
        doc = np.repeat(np.arange(to - at), counts)[first]
        two = (two >> np.uint64(32)).astype(np.uint32)
        yield at, own, starts, ends, counts, one, two, doc, first - (np.cumsum(counts) - counts)[doc]
        at = to


def _planes(values: np.ndarray) -> bytes:
    """Ascending numbers as differences, byte by byte, which packs well."""
    return _wide(np.diff(values, prepend=np.int64(0)))


def _values(planes: bytes) -> np.ndarray:
    return np.cumsum(_narrow(planes, "<i8"))


def _place(one: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and counter of a window."""
    return ((one >> np.uint64(40)) % np.uint64(shards)).astype(np.int64), (one & np.uint64((1 << _CELLS) - 1)).astype(np.int64)


def _cut(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal keys begin and end."""
    begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return begins, np.append(begins[1:], len(keys))


def _sketch(size: int, shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(0).to_numpy()
            keys = []
            for at, *_, one, _, doc, _ in windows(as_text(batch.column(1)), size):
                shard, cell = _place(one, shards)
                keys.append((shard << 16 | block[at:][doc]) << _CELLS | cell)
            key, times = np.unique(np.concatenate(keys) if keys else np.zeros(0, np.int64), return_counts=True)
            begins, ends = _cut(key >> (_CELLS + 16))
            own = key & ((1 << (_CELLS + 16)) - 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key[begins] >> (_CELLS + 16)).cast(pa.int32()), pa.array([_planes(own[b:e]) for b, e in zip(begins, ends)], pa.binary()),
                 pa.array([_planes(own[b:e][times[b:e] > 1]) for b, e in zip(begins, ends)], pa.binary())],
                ["shard", "counters", "twice"])

    return run


def _merge(table: pa.Table) -> pa.Table:
    """The merged sketch of one shard: each block's own counters that reach two. Rows hold block and counter as one number."""
    counters, twice = (np.concatenate([_values(x) for x in table.column(n).to_pylist()]) for n in ("counters", "twice"))
    cell = (1 << _CELLS) - 1
    touched, times = np.unique(np.concatenate([counters & cell, twice & cell]), return_counts=True)
    often = touched[times > 1]
    back = np.unique(counters[_known(often, counters & cell)[1]])
    begins, ends = _cut(back >> _CELLS)
    shard = table.column("shard")[0].as_py()
    return pa.table({
        "shard": pa.array([shard] * len(begins), pa.int32()), "block": pa.array(back[begins] >> _CELLS).cast(pa.int32()),
        "cells": pa.array([_planes(back[b:e] & cell) for b, e in zip(begins, ends)], pa.binary())})


def _wide(values: np.ndarray) -> bytes:
    """Numbers byte by byte, so that bytes that are alike stand together."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def _narrow(planes: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


def _bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One packed row per block and batch instead of one row per document."""
    options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))
    for batch in batches:
        block = batch.column(0).to_numpy()
        order = np.argsort(block, kind="stable")
        rows = batch.take(pa.array(order)).drop_columns(["block"])
        names, packed = [], []
        for b, e in zip(*_cut(block[order])):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=options) as writer:
                writer.write_batch(rows.slice(int(b), int(e - b)))
            names.append(int(block[order[b]]))
            packed.append(sink.getvalue().to_pybytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(packed, pa.binary())], ["block", "rows"])


def _unbundle(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for packed in batch.column("rows").to_pylist():
        yield from pa.ipc.open_stream(packed)


class _Block:
    """What one block of documents has found so far in pass 2."""

    def __init__(self):
        self.keys: np.ndarray | list = []
        self.found: list[tuple[np.ndarray, ...]] = []

    def rows(self, block: int, shards: int) -> Iterator[tuple]:
        if not self.found:
            return
        one, two, doc, start = (np.concatenate([f[i] for f in self.found]) for i in range(4))
        if not len(one):
            return
        order = np.lexsort((start, doc, two, one))
        one, two, doc, start = one[order], two[order], doc[order], start[order]
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(one))) > 1
        shard = _place(one[first], shards)[0]
        for s in np.unique(shard):
            at = first[shard == s]
            yield int(s), block, one[at].tobytes(), two[at].tobytes(), _wide(doc[at]), _wide(start[at].astype("<i4")), many[shard == s].tobytes()


def _candidates(size: int, shards: int):
    names = ["shard", "block", "one", "two", "doc", "start", "many"]

    def out(rows):
        kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, _Block()
        for block, kind, batch in _by_block(batches):
            if block != now:
                yield out(list(state.rows(now, shards)))
                now, state = block, _Block()
            if kind == 0:
                state.keys += [np.int64(s) << _CELLS | _values(c) for s, c in zip(batch.column("shard").to_pylist(), batch.column("one").to_pylist())]
                continue
            if isinstance(state.keys, list):
                state.keys = np.sort(np.concatenate(state.keys)) if state.keys else np.zeros(0, np.int64)
            for rows in _unbundle(batch):
                ids = rows.column("doc_id").fill_null(_LAST).to_numpy()
                for at, *_, one, two, doc, start in windows(as_text(rows.column("text")), size):
                    shard, cell = _place(one, shards)
                    hit = _known(state.keys, shard << _CELLS | cell)[1]
                    state.found.append((one[hit], two[hit], ids[at:][doc[hit]], start[hit]))
        yield out(list(state.rows(now, shards)))

    return run


def _known(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return at, keys[at] == asked


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """Rows in the order of block and kind (0: answers, 1: documents), cut where either changes."""
    for batch in batches:
        key = batch.column("block").to_numpy().astype(np.int64) * 2 + batch.column("kind").to_numpy()
        for b, e in zip(*_cut(key)):
            yield int(key[b] >> 1), int(key[b] & 1), batch.slice(int(b), int(e - b))


def _first(table: pa.Table) -> pa.Table:
    """Exact groups of one shard: for each block its repeated windows with the place that stays (none if it is not here)."""
    parts = {n: [np.frombuffer(x, k) for x in table.column(n).to_pylist()] for n, k in (("one", "<u8"), ("two", "<u4"), ("many", "?"))}
    parts |= {n: [_narrow(x, k) for x in table.column(n).to_pylist()] for n, k in (("doc", "<i8"), ("start", "<i4"))}
    size = [len(x) for x in parts["one"]]
    block = np.repeat(table.column("block").to_numpy(), size)
    one, two, doc, start, many = (np.concatenate(parts[n]) for n in ("one", "two", "doc", "start", "many"))
    order = np.lexsort((start, doc, two, one))
    one, two, doc, start, many, block = (x[order] for x in (one, two, doc, start, many, block))
    new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    repeated = ((np.bincount(group) > 1) | (np.bincount(group, many) > 0))[group]
    here = (doc == doc[first][group]) & (start == start[first][group])
    stay_doc, stay_start = np.where(here, doc, -_LAST - 1), np.where(here, start, -1)
    rows = []
    order = np.argsort(block[repeated], kind="stable")
    cols = [x[repeated][order] for x in (block, one, two, stay_doc, stay_start)]
    for b, e in zip(*_cut(cols[0])):
        rows.append((int(cols[0][b]), cols[1][b:e].tobytes(), cols[2][b:e].tobytes(), _wide(cols[3][b:e]), _wide(cols[4][b:e].astype("<i4"))))
    kinds = [pa.int32(), *[pa.binary()] * 4]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["block", "one", "two", "doc", "start"])


def _remove(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, ready = None, [], None
        for block, kind, batch in _by_block(batches):
            if block != now:
                now, held, ready = block, [], None
            if kind == 0:
                held += zip(*(batch.column(n).to_pylist() for n in ("one", "two", "doc", "start")))
                continue
            if ready is None:
                read = (lambda x: np.frombuffer(x, "<u8"), lambda x: np.frombuffer(x, "<u4"), lambda x: _narrow(x, "<i8"), lambda x: _narrow(x, "<i4"))
                ready = [np.concatenate([r(h[i]) for h in held] or [r(b"")]) for i, r in enumerate(read)]
                keys = ready[0] ^ words.mix(ready[1].astype(np.uint64))
                order = np.argsort(keys)
                ready, keys, held = [c[order] for c in ready], keys[order], []
            for rows in _unbundle(batch):
                yield cut(rows, ready, keys)

    def cut(rows: pa.RecordBatch, ready: list[np.ndarray], keys: np.ndarray) -> pa.RecordBatch:
        ids, kept, n_words, n_removed = rows.column("doc_id").fill_null(_LAST).to_numpy(), [], [], []
        for at, data, starts, ends, counts, one, two, doc, start in windows(as_text(rows.column("text")), size):
            place, hit = _known(keys, one ^ words.mix(two.astype(np.uint64)))
            hit = np.flatnonzero(hit)
            place = place[hit]
            mine, stay = ids[at:][doc[hit]], ready[2][place]
            hit = hit[(ready[0][place] == one[hit]) & ((mine > stay) | (mine == stay) & (start[hit] > ready[3][place]))]
            first = (np.cumsum(counts) - counts)[doc[hit]] + start[hit]
            cover = np.zeros(len(starts) + 1, np.int64)
            np.add.at(cover, first, 1)
            np.add.at(cover, first + size, -1)
            gone = np.cumsum(cover[:-1]) > 0
            raw, w = data.tobytes(), 0
            for c in counts.tolist():
                lost = gone[w : w + c]
                b, e = starts[w : w + c][~lost], ends[w : w + c][~lost]
                kept.append(b" ".join([raw[x:y] for x, y in zip(b.tolist(), e.tolist())]))
                n_words.append(c)
                n_removed.append(int(lost.sum()))
                w += c
        columns = [rows.column("rest"), rows.column("text"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["rest", "text", "kept", "n_words", "n_removed"])

    return run


def _dealt(docs: DataFrame, count: int) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)).cast("int").alias("block")


def deduplicate(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """The columns of ``docs`` in a struct ``rest`` but for text, then text, kept, n_words, n_removed; one row per row.

    ``kept`` holds the words that no repeated window covers, joined by one blank. A window is repeated if the same words
    also start in a row of smaller doc_id, or of the same doc_id at an earlier word. Rows that repeat an id at the same
    place do not remove each other. Rows without id come after all others. Null texts have no words; texts of fewer
    than ``size`` words lose nothing. An empty table gives no rows.
    """
    count = min(partitions(docs.sparkSession), 1 << 15)
    others = [c for c in docs.columns if c != "text"]
    base = docs.select(F.struct(*others).alias("rest"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base.withColumn("block", _dealt(base, count))
    sketches = base.select("block", "text").mapInArrow(_sketch(size, count), "shard int, counters binary, twice binary")
    often = sketches.groupBy("shard").applyInArrow(_merge, "shard int, block int, cells binary")

    def meet(answers: DataFrame, documents: DataFrame) -> DataFrame:
        both = answers.withColumn("kind", F.lit(0)).unionByName(documents.withColumn("kind", F.lit(1)), allowMissingColumns=True)
        return both.repartitionById(count, F.col("block")).sortWithinPartitions("block", "kind")

    rest = base.schema["rest"].dataType.simpleString()
    packed = lambda *names: base.select("block", *names).mapInArrow(_bundle, "block int, rows binary")
    places = meet(often.select("block", "shard", F.col("cells").alias("one")), packed("doc_id", "text")).mapInArrow(
        _candidates(size, count), "shard int, block int, one binary, two binary, doc binary, start binary, many binary")
    stays = places.groupBy("shard").applyInArrow(_first, "block int, one binary, two binary, doc binary, start binary")
    return meet(stays, packed("doc_id", "text", "rest")).mapInArrow(_remove(size), f"rest {rest}, text string, kept string, n_words long, n_removed long")


def remove_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` with texts cut: what stays of a text that lost words is joined by single blanks, others are unchanged.

    n_chars, where ``docs`` has it, is counted anew for texts that changed.
    """
    found = deduplicate(docs, size)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    cols = {c: F.col(f"rest.`{c}`") for c in docs.columns if c != "text"} | {"text": text}
    if "n_chars" in cols:
        cols["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(cols["n_chars"])
    kinds = dict(docs.dtypes)
    return found.select(*[cols[c].cast(kinds[c]).alias(c) for c in docs.columns])
