"""Near-duplicate documents by SimHash fingerprints that meet at anchor points of a covering code.

Fingerprints of 64 bits link at ``THRESHOLD`` = 2 or fewer differing bits. The anchors are the words of a perfect code: the
Hamming code of length 63, whose words lie within one bit of every point (covering radius 1), times both values of the
last bit. Two fingerprints within 2 bits have a point between them within 1 bit of each; the anchor that covers it
lies within the covering radius plus 1 of both. So replicating *both* to every anchor within the radius plus half the
threshold (33 anchors at most) brings every pair together, where replicating one side only would need the radius plus
the whole threshold. An anchor is met only by points within 2 bits of it: at most 2081 distinct fingerprints, however
many documents there are, since equal fingerprints are one row before they are replicated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstrata.llm import words
from gridstrata.llm.common import as_text, checkpoint, spread
from gridstrata.llm.components import components, stars

THRESHOLD = 2
SHINGLE = 3
SEED = 42
_ONE = np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _bits(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per document the 64 bits that are set in over half of its hashes."""
    out = np.zeros(len(counts), np.uint64)
    ends = np.cumsum(counts)
    at, place = 0, _ONE << np.arange(64, dtype=np.uint64)
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] - counts[at] + (1 << 16), "right")))
        first = ends[at] - counts[at]
        sums = np.zeros((to - at, 64), np.int64)
        for lo in range(int(first), int(ends[to - 1]), 1 << 18):  # one document may be longer than a slice
            hi = min(int(ends[to - 1]), lo + (1 << 18))
            bits = np.unpackbits(h[lo:hi].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = ends[at:to] - counts[at:to]
            some = np.flatnonzero((counts[at:to] > 0) & (starts < hi) & (ends[at:to] > lo))
            sums[some] += np.add.reduceat(bits, np.maximum(starts[some], lo) - lo, axis=0, dtype=np.int64)
        out[at:to] = (np.where(2 * sums > counts[at:to, None], place, np.uint64(0))).sum(axis=1, dtype=np.uint64)
        at = to
    return out


def fingerprints(texts: pa.Array) -> np.ndarray:
    """SimHash of each text: A-Z lower-cased, runs of 3 words joined by one blank, XXH64 with seed 42, bits by majority."""
    data, places = words.buffers(texts)
    data = _LOWER[data]
    starts, ends, counts = words.spans(data, places)
    n = np.where(counts == 0, 0, np.maximum(1, counts - SHINGLE + 1))
    h = np.empty(int(n.sum()), np.uint64)
    digest, k, w = xxhash.xxh64_intdigest, 0, 0
    # one blank between words: where texts have other gaps, the words are joined anew
    for i, c in enumerate(counts.tolist()):
        if not c:
            continue
        own, to = starts[w : w + c], ends[w : w + c]
        raw = data[places[i] : places[i + 1]].tobytes()
        begins, stops = own - places[i], to - places[i]
        gaps = begins[1:] - stops[:-1]
        if (gaps != 1).any() or (data[to[:-1]] != 32).any():
            raw = b" ".join(raw.split(None))
            lengths = to - own
            stops = np.cumsum(lengths) + np.arange(c)
            begins = stops - lengths
        m = int(n[i])
        b, s = begins[:m].tolist(), stops[min(SHINGLE, c) - 1 :].tolist()
        h[k : k + m] = [digest(raw[x:y], SEED) for x, y in zip(b, s)]
        k, w = k + m, w + c
    return _bits(h, n)


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = fingerprints(as_text(batch.column(1))).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], ["doc_id", "bits"])


def with_bits(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, bits): the fingerprint as a signed long; null and blank texts have fingerprint 0."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_print_batches, "doc_id long, bits long")


def syndromes(points: np.ndarray) -> np.ndarray:
    """The syndrome of bits 0 to 62 in the Hamming code: the place (from 1) of the bit to flip, 0 at a code word."""
    out = np.zeros(len(points), np.uint64)
    for j in range(6):
        mask = sum(1 << (i - 1) for i in range(1, 64) if i >> j & 1)
        odd = points & np.uint64(mask)
        for shift in (32, 16, 8, 4, 2, 1):
            odd ^= odd >> np.uint64(shift)
        out |= (odd & _ONE) << np.uint64(j)
    return out


def anchors(points: np.ndarray) -> np.ndarray:
    """All anchors within the covering radius plus one of each point, as a matrix whose rows may repeat an anchor."""
    s = syndromes(points)
    near = np.empty((len(points), 65), np.uint64)
    flip = lambda at: np.where(at > 0, _ONE << (np.maximum(at, _ONE) - _ONE), np.uint64(0))
    near[:, 0] = points ^ flip(s)
    near[:, 64] = near[:, 0] ^ (_ONE << np.uint64(63))
    for i in range(1, 64):
        moved = np.uint64(i)
        near[:, i] = points ^ (_ONE << (moved - _ONE)) ^ flip(s ^ moved)
    return near


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, points = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        for lo in range(0, len(points), 20_000):
            near = np.sort(anchors(points[lo : lo + 20_000]), axis=1)
            fresh = np.ones(near.shape, bool)
            fresh[:, 1:] = near[:, 1:] != near[:, :-1]
            row = np.nonzero(fresh)[0] + lo
            yield pa.RecordBatch.from_arrays(
                [pa.array(near[fresh].view(np.int64)), pa.array(points[row].view(np.int64)), pa.array(node[row])],
                ["anchor", "bits", "node"])


def close_pairs(key: np.ndarray, bits: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows (in the order of key) with equal keys whose bits differ in at most ``THRESHOLD`` places."""
    us, vs, live = [], [], np.arange(len(key))
    step = 1
    while len(live := live[live + step < len(key)]) and len(live := live[key[live] == key[live + step]]):
        hit = live[np.bitwise_count(bits[live] ^ bits[live + step]) <= THRESHOLD]
        us.append(node[hit])
        vs.append(node[hit + step])
        step += 1
        if sum(map(len, us)) > 4_000_000:
            us, vs = ([x] for x in stars(np.concatenate(us), np.concatenate(vs)))
    if not us:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return stars(np.concatenate(us), np.concatenate(vs))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in the order of their anchor; the last anchor of a batch waits for the next batch."""
    kept = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]

    def out(cols):
        u, v = close_pairs(*cols)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    for batch in batches:
        own = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()]
        kept = [np.concatenate(x) for x in zip(kept, own)]
        cut = int(np.searchsorted(kept[0], kept[0][-1])) if len(kept[0]) else 0
        if cut:
            yield out([x[:cut] for x in kept])
            kept = [x[cut:] for x in kept]
    yield out(kept)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, bits, component_id), one per row of ``docs``.

    component_id is the smallest doc_id that links of at most 2 differing bits reach. Null and blank texts have
    fingerprint 0 and link like any other; repeated rows and repeated ids link by their fingerprints. A row without
    doc_id gets its fingerprint, takes no part in links and has no component. Other columns are not read.
    """
    prints = checkpoint(with_bits(docs))
    nodes = checkpoint(prints.where("doc_id IS NOT NULL").groupBy("bits").agg(F.min("doc_id").alias("node")))
    placed = nodes.select("node", "bits").mapInArrow(_replicate, "anchor long, bits long, node long")
    links = spread(placed, "anchor").mapInArrow(_compare, "u long, v long")
    # an id that comes with several texts joins their fingerprints
    named = prints.where("doc_id IS NOT NULL").select("doc_id", "bits")
    several = named.groupBy("doc_id").agg(F.min("bits").alias("lo"), F.max("bits").alias("hi")).where("lo <> hi").select("doc_id")
    ids = named.join(several, "doc_id", "left_semi").distinct().join(nodes, "bits").select(F.col("node").alias("u"), "doc_id")
    ids = ids.join(ids.groupBy("doc_id").agg(F.min("u").alias("v")), "doc_id").select("u", "v")
    found = components(links.unionByName(ids))
    classes = nodes.join(found, "node", "left").select("bits", F.coalesce("component", "node").alias("component_id"))
    classes = checkpoint(classes)
    known = prints.where("doc_id IS NOT NULL").join(classes, "bits").select("doc_id", "bits", "component_id")
    none = prints.where("doc_id IS NULL").select("doc_id", "bits", F.lit(None).cast("long").alias("component_id"))
    return known.unionByName(none)


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of its group of near duplicates, once each.

    Rows without doc_id stay as they are. Of rows that share the smallest id the first by text stays.
    """
    names = docs.columns
    keep = near_duplicates(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_keep")).distinct()
    rest = docs.where("doc_id IS NOT NULL").join(keep, F.col("doc_id") == F.col("_keep"), "left_semi")
    first = rest.groupBy("doc_id").agg(F.min_by(F.struct(*names), F.struct("text")).alias("_row")).select("_row.*")
    return first.select(*names).unionByName(docs.where("doc_id IS NULL"))
