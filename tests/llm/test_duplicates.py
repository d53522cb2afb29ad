"""SimHash groups, repeated passages and near vectors against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from gridstrata.llm import components, forest, simhash, substrings, tiles
from gridstrata.llm.queries import ORACLES, QUERIES
from gridstrata.sources.tables import table
from tests.oracle import compare, connect


def groups(n, links):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_simhash(rows):
    rows = [(i, fingerprint(t)) for i, t in rows if i is not None]
    nodes = sorted({i for i, _ in rows})
    links = [(nodes.index(a), nodes.index(b)) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= 2]
    root = groups(len(nodes), links)
    return sorted((i, f, nodes[root[nodes.index(i)]]) for i, f in rows)


def test_roots_and_stars():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a, b = rng.integers(0, 40, 30), rng.integers(0, 40, 30)
        assert components.roots(a, b, 40).tolist() == groups(40, zip(a.tolist(), b.tolist()))


def test_components_of_chains_stars_and_nothing(base):
    chain = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1300)] + [(5000, 5000), (None, 3)]
    got = {r.node: r.component for r in components.components(base.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1300)}
    assert components.components(base.createDataFrame([], "u long, v long")).count() == 0


def test_anchors_meet_for_all_pairs_within_two_bits():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 2**63, 500, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 500, dtype=np.uint64)
    assert max(len(set(r)) for r in simhash.anchors(x).tolist()) <= 33
    for _ in range(4):
        y = x.copy()
        for bit in rng.integers(0, 64, (2, 500)):
            y ^= np.uint64(1) << bit.astype(np.uint64)
        assert all(set(a) & set(b) for a, b in zip(simhash.anchors(x).tolist(), simhash.anchors(y).tolist()))


def test_fingerprints_and_groups_equal_brute_force(make, hard, base, small):
    rng = random.Random(2)
    text = hard[5][1]
    near = [(200 + i, text + f" tail{i % 3} more{i}") for i in range(30)] + [(300 + i, " ".join(rng.sample(text.split(), 12))) for i in range(40)]
    rows = hard + near
    got = simhash.near_duplicates(make(rows)).collect()
    assert sorted((r.doc_id, r.bits & (2**64 - 1), r.component_id) for r in got if r.doc_id is not None) == brute_simhash(rows)
    assert len(got) == len(rows) and all(r.component_id is None for r in got if r.doc_id is None)
    assert simhash.near_duplicates(make([])).count() == 0
    rows = [(r.doc_id, r.text) for r in table(base, small, "documents").collect()]
    got = QUERIES["op4_simhash_anchors"](base, small).collect()
    assert sorted((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got) == brute_simhash(rows)


def test_close_pairs_of_a_large_group_are_a_star():
    bits = np.arange(64, dtype=np.uint64)
    bits = np.concatenate([[0], np.uint64(1) << bits]).astype(np.uint64)
    u, v = simhash.close_pairs(np.zeros(65, np.int64), bits, np.arange(65))
    assert v.tolist() == [0] * 64 and u.tolist() == list(range(1, 65))


def test_one_row_of_each_group_stays(make, hard):
    kept = simhash.one_per_group(make(hard))
    assert kept.columns == make(hard).columns
    want = {c for *_, c in brute_simhash(hard)}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 2


def brute_substrings(rows, size=20):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    first = {}
    key = lambda i, s: (rows[i][0] is None, rows[i][0] or 0, s)
    for i, w in enumerate(words):
        for s in range(len(w) - size + 1):
            k = tuple(w[s : s + size])
            first[k] = min(first.get(k, (True, 1 << 62, 0)), key(i, s))
    out = []
    for i, w in enumerate(words):
        gone = set()
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < key(i, s):
                gone |= set(range(s, s + size))
        out.append((rows[i][0], len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shift", [0, 3])
def test_repeated_passages_equal_brute_force(make, hard, shift):
    rng = random.Random(shift)
    rows = hard + [(100 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 70 + shift)))) for i in range(60)]
    got = [(r.rest.doc_id, r.n_words, r.n_removed, r.kept) for r in substrings.deduplicate(make(rows)).collect()]
    assert sorted(got, key=repr) == brute_substrings(rows)
    cut = substrings.remove_repeats(make(rows))
    assert cut.columns == make(rows).columns and cut.count() == len(rows)
    assert all(r.text is None or r.n_chars == len(r.text) for r in cut.collect())
    assert substrings.deduplicate(make([])).count() == 0


@pytest.mark.parametrize("name", list(ORACLES))
def test_queries_equal_sql(base, small, name):
    assert compare(QUERIES[name](base, small).toPandas(), connect(small).execute(ORACLES[name]).fetchdf()) is None


@pytest.fixture(scope="module")
def odd_vectors():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 12))
    x[100:160] = x[99] * rng.uniform(0.5, 3, (60, 1)) + rng.normal(size=(60, 12)) * np.linspace(0.02, 0.4, 60)[:, None]
    x[200] = x[201]
    x[202] = x[201] * 1e-150
    x[203] = x[201] * 1e150
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(500, None, 1), (501, [0.0] * 12, 1), (502, [1.0] * 11 + [None], 1), (503, [float("nan")] * 12, 1), (504, [float("inf")] * 12, 1), (505, [], 1), (None, [1.0] * 12, 1), (200, x[200].tolist(), 2)]
    return rows, x


@pytest.mark.parametrize("block", [4096, 50])
def test_near_vectors_equal_brute_force(base, odd_vectors, block):
    rows, x = odd_vectors
    df = base.createDataFrame(rows, "vec_id long, embedding array<double>, n_links int")
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hit = unit @ unit.T >= 0.95
    np.fill_diagonal(hit, False)
    root = groups(400, zip(*(a.tolist() for a in np.nonzero(hit))))
    want = [(i, int(hit[i].sum()), root[i], root[i] == i) for i in range(400)] + [(i, 0, i, True) for i in range(500, 506)]
    assert sorted(map(tuple, tiles.near_vectors(df, block_rows=block).collect())) == want
    assert tiles.near_vectors(df.where("false")).count() == 0


def test_tile_bounds_lose_no_pair():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 64))
    y = x[rng.integers(0, 300, 300)] + rng.normal(size=(300, 64)) * rng.uniform(0.2, 0.5, (300, 1))
    i, j = tiles.tile(x, y, 0.95, False)
    cos = (x / np.linalg.norm(x, axis=1)[:, None]) @ (y / np.linalg.norm(y, axis=1)[:, None]).T
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(cos >= 0.95))))


def test_forest_recall_and_scores(base, small):
    vectors = {r.vec_id: np.array(r.embedding, float) for r in table(base, small, "embeddings").collect()}
    found = defaultdict(list)
    for r in QUERIES["op6_hash_forest"](base, small).orderBy("query_id", "rank").collect():
        assert r.score == pytest.approx(float(np.sqrt(((vectors[r.query_id] - vectors[r.vec_id]) ** 2).sum())), abs=1e-12)
        found[r.query_id].append(r.vec_id)
    assert set(found) == {i for i in vectors if i % 100 == 0}
    hits = 0
    for q, got in found.items():
        near = sorted((float(((vectors[q] - v) ** 2).sum()), i) for i, v in vectors.items() if i != q)[:10]
        hits += len({i for _, i in near} & set(got))
    assert hits >= 9 * len(found)


def test_forest_takes_ties_few_rows_and_odd_vectors(base, odd_vectors):
    rows, _ = odd_vectors
    df = base.createDataFrame([(0, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (2, [1.0, 2.0], 1), (100, [5.0, 2.0], 1)], "vec_id long, embedding array<double>, rank int")
    got = [tuple(r) for r in forest.neighbours(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 0.0), (0, 2, 3, 0.0), (0, 3, 100, 4.0), (100, 1, 0, 4.0), (100, 2, 2, 4.0), (100, 3, 3, 4.0)]
    odd = base.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r.query_id for r in forest.neighbours(odd, block_rows=60).collect()} == {0, 100, 200, 300}
    assert forest.neighbours(odd.where("false")).count() == 0


