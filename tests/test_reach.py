"""Pairs and shares within a reach: crowded cells in parts, pairs in all tasks."""

import math

from pyspark.sql import functions as F

from gridstrata.operators import joins


def crowd(spark):
    """Forty rows around one spot, few far off, one twice and two without a place, all in one partition."""
    rows = [(i, (i * 37 % 11) / 10.0, (i * 91 % 13) / 10.0) for i in range(40)] + [(100 + i, 5.0 + i, -3.0 * i) for i in range(6)]
    rows += [(3, 3 * 37 % 11 / 10.0, 3 * 91 % 13 / 10.0), (200, None, 1.0), (201, 1.0, None)]
    return rows, spark.createDataFrame(rows, "id long, x double, y double").coalesce(1)


def test_crowded_cells_are_compared_in_parts(spark, monkeypatch):
    rows, df = crowd(spark)
    placed = [r for r in rows if None not in r]
    want = sorted((a[0], b[0]) for a in placed for b in placed if (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 0.25)
    monkeypatch.setattr(joins, "CELL_ROWS", 4, raising=False)
    pairs = joins.within_distance(df, df, "x", "y", 0.5)
    assert sorted((r["id"], r["id_2"]) for r in pairs.collect()) == want
    assert pairs.columns == ["id", "x", "y", "id_2", "x_2", "y_2", "d2"]


def test_pairs_are_made_in_all_tasks(spark):
    _, df = crowd(spark)
    far = df.select(F.col("id"), (F.col("x") + F.col("id")).alias("x"), "y")
    for pairs in (joins.within_distance(far, far, "x", "y", 0.5), joins.within_km(far, far, "y", "x", 10.0)):
        assert pairs.select(F.spark_partition_id()).distinct().count() > 1


def test_facts_in_reach_are_added_up_without_pairs(spark, monkeypatch):
    rows, df = crowd(spark)
    monkeypatch.setattr(joins, "CELL_ROWS", 4, raising=False)
    monkeypatch.setattr(joins, "_AT_ONCE", 3, raising=False)
    rows = rows + [(300, 89.999, 0.0), (301, 89.999, 180.0), (302, 0.0, 179.9999), (303, 0.0, -179.9999), (304, float("nan"), 1.0)]
    df = spark.createDataFrame([(i, i % 2, x, y) for i, x, y in rows], "id long, side int, x double, y double")
    facts = [(i, None if m == 2 else f"m{m}", v) for i, *_ in rows for m, v in enumerate((1.5, None, i * 1.0)) if (i + m) % 3]
    facts += [(7, "m0", 4.0), (7, "m0", 4.0), (100, "only here", float("inf")), (None, "m0", 1.0), (9999, "m0", 1.0)]
    other = spark.createDataFrame(facts, "id_b long, m string, v double")
    km = lambda a, b: 2 * 6371.0 * math.asin(math.sqrt(min(1.0, math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2)))
    placed = [r for r in rows if None not in r and r[1] == r[1]]
    for keys in ((), ("side",)):
        want = {}
        for at, a in enumerate(placed):
            for b in placed:
                if km(a, b) <= 60.0 and not (keys and (a[0] - b[0]) % 2):
                    for i, m, v in facts:
                        if i == b[0]:
                            n, total = want.get((at, m), (0, 0.0))
                            want[at, m] = (n + 1, total + (v or 0.0))
        got = joins.within_km(df, df.withColumnRenamed("id", "id_b"), "x", "y", 60.0, keys=keys, facts=other, on="id_b", by="m", total="v")
        assert got.columns == ["id", "side", "x", "y", "m", "n", "total"]
        plain = lambda many: sorted(((i, m or "", n, round(t, 6)) for i, m, n, t in many))
        assert plain((r["id"], r["m"], r["n"], r["total"]) for r in got.collect()) == plain((placed[at][0], m, *nt) for (at, m), nt in want.items())
        assert any(math.isinf(t) for _, t in want.values()) and any(n > 2 for n, _ in want.values())


def test_places_at_the_very_limit_are_decided_by_the_haversine_formula():
    from gridstrata.functions import geo

    lat, lon = [0.0, 0.0, 10.0, 0.0], [0.0, 3.0, 3.0, 180.0]
    exact = 2 * geo.EARTH_KM * math.asin(math.sqrt(math.sin(math.radians(3.0) / 2) ** 2))
    near = geo.within_km(lat, lon, lat, lon, exact)
    assert near.tolist() == [[True, True, False, False], [True, True, False, False], [False, False, True, False], [False, False, False, True]]
    assert not geo.within_km(lat, lon, lat, lon, exact * (1 - 1e-15))[0, 1]
    assert geo.within_km(lat, lon, lat, lon, 20100.0).all()


def test_radius_query_forms_no_rows_for_pairs(spark, small):
    from gridstrata.plans import QUERIES

    plan = QUERIES["join_radius_haversine"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "ASIN" not in plan.upper()
