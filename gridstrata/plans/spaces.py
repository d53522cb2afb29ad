"""Graphs, clusters, spatial tables, rasters and volumes."""

from pyspark.sql import functions as F

from gridstrata.operators import density, graph, joins, spatial, volume
from gridstrata.plans.base import cells, grid, long, points, r6, stations, with_
from gridstrata.plans.joining import EDGES, INSIDE, RING, zones
from gridstrata.plans.profiles import rounded
from gridstrata.plans.registry import query
from gridstrata.sources import table


def links(spark, sf):
    """County graph: customers next to each other in number are near, those 7 apart are far links."""
    ids = table(spark, sf, "customer").select(F.col("c_custkey").alias("src"))
    offsets = F.explode(F.array(*map(F.lit, (-1, 1, -7, 7)))).alias("o")
    e = ids.select("src", offsets).select("src", (F.col("src") + F.col("o")).alias("dst"), (F.abs("o") == 1).alias("near"))
    return e.join(ids.select(F.col("src").alias("dst")), "dst", "left_semi")


LINKS = {
    "e": """SELECT a.c_custkey AS src, b.c_custkey AS dst, o IN (-1, 1) AS near FROM (SELECT c_custkey, unnest([-1, 1, -7, 7]) AS o FROM customer) a
            JOIN customer b ON b.c_custkey = a.c_custkey + a.o""",
    "n": "SELECT src, dst FROM e WHERE near", "f": "SELECT src, dst FROM e WHERE NOT near",
    "d1": "SELECT DISTINCT src, dst FROM n",
    "d2": """SELECT DISTINCT src, dst FROM (SELECT a.src, b.dst FROM d1 a JOIN n b ON b.src = a.dst UNION ALL SELECT * FROM f) WHERE src <> dst AND (src, dst) NOT IN (SELECT (src, dst) FROM d1)""",
    "d3": """SELECT DISTINCT src, dst FROM (SELECT a.src, b.dst FROM d2 a JOIN n b ON b.src = a.dst UNION ALL SELECT a.src, b.dst FROM d1 a JOIN f b ON b.src = a.dst)
             WHERE src <> dst AND (src, dst) NOT IN (SELECT (src, dst) FROM d1 UNION ALL SELECT (src, dst) FROM d2)""",
    "d4": """SELECT DISTINCT src, dst FROM (SELECT a.src, b.dst FROM d3 a JOIN n b ON b.src = a.dst UNION ALL SELECT a.src, b.dst FROM d2 a JOIN f b ON b.src = a.dst)
             WHERE src <> dst AND (src, dst) NOT IN (SELECT (src, dst) FROM d1 UNION ALL SELECT (src, dst) FROM d2 UNION ALL SELECT (src, dst) FROM d3)""",
    "h": "SELECT src, dst, 1 AS degree FROM d1 UNION ALL SELECT src, dst, 2 FROM d2 UNION ALL SELECT src, dst, 3 FROM d3 UNION ALL SELECT src, dst, 4 FROM d4",
}


@query(
    "graph_k_hop",
    with_(**LINKS) + "SELECT src, CAST(degree AS BIGINT) AS degree, count(*) AS n, round(sum(c_acctbal), 2) AS area FROM h JOIN customer ON c_custkey = dst GROUP BY 1, 2",
)
def graph_k_hop(spark, sf):
    hops = graph.k_hop(links(spark, sf))
    area = table(spark, sf, "customer").select(F.col("c_custkey").alias("dst"), "c_acctbal")
    return hops.join(area, "dst").groupBy("src", long("degree").alias("degree")).agg(F.count(F.lit(1)).alias("n"), r6(F.sum("c_acctbal"), 2).alias("area"))


@query(
    "graph_neighbour_agg",
    with_("grid", **LINKS, own="SELECT bldg_id, ts, energy, 0 AS degree FROM grid UNION ALL SELECT h.src, g.ts, g.energy, h.degree FROM grid g JOIN h ON h.dst = g.bldg_id WHERE h.degree <= 2")
    + """SELECT bldg_id, ts, round(sum(energy) FILTER (degree = 1), 6) AS energy_degree_1, round(sum(energy) FILTER (degree = 2), 6) AS energy_degree_2, round(sum(energy), 6) AS energy_all FROM own GROUP BY 1, 2""",
)
def graph_neighbour_agg(spark, sf):
    hops = graph.k_hop(links(spark, sf), degrees=2)
    return rounded(graph.neighbour_sums(grid(spark, sf), hops, "bldg_id", "ts", "energy", (1, 2)), ["bldg_id"])


@query(
    "graph_adjacency_by_distance",
    with_("points") + """SELECT a.pid AS src, b.pid AS dst, CASE WHEN pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 1 THEN 'adjacent' ELSE 'far' END AS kind
    FROM points a JOIN points b ON a.pid <> b.pid AND abs(a.x - b.x) <= 1.5 AND abs(a.y - b.y) <= 1.5 AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 2.25""",
)
def graph_adjacency_by_distance(spark, sf):
    p = points(spark, sf).select("pid", "x", "y")
    pairs = joins.within_distance(p, p, "x", "y", 1.5).where("pid <> pid_2")
    kind = F.when(F.col("d2") <= 1, "adjacent").otherwise("far")
    return pairs.select(F.col("pid").alias("src"), F.col("pid_2").alias("dst"), kind.alias("kind"))


def density_sql(points: str, eps: float, need: int, **before: str) -> str:
    """Clusters of rows (g, id, x, y) by pairs of places and the reach of each core along cores."""
    steps = with_(
        **before,
        pt=points,
        pl="SELECT g, x, y, count(*) AS n, min(id) AS p FROM pt GROUP BY ALL",
        pr=f"""SELECT a.p, b.p AS q, b.n FROM pl a JOIN pl b ON a.g = b.g AND abs(a.x - b.x) <= {eps} AND abs(a.y - b.y) <= {eps}
            AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {eps * eps}""",
        co=f"SELECT p FROM pr GROUP BY p HAVING sum(n) >= {need}",
        ed="SELECT p, q FROM pr WHERE p IN (FROM co) AND q IN (FROM co)",
        re="SELECT p, q FROM ed UNION SELECT re.p, ed.q FROM re JOIN ed ON ed.p = re.q",
        cl="SELECT p, min(q) AS c FROM re GROUP BY p",
        bo="SELECT pr.p, min(c) AS c FROM pr JOIN cl ON cl.p = pr.q WHERE pr.p NOT IN (FROM co) GROUP BY pr.p",
        fo="SELECT pl.*, coalesce(cl.c, bo.c, -1) AS cluster, CASE WHEN cl.c IS NULL THEN 0 ELSE 1 END AS core FROM pl LEFT JOIN cl USING (p) LEFT JOIN bo USING (p)",
    )
    return steps.replace("WITH ", "WITH RECURSIVE ", 1)


@query(
    "cluster_density_hourly",
    density_sql("SELECT date_trunc('hour', ts) AS g, event_id AS id, (user_id * 37) % 101 / 10.0::DOUBLE AS x, (user_id * 53) % 97 / 10.0::DOUBLE AS y FROM events WHERE value >= 5", 2.0, 3)
    + "SELECT pt.g AS hour, pt.id AS event_id, CAST(cluster AS BIGINT) AS cluster, CAST(core AS BIGINT) AS core FROM pt JOIN fo ON fo.g = pt.g AND fo.x = pt.x AND fo.y = pt.y",
)
def cluster_density_hourly(spark, sf):
    events = table(spark, sf, "events").where("value >= 5").select(
        F.date_trunc("hour", "ts").alias("hour"), "event_id", ((F.col("user_id") * 37) % 101 / 10.0).alias("x"), ((F.col("user_id") * 53) % 97 / 10.0).alias("y")
    )
    out = density.density_clusters(events, ["hour"], "event_id", "x", "y", 2.0, 3)
    return out.select("hour", "event_id", long("cluster").alias("cluster"), long("core").alias("core"))


ELLIPSE = {
    "m": "SELECT nation, sum(x * w) / sum(w) AS cx, sum(y * w) / sum(w) AS cy, count(*) AS n, sum(w) - sum(w * w) / sum(w) AS f FROM p GROUP BY 1",
    "c": """SELECT p.nation, any_value(cx) AS cx, any_value(cy) AS cy, any_value(n) AS n, sum(w * (x - cx) * (x - cx)) / any_value(f) AS vxx, sum(w * (y - cy) * (y - cy)) / any_value(f) AS vyy,
            sum(w * (x - cx) * (y - cy)) / any_value(f) AS vxy FROM p JOIN m ON m.nation = p.nation GROUP BY 1""",
    "d": """SELECT p.*, c.n, sqrt((pow(x - cx, 2) * vyy - 2 * (x - cx) * (y - cy) * vxy + pow(y - cy, 2) * vxx) / (vxx * vyy - vxy * vxy)) AS d FROM p JOIN c ON c.nation = p.nation""",
    "k": "SELECT d.* FROM d JOIN (SELECT nation, quantile_cont(d, 0.9) AS q FROM d GROUP BY 1) q ON q.nation = d.nation WHERE n < 10 OR d <= q",
    "m2": "SELECT nation, sum(x * w) / sum(w) AS cx, sum(y * w) / sum(w) AS cy, count(*) AS n, avg(w) AS weight, sum(w) - sum(w * w) / sum(w) AS f FROM k GROUP BY 1",
    "c2": """SELECT k.nation, any_value(cx) AS cx, any_value(cy) AS cy, any_value(m2.n) AS n, any_value(weight) AS weight, sum(w * (x - cx) * (x - cx)) / any_value(f) AS vxx, sum(w * (y - cy) * (y - cy)) / any_value(f) AS vyy,
             sum(w * (x - cx) * (y - cy)) / any_value(f) AS vxy FROM k JOIN m2 ON m2.nation = k.nation GROUP BY 1""",
}


@query(
    "ellipse_weighted",
    with_("points", p="SELECT nation * 1000 + pid % 7 AS nation, x, y, weight + 2000 AS w FROM points", **ELLIPSE)
    + """SELECT nation AS zone, round(cx, 6) AS cx, round(cy, 6) AS cy, round(4 * sqrt((vxx + vyy) / 2 + sqrt(pow((vxx - vyy) / 2, 2) + vxy * vxy)), 4) AS width,
         round(4 * sqrt(greatest((vxx + vyy) / 2 - sqrt(pow((vxx - vyy) / 2, 2) + vxy * vxy), 0)), 4) AS height, round(degrees(atan2(2 * vxy, vxx - vyy) / 2), 4) AS angle, round(weight, 6) AS weight, n AS size FROM c2 WHERE n > 3""",
)
def ellipse_weighted(spark, sf):
    p = points(spark, sf).select((F.col("nation").cast("bigint") * 1000 + F.col("pid") % 7).alias("zone"), "x", "y", (F.col("weight") + 2000).alias("w"))
    e = spatial.weighted_ellipse(p, ["zone"], "x", "y", "w").where("size > 3")
    e = e.withColumns({c: r6(c, 4) for c in ("width", "height", "angle")})
    return rounded(e, ["zone"])


CENTROIDS = """SELECT CAST(epoch(date_trunc('hour', ts)) / 3600 AS BIGINT) * 10 + user_id % 10 AS cid, CAST(epoch(date_trunc('hour', ts)) / 3600 AS BIGINT) AS hour, 30 + sum(user_id % 50) / count(*) / 5 AS lat,
    -100 + sum(user_id % 70) / count(*) / 5 AS lon, sum(value) / 0.0097 / count(*) AS weight, count(*) AS size FROM events GROUP BY user_id % 10, 1, 2"""


def centroids(spark, sf):
    """One weighted centre per hour and tenth of the users."""
    hour = F.floor(F.unix_timestamp("ts") / 3600)
    rows = table(spark, sf, "events").withColumns({"hour": hour, "c": F.col("user_id") % 10})
    n = F.count(F.lit(1))
    return rows.groupBy("hour", "c").agg(
        (30 + F.sum(F.col("user_id") % 50) / n / 5).alias("lat"), (-100 + F.sum(F.col("user_id") % 70) / n / 5).alias("lon"),
        (F.sum("value") / 0.0097 / n).alias("weight"), n.alias("size"),
    ).select((F.col("hour") * 10 + F.col("c")).alias("cid"), "hour", "lat", "lon", "weight", "size")


HAVERSINE = """2 * 6371 * asin(sqrt(least(1.0, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"""
MOTION = {
    "ce": CENTROIDS,
    "j": f"SELECT a.*, b.cid AS cid1, a.hour - b.hour AS n, b.lat AS lat1, b.lon AS lon1, b.weight AS w1, b.size AS s1, {HAVERSINE} AS km FROM ce a JOIN ce b ON a.hour - b.hour BETWEEN 1 AND 4",
    "b": "SELECT *, row_number() OVER (PARTITION BY cid ORDER BY n, km, cid1) AS rn FROM j WHERE km <= 100 * n",
    "v": """SELECT cid, hour, lat, lon, weight, size, (lat - lat1) / n AS lat_diff, (lon - lon1) / n AS lon_diff, (weight - w1) / n AS weight_diff, size - s1 AS size_diff
            FROM b WHERE rn = 1 AND (lat <> lat1 OR lon <> lon1)""",
}


@query(
    "cluster_motion",
    with_(**MOTION) + "SELECT cid, hour, round(lat, 6) AS lat, round(lon, 6) AS lon, round(weight, 4) AS weight, size, round(lat_diff, 6) AS lat_diff, round(lon_diff, 6) AS lon_diff, round(weight_diff, 4) AS weight_diff, size_diff FROM v",
)
def cluster_motion(spark, sf):
    v = spatial.cluster_motion(centroids(spark, sf), "cid", "hour", "lat", "lon", "weight", "size")
    return rounded(v.withColumns({"weight": r6("weight", 4), "weight_diff": r6("weight_diff", 4)}), ["cid"])


@query("cluster_merge_similar")
def cluster_merge_similar(spark, sf):
    v = spatial.cluster_motion(centroids(spark, sf), "cid", "hour", "lat", "lon", "weight", "size")
    v = v.withColumns({"width": 1 + F.col("cid") % 7 / F.lit(10.0), "height": 0.5 + F.col("cid") % 5 / F.lit(10.0), "angle": (F.col("cid") % 6).cast("double")})
    # Largest differences of vectors that count as one.
    limits = {"lat": 0.25, "lon": 0.25, "lat_diff": 0.5, "lon_diff": 0.5, "width": 0.8, "height": 0.8, "angle": 5.0, "size": 30.0}
    out = graph.merge_similar(v, "hour", "cid", limits, "size", F.col("width") * F.col("height"))
    return rounded(out.select("cid", "hour", "lat", "lon", "size"), ["cid"])


PLACES = """SELECT s_suppkey AS county, 28 + ((s_suppkey * 53) % 141) / 10.0 AS lat, -102 + ((s_suppkey * 29) % 183) / 10.0 AS lon FROM supplier"""


@query(
    "hit_zone_projection",
    with_(
        **MOTION, co=PLACES, nb="SELECT a.county, b.county AS other FROM co a JOIN co b ON b.county = a.county + 1 OR b.county = a.county - 1",
        h="""SELECT cid AS vid, hour AS ts, h, round(greatest(least(weight / 600, 10), 0) + greatest(least(h * weight_diff / 250, 3), -3) + greatest(least(size_diff / 2, 10), -1), 1) AS impact,
             lat + h * lat_diff AS py, lon + h * lon_diff AS px, 1.5 + cid % 4 / 4.0::DOUBLE AS w, 1.0 + cid % 3 / 4.0::DOUBLE AS ht, (cid % 90)::DOUBLE AS angle FROM (SELECT *, unnest([3, 6]) AS h FROM v)""",
        g="SELECT * REPLACE (w + CASE WHEN impact > 0 THEN h * 0.15 ELSE 0 END AS w, ht + CASE WHEN impact > 0 THEN h * 0.15 ELSE 0 END AS ht) FROM h",
        i="""SELECT g.*, county FROM g JOIN co ON abs(co.lon - px) <= greatest(w, ht) / 2 + 0.01 AND abs(co.lat - py) <= greatest(w, ht) / 2 + 0.01
             AND pow(((co.lon - px) * cos(radians(angle)) + (co.lat - py) * sin(radians(angle))) / (w / 2), 2) + pow(((co.lat - py) * cos(radians(angle)) - (co.lon - px) * sin(radians(angle))) / (ht / 2), 2) <= 1""",
        a="SELECT DISTINCT vid, ts, h, impact, py, px, other AS county FROM i JOIN nb ON nb.county = i.county",
        s="SELECT vid, h, count(*) AS n_hit FROM (SELECT vid, h FROM i UNION ALL SELECT vid, h FROM a) GROUP BY 1, 2",
        r="SELECT DISTINCT vid, ts, h, impact, py, px, county FROM (SELECT vid, ts, h, impact, py, px, county FROM i UNION ALL SELECT * FROM a)",
        d="SELECT r.*, n_hit, sqrt(pow(co.lon - px, 2) + pow(co.lat - py, 2)) * 111 AS distance FROM r JOIN co ON co.county = r.county JOIN s ON s.vid = r.vid AND s.h = r.h",
        p="SELECT *, round(greatest(impact, 0) / greatest(least(pow(greatest(least(1 + distance / 150, 3), 1), 2), 4), 1), 9) AS power FROM d",
        best="SELECT *, row_number() OVER (PARTITION BY ts, county, h ORDER BY power DESC, vid) AS rn FROM p",
    )
    + "SELECT ts, county, CAST(h AS BIGINT) AS h, vid, round(distance, 5) AS distance, n_hit, round(power, 6) AS power FROM best WHERE rn = 1",
)
def hit_zone_projection(spark, sf):
    v = spatial.cluster_motion(centroids(spark, sf), "cid", "hour", "lat", "lon", "weight", "size")
    v = v.withColumns(
        {
            "width": F.lit(1.5) + F.col("cid") % 4 / F.lit(4.0), "height": F.lit(1.0) + F.col("cid") % 3 / F.lit(4.0),
            "angle": (F.col("cid") % 90).cast("double"),
        }
    ).withColumnsRenamed({"cid": "vid", "hour": "ts"})
    key = F.col("s_suppkey")
    co = table(spark, sf, "supplier").select(
        key.alias("county"), (28 + ((key * 53) % 141) / 10.0).alias("lat"), (-102 + ((key * 29) % 183) / 10.0).alias("lon")
    )
    near = co.select("county", F.explode(F.array(F.col("county") - 1, F.col("county") + 1)).alias("other"))
    near = near.join(co.select(F.col("county").alias("other")), "other", "left_semi")
    out = spatial.hit_zones(v, co, near)
    return rounded(out.withColumn("distance", r6("distance", 5)).withColumn("h", long("h")), ["county"])


FIELDS = """SELECT s_suppkey AS zone, [{'x': cx - 4.3, 'y': cy - 3.1}, {'x': cx + 5.2, 'y': cy - 2.4}, {'x': cx + 0.7, 'y': cy + 5.6}] AS ring
    FROM (SELECT s_suppkey, ((s_suppkey * 53) % 1009) / 10.0 AS cx, ((s_suppkey * 29) % 997) / 10.0 AS cy FROM supplier)"""


def fields(spark, sf):
    """A triangle around each station."""
    corners = ((-4.3, -3.1), (5.2, -2.4), (0.7, 5.6))
    ring = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in corners])
    return stations(spark, sf).select(F.col("sid").alias("zone"), ring.alias("ring"))


@query(
    "grid_tessellate",
    with_(
        ring=FIELDS, edges=EDGES,
        c="""SELECT zone, col, row FROM (SELECT zone, unnest(generate_series(CAST(floor(x0) AS BIGINT), CAST(floor(x1) AS BIGINT))) AS col, y0, y1 FROM (
             SELECT zone, list_min(list_transform(ring, lambda v: v.x)) AS x0, list_max(list_transform(ring, lambda v: v.x)) AS x1, list_min(list_transform(ring, lambda v: v.y)) AS y0,
             list_max(list_transform(ring, lambda v: v.y)) AS y1 FROM ring)), LATERAL (SELECT unnest(generate_series(CAST(floor(y0) AS BIGINT), CAST(floor(y1) AS BIGINT))) AS row)""",
        k="SELECT zone, col, row, col + unnest([0.0, 0.0, 1.0, 1.0]) AS x, row + unnest([0.0, 1.0, 0.0, 1.0]) AS y FROM c",
        i="""SELECT k.zone, col, row, x, y FROM k JOIN edges e ON e.zone = k.zone AND (e.a.y > y) <> (e.b.y > y) AND x < (e.b.x - e.a.x) * (y - e.a.y) / (e.b.y - e.a.y) + e.a.x
             GROUP BY ALL HAVING count(*) % 2 = 1""",
    )
    + "SELECT zone, col, row FROM i GROUP BY 1, 2, 3 HAVING count(*) = 4",
)
def grid_tessellate(spark, sf):
    return spatial.tessellate(fields(spark, sf), ["zone"], "ring", 1.0)


@query(
    "buffer_label",
    with_("points", "stations", n="SELECT DISTINCT pid FROM points p JOIN stations s ON pow(p.x - s.x, 2) + pow(p.y - s.y, 2) <= 4")
    + "SELECT p.pid, CASE WHEN p.weight > 0 THEN CASE WHEN n.pid IS NULL THEN 0.0 ELSE 1.0 END END::DOUBLE AS label FROM points p LEFT JOIN n ON n.pid = p.pid",
)
def buffer_label(spark, sf):
    p = points(spark, sf).withColumn("data", F.when(F.col("weight") > 0, F.col("weight")))
    out = spatial.buffer_label(p, "pid", stations(spark, sf), "x", "y", 2.0, "data")
    return out.select("pid", F.col("label").cast("double").alias("label"))


@query(
    "zonal_stats",
    with_("points", "stations")
    + """SELECT s.sid, count(p.pid) AS n, round(avg(p.weight), 6) AS mean, min(p.weight) AS low, max(p.weight) AS high FROM stations s
         LEFT JOIN points p ON pow(p.x - s.x, 2) + pow(p.y - s.y, 2) <= 25 GROUP BY 1""",
)
def zonal_stats(spark, sf):
    return rounded(spatial.zonal_stats(points(spark, sf), stations(spark, sf), "sid", "x", "y", 5.0, "weight"), ["sid"])


@query(
    "raster_sample_points",
    with_("points", "cells") + "SELECT pid, c.col, c.row, c.price FROM points p JOIN cells c ON c.col = CAST(floor(p.x / 0.9) AS BIGINT) AND c.row = CAST(floor(p.y / 0.9) AS BIGINT)",
)
def raster_sample_points(spark, sf):
    out = spatial.sample_points(points(spark, sf), "x", "y", cells(spark, sf), 0.9)
    return out.where("price is not null").select("pid", "col", "row", "price")


ALIGN = {
    "a": "SELECT col, row, price AS v FROM cells", "b": "SELECT col // 3 AS col, row // 3 AS row, max(cust) AS v FROM cells GROUP BY 1, 2",
    "x": """SELECT greatest(a.x0, b.x0) AS x0, least(a.x1, b.x1) AS x1, greatest(a.y0, b.y0) AS y0, least(a.y1, b.y1) AS y1 FROM
            (SELECT min(col) * 1.0 AS x0, max(col) + 1.0 AS x1, min(row) * 1.0 AS y0, max(row) + 1.0 AS y1 FROM a) a,
            (SELECT min(col) * 3.0 AS x0, max(col) * 3.0 + 3 AS x1, min(row) * 3.0 AS y0, max(row) * 3.0 + 3 AS y1 FROM b) b""",
    "g": """SELECT col, row FROM (SELECT unnest(generate_series(CAST(ceil(x0 / 2) AS BIGINT), CAST(floor(x1 / 2) AS BIGINT) - 1)) AS col, y0, y1 FROM x),
            LATERAL (SELECT unnest(generate_series(CAST(ceil(y0 / 2) AS BIGINT), CAST(floor(y1 / 2) AS BIGINT) - 1)) AS row)""",
}


def aligned(spark, sf):
    a = cells(spark, sf).select("col", "row", F.col("price").alias("v"))
    b = cells(spark, sf).groupBy(F.floor(F.col("col") / 3).alias("col"), F.floor(F.col("row") / 3).alias("row")).agg(F.max("cust").alias("v"))
    return a, b, spatial.common_grid([(a, 1.0), (b, 3.0)], 2.0)


@query(
    "raster_align",
    with_("cells", **ALIGN)
    + """SELECT g.col, g.row, a.v AS price, b.v AS cust FROM g LEFT JOIN a ON a.col = CAST(floor((g.col + 0.5) * 2) AS BIGINT) AND a.row = CAST(floor((g.row + 0.5) * 2) AS BIGINT)
         LEFT JOIN b ON b.col = CAST(floor((g.col + 0.5) * 2 / 3) AS BIGINT) AND b.row = CAST(floor((g.row + 0.5) * 2 / 3) AS BIGINT)""",
)
def raster_align(spark, sf):
    a, b, target = aligned(spark, sf)
    out = spatial.align_nearest(target, 2.0, a, 1.0, "v", "price")
    return spatial.align_nearest(out, 2.0, b, 3.0, "v", "cust")


@query(
    "raster_align_bilinear",
    with_(
        "cells", **ALIGN, q="SELECT col, row, (col + 0.5) * 2 / 3 - 0.5 AS x, (row + 0.5) * 2 / 3 - 0.5 AS y FROM g",
        k="""SELECT col, row, CAST(floor(x) AS BIGINT) + dx AS c, CAST(floor(y) AS BIGINT) + dy AS r, CASE WHEN dx = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END * CASE WHEN dy = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END AS w
             FROM q, (SELECT unnest([0, 0, 1, 1]) AS dx, unnest([0, 1, 0, 1]) AS dy)""",
        s="SELECT k.col, k.row, sum(w * v) / sum(w) AS v FROM k JOIN b ON b.col = k.c AND b.row = k.r WHERE w > 0 GROUP BY 1, 2",
    )
    + "SELECT g.col, g.row, round(s.v, 6) AS cust FROM g LEFT JOIN s ON s.col = g.col AND s.row = g.row",
)
def raster_align_bilinear(spark, sf):
    _, b, target = aligned(spark, sf)
    return rounded(spatial.align_bilinear(target, 2.0, b, 3.0, "v", "cust"), [])


@query("raster_nodata_mask", with_("cells") + "SELECT col, row, price, cust, dom FROM cells WHERE cust <> 0 AND dom <> 1")
def raster_nodata_mask(spark, sf):
    return spatial.nodata_mask(cells(spark, sf), {"cust": 0.0, "dom": 1.0})


@query(
    "raster_clip",
    with_("cells", points="SELECT row * 128 + col AS pid, (col + 0.5) * 1.0 AS x, (row + 0.5) * 1.0 AS y FROM cells", ring=RING, edges=EDGES, i=INSIDE)
    + "SELECT DISTINCT pid FROM i",
)
def raster_clip(spark, sf):
    rows = cells(spark, sf).select(
        (F.col("row") * 128 + F.col("col")).alias("pid"), (F.col("col") + 0.5).alias("x"), (F.col("row") + 0.5).alias("y")
    )
    return spatial.clip_to_polygons(rows, "x", "y", zones(spark, sf), "ring", 10.0).select("pid")


@query(
    "raster_stack",
    with_("cells") + "SELECT col, row, price, cust, dom FROM cells",
)
def raster_stack(spark, sf):
    long_form = cells(spark, sf).unpivot(["col", "row"], ["price", "cust", "dom"], "band", "value")
    return spatial.stack_bands(long_form, ["price", "cust", "dom"])


@query(
    "deposits_by_province",
    """SELECT n_name, count(c_custkey) AS n, round(avg(c_acctbal) FILTER (c_mktsegment = 'MACHINERY'), 6) AS mean_labelled, round(avg(c_acctbal) FILTER (c_mktsegment <> 'MACHINERY'), 6) AS mean_other
       FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1""",
)
def deposits_by_province(spark, sf):
    labelled = F.col("c_mktsegment") == "MACHINERY"
    stats = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(
        F.count("c_custkey").alias("n"), F.avg(F.when(labelled, F.col("c_acctbal"))).alias("mean_labelled"),
        F.avg(F.when(~labelled, F.col("c_acctbal"))).alias("mean_other"),
    )
    out = table(spark, sf, "nation").join(stats, "n_nationkey", "left").na.fill(0, ["n"])
    return rounded(out.select("n_name", "n", "mean_labelled", "mean_other"), [])


@query(
    "group_dissolve",
    "SELECT p_brand AS name, p_type AS kind, count(*) AS n_parts, CAST(sum(p_size) AS BIGINT) AS length, min(p_retailprice) AS x0, max(p_retailprice) AS x1 FROM part WHERE p_size > 10 GROUP BY 1, 2",
)
def group_dissolve(spark, sf):
    lines = table(spark, sf, "part").where("p_size > 10")
    return lines.groupBy(F.col("p_brand").alias("name"), F.col("p_type").alias("kind")).agg(
        F.count(F.lit(1)).alias("n_parts"), F.sum("p_size").alias("length"), F.min("p_retailprice").alias("x0"), F.max("p_retailprice").alias("x1")
    )


def voxel_rows(spark, sf):
    label = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 0)
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("sample"), (F.col("l_partkey") % 20).alias("i"), F.col("l_linenumber").cast("bigint").alias("x"),
        F.col("l_quantity").cast("bigint").alias("t"), label.alias("label"),
    )


VOXELS = "SELECT l_suppkey AS sample, l_partkey % 20 AS i, CAST(l_linenumber AS BIGINT) AS x, CAST(l_quantity AS BIGINT) AS t, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 0 END AS label FROM lineitem"


@query(
    "volume_to_slices",
    with_(v=VOXELS) + " UNION ALL ".join(
        f"SELECT sample, '{a}' AS axis, {a} AS idx, max({b}) + 1 AS height, max({c}) + 1 AS width, count(*) FILTER (label > 0) AS n_positive FROM v GROUP BY ALL"
        for a, b, c in (("i", "x", "t"), ("x", "i", "t"), ("t", "i", "x"))),
)
def volume_to_slices(spark, sf):
    return volume.slices(voxel_rows(spark, sf), "sample", ["i", "x", "t"], "label")


@query(
    "volume_empty_report",
    """WITH v AS (SELECT o_custkey AS s, CASE WHEN o_orderstatus = 'P' THEN 1 WHEN o_orderstatus = 'F' THEN 0 END AS l FROM orders WHERE o_orderkey % 3 = 0), f AS (SELECT s, count(l) AS a, count(*) FILTER (l > 0) AS b FROM v GROUP BY 1)
       SELECT c_custkey AS sample, coalesce(a, 0) AS n_labelled, coalesce(b, 0) AS n_positive, CASE WHEN coalesce(a, 0) = 0 THEN 'no label' WHEN b = 0 THEN 'empty' ELSE 'filled' END AS state FROM customer LEFT JOIN f ON s = c_custkey""",
)
def volume_empty_report(spark, sf):
    label = F.when(F.col("o_orderstatus") == "P", 1).when(F.col("o_orderstatus") == "F", 0)
    rows = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("sample"), label.alias("label"))
    return volume.empty_report(table(spark, sf, "customer").select(F.col("c_custkey").alias("sample")), "sample", rows, "label")


@query(
    "volume_sparse_coords",
    "SELECT vec_id, CAST(t AS BIGINT) AS t FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(len(embedding))) AS t FROM embeddings) WHERE v > 0.2",
)
def volume_sparse_coords(spark, sf):
    mask = F.transform("embedding", lambda v: (v > F.lit(0.2).cast("float")).cast("int"))
    out = volume.sparse_coords(table(spark, sf, "embeddings").select("vec_id", mask.alias("mask")), ["vec_id"], "mask")
    return out.withColumn("t", long("t"))


@query(
    "mask_from_rgb",
    """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_linenumber % 3 AS r, l_partkey % 2 AS g, l_suppkey % 2 AS b FROM lineitem), d AS (SELECT DISTINCT r, g, b FROM p),
       c AS (SELECT r, g, b, row_number() OVER (ORDER BY r, g, b) - 1 AS label FROM d WHERE r + g > 0) SELECT l_orderkey, l_linenumber, l_partkey, coalesce(label, -1) AS label FROM p LEFT JOIN c USING (r, g, b)""",
)
def mask_from_rgb(spark, sf):
    pixels = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (F.col("l_linenumber") % 3).alias("r"), (F.col("l_partkey") % 2).alias("g"), (F.col("l_suppkey") % 2).alias("b")
    )
    found = pixels.select("r", "g", "b").distinct().where("r + g > 0")
    # Position of the colour among those found; the colours of a label map are few.
    all_found = found.agg(F.array_sort(F.collect_list(F.struct("r", "g", "b"))).alias("a"))
    colours = found.select("r", "g", "b", (F.array_position(all_found.scalar(), F.struct("r", "g", "b")) - 1).alias("label"))
    out = volume.class_of_colour(pixels, colours)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "label")


@query(
    "model_profile_features",
    with_("cells", v="SELECT row // 100 AS sample, col, row % 100 AS depth, price / 997 AS price FROM cells")
    + " UNION ALL ".join(
        f"SELECT sample, '{a}' AS axis, {a} AS pos, round(min(price), 6) AS low, round(max(price), 6) AS high, round(avg(price), 6) AS mean, round(stddev_pop(price), 6) AS std FROM v GROUP BY ALL" for a in ("depth", "col")),
)
def model_profile_features(spark, sf):
    rows = cells(spark, sf).select(F.floor(F.col("row") / 100).alias("sample"), "col", (F.col("row") % 100).alias("depth"), (F.col("price") / 997).alias("price"))
    return rounded(volume.profile_features(rows, "sample", ["depth", "col"], "price"), ["sample"])
