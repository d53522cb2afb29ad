"""Set operations and reshape."""

from pyspark.sql import functions as F

from gridstrata.operators import reshape
from gridstrata.plans.base import long, r6, with_
from gridstrata.plans.registry import query
from gridstrata.sources import table

FLAGS = ["A", "N", "R"]


def _customers(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )


def _suppliers(spark, sf):
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"),
        F.col("s_name").alias("name"),
    )


@query(
    "union_common_columns",
    """SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal AS balance FROM customer
       UNION ALL SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier""",
)
def union_common_columns(spark, sf):
    return reshape.union_common(_customers(spark, sf), _suppliers(spark, sf))


@query(
    "union_fill_missing",
    """SELECT c_custkey AS id, CAST(c_nationkey AS VARCHAR) AS nation, c_acctbal AS balance, c_mktsegment AS segment,
         NULL AS name FROM customer
       UNION ALL SELECT s_suppkey, CAST(s_nationkey AS VARCHAR), s_acctbal, NULL, s_name FROM supplier""",
)
def union_fill_missing(spark, sf):
    return reshape.union_fill(_customers(spark, sf), _suppliers(spark, sf), as_text=["nation"])


@query(
    "set_difference_keys",
    "SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def set_difference_keys(spark, sf):
    return reshape.keys_missing(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("set_intersect_keys", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def set_intersect_keys(spark, sf):
    return reshape.keys_shared(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("distinct_pairs", "SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem")
def distinct_pairs(spark, sf):
    return table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag").distinct()


@query(
    "unpivot_facts",
    """SELECT l_orderkey, l_linenumber, l_partkey, 'l_discount' AS name, l_discount AS value FROM lineitem
       UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, 'l_tax', l_tax FROM lineitem""",
)
def unpivot_facts(spark, sf):
    ids, values = ["l_orderkey", "l_linenumber", "l_partkey"], ["l_discount", "l_tax"]
    return reshape.unpivot(table(spark, sf, "lineitem").select(*ids, *values), ids, values)


@query(
    "pivot_facts",
    """SELECT l_suppkey, round(sum(l_quantity) FILTER (l_returnflag = 'A'), 2) AS "A",
         round(sum(l_quantity) FILTER (l_returnflag = 'N'), 2) AS "N",
         round(sum(l_quantity) FILTER (l_returnflag = 'R'), 2) AS "R" FROM lineitem GROUP BY 1""",
)
def pivot_facts(spark, sf):
    return reshape.pivot(
        table(spark, sf, "lineitem"), ["l_suppkey"], "l_returnflag", r6(F.sum("l_quantity"), 2), FLAGS
    )


@query(
    "flatten_groups",
    "SELECT l_suppkey, "
    + ", ".join(
        f"""round(avg(l_quantity) FILTER (l_returnflag = '{f}' AND l_linestatus = '{s}'), 6) AS "{f}_{s}_mean",
            max(l_quantity) FILTER (l_returnflag = '{f}' AND l_linestatus = '{s}') AS "{f}_{s}_max" """
        for f in FLAGS for s in ("F", "O")
    )
    + " FROM lineitem GROUP BY 1",
)
def flatten_groups(spark, sf):
    values = [f"{f}_{s}" for f in FLAGS for s in ("F", "O")]
    stats = {"mean": r6(F.avg("l_quantity")), "max": F.max("l_quantity")}
    return reshape.flatten_groups(
        table(spark, sf, "lineitem"), ["l_suppkey"], ["l_returnflag", "l_linestatus"], stats, values
    )


@query(
    "explode_lists",
    """SELECT vec_id, CAST(unnest(range(len(embedding))) AS BIGINT) AS pos, round(CAST(unnest(embedding) AS DOUBLE), 6) AS v
       FROM embeddings""",
)
def explode_lists(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return rows.select("vec_id", long("pos").alias("pos"), r6(F.col("v").cast("double")).alias("v"))


@query(
    "explode_slice_menu",
    """SELECT vec_id, axis, CAST(idx AS BIGINT) AS idx FROM (
         SELECT vec_id, 'i' AS axis, unnest(range(12)) AS idx FROM embeddings UNION ALL
         SELECT vec_id, 'x', unnest(range(8)) FROM embeddings)""",
)
def explode_slice_menu(spark, sf):
    menu = reshape.slice_menu(table(spark, sf, "embeddings").select("vec_id"), {"i": 12, "x": 8})
    return menu.withColumn("idx", long("idx"))
