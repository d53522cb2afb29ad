"""Greedy matches as the fixed point of bounded steps.

The greedy rule (truths in their order, each takes the best free partner) is settled without going through all truths
one after another. Truths are cut into blocks of some hundred in their order. A block is folded in one expression, given
the partners that earlier blocks took; then blocks whose earlier blocks changed their mind about a shared partner
are folded again, until nothing changes. The first block is right after the first round, the second at the latest after
the second, so the end is the greedy match; most blocks share few partners and rounds are few.

Lists of partners end at the first one no earlier truth wants: it is free whatever the others do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridstrata.operators.ranks import value_ranks
from gridstrata.session import checkpoint

BLOCK = 256


def _wish_lists(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pairs in the order of each truth's preference, cut behind the first partner that no earlier truth wants."""
    first = Window.partitionBy(*keys, "p_id").orderBy("t_order")
    free = pairs.withColumn("_free", (F.row_number().over(first) == 1).cast("int"))
    before = Window.partitionBy(*keys, "t_order").orderBy(F.col("gain").desc(), "p_order").rowsBetween(Window.unboundedPreceding, -1)
    return free.where(F.col("gain") > 0).withColumn("_seen", F.coalesce(F.sum("_free").over(before), F.lit(0))).where("_seen = 0").drop("_seen", "_free")


def greedy(pairs: DataFrame, keys: Sequence[str], place: str, block: int = BLOCK) -> DataFrame:
    """Rows (keys, t_id, p_id) of the greedy match, truths in the order of ``t_order``.

    ``pairs`` has the keys, t_id, t_order (comparable; its order is that of the number ``place``, ties aside), p_id,
    p_order and gain; the best partner has the largest gain, of several the smallest p_order. Pairs without gain are out.
    """
    keys = list(keys)
    wishes = checkpoint(_wish_lists(pairs, keys))
    truths = wishes.groupBy(*keys, "t_id", "t_order", place).agg(F.sort_array(F.collect_list(F.struct((-F.col("gain")).alias("g"), "p_order", "p_id"))).alias("wishes"))
    ranks = value_ranks(truths.select(*keys, place), keys, place).select(*keys, place, F.floor(F.col("below") / block).alias("block"))
    truths = checkpoint(truths.join(ranks, [*keys, place]))
    listed = F.sort_array(F.collect_list(F.struct("t_order", "t_id", F.transform("wishes", lambda w: w["p_id"]).alias("ids"))))
    blocks = checkpoint(truths.groupBy(*keys, "block").agg(listed.alias("truths")))
    wanted = wishes.select(*keys, "t_id", "t_order", "p_id").join(truths.select(*keys, "t_id", "t_order", "block"), [*keys, "t_id", "t_order"])
    wanted = wanted.select(*keys, "p_id", "block").distinct()
    both = wanted.groupBy(*keys, "p_id").agg(F.min("block").alias("_a"), F.max("block").alias("_z")).where("_a < _z").drop("_a", "_z")
    shared = checkpoint(wanted.join(both, [*keys, "p_id"]))  # partners that more than one block wants

    def fold(rows: DataFrame) -> DataFrame:
        """Each block's choices (t_id, p_id) in order, given the partners ``taken`` before."""
        def step(state, truth):
            choice = F.get(F.filter(truth["ids"], lambda p: ~F.array_contains(state["taken"], p)), F.lit(0))
            chosen = F.struct(truth["t_id"].alias("t_id"), choice.alias("p_id"))
            return F.struct(
                F.when(choice.isNull(), state["taken"]).otherwise(F.concat(state["taken"], F.array(choice))).alias("taken"),
                F.when(choice.isNull(), state["made"]).otherwise(F.concat(state["made"], F.array(chosen))).alias("made"))

        ids = dict(wishes.dtypes)
        empty = F.array().cast(f"array<struct<t_id:{ids['t_id']},p_id:{ids['p_id']}>>")
        start = F.struct(F.col("taken"), empty.alias("made"))
        return rows.withColumn("made", F.aggregate("truths", start, step, lambda s: s["made"]))

    none = F.array().cast(f"array<{dict(wishes.dtypes)['p_id']}>")
    state = checkpoint(fold(blocks.withColumn("taken", none)).select(*keys, "block", "taken", "made"))
    while True:
        made = state.select(*keys, "block", F.explode(F.transform("made", lambda m: m["p_id"])).alias("p_id"))
        first = made.join(both, [*keys, "p_id"]).groupBy(*keys, "p_id").agg(F.min("block").alias("_by"))
        before = shared.join(first, [*keys, "p_id"]).where(F.col("_by") < F.col("block"))
        now = before.groupBy(*keys, "block").agg(F.sort_array(F.collect_set("p_id")).alias("_now"))
        open_ = state.join(now, [*keys, "block"], "left").withColumn("_now", F.coalesce("_now", none))
        open_ = checkpoint(open_.where(F.col("_now") != F.sort_array("taken")).select(*keys, "block", F.col("_now").alias("taken")))
        if open_.isEmpty():
            break
        again = fold(blocks.join(open_, [*keys, "block"])).select(*keys, "block", "taken", "made")
        state = checkpoint(state.join(open_.select(*keys, "block"), [*keys, "block"], "left_anti").unionByName(again))
    return state.select(*keys, F.inline("made"))
