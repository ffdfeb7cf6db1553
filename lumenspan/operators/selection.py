"""Exact quantiles by selection: passes that narrow an interval of values, with no group sorted and no list of values kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .settle import settled

#: Parts that a pass cuts an interval into, so rows that one key has in the pass's only window.
PARTS = 1 << 16


def exact_quantile(rows: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """(keys, n, quantile): the element at ceil(q n) of each key's ordered whole numbers; nulls count for none.

    A first pass finds each key's least and largest value and count. Each further pass counts the rows of ``PARTS`` equal
    parts of what is left of a key's interval and keeps the part that the rank falls into, until parts are single
    values: two passes for intervals below 2**32, four for any. Counts combine before they are
    shuffled; a key of any size sends ``PARTS`` rows a task at most. A key without a value has a null quantile; no rows
    and no keys give one row, as an aggregate without groups does.
    """
    x = F.col(value).cast("long")
    data = rows.select(*keys, x.alias("x"))
    spread = data.groupBy(*keys).agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    # the width as an exact decimal, as it may be beyond a long
    width = F.col("hi").cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)") + 1
    state = settled(spread.select(*keys, "n", "lo", F.greatest(F.lit(1).cast("long"), F.ceil(F.lit(q) * F.col("n")).cast("long")).alias("rank"), width.cast("decimal(20,0)").alias("width")))
    while (state.agg(F.max("width")).first()[0] or 1) > 1:
        step = F.ceil(F.col("width") / F.lit(PARTS)).cast("decimal(20,0)")
        asked = state.select(*keys, "lo", "width", "rank", step.alias("step"))
        near = data.join(asked, keys) if keys else data.crossJoin(F.broadcast(asked))  # a single row
        apart = F.col("x").cast("decimal(20,0)") - F.col("lo").cast("decimal(20,0)")
        inside = near.where((apart >= 0) & (apart < F.col("width"))).withColumn("part", F.floor(apart / F.col("step")).cast("int"))
        counts = inside.groupBy(*keys, "part").agg(F.count(F.lit(1)).alias("c"), F.min("lo").alias("lo"), F.min("rank").alias("rank"), F.min("step").alias("step"))
        upto = F.sum("c").over(Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
        hit = counts.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("c") < F.col("rank")))
        lo = (F.col("lo").cast("decimal(20,0)") + F.col("part") * F.col("step")).cast("long")
        kept = state.select(*keys, "n")
        found = hit.select(*keys, lo.alias("lo"), (F.col("rank") - (F.col("upto") - F.col("c"))).alias("rank"), F.col("step").alias("width"))
        joined = kept.join(found, keys, "left") if keys else kept.crossJoin(F.broadcast(found))  # single rows
        state = settled(joined.select(*keys, "n", "lo", "rank", F.coalesce("width", F.lit(1)).cast("decimal(20,0)").alias("width")))
    return state.select(*keys, "n", F.col("lo").alias("quantile"))
