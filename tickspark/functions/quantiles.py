"""Exact quantiles of few, very large groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import stored


def exact_quantiles(df: DataFrame, col: str, probs: dict[str, float], by: list[str], slots: int = 64, keep: bool = True) -> DataFrame:
    """(by..., one column for each name in probs): quantiles with linear interpolation over the values that are not null.

    A mergeable sketch cuts each group into slots of about equal size; slots are counted, and only the values of the few
    slots that hold an order statistic asked for are ranked.  No task keeps the distinct values of a whole group.
    The values are read three times, so they are stored first; keep=False is for an input that is stored already.
    """
    keys = by or ["_all"]
    base = df if by else df.withColumn("_all", F.lit(0))
    base = base.filter(F.col(col).isNotNull()).select(*keys, F.col(col).cast("double").alias("_v"))
    base = stored(base, "quantiles") if keep else base
    cuts = F.percentile_approx("_v", [k / slots for k in range(1, slots)], 20 * slots)
    sketch = base.groupBy(*keys).agg(cuts.alias("_cuts"), F.count("*").alias("_n"))
    placed = base.join(sketch, keys).withColumn("_slot", F.size(F.filter("_cuts", lambda c: c < F.col("_v")))).drop("_cuts")
    before = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(*keys, "_n", "_slot").agg(F.count("*").alias("_c")).withColumn("_before", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    at = {name: F.lit(p) * (F.col("_n") - 1) for name, p in probs.items()}
    ranks = {(name, end): f(x).cast("long") for name, x in at.items() for end, f in (("a", F.floor), ("b", F.ceil))}

    def inside(begin: str, n: str):
        return {k: (r >= F.col(begin)) & (r < F.col(begin) + F.col(n)) for k, r in ranks.items()}

    hit = None
    for x in inside("_before", "_c").values():
        hit = x if hit is None else hit | x
    asked = placed.join(sizes.filter(hit).select(*keys, "_slot", "_before"), [*keys, "_slot"])
    counted = asked.groupBy(*keys, "_n", "_slot", "_before", "_v").agg(F.count("*").alias("_m"))
    earlier = Window.partitionBy(*keys, "_slot").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("_first", F.col("_before") + F.coalesce(F.sum("_m").over(earlier), F.lit(0)))
    found = counted.groupBy(*keys, "_n").agg(*(F.max(F.when(x, F.col("_v"))).alias(f"_{name}_{end}") for (name, end), x in inside("_first", "_m").items()))
    share = {name: x - F.floor(x) for name, x in at.items()}
    out = {name: F.col(f"_{name}_a") * (1 - share[name]) + F.col(f"_{name}_b") * share[name] for name in probs}
    return found.select(*by, *(v.alias(name) for name, v in out.items()))
