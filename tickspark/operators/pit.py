"""Point-in-time feature joins, training sets, feature vectors and the feature registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.blocks import join_keys, largest_key, time_cuts, with_bucket
from ..functions.windows import micros


def point_in_time_join(
    entities: DataFrame,
    features: DataFrame,
    names: list[str],
    max_age_s: float | None = None,
    entity: str = "entity_id",
    ts: str = "ts",
    entity_rows: int = 1_000_000,
) -> DataFrame:
    """Each entity row with the latest value of each feature at or before its time (null if none, or older than max_age_s).

    features: (entity_id, feature_name, ts, value, created_at).  Both sides are put together and one window
    carries the last value of every feature forward: one shuffle whatever the number of features.  A
    stored null is a value.  Ties on time go to the latest created_at.

    If an entity has more than `entity_rows` rows, rows are dealt by (entity, time bucket): the last value of each
    feature in each bucket is a small table, whose exclusive scan is carried back into the buckets, so that no task holds
    more than one bucket of an entity.
    """
    own = [F.col(f"`{c}`").alias(f"_e_{i}") for i, c in enumerate(entities.columns)]
    left = entities.select(F.col(entity).alias("_k"), F.col(ts).alias("_t"), *own, F.lit(1).alias("_side"))
    wanted = features.filter(F.col("feature_name").isin(*names))
    found = F.col("feature_name").alias("_n"), F.col("value").alias("_value"), "created_at"
    right = wanted.select(F.col(entity).alias("_k"), F.col(ts).alias("_t"), *found, F.lit(0).alias("_side"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_v", F.struct(F.col("_t").alias("t"), F.col("_value").alias("value")))
    slim = both.select("_k", "_t")
    most = largest_key(slim, ["_k"])
    cuts = time_cuts(slim, "_t", min(2 + 2 * most // entity_rows, 1000)) if most > entity_rows else []
    keys = ["_k"]
    if cuts:
        keys, both = ["_k", "_bucket"], with_bucket(both, micros("_t"), cuts)
    w = Window.partitionBy(*keys).orderBy("_t", "_side", "created_at").rowsBetween(Window.unboundedPreceding, 0)
    last = {f"_f_{i}": F.last(F.when(F.col("_n") == n, F.col("_v")), ignorenulls=True).over(w) for i, n in enumerate(names)}
    out = both.withColumns(last).filter("_side = 1")
    if cuts:
        out = join_keys(out, _values_before(both, names), keys).withColumns({c: F.coalesce(c, f"_b{c}") for c in last})

    def at(i: int) -> Column:
        v = F.col(f"_f_{i}.value")
        return v if max_age_s is None else F.when((micros("_t") - micros(F.col(f"_f_{i}.t"))) <= max_age_s * 1e6, v)

    return out.select(*(F.col(f"_e_{i}").alias(c) for i, c in enumerate(entities.columns)), *(at(i).alias(n) for i, n in enumerate(names)))


def _values_before(both: DataFrame, names: list[str]) -> DataFrame:
    """(_k, _bucket, _b_f_0, ...): the last value of each feature before each bucket that has rows."""
    when = F.struct("_t", "created_at")
    ends = {f"_f_{i}": F.max_by("_v", F.when(F.col("_n") == n, when)) for i, n in enumerate(names)}
    buckets = both.groupBy("_k", "_bucket").agg(*(c.alias(n) for n, c in ends.items()))
    before = Window.partitionBy("_k").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return buckets.select("_k", "_bucket", *(F.last(c, ignorenulls=True).over(before).alias(f"_b{c}") for c in ends))


def training_dataset(entities: DataFrame, features: DataFrame, names: list[str], label: str, start: str, end: str, step: str, entity: str = "entity_id", entity_rows: int = 1_000_000) -> DataFrame:
    """Entity x time grid (end exclusive) with point-in-time features and label; incomplete rows go."""
    at = F.explode(F.expr(f"sequence(timestamp_ntz '{start}', timestamp_ntz '{end}', interval {step})")).alias("ts")
    grid = entities.select(entity).distinct().select(entity, at).filter(F.col("ts") < F.expr(f"timestamp_ntz '{end}'"))
    return point_in_time_join(grid, features, [*names, label], entity=entity, entity_rows=entity_rows).dropna(subset=[*names, label])


def to_map(df: DataFrame, cols: list[str], out: str = "features") -> DataFrame:
    """Feature columns as one map; nulls are absent."""
    pairs = F.filter(F.array(*(F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value")) for c in cols)), lambda x: x["value"].isNotNull())
    return df.withColumn(out, F.map_from_entries(pairs))


def to_vector(df: DataFrame, names: list[str], col: str = "features", fill: float | None = None, out: str = "vector") -> DataFrame:
    """A feature map as an array in the order of names; absent ones are null or `fill`."""
    cells = F.transform(F.array(*map(F.lit, names)), lambda n: F.try_element_at(F.col(col), n))
    return df.withColumn(out, cells if fill is None else F.transform(cells, lambda x: F.coalesce(x, F.lit(fill))))


@dataclass
class Feature:
    name: str
    build: Callable[[DataFrame], DataFrame]
    needs: tuple[str, ...] = ()
    group: str = "default"


@dataclass
class FeatureRegistry:
    """User-defined feature builders (DataFrame -> DataFrame) composed into one plan in order of dependence."""

    features: dict[str, Feature] = field(default_factory=dict)

    def register(self, name: str, build: Callable[[DataFrame], DataFrame], needs: tuple[str, ...] = (), group: str = "default") -> None:
        self.features[name] = Feature(name, build, tuple(needs), group)

    def order(self, names: list[str]) -> list[str]:
        """Names and what they need, each after its needs; a cycle or an unknown name raises."""
        done: list[str] = []
        open_: set[str] = set()

        def visit(n: str) -> None:
            if n in done:
                return
            if n in open_:
                raise ValueError(f"features depend on each other in a circle at {n}")
            if n not in self.features:
                raise KeyError(n)
            open_.add(n)
            for k in self.features[n].needs:
                visit(k)
            open_.discard(n)
            done.append(n)

        for n in names:
            visit(n)
        return done

    def build(self, df: DataFrame, names: list[str]) -> DataFrame:
        for n in self.order(names):
            df = self.features[n].build(df)
        return df

    def search(self, text: str) -> list[str]:
        return sorted(n for n in self.features if text.lower() in n.lower())

    def in_group(self, group: str) -> list[str]:
        return sorted(n for n, f in self.features.items() if f.group == group)


def run_checks(df: DataFrame, checks: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """User-defined data checks, each giving (issue, entity, status) rows, put together."""
    out = checks[0](df).select("issue", "entity", "status")
    for c in checks[1:]:
        out = out.unionByName(c(df).select("issue", "entity", "status"))
    return out
