"""Exact linear-interpolated percentile per group that stays bounded under skew.

``percentile(v, p)`` keeps every distinct value of a group in one buffer, so a group holding a third of a 100 TB
table would land in one task. Here, in two scans:

1. one aggregate per group: the count n and ``percentile_approx`` at p and at steps on either side of it. The
   narrowest pair of steps that is wider than 2/n plus the sketch's error brackets the two ranks which the
   interpolation needs, at every group size alike;
2. the rows meet their group's bracket (one row per group; broadcast when there are at most ``MAX_BROADCAST_GROUPS``,
   else joined by shuffle) and are counted below it and per distinct value inside, combining map-side. So raw rows are
   not dealt out by group;
3. a running count over the few values inside finds the ranks floor(k) and ceil(k), k = (n-1)p. A bracket that
   misses one of them raises an error.

Result equals ``sorted(v)[f]*(c-k) + sorted(v)[c]*(k-f)`` (f == c: the value). NULL and NaN values do not count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_BROADCAST_GROUPS = 100_000
_STEPS = (1.0, 0.3, 0.1, 0.03, 0.01, 1e-3, 1e-4, 1e-5)


def _brackets(base: DataFrame, keys: list[str], p: float, accuracy: int) -> DataFrame:
    """(keys, _a, _b, _k): the bracket of every group."""
    steps = [s for s in _STEPS if s > 6.0 / accuracy] + [6.0 / accuracy]
    at = [max(0.0, p - s) for s in steps] + [min(1.0, p + s) for s in steps]
    need = 2.0 / F.col("_n") + 3.0 / accuracy
    index = F.lit(0)
    for i, s in enumerate(steps):  # from wide to narrow: the last that is wide enough
        index = F.when(F.lit(s) >= need, i).otherwise(index)
    return (base.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", at, accuracy).alias("_q"))
            .withColumn("_i", index)
            .select(*keys, F.get("_q", F.col("_i")).alias("_a"), F.get("_q", F.col("_i") + len(steps)).alias("_b"),
                    ((F.col("_n") - 1) * F.lit(p)).alias("_k")))


def exact_percentile(df: DataFrame, keys: Sequence[str], value: str, p: float,
                     out: str = "percentile", accuracy: int = 1_000_000) -> DataFrame:
    keys = list(keys)
    v = F.col(value).cast("double")
    base = df.select(*keys, v.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    stats = _brackets(base, keys, p, accuracy)
    few = stats.limit(MAX_BROADCAST_GROUPS + 1).collect()
    if len(few) <= MAX_BROADCAST_GROUPS:
        stats = F.broadcast(df.sparkSession.createDataFrame(few, stats.schema))
    inside = F.when(F.col("_v") >= F.col("_a"), F.col("_v"))
    counted = (base.join(stats, keys).filter(F.col("_v") <= F.col("_b"))
               .groupBy(*keys, inside.alias("_x")).agg(F.count(F.lit(1)).alias("_cnt"), F.max("_k").alias("_k")))
    w = Window.partitionBy(*keys).orderBy(F.col("_x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn("_lo", F.coalesce(F.sum("_cnt").over(w), F.lit(0))).withColumn("_hi", F.col("_lo") + F.col("_cnt") - 1)

    def at(rank):
        return F.max(F.when((rank >= F.col("_lo")) & (rank <= F.col("_hi")), F.col("_x")))

    picked = ranked.groupBy(*keys).agg(at(F.floor("_k")).alias("_vf"), at(F.ceil("_k")).alias("_vc"), F.max("_k").alias("_k"))
    f, c, k = F.floor("_k"), F.ceil("_k"), F.col("_k")
    res = F.when(F.col("_vf").isNull() | F.col("_vc").isNull(), F.raise_error(F.lit("the bracket misses a rank")).cast("double")) \
        .when(f == c, F.col("_vf")).otherwise(F.col("_vf") * (c - k) + F.col("_vc") * (k - f))
    return picked.select(*keys, res.alias(out))
