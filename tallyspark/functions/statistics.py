"""Robust statistics of arrays, and of groups, with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Scale of the median absolute deviation, of the mean absolute deviation, and the bounds.
MAD_SCALE, MEAN_SCALE = 0.6745, 1.253314
OUTLYING = 3.5
TRUSTED_COHORT = 8
LEAST_HISTORY = 3
TAIL = 0.05


def _double(values: Column) -> Column:
    return values.cast("array<double>")


def _let(value: Column, then) -> Column:
    """`then` of a value that is computed once, however often `then` reads it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _at(ordered: Column, p: float) -> Column:
    """Percentile p of an array in order."""
    at = (F.size(ordered) - 1) * F.lit(p / 100.0)
    low = F.get(ordered, F.floor(at).cast("int"))
    return F.when(F.size(ordered) > 0, low + (F.get(ordered, F.ceil(at).cast("int")) - low) * (at - F.floor(at)))


def median(values: Column) -> Column:
    """Median of an array without nulls; null if it is empty."""
    return percentile(values, 50)


def percentile(values: Column, p: float) -> Column:
    """Percentile p (0 to 100) by linear interpolation at (n - 1) * p / 100."""
    return _let(F.array_sort(_double(values)), lambda ordered: _at(ordered, p))


def _off(values: Column, middle: Column) -> Column:
    return F.transform(_double(values), lambda v: F.abs(v - middle))


def mad(values: Column) -> Column:
    """Median absolute deviation from the median."""
    return _let(median(values), lambda middle: median(_off(values, middle)))


def mean(values: Column) -> Column:
    total = F.aggregate(_double(values), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(total, F.size(values))


def modified_z(x: Column, values: Column) -> Column:
    """Robust z-score of x against a sample; by the mean deviation where the median deviation is 0; null under two values or without spread."""

    def score(middle: Column) -> Column:
        gap = x.cast("double") - middle
        spreads = _let(_off(values, middle), lambda off: F.struct(median(off).alias("median"), mean(off).alias("mean")))
        return _let(spreads, lambda s: F.when(s["median"] != 0, F.lit(MAD_SCALE) * gap / s["median"]).when(s["mean"] != 0, gap / (F.lit(MEAN_SCALE) * s["mean"])))

    return F.when(F.size(values) >= 2, _let(median(values), score))


def mid_rank(values: Column, x: Column) -> Column:
    """(number below + half the number equal) / n."""
    x = x.cast("double")
    below = F.size(F.filter(_double(values), lambda v: v < x))
    equal = F.size(F.filter(_double(values), lambda v: v == x))
    return F.when(x.isNotNull(), F.try_divide(below + equal / F.lit(2.0), F.size(values)))


def group_mad(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, median, mad) by two grouped aggregations, so no group is collected."""
    middle = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(value).alias("n"), F.percentile(F.col(value).cast("double"), F.lit(0.5)).alias("median"))
    off = df.where(F.col(value).isNotNull()).join(middle, keys).withColumn("_off", F.abs(F.col(value).cast("double") - F.col("median")))
    return off.groupBy(*keys, "n", "median").agg(F.percentile("_off", F.lit(0.5)).alias("mad"))


def group_mid_rank(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """`df` with `mid_rank` of each non-null value in its group, from counts per distinct value.

    Counts of equal values are taken first, so the running sum has a row per distinct value.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_equal"))
    below = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_below", F.coalesce(F.sum("_equal").over(below), F.lit(0))).withColumn("_n", F.sum("_equal").over(Window.partitionBy(*keys)))
    ranks = counts.select(*keys, value, ((F.col("_below") + F.col("_equal") / 2) / F.col("_n")).alias("mid_rank"))
    return df.join(ranks, [*keys, value], "left")


def _ranked(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds `_rank`, from 0, of each sample's value in its group."""
    return samples.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(value)) - 1)


def peer_percentile(units: DataFrame, samples: DataFrame, keys: list[str], who: str, value: str, p: float) -> DataFrame:
    """(who, keys, n, percentile) of each of `units` (who, keys): of the samples of its group that are not its own.

    The samples of a group are ranked once; the few of its own that lie below a rank move it up by one each, so a unit
    meets two samples and never all of its peers.
    """
    ranked = _ranked(samples.where(F.col(value).isNotNull()).select(*keys, who, F.col(value).cast("double").alias("_value")), keys, "_value")
    sizes = ranked.groupBy(*keys).agg(F.count("*").alias("_all"))
    own = ranked.groupBy(who, *keys).agg(F.array_sort(F.collect_list("_rank")).alias("_own"))
    found = units.select(who, *keys).distinct().join(sizes, keys).join(own, [who, *keys], "left").withColumn("_own", F.coalesce("_own", F.array().cast("array<int>")))
    found = found.withColumn("n", F.col("_all") - F.size("_own")).where("n > 0").withColumn("_at", (F.col("n") - 1) * F.lit(p / 100))

    def full(rank: Column) -> Column:
        """The rank among all of a rank among the peers."""
        return F.aggregate("_own", rank.cast("int"), lambda at, o: F.when(o <= at, at + 1).otherwise(at))

    found = found.withColumn("_part", F.col("_at") - F.floor("_at"))
    ends = found.select(who, *keys, "n", "_part", F.explode(F.array(F.struct(full(F.floor("_at")).alias("_rank"), (1 - F.col("_part")).alias("_share")), F.struct(full(F.ceil("_at")).alias("_rank"), F.col("_part").alias("_share")))).alias("_end"))
    met = ends.select(who, *keys, "n", "_end.*").join(ranked.select(*keys, "_rank", "_value"), [*keys, "_rank"])
    return met.groupBy(who, *keys, "n").agg(F.sum(F.col("_value") * F.col("_share")).alias("percentile"))


def peer_mid_rank(at: DataFrame, samples: DataFrame, keys: list[str], who: str, value: str) -> DataFrame:
    """`at` (who, keys, value, ...) with `n` and `mid_rank` of its value among the samples of its group that are not its own.

    Counts of equal values are taken once for a group and summed up along its values; a unit's own few are taken off. No unit meets its peers.
    """
    known = samples.where(F.col(value).isNotNull()).select(*keys, who, F.col(value).cast("double").alias("_value"))
    asked = at.withColumn("_value", F.col(value).cast("double"))
    counts = known.select(*keys, "_value", F.lit(1).alias("_one")).unionByName(asked.select(*keys, "_value", F.lit(0).alias("_one"))).groupBy(*keys, "_value").agg(F.sum("_one").alias("_equal"))
    so_far = Window.partitionBy(*keys).orderBy("_value").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_below", F.coalesce(F.sum("_equal").over(so_far), F.lit(0))).withColumn("_all", F.sum("_equal").over(Window.partitionBy(*keys)))
    mine = asked.select(who, *keys, "_value").distinct().join(known.withColumnRenamed("_value", "_own"), [who, *keys])
    mine = mine.groupBy(who, *keys, "_value").agg(F.count("*").alias("_mine"), F.count_if(F.col("_own") < F.col("_value")).alias("_mine_below"), F.count_if(F.col("_own") == F.col("_value")).alias("_mine_equal"))
    found = asked.join(counts, [*keys, "_value"]).join(mine, [who, *keys, "_value"], "left").fillna(0, ["_mine", "_mine_below", "_mine_equal"])
    below, equal = F.col("_below") - F.col("_mine_below"), F.col("_equal") - F.col("_mine_equal")
    found = found.withColumn("n", F.col("_all") - F.col("_mine")).withColumn("mid_rank", F.try_divide(below + equal / F.lit(2.0), F.col("n")))
    return found.select(*at.columns, "n", "mid_rank")
