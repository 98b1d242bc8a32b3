"""Targets and seats of any number of sources, as aggregates over a written table of them.

Nothing of a source reaches the driver but sums over all: a round of cutting and sharing, or of trying divisors, is one aggregation.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, scratch

#: Divisors tried in one aggregation; two that differ by less than FINE are one.
TRIED, FINE = 64, 1e-12
_EXACT = "decimal(38,6)"


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """`rows` with `k`, their number from 0 in an order over all: sorted ranges are counted, so no task has all rows."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = Written(dealt.withColumn("_at", F.monotonically_increasing_id()), "apportion-order").df
    part = F.shiftright("_at", 33)
    counts = sorted((r["part"], r["n"]) for r in dealt.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row for each partition
    before, total = [], 0
    for p, n in counts:
        before.append((p, total))
        total += n
    offsets = rows.sparkSession.createDataFrame(before, "_part long, _before long")
    found = dealt.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return found.withColumn("k", F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_at", "_part", "_before")


def with_targets(sources: DataFrame, total: int, cap: int) -> DataFrame:
    """`sources` (weight, words, ...) with `target`: shares of `total` by weight, none above `cap` times its words; the excess is shared again."""
    most = (F.col("words") * cap).cast(_EXACT)
    left, weight, cut = float(total), float(sources.agg(F.sum(F.col("weight").cast(_EXACT))).first()[0] or 0), 0

    def over() -> Column:
        return F.lit(True) if weight <= 0 else F.lit(left) * F.col("weight") / F.lit(weight) > F.col("words") * cap

    while weight > 0:
        sums = sources.agg(F.count_if(over()), F.sum(F.when(over(), most)), F.sum(F.when(~over(), F.col("weight").cast(_EXACT)))).first()
        if sums[0] == cut:
            break
        cut, left, weight = sums[0], float(total - (sums[1] or 0)), float(sums[2] or 0)
    share = F.lit(0.0) if weight <= 0 else F.lit(left) * F.col("weight") / F.lit(weight)
    return sources.withColumn("target", F.when(over(), (F.col("words") * cap).cast("double")).otherwise(share))


def with_seats(rows: DataFrame, seats: int, votes: str = "votes", most: str = "most") -> DataFrame:
    """`rows` (k, votes, most, ...) with `seats` by the highest quotients votes/1, votes/3, votes/5 ...; none over its most; ties by k.

    With a divisor d a row has round(votes / (2 d)) seats: divisors are tried many at a time until two neighbours hold the number between
    them; the seats that the larger one leaves go by quotient.
    """
    limit = F.when(F.col(votes) > 0, F.col(most)).otherwise(0).cast("long")
    given = lambda d: F.least(limit, F.floor(F.col(votes) / F.lit(d) + 0.5)).cast("long")
    every, top, total, n = rows.agg(F.sum(limit), F.max(votes), F.sum(F.col(votes).cast(_EXACT)), F.count("*")).first()
    if seats >= (every or 0):
        return rows.withColumn("seats", limit)
    low, high, held = float(total) / (4 * seats + 4 * n + 4), 4 * float(top) + 1, 0
    while (rows.agg(F.sum(given(low))).first()[0] or 0) <= seats:
        low /= 2
    while high / low > 1 + FINE and held < seats:
        step = (high / low) ** (1 / (TRIED + 1))
        tried = [low * step**j for j in range(1, TRIED + 1)]
        sums = rows.agg(*(F.sum(given(d)) for d in tried)).first()
        fits = [(d, s) for d, s in zip(tried, sums) if low < d < high and s <= seats]
        beyond = [d for d, s in zip(tried, sums) if low < d < high and s > seats]
        if not fits and not beyond:
            break
        if fits:
            high, held = fits[0]
        if beyond:
            low = beyond[-1]
    found = rows.withColumn("seats", given(high))
    rest = seats - (found.agg(F.sum("seats")).first()[0] or 0)
    if rest <= 0:
        return found
    quotient = F.col(votes) / (2 * F.col("seats") + 1)
    extra = found.where(F.col("seats") < limit).orderBy(F.desc(quotient), "k").limit(int(rest)).select("k", F.lit(1).alias("_extra"))
    return found.join(Written(extra, "apportion-extra").df, "k", "left").withColumn("seats", F.col("seats") + F.coalesce("_extra", F.lit(0))).drop("_extra")


def plan(sources: DataFrame, weights, cap: int, block_tokens: int, finest: int) -> tuple[DataFrame, int]:
    """(k, source, rows, words, target, block, quota) of `sources` (source, rows, words), and how many they are.

    Equal blocks by highest quotients; a source whose target has under `finest` of them has blocks of its own (its target in `finest` parts).
    """
    with scratch() as keep:
        last = F.col("source").isNull()
        held = numbered(sources, [last, F.col("source")])
        held = Written(held.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("k") % len(weights) + 1).cast("int")).cast("double")), "apportion-sources").df
        n, total = held.agg(F.count("*"), F.sum("words")).first()
        held = with_targets(held, int(total or 0), cap)
        block = F.when(F.col("target") >= finest * block_tokens, block_tokens).otherwise(F.greatest(F.lit(1), F.floor(F.col("target") / finest)).cast("long"))
        held = held.withColumn("block", block.cast("long"))
        held = Written(held.withColumn("most", cap * F.ceil(F.col("words") / F.col("block"))), "apportion-targets").df
        large = F.col("block") == block_tokens
        aimed = held.where(large).agg(F.sum(F.col("target").cast(_EXACT))).first()[0]
        seated = with_seats(held.where(large), round(float(aimed or 0) / block_tokens), votes="target").withColumnRenamed("seats", "quota")
        own = held.where(~large).withColumn("quota", F.least("most", F.bround(F.col("target") / F.col("block"), 0).cast("long")))
        columns = ["k", "source", "rows", "words", "target", "block", "quota"]
        return keep(Written(seated.select(*columns).unionByName(own.select(*columns)), "apportion-plan")).df, n


def check_weights(weights) -> None:
    if not len(weights) or any(w < 0 or not math.isfinite(w) for w in weights):
        raise ValueError("weights are numbers from 0 on, at least one")
