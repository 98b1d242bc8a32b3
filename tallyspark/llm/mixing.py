"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The mix is counted in blocks of `block_tokens` words. Blocks go to sources by highest quotients
(votes: the sources' target words), then within a source to its shards (votes: the shards'
words), so every shard has an integer quota. A shard is a seeded hash class of a source's
documents, read in seeded order as one stream of words; the stream is cut into blocks, of
which whole passes and a seeded systematic sample make up the quota. A document's share is
the part of its words that lies in chosen blocks, which is a difference of two closed
forms, so blocks are never rows.

A source whose target is under `FINEST` blocks is counted in finer blocks of its own (its target in
`FINEST` parts), so that it comes near its target; the blocks of the others stay as they are.

A source has a shard for each `rows_per_shard` rows, `MOST_SHARDS` at most, so none is a hot group (a shard's window
sorts four numbers a row). Rows are dealt by id and text, so neither null nor repeated ids make one; only rows alike in
both stay together. Sources may be any number: their targets and seats are aggregates over a table of them (`apportion`); shards are
apportioned on the executors, a source's shards in one group of at most `MOST_SHARDS` rows. Targets that exceed
`cap` times their source's words are cut to that, the excess is shared again by weight.

Defined cases: a null text has size 0 and is never taken; null sources are one source, the
last; repeated rows are documents of their own (alike in all, it is open which of them is which); ids may be null; an empty table gives an
empty result; columns beside id, text and source are not read.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import apportion
from .common import Written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_TOKENS = 256
#: Blocks that a source's target has at least.
FINEST = 400
ROWS_PER_SHARD = 4096
MOST_SHARDS = 4096
#: Sources up to which their table (some 100 bytes each) is broadcast; beyond it is joined like any other.
MOST_BROADCAST = 20_000
SEED = 17


def sainte_lague(votes, seats: int, most=None) -> np.ndarray:
    """Seats by the highest quotients votes/1, votes/3, votes/5 ...; none gets over its `most`; ties by position."""
    votes = np.asarray(votes, float)
    most = np.full(len(votes), seats, np.int64) if most is None else np.asarray(most, np.int64)
    most = np.where(votes > 0, most, 0)
    if seats >= most.sum():
        return most
    given = lambda d: np.minimum(most, np.floor(votes / d + 0.5).astype(np.int64))
    low, high = votes.sum() / (4 * seats + 4 * len(votes) + 4), 4 * votes.max() + 1
    while given(low).sum() <= seats:
        low /= 2
    for _ in range(200):
        middle = (low + high) / 2
        if given(middle).sum() > seats:
            low = middle
        else:
            high = middle
    found = given(high)
    rest = [(-votes[k] / (2 * found[k] + 1), k) for k in np.nonzero(found < most)[0].tolist()]
    heapq.heapify(rest)
    for _ in range(seats - int(found.sum())):
        _, k = heapq.heappop(rest)
        found[k] += 1
        if found[k] < most[k]:
            heapq.heappush(rest, (-votes[k] / (2 * found[k] + 1), k))
    return found


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, *carry) -> DataFrame:
    """(id, digest, source, size); digest: of the text."""
    quoted = lambda c: F.col(f"`{c}`")
    size = F.coalesce(F.regexp_count(quoted(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(quoted(id_col).alias("id"), F.xxhash64(quoted(text_col)).alias("digest"), quoted(source_col).alias("source"), size.alias("size"), *carry)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, cap: int = CAP, block_tokens: int = BLOCK_TOKENS, rows_per_shard: int = ROWS_PER_SHARD, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, size, source_size, target, taken) of each row, and the columns of `docs` that `carry` names, as a struct `row`.

    weights: of the sources by code point, null last, repeating.
    """
    apportion.check_weights(weights)
    sized = Written(sizes(docs, id_col, text_col, source_col), "mix-sizes").df
    sources = sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("words"))
    by_source, n_sources = apportion.plan(sources, weights, cap, block_tokens, FINEST)
    shards = F.least(F.lit(MOST_SHARDS), F.ceil(F.col("rows") / rows_per_shard)).alias("shards")
    by_source = by_source.select("k", F.col("source").alias("name"), shards, F.col("words").alias("source_size"), "target", "block", "quota")
    if n_sources <= MOST_BROADCAST:
        by_source = F.broadcast(by_source)

    def place(rows: DataFrame) -> DataFrame:
        found = rows.join(by_source, rows["source"].eqNullSafe(by_source["name"])).withColumn("order", F.xxhash64(F.lit(seed), "id", "digest"))
        return found.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "id", "digest"), "shards"))

    shards = place(sized).groupBy("k", "shard", "block", "quota").agg(F.sum("size").alias("words"))

    def apportioned(shards: pd.DataFrame) -> pd.DataFrame:
        """The quota of each of one source's shards."""
        shards = shards.sort_values("shard", ignore_index=True)
        own = -(-shards["words"].to_numpy() // shards["block"].to_numpy())
        quota = sainte_lague(shards["words"].to_numpy(), int(shards["quota"].iloc[0]), cap * own)
        return pd.DataFrame({"k": shards["k"], "shard": shards["shard"], "blocks": own, "passes": quota // np.maximum(own, 1), "rest": quota % np.maximum(own, 1)})

    by_shard = shards.groupBy("k").applyInPandas(apportioned, "k long, shard long, blocks long, passes long, rest long")
    by_shard = Written(by_shard.withColumn("start", F.pmod(F.xxhash64(F.lit(seed + 2), "k", "shard"), F.greatest("blocks", F.lit(1)))), "mix-shards").df

    stream = Window.partitionBy("k", "shard").orderBy("order", "id", "digest", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = place(sizes(docs, id_col, text_col, source_col, F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")) if carry else sized)
    placed = placed.withColumn("end", F.sum("size").over(stream)).join(by_shard, ["k", "shard"])

    def chosen(j):
        return F.floor((j * F.col("rest") + F.col("start")) / F.greatest("blocks", F.lit(1)))

    def before(x):
        """Words that the mix takes from the first x words of the shard's stream."""
        j = F.floor(x / F.col("block"))
        return F.col("passes") * x + F.col("block") * chosen(j) + (x - j * F.col("block")) * (chosen(j + 1) - chosen(j))

    taken = (before(F.col("end")) - before(F.col("end") - F.col("size"))).cast("long")
    return placed.select("id", "size", "source_size", "target", taken.alias("taken"), *(["row"] if carry else []))
