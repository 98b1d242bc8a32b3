"""SimHash near copies, checked by word-shingle similarity, for the pipeline's stage.

A text is the set of its shingles of five words (words as in `simhash`; a shorter text is one
shingle). Two texts are near copies where the Jaccard similarity of their sets is 0.8 or more.
Candidates come from `simhash`: texts whose fingerprints are equal or linked at 3 or fewer differing bits. As most
pairs of that similarity lie further apart, more come from `BANDS` bands of `ROWS` minima of seeded permutations: at a similarity of
exactly 0.8 a pair meets in no band with a chance of 0.0005, above it less. Every
link, of either kind, is verified on the whole sets before components form. A shingle is a hash of 32 bits there: two texts of a thousand
shingles agree in one by chance once in 4000 pairs, which moves their similarity by a thousandth.

Texts of the same words are one node. First the SimHash candidates are verified, and every member of a bucket is compared with
the bucket's least node, which joins most groups in rows linear in their size. In buckets that
still hold several components all pairs of different components are then compared inside
one task; larger buckets are cut into blocks, and every pair of blocks has a task of its own.

Defined cases: texts without words (null or empty) are copies of each other; rows with a null
id and repeated rows take part like any other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Written, ascii_words, bounded_batches, scratch, text_bytes
from .components import connected_components
from .features import mixed
from .simhash import SEED, fingerprint, first_of_groups, links, rows_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 6
BLOCK = 512
#: Shingles permuted at a time, for bounded memory on long texts.
CHUNK = 1 << 11


@lru_cache(8)
def _weights(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64) | np.uint64(1)


def shingles(words: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes, of 32 bits, of the runs of `shingle` words; a shorter text is one run."""
    if not words:
        return np.zeros(0, np.uint32)
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    weight = _weights(shingle, seed)
    n, held = max(1, len(words) - shingle + 1), min(shingle, len(words))
    runs = np.full(n, np.uint64(held))
    for k in range(held):
        runs += each[k : k + n] * weight[k]
    return np.unique((mixed(runs) >> np.uint64(32)).astype(np.uint32))


@lru_cache(1)
def _permutations(seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Odd factors and shifts of the permutations of 32 bits; factors that make a band's minima its key."""
    rng = np.random.default_rng(seed)
    factor, shift = rng.integers(0, 1 << 32, (2, BANDS * ROWS, 1), dtype=np.uint32)
    return factor | np.uint32(1), shift, rng.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def band_keys(hashes: np.ndarray, seed: int = SEED) -> np.ndarray:
    """A key for each band of minima; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    factor, shift, weight = _permutations(seed)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(hashes), CHUNK):
        least = np.minimum(least, (hashes[None, k : k + CHUNK] * factor + shift).min(axis=1))
    return mixed(mixed((mixed(least.astype(np.uint64).reshape(BANDS, ROWS)) * weight).sum(axis=1, dtype=np.uint64)) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        node, fps, keys, sets = [], [], [], []
        for t in text_bytes(b.column(1)):
            words = ascii_words(t)
            found = shingles(words)
            node.append(xxhash.xxh64_intdigest(b" ".join(words), SEED))
            fps.append(fingerprint(t))
            keys.append(band_keys(found))
            sets.append(np.sort(found.view(np.int32)))
        columns = [b.column(0), b.column(2), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), pa.array(sets, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["id", "digest", "node", "fp", "keys", "shingles"])


def _could(a, b, similarity: float):
    """Whether sets of these sizes can be that similar."""
    return F.least(a, b) >= similarity * F.greatest(a, b)


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The (src, dst) whose sets are similar."""
    a, b = (sets.select(F.col("node").alias(end), F.col("shingles").alias(f"{end}_set")) for end in ("src", "dst"))
    both = pairs.join(b, "dst").join(a, "src").select("src", "dst", F.size(F.array_intersect("src_set", "dst_set")).alias("n"), (F.size("src_set") + F.size("dst_set")).alias("total"))
    return both.where(F.col("n") >= similarity * (F.col("total") - F.col("n"))).select("src", "dst")


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted sets share."""
    at = np.searchsorted(a, b)
    return int(np.count_nonzero(a[np.minimum(at, len(a) - 1)] == b))


def _bucket_links(node: np.ndarray, component: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between different components, none between those already joined."""
    sizes = np.array([len(s) for s in sets])
    _, component = np.unique(component, return_inverse=True)
    found = []
    for k in range(1, len(node)):
        could = (component[:k] != component[k]) & (np.minimum(sizes[:k], sizes[k]) >= similarity * np.maximum(sizes[:k], sizes[k]))
        for j in np.nonzero(could)[0].tolist():
            if component[j] == component[k]:
                continue
            n = _shared(sets[j], sets[k])
            if n >= similarity * (sizes[j] + sizes[k] - n):
                found.append((int(node[j]), int(node[k])))
                component[component == component[j]] = component[k]
    return found


def _search_batches(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by run; a run is one bucket or pair of blocks, of bounded size."""
    run, held = None, []

    def links() -> Iterator[pa.RecordBatch]:
        if held:
            node, component, sets = zip(*held)
            found = _bucket_links(np.array(node), np.array(component), list(sets), similarity)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], names=["src", "dst"])

    for b in batches:
        for k, (r, n, c) in enumerate(zip(*(b.column(i).to_pylist() for i in range(3)))):
            if r != run:
                yield from links()
                run, held = r, []
            # Copied, so that no batch outlives its turn.
            held.append((n, c, b.column(3)[k].values.to_numpy().copy()))
    yield from links()


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """(src, dst) of `nodes` (node, fp): each against the least node of its fingerprint, and those least nodes over a spanning set of the SimHash links."""
    least = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    same = nodes.join(least, "fp").where("node <> least").select(F.col("least").alias("src"), F.col("node").alias("dst"))
    return links(least.select("fp", F.col("least").alias("node"))).unionByName(same)


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(id, digest, component) of each row: the least node reachable over verified links; digest: a hash of the exact text."""
    if similarity < SIMILARITY:
        raise ValueError(f"the bands find pairs of similarity {SIMILARITY} or more")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    bounded_batches()
    rows = rows.mapInArrow(_set_batches, f"id {rows.schema['id'].dataType.simpleString()}, digest long, node long, fp long, keys array<long>, shingles array<int>")
    held = Written(rows.withColumn("row", F.monotonically_increasing_id()), "similar-rows").df
    nodes = held.groupBy("node").agg(F.min(F.struct("row", F.size("shingles").alias("n"), "fp", "keys")).alias("one")).select("node", "one.*")
    nodes = Written(nodes, "similar-nodes").df
    keys = nodes.select("node", "n", F.explode("keys").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("node", "n")).alias("least")).where("members > 1")
    met = Written(keys.join(buckets, "key"), "similar-met").df
    with scratch() as keep:
        near = keep(Written(fingerprint_pairs(nodes.select("node", "fp")).distinct(), "similar-near")).df
    asked = met.select("node").unionByName(near.select(F.explode(F.array("src", "dst")).alias("node"))).distinct()
    candidates = nodes.join(asked, "node", "left_semi").select("row")
    sets = Written(held.select("row", "node", "shingles").join(candidates, "row", "left_semi").select("node", "shingles"), "similar-sets").df
    pairs = met.where((F.col("node") != F.col("least.node")) & _could(F.col("n"), F.col("least.n"), similarity)).select(F.col("least.node").alias("src"), F.col("node").alias("dst")).unionByName(near).distinct()
    first = Written(_verified(pairs, sets, similarity), "similar-links").df
    # Buckets of two have had their comparison.
    joined = met.where("members > 2").select("key", "node").join(connected_components(first), "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    joined = Written(joined, "similar-joined").df
    several = joined.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high").select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    part = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.least(mine, o) * F.col("blocks") + F.greatest(mine, o))
    runs = joined.join(several, "key").select("node", "component", F.explode(part).alias("part"), "key").select(F.xxhash64("key", "part").alias("run"), "node", "component")
    runs = runs.join(sets, "node").select("run", "node", "component", "shingles").repartition("run").sortWithinPartitions("run")
    second = Written(runs.mapInArrow(partial(_search_batches, similarity=similarity), "src long, dst long"), "similar-links").df
    found = connected_components(first.unionByName(second))
    # Written, so that the rows of a very common text meet their one row in a join that Spark can split.
    named = Written(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component")), "similar-named").df
    return held.select("id", "digest", "node").join(named, "node").select("id", "digest", "component")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of near copies in `docs`, chosen as in `simhash.deduplicate`."""
    with scratch() as keep:
        groups = similar_groups(docs, id_col, text_col, **options)
        first = keep(first_of_groups(groups, [F.col("component")])).df
    return rows_of(docs, first, id_col, text_col)
