"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits. It is cut into three segments of 22, 21 and 21 bits,
each padded with zero bits to a word of 23. The binary Golay code of length 23 is
perfect: every word is within 3 bits of exactly one of its 4096 codewords, whose
index is the word's 12-bit key. ``near(w)`` is the set of keys of w and of the words
one bit away from it, which has at most six members; ``key(u)`` is in ``near(w)``
whenever u and w differ in at most one bit.

Of 3 differing bits over three segments the two segments with the fewest have at
most one each (3+0+0, 2+1+0 or 1+1+1). So for each pair (X, Y) of segments a
fingerprint gives the left keys ``key(X) x near(Y)`` and the right keys
``near(X) x key(Y)``, 24 bits each, about six of either kind: two fingerprints that
differ in at most 3 bits meet in a bucket of some pair, left against right. What meets
is verified on all 64 bits.

Buckets are dealt out by key and searched in numpy. A bucket never yields its pairs:
it yields the edges of a spanning forest of its links, so rows stay linear in the
bucket's size. A bucket with more members than `block` is cut into blocks and every
pair of blocks is searched by a task of its own; each link lies in some pair of blocks.

Defined cases: a very long text is held whole, with its words, by the task that reads it; components have no ties, as the
smallest id names them; a null or empty text has no words and fingerprint 0, linked like any
other; repeated rows and equal texts share a fingerprint and so a component; an empty
table gives an empty result; columns beside the id and the text are not read, whatever their names.
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

SEED = 42
SHINGLE = 3
BITS = 3
#: (lowest bit, number of bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
GOLAY_GENERATOR = 0xC75
BLOCK = 2048
#: Shingles hashed at a time, for bounded memory on long texts.
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    words = ascii_words(text)
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    counts = np.zeros(64, np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, CHUNK):
        h = np.array([digest(line[s:e], seed) for s, e in zip(starts[k : k + CHUNK], ends[k : k + CHUNK])], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = np.array([fingerprint(t, shingle, seed) for t in text_bytes(b.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(values.view(np.int64))], names=["id", "digest", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, digest, fp): the 64-bit fingerprint of each row's whole text, as a signed long; digest: a hash of the exact text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    bounded_batches()
    schema = f"id {rows.schema['id'].dataType.simpleString()}, digest long, fp long"
    return rows.mapInArrow(partial(_fingerprint_batches, shingle=shingle, seed=seed), schema)


@lru_cache(1)
def golay_table() -> np.ndarray:
    """Index of the codeword nearest to each of the 2**23 words."""
    data = np.arange(1 << 12, dtype=np.uint32)
    code = data << 11
    rest = code.copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ np.uint32(GOLAY_GENERATOR << (bit - 11)), rest)
    code |= rest
    table = np.empty(1 << 23, np.uint16)
    one = [1 << i for i in range(23)]
    errors = [0, *one, *(a | b for i, a in enumerate(one) for b in one[:i]), *(a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j])]
    for e in errors:
        table[code ^ np.uint32(e)] = data
    return table


def segment_keys(fps: np.ndarray, segment: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key of each fingerprint's segment; near as (row numbers, keys)."""
    low, bits = segment
    table = golay_table()
    words = (fps >> np.uint64(low) & np.uint64((1 << bits) - 1)).astype(np.uint32)
    flips = np.concatenate(([0], 1 << np.arange(bits))).astype(np.uint32)
    around = np.sort(table[words[:, None] ^ flips[None, :]], axis=1)
    new = np.ones(around.shape, bool)
    new[:, 1:] = around[:, 1:] != around[:, :-1]
    return table[words], np.nonzero(new)[0], around[new]


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, CHUNK // 4):
            b = batch.slice(k, CHUNK // 4)
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            found = [segment_keys(fps, s) for s in SEGMENTS]
            keys, rows, left = [], [], []
            for t, (x, y) in enumerate(PAIRS):
                (kx, rx, nx), (ky, ry, ny) = found[x], found[y]
                keys += [t << 24 | kx[ry].astype(np.int64) << 12 | ny, t << 24 | nx.astype(np.int64) << 12 | ky[rx]]
                rows += [ry, rx]
                left += [np.ones(len(ry), bool), np.zeros(len(rx), bool)]
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(left)), b.column(0).take(at), b.column(1).take(at)], names=["key", "is_left", "fp", "node"])


def forest(fps: np.ndarray, left: np.ndarray, right: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (as two arrays of positions) of a spanning forest of the links between left and right members.

    Searches breadth first; a member that was reached is not compared again, so a bucket
    whose members are all alike costs a few passes and one whose members are all apart a
    pass for each.
    """
    a, b = [], []
    fresh = {True: np.nonzero(left)[0], False: np.nonzero(right)[0]}
    while len(fresh[True]) and len(fresh[False]):
        start = int(fresh[True][0])
        fresh[True] = fresh[True][1:]
        queue = [(start, True)]
        for at, is_left in queue:
            other = fresh[not is_left]
            if not len(other):
                continue
            linked = np.bitwise_count(fps[other] ^ fps[at]) <= bits
            if linked.any():
                reached = other[linked]
                fresh[not is_left] = other[~linked]
                a += [at] * len(reached)
                b += reached.tolist()
                queue += [(int(x), not is_left) for x in reached]
    return np.array(a, np.int64), np.array(b, np.int64)


def small_links(keys: np.ndarray, fps: np.ndarray, left: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal keys, each row against the next, the one after it and so on."""
    a, b = [], []
    for step in range(1, len(keys)):
        at = np.nonzero(keys[step:] == keys[:-step])[0]
        if not len(at):
            break
        at = at[(np.bitwise_count(fps[at] ^ fps[at + step]) <= bits) & (left[at] != left[at + step])]
        a.append(at)
        b.append(at + step)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64),) * 2


#: Runs up to this many rows are compared row by row; longer ones by `forest`.
SHORT_RUN = 24


def _link_batches(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, part); a run of both is one bucket or pair of blocks, of bounded size."""
    held = None

    def links(t: pa.Table) -> Iterator[pa.RecordBatch]:
        run, left, fps = (t.column(c).to_numpy() for c in ("run", "is_left", "fp"))
        node, fps = t.column("node").combine_chunks(), fps.view(np.uint64)
        edges = np.nonzero(np.diff(run))[0] + 1
        starts, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(run)]))
        long = ends - starts > SHORT_RUN
        short = np.repeat(~long, ends - starts)
        where = np.nonzero(short)[0]
        found = [tuple(where[x] for x in small_links(run[where], fps[where], left[where], bits))] if len(where) else []
        for s, e in zip(starts[long], ends[long]):
            x, y = forest(fps[s:e], left[s:e], ~left[s:e], bits)
            found.append((x + s, y + s))
        a, b = (np.concatenate([f[i] for f in found]) for i in (0, 1)) if found else (np.zeros(0, np.int64),) * 2
        keep = fps[a] != fps[b]
        if keep.any():
            yield pa.RecordBatch.from_arrays([node.take(pa.array(a[keep])), node.take(pa.array(b[keep]))], names=["src", "dst"])

    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        run = t.column("run").to_numpy()
        last = int(np.searchsorted(-(run != run[-1]).astype(np.int8), 0)) if len(run) else 0
        if last:
            yield from links(t.slice(0, last))
        held = t.slice(last)
    if held is not None and held.num_rows:
        yield from links(held)


def links(fps: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(src, dst) between nodes (one for each distinct fingerprint): a spanning set of all links at `bits` or fewer bits.

    fps: (fp long, node), distinct in fp.
    """
    if not 0 <= bits <= BITS:
        raise ValueError(f"three segments find links at up to {BITS} bits")
    node = fps.schema["node"].dataType.simpleString()
    keys = fps.select("fp", "node").mapInArrow(_key_batches, f"key long, is_left boolean, fp long, node {node}")
    keys = Written(keys, "simhash-keys").df
    # Blocks of a bucket: `count / block` of them, dealt by the fingerprint's hash; one for nearly every bucket.
    sizes = keys.groupBy("key").agg(F.count("*").alias("n"), F.max("is_left").alias("l"), F.min("is_left").alias("r")).where("l and not r")
    sizes = sizes.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    other = F.sequence(F.lit(0), F.col("blocks") - 1)
    # A left row goes to (its block, every block), a right row to (every block, its block).
    part = F.when(F.col("is_left"), F.transform(other, lambda o: mine * F.col("blocks") + o)).otherwise(F.transform(other, lambda o: o * F.col("blocks") + mine))
    single = F.col("blocks") == 1
    rows = keys.join(sizes, "key").select("key", "is_left", "fp", "node", F.explode(F.when(single, F.array(F.lit(0))).otherwise(part)).alias("part"))
    rows = rows.select(F.xxhash64("key", "part").alias("run"), "is_left", "fp", "node")
    rows = rows.repartition("run").sortWithinPartitions("run")
    return rows.mapInArrow(partial(_link_batches, bits=bits), f"src {node}, dst {node}")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = BITS, seed: int = SEED, block: int = BLOCK) -> DataFrame:
    """(id, digest, fp, component): the smallest id reachable over links between fingerprints, itself included."""
    docs_fp = Written(fingerprints(docs, id_col, text_col, shingle, seed), "simhash-fp").df
    nodes = docs_fp.groupBy("fp").agg(F.min("id").alias("node"))
    with scratch() as keep:
        found = connected_components(links(nodes.where("node is not null"), bits, block))
        # Written, so that the rows of a very common fingerprint meet their one row in a join that Spark can split.
        named = keep(Written(nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component")), "simhash-named")).df
    return docs_fp.join(named, "fp").select("id", "digest", "fp", "component")


def hex_fingerprint(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of `docs`: the one with the smallest id, of rows with equal ids that of the smallest text hash.

    A null id comes after all others; a group without any id is the rows of one fingerprint.
    """
    group = [F.col("component"), F.when(F.col("component").isNull(), F.col("fp")).alias("alone")]
    with scratch() as keep:
        groups = simhash_groups(docs, id_col, text_col, **options)
        first = keep(first_of_groups(groups, group)).df
    return rows_of(docs, first, id_col, text_col)


def first_of_groups(groups: DataFrame, group: list) -> Written:
    """(_id, _digest, _n): the smallest (id, digest) of each group of `groups` (id, digest and what `group` reads), and how many rows have it."""
    keys = [f"group{k}" for k in range(len(group))]
    rows = groups.groupBy(*(g.alias(k) for g, k in zip(group, keys)), "id", "digest").agg(F.count("*").alias("n"))
    first = rows.groupBy(*keys).agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "digest", "n")).alias("first"))
    return Written(first.select(F.col("first.id").alias("_id"), F.col("first.digest").alias("_digest"), F.col("first.n").alias("_n")), "simhash-kept")


def rows_of(docs: DataFrame, keep: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of `docs` for each of `keep` (_id, _digest, _n)."""
    same = docs[f"`{id_col}`"].eqNullSafe(keep["_id"]) & (F.xxhash64(docs[f"`{text_col}`"]) == keep["_digest"])
    # Only rows that repeat both id and text need to be thinned out.
    repeated = docs.join(keep.where("_n > 1"), same, "left_semi").dropDuplicates([id_col, text_col])
    return docs.join(keep.where("_n = 1"), same, "left_semi").unionByName(repeated)
