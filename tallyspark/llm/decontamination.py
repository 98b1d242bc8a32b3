"""Benchmark decontamination with an Aho-Corasick automaton over normalised text.

Texts are normalised alike: A-Z in lower case, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
joined by single spaces, a space at either end. A window is 10 consecutive words of an item (all
of an item with fewer words, but not none). One automaton over all items scans each text once: its
patterns are the short items and, of the longer ones, every seventh run of four words, one of which lies
in any window; that makes it small enough for megabytes of benchmark. Where such a run is met, the
windows of the text around it are looked up by hash among those of the items and compared word by word.
Ends of matches give word numbers, and words map back to offsets in the original text.

The benchmark goes to the executors as the items it is built from, in a broadcast of at most
`MOST_BYTES` (checked by an aggregation before anything is collected); a worker builds the automaton once. A
larger benchmark has several automata, each of a part of its items (`in_parts`): one pass of the texts for each, which gives
back the texts that are hit; their runs and items are then put together. So the same method holds at any size, at a
scan for each `MOST_BYTES`; an item of more than half of that widens its part.

Defined cases: texts of any length are taken whole, one at a time; a word that lies in several windows is hit once, and an item that
occurs often is named once (no ties); a null text or item has no words and no windows; repeated items share
windows and each count by id (null ids by no id); repeated documents each have their row; empty tables give
empty results (no benchmark: no hits); columns beside id and text are carried along, and one of the
result's name is replaced.
"""

from __future__ import annotations

import re
import uuid
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, bounded_batches, text_bytes
from .features import mixed

WINDOW = 10
#: Benchmark text, in bytes, that the automaton takes; it needs some 50 times as much in each worker.
MOST_BYTES = 4 << 20
#: Words of a pattern of longer items.
ANCHOR = 4

_WORD = [b for b in range(256) if b >= 0x80 or chr(b).isalnum()]
TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if b in _WORD else 32 for b in range(256))
#: The same words in the original text.
ORIGINAL = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def line(found: list[bytes]) -> str:
    return (b" " + b" ".join(found) + b" ").decode("latin-1")


def hashes(found: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in found), np.uint64, len(found))


def window_hashes(each: np.ndarray, n: int, starts: np.ndarray | None = None) -> np.ndarray:
    """A hash of the n words from each start (of every window) by the words' hashes."""
    starts = np.arange(len(each) - n + 1) if starts is None else starts
    sums = np.zeros(len(starts), np.uint64)
    for k in range(n):
        sums += mixed(each[starts + k] + np.uint64(k))
    return mixed(sums + np.uint64(n))


class Automaton:
    """The items' automaton and windows."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.window, self.ids = window, [i for i, _ in items]
        #: Of the patterns: whether it is part of longer items; words and owners of the item that it is.
        patterns: dict[str, list] = {}
        anchor = min(ANCHOR, window)
        self.words: list[bytes] = []
        starts, owners = [], []
        for k, (_, text) in enumerate(items):
            found = words(text)
            if not found:
                continue
            if len(found) < window:
                patterns.setdefault(line(found), [False, len(found), []])[2].append(k)
                continue
            for i in range(0, len(found) - anchor + 1, window - anchor + 1):
                patterns.setdefault(line(found[i : i + anchor]), [True, anchor, []])[0] = True
            starts.append(len(self.words) + np.arange(len(found) - window + 1))
            owners.append(np.full(len(starts[-1]), k))
            self.words += found
        start, owner = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, owners))
        for self.seed in range(64):
            each = hashes(self.words, self.seed)
            h = window_hashes(each, window, start)
            check = window_hashes(hashes(self.words, self.seed + 64), window, start)
            order = np.lexsort((owner, check, h))
            new = np.concatenate(([True], np.diff(h[order]) != 0)) if len(h) else np.zeros(0, bool)
            if (new[1:] | (np.diff(check[order]) == 0)).all():
                break  # different windows have different hashes
        #: Hash, first place and, from `at` on, owners of each distinct window.
        self.hash, self.place, self.owner = h[order][new], start[order][new], owner[order]
        self.at = np.append(np.nonzero(new)[0], len(order))
        self.built = ahocorasick.Automaton()
        for pattern, value in patterns.items():
            self.built.add_word(pattern, tuple(value))
        self.built.make_automaton()
        self.empty = not patterns

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words as (first, end), and the ids of the items that occur."""
        if not found or self.empty:
            return [], set()
        matched = list(self.built.iter(line(found)))
        if not matched:
            return [], set()
        # Where in the line the space behind each word stands.
        after = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        last = np.searchsorted(after, np.fromiter((end for end, _ in matched), np.int64, len(matched)))
        spots, who = [], set()
        around = np.zeros(len(found) + 1, np.int64)
        for at, (_, (is_part, n, owners)) in zip(last.tolist(), matched):
            if owners:
                spots.append((at - n + 1, n))
                who.update(owners)
            if is_part:
                around[max(0, at - self.window + 1)] += 1
                around[at - n + 2] -= 1
        starts = np.nonzero(np.cumsum(around)[: max(0, len(found) - self.window + 1)])[0]
        if len(starts) and len(self.hash):
            h = window_hashes(hashes(found, self.seed), self.window, starts)
            k = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
            same = self.hash[k] == h
            for start, j in zip(starts[same].tolist(), k[same].tolist()):
                place = self.place[j]
                if found[start : start + self.window] == self.words[place : place + self.window]:
                    spots.append((start, self.window))
                    who.update(self.owner[self.at[j] : self.at[j + 1]].tolist())
        return runs_of(len(found), spots), {self.ids[k] for k in who if self.ids[k] is not None}


class Shared:
    """The items in a broadcast, told apart by a token, so that no worker hashes them."""

    def __init__(self, broadcast, window: int):
        self.broadcast, self.window, self.token = broadcast, window, uuid.uuid4().hex

    def __hash__(self) -> int:
        return hash(self.token)

    def __eq__(self, other) -> bool:
        return self.token == other.token


@lru_cache(2)
def automaton(shared: Shared) -> Automaton:
    return Automaton(shared.broadcast.value, shared.window)


def runs_of(n: int, spots: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs, as (first, end), of the words of a text of n that lie in one of the spots (first, number of words)."""
    if not spots:
        return []
    first, many = np.array(spots, np.int64).T
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + many, -1)
    hit = np.concatenate(([False], np.cumsum(change[:-1]) > 0, [False]))
    turns = np.nonzero(hit[1:] != hit[:-1])[0]
    return list(zip(turns[::2].tolist(), turns[1::2].tolist()))


def offsets(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) in code points of the original text of each run of words."""
    if not runs:
        return []
    at = [m.span() for m in ORIGINAL.finditer(text.decode())]
    return [(at[s][0], at[e - 1][1]) for s, e in runs]


RUN = pa.list_(pa.struct([("first_word", pa.int32()), ("end_word", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))


RESULT = "struct<n_words:bigint,runs:array<struct<first_word:int,end_word:int,start:int,end:int>>,items:array<string>>"


def _shown(text: bytes, runs: list[tuple[int, int]]) -> list[dict]:
    return [{"first_word": w[0], "end_word": w[1], "start": o[0], "end": o[1]} for w, o in zip(runs, offsets(text, runs))]


def _result(n: list[int], shown: list, items: list) -> pa.Array:
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(shown, RUN), pa.array(items, pa.list_(pa.string()))], names=["n_words", "runs", "items"])


def _scanned(column: pa.Array, built: Automaton) -> pa.Array:
    """One text's words are held at a time."""
    n, shown, items = [], [], []
    for text in text_bytes(column):
        found = words(text)
        runs, who = built.scan(found)
        n.append(len(found))
        shown.append(_shown(text, runs))
        items.append(sorted(who))
    return _result(n, shown, items)


def _scan_column(text, held: list[tuple[str | None, bytes]], spark: SparkSession, window: int):
    bounded_batches()
    shared = Shared(spark.sparkContext.broadcast(held), window)

    @F.arrow_udf(RESULT)
    def scanned(texts: pa.Array) -> pa.Array:
        return _scanned(texts, automaton(shared))

    return scanned(text)


def _items(benchmark: DataFrame, item_col: str, item_text_col: str) -> DataFrame:
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("binary").alias("text")).where("text is not null")
    return items.withColumn("size", F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)))


def _collected(items: DataFrame) -> list[tuple[str | None, bytes]]:
    return [(r["item"], bytes(r["text"])) for r in items.select("item", "text").collect()]


def contamination(text, benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, most_bytes: int = MOST_BYTES):
    """Column (n_words, runs, items) of the column `text`: the hit runs, with word numbers and offsets, and the items that occur.

    Raises ValueError for a benchmark over `most_bytes`; `contaminated` takes any.
    """
    items = _items(benchmark, item_col, item_text_col)
    size = items.agg(F.sum("size")).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"the benchmark has {size} bytes; one automaton takes {most_bytes}")
    return _scan_column(text, _collected(items), benchmark.sparkSession, window)


def parts_of(items: DataFrame, most_bytes: int) -> tuple[DataFrame, int]:
    """The items with the number of their part, and the number of parts: each has at most `most_bytes`, or twice the largest item where that is more."""
    items = Written(items.withColumn("key", F.xxhash64(F.monotonically_increasing_id())), "contamination-items").df
    total, largest = items.agg(F.sum("size"), F.max("size")).first()
    limit = max(most_bytes, 2 * (largest or 0), 1)
    n = max(1, -(-2 * (total or 0) // limit))
    while n > 1 and items.groupBy(F.pmod("key", F.lit(n))).agg(F.sum("size").alias("size")).agg(F.max("size")).first()[0] > limit:
        n += -(-n // 2)
    return items.withColumn("part", F.pmod("key", F.lit(n))), n


def in_parts(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, name: str = "contamination", most_bytes: int = MOST_BYTES) -> DataFrame:
    """What `contaminated` gives, for a benchmark of any size: an automaton for each part of it, one pass of the texts each.

    A pass gives back the hit runs and items of the texts that have any, so nothing else is shuffled, and a worker holds one part's automaton at a time.
    """
    kept = [c for c in docs.columns if c != name]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("doc"), F.col(f"`{text_col}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = Written(rows, "contamination-rows").df
    items, n = parts_of(_items(benchmark, item_col, item_text_col), most_bytes)
    hits = None
    for part in range(n):
        found = rows.select("row", _scan_column(F.col("text"), _collected(items.where(F.col("part") == part)), docs.sparkSession, window).alias("c"))
        found = Written(found.select("row", "c.runs", "c.items").where(F.size("runs") > 0), "contamination-hits").df
        hits = found if hits is None else hits.unionByName(found)
    gathered = hits.groupBy("row").agg(F.flatten(F.collect_list("runs")).alias("spots"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))

    @F.arrow_udf(RESULT)
    def shown(texts: pa.Array, spots: pa.Array, items: pa.Array) -> pa.Array:
        n, runs = [], []
        for text, held in zip(text_bytes(texts), spots.to_pylist()):
            n.append(len(words(text)))
            runs.append(_shown(text, runs_of(n[-1], [(s["first_word"], s["end_word"] - s["first_word"]) for s in held or []])))
        return _result(n, runs, [x or [] for x in items.to_pylist()])

    bounded_batches()
    return rows.join(gathered, "row", "left").select("doc.*", shown("text", "spots", "items").alias(name))


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", name: str = "contamination", item_col: str = "item_id", item_text_col: str = "text", most_bytes: int = MOST_BYTES, **options) -> DataFrame:
    """`docs` with the column `name` (n_words, runs, items), by one automaton where the benchmark fits into it and by several where not."""
    named = {"item_col": item_col, "item_text_col": item_text_col, "most_bytes": most_bytes, **options}
    if (_items(benchmark, item_col, item_text_col).agg(F.sum("size")).first()[0] or 0) > most_bytes:
        return in_parts(docs, benchmark, text_col, name=name, **named)
    return docs.withColumn(name, contamination(F.col(f"`{text_col}`"), benchmark, **named))


def hit_words(runs):
    return F.aggregate(runs, F.lit(0).cast("long"), lambda n, r: n + r["end_word"] - r["first_word"])


def item_digest(items):
    return F.sha2(F.array_join(items, ","), 256)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` whose text has no hit."""
    found = contaminated(docs, benchmark, text_col, "_hits of the benchmark", **options)
    return found.where(F.size(F.col("`_hits of the benchmark`")["runs"]) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))
