"""Secret scans with corpus-wide ownership frequency.

A scan of every whole text finds candidates: three base kinds (assigned values, access
keys, long hex runs) and opaque tokens (runs of 32 or more characters of mixed classes and
high entropy outside the base spans). The hash of each candidate's value is aggregated
over the corpus: distinct repositories, distinct owners. A value that `copied_owners` or
more owners hold is a copied example, however many repositories of fewer owners hold it; a value of
one owner is live-looking. Base spans always stay; an opaque token becomes a span of kind
``live`` only where it is no copied example (its field `live` says whether one owner has it).

Spans are in code points, end exclusive.

Defined cases: a text of any length is scanned and masked whole, in linear time; spans that start together are in the order of
their kinds, and a value found as two kinds counts once; a null or empty text has no spans; a null owner or repository counts as one
owner or repository; repeated rows count once in the frequencies and each have their result;
an empty table gives an empty result; only the id, text, owner and repository columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, bounded_batches

KINDS = ("assign", "access", "hex", "live")
#: Least length of the value of each base kind.
LEAST = {"assign": 6, "access": 20, "hex": 24}
ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{32,}")
#: Bits of entropy per character of an opaque token, at least.
ENTROPY = 3.5
COPIED_OWNERS = 3

CANDIDATES = pa.list_(pa.struct([("kind", pa.int8()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.int64())]))


def entropy(value: str) -> float:
    counts = np.unique(np.frombuffer(value.encode(), np.uint8), return_counts=True)[1] / len(value)
    return float(-(counts * np.log2(counts)).sum())


def _opaque(value: str) -> bool:
    classes = (re.search("[a-z]", value), re.search("[A-Z]", value), re.search("[0-9]", value))
    return all(classes) and entropy(value) >= ENTROPY


def candidates(text: str | None) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) by start, then kind. A value is the same whatever the kind it was found as."""
    if not text:
        return []
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        found += [(0, m.start(), m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(2, m.start(), m.end(), m[0]) for m in HEX.finditer(text)]
    base, at, reach = sorted((s, e) for _, s, e, _ in found), 0, 0
    for m in OPAQUE.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][1])
            at += 1
        if reach <= m.start() and _opaque(m[0]):
            found.append((3, m.start(), m.end(), m[0]))
    return sorted(found, key=lambda c: (c[1], c[0]))


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [[{"kind": k, "start": s, "end": e, "value": np.uint64(xxhash.xxh64_intdigest(v)).astype(np.int64)} for k, s, e, v in candidates(t)] for t in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), pa.array(found, CANDIDATES)], names=["id", "repo", "owner", "digest", "found"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """(id, repo, owner, digest, found): the candidates of each row; digest: of its text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(repo_col).alias("repo"), F.col(owner_col).alias("owner"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    bounded_batches()
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("id", "repo", "owner")}
    return rows.mapInArrow(_scan_batches, f"id {kinds['id']}, repo {kinds['repo']}, owner {kinds['owner']}, digest long, found array<struct<kind:tinyint,start:int,end:int,value:bigint>>")


def ownership(scanned: DataFrame) -> DataFrame:
    """(value, n_repos, n_owners) of each candidate hash over the whole corpus.

    Counted in steps with partial sums, so a value that a third of the corpus holds is no hot group.
    """
    each = scanned.where(F.size("found") > 0).select("repo", "owner", F.explode("found.value").alias("value"))
    each = each.select("value", F.struct("repo").alias("repo"), F.struct("owner").alias("owner")).distinct()
    by_repo = each.groupBy("value", "repo").agg(F.count("*").alias("n")).groupBy("value").agg(F.count("*").alias("n_repos"))
    by_owner = each.groupBy("value", "owner").agg(F.count("*").alias("n")).groupBy("value").agg(F.count("*").alias("n_owners"))
    return by_repo.join(by_owner, "value")


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", copied_owners: int = COPIED_OWNERS) -> DataFrame:
    """(id, digest, spans): one row per row of `docs`; digest: of its text; spans as (start, kind, end, n_repos, n_owners, copied, live) in order."""
    held = Written(scan(docs, id_col, text_col, repo_col, owner_col).select("*", F.monotonically_increasing_id().alias("row")), "secret-scan").df
    copied = F.col("n_owners") >= copied_owners
    known = ownership(held).select("value", "n_repos", "n_owners", copied.alias("copied"), (~copied & (F.col("n_owners") == 1)).alias("live"))
    each = held.where(F.size("found") > 0).select("row", F.explode("found").alias("f")).select("row", "f.*")
    each = each.join(known, "value").where((F.col("kind") < KINDS.index("live")) | ~F.col("copied"))
    spans = each.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "n_repos", "n_owners", "copied", "live"))).alias("spans"))
    none = F.array().cast(spans.schema["spans"].dataType)
    return held.select("id", "digest", "row").join(spans, "row", "left").select("id", "digest", F.coalesce("spans", none).alias("spans"))


def span_text(spans):
    """kind:start:end of each, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"].cast("int")), s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_spans(spans):
    return F.filter(spans, lambda s: s["kind"] < KINDS.index("live"))


def mask_text(text: str, spans: Iterable[tuple[int, int]], mask: str) -> str:
    """The text with its spans (by start) masked, cut once at their edges; spans that overlap share one mask."""
    out, at = [], 0
    for start, end in spans:
        if end <= at:
            continue
        if start >= at:
            out += (text[at:start], mask)
        at = end
    out.append(text[at:])
    return "".join(out)


def masked(text: Column, spans: Column, mask: str = "[SECRET]") -> Column:
    """Column of the texts with each of the `spans` (start, end; by start) as one `mask`; null where the text is."""
    bounded_batches()

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(texts, spans):
            t = t.as_py()
            if t is not None and s.is_valid:
                edges = s.values
                t = mask_text(t, zip(edges.field("start").to_pylist(), edges.field("end").to_pylist()), mask)
            out.append(t)
        return pa.array(out, pa.string())

    return cut(text, F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]", **options) -> DataFrame:
    """`docs` with every span masked whose value is not a copied example; other rows and columns as they were."""
    spans = secret_spans(docs, id_col, text_col, **options)
    kept = F.filter("spans", lambda s: ~s["copied"])
    to_mask = spans.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), kept.alias("_spans")).where(F.size("_spans") > 0).dropDuplicates(["_id", "_digest"])
    own = lambda c: docs[f"`{c}`"]
    same = own(id_col).eqNullSafe(to_mask["_id"]) & (F.xxhash64(own(text_col)) == to_mask["_digest"])
    text, found = own(text_col), to_mask["_spans"]
    # Only texts with spans go to Python.
    text = F.when(found.isNull(), text).otherwise(masked(F.when(found.isNotNull(), text), found, mask))
    return docs.join(to_mask, same, "left").select(*((text if c == text_col else own(c)).alias(c) for c in docs.columns))
