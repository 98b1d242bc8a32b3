"""Language identification by Bayesian evidence fusion.

Four pieces of evidence are combined for each row, as sums of logarithms:

* the text: a multinomial model over hashed words and byte trigrams, counted over all
  labelled documents by a grouped aggregation; as features overlap, a text weighs as `TEXT_WEIGHT`
  independent features at most;
* the declared markup language (``<html lang>``), through P(declared | language);
* the address suffix (a language segment of the path, else the top-level domain), through
  P(suffix | language);
* the host's prior, smoothed towards its parent domain's, that towards its top-level
  domain's, and that towards the whole corpus.

The two conditionals and the priors are grouped sums of the rows' text posteriors over the whole
table. A row's own posterior is taken out of its host's prior, so it is not counted twice.

Defined cases: long texts are read in pieces of 1 MB, a page's markup is cut out of it as a whole in linear time; of equally likely languages the
first by name counts; columns beside those read are carried along, whatever their names; a null or empty text has a flat likelihood and lives on the other evidence; missing
declarations, suffixes and hosts are left out; hosts of equal name share a prior; repeated
rows count each; an empty table gives an empty result; no labels: no languages, every
language null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Written, bounded_batches, text_bytes
from .features import Words, chunks, mixed, pieces

BUCKETS = 1 << 14
SMOOTHING = 0.5
#: What a feature weighs (features overlap, so less than 1), and all features of a text at most.
FEATURE_WEIGHT = 0.25
TEXT_WEIGHT = 12.0
#: Pseudo-rows of the level above in a host's, domain's and top-level domain's prior.
LEVEL_WEIGHT = 8.0
EVIDENCE_SMOOTHING = 1.0
_OPEN = re.compile(rb"<(?:(script|style)\b|!--)?", re.I)
#: What ends a tag, by what opens it.
_ENDS = {b"script": re.compile(rb"</script\s*+>", re.I), b"style": re.compile(rb"</style\s*+>", re.I), b"!--": re.compile(rb"-->"), b"": re.compile(rb">")}
_ENTITY = re.compile(rb"&#?\w+;")


def features(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, bucket) of the features, some texts (or a piece of a long one) at a time."""
    cut = [(k, part) for k, t in enumerate(texts) for _, part in pieces(t)]
    owner, before = np.array([k for k, _ in cut], np.int64), 0
    for part in chunks([p for _, p in cut]):
        w = Words(part)
        inside = w.folded > 32
        three = inside[:-2] & inside[1:-1] & inside[2:] if len(inside) > 2 else np.zeros(0, bool)
        at = np.nonzero(three)[0]
        f = w.folded.astype(np.uint64)
        gram = mixed(f[at] << np.uint64(16) | f[at + 1] << np.uint64(8) | f[at + 2] | np.uint64(1 << 40))
        doc = np.concatenate((w.doc, np.searchsorted(w.starts, at, side="right") - 1))
        yield owner[before + doc], (np.concatenate((w.hash, gram)) >> np.uint64(30)).astype(np.int64) & (BUCKETS - 1)
        before += len(part)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, np.ndarray] = {}
    for b in batches:
        names, number = np.unique(np.array(b.column(0).to_pylist(), object).astype(str), return_inverse=True)
        for doc, bucket in features(text_bytes(b.column(1))):
            found = np.bincount(number[doc] * BUCKETS + bucket, minlength=len(names) * BUCKETS).reshape(-1, BUCKETS)
            for name, row in zip(names.tolist(), found):
                totals[name] = totals.get(name, 0) + row
    for name, row in totals.items():
        at = np.nonzero(row)[0]
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(row[at])], names=["label", "bucket", "n"])


def train(docs: DataFrame, text_col: str = "text", label_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """(languages, log P(bucket | language)) from the counts over all labelled rows.

    The table that reaches the driver has `BUCKETS` numbers for each language.
    """
    rows = docs.where(F.col(label_col).isNotNull()).select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    bounded_batches()
    counts = rows.mapInArrow(_count_batches, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["label"].unique().tolist())
    table = np.full((len(languages), BUCKETS), SMOOTHING)
    table[counts["label"].map({name: k for k, name in enumerate(languages)}).to_numpy(int), counts["bucket"].to_numpy(int)] += counts["n"].to_numpy(float)
    return languages, np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32) if languages else table


def likelihoods(texts: list[bytes], table: np.ndarray) -> np.ndarray:
    """Tempered log likelihood of each text under each language, the best at 0."""
    n = len(texts)
    held, each = np.zeros(n), np.zeros((n, len(table)))
    for doc, bucket in features(texts):
        held += np.bincount(doc, minlength=n)
        each += np.stack([np.bincount(doc, row[bucket], n) for row in table], axis=1)
    held = np.maximum(held, 1)
    each *= (np.minimum(held * FEATURE_WEIGHT, TEXT_WEIGHT) / held)[:, None]
    return each - each.max(axis=1, keepdims=True) if n else each


def plain(html: bytes) -> bytes:
    """The text of a page without tags, scripts and styles, for the likelihood alone; one that nothing ends is a plain tag.

    What isn't found behind a place isn't looked for behind a later one, so the time is linear in the page.
    """
    out, at, missing = [], 0, set()
    while b"" not in missing and (m := _OPEN.search(html, at)):
        end = None
        for kind in ((m[1] or m[0][1:]).lower(), b""):
            if kind not in missing and not end and not (end := _ENDS[kind].search(html, m.end() if kind else m.start() + 1)):
                missing.add(kind)
        if end:
            out.append(html[at : m.start()])
            at = end.end()
    out.append(html[at:])
    return _ENTITY.sub(b" ", b" ".join(out))


def text_likelihood(text: Column, table: np.ndarray, is_html: bool) -> Column:
    """Column of array<double>: the log likelihoods, by language."""
    bounded_batches()

    @F.arrow_udf("array<double>")
    def scored(column: pa.Array) -> pa.Array:
        texts = text_bytes(column)
        found = likelihoods([plain(t) for t in texts] if is_html else texts, table)
        return pa.array(list(found), pa.list_(pa.float64()))

    return scored(text)


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def suffix_of(url: Column) -> Column:
    """The first path segment where it has the form of a language code, else the top-level domain."""
    path = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[-_][A-Za-z]{2,4})?(?:[/?#]|$)", 1))
    top = F.regexp_extract(host_of(url), r"\.([a-z]+)$", 1)
    return F.when(path != "", F.concat(F.lit("/"), path)).when(top != "", F.concat(F.lit("."), top))


def declared_of(html: Column) -> Column:
    """The two or three letters of ``lang`` in the opening html tag."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html\b[^<>]*?\s(?:xml:)?lang\s*=\s*[\"']?([a-z]{2,3})", 1)), F.lit(""))


def softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def _sums(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """Sums of the text posteriors by `keys`, as an array."""
    return rows.groupBy(*keys).agg(F.array(*(F.sum(F.col("posterior")[k]) for k in range(n))).alias(name))


def _totals(sums: DataFrame, name: str, n: int) -> tuple[list[float], int]:
    """The sum of all rows' arrays (one number for each language) and how many rows there are."""
    *found, rows = sums.agg(*(F.sum(F.col(name)[k]) for k in range(n)), F.count("*")).first()
    return [x or 0.0 for x in found], rows


def _array(numbers: list[float]) -> Column:
    return F.array(*map(F.lit, numbers))


def _conditional(rows: DataFrame, column: str, n: int) -> DataFrame:
    """(_column, log P(column | language)) for each value of `column`."""
    found = Written(_sums(rows.where(F.col(column).isNotNull()), [column], n, "sums"), f"language-{column}").df
    total, values = _totals(found, "sums", n)
    logs = F.zip_with("sums", _array([t + EVIDENCE_SMOOTHING * values for t in total]), lambda s, a: F.log((s + EVIDENCE_SMOOTHING) / a))
    return found.select(F.col(column).alias(f"_{column}"), logs.alias(f"{column}_logs"))


def fuse(rows: DataFrame, languages: list[str]) -> DataFrame:
    """`rows` (logs, declared, suffix, host, ...) with `language`, `score` and the posterior by language.

    logs: log likelihoods of the text, by language. Other columns are carried along, whatever their names; of the three results' names they are replaced.
    """
    n, added = len(languages), ("language", "score", "posterior")
    kept = [c for c in rows.columns if c not in added]
    if not n:
        return rows.select(*(F.col(f"`{c}`") for c in kept), F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("array<double>").alias("posterior"))
    rows = rows.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), "logs", "declared", "suffix", "host", softmax(F.col("logs")).alias("posterior"))
    rows = rows.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).withColumn("top", F.regexp_extract("host", r"([^.]+)$", 1))
    hosts = _sums(rows.where("host is not null"), ["top", "domain", "host"], n, "host_sums")
    add = lambda name: F.array(*(F.sum(F.col(name)[k]) for k in range(n)))
    domains = hosts.groupBy("top", "domain").agg(add("host_sums").alias("domain_sums"))
    tops = Written(domains.groupBy("top").agg(add("domain_sums").alias("top_sums")), "language-tops").df
    whole, _ = _totals(tops, "top_sums", n)
    size = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)

    def smoothed(sums: Column, above: Column) -> Column:
        return F.zip_with(sums, above, lambda s, p: (s + LEVEL_WEIGHT * p) / (size(sums) + LEVEL_WEIGHT))

    p = smoothed(_array(whole), _array([1.0 / n] * n))
    priors = hosts.join(domains, ["top", "domain"]).join(tops, "top").withColumn("p", smoothed(F.col("top_sums"), p)).withColumn("p", smoothed(F.col("domain_sums"), F.col("p")))
    priors = Written(priors.select(F.col("host").alias("_host"), "host_sums", F.col("p").alias("above")), "language-hosts").df
    joined = rows.join(priors, rows["host"] == priors["_host"], "left")
    for column in ("declared", "suffix"):
        known = _conditional(rows, column, n)
        joined = joined.join(known, joined[column] == known[f"_{column}"], "left")
    none = _array([0.0] * n)
    others = F.zip_with("host_sums", "posterior", lambda s, p: F.greatest(s - p, F.lit(0.0)))
    prior = F.coalesce(F.transform(smoothed(others, F.col("above")), lambda p: F.log(p)), none)
    logs = _plus(_plus(F.col("logs"), prior), _plus(F.coalesce("declared_logs", none), F.coalesce("suffix_logs", none)))
    joined = joined.withColumn("posterior", softmax(logs))
    best = F.array_position("posterior", F.array_max("posterior")).cast("int")
    return joined.select("_row.*", F.get(F.array(*map(F.lit, languages)), best - 1).alias("language"), F.array_max("posterior").alias("score"), "posterior")
