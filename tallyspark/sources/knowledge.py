"""Markdown knowledge: front matter, sections, and chunks of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens, slug

MAX_TOKENS = 380


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of every file under `path`; the id is the file's name without its ending."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return files.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("doc_id"), F.col("value").alias("text"))


def front_matter(text: Column, key: str) -> Column:
    """A one-line entry of the front matter, without quotes; empty if there is none."""
    head = F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    return F.trim(F.regexp_replace(F.regexp_extract(head, rf"(?m)^{key}:[ \t]*(.*)$", 1), "^[\"']|[\"']$", ""))


def listed(entry: Column) -> Column:
    """The members of a bracketed list."""
    inner = F.regexp_replace(entry, r"^\[|\]$", "")
    return F.filter(F.transform(F.split(inner, ","), F.trim), lambda x: x != "")


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, title, position, heading, text) of each second-level section."""
    body = F.regexp_replace("text", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "")
    parts = F.split(F.concat(F.lit("\n"), body), r"\n## ")
    rows = docs.select("doc_id", front_matter(F.col("text"), "title").alias("title"), F.posexplode(parts).alias("position", "part")).where("position > 0")
    heading = F.trim(F.substring_index("part", "\n", 1))
    return rows.select("doc_id", "title", "position", heading.alias("heading"), F.trim(F.substr("part", F.length(F.substring_index("part", "\n", 1)) + 1), F.lit(" \n\r\t")).alias("text"))


def chunks(docs: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(chunk_id, doc_id, title, heading, text): sections, split before blank lines and list items where they are too long.

    Blocks are packed in order, so a section's blocks are folded into an array of chunks.
    """
    blocks = F.filter(F.transform(F.split("text", r"\n\s*\n|\n(?=\s*(?:[-*]|\d+\.)\s)"), F.trim), lambda b: b != "")

    def add(held: Column, block: Column) -> Column:
        last = F.element_at(held, -1)
        joined = F.concat(last, F.lit("\n"), block)
        grown = F.concat(F.slice(held, F.lit(1), F.size(held) - 1), F.array(joined))
        return F.when(F.size(held) == 0, F.array(block)).when(estimate_tokens(joined) > max_tokens, F.concat(held, F.array(block))).otherwise(grown)

    split = F.aggregate(blocks, F.array().cast("array<string>"), add)
    parts = F.when(estimate_tokens(F.col("text")) <= max_tokens, F.array("text")).otherwise(split)
    rows = sections(docs).select("doc_id", "title", "heading", F.posexplode(parts).alias("n", "text"))
    suffix = F.when(F.col("n") > 0, F.concat(F.lit("-"), (F.col("n") + 1).cast("string"))).otherwise("")
    return rows.select(F.concat("doc_id", F.lit("#"), slug(F.col("heading")), suffix).alias("chunk_id"), "doc_id", "title", "heading", "text")


def sections_of(rows: DataFrame, wanted: DataFrame, headings: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of the documents that `wanted` (doc_id) names, of some headings only if any are given: a lookup, nothing is ranked."""
    found = rows.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    return found.where(F.lower("heading").isin(*(h.lower() for h in headings))) if headings else found


def links(references: DataFrame) -> DataFrame:
    """(doc_id, rules, metrics) from (kind, name, doc_id): which rules and metrics name a document."""
    named = lambda kind: F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name"))))
    return references.where("doc_id is not null").groupBy("doc_id").agg(named("rule").alias("rules"), named("metric").alias("metrics"))


def missing_documents(references: DataFrame, docs: DataFrame) -> DataFrame:
    """Documents that a rule or metric names and nobody has written."""
    return references.where("doc_id is not null").select("doc_id").distinct().join(docs.select("doc_id"), "doc_id", "left_anti")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(query, query_text, expect, kinds) of an evaluation set in JSON lines; the text is the query's key."""
    rows = spark.read.schema("query string, expect array<string>, kinds array<string>").json(path)
    return rows.where("query is not null").select("query", F.col("query").alias("query_text"), "expect", F.coalesce("kinds", F.array().cast("array<string>")).alias("kinds"))
