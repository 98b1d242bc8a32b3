"""What an assistant may ask of stored results: parameterised queries over tables, answers as text.

Tables (any frames, as `engine.analyse`, `report` and `knowledge` give them, or what was stored of them) are given by name; a question's words reach SQL as
arguments only, never as text of the statement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import retrieval

# Characters of a section that is shown, hits and tokens of a search.
SECTION_CHARS, HITS, TOKENS = 900, 3, 700


def _listed(names: list[str]) -> Column:
    """A list as an argument; an empty one holds a name that nothing has."""
    return F.array(*map(F.lit, names or [""]))


def rule_detail(spark: SparkSession, outcomes: DataFrame, rules: DataFrame, document_id: str, rule_id: str) -> DataFrame:
    """(detail): a rule's title and rationale and all its outcomes in order with their evidence.

    outcomes: (document_id, rule_id, period, end_date, is_anchor, outcome, evidence as name and value); rules: (rule_id, title, rationale). One row; for a rule that was not
    evaluated it says so.
    """
    return spark.sql(
        """
        WITH own AS (SELECT * FROM {outcomes} WHERE document_id = :document AND rule_id = trim(:rule)),
        lines AS (
          SELECT end_date, is_anchor, concat('- ', coalesce(period, 'document'), ': ', outcome,
            coalesce(concat(' | ', nullif(array_join(transform(filter(evidence, e -> e.value IS NOT NULL), e -> concat(e.name, ' = ', e.value)), '; '), '')), '')) AS line FROM own),
        told AS (SELECT array_join(transform(array_sort(collect_list(struct(end_date, is_anchor, line))), x -> x.line), '\n') AS history, count(*) AS n FROM lines)
        SELECT CASE WHEN n = 0 THEN concat('rule_detail(', trim(:rule), '): no such rule evaluated for this document')
          ELSE concat('rule_detail(', trim(:rule), '): ', coalesce(r.title, trim(:rule)), coalesce(concat(' - ', r.rationale), ''), '\n', history) END AS detail
        FROM told LEFT JOIN (SELECT rule_id, max(title) AS title, max(rationale) AS rationale FROM {rules} WHERE rule_id = trim(:rule) GROUP BY rule_id) r ON true
        """,
        args={"document": document_id, "rule": rule_id}, outcomes=outcomes, rules=rules,
    )


def rule_block(spark: SparkSession, outcomes: DataFrame, rules: DataFrame, document_id: str, rule_ids: list[str]) -> DataFrame:
    """(rule_id, block) of those of the rules whose last outcome fired: severity, title, last evidence, history and rationale."""
    return spark.sql(
        """
        WITH own AS (SELECT * FROM {outcomes} WHERE document_id = :document AND array_contains(:rules, rule_id)),
        each AS (
          SELECT rule_id, max_by(struct(outcome, severity, period, evidence), struct(end_date, is_anchor)) AS last,
            array_join(transform(array_sort(collect_list(struct(end_date, is_anchor, period, outcome))), x -> concat(coalesce(x.period, 'document'), ' ', x.outcome)), ', ') AS history FROM own GROUP BY rule_id)
        SELECT e.rule_id, concat(e.rule_id, ' [', upper(last.severity), '] ', coalesce(r.title, e.rule_id), '\n  evidence (', coalesce(last.period, 'document'), '): ',
          array_join(transform(filter(last.evidence, v -> v.value IS NOT NULL), v -> concat(v.name, ' = ', v.value)), '; '), '\n  history: ', history, coalesce(concat('\n  rationale: ', r.rationale), '')) AS block
        FROM each e LEFT JOIN {rules} r ON r.rule_id = e.rule_id WHERE last.outcome = 'fired'
        """,
        args={"document": document_id, "rules": _listed(rule_ids)}, outcomes=outcomes, rules=rules,
    )


def knowledge_sections(spark: SparkSession, chunks: DataFrame, doc_ids: list[str], headings: list[str] | None = None) -> DataFrame:
    """(block) of the chunks of these documents (of some headings only, if any are given), in the order of the documents asked for; long texts are cut for display.

    chunks: (chunk_id, doc_id, title, heading, text).
    """
    wanted = list(dict.fromkeys(doc_ids))
    return spark.sql(
        f"""
        SELECT concat('[kb:', chunk_id, '] ', title, ' - ', heading, '\n', CASE WHEN length(text) <= {SECTION_CHARS} THEN text ELSE concat(left(text, {SECTION_CHARS}), ' ...') END) AS block
        FROM {{chunks}} WHERE array_contains(:docs, doc_id) AND (:every OR array_contains(:headings, lower(heading))) ORDER BY array_position(:docs, doc_id), chunk_id
        """,
        args={"docs": _listed(wanted), "headings": _listed([h.lower() for h in headings or []]), "every": not headings}, chunks=chunks,
    )


def knowledge_search(spark: SparkSession, chunks: DataFrame, queries: DataFrame, boosts: DataFrame | None = None, k: int = HITS, budget: int = TOKENS) -> DataFrame:
    """(query, answer): the first hits of each query in `queries` (query, query_text) within a budget of tokens, or that there are none.

    chunks: (chunk_id, title, heading, text); boosts: (chunk, boost). All queries are answered in one plan.
    """
    found = retrieval.bm25_search(queries, chunks, headings=("title", "heading"))
    hits = retrieval.ranked(retrieval.boosted(found, boosts) if boosts is not None else found, k)
    shown = chunks.select(F.col("chunk_id").alias("chunk"), "title", "heading", "text")
    kept = retrieval.pack(hits.join(shown, "chunk"), budget)
    line = F.concat(F.lit("[kb:"), F.col("chunk").cast("string"), F.lit("] "), F.concat_ws(" - ", "title", "heading"), F.lit("\n"), "text")
    answers = kept.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    told = F.concat(F.lit("knowledge_search("), "query_text", F.lit("):\n"), F.array_join("lines", "\n\n"))
    return queries.join(answers, "query", "left").select("query", F.when(F.col("lines").isNull(), F.lit("no matches")).otherwise(told).alias("answer"))
