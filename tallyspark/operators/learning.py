"""Learning from feedback: latest verdicts, reliability of rules, boosts of chunks, backtests."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog.rules import Rule
from . import engine
from . import facts as facts_

# Pseudo-counts of the prior, steps and bounds of a boost.
PRIOR_CONFIRMS, PRIOR_ALL = 3, 5
BOOST_CONFIRM, BOOST_DISMISS, BOOST_LOW, BOOST_HIGH = 0.2, 0.1, -0.5, 1.0


def latest_verdicts(feedback: DataFrame, keys: tuple[str, ...] = ("analysis_id", "finding_id"), order: tuple[str, ...] = ("created_at", "id")) -> DataFrame:
    """The last verdict of each finding; equal times are settled by the id."""
    return feedback.groupBy(*keys).agg(F.max_by("verdict", F.struct(*order)).alias("verdict"))


def _counts() -> tuple[Column, Column]:
    return F.count_if(F.col("verdict") == "confirm").alias("confirms"), F.count_if(F.col("verdict") == "dismiss").alias("dismisses")


def reliability(confirms: Column, dismisses: Column) -> Column:
    """Mean of the posterior."""
    return (PRIOR_CONFIRMS + confirms) / (PRIOR_ALL + confirms + dismisses)


def rule_reliability(feedback: DataFrame, findings: DataFrame) -> DataFrame:
    """(rule_id, confirms, dismisses, score): each finding's last verdict goes to all its rules."""
    each = latest_verdicts(feedback).join(findings, ["analysis_id", "finding_id"]).select("verdict", F.explode(F.array_distinct("rule_ids")).alias("rule_id"))
    found = each.groupBy("rule_id").agg(*_counts())
    return found.withColumn("score", reliability(F.col("confirms"), F.col("dismisses")))


def boost(confirms: Column, dismisses: Column) -> Column:
    return F.least(F.lit(BOOST_HIGH), F.greatest(F.lit(BOOST_LOW), BOOST_CONFIRM * confirms - BOOST_DISMISS * dismisses))


def chunk_boosts(feedback: DataFrame, findings: DataFrame) -> DataFrame:
    """(chunk, boost): of the chunks that judged findings cite."""
    each = latest_verdicts(feedback).join(findings, ["analysis_id", "finding_id"]).select("verdict", F.explode(F.array_distinct("chunk_ids")).alias("chunk"))
    found = each.groupBy("chunk").agg(*_counts())
    return found.select("chunk", boost(F.col("confirms"), F.col("dismisses")).alias("boost"))


def in_order(reliability: DataFrame) -> DataFrame:
    """Rules by how often they were judged, then by id."""
    return reliability.orderBy(F.desc(F.col("confirms") + F.col("dismisses")), "rule_id")


def run_candidate(facts: DataFrame, documents: DataFrame, rule: Rule) -> DataFrame:
    """`backtest` of one candidate rule over all stored documents in one plan, with the fixed bounds in place of cohorts."""
    kept, _ = facts_.validate(facts)
    grid = engine.with_cohort_bounds(engine.with_metrics(facts_.grid(kept, documents)))
    return backtest(engine.latest(engine.rule_outcomes(grid, {rule.id: replace(rule, status="active")})))


def backtest(latest_outcomes: DataFrame) -> DataFrame:
    """Of a candidate rule's latest outcomes over all documents: how many fired, passed, and lacked data."""
    return latest_outcomes.groupBy("rule_id").agg(F.count("*").alias("documents"), *(F.count_if(F.col("outcome") == o).alias(o) for o in ("fired", "passed", "insufficient_data")))
