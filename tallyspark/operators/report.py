"""Report tables from outcomes: scorecard, overall risk, gaps, integrity, metric tables, fact sheet lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog.items import items_frame
from ..catalog.rules import SEVERITIES
from ..functions.text import format_value

FIRED, PASSED, INSUFFICIENT = "fired", "passed", "insufficient_data"
HIGH = SEVERITIES.index("high")


def scorecard(latest: DataFrame, by: tuple[str, ...] = ("document_id", "pack")) -> DataFrame:
    """Counts of outcomes by group, with the worst severity that fired."""
    fired = F.col("outcome") == FIRED
    return latest.groupBy(*by).agg(*(F.count_if(F.col("outcome") == o).alias(o) for o in (FIRED, PASSED, INSUFFICIENT)), F.max(F.when(fired, F.col("severity_rank"))).alias("worst_rank"))


def risk(ranks: str = "severity_rank") -> Column:
    """Overall risk of a group of fired findings."""
    rank = F.col(ranks)
    worst, high = F.max(rank), F.count_if(rank == HIGH)
    return F.when((worst > HIGH) | (high >= 3), "high").when(high >= 1, "elevated").when(worst == SEVERITIES.index("medium"), "moderate").otherwise("low")


def overall_risk(latest: DataFrame) -> DataFrame:
    """(document_id, risk) of the rules that fired outside the integrity pack; low where none did."""
    found = latest.where((F.col("outcome") == FIRED) & (F.col("pack") != "integrity")).groupBy("document_id").agg(risk().alias("risk"))
    return latest.select("document_id").distinct().join(found, "document_id", "left").select("document_id", F.coalesce("risk", F.lit("low")).alias("risk"))


def data_gaps(latest: DataFrame, first: int | None = 4) -> DataFrame:
    """Missing inputs by rule that lacks data, at most `first` each as a report shows them."""
    gaps = latest.where(F.col("outcome") == INSUFFICIENT)
    missing = F.slice("missing", 1, first) if first else F.col("missing")
    return gaps.select("document_id", "rule_id", missing.alias("missing"))


def missing_inputs(latest: DataFrame) -> DataFrame:
    """Distinct missing inputs of each document, sorted."""
    each = latest.where(F.col("outcome") == INSUFFICIENT).select("document_id", F.explode("missing").alias("name"))
    return each.groupBy("document_id").agg(F.array_sort(F.collect_set("name")).alias("missing"))


def integrity(latest: DataFrame) -> DataFrame:
    return latest.where("pack = 'integrity'").groupBy("document_id").agg(F.count_if(F.col("outcome") == PASSED).alias("passed"), F.count_if(F.col("outcome") == FIRED).alias("failed"))


def metric_table(metrics: DataFrame) -> DataFrame:
    """Headline metrics as a map from period to display."""
    shown = metrics.where("headline and period is not null").withColumn("display", format_value(F.col("value"), F.col("unit")))
    entries = F.array_sort(F.collect_list(F.struct("end_date", "period", "display")))
    return shown.groupBy("document_id", "metric").agg(F.map_from_entries(F.transform(entries, lambda e: F.struct(e["period"], e["display"]))).alias("values"))


def reference(kind: Column, key: Column, period: Column) -> Column:
    """f:key@period; without the period for what belongs to the document."""
    return F.concat(kind, F.lit(":"), key, F.coalesce(F.concat(F.lit("@"), period), F.lit("")))


def ordered_findings(latest: DataFrame) -> DataFrame:
    return latest.orderBy(F.desc(F.col("outcome") == FIRED), F.desc("severity_rank"), "rule_id")


def label_of(key: Column) -> Column:
    """Words of an item's or metric's key, the first with a capital."""
    words = F.replace(key, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))


def describe_missing(ref: Column) -> Column:
    """A missing fact as "Label (period)"; what is no fact stays as it is."""
    key, period = F.split_part(F.substr(ref, F.lit(3)), F.lit("@"), F.lit(1)), F.split_part(ref, F.lit("@"), F.lit(2))
    return F.when(ref.startswith("f:"), F.concat(label_of(key), F.when(period != "", F.concat(F.lit(" ("), period, F.lit(")"))).otherwise(""))).otherwise(ref)


def fact_sheet(latest: DataFrame, metrics: DataFrame, documents: DataFrame | None = None, anomalies: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """(document_id, sheet): sections of lines, apart by blank lines: header, integrity, findings, anomalies, metrics, document facts and gaps.

    documents: (document_id, company, sector, doc_type); anomalies as `engine.ordered` gives them; facts: of which those without a period are shown.
    """
    line = lambda rows, text, section, order: rows.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("line")))), lambda x: x["line"]), "\n").alias(section))
    ok = integrity(latest).select("document_id", F.concat_ws(" ", F.lit("Integrity:"), "passed", F.lit("passed,"), "failed", F.lit("failed")).alias("a"))
    fired = latest.where(F.col("outcome") == FIRED)
    findings = line(fired, F.concat_ws(" ", F.lit("-"), "severity", "rule_id", F.coalesce("period", F.lit(""))), "b", [(-F.col("severity_rank")).alias("o"), F.col("rule_id")])
    shown = metrics.where("headline and is_anchor")
    table = line(shown, F.concat_ws(" ", F.lit("-"), "metric", format_value(F.col("value"), F.col("unit"))), "c", [F.col("metric").alias("o")])
    gaps = line(latest.where(F.col("outcome") == INSUFFICIENT), F.concat(F.lit("- "), F.col("rule_id"), F.lit(": "), F.array_join("missing", ", ")), "d", [F.col("rule_id").alias("o")])
    sections = {"a": ok, "b": findings, "c": table, "d": gaps}
    if documents is not None:
        at = latest.groupBy("document_id").agg(F.max_by("period", "severity_rank").alias("_period"), F.count("*").alias("_rules"))
        head = documents.join(at, "document_id", "left")
        sections["0"] = head.select("document_id", F.concat_ws("\n", F.concat_ws(" | ", F.concat(F.lit("Company: "), "company"), F.concat(F.lit("sector "), "sector"), "doc_type"), F.concat(F.lit("Rules: "), F.col("_rules").cast("string"), F.lit(" apply"))).alias("0"))
    if anomalies is not None:
        text = F.concat_ws(" ", F.lit("-"), "metric", "period", "direction", F.concat(F.lit("against its "), "basis"), F.when(F.col("adverse"), "(adverse)").otherwise(""))
        sections["b2"] = line(anomalies, F.rtrim(text), "b2", [F.col("position").alias("o")])
    if facts is not None:
        units = F.broadcast(items_frame(facts.sparkSession).select("key", "unit"))
        own = facts.where("kind is null").join(units, "key", "left")
        sections["c2"] = line(own, F.concat_ws(" ", F.lit("-"), label_of(F.col("key")), F.coalesce("text", format_value(F.col("value"), F.col("unit")))), "c2", [F.col("key").alias("o")])
    every = latest.select("document_id").distinct()
    for part in sections.values():
        every = every.join(part, "document_id", "left")
    return every.select("document_id", F.concat_ws("\n\n", *(f"`{k}`" for k in sorted(sections))).alias("sheet"))


#: Confidence of a finding that only a threshold backs.
RULE_CONFIDENCE = 0.6
CONCERNS = 4


def findings(latest: DataFrame, reliability: DataFrame | None = None, titles: DataFrame | None = None) -> DataFrame:
    """One finding for each fired rule: its evidence cited as references, its earlier firings named.

    reliability: (rule_id, score), the confidence where known; titles: (rule_id, title, rationale), else the id stands for both.
    """
    fired = latest.where(F.col("outcome") == FIRED)
    for extra, columns in ((reliability, ("score",)), (titles, ("title", "rationale"))):
        fired = fired.join(extra.select("rule_id", *columns), "rule_id", "left") if extra is not None else fired.withColumns({c: F.lit(None).cast("double" if c == "score" else "string") for c in columns})
    title, at = F.coalesce("title", "rule_id"), F.coalesce(F.concat(F.lit(" ("), "period", F.lit(")")), F.lit(""))
    name = lambda e: reference(F.lit("x"), e["name"], F.col("period"))
    cited = F.array_join(F.transform(F.filter("evidence", lambda e: e["value"].isNotNull()), lambda e: F.concat(e["name"], F.lit(" {{"), name(e), F.lit("}}"))), "; ")
    earlier = F.array_distinct(F.filter("fired_periods", lambda p: p.isNotNull() & ~p.eqNullSafe(F.col("period"))))
    again = F.when(F.size(earlier) > 0, F.concat(F.lit(" The rule also fired in "), F.array_join(earlier, ", "), F.lit("."))).otherwise("")
    return fired.select(
        "document_id", F.concat(F.lit("R-"), "rule_id").alias("finding_id"), F.lit("rule").alias("origin"), F.array("rule_id").alias("rule_ids"), title.alias("title"), "pack", "severity", "severity_rank",
        F.coalesce("score", F.lit(RULE_CONFIDENCE)).alias("confidence"), F.concat(title, at, F.when(cited != "", F.concat(F.lit(": "), cited)).otherwise(""), F.lit(".")).alias("summary"),
        F.concat(F.coalesce("rationale", F.lit("")), again).alias("analysis"), "fired_periods",
    )


def in_order(found: DataFrame) -> DataFrame:
    """`found` with `position` in its document: severest first, an agent's before a rule's, then by confidence and id."""
    order = Window.partitionBy("document_id").orderBy(F.desc("severity_rank"), F.col("origin") != "agent", F.desc("confidence"), "finding_id")
    return found.withColumn("position", F.row_number().over(order))


def assembled(latest: DataFrame, found: DataFrame) -> DataFrame:
    """One report for each document of `latest`: risk, concerns, findings in order, scorecard, integrity counts and gaps, nested."""
    ordered = in_order(found)
    part = ordered.groupBy("document_id").agg(risk().alias("risk"), F.array_sort(F.collect_list(F.struct("position", "finding_id", "title", "severity", "confidence", "summary", "analysis", "rule_ids"))).alias("findings"))
    part = part.withColumn("concerns", F.slice(F.col("findings")["title"], 1, CONCERNS))
    nested = lambda df, name: df.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(*(c for c in df.columns if c != "document_id")))).alias(name))
    every = latest.select("document_id").distinct()
    for df in (part, nested(scorecard(latest), "scorecard"), integrity(latest).select("document_id", F.struct("passed", "failed").alias("integrity")), nested(data_gaps(latest), "gaps")):
        every = every.join(df, "document_id", "left")
    return every.withColumn("risk", F.coalesce("risk", F.lit("low")))


def metric_history(metrics: DataFrame, key: str) -> DataFrame:
    """(document_id, history): a metric's reported periods in order, each with its reference and display."""
    rows = metrics.where(F.col("metric") == key)
    line = F.struct("end_date", reference(F.lit("m"), F.col("metric"), F.col("period")).alias("ref"), format_value(F.col("value"), F.col("unit")).alias("display"))
    return rows.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.struct(x["ref"].alias("ref"), x["display"].alias("display"))).alias("history"))


def rule_history(outcomes: DataFrame) -> DataFrame:
    """(document_id, rule_id, history): every outcome of a rule in order, with its period."""
    line = F.struct("end_date", "is_anchor", "period", "outcome")
    return outcomes.groupBy("document_id", "rule_id").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: F.struct(x["period"].alias("period"), x["outcome"].alias("outcome"))).alias("history"))
