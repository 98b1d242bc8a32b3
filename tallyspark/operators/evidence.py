"""Evidence: an index of citable values, references in prose, and figures that lack one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog.items import items_frame
from ..functions import periods
from ..functions.text import FIGURE, REFERENCE, bare_figures, format_value, references
from .report import reference

BRACES = r"\{\{([^{}]*)\}\}"
NUMBER = r"\d[\d,]*(?:\.\d+)?"
#: How many groups and findings a plan and a summary show.
PLAN_GROUPS, SUMMARY_FINDINGS = 5, 3


def index(facts: DataFrame, metrics: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(document_id, ref, display): facts, metrics, then the evidence of rules where neither has the reference."""
    period = F.when(F.col("kind").isNotNull(), periods.label(F.col("kind"), F.col("fiscal_year"), F.col("part")))
    facts = facts.join(F.broadcast(items_frame(facts.sparkSession).select("key", "unit")), "key", "left")
    a = facts.select("document_id", reference(F.lit("f"), F.col("key"), period).alias("ref"), F.coalesce("text", format_value(F.col("value"), F.col("unit"))).alias("display"), F.lit(0).alias("priority"))
    b = metrics.select("document_id", reference(F.lit("m"), F.col("metric"), F.col("period")).alias("ref"), format_value(F.col("value"), F.col("unit")).alias("display"), F.lit(1).alias("priority"))
    c = outcomes.select("document_id", "period", F.explode("evidence").alias("e")).select("document_id", reference(F.lit("x"), F.col("e.name"), F.col("period")).alias("ref"), F.col("e.value").alias("display"), F.lit(2).alias("priority"))
    every = a.unionByName(b).unionByName(c.where("display is not null"))
    return every.groupBy("document_id", "ref").agg(F.min_by("display", "priority").alias("display"))


def resolve(texts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(document_id, text_id, ref, display, ordinal): references in order, each once; an unknown one has no display."""
    each = texts.select("document_id", "text_id", F.posexplode(references(F.col("text"))).alias("ordinal", "ref"))
    first = each.groupBy("document_id", "text_id", "ref").agg(F.min("ordinal").alias("ordinal"))
    return first.join(evidence, ["document_id", "ref"], "left")


def render(texts: DataFrame, evidence: DataFrame) -> DataFrame:
    """`texts` with `rendered`: displays in place of known references; a unit that the display has already, and a figure written out behind its own citation, are dropped."""
    shown = resolve(texts, evidence).where("display is not null").groupBy("document_id", "text_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "ref", "display"))).alias("shown"))

    def put(text: Column, s: Column) -> Column:
        ref = F.concat(F.lit(r"\{\{\s*"), F.regexp_replace(s["ref"], r"([^A-Za-z0-9_:])", r"\\$1"), F.lit(r"\s*\}\}"))
        unit = F.when(s["display"].endswith("days"), r"(?:\s?days?\b)?").when(s["display"].endswith("x"), r"(?:\s?x\b)?").when(s["display"].endswith("%"), r"(?:\s?%)?").when(s["display"].endswith(" cr"), r"(?:\s?(?:crores?|cr)\b)?").otherwise("")
        plain = F.regexp_replace(s["display"], r"([^A-Za-z0-9_ ])", r"\\$1")
        again = F.concat(F.lit(r"(?:\s?"), plain, F.lit(")?"))
        return F.regexp_replace(text, F.concat(ref, unit, again), F.regexp_replace(s["display"], r"([\\$])", r"\\$1"))

    joined = texts.join(shown, ["document_id", "text_id"], "left")
    return joined.withColumn("rendered", F.coalesce(F.aggregate("shown", F.col("text"), put), F.col("text"))).drop("shown")


def normalised(figure: Column) -> Column:
    return F.replace(F.lower(figure), F.lit(" "), F.lit(""))


def check_prose(texts: DataFrame, evidence: DataFrame, allowed: Column | None = None) -> DataFrame:
    """(document_id, text_id, problems): unknown references, other braces, and figures that stand without a citation.

    allowed: array of figures, normalised, that may be written out.
    """
    unknown = resolve(texts, evidence).where("display is null").groupBy("document_id", "text_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("unknown reference "), "ref"))).alias("unknown"))
    braces = F.filter(F.regexp_extract_all("text", F.lit(BRACES), F.lit(1)), lambda t: ~F.trim(t).rlike("^[fmx]:"))
    figures = F.filter(bare_figures(F.col("text")), lambda f: ~F.array_contains(allowed, normalised(f)) if allowed is not None else F.lit(True))
    problems = F.concat(F.coalesce("unknown", F.array().cast("array<string>")), F.transform(braces, lambda t: F.concat(F.lit("no evidence reference: "), t)), F.transform(figures, lambda f: F.concat(F.lit("figure without citation: "), f)))
    return texts.join(unknown, ["document_id", "text_id"], "left").select("document_id", "text_id", problems.alias("problems"))


def figure_key(figure: Column) -> Column:
    """struct(kind, value) of a displayed figure; null without a unit, and for lakh, which is on another scale."""
    low = F.lower(figure)
    number = F.replace(F.regexp_extract(low, f"({NUMBER})", 1), F.lit(","), F.lit("")).try_cast("decimal(24,12)")
    kind = F.when(low.contains("%"), "percent").when(low.contains("day"), "days").when(low.contains("₹") | low.rlike(r"\bcr\b|crore"), "inr").when(F.rtrim(low).endswith("x"), "times")
    negative = F.ltrim(low).rlike(r"^[-(−]") | low.contains("-₹") | low.contains("₹-")
    return F.when(number.isNotNull() & ~low.contains("lakh") & kind.isNotNull(), F.struct(kind.alias("kind"), F.when(negative, -number).otherwise(number).alias("value")))


def link_figures(texts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(document_id, text_id, figure, ref) of the bare figures that exactly one reference displays."""
    figures = texts.select("document_id", "text_id", F.explode(F.array_distinct(bare_figures(F.col("text")))).alias("figure")).withColumn("k", figure_key(F.col("figure"))).where("k is not null")
    shown = evidence.withColumn("k", figure_key(F.col("display"))).where("k is not null")
    found = figures.join(shown, ["document_id", "k"]).groupBy("document_id", "text_id", "figure").agg(F.count("*").alias("n"), F.min("ref").alias("ref"))
    return found.where("n = 1").drop("n")


def linked(texts: DataFrame, evidence: DataFrame, preferred: DataFrame | None = None, scope: DataFrame | None = None, skip: Column | None = None) -> DataFrame:
    """`texts` with `linked`: bare figures in prose give way to the one reference that displays them.

    scope: (document_id, ref) that may be cited at all; preferred: (document_id, ref) that come first where several display a figure; skip: array of
    figures, normalised, that stay. References that stand already are kept as they are.
    """
    shown = evidence.join(scope, ["document_id", "ref"], "left_semi") if scope is not None else evidence
    first = preferred.select("document_id", "ref", F.lit(1).alias("_first")) if preferred is not None else None
    shown = shown.join(first, ["document_id", "ref"], "left") if first is not None else shown.withColumn("_first", F.lit(None).cast("int"))
    shown = shown.withColumn("k", figure_key(F.col("display"))).where("k is not null").groupBy("document_id", "k").agg(F.collect_set(F.when(F.col("_first") == 1, F.col("ref"))).alias("_preferred"), F.collect_set("ref").alias("_every"))
    one = F.when(F.size("_preferred") > 0, F.when(F.size("_preferred") == 1, F.get("_preferred", F.lit(0)))).when(F.size("_every") == 1, F.get("_every", F.lit(0)))
    figures = texts.select("document_id", "text_id", F.explode(F.array_distinct(F.regexp_extract_all(F.regexp_replace("text", REFERENCE, ""), F.lit(f"({FIGURE})"), F.lit(1)))).alias("figure"))
    figures = figures.where(~F.array_contains(skip, normalised(F.col("figure")))) if skip is not None else figures
    found = figures.withColumn("k", figure_key(F.col("figure"))).join(shown.withColumn("ref", one).where("ref is not null"), ["document_id", "k"])
    pairs = found.groupBy("document_id", "text_id").agg(F.map_from_entries(F.collect_list(F.struct("figure", "ref"))).alias("_refs"))
    # The text in pieces: references and figures, each behind what stands before it.
    piece = rf"(?s)(.*?)(\{{\{{[^{{}}]*\}}\}}|{FIGURE.removeprefix('(?i)')}|\z)"
    parts = F.arrays_zip(*(F.regexp_extract_all("text", F.lit(f"(?i){piece}"), F.lit(g)).alias(n) for g, n in ((1, "before"), (2, "token"))))
    put = F.transform(parts, lambda p: F.concat(p["before"], F.coalesce(F.concat(F.lit("{{"), F.get(F.array(F.col("_refs")[p["token"]]), F.lit(0)), F.lit("}}")), p["token"])))
    return texts.join(pairs, ["document_id", "text_id"], "left").withColumn("linked", F.when(F.col("_refs").isNull(), F.col("text")).otherwise(F.array_join(put, ""))).drop("_refs")


def uncovered(fired: DataFrame, covered: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Fired rules that no finding covers and none has dismissed."""
    keys = ["document_id", "rule_id"]
    return fired.join(covered.select(*keys), keys, "left_anti").join(dismissed.select(*keys), keys, "left_anti")


def plan(fired: DataFrame, theme: str = "category") -> DataFrame:
    """(document_id, position, theme, rule_ids): fired rules by theme, in the order in which the themes first appear, the first five."""
    order = F.struct((-F.col("severity_rank")).alias("severity"), "rule_id")
    groups = fired.groupBy("document_id", theme).agg(F.min(order).alias("first"), F.array_sort(F.collect_list(order))["rule_id"].alias("rule_ids"))
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy("first"))
    return groups.withColumn("position", rank).where(F.col("position") <= PLAN_GROUPS).select("document_id", "position", theme, "rule_ids")


def summary(findings: DataFrame) -> DataFrame:
    """(document_id, headline, summary) from the ordered findings (document_id, position, title, summary)."""
    ordered = F.array_sort(F.collect_list(F.struct("position", "title", "summary")))
    found = findings.groupBy("document_id").agg(F.count("*").alias("n"), ordered.alias("f"))
    headline = F.concat(F.col("n").cast("string"), F.lit(" findings; most severe: "), F.lower(F.col("f")[0]["title"]))
    return found.select("document_id", headline.alias("headline"), F.array_join(F.slice("f", 1, SUMMARY_FINDINGS)["summary"], " ").alias("summary"))


def accepted(drafts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Drafts that no verdict rejects; those without one stay."""
    return drafts.join(verdicts.select("draft_id", "decision"), "draft_id", "left").where("decision is null or decision <> 'reject'").drop("decision")
