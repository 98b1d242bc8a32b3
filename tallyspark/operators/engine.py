"""Metrics, rules, cohorts and anomalies over the grid, for all documents in one plan."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog.items import DAYS, DOCUMENT, PERIOD, RATIO, TIMES
from ..catalog.metrics import METRICS, Metric, Terms, levels
from ..catalog.rules import COHORT_BOUNDS, RULES, SEVERITIES, Rule
from ..functions import periods, provenance, statistics
from ..functions.timeseries import AMOUNT, Grid, amount
from . import facts as facts_
from .lineage import written

_RESULTS = "array<struct<applies:boolean,rule_id:string,pack:string,scope:string,outcome:string,severity_rank:int,missing:array<string>,evidence:array<struct<name:string,value:string>>>>"
FIRED, PASSED, INSUFFICIENT = "fired", "passed", "insufficient_data"


def severity_rank(severity: str) -> int:
    return SEVERITIES.index(severity)


def severity_name(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, SEVERITIES)), rank)


def _guarded(m: Metric, terms: Terms) -> Column:
    value = m.formula(terms).try_cast(AMOUNT)
    if m.scope == DOCUMENT:
        value = F.max(F.when(F.col("is_anchor"), value)).over(Window.partitionBy("document_id"))
    return F.when(~F.col("sector").isin(*sorted(m.exclude)), value) if m.exclude else value


def with_metrics(grid: DataFrame) -> DataFrame:
    """The grid with every metric as a column, level by level; null where a metric does not suit the sector."""
    terms = Terms(Grid())
    for level in levels():
        grid = grid.withColumns({m.key: _guarded(m, terms) for m in level})
    revenue = F.max(F.when(F.col("is_anchor"), F.col("revenue_from_operations"))).over(Window.partitionBy("document_id"))
    days = F.max(F.when(F.col("is_anchor"), F.col("days"))).over(Window.partitionBy("document_id"))
    return grid.withColumn("size_bucket", facts_.size_bucket(revenue, days))


def metric_rows(grid: DataFrame) -> DataFrame:
    """Long metrics (document_id, metric, period, value, ...) of observed periods, without missing ones; document metrics once."""
    each = F.array(*(F.struct(F.lit(m.key).alias("metric"), F.lit(m.scope).alias("scope"), F.lit(m.unit).alias("unit"), F.lit(m.better).alias("better"), F.lit(m.headline).alias("headline"), F.col(m.key).alias("value")) for m in METRICS.values()))
    rows = grid.where("observed").select("document_id", "sector", "size_bucket", "kind", "fiscal_year", "part", "end_date", "days", "is_anchor", F.explode(each).alias("_metric")).select("*", "_metric.*").drop("_metric")
    label = periods.label(F.col("kind"), F.col("fiscal_year"), F.col("part"))
    rows = rows.where((F.col("scope") == PERIOD) | F.col("is_anchor")).where("value is not null")
    return rows.withColumn("period", F.when(F.col("scope") == PERIOD, label))


def baselines(metrics: DataFrame) -> DataFrame:
    """Samples of cohorts: (metric, sector, size_bucket, kind, value, document_id) of documents that have a size."""
    return metrics.where((F.col("scope") == PERIOD) & F.col("size_bucket").isNotNull()).select("metric", "sector", "size_bucket", "kind", "value", "document_id")


def with_cohort_bounds(grid: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Adds ``cohort_p90_*``: the percentile of the peers' values without the document's own, from 8 values on, else the fixed bound."""
    names = {metric: f"cohort_p{p}_{metric}" for metric, (p, _) in COHORT_BOUNDS.items()}
    fixed = {names[m]: F.lit(fallback).cast(AMOUNT) for m, (_, fallback) in COHORT_BOUNDS.items()}
    if samples is None:
        return grid.withColumns(fixed)
    keys = ["sector", "size_bucket", "kind"]
    units, found = grid.select("document_id", *keys).distinct(), None
    for p in sorted({p for p, _ in COHORT_BOUNDS.values()}):
        own = [m for m, (q, _) in COHORT_BOUNDS.items() if q == p]
        each = units.withColumn("metric", F.explode(F.array(*map(F.lit, own))))
        part = statistics.peer_percentile(each, samples.where(F.col("metric").isin(own)), [*keys, "metric"], "document_id", "value", p).where(F.col("n") >= statistics.TRUSTED_COHORT)
        found = part if found is None else found.unionByName(part)
    # One narrow row for each document and kind, so that the wide grid is joined once.
    wide = found.groupBy("document_id", *keys).agg(*(F.max(F.when(F.col("metric") == m, amount(F.col("percentile")))).alias(n) for m, n in names.items()))
    return grid.join(wide, ["document_id", *keys], "left").withColumns({n: F.coalesce(F.col(n), v) for n, v in fixed.items()})


def sound_rules(grid: DataFrame, rules: dict[str, Rule] = RULES) -> tuple[dict[str, Rule], dict[str, str]]:
    """(rules whose conditions the grid can answer, reason by id of the others): one that reads an unknown column or has a type that does not fit is left out alone.

    Only plans are analysed, over a frame of the grid's schema without rows; all rules at once, and one by one only where that fails.
    """
    bare, terms = grid.sparkSession.createDataFrame([], grid.schema), Terms(Grid())

    def told(some: dict[str, Rule]) -> str | None:
        try:
            conditions = [c(terms) for r in some.values() for c in (r.when, *(e for e, _ in r.escalate))]
            needs = sorted({n for r in some.values() for n in r.needs})
            fields = bare.select(*(c.alias(f"_{k}") for k, c in enumerate(conditions)), *needs).schema[: len(conditions)]
            kinds = {f.dataType.simpleString() for f in fields} - {"boolean", "void"}
            return f"a condition is {', '.join(sorted(kinds))}" if kinds else None
        except AnalysisException as found:
            return str(found).splitlines()[0]

    if told(rules) is None:
        return dict(rules), {}
    reasons = {key: told({key: r}) for key, r in rules.items()}
    return {k: r for k, r in rules.items() if reasons[k] is None}, {k: v for k, v in reasons.items() if v is not None}


def rule_outcomes(grid: DataFrame, rules: dict[str, Rule] = RULES, packs: tuple[str, ...] | None = None) -> DataFrame:
    """One row for each document, rule and period it applies to: outcome, severity, evidence, missing.

    Unknown conditions are insufficient data, with the needed columns that are null. A severity is
    the highest of the base and the escalations that hold.
    """
    active = [r for r in rules.values() if r.status == "active" and (packs is None or r.pack in packs)]
    by_pack: dict[str, list[Rule]] = {}
    for r in active:
        by_pack.setdefault(r.pack, []).append(r)
    found = None
    for own in by_pack.values():
        rows = _pack_outcomes(grid, own)
        found = rows if found is None else found.unionByName(rows)
    return _pack_outcomes(grid, []) if found is None else found


def _applies(r: Rule) -> Column:
    """Whether a row is of a document and period that the rule is for."""
    kinds = F.col("is_anchor") if r.scope == DOCUMENT else F.col("kind").isin(*r.kinds)
    applies = F.col("doc_type").isin(*r.applies_to) & kinds
    return applies & ~F.col("sector").isin(*sorted(r.exclude)) if r.exclude else applies


def _pack_outcomes(grid: DataFrame, active: list[Rule]) -> DataFrame:
    """The outcomes of some rules; of a written grid only the columns that they need are read."""
    terms = Terms(Grid())
    conditions = {f"_when_{k}": r.when(terms) for k, r in enumerate(active)}
    conditions |= {f"_escalate_{k}_{j}": c(terms) for k, r in enumerate(active) for j, (c, _) in enumerate(r.escalate)}
    grid = grid.withColumns(conditions) if conditions else grid

    def result(k: int, r: Rule) -> Column:
        fired = F.col(f"_when_{k}")
        steps = [F.when(F.col(f"_escalate_{k}_{j}"), severity_rank(s)).otherwise(severity_rank(r.severity)) for j, (_, s) in enumerate(r.escalate)]
        base = F.lit(severity_rank(r.severity))
        return F.struct(
            _applies(r).alias("applies"), F.lit(r.id).alias("rule_id"), F.lit(r.pack).alias("pack"), F.lit(r.scope).alias("scope"),
            F.when(fired, FIRED).when(~fired, PASSED).otherwise(INSUFFICIENT).alias("outcome"),
            (F.greatest(base, *steps) if steps else base).alias("severity_rank"),
            F.when(fired.isNull(), F.array_sort(F.filter(F.array(*(F.when(F.col(n).isNull(), F.lit(n)) for n in r.needs)), lambda x: x.isNotNull()))).otherwise(F.array().cast("array<string>")).alias("missing"),
            F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).cast("string").alias("value")) for n in r.needs)).cast("array<struct<name:string,value:string>>").alias("evidence"),
        )

    each = F.array(*(result(k, r) for k, r in enumerate(active))).cast(_RESULTS)
    rows = grid.where("observed").select("document_id", "kind", "fiscal_year", "part", "end_date", "is_anchor", F.explode(F.filter(each, lambda x: x["applies"])).alias("_rule")).select("*", "_rule.*").drop("_rule", "applies")
    label = periods.label(F.col("kind"), F.col("fiscal_year"), F.col("part"))
    return rows.withColumn("period", F.when(F.col("scope") == PERIOD, label)).withColumn("severity", severity_name(F.col("severity_rank")))


def with_provenance(grid: DataFrame) -> DataFrame:
    """The grid of `with_metrics` with ``missing_``, ``inputs_`` and ``notes_`` of every metric: the facts and reasons that it lacks, what it has read, remarks in their order.

    A metric's arrays hold those of the metrics below it, so they are added level by level; arrays of another period come from its row.
    """
    terms, empty = provenance.TracedTerms(Grid()), provenance.none()
    for level in levels():
        added = {}
        for m in level:
            found = m.formula(terms)
            arrays = {"missing": F.when(F.col(m.key).isNull(), provenance.union(found.missing)).otherwise(empty), "inputs": provenance.union(found.inputs), "notes": provenance.union(found.notes)}
            for name, array in arrays.items():
                if m.scope == DOCUMENT:
                    array = F.coalesce(F.max(F.when(F.col("is_anchor"), array)).over(Window.partitionBy("document_id")), empty)
                if m.exclude:
                    unfit = F.array(F.concat(F.lit(f"{m.key} is not meaningful for "), "sector", F.lit(" companies"))) if name == "missing" else empty
                    array = F.when(F.col("sector").isin(*sorted(m.exclude)), unfit).otherwise(array)
                added[f"{name}_{m.key}"] = array
        grid = grid.withColumns(added)
    return grid


def metric_provenance(grid: DataFrame) -> DataFrame:
    """(document_id, metric, kind, fiscal_year, part, missing, inputs, notes) of every metric in observed periods, missing ones too; document metrics at the anchor."""
    sorted_ = lambda c: F.array_sort(F.col(c))
    each = F.array(*(F.struct(F.lit(m.key).alias("metric"), F.lit(m.scope).alias("scope"), F.col(m.key).alias("value"), sorted_(f"missing_{m.key}").alias("missing"), sorted_(f"inputs_{m.key}").alias("inputs"), F.col(f"notes_{m.key}").alias("notes")) for m in METRICS.values()))
    rows = grid.where("observed").select("document_id", "kind", "fiscal_year", "part", "is_anchor", F.explode(each).alias("_m")).select("*", "_m.*").drop("_m")
    return rows.where((F.col("scope") == PERIOD) | F.col("is_anchor")).drop("is_anchor", "scope")


def rule_provenance(grid: DataFrame, rules: dict[str, Rule] = RULES) -> DataFrame:
    """(document_id, rule_id, kind, fiscal_year, part, end_date, missing, inputs, notes) of the outcomes of `rule_outcomes`: what an insufficient one lacks, down to facts.

    grid: of `with_provenance`, with cohort bounds.
    """
    terms, found, by_pack = provenance.TracedTerms(Grid()), None, {}
    for r in rules.values():
        if r.status == "active":
            by_pack.setdefault(r.pack, []).append(r)
    for own in by_pack.values():
        traced = {r.id: r.when(terms) for r in own}
        added = {f"_{name}_{k}": provenance.union(getattr(traced[r.id], name)) for k, r in enumerate(own) for name in ("missing", "inputs", "notes")}
        added |= {f"_when_{k}": traced[r.id].value for k, r in enumerate(own)}

        def told(k: int, r: Rule) -> Column:
            missing = F.when(F.col(f"_when_{k}").isNull(), F.array_sort(F.col(f"_missing_{k}"))).otherwise(provenance.none())
            return F.struct(_applies(r).alias("applies"), F.lit(r.id).alias("rule_id"), missing.alias("missing"), F.array_sort(F.col(f"_inputs_{k}")).alias("inputs"), F.col(f"_notes_{k}").alias("notes"))

        each = F.filter(F.array(*(told(k, r) for k, r in enumerate(own))), lambda x: x["applies"])
        rows = grid.withColumns(added).where("observed").select("document_id", "kind", "fiscal_year", "part", "end_date", F.explode(each).alias("_r")).select("*", "_r.*").drop("_r", "applies")
        found = rows if found is None else found.unionByName(rows)
    return found


def latest(outcomes: DataFrame, keys: tuple[str, ...] = ("document_id", "rule_id")) -> DataFrame:
    """The last outcome by end date (of equal dates the anchor's), with the periods that fired so far."""
    last = F.max_by(F.struct("outcome", "severity", "severity_rank", "period", "evidence", "missing", "pack"), F.struct("end_date", "is_anchor"))
    periods_fired = F.array_sort(F.collect_list(F.when(F.col("outcome") == FIRED, F.struct("end_date", "period"))))
    return outcomes.groupBy(*keys).agg(last.alias("last"), periods_fired["period"].alias("fired_periods")).select(*keys, "last.*", "fired_periods")


def anomalies(metrics: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Metrics at the anchor that stand out from the document's own history or from its cohort.

    History: at least 3 earlier periods of the kind and a modified z beyond 3.5. Cohort: at least 8 values
    of other documents and a mid-rank in either tail of a twentieth.
    """
    free = metrics.where(F.col("unit").isin(RATIO, TIMES, DAYS) & (F.col("scope") == PERIOD))
    earlier = Window.partitionBy("document_id", "metric", "kind").orderBy("end_date").rowsBetween(Window.unboundedPreceding, -1)
    own = free.withColumn("sample", F.collect_list("value").over(earlier)).where("is_anchor")
    own = own.where(F.size("sample") >= statistics.LEAST_HISTORY).withColumn("score", statistics.modified_z(F.col("value"), F.col("sample"))).where(F.abs("score") > statistics.OUTLYING)
    found = own.select("document_id", "metric", "period", F.lit("history").alias("basis"), "better", F.col("value").cast("double").alias("value"), statistics.median(F.col("sample")).alias("reference"), "score", F.size("sample").alias("n"))
    if samples is not None:
        keys = ["metric", "sector", "size_bucket", "kind"]
        at = free.where("is_anchor").select("document_id", *keys, "period", "better", "value")
        ranked = statistics.peer_mid_rank(at, samples, keys, "document_id", "value").withColumnRenamed("mid_rank", "score")
        ranked = ranked.where((F.col("n") >= statistics.TRUSTED_COHORT) & ((F.col("score") <= statistics.TAIL) | (F.col("score") >= 1 - statistics.TAIL)))
        middle = statistics.peer_percentile(ranked, samples, keys, "document_id", "value", 50).select("document_id", *keys, F.col("percentile").alias("reference"))
        ranked = ranked.join(middle, ["document_id", *keys])
        found = found.unionByName(ranked.select("document_id", "metric", "period", F.lit("cohort").alias("basis"), "better", F.col("value").cast("double").alias("value"), "reference", "score", F.col("n").cast("int").alias("n")))
    high = F.col("value") > F.col("reference")
    adverse = F.when(F.col("better") == "higher", ~high).when(F.col("better") == "lower", high)
    return found.select("document_id", "metric", "period", "basis", F.when(high, "high").otherwise("low").alias("direction"), adverse.alias("adverse"), "value", "reference", "score", "n")


def ordered(found: DataFrame) -> DataFrame:
    """Anomalies with `position` in their document: adverse ones first, then by metric and basis."""
    order = Window.partitionBy("document_id").orderBy(F.desc(F.coalesce("adverse", F.lit(False))), "metric", "basis")
    return found.withColumn("position", F.row_number().over(order))


def analyse(facts: DataFrame, documents: DataFrame, samples: DataFrame | None = None, peers: bool = False, rules: dict[str, Rule] = RULES) -> dict[str, DataFrame]:
    """The whole engine: issues, grid, metrics, outcomes, latest outcomes and anomalies.

    peers: the documents at hand are each other's cohorts, where no `samples` are given. A rule that the grid can't answer is
    an issue (level error, key its id) and costs no other rule. The grid is written to the shared folder with its items, then with its metrics and
    bounds, as several frames read it: `lineage.release` drops these tables.
    """
    kept, issues = facts_.validate(facts)
    grid = written(facts_.grid(written(kept, "engine-facts"), documents), "engine-items")
    grid = written(with_metrics(grid), "engine-metrics")
    metrics = metric_rows(grid)
    if peers and samples is None:
        samples = written(baselines(metrics), "engine-samples")
    grid = with_cohort_bounds(grid, samples)
    if samples is not None:
        grid = written(grid, "engine-grid")
    sound, broken = sound_rules(grid, rules)
    if broken:
        none = {c: F.lit(None) for c in ("document_id", "kind", "fiscal_year", "part")}
        rows = facts.sparkSession.createDataFrame(sorted(broken.items()), "key string, reason string").withColumns(none).withColumn("level", F.lit("error"))
        issues = issues.unionByName(rows.select(*(F.col(c).cast(issues.schema[c].dataType) for c in issues.columns)))
    outcomes = rule_outcomes(grid, sound)
    return {"issues": issues, "grid": grid, "metrics": metrics, "outcomes": outcomes, "latest": latest(outcomes), "anomalies": anomalies(metrics, samples)}
