"""Tagged filings: XML instances as contexts and facts, and their mapping to line items."""

from __future__ import annotations

from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog.items import CRORE, ITEMS
from ..functions import periods, printed
from ..functions.timeseries import AMOUNT

ELEMENTS = "path string, context string, start_date date, end_date date, dimensional boolean, element string, ordinal int, text string, error string"


def _local(name: str) -> str:
    return name.rpartition(":")[2]


def parse_instance(content: bytes) -> list[tuple]:
    """(context, start, end, dimensional, element, ordinal, text) of each fact in document order; raises ValueError.

    Documents with a DTD are refused, and so are entities.
    """
    contexts: dict[str, dict] = {}
    facts: list[tuple[str, str, str]] = []
    stack: list[tuple[str, dict]] = []
    text: list[str] = []
    parser = expat.ParserCreate()

    def refuse(*_):
        raise ValueError("a document type is not allowed")

    def start(name, attributes):
        stack.append((_local(name), attributes))
        text.clear()
        if len(stack) == 1 and _local(name) != "xbrl":
            raise ValueError("the root is not xbrl")
        if _local(name) == "context":
            contexts[attributes.get("id", "")] = {"start": None, "end": None, "dimensional": False}
        if _local(name) in ("explicitMember", "typedMember") and current():
            contexts[current()]["dimensional"] = True

    def current():
        return next((a.get("id", "") for n, a in stack if n == "context"), None)

    def end(name):
        tag, attributes = stack.pop()
        value = "".join(text).strip()
        text.clear()
        context = current()
        if context is not None and tag in ("startDate", "endDate", "instant"):
            contexts[context]["start" if tag == "startDate" else "end"] = value
        elif len(stack) == 1 and "contextRef" in attributes:
            facts.append((attributes["contextRef"], tag, value))

    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = refuse
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text.append
    try:
        parser.Parse(content, True)
    except expat.ExpatError as e:
        raise ValueError(f"not XML: {e}") from None
    if not contexts:
        raise ValueError("no context")
    found, ordinal = [], {}
    for context, element, value in facts:
        c = contexts.get(context)
        if c:
            n = ordinal[context, element] = ordinal.get((context, element), 0) + 1
            found.append((context, c["start"], c["end"], c["dimensional"], element, n, value))
    return found


def _parse_files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in ELEMENTS.split(", ")]
    for frame in frames:
        rows = []
        for path, content in zip(frame["path"], frame["content"]):
            try:
                rows += [(path, *r, None) for r in parse_instance(bytes(content))]
            except ValueError as e:
                rows.append((path, *[None] * 7, str(e)))
        out = pd.DataFrame(rows, columns=columns)
        for c in ("start_date", "end_date"):
            out[c] = pd.to_datetime(out[c], errors="coerce").dt.date
        out["ordinal"] = out["ordinal"].astype("Int32")
        yield out


def read_instances(files: DataFrame) -> DataFrame:
    """Facts of the filings in `files` (path, content); one that can't be read is a row with `error`."""
    return files.select("path", "content").mapInPandas(_parse_files, ELEMENTS)


def binary_files(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """Files with their content; those over `most_bytes` are not opened."""
    found = spark.read.format("binaryFile").load(path)
    return found.where(F.col("length") <= most_bytes) if most_bytes else found


def kind_of(content, path):
    """offer_document, tagged_filing or null, by the first bytes."""
    head = F.ltrim(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"))
    return F.when(head.startswith("%PDF"), "offer_document").when(head.startswith("<") | F.lower(path).endswith(".xml"), "tagged_filing")


def mapping(spark: SparkSession) -> DataFrame:
    """(key, nature, unit, element, sign, pick) of every element of the vocabulary."""
    rows = [(i.key, i.nature, i.unit, *_element(e)) for i in ITEMS.values() for e in i.elements]
    return spark.createDataFrame(rows, "key string, nature string, unit string, element string, sign int, pick string")


def _element(text: str) -> tuple[str, int, str | None]:
    name, _, pick = text.partition("#")
    return name.lstrip("-"), -1 if name.startswith("-") else 1, pick or None


def longest_ending(spans: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """(keys, end_date, period): of the spans (keys, start_date, end_date, period) that end on a date the longest."""
    return spans.groupBy(*keys, "end_date").agg(F.max_by("period", F.datediff("end_date", "start_date")).alias("period"))


#: Elements that say something of the filing itself.
STATED = {"start": "DateOfStartOfReportingPeriod", "end": "DateOfEndOfReportingPeriod"}
METADATA = {
    "company": "NameOfTheCompany", "nse_symbol": "Symbol", "bse_code": "ScripCode", "isin": "ISIN", "nature": "NatureOfReportStandaloneConsolidated", "audited": "WhetherResultsAreAuditedOrUnaudited",
    "filed": "DateOfBoardMeetingWhenFinancialResultsWereApproved", "year_end": "DateOfEndOfFinancialYear", "declaration": "DeclarationOfUnmodifiedOpinionOrStatementOnImpactOfAuditQualification",
}
UNLISTED = "NOTLISTED"


def _issue(rows: DataFrame, level: str, message) -> DataFrame:
    return rows.select("path", F.lit(level).alias("level"), message.alias("message"))


def metadata(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((path, company, nse_symbol, bse_code, isin, basis, audited, filed, fye_month, opinion), issues) of each filing.

    Said by the context OneD where there is one, else by the filing's first span. Without a stated end of the year that is March, with a warning.
    """
    spans = elements.where("error is null and not dimensional and start_date is not null")
    primary = spans.groupBy("path").agg(F.min(F.struct((F.col("context") != "OneD").alias("other"), "context"))["context"].alias("context"))
    said = lambda name: F.min_by(F.when((F.col("element") == name) & (F.trim("text") != ""), F.trim("text")), F.when(F.col("element") == name, F.col("ordinal")))
    found = spans.join(primary, ["path", "context"]).groupBy("path").agg(*(said(e).alias(k) for k, e in METADATA.items()))
    month = F.month(F.try_to_date("year_end", "yyyy-MM-dd"))
    rows = found.select(
        "path", "company", F.when(F.col("nse_symbol") != UNLISTED, F.col("nse_symbol")).alias("nse_symbol"), "bse_code", "isin",
        F.when(F.lower("nature").startswith("consol"), "consolidated").otherwise("standalone").alias("basis"), F.coalesce(F.lower("audited") == "audited", F.lit(False)).alias("audited"),
        F.try_to_date("filed", "yyyy-MM-dd").alias("filed"), F.coalesce(month, F.lit(3)).alias("fye_month"), printed.opinion(F.col("declaration")).alias("opinion"),
    )
    unsaid = _issue(found.where(month.isNull()), "warning", F.lit("fiscal year end not stated; March assumed"))
    return rows, unsaid.unionByName(_issue(found.where("company is null"), "error", F.lit("the filing does not name the company")))


def stated_dates(elements: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(elements whose contexts have the dates that they state themselves, issues where those differ)."""
    said = lambda name: F.try_to_date(F.max(F.when(F.col("element") == name, F.trim("text"))), "yyyy-MM-dd")
    found = elements.where("error is null and not dimensional and start_date is not null").groupBy("path", "context", "start_date", "end_date").agg(said(STATED["start"]).alias("_start"), said(STATED["end"]).alias("_end"))
    found = found.where((F.col("_start") != F.col("start_date")) | (F.col("_end") != F.col("end_date"))).where("_start is not null and _end is not null")
    moved = elements.join(found.select("path", "context", "_start", "_end"), ["path", "context"], "left")
    moved = moved.withColumns({c: F.when(F.col("start_date").isNotNull(), F.coalesce(s, c)).otherwise(F.col(c)) for c, s in (("start_date", "_start"), ("end_date", "_end"))})
    return moved.select(elements.columns), _issue(found, "warning", F.format_string("context %s: dates %s..%s contradict its reporting period %s..%s, which counts", "context", "start_date", "end_date", "_start", "_end"))


def unmapped(elements: DataFrame, by: tuple[str, ...] = ("path",)) -> DataFrame:
    """(by, elements): the elements, in order, that have a number other than zero and that no line item takes."""
    known = F.broadcast(mapping(elements.sparkSession).select("element").distinct())
    rows = elements.where("error is null and not dimensional").where(printed.is_line_item(F.col("element"))).where(F.col("text").try_cast(AMOUNT) != 0)
    return rows.join(known, "element", "left_anti").groupBy(*by).agg(F.array_sort(F.collect_set("element")).alias("elements"))


def undated(elements: DataFrame) -> DataFrame:
    """Issues of balance sheet dates on which no period of the filing ends."""
    plain = elements.where("error is null and not dimensional")
    ends = plain.where("start_date is not null").select("path", "end_date").distinct()
    alone = plain.where("start_date is null").select("path", "end_date").distinct().join(ends, ["path", "end_date"], "left_anti")
    return _issue(alone, "warning", F.format_string("balance sheet date %s has no period", "end_date"))


def conflicts(elements: DataFrame, fye: int | None = None) -> DataFrame:
    """Issues of items for whose period contexts have different values; `to_facts` keeps the first."""
    each = by_context(elements, 3 if fye is None else fye).groupBy("path", "key", "period").agg(F.count_distinct("value").alias("n"))
    return _issue(each.where("n > 1"), "warning", F.concat(F.lit("conflicting values of "), "key", F.lit(" in "), periods.label(F.col("period.kind"), F.col("period.fiscal_year"), F.col("period.part")), F.lit("; the first counts")))


def exceptional_sign(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, issues): exceptional items are turned round where only that gives, exactly, the profit before tax from the profit before them."""
    keys, names = ["path", "kind", "fiscal_year", "part"], {"before": "profit_before_exceptional_items", "exceptional": "exceptional_items", "pbt": "profit_before_tax"}
    wide = facts.groupBy(*keys).agg(*(F.max(F.when(F.col("key") == k, F.col("value"))).alias(n) for n, k in names.items()))
    wrong = wide.where("exceptional <> 0 and before - exceptional = pbt and before + exceptional <> pbt")
    keyed = wrong.select(*(F.col(c).alias(f"_{c}") for c in keys), F.lit("exceptional_items").alias("_key"))
    same = (F.col("path") == F.col("_path")) & (F.col("kind") == F.col("_kind")) & (F.col("fiscal_year") == F.col("_fiscal_year")) & F.col("part").eqNullSafe(F.col("_part")) & (F.col("key") == F.col("_key"))
    turned = facts.join(keyed, same, "left").withColumn("value", F.when(F.col("_key").isNotNull(), -F.col("value")).otherwise(F.col("value")))
    return turned.select(facts.columns), _issue(wrong, "warning", F.concat(F.lit("exceptional items of "), periods.label(F.col("kind"), F.col("fiscal_year"), F.col("part")), F.lit(" had the other sign")))


def parse_filings(elements: DataFrame) -> dict[str, DataFrame]:
    """Whole filings: `documents` (metadata), `facts` (of periods, and the opinion), `issues` and `unmapped`, all by path.

    elements: as `read_instances` gives them; persist or write them first, as each of the frames reads them.
    """
    documents, issues = metadata(elements)
    dated, moved = stated_dates(elements)
    facts, turned = exceptional_sign(to_facts(dated.join(documents.select("path", "fye_month"), "path")))
    text = lambda kind: F.lit(None).cast(kind)
    opinions = documents.where("opinion is not null").select("path", F.lit("auditor_opinion").alias("key"), text("string").alias("kind"), text("int").alias("fiscal_year"), text("int").alias("part"), text(AMOUNT).alias("value"), F.col("opinion").alias("text"))
    broken = _issue(elements.where("error is not null"), "error", F.col("error"))
    every = issues.unionByName(moved).unionByName(turned).unionByName(undated(dated)).unionByName(conflicts(dated.join(documents.select("path", "fye_month"), "path"))).unionByName(broken)
    return {"documents": documents, "facts": facts.withColumn("text", text("string")).unionByName(opinions), "issues": every, "unmapped": unmapped(elements)}


def to_facts(elements: DataFrame, fye: int = 3) -> DataFrame:
    """(path, key, kind, fiscal_year, part, value): element values by period, signed and summed.

    Balances take the longest period that ends on their date. #first and #last pick of two values or more. A period that contexts disagree on keeps the first.
    fye: the month in which fiscal years end, where `elements` has no column fye_month.
    """
    summed = by_context(elements, fye)
    first = Window.partitionBy("path", "key", "period").orderBy("context")
    return summed.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("path", "key", "period.*", "value")


def by_context(elements: DataFrame, fye: int = 3) -> DataFrame:
    """(path, context, key, period, value): what `to_facts` takes the first of."""
    ends = F.col("fye_month") if "fye_month" in elements.columns else F.lit(fye)
    plain = elements.where("error is null and not dimensional").withColumn("number", F.col("text").try_cast(AMOUNT)).where("number is not null")
    spans = plain.where("start_date is not null").select("path", "start_date", "end_date", ends.alias("_ends")).distinct().withColumn("period", periods.from_dates(F.col("start_date"), F.col("end_date"), F.col("_ends"))).drop("_ends").where("period is not null")
    longest = longest_ending(spans)
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "number")))["number"]
    values = plain.groupBy("path", "context", "start_date", "end_date", "element").agg(ordered.alias("numbers"))
    mapped = values.join(F.broadcast(mapping(elements.sparkSession)), "element")
    picked = F.when(F.col("pick").isNull(), F.get("numbers", F.lit(0))).when(F.size("numbers") >= 2, F.when(F.col("pick") == "first", F.get("numbers", F.lit(0))).otherwise(F.element_at("numbers", -1)))
    scaled = F.when(F.col("unit") == CRORE, picked / F.lit(10_000_000)).otherwise(picked).cast(AMOUNT)
    rows = mapped.withColumn("value", scaled * F.col("sign")).where("value is not null")
    flows = rows.where("start_date is not null").join(spans, ["path", "start_date", "end_date"])
    balances = rows.where("start_date is null").join(longest, ["path", "end_date"])
    every = flows.unionByName(balances.select(flows.columns))
    return every.groupBy("path", "context", "key", "period").agg(F.sum("value").cast(AMOUNT).alias("value"))
