from decimal import Decimal

from pyspark.sql import functions as F

from tallyspark.operators import statements


def test_runs_of_pages(spark):
    pages = spark.createDataFrame(
        [("d", 3, "Restated Consolidated  Statement of Profit and Loss\nx"), ("d", 4, "Statement of Profit and Loss (continued)"), ("d", 7, "Balance Sheet as at March 31"), ("d", 9, "the balance sheet is discussed below"), ("e", 3, None), ("e", 5, "Cash flow statement\nBalance sheet")],
        "document_id string, page int, text string",
    )
    found = {(r.document_id, r.statement): (r.first_page, r.last_page, r.consolidated, r.restated) for r in statements.runs(pages).collect()}
    assert found == {("d", "profit_and_loss"): (3, 4, True, True), ("d", "balance_sheet"): (7, 7, False, False), ("e", "balance_sheet"): (5, 5, False, False)}


def test_best_run(spark):
    found = spark.createDataFrame([("d", "cash_flow", 1, False, True, 9), ("d", "cash_flow", 4, True, False, 9), ("d", "cash_flow", 6, True, False, 9), ("d", "balance_sheet", 2, True, True, 4)], "document_id string, statement string, first_page int, consolidated boolean, restated boolean, mapped int")
    assert [(r.statement, r.first_page) for r in statements.best_runs(found).collect()] == [("cash_flow", 4)]


LINES = [
    # line, x0, label, values
    (0, 0.0, "Income", [None]), (1, 0.0, "Revenue from", [None]), (2, 0.0, "operations", [None]), (3, 0.0, "", ["100"]), (4, 0.0, "Other income", ["5"]), (5, 0.0, "", [None]),
    (6, 0.0, "Trade payables", [None]), (7, 5.0, "(a) small firms", ["1"]), (8, 5.0, "others", ["(2)"]), (9, 0.0, "Provisions", ["4"]), (10, 5.0, "of another kind", ["9"]),
    (11, 0.0, "Profit attributable to", [None]), (12, 4.0, "Owners of the Company", ["70"]), (13, 4.0, "Non-controlling interests", ["3"]), (14, 0.0, "As per our report", [None]), (15, 0.0, "Provisions", ["8"]),
]


def test_statement_to_amounts(spark):
    rows = spark.createDataFrame([("d", 1, *x) for x in LINES], "document_id string, table int, line int, x0 double, label string, values array<string>")
    printed = statements.merge_wrapped(statements.body(rows))
    assert [(r.line, r.label, r["values"]) for r in printed.orderBy("line").collect()][:3] == [(0, "Income", [None]), (1, "Revenue from operations", ["100"]), (4, "Other income", ["5"])]
    names = spark.createDataFrame([("profit_and_loss", k, n, i) for i, (k, n) in enumerate({"revenue": "Revenue from operations", "other_income": "Other income", "payables": "Trade payables", "provisions": "Provisions"}.items())], "statement string, key string, name string, rank int")
    known = statements.matched(statements.with_sections(printed).withColumn("statement", F.lit("profit_and_loss")), names)
    parts = statements.with_parents(known)
    assert {(r.line, r.key, r.from_parent) for r in parts.collect()} >= {(1, "revenue", False), (7, "payables", True), (8, "payables", True), (9, "provisions", False), (10, None, False), (12, "profit_attributable_to_owners", False), (13, None, False)}
    columns = spark.createDataFrame([("d", 1, 0, "FY25", Decimal("0.1"))], "document_id string, table int, column int, period string, scale decimal(10,4)")
    items = spark.createDataFrame([(k, "inr_crore", False) for k in ("revenue", "payables", "provisions", "profit_attributable_to_owners")], "key string, unit string, sum_rows boolean")
    found = {r.key: (float(r.value), r.ignored) for r in statements.item_amounts(statements.contributions(parts, columns, items)).collect()}
    assert found == {"revenue": (10.0, []), "payables": (-0.1, []), "provisions": (0.4, []), "profit_attributable_to_owners": (7.0, [])}


def test_sections_qualify(spark):
    rows = spark.createDataFrame([("d", 1, 0, 0.0, "Non-current liabilities", [None]), ("d", 1, 1, 0.0, "Borrowings", ["1"]), ("d", 1, 2, 0.0, "Current liabilities", [None]), ("d", 1, 3, 0.0, "Borrowings", ["2"]), ("d", 1, 4, 0.0, "Total borrowings", ["3"])], "document_id string, table int, line int, x0 double, label string, values array<string>")
    names = spark.createDataFrame([("balance_sheet", "long", "Non-current borrowings", 0), ("balance_sheet", "short", "Current borrowings", 1), ("balance_sheet", "all", "Total borrowings", 2)], "statement string, key string, name string, rank int")
    known = statements.matched(statements.with_sections(rows).withColumn("statement", F.lit("balance_sheet")), names)
    assert [r.key for r in known.where("line in (1, 3, 4)").orderBy("line").collect()] == ["long", "short", "all"]


def test_direct_rows_come_first(spark):
    parts = spark.createDataFrame([("a", 1, "x", 5.0, True, False), ("a", 2, "y", 7.0, False, False), ("a", 3, "z", 8.0, False, False), ("a", 4, "w", 7.0, False, False), ("b", 1, "x", 1.0, False, True), ("b", 2, "y", 2.0, False, True), ("b", 3, "z", 4.0, True, True)], "key string, line int, label string, value double, from_parent boolean, sum_rows boolean")
    found = {r.key: (r.value, r.ignored) for r in statements.item_amounts(parts, ("key",)).collect()}
    assert found == {"a": (7.0, ["z"]), "b": (3.0, [])} and statements.item_amounts(parts.where("false"), ("key",)).count() == 0


def test_a_label_printed_often_is_matched_once(spark, monkeypatch):
    rows = [(f"d{n}", 1, line, "balance_sheet", label, section) for n in range(3) for line, label, section in ((1, "Borrowings", "Non-current liabilities"), (2, "Borrowings", None), (3, "Borrowings", "Non-current liabilities"), (4, "Odd", None))]
    rows = spark.createDataFrame(rows, "document_id string, table int, line int, statement string, label string, section string")
    names = spark.createDataFrame([("balance_sheet", "long", "Non-current borrowings", 0), ("balance_sheet", "short", "Current borrowings", 1)], "statement string, key string, name string, rank int")
    asked, real = [], statements.labels.match
    monkeypatch.setattr(statements.labels, "match", lambda given, known: asked.append(given.count()) or real(given, known))
    got = {(r.document_id, r.line): (r.key, r.score) for r in statements.matched(rows, names).collect()}
    assert got == {(f"d{n}", line): found for n in range(3) for line, found in ((1, ("long", 1.0)), (2, (None, None)), (3, ("long", 1.0)), (4, (None, None)))}
    assert asked == [4]
