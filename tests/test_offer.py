"""Made filings as words with positions, and what must be read from them."""

import random
from decimal import Decimal

from tallyspark.operators import offer

NAMES = [
    ("profit_and_loss", "revenue_from_operations", "Revenue from operations"), ("profit_and_loss", "other_income", "Other income"), ("profit_and_loss", "total_income", "Total income"),
    ("profit_and_loss", "employee_benefits", "Employee benefits expense"), ("profit_and_loss", "finance_costs", "Finance costs"), ("profit_and_loss", "depreciation_amortisation", "Depreciation and amortisation expense"),
    ("profit_and_loss", "total_expenses", "Total expenses"), ("profit_and_loss", "profit_before_tax", "Profit before tax"), ("profit_and_loss", "total_tax_expense", "Total tax expense"), ("profit_and_loss", "profit_after_tax", "Profit for the period"),
    ("profit_and_loss", "profit_attributable_to_owners", "Profit attributable to owners"), ("profit_and_loss", "eps_basic", "Basic earnings per share"), ("profit_and_loss", "face_value_per_share", "Face value per share"),
    ("balance_sheet", "borrowings_non_current", "Borrowings non-current"), ("balance_sheet", "borrowings_current", "Borrowings current"), ("balance_sheet", "trade_receivables", "Trade receivables"), ("balance_sheet", "cash_and_cash_equivalents", "Cash and cash equivalents"),
    ("balance_sheet", "inventories", "Inventories"), ("balance_sheet", "total_assets", "Total assets"), ("balance_sheet", "equity_share_capital", "Equity share capital"), ("balance_sheet", "other_equity", "Other equity"),
    ("cash_flow", "operating_cash_flow", "Net cash from operating activities"), ("cash_flow", "purchase_of_property", "Purchase of property"), ("cash_flow", "interest_paid", "Interest paid"), ("cash_flow", "dividend_paid", "Dividends paid"), ("cash_flow", "repayment", "Repayment of borrowings"),
]
UNITS = {"eps_basic": "inr", "face_value_per_share": "inr"}
ADD = {"purchase_of_property"}


class Page:
    """Words of a page: text from the left, numbers to the right edges of columns."""

    def __init__(self, document, number, title, captions=(), unit="(Amounts in ₹ million)"):
        self.document, self.number, self.words, self.texts, self.top = document, number, [], [], 20.0
        for line in [title, *([unit] if unit else []), *captions]:
            self.line(line)

    def line(self, text="", values=(), x=50.0, note=None, split=False, rights=(350.0, 430.0)):
        """A printed row; its words' tops vary by less than a line's tolerance."""
        self.texts.append(text)
        at = x
        for k, word in enumerate(text.split()):
            self.words.append((self.document, self.number, word, at, at + 5 * len(word), self.top + (k % 3) * 0.8))
            at += 5 * len(word) + 4
        if note:
            self.words.append((self.document, self.number, note, 240.0, 240.0 + 5 * len(note), self.top))
        for value, right in zip(values, rights):
            if value is None:
                continue
            if split and len(value) > 5:
                self.words.append((self.document, self.number, value[:1], right - 5 * len(value), right - 5 * len(value) + 5, self.top + 1.5))
                value = value[1:]
            self.words.append((self.document, self.number, value, right - 5 * len(value), right, self.top))
        self.top += 12

    def header(self, *lines, rights=(350.0, 430.0)):
        """Column headers of several lines, centred over the columns."""
        for line in lines:
            for text, right in zip(line, rights):
                at = right - 2.5 * (len(text) + 2)
                for word in text.split():
                    self.words.append((self.document, self.number, word, at, at + 2.5 * len(word), self.top))
                    at += 2.5 * (len(word) + 1)
            self.top += 12
            self.texts.append("")

    def row(self):
        return (self.document, self.number, "\n".join(self.texts))


def rupees(x):
    """Indian digit groups; brackets for negative, a dash for nil."""
    if not x:
        return "-"
    whole, fraction = f"{abs(x):.2f}".split(".")
    head, tail = whole[:-3], whole[-3:]
    groups = []
    while head:
        groups.insert(0, head[-2:])
        head = head[:-2]
    text = ",".join([*groups, tail]) + "." + fraction
    return f"({text})" if x < 0 else text


def filing(k):
    """Pages of a filing and the facts in them, in crore: amounts are printed in million."""
    r, name = random.Random(k), f"doc{k}"
    facts = {}
    amount = lambda low=100, high=90_000: Decimal(r.randrange(low * 100, high * 100)) / 100

    def printed(page, key, label, values, years=("FY25", "FY24"), **options):
        page.line(label, [rupees(v) for v in values], split=r.random() < 0.5, **options)
        if key:
            for year, v in zip(years, values):
                facts[key, year] = v if key in UNITS else v / 10

    cover = Page(name, 1, "DRAFT RED HERRING PROSPECTUS", ["THIS IS A COVER", f"MADE COMPANY {k} LIMITED", f"Corporate Identity Number: U{10000 + k}MH2001PLC{100000 + k}"], unit=None)
    p = Page(name, 3, "Restated Consolidated Statement of Profit and Loss")
    p.line("Particulars", note="Notes")
    p.header(("For the year ended", "For the year ended"), ("March 31, 2025", "March 31, 2024"))
    p.line("Income")
    printed(p, "revenue_from_operations", "I. Revenue from operations", [amount(), amount()], note="21")
    printed(p, "other_income", "II. Other income", [amount(), Decimal(0)], note="22")
    income = [amount(), amount()]
    printed(p, "total_income", "III. Total income (I+II)", income)
    p.line("Expenses")
    printed(p, "employee_benefits", "Employee benefits expense", [amount(), amount()])
    # The label runs over two lines; the amounts stand on the second line of the next.
    p.line("Depreciation and", [])
    p.line("amortisation expense", [])
    values = [amount(), amount()]
    p.line("", [rupees(v) for v in values])
    for year, v in zip(("FY25", "FY24"), values):
        facts["depreciation_amortisation", year] = v / 10
    printed(p, "total_expenses", "Total expenses", [amount(), amount()])
    pbt = [amount(), amount()]
    printed(p, "profit_before_tax", "Profit before tax", pbt)
    tax = [(v / 4).quantize(Decimal("0.01")) for v in pbt]
    flipped = k % 3 == 0
    p.line("Total tax expense", [rupees(-v if flipped else v) for v in tax])
    for year, v, b in zip(("FY25", "FY24"), tax, pbt):
        facts["total_tax_expense", year] = v / 10
        facts["profit_after_tax", year] = (b - v) / 10
    p.line("Profit for the year", [rupees(b - v) for b, v in zip(pbt, tax)])
    p.line("Profit attributable to:")
    owners = [amount(), amount()]
    printed(p, "profit_attributable_to_owners", "Owners of the Company", owners)
    p.line("Non-controlling interests", [rupees(amount()), rupees(amount())])
    p.line("Earnings per equity share (face value of ₹ 10 each)")
    printed(p, "eps_basic", "Basic earnings per share", [amount(1, 90), amount(1, 90)])
    for year in ("FY25", "FY24"):
        facts["face_value_per_share", year] = Decimal(10)
    p.line("As per our report of even date attached")
    p.line("Total income", ["9,999.00", "9,999.00"])

    c = Page(name, 5, "Restated Consolidated Statement of Cash Flows")
    c.header(("For the year ended", "For the year ended"), ("31 March 2025", "31 March 2024"))
    printed(c, "operating_cash_flow", "Net cash generated from operating activities", [amount(), -amount()])
    printed(c, "interest_paid", "Interest paid", [-amount(), -amount()])
    printed(c, "dividend_paid", "Dividends paid", [-amount(), Decimal(0)])
    one, two = [-amount(), -amount()], [-amount(), -amount()]
    c.line("Purchase of property", [rupees(v) for v in one])
    c.line("Purchase of property", [rupees(v) for v in two])
    for year, a, b in zip(("FY25", "FY24"), one, two):
        facts["purchase_of_property", year] = (a + b) / 10
    printed(c, "repayment", "Repayment of borrowings", [-amount(), -amount()])

    b = Page(name, 7, "Restated Consolidated Balance Sheet")
    b.header(("As at", "As at"), ("March 31, 2025", "March 31, 2024"))
    b.line("Current assets")
    printed(b, "inventories", "(a) Inventories", [amount(), amount()])
    b.line("(b) Trade receivables")
    parts = [[amount(), amount()] for _ in range(2)]
    for label, v in zip(("Secured", "Unsecured"), parts):
        b.line(label, [rupees(x) for x in v], x=70.0)
    for y, year in enumerate(("FY25", "FY24")):
        facts["trade_receivables", year] = (parts[0][y] + parts[1][y]) / 10
    printed(b, "cash_and_cash_equivalents", "(c) Cash and cash equivalents", [amount(), amount()])
    printed(b, "equity_share_capital", "Equity share capital", [amount(), amount()])
    printed(b, "other_equity", "Other equity", [amount(), -amount()])
    printed(b, "total_assets", "Total assets", [amount(), amount()])
    b.line("Something unheard of", ["1,234.00", "2,345.00"])
    d = Page(name, 8, "Restated Consolidated Balance Sheet (continued)", unit=None)
    d.line("Non-current liabilities")
    printed(d, "borrowings_non_current", "Borrowings", [amount(), amount()])
    d.line("Current liabilities")
    printed(d, "borrowings_current", "Borrowings", [amount(), amount()])
    # A summary elsewhere, with fewer rows and other figures.
    e = Page(name, 12, "Statement of Profit and Loss")
    e.header(("For the year ended", "For the year ended"), ("March 31, 2025", "March 31, 2024"))
    for label in ("Total income", "Total expenses", "Finance costs"):
        e.line(label, ["7,777.00", "6,666.00"])
    return [cover, p, c, b, d, e], facts, flipped


def frames(spark, filings):
    pages = [q for f in filings for q in f[0]]
    words = [w for q in pages for w in q.words]
    random.Random(1).shuffle(words)
    return (
        spark.createDataFrame([q.row() for q in pages], "document_id string, page int, text string").repartition(3),
        spark.createDataFrame(words, "document_id string, page int, text string, x0 double, x1 double, top double").repartition(5),
        spark.createDataFrame([(*n, k) for k, n in enumerate(NAMES)], "statement string, key string, name string, rank int"),
        spark.createDataFrame([(key, UNITS.get(key, "inr_crore"), key in ADD) for _, key, _ in NAMES], "key string, unit string, sum_rows boolean"),
    )


def label(r):
    return f"FY{r.fiscal_year % 100:02d}" if r.kind == "year" else f"{r.kind}{r.part}"


def test_ten_filings(spark):
    filings = [filing(k) for k in range(10)]
    found = offer.read(*frames(spark, filings))
    got = {}
    for r in found["facts"].collect():
        assert (r.document_id, r.key, label(r)) not in got
        got[r.document_id, r.key, label(r)] = r.value
    want = {(f"doc{k}", key, year): v for k, (_, facts, _) in enumerate(filings) for (key, year), v in facts.items()}
    assert got == want
    pages = {(r.key, r.page, r.method) for r in found["facts"].collect()}
    assert {("borrowings_current", 8, "table"), ("eps_basic", 3, "table"), ("face_value_per_share", 3, "text"), ("interest_paid", 5, "table")} <= pages
    labels = {r.key: r.raw_label for r in found["facts"].where("document_id = 'doc1'").collect()}
    assert labels["trade_receivables"] == "Secured + Unsecured" and labels["depreciation_amortisation"] == "Depreciation and amortisation expense"
    told = sorted((r.document_id, r.level, r.reason) for r in found["issues"].collect())
    assert told == sorted((f"doc{k}", "info", "tax had the other sign") for k in range(0, 10, 3) for _ in range(2))
    assert {(r.page, r.label) for r in found["unmapped"].collect()} == {(7, "Something unheard of")}
    assert {(r.fye_month, r.consolidated, r.restated) for r in found["documents"].collect()} == {(3, True, True)}


def test_issues(spark):
    """No statement; statements without a header, without a unit, and of several direct rows."""
    pages, facts, _ = filing(1)
    bare = Page("bare", 1, "Nothing of note")
    p = Page("odd", 1, "Statement of Profit and Loss", unit=None)
    p.header(("For the year ended", "For the year ended"), ("March 31, 2025", "March 31, 2024"))
    for text in ("Revenue from operations", "Other income", "Total income", "Total expenses", "Profit before tax", "Finance costs"):
        p.line(text, ["1,234.00", "2,345.00"])
    b = Page("odd", 2, "Balance Sheet")
    b.header(("As at", "As at"), ("March 31, 2025", "March 31, 2024"))
    for text in ("Inventories", "Trade receivables", "Cash and cash equivalents", "Total assets", "Equity share capital"):
        b.line(text, ["1,234.00", "2,345.00"])
    b.line("Total assets", ["4,321.00", "2,345.00"])
    c = Page("odd", 4, "Cash Flow Statement")
    c.line("Interest paid", ["1,234.00", "2,345.00"])
    found = offer.read(*frames(spark, [([bare, p, b, c, *pages], facts, False)]))
    got = {(r.document_id, r.level, r.ref, r.reason) for r in found["issues"].collect()}
    assert got == {
        ("bare", "error", None, "no primary financial statements found"), ("odd", "error", None, "page 1: currency unit not stated"), ("odd", "warning", None, "profit_and_loss not found"), ("odd", "warning", None, "cash_flow not found"),
        ("odd", "warning", "f:total_assets@FY25", "several rows map to this item; kept 'Total assets', ignored 'Total assets'"),
    }
    assert {(r.key, r.value) for r in found["facts"].where("document_id = 'odd' and fiscal_year = 2025").collect()} == {(k, Decimal("123.4")) for k in ("inventories", "trade_receivables", "cash_and_cash_equivalents", "total_assets", "equity_share_capital")}
    empty = offer.read(*(f.limit(0) if k < 2 else f for k, f in enumerate(frames(spark, [([bare], {}, False)]))))
    assert all(f.collect() == [] for f in empty.values())


def test_covers(spark):
    pages = frames(spark, [filing(2), ([Page("x", 1, "A letter")], {}, False)])[0]
    documents, issues = offer.cover(pages)
    assert {(r.document_id, r.doc_type, r.company, r.cin) for r in documents.collect()} == {("doc2", "drhp", "MADE COMPANY 2 LIMITED", "U10002MH2001PLC100002"), ("x", None, None, None)}
    assert {(r.document_id, r.level) for r in issues.collect()} == {("doc2", "info"), ("x", "error")} and issues.count() == 3
