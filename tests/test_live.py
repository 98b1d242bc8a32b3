import json
import os
import threading
import time
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import tools
from tallyspark.sources import filings, reader
from tallyspark.streaming import live

T = datetime(2025, 1, 1)


def put(folder, name, rows):
    """A file that appears at once."""
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/.{name}", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    os.rename(f"{folder}/.{name}", f"{folder}/{name}")


def test_latest_within(spark, tmp_path):
    """Late, repeated and expired events: a key that is quiet goes, and one that comes again starts anew."""
    at = lambda hours: (T + timedelta(hours=hours)).isoformat()
    batches = [
        [("a", "x", 0), ("b", "x", 1), ("a", "y", 2), ("a", "y", 2)],
        [("a", "old", 1), ("b", "x", 1), ("a", "w", 2), (None, "n", 3)],
        [("c", "z", 40)],
        [("c", "z", 41), ("a", "too late", 3)],
        [("b", "again", 42)],
        [("c", "z", 100)],
        [("c", "end", 101)],
    ]
    folder, out = str(tmp_path / "in"), []
    stream = spark.readStream.schema("k string, v string, t timestamp").option("maxFilesPerTrigger", 1).json(folder) if os.makedirs(folder) is None else None
    found = live.latest_within(stream, "k", "v", "t", keep="24 hours", late="1 hour")
    for n, rows in enumerate(batches):
        put(folder, f"{n}.json", [{"k": k, "v": v, "t": at(h)} for k, v, h in rows])
        query = found.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, _: out.extend(tuple(r) for r in b.collect())).trigger(availableNow=True).start()
        query.awaitTermination()
    hours = [(k, s, v, (t - T).total_seconds() / 3600) for k, s, v, t in out]
    assert sorted(hours) == sorted([
        ("a", "current", "y", 2), ("b", "current", "x", 1), ("c", "current", "z", 40), ("a", "expired", "y", 2), ("b", "expired", "x", 1), ("c", "current", "z", 41),
        ("b", "current", "again", 42), ("c", "current", "z", 100), ("b", "expired", "again", 42), ("c", "current", "end", 101),
    ])


def test_follow_until_the_end(spark, tmp_path):
    folder = str(tmp_path / "events")
    os.makedirs(folder)
    events = spark.readStream.schema("analysis_id string, stage string, status string, at timestamp").json(folder)
    row = lambda a, stage, status, n: {"analysis_id": a, "stage": stage, "status": status, "at": (T + timedelta(minutes=n)).isoformat()}

    def write():
        put(folder, "1.json", [row("one", "metrics", "running", 2), row("two", "facts", "running", 1), row("one", "facts", "running", 1)])
        time.sleep(3)
        put(folder, "2.json", [row("two", "report", "completed", 5), row("one", "rules", "running", 3)])
        time.sleep(3)
        put(folder, "3.json", [row("one", "report", "completed", 9)])

    writer = threading.Thread(target=write)
    writer.start()
    got = [(e["stage"], e["status"]) for e in live.follow(spark, events, "one", str(tmp_path / "check"), trigger="200 milliseconds")]
    writer.join()
    assert got == [("facts", "running"), ("metrics", "running"), ("rules", "running"), ("report", "completed")] and not spark.streams.active


def test_a_fault_of_the_stream_is_raised(spark, tmp_path):
    folder = str(tmp_path / "events")
    os.makedirs(folder)
    put(folder, "1.json", [{"analysis_id": "one", "stage": "s", "status": "running", "at": T.isoformat()}])
    events = spark.readStream.schema("analysis_id string, stage string, status string, at timestamp").json(folder)
    broken = events.withColumn("stage", F.raise_error(F.lit("planted")).cast("string"))
    with pytest.raises(RuntimeError, match="planted"):
        list(live.follow(spark, broken, "one", str(tmp_path / "check"), trigger="200 milliseconds"))
    assert not spark.streams.active


XML = """<xbrl><context id="c1"><period><startDate>2024-04-01</startDate><endDate>2025-03-31</endDate></period></context>
<context id="c2"><period><instant>2025-03-31</instant></period></context><in:Revenue contextRef="c1">{}</in:Revenue><in:Assets contextRef="c2">5</in:Assets></xbrl>"""


def test_filing_format(spark, tmp_path):
    folder = tmp_path / "filings" / "deep"
    folder.mkdir(parents=True)
    for k in range(4):
        (folder / f"{k}.xml").write_text(XML.format(k))
    (folder / "broken.xml").write_text("<xbrl>")
    (folder / "notes.txt").write_text("none")
    (folder / "_hidden.xml").write_text("none")
    reader.register(spark)
    found = spark.read.format("filing").load(str(tmp_path / "filings"))
    rows = lambda df: sorted((os.path.basename(r.path), *map(str, r[1:])) for r in df.collect())
    files = spark.createDataFrame([(str(p), p.read_bytes()) for p in folder.glob("[0-9b]*.xml")], "path string, content binary")
    assert rows(found) == rows(filings.read_instances(files)) and found.where("error is null").count() == 8 and found.where("error is not null").count() == 1
    assert {r.start_date for r in found.where("element = 'Revenue'").collect()} == {date(2024, 4, 1)}
    assert found.rdd.getNumPartitions() == 5
    one = found.where(F.col("path") == str(folder / "2.xml"))
    assert [r.text for r in one.where("element = 'Revenue'").collect()] == ["2"] and one.rdd.getNumPartitions() == 1
    assert found.where(F.col("path").startswith(str(folder / "b"))).rdd.getNumPartitions() == 1 and found.where(F.col("path").isin(str(folder / "1.xml"), str(folder / "3.xml"))).count() == 4
    assert spark.read.format("filing").option("most_bytes", 10).load(str(folder)).where("error like 'over%'").count() == 4
    (tmp_path / "empty").mkdir()
    assert spark.read.format("filing").load(str(tmp_path / "empty")).count() == 0


def test_word_boxes_format(spark, tmp_path):
    reader.register(spark)
    page = {"page": 1, "text": "Total", "words": [{"text": "Total", "x0": 1, "x1": 2.5, "top": 3}]}
    put(str(tmp_path / "w"), "doc1.jsonl", [page, page | {"page": 2, "words": []}])
    put(str(tmp_path / "w"), "doc2.jsonl", [{"page": 1}])
    rows = {(r.document_id, r.page): r for r in spark.read.format("word_boxes").load(str(tmp_path / "w")).collect()}
    assert set(rows) == {("doc1", 1), ("doc1", 2), ("doc2", None)} and rows["doc2", None].error
    assert [tuple(w) for w in rows["doc1", 1].words] == [("Total", 1.0, 2.5, 3.0)] and rows["doc1", 2].words == []


def test_tools(spark):
    evidence = lambda **v: [{"name": k, "value": x} for k, x in v.items()]
    rows = [("d", "R1", f"FY{y}", date(2000 + y, 3, 31), True, o, "high", evidence(dso=v, gap=None)) for y, o, v in ((24, "passed", "80"), (25, "fired", "98"), (23, "insufficient_data", None))]
    rows += [("d", "R2", "FY25", date(2025, 3, 31), True, "passed", "low", evidence(x="1")), ("e", "R1", "FY25", date(2025, 3, 31), True, "fired", "low", evidence(x="1"))]
    outcomes = spark.createDataFrame(rows, "document_id string, rule_id string, period string, end_date date, is_anchor boolean, outcome string, severity string, evidence array<struct<name:string,value:string>>")
    rules = spark.createDataFrame([("R1", "Receivables", "They grow"), ("R2", "Other", "It may")], "rule_id string, title string, rationale string")
    told = lambda rule: tools.rule_detail(spark, outcomes, rules, "d", rule).first().detail
    assert told(" R1 ") == "rule_detail(R1): Receivables - They grow\n- FY23: insufficient_data\n- FY24: passed | dso = 80\n- FY25: fired | dso = 98"
    assert told("x' OR '1'='1") == "rule_detail(x' OR '1'='1): no such rule evaluated for this document"
    blocks = {r.rule_id: r.block for r in tools.rule_block(spark, outcomes, rules, "d", ["R1", "R2"]).collect()}
    assert blocks == {"R1": "R1 [HIGH] Receivables\n  evidence (FY25): dso = 98\n  history: FY23 insufficient_data, FY24 passed, FY25 fired\n  rationale: They grow"}
    assert tools.rule_block(spark, outcomes, rules, "d", []).collect() == []
    chunks = spark.createDataFrame([("k#a", "k", "Cash", "Signals", "cash falls " * 100), ("k#b", "k", "Cash", "Causes", "short"), ("m#a", "m", "Debt", "Signals", "interest coverage")], "chunk_id string, doc_id string, title string, heading string, text string")
    got = [r.block for r in tools.knowledge_sections(spark, chunks, ["m", "k", "m"], ["signals"]).collect()]
    assert got[0] == "[kb:m#a] Debt - Signals\ninterest coverage" and len(got) == 2 and got[1].endswith(" ...") and len(got[1]) == 900 + len("[kb:k#a] Cash - Signals\n ...")
    asked = spark.createDataFrame([(1, "interest coverage"), (2, "unheard")], "query int, query_text string")
    answers = {r.query: r.answer for r in tools.knowledge_search(spark, chunks, asked).collect()}
    assert answers[1] == "knowledge_search(interest coverage):\n[kb:m#a] Debt - Signals\ninterest coverage" and answers[2] == "no matches"
