"""Tables that outlive a run: documents, reports, findings, feedback, cohort samples, candidate rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TERMINAL = ("completed", "failed")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def save_report(latest: DataFrame, path: str) -> None:
    """Appends a JSON report for each document: its outcomes as an array."""
    rows = latest.groupBy("document_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("rule_id", "outcome", "severity", "period", "missing")))).alias("report"))
    append(rows.withColumn("created_at", F.current_timestamp()), path)


#: Partitions of a table of samples, by a hash of the document.
BUCKETS = 64


def save_findings(findings: DataFrame, candidates: DataFrame, path: str) -> None:
    """Appends findings and candidate rules, both with their analysis_id, to tables of their own beneath `path`."""
    for name, rows in (("findings", findings), ("rule_versions", candidates.withColumn("status", F.lit("proposed")))):
        append(rows.withColumn("created_at", F.current_timestamp()), f"{path}/{name}")


def record_samples(samples: DataFrame, path: str, documents: DataFrame | None = None) -> None:
    """Cohort samples of the documents at hand replace their earlier ones; running it again changes nothing.

    documents: (document_id) of all that were analysed, so that those without samples lose their old ones; else those of
    `samples`. Rows lie in `BUCKETS` partitions by a hash of the document; the touched ones are merged beside the table,
    then overwritten, so no reader's files go while they are read.
    """
    spark = samples.sparkSession
    bucket = F.pmod(F.xxhash64("document_id"), F.lit(BUCKETS)).cast("int")
    known = (samples if documents is None else documents).select("document_id").distinct()
    touched = [r["bucket"] for r in known.select(bucket.alias("bucket")).distinct().collect()]  # at most BUCKETS
    fresh = samples.withColumn("bucket", bucket)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(folder):
        old = spark.read.parquet(path).where(F.col("bucket").isin(touched)).withColumn("document_id", F.col("document_id").cast(samples.schema["document_id"].dataType))
        fresh = fresh.unionByName(old.join(known, "document_id", "left_anti"), allowMissingColumns=True)
    staging = f"{path.rstrip('/')}-staging-{uuid.uuid4().hex}"
    fresh.write.parquet(staging)
    merged = spark.read.schema(fresh.schema).parquet(staging)
    left = {r["bucket"] for r in merged.select("bucket").distinct().collect()}
    merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for b in set(touched) - left:
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={b}"), True)
    files.delete(spark._jvm.org.apache.hadoop.fs.Path(staging), True)


def load_samples(spark: SparkSession, path: str, sector: str, exclude_document: str) -> DataFrame:
    """A sector's samples without those of one document."""
    return spark.read.parquet(path).where((F.col("sector") == sector) & (F.col("document_id").cast("string") != exclude_document))


def statuses(findings: DataFrame, feedback: DataFrame) -> DataFrame:
    """Findings with the status that their last verdict gives; open without one."""
    last = feedback.groupBy("analysis_id", "finding_id").agg(F.max_by("verdict", F.struct("created_at", "id")).alias("verdict"))
    status = F.when(F.col("verdict") == "confirm", "confirmed").when(F.col("verdict") == "dismiss", "dismissed").otherwise("open")
    return findings.join(last, ["analysis_id", "finding_id"], "left").withColumn("status", status).drop("verdict")


def interrupted(analyses: DataFrame) -> DataFrame:
    """Analyses that a restart left queued or running are failed."""
    return analyses.withColumn("status", F.when(F.col("status").isin("queued", "running"), "failed").otherwise(F.col("status")))


def candidate_issues(candidates: DataFrame, known_rules: DataFrame, known_names: DataFrame) -> DataFrame:
    """(rule_id, reason) of candidates whose id is taken or that need a column nobody has."""
    taken = candidates.join(known_rules.select("rule_id"), "rule_id", "left_semi").select("rule_id", F.lit("the id is taken").alias("reason"))
    needs = candidates.select("rule_id", F.explode("needs").alias("name")).join(known_names.select("name"), "name", "left_anti")
    return taken.unionByName(needs.select("rule_id", F.concat(F.lit("unknown name "), "name").alias("reason")))
