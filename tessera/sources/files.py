"""File sources and sinks: judgment JSONL, logs with JSON inside, whole text files, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

JUDGMENT = """case_title string, court_name string, court_type string, neutral_citation string, reporter_citations array<string>,
judgment_date string, bench array<string>, act_sections array<string>, keywords array<string>, headnote string, disposition string,
full_text string, source_url string, _bad string"""


def judgments(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(judgments, rejected) of a JSONL path.

    Lines that are no JSON, or lack a title or a text, are rejected with the
    reason; blank lines are skipped.  Missing courts and lists get defaults, and
    a judgment has the SHA-256 of its text as ``content_hash``.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.withColumn("j", F.from_json("value", JUDGMENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    reason = F.when(F.col("j._bad").isNotNull(), "not JSON").when(blank("j.case_title"), "no title").when(blank("j.full_text"), "no text")
    judged = parsed.withColumn("reason", reason)
    fine = judged.filter("reason is null").select("j.*").drop("_bad")
    empty = F.array().cast("array<string>")
    fine = fine.withColumns(
        {
            "court_name": F.coalesce("court_name", F.lit("Unknown")),
            "court_type": F.coalesce("court_type", F.lit("HIGH_COURT")),
            "judgment_date": F.try_to_date("judgment_date"),
            **{c: F.coalesce(c, empty) for c in ("reporter_citations", "bench", "act_sections", "keywords")},
            "content_hash": F.sha2("full_text", 256),
        }
    )
    return fine, judged.filter("reason is not null").select("value", "reason")


def log_records(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Rows (time, level, step, ms, msg) of the JSON objects that log lines hold, not before ``since``."""
    found = spark.read.text(path).select(F.regexp_extract("value", r'(\{"level".*\})', 1).alias("j")).filter("j <> ''")
    rows = found.select(F.from_json("j", "level string, time string, step string, ms double, msg string").alias("r")).select("r.*")
    rows = rows.withColumn("time", F.try_to_timestamp("time")).filter("time is not null")
    return rows.filter(F.col("time") >= F.lit(since).cast("timestamp")) if since else rows


def text_files(spark: SparkSession, pattern: str) -> DataFrame:
    """Rows (name, text) of whole files."""
    files = spark.read.text(pattern, wholetext=True)
    return files.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), F.col("value").alias("text"))


def write_json(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON lines, in folders by the given columns."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def rebuild_children(df: DataFrame, path: str, parent: str) -> None:
    """Parquet with a folder for each parent, replacing those of the parents in ``df`` only."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(parent).parquet(path)


def mock_case(cnr):
    """Deterministic mock fields of a case number: status and hearing offset by the sum of its character codes."""
    from tessera.functions.text import char_code_sum

    seed = char_code_sum(cnr)
    status = F.element_at(F.array(*map(F.lit, ("PENDING", "DISPOSED", "TRANSFERRED"))), (seed % 3 + 1).cast("int"))
    return F.struct(cnr.alias("cnr"), status.alias("status"), (seed % 90).alias("days_to_hearing"))
