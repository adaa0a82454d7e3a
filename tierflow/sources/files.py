"""Readers and writers for prompt, sample, transcript and cost-log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tierflow import vocab as V
from tierflow.functions import scoring as S, text as T

PROMPT_SCHEMA = ("text STRING, prompt STRING, instruction STRING, label STRING, source STRING, "
                 "_corrupt_record STRING")
SAMPLE_SCHEMA = ("id STRING, source STRING, raw_text STRING, context MAP<STRING,STRING>, "
                 "complexity_hint STRING, intent_type STRING, domain STRING, label STRING, "
                 "confidence DOUBLE, created_at TIMESTAMP")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """Labelled prompts from JSON lines: first non-empty of text, prompt and instruction;
    malformed and blank lines are skipped, missing labels come from the formula."""
    d = spark.read.schema(PROMPT_SCHEMA).option("mode", "PERMISSIVE").json(path)
    full = lambda c: F.nullif(F.col(c), F.lit(""))
    d = d.where(F.col("_corrupt_record").isNull()).select(
        T.strip(F.coalesce(full("text"), full("prompt"), full("instruction"))).alias("text"),
        full("label").alias("given"), F.coalesce("source", F.lit("custom-jsonl")).alias("source"))
    d = S.label_signals(d.where(F.col("text") != ""), "text", "formula")
    return d.select("text", F.coalesce("given", "formula").alias("label"), "source")


def read_score_input(spark: SparkSession, path: str) -> DataFrame:
    """Prompts to score: the ``prompt`` key of a JSON line, else the line itself."""
    line = T.strip(F.col("value"))
    return spark.read.text(path).where(line != "").select(
        F.coalesce(F.get_json_object("value", "$.prompt"), line).alias("text"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Typed samples; a line that does not fit the schema fails the job."""
    return spark.read.schema(SAMPLE_SCHEMA).option("mode", "FAILFAST").json(path)


def scan_corpus(spark: SparkSession, root: str, exclude=V.SCAN_EXCLUDED_DIRS, max_kb: int | None = None) -> DataFrame:
    """Text chunks of the files below a folder. Folder, suffix and size (if ``max_kb`` is given) are checked on the
    file listing, before contents are read."""
    parts = F.split("path", "/")
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    f = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
         .where((F.lit(True) if max_kb is None else F.col("length") <= max_kb * 1024)
                & ~F.arrays_overlap(parts, F.array(*[F.lit(e) for e in exclude]))
                & ~suffix.isin(V.SCAN_BINARY_SUFFIXES)))
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    f = f.select("path", suffix.alias("suffix"), text.alias("text"))
    c = T.chunk_text(f, "text", "suffix")
    return c.select(T.file_sample_id(F.col("path"), F.col("chunk_pos")).alias("id"),
                    F.lit("workspace-scanner").alias("source"), F.col("chunk").alias("raw_text"),
                    F.create_map(F.lit("file"), F.col("path"), F.lit("chunk"), F.col("chunk_pos").cast("string"))
                    .alias("context"))


def session_turns(conv: DataFrame, max_turns: int | None = None, max_chars: int | None = None) -> DataFrame:
    """User turns of transcripts as samples; ``turn`` counts all messages from 0. Whole turns unless the limits are given."""
    d = conv.where((F.col("role") == "user") & (F.length("text") >= 10))
    if max_turns is not None:
        d = d.where(F.col("turn") < max_turns)
    text = F.col("text") if max_chars is None else F.substring("text", 1, max_chars)
    return d.select(F.format_string("sess_%s_%04d", F.col("conv_id").cast("string"), F.col("turn")).alias("id"),
                    F.lit("session-miner").alias("source"), text.alias("raw_text"),
                    "conv_id", "turn")


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_cost_log(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Appends to a log with one folder per day."""
    df.withColumn("date", F.date_format(ts, "yyyy-MM-dd")).write.mode("append").partitionBy("date").parquet(path)


def read_cost_log(spark: SparkSession, path: str, date: str) -> DataFrame:
    """One day; other days' folders are not listed into the scan."""
    return spark.read.parquet(path).where(F.col("date") == F.lit(date).cast("date"))
