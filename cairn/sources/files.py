"""Readers of facts from files, and sinks. All reading goes through Spark, so any store it knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def timing_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, line_no, line) of timing dumps below a folder; a dump is one module's, so it is read whole."""
    d = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*timings").text(path, wholetext=True)
    lines = F.posexplode(F.split("value", "\n")).alias("line_no", "line")
    return d.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"), lines)


def baseline(spark: SparkSession, path: str, limit: int = 2_000_000) -> DataFrame:
    """(path, hash, content, too_large) of the files below a folder; large ones without content."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return d.select("path", F.sha2("content", 256).alias("hash"), F.when(F.col("length") < limit, F.col("content")).alias("content"), (F.col("length") >= limit).alias("too_large"))


def package_records(spark: SparkSession, path: str) -> DataFrame:
    """Records `key: value`, separated by lines of ---, as maps."""
    d = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"(?m)^---\s*$")).alias("record")).where("trim(record) <> ''")
    return d.select(F.str_to_map(F.regexp_replace(F.regexp_replace("record", r"^\s+|\s+$", ""), r"\n\s+", " "), F.lit("\n"), F.lit(":")).alias("fields")).select(F.trim(F.col("fields")["name"]).alias("package"), F.trim(F.col("fields")["id"]).alias("unit_id"), (F.trim(F.col("fields")["exposed"]) == "True").alias("exposed"))


def environment_lines(spark: SparkSession, path: str) -> DataFrame:
    """Directives of an environment file: (line, directive, argument); comments and blank lines go."""
    d = spark.read.text(path).select(F.trim("value").alias("line")).where("line <> '' and not startswith(line, '--')")
    return d.select("line", F.regexp_extract("line", r"^(\S+)", 1).alias("directive"), F.trim(F.regexp_replace("line", r"^\S+", "")).alias("argument"))


def session_log(spark: SparkSession, path: str) -> DataFrame:
    """Session entries of newline-delimited JSON; malformed lines are ignored."""
    kind = "seq long, id string, role string, type string, content string, tool_call_id string, tool_name string, _corrupt_record string"
    return spark.read.schema(kind).json(path).where("_corrupt_record is null").drop("_corrupt_record")


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_markdown(df: DataFrame, path: str, title: str) -> None:
    """One bullet per row below a title, in the rows' order."""
    line = F.concat(F.lit("* "), F.concat_ws(", ", *(F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in df.columns)))
    df.select(line.alias("value")).write.option("header", "false").text(path)
