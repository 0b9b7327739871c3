"""Readers: JSON lines, whole log files, JSON documents, source folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# --- fixed values: field names and types of the row formats -----------------
LABELLED_ROW = (
    "log string, label string, explanation string, confidence double, label_source string, "
    "module string, mutation_id string, tier int, is_inert boolean"
)
AUGMENTED_ROW = LABELLED_ROW + ", augmented boolean, aug_id int"
NATURAL_ROW = "id string, source string, log string, label string, notes string"
AB_SAMPLE = (
    "id string, bug_type string, module string, manual_minutes double, ai_minutes double, "
    "manual_log_lines_read int, ai_log_lines_read int, engineer_confidence_manual int, "
    "engineer_confidence_ai int"
)


def read_jsonl(spark: SparkSession, path: str, schema: str = LABELLED_ROW) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped, broken ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_log_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, log): every file is one record."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").alias("log")
    )


def read_json_array(spark: SparkSession, path: str, schema: str = AB_SAMPLE) -> DataFrame:
    """Rows of JSON documents, each an array of objects or one object; many documents per task.

    Documents are taken apart as variants. A broken document or a value that is not of its
    column's type fails the query; a missing member is null.
    """
    document = F.parse_json(F.col("value"))
    members = F.coalesce(F.try_variant_get(document, "$", "array<variant>"), F.array(document))
    rows = spark.read.text(path, wholetext=True).select(F.explode(members).alias("row"))
    fields = StructType.fromDDL(schema).fields
    return rows.select(
        *[F.variant_get("row", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in fields]
    )


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A report, or None when the path is absent (asked of the path's own file system)."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return read_json_array(spark, path, schema) if files.exists(target) else None


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """(module, text): one row per source file, named after the file."""
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return spark.read.text(path, wholetext=True).select(
        name.alias("module"), F.col("value").alias("text")
    )


def missing_modules(configured: DataFrame, found: DataFrame) -> DataFrame:
    """Configured modules without a source: the skip list of a run."""
    return configured.join(found.select("module"), "module", "left_anti")
