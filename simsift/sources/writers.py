"""Writers: JSON lines, splits, one-document reports, per-row text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .logfiles import LogFiles


def write_jsonl(rows: DataFrame, path: str, **options) -> None:
    """JSON lines; null fields are left out, non-ASCII text stays as it is."""
    rows.write.mode("overwrite").options(**options).json(path)


def write_splits(rows: DataFrame, path: str) -> None:
    """One folder per split value."""
    rows.write.mode("overwrite").partitionBy("split").json(path)


def report_document(report: DataFrame) -> Column:
    return F.to_json(F.struct(*report.columns)).alias("value")


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as one JSON document."""
    report.select(report_document(report)).coalesce(1).write.mode("overwrite").text(path)


def write_text_per_row(rows: DataFrame, text: str, path: str, names: tuple[str, ...] = ("module", "mutation_id")) -> None:
    """One file per row, by default named ``{module}_{mutation_id}.log``, many per task, in one folder per task.

    Each text ends with one line break. A null text is an empty one, a null name an empty part of
    the file's. Two rows of one name in a task, or a name that holds a slash, are errors.
    """
    rows.sparkSession.dataSource.register(LogFiles)
    name = F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in names])
    rows.select(name.alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text")).write.format(LogFiles.name()).mode(
        "overwrite"
    ).save(path)


def write_lines(lines: DataFrame, path: str) -> None:
    """(line_no, line) as one text file; meant for short, bounded texts."""
    lines.coalesce(1).sortWithinPartitions("line_no").select("line").write.mode("overwrite").text(path)


def write_json_arrays(rows: DataFrame, path: str, per_document: int = 10_000) -> None:
    """JSON-array documents of at most ``per_document`` rows, one per file."""
    numbered = rows.select(F.struct(*rows.columns).alias("row"), F.monotonically_increasing_id().alias("n"))
    parts = numbered.groupBy(F.floor(F.col("n") / per_document).alias("document")).agg(F.collect_list("row").alias("rows"))
    parts.select(F.to_json("rows").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
