"""Registered queries: sources and sinks, each written to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.classify import with_verdict
from ..operators import ab as AB
from ..operators import evaluate as EV
from ..operators import mutate as MU
from ..operators import split as SP
from ..operators.dashboard import dashboard_lines
from ..session import scratch_path
from ..sources import readers as R
from ..sources import writers as W
from . import derived as D
from . import oracle as S
from .evaluation import _AB_ALL, _RATES, _SCORED, scored
from .registry import query


@query("src1_jsonl_rows", "SRC-1", f"WITH {S._SIM} SELECT id, log, label, module FROM sim")
def jsonl_rows(spark, sf):
    path = scratch_path(spark, "rows")
    W.write_jsonl(D.sim_logs(spark, sf), path)
    return R.read_jsonl(spark, path, "id bigint, log string, label string, module string")


@query("src2_log_files", "SRC-2 CLS-5", f"""WITH d AS (SELECT item_id AS id, text || chr(10) AS log FROM benchmark), {S.verdicts('d')}
SELECT id, length(log) AS n_chars, md5(log) AS log_md5, v_label AS label FROM cls""")
def log_files(spark, sf):
    path = scratch_path(spark, "logs")
    D.table(spark, sf, "benchmark").select(
        F.lit("log").alias("module"), F.col("item_id").alias("mutation_id"), "text"
    ).transform(lambda rows: W.write_text_per_row(rows, "text", path) or rows)
    files = R.read_log_files(spark, f"{path}/*")
    item = F.regexp_extract("file", r"/log_(\d+)\.log$", 1).cast("bigint")
    return with_verdict(files).select(
        item.alias("id"), F.length("log").alias("n_chars"),
        F.md5(F.col("log").cast("binary")).alias("log_md5"), F.col("verdict.label").alias("label"),
    )


@query("src3_json_arrays", "SRC-3", f"WITH {S._AB} SELECT grp, manual_minutes, ai_minutes FROM ab")
def json_arrays(spark, sf):
    path = scratch_path(spark, "samples")
    W.write_json_arrays(D.ab_samples(spark, sf), path)
    return R.read_json_array(spark, path, "grp string, manual_minutes double, ai_minutes double")


@query("src4_optional_report", "SRC-4", f"""{_SCORED} SELECT 'eval' AS report, {_RATES} FROM sc""")
def optional_report(spark, sf):
    kept, absent = scratch_path(spark, "eval"), scratch_path(spark, "absent")
    W.write_report(EV.accuracy_report(scored(spark, sf)), kept)
    schema = "total bigint, correct bigint, accuracy double, unknown_rate double"
    found = {"eval": kept, "natural": absent}
    rows = None
    for name, path in found.items():
        report = R.read_optional(spark, path, schema)
        if report is not None:
            named = report.select(F.lit(name).alias("report"), "*")
            rows = named if rows is None else rows.unionByName(named)
    return rows


@query("src5_source_files", "SRC-5", """SELECT 'p' || page_id::VARCHAR AS module, md5(html || chr(10)) AS text_md5, true AS found FROM pages
UNION ALL SELECT 'b' || item_id::VARCHAR, NULL, false FROM benchmark""")
def source_files(spark, sf):
    path = scratch_path(spark, "sources")
    name = F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("module")
    W.write_text_per_row(D.table(spark, sf, "pages").select(name, "html"), "html", path, ("module",))
    found = R.read_sources(spark, f"{path}/*")
    other = F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("module")
    configured = D.table(spark, sf, "pages").select(name).unionByName(D.table(spark, sf, "benchmark").select(other))
    skipped = R.missing_modules(configured, found)
    return found.select(
        "module", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.lit(True).alias("found")
    ).unionByName(skipped.select("module", F.lit(None).cast("string").alias("text_md5"), F.lit(False).alias("found")))


@query("snk1_jsonl_text", "SNK-1", """SELECT doc_id, lang = 'en' AS has_lang,
  length(regexp_replace(text, '[\x00-\x7f]', '', 'g')) AS n_beyond_ascii, md5(text) AS text_md5 FROM documents""")
def jsonl_text(spark, sf):
    path = scratch_path(spark, "documents")
    rows = D.table(spark, sf, "documents").select(
        "doc_id", "text", F.when(F.col("lang") == "en", F.col("lang")).alias("lang")
    )
    W.write_jsonl(rows, path)
    back = spark.read.text(path)
    body = F.from_json("value", "doc_id bigint, text string")
    return back.select(
        body["doc_id"].alias("doc_id"), F.contains("value", F.lit('"lang":')).alias("has_lang"),
        # counted in the line itself: a character written as an escape would be missing
        F.length(F.regexp_replace("value", r"[\x00-\x7f]", "")).alias("n_beyond_ascii"),
        F.md5(body["text"].cast("binary")).alias("text_md5"),
    )


@query("snk2_split_folders", "SNK-2 WIN-2", f"""WITH {S._SIM}, {S.split_of('sim', 'id::VARCHAR')}
SELECT split, label, count(*) AS n FROM spl GROUP BY ALL""")
def split_folders(spark, sf):
    path = scratch_path(spark, "splits")
    W.write_splits(SP.stratified_split(D.sim_logs(spark, sf), ["id"]), path)
    back = spark.read.schema("label string, split string").json(path)
    return back.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"))


@query("snk3_report_document", "SNK-3", _AB_ALL)
def report_document(spark, sf):
    path = scratch_path(spark, "ab")
    report = AB.ab_report(D.ab_samples(spark, sf))
    W.write_report(report, path)
    return spark.read.schema(report.schema).json(path)


_TWO = ["reset_inversion", "overflow_guard_removal"]


@query("snk4_text_per_row", "SNK-4", S.all_mutants() + f"""
SELECT source_id, mutation_id, md5(mutated || chr(10)) AS file_md5 FROM mutants WHERE mutation_id IN ({', '.join(map(S.q, _TWO))})""")
def text_per_row(spark, sf):
    path = scratch_path(spark, "mutants")
    rows = MU.mutate(D.sources(spark, sf), ids=_TWO)
    W.write_text_per_row(rows.withColumn("module", F.col("source_id")), "mutated_source", path)
    files = R.read_log_files(spark, f"{path}/*")
    return files.select(
        F.regexp_extract("file", r"/(\d+)_\w+\.log$", 1).cast("bigint").alias("source_id"),
        F.regexp_extract("file", r"/\d+_(\w+)\.log$", 1).alias("mutation_id"),
        F.md5(F.col("log").cast("binary")).alias("file_md5"),
    )


def _quality_sql(title: str, rel: str) -> str:
    return f"""SELECT {S.q(title)} AS line UNION ALL
SELECT '- Accuracy: ' || printf('%.1f', 100.0 * accuracy) || '% (' || correct || '/' || total || ')' FROM {rel} UNION ALL
SELECT '- Unknown Rate: ' || printf('%.1f', 100.0 * unknown_rate) || '%' FROM {rel} UNION ALL SELECT '' """


_MINUTES = " UNION ALL ".join(
    f"SELECT '- {text}: ' || printf('%.2f', {col}) FROM a" for text, col in (
        ("Median Manual Minutes", "manual_p50_min"), ("Median AI Minutes", "ai_p50_min"),
        ("P95 Manual Minutes", "manual_p95_min"), ("P95 AI Minutes", "ai_p95_min"))
)


@query("snk5_dashboard", "SNK-5 AGG-10", f"""{_SCORED}, e AS (SELECT {_RATES} FROM sc),
nat AS (SELECT {_RATES} FROM sc WHERE confidence >= 0.7), a AS ({_AB_ALL})
SELECT '# Metrics Dashboard' AS line UNION ALL SELECT '' UNION ALL {_quality_sql('## Model Eval', 'e')}
UNION ALL {_quality_sql('## Natural Bug Sanity Check', 'nat')}
UNION ALL SELECT '## A/B Pilot' UNION ALL SELECT '- Samples: ' || samples FROM a UNION ALL {_MINUTES}
UNION ALL SELECT '- Median Time Reduction: ' || printf('%.1f', 100.0 * time_reduction_p50) || '%' FROM a UNION ALL SELECT ''
UNION ALL SELECT '## Portfolio Health' UNION ALL SELECT '- Mean Accuracy Across Available Reports: ' ||
  printf('%.1f', 100.0 * (e.accuracy + nat.accuracy) / 2) || '%' FROM e, nat UNION ALL SELECT ''
UNION ALL SELECT '_Generated from the stored reports._'""")
def dashboard(spark, sf):
    path = scratch_path(spark, "dashboard")
    rows = scored(spark, sf)
    lines = dashboard_lines(
        spark, EV.accuracy_report(rows), EV.accuracy_report(rows.filter("confidence >= 0.7D")),
        AB.ab_report(D.ab_samples(spark, sf)),
    )
    W.write_lines(lines, path)
    return spark.read.text(path).withColumnRenamed("value", "line")
