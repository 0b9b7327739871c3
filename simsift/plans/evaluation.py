"""Registered queries: evaluation, A/B statistics, dashboard inputs, learned classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.generated import lenient_label
from ..functions.textforms import rounded
from ..operators import ab as AB
from ..operators import evaluate as EV
from ..operators import triage as OT
from ..operators.learn import fit_and_score
from . import derived as D
from . import oracle as S
from .registry import query

_SCORED = f"WITH {S._SIM}, {S.verdicts('sim')}, sc AS (SELECT id, label AS expected, v_label AS predicted, v_conf AS confidence FROM cls)"
_RATES = """count(*) AS total, count(*) FILTER (predicted = expected) AS correct,
  CASE WHEN count(*) > 0 THEN count(*) FILTER (predicted = expected) / count(*) ELSE 0.0 END AS accuracy,
  CASE WHEN count(*) > 0 THEN count(*) FILTER (predicted = 'Unknown') / count(*) ELSE 0.0 END AS unknown_rate"""


def scored(spark, sf):
    return EV.with_prediction(D.sim_logs(spark, sf))


@query("agg1_accuracy", "AGG-1", f"{_SCORED} SELECT {_RATES} FROM sc")
def accuracy(spark, sf):
    return EV.accuracy_report(scored(spark, sf))


@query("agg1_accuracy_of_nothing", "AGG-1", f"{_SCORED} SELECT {_RATES} FROM sc WHERE expected = 'no such label'")
def accuracy_of_nothing(spark, sf):
    return EV.accuracy_report(scored(spark, sf).filter("expected = 'no such label'"))


@query("agg2_confusion", "AGG-2", f"{_SCORED} SELECT expected, predicted, count(*) AS n FROM sc GROUP BY ALL")
def confusion(spark, sf):
    return EV.confusion(scored(spark, sf))


@query("srt2_most_common", "SRT-2", f"""{_SCORED}, c AS (SELECT expected, predicted, count(*) AS n FROM sc GROUP BY ALL)
SELECT expected, string_agg(predicted || '=' || n::VARCHAR, '; ' ORDER BY n DESC, predicted) AS row FROM c GROUP BY expected""")
def most_common(spark, sf):
    document = EV.confusion_document(EV.confusion(scored(spark, sf)))
    rows = document.select(F.explode("confusion").alias("expected", "counts"))
    pair = lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    return rows.select(
        "expected", F.array_join(F.transform(F.map_entries("counts"), pair), "; ").alias("row")
    )


@query("agg3_details", "AGG-3", f"""{_SCORED} SELECT id::VARCHAR AS id, expected, predicted, confidence,
  expected = predicted AS correct FROM sc""")
def details(spark, sf):
    rows = scored(spark, sf).withColumn("correct", F.col("expected") == F.col("predicted"))
    return EV.details(rows, "correct")


@query("agg4_accuracy_ignoring_case", "AGG-4", f"""WITH {S._SIM}, {S._gen()}, p AS (SELECT label AS expected,
  coalesce(CASE WHEN json_valid(b) THEN b::JSON->>'$.label' END, 'Unknown') AS predicted FROM sim JOIN
  (SELECT id, CASE WHEN strpos(generated_text, '}}') > 0 THEN substr(generated_text, strpos(generated_text, '{{'),
    length(generated_text) - strpos(reverse(generated_text), '}}') + 2 - strpos(generated_text, '{{')) END AS b FROM gen) USING (id))
SELECT count(*) AS total, count(*) FILTER (lower(predicted) = lower(expected)) AS correct,
  count(*) FILTER (lower(predicted) = lower(expected)) / count(*) AS accuracy,
  count(*) FILTER (predicted = 'Unknown') / count(*) AS unknown_rate FROM p""")
def accuracy_ignoring_case(spark, sf):
    logs = D.sim_logs(spark, sf)
    rows = EV.join_predictions(logs.select("id", F.col("label").alias("expected")), D.generated(logs))
    rows = rows.withColumn("predicted", lenient_label(F.col("generated_text")))
    return EV.accuracy_report(rows, EV.ignoring_case())


@query("agg5_speed", "AGG-5", f"""WITH {S._SPEED} SELECT printf('%.3f', avg(elapsed_s))::DOUBLE AS avg_latency_s,
  printf('%.1f', avg(CASE WHEN elapsed_s > 0 THEN n_tokens / elapsed_s ELSE 0.0 END))::DOUBLE AS avg_tokens_per_sec FROM speed""")
def speed(spark, sf):
    return EV.speed_report(D.speed_runs(spark, sf))


@query("agg6_label_distribution", "AGG-6", f"WITH {S._SIM} SELECT label, count(*) AS n FROM sim GROUP BY label")
def label_distribution(spark, sf):
    return EV.label_distribution(D.sim_logs(spark, sf)).orderBy(F.desc("n"), "label")


@query("agg7_median", "AGG-7", "SELECT l_shipdate::DATE::VARCHAR AS day, count(*) AS n, median(l_extendedprice) AS median FROM lineitem GROUP BY ALL")
def median(spark, sf):
    rows = D.table(spark, sf, "lineitem").select(
        F.col("l_shipdate").cast("date").cast("string").alias("day"), F.col("l_extendedprice").alias("x")
    )
    return AB.order_statistics(rows, ["day"]).select("day", "n", "median")


_P95 = "list_extract(list_sort(list({x})), least(count(*) - 1, round_even(0.95::DOUBLE * (count(*) - 1), 0)::BIGINT) + 1)"


@query("agg8_p95", "AGG-8", f"""SELECT event_type, user_id, count(*) AS n, {_P95.format(x='value')} AS p95
  FROM events WHERE value IS NOT NULL GROUP BY ALL""")
def p95(spark, sf):
    rows = D.table(spark, sf, "events").select("event_type", "user_id", F.col("value").alias("x"))
    return AB.order_statistics(rows, ["event_type", "user_id"]).select("event_type", "user_id", "n", "p95")


def _ab_sql(by: str) -> str:
    head, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    return f"""WITH {S._AB}, r AS (SELECT {head}count(*) AS samples, median(manual_minutes) AS manual_p50_min,
  median(ai_minutes) AS ai_p50_min, {_P95.format(x='manual_minutes')} AS manual_p95_min,
  {_P95.format(x='ai_minutes')} AS ai_p95_min FROM ab {group})
SELECT *, CASE WHEN manual_p50_min <> 0 THEN (manual_p50_min - ai_p50_min) / manual_p50_min ELSE 0.0 END AS time_reduction_p50 FROM r"""


_AB_ALL = _ab_sql("")


@query("agg9_ab_report", "AGG-9 AGG-7 AGG-8", _AB_ALL)
def ab_report(spark, sf):
    return AB.ab_report(D.ab_samples(spark, sf))


@query("agg9_ab_report_by_group", "AGG-9", _ab_sql("grp"))
def ab_report_by_group(spark, sf):
    return AB.ab_report(D.ab_samples(spark, sf), ["grp"])


@query("agg10_mean_accuracy", "AGG-10", f"""{_SCORED}, r AS (SELECT {_RATES} FROM sc UNION ALL SELECT {_RATES} FROM sc WHERE confidence >= 0.7)
SELECT avg(accuracy) AS mean_accuracy FROM r""")
def mean_accuracy(spark, sf):
    rows = scored(spark, sf)
    sure = EV.accuracy_report(rows.filter("confidence >= 0.7D"))
    return EV.mean_accuracy(EV.accuracy_report(rows), sure)


@query("jn5_joined_predictions", "JN-5", f"""WITH {S._SIM}, {S._gen()}, {S.model_read('gen')}, {S.verdicts('sim')}
SELECT s.id, s.label AS expected, CASE WHEN m_ok THEN m_label ELSE v_label END AS predicted
FROM sim s JOIN mod USING (id) JOIN cls ON cls.id = s.id""")
def joined_predictions(spark, sf):
    logs = D.sim_logs(spark, sf)
    model = OT.model_or_rules(logs, D.generated(logs))
    predicted = model.select("id", F.col("verdict.label").alias("predicted"))
    return EV.join_predictions(logs.select("id", F.col("label").alias("expected")), predicted)


@query("ml1_learned_classifier", "ML-1", f"""WITH {S._SIM}, {S.split_of('sim', 'id::VARCHAR')}
SELECT split, count(*) AS total, true AS learned FROM spl GROUP BY split""")
def learned_classifier(spark, sf):
    """Rows per split, and whether a linear text classifier trained on the train split gets most of them right."""
    scored = fit_and_score(D.sim_logs(spark, sf), ["id"])
    return scored.select("split", "total", (F.col("accuracy") >= 0.5).alias("learned"))
