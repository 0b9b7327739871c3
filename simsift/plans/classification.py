"""Registered queries: projections, text fields, classification, generated text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import formats as FM
from ..functions import generated as G
from ..functions import logfields as LF
from ..functions import masking as K
from ..functions import triage as TR
from ..functions.classify import classify_log, with_verdict
from ..functions.draws import fill, with_draws
from ..functions.logparser import with_parsed_label
from ..functions.sqlfunction import create_classifier
from ..functions.textforms import fixed, percent
from ..operators import triage as OT
from ..operators.defaults import with_defaults
from ..operators.pairs import training_pairs
from ..streaming.breaker import replay_breaker, route
from . import derived as D
from . import oracle as S
from .registry import query

RECOVERY_S = 6 * 3600
GATE = 0.85


def _verdict_columns(df: DataFrame, *keep: str, struct: str = "verdict") -> DataFrame:
    return df.select(*keep, f"{struct}.label", f"{struct}.explanation", f"{struct}.confidence")


# ---- projections and filters --------------------------------------------------

@query("prj1_size_reject", "PRJ-1", f"""WITH {S._LONG} SELECT id, length(log) AS n_chars, 400 AS status,
  {S.q(FM.TOO_LONG_DETAIL)} AS detail FROM long WHERE length(log) > 100000""")
def size_reject(spark, sf):
    rows = D.long_logs(spark, sf).filter(TR.too_long(F.col("log")))
    return rows.select(
        "id", F.length("log").alias("n_chars"), F.lit(400).alias("status"),
        F.lit(FM.TOO_LONG_DETAIL).alias("detail"),
    )


@query("prj2_tail_cut", "PRJ-2", f"""WITH {S._LONG}, c AS (SELECT id, {S.cut('log')} AS cut FROM long)
SELECT id, length(cut) AS n_chars, md5(cut) AS cut_md5, {S.cut('cut')} = cut AS stable FROM c""")
def tail_cut(spark, sf):
    cut = D.long_logs(spark, sf).withColumn("cut", TR.keep_tail(F.col("log")))
    return cut.select(
        "id", F.length("cut").alias("n_chars"), F.md5(F.col("cut").cast("binary")).alias("cut_md5"),
        (TR.keep_tail(F.col("cut")) == F.col("cut")).alias("stable"),
    )


_g = S.gated(GATE)


@query("prj3_confidence_gate", "PRJ-3", f"""WITH {S._SIM}, {S.verdicts('sim')}
SELECT id, {_g[0]} AS label, {_g[1]} AS explanation, {_g[2]} AS confidence FROM cls""")
def confidence_gate(spark, sf):
    rows = with_verdict(D.sim_logs(spark, sf))
    return _verdict_columns(rows.withColumn("verdict", TR.gate(F.col("verdict"), GATE)), "id")


@query("prj4_missing_defaults", "PRJ-4", """SELECT event_id,
  coalesce(CASE WHEN event_type <> 'click' THEN event_type END, 'Unknown') AS label,
  coalesce(CASE WHEN user_id % 3 > 0 THEN props END, '') AS log,
  coalesce(CASE WHEN user_id % 4 > 0 THEN user_id::VARCHAR END, 'unknown') AS id,
  coalesce(CASE WHEN user_id % 5 > 0 THEN value END, 1.0) AS confidence FROM events""")
def missing_defaults(spark, sf):
    user = F.col("user_id")
    return D.table(spark, sf, "events").select(
        "event_id",
        F.coalesce(F.when(F.col("event_type") != "click", F.col("event_type")), F.lit("Unknown")).alias("label"),
        F.coalesce(F.when(user % 3 > 0, F.col("props")), F.lit("")).alias("log"),
        F.coalesce(F.when(user % 4 > 0, user.cast("string")), F.lit("unknown")).alias("id"),
        F.coalesce(F.when(user % 5 > 0, F.col("value")), F.lit(1.0)).alias("confidence"),
    )


_GAPS = """SELECT event_id, event_id AS n, CASE WHEN event_type <> 'click' THEN event_type END AS label,
  CASE WHEN user_id % 3 > 0 THEN props END AS log, CASE WHEN user_id % 4 > 0 THEN user_id::VARCHAR END AS id,
  CASE WHEN user_id % 5 > 0 THEN value END AS confidence FROM events"""
_IDS = {"natural": "coalesce(id, 'unknown')", "evaluation": "coalesce(id, 'test_' || idx)", "benchmark": "idx::VARCHAR"}


@query("prj4_defaults_by_use", "PRJ-4", f"WITH g AS (SELECT *, row_number() OVER (ORDER BY n) - 1 AS idx FROM ({_GAPS}))"
       + " UNION ALL ".join(f""" SELECT {S.q(use)} AS use, event_id, {i} AS id, coalesce(label, 'Unknown') AS label,
  coalesce(log, '') AS log, coalesce(confidence, 0.0) AS confidence FROM g""" for use, i in _IDS.items()))
def defaults_by_use(spark, sf):
    user = F.col("user_id")
    rows = D.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_type") != "click", F.col("event_type")).alias("label"),
        F.when(user % 3 > 0, F.col("props")).alias("log"), F.when(user % 4 > 0, user.cast("string")).alias("id"),
        F.when(user % 5 > 0, F.col("value")).alias("confidence"),
    )
    parts = [with_defaults(rows, use, ["event_id"]).withColumn("use", F.lit(use)) for use in _IDS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_PROMPT = f"{S.q(FM.PROMPT_HEAD)} || log || {S.q(FM.PROMPT_TAIL)}"
_TARGET = """'{"label":"' || label || '","explanation":"' || v_text || '","confidence":' || v_conf || '}'"""


@query("prj5_prompt", "PRJ-5", f"WITH {S._SIM} SELECT id, {_PROMPT} AS prompt FROM sim")
def prompt(spark, sf):
    return D.sim_logs(spark, sf).select("id", TR.prompt(F.col("log")).alias("prompt"))


def _labelled(spark, sf):
    rows = with_verdict(D.sim_logs(spark, sf))
    return rows.select("id", "log", "label", "verdict.explanation", "verdict.confidence")


@query("prj6_target_json", "PRJ-6",
       f"WITH {S._SIM}, {S.verdicts('sim')} SELECT id, {_TARGET} AS target FROM cls")
def target_json(spark, sf):
    target = TR.target_json(F.col("label"), F.col("explanation"), F.col("confidence"))
    return _labelled(spark, sf).select("id", target.alias("target"))


@query("prj7_training_pairs", "PRJ-7", f"""WITH {S._SIM}, {S.verdicts('sim')}, p AS (
  SELECT id, {_PROMPT} AS prompt, {_TARGET} AS target FROM cls)
SELECT id, prompt, target, '<s>[INST] ' || prompt || ' [/INST]' || chr(10) || target || '</s>' AS text FROM p""")
def instruct_pairs(spark, sf):
    return training_pairs(_labelled(spark, sf), "id")


# ---- text fields ----------------------------------------------------------------

@query("txt1_assertion_id", "TXT-1", f"WITH {S._SIM} SELECT id, {S.assert_id('log')} AS assert_id FROM sim")
def assertion_id(spark, sf):
    return D.sim_logs(spark, sf).select("id", LF.assertion_id(F.col("log")).alias("assert_id"))


@query("txt2_signal_dump", "TXT-2", f"WITH {S._SIM} SELECT id, {S.dump('log')} AS signals FROM sim")
def signal_dump(spark, sf):
    return D.sim_logs(spark, sf).select("id", LF.signal_dump(F.col("log")).alias("signals"))


@query("txt3_cycle", "TXT-3",
       f"WITH {S._SIM} SELECT id, {S.cycle('log')} AS cycle, {S.at_cycle('log')} AS at_cycle FROM sim")
def cycle(spark, sf):
    return D.sim_logs(spark, sf).select(
        "id", LF.cycle_number(F.col("log")).alias("cycle"), LF.at_cycle(F.col("log")).alias("at_cycle")
    )


@query("txt4_structured_fields", "TXT-4", f"""WITH {S._SIM}, b AS (SELECT id, {S.body('log')} AS body FROM sim),
e AS (SELECT id, body, unnest(list_filter(string_split(body, '|'), lambda p: contains(p, '='))) AS part FROM b)
SELECT DISTINCT id, trim(split_part(part, '=', 1)) AS key,
  {S.field('body', 'X').replace("= 'X'", "= trim(split_part(part, '=', 1))")} AS value FROM e""")
def structured_fields(spark, sf):
    fields = LF.structured_fields(F.col("log"))
    return D.sim_logs(spark, sf).select("id", F.explode(fields).alias("key", "value"))


@query("txt5_noise_free", "TXT-5", f"WITH {S._SIM} SELECT id, {S.noise_free('log')} AS text FROM sim")
def noise_free(spark, sf):
    return D.sim_logs(spark, sf).select("id", LF.normalise_noise(F.col("log")).alias("text"))


@query("txt6_behaviour_hash", "TXT-6",
       f"WITH {S._SIM} SELECT id, sha256({S.noise_free('log')}) AS hash FROM sim")
def behaviour_hash(spark, sf):
    return D.sim_logs(spark, sf).select("id", LF.behaviour_hash(F.col("log")).alias("hash"))


@query("txt7_mask", "TXT-7", f"""WITH {S._SOURCES}, {S.masked()}
SELECT source_id, len(literals) AS n_literals, md5(masked) AS masked_md5,
  md5(array_to_string(literals, chr(10))) AS literals_md5 FROM msk""")
def mask(spark, sf):
    rows = D.sources(spark, sf).select(
        "source_id", K.masked_text(F.col("text")).alias("m"), K.masked_literals(F.col("text")).alias("l")
    )
    return rows.select(
        "source_id", F.size("l").alias("n_literals"), F.md5(F.col("m").cast("binary")).alias("masked_md5"),
        F.md5(F.array_join("l", "\n").cast("binary")).alias("literals_md5"),
    )


@query("txt8_restore", "TXT-8",
       f"WITH {S._SOURCES} SELECT source_id, md5(text) AS restored_md5, true AS same FROM sources")
def restore(spark, sf):
    text = F.col("text")
    back = K.restore(K.masked_text(text), K.masked_literals(text))
    rows = D.sources(spark, sf).withColumn("back", back)
    return rows.select(
        "source_id", F.md5(F.col("back").cast("binary")).alias("restored_md5"),
        (F.col("back") == text).alias("same"),
    )


_TEMPLATE = "c={cycle} n={count} e={expected} a={actual} x={addr} d={data} raw={addr:04x}"


@query("txt9_template_fill", "TXT-9", f"""WITH d AS (SELECT event_id, {S.digest(42, 'event_id::VARCHAR', 'fill')} AS d FROM events)
SELECT event_id, {S.fill(S.q(_TEMPLATE), 'd')} AS text FROM d""")
def template_fill(spark, sf):
    rows = with_draws(
        D.table(spark, sf, "events"), 42, F.col("event_id").cast("string"), {"fill": None}
    )
    return rows.select("event_id", fill(F.lit(_TEMPLATE), "fill").alias("text"))


@query("txt10_strict_json", "TXT-10", f"""WITH {S._SIM}, {S._gen()}, {S.model_read('gen')}
SELECT id, m_ok AS complete, CASE WHEN m_ok THEN m_label END AS label,
  CASE WHEN m_ok THEN m_text END AS explanation, CASE WHEN m_ok THEN m_conf END AS confidence FROM mod""")
def strict_json(spark, sf):
    rows = D.generated(D.sim_logs(spark, sf)).withColumn("v", G.strict_verdict(F.col("generated_text")))
    return rows.select("id", F.col("v").isNotNull().alias("complete"), "v.label", "v.explanation", "v.confidence")


@query("txt11_lenient_json", "TXT-11", f"""WITH {S._SIM}, {S._gen()}, w AS (SELECT id,
  CASE WHEN strpos(generated_text, '{{') > 0 AND strpos(reverse(generated_text), '}}') > 0 THEN
    substr(generated_text, strpos(generated_text, '{{'),
      length(generated_text) - strpos(reverse(generated_text), '}}') + 2 - strpos(generated_text, '{{')) END AS w FROM gen)
SELECT id, coalesce(CASE WHEN json_valid(w) THEN w::JSON->>'$.label' END, 'Unknown') AS label FROM w""")
def lenient_json(spark, sf):
    return D.generated(D.sim_logs(spark, sf)).select(
        "id", G.lenient_label(F.col("generated_text")).alias("label")
    )


@query("txt12_number_text", "TXT-12", """SELECT event_id, printf('%.2f', value) AS two,
  printf('%.1f', value * 100.0) || '%' AS pct FROM events""")
def number_text(spark, sf):
    return D.table(spark, sf, "events").select(
        "event_id", fixed(F.col("value"), 2).alias("two"), percent(F.col("value")).alias("pct")
    )


# ---- classification ---------------------------------------------------------------

@query("cls1_rule_verdicts", "CLS-1", f"""WITH {S._SIM},
  u AS (SELECT 'log' AS kind, id, log FROM sim UNION ALL SELECT 'document', doc_id, text FROM documents),
  {S.verdicts('u')} SELECT kind, id, v_label AS label, v_text AS explanation, v_conf AS confidence FROM cls""")
def rule_verdicts(spark, sf):
    logs = D.sim_logs(spark, sf).select(F.lit("log").alias("kind"), "id", "log")
    prose = D.table(spark, sf, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("log")
    )
    return _verdict_columns(with_verdict(logs.unionByName(prose)), "kind", "id")


@query("cls2_parsed_labels", "CLS-2", f"""WITH {S._SIM},
  u AS (SELECT 'log' AS kind, id, log FROM sim UNION ALL SELECT 'document', doc_id, text FROM documents),
  {S.parsed('u')} SELECT kind, id, p_label AS label, p_text AS explanation, p_conf AS confidence FROM par""")
def parsed_labels(spark, sf):
    logs = D.sim_logs(spark, sf).select(F.lit("log").alias("kind"), "id", "log")
    prose = D.table(spark, sf, "documents").select(
        F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("log")
    )
    return _verdict_columns(with_parsed_label(logs.unionByName(prose)), "kind", "id", struct="parsed")


_MODEL = f"""{S._SIM}, {S._gen()}, j AS (SELECT sim.*, generated_text FROM sim LEFT JOIN gen USING (id)),
  {S.model_read('j')}, {S.verdicts('mod')}"""


@query("cls3_model_or_rules", "CLS-3", f"""WITH {_MODEL}
SELECT id, CASE WHEN m_ok THEN m_label ELSE v_label END AS label, CASE WHEN m_ok THEN m_text ELSE v_text END AS explanation,
  CASE WHEN m_ok THEN m_conf ELSE v_conf END AS confidence FROM cls""")
def model_or_rules(spark, sf):
    logs = D.sim_logs(spark, sf)
    return _verdict_columns(OT.model_or_rules(logs, D.generated(logs)), "id")


_CHOSEN = """SELECT *, CASE WHEN use_model AND m_ok THEN m_label ELSE v_label END AS c_label,
  CASE WHEN use_model AND m_ok THEN m_text ELSE v_text END AS c_text,
  CASE WHEN use_model AND m_ok THEN m_conf ELSE v_conf END AS c_conf FROM cls"""
_c = S.gated(0.7, "c_label", "c_text", "c_conf")


FULL_TRIAGE = f"""WITH RECURSIVE {_MODEL.split(', j AS')[0]}, {S.breaker(5, RECOVERY_S)},
  req AS (SELECT id, label, log FROM sim UNION ALL SELECT -1 - doc_id, NULL, log FROM
    (SELECT id AS doc_id, log FROM ({f'WITH {S._LONG} SELECT * FROM long'}))),
  j AS (SELECT req.id, length(log) > 100000 AS too_long, CASE WHEN length(log) <= 100000 THEN {S.cut('log')} END AS log,
    coalesce(admitted AND ok, false) AS use_model, coalesce(generated_text, '') AS generated_text,
    CASE WHEN NOT coalesce(admitted, true) THEN 503 WHEN NOT coalesce(ok, true) THEN 502 ELSE 200 END AS st
    FROM req LEFT JOIN gen ON gen.id = req.id LEFT JOIN brk ON brk.call_id = req.id),
  {S.model_read('j')}, {S.verdicts('mod')}, ch AS ({_CHOSEN}),
  o AS (SELECT *, CASE WHEN too_long THEN 400 ELSE st END AS status FROM ch)
SELECT id, status, CASE WHEN status = 200 THEN {_c[0]} END AS label, CASE WHEN status = 200 THEN {_c[1]} END AS explanation,
  CASE WHEN status = 200 THEN {_c[2]} END AS confidence,
  CASE status WHEN 400 THEN {S.q(FM.TOO_LONG_DETAIL)} WHEN 503 THEN 'Circuit breaker OPEN' WHEN 502 THEN 'Call to the model failed' END AS detail FROM o"""


def requests(spark, sf):
    """(id, log): all logs, and texts of lengths around the limits that no call belongs to."""
    longs = D.long_logs(spark, sf).select((-1 - F.col("id")).alias("id"), "log")
    return D.sim_logs(spark, sf).select("id", "log").unionByName(longs)


@query("cls4_full_triage", "CLS-4 PRJ-1 PRJ-2 PRJ-3 STR-4", FULL_TRIAGE)
def full_triage(spark, sf):
    routed = route(replay_breaker(D.calls(spark, sf), 5, RECOVERY_S), fallback=False)
    return OT.triage(
        requests(spark, sf), routed.withColumnRenamed("call_id", "id"), D.generated(D.sim_logs(spark, sf))
    )


@query("cls5_rules_only_triage", "CLS-5 UDF-2", f"""WITH {S._SIM}, {S.verdicts('sim')}
SELECT id, v_label AS label, v_text AS explanation, v_conf AS confidence FROM cls""")
def rules_only_triage(spark, sf):
    rows = D.sim_logs(spark, sf).select("id", classify_log(F.col("log")).alias("verdict"))
    return spark.sql("SELECT id, verdict.label, verdict.explanation, verdict.confidence FROM {rows}", rows=rows)


@query("udf2_sql_function", "UDF-2", f"""WITH u AS (SELECT doc_id AS id, text AS log FROM documents), {S.verdicts('u')}
SELECT id AS doc_id, v_label AS label, v_text AS explanation, v_conf AS confidence FROM cls""")
def sql_function(spark, sf):
    create_classifier(spark)
    judged = spark.sql("SELECT doc_id, classify_log(text) AS verdict FROM {docs}", docs=D.table(spark, sf, "documents"))
    return _verdict_columns(judged, "doc_id")
