"""Registered queries: mutations, corpus joins, augmentation, split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog.labels import MODULES
from ..catalog.mutations import SPECS, MutationSpec
from ..catalog.templates import FALLBACK_LOG, synthetic_logs
from ..functions.draws import choice, with_draws
from ..operators import augment as A
from ..operators import generate as GN
from ..operators import lookups as LK
from ..operators import mutate as MU
from ..operators import split as SP
from . import derived as D
from . import oracle as S
from .registry import query

SEED = 42


def _md5(name: str):
    return F.md5(F.col(name).cast("binary"))


# ---- mutations --------------------------------------------------------------------

def _one_mutation(mutation_id: str):
    def run(spark, sf) -> DataFrame:
        rows = MU.mutate(D.sources(spark, sf), ids=[mutation_id])
        return rows.select(
            "source_id", "changed", F.length("mutated_source").alias("n_chars"),
            _md5("mutated_source").alias("mutated_md5"),
        )

    return run


for _i, _spec in enumerate(SPECS, start=1):
    query(f"mut{_i}_{_spec.mutation_id}", f"MUT-{_i}", S.mutated_one(_spec.mutation_id))(
        _one_mutation(_spec.mutation_id)
    )


@query("mut10_all_mutants", "MUT-10", S.all_mutants() + """
SELECT source_id, mutation_id, label, tier, description, md5(mutated) AS mutated_md5 FROM mutants""")
def all_mutants(spark, sf):
    return MU.mutate(D.sources(spark, sf)).select(
        "source_id", "mutation_id", "label", "tier", "description",
        _md5("mutated_source").alias("mutated_md5"),
    )


@query("mut11_catalogue_use", "MUT-11", S.all_mutants() + """
SELECT position, mutation_id, label, tier, count(*) AS n_sources, count(*) FILTER (changed) AS n_changed
FROM mutants GROUP BY ALL""")
def catalogue_use(spark, sf):
    registry = MU.default_registry()
    order = F.array_position(F.array(*[F.lit(i) for i in registry.ids()]), F.col("mutation_id")) - 1
    return (
        MU.mutate(D.sources(spark, sf), registry)
        .groupBy(order.alias("position"), "mutation_id", "label", "tier")
        .agg(F.count(F.lit(1)).alias("n_sources"), F.count_if("changed").alias("n_changed"))
    )


@query("mut12_changed_flags", "MUT-12",
       S.all_mutants() + "SELECT source_id, mutation_id, changed FROM mutants")
def changed_flags(spark, sf):
    return MU.mutate(D.sources(spark, sf)).select("source_id", "mutation_id", "changed")


_LOOP = MutationSpec("loop_to_stop", "Own Mutation", 2, "Every word clk becomes stop.")


@query("udf1_own_mutation", "UDF-1", f"""WITH {S._SOURCES}, {S.masked()},
mut AS (SELECT *, regexp_replace(masked, '\\bclk\\b', 'stop', 'g') AS rewritten FROM msk)
SELECT source_id, 'loop_to_stop' AS mutation_id, md5({S.restore('rewritten')}) AS mutated_md5 FROM mut""")
def own_mutation(spark, sf):
    registry = MU.default_registry()
    registry.register(_LOOP, lambda t: F.regexp_replace(t, r"\bclk\b", "stop"))
    return MU.mutate(D.sources(spark, sf), registry, ids=[_LOOP.mutation_id]).select(
        "source_id", "mutation_id", _md5("mutated_source").alias("mutated_md5")
    )


# ---- joins --------------------------------------------------------------------------

_KEPT = f"kept(mutation_id, module, kept_log) AS (VALUES {S._rows(synthetic_logs())})"
_OTHER = "CASE WHEN id % 11 = 0 THEN 'other' ELSE sim.module END"


def _fallback(mutation: str, module: str) -> str:
    head, middle, tail = map(S.q, FALLBACK_LOG)
    return f"{head} || {mutation} || {middle} || {module} || {tail}"


@query("jn1_kept_logs", "JN-1", f"""WITH {S._SIM}, {_KEPT},
r AS (SELECT id, sim.mutation_id, {_OTHER} AS module FROM sim)
SELECT id, r.mutation_id, r.module, coalesce(kept_log, {_fallback('r.mutation_id', 'r.module')}) AS log
FROM r LEFT JOIN kept k ON r.mutation_id = k.mutation_id AND r.module = k.module""")
def kept_logs(spark, sf):
    rows = D.sim_logs(spark, sf).select(
        "id", "mutation_id", F.when(F.col("id") % 11 == 0, "other").otherwise(F.col("module")).alias("module")
    )
    return LK.with_synthetic_log(rows).select("id", "mutation_id", "module", "log")


def runs(spark, sf):
    """(module, mutation_id, log, ok, id): every nine events are the runs of one design."""
    ok = (F.col("event_type") != "error").alias("ok")
    module = F.concat(F.lit("m"), F.floor(F.col("id") / 9).cast("string"))
    return D.sim_logs(spark, sf, ok).select(module.alias("module"), "mutation_id", "log", "ok", "id")


def golden_runs(all_runs: DataFrame) -> DataFrame:
    """A module's reference run: its least log under a head of nothing but noise."""
    return all_runs.groupBy("module").agg(
        F.concat(F.lit(D.GOLDEN_HEAD), F.min("log")).alias("log"), (F.min("id") % 5 != 0).alias("ok")
    )


@query("jn2_inert_runs", "JN-2",
       f"WITH {S._RUNS}, {S._INERT} SELECT module, mutation_id, ok, is_inert FROM inert")
def inert_runs(spark, sf):
    rows = runs(spark, sf)
    return GN.with_inertness(rows, golden_runs(rows)).select("module", "mutation_id", "ok", "is_inert")


@query("flt1_active_runs", "FLT-1",
       f"WITH {S._RUNS}, {S._INERT} SELECT module, mutation_id FROM inert WHERE NOT is_inert")
def active_runs(spark, sf):
    rows = runs(spark, sf)
    return GN.drop_inert(GN.with_inertness(rows, golden_runs(rows))).select("module", "mutation_id")


_SPEC_ROWS = S._rows([(s.mutation_id, s.label, s.tier, s.description) for s in SPECS])


@query("jn3_source_mutation_pairs", "JN-3", f"""WITH specs(mutation_id, label, tier, description) AS (VALUES {_SPEC_ROWS})
SELECT page_id AS source_id, specs.* FROM pages CROSS JOIN specs""")
def source_mutation_pairs(spark, sf):
    return GN.pair_up(D.table(spark, sf, "pages").select(F.col("page_id").alias("source_id")))


@query("jn4_label_lines", "JN-4", f"""WITH {S._SIM}, {S.augmented('sim', 1, SEED)}
SELECT id, label, list_extract(lines, {S.choice('d_line', 'len(lines)')} + 1) AS template FROM aug WHERE copy = 0""")
def label_lines(spark, sf):
    rows = LK.with_label_lines(D.sim_logs(spark, sf).select("id", "label"))
    key = F.concat_ws(":", F.col("id").cast("string"), F.lit("0"))
    drawn = with_draws(rows, SEED, key, {"line": None})
    chosen = F.get("lines", choice("line", F.size("lines")))
    return drawn.select("id", "label", chosen.alias("template"))


# ---- augmentation -------------------------------------------------------------------

def _copies(spark, sf, n_aug: int) -> DataFrame:
    rows = A.number_variants(LK.with_label_lines(D.sim_logs(spark, sf).select("id", "label")), n_aug)
    key = F.concat_ws(":", F.col("id").cast("string"), F.col("_copy").cast("string"))
    return A.with_variant_draws(rows, SEED, key)


@query("gen1_numbered_variants", "GEN-1",
       f"WITH {S._SIM} SELECT id, label, c.copy AS copy FROM sim, unnest(range(-1, 3)) AS c(copy)")
def numbered_variants(spark, sf):
    rows = A.number_variants(D.sim_logs(spark, sf).select("id", "label"), 3)
    return rows.select("id", "label", F.col("_copy").cast("bigint").alias("copy"))


def _aug_sql(column: str, name: str) -> str:
    return (f"WITH {S._SIM}, {S.augmented('sim', 2, SEED)} SELECT id, copy, {column} AS {name} "
            "FROM aug WHERE copy >= 0")


def _aug_column(spark, sf, column, name: str) -> DataFrame:
    rows = _copies(spark, sf, 2).filter("_copy >= 0")
    return rows.select("id", F.col("_copy").cast("bigint").alias("copy"), column.alias(name))


@query("gen2_noise_prefix", "GEN-2", _aug_sql("noise", "noise"))
def noise_prefix(spark, sf):
    return _aug_column(spark, sf, A.noise_prefix(), "noise")


@query("gen3_assertion_line", "GEN-3", _aug_sql("line", "line"))
def assertion_line(spark, sf):
    return _aug_column(spark, sf, A.assertion_line(F.col("lines")), "line")


@query("gen4_suffix_line", "GEN-4", _aug_sql("suffix", "suffix"))
def suffix_line(spark, sf):
    return _aug_column(spark, sf, A.suffix_line(), "suffix")


@query("gen5_module_stamp", "GEN-5", _aug_sql("stamp", "module"))
def module_stamp(spark, sf):
    return _aug_column(spark, sf, A.module_stamp(), "module")


def augmented(spark, sf, n_aug: int) -> DataFrame:
    rows = A.augment(D.sim_logs(spark, sf), ["id"], n_aug, SEED)
    return rows.withColumn("aug_id", F.col("aug_id").cast("bigint"))


_AUGROWS = f"WITH {S._SIM}, {S.augmented_rows('sim', 8, SEED)}"


@query("gen6_augmented_corpus", "GEN-6 SET-1", _AUGROWS + """
SELECT id, label, mutation_id, log, module, coalesce(augmented, false) AS augmented, coalesce(aug_id, -1) AS aug_id FROM augrows""")
def augmented_corpus(spark, sf):
    return augmented(spark, sf, 8).select(
        "id", "label", "mutation_id", "log", "module",
        F.coalesce("augmented", F.lit(False)).alias("augmented"),
        F.coalesce("aug_id", F.lit(-1)).alias("aug_id"),
    )


@query("set1_base_and_variants", "SET-1", f"""WITH {S._SIM}, {S.augmented_rows('sim', 2, SEED)}
SELECT id, log, false AS augmented FROM sim
UNION ALL SELECT id, log, augmented FROM augrows WHERE augmented""")
def base_and_variants(spark, sf):
    base = D.sim_logs(spark, sf).select("id", "log")
    extra = augmented(spark, sf, 2).filter("augmented").select("id", "log", "augmented")
    rows = base.unionByName(extra, allowMissingColumns=True)
    return rows.withColumn("augmented", F.coalesce("augmented", F.lit(False)))


_CORPUS = f"""{S._RUNS}, {S._INERT}, {_KEPT}, specs(mutation_id, label, tier, description) AS (VALUES {_SPEC_ROWS}),
pairs AS (SELECT m.module, specs.*, g.ok AS g_ok FROM (SELECT DISTINCT module FROM runs) m CROSS JOIN specs
  LEFT JOIN golden g ON g.module = m.module),
simulated AS (SELECT p.module, p.mutation_id, p.tier, coalesce(i.log, '') AS log, coalesce(i.is_inert, false) AS is_inert
  FROM pairs p LEFT JOIN inert i ON i.module = p.module AND i.mutation_id = p.mutation_id WHERE coalesce(p.g_ok, false)),
{S.parsed('simulated')},
corpus AS (
SELECT log, p_label AS label, p_text AS explanation, p_conf AS confidence, 'log_parser' AS label_source, module,
  mutation_id, tier, is_inert FROM par WHERE NOT is_inert
UNION ALL SELECT coalesce(kept_log, {_fallback('p.mutation_id', 'p.module')}), label, description, 1.0, 'mutation',
  p.module, p.mutation_id, tier, false FROM pairs p LEFT JOIN kept k ON k.module = p.module AND k.mutation_id = p.mutation_id
  WHERE NOT coalesce(g_ok, false))"""


@query("gen7_generated_corpus", "GEN-7 SET-2 JN-3", f"WITH {_CORPUS} SELECT * FROM corpus")
def generated_corpus(spark, sf):
    rows = runs(spark, sf)
    return GN.generate_corpus(rows.select("module").distinct(), rows, golden_runs(rows))


@query("set2_all_modules", "SET-2", f"""WITH {_KEPT}, specs(mutation_id, label, tier, description) AS (VALUES {_SPEC_ROWS}),
src AS (SELECT page_id, {S.pick(MODULES, 'page_id % 5')} AS module FROM pages)
SELECT s.module, mutation_id, label, 1.0::DOUBLE AS confidence, kept_log AS log, count(*) AS n FROM src s CROSS JOIN specs
JOIN kept USING (module, mutation_id) GROUP BY ALL""")
def all_modules(spark, sf):
    sources = D.table(spark, sf, "pages").select(D.pick(MODULES, F.col("page_id") % 5).alias("module"))
    rows = GN.generate_corpus(sources)
    return rows.groupBy("module", "mutation_id", "label", "confidence", "log").agg(
        F.count(F.lit(1)).alias("n")
    )


# ---- split ------------------------------------------------------------------------

_KEYED = f"WITH {S._SIM}, {S.split_of('sim', 'id::VARCHAR')}"


@query("win1_shuffle_ranks", "WIN-1", _KEYED + " SELECT lab AS label, id, rank FROM spl")
def shuffle_ranks(spark, sf):
    return SP.label_ranks(D.sim_logs(spark, sf), ["id"], seed=SEED)


@query("win2_stratified_split", "WIN-2", _KEYED + " SELECT id, label, split FROM spl")
def stratified_split(spark, sf):
    return SP.stratified_split(D.sim_logs(spark, sf), ["id"], seed=SEED).select("id", "label", "split")


@query("win2_small_groups", "WIN-2", f"""WITH d AS (SELECT doc_id, lang || '/' || source AS label FROM documents),
{S.split_of('d', 'doc_id::VARCHAR', seed=7)} SELECT doc_id, label, split FROM spl""")
def small_groups(spark, sf):
    rows = D.table(spark, sf, "documents").select(
        "doc_id", F.concat_ws("/", "lang", "source").alias("label")
    )
    return SP.stratified_split(rows, ["doc_id"], seed=7)


@query("srt1_split_order", "SRT-1", _KEYED + """
SELECT split, id, md5(concat_ws(':', '42', id::VARCHAR)) AS sort_key,
  row_number() OVER (ORDER BY split, md5(concat_ws(':', '42', id::VARCHAR))) AS position FROM spl""")
def split_order(spark, sf):
    rows = SP.stratified_split(D.sim_logs(spark, sf), ["id"], seed=SEED)
    return SP.shuffled(rows, ["id"], SEED).select(
        "split", "id", F.substring(SP.shuffle_key(["id"], SEED), 1, 32).alias("sort_key"), "position"
    )
