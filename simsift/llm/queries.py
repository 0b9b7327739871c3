"""The operators on their whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, stored
from . import (
    align, decontaminate, hostrules, jaccard, langid, lines, packing, pseudonyms, resample, shards, tokenfiles,
    toolcalls, urllists,
)
from .registry import QUERIES, query
from .sql import DECONTAMINATION, HOST_RULES, TOOL_CALLS, URL_LISTS

__all__ = ["QUERIES"]


#: Key of the registered query; a caller brings a secret of their own.
KEY = "registered query"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), packing.public_packing())


@query("op2_language")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.fit_model(docs, ~held_out)
    return langid.classify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)


@query("op3_host_rules", HOST_RULES)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measured = hostrules.measures(docs)
    narrow = stored(measured.select(F.struct("row.doc_id").alias("row"), "host", "m"), "measures")
    verdicts = stored(hostrules.host_verdicts(hostrules.host_counts(narrow)), "hosts")
    return hostrules.with_verdict(narrow, verdicts).select(
        "row.doc_id", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words",
        "m.base_failed", "kept",
    )


def drawn(*parts: Column | str) -> Column:
    """A number below 2**28 that follows from the parts, the same in every engine."""
    cells = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat(*cells)), 1, 7), 16, 10).cast("int")


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list about a fifth of the sites, domains and paths that the pages name."""
    site, part = urllists.host(F.col("url")), urllists.segment(F.col("url"))
    sites = pages.select(site.alias("host"), part.alias("segment")).filter("host IS NOT NULL").distinct()
    draw = drawn(F.col("host"), "/", F.col("segment")) % 3
    pattern = (
        F.when(draw == 0, F.col("host"))
        .when((draw == 1) & (F.col("segment") != ""), F.concat_ws("/", "host", "segment"))
        .otherwise(F.regexp_replace("host", r"^[^.]+\.(?=.*\.)", ""))
    )
    listed = sites.select(pattern.alias("pattern")).distinct().filter(drawn("listed", F.col("pattern")) % 5 == 0)
    entry = F.concat_ws(":", "pattern", "revision")
    return listed.select("pattern", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("revision")).select(
        entry.alias("entry_id"), "pattern",
        F.get(F.array(F.lit("ads"), F.lit("malware"), F.lit("adult")), drawn("kind", F.col("pattern")) % 3).alias("category"),
        F.when(F.col("revision") % 2 == 0, "add").otherwise("remove").alias("action"),
        F.date_add(F.lit("2024-01-01").cast("date"), drawn("day", entry) % 366).alias("day"),
    )


@query("op4_url_lists", URL_LISTS)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    fetched = F.date_add(F.lit("2024-01-01").cast("date"), drawn("fetched", F.col("page_id")) % 366)
    captures = pages.withColumn("fetched_on", fetched)
    return urllists.judged(captures, stored(dated_list(pages), "list")).select(
        "row.page_id", "row.fetched_on", "verdict.host", "verdict.blocked",
        F.array_join("verdict.categories", ",").alias("categories"), "verdict.n_entries",
    )


SCHEMAS = {
    "search": {"query": ("string", True), "limit": ("integer", False)},
    "weather": {"city": ("string", True), "days": ("integer", True)},
}


def tool_calls(turns: DataFrame) -> DataFrame:
    """A call, sometimes two, per assistant turn; its arguments hold the turn's text, some are wrong."""
    conv, turn, text = F.col("conv_id"), F.col("turn"), F.coalesce("text", F.lit(""))
    here = F.concat(F.lit("c"), turn.cast("string"))
    draw = drawn(conv, ":", turn)
    other = F.concat(F.lit("c"), (turn + F.when(draw % 31 == 0, 2).otherwise(-2)).cast("string"))
    first = F.when(draw % 2 == 0, F.array(other)).otherwise(F.array().cast("array<string>"))
    number = F.size(F.split(text, " "))
    forms = [
        F.to_json(F.struct(text.alias("query"), number.alias("limit"))),
        F.to_json(F.struct(number.alias("days"), text.alias("city"))),
        F.to_json(F.struct(number.cast("string").alias("limit"), text.alias("query"))),
        F.to_json(F.struct(text.alias("city"), number.alias("zip"))),
        F.concat(F.lit('{"query": "'), turn.cast("string")),
    ]
    tools = ["search", "weather", "search", "weather", "search"]
    kind = draw % 5
    made = F.array(*[F.struct(F.lit(t).alias("tool"), f.alias("arguments")) for t, f in zip(tools, forms)])
    calls = F.array(
        F.struct(here.alias("call_id"), first.alias("depends_on")),
        F.struct(F.concat(here, F.lit("b")).alias("call_id"), F.array(here).alias("depends_on")),
    )
    wanted = F.when(draw % 3 == 0, calls).otherwise(F.slice(calls, 1, 1))
    return turns.filter("role = 'assistant'").select(
        "conv_id", F.get(made, kind).alias("made"), F.explode(wanted).alias("call")
    ).select("conv_id", "call.*", "made.*")


def tool_results(turns: DataFrame) -> DataFrame:
    """The turn after an assistant's holds the result of its call."""
    return turns.filter("role != 'assistant' AND turn > 0").select(
        "conv_id", F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")).alias("call_id"),
        F.col("text").alias("content"),
    )


@query("op6_tool_calls", TOOL_CALLS)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return toolcalls.linked(tool_calls(turns), tool_results(turns), SCHEMAS).select(
        "conv_id", "call_id", "tool", "level", "n_results", "status",
        F.array_join("errors", ",").alias("errors"), "record",
    )


@query("op5_pseudonyms")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pseudonyms.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), KEY)
    counts = [pseudonyms.count_of(kind).alias(f"n_{kind}") for kind in pseudonyms.KINDS]
    return done.select("row.doc_id", "row.text", *counts)


@query("op7_decontamination", DECONTAMINATION)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_found")


@query("op8_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.similar_sets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query("op9_line_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return done.select(
        "row.doc_id", F.col("lines.n").alias("n_lines"), F.col("lines.dropped").alias("n_dropped"), "row.text"
    )


@query("op10_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    placed = shards.shuffle_into_shards(rows, ["doc_id", "text_crc32", "size"], 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op11_resampling")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn_rows = resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn_rows.select("doc_id", "n_features", "weight", "score", "rank")


@query("op12_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairing = align.Pairing(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return align.aligned(table(spark, sf_dir, "documents"), pairing)


@query("op13_token_files")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    tokenfiles.write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return tokenfiles.read_tokens(spark, folder, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
