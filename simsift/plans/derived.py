"""Inputs of the registered queries, derived from the given tables only.

Every function reads a whole table and maps it row by row; ``plans.oracle``
states the same derivations in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import templates as T
from ..catalog.labels import MODULES, UNKNOWN
from ..catalog.mutations import SPECS
from ..operators.lookups import template_table

RTL = """module unit_{n}(input clk, input rst_n); // if (wr_en) posedge, unit {n}
/* block: count < MAX_DEPTH && ready
   parity_reg <= ^x; */
initial $display("if (rd_en) \\"negedge\\" // {n}");
always @(posedge clk) begin
  if (!rst_n) begin
    count <= 0;
    mem[{n}] <= data_in;
  end else if (wr_en) begin
    shift_tx <= {1'b0, shift_tx[{n}:1]};
    shift_rx <= {shift_rx[{n}:0], miso};
    shift_in <= {shift_in[DATA_WIDTH-2:0], sda};
  end
  if (valid && ready && count < MAX_DEPTH) count <= count + 1;
  if (baud_cnt < BAUD_DIV - 1) baud_cnt <= baud_cnt + 1;
  if (bit_cnt > 0) bit_cnt <= bit_cnt - 1;
  parity_reg <= ^data_in;
  if (parity_err) parity_out <= parity_reg ^ tx;
end
endmodule
"""
GOLDEN_HEAD = "2024-02-02T01:02:03 seed = 7 /tmp/run/base\n"  # noise alone
NOISY_HEAD = ("2024-01-01T00:00:00 started, seed = ", "\nfiles in /tmp/run/", "/out\n")
NOISY_TAIL = ("\nSimulation time: ", " ns")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(options, index: Column) -> Column:
    return F.get(F.array(*[F.lit(o) for o in options]), index.cast("int"))


def _numbered(text: Column, n: Column) -> Column:
    """Fill a template with numbers that follow from the row's id."""
    for name, (low, span) in (
        ("cycle", (20, 500)), ("count", (16, 49)), ("expected", (5, 246)), ("actual", (0, 256))
    ):
        text = F.replace(text, F.lit("{" + name + "}"), (n % span + low).cast("string"))
    return text


def sim_logs(spark: SparkSession, sf_dir: str, *extra: Column, rows: DataFrame | None = None) -> DataFrame:
    """(id, module, mutation_id, label, log, extra...): one log per event, four textual forms.

    ``rows``: the events with the columns that ``extra`` names, in place of the table.
    """
    n = F.col("event_id")
    given = table(spark, sf_dir, "events").select("event_id", "event_type") if rows is None else rows
    events = given.withColumns(
        {
            "mutation_id": pick([s.mutation_id for s in SPECS], n % 9),
            "own_label": pick([s.label for s in SPECS], n % 9),
            "module": pick(MODULES, F.floor(n / 9) % 5),
            "form": (F.floor(n / 45) % 4).cast("int"),
        }
    )
    passing = F.col("event_type") == "view"
    text = F.when(passing, F.lit(T.PASSING_LOG)).otherwise(F.col("template"))
    filled = events.join(F.broadcast(template_table(spark)), ["mutation_id", "module"]).withColumn(
        "body", _numbered(text, n)
    )
    body, id_text = F.col("body"), n.cast("string")
    noisy = F.concat(
        F.lit(NOISY_HEAD[0]), id_text, F.lit(NOISY_HEAD[1]), id_text, F.lit(NOISY_HEAD[2]), body,
        F.lit(NOISY_TAIL[0]), id_text, F.lit(NOISY_TAIL[1]),
    )
    log = (
        F.when(F.col("form") == 0, body)
        .when(F.col("form") == 1, F.split_part(body, F.lit("\n"), F.lit(1)))
        .when(F.col("form") == 2, F.split_part(body, F.lit("\n"), F.lit(2)))
        .otherwise(noisy)
    )
    return filled.select(
        n.alias("id"), "module", "mutation_id",
        F.when(passing, F.lit(UNKNOWN)).otherwise(F.col("own_label")).alias("label"), log.alias("log"),
        *extra,
    )


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session's zone."""
    days = F.unix_date(ts.cast("date")).cast("bigint")
    minutes = (days * 24 + F.hour(ts)) * 60 + F.minute(ts)
    seconds = F.date_part(F.lit("SECOND"), ts)
    return minutes * F.lit(60_000_000) + (seconds * F.lit(1_000_000)).cast("bigint")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(service, call_id, ts_us, ok): one service call per event."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 8).alias("service"), F.col("event_id").alias("call_id"),
        micros(F.col("ts")).alias("ts_us"), (F.col("event_type") != "error").alias("ok"),
    )


def generated(logs: DataFrame) -> DataFrame:
    """(id, generated_text): model output in seven shapes, good and bad."""
    label = F.col("label")
    full = F.concat(
        F.lit('{"label": "'), label, F.lit('", "explanation": "seen by the model", "confidence": 0.9}')
    )
    shapes = [
        full,
        F.concat(F.lit("Answer: "), full, F.lit(" done")),
        F.concat(F.lit('{"label": "'), label, F.lit('"}')),
        F.concat(F.lit('{"label": "'), label, F.lit('", ')),
        F.lit(""),
        F.concat(F.lit('  {"label": "'), F.lower(label),
                 F.lit('", "explanation": "unsure", "confidence": 0.55}\n')),
        F.concat(F.lit('{"label": "'), label, F.lit('", "explanation": null, "confidence": 0.8}')),
    ]
    text = F.when(F.col("id") % 7 == 0, shapes[0])
    for i, shape in enumerate(shapes[1:], start=1):
        text = text.when(F.col("id") % 7 == i, shape)
    return logs.select("id", text.alias("generated_text"))


def ab_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, manual_minutes, ai_minutes) from order lines."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("grp"), F.col("l_quantity").alias("manual_minutes"),
        (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("ai_minutes"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source_id, text): a small design text in front of every page."""
    n = (F.col("page_id") % 64).cast("string")
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("source_id"),
        F.concat(F.replace(F.lit(RTL), F.lit("{n}"), n), F.col("html")).alias("text"),
    )


# Target lengths of the long logs by doc_id % 16; 0 keeps the text.
LONG_TARGETS = (49_999, 50_000, 50_001, 99_999, 100_000, 100_001) + (0,) * 10


def long_logs(spark: SparkSession, sf_dir: str, *extra: Column, rows: DataFrame | None = None) -> DataFrame:
    """(id, log, extra...): documents, some repeated up to lengths around the limits; ``rows`` as in ``sim_logs``."""
    target = pick(LONG_TARGETS, F.col("doc_id") % 16)
    times = (F.ceil(target / F.greatest(F.length("text"), F.lit(1)))).cast("int")
    # a text beyond its target stays whole
    longer = F.left(F.repeat(F.col("text"), times), F.greatest(target, F.length("text")))
    given = table(spark, sf_dir, "documents") if rows is None else rows
    return given.select(
        F.col("doc_id").alias("id"),
        F.when((target > 0) & (F.length("text") > 0), longer).otherwise(F.col("text")).alias("log"),
        *extra,
    )


def speed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(elapsed_s, n_tokens) from events; clicks have no duration."""
    return table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "click", F.lit(0.0)).otherwise(F.col("value")).alias("elapsed_s"),
        (F.col("event_id") % 128).alias("n_tokens"),
    )
