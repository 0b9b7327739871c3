"""Masking and the nine rewrites, checked on own sources against plain regex code."""

import random
import re

import pytest
from pyspark.sql import functions as F

from simsift.catalog.mutations import SPECS, MutationSpec
from simsift.functions import masking as K
from simsift.operators.mutate import default_registry, mutate

SOURCE = """// if (wr_en) posedge
always @(posedge clk) begin
  if (!rst_n) q <= 0; /* if (rd_en)
     count < MAX */

  data <= in;
  mem[ptr] <= in;
  bus[3:0] <= in;
  if ( wr_en ) $display("if (rd_en) // posedge");
  if (!wr_en) x <= 1;
  tx <= {1'b0,  sh[7:1]};
  a <= {sh[6:0], miso}; b <= {sh[0:0], m}; c <= {sh[W-2:0],  m}; d <= {sh[7-2:0], m};
  if (valid && ready && count < MAX_DEPTH) count <= count + 1;
  if (baud < DIV - 1) baud <= baud + 1;
  if (bit_cnt > 0) bit_cnt <= bit_cnt - 1;
  parity_reg <= ^data; if (parity_err) parity_out <= parity_reg ^ tx;
end
"""


def mutants(spark, source=SOURCE):
    rows = mutate(spark.createDataFrame([(source,)], "text string")).collect()
    return {r["mutation_id"]: r for r in rows}


def test_rewrites(spark):
    got = {k: r["mutated_source"] for k, r in mutants(spark).items()}
    assert list(got) == [s.mutation_id for s in SPECS]
    nb = got["nonblocking_to_blocking"]
    assert "data = in;" in nb and "mem[ptr] = in;" in nb and "bus[3:0] <= in;" in nb
    assert "q <= 0" in nb  # not at the start of a line
    assert "@(negedge clk)" in got["posedge_to_negedge"] and '// posedge");' in got["posedge_to_negedge"]
    assert "if (rst_n) q" in got["reset_inversion"]
    assert "if (!wr_en) $display" in got["enable_polarity_flip"] and "!!" not in got["enable_polarity_flip"]
    width = got["data_width_truncation"]
    for text in ("{2'b00, sh[7:1]", "{sh[5:0], miso}", "{sh[0:0], m}; c", "{sh[W-2-1:0], m}", "{sh[7-2-1:0], m}"):
        assert text in width
    assert "count <= MAX_DEPTH" in got["counter_boundary_violation"] and "count < MAX */" in got["counter_boundary_violation"]
    assert "if (valid && count < MAX_DEPTH)" in got["handshake_violation"]
    assert "baud < DIV)" in got["overflow_guard_removal"] and "bit_cnt >= 0" in got["overflow_guard_removal"]
    parity = got["parity_check_removal"]
    assert "parity_reg <= 1'b0; if (1'b0) parity_out <= parity_reg ;" in parity
    assert all(s.startswith("// if (wr_en) posedge\n") for s in got.values())


def test_changed_flag(spark):
    assert all(r["changed"] for r in mutants(spark).values())
    plain = mutants(spark, "nothing to do // posedge")
    assert not any(r["changed"] for r in plain.values())
    assert {r["mutated_source"] for r in plain.values()} == {"nothing to do // posedge"}


def test_long_white_space_is_linear(spark):
    text = "\n" * 20_000 + "a" + " " * 20_000 + "<= 1;\ncount" + " " * 20_000 + "<" + " " * 20_000
    assert mutants(spark, text)["nonblocking_to_blocking"]["changed"]


PLAIN_MASK = re.compile(r'//.*?$|/\*.*?\*/|"(?:\\.|[^"\\])*"', re.MULTILINE | re.DOTALL)


def mask_and_restore(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    masked, literals = K.masked_text(F.col("text")), K.masked_literals(F.col("text"))
    return rows.select(
        "i", masked.alias("m"), literals.alias("l"), K.restore(masked, literals).alias("r")
    ).orderBy("i").collect()


def test_masking_equals_plain_regex_and_round_trips(spark):
    rng = random.Random(3)
    pieces = ["//", "/*", "*/", '"', "\\", "\n", "a", "é", " ", "\\\"", "/", "*", "x <= 1"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 14))) for _ in range(4000)] + ["", SOURCE]
    for text, row in zip(texts, mask_and_restore(spark, texts), strict=True):
        literals = PLAIN_MASK.findall(text)
        counter = iter(range(len(literals)))
        assert row["l"] == literals
        assert row["m"] == PLAIN_MASK.sub(lambda _: f"__SANITIZED_{next(counter)}__", text)
        assert row["r"] == text


def test_huge_literal(spark):
    text = '"' + "ab\\\"" * 10_000 + '" // "' + "z" * 30_000
    assert mask_and_restore(spark, [text])[0]["r"] == text


def test_registry():
    registry = default_registry()
    own = MutationSpec("own", "Own", 2, "Own rewrite.")
    registry.register(own, lambda t: t)
    assert registry.ids() == [s.mutation_id for s in SPECS] + ["own"]
    with pytest.raises(ValueError, match="own"):
        registry.register(own, lambda t: t)
    assert "own" not in default_registry().ids()


def test_bound_of_any_length_is_lowered(spark):
    from simsift.operators.mutate import _one_less

    texts = ["0", "1", "10", "007", "00", "1000000", "10" + "0" * 50, "123456789" * 6]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", _one_less(F.col("t")).alias("n"))
    assert all(r["n"] == str(max(0, int(r["t"]) - 1)) for r in rows.collect())
