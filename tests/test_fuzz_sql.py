"""Random texts through the parser and field functions, against the SQL twins."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from simsift.functions import logfields as LF
from simsift.functions import logparser as LP
from simsift.functions.logparser import with_parsed_label
from simsift.plans import oracle as S

WORDS = [
    *[w for group in (LP.TEXT_COUNTER, LP.TEXT_HANDSHAKE, LP.TEXT_DATA, LP.TEXT_PARITY, LP.TEXT_ENABLE)
      for p in group for w in p.replace(r"\s+", " ").split(".*")],
    "Counter overflow", "Counter overflow", "count", "count=7", "count:3", "count", "at cycle 5", "at cycle ", "@", "=",
    "cycle", "cycle = 4", "9", "Data mismatch expected=1", "actual:2", " at cycle 8", "expected=1", "actual",
    "TB_LOG|", "TB_LOG|kind=ASSERT_FAIL|", "TB_LOG|kind=SCOREBOARD_FAIL|", "|", "assert_id=", "assert_id=FIFO_OVERFLOW",
    "id=RX_PARITY", "id:cs_n", "signals=a=1", "signal_dump: b", "ready=0", "write_fire=1", "valid = 1", "|cycle=3",
    "|count=4", "|expected=1|actual=2", "|expected=", "|ready=0|write_fire=1", "|signals=", "x", " ", "\n", "\n",
]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    return [
        "".join(rng.choice([w, w, w.upper()]) + rng.choice(["", "", " ", "\n"]) for w in rng.choices(WORDS, k=rng.randint(1, 12)))
        for _ in range(20_000)
    ]


@pytest.fixture(scope="module")
def duck(texts):
    con = duckdb.connect()
    con.register("u", pd.DataFrame({"id": range(len(texts)), "log": texts}))
    return con


@pytest.fixture(scope="module")
def rows(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id bigint, log string").repartition(8).cache()


def same(got, want, texts):
    want = {r[0]: r[1:] for r in want}
    wrong = [(texts[r[0]], tuple(r)[1:], want[r[0]]) for r in got if tuple(r)[1:] != want[r[0]]]
    assert wrong[:3] == []


def test_parser(rows, duck, texts):
    got = with_parsed_label(rows).select("id", "parsed.*").collect()
    want = duck.execute(f"WITH {S.parsed('u')} SELECT id, p_label, p_text, p_conf FROM par").fetchall()
    assert len({r["label"] for r in got}) == 6
    same(got, want, texts)


def test_fields(rows, duck, texts):
    log = F.col("log")
    got = rows.select(
        "id", LF.assertion_id(log), LF.cycle_number(log), LF.at_cycle(log), LF.signal_dump(log), LF.behaviour_hash(log)
    ).collect()
    want = duck.execute(
        f"SELECT id, {S.assert_id('log')}, {S.cycle('log')}, {S.at_cycle('log')}, {S.dump('log')}, "
        f"sha256({S.noise_free('log')}) FROM u"
    ).fetchall()
    same(got, want, texts)
