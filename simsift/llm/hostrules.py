"""Quality rules by document and by host.

Measures (whole texts; a null text has no words) feed three rules per document:
``short``, ``repeats`` and ``symbols``. A document fails its base rules when it is
short or repeats itself. Per host the failures of every rule are counted; their
rates are shrunk with a beta prior that is fitted to all hosts by moments, so that
a host with few documents is judged near the mean of all. A host is rejected when a
shrunk rate exceeds its limit, and with it all its documents.

Input rows travel as one struct ``row``, so no column name of theirs can clash.
Null hosts give no evidence: their documents are judged by the base rules alone.
Equal rows are separate documents. An empty table gives empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
RULES = ("short", "repeats", "symbols")


@dataclass(frozen=True)
class Limits:
    """short: fewer words; repeats: percent of words in repeated windows; symbols: per 100 words.

    host: the shrunk failure rate above which a host is rejected.
    """

    short: int = 50
    repeats: int = 50
    symbols: int = 10
    host: float = 0.6


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def _window_hashes(w: Column) -> Column:
    """Hashes of all three-word windows, in the order of their places.

    The hash has 64 bits: two different windows of one text meet with chance n * n / 2**65.
    """
    hashed = F.transform(w, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.slice(hashed, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))


def _windows(h: Column) -> Column:
    """(hash, place) of all windows, in the order of the hashes; none where all hashes differ, as nothing repeats there."""
    window = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(window)).otherwise(
        F.array().cast("array<struct<h:bigint,i:int>>")
    )


def _repeated_words(s: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; s: sorted windows."""
    repeated = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-3).alias("last"))
    return F.aggregate(
        F.sort_array(F.transform(repeated, lambda x: x["i"])), start,
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n"), i.alias("last")
        ),
        lambda acc: acc["n"],
    )


def _symbols(text: Column) -> Column:
    """Symbols of a text: each is one byte, which no other character holds."""
    gone = [F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in SYMBOLS]
    return sum(gone[1:], gone[0])


def measures(
    docs: DataFrame, text: str = "text", host: str = "source", limits: Limits = Limits()
) -> DataFrame:
    """(row, host, m) per document; m: the measures, the base verdict and the rules failed."""
    base = docs.select(
        F.struct("*").alias("row"), F.col(host).alias("host"), F.coalesce(text, F.lit("")).alias("t")
    )
    # one-element explodes keep the word and window arrays from being computed for every use
    base = base.withColumn("w", F.explode(F.array(words(F.col("t")))))
    base = base.withColumn("h", F.explode(F.array(_window_hashes(F.col("w")))))
    base = base.withColumn("s", F.explode(F.array(_windows(F.col("h")))))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    m = F.struct(
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        _symbols(F.col("t")).cast("bigint").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0]
        .cast("bigint").alias("n_dup_lines"),
        _repeated_words(F.col("s")).alias("n_repeat_words"),
    )
    measured = base.select("row", "host", m.alias("m"))
    m = F.col("m")
    short, repeats = m["n_words"] < limits.short, m["n_repeat_words"] * 100 > m["n_words"] * limits.repeats
    return measured.withColumn(
        "m",
        m.withField("short", short).withField("repeats", repeats)
        .withField("symbols", m["n_symbols"] * 100 > m["n_words"] * limits.symbols)
        .withField("base_failed", short | repeats),
    )


def with_passing_rows(measured: DataFrame) -> DataFrame:
    """measured with a null ``row`` where the base rules fail, and of the measures the verdicts."""
    m = F.col("m")
    verdicts = F.struct(*[m[c].alias(c) for c in (*RULES, "base_failed")])
    return measured.select(F.when(~m["base_failed"], F.col("row")).alias("row"), "host", verdicts.alias("m"))


def host_counts(measured: DataFrame) -> DataFrame:
    """(host, n, one count per rule), pre-aggregated before the shuffle."""
    return (
        measured.filter("host IS NOT NULL").groupBy("host")
        .agg(F.count(F.lit(1)).alias("n"), *[F.count_if(f"m.{r}").alias(r) for r in RULES])
    )


def beta_priors(counts: DataFrame) -> dict[str, tuple[float, float]]:
    """rule -> (mean, strength) over all hosts, by moments; one row reaches the driver.

    Strength is the number of documents the prior weighs as much as. Where hosts
    differ no more than chance makes them, it is the largest, 1e6.
    """
    total = F.sum("n")
    sums = counts.agg(
        F.count(F.lit(1)).alias("hosts"), total.alias("n"),
        *[F.sum(r).alias(r) for r in RULES],
        *[F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_sq") for r in RULES],
    ).first()
    priors = {}
    for rule in RULES:
        n = sums["n"] or 0
        if n == 0:
            priors[rule] = (0.0, 1e6)
            continue
        mean = sums[rule] / n
        within = mean * (1 - mean)
        # variance of the hosts' rates less what drawing the documents adds
        spread = sums[f"{rule}_sq"] / n - mean * mean - within * (sums["hosts"] - 1) / n
        strength = within / spread - 1 if spread > 0 else 1e6
        priors[rule] = (mean, min(max(strength, 1.0), 1e6))
    return priors


def host_verdicts(counts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(host, n, <rule>_rate shrunk, rejected)."""
    priors = beta_priors(counts)
    rates = {
        f"{r}_rate": (F.col(r) + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
        for r, (mean, strength) in priors.items()
    }
    judged = counts.withColumns(rates)
    worst = F.greatest(*[F.col(c) for c in rates])
    return judged.select("host", "n", *rates, (worst > F.lit(limits.host)).alias("rejected"))


def with_verdict(measured: DataFrame, verdicts: DataFrame) -> DataFrame:
    """measured with boolean ``kept``.

    Only the rejected hosts are joined. Their table is a stored one: Spark broadcasts it when its
    files are small, and splits a hot host's partition in the sort-merge join otherwise.
    """
    rejected = verdicts.filter("rejected").select("host", "rejected")
    joined = measured.join(rejected, "host", "left")
    return joined.withColumn("kept", ~F.col("m.base_failed") & F.col("rejected").isNull()).drop("rejected")
