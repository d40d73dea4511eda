"""Quality rules with host-level verdicts, in column expressions only.

Each document gets its statistics from its own text (no shuffle). Rule failures are then counted by host; a host's
failure rate is shrunk towards the rate of all hosts by a beta prior that the hosts themselves give (method of
moments), and hosts whose shrunk rate is surely above a limit are rejected with all their documents.

Nulls: a null text has no words and fails; a null host is a host of its own that is never rejected. Repeated rows
count each. Texts of any length are judged whole, in the same way at every length. Extra columns may have any names: a
column that quality() is asked to keep and that has the name of one of its results is left out; kept_documents() keeps
all columns as they are. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The word, line and symbol patterns of the contract.
SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
#: Parts into which rows of one host are dealt where the verdicts are too many to broadcast.
SALTS = 64
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A host is rejected if its shrunk failure rate less `surety` standard deviations is above this rate.
    host_limit: float = 0.5
    surety: float = 2.0
    #: Hosts in one broadcast of verdicts at most; more are joined by a shuffle.
    broadcast_hosts: int = 100_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value worked out once: a lambda's variable is never inlined."""
    return F.element_at(F.transform(F.array(value), body), 1)


def covered(positions: Column, width: int = 3) -> Column:
    """How many words windows of that width at sorted positions cover together."""
    gaps = let(positions, lambda p: F.aggregate(p, F.struct(F.lit(-(1 << 40)).alias("last"), F.lit(0).cast("long").alias("n")), lambda a, x: F.struct(x.cast("long").alias("last"), (a["n"] + F.least(x.cast("long") - a["last"], F.lit(width).cast("long"))).alias("n")))["n"])
    return gaps


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows that stand twice or more in the text, the first one included.

    Windows are sorted by a hash, then by their words, so that equal ones stand side by side; the words themselves are
    compared, so that windows of one hash are told apart.
    """
    window = lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("k"), *[F.get(w, i + j).alias(f"w{j}") for j in range(3)], i.cast("long").alias("p"))
    equal = lambda x, y: (x["k"] == y["k"]) & (x["w0"] == y["w0"]) & (x["w1"] == y["w1"]) & (x["w2"] == y["w2"])
    twin = lambda s, x, i: ((i > 0) & equal(F.get(s, i - 1), x)) | F.coalesce(equal(F.get(s, i + 1), x), F.lit(False))
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window))
    found = let(windows, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: twin(s, x, i)), lambda x: x["p"])))
    return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(covered(found))


def document_stats(text: Column) -> Column:
    """The numbers of STATS as a struct."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    return let(
        F.array_remove(F.split(t, SPACE + "+"), ""),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(t, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )


def base_failed(s: Column, rules: Rules) -> Column:
    return (s["n_words"] < rules.min_words) | (100 * s["n_repeat_words"] > rules.max_repeat_percent * s["n_words"])


def host_rates(judged: DataFrame, rules: Rules, settle: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """(host, n, n_failed, host_rate, host_spread, rejected) from rows of (host, failed boolean).

    Prior: a beta distribution with the mean and variance of the hosts' raw rates, each host weighing the same,
    less the variance that counting alone gives. The strength is kept within 2 and 1e6. One row for each host is
    combined before the shuffle, so a host with a third of all documents costs no more than another. The prior is one
    row of three numbers, which the driver reads.
    """
    hosts = judged.groupBy("host").agg(F.count("*").alias("n"), F.count_if("failed").alias("failed")).withColumn("raw", F.col("failed") / F.col("n"))
    if settle is not None:  # read twice: for the prior and for the rates
        hosts = settle(hosts, "host-counts")
    m, v, noise = F.avg("raw"), F.var_pop("raw"), F.avg(F.lit(1.0) / F.col("n"))
    prior = hosts.agg(m.alias("m"), v.alias("v"), noise.alias("noise")).select(
        F.coalesce(F.col("m"), F.lit(0.0)).alias("m"), F.greatest(F.coalesce(F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("noise"), F.lit(0.0)), F.lit(1e-9)).alias("v")
    )
    mean, strength = prior.select("m", F.least(F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(2.0)), F.lit(1e6)).alias("strength")).first()
    a, b = mean * F.lit(strength) + F.col("failed"), (1 - mean) * F.lit(strength) + F.col("n") - F.col("failed")
    rate, spread = a / (a + b), F.sqrt(a * b / (a + b) / (a + b) / (a + b + 1))
    verdict = F.col("host").isNotNull() & (rate - rules.surety * spread > rules.host_limit)
    return hosts.select("host", "n", F.col("failed").alias("n_failed"), rate.alias("host_rate"), spread.alias("host_spread"), verdict.alias("rejected"))


def meet_hosts(rows: DataFrame, host: Column, spread_by: Column, rejected: DataFrame, rules: Rules, how: str) -> DataFrame:
    """rows joined with the rejected hosts (a column host), which are counted: few are broadcast, many are joined by host with a salt."""
    bad = rejected.select(F.col("host").alias("_host"), F.lit(True).alias("host_rejected"))
    if bad.limit(rules.broadcast_hosts + 1).count() <= rules.broadcast_hosts:
        return rows.join(F.broadcast(bad), host == bad["_host"], how)
    dealt = bad.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(dealt, (host == dealt["_host"]) & (F.pmod(spread_by, F.lit(SALTS)).cast("int") == dealt["_salt"]), how)


def kept_documents(docs: DataFrame, settle: Callable[[DataFrame, str], DataFrame], rules: Rules = Rules(), text: str = "text", host: str = "source") -> DataFrame:
    """The rows of docs that quality() keeps. Only what the verdict needs is worked out, once for the hosts and once for the rows."""
    t = F.coalesce(docs[text], F.lit(""))
    failed = let(F.array_remove(F.split(t, SPACE + "+"), ""), lambda w: F.when(F.size(w) < rules.min_words, F.lit(True)).otherwise(100 * repeat_words(w) > rules.max_repeat_percent * F.size(w)))
    rejected = host_rates(docs.select(docs[host].alias("host"), failed.alias("failed")), rules, settle).filter("rejected")
    return meet_hosts(docs.filter(~failed), docs[host], F.xxhash64(t), settle(rejected.select("host"), "hosts"), rules, "left_anti")


RESULTS = (*STATS, "base_failed", "kept", "host_rejected")


def quality(docs: DataFrame, rules: Rules = Rules(), host: str = "source", keep: tuple[str, ...] = ("doc_id",), settle: Callable[[DataFrame, str], DataFrame] | None = None, text: str = "text") -> DataFrame:
    """The columns `keep` of every document, its statistics, base_failed, kept and host_rejected.

    settle(df, label), where given, writes the judged rows once so that the second pass doesn't read texts again.
    """
    own = [c for c in keep if c not in RESULTS]
    judged = docs.select(F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(own)], F.lit(0).alias("_")).alias("own"), document_stats(docs[text]).alias("stats"), docs[host].alias("host"))
    judged = judged.withColumn("failed", base_failed(F.col("stats"), rules))
    if settle is not None:
        judged = settle(judged, "quality")
    rejected = host_rates(judged.select("host", "failed"), rules, settle).filter("rejected")
    if settle is not None:
        rejected = settle(rejected.select("host"), "hosts")
    out = meet_hosts(judged, judged["host"], F.xxhash64("own", "stats"), rejected, rules, "left")
    gone = F.coalesce(F.col("host_rejected"), F.lit(False))
    return out.select(*[F.col(f"own.c{i}").alias(c) for i, c in enumerate(own)], *[F.col(f"stats.{x}").alias(x) for x in STATS], F.col("failed").alias("base_failed"), (~F.col("failed") & ~gone).alias("kept"), gone.alias("host_rejected"))
