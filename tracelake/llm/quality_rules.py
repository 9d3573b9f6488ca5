"""Quality rules at host level, from DataFrame functions only.

Each document gets rule counts from its whole text. Rule failures are summed by domain, each domain's failure rate is
shrunk towards the corpus by a beta prior that is fitted to the domains themselves (method of moments), and the host's
verdict is joined back to its documents.

A document is dropped if it fails the base rules, if it fails a grave rule, or if it fails a mild rule while its host's
shrunk rate is above ``max_host_rate``. A clean document of a bad host stays.

Defined cases: null or empty text has no words and fails the base; a null domain is a host of its own; repeated rows
each keep their row; an empty table gives an empty result; other columns of the input pass through unread, but for those named
like a result (``RESULTS``), which give way to it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, count_chars, free_name, let, stage_table, words_of

SYMBOLS = "#*$%&|<>"
RESULTS = ("_q", "_base_failed", "_grave", "_mild", "_host_rate", "_kept")


@dataclass(frozen=True)
class HostRules:
    min_words: int = 10
    max_repeat_pct: int = 20
    window: int = 5
    grave_symbols_pct: int = 20  # symbols for each hundred words
    grave_bangs_pct: int = 40
    mild_symbols_pct: int = 10
    mild_dup_lines: int = 3
    min_mean_chars: float = 2.0
    max_mean_chars: float = 18.0
    max_host_rate: float = 0.5


def repeated_words(words: Column, window: int = 5) -> Column:
    """Words inside windows that occur twice or more in the text, the first included; each word counts once."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(starts, i + 1) - x, F.lit(window))).cast("long"))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    def over(hashes: Column) -> Column:
        def doubled(s: Column) -> Column:
            same = F.filter(s, lambda x, i: F.get(s, i - 1)["h"].eqNullSafe(x["h"]) | F.get(s, i + 1)["h"].eqNullSafe(x["h"]))
            return let(F.array_sort(F.transform(same, lambda x: x["i"])), covered)

        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(ranked, doubled))

    def of(ws: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(ws) - window), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(window)]))
        return F.when(F.size(ws) < window, F.lit(0).cast("long")).otherwise(let(grams, over))

    return let(words, of)


def rule_counts(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rules: HostRules = HostRules()) -> DataFrame:
    """One row for each input row: the kept columns and a struct ``_q`` of counts."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counts = let(
        words_of(F.col(text)),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            (F.length(body) - count_chars(body, SPACES)).cast("long").alias("word_chars"),
            count_chars(body, SYMBOLS).alias("n_symbols"),
            let(lines, lambda ls: F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
            repeated_words(ws, rules.window).alias("n_repeat_words"),
            count_chars(body, "!").alias("n_bangs"),
        ),
    )
    return docs.select(*[F.col(c) for c in (docs.columns if keep is None else keep)], F.explode(F.array(counts)).alias("_q"))  # a generator, so that each use doesn't count again


def judge(counted: DataFrame, rules: HostRules = HostRules()) -> DataFrame:
    """Adds base_failed, grave and mild from ``_q``."""
    q = lambda c: F.col(f"_q.{c}")
    base = (q("n_words") < rules.min_words) | (100 * q("n_repeat_words") > rules.max_repeat_pct * q("n_words"))
    mean_chars = q("word_chars") / F.greatest(q("n_words"), F.lit(1))
    grave = (100 * q("n_symbols") > rules.grave_symbols_pct * q("n_words")) | (100 * q("n_bangs") > rules.grave_bangs_pct * q("n_words"))
    mild = (100 * q("n_symbols") > rules.mild_symbols_pct * q("n_words")) | (q("n_dup_lines") >= rules.mild_dup_lines) | ~mean_chars.between(rules.min_mean_chars, rules.max_mean_chars)
    return counted.withColumns({"_base_failed": base, "_grave": grave, "_mild": mild})


def host_rates(judged: DataFrame, host: str = "source") -> DataFrame:
    """host, docs, failed, host_rate: the failure rate shrunk by a beta prior fitted over hosts."""
    failed = F.col("_base_failed") | F.col("_grave") | F.col("_mild")
    hosts = judged.groupBy(F.col(host).alias("_host")).agg(F.count("*").alias("docs"), F.sum(failed.cast("long")).alias("failed"))
    hosts = stage_table(hosts, "quality-hosts")
    rate = F.col("failed") / F.col("docs")
    fit = hosts.agg(F.sum("failed").alias("f"), F.sum("docs").alias("n"), F.var_samp(rate).alias("v")).first()
    mean = (fit["f"] or 0) / fit["n"] if fit["n"] else 0.0
    strength = min(max(mean * (1 - mean) / fit["v"] - 1, 1.0), 1e6) if fit["v"] else 1e6 if fit["v"] == 0 else 1.0
    return hosts.withColumn("host_rate", (F.col("failed") + F.lit(strength * mean)) / (F.col("docs") + F.lit(strength)))


def host_verdicts(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None, rules: HostRules = HostRules()) -> DataFrame:
    """The kept columns (all by default) with the struct ``_q``, ``_base_failed``, ``_host_rate`` and ``_kept``."""
    docs = docs.drop(*RESULTS)
    keep = docs.columns if keep is None else [c for c in keep if c not in RESULTS]
    # Counted once and staged, with what is kept of the documents: hosts are summed from it, and verdicts joined to it.
    judged = stage_table(judge(rule_counts(docs, text, list(dict.fromkeys([*keep, host])), rules), rules), "quality-rules")
    of = free_name("_host", judged)
    rates = host_rates(judged, host).select(F.col("_host").alias(of), F.col("host_rate").alias("_host_rate"))
    out = judged.join(rates, judged[host].eqNullSafe(rates[of]), "left").drop(of)
    drop = F.col("_base_failed") | F.col("_grave") | (F.col("_mild") & (F.col("_host_rate") > rules.max_host_rate))
    return out.withColumn("_kept", ~drop)
