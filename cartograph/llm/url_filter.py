"""URL filters: rules first, a character language-model ratio for the rest.

A rule is ``host/path``; it fits its host and all subdomains if the url's path starts with
the rule's, and the longest rule that fits decides.  URLs that rules decide are the labelled
samples: two smoothed variable-order Markov models, of accepted and of rejected URLs, are
counted from four fifths of them, and the last fifth calibrates where the length-normalised
log-likelihood difference separates them.  A url without a rule is allowed if its difference
is not below that threshold.

Counts cover all labelled URLs; the model is bounded by its alphabet and order (40 ** 3
numbers).  All of it is DataFrame expressions.

Defined results: a null url, or one without ``://``, has empty host and path, no rule and
score 0.  An empty path, as of ``http://x.org?q``, fits no rule, since a rule's path starts
with a slash.  Without labelled URLs of both verdicts, every url without a rule is allowed.
Repeated rows each keep their row, an empty table gives no rows, and urls of any length are
read whole.  Columns named like those made here are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .markov import Alphabet, gram_counts, ratio_table, score

ALPHABET = Alphabet("abcdefghijklmnopqrstuvwxyz0.-/?=&#_%:+")
ORDER = 2


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"\A[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """``(rule, verdict)`` of the longest of ``rules`` (pattern, verdict) that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, outcome in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is asked first
        name, _, tail = pattern.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + tail)
        rule = F.when(fits, F.lit(pattern)).otherwise(rule)
        verdict = F.when(fits, F.lit(outcome)).otherwise(verdict)
    return rule, verdict


def _letters(url: Column) -> Column:
    """What the models read: after the scheme, lower case, digits alike."""
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    return F.regexp_replace(F.lower(F.when(F.instr(url, "://") > 0, rest).otherwise(F.lit(""))), "[0-9]", "0")


def judge_urls(
    pages: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", labelled: DataFrame | None = None,
) -> DataFrame:
    """``pages`` with host, path, rule, verdict and ``url_score`` (per character, less the
    threshold: at least 0 is allowed).

    ``labelled(url, label)`` with label 1 for accepted may replace the rules' own verdicts as
    samples.
    """
    made = ("host", "path", "rule", "verdict", "url_score")
    names = [F.col(f"`{c}`") for c in pages.columns if c not in made]
    host, path = host_and_path(F.col(f"`{url_col}`").cast("string"))
    split = pages.select(*names, host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    ruled = split.select("*", rule.alias("rule"), verdict.alias("__verdict"), _letters(F.col(f"`{url_col}`").cast("string")).alias("__letters"))
    if labelled is None:
        samples = ruled.where("rule is not null").select((F.col("__verdict") == "allow").cast("int").alias("label"), F.col("__letters").alias("value"))
    else:
        samples = labelled.select(F.col("label").cast("int").alias("label"), _letters(F.col("url")).alias("value")).where("label in (0, 1)")
    samples = samples.where("value <> ''")
    part = F.pmod(F.xxhash64("value"), F.lit(5))
    counts = gram_counts(samples.where(part != 0), ALPHABET, ORDER)
    table = threshold = None
    if {label for label, _, _ in counts} == {0, 1}:
        table = ratio_table(counts, ALPHABET, ORDER)
        each = score(F.col("value"), table, ALPHABET, ORDER) / F.length("value")
        stats = {
            r["label"]: r for r in samples.where(part == 0).select("label", each.alias("x")).groupBy("label")
            .agg(F.avg("x").alias("m"), F.coalesce(F.stddev_pop("x"), F.lit(0.0)).alias("d")).collect()
        }
        if set(stats) == {0, 1}:  # where both classes are equally many deviations away
            (m0, d0), (m1, d1) = ((stats[k]["m"], stats[k]["d"] + 1e-6) for k in (0, 1))
            threshold = round((m1 * d0 + m0 * d1) / (d0 + d1), 6)
        else:
            threshold = 0.0
    letters = F.col("__letters")
    if table is None:
        value = F.lit(0.0)
    else:
        value = F.when(letters == "", F.lit(0.0)).otherwise(score(letters, table, ALPHABET, ORDER) / F.length(letters) - F.lit(threshold))
    out = ruled.withColumn("url_score", value)
    own = F.when(F.col("url_score") >= 0, F.lit("allow")).otherwise(F.lit("block"))
    return out.select(*names, "host", "path", "rule", F.coalesce("__verdict", own).alias("verdict"), "url_score")
