"""Scores and verdicts of documents from their findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from palimpsest.functions import lexicon as X


def severity_order(severity: Column) -> Column:
    """0 for critical to 4 for info."""
    return F.coalesce(*(F.when(severity == s, F.lit(i)) for i, s in enumerate(X.SEVERITIES)), F.lit(len(X.SEVERITIES)))


def verdict(score: Column) -> Column:
    """The band of a score."""
    out = F.lit(X.BANDS[-1][1])
    for low, name in reversed(X.BANDS[:-1]):
        out = F.when(score >= low, F.lit(name)).otherwise(out)
    return out


def score_findings(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, findings, score, verdict): within a code the gravest counts in full, the second 0.4, others 0.15 of their weight.

    In twentieths (20, 8, 3), so that the sum is exact; rounded half to even, 100 at most. Rows are counted by code and
    severity before they are ranked, so a document with any number of findings is 20 rows by 5 at most.
    """
    counts = findings.groupBy(key, "code", "severity").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(key, "code").orderBy(severity_order(F.col("severity"))).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    c = counts.withColumn("before", before)
    first, second = F.when(F.col("before") == 0, 1).otherwise(0), F.when((F.col("before") <= 1) & (F.col("before") + F.col("n") >= 2), 1).otherwise(0)
    twentieths = F.col("weight") * (20 * first + 8 * second + 3 * (F.col("n") - first - second))
    total = c.groupBy(key).agg(F.sum("n").alias("findings"), F.sum(twentieths).alias("twentieths"))
    score = F.least(F.lit(100), F.bround(F.col("twentieths") / 20.0).cast("int"))
    return total.select(key, "findings", score.alias("score"), verdict(score).alias("verdict"))


def severity_counts(findings: DataFrame, *keys: str) -> DataFrame:
    """Counts of each severity, and of all."""
    return findings.groupBy(*keys).agg(*(F.count_if(F.col("severity") == s).alias(s) for s in X.SEVERITIES), F.count("*").alias("total"))
