"""The history of scans: tables of (id, user_id, token, filename, sha256, bytes, score, verdict, findings, source, report, created_at)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from palimpsest.functions.lexicon import RETENTION


def _flagged():
    return F.col("verdict").isin("poisoned", "suspicious")


def recent(scans: DataFrame, user_id: int, n: int = 50) -> DataFrame:
    """A user's newest scans, without their reports."""
    return scans.where(F.col("user_id") == user_id).drop("report").orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def retain(scans: DataFrame, n: int = RETENTION) -> DataFrame:
    """The newest ``n`` scans of each user; those without a user stay.

    The limit on the rank is also applied where rows are read (``WindowGroupLimit``, Partial), so of a user no task sends more than ``n`` rows on.
    """
    rank = F.row_number().over(W.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id")))
    kept = scans.where("user_id is not null").withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")
    return kept.unionByName(scans.where("user_id is null"))


def user_stats(scans: DataFrame) -> DataFrame:
    """Per user: scans, flagged, findings, worst."""
    return scans.where("user_id is not null").groupBy("user_id").agg(F.count("*").alias("scans"), F.count_if(_flagged()).alias("flagged"), F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"), F.coalesce(F.max("score"), F.lit(0)).alias("worst"))


def platform_stats(scans: DataFrame, users: DataFrame) -> DataFrame:
    """One row: scans, flagged, findings, users."""
    one = scans.agg(F.count("*").alias("scans"), F.count_if(_flagged()).alias("flagged"), F.coalesce(F.sum("findings"), F.lit(0)).alias("findings"))
    return one.join(users.agg(F.count("*").alias("users")))


def claim(scans: DataFrame, claims: DataFrame) -> DataFrame:
    """Scans without a user that users claim by their token, rows (token, claimed_by), get the user; of several the one with the smallest id."""
    first = claims.where("token is not null").groupBy("token").agg(F.min("claimed_by").alias("claimed_by"))
    return scans.join(first, "token", "left").withColumn("user_id", F.coalesce("user_id", "claimed_by")).select(*scans.columns)


def delete(scans: DataFrame, gone: DataFrame) -> DataFrame:
    """The scans but those that rows (token, user_id) name; a null user_id names a guest's scan."""
    gone = gone.select(F.col("token").alias("gone_token"), F.col("user_id").alias("gone_user"))
    return scans.join(gone, (scans["token"] == gone["gone_token"]) & scans["user_id"].eqNullSafe(gone["gone_user"]), "left_anti")


def by_token(scans: DataFrame, token: str) -> DataFrame:
    """The scan with a token, with its report."""
    return scans.where(F.col("token") == token)


def by_id(scans: DataFrame, scan_id: int) -> DataFrame:
    """The scan with an id, with its report."""
    return scans.where(F.col("id") == scan_id)


def guest_tokens(tokens: Column, token: Column, n: int = 10) -> Column:
    """A guest's tokens with one more: the last ``n``, the newest last."""
    all_of = F.array_append(F.coalesce(tokens, F.array().cast("array<string>")), token)
    return F.slice(all_of, F.greatest(F.size(all_of) - (n - 1), F.lit(1)), n)


def save(scans: DataFrame, new: DataFrame, n: int = RETENTION) -> DataFrame:
    """The history with new scans, in which users that have new ones are trimmed. Nobody else's scans are ranked or move."""
    touched = new.where("user_id is not null").select("user_id").distinct()
    others = scans.join(touched, "user_id", "left_anti").unionByName(new.where("user_id is null"))
    return others.select(*scans.columns).unionByName(retain(scans.join(touched, "user_id", "left_semi").select(*scans.columns).unionByName(new.where("user_id is not null")), n))


def quarantine(scored: DataFrame, from_score: int = 35) -> DataFrame:
    """Scored documents with their route: quarantine or model."""
    return scored.withColumn("route", F.when(F.col("score") >= from_score, "quarantine").otherwise("model"))
