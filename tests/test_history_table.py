"""The history as a table: what changes read and write, and what look-ups open."""

import datetime as dt
import glob
import os
import random

from pyspark.sql import functions as F

from palimpsest.operators import history as H
from palimpsest.sources.history_table import HistoryTable

SCAN = "id long, user_id long, token string, score int, verdict string, findings long, created_at timestamp"


def scans(n, start=0, seed=1):
    rng = random.Random(seed)
    return [(start + i, rng.choice([*range(30), None]), f"t{rng.random():.12f}", rng.randint(0, 100), "clean", 1, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 90_000))) for i in range(n)]


def content(df):
    return sorted(tuple(r) for r in df.select("id", "user_id", "token", "score", "created_at").fillna(-1, ["user_id"]).collect())


def files(path):
    return {p: (os.stat(p).st_mtime_ns, os.stat(p).st_size) for p in glob.glob(f"{path}/bucket=*/*.parquet")}


def of_bucket(paths):
    return {int(p.split("bucket=")[1].split("/")[0]) for p in paths}


def test_changes_rewrite_the_buckets_of_their_users(spark, tmp_path):
    path = str(tmp_path / "history")
    table, old = HistoryTable(spark, path, buckets=16), spark.createDataFrame(scans(900), SCAN)
    table.create(H.retain(old, 20))
    assert content(table.read()) == content(H.retain(old, 20))
    before = files(path)
    new = spark.createDataFrame([(2000 + i, 7 if i < 30 else None, f"n{i}", 50, "review", 2, dt.datetime(2025, 1, 1) + dt.timedelta(days=i)) for i in range(31)], SCAN)
    touched = table.save(new, 20)
    expected = H.save(H.retain(old, 20), new, 20)
    assert content(table.read()) == content(expected) and len(touched) <= 2
    after = files(path)
    assert of_bucket(p for p in before if after.get(p) != before[p]) | of_bucket(set(after) - set(before)) <= set(touched)
    plan = table.read(touched)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan
    table.save(new, 20)  # once more changes nothing
    assert content(table.read()) == content(expected)


def test_deleting_and_claiming(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = scans(300, seed=3)
    table, old = HistoryTable(spark, path, buckets=8), spark.createDataFrame(rows, SCAN)
    table.create(old)
    gone = spark.createDataFrame([(t, u) for _, u, t, *_ in rows[:40]] + [(rows[50][2], 999), ("nobody", None)], "token string, user_id long")
    table.delete(gone)
    assert content(table.read()) == content(H.delete(old, gone)) and table.read().count() == 260
    everything_of_5 = table.read().where("user_id = 5").select("token", "user_id")
    alone = HistoryTable(spark, str(tmp_path / "alone"), buckets=8)
    alone.create(old.where("user_id = 5"))
    alone.delete(everything_of_5.unionByName(gone))
    assert alone.read().count() == 0 and alone.save(old.limit(0)) == []
    guests = [r for r in rows[40:] if r[1] is None]
    claims = spark.createDataFrame([(guests[0][2], 3), (guests[0][2], 9), (guests[1][2], 4), (rows[45][2], 1) if rows[45][1] is not None else ("x", 1), (None, 2)], "token string, claimed_by long")
    expected = content(H.claim(table.read().drop("bucket"), claims))
    table.claim(claims)
    assert content(table.read()) == expected
    recent = [r["id"] for r in table.recent(3, 5).collect()]
    assert recent == [r["id"] for r in H.recent(table.read(), 3, 5).collect()] and guests[0][0] in {r["id"] for r in table.recent(3, 500).collect()}
    assert [tuple(r) for r in table.stats(3).collect()] == [tuple(r) for r in H.user_stats(table.read().where("user_id = 3")).collect()]


def test_a_look_up_opens_few_row_groups(spark, tmp_path):
    rows = [(i, i % 50, f"{(i * 2654435761) % 2**32:010d}", 1, "clean", 0, dt.datetime(2024, 1, 1)) for i in range(60_000)]
    table = HistoryTable(spark, str(tmp_path / "history"), buckets=4, row_group_bytes=16 << 10)
    table.create(spark.createDataFrame(rows, SCAN).repartition(4))
    found = table.by_token(rows[777][2])
    assert [r["id"] for r in found.collect()] == [777]
    leaf = found._jdf.queryExecution().executedPlan().collectLeaves()
    read = sum(leaf.apply(i).metrics().apply("numOutputRows").value() for i in range(leaf.size()))
    assert 1 <= read < 6000, read  # of 60000; nothing but filters on row groups and pages can leave rows out before the scan gives them
    assert table.by_token("nobody").count() == 0
