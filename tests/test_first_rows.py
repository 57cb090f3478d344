"""Distributed selection against sorting."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import ranking
from tallyforge.operators.first_rows import By, cuts, first_per_key

SCHEMA = "repo string, seq long, ts timestamp, hash string, other int"
ORDER = ranking.LISTING


def rows(kind: str) -> list[tuple]:
    rng, start, out = random.Random(kind), datetime(2001, 1, 1), []
    for i in range(1500):
        repo = rng.choice(["hot", "hot", "hot", "b", "c", None])
        seq = {"mixed": rng.choice([None, rng.randrange(300)]), "seq": i, "alike": 7}.get(kind)
        ts = {"alike": start, "ts": start + timedelta(microseconds=rng.randrange(10**12)), "burst": start + timedelta(seconds=rng.choice([0, 0, 0, 0, rng.randrange(10**7)]))}.get(
            kind, rng.choice([None, start - timedelta(days=rng.randrange(20000))])
        )
        out.append((repo, seq, ts, f"{'same-prefix-' if i % 2 else ''}{rng.randrange(16**6):x}-{i}", i))
    return out


def place(row):
    _, seq, ts, key, _ = row
    micros = None if ts is None else -int((ts - datetime(1970, 1, 1)).total_seconds() * 10**6)
    return (seq is None, seq or 0, micros is None, micros or 0, key.encode())


@pytest.mark.parametrize("kind, count", [("mixed", 60), ("seq", 1), ("ts", 60), ("alike", 60), ("burst", 60)])
def test_first_rows_equal_sorting(spark, kind, count):
    own = rows(kind)
    df = spark.createDataFrame(own, SCHEMA)
    expected = []
    for repo in {r[0] for r in own}:
        expected += [r[4] for r in sorted((r for r in own if r[0] == repo), key=place)[:count]]
    assert sorted(r.other for r in first_per_key(df, ["repo"], ORDER, count).collect()) == sorted(expected)
    state, _ = cuts(df, ["repo"], ORDER, count)
    assert all(r.rows <= count for r in state.collect())


def test_rows_alike_in_everything_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1, None, "x", 0)] * 50 + [("a", 0, None, None, 1)] * 3, SCHEMA)
    got = [r.other for r in first_per_key(df, ["repo"], ORDER, 10).collect()]
    assert sorted(got) == [0] * 7 + [1] * 3
    assert first_per_key(df.where("false"), ["repo"], ORDER, 10).count() == 0
    two = first_per_key(df, ["repo", "other"], [By("seq", descending=True)], 2)
    assert sorted((r.other, r.seq) for r in two.collect()) == [(0, 1), (0, 1), (1, 0), (1, 0)]
    with pytest.raises(ValueError):
        first_per_key(df, ["repo"], [By("hash", "text"), By("seq")], 1)


def test_large_limits_of_commits(spark):
    df = spark.createDataFrame(rows("mixed"), SCHEMA)
    large = ranking.limit_commits(df.unionByName(df.withColumn("hash", F.concat("hash", F.lit("+")))), 1100)
    assert {r["repo"]: r["count"] for r in large.groupBy("repo").count().collect()}["hot"] == 1100
