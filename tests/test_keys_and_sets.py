"""Filters of wanted keys, and the similarity join, against plain versions."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge import schema
from tallyforge.operators import codestats, trends
from tallyforge.operators.keyfilter import key_filter, possible
from tallyforge.operators.setsim import similar_sets
from tallyforge.plans.analyze import Options, Portfolio, analyze


def moved(df) -> list[str]:
    """Columns that each exchange of a plan moves."""
    plan = df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    return [found for found in re.findall(r"\(\d+\) (?:Broadcast)?Exchange\nInput \[\d+\]: \[(.*)\]", plan)]


@pytest.mark.parametrize("expected", [None, 1, 10**9])
def test_no_wanted_row_is_lost(spark, expected):
    rows = spark.range(20_000).select(
        (F.col("id") % 50).cast("string").alias("repo"), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).alias("hash"), F.lit("x").alias("content")
    )
    keys = rows.where("xxhash64(repo, hash, 1) % 40 = 0").select("repo", "hash").distinct()
    kept = {tuple(r) for r in possible(rows, keys, expected).select("repo", "hash").distinct().collect()}
    wanted = {tuple(r) for r in keys.collect()}
    assert wanted <= kept and any(h is None for _, h in wanted)
    if expected != 1:
        assert len(kept) - len(wanted) < 0.06 * rows.select("repo", "hash").distinct().count()
    assert possible(rows, keys.where("false")).count() == 0
    assert key_filter(keys, 10**12)[1] == 32_768


def test_trees_of_no_interest_are_not_counted_and_contents_do_not_move(spark):
    files = spark.createDataFrame([(f"r{i % 20}", f"c{i}", "a.py", b"x = 1\n" * (i + 1)) for i in range(400)], schema.FILES)
    snapshots = spark.createDataFrame([(f"r{i % 20}", 1, "2000-01", f"c{i}") for i in range(0, 400, 10)], "repo string, period_no int, period string, commit_hash string")
    counted = trends.snapshot_languages(snapshots, files)
    assert {(r.commit_hash, r.code) for r in counted.collect()} == {(f"c{i}", i + 1) for i in range(0, 400, 10)}
    passed = possible(files, snapshots.select("repo", "commit_hash"))
    assert 40 <= passed.count() < 60
    exchanges = moved(counted)
    assert exchanges and not any("content" in columns for columns in exchanges)


def test_analysis_counts_present_trees_only(spark, monkeypatch):
    files = [("a", None, "now.py", b"x = 1\n"), *[("a", f"c{i}", "old.py", b"y = 2\n") for i in range(300)], ("b", "only", "b.py", b"z = 3\n"), ("c", "c1", "c.py", b"1\n"), ("c", "c2", "c.py", b"1\n")]
    repos = [(r, "github", r, r, "", f"https://h/o/{r}", "", "", "", False, False) for r in "abc"] + [("d", "github", "d", "d", "", "https://h/o/d", "", "", "", False, True)]
    seen = []
    original = codestats.file_stats
    monkeypatch.setattr(codestats, "file_stats", lambda df, **more: seen.append(df) or original(df, **more))
    tables = Portfolio(repos=spark.createDataFrame(repos, schema.REPOS), files=spark.createDataFrame([*files, ("d", None, "d.py", b"4\n")], schema.FILES))
    result = analyze(tables, Options(), "2001-01-01 00:00:00")
    assert {(r.repo, r.code) for r in result.totals.collect()} == {("a", 1), ("b", 1)}
    assert [r.repo for r in result.errors.collect()] == ["c"]
    assert seen[0].count() < 20 and not any("content" in columns for columns in moved(seen[0]))


@pytest.mark.parametrize("threshold", [0.05, 0.5, 0.85])
def test_similar_sets_equal_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 100))
    base = [rng.sample(range(60), rng.randrange(1, 40)) for _ in range(12)]
    def near(members):
        out = set(members) ^ set(rng.sample(range(90), rng.randrange(0, 6)))
        return sorted(out, key=lambda _: rng.random())
    left = [(f"l{i}", near(rng.choice(base))) for i in range(120)] + [("none", []), ("far", list(range(1000, 1100))), ("same", base[0])]
    right = [(f"r{i}", m) for i, m in enumerate(base + [near(b) for b in base] + [[], base[3]])]
    got = similar_sets(spark.createDataFrame(left, "id string, members array<long>"), spark.createDataFrame(right, "id string, members array<long>"), threshold)
    expected = {}
    for a, x in left:
        for b, y in right:
            union = len(set(x) | set(y))
            if x and y and len(set(x) & set(y)) / union >= threshold:
                expected[a, b] = len(set(x) & set(y)) / union
    rows = got.collect()
    assert len(rows) == len(expected) and {(r.left_id, r.right_id): r.similarity for r in rows} == expected
    assert expected
