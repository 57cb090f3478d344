"""Operators on the small cases that fix their meaning."""

import pytest
from pyspark.sql import functions as F

from tallyforge import schema
from tallyforge.operators import authorship, churn, health, license, ranking, selection, trends
from tallyforge.plans import reports, tables

NOW = "2026-02-23 00:00:00"


def commits(spark, *rows):
    """Rows of repo, hash, author, message, instant text."""
    df = spark.createDataFrame(
        [(repo, hash_, author, message, ts, seq) for seq, (repo, hash_, author, message, ts) in enumerate(rows)],
        "repo string, hash string, author string, message string, t string, seq bigint",
    )
    ts = F.to_timestamp("t")
    return df.select("repo", "hash", "author", "message", ts.alias("ts"), ts.alias("committer_ts"), "seq")


def stats(spark, rows):
    return spark.createDataFrame([(r, h, a, d, e) for r, h, a, d, e in rows], schema.COMMIT_STATS)


def repos(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "repo string")


def test_limit_keeps_listing_order(spark):
    df = commits(spark, *[("r", f"h{i}", "a", "m", f"2025-01-{i + 1:02d} 00:00:00") for i in range(9)], ("s", "x", "a", "m", None))
    got = {(r.repo, r.hash) for r in ranking.limit_commits(df, 3).collect()}
    assert got == {("r", "h0"), ("r", "h1"), ("r", "h2"), ("s", "x")}
    newest = ranking.limit_commits(df.withColumn("seq", F.lit(None).cast("bigint")), 2).collect()
    assert {(r.repo, r.hash) for r in newest} == {("r", "h8"), ("r", "h7"), ("s", "x")}
    assert ranking.limit_commits(df, 0).count() == 10


@pytest.mark.parametrize("buckets", [1, 7, 200])
def test_top_per_key_is_exact_for_a_hot_key(spark, buckets):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("k"),
        F.pmod(F.hash("id"), F.lit(100)).alias("v"), "id",
    )
    order = [F.col("v").desc(), F.col("id").asc()]
    got = ranking.top_per_key(df, ["k"], order, 20, spread=["id"], buckets=buckets, rank_column="rank").collect()
    expected = {}
    for row in sorted(df.collect(), key=lambda r: (-r.v, r.id)):
        expected.setdefault(row.k, []).append(row.id)
    assert {(r.k, r["rank"], r.id) for r in got} == {
        (k, i, id_) for k, ids in expected.items() for i, id_ in enumerate(ids[:20], start=1)
    }


def test_ai_estimate(spark):
    df = commits(
        spark,
        ("r", "aaa", "Jo <jo@x>", "feat\n\nCo-Authored-By: Claude <c@x>", "2025-01-03 00:00:00"),
        ("r", "bbb", "Jo <jo@x>", "manual", "2025-01-02 00:00:00"),
        ("r", "ccc", "renovate[bot]", "bump", "2025-01-01 00:00:00"),
        ("r", "ddd", "renovate[bot]", "unknown size", "2024-01-01 00:00:00"),
    )
    known = stats(spark, [("r", "aaa", 100, 10, None), ("r", "ccc", 50, 5, None), ("r", "ddd", 7, 7, "status 403")])
    rows = {r.repo: r for r in authorship.ai_by_repo(repos(spark, "r", "none"), df, known).collect()}
    assert (rows["r"].total_commits, rows["r"].ai_commits, rows["r"].commit_percent, rows["r"].ai_additions) == (4, 3, 75.0, 150)
    assert (rows["none"].total_commits, rows["none"].commit_percent, rows["none"].ai_additions) == (0, 0.0, 0)
    details = {r.hash: r for r in authorship.ai_details(df, known).collect()}
    assert set(details) == {"aaa", "ccc"}
    assert (details["aaa"].message, details["aaa"].signals) == ("feat", ["co-author"])
    errors = [r.message for r in authorship.ai_partial_errors(df, known).collect()]
    assert errors == ["CommitStats ddd: status 403"]
    limited = authorship.ai_by_repo(repos(spark, "r"), df, known, 2).first()
    assert (limited.total_commits, limited.ai_commits, limited.ai_additions) == (2, 1, 100)
    assert authorship.ai_over_all(authorship.ai_by_repo(repos(spark), df, known)).count() == 0


def test_health_classes(spark):
    df = commits(
        spark,
        ("mixed", "a", "x", "m", "2025-01-19 00:00:00"),
        ("mixed", "b", "x", "m", "2026-02-13 00:00:00"),
        ("mixed", "c", "x", "m", "2025-08-07 00:00:00"),
        ("undated", "d", "x", "m", None),
        ("broken", "e", "x", "m", "2026-02-13 00:00:00"),
        ("future", "f", "x", "m", "2027-02-13 00:00:00"),
    )
    failed = spark.createDataFrame([("broken", "status 403")], "repo string, error string")
    names = ["mixed", "undated", "broken", "future", "none"]
    rows = {r.repo: r for r in health.repo_health(repos(spark, *names), df, NOW, failures=failed, limit=0).collect()}
    assert {n: (r.category, r.days_since_commit, r.last_commit_date) for n, r in rows.items()} == {
        "mixed": ("active", 10, "2026-02-13T00:00:00Z"),
        "undated": ("abandoned", -1, ""),
        "broken": ("failed", -1, ""),
        "future": ("active", 0, "2027-02-13T00:00:00Z"),
        "none": ("abandoned", -1, ""),
    }
    assert rows["broken"].error == "status 403"
    first = {r.repo: r.days_since_commit for r in health.repo_health(repos(spark, "mixed"), df, NOW, limit=1).collect()}
    assert first == {"mixed": 400}  # only the first listed commit is read
    assert [r.days_since_commit for r in health.repo_health(repos(spark, "mixed"), df, NOW).collect()] == [10]  # all, unless asked otherwise


def test_health_details(spark):
    df = commits(
        spark,
        ("r", "a1", "Alice <alice@x>", "m", "2026-01-23 00:00:00"),
        ("r", "a2", "Bob <bob@x>", "m", "2025-12-23 00:00:00"),
        ("r", "a3", "alice <ALICE@x>", "m", "2025-06-23 00:00:00"),
        ("r", "a4", "Charlie <charlie@x>", "m", "2024-11-23 00:00:00"),
        ("s", "b1", "Dan", "m", "2026-01-23 00:00:00"),
    )
    known = stats(spark, [("r", "a1", 100, 20, None), ("r", "a2", 50, 10, None), ("r", "a3", 200, 50, None), ("r", "a4", 30, 5, None)])
    authors = health.author_windows(df, known, NOW)
    windows = {(r.repo, r.window): r for r in health.window_details(authors).collect()}
    recent = windows["r", "0-6mo"]
    assert (recent.authors, recent.commits, recent.additions, recent.deletions, recent.net_churn) == (2, 2, 150, 30, 120)
    assert (windows["r", "6-12mo"].authors, windows["r", "12mo+"].authors) == (1, 1)
    assert set(windows) == {("r", "0-6mo"), ("r", "6-12mo"), ("r", "12mo+"), ("s", "0-6mo")}
    assert (windows["s", "0-6mo"].commits, windows["s", "0-6mo"].additions) == (1, 0)
    assert {r.repo: r.bus_factor for r in health.bus_factor(authors).collect()} == {"r": 50.0, "s": 100.0}
    assert {r.repo: r.velocity_trend for r in health.velocity(authors).collect()} == {"r": 2.0, "s": 0.0}
    assert [r.message for r in health.health_partial_errors(df, known).collect()] == ["CommitStats b1: no statistics"]


def test_health_summary(spark):
    def summary(*rows):
        frame = spark.createDataFrame([(str(i), c, n) for i, (c, n) in enumerate(rows)], "repo string, category string, code bigint")
        return {r.category: r for r in health.health_summary(frame, frame).collect()}

    mixed = summary(("active", 1000), ("maintained", 2000), ("abandoned", 7000))
    assert (mixed["active"].repos, mixed["active"].code, mixed["active"].code_percent) == (1, 1000, 10.0)
    assert (mixed["abandoned"].code_percent, mixed["failed"].repos) == (70.0, 0)
    failed = summary(("active", 1000), ("failed", 500))
    assert (failed["failed"].repos, failed["failed"].code, failed["active"].code_percent) == (1, 500, 100.0)
    assert summary() == {}


def test_churn_and_hotspots(spark):
    df = commits(spark, *[("r", h, "a", "m", f"2025-01-0{9 - i} 00:00:00") for i, h in enumerate(["aaa", "bbb", "ccc", "nofiles"])])
    files = spark.createDataFrame(
        [
            ("r", "aaa", "main.go", 50, 10), ("r", "aaa", "util.go", 20, 5), ("r", "bbb", "main.go", 30, 5),
            ("r", "ccc", "main.go", 10, 2), ("r", "ccc", "README.md", 5, 0), ("r", "ccc", "README.md", 1, 0),
            ("r", "other", "main.go", 1, 1),
        ],
        schema.COMMIT_FILES,
    )
    rows = [tuple(r) for r in churn.top_files(churn.file_churn(df, files)).orderBy("rank").collect()]
    assert rows == [("r", "main.go", 3, 90, 17, 1), ("r", "README.md", 2, 6, 0, 2), ("r", "util.go", 1, 20, 5, 3)]
    assert churn.scanned_commits(df).first().total_commits == 4
    assert churn.scanned_commits(df, 1).first().total_commits == 1
    assert {r.path for r in churn.file_churn(df, files, 1).collect()} == {"main.go", "util.go"}

    changed = spark.createDataFrame(
        [("r", "complex.go", 10, 0, 0), ("r", "simple.go", 20, 0, 0), ("r", "util.go", 5, 0, 0), ("r", "gone.go", 9, 0, 0), ("r", "flat.go", 9, 0, 0)],
        "repo string, path string, changes bigint, additions bigint, deletions bigint",
    )
    complexity = spark.createDataFrame([("r", "complex.go", 50), ("r", "simple.go", 2), ("r", "util.go", 10), ("r", "flat.go", 0)], "repo string, path string, complexity bigint")
    hot = [(r.path, r.hotspot) for r in churn.hotspots(changed, complexity).orderBy("rank").collect()]
    assert hot == [("complex.go", 500.0), ("util.go", 50.0), ("simple.go", 40.0)]
    assert churn.hotspots(changed, complexity, 1).count() == 1
    assert churn.hotspots(changed, complexity, 0).count() == 3


MIT = """MIT License

Copyright (c) 2024 {}

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""


def test_license(spark):
    files = spark.createDataFrame(
        [
            ("mit", None, "LICENSE", MIT.format("Jo Doe and Others, Inc.").encode()),
            ("mit", None, "COPYING.md", b"see LICENSE"),
            ("deep", None, "docs/LICENSE", MIT.encode()),
            ("other", None, "licence.txt", b"All rights reserved."),
            ("empty", None, "LICENSE", b""),
            ("code", None, "main.go", MIT.encode()),
        ],
        schema.FILES,
    )
    corpus = spark.createDataFrame([("MIT", MIT.format("<holder>")), ("X11", MIT.replace("sublicense", "lend") + " Not for advertising."), ("ISC", "Permission to use, copy, modify")], "spdx string, text string")
    found = {r.repo: r.license for r in license.repo_license(license.license_files(files), corpus).collect()}
    assert found == {"mit": "MIT"}


def test_license_texts_are_taken_apart_once(spark):
    """A filter on the number of words or shingles would make them a second time."""
    from pyspark.sql import Row

    files = spark.createDataFrame([("a", "LICENSE", bytearray(MIT.encode())), ("b", "LICENSE", bytearray(b"few words")), ("c", "LICENSE", None)], "repo string, path string, content binary")
    sets = license.license_sets(files, Row(least=20, most=400))
    assert [r.repo for r in sets.collect()] == ["a"]
    plan = sets._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("copyright"), plan.count("array_distinct")) == (1, 1)


def test_shingles_are_hashes_of_runs_of_words(spark):
    rows = spark.createDataFrame([(["a", "b", "c", "d", "b", "c", "d"],), (["a", "b"],), (["a"],), ([],)], "words array<string>")
    runs = "IF(size(words) > 0, array_distinct(transform(sequence(1, greatest(size(words) - 2, 1)), i -> xxhash64(slice(words, i, 3)))), array())"
    for row in rows.select(license.shingles(F.col("words")).alias("got"), F.expr(runs).alias("wanted")).collect():
        assert row.got == row.wanted


def test_license_corpora(spark, tmp_path):
    from tallyforge.sources.licenses import read_corpus

    (tmp_path / "X11-like.txt").write_text(MIT.replace("sublicense", "lend") + "Not for advertising without permission of the holder.")
    (tmp_path / "Own-1.0").write_text("Do as you like with it but tell your friends about it " * 9 + "and be kind.")
    corpus = license.public_corpus(spark).unionByName(read_corpus(spark, str(tmp_path)))
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "Unlicense", "Zlib", "BSL-1.0", "X11-like", "Own-1.0"} == {r.spdx for r in corpus.collect()}
    texts = {r.spdx: r.text for r in corpus.collect()}
    files = spark.createDataFrame([(spdx, None, "LICENSE", text.replace("<owner>", "Jo").upper().encode()) for spdx, text in texts.items()], schema.FILES)
    found = {(r.repo, r.license) for r in license.repo_license(license.license_files(files), corpus).collect()}
    assert found == {(spdx, spdx) for spdx in texts}
    assert license.license_matches(license.license_files(files), corpus.where("false")).collect() == []


def test_select_repos(spark):
    rows = [
        ("1", "github", "a", "", "https://h/org/a", False, False),
        ("2", "github", "fork", "", "https://h/org/fork", False, True),
        ("3", "github", "old", "", "https://h/org/old", True, False),
        ("4", "bitbucket", "b", "P1", "https://h/ws/b", False, False),
        ("5", "bitbucket", "c", "P2", "https://h/ws/c", False, False),
        ("6", "gitlab", "d", "grp/sub", "https://h/grp/sub/d", False, False),
        ("7", "gitlab", "e", "grpx", "https://h/grpx/e", False, False),
    ]
    df = spark.createDataFrame(rows, "repo string, provider string, slug string, project string, url string, archived boolean, fork boolean")

    def chosen(**options):
        return "".join(sorted(r.repo for r in selection.select_repos(df, **options).collect()))

    assert chosen() == "14567"
    assert chosen(include_forks=True) == "124567"
    assert chosen(include_archived=True) == "134567"
    assert chosen(projects=["P1"]) == "1467"
    assert chosen(include=["a", "b"], exclude=["b"]) == "1"
    assert chosen(include=["A"]) == ""
    assert chosen(exclude=["a"]) == "4567"
    assert chosen(owner="grp") == "6"
    assert chosen(owner="ws") == "45"
    many = [f"x{i}" for i in range(2000)]
    assert chosen(include=[*many, "a"]) == "1"
    assert chosen(exclude=[*many, "a"]) == "4567"


def calendar(spark, *args):
    return [(r.period_no, r.period, str(r.period_end)) for r in trends.period_calendar(spark, *args).orderBy("period_no").collect()]


def test_period_calendar(spark):
    assert calendar(spark, "2025-01", "2025-03", "monthly") == [
        (1, "2025-01", "2025-01-31 23:59:59"), (2, "2025-02", "2025-02-28 23:59:59"), (3, "2025-03", "2025-03-31 23:59:59"),
    ]
    assert [p[1] for p in calendar(spark, "2025-01-01", "2025-01-22", "weekly")] == ["2025-01-01", "2025-01-08", "2025-01-15", "2025-01-22"]
    assert [p[1] for p in calendar(spark, "2024-11", "2025-02", "monthly")] == ["2024-11", "2024-12", "2025-01", "2025-02"]
    for bad in [("2025-1", "2025-03", "monthly"), ("2025-03", "2025-01", "monthly"), ("2025-13", "2026-03", "monthly"), ("2025-01", "2025-03", "daily"), ("2025-01", "2025-03", "weekly")]:
        assert calendar(spark, *bad) == []


def test_commits_at_periods(spark):
    df = commits(
        spark,
        ("r", "h1", "a", "m", "2025-01-15 00:00:00"), ("r", "h2", "a", "m", "2025-02-20 00:00:00"),
        ("r", "h3", "a", "m", "2025-03-10 00:00:00"), ("late", "x", "a", "m", "2025-04-01 00:00:00"),
    )
    got = {(r.repo, r.period): r.commit_hash for r in trends.commits_at_periods(df, "2024-12", "2025-03", "monthly").collect()}
    assert got == {("r", "2025-01"): "h1", ("r", "2025-02"): "h2", ("r", "2025-03"): "h3"}
    assert trends.commits_at_periods(df, "2025-03", "2025-01", "monthly").count() == 0


def test_commits_at_periods_equals_the_range_join(spark):
    """Two clocks that disagree, one repository with most commits; against brute force."""
    base = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    df = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise((F.col("id") % 40).cast("string")).alias("repo"),
        F.col("id").cast("string").alias("hash"),
        (base + F.make_dt_interval(F.pmod(F.hash("id"), F.lit(700)).cast("int"))).alias("ts"),
        (base + F.make_dt_interval(F.pmod(F.hash(F.col("id") + 7), F.lit(90)).cast("int"))).alias("committer_ts"),
    )
    for since, until, interval in [("2024-03", "2025-06", "monthly"), ("2024-05-08", "2024-09-30", "weekly")]:
        got = {(r.repo, r.period): r.commit_hash for r in trends.commits_at_periods(df, since, until, interval).collect()}
        expected = {}
        rows = df.collect()
        for period in trends.period_calendar(spark, since, until, interval).collect():
            for row in rows:
                if row.ts <= period.period_end:
                    key = (row.repo, period.period)
                    expected[key] = max(expected.get(key, (row.committer_ts, "")), (row.committer_ts, row.hash))
        assert got == {k: v[1] for k, v in expected.items()}


def test_snapshots(spark):
    at = spark.createDataFrame([("r", 1, "p1", "c1"), ("r", 2, "p2", "c1"), ("r", 3, "p3", "c2"), ("r", 4, "p4", "lost")], "repo string, period_no int, period string, commit_hash string")
    files = spark.createDataFrame(
        [("r", "c1", "a.py", b"x\n"), ("r", "c2", "a.py", b"x\ny\n"), ("r", "c2", "vendor/a.py", b"x\n"), ("r", "c9", "a.py", b"x\n")], schema.FILES
    )
    kept = trends.with_tree(at, files)
    sums = trends.snapshot_languages(kept, files)
    by_repo = trends.trend_repos(kept, sums)
    assert {(r.period, r.code) for r in by_repo.collect()} == {("p1", 1), ("p2", 1), ("p3", 2)}
    calendar_ = spark.createDataFrame([(i, f"p{i}") for i in range(1, 6)], "period_no int, period string")
    rows = trends.trend_totals(calendar_, by_repo).orderBy("period_no").collect()
    assert [(r.repos, r.code, r.code_delta) for r in rows] == [(1, 1, None), (1, 1, 0), (1, 2, 1), (0, 0, -2), (0, 0, None)]
    matrix = trends.code_matrix(by_repo, "repo", ["p1", "p2", "p3", "p4"]).collect()
    assert [tuple(r) for r in matrix] == [("r", 1, 1, 2, 0)]
    assert [r.delta_label for r in tables.period_table(trends.trend_totals(calendar_, by_repo)).collect()] == ["", "+0", "+1", "-2", ""]


def test_split_and_projects(spark):
    repos_ = spark.createDataFrame([("1", "a", "P1", "u"), ("2", "b", "P2", "u"), ("3", "c", "P1", "u"), ("4", "bad", "P1", "u"), ("5", "no-project", "", "u")], "repo string, slug string, project string, url string")
    failures = spark.createDataFrame([("4", "clone failed")], "repo string, error string")
    good, errors = reports.split_results(repos_, failures)
    assert [(r.repository, r.error) for r in errors.collect()] == [("bad", "clone failed")]
    totals = spark.createDataFrame([("1", 100, 10, 1), ("2", 500, 0, 2), ("3", 200, 0, 3), ("5", 0, 0, 0)], "repo string, code bigint, comments bigint, complexity bigint")
    listed = tables.repos_by_project(good, totals).collect()
    assert [(r.project, r.repository) for r in listed] == [("P2", "b"), ("P1", "c"), ("P1", "a"), ("", "no-project")]
    table = tables.project_table(tables.project_rollup(good, totals)).collect()
    assert [(r.project, r.repos, r.code_lines) for r in table] == [("P2", 1, "500"), ("P1", 2, "300"), ("", 1, "0"), ("TOTAL", 4, "800")]
    assert [r.repository for r in tables.top_repos(good, totals, 2).collect()] == ["b", "c"]
    flags = tables.sections(good).first()
    assert (flags.has_groups, flags.has_ai, flags.has_churn) == (True, False, False)


def test_labels_of_tables(spark):
    labels = spark.createDataFrame([("active", 12), ("abandoned", -1), ("failed", -1), (None, None)], "c string, d int").select(tables.health_label(F.col("c"), F.col("d")))
    assert [r[0] for r in labels.collect()] == ["Active (12d)", "Abandoned (no commits)", "Failed (error)", "—"]
    totals = spark.createDataFrame([(1, 2, 3, 4, 5, 6, 7, 0)], "repos bigint, files bigint, lines bigint, code bigint, comments bigint, blanks bigint, complexity bigint, filtered_files bigint")
    assert [r.metric for r in tables.summary_table(totals).collect()][-1] == "Complexity"
    ai = spark.createDataFrame([(10, 4, 40.0, 0)], "total_commits bigint, ai_commits bigint, commit_percent double, ai_additions bigint")
    assert [tuple(r) for r in tables.ai_table(ai).collect()] == [(1, "Commits", "10", 4, "40.0%")]
