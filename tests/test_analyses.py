"""Whole analyses from tables to written reports."""

import json

import pytest
from pyspark.sql import functions as F

from tallyforge import schema
from tallyforge.plans.analyze import Options, Portfolio, analyze, analyze_trends
from tallyforge.plans.tables import report_tables
from tallyforge.sinks.reports import write_report, write_trends_report
from tallyforge.sources import reports as report_source

NOW = "2026-02-23 00:00:00"


def portfolio(spark):
    repos = spark.createDataFrame(
        [
            (n, "bitbucket", n, n, "PROJ1" if n != "lone" else "", f"https://h/ws/{n}", "", "", "main", False, n == "fork")
            for n in ("one", "two", "empty", "bad", "fork", "lone")
        ],
        schema.REPOS,
    )
    files = spark.createDataFrame(
        [
            ("one", "c1", "main.go", b"package main\n\n// note\nfunc main() { if a == b {} }\n"),
            ("one", "c1", "gen.go", b"// Code generated x\n"),
            ("two", "c2", "a.py", b"import os\n"),
            ("two", "c2", "b.go", b"package b\n"),
            ("fork", "c3", "a.py", b"import os\n"),
            ("lone", "c4", "a.py", b"if x:\n  y\n"),
            ("bad", "c5", "half.py", b"x\n"),
        ],
        schema.FILES,
    )
    rows = [
        ("one", "c1", "Jo <jo@x>", "feat\n\nCo-Authored-By: Claude <c@x>", "2026-02-13 00:00:00"),
        ("one", "c0", "Al <al@x>", "plain", "2025-06-13 00:00:00"),
        ("two", "c2", "bot[bot]", "bump", "2025-03-01 00:00:00"),
        ("lone", "c4", "Jo <jo@x>", "x", "2024-01-01 00:00:00"),
        ("fork", "c3", "bot[bot]", "x", "2026-01-01 00:00:00"),
        ("bad", "c5", "bot[bot]", "x", "2026-01-01 00:00:00"),
    ]
    ts = F.to_timestamp("t")
    commits = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "repo string, hash string, author string, message string, t string, seq bigint").select(
        "repo", "hash", "author", "message", ts.alias("ts"), ts.alias("committer_ts"), "seq"
    )
    stats = spark.createDataFrame([("one", "c1", 100, 10, None), ("one", "c0", 5, 5, None), ("lone", "c4", 1, 0, None)], schema.COMMIT_STATS)
    changed = spark.createDataFrame([("one", "c1", "main.go", 100, 10), ("one", "c0", "main.go", 5, 5), ("two", "c2", "a.py", 1, 0)], schema.COMMIT_FILES)
    failures = spark.createDataFrame([("bad", "files", "clone failed"), ("lone", "health", "status 403")], schema.REPO_FAILURES)
    return Portfolio(repos=repos, files=files, commits=commits, commit_stats=stats, commit_files=changed, failures=failures)


def test_analyze(spark, tmp_path):
    options = Options(ai=True, health=True, health_details=True, churn=True, hotspots=True)
    result = analyze(portfolio(spark), options, NOW, provider="bitbucket", workspace="ws", organization="", generated_at="2026-02-23T00:00:00Z")
    write_report(str(tmp_path / "report"), result.head, result.rows, result.errors)

    rows = {}
    for part in (tmp_path / "report/repositories").glob("part-*"):
        for line in part.read_text().splitlines():
            row = json.loads(line)
            rows[row["repository"]] = row
    assert set(rows) == {"one", "two", "empty", "lone"}
    one = rows["one"]
    assert one["totals"] == {"files": 1, "lines": 4, "code": 2, "comments": 1, "blanks": 1, "complexity": 2}
    assert (one["filtered_files"], one["project"]) == (1, "PROJ1")
    assert one["languages"] == [{"name": "Go", "files": 1, "lines": 4, "code": 2, "comments": 1, "blanks": 1, "complexity": 2}]
    assert one["churn"]["top_files"] == [{"path": "main.go", "changes": 2, "additions": 105, "deletions": 15}]
    assert one["churn"]["hotspots"][0]["hotspot"] == 4.0
    estimate = one["ai_estimate"]
    assert (estimate["total_commits"], estimate["ai_commits"], estimate["commit_percent"], estimate["ai_additions"]) == (2, 1, 50.0, 100)
    assert "details" not in estimate
    found = result.ai_details.where("repo = 'one'").select("hash", "author", "message", "signals", "additions", "deletions").collect()
    assert [tuple(r) for r in found] == [("c1", "Jo <jo@x>", "feat", ["co-author"], 100, 10)]
    assert one["health"] == {"category": "active", "last_commit_date": "2026-02-13T00:00:00Z", "days_since_commit": 10}
    assert one["health_details"]["authors_by_window"] == {"0-6mo": 1, "6-12mo": 1}
    assert one["health_details"]["churn_by_window"]["6-12mo"] == {"additions": 5, "deletions": 5, "net_churn": 0, "commits": 1}
    assert (one["health_details"]["bus_factor"], one["health_details"]["velocity_trend"]) == (50.0, 1.0)
    assert rows["empty"]["languages"] == [] and rows["empty"]["totals"]["code"] == 0
    assert "filtered_files" not in rows["two"] and "project" not in rows["lone"]
    assert rows["two"]["ai_estimate"]["ai_additions"] == 0 and "details" not in rows["two"]["ai_estimate"]
    assert rows["lone"]["health"]["category"] == "failed"

    head = json.loads(next(p.read_text() for p in (tmp_path / "report/head").glob("part-*") if p.stat().st_size))
    assert (head["provider"], head["workspace"], "organization" in head) == ("bitbucket", "ws", False)
    assert head["totals"] == {"repos": 4, "files": 4, "lines": 8, "code": 6, "comments": 1, "blanks": 1, "complexity": 3, "filtered_files": 1}
    assert [e["name"] for e in head["by_language"]] == ["Go", "Python"]
    assert (head["ai_estimate"]["total_commits"], head["ai_estimate"]["ai_commits"]) == (4, 2)
    summary = head["health_summary"]
    assert (summary["active"]["repos"], summary["abandoned"]["repos"], summary["failed"]["repos"], summary["active"]["code_percent"]) == (1, 1, 1, 50.0)
    errors = [json.loads(line) for p in (tmp_path / "report/errors").glob("part-*") for line in p.read_text().splitlines()]
    assert [(e["repository"], e["error"]) for e in errors] == [("bad", "clone failed")]
    assert {tuple(r) for r in result.diagnostics.collect()} == {
        ("ai-estimate-detail", "two", "CommitStats c2: no statistics"),
        ("ai-estimate-detail", "bad", "CommitStats c5: no statistics"),
        ("health", "lone", "status 403"),
        ("health-details", "two", "CommitStats c2: no statistics"),
        ("health-details", "bad", "CommitStats c5: no statistics"),
    }


def test_only_the_present_tree_counts(spark):
    tables = portfolio(spark)
    text = b"x = 1\n"
    trees = [("one", None, "a.py", text), ("one", "c0", "a.py", text), ("one", "c1", "a.py", text), ("two", "c2", "a.py", text), ("empty", "c7", "a.py", text), ("empty", "c8", "a.py", text)]
    tables.files = spark.createDataFrame(trees, schema.FILES)
    result = analyze(tables, Options(), NOW)
    assert {r.repo: (r.files, r.code) for r in result.totals.collect() if r.files} == {"one": (1, 1), "two": (1, 1)}
    assert {r.repository: r.error for r in result.errors.collect()} == {"bad": "clone failed", "empty": "several trees, none of them marked as present"}


def test_nothing_is_cut_without_being_asked(spark):
    tables = portfolio(spark)
    ts = F.timestamp_seconds(F.lit(1_770_000_000) - F.col("id"))
    many = spark.range(1200).select(
        F.lit("one").alias("repo"), F.concat(F.lit("h"), "id").alias("hash"), F.lit("bot[bot]").alias("author"), F.lit("x").alias("message"),
        ts.alias("ts"), ts.alias("committer_ts"), "id",
    ).withColumnRenamed("id", "seq")
    tables.commits = many
    tables.commit_stats = many.select("repo", "hash", F.lit(1).cast("long").alias("additions"), F.lit(0).cast("long").alias("deletions"), F.lit(None).cast("string").alias("error"))
    changed = many.select("repo", "hash", F.concat(F.lit("f"), F.format_string("%02d", F.pmod("seq", F.lit(25))), F.lit(".py")).alias("path"), F.lit(1).cast("long").alias("additions"), F.lit(0).cast("long").alias("deletions"))
    tables.commit_files = changed.unionByName(changed.filter("path <> 'f00.py'"))
    body = {i: b"if x == 1:\n  y\n" * (100 if i == 0 else 1) for i in range(25)}
    tables.files = spark.createDataFrame([("one", None, f"f{i:02d}.py", b) for i, b in body.items()], schema.FILES)
    result = analyze(tables, Options(ai=True, churn=True, hotspots=True), NOW)
    assert [r.total_commits for r in result.ai.where("repo = 'one'").collect()] == [1200]
    assert result.top_files.where("path = 'f00.py'").count() == 0
    assert result.hotspots.where("rank = 1").first().path == "f00.py"
    assert [r.total_commits for r in analyze(tables, Options(ai=True, ai_commit_limit=700), NOW).ai.where("repo = 'one'").collect()] == [700]


def test_plain_analysis_has_no_optional_parts(spark):
    result = analyze(portfolio(spark), Options(include_forks=True), NOW)
    assert {"churn", "ai_estimate", "health", "health_details"} & set(result.rows.columns) == set()
    assert {"ai_estimate", "health_summary"} & set(result.head.columns) == set()
    assert {r.repository for r in result.rows.collect()} == {"one", "two", "empty", "lone", "fork"}
    assert result.diagnostics.count() == 0


def test_trends(spark, tmp_path):
    result = analyze_trends(portfolio(spark), Options(), "2025-02", "2026-02", "monthly")
    rows = {r.period: (r.repos, r.code) for r in result.totals.collect()}
    assert len(rows) == 13
    # By February only "lone" has a commit, "two" since March, "one" since June, "bad" since January 2026.
    # The June commit of "one" has no tree, so that repository is skipped until its next commit.
    assert (rows["2025-02"], rows["2025-03"], rows["2025-06"], rows["2026-02"]) == ((1, 2), (2, 4), (2, 4), (4, 7))
    write_trends_report(str(tmp_path / "t"), result.head, result.rows, result.repository_rows, result.errors)

    def lines(name):
        return [json.loads(line) for p in (tmp_path / "t" / name).glob("part-*") for line in p.read_text().splitlines()]

    head = lines("head")[0]
    assert (head["since"], head["interval"], len(head["periods"]), head["periods"][0]) == ("2025-02", "monthly", 13, "2025-02")
    snapshots = {row["period"]: row for row in lines("snapshots")}
    assert snapshots["2026-02"]["totals"]["repos"] == 4
    assert [(e["name"], e["code"]) for e in snapshots["2026-02"]["by_language"]] == [("Python", 4), ("Go", 3)]
    last = {row["repository"]: row for row in lines("repositories") if row["period"] == "2026-02"}
    assert (last["one"]["filtered_files"], last["one"]["languages"][0]["name"], last["two"]["totals"]["files"]) == (1, "Go", 2)
    tables = result.tables()
    assert [r.delta_label for r in tables["periods"].limit(3).collect()] == ["", "+2", "+0"]
    assert {r.language: r["2026-02"] for r in tables["languages"].collect()} == {"Go": 3, "Python": 4}
    assert tables["top_repositories"].count() == 4


def test_tables_of_a_read_report_equal_those_of_the_analysis(spark, tmp_path):
    options = Options(ai=True, health=True, health_details=True, churn=True, hotspots=True)
    result = analyze(portfolio(spark), options, NOW, provider="bitbucket", workspace="ws")
    nested = result.head.drop("errors").first().asDict(recursive=True)
    nested["repositories"] = [r.asDict(recursive=True) for r in result.rows.drop("repo").collect()]
    nested["errors"] = [r.asDict() for r in result.errors.drop("repo").collect()]
    (tmp_path / "report.json").write_text(json.dumps(nested))
    read = report_tables(report_source.report_frames(report_source.of_documents(report_source.read_reports(spark, str(tmp_path / "report.json")), "standard")))
    direct = result.tables()
    assert set(read) == set(direct)
    for name, table in direct.items():
        columns = [c for c in table.columns if c != "repo"]
        expected = sorted(map(str, table.select(columns).collect()))
        assert sorted(map(str, read[name].select(columns).collect())) == expected, name
        assert expected, name


def test_missing_tables_are_named(spark):
    tables = portfolio(spark)
    tables.commit_files = None
    with pytest.raises(ValueError, match="commit_files"):
        analyze(tables, Options(churn=True), NOW)


def test_commits_and_statistics_are_read_once(spark):
    from datetime import datetime, timedelta

    counts = {name: spark.sparkContext.accumulator(0) for name in ("commits", "commit_stats")}

    def watched(name, rows, columns):
        def seen(batches):
            for batch in batches:
                counts[name].add(batch.num_rows)
                yield batch

        return spark.createDataFrame(rows, columns).mapInArrow(seen, columns)

    start = datetime(2001, 1, 1)
    commits = [(f"r{i % 3}", f"h{i}", f"Dev {i % 4} <d{i % 4}@e.com>", "AI-generated fix" if i % 5 == 0 else "work", start - timedelta(days=i), start, i) for i in range(90)]
    stats = [(c[0], c[1], 10, 1, None) for c in commits if int(c[1][1:]) % 7]
    tables = Portfolio(
        repos=spark.createDataFrame([(f"r{i}", "github", f"s{i}", f"s{i}", "", f"https://h/o/s{i}", "", "", "", False, False) for i in range(3)], schema.REPOS),
        files=spark.createDataFrame([(f"r{i}", None, "a.py", b"if x:\n  pass\n") for i in range(3)], schema.FILES),
        commits=watched("commits", commits, schema.COMMITS), commit_stats=watched("commit_stats", stats, schema.COMMIT_STATS),
        commit_files=spark.createDataFrame([(c[0], c[1], "a.py", 1, 1) for c in commits], schema.COMMIT_FILES),
    )
    result = analyze(tables, Options(ai=True, health=True, health_details=True, churn=True, hotspots=True, ai_commit_limit=20, churn_limit=10), "2001-01-02 00:00:00")
    rows = {r.repo: r for r in result.rows.collect()}
    for frame in (result.diagnostics, result.ai_details, result.windows, result.bus_factor, result.velocity, result.head, result.top_files, result.hotspots):
        frame.collect()
    assert counts["commits"].value == len(commits) and counts["commit_stats"].value == len(stats)
    assert [rows["r0"].ai_estimate.total_commits, rows["r0"].churn.total_commits, rows["r0"].health_details.churn_by_window["0-6mo"].commits] == [20, 10, 30]
    flagged = [c for c in commits if c[0] == "r0" and c[3] != "work"][:4]
    known = [c for c in flagged if c[1] in {s[1] for s in stats}]
    assert (rows["r0"].ai_estimate.ai_commits, rows["r0"].ai_estimate.ai_additions) == (4, 10 * len(known))
