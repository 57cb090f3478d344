"""Landed pages, source trees, archives and reports, read from files the tests write."""

import io
import json
import os
import tarfile

from pyspark.sql import functions as F

from tallyforge.operators import codestats
from tallyforge.sinks.reports import write_diagnostics, write_tables
from tallyforge.sources import archives, bitbucket, github, gitlab, pages, reports, trees


def land(root, path, content):
    target = root / path
    target.parent.mkdir(parents=True, exist_ok=True)
    if isinstance(content, bytes):
        target.write_bytes(content)
    else:
        target.write_text(content if isinstance(content, str) else json.dumps(content))


def test_github(spark, tmp_path):
    land(tmp_path, "repos/page-1.json", [
        {"name": "a", "full_name": "o/a", "html_url": "https://h/o/a", "clone_url": "https://h/o/a.git", "archived": False, "fork": True, "size": 3},
        {"name": "b", "html_url": "https://h/o/b", "archived": True},
    ])
    rows = {r.slug: r for r in github.repos(pages.read_pages(spark, str(tmp_path / "repos"))).collect()}
    assert (rows["a"].repo, rows["a"].fork, rows["a"].archived, rows["a"].project) == ("github:https://h/o/a", True, False, "")
    assert (rows["b"].clone_url, rows["b"].fork, rows["b"].archived) == ("", False, True)

    def commit(sha, date, message="m"):
        return {"sha": sha, "commit": {"author": {"name": "Jo", "email": "jo@x", "date": date}, "message": message}}

    key = "repo=github%3Ahttps%3A%2F%2Fh%2Fo%2Fa"
    land(tmp_path, f"commits/{key}/page-2.json", [commit("c3", "soon")])
    land(tmp_path, f"commits/{key}/page-10.json", [commit("c4", "2025-01-01T00:00:00Z")])
    land(tmp_path, f"commits/{key}/page-1.json", [commit("c1", "2025-06-15T10:00:00Z", "x\n\nCo-Authored-By: y"), commit("c2", "2025-06-14T12:00:00+02:00")])
    got = github.commits(pages.read_pages(spark, str(tmp_path / "commits"))).orderBy("seq").collect()
    assert [(r.hash, r.repo, r.author, str(r.ts)) for r in got] == [
        ("c1", "github:https://h/o/a", "Jo <jo@x>", "2025-06-15 10:00:00"),
        ("c2", "github:https://h/o/a", "Jo <jo@x>", "2025-06-14 10:00:00"),
        ("c3", "github:https://h/o/a", "Jo <jo@x>", "None"),
        ("c4", "github:https://h/o/a", "Jo <jo@x>", "2025-01-01 00:00:00"),
    ]
    two = {"sha": "z", "commit": {"author": {"date": "2025-01-01T00:00:00Z"}, "committer": {"date": "2025-03-01T00:00:00Z"}}}
    clocks = github.commits(as_pages(spark, [two], repo="r")).first()
    assert (str(clocks.ts), str(clocks.committer_ts)) == ("2025-01-01 00:00:00", "2025-03-01 00:00:00")
    detail = {"stats": {"additions": 150, "deletions": 30}, "files": [{"filename": "main.go", "additions": 100, "deletions": 20}, {"filename": "util.go", "additions": 50, "deletions": 10}]}
    land(tmp_path, f"details/{key}/hash=c1/1.json", detail)
    details = pages.read_pages(spark, str(tmp_path / "details"))
    assert [tuple(r) for r in github.commit_stats(details).select("hash", "additions", "deletions").collect()] == [("c1", 150, 30)]
    assert {tuple(r)[1:] for r in github.commit_files(details).collect()} == {("c1", "main.go", 100, 20), ("c1", "util.go", 50, 10)}


def as_pages(spark, *values, **keys):
    rows = [(*keys.values(), i, v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, ", ".join([f"{k} string" for k in keys] + ["page bigint", "value string"]))


def test_gitlab(spark):
    page = [
        {"id": 1, "path": "a", "name": "A", "web_url": "https://h/g/s/a", "http_url_to_repo": "https://h/g/s/a.git", "default_branch": "main", "archived": False, "namespace": {"full_path": "g/s"}},
        {"id": 2, "path": "b", "name": "B", "web_url": "https://h/g/b", "archived": True, "forked_from_project": {"id": 9}, "namespace": {"full_path": "g"}},
    ]
    rows = {r.slug: r for r in gitlab.repos(as_pages(spark, page)).collect()}
    assert (rows["a"].project, rows["a"].fork, rows["a"].default_branch, rows["a"].name) == ("g/s", False, "main", "A")
    assert (rows["b"].fork, rows["b"].archived, rows["b"].clone_url) == (True, True, "")
    commits = gitlab.commits(as_pages(spark, [{"id": "abc", "author_name": "Jo", "author_email": "jo@x", "message": "m", "committed_date": "2025-06-15T10:00:00.000+00:00"}], repo="r")).collect()
    assert [(r.hash, r.author, str(r.ts)) for r in commits] == [("abc", "Jo <jo@x>", "2025-06-15 10:00:00")]
    stats = gitlab.commit_stats(as_pages(spark, {"stats": {"additions": 1, "deletions": 2}}, repo="r", hash="abc")).first()
    assert (stats.additions, stats.deletions, stats.error) == (1, 2, None)
    groups = gitlab.subgroups(as_pages(spark, [{"id": 7, "path": "s", "full_path": "g/s", "name": "S"}])).collect()
    assert [tuple(r) for r in groups] == [(7, "s", "g/s", "S")]


def test_bitbucket(spark):
    def repo(slug, **more):
        links = {"html": {"href": f"https://h/w/{slug}"}, "clone": [{"name": "ssh", "href": "git@h"}, {"name": "https", "href": f"https://h/w/{slug}.git"}]}
        return {"slug": slug, "full_name": f"w/{slug}", "project": {"key": "P"}, "links": links, **more}

    first = {"values": [repo("a"), "broken", 42, repo("b", parent={"full_name": "up/b"}, mainbranch={"name": "dev/x y"})], "next": "n"}
    rows = {r.slug: r for r in bitbucket.repos(as_pages(spark, first, {"values": [repo("c", mainbranch={"name": ""})]})).collect()}
    assert set(rows) == {"a", "b", "c"}
    assert (rows["a"].clone_url, rows["a"].default_branch, rows["a"].download_url, rows["a"].fork) == ("https://h/w/a.git", "main", "https://bitbucket.org/w/a/get/main.tar.gz", False)
    assert (rows["b"].fork, rows["b"].download_url, rows["c"].default_branch) == (True, "https://bitbucket.org/w/b/get/dev%2Fx%20y.tar.gz", "main")
    assert [tuple(r) for r in bitbucket.projects(as_pages(spark, {"values": [{"key": "K", "name": "N"}]})).collect()] == [("K", "N")]
    commits = bitbucket.commits(as_pages(spark, {"values": [{"hash": "abc", "date": "2025-06-15T10:00:00.123456+00:00", "message": "m", "author": {"raw": "Jo <jo@x>"}}]}, repo="r")).collect()
    assert [(r.hash, r.author, str(r.ts)) for r in commits] == [("abc", "Jo <jo@x>", "2025-06-15 10:00:00.123456")]
    diffs = as_pages(
        spark,
        {"values": [{"new": {"path": "a"}, "old": {"path": "z"}, "lines_added": 100, "lines_removed": 20}, {"old": {"path": "gone"}, "lines_added": 50, "lines_removed": 10}]},
        {"values": [{"lines_added": 1, "lines_removed": 1}]},
        repo="r", hash="abc",
    )
    assert [(r.additions, r.deletions) for r in bitbucket.commit_stats(diffs).collect()] == [(151, 31)]
    assert {r.path for r in bitbucket.commit_files(diffs).collect()} == {"a", "gone", ""}
    empty = bitbucket.commit_stats(as_pages(spark, {"values": []}, repo="r", hash="abc")).first()
    assert (empty.additions, empty.deletions) == (0, 0)


def test_trees(spark, tmp_path):
    for path, content in {
        "main.go": "package main\n", "pkg/__init__.py": "x\n", "pkg/.hidden.py": "x\n", "pkg/deep/er/a b.py": "x\n",
        ".git/objects/x.py": "x\n", "pkg/.git/x.py": "x\n", "vendor/lib/dep.go": "x\n", "generated.go": "// Code generated x\n", "bin.dat": b"\x00\xff",
        "gz.gz": b"not really gzip",
    }.items():
        land(tmp_path / "one", path, content)
    (tmp_path / "empty").mkdir()
    roots = spark.createDataFrame([(n, None, f"file://{tmp_path}/{n}") for n in ("one", "empty", "missing")], "repo string, commit_hash string, root string")
    files = {r.path: bytes(r.content) for r in trees.read_trees(roots).collect()}
    assert files == {
        "main.go": b"package main\n", "pkg/__init__.py": b"x\n", "pkg/.hidden.py": b"x\n", "pkg/deep/er/a b.py": b"x\n",
        "generated.go": b"// Code generated x\n", "bin.dat": b"\x00\xff", "gz.gz": b"not really gzip",
    }
    stats = codestats.language_stats(codestats.file_stats(trees.read_trees(roots)))
    totals = {r.repo: (r.files, r.code, r.filtered_files) for r in codestats.repo_totals(roots.select("repo"), stats).collect()}
    assert totals == {"one": (4, 4, 1), "empty": (0, 0, 0), "missing": (0, 0, 0)}
    assert {r.path for r in trees.list_trees(roots).collect() if ".git/" in r.path} == set()


def archive(*members):
    packed = io.BytesIO()
    with tarfile.open(fileobj=packed, mode="w:gz") as tar:
        for name, body in members:
            info = tarfile.TarInfo(name)
            if body is None:
                info.type = tarfile.DIRTYPE
                tar.addfile(info)
            elif isinstance(body, str):
                info.type, info.linkname = tarfile.SYMTYPE, body
                tar.addfile(info)
            else:
                info.size = len(body)
                tar.addfile(info, io.BytesIO(body))
    return packed.getvalue()


def test_archives(spark, tmp_path):
    good = archive(("top-abc/", None), ("top-abc/main.go", b"package main\n"), ("top-abc/sub/x.py", b"x\n"), ("other/y.py", b"y\n"), ("top-abc/link", "main.go"), ("top-abc/../../evil.py", b"z\n"))
    land(tmp_path, "repo=r1/a b%20c.tar.gz", good)
    land(tmp_path, "repo=r2/a.tar.gz", good[: len(good) // 2])
    land(tmp_path, "repo=r3/a.tar.gz", b"no archive")
    expanded = archives.expand_archives(archives.find_archives(spark, str(tmp_path)))
    files = {r.path: bytes(r.content) for r in archives.archive_files(expanded).filter("repo = 'r1'").collect()}
    assert files == {"main.go": b"package main\n", "sub/x.py": b"x\n", "other/y.py": b"y\n"}
    assert {r.repo for r in archives.archive_failures(expanded).collect()} == {"r2", "r3"}


def test_reports(spark, tmp_path):
    standard = {"organization": "o", "repositories": [{"repository": "a", "totals": {"code": 7}, "health": {"category": "active", "days_since_commit": 3}}], "totals": {"code": 7}}
    trend = {"organization": "o", "since": "2025-01", "interval": "monthly", "periods": ["2025-01"], "snapshots": [{"period": "2025-01", "totals": {"code": 5}}]}
    land(tmp_path, "a.json", json.dumps(standard, indent=2))
    land(tmp_path, "b.json", json.dumps(trend, indent=2))
    read = reports.read_reports(spark, str(tmp_path))
    assert {r.report_type for r in read.collect()} == {"standard", "trends"}
    assert [(r.repository, r.totals.code, r.health.category) for r in reports.report_repositories(read).collect()] == [("a", 7, "active")]
    assert [(r.period_no, r.period, r.totals.code) for r in reports.report_snapshots(read).collect()] == [(1, "2025-01", 5)]


def test_page_numbers(spark, tmp_path):
    for name in ("page-2.json", "page-10.json", "page-1700000000123.json", "page.json", "x9-00000000000000000000000007.json"):
        land(tmp_path, name, name)
    got = [(r.value, r.page) for r in pages.read_pages(spark, str(tmp_path)).orderBy("page").collect()]
    assert got == [("page.json", 0), ("page-2.json", 2), ("x9-00000000000000000000000007.json", 7), ("page-10.json", 10), ("page-1700000000123.json", 700000000123)]


def test_diagnostics(spark, tmp_path):
    rows = spark.createDataFrame([("health", "a", "status 403")], "category string, repo string, message string")
    assert write_diagnostics(str(tmp_path / "log"), rows)
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).collect()] == ["[health] a | status 403"]
    assert not write_diagnostics(str(tmp_path / "none"), rows.filter(F.lit(False)))
    assert not os.path.exists(tmp_path / "none")
    write_tables(str(tmp_path / "tables"), {"errors": rows})
    assert spark.read.parquet(str(tmp_path / "tables/errors")).count() == 1
