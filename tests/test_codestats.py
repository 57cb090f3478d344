"""Line counts, file classes and totals."""

from pyspark.sql import functions as F

from tallyforge.operators import codestats

GO = (
    'package main\n\n// c1\nfunc main() {\n  x := "// no" // yes\n  if x == "a" && y {\n  }\n/* a\n\n b */ z()\n'
    "  s := `raw\n\n// in raw\n`\n}\n"
)
PYTHON = '"""doc\n\nstring"""\nimport os\n# c\nx = """multi\n# not\n\n"""\nif x or y: pass\n'


def counted(spark, *rows):
    df = spark.createDataFrame([("r", p, c if isinstance(c, bytes) else c.encode()) for p, c in rows], "repo string, path string, content binary")
    return codestats.file_stats(df)


# path, content, language, lines, code, comments, blanks, complexity
CASES = [
        ("main.go", GO, "Go", 15, 11, 3, 1, 3),
        ("a.py", PYTHON, "Python", 10, 6, 4, 0, 2),
        ("a.py", "x = 'it\\'s # no'  # yes\n", "Python", 1, 1, 0, 0, 0),
        ("a.py", "\n\n", "Python", 2, 0, 0, 2, 0),
        ("a.py", "", "Python", 0, 0, 0, 0, 0),
        ("a.py", "x", "Python", 1, 1, 0, 0, 0),
        ("A.HTML", "<p>\n<!-- x -->\n<!-- y\n\nz -->\n</p>", "HTML", 6, 2, 4, 0, 0),
        ("a.js", "/* open\nnever closed\n", "JavaScript", 2, 0, 2, 0, 0),
        ("a.js", "a /* x */ /* y\n*/ b\n", "JavaScript", 2, 2, 0, 0, 0),
        ("a.js", "for(;;) {}\nelse if (a) {}\nelseif (b)\n", "JavaScript", 3, 3, 0, 0, 3),
        ("a.js", "x\r\n\r\n// y\r\n", "JavaScript", 3, 1, 1, 1, 0),
        ("m.lua", "--[[ b\n c ]]\nlocal x = 1 -- t\n-- l\n", "Lua", 4, 1, 3, 0, 0),
        ("x.h", "class X {};\n", "C++ Header", 1, 1, 0, 0, 0),
        ("x.h", "int x;\n", "C Header", 1, 1, 0, 0, 0),
        ("x.h", "#import <a.h>\n@interface X\n", "Objective C", 2, 2, 0, 0, 0),
        ("x.m", "x = 1;\n", "MATLAB", 1, 1, 0, 0, 0),
        ("x.pl", "#!/usr/bin/swipl\nuse strict; my $x\n", "Prolog", 2, 2, 0, 0, 0),
        ("x.pl", "a :- b.\n% c\n", "Prolog", 2, 1, 1, 0, 0),
        ("x.ts", "<!DOCTYPE TS>\n<TS/>\n", "Qt Translation", 2, 2, 0, 0, 0),
        ("x.d.ts", "let x: int;\n", "TypeScript Typings", 1, 1, 0, 0, 0),
        ("sub/Dockerfile", "# c\nFROM x\n", "Dockerfile", 2, 1, 1, 0, 0),
        ("run", "#!/usr/bin/env bash\necho hi\n", "BASH", 2, 1, 1, 0, 0),
        ("a.sql", "SELECT 1 -- x\n/* y */\n", "SQL", 2, 1, 1, 0, 0),
]


def test_line_counts(spark):
    df = spark.createDataFrame(
        [(str(i), case[0], case[1].encode()) for i, case in enumerate(CASES)], "repo string, path string, content binary"
    )
    rows = {int(r.repo): r for r in codestats.file_stats(df).collect()}
    for i, (path, content, *expected) in enumerate(CASES):
        row = rows[i]
        got = [row.language, row.lines, row.code, row.comments, row.blanks, row.complexity]
        assert (row.status, got) == ("counted", expected), (path, content)
        assert row.lines == row.code + row.comments + row.blanks


def test_long_lines_do_not_exhaust_the_stack(spark):
    text = 'x = "' + "\\x41" * 200_000 + '" + `' + "a\n" * 50_000 + "` // end\n/*" + "*\n" * 100_000 + "*/\n"
    row = counted(spark, ("big.go", text)).first()
    assert (row.lines, row.code, row.comments) == (50_001 + 100_001, 50_001, 100_001)


def test_file_classes(spark):
    rows = {
        r.path: r.status
        for r in counted(
            spark,
            ("main.go", "package main\n"),
            ("vendor/lib/dep.go", "package dep\n"),
            ("a/node_modules/b/c.js", "x\n"),
            (".git/config", "x\n"),
            ("sub/.hg/x.py", "x\n"),
            ("generated.go", "// Code generated by x. DO NOT EDIT.\npackage g\n"),
            ("late.go", "package g\n" * 60 + "// Code generated by x\n"),
            ("made.zzz", "# @generated\n"),
            ("go.sum", "x\n"),
            ("app.min.js", "x\n"),
            ("wide.js", "x" * 500 + "\n"),
            ("bin.py", b"a\x00b"),
            ("badutf.py", b"x = '\xff'\n"),
            ("what.zzz", "x\n"),
            ("noext", "x\n"),
        ).collect()
    }
    assert rows == {
        "main.go": "counted",
        "generated.go": "filtered",
        "late.go": "filtered",
        "made.zzz": "filtered",
        "go.sum": "filtered",
        "app.min.js": "filtered",
        "wide.js": "filtered",
        "bin.py": "binary",
        "badutf.py": "counted",
        "what.zzz": "unknown",
        "noext": "unknown",
    }


def test_totals_keep_empty_repositories(spark):
    stats = counted(spark, ("main.go", "package main\n"), ("script.py", "import os\n"), ("generated.go", "// Code generated x\n"))
    by_language = codestats.language_stats(stats)
    repos = spark.createDataFrame([("r",), ("empty",)], "repo string")
    totals = {r.repo: r for r in codestats.repo_totals(repos, by_language).collect()}
    assert (totals["r"].files, totals["r"].code, totals["r"].filtered_files) == (2, 2, 1)
    assert (totals["empty"].files, totals["empty"].code, totals["empty"].filtered_files) == (0, 0, 0)
    whole = codestats.portfolio_totals(codestats.repo_totals(repos, by_language)).first()
    assert (whole.repos, whole.files, whole.filtered_files) == (2, 2, 1)
    assert [r.language for r in codestats.portfolio_languages(by_language).collect()] == ["Go", "Python"]


def test_cube_levels(spark):
    by_language = spark.createDataFrame(
        [("a", "Go", 1, 10, 5, 3, 2, 1, 0), ("a", None, 0, 0, 0, 0, 0, 0, 4), ("b", "Go", 2, 20, 15, 3, 2, 1, 0)],
        "repo string, language string, files bigint, lines bigint, code bigint, comments bigint, blanks bigint,"
        " complexity bigint, filtered_files bigint",
    )
    rows = codestats.stats_cube(by_language).filter("level = 3").collect()
    assert [(r.files, r.code) for r in rows] == [(3, 20)]
    assert codestats.stats_cube(by_language).groupBy("level").count().filter(F.col("level") == 1).first()["count"] == 2


def test_path_is_evaluated_once_by_the_test_of_directories(spark):
    """Where a path is computed, a filter would repeat what computes it wherever the path is named."""
    rows = spark.range(4).select(F.concat(F.when(F.col("id") % 2 == 0, "vendor/").otherwise("src/"), F.lit("made"), "id").alias("path"))
    seen = codestats.visible_files(rows)
    assert sorted(r.path for r in seen.collect()) == ["src/made1", "src/made3"]
    condition = next(line for line in seen._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in line)
    assert condition.count("vendor/") == 1


def test_filter_of_languages_classifies_no_file_twice(spark):
    files = spark.createDataFrame([("r", "a.go", bytearray(b"x := 1\n")), ("r", "b.go", bytearray(b"// Code generated x\n"))], "repo string, path string, content binary")
    seen = codestats.languages_only(codestats.language_stats(codestats.file_stats(files)))
    assert [(r.language, r.files, r.code) for r in seen.collect()] == [("Go", 1, 1)]
    assert seen._jdf.queryExecution().optimizedPlan().toString().count("Autogenerated by Thrift Compiler)") == 1


def test_paths_are_tested_for_directories_by_one_compiled_search(spark):
    """Functions of lambdas are evaluated call by call, and with them all that computes the path."""
    rows = spark.range(4).select(F.concat(F.when(F.col("id") % 2 == 0, "deps/").otherwise("a/deps/"), F.lit("made"), "id").alias("path"))
    seen = codestats.visible_files(rows)
    assert sorted(r.path for r in seen.collect()) == ["a/deps/made1", "a/deps/made3"]
    assert "lambda" not in seen._jdf.queryExecution().optimizedPlan().toString()


def test_a_marked_text_is_searched_for_empty_lines_once(spark):
    files = spark.createDataFrame([("r", "a.go", bytearray(b"\n \n// c\nx := 1\n\t\n"))], "repo string, path string, content binary")
    seen = codestats.file_stats(files)
    assert [(r.lines, r.code, r.comments, r.blanks) for r in seen.collect()] == [(5, 1, 1, 3)]
    searches = seen._jdf.queryExecution().optimizedPlan().toString()
    assert searches.count("]*+(?=\\n)|") == 1
