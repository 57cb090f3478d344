"""Column functions on small values."""

from pyspark.sql import functions as F

from tallyforge.functions import authorship as A
from tallyforge.functions import calendar as C
from tallyforge.functions import text as T


def evaluate(spark, values, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(values, schema).select(*columns).collect()]


def test_signals(spark):
    trailer = "feat: add\n\nCo-Authored-By: {}"
    cases = [
        ("", trailer.format("Claude <noreply@example.com>"), "co-author"),
        ("", trailer.format("Copilot <x@example.com>"), "co-author"),
        ("", trailer.format("Cursor <x@example.com>"), "co-author"),
        ("", "x\n \t co-authored-by: some Amazon Q helper", "co-author"),
        ("", trailer.format("John Doe <john@example.com>"), ""),
        ("", "thanks co-authored-by: claude", ""),
        ("", "Co-Authored-By:\nclaude", ""),
        ("", "Generated by Claude", "commit-message"),
        ("", "AI-generated code", "commit-message"),
        ("", "AI-assisted refactoring", "commit-message"),
        ("", "auto-generated", "commit-message"),
        ("", "feat: add login page", ""),
        ("dependabot[bot] <1+dependabot[bot]@users.example>", "bump", "bot-author"),
        ("Renovate[BOT]", "bump", "bot-author"),
        ("Jane Doe <jane@example.com>", "some message", ""),
        ("copilot[bot] <c@example.com>", "AI-generated fix\n\nCo-Authored-By: Claude <x>\nCo-Authored-By: Claude <x>", "co-author,commit-message,bot-author"),
    ]
    got = evaluate(
        spark, [c[:2] for c in cases], "author string, message string",
        F.array_join(A.ai_signals(F.col("author"), F.col("message")), ","), A.is_ai_flagged(F.col("author"), F.col("message")),
    )
    assert got == [(c[2], c[2] != "") for c in cases]


def test_author_identity(spark):
    cases = [
        ("Alice <Alice@Example.com>", "alice@example.com"),
        ("Alice < a@b.c\t> <d@e.f>", "a@b.c"),
        ("Alice <>", ""),
        ("  Alice\n", "alice"),
        ("Alice <broken", "alice <broken"),
        ("a > b <c@d>", "c@d"),
    ]
    assert evaluate(spark, [(c[0],) for c in cases], "a string", A.author_identity(F.col("a"))) == [(c[1],) for c in cases]


def test_text(spark):
    number = F.col("n")
    cases = [(0, "0"), (42, "42"), (999, "999"), (1000, "1,000"), (12345, "12,345"), (1234567, "1,234,567"), (-500, "-500"), (-1234, "-1,234")]
    assert evaluate(spark, [(c[0],) for c in cases], "n bigint", T.thousands(number)) == [(c[1],) for c in cases]
    ratios = [(0, 0, "0.0%"), (0, 100, "0.0%"), (10, 90, "10.0%"), (1, 99, "1.0%"), (50, 50, "50.0%"), (107961, 8197829, "1.3%")]
    label = T.percent_label(T.comment_ratio(F.col("a"), F.col("b")))
    assert evaluate(spark, [r[:2] for r in ratios], "a bigint, b bigint", label) == [(r[2],) for r in ratios]
    days = [
        ("2026-02-19T07:56:55Z", "2026-02-19"), ("2026-02-19", "2026-02-19"), ("not-a-date", "not-a-date"),
        ("2026-02-19T23:30:00-05:00", "2026-02-19"), ("2026-02-31", "2026-02-31"), ("2026-02-19 10:00:00", "2026-02-19 10:00:00"),
    ]
    assert evaluate(spark, [(d[0],) for d in days], "d string", T.date_part(F.col("d"))) == [(d[1],) for d in days]
    signs = [(5, "+5"), (0, "+0"), (-1234, "-1234"), (None, None)]
    assert evaluate(spark, [(s[0],) for s in signs], "n bigint", T.signed(number)) == [(s[1],) for s in signs]
    assert evaluate(spark, [("active", ""), ("", "x")], "a string, b string", T.capitalize(F.col("a")), T.report_title(F.col("a"), F.col("b"))) == [
        ("Active", "active"), ("", "x"),
    ]
    assert evaluate(spark, [("o", "u", ""), ("o", "", ""), ("o", "u", "g")], "o string, u string, g string", T.report_organization(F.col("o"), F.col("u"), F.col("g"))) == [
        ("u",), ("o",), ("g",),
    ]
    assert evaluate(spark, [("a\nb",), ("a",), ("",)], "m string", T.first_line(F.col("m"))) == [("a",), ("a",), ("",)]


def test_urls(spark):
    url = F.col("u")
    assert evaluate(
        spark, [("https://x.example/org/name//",), ("https://x.example/g/sub/name",), ("name",), ("",)], "u string",
        T.url_owner(url), T.url_name(url), T.url_project_path(url),
    ) == [("org", "name", "org/name//"), ("sub", "name", "g/sub/name"), ("", "", "name"), ("", "", "")]


def test_top_names(spark):
    entries = [[(5000, "Go"), (1000, "Ruby"), (3000, "Python"), (500, "Shell"), (500, "Awk")]]
    df = [(e,) for e in entries]
    for count, names in [(3, "Go, Python, Ruby"), (10, "Go, Python, Ruby, Awk, Shell")]:
        assert evaluate(spark, df, "e array<struct<code: bigint, name: string>>", T.top_names(F.col("e"), count)) == [(names,)]


def test_activity_class(spark):
    now = C.as_instant("2026-02-23 00:00:00")
    rows = []
    for days, expected in [(179, "active"), (180, "maintained"), (364, "maintained"), (365, "abandoned"), (366, "abandoned"), (0, "active"), (-5, "active")]:
        then = now - F.make_dt_interval(F.lit(days))
        elapsed = C.elapsed_days(then, now)
        rows.append((spark.range(1).select(elapsed, C.activity_class(elapsed)).first(), (max(days, 0), expected)))
    assert [tuple(got) for got, _ in rows] == [expected for _, expected in rows]
    # Two seconds around midnight are no day.
    assert spark.range(1).select(C.elapsed_days(C.as_instant("2026-02-22 23:59:59"), C.as_instant("2026-02-23 00:00:01"))).first()[0] == 0


def test_months_run_over(spark):
    def before(instant, months):
        return str(spark.range(1).select(C.months_before(C.as_instant(instant), months)).first()[0])

    assert before("2001-08-31 10:00:00", 6) == "2001-03-03 10:00:00"
    assert before("2001-08-31 10:00:00", 12) == "2000-08-31 10:00:00"
    assert before("2004-02-29 01:02:03", 12) == "2003-03-01 01:02:03"
    assert before("2026-02-23 00:00:00", 6) == "2025-08-23 00:00:00"


def test_commit_window(spark):
    now = C.as_instant("2026-02-23 00:00:00")
    cases = [("2025-08-23 00:00:00", "0-6mo"), ("2025-08-22 23:59:59", "6-12mo"), ("2025-02-23 00:00:00", "6-12mo"), ("2025-02-22 23:59:59", "12mo+"), (None, "12mo+")]
    got = evaluate(spark, [(c[0],) for c in cases], "t string", C.commit_window(F.to_timestamp("t"), now))
    assert got == [(c[1],) for c in cases]
    assert [r[0] for r in evaluate(spark, [("12mo+",), ("0-6mo",), ("6-12mo",)], "w string", C.window_order(F.col("w")))] == [3, 1, 2]


def test_first_period(spark):
    def number(instant, since, interval):
        return spark.range(1).select(C.first_period_covering(F.try_to_timestamp(F.lit(instant)), F.lit(since), interval)).first()[0]

    assert number("2024-12-31 23:59:59", "2025-01", C.MONTHLY) == 1
    assert number("2025-01-31 23:59:59", "2025-01", C.MONTHLY) == 1
    assert number("2025-01-31 23:59:59.000001", "2025-01", C.MONTHLY) == 2
    assert number("2026-01-01 00:00:00", "2025-01", C.MONTHLY) == 13
    assert number("never", "2025-01", C.MONTHLY) == 1
    assert number("2025-01-01 10:00:00", "2025-01-01", C.WEEKLY) == 1
    assert number("2025-01-01 23:59:59.5", "2025-01-01", C.WEEKLY) == 2
    assert number("2025-01-08 10:00:00", "2025-01-01", C.WEEKLY) == 2
    assert number("2025-01-09 00:00:00", "2025-01-01", C.WEEKLY) == 3


def test_lines_of_code_and_blank_lines_by_brute_force(spark):
    import random

    from tallyforge.functions import lines as L

    draw = random.Random(5)
    texts = ["", "\n", " ", " \n", "\n ", "\x01", "\x01\n\x01 ", "a\n\n\n", "\n\na", "a\n \t", "é\n \n\U0001f600 \n", None]
    texts += ["".join(draw.choices(" \t\r\f\x0B\n\n\n\x01ab", k=draw.randint(0, 12))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", L.code_lines(F.col("text")).alias("code"), L.blank_lines(F.col("text")).alias("blanks"))
    for row in rows.collect():
        if row.text is None:
            assert (row.code, row.blanks) == (None, None)
            continue
        parts = row.text.split("\n")
        shown = parts[:-1] if parts[-1] == "" else parts
        blanks = sum(not line.strip(" \t\r\f\x0B") for line in shown)
        code = sum(bool(line.strip(" \t\r\f\x0B\x01")) for line in shown)
        assert (row.code, row.blanks) == (code, blanks), repr(row.text)


def test_branches_of_every_syntax_by_brute_force(spark):
    """A token counts where a word starts, at the start of a text too, and adjoining tokens each count."""
    import random
    import re

    from tallyforge.functions import lines as L
    from tallyforge.rules.languages import SYNTAXES

    draw = random.Random(7)
    rows = []
    for number, syntax in enumerate(SYNTAXES):
        pieces = [*syntax.branches, *" \t\n\r\x0B\f\xa0\u2003", "x", "é", "=", "(", "\x01"]
        rows += [(number, "".join(draw.choices(pieces, k=draw.randint(0, 9)))) for _ in range(60)]
    frame = spark.createDataFrame([*rows, (0, None)], "syntax int, text string").withColumn("led", L.led_by_feed(F.col("text")))
    got = frame.select("syntax", "text", L.branch_count("led", "syntax").alias("n")).collect()
    for row in got:
        branches = SYNTAXES[row.syntax].branches
        if row.text is None:
            assert row.n is None
            continue
        pattern = r"(?<![^ \t\n\x0B\f\r])(?:" + "|".join(re.escape(b) for b in branches) + ")"
        assert row.n == (len(re.findall(pattern, row.text)) if branches else 0), repr(row.text)
