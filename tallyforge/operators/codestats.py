"""Code statistics: classify and count each file where it lies, then add up numbers only.

File contents are never shuffled. One narrow pass turns every file into a handful of numbers; only
their partial sums per repository and language travel.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import lines as L
from tallyforge.rules import paths as P
from tallyforge.rules.languages import LONG_EXTENSIONS, NAME_KEYS, language_rules
from tallyforge.schema import MEASURES
from tallyforge.session import with_computed

# What became of a file.
COUNTED = "counted"
FILTERED = "filtered"
UNKNOWN = "unknown"
BINARY = "binary"

_INTERPRETER = r"\A#![ \t]*(?:\S*/env[ \t]+(?:-\S+[ \t]+)*|\S*/)?([A-Za-z]+)"


def file_name(path: Column) -> Column:
    """Last segment of a path."""
    return F.substring_index(path, "/", -1)


def in_pruned_directory(path: Column) -> Column:
    """True below a version-control or vendored directory: any of its ancestors has a name that the rules have, or meets one of the few patterns."""
    return path.rlike(P.PRUNED_SEARCH)


def is_vendored(path: Column) -> Column:
    """True for a single file of third-party code.

    Names are looked up whole. Patterns are looked up by extension, so a path meets those of its own extension alone, of which most have none.
    """
    rules, name = P.VENDOR_INDEX, file_name(path)
    extension = F.substring_index(name, ".", -1)
    matched = F.lit(False)
    for pattern in dict.fromkeys(rules.by_extension.values()):
        own = [ending for ending, held in rules.by_extension.items() if held == pattern]
        matched = F.when(extension.isin(*own), path.rlike(pattern)).otherwise(matched)
    # Most files have an extension that no pattern is about, which one look-up tells.
    matched = F.when(extension.isin(*rules.by_extension), matched).otherwise(F.lit(False))
    named = name.isin(*sorted(rules.names)) | path.isin(*sorted(rules.root_names)) | matched
    return named | path.rlike(rules.other_files) if rules.other_files else named


def is_generated(path: Column, text: Column, minified_line_length: int = P.MINIFIED_LINE_LENGTH) -> Column:
    """True for a file that a tool wrote: by its path, by a marker anywhere in it, or by the mean length of its lines."""
    minified = path.rlike(P.MINIFIED_EXTENSION) & (F.length(text) > minified_line_length * F.greatest(L.total_lines(text), F.lit(1)))
    stemmed = marked = F.lit(False)
    for marker in P.GENERATED_MARKERS:
        if any(stem in marker for stem in P.GENERATED_STEMS):
            stemmed = stemmed | F.contains(text, F.lit(marker))
        else:
            marked = marked | F.contains(text, F.lit(marker))
    held = reduce(or_, [F.contains(text, F.lit(stem)) for stem in P.GENERATED_STEMS])
    marked = marked | (held & stemmed)
    # The plain search spares nearly all files the one for whole words.
    return path.rlike(P.GENERATED_PATH) | minified | (marked & text.rlike(P.GENERATED_MARK))


def is_binary(content: Column) -> Column:
    """True when there is a NUL byte."""
    return F.contains(content, F.lit(bytes([0])))


def head_trees(trees: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of (repo, commit_hash): the present tree of each repository, and the repositories where nothing tells which it is.

    The present tree is the one without a commit hash, else the only one there is.
    """
    seen = trees.select("repo", "commit_hash").distinct().groupBy("repo").agg(
        F.count(F.lit(1)).alias("_trees"), F.count("commit_hash").alias("_hashed"), F.max("commit_hash").alias("_hash")
    )
    marked = F.col("_trees") > F.col("_hashed")
    heads = seen.filter(marked | (F.col("_trees") == 1)).select("repo", F.when(~marked, F.col("_hash")).alias("head"))
    return heads, seen.filter(~marked & (F.col("_trees") > 1)).select("repo")


def of_heads(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """Rows (repo, commit_hash, ...) of the present trees, without the hash."""
    joined = rows.join(heads, "repo").filter(F.col("commit_hash").eqNullSafe(F.col("head")))
    return joined.select(*[c for c in rows.columns if c != "commit_hash"])


def rule_key(path: Column, text: Column) -> Column:
    """Key into the language rules: whole name, extension, or the interpreter of a script."""
    name = F.lower(file_name(path))
    key = F.when(name.isin(NAME_KEYS), name)
    for extension in LONG_EXTENSIONS:
        key = key.when(F.endswith(name, F.lit(extension)), F.lit(extension))
    interpreter = F.nullif(F.regexp_extract(text, _INTERPRETER, 1), F.lit(""))
    return key.when(F.contains(name, F.lit(".")), F.concat(F.lit("."), F.substring_index(name, ".", -1))).when(
        F.startswith(text, F.lit("#!")), F.concat(F.lit("#!"), interpreter)
    )


def choose_language(candidates: Column, text: Column) -> Column:
    """The candidate that a text speaks for; most files have but one.

    A script goes to the language whose interpreter it names. Any other text goes to the language whose signs weigh most: each sign that occurs, however
    often, adds its weight. The first candidate wins ties, so it is what a text without any sign is taken for.
    """
    interpreter = F.regexp_extract(text, _INTERPRETER, 1)

    def weight(candidate: Column) -> Column:
        named = F.when(F.array_contains(candidate["interpreters"], interpreter), F.lit(1_000_000)).otherwise(F.lit(0))
        signs = F.transform(candidate["signs"], lambda s: F.when(F.contains(text, s["sign"]), s["weight"]).otherwise(F.lit(0)))
        return F.aggregate(signs, named, lambda total, w: total + w)

    weighed = F.transform(candidates, lambda c, i: F.struct((-weight(c)).alias("less"), i.alias("place"), c.alias("rule")))
    first = F.try_element_at(candidates, F.lit(1))
    return F.when(F.size(candidates) > 1, F.array_min(F.transform(weighed, lambda w: F.struct(w["less"], w["place"], w["rule"])))["rule"]).otherwise(first)


def visible_files(files: DataFrame) -> DataFrame:
    """Files outside pruned directories; tests the path only, before any content is touched."""
    return files.filter(~in_pruned_directory(F.col("path")))


def file_stats(files: DataFrame, *, minified_line_length: int = P.MINIFIED_LINE_LENGTH) -> DataFrame:
    """One row per visible file: what became of it, its language and its counts.

    Needs ``path`` and binary ``content``; every other column is passed on. Files of an unknown
    language and binary files stay as rows with null counts, so that nothing is lost silently. Scripts and style sheets
    whose mean line is longer than ``minified_line_length`` count as minified, which is a filter.
    """
    rules = F.broadcast(language_rules(files.sparkSession))  # fixed size, see the rule table
    passed = [c for c in files.columns if c != "content"]
    text = F.make_valid_utf8(F.col("content").cast("string"))
    keyed = visible_files(files).withColumn("_text", text).withColumn("_key", rule_key(F.col("path"), F.col("_text")))
    chosen = choose_language(F.col("candidates"), F.col("_text"))
    status = (
        F.when(is_vendored(F.col("path")) | is_generated(F.col("path"), F.col("_text"), minified_line_length), F.lit(FILTERED))
        .when(F.col("_rule").isNull(), F.lit(UNKNOWN))
        .when(is_binary(F.col("content")), F.lit(BINARY))
        .otherwise(F.lit(COUNTED))
    )
    # A filter of the language or status is met after the file is classified, and not by classifying it a second time.
    classified = with_computed(keyed.join(rules, F.col("_key") == F.col("key"), "left").withColumn("_rule", chosen), status=status).select(
        *passed,
        "status",
        F.when(F.col("status") == COUNTED, F.col("_rule")).alias("_rule"),
        F.when(F.col("status") == COUNTED, F.col("_text")).alias("_text"),
    )
    body, syntax = F.col("_text"), "_rule.syntax"
    marked = (
        classified.withColumn("_unescaped", L.unescape(body))
        .withColumn("_marked", L.mark_tokens("_unescaped", syntax))
        .withColumn("_led", L.led_by_feed(F.col("_marked")))
        .withColumn("_empty", L.empty_lines(F.col("_led")))
    )
    counted = marked.select(
        *passed,
        "status",
        F.col("_rule.language").alias("language"),
        L.total_lines(body).alias("lines"),
        (L.code_lines(F.col("_marked"), F.col("_empty")) + L.raw_string_breaks("_unescaped", syntax)).alias("code"),
        L.blank_lines(F.col("_marked"), F.col("_empty")).alias("blanks"),
        F.when(body.isNotNull(), L.branch_count("_led", syntax)).alias("complexity"),
    )
    comments = F.col("lines") - F.col("code") - F.col("blanks")
    return counted.select(*passed, "status", "language", "lines", "code", comments.alias("comments"), "blanks", "complexity")


def language_stats(stats: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """File stats added up per key and language.

    The row without language carries the files that were filtered, unknown or binary, so that one
    pass over the files serves all totals.
    """
    counted = F.col("status") == COUNTED
    sums = [F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in MEASURES[1:]]
    return stats.groupBy(*keys, "language").agg(
        F.count_if(counted).alias("files"), *sums, F.count_if(F.col("status") == FILTERED).alias("filtered_files")
    )


def languages_only(by_language: DataFrame) -> DataFrame:
    """Rows of :func:`language_stats` that belong to a language."""
    return by_language.filter(F.col("language").isNotNull()).drop("filtered_files")


def _measure_sums(extra: Sequence[str] = ()) -> list[Column]:
    return [F.coalesce(F.sum(m), F.lit(0)).cast("long").alias(m) for m in [*MEASURES, *extra]]


def repo_totals(repos: DataFrame, by_language: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Totals per repository; one without files appears with zeros."""
    totals = by_language.groupBy(*keys).agg(*_measure_sums(["filtered_files"]))
    filled = [F.coalesce(F.col(m), F.lit(0)).alias(m) for m in [*MEASURES, "filtered_files"]]
    return repos.select(*keys).join(totals, list(keys), "left").select(*keys, *filled)


def portfolio_totals(totals: DataFrame) -> DataFrame:
    """Totals over all repositories, with their number; zeros when there are none."""
    return totals.agg(F.count(F.lit(1)).alias("repos"), *_measure_sums(["filtered_files"]))


def portfolio_languages(by_language: DataFrame) -> DataFrame:
    """Totals per language over all repositories, largest code first."""
    grouped = languages_only(by_language).groupBy("language").agg(*_measure_sums())
    return grouped.orderBy(F.col("code").desc(), "language")


def stats_cube(by_language: DataFrame) -> DataFrame:
    """Repository and language, repository, language and grand totals in one pass.

    The grouping sets expand the sums per repository and language, not the files. ``level`` tells
    the sets apart: 0 both, 1 repository, 2 language, 3 everything.
    """
    sets = [["repo", "language"], ["repo"], ["language"], []]
    return (
        languages_only(by_language)
        .groupingSets([[F.col(c) for c in s] for s in sets], "repo", "language")
        .agg(F.grouping_id().cast("int").alias("level"), *_measure_sums())
    )
