"""License identification by similarity of word shingles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tallyforge.operators.setsim import similar_sets
from tallyforge.rules.licenses import TEXTS
from tallyforge.rules.paths import LICENSE_FILE
from tallyforge.session import stage, with_computed

# Least confidence of a match, words per shingle.
CONFIDENCE = 0.85
SHINGLE_WORDS = 3


def license_files(files: DataFrame) -> DataFrame:
    """Files in the root of a repository that may hold its license."""
    return files.filter(F.col("path").rlike(LICENSE_FILE))


def public_corpus(spark: SparkSession) -> DataFrame:
    """Corpus of the short public licenses that this package has in full; longer ones are read from files (``sources.licenses``)."""
    return spark.createDataFrame(list(TEXTS.items()), "spdx string, text string")


def license_words(text: Column) -> Column:
    """Words of a license text in lower case, without copyright lines and punctuation."""
    body = F.regexp_replace(F.lower(text), r"(?m)^[ \t]*copyright\b[^\n]*", " ")
    return F.filter(F.split(body, r"[^\p{L}\p{N}.]+"), lambda w: F.replace(w, F.lit("."), F.lit("")) != "")


def shingles(words: Column, size: int = SHINGLE_WORDS) -> Column:
    """Hashes of the distinct runs of ``size`` words; a shorter text is one run of all its words, none has no run.

    Hashes, as Spark finds distinct numbers by hashing but distinct texts by comparing all of them.
    """

    def runs(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - size + 1, F.lit(1)))
        # The hash of an array is that of its elements one after the other, and what is beyond its end is null and adds nothing.
        every = F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + (n - 1)) for n in range(size)])))
        return F.when(F.size(words) > 0, every).otherwise(F.array().cast("array<long>"))

    return F.element_at(F.transform(F.array(words), runs), 1)


def _fitting(words: Column, sizes: Row, threshold: float) -> tuple[Column, Column]:
    """Whether a text may have as many shingles as a similar license, told by its words; and whether its shingles are as many."""
    most = F.greatest(F.size(words) - SHINGLE_WORDS + 1, F.lit(1))
    least = F.lit(int(math.ceil(sizes["least"] * threshold - 1e-9)))
    n = F.size("members")
    return (F.size(words) > 0) & (most >= least), n.between(least, F.lit(int(sizes["most"] / threshold + 1e-9)))


def license_sets(candidates: DataFrame, sizes: Row, threshold: float = CONFIDENCE) -> DataFrame:
    """Key columns, ``_digest`` of the words and ``members`` (shingles) of candidates of fitting size, with each text taken apart once."""
    keys = [c for c in candidates.columns if c != "content"]
    text = F.make_valid_utf8(F.col("content").cast("string"))
    enough, fits = _fitting(F.col("_words"), sizes, threshold)
    worded = with_computed(candidates, _words=license_words(text)).where(enough)
    digested = with_computed(worded, _digest=F.sha2(F.array_join("_words", " "), 256), members=shingles(F.col("_words"))).where(fits)
    return digested.select(*keys, "_digest", "members")


def license_matches(candidates: DataFrame, corpus: DataFrame, threshold: float = CONFIDENCE) -> DataFrame:
    """Licenses similar enough to each candidate, with their confidence: the Jaccard similarity of the shingle sets.

    Candidates have a ``content`` and any key columns, which are passed on; the corpus has ``spdx`` and ``text``. The size of the sets is bounded first: a text
    with too few words is dropped before it is taken apart, one with too few or too many shingles before any of them moves. Most
    repositories share a handful of license texts, so equal texts become one, told by a digest of their words, and each distinct text is compared
    once (:func:`similar_sets`). Only digests meet the candidates again. The least and the largest size in the corpus are fetched beforehand, and
    the sets of fitting size are written to the shared folder, so texts are read once.
    """
    keys = [c for c in candidates.columns if c != "content"]
    known = corpus.select(F.col("spdx").alias("id"), shingles(license_words(F.col("text"))).alias("members")).where(F.size("members") > 0)
    sizes = known.agg(F.min(F.size("members")).alias("least"), F.max(F.size("members")).alias("most")).first()
    if sizes["least"] is None:
        return candidates.select(*keys, F.lit("").alias("spdx"), F.lit(0.0).alias("confidence")).limit(0)
    digested = stage(license_sets(candidates, sizes, threshold), "license-sets")  # read twice below; only sets of fitting size
    distinct = digested.groupBy(F.col("_digest").alias("id")).agg(F.any_value("members").alias("members"))
    found = similar_sets(distinct, known, threshold)
    return digested.select(*keys, "_digest").join(found, F.col("_digest") == F.col("left_id")).select(
        *keys, F.col("right_id").alias("spdx"), F.col("similarity").alias("confidence")
    )


def best_license(matches: DataFrame) -> DataFrame:
    """Best license of each repository that has one; equal confidence goes to the first id."""
    best = F.min_by("spdx", F.struct(-F.col("confidence"), "spdx"))
    return matches.groupBy("repo").agg(best.alias("license"), F.max("confidence").alias("confidence"))


def repo_license(candidates: DataFrame, corpus: DataFrame, threshold: float = CONFIDENCE) -> DataFrame:
    """Best license of each repository among its candidates (repo, path, content)."""
    return best_license(license_matches(candidates, corpus, threshold))
