"""Spelling variants against a plain comparison of all words."""

import random
import re
import zlib
from collections import Counter

import pytest

from tallyforge.llm import spelling
from tests.llm.cases import rows, table


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(counts):
    form, out = {}, {}
    for word, n in counts.items():
        others = [w for w in counts if near(word, w)]
        best = min(others, key=lambda w: (-counts[w], w), default=None)
        form[word] = best if best is not None and counts[best] >= 5 * n else None
        out[word] = len(others)
    def root(word):
        return word if form[word] is None else root(form[word])
    return {(w, form[w], root(w), n, out[w], counts.get(form[w])) for w, n in counts.items()}


def plain_counts(docs):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{key}:{run}".encode())
            if key is not None and h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def made_up(rng, n):
    """Words of few letters, many of them near each other."""
    out = {"a" * 6: 4000, "a" * 7: 700, "a" * 8: 100, "aaaaaab": 20, "baaaaaa": 20, "ÿàéÿàé": 30, "ÿàéÿà": 300, "x" * 3000: 9, "x" * 2999: 60, "x" * 2999 + "y": 60}
    while len(out) < n:
        out["".join(rng.choice("abcß") for _ in range(rng.randrange(3, 9)))] = rng.choice([5, 5, 7, 40, 300, 3000])
    return out


@pytest.mark.parametrize("partitions", ["8", "60"])
def test_variants_equal_brute_force(spark, partitions):
    counts = made_up(random.Random(4), 700)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = [tuple(r) for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(got) == len(set(got)) and set(got) == plain(counts)
    assert sum(r[1] is not None for r in got) > 100 and max(r[4] for r in got) > 10
    assert any(r[2] != r[1] and r[1] is not None for r in got)


def test_words_of_texts_equal_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    own = rows() + [(1000 + i, " ".join(rng.choice(["Colour", "colours", "Straße", "naïveté", "abcdef×g", "donaudampf", "DONAUDAMPF"]) for _ in range(40)), *[None] * 9) for i in range(300)]
    own += [(9, "y" * 20_000, *[None] * 9)] * 5 + [(None, "colour " * 50, *[None] * 9)]
    counts = spelling.word_counts(table(spark, own), planted=199)
    expected = plain_counts([(r[0], r[1]) for r in own])
    assert {r.word: r.n for r in counts.collect()} == expected
    got = [tuple(r) for r in spelling.variants(counts).collect()]
    assert set(got) == plain(expected) and len(got) == len(expected)
    assert any(r[1] == "colour" or r[1] == "donaudampf" for r in got)


def test_nothing_in_common_and_empty_table(spark):
    one = spark.createDataFrame([("lonely", 7)], "word string, n long")
    assert [tuple(r) for r in spelling.variants(one).collect()] == [("lonely", None, "lonely", 7, 0, None)]
    assert spelling.variants(spelling.word_counts(table(spark, []))).collect() == []
