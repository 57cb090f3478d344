"""Periodic runs against a plain search of all lags."""

import random

import numpy as np
import pytest

from tallyforge.llm import periods
from tests.llm.cases import rows, table, words


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 3 + 1):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(24, 3 * q):
                found.setdefault((i - q, j - i + q), q)  # the smallest period comes first
            i = j
    return sorted((start, length, q) for (start, length), q in found.items())


def plain_collapsed(w):
    gone = {i for start, length, q in plain_runs(w) for i in range(start + q, start + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(rng):
    """Words of few kinds, with phrases, repeated phrases and phrases made of few parts."""
    kinds, out, size = rng.choice([1, 2, 3, 6]), [], rng.choice([30, 120, 400])
    block = lambda m: [rng.randrange(kinds) for _ in range(m)]
    while len(out) < size:
        choice = rng.random()
        if choice < 0.3:
            out += block(rng.randrange(1, 20))
        elif choice < 0.8:
            out += block(rng.randrange(1, 9)) * rng.randrange(1, 12)
        else:
            a, b = block(5), block(5)
            out += sum([rng.choice([a, b]) for _ in range(rng.randrange(2, 12))], []) * rng.randrange(1, 5)
    return out


def test_runs_equal_brute_force():
    rng, total = random.Random(1), 0
    for _ in range(600):
        w = repetitive(rng)
        expected = plain_runs(w)
        assert periods.runs(np.array(w)) == expected, w
        total += len(expected)
    assert total > 500


def test_contexts_that_recur_within_a_period():
    # Each pair of blocks stands twice in the period, so only a context as long as the period tells it.
    a, b = list(range(20)), list(range(20, 40))
    w = [99, *sum([a, a, a, b, b, b, a, b], []) * 4, 98]
    assert periods.runs(np.array(w)) == plain_runs(w)
    assert (1, 640, 160) in periods.runs(np.array(w))


@pytest.mark.parametrize("w, expected", [
    (np.zeros(300_000, np.int64), [(0, 300_000, 1)]),
    (np.arange(300_000) % 7, [(0, 300_000, 7)]),
    (np.arange(300_000) % 99_999, [(0, 300_000, 99_999)]),
    (np.arange(300_000), []),
    (np.zeros(23, np.int64), []),
    (np.zeros(0, np.int64), []),
])
def test_long_and_short_texts(w, expected):
    assert periods.runs(w) == expected


def test_rows_equal_brute_force(spark, monkeypatch):
    own = rows()
    rng = random.Random(2)
    own += [(1000 + i, " ".join(map(str, repetitive(rng))), *[None] * 9) for i in range(60)]
    own += [(2000, "tick tock " * 40_000, *[None] * 9), (None, "na " * 30, *[None] * 9), (2000, "tick tock " * 40_000, *[None] * 9)]
    found = periods.periodic_runs(table(spark, own)).select("row.*", "n_words", "runs", "collapsed", periods.most_repeated(periods.F.col("runs")).alias("best"))
    got = sorted((str((r[0], r[1])), r.n_words, [tuple(x) for x in r.runs], r.collapsed, r.best and tuple(r.best)) for r in found.toDF(*[f"c{i}" for i in range(11)], "n_words", "runs", "collapsed", "best").collect())
    expected = []
    for r in own:
        w = words(r[1])
        if r[0] == 2000:
            own_runs, collapsed = [(0, 80_000, 2)], "tick tock"
        else:
            own_runs, collapsed = plain_runs(w), plain_collapsed(w)
        best = max(own_runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        expected.append((str((r[0], r[1])), len(w), own_runs, collapsed, best))
    assert got == sorted(expected)
    assert sum(len(x[2]) for x in got) > 60


def test_texts_looked_at_together_stay_apart(spark, monkeypatch):
    # Twelve words each; together they would be runs.
    found = periods.periodic_runs(table(spark, [(i, "a b c " * 4, *[None] * 9) for i in range(9)]).coalesce(1)).collect()
    assert [r.runs for r in found] == [[]] * 9


def test_empty_table(spark):
    assert periods.periodic_runs(table(spark, [])).collect() == []
