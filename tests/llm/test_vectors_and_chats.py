"""Nearest vectors, conversations, components and the pipeline."""

import math
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm import chats, neighbours
from tallyforge.llm.components import components


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 200), (200, 250), (7, 7), (None, 3)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len(found) == len({r.node for r in found})
    assert {r.label for r in found if r.node <= 40} == {0} and {r.label for r in found if 100 <= r.node < 160} == {100}
    assert {r.node: r.label for r in found if r.node >= 200} == {200: 200, 250: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


VECTORS = "vec_id long, embedding array<float>, label int, leaf int, score double"


def test_nearest_vectors_against_brute_force(spark):
    rng = np.random.default_rng(2)
    points = rng.normal(size=(600, 16)).astype(np.float32)
    points[100:300] = points[100]  # many equal vectors
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0]]
    data = [(i, p.tolist(), 0, 0, 0.0) for i, p in enumerate(points)] + [(1000 + 50 * i, v, None, None, None) for i, v in enumerate(odd)]
    data += [(None, points[0].tolist(), 1, 1, 1.0)]
    table = spark.createDataFrame(data, VECTORS)
    found = neighbours.nearest(table, table.where("vec_id % 50 = 0")).collect()
    wide = points.astype(np.float64)
    unit = wide / np.linalg.norm(wide, axis=1, keepdims=True)
    hits = total = 0
    for q in range(0, 600, 50):
        cosine = unit @ unit[q]
        cosine[q] = -np.inf
        own = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - cosine[r.vec_id]) < 1e-12 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        true = np.sort(cosine)[::-1][4]
        hits += sum(r.score >= true - 1e-12 for r in own)
        total += 5
    assert {r.query_id for r in found} == set(range(0, 600, 50)) and hits >= 0.9 * total


def plain_cosine(a, b):
    def dot(x, y):
        total = 0.0
        for v, w in zip(x, y):
            total += float(v) * float(w)
        return total

    return dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b)))


@pytest.mark.parametrize("part", [16_000, 70])
def test_ties_go_to_smaller_ids_whatever_the_blocks(spark, monkeypatch, part):
    monkeypatch.setattr(neighbours, "PART", part)
    rng = np.random.default_rng(3)
    points = rng.normal(size=(500, 24)).astype(np.float32)
    points[40:440] = points[40]
    points[450:] = points[445] * 3  # parallel, with another length
    table = spark.createDataFrame([(i, p.tolist(), 0, 0, 0.0) for i, p in enumerate(points)], VECTORS)
    found = neighbours.nearest(table, table.where("vec_id % 50 = 0")).collect()
    for q in range(50, 440, 50):
        own = [(r.vec_id, r.score) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)]
        assert own == [(i, plain_cosine(points[q], points[i])) for i in [i for i in range(40, 60) if i != q][:5]]
    assert all(r.score == plain_cosine(points[r.query_id], points[r.vec_id]) for r in found)


def test_components_out_of_the_range_of_squares(spark):
    vectors = [(0, [1e200, 0.0]), (1, [3e-200, 3e-200]), (2, [0.0, 5e-324]), (3, [-1e308, 1e300]), (4, [2.0, 1e-3])]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    found = neighbours.nearest(table, table.where("vec_id = 0")).orderBy("rank").collect()
    assert [r.vec_id for r in found] == [4, 1, 2, 3]
    assert np.allclose([r.score for r in found], [1 / math.sqrt(1 + 2.5e-7), math.sqrt(0.5), 0.0, -1.0])


def test_nearest_vectors_of_tiny_tables(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 2.0])], "vec_id long, embedding array<double>")
    found = neighbours.nearest(few, few.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in found] == [(0, 1), (0, 50), (50, 1), (50, 0)]
    assert neighbours.nearest(few.where("vec_id = 0"), few).where("query_id = 0").collect() == []
    assert neighbours.nearest(few.where("false"), few).collect() == []


CHAT = "conv_id long, turn long, role string, text string, part int, at long"


def _turns(conv, texts, first=0):
    return [(conv, first + i, "user" if i % 2 == 0 else "assistant", t, 1, 1) for i, t in enumerate(texts)]


def test_snapshots_collapse_to_maximal_conversations(spark, monkeypatch):
    monkeypatch.setattr(chats, "BLOCK", 3)
    long = [f"t{i}" for i in range(10)]
    data = _turns(1, long) + _turns(2, long[:4]) + _turns(3, long) + _turns(4, long[1:]) + _turns(5, [*long[:4], "x"], first=7)
    data += _turns(6, ["a", None]) + _turns(7, ["a", ""]) + _turns(8, ["a"]) + [(9, None, None, None, None, None)] * 2 + [(None, 1, "user", "z", 1, 1)]
    found = chats.collapse(spark.createDataFrame(data, CHAT)).collect()
    assert {r.conv_id for r in found} == {1, 4, 5, 6, 7, 9, None}
    text = {}
    for r in sorted(found, key=lambda r: (r.conv_id is None, r.conv_id, r.part)):
        text[r.conv_id] = text.get(r.conv_id, "") + r.rendered
    assert text[1] == "".join(f"<|im_start|>{'user' if i % 2 == 0 else 'assistant'}\nt{i}<|im_end|>\n" for i in range(10))
    assert Counter(r.conv_id for r in found)[1] == 4 and {r.n_turns for r in found if r.conv_id == 1} == {10}
    assert text[9] == "<|im_start|>\n<|im_end|>\n" * 2
    assert chats.collapse(spark.createDataFrame([], CHAT)).collect() == []


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline
    from tests.llm.cases import rows

    columns = "doc_id long, text string, lang string, source string, n_chars long"
    texts = {r[0]: r[1] for r in rows() if r[0] is not None}
    docs = spark.createDataFrame([r[:5] for r in rows()], columns)
    stages = dict(corpus_pipeline.STAGES)
    spoken = stages["language_id"](spark, docs, "").collect()
    assert {r.doc_id for r in spoken if r.doc_id is not None} == {i for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    kept = stages["near_copies"](spark, spark.createDataFrame(spoken, columns), "").collect()
    assert len(kept) < len(spoken) and len({r.doc_id for r in kept if r.doc_id}) == len([r for r in kept if r.doc_id])
    shorter = stages["repeated_passages"](spark, spark.createDataFrame(kept, columns), "").collect()
    assert sum(len(r.text) for r in shorter) < sum(len(r.text) for r in kept) and all(r.n_chars == len(r.text) for r in shorter)
    hidden = spark.createDataFrame([(1, "my password=hunter2hunter2 ok", "en", "s", 29), (2, "clean", "en", "s", 5), (3, None, None, None, None)], columns)
    assert [r.text for r in stages["secret_scan"](spark, hidden, "").orderBy("doc_id").collect()] == ["my [SECRET] ok", "clean", None]
    assert stages["packing"](spark, hidden, "").count() > 0
