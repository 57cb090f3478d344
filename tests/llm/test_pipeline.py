"""The corpus pipeline from documents to packed tokens, against the same in plain Python."""

import random
import re
from collections import Counter

import numpy as np

import corpus_pipeline
from tallyforge.llm import bpe, secrets
from tallyforge.llm.queries import vocabulary
from tests.llm.cases import odd_texts, table, words
from tests.llm.test_documents import count_grouped, passage_texts


def documents():
    rng = random.Random(12)
    texts = odd_texts()
    keys = [f"note {i} api_key = 'abcdef{i}9' then token: {'x' * 9}{i} end of note number {i} with more words {rng.random()}" for i in range(12)]
    keys += ["AKIA" + "ABCDEFGHIJKLMNOPQRST", "id " + "0a" * 15 + " and password=" + "0f" * 14, "Grüße ohne alles"]
    return [(7 * i + 3, t, ["en", "de", None][i % 3], "s", len(t or ""), *[None] * 6) for i, t in enumerate(texts + keys)]


def linked_groups(docs):
    sets = {}
    for i, text in docs:
        w = words(text, lower=True)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a, x in sets.items():
            for b, y in sets.items():
                if x and y and 100 * len(x & y) >= 75 * len(x | y) and label[b] < label[a]:
                    label[a] = label[b]
                    changed = True
    return label


def without_repeats(docs):
    first, out = {}, []
    for i, text in sorted(docs):
        w = words(text)
        for p in range(len(w) - 19):
            first.setdefault(tuple(w[p : p + 20]), (i, p))
    for i, text in docs:
        w = words(text)
        gone = {p + k for p in range(len(w) - 19) for k in range(20) if first[tuple(w[p : p + 20])] != (i, p)}
        if len(w) > len(gone):
            out.append((i, " ".join(x for p, x in enumerate(w) if p not in gone) if gone else text))
    return out


def redacted(text):
    found = [m.span() for m in re.finditer(secrets.ASSIGN, text) if len(m[2]) >= 6] + [m.span() for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [m.span() for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    out, at = "", 0
    for start, end in sorted(found):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, end)
    return out + text[at:]


def test_pipeline_equals_plain_python(spark, tmp_path):
    docs = documents()
    table(spark, docs).write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()

    kept = [(r[0], r[1]) for r in docs if any(c.isalpha() for c in r[1] or "")]
    label = linked_groups(kept)
    kept = [(i, t) for i, t in kept if label[i] == i]
    kept = [(i, redacted(t)) for i, t in without_repeats(kept)]
    assert 10 < len(kept) < len(docs) - 10 and sum("[SECRET]" in t for _, t in kept) > 10

    library = bpe.Coder(vocabulary()).library
    expected = Counter()
    for i, text in kept:
        ids = library.encode(text, add_special_tokens=False).ids + [1]
        expected.update((i, len(ids), k, x) for k, x in enumerate(ids))
    got = Counter()
    for r in found:
        got.update((r.doc_id, r.doc_tokens, r.start + k, x) for k, x in enumerate(np.frombuffer(r.ids, "<u4").tolist()))
    assert got == expected


def test_near_copies_stage_does_not_group_documents_that_share_only_passages(spark, monkeypatch):
    grouped = count_grouped(monkeypatch)
    docs = spark.createDataFrame(list(enumerate(passage_texts())), "doc_id long, text string")
    kept = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == list(range(240))
    assert grouped["shingle-groups"] <= 20
