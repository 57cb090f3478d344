"""License notices against a plain search."""

import re

from tallyforge.llm import notices
from tests.llm.cases import odd_texts, rows, table

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TEXTS = [
    "Licensed under the Apache License, Version 2.0.", "CC-BY/cc by CC BY-NC 4.0", "All rights reserved. all\nRIGHTS-reserved", "ALL RIGHTS rights reserved",
    "GNU General Public License, version 3", "licensed under the GNU General Public Licence version 3", "under license under the apache license version 2.1", "apache",
    "released under an MIT license", "MIT license", "x " * 500 + "Released under the MIT License. " + "y " * 500 + "Licensed under CC BY-NC 4.0.",
    "by all rights " * 3000 + "all rights reserved", "version 2 0 the license apache under licensed", "Public License v. 2.0 subject to the terms of the Mozilla Public License, v. 2.0",
]


def own_rows():
    return rows() + [(5000 + i, t, *[None] * 9) for i, t in enumerate(TEXTS + TEXTS[:2])] + [(None, TEXTS[0], *[None] * 9)]


def words(text):
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(all_words):
    """Template, start and share of every row, with rare words counted over all of them."""
    held = {}
    for w in all_words:
        for x in set(w):
            held[x] = held.get(x, 0) + 1
    out = []
    for w in all_words:
        found = []
        for number, t in enumerate(notices.TEMPLATES):
            first = {}
            for i, x in enumerate(t.words):
                first.setdefault(x, i)
            rare = sorted(first.items(), key=lambda x: (held.get(x[0], 0), x[1]))[:3]
            need = len(rare) if t.text == t.phrase else 2
            phrase = t.phrase.split()
            for start in range(-len(t.words), len(w)):
                stands = lambda i: 0 <= start + i < len(w) and w[start + i] == t.words[i]  # noqa: B023,E731
                if sum(stands(i) for _, i in rare) >= need and all(stands(i + t.phrase_at) for i in range(len(phrase))):
                    share = sum(stands(i) for i in range(len(t.words))) / len(t.words)
                    if share >= notices.LEAST:
                        found.append((number, start, share))
        out.append((len(w), sorted(found)))
    return out


def test_notices_equal_brute_force(spark):
    own = own_rows()
    found = notices.find(table(spark, own)).select("row.doc_id", "row.text", "n_words", "notices", notices.labels(notices.F.col("notices")).alias("labels")).collect()
    expected = {(r[0], r[1]): x for r, x in zip(own, plain([words(r[1]) for r in own]))}
    assert len(found) == len(own)
    for r in found:
        assert (r.n_words, sorted(tuple(m) for m in r.notices)) == expected[r.doc_id, r.text], r
        assert r.labels == ",".join(sorted({notices.TEMPLATES[m["template"]].label for m in r.notices}))
    got = {r.text: r.labels for r in found}
    assert got[TEXTS[0]] == "apache-2.0" and got[TEXTS[1]] == "cc-by" and got[TEXTS[2]] == "reserved" and got[TEXTS[3]] == ""
    assert got[TEXTS[8]] == "mit" and got[TEXTS[9]] == "" and got[TEXTS[10]] == "cc-by,cc-by-nc,mit" and got[TEXTS[6]] == "" and got[TEXTS[12]] == ""


def test_base_phrases_are_found_at_every_place(spark):
    texts = [t for t in TEXTS + odd_texts()]
    found = notices.find(table(spark, [(i, t, *[None] * 9) for i, t in enumerate(texts)])).select("row.doc_id", "notices").collect()
    for r in found:
        w = words(texts[r.doc_id])
        for number, t in enumerate(notices.TEMPLATES[:3]):
            n = len(t.words)
            assert [i for i in range(len(w)) if w[i : i + n] == t.words] == sorted(m["start"] for m in r.notices if m["template"] == number)


def test_empty_table_and_own_templates(spark):
    assert notices.find(table(spark, [])).collect() == []
    own = [notices.Template("x", "alpha beta gamma delta", "beta gamma")]
    found = notices.find(table(spark, [(1, "say Alpha, beta gamma -- delta!", *[None] * 9), (2, "beta gamma delta", *[None] * 9), (3, "beta", *[None] * 9)]), own)
    got = {r.doc_id: [tuple(m) for m in r.notices] for r in found.select("row.doc_id", "notices").collect()}
    assert got == {1: [(0, 1, 1.0)], 2: [(0, -1, 0.75)], 3: []}
