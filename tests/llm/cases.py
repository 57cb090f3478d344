"""Small documents with every odd case, and plain versions of what the operators compute."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, kept string, n long, part int, label string, spans string"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    text = text or ""
    return _WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text) if lower else text)


def prose(rng: random.Random, n: int) -> str:
    vocabulary = ["alpha", "beta", "Gamma", "delta,", "über", "naïve.", "token", "x", "日本", "end"] + [f"w{i}" for i in range(200)]
    return "".join(rng.choice(vocabulary) + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(n))


def odd_texts() -> list:
    rng = random.Random(5)
    base, passage = prose(rng, 120), " ".join(f"p{i}" for i in range(60))
    texts = [None, "", " \n\t ", "one", "one two three", "ONE two Three", "12 34 !!", "é", base, base, base.upper(), base + " more words here", "\x00\x1c odd line"]
    for k in range(25):  # near copies of one text, fewer and more changed
        own = base.split(" ")
        for _ in range(k // 4):
            own[rng.randrange(len(own))] = f"new{rng.random()}"
        texts.append(" ".join(own))
    texts += [prose(rng, 30) + " " + passage + " " + prose(rng, 30) for _ in range(12)]
    texts += [passage, passage + " " + passage, prose(rng, 20_000), "the cat sat on the mat " * 50]
    return texts


def rows() -> list[tuple]:
    """(doc_id, text, ...) with nulls in all columns, gaps in the ids, and repeated rows."""
    out = [(3 * i + 2, t, "en" if i % 3 else None, "s", len(t or ""), "r", "k", i, i, "l", "x") for i, t in enumerate(odd_texts())]
    return out + [out[8], out[8], out[30]] + [(None, out[8][1], None, None, None, None, None, None, None, None, None)]


def table(spark, chosen=None):
    return spark.createDataFrame(rows() if chosen is None else chosen, DOCS)
