"""License notices in texts, by a positional index of the rarest words of notice templates.

1. The documents that hold each word of the templates are counted, over all documents; the fewer, the higher its inverse document frequency.
2. Of each template the ``RARE`` words of highest inverse document frequency are indexed, with their relative positions. A file looks up
   those of its own words that the index has.
3. A posting says where the template would begin in the file: the word's place less its relative position. The postings of a template
   are intersected: two different words at least must agree on a beginning (all, for a template that is one phrase).
4. There the mandatory phrase of the template is verified word by word, and the share of the template's words that stand in their
   places is its score. A notice is reported from ``LEAST`` on, so single words may differ elsewhere.

All of it is Spark functions on the row that holds the text: nothing is shuffled but the counts of the template words, which are as few as
the templates are long.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words are of digits, lower-case letters and everything beyond ASCII; all else separates them.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RARE = 3
LEAST = 0.75


@dataclass(frozen=True)
class Template:
    """Words of a notice. The phrase is mandatory; a template without other words is found where its phrase stands."""

    label: str
    text: str
    phrase: str
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def phrase_at(self) -> int:
        words, phrase = self.words, self.phrase.split()
        return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


# Phrases that always count, and the notices by which the licenses themselves (as listed by SPDX) ask to be named, or their first words.
TEMPLATES = [
    Template("cc-by", "cc by", "cc by", base=True),
    Template("gpl", "general public license", "general public license", base=True),
    Template("reserved", "all rights reserved", "all rights reserved", base=True),
    Template("agpl", "licensed under the gnu affero general public license", "gnu affero general public license"),
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    Template("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license version 1 0"),
    Template("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    Template("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    Template("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    Template("cc0-1.0", "waived all copyright and related or neighboring rights to this work", "all copyright and related or neighboring rights"),
    Template("epl-2.0", "made available under the terms of the eclipse public license 2 0", "eclipse public license 2 0"),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3"),
    Template("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "with or without fee"),
    Template("lgpl", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    Template("mit", "released under the mit license", "mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "free of charge to any person obtaining a copy"),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
]


def words_of(text: Column) -> Column:
    """Words of a text, with A-Z in lower case."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase), F.lit(WORD), F.lit(0))


def _literals(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def word_counts(docs: DataFrame, templates: list[Template] = TEMPLATES, text_column: str = "text") -> dict[str, int]:
    """Rows that hold each word of the templates, over all rows. As many numbers as the templates have words reach the driver."""
    vocabulary = _literals(sorted({word for t in templates for word in t.words}))
    held = docs.select(F.explode(F.array_intersect(words_of(F.col(text_column)), vocabulary)).alias("word"))
    return {row["word"]: row["count"] for row in held.groupBy("word").count().collect()}


def index(counts: dict[str, int], templates: list[Template] = TEMPLATES) -> list[list[tuple[str, int]]]:
    """For each template its words that the fewest rows hold, each with its first place; ties go to the first place."""
    out = []
    for t in templates:
        places = {word: i for i, word in reversed(list(enumerate(t.words)))}
        out.append(sorted(places.items(), key=lambda x: (counts.get(x[0], 0), x[1]))[:RARE])
    return out


def find(docs: DataFrame, templates: list[Template] = TEMPLATES, text_column: str = "text") -> DataFrame:
    """``row`` (all columns of the input as a struct), ``n_words`` and ``notices``: array of (template, start, share).

    ``template`` is a place in ``templates``, ``start`` the word where it begins (from 0; below 0 if the text begins inside it), ``share`` that of its words in place. Templates of one phrase are
    found at every place. Null and empty texts have no words and no notices. Each row is looked at by itself, but for the counts that
    choose what is indexed; repeated rows have equal notices, ids may be null or repeat, and extra columns pass through
    in ``row``, whatever their names. A very long text takes time in proportion to its words. An empty table gives none. The texts are read twice and never shuffled.
    """
    postings = index(word_counts(docs, templates, text_column), templates)
    looked_up = sorted({word for anchors in postings for word, _ in anchors})
    rows = docs.select(F.struct("*").alias("row"), words_of(F.col(text_column)).alias("words"))
    place = F.transform("words", lambda w, i: F.when(w.isin(looked_up), F.struct(i.alias("at"), w.alias("word"))))
    none = F.array().cast("array<struct<at:int,word:string>>")
    hits = F.when(F.arrays_overlap("words", _literals(looked_up)), F.filter(place, lambda h: h.isNotNull())).otherwise(none)
    rows = rows.select("row", "words", hits.alias("hits"))

    def notices(number: int, t: Template, anchors: list[tuple[str, int]]) -> Column:
        def begins(word: str, relative: int) -> Column:
            return F.transform(F.filter("hits", lambda h: h["word"] == word), lambda h: h["at"] - relative)

        def stands(start: Column, at: int) -> Column:
            return F.coalesce(F.get("words", start + at) == t.words[at], F.lit(False))

        sets = [begins(*anchor) for anchor in anchors]
        if t.text == t.phrase or len(sets) < 3:
            starts = sets[0]
            for more in sets[1:]:
                starts = F.array_intersect(starts, more)
        else:
            starts = F.array_union(F.array_intersect(sets[0], F.array_union(sets[1], sets[2])), F.array_intersect(sets[1], sets[2]))

        def verified(start: Column) -> Column:
            holds = F.lit(True)
            for at in range(t.phrase_at, t.phrase_at + len(t.phrase.split())):
                holds = holds & stands(start, at)
            return holds

        def scored(start: Column) -> Column:
            in_place = F.lit(0)
            for at in range(len(t.words)):
                in_place = in_place + stands(start, at).cast("int")
            return F.struct(F.lit(number).alias("template"), start.alias("start"), (in_place / len(t.words)).alias("share"))

        found = F.filter(F.transform(F.filter(starts, verified), scored), lambda m: m["share"] >= LEAST)
        # Two of the words looked up must be there at all.
        return F.when(F.size("hits") > 1, found).otherwise(F.array().cast("array<struct<template:int,start:int,share:double>>"))

    every = F.concat(*(notices(i, t, anchors) for i, (t, anchors) in enumerate(zip(templates, postings))))
    return rows.select("row", F.size("words").cast("long").alias("n_words"), every.alias("notices"))


def labels(notices: Column, templates: list[Template] = TEMPLATES, base: bool = False) -> Column:
    """Distinct labels of notices, sorted and comma-joined; ``base`` takes those of base templates alone."""
    names = _literals([t.label for t in templates])
    if base:
        notices = F.filter(notices, lambda m: m["template"].isin([i for i, t in enumerate(templates) if t.base]))
    return F.array_join(F.array_sort(F.array_distinct(F.transform(notices, lambda m: F.get(names, m["template"])))), ",")
