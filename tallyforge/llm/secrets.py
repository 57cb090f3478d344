"""Secrets in texts: known forms, and strings that pass for random.

Known forms are regular expressions. Besides them, every long run of letters, digits and +/_=- is a candidate. The alphabet of
its encoding (hexadecimal, base 32, base 64) is inferred from its characters, and three tests ask whether it was drawn
from that alphabet at random: chi-squared for equal frequencies, runs above and below the middle of the alphabet, and
serial correlation. Their p values (the smallest, times three) are uniform for random strings and near zero for words,
so the number of p values above a half tells how many candidates of an encoding and length are random. For each such
class the smallest threshold is taken at which no more than ``FALSE`` of the reported candidates are expected not to be
random. Short strings give weak tests, which raises the threshold of their class.

All of it is Spark functions; counts of p values are combined before they move, and the thresholds are a small map.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.session import stage

# Fixed patterns of the known forms, and the least length of the group that decides.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
KINDS = {"assign": (ASSIGN, 2, 6), "access": (ACCESS, 0, 20), "hex": (HEX, 0, 24)}
#: Words one of which every assignment holds, in lower case.
HINTS = ("passw", "secret", "token", "api")

# A whole run of at least 20 characters none of which is marked as part of a known form.
_MARK = "\x01"
CANDIDATE = rf"(?<![A-Za-z0-9+/_={_MARK}-])[A-Za-z0-9+/_=-]{{20,}}+(?!{_MARK})"
#: Rows of an array that are walked through before their results are put together.
BLOCK = 128
# Alphabets by name: a pattern of all their strings, and their characters in order.
ALPHABETS = {
    "hex": ("^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef"),
    "base32": ("^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base64": ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}
#: Share of the reported candidates that may be expected not to be random.
FALSE = 0.05
#: Steps in which thresholds of p are chosen, and lengths at which a class of lengths begins.
STEPS, LENGTHS = 20, (20, 28, 40, 64, 128)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """An expression over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _walk(rows: Column, begin: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """What ``step(state, row)``, a pair of the next state and an entry of type ``kind``, gives for each row of an array.

    In blocks, as an array that grows by one entry a step is copied at every step: so the copies add up to little more than the rows.
    """

    def block(state: Column, rows: Column) -> Column:
        def add(s: Column, row: Column) -> Column:
            following, entry = step(s["state"], row)
            return F.struct(following.alias("state"), F.concat(s["out"], F.array(entry)).alias("out"))

        return F.aggregate(rows, F.struct(state.alias("state"), F.array().cast(f"array<{kind}>").alias("out")), add)

    def blocks(rows: Column) -> Column:
        def add(s: Column, i: Column) -> Column:
            done = block(s["state"], F.slice(rows, i * BLOCK + 1, F.lit(BLOCK)))
            return let(done, lambda d: F.struct(d["state"].alias("state"), F.concat(s["out"], F.array(d["out"])).alias("out")))

        numbers = F.sequence(F.lit(0), ((F.size(rows) - 1) / BLOCK).cast("int"))
        start = F.struct(begin.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out"))
        return F.flatten(F.aggregate(numbers, start, add, lambda s: s["out"]))

    return let(rows, blocks)


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Pieces between the matches, each with the match that follows it (null after the last) and the group that decides."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    decides = found if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.arrays_zip(F.split(text, pattern, -1).alias("piece"), found.alias("found"), decides.alias("decides"))


def _spans_of(matches: Column, least: int) -> Column:
    """Places of matches: the lengths of the pieces and matches before them, added up."""

    def step(at: Column, row: Column) -> tuple[Column, Column]:
        start = at + F.length(row["piece"])
        end = start + F.coalesce(F.length(row["found"]), F.lit(0))
        return end, F.struct(start.alias("start"), end.alias("end"), row["found"].alias("found"), F.length(row["decides"]).alias("size"))

    every = _walk(matches, F.lit(0), "struct<start:int,end:int,found:string,size:int>", step)
    return F.transform(F.filter(every, lambda s: s["size"] >= least), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found")))


def spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """Leftmost non-overlapping matches as (start, end, found), in code points, end exclusive; those with a short group go.

    Between the matches lie the pieces that splitting by the pattern leaves, so their lengths add up to the places, in time proportional
    to the text and its matches.
    """
    return F.when(text.rlike(pattern), _spans_of(_matches(text, pattern, group), least)).otherwise(F.array().cast("array<struct<start:int,end:int,found:string>>"))


def masked(text: Column, pattern: str, group: int, least: int) -> Column:
    """Text with a mark in place of each character of the matches that ``spans`` reports."""

    def shown(row: Column) -> Column:
        found = F.when(F.length(row["decides"]) >= least, F.repeat(F.lit(_MARK), F.length(row["found"]))).otherwise(F.coalesce(row["found"], F.lit("")))
        return F.concat(row["piece"], found)

    return F.when(text.rlike(pattern), F.array_join(F.transform(_matches(text, pattern, group), shown), "")).otherwise(text)


def normal_above(z: Column) -> Column:
    """Share of a normal distribution above z, to about 0.0002 (Page 1977)."""
    return 1 / (1 + F.exp(F.least(F.greatest(1.5976 * z + 0.07056 * z * z * z, F.lit(-700.0)), F.lit(700.0))))


def _total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, v: s + v)


def _but_last(array: Column) -> Column:
    return F.slice(array, 1, F.size(array) - 1)


def _but_first(array: Column) -> Column:
    return F.slice(array, 2, F.size(array) - 1)


def _chi_squared(x: Column, k: Column) -> Column:
    """Standardised chi-squared statistic of equal frequencies of k values."""
    n = F.size(x).cast("double")
    squares = _total(F.transform(F.array_distinct(x), lambda v: F.pow(F.size(F.filter(x, lambda w: w == v)).cast("double"), F.lit(2.0))))
    return (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))


def _runs(u: Column) -> Column:
    """Standardised number of runs of equal values among zeros and ones; 9 if there is but one value."""

    def of(counts: Column) -> Column:
        n, ones = counts["n"], counts["ones"]
        expected = 2 * ones * (n - ones) / n + 1
        spread = (expected - 1) * (expected - 2) / (n - 1)
        return F.when(spread > 0, (counts["changes"] + 1 - expected) / F.sqrt(spread)).otherwise(F.lit(9.0))

    changes = _total(F.zip_with(_but_last(u), _but_first(u), lambda a, b: F.abs(a - b)))
    return let(F.struct(F.size(u).cast("double").alias("n"), _total(u).alias("ones"), changes.alias("changes")), of)


def _serial(c: Column) -> Column:
    """Standardised correlation of centered values with their successors; 9 if they are all equal."""

    def of(sums: Column) -> Column:
        n = sums["n"]
        return F.when(sums["squares"] > 0, (sums["products"] / sums["squares"] + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))

    products = _total(F.zip_with(_but_last(c), _but_first(c), lambda a, b: a * b))
    squares = _total(F.transform(c, lambda v: v * v))
    return let(F.struct(F.size(c).cast("double").alias("n"), products.alias("products"), squares.alias("squares")), of)


def encoding_of(value: Column) -> Column:
    """Name of the smallest alphabet that a string fits."""
    return F.when(value.rlike(ALPHABETS["hex"][0]), "hex").when(value.rlike(ALPHABETS["base32"][0]), "base32").otherwise("base64")


def randomness(value: Column, encoding: Column) -> Column:
    """How well a string passes for random in its encoding: the smallest of three p values, times three."""
    letters = F.when(encoding == "hex", ALPHABETS["hex"][1]).when(encoding == "base32", ALPHABETS["base32"][1]).otherwise(ALPHABETS["base64"][1])
    body = F.translate(value, "-_=", "+/")
    body = F.when(encoding == "hex", F.lower(body)).otherwise(body)
    two = lambda z: 2 * normal_above(F.abs(z))

    def p(x: Column, k: Column) -> Column:
        upper = F.transform(x, lambda v: F.when(v >= k / 2, 1.0).otherwise(0.0))
        centered = let(_total(x) / F.size(x), lambda mean: F.transform(x, lambda v: v - mean))
        least = F.least(normal_above(_chi_squared(x, k)), let(upper, lambda u: two(_runs(u))), let(centered, lambda c: two(_serial(c))))
        return F.when(F.size(x) > 2, F.least(F.lit(1.0), 3 * least)).otherwise(F.lit(0.0))

    places = lambda alphabet: F.filter(F.transform(F.split(body, ""), lambda c: (F.instr(alphabet, c) - 1).cast("double")), lambda v: v >= 0)
    return let(letters, lambda alphabet: let(places(alphabet), lambda x: p(x, F.length(alphabet).cast("double"))))


def length_class(size: Column) -> Column:
    """Number of the class of a length."""
    level = F.lit(0)
    for at in LENGTHS[1:]:
        level = level + F.when(size >= at, 1).otherwise(0)
    return level


ORDER = {kind: i for i, kind in enumerate([*KINDS, "random"])}


def scan(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``row`` (all columns as a struct), ``known`` (spans of the known forms), ``random`` (candidates with their p values).

    A candidate that meets a known form is none. That is told by marking the known forms in the text before candidates are looked for, so
    no two lists of spans are compared.
    """
    rows = docs.select(F.struct("*").alias("row"))
    text = F.coalesce(F.col("row")[text_column], F.lit(""))
    low, hinted = F.lower(text), F.lit(False)
    for hint in HINTS:
        hinted = hinted | low.contains(hint)
    empty = F.array().cast("array<struct<start:int,end:int,found:string>>")
    present = {"assign": hinted, "access": text.contains("AKIA"), "hex": F.lit(True)}

    def placed(kind: str) -> Column:
        found = F.when(present[kind], spans(text, *KINDS[kind])).otherwise(empty)
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(ORDER[kind]).alias("kind"), s["end"].alias("end")))

    def hidden(kind: str) -> Callable[[Column], Column]:
        return lambda t: F.when(present[kind], masked(t, *KINDS[kind])).otherwise(t)

    # Most texts have no known form, and none has the mark in it.
    unmarked = F.when(text.contains(_MARK), F.translate(text, _MARK, " ")).otherwise(text)

    def rest(known: Column) -> Column:
        marked = unmarked
        for kind in KINDS:
            marked = let(marked, hidden(kind))
        return F.when(F.size(known) > 0, marked).otherwise(unmarked)

    def tested(s: Column) -> Column:
        return let(
            encoding_of(s["found"]),
            lambda e: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), e.alias("encoding"),
                length_class(s["end"] - s["start"]).alias("length_class"), randomness(s["found"], e).alias("p"),
            ),
        )

    def both(known: Column) -> Column:
        candidates = let(rest(known), lambda t: spans(t, CANDIDATE, 0, 0))
        return F.struct(known.alias("known"), F.transform(candidates, tested).alias("random"))

    found = let(F.concat(*(placed(kind) for kind in KINDS)), both)
    return rows.select("row", found.alias("found")).select("row", "found.known", "found.random")


def thresholds(scanned: DataFrame) -> dict[tuple[str, int], float]:
    """Least p value that is reported, for each encoding and class of lengths that has one; over all candidates."""
    step = F.least(F.floor(F.col("s.p") * STEPS), F.lit(STEPS - 1)).cast("int").alias("step")
    # The outer form keeps Spark from making the array once more to filter by it.
    tested = scanned.select(F.explode_outer("random").alias("s")).where("s IS NOT NULL").groupBy("s.encoding", "s.length_class", step).count()
    counts: dict[tuple[str, int], list[int]] = {}
    for encoding, length, at, n in tested.collect():  # encodings x lengths x steps rows at most
        counts.setdefault((encoding, length), [0] * STEPS)[at] = n
    out = {}
    for key, steps in counts.items():
        random = min(sum(steps), 2 * sum(steps[STEPS // 2 :]))
        for at in range(1, STEPS):  # p below one step is never taken for random
            reported = sum(steps[at:])
            if reported and 1 - random * (1 - at / STEPS) / reported <= FALSE:
                out[key] = at / STEPS
                break
    return out


def reported(least: dict[tuple[str, int], float]) -> Column:
    """All spans of a scanned row: array of (start, kind number, end), sorted."""

    def passes(s: Column) -> Column:
        level = F.lit(None).cast("double")
        for (encoding, length), at in least.items():
            level = F.when((s["encoding"] == encoding) & (s["length_class"] == length), F.lit(at)).otherwise(level)
        return F.coalesce(s["p"] >= level, F.lit(False))

    more = F.transform(F.filter("random", passes), lambda s: F.struct(s["start"].alias("start"), F.lit(ORDER["random"]).alias("kind"), s["end"].alias("end")))
    return F.array_sort(F.concat("known", more))


def joined(spans: Column) -> Column:
    """Spans as text: kind:start:end, comma-joined."""
    names = F.array(*(F.lit(kind) for kind in ORDER))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """Text with a mark in place of each span; overlapping spans share one."""
    # Four bytes a character, so that a piece is cut out without walking through the text before it.
    data = F.encode(text, "UTF-32")

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        apart = F.struct(at.alias("start"), s["start"].alias("end"))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, apart)

    def pieces(data: Column) -> Column:
        last = F.array(F.struct(F.array_max(F.transform(spans, lambda s: s["end"])).alias("start"), (F.octet_length(data) / 4).cast("int").alias("end")))
        kept = F.concat(F.filter(_walk(spans, F.lit(0), "struct<start:int,end:int>", step), lambda p: p.isNotNull()), last)
        cut = lambda p: F.decode(F.substring(data, 4 * p["start"] + 1, 4 * (p["end"] - p["start"])), "UTF-32")
        return F.array_join(F.transform(kept, cut), mark)

    return F.when(F.size(spans) > 0, let(data, pieces)).otherwise(text)


def find(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``row`` (all columns of the input as a struct) and ``spans``: array of (start, kind, end) sorted by start, then kind.

    Kinds are numbered assign, access, hex, random; places are code points, the end is exclusive. Spans of different known
    forms may overlap; a random one is reported where no known one is. Null and empty texts have none. Each row is looked
    at by itself, but for the thresholds, which hold for all rows together; repeated rows have equal spans. Ids may be null
    or repeat. Extra columns pass through in ``row``, whatever their names. The texts are read twice and never shuffled.
    """
    scanned = scan(docs, text_column)
    return scanned.select("row", reported(thresholds(scanned)).alias("spans"))


def find_narrow(docs: DataFrame, keep: list[str], text_column: str = "text") -> DataFrame:
    """As ``find`` without the text: what the scan finds is written, so texts are read once. ``row`` has columns ``keep``."""
    scanned = scan(docs, text_column)
    scanned = stage(scanned.select(F.struct(*(F.col("row")[c].alias(c) for c in keep)).alias("row"), "known", "random"), "secrets")
    return scanned.select("row", reported(thresholds(scanned)).alias("spans"))
