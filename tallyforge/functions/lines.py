"""Line, comment and branch counts of one source text.

A text is counted where it lies, without exploding its lines into rows:

1. escaped characters go, so that a string ends at its next quote;
2. strings and comments are replaced by a mark (see ``rules.languages``);
3. a line is code if it still shows anything but white space and marks, blank if it shows nothing,
   and a comment line otherwise. Lines swallowed by a multi-line comment are comment lines too, as
   they are missing from the marked text but not from the total;
4. branch tokens are counted in what is left, so never inside strings or comments.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.rules.languages import MARK, SYNTAXES, branch_rule, token_rule

# A backquote keeps its backslash: in raw strings it ends the string.
_ESCAPED = r"\\[^\n`]"


def line_breaks(text: Column) -> Column:
    """Number of line feeds."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))


def total_lines(text: Column) -> Column:
    """Number of lines; a trailing line feed starts no further line, an empty text has none."""
    unfinished = F.when((text == "") | F.endswith(text, F.lit("\n")), F.lit(0)).otherwise(F.lit(1))
    return (line_breaks(text) + unfinished).cast("long")


def _literal(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _by_syntax(text: str, syntax: str, results: dict[int, str], otherwise: str) -> Column:
    """The result for the number of a syntax, each with its own literal pattern; results speak of the text as ``t``.

    The choice is made inside a lambda, where only the branch taken is evaluated. Generated code would
    hold all branches in one method, too large to be compiled to machine code. Written as one SQL
    expression, because building it call by call takes seconds on the driver. Numbers are found by halves, as there are dozens.
    """

    def chosen(numbers: list[int]) -> str:
        if len(numbers) <= 2:
            branches = " ".join(f"WHEN {number} THEN {results[number]}" for number in numbers)
            return f"CASE {syntax} {branches} ELSE {otherwise} END" if numbers else otherwise
        middle = len(numbers) // 2
        return f"IF({syntax} < {numbers[middle]}, {chosen(numbers[:middle])}, {chosen(numbers[middle:])})"

    return F.expr(f"element_at(transform(array({text}), t -> {chosen(sorted(results))}), 1)")


def unescape(text: Column) -> Column:
    """Text without escaped characters; most texts have none."""
    return F.when(F.contains(text, F.lit("\\")), F.regexp_replace(text, _ESCAPED, "")).otherwise(text)


def mark_tokens(unescaped: str, syntax: str) -> Column:
    """Text of a column with strings and comments replaced; unchanged for a syntax that has neither."""
    results = {}
    for number, rule in enumerate(SYNTAXES):
        tokens, replacement, _ = token_rule(rule)
        if tokens:
            results[number] = f"regexp_replace(t, {_literal(tokens)}, {_literal(replacement)})"
    return _by_syntax(unescaped, syntax, results, "t")


def raw_string_breaks(unescaped: str, syntax: str) -> Column:
    """Line feeds inside multi-line strings: these lines are code although the mark hides them."""
    results = {}
    for number, rule in enumerate(SYNTAXES):
        tokens, _, raw_group = token_rule(rule)
        if raw_group:
            quoted = " OR ".join(f"contains(t, {_literal(quote)})" for quote in rule.raw)
            raw = f"array_join(regexp_extract_all(t, {_literal(tokens)}, {raw_group}), '')"
            breaks = f"octet_length({raw}) - octet_length(replace({raw}, '\\n', ''))"
            results[number] = f"IF({quoted}, CAST({breaks} AS BIGINT), 0L)"
    return _by_syntax(unescaped, syntax, results, "0L")


_SPACES = " \t\r\f\x0B"
_EMPTY_LINE = rf"\n(?:[{_SPACES + MARK}]*+(?=\n)|[{_SPACES + MARK}]++\z)"


def led_by_feed(text: Column) -> Column:
    """A text after a line feed, so that its first line begins like all others."""
    return F.concat(F.lit("\n"), text)


def empty_lines(led: Column) -> Column:
    """Array of the lines of a marked text that show nothing but white space and marks, each after its line feed; the text is led by one.

    They are few, so they are looked for instead of all others.
    """
    return F.regexp_extract_all(led, F.lit(_EMPTY_LINE), F.lit(0))


def code_lines(marked: Column, empty: Column | None = None) -> Column:
    """Lines of a marked text that show code: all but its :func:`empty_lines`, which are made here if they are not at hand."""
    return total_lines(marked) - F.array_size(empty_lines(led_by_feed(marked)) if empty is None else empty)


def blank_lines(marked: Column, empty: Column | None = None) -> Column:
    """Lines of a marked text that show nothing at all, not even a mark."""
    empty = empty_lines(led_by_feed(marked)) if empty is None else empty
    return F.array_size(F.filter(empty, lambda line: ~F.contains(line, F.lit(MARK)))).cast("long")


def branch_count(led: str, syntax: str) -> Column:
    """Branch tokens of a marked text that is led by a line feed, 0 for a syntax without any.

    The pattern is the one white space before a token, a single byte, so the bytes that go with it are counted: there are many, and a list of them costs more.
    """
    results = {}
    for number, rule in enumerate(SYNTAXES):
        pattern = branch_rule(rule)
        if pattern:
            results[number] = f"CAST(octet_length(t) - octet_length(regexp_replace(t, {_literal(pattern)}, '')) AS BIGINT)"
    return _by_syntax(led, syntax, results, "0L")
