"""Commit author and message functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import trim_space

# Tool names, message phrases and signal names that decide the result.
AI_TOOL_NAMES = [
    "claude", "copilot", "cursor", "codeium", "gemini", "chatgpt", "openai", "anthropic", "windsurf", "aider",
    "amazon q",
]
AI_MESSAGE_PHRASES = ["generated by", "ai-generated", "ai-assisted", "auto-generated"]
SIGNAL_CO_AUTHOR = "co-author"
SIGNAL_COMMIT_MESSAGE = "commit-message"
SIGNAL_BOT_AUTHOR = "bot-author"


def _any_of(words: list[str]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


# (?dm): only a line feed ends a line, and ^ matches at every line start.
_CO_AUTHOR_LINE = r"(?dm)^[\s\p{Z}\x{85}]*+co-authored-by:[^\n]*" + _any_of(AI_TOOL_NAMES)


def names_ai_co_author(message: Column) -> Column:
    """True when a co-author trailer line names one of the tools."""
    return F.lower(message).rlike(_CO_AUTHOR_LINE)


def has_ai_phrase(message: Column) -> Column:
    """True when the message contains one of the phrases."""
    return F.lower(message).rlike(_any_of(AI_MESSAGE_PHRASES))


def is_bot(author: Column) -> Column:
    """True when the author is marked as a bot."""
    return F.contains(F.lower(author), F.lit("[bot]"))


def ai_signals(author: Column, message: Column) -> Column:
    """Array of the signals of one commit, each at most once, in fixed order."""
    return F.array_compact(
        F.array(
            F.when(names_ai_co_author(message), F.lit(SIGNAL_CO_AUTHOR)),
            F.when(has_ai_phrase(message), F.lit(SIGNAL_COMMIT_MESSAGE)),
            F.when(is_bot(author), F.lit(SIGNAL_BOT_AUTHOR)),
        )
    )


def is_ai_flagged(author: Column, message: Column) -> Column:
    """True when a commit has any signal; cheaper than building the array."""
    flagged = names_ai_co_author(message) | has_ai_phrase(message) | is_bot(author)
    return F.coalesce(flagged, F.lit(False))


def author_identity(author: Column) -> Column:
    """E-mail inside the first angle brackets, else the whole text; trimmed, lower case."""
    inner = F.when(author.rlike("<[^>]*>"), F.regexp_extract(author, "<([^>]*)>", 1)).otherwise(author)
    return F.lower(trim_space(inner))
