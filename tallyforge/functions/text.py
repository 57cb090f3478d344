"""String, label and ratio functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as Unicode sees it, not only blanks.
_EDGE_SPACE = r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$"
_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"
_ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def blank_to_null(value: Column) -> Column:
    """Null for the empty string, the value otherwise."""
    return F.nullif(value, F.lit(""))


def trim_space(value: Column) -> Column:
    """Strip every kind of white space at both ends (``F.trim`` strips blanks only)."""
    return F.regexp_replace(value, _EDGE_SPACE, "")


def first_line(value: Column) -> Column:
    """Text before the first line break."""
    return F.split_part(value, F.lit("\n"), F.lit(1))


def _url_segments(url: Column) -> Column:
    return F.split(F.regexp_replace(url, "/+$", ""), "/")


def url_owner(url: Column) -> Column:
    """Last but one segment of a repository URL, empty when there are fewer than two."""
    parts = _url_segments(url)
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(F.lit(""))


def url_name(url: Column) -> Column:
    """Last segment of a repository URL, empty when there are fewer than two."""
    parts = _url_segments(url)
    return F.when(F.size(parts) >= 2, F.element_at(parts, -1)).otherwise(F.lit(""))


def url_project_path(url: Column) -> Column:
    """Whole path of a repository URL without the leading slash (group/subgroup/name)."""
    path = F.try_parse_url(url, F.lit("PATH"))
    return F.regexp_replace(F.coalesce(path, F.lit("")), "^/", "")


def thousands(number: Column) -> Column:
    """Integer with comma separators; a minus sign is kept."""
    return F.format_number(number, 0)


def comment_ratio(comments: Column, code: Column) -> Column:
    """Comments as a percentage of comments and code, 0 when there is neither."""
    total = comments + code
    return F.when(total == 0, F.lit(0.0)).otherwise(comments / F.nullif(total, F.lit(0)) * 100)


def percent(part: Column, whole: Column) -> Column:
    """Part as a percentage of whole, 0 when the whole is 0."""
    return F.when(whole > 0, part / F.nullif(whole, F.lit(0)) * 100).otherwise(F.lit(0.0))


def percent_label(value: Column) -> Column:
    """One decimal and a percent sign."""
    return F.format_string("%.1f%%", value)


def date_part(value: Column) -> Column:
    """``yyyy-MM-dd`` of an ISO timestamp or date as written, any other text unchanged."""
    well_formed = (value.rlike(_RFC3339) | value.rlike(_ISO_DATE)) & F.try_to_timestamp(value).isNotNull()
    return F.when(well_formed, F.substring(value, 1, 10)).otherwise(value)


def capitalize(value: Column) -> Column:
    """First letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(value, 1, 1)), F.substring(value, 2, 1_000_000))


def signed(number: Column, *, separators: bool = False) -> Column:
    """``+n`` or ``-n``; null stays null."""
    text = thousands(number) if separators else number.cast("string")
    return F.when(number >= 0, F.concat(F.lit("+"), text)).otherwise(text)


def report_title(workspace: Column, organization: Column) -> Column:
    """Workspace when given, else the organisation."""
    return F.coalesce(blank_to_null(workspace), organization, F.lit(""))


def report_organization(org: Column, user: Column, group: Column) -> Column:
    """A group wins over a user, a user over an organisation."""
    return F.coalesce(blank_to_null(group), blank_to_null(user), org, F.lit(""))


def top_names(entries: Column, count: int) -> Column:
    """Names of the largest entries of ``array<struct<code, name>>``, joined by a comma and a blank."""
    ordered = F.array_sort(F.transform(entries, lambda e: F.struct((-e["code"]).alias("k"), e["name"].alias("name"))))
    return F.array_join(F.transform(F.slice(ordered, 1, count), lambda e: e["name"]), ", ")
