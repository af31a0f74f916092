"""String columns: month lists, region codes, labels, dates as text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def relmonth_count(string, window, split: str = ":") -> Column:
    """How many tokens of a delimited month string fall in ``window``.

    A repeated token counts each time, a token that is no number never counts,
    and a null string counts zero.
    """
    s = F.col(string) if isinstance(string, str) else string
    months = [float(m) for m in window]
    hits = F.filter(F.split(s, split), lambda t: t.try_cast("double").isin(months))
    return F.coalesce(F.size(hits), F.lit(0)).cast("int")


def parent_region(code) -> Column:
    """Drop the last level of a dotted region code ("6.2.13" -> "6.2")."""
    c = F.col(code) if isinstance(code, str) else code
    return F.regexp_replace(c, r"\p{Punct}\d+$", "")


def cluster_label(group, number) -> Column:
    g = F.col(group) if isinstance(group, str) else group
    n = F.col(number) if isinstance(number, str) else number
    return F.format_string("%s.%04d", g.cast("string"), n.cast("int"))


def parse_mixed_date(text) -> Column:
    """ISO dates, else month/day/year; anything else is null."""
    t = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.try_to_date(t, "yyyy-MM-dd"), F.try_to_date(t, "M/d/yyyy"))


def region_pattern(codes) -> str:
    """Regular expression that selects stations by region code prefixes.

    A code that reads as a number ("8", "8.2") is a whole level, so a literal
    dot must follow; a level-three code is a bare prefix, which also selects
    longer codes that start with it.
    """
    parts = []
    for code in codes:
        try:
            float(code)
            parts.append(f"^{code}\\.")
        except ValueError:
            parts.append(f"^{code}")
    return "|".join(parts)


def region_match(column, codes, exact: bool = False) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    if not exact:
        return c.rlike(region_pattern(codes))
    return c.rlike("|".join(f"^{re.escape(code)}(\\.|$)" for code in codes))


def reviewer_tag(path, rules: dict[str, str], default: str = "unknown") -> Column:
    """Name of the first rule whose pattern is found in a file path."""
    p = F.col(path) if isinstance(path, str) else path
    tag = F.lit(default)
    for name, pattern in reversed(list(rules.items())):
        tag = F.when(p.rlike(pattern), F.lit(name)).otherwise(tag)
    return tag
