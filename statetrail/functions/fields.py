"""Regex groups of a line in one pass.

``regexp_extract`` runs the whole match again for every group. A line holds no
line feed and neither does any group of our patterns, so the match is rewritten
once to its groups joined by line feeds and split once.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from statetrail.functions.let import only_if


def regex_parts(text: Column, pattern: str, groups: list[str]) -> Column:
    """Array ``['', g1, g2, ...]``, or the unsplit text when nothing matched.

    ``groups`` are replacement items: ``$n`` for a group, anything else literal.
    ``(?d)`` keeps ``.`` running over every character but the line feed.
    """
    joined = "".join("\n" + g for g in groups)
    return F.split(F.regexp_replace(text, f"(?d){pattern}(?s:.*)$", joined), "\n")


def matched_parts(text: Column, parts: Column, fewest: int) -> Column:
    """Array with the parts when at least ``fewest`` groups matched, else empty."""
    return only_if(
        parts,
        lambda p: (F.size(p) > fewest) & (F.get(p, F.lit(0)) == "") & ~text.startswith("\n"),
    )
