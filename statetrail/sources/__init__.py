"""Readers: text lines, entity ids, typed hand-off tables."""

from statetrail.sources.lines import number_lines, read_entities, read_lines
from statetrail.sources.tables import read_table

__all__ = ["number_lines", "read_entities", "read_lines", "read_table"]
