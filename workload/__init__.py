"""Queries over the test tables, each with the SQL that states the same result where SQL can."""

from workload import conversations, lookups, merging, parsing, reshaping, sources, stages, streams, validation
from workload.base import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "conversations",
    "lookups",
    "merging",
    "parsing",
    "reshaping",
    "sources",
    "stages",
    "streams",
    "validation",
]
