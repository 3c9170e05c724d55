"""The archive's queries, each with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from chatlode.operators import classify, enrichment, relations, roundtrip, search, stats, timestamps, topics, views  # noqa: F401  the modules register their queries
from chatlode.operators.registry import QUERIES


def queries():
    return {name: f for name, (f, _) in QUERIES.items()} | {"p4_found": timestamps.p4_found, "p4_readings": timestamps.p4_readings}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql} | {"p4_found": timestamps.FOUND_SQL}
