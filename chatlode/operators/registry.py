"""Registry of queries: a DataFrame function with the SQL that gives the same rows, or none."""

from __future__ import annotations

from chatlode.functions.text import ASSISTANT_ALIASES, USER_ALIASES
from chatlode.operators.timestamps import normalized_sql

QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = (f, sql)
        return f

    return add


_in = lambda words: ", ".join(f"'{w}'" for w in words)
ROLE_SQL = f"CASE WHEN lower(trim(role)) IN ({_in(ASSISTANT_ALIASES)}) THEN 'assistant' WHEN lower(trim(role)) IN ({_in(USER_ALIASES)}) THEN 'user' ELSE lower(trim(role)) END"
#: Messages with the role read through its aliases, and for the second also the instant of each time text, of any format, in
#: UTC and in the display zone (UTC+8).
ROLES_SQL = f"(SELECT *, {ROLE_SQL} AS rl FROM messages)"
MESSAGES_SQL = f"(SELECT *, {ROLE_SQL} AS rl, make_timestamp(utc_us) AS ts, make_timestamp(utc_us) + INTERVAL 8 HOUR AS lt FROM {normalized_sql()})"
