"""All queries of the engine and their SQL twins, by name."""

from __future__ import annotations

from canvass.queries import dashboards, features, linkage, matching, reports, rollups, rules, statistics

MODULES = (rollups, dashboards, linkage, matching, reports, rules, features, statistics)


def queries() -> dict:
    return {name: fn for m in MODULES for name, (fn, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
