"""Registered queries by theme; ``all_queries`` and ``all_sql`` gather them."""

from __future__ import annotations


def all_queries() -> dict:
    from . import derived, floors, intake, outlines, paths, records, relational, series, spatial

    return {**series.QUERIES, **relational.QUERIES, **spatial.QUERIES, **derived.QUERIES, **paths.QUERIES, **intake.QUERIES, **records.QUERIES, **floors.QUERIES, **outlines.QUERIES}


def all_sql() -> dict[str, str]:
    from . import derived, floors, intake, outlines, paths, records, relational, series, spatial

    return {**series.SQL, **relational.SQL, **spatial.SQL, **derived.SQL, **paths.SQL, **intake.SQL, **records.SQL, **floors.SQL, **outlines.SQL}
