"""Registered queries, one module per family, each with its DuckDB equivalent where SQL can state it."""

from __future__ import annotations

from tamis.plans import books, chats, corpora, corpus, extras, gates, judging, measures, relational, searches, spine, turns

FAMILIES = (corpus, chats, measures, relational, gates, corpora, judging, spine, turns, books, extras, searches)


def registry() -> dict:
    return {name: query for family in FAMILIES for name, query in family.QUERIES.items()}


def oracles() -> dict:
    return {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
