"""The queries of this library by name, and the SQL that checks them."""

from __future__ import annotations

from .plans import editing, inspection, text

_PLANS = (inspection, editing, text)


def flagship(spark, sf_dir):
    return queries()["doc_profile"](spark, sf_dir)


def queries():
    return {k: f for p in _PLANS for k, f in p.QUERIES.items()}


def oracle_sql():
    return {k: s() if callable(s) else s for p in _PLANS for k, s in p.SQL.items()}
