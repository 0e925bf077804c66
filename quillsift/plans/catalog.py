"""All named queries of the library and the SQL they are checked against."""

from __future__ import annotations

from quillsift.plans import corpus, images, similarity, visits  # noqa: F401  (they register their queries)
from quillsift.plans.base import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
