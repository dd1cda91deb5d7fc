"""All core queries: name -> callable, and name -> SQL."""

from __future__ import annotations

from ..operators import units
from ..session import table
from . import evaluation, filings, retrieval, stores, streams, verification  # noqa: F401
from .registry import QUERIES, SQL, query

FLAGSHIP = "ranking_report"


@query()
def p3_amounts(spark, d):
    return units.common_amounts(table(spark, d, "gold_items"), table(spark, d, "number_mentions"), table(spark, d, "chunks"))


@query()
def p3_found(spark, d):
    return p3_amounts(spark, d).select("table_name", "rec_key", "common_unit", "amount")
