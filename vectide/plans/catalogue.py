"""Queries of the library's operators on the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from vectide.plans import catalogue_graph, catalogue_mining, catalogue_more, catalogue_search, catalogue_series, catalogue_stream  # noqa: F401
from vectide.plans.base import QUERIES, SQL  # noqa: F401
