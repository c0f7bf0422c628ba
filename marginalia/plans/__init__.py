"""Queries of the library's own operators, by name, and their SQL."""

from . import cohort_queries, connector_queries, feature_queries, history_queries, keyed_queries, learned_queries, more_queries, record_queries, rest_queries, scoring_queries, series_queries, store_queries, text_queries
from .bindings import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "cohort_queries", "connector_queries", "feature_queries", "history_queries", "keyed_queries", "learned_queries", "more_queries", "record_queries", "rest_queries", "scoring_queries", "series_queries", "store_queries", "text_queries"]
