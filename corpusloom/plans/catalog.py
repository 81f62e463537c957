"""Loads every module that registers queries."""

from . import (queries_corpus, queries_search, queries_groups, queries_logs,  # noqa: F401
               queries_evaluation, queries_streams)
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
