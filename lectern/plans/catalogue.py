"""Imports every query module, which registers its queries."""

from lectern.plans import context, documents, evaluation, glossary, library, notes, retrieval, streams, transcripts, usage  # noqa: F401
from lectern.plans.registry import all_queries, all_sql  # noqa: F401
