"""The registered queries and their SQL."""

from . import archive_queries, catalogue_queries, citation_queries, composition_queries, form_queries, ledger_queries, person_queries, search_queries, text_queries, works_queries  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
