"""Import every catalog module so that all queries and SQL twins register."""

from . import catalog_growth, catalog_revisions  # noqa: F401
from .oracle import SQL
from .queries import QUERIES

__all__ = ["QUERIES", "SQL"]
