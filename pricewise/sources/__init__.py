"""Sources and sinks: explicit schemas, CSV/Parquet readers, result writers and
the fixture views built from the driver's tables."""

from .schema import LISTING_SCHEMA, REVISION_SCHEMA
from .readers import read_listings, read_revisions, read_table, write_bucketed, write_result
from .fixtures import listing_view, revision_view

__all__ = [
    "LISTING_SCHEMA", "REVISION_SCHEMA", "read_listings", "read_revisions", "read_table",
    "write_result", "write_bucketed", "listing_view", "revision_view",
]
