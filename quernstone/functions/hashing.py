"""Short keys for query texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def query_hash(query: Column) -> Column:
    """First 8 hex digits of the SHA-256 of a query text."""
    return F.substring(F.sha2(query, 256), 1, 8)
