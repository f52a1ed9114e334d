"""Every query of the engine, with the SQL that an oracle runs on the same tables."""

from . import formats, mapped, metadata, skipping, sql_mix, surfaces, timelines  # noqa: F401  (each registers its queries)
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
