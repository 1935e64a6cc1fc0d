"""Column names that don't clash."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_name(name: str, *tables: DataFrame) -> str:
    """The name, lengthened until no table has it; case doesn't count."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name
