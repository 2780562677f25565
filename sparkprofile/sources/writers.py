"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_tables(tables: dict[str, DataFrame], path: str, format: str = "json", mode: str = "overwrite") -> dict[str, str]:
    """One sub-folder per table; JSON lines by default.  Returns the folder of each table."""
    places = {}
    for name, table in tables.items():
        places[name] = f"{path.rstrip('/')}/{name}"
        table.write.mode(mode).format(format).save(places[name])
    return places


def write_json(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> dict[str, str]:
    """A whole analysis as JSON, one sub-folder per result table."""
    return write_tables(tables, path, "json", mode)
