"""Rows -> INSERT statements -> dump files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions.literals import render_literal


def insert_text(df: DataFrame, table: str | Column, list_columns: bool = True) -> Column:
    """``INSERT INTO t (a, b) VALUES (1, 'x')`` for each row, without the end mark."""
    columns = f" ({', '.join(df.columns)})" if list_columns else ""
    literals = [render_literal(F.col(f.name), f.dataType) for f in df.schema]
    name = F.lit(table) if isinstance(table, str) else table
    return F.concat(
        F.lit("INSERT INTO "), name, F.lit(f"{columns} VALUES ("), F.concat_ws(", ", *literals), F.lit(")")
    )


def render_inserts(df: DataFrame, table: str, keep: Sequence[str] = (), list_columns: bool = True) -> DataFrame:
    """Add nothing but the statement: ``keep`` columns and ``stmt`` with its end mark."""
    return df.select(*keep, F.concat(insert_text(df, table, list_columns), F.lit(";")).alias("stmt"))


def write_dump(statements: DataFrame, path: str, separator: str = ";\n") -> str:
    """Write the single string column of ``statements`` (no end marks) as dump files, one per partition."""
    statements.write.option("lineSep", separator).text(path)
    return path


def export_dump(df: DataFrame, table: str, path: str, list_columns: bool = True) -> str:
    return write_dump(df.select(insert_text(df, table, list_columns).alias("value")), path)
