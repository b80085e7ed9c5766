"""Statements -> value tuples -> typed rows, with what does not fit kept aside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.literals import (
    EMPTY_FIRST, EMPTY_VALUE, TRIMMED_VALUE, TUPLE, VALUE, date_mask, date_text, is_null_literal, is_temporal,
    to_timestamp_value, to_typed_value,
)
from sluice.functions.text import insert_columns, insert_table_name, is_insert

# the flag stands at the words alone: a class that is matched in any case takes twice the time
HEAD = r"""\A\s*+(?i:INSERT)\s++(?i:INTO)\s++(?:"[^"]*"|`[^`]*`|[^\s("`]+)++\s*+(?:\(([^)]*)\)\s*+)?+(?i:VALUES)\s*+"""
_ONE_TUPLE = HEAD + rf"({TUPLE})[;\s]*+\z"
_ALL_TUPLES = HEAD + rf"{TUPLE}(?:\s*+,\s*+{TUPLE})*+[;\s]*+\z"

# Reasons a statement or tuple is set aside.
NOT_INSERT = "not_insert"
UNPARSED = "unparsed_values"
ARITY = "arity_mismatch"
UNKNOWN_COLUMN = "unknown_column"
BAD_VALUE = "bad_value"
UNSUPPORTED = "unsupported_expression"
OTHER_TABLE = "other_table"
BAD_BYTES = "bad_bytes"
#: column of statements that are to be set aside whole, as they belong to another table
MISPLACED = "_misplaced"


def column_names(listed: Column) -> Column:
    """Text of a column list -> ``a,b,c`` in lower case, without quotes and blanks."""
    return F.lower(F.regexp_replace(listed, r"""[\s"`]++""", ""))


def parse_tuples(stmts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per VALUES tuple: ``keep``, ``listed``, ``row_no``, ``tuple``, ``vals``, ``reason``.

    ``listed`` is the column list as written, empty where there is none. A statement that is no INSERT, that lost
    bytes when it was decoded, or whose values cannot be read gives one row with a reason and its text.
    """
    misplaced = F.col(MISPLACED) if MISPLACED in stmts.columns else F.lit(False)
    damaged = F.col(BAD_BYTES) if BAD_BYTES in stmts.columns else F.lit(False)
    heads = stmts.select(
        *keep, "stmt", (misplaced | damaged).alias(MISPLACED), damaged.alias(BAD_BYTES), F.regexp_extract("stmt", HEAD, 1).alias("listed"),
        F.regexp_extract("stmt", _ONE_TUPLE, 2).alias("single"),
    )
    # statements of one tuple, the usual form of a dump, are done with the first pattern
    several = F.regexp_extract_all(F.regexp_replace("stmt", HEAD, ""), F.lit(TUPLE), F.lit(0))
    tuples = (
        F.when(F.col(MISPLACED), F.array(F.lit(None).cast("string")))
        .when(F.col("single") != "", F.array("single"))
        .when(F.col("stmt").rlike(_ALL_TUPLES), several)
        .otherwise(F.array(F.lit(None).cast("string")))
    )
    rows = heads.select(*keep, "stmt", MISPLACED, BAD_BYTES, "listed", F.posexplode(tuples).alias("row_no", "tuple"))
    body = F.col("body")
    rows = rows.withColumn("body", F.substring(F.col("tuple"), F.lit(2), F.length("tuple") - 2))
    rows = rows.withColumn("vals", F.regexp_extract_all(body, F.lit(TRIMMED_VALUE), F.lit(1)))
    # a comma with nothing before or after it is looked for first, the exact test is made only where one is
    covered = F.array_join(F.regexp_extract_all(body, F.lit(VALUE), F.lit(0)), ",") == body
    reason = (
        F.when(F.col("tuple").isNull() & ~is_insert(F.col("stmt")), NOT_INSERT)
        .when(F.col(BAD_BYTES), BAD_BYTES)
        .when(F.col(MISPLACED), OTHER_TABLE)
        .when(F.col("tuple").isNull(), UNPARSED)
        .when((body.rlike(EMPTY_VALUE) | body.rlike(EMPTY_FIRST)) & ~covered, UNPARSED)
    )
    return rows.select(
        *keep, "listed", "row_no", F.coalesce("tuple", "stmt").alias("tuple"), "vals", reason.alias("reason")
    )


def explode_values(stmts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per value of every readable tuple: ``keep``, ``listed``, ``row_no``, ``pos`` (from 1), ``raw``."""
    # unreadable tuples end in the generator, which spares a filter that would parse the tuple once more
    values = F.posexplode(F.when(F.col("reason").isNull(), F.col("vals")))
    return (
        parse_tuples(stmts, keep)
        .select(*keep, "listed", "row_no", values.alias("i", "v"))
        .select(*keep, "listed", "row_no", (F.col("i") + 1).alias("pos"), F.col("v").alias("raw"))
    )


def column_lists(stmts: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per column an INSERT names: ``keep``, ``pos`` (from 1), ``column_name``."""
    return stmts.select(*keep, F.posexplode(insert_columns(F.col("stmt"))).alias("i", "column_name")).select(
        *keep, (F.col("i") + 1).alias("pos"), "column_name"
    )


def typed_rows(stmts: DataFrame, schema: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """Typed rows of one table: ``keep``, the fields of ``schema``, ``_tuple`` and ``_reason``.

    ``_reason`` is NULL for rows that fit. Values go by the column list of the INSERT where it has one, else
    by position; a column the list leaves out is NULL.
    """
    names = [f.name.lower() for f in schema]
    fields = list(enumerate(schema))
    tuples = parse_tuples(stmts, keep)
    as_schema = F.col("listed").isin("", ", ".join(names), ",".join(names), ", ".join(schema.names))
    listed = F.split(column_names(F.col("listed")), ",")
    by_name = F.transform(
        F.array(*[F.lit(n) for n in names]), lambda n: F.get("vals", F.array_position(listed, n).cast("int") - 1))
    n_expected = F.when(F.col("listed") == "", F.lit(len(names))).otherwise(F.size(listed))
    unknown = ~as_schema & (F.size(F.array_except(listed, F.array(*[F.lit(n) for n in names]))) > 0)
    # a list in another order, or with fewer columns, is brought into the order of the schema
    ordered = tuples.select(
        *keep, "tuple",
        F.when(as_schema, F.col("vals")).otherwise(by_name).alias("vals"),
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(as_schema & (F.size("vals") == len(names)), F.lit(None))
        .when(F.size("vals") != n_expected, ARITY)
        .when(unknown, UNKNOWN_COLUMN).alias("reason"),
    )

    def raw(i: int) -> Column:
        return F.get("vals", F.lit(i))

    dated = ordered.select(
        "*",
        *[c for i, f in fields if is_temporal(f.dataType)
          for c in (date_text(raw(i)).alias(f"_d{i}"), date_mask(raw(i)).alias(f"_m{i}"))],
    )

    def value(i: int, f: T.StructField) -> Column:
        if is_temporal(f.dataType):
            return to_timestamp_value(F.col(f"_d{i}"), F.col(f"_m{i}")).cast(f.dataType)
        return to_typed_value(raw(i), f.dataType)

    typed = dated.select(*keep, "tuple", "vals", "reason", *[value(i, f).alias(f"_t{i}") for i, f in fields])
    reason = F.when(F.col("reason").isNotNull(), F.col("reason"))
    for i, f in fields:
        lost = F.col(f"_t{i}").isNull() & raw(i).isNotNull() & ~is_null_literal(raw(i))
        why = UNSUPPORTED if isinstance(f.dataType, T.StringType) else BAD_VALUE
        reason = reason.when(lost, F.lit(f"{why}:{f.name}"))
    row = F.struct(
        *[F.col(f"_t{i}").alias(f.name) for i, f in fields],
        F.col("tuple").alias("_tuple"), reason.alias("_reason"),
    )
    # a generator of one row: filters on _reason stay above it, so no value is parsed a second time
    return typed.select(*keep, F.inline(F.array(row)))


def good_rows(typed: DataFrame) -> DataFrame:
    return typed.filter("_reason IS NULL").drop("_tuple", "_reason")


def rejected_rows(typed: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """What was set aside: ``keep``, the text of the tuple or statement, and why."""
    return typed.filter("_reason IS NOT NULL").select(
        *keep, F.col("_tuple").alias("raw"), F.col("_reason").alias("reason")
    )


def with_table_names(stmts: DataFrame) -> DataFrame:
    """Add ``table_name`` per statement; NULL for what is no readable INSERT."""
    return stmts.withColumn("table_name", insert_table_name(F.col("stmt")))
