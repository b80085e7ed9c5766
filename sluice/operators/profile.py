"""Column profile, type inference and DDL rendering from parsed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions.ddl import dialect_type
from sluice.functions.literals import date_text, is_date_call, is_null_literal, is_quoted, to_text_value
from sluice.operators.values import column_names, explode_values, with_table_names

_NUMBER = r"^[+-]?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?$"
_FLOAT = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"
_DATE = r"^\d{4}-\d{2}-\d{2}$"
_STAMP = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?$"
# Bounds of INT and BIGINT, widest decimal, widest VARCHAR.
INT_MAX, BIGINT_MAX = 2**31 - 1, 2**63 - 1
MAX_DECIMAL = 38
MAX_VARCHAR = 65533
#: kinds of values; numbers, since every value is compared with most of them
NULL, INT, DEC, FLOAT, DATE, STAMP, TEXT = range(7)
#: digits that a long surely holds
_LONG_DIGITS = 18


def named_values(stmts: DataFrame) -> DataFrame:
    """Values of INSERTs: ``table_name, listed, pos, raw``; ``listed`` is the column list as written."""
    return explode_values(with_table_names(stmts).filter("table_name IS NOT NULL"), ["table_name"]).select(
        "table_name", "listed", "pos", "raw")


def _described(values: DataFrame) -> DataFrame:
    """Each value with its kind, text, digits and magnitude (a long, or a decimal where that is too short).

    Kinds are tried in the order of their cost; most values are settled by one test.
    """
    raw = F.col("raw")
    stamp = date_text(raw)
    is_date = stamp.rlike(_DATE) & stamp.try_cast("date").isNotNull()
    is_stamp = stamp.rlike(_STAMP) & stamp.try_cast("timestamp_ntz").isNotNull()
    dated = F.when(is_date, DATE).when(is_stamp, STAMP).otherwise(TEXT)
    kind = (
        F.when(is_quoted(raw), F.when((F.substring(raw, 6, 1) == "-") & F.length(raw).between(12, 32), dated).otherwise(TEXT))
        .when(raw.rlike(_NUMBER), F.when(F.contains(raw, F.lit(".")), DEC).otherwise(INT))
        .when(is_null_literal(raw), NULL)
        .when(is_date_call(raw), dated)
        # a leading zero carries meaning (codes), so such numbers count as text
        .when(raw.rlike(_FLOAT) & ~raw.rlike(r"^[+-]?0[0-9]"), FLOAT)
        .otherwise(TEXT)
    )
    known = values.select(*values.columns, kind.alias("kind"))
    sign = (raw.startswith("-") | raw.startswith("+")).cast("int")
    dot = F.instr(raw, ".")
    # what was found to be a date has its text where the test looked for it
    text = F.when(F.col("kind").between(INT, FLOAT), raw).when(F.col("kind").isin(DATE, STAMP), stamp).when(
        F.col("kind") != NULL, to_text_value(raw))
    long = F.length(raw) <= _LONG_DIGITS
    return known.select(
        *values.columns, "kind", text.alias("text"),
        F.when(F.col("kind") == INT, F.length(raw) - sign).when(F.col("kind") == DEC, dot - 1 - sign).alias("int_digits"),
        F.when(F.col("kind") == DEC, F.length(raw) - dot).alias("scale"),
        F.when((F.col("kind") == INT) & long, F.abs(raw.try_cast("long"))).alias("small"),
        F.when((F.col("kind") == INT) & ~long & (F.length(raw) <= 20), F.abs(raw.try_cast("decimal(20,0)"))).alias("large"),
    )


def _of_majority(per_list: DataFrame) -> DataFrame:
    """Positions that statements without column list have in most of their tuples; a stray longer tuple adds none."""
    own = Window.partitionBy("table_name", "listed").orderBy("pos")
    exactly = F.col("n") - F.coalesce(F.lead("n").over(own), F.lit(0))
    counted = per_list.withColumn("__exact", F.struct(exactly.alias("tuples"), F.col("pos").alias("arity")))
    usual = F.max("__exact").over(Window.partitionBy("table_name", "listed"))
    return counted.withColumn("__usual", usual).filter((F.col("listed") != "") | (F.col("pos") <= F.col("__usual.arity"))).drop("__exact", "__usual")


def profile_values(values: DataFrame, text_stats: bool = True, usual_arity: bool = False) -> DataFrame:
    """One row per table and column.

    Values are first summed up per column list and position (partial sums before the shuffle), then the few
    results are put under their column names: by the list, or ``c<pos>`` where the statement has none.
    ``text_stats`` adds least and greatest text and a distinct estimate, whose states are wider. ``usual_arity`` leaves
    out positions beyond the most frequent length of a table's tuples.
    """
    kinds = {"n_null": (NULL, NULL), "n_int": (INT, INT), "n_dec": (INT, DEC), "n_float": (INT, FLOAT),
             "n_date": (DATE, DATE), "n_stamp": (DATE, STAMP)}
    texts = [F.min("text").alias("min_text"), F.max("text").alias("max_text"), F.hll_sketch_agg("text").alias("distinct")]
    per_list = _described(values).groupBy("table_name", "listed", "pos").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("kind").between(*k)).alias(n) for n, k in kinds.items()],
        F.max(F.length("text")).alias("max_len"),
        *[F.max(c).alias(c) for c in ("int_digits", "scale", "small", "large")],
        *(texts if text_stats else []),
    )
    per_list = per_list.withColumn("magnitude", F.greatest(F.col("small").cast("decimal(20,0)"), "large")).drop("small", "large")
    per_list = _of_majority(per_list) if usual_arity else per_list
    texts = [F.min("min_text").alias("min_text"), F.max("max_text").alias("max_text"),
             F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("approx_distinct")]
    return per_list.withColumn("column_name", _column_name()).groupBy("table_name", "column_name").agg(
        F.min("pos").alias("pos"),
        *[F.sum(c).alias(c) for c in ("n", *kinds)],
        F.coalesce(F.max("max_len"), F.lit(0)).alias("max_len"),
        F.coalesce(F.max("int_digits"), F.lit(1)).alias("int_digits"),
        F.coalesce(F.max("scale"), F.lit(0)).alias("scale"),
        F.max("magnitude").alias("magnitude"),
        *(texts if text_stats else []),
    )


def _column_name() -> Column:
    """Name of the column at ``pos`` of the list ``listed``."""
    name = F.get(F.split(column_names(F.col("listed")), ","), F.col("pos") - 1)
    return F.when(F.col("listed") != "", name).otherwise(F.concat(F.lit("c"), F.col("pos")))


def sample_values(values: DataFrame, n: int = 5) -> DataFrame:
    """The n smallest raw values per column, joined; ranks are cut to n before the shuffle."""
    by_text = Window.partitionBy("table_name", "column_name").orderBy("raw")
    top = values.withColumn("column_name", _column_name()).withColumn("rank", F.row_number().over(by_text)).filter(F.col("rank") <= n)
    return top.groupBy("table_name", "column_name").agg(
        F.array_join(F.array_sort(F.collect_list("raw")), " | ").alias("samples")
    )


def infer_types(profile: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Narrowest type every non-null value fits, and the share that does.

    ``tolerance`` is the share of values that may miss; those rows are set aside by the load.
    """
    held = F.col("n") - F.col("n_null")
    enough = held * F.lit(1.0 - tolerance)

    def fits(c: str) -> Column:
        return (held > 0) & (F.col(c) >= enough)

    integer = (
        F.when(F.coalesce(F.col("magnitude") <= INT_MAX, F.lit(False)) & (F.col("int_digits") <= 10), "INT")
        .when(F.coalesce(F.col("magnitude") <= BIGINT_MAX, F.lit(False)) & (F.col("int_digits") <= 19), "BIGINT")
        .when(F.col("int_digits") <= MAX_DECIMAL, F.concat(F.lit("DECIMAL("), F.col("int_digits"), F.lit(",0)")))
    )
    precision = F.col("int_digits") + F.col("scale")
    decimal = F.when(
        precision <= MAX_DECIMAL, F.concat(F.lit("DECIMAL("), precision, F.lit(","), F.col("scale"), F.lit(")"))
    )
    text = F.when(
        F.col("max_len") <= MAX_VARCHAR, F.concat(F.lit("VARCHAR("), F.greatest("max_len", F.lit(1)), F.lit(")"))
    ).otherwise("TEXT")
    ladder = [("n_int", integer), ("n_dec", decimal), ("n_float", F.lit("DOUBLE")), ("n_date", F.lit("DATE")),
              ("n_stamp", F.lit("TIMESTAMP"))]
    sql_type, share = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(1.0))
    for column, name in ladder:
        # numbers of more digits than a decimal holds stay text, which keeps all of them
        taken = fits(column) & (name.isNotNull() if column in ("n_int", "n_dec") else F.lit(True))
        taken = taken & ~(fits("n_dec") & decimal.isNull()) if column == "n_float" else taken
        sql_type = sql_type.when(taken, name)
        share = share.when(taken, F.col(column) / held)
    return profile.select(
        "table_name", "pos", "column_name", sql_type.otherwise(text).alias("sql_type"),
        share.otherwise(F.lit(1.0)).alias("confidence"),
    )


def merge_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles of ``profile_values`` (without text statistics) put together: one row per table and column.

    Counts add up and extents take the greater, so the order of merging does not matter, and the type that ``infer_types``
    finds for a merged profile is the least one that holds the values of all parts.
    """
    counts = ["n", "n_null", "n_int", "n_dec", "n_float", "n_date", "n_stamp"]
    return profiles.groupBy("table_name", "column_name").agg(
        F.min("pos").alias("pos"), *[F.sum(c).alias(c) for c in counts],
        *[F.max(c).alias(c) for c in ("max_len", "int_digits", "scale", "magnitude")])


def infer_schema(stmts: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """INSERT statements -> ``table_name, pos, column_name, sql_type, confidence``."""
    return infer_types(profile_values(named_values(stmts), text_stats=False, usual_arity=True), tolerance)


def fallback_schema(tables: DataFrame, kind: str = "text") -> DataFrame:
    """Schema for tables whose values tell nothing.

    ``text``: one TEXT column per profiled column (lossless); ``generic``: the fixed three-column shape.
    """
    if kind == "text":
        return tables.select("table_name", "pos", "column_name", F.lit("TEXT").alias("sql_type"),
                             F.lit(0.3).alias("confidence"))
    # Columns of the generic table.
    shape = [("id", "BIGINT"), ("data", "TEXT"), ("created_time", "TIMESTAMP")]
    columns = F.array(*[F.struct(F.lit(i + 1).alias("pos"), F.lit(n).alias("column_name"), F.lit(t).alias("sql_type"))
                        for i, (n, t) in enumerate(shape)])
    return tables.select("table_name").distinct().select("table_name", F.inline(columns)).withColumn(
        "confidence", F.lit(0.3))


def render_ddl(schema: DataFrame, dialect: str = "doris", replication: int = 1, buckets: int = 10) -> DataFrame:
    """One CREATE TABLE per table, columns in order: ``table_name, ddl``. Groups are columns of one table."""
    line = F.concat_ws(" ", "column_name", dialect_type(F.col("sql_type"), dialect))
    cols = F.array_sort(F.collect_list(F.struct("pos", line.alias("line"), F.col("column_name").alias("name"))))
    tables = schema.groupBy("table_name").agg(cols.alias("cols"))
    body = F.concat(F.lit("CREATE TABLE "), F.col("table_name"), F.lit(" ("), F.array_join("cols.line", ", "), F.lit(")"))
    key = F.get(F.col("cols.name"), F.lit(0))
    tail = {
        "doris": F.concat(
            F.lit(" DUPLICATE KEY("), key, F.lit(") DISTRIBUTED BY HASH("), key,
            F.lit(f') BUCKETS {buckets} PROPERTIES ("replication_num" = "{replication}");')),
        "postgresql": F.lit(";"),
        "spark": F.lit(" USING parquet"),
    }[dialect]
    return tables.select("table_name", F.concat(body, tail).alias("ddl"))


_SPARK_TYPES = {
    "TINYINT": T.ByteType(), "SMALLINT": T.ShortType(), "INT": T.IntegerType(), "INTEGER": T.IntegerType(),
    "BIGINT": T.LongType(), "FLOAT": T.FloatType(), "REAL": T.FloatType(), "DOUBLE": T.DoubleType(),
    "DATE": T.DateType(), "DATETIME": T.TimestampNTZType(), "TIMESTAMP": T.TimestampNTZType(),
    "VARCHAR": T.StringType(), "VARCHAR2": T.StringType(), "CHAR": T.StringType(), "TEXT": T.StringType(),
    "STRING": T.StringType(), "CLOB": T.StringType(), "BLOB": T.BinaryType(), "BYTEA": T.BinaryType(),
}


def spark_type(sql_type: str) -> T.DataType:
    """Type name of a dump or target dialect -> Spark type; lengths are dropped, precision is kept."""
    base, _, args = sql_type.strip().upper().partition("(")
    base = base.strip()
    if base in ("DECIMAL", "NUMBER", "NUMERIC"):
        numbers = [int(a) for a in args.rstrip(") ").split(",") if a.strip()]
        precision, scale = (numbers + [0])[:2] if numbers else (38, 10)
        return T.DecimalType(precision, scale)
    return _SPARK_TYPES.get(base.split(" ")[0], T.StringType())


def struct_of(columns: list[tuple[str, str]]) -> T.StructType:
    """(name, type name) pairs -> StructType, the length of a VARCHAR kept as metadata."""
    fields = []
    for name, sql_type in columns:
        meta = {"sql_type": sql_type} if "(" in sql_type and spark_type(sql_type) == T.StringType() else {}
        fields.append(T.StructField(name, spark_type(sql_type), True, meta))
    return T.StructType(fields)
