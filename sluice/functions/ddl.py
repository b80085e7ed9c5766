"""Column expressions over DDL scripts, and the type map between dialects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.literals import BLANKS, DOUBLE_QUOTED, QUOTED, TUPLE
from sluice.functions.text import DEFAULT_OWNERS, collapse_blanks

# Source type pattern -> target type, applied to the type of each column.
TYPE_MAP = [
    (r"\bTINYINT\b", "SMALLINT"),
    (r"\bBIGINT\b", "BIGINT"),
    (r"\bINT\b", "INTEGER"),
    (r"\bDOUBLE\b(?!\s+PRECISION)", "DOUBLE PRECISION"),
    (r"\bFLOAT\b", "REAL"),
    (r"\bDATETIME\b", "TIMESTAMP"),
    (r"\b(?:LONG|MEDIUM|TINY)?TEXT\b", "TEXT"),
    (r"\bNUMBER\s*\(\s*(\d+)\s*,\s*(\d+)\s*\)", "NUMERIC($1,$2)"),
    (r"\bNUMBER\s*\(\s*(\d+)\s*\)", "NUMERIC($1)"),
    (r"\bNUMBER\b", "NUMERIC"),
    (r"\bVARCHAR2\s*\(\s*(\d+)(?:\s+(?:CHAR|BYTE))?\s*\)", "VARCHAR($1)"),
    (r"\bCLOB\b", "TEXT"),
    (r"\bBLOB\b", "BYTEA"),
]
# Table options with no counterpart in the target dialect.
DROPPED_OPTIONS = [
    r"\bENGINE\s*=\s*\w+", r"\bDEFAULT\s+CHARSET\s*=\s*\w+", r"\bCHARSET\s*=\s*\w+", r"\bCOLLATE\s*=\s*\w+",
    r"\bAUTO_INCREMENT\b(?:\s*=\s*\d+)?",
]

_NAME = r"""["`]?(\w+)["`]?"""
_CREATE = r"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?"


def _tidy(ddl: Column) -> Column:
    return F.trim(F.regexp_replace(ddl, r"\s+", " "))


def clean_ddl(ddl: Column, owners: Sequence[str] = DEFAULT_OWNERS) -> Column:
    """USE statements, database qualifiers and owners out of a DDL script, blanks collapsed."""
    out = F.regexp_replace(ddl, r"(?i)(^|;)\s*USE\s+\w+\s*(?:;|$)", "$1")
    out = F.regexp_replace(out, rf"(?i)({_CREATE})(?:\[?\w+\]?\s*\.\s*)+", "$1")
    for owner in owners:
        out = F.regexp_replace(out, rf"(?i)\[{owner}\]\s*\.?\s*|\b{owner}\s*\.\s*", "")
    return _tidy(out)


#: one item of a column list: everything up to a comma outside quotes and parentheses
_ITEM = rf"""(?:{QUOTED}|{DOUBLE_QUOTED}|`[^`]*+`|{TUPLE}|[^,'"`()])++"""
#: a CREATE TABLE: what stands before its column list, the list, and what follows
_SCRIPT = rf"""(?is)\A(.*?{_CREATE}(?:[\w$#.]|"[^"]*+"|`[^`]*+`|\[[^\]]*+\])++\s*+)({TUPLE})(.*+)\z"""
#: a column: its name with the blanks around it, its type with arguments, the rest
_COLUMN = r"""(?is)\A(\s*+(?:"[^"]*+"|`[^`]*+`|\[[^\]]*+\]|[\w$#]++)\s++)(\w++(?:\s*+\([^()]*+\))?+)(.*+)\z"""
# First words of items that are no columns.
_NO_COLUMN = r"(?i)\A\s*+(?:PRIMARY|UNIQUE|KEY|INDEX|CONSTRAINT|FOREIGN|CHECK|FULLTEXT|SPATIAL|EXCLUDE|LIKE)\b"


def _without_options(text: Column) -> Column:
    """Table options out of a text; what stands in quotes, such as a comment, is left as it is."""

    def bare(t: Column) -> Column:
        out = t
        for pattern in DROPPED_OPTIONS:
            out = F.regexp_replace(out, "(?i)" + pattern, "")
        return F.when(t.startswith("'") | t.startswith('"') | t.startswith("`"), t).otherwise(out)

    tokens = F.regexp_extract_all(text, F.lit(rf"""{QUOTED}|{DOUBLE_QUOTED}|`[^`]*+`|[^'"`]++|."""), F.lit(0))
    return F.array_join(F.transform(tokens, bare), "")


def _converted_type(sql_type: Column) -> Column:
    out = sql_type
    for pattern, target in TYPE_MAP:
        out = F.regexp_replace(out, rf"(?i)\A{pattern}", target)
    return out


def _converted_item(item: Column) -> Column:
    """One item of a column list with its type mapped; constraints keep their words."""
    kind, rest = F.regexp_extract(item, _COLUMN, 2), F.regexp_extract(item, _COLUMN, 3)
    # DOUBLE PRECISION is the other dialect's name already
    mapped = F.when(rest.rlike(r"(?i)\A\s*+PRECISION\b"), kind).otherwise(_converted_type(kind))
    column = F.concat(F.regexp_extract(item, _COLUMN, 1), mapped, _without_options(rest))
    return F.when(item.rlike(_NO_COLUMN) | (kind == ""), item).otherwise(column)


def convert_ddl(ddl: Column) -> Column:
    """Types and table options of a CREATE TABLE mapped to the other dialect.

    The column list is split at its own commas, and only the type of a column is mapped: names, defaults and comments keep
    their words whatever they are. A text without a column list loses its options only.
    """
    listed = F.regexp_extract(ddl, _SCRIPT, 2)
    inner = F.substring(listed, F.lit(2), F.length(listed) - 2)
    items = F.filter(F.regexp_extract_all(inner, F.lit(_ITEM), F.lit(0)), lambda i: F.btrim(i, F.lit(BLANKS)) != "")
    body = F.array_join(F.transform(items, _converted_item), ",")
    tail = _without_options(F.regexp_extract(ddl, _SCRIPT, 3))
    whole = F.concat(F.regexp_extract(ddl, _SCRIPT, 1), F.lit("("), body, F.lit(")"), tail)
    return collapse_blanks(F.when(listed != "", whole).otherwise(_without_options(ddl)))


def ddl_table_name(ddl: Column) -> Column:
    """Name a DDL script creates; empty when it creates none."""
    return F.regexp_extract(ddl, rf"(?i){_CREATE}{_NAME}", 1)


def is_valid_ddl(ddl: Column) -> Column:
    return F.coalesce(
        F.upper(ddl).startswith("CREATE TABLE")
        & (ddl_table_name(ddl) != "")
        & F.contains(ddl, F.lit("("))
        & F.contains(ddl, F.lit(")")),
        F.lit(False),
    )


#: a CREATE TABLE up to its ``;``, which is none inside quotes or parentheses
_STATEMENT = rf"""(?is)CREATE\s+TABLE\b(?:{QUOTED}|{DOUBLE_QUOTED}|`[^`]*+`|{TUPLE}|[^;'"`(])*+;"""


def extract_ddl(text: Column) -> Column:
    """The DDL inside free text, empty if there is none.

    The text is cut at its code fences and each piece is classified: a fence tagged as SQL counts whole, any other piece
    by the first whole CREATE TABLE statement in it, fenced pieces before others. A text in which no piece has one is
    taken from the line that opens a CREATE TABLE, or whole if it names one somewhere.
    """
    pieces = F.split(text, "```", -1)

    def candidate(piece: Column, i: Column) -> Column:
        fenced = (i % 2 == 1) & (i < F.size(pieces) - 1)
        tagged = F.btrim(F.regexp_extract(piece, r"(?is)\Asql\b(.*+)\z", 1), F.lit(BLANKS))
        found = F.nullif(F.regexp_extract(piece, _STATEMENT, 0), F.lit(""))
        rank = F.when(fenced & (tagged != ""), 0).when(fenced & found.isNotNull(), 1).when(found.isNotNull(), 2)
        return F.struct(rank.alias("rank"), i.alias("i"), F.when(rank == 0, tagged).otherwise(found).alias("ddl"))

    best = F.array_min(F.filter(F.transform(pieces, candidate), lambda c: c["rank"].isNotNull()))["ddl"]
    opened = F.nullif(F.regexp_extract(text, r"(?im)^[ \t]*+(CREATE TABLE(?s:.*+))", 1), F.lit(""))
    lines = F.transform(F.split(F.btrim(opened, F.lit(BLANKS)), "\n"), lambda x: F.btrim(x, F.lit(" \t\r")))
    named = F.when(F.contains(F.upper(text), F.lit("CREATE TABLE")), F.btrim(text, F.lit(BLANKS)))
    return F.coalesce(best, F.array_join(lines, "\n"), named, F.lit(""))


# Inferred type -> type name per target dialect; precision and length are kept as inferred.
DIALECT_TYPES = {
    "doris": {"TIMESTAMP": "DATETIME", "TEXT": "TEXT"},
    "postgresql": {"INT": "INTEGER", "DOUBLE": "DOUBLE PRECISION"},
    "spark": {"VARCHAR": "STRING", "TEXT": "STRING", "TIMESTAMP": "TIMESTAMP_NTZ"},
}


def dialect_type(sql_type: Column, dialect: str) -> Column:
    """Inferred type such as ``DECIMAL(8,2)`` in the words of a dialect."""
    base = F.regexp_extract(sql_type, r"^\w+", 0)
    out = sql_type
    for source, target in DIALECT_TYPES[dialect].items():
        keep_args = dialect != "spark" and source != "VARCHAR"
        args = F.regexp_extract(sql_type, r"\(.*\)", 0) if keep_args else F.lit("")
        out = F.when(base == source, F.concat(F.lit(target), args)).otherwise(out)
    return out
