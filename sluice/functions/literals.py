"""Literals of an INSERT statement: token patterns, and raw literal -> typed column.

All patterns are possessive, so they run in linear time and constant stack on literals of any length. Runs of one class
of characters are greedy where what follows begins with another character: nothing can be given back there, and the
regular expressions of Java walk such a run several times faster.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTED = r"'[^']*(?:''[^']*)*+'"
DOUBLE_QUOTED = r'"[^"]*"'
_ATOM = rf"{QUOTED}|{DOUBLE_QUOTED}"
_PARENS_1 = rf"""\((?:{_ATOM}|[^'"()]+)*+\)"""
_PARENS_2 = rf"""\((?:{_ATOM}|[^'"()]+|{_PARENS_1})*+\)"""
#: one value of a tuple; calls may nest two deep, anything deeper is quarantined
VALUE = rf"""(?:{_ATOM}|[^'"(),]+|{_PARENS_2})++"""
#: the same with the blanks around it left out, as group 1
TRIMMED_VALUE = rf"""\s*+((?:[^'"(),\s]+|{_ATOM}|\s++(?![,\s]|\z)|{_PARENS_2})++)\s*+(?:,|\z)"""
#: two commas with nothing between (or at the end), perhaps inside a literal; a pattern that opens with a plain sign is
#: looked for much faster than one that opens with a choice, so the same at the start is a pattern of its own
EMPTY_VALUE = r",\s*+(?:,|\z)"
EMPTY_FIRST = r"\A\s*+(?:,|\z)"
#: one parenthesised tuple of a VALUES list
TUPLE = rf"""\((?:{_ATOM}|[^'"()]+|{_PARENS_2})*+\)"""

#: one operand of a text expression: a literal, N'..', q'[..]', CHR(n), TO_CLOB('..'), EMPTY_CLOB()
TEXT_TERM = rf"""(?is)(?:N?+{QUOTED}|Q'\[[^'\]]*+\]'|N?CHR\s*+\(\s*+\d++\s*+\)|TO_N?CLOB\s*+\(\s*+{QUOTED}\s*+\)|EMPTY_[BC]LOB\s*+\(\s*+\))"""
#: operands joined by ``||``
TEXT_EXPRESSION = rf"""(?is)\A\s*+{TEXT_TERM[5:]}(?:\s*+\|\|\s*+{TEXT_TERM[5:]})*+\s*+\z"""
#: what starts like an expression and must be looked at
_MAYBE_EXPRESSION = r"(?i)\A(?:N'|Q'|N?CHR\s*+\(|TO_N?CLOB\s*+\(|EMPTY_[BC]LOB)"
#: a number as it may stand for a text
_NUMBER = r"\A[+-]?+(?:\d++\.?+\d*+|\.\d++)(?:[eE][+-]?+\d++)?+[fFdD]?+\z"
_WHOLE_QUOTED = rf"(?s)\A(?:{QUOTED}|{DOUBLE_QUOTED})\z"

BLANKS = " \t\r\n"

# Date mask elements of the dump dialect and the datetime pattern letters they stand for, in the
# order they are replaced (after Y, R, D and S have become lower case, R meaning the same as Y).
DATE_MASKS = [
    ("HH24", "\u0001"),
    ("HH12", "hh"),
    ("HH", "hh"),
    ("\u0001", "HH"),
    ("MONTH", "MMMM"),
    ("MON", "MMM"),
    ("MI", "mm"),
    ("FF", "SSSSSS"),
    ("AM", "a"),
    ("PM", "a"),
]
# Masks whose text is already ISO and is cast directly.
ISO_MASKS = ["YYYY-MM-DD", "YYYY-MM-DD HH24:MI:SS", "YYYY-MM-DD HH24:MI:SS.FF6", "YYYY-MM-DD HH24:MI:SS.FF"]

#: quoted date text (1) and mask (2) of TO_DATE(..), TO_TIMESTAMP(..), DATE '..', TIMESTAMP '..' or a bare literal
_DATE = (
    r"(?is)\A(?:TO_DATE\s*+\(\s*+|TO_TIMESTAMP\s*+\(\s*+|DATE\s*+|TIMESTAMP\s*+)?+'([^']*+)'"
    r"(?:\s*+,\s*+'([^']*+)'\s*+)?+\s*+\)?+\z"
)
_ANY_DATE = r"(?is)^(?:TO_DATE\s*+\(|TO_TIMESTAMP\s*+\(|DATE|TIMESTAMP)\s*+'([^']*+)'.*+$"


def trim_end(c: Column, chars: str = ";" + BLANKS) -> Column:
    """Right trim of a set of characters. Trimming by a set walks the whole string, so the end is tested first."""
    ends = F.lit(False)
    for ch in chars:
        ends = ends | F.endswith(c, F.lit(ch))
    return F.when(ends, F.rtrim(c, F.lit(chars))).otherwise(c)


def is_quoted(c: Column) -> Column:
    return c.startswith("'") | c.startswith('"')


def unquote(c: Column) -> Column:
    """``'it''s'`` -> ``it's``; either quote character, doubled inside. ``c`` must be quoted."""
    mark = F.left(c, F.lit(1))
    return F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.repeat(mark, F.lit(2)), mark)


def is_text_expression(c: Column) -> Column:
    """Literals joined by ``||``, N'..', CHR(n) and the like; a plain literal may pass too."""
    return (F.contains(c, F.lit("||")) | c.rlike(_MAYBE_EXPRESSION)) & c.rlike(TEXT_EXPRESSION)


def text_of_expression(c: Column) -> Column:
    """The text that an expression of ``is_text_expression`` stands for."""

    def term(t: Column) -> Column:
        inner = F.regexp_extract(t, rf"(?s)({QUOTED})", 1)
        return (
            F.when(t.rlike(r"(?i)\AN?CHR"), F.decode(F.unhex(F.lpad(F.hex(F.regexp_extract(t, r"(\d+)", 1).cast("int")), 8, "0")), "UTF-32"))
            .when(t.rlike(r"(?i)\AQ'"), F.substring(t, F.lit(4), F.length(t) - 5))
            .when(inner == "", F.lit(""))
            .otherwise(unquote(inner))
        )

    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(TEXT_TERM), F.lit(0)), term), "")


def is_null_literal(c: Column) -> Column:
    """Bare NULL in any case; ``'NULL'`` is a string and stays one."""
    return (F.length(c) == 4) & (F.upper(c) == "NULL")


def is_date_call(c: Column) -> Column:
    return c.rlike(r"(?i)^(?:TO_DATE|TO_TIMESTAMP)\s*\(|^(?:DATE|TIMESTAMP)\s*'")


def java_mask(mask: Column) -> Column:
    """Date mask of the dump, in upper case -> datetime pattern."""
    out = F.regexp_replace(F.translate(mask, "YRDS", "yyds"), "FF[1-9]", "FF")
    for token, letters in DATE_MASKS:
        out = F.replace(out, F.lit(token), F.lit(letters))
    return out


def date_text(c: Column) -> Column:
    """The date text inside a date call or a quoted literal; empty for anything else."""
    return F.regexp_extract(c, _DATE, 1)


def date_mask(c: Column) -> Column:
    """The mask of a date call in upper case, empty when it has none."""
    return F.upper(F.regexp_extract(c, _DATE, 2))


def to_timestamp_value(text: Column, mask: Column) -> Column:
    """Date text and mask -> timestamp without zone; NULL where it is no date.

    ISO masks are cast; other masks go through the parser (formatters are cached per mask).
    """
    other = F.try_to_timestamp(text, java_mask(mask)).try_cast(T.TimestampNTZType())
    return F.when((mask == "") | mask.isin(ISO_MASKS), text.try_cast(T.TimestampNTZType())).otherwise(other)


def to_text_value(c: Column) -> Column:
    """Raw literal -> string. Date calls give their date text, numbers their digits.

    NULL for the NULL literal, and for everything that is no literal: calls of other functions, pseudo-columns such as
    SYSDATE, names, arithmetic. A quoted literal without a quote inside, the usual case, is told without a pattern.
    """
    inner = F.substring(c, F.lit(2), F.length(c) - 2)
    plain = c.startswith("'") & c.endswith("'") & (F.octet_length(c) >= 2) & ~F.contains(inner, F.lit("'"))
    return (
        F.when(plain, inner)
        .when(is_null_literal(c), F.lit(None).cast("string"))
        .when(is_text_expression(c), text_of_expression(c))
        .when(is_quoted(c), F.when(c.rlike(_WHOLE_QUOTED), unquote(c)))
        .when(c.rlike(_NUMBER) | F.upper(c).isin("TRUE", "FALSE"), c)
        .when(is_date_call(c), F.nullif(F.regexp_replace(c, _ANY_DATE, "$1"), c))
    )


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType))


def to_typed_value(c: Column, dtype: T.DataType) -> Column:
    """Raw literal -> ``dtype``; NULL for the NULL literal and for text that does not fit. Dates take
    ``to_timestamp_value``, whose inputs are worth a column of their own."""
    if isinstance(dtype, T.StringType):
        return to_text_value(c)
    if isinstance(dtype, T.BinaryType):
        hexed = F.try_to_binary(F.regexp_extract(c, r"'([0-9A-Fa-f]*)'", 1), F.lit("hex"))
        return F.when(c.rlike("(?i)^HEXTORAW"), hexed).otherwise(to_text_value(c).cast("binary"))
    # NULL is no number, so the cast covers the NULL literal too; quotes around a number are allowed
    return F.when(is_quoted(c), F.btrim(c, F.lit("'\""))).otherwise(c).try_cast(dtype)


def render_literal(c: Column, dtype: T.DataType) -> Column:
    """Typed column -> literal text, NULL included."""
    if isinstance(dtype, T.StringType):
        text = F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'"))
    elif isinstance(dtype, (T.TimestampNTZType, T.TimestampType, T.DateType)):
        stamp = c.cast("timestamp_ntz").cast("string")
        text = F.when(
            F.contains(stamp, F.lit(".")),
            F.concat(F.lit("TO_TIMESTAMP('"), stamp, F.lit("', 'YYYY-MM-DD HH24:MI:SS.FF6')")),
        ).otherwise(F.concat(F.lit("TO_DATE('"), stamp, F.lit("', 'YYYY-MM-DD HH24:MI:SS')")))
    elif isinstance(dtype, T.BooleanType):
        text = F.when(c, F.lit("1")).otherwise(F.lit("0"))
    elif isinstance(dtype, T.BinaryType):
        text = F.concat(F.lit("HEXTORAW('"), F.hex(c), F.lit("')"))
    else:
        text = c.cast("string")
    return F.coalesce(text, F.lit("NULL")) if not isinstance(dtype, T.BooleanType) else F.when(
        c.isNull(), F.lit("NULL")).otherwise(text)
