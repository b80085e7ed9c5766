"""Column expressions over dump lines and statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.literals import BLANKS, DOUBLE_QUOTED, QUOTED

# Lines of the dump client that are no SQL, and comment openers (compared in upper case).
CLIENT_LINE_PREFIXES = [
    "--", "/*", "*/", "PROMPT", "SET ", "SPOOL", "WHENEVER", "EXECUTE", "COMMIT;", "REM ",
]
# Client commands dropped when a statement is cleaned.
CLIENT_COMMANDS = [
    "PROMPT ", "SET ", "SPOOL ", "WHENEVER ", "EXECUTE ", "REM ", "@", "DEFINE ", "UNDEFINE ",
    "COLUMN ", "TTITLE ", "BTITLE ", "BREAK ", "COMPUTE ",
]
# Typographic quotes and full-width punctuation and their ASCII forms, position by position.
WIDE_FORMS = "‘’“”「」『』，。：；（）"
ASCII_FORMS = "''" + '""""""' + ",.:;()"
#: schema owners removed from qualified names; a caller names those of its dumps
DEFAULT_OWNERS: tuple[str, ...] = ()
#: an identifier, bare or quoted
NAME = r"""(?:"[^"]++"|`[^`]++`|\[[^\]]++\]|(?U:[\w$#]++))"""

# Control characters that no line of a dump means.
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
CJK = r"[\x{4e00}-\x{9fff}]"


def _escape(token: str) -> str:
    return "".join("\\" + ch if ch in "*@/-;." else ch for ch in token)


def _starts_with_any(line: Column, prefixes: Sequence[str]) -> Column:
    return line.rlike("^(?:" + "|".join(_escape(p) for p in prefixes) + ")")


#: prefixes of lines that are noise to their end, whatever they hold
_WHOLE_LINES = ("--", "*/", "PROMPT", "REM ")
#: comment, directive and blank lines in front of a statement; a directive ends at its ``;``, free text at its line end
LEADING_NOISE = (
    r"(?i)\A(?:[ \t\r]*+(?:(?:" + "|".join(_escape(p) for p in _WHOLE_LINES) + r")[^\n]*+(?:\n|\z)|(?:"
    + "|".join(_escape(p) for p in CLIENT_LINE_PREFIXES if p not in (*_WHOLE_LINES, "COMMIT;", "/*"))
    + r"|COMMIT\b|@|DEFINE |UNDEFINE |COLUMN |TTITLE |BTITLE |BREAK |COMPUTE )[^\n;]*+(?:;|\n|\z)"
    + r"|/\*(?s:.*?)\*/(?:\n|\z)|(?:\n|\z)))++"
)


def strip_leading_noise(text: Column) -> Column:
    """Remove what stands between the previous ``;`` and the statement proper."""
    opens = F.upper(F.left(text, F.lit(6))) == "INSERT"
    blank_first = text.rlike(r"(?i)\A\s++INSERT\b")
    return F.when(opens, text).when(blank_first, F.ltrim(text, F.lit(BLANKS))).otherwise(
        F.regexp_replace(text, LEADING_NOISE, ""))


def is_sql_line(line: Column) -> Column:
    """False for blank lines, comments and client directives."""
    up = F.upper(F.btrim(line, F.lit(BLANKS)))
    return (up != "") & ~_starts_with_any(up, CLIENT_LINE_PREFIXES)


def is_insert(text: Column) -> Column:
    return text.rlike(r"(?i)^\s*INSERT")


def collapse_blanks(text: Column) -> Column:
    """Runs of blanks outside literals become one space; literals keep every character."""
    plain = F.regexp_replace(text, r"\s+", " ")
    # \G steps over literals and single spaces, so only the blank runs between tokens are replaced
    careful = F.regexp_replace(text, rf"\G((?:{QUOTED}|[^'\s]++| (?!\s))*+)\s++", "$1 ")
    return F.btrim(F.when(F.contains(text, F.lit("'")), careful).otherwise(plain), F.lit(BLANKS))


def strip_comments(text: Column) -> Column:
    """Comments inside a statement become one space; comment signs inside literals stay."""
    has_sign = F.contains(text, F.lit("--")) | F.contains(text, F.lit("/*"))
    bare = F.regexp_replace(
        text, rf"""(?s)\G((?:{QUOTED}|{DOUBLE_QUOTED}|[^'"/-]++|-(?!-)|/(?!\*))*+)(?:--[^\n]*+|/\*.*?\*/)""", "$1 "
    )
    return F.when(has_sign, bare).otherwise(text)


def _insert_head(owners: Sequence[str]) -> str:
    """Pattern of ``INSERT INTO`` and every qualifier in front of the table name."""
    named = "|".join(rf"\[{o}\]\s*+\.?+\s*+|{o}\s*+\.\s*+" for o in owners)
    qualifier = rf"{NAME}\s*+\.\s*+"
    return rf"(?i)\A\s*+INSERT\s++INTO\s++(?:{named + '|' if owners else ''}{qualifier})*+"


def strip_insert_qualifier(stmt: Column, owners: Sequence[str] = DEFAULT_OWNERS) -> Column:
    """``INSERT INTO db.t`` -> ``INSERT INTO t``; only the head of the statement is touched."""
    return F.regexp_replace(stmt, _insert_head(owners), "INSERT INTO ")


def clean_statement(stmt: Column, owners: Sequence[str] = DEFAULT_OWNERS) -> Column:
    """INSERT with its qualifier gone, or NULL when the statement is none or is a client command."""
    body = F.btrim(stmt, F.lit(BLANKS))
    return F.when(
        is_insert(body) & ~_starts_with_any(F.upper(body), CLIENT_COMMANDS),
        collapse_blanks(strip_insert_qualifier(body, owners)),
    )


def has_insert_format(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)INSERT\s+INTO") & text.rlike(r"(?i)VALUES\s*\("), F.lit(False))


def insert_table_name(stmt: Column, owners: Sequence[str] = DEFAULT_OWNERS) -> Column:
    """Target table of an INSERT, bare or quoted, without qualifier; NULL when there is none."""
    pattern = _insert_head(owners) + rf"({NAME})\s*+(?:\(|(?:VALUES|SELECT|WITH)\b)"
    return F.nullif(F.btrim(F.regexp_extract(stmt, pattern, 1), F.lit('"`[]')), F.lit(""))


def file_table_name(path: Column) -> Column:
    """Table name a file name suggests: extension off, other than word characters -> ``_``."""
    base = F.substring_index(path, "/", -1)
    stem = F.regexp_replace(base, r"(?<=[^.])\.[^.]*$", "")
    return F.regexp_replace(stem, r"(?U)[^\w]", "_")


def insert_columns(stmt: Column) -> Column:
    """Column list of the INSERT as an array, empty when the statement names none."""
    listed = F.regexp_extract(stmt, r"""(?i)\A\s*+INSERT\s++INTO\s++(?:"[^"]*+"|`[^`]*+`|[^\s("`]++)++\s*+\(([^)]*+)\)\s*+VALUES\b""", 1)
    names = F.transform(F.split(listed, ","), lambda x: F.btrim(x, F.lit(BLANKS + '"`')))
    return F.when(listed == "", F.array().cast("array<string>")).otherwise(names)


def normalise_line(line: Column) -> Column:
    """BOM off, wide punctuation to ASCII, control characters out, blanks collapsed, trimmed."""
    no_bom = F.regexp_replace(line, r"^\x{feff}", "")
    ascii_marks = F.translate(no_bom, WIDE_FORMS, ASCII_FORMS)
    return F.btrim(F.regexp_replace(F.regexp_replace(ascii_marks, CONTROL_CHARS, ""), r"(?U)\s+", " "))


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def type_date_literals(stmt: Column) -> Column:
    """Mark whole date literals with their type and write NULL in upper case, outside other literals."""
    stamped = F.regexp_replace(stmt, r"(?<!')'(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})'(?!')", "'$1'::timestamp")
    dated = F.regexp_replace(stamped, r"(?<!')'(\d{4}-\d{2}-\d{2})'(?!')", "'$1'::date")
    upper_null = F.regexp_replace(dated, rf"(?i)\G((?:{QUOTED}|(?!\bNULL\b)[^'])*+)\bNULL\b", "$1NULL")
    return F.when(dated.rlike(r"(?i)\bnull\b"), upper_null).otherwise(dated)
