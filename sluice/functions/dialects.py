"""How dumps of different databases write literals, and one standard form to bring them to.

A dialect selects token patterns: backslash escapes, quotes of the form q'[..]' with any delimiter, text in double quotes,
introducers, comments from ``#``. Statements are brought to the standard form first - text in single quotes, an inner
quote doubled, no escapes - so that everything behind needs one set of patterns. Only statements that hold a sign of their
dialect are rewritten; the test for it is a search for a fixed string.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sluice.functions.literals import DOUBLE_QUOTED, QUOTED, is_quoted, unquote

#: q'[..]' and the like: the four brackets end with their counterpart, any other character with itself (group ``mark``)
_Q_BODY = r"(?:\[(?s:.*?)\]'|\{(?s:.*?)\}'|\((?s:.*?)\)'|<(?s:.*?)>'|(?<mark>[^\[{(<\s])(?s:.*?)\k<mark>')"
_BRACKETS, _CLOSERS = "[{(<", "]})>"
#: text with backslash escapes
_ESCAPED = r"'[^'\\]*+(?:(?:''|\\(?s:.))[^'\\]*+)*+'"
_ESCAPED_DOUBLE = r'"[^"\\]*+(?:(?:""|\\(?s:.))[^"\\]*+)*+"'
_BACKTICKS = r"`[^`]*+`"
# What an escaped character stands for, where it is not itself.
ESCAPES = {"0": "\0", "b": "\b", "n": "\n", "r": "\r", "t": "\t", "Z": "\x1a", "%": "\\%", "_": "\\_"}


@dataclass(frozen=True)
class Dialect:
    """Token patterns of a dump. All are possessive or bounded by their closing mark."""

    name: str
    backslash: bool = False  # \' inside a literal, "text", _charset'text', # comments
    q_quotes: bool = False  # q'[text]'

    @property
    def quoted(self) -> str:
        return _ESCAPED if self.backslash else QUOTED

    @property
    def double_quoted(self) -> str:
        return _ESCAPED_DOUBLE if self.backslash else DOUBLE_QUOTED

    @property
    def line_comment(self) -> str:
        return r"(?:--|#)[^\n]*+" if self.backslash else r"--[^\n]*+"

    @property
    def q_quoted(self) -> str:
        return rf"(?<![\w$#])[nN]?[qQ]'{_Q_BODY}"

    @property
    def token(self) -> str:
        """One complete token outside literals: a literal, a name in quotes, a comment with its line end, or other text.

        What cannot be completed - an open literal or comment - matches nothing.
        """
        starts = "'\"/" + ("#`" if self.backslash else "") + r"\-"
        parts = [self.quoted, self.double_quoted, rf"{self.line_comment}\n", r"/\*(?s:.*?)\*/", r"-(?!-)", r"/(?!\*)"]
        if self.backslash:
            parts += [_BACKTICKS]
        if self.q_quotes:
            parts = [self.q_quoted, *parts, r"(?<=[\w$#])[nNqQ]", r"[qQ](?!')", r"[nN](?![qQ]')"]
            starts += "nNqQ"
        return "(?:" + "|".join([*parts, rf"[^;{starts}]++"]) + ")"

    def closing(self, state: str) -> str:
        """Pattern of the rest of a token that a text is entered in, see ``sources.lexer``."""
        if state == "'":
            inner = r"'[^'\\]*+(?:(?:''|\\(?s:.))[^'\\]*+)*+'" if self.backslash else QUOTED
            return inner[1:]
        if state == '"':
            return self.double_quoted[1:]
        if state == "*":
            return r"(?s:.*?)\*/"
        if state.startswith("q"):
            return rf"(?s:.*?)\Q{state[1:]}'\E"
        return ""

    def signs(self, text: Column) -> Column:
        """Whether a text may hold something that is not in the standard form."""
        if self.backslash:
            return F.contains(text, F.lit("\\")) | F.contains(text, F.lit('"')) | F.contains(text, F.lit("#")) | text.rlike(_INTRODUCER)
        if self.q_quotes:
            return F.contains(text, F.lit("q'")) | F.contains(text, F.lit("Q'"))
        return F.lit(False)


_INTRODUCER = r"(?<![\w$])_[A-Za-z]\w*+\s*+(?=')"

#: ANSI literals only
ANSI = Dialect("ansi")
#: exports of Oracle's tools, the usual input
ORACLE = Dialect("oracle", q_quotes=True)
#: dumps of MySQL and its relatives
MYSQL = Dialect("mysql", backslash=True)
DIALECTS = {d.name: d for d in (ANSI, ORACLE, MYSQL)}


def dialect_of(name: str | Dialect) -> Dialect:
    if isinstance(name, Dialect):
        return name
    if name not in DIALECTS:
        raise ValueError(f"no such dialect: {name}; known are {', '.join(DIALECTS)}")
    return DIALECTS[name]


def _standard(text: Column) -> Column:
    """Text -> literal in standard form."""
    return F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))


def _unescaped(text: Column) -> Column:
    """Text inside quotes with its backslash escapes resolved, each once and from the left."""
    marks = F.create_map(*[F.lit(x) for pair in ESCAPES.items() for x in pair])

    def piece(t: Column) -> Column:
        escaped = F.substring(t, 2, 1)
        return F.when(t.startswith("\\") & (F.length(t) == 2), F.coalesce(F.element_at(marks, escaped), escaped)).otherwise(t)

    pieces = F.regexp_extract_all(text, F.lit(r"[^\\]++|\\(?s:.)|\\"), F.lit(0))
    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(pieces, piece), "")).otherwise(text)


def _standard_token(dialect: Dialect, token: Column) -> Column:
    if dialect.q_quotes:
        inner = F.substring(F.regexp_replace(token, r"\A[nN]?[qQ]'", ""), F.lit(2), F.length(token))
        return F.when(token.rlike(r"\A[nN]?[qQ]'."), _standard(F.substring(inner, F.lit(1), F.length(inner) - 2))).otherwise(token)
    if dialect.backslash:
        bare = F.regexp_replace(token, r"\A_\w++\s*+", "")
        # a doubled quote is resolved with the quotes, before the escapes
        text = F.when(is_quoted(bare) & (F.length(bare) >= 2), _standard(_unescaped(unquote(bare))))
        comment = F.when(token.startswith("#"), F.concat(F.lit("--"), F.substring(token, F.lit(2), F.length(token))))
        return F.coalesce(text, comment, token)
    return token


def standard_literals(text: Column, dialect: str | Dialect) -> Column:
    """SQL of a dialect with all literals in standard form; comments are stepped over, open tokens stay as they are."""
    dialect = dialect_of(dialect)
    if not (dialect.q_quotes or dialect.backslash):
        return text
    last = rf"|{dialect.line_comment}\z|(?s:.)"  # what is not a whole token passes through
    one = (rf"{_INTRODUCER}{dialect.quoted}|" if dialect.backslash else "") + dialect.token + last
    if dialect.backslash:
        # other text stops where an introducer begins
        one = one.replace("|[^;", "|_|[^_;")
    tokens = F.regexp_extract_all(text, F.lit(one), F.lit(0))
    return F.when(dialect.signs(text), F.array_join(F.transform(tokens, lambda t: _standard_token(dialect, t)), "")).otherwise(text)
