"""SQL text over a store's tables or over given DataFrames: refusals by name, and functions with the dialect's meaning.

The text is read as tokens, so nothing inside literals, quoted names and comments counts.  What the dialect does not have is
refused with its name, although Spark would run it.  Functions whose meaning parts from Spark's become SQL functions that
Catalyst inlines.  Operators are Spark's: `/` divides as reals, `%` needs numbers, and LIKE here ignores case as ILIKE does,
also beyond ASCII; the exact forms are in functions/scalar.py.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from .errors import BindError, ParseError, Unsupported
from .sources.store import Store

_TOKEN = re.compile(r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`|--[^\n]*|/\*.*?\*/|[A-Za-z_][A-Za-z0-9_]*|\d+(?:\.\d*)?|\?\d*|[:@$][A-Za-z_]\w*|\s+|.""", re.S)
#: Sequences of words that the dialect refuses, and what the refusal says.
REFUSED = (
    ("RIGHT JOIN", "RIGHT JOIN"), ("RIGHT OUTER", "RIGHT JOIN"), ("FULL JOIN", "FULL JOIN"), ("FULL OUTER", "FULL JOIN"), ("NATURAL", "NATURAL JOIN"), ("USING (", "JOIN ... USING"),
    ("LATERAL", "LATERAL"), ("ROLLUP", "ROLLUP"), ("CUBE", "CUBE"), ("GROUPING SETS", "GROUPING SETS"), ("GROUP BY ALL", "GROUP BY ALL"), ("QUALIFY", "QUALIFY"), ("ILIKE", "ILIKE"), ("RLIKE", "RLIKE"),
    ("REGEXP", "REGEXP"), ("GLOB", "GLOB"), ("PIVOT", "PIVOT"), ("UNPIVOT", "UNPIVOT"), ("TABLESAMPLE", "TABLESAMPLE"), ("WITH RECURSIVE", "WITH RECURSIVE"), ("INTERSECT ALL", "INTERSECT ALL"),
    ("EXCEPT ALL", "EXCEPT ALL"), ("MINUS", "MINUS"), ("DISTINCT ON", "DISTINCT ON"), ("SAVEPOINT", "SAVEPOINT"), ("RELEASE SAVEPOINT", "SAVEPOINT"), ("UNION (", "a parenthesised arm"),
    ("UNION ALL (", "a parenthesised arm"), ("UNION VALUES", "VALUES as an arm"), ("LEFT SEMI", "SEMI JOIN"), ("LEFT ANTI", "ANTI JOIN"), ("CLUSTER BY", "CLUSTER BY"), ("DISTRIBUTE BY", "DISTRIBUTE BY"), ("SORT BY", "SORT BY"),
)
#: Functions of the other dialect that it does not take either.
REFUSED_MYSQL = frozenset(
    "CONCAT_WS GREATEST LEAST MOD SYSDATE FROM_UNIXTIME DATE_FORMAT STR_TO_DATE TIME_FORMAT DATEDIFF TIMEDIFF TIMESTAMPDIFF DATE_ADD DATE_SUB ADDDATE SUBDATE MONTHNAME DAYNAME WEEK WEEKOFYEAR YEARWEEK "
    "JSON_QUOTE JSON_TYPE JSON_CONTAINS JSON_OVERLAPS".split()
)
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLACE = "CASE WHEN p < 0 THEN char_length(s) + p + 1 ELSE p END"
_CUT = "CASE WHEN least({b}, char_length(s) + 1) > greatest({a}, 1) THEN substring(s, CAST(greatest({a}, 1) AS INT), CAST(least({b}, char_length(s) + 1) - greatest({a}, 1) AS INT)) ELSE '' END"
_FROM, _TO = f"(CASE WHEN n < 0 THEN {_PLACE} + n ELSE {_PLACE} END)", f"(CASE WHEN n < 0 THEN {_PLACE} ELSE {_PLACE} + n END)"
#: (name, number of arguments) -> name, parameters, body.
FUNCTIONS = {
    ("UPPER", 1): ("tm_upper", "s STRING", f"translate(s, '{_LOW}', '{_UP}')"),
    ("LOWER", 1): ("tm_lower", "s STRING", f"translate(s, '{_UP}', '{_LOW}')"),
    ("HEX", 1): ("tm_hex", "s STRING", "coalesce(hex(CAST(s AS BINARY)), '')"),
    ("ROUND", 1): ("tm_round", "x DOUBLE", "round(x, 0)"),
    ("SUBSTR", 2): ("tm_substr_from", "s STRING, p BIGINT", f"CASE WHEN s IS NOT NULL AND p IS NOT NULL THEN {_CUT.format(a=f'({_PLACE})', b='(char_length(s) + 1)')} END"),
    ("SUBSTR", 3): ("tm_substr", "s STRING, p BIGINT, n BIGINT", f"CASE WHEN s IS NOT NULL AND p IS NOT NULL AND n IS NOT NULL THEN {_CUT.format(a=_FROM, b=_TO)} END"),
    ("MIN", 2): ("tm_min", "a DOUBLE, b DOUBLE", "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN least(a, b) END"),
    ("MAX", 2): ("tm_max", "a DOUBLE, b DOUBLE", "CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END"),
}
_SAME = {"SUBSTRING": "SUBSTR"}
_TYPES = {"tm_round": "DOUBLE", "tm_min": "DOUBLE", "tm_max": "DOUBLE"}


def scan(text: str) -> list[str]:
    """The text's tokens, without comments; white space is one blank."""
    out = []
    for m in _TOKEN.finditer(text):
        t = m.group()
        if t in ("'", '"', "`"):
            raise ParseError("a quotation has no end")
        if t.startswith(("--", "/*")) or t.isspace():
            if out and out[-1] != " ":
                out.append(" ")
        else:
            out.append(t)
    return out


def refuse(tokens: Sequence[str], mysql: bool = False) -> None:
    """Raise Unsupported, with its name, for the first thing that the dialect does not have."""
    words = [t.upper() for t in tokens if t != " "]
    for k, w in enumerate(words):
        for pattern, name in REFUSED:
            parts = pattern.split()
            if words[k : k + len(parts)] == parts:
                raise Unsupported(f"{name} is not supported")
        if w == "VALUES" and k == 0:
            raise Unsupported("VALUES as a query is not supported")
        if mysql and w in REFUSED_MYSQL and words[k + 1 : k + 2] == ["("]:
            raise Unsupported(f"function {w} is not supported")


def _arguments(tokens: Sequence[str], at: int) -> int:
    """Number of arguments in the parentheses that open at a token."""
    depth, commas, some = 0, 0, False
    for t in tokens[at:]:
        depth += (t == "(") - (t == ")")
        if depth == 0:
            return commas + some
        commas += depth == 1 and t == ","
        some |= t not in ("(", " ")
    raise ParseError("a parenthesis has no end")


class Engine:
    """Queries over a store's tables, or over DataFrames by name."""

    def __init__(self, spark: SparkSession, tables: Store | Mapping[str, DataFrame], mysql: bool = False):
        self.spark, self.tables, self.mysql = spark, tables, mysql

    def _names(self) -> dict[str, str]:
        return {n.lower(): n for n in (self.tables.names() if isinstance(self.tables, Store) else self.tables)}

    def sql(self, text: str, params: Sequence | Mapping = ()) -> DataFrame:
        """One query.  Parameters stand at ? in their order, or at :name."""
        tokens = scan(text.strip().rstrip(";"))
        if ";" in tokens:
            raise ParseError("one statement at a time")
        refuse(tokens, self.mysql)
        words = [t.upper() for t in tokens if t != " "]
        if not words or words[0] not in ("SELECT", "WITH"):
            raise Unsupported("the engine's sql() takes queries; writes are methods of Store")
        marks = sum(t.startswith("?") for t in tokens)
        if not isinstance(params, Mapping) and marks != len(params):
            raise BindError(f"{marks} parameters are asked for and {len(params)} given")
        tables, out, views = self._names(), list(tokens), {}
        solid = [k for k, t in enumerate(tokens) if t != " "]
        for n, k in enumerate(solid):
            word = tokens[k].upper()
            follows = tokens[solid[n + 1]] if n + 1 < len(solid) else ""
            before = tokens[solid[n - 1]].upper() if n else ""
            if follows == "(" and before != ".":
                found = FUNCTIONS.get((_SAME.get(word, word), _arguments(tokens, solid[n + 1])))
                if found and not (self.mysql and word in ("HEX", "ROUND", "SUBSTR", "SUBSTRING")):
                    name, arguments, body = found
                    self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {_TYPES.get(name, 'STRING')} RETURN {body}")
                    out[k] = name
            elif word == "LIKE":
                rest = [tokens[j].upper() for j in solid[n + 1 : n + 3]]
                out[k] = "ILIKE"
                if "ESCAPE" not in rest and n + 1 < len(solid):
                    out[solid[n + 1]] += " ESCAPE '\u0001'"
            elif word.lower() in tables and before in ("FROM", "JOIN", ","):
                views[word.lower()] = f"tm_{id(self)}_{word.lower()}"
                alias = follows.upper() == "AS" or re.fullmatch(r"[A-Za-z_]\w*", follows) and follows.upper() not in _AFTER_TABLE
                out[k] = views[word.lower()] + ("" if alias else f" AS {tokens[k]}")
        for name, view in views.items():
            df = self.tables.frame(tables[name]) if isinstance(self.tables, Store) else self.tables[tables[name]]
            df.createOrReplaceTempView(view)
        return self.spark.sql("".join(out), args=dict(params) if isinstance(params, Mapping) else list(params))


_AFTER_TABLE = frozenset("WHERE JOIN INNER LEFT CROSS ON GROUP ORDER LIMIT OFFSET UNION INTERSECT EXCEPT HAVING WINDOW".split())
