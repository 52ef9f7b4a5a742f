"""Scalar functions with the dialect's semantics, as Column expressions.

Case mapping, LIKE and NOCASE fold ASCII letters alone; division by zero is NULL; casts take the numeric prefix of a text and
never fail; scalar min and max are NULL where an argument is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NUMBER = r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"
_WHOLE = r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lower(c) -> Column:
    return F.translate(col(c), UPPER, LOWER)


def upper(c) -> Column:
    return F.translate(col(c), LOWER, UPPER)


def fold(c, collation: str) -> Column:
    """The key that stands for a text under a collation."""
    kinds = {"BINARY": lambda x: x, "NOCASE": lower, "RTRIM": lambda x: F.regexp_replace(x, " +$", "")}
    if collation.upper() not in kinds:
        raise ValueError(f"no such collation: {collation}")
    return kinds[collation.upper()](col(c))


def like(c, pattern: str, escape: str | None = None) -> Column:
    """ASCII-case-insensitive LIKE; without an escape no character is one."""
    out, k = ["^"], 0
    while k < len(pattern):
        ch = pattern[k]
        if escape and ch == escape and k + 1 < len(pattern):
            k += 1
            out.append(_quoted(pattern[k]))
        else:
            out.append({"%": ".*", "_": "."}.get(ch) or _quoted(ch))
        k += 1
    return lower(c).rlike("(?s)" + "".join(out) + "$(?!\\n)")


def _quoted(ch: str) -> str:
    ch = ch.lower() if ch in UPPER else ch
    return "\\" + ch if not ch.isalnum() and ord(ch) < 128 else ch


def number(c, kind: str = "string") -> Column:
    """The value as a double: text by its numeric prefix, 0 without one."""
    c = col(c)
    if kind != "string":
        return c.cast("double")
    return F.when(c.isNotNull(), F.coalesce(F.regexp_extract(c, _NUMBER, 1).try_cast("double"), F.lit(0.0)))


def truthy(c, kind: str = "string") -> Column:
    """What a WHERE keeps: neither NULL nor zero."""
    return F.coalesce(number(c, kind) != 0, F.lit(False))


def cast_integer(c, kind: str = "string") -> Column:
    c = col(c)
    if kind == "string":
        digits = F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1)
        big = F.when(digits.startswith("-"), F.lit(-(2**63))).otherwise(F.lit(2**63 - 1))
        return F.when(c.isNotNull(), F.when(digits == "", F.lit(0)).otherwise(F.coalesce(digits.try_cast("bigint"), big)).cast("bigint"))
    if kind in ("double", "float"):  # saturating, towards zero
        top = 9.223372036854775807e18
        return F.when(c.isNull(), None).when(F.isnan(c), F.lit(0)).when(c >= top, F.lit(2**63 - 1)).when(c <= -top, F.lit(-(2**63))).otherwise(F.when(F.abs(c) < top, c).try_cast("bigint"))
    return c.cast("bigint")


def compare_numeric_to_text(n, text) -> Column:
    """n = text under numeric affinity: a well-formed number compares as one, any other text never equals."""
    text = col(text)
    return F.when(text.rlike(_WHOLE), col(n).cast("double") == F.trim(text).try_cast("double")).otherwise(F.when(col(n).isNotNull() & text.isNotNull(), F.lit(False)))


def add(a, b) -> Column:
    """Integer sum that becomes real where it overflows; the result is a double."""
    a, b = col(a), col(b)
    return F.coalesce(F.try_add(a, b).cast("double"), a.cast("double") + b.cast("double"))


def divide(a, b, integers: bool = True) -> Column:
    a, b = col(a), col(b)
    if integers:
        return F.when(b != 0, F.call_function("try_divide", a - F.try_mod(a, b), b).cast("bigint"))
    return F.when(b != 0, a.cast("double") / b.cast("double"))


def remainder(a, b) -> Column:
    """Of both operands cut to integers; the sign is the dividend's."""
    return F.try_mod(cast_integer(a, "double"), cast_integer(b, "double"))


def substr(c, start, length=None) -> Column:
    """1-based; a negative start counts from the end; position 0 takes one of the length; a negative length looks back."""
    c, n = col(c), F.length(col(c))
    p = (start if isinstance(start, Column) else F.lit(start)).cast("bigint")
    z = F.lit(2**40) if length is None else (length if isinstance(length, Column) else F.lit(length)).cast("bigint")
    # Positions begin .. end - 1 of the text, from 1.
    first = F.when(p < 0, n + p + 1).when(p == 0, F.lit(0)).otherwise(p)
    begin, end = F.when(z < 0, first + z).otherwise(first), F.when(z < 0, first).otherwise(first + z)
    begin, end = F.greatest(begin, F.lit(1)), F.least(end, n + 1)
    return F.when(c.isNull() | p.isNull() | z.isNull(), None).when(end > begin, F.substring(c, begin.cast("int"), (end - begin).cast("int"))).otherwise(F.lit(""))


def trim(c, chars: str = " ", side: str = "both") -> Column:
    return {"both": F.btrim, "left": F.ltrim, "right": F.rtrim}[side](col(c), F.lit(chars))


def replace(c, old, new) -> Column:
    return F.replace(col(c), old if isinstance(old, Column) else F.lit(old), new if isinstance(new, Column) else F.lit(new))


def instr(c, part) -> Column:
    return F.instr(col(c), part)


def hex_(c) -> Column:
    """Bytes of the text form; NULL gives an empty text."""
    return F.coalesce(F.hex(col(c).cast("string").cast("binary")), F.lit(""))


def unhex(c) -> Column:
    c = col(c)
    return F.when((F.length(c) % 2 == 0) & c.rlike("^[0-9A-Fa-f]*$"), F.unhex(c))


def round_(c, digits: int = 0) -> Column:
    """Half away from zero; always real; fewer than no digits are none."""
    return F.round(col(c).cast("double"), max(0, min(30, digits))).cast("double")


def scalar_min(*cs) -> Column:
    cs = [col(c) for c in cs]
    return F.when(_none_null(cs), F.least(*cs))


def scalar_max(*cs) -> Column:
    cs = [col(c) for c in cs]
    return F.when(_none_null(cs), F.greatest(*cs))


def _none_null(cs: list[Column]) -> Column:
    fine = cs[0].isNotNull()
    for c in cs[1:]:
        fine = fine & c.isNotNull()
    return fine


def random(seed: int | None = None) -> Column:
    r = F.rand() if seed is None else F.rand(seed)
    return ((r * 2 - 1) * 9.2e18).cast("bigint")


def real_text(c) -> Column:
    """A real as text: up to 15 significant digits, always with a point or exponent."""
    c = col(c).cast("double")
    short = F.regexp_replace(F.regexp_replace(F.format_string("%.15g", c), r"(\.[0-9]*?)0+(?=e|$)", "$1"), r"\.(?=e|$)", "")
    return F.when(c.isNull(), None).when(short.contains("."), short).when(short.contains("e"), F.regexp_replace(short, "e", ".0e")).otherwise(F.concat(short, F.lit(".0")))


def concat(*cs) -> Column:
    return F.concat(*[col(c) for c in cs])


# The variants of the other dialect.


def mysql_substr(c, start: int, length: int | None = None) -> Column:
    c, n = col(c), F.length(col(c))
    if start == 0 or (length is not None and length <= 0):
        return F.when(c.isNotNull(), F.lit(""))
    begin = F.lit(start) if start > 0 else n + start + 1
    return F.when(c.isNull(), None).when((begin < 1) | (begin > n), F.lit("")).otherwise(F.substring(c, begin.cast("int"), F.lit(2**30 if length is None else length)))


def mysql_hex(c) -> Column:
    return F.hex(col(c))


def mysql_nullif(a, b, kinds: tuple[str, str] = ("string", "string")) -> Column:
    a, b = col(a), col(b)
    same = a == b if kinds[0] == kinds[1] else number(a, kinds[0]) == number(b, kinds[1])
    return F.when(F.coalesce(same, F.lit(False)), None).otherwise(a)


def mysql_round(c, digits: int = 0) -> Column:
    """Half to even; negative digits round before the point."""
    return F.bround(col(c).cast("double"), digits).cast("double")
