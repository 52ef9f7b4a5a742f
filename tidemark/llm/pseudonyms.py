"""Format-preserving pseudonyms for personal numbers, dates and mail addresses, in DataFrame operations alone.

A value that a format's own rules confirm (check digits, ranges, the calendar) is permuted within the values of that format
by a keyed, unbalanced Feistel network: the value is split into two numbers, and each round adds a keyed hash of one to the
other, modulo its own range.  Each round can be undone, so different values stay different, and equal values stay equal
in all documents.  What the rules don't confirm stays as it is, and so does every other character.

| format | confirmed by | stays | moves within |
|-|-|-|-|
| payment card, 13-19 digits, single spaces or hyphens, also before or after other digits | Luhn | first digit, grouping | the middle digits; the check digit follows |
| IBAN, also before other words | modulo 97 | country, letters, grouping | the digits; the check digits follow |
| North American telephone | its notation | country code, punctuation | numbers with area and exchange 200-999, or the others |
| US social security number | area, group and serial | hyphens | valid numbers |
| IPv4 address | octets up to 255 | | all addresses |
| date y-m-d, d.m.y, m/d/y | calendar, 1800 to 2199 | notation, padding | the 146,097 days of those years |
| mail address | characters of its local part | domain, case, punctuation | letters and digits of the local part |

Edge cases: a null text stays null and an empty one empty, with no value replaced; repeated rows give equal results; a very
long text is rewritten whole, in one task; of overlapping matches the leftmost counts, and of those the format named first
in the pattern; an empty table gives an empty result; other columns are carried along, whatever their names.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table

ROUNDS = 8
KEY_SETTING = "spark.tidemark.pseudonyms.key"
_drawn: dict[str, str] = {}
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
_IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
_PHONE = r"(?<![A-Za-z0-9])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![A-Za-z0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
_ISO = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
_DOTS = r"(?<![0-9.])[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9])"
_SLASHES = r"(?<![0-9/])[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9/])"
_CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
_BEFORE, _AFTER = "(?<![A-Za-z0-9])", "(?![A-Za-z0-9])"
#: The usual groupings of a card, and the lengths of IBANs by country; other groupings and countries count where these don't.
_CARD_FORM = r"^(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})$"
_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
_IBAN_FORM = "^(?:" + "|".join(f"(?:{c.replace(' ', '|')})[A-Z0-9]{{{n - 2}}}" for n, c in _LENGTHS.items()) + ")$"
_DAYS = (189, 773)  # 189 * 773 = 146,097 days, four centuries
_FIRST_DAY = -62_091  # 1800-01-01, counted from 1970-01-01


def _long(c: Column) -> Column:
    return c.try_cast("bigint")


def _hash(key: str, tag: str, i: Column, x: Column) -> Column:
    return _long(F.conv(F.substring(F.sha2(F.concat_ws("/", F.lit(key), F.lit(tag), i.cast("string"), x.cast("string")).cast("binary"), 256), 1, 15), 16, 10))


def feistel(key: str, tag: str, left: Column, right: Column, a: Column | int, b: Column | int) -> Column:
    """(left modulo a, right modulo b) permuted; a struct l, r."""
    a, b = (F.lit(x).cast("bigint") if isinstance(x, int) else x for x in (a, b))
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r")),
        lambda acc, i: F.when(i % 2 == 0, F.struct(((acc["l"] + _hash(key, tag, i, acc["r"]) % a) % a).alias("l"), acc["r"].alias("r"))).otherwise(
            F.struct(acc["l"].alias("l"), ((acc["r"] + _hash(key, tag, i, acc["l"]) % b) % b).alias("r"))
        ),
    )


def _ten(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(10**k).cast("bigint") for k in range(19)]), (n + 1).cast("int"))


def _let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def permuted_digits(key: str, tag: str, digits: Column) -> Column:
    """A string of up to 36 digits permuted among those of its length; one digit is shifted by a keyed amount."""
    def run(d: Column) -> Column:
        n = F.length(d)
        cut = F.floor(n / 2).cast("int")
        named = f"{tag}"
        out = feistel(key, named, F.coalesce(_long(F.substring(d, F.lit(1), cut)), F.lit(0)), _long(F.substring(d, cut + 1, n)), _ten(cut), _ten(n - cut))
        return _let(out, lambda o: F.concat(F.when(cut > 0, F.lpad(o["l"].cast("string"), cut, "0")).otherwise(F.lit("")), F.lpad(o["r"].cast("string"), (n - cut).cast("int"), "0")))

    return F.when(F.length(digits) == 0, digits).otherwise(_let(digits, run))


def only(c: Column, kept: str) -> Column:
    return F.regexp_replace(c, F.lit(f"[^{kept}]"), F.lit(""))


def overlaid(shape: Column, kept: str, new: Column) -> Column:
    """The shape with its characters of that kind replaced by those of new, in order."""
    return F.array_join(
        F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.when(F.substring(shape, i, F.lit(1)).rlike(f"[{kept}]"), F.substring(new, F.length(only(F.substring(shape, F.lit(1), i), kept)), F.lit(1))).otherwise(F.substring(shape, i, F.lit(1)))),
        "",
    )


def _luhn(digits: Column) -> Column:
    """Sum of a digit string whose last digit counts double: the check digit's other side."""
    n = F.length(digits)
    return F.aggregate(
        F.sequence(F.lit(1), n), F.lit(0).cast("bigint"),
        lambda acc, i: acc + _let(_long(F.substring(digits, i, F.lit(1))), lambda d: F.when((n - i) % 2 == 0, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)),
    )


def _card_right(m: Column) -> Column:
    def run(d: Column) -> Column:
        n = F.length(d)
        return (10 - _luhn(F.substring(d, F.lit(1), n - 1)) % 10) % 10 == _long(F.substring(d, n, F.lit(1)))

    return _let(only(m, "0-9"), run)


def _card(key: str, m: Column) -> Column:
    def run(d: Column) -> Column:
        moved = F.concat(F.substring(d, 1, 1), permuted_digits(key, "card", F.substring(d, F.lit(2), F.length(d) - 2)))
        return overlaid(m, "0-9", _let(moved, lambda x: F.concat(x, ((10 - _luhn(x) % 10) % 10).cast("string"))))

    return _let(only(m, "0-9"), run)


def _mod97(c: Column) -> Column:
    """Remainder of an IBAN whose country and check digits stand at the end; letters count 10 to 35."""
    def step(acc: Column, i: Column) -> Column:
        code = F.ascii(F.substring(c, i, F.lit(1))).cast("bigint")
        return F.when(code >= 65, (acc * 100 + code - 55) % 97).otherwise((acc * 10 + code - 48) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(c)), F.lit(0).cast("bigint"), step)


def _iban_right(m: Column) -> Column:
    def run(x: Column) -> Column:
        body = F.substring(x, F.lit(5), F.length(x))
        return (_mod97(F.concat(body, F.substring(x, 1, 4))) == 1) & (F.length(only(body, "0-9")) > 0)

    return _let(only(m, "A-Z0-9"), run)


def _iban(key: str, m: Column) -> Column:
    def run(x: Column) -> Column:
        country, body = F.substring(x, 1, 2), F.substring(x, F.lit(5), F.length(x))
        moved = _let(body, lambda b: overlaid(b, "0-9", permuted_digits(key, "iban", only(b, "0-9"))))
        whole = _let(moved, lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))
        return overlaid(m, "A-Z0-9", whole)

    return _let(only(m, "A-Z0-9"), run)


def _phone(key: str, m: Column) -> Column:
    """Numbers with area and exchange 200-999 are permuted among themselves, and so are all others (2 + 1.6 milliards)."""
    def run(d: Column) -> Column:
        n = F.length(d)
        area, exchange, line = (_long(F.substring(d, n - k, F.lit(z))) for k, z in ((9, 3), (6, 3), (3, 4)))

        def moved(tag: str, value: Column, side: int, parts) -> Column:
            out = feistel(key, tag, F.floor(value / side), value % side, side, side)
            shown = lambda v: F.concat(F.when(n == 11, F.substring(d, 1, 1)).otherwise(F.lit("")), *[F.lpad(x.cast("string"), z, "0") for x, z in zip(parts(v), (3, 3, 4))])
            return _let(out, lambda o: _let(o["l"] * side + o["r"], shown))

        low = 200 * 10_000_000
        valid = moved("phone", ((area - 200) * 800 + exchange - 200) * 10_000 + line, 80_000, lambda v: (F.floor(v / 8_000_000) + 200, F.floor(v / 10_000) % 800 + 200, v % 10_000))
        value = F.when(area < 200, (area * 1_000 + exchange) * 10_000 + line).otherwise(low + ((area - 200) * 200 + exchange) * 10_000 + line)
        other = moved(
            "phone-other", value, 60_000,
            lambda v: (F.when(v < low, F.floor(v / 10_000_000)).otherwise(F.floor((v - low) / 2_000_000) + 200), F.when(v < low, F.floor(v / 10_000) % 1_000).otherwise(F.floor((v - low) / 10_000) % 200), v % 10_000),
        )
        return overlaid(m, "0-9", F.when((area >= 200) & (exchange >= 200), valid).otherwise(other))

    return _let(only(m, "0-9"), run)


def _ssn(key: str, m: Column) -> Column:
    area, group, serial = (_long(F.substring(m, k, z)) for k, z in ((1, 3), (5, 2), (8, 4)))
    right = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    out = feistel(key, "ssn", place * 99 + group - 1, serial - 1, 898 * 99, 9_999)

    def shown(o: Column) -> Column:
        a = F.floor(o["l"] / 99)
        return F.concat(F.lpad(F.when(a >= 665, a + 2).otherwise(a + 1).cast("string"), 3, "0"), F.lit("-"), F.lpad((o["l"] % 99 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((o["r"] + 1).cast("string"), 4, "0"))

    return F.when(right, _let(out, shown)).otherwise(m)


def _ip(key: str, m: Column) -> Column:
    def run(o: Column) -> Column:
        part = [_long(F.element_at(o, k)) for k in (1, 2, 3, 4)]
        right = (F.array_max(F.transform(o, _long)) <= 255) & (F.array_max(F.transform(o, lambda x: F.when(F.length(x) > 1, x.startswith("0")).otherwise(F.lit(False)).cast("int"))) == 0)
        out = feistel(key, "ip", part[0] * 256 + part[1], part[2] * 256 + part[3], 65_536, 65_536)
        new = _let(out, lambda v: F.concat_ws(".", F.floor(v["l"] / 256).cast("string"), (v["l"] % 256).cast("string"), F.floor(v["r"] / 256).cast("string"), (v["r"] % 256).cast("string")))
        return F.when(right, new).otherwise(m)

    return _let(F.split(m, r"\."), run)


def _date(key: str, m: Column) -> Column:
    def run(p: Column) -> Column:
        iso, dots = m.rlike("^[0-9]{4}-"), m.contains(".")
        y, mo, d = (F.when(iso, F.element_at(p, a)).when(dots, F.element_at(p, b)).otherwise(F.element_at(p, c)) for a, b, c in ((1, 3, 3), (2, 2, 1), (3, 1, 2)))
        padded = F.lpad(y, 4, "0"), F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")
        day = F.concat_ws("-", *padded).try_cast("date")
        n = F.unix_date(day).cast("bigint") - _FIRST_DAY
        out = feistel(key, "date", F.floor(n / _DAYS[1]), n % _DAYS[1], *_DAYS)

        def shown(o: Column) -> Column:
            new = F.date_from_unix_date((o["l"] * _DAYS[1] + o["r"] + _FIRST_DAY).cast("int"))
            short = (F.length(mo) < 2) | (F.length(d) < 2)
            form = lambda long, brief: F.when(short, F.date_format(new, brief)).otherwise(F.date_format(new, long))
            return F.when(iso, F.date_format(new, "yyyy-MM-dd")).when(dots, form("dd.MM.yyyy", "d.M.yyyy")).otherwise(form("MM/dd/yyyy", "M/d/yyyy"))

        return F.when(day.isNotNull() & (n >= 0) & (n < _DAYS[0] * _DAYS[1]), _let(out, shown)).otherwise(m)

    return _let(F.split(m, "[-./]"), run)


def _letters(key: str, word: Column) -> Column:
    """Lower-case letters permuted among words of that length; of a longer word, every 24 letters are permuted by themselves."""
    def number(c: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.length(c)), F.lit(0).cast("bigint"), lambda acc, i: acc * 26 + F.ascii(F.substring(c, i, F.lit(1))) - 97)

    def spelled(v: Column, n: Column) -> Column:
        power = lambda k: F.element_at(F.array(*[F.lit(26**j).cast("bigint") for j in range(14)]), (k + 1).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.char((F.floor(v / power(n - i)).cast("bigint") % 26 + 97).cast("int"))), "")).otherwise(F.lit(""))

    def run(w: Column) -> Column:
        n = F.length(w)
        cut = F.floor(n / 2).cast("int")
        power = lambda k: F.element_at(F.array(*[F.lit(26**j).cast("bigint") for j in range(14)]), (k + 1).cast("int"))
        left = F.when(cut > 0, number(F.substring(w, F.lit(1), cut))).otherwise(F.lit(0).cast("bigint"))
        out = feistel(key, "letters", left, number(F.substring(w, cut + 1, n)), power(cut), power(n - cut))
        return _let(out, lambda o: F.concat(spelled(o["l"], cut), spelled(o["r"], (n - cut).cast("int"))))

    pieces = F.transform(F.sequence(F.lit(0), F.floor((F.length(word) - 1) / 24).cast("int")), lambda k: _let(F.substring(word, k * 24 + 1, F.lit(24)), run))
    return F.when(F.length(word) == 0, word).otherwise(F.array_join(pieces, ""))


def _email(key: str, m: Column) -> Column:
    def run(local: Column) -> Column:
        low = F.lower(local)
        letters = overlaid(low, "a-z", _let(only(low, "a-z"), lambda w: _letters(key, w)))
        digits = _let(letters, lambda x: overlaid(x, "0-9", _let(only(x, "0-9"), lambda d: F.concat(*[permuted_digits(key, "mail", F.substring(d, F.lit(a), F.lit(36))) for a in (1, 37)]))))
        cased = _let(digits, lambda x: F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: F.when(F.substring(local, i, F.lit(1)).rlike("[A-Z]"), F.upper(F.substring(x, i, F.lit(1)))).otherwise(F.substring(x, i, F.lit(1)))), ""))
        return F.concat(cased, F.substring(m, F.length(local) + 1, F.length(m)))

    return _let(F.substring_index(m, "@", 1), run)


def pseudonym(key: str, m: Column) -> Column:
    """One matched string with its pseudonym, or as it is where its format's rules don't confirm it."""
    whole = lambda p: m.rlike(f"^(?:{p})$")
    return (
        F.when(m.contains("@"), _email(key, m)).when(m.rlike("^[A-Z]"), _iban(key, m)).when(whole(_IP), _ip(key, m)).when(whole(f"{_ISO}|{_DOTS}|{_SLASHES}"), _date(key, m))
        .when(whole(_SSN), _ssn(key, m)).when(whole(_PHONE), _phone(key, m)).otherwise(_card(key, m))
    )


def _confirmed(text: Column, pattern: str, kept: str, least: int, right, form) -> Column:
    """The strings of that pattern in a text that their check digits confirm.

    The pattern may run on into what follows, so from each place the beginnings of a match that end at a group's end are
    tried: those of the usual form come first, then the longer.
    """
    runs = F.array_distinct(F.regexp_extract_all(text, F.lit(f"{_BEFORE}(?=({pattern}){_AFTER})"), F.lit(1)))

    def chosen(run: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(least), F.length(run)), lambda i: F.substring(run, i, F.lit(1)).rlike("[A-Z0-9]") & ~F.substring(run, i + 1, F.lit(1)).rlike("[A-Z0-9]"))
        fine = F.filter(F.transform(ends, lambda i: F.substring(run, F.lit(1), i)), lambda x: F.when(F.length(only(x, kept)) >= least, right(x)).otherwise(F.lit(False)))
        return F.array_max(F.transform(fine, lambda x: F.struct(form(x).alias("usual"), F.length(x).alias("n"), x.alias("found"))))["found"]

    return F.array_distinct(F.filter(F.transform(runs, chosen), lambda x: x.isNotNull()))


def _pattern(text: Column) -> Column:
    """The pattern of all formats for a text: of cards and IBANs it holds the very strings that are confirmed there."""
    cards = _confirmed(text, _CARD, "0-9", 13, _card_right, lambda x: x.rlike(_CARD_FORM))
    ibans = _confirmed(text, _IBAN, "A-Z0-9", 12, _iban_right, lambda x: only(x, "A-Z0-9").rlike(_IBAN_FORM))
    longest = lambda a: F.array_join(F.transform(F.sort_array(F.transform(a, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))), False), lambda p: p["x"]), "|")
    either = lambda a: F.when(F.size(a) > 0, F.concat(F.lit(f"|{_BEFORE}(?:"), longest(a), F.lit(f"){_AFTER}"))).otherwise(F.lit(""))
    return F.concat(F.lit(f"(?:{_EMAIL})"), _let(ibans, either), F.lit("".join(f"|(?:{p})" for p in (_PHONE, _SSN, _IP, _ISO, _DOTS, _SLASHES))), _let(cards, either))


def pseudonymised(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The documents with the text rewritten and n_replaced added as the last column (with underscores before its name if a
    column of that name came in).  Texts without a digit or an @ are passed on unread."""
    def cut(pattern: Column) -> Column:
        found = F.regexp_extract_all(F.col(text), pattern, F.lit(0))
        return _let(found, lambda f: F.when(F.size(f) > 0, F.struct(F.split(F.col(text), pattern, -1).alias("between"), f.alias("old"), F.transform(f, lambda m: pseudonym(key, m)).alias("new"))))

    parts = F.when(F.col(text).rlike("[0-9@]"), _let(_pattern(F.col(text)), cut))
    rest = [c for c in docs.columns if c != text]
    own, told = free_name(docs, "parts"), free_name(docs, "n_replaced")
    held = docs.select(*rest, F.col(text), parts.alias(own))
    joined = F.concat(F.array_join(F.zip_with(F.slice(f"{own}.between", F.lit(1), F.size(f"{own}.new")), F.col(f"{own}.new"), lambda a, b: F.concat(a, b)), ""), F.element_at(f"{own}.between", -1))
    changed = F.aggregate(F.zip_with(f"{own}.old", f"{own}.new", lambda a, b: (a != b).cast("bigint")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return held.select(*rest, F.when(F.col(own).isNull(), F.col(text)).otherwise(joined).alias(text), F.coalesce(changed, F.lit(0).cast("bigint")).alias(told))


def configured_key(spark: SparkSession) -> str:
    """The secret key: the session's spark.tidemark.pseudonyms.key, or where that is unset one drawn for this application.

    Pseudonyms can be undone with the key, so it stands in no source; to link values across applications, set it.
    """
    found = spark.conf.get(KEY_SETTING, None)
    return found or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(16))


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"), configured_key(spark))
