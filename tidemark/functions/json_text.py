"""JSON in texts, strict, with the order of keys, repeated keys and the spelling of numbers kept: Arrow functions."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import col


class Number(str):
    """A number as it was spelled."""


class Object(list):
    """Key and value pairs in order."""


def _refuse(name: str):
    raise ValueError(f"malformed JSON: {name}")


_decoder = json.JSONDecoder(object_pairs_hook=Object, parse_float=Number, parse_int=Number, parse_constant=_refuse)


def parse(text: str):
    try:
        return _decoder.decode(text)
    except (ValueError, RecursionError) as e:
        raise ValueError("malformed JSON") from e


def dump(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, Number):
        return str(v)
    if isinstance(v, str):
        return json.dumps(v, ensure_ascii=False)
    if isinstance(v, Object):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{dump(x)}" for k, x in v) + "}"
    return "[" + ",".join(map(dump, v)) + "]"


def kind(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, Number):
        return "real" if re.search(r"[.eE]", v) else "integer"
    return "text" if isinstance(v, str) else "object" if isinstance(v, Object) else "array"


_STEP = re.compile(r'\."((?:[^"\\]|\\.)*)"|\.([^.\[]+)|\[(\d+)\]|\[#(?:-(\d+))?\]')


@lru_cache(4096)
def path(p: str) -> tuple:
    """Steps: ("key", name), ("at", n) or ("end", n) counted back from the length."""
    if not p.startswith("$"):
        raise ValueError(f"bad JSON path: {p!r}")
    steps, at = [], 1
    while at < len(p):
        m = _STEP.match(p, at)
        if not m:
            raise ValueError(f"bad JSON path: {p!r}")
        if m[1] is not None or m[2] is not None:
            steps.append(("key", m[1] if m[1] is not None else m[2]))
        else:
            steps.append(("at", int(m[3])) if m[3] is not None else ("end", int(m[4] or 0)))
        at = m.end()
    return tuple(steps)


class _MISSING:
    """No such node; the class itself is the mark, so that it survives pickling."""



def _index(v, step) -> int | None:
    """Where a step leads in an object's pairs or an array; the length means just beyond."""
    what, x = step
    if what == "key":
        return next((k for k, (name, _) in enumerate(v) if name == x), None) if isinstance(v, Object) else None
    if not isinstance(v, list) or isinstance(v, Object):
        return None
    n = x if what == "at" else len(v) - x
    return n if 0 <= n <= len(v) else None


def node(v, steps):
    for step in steps:
        k = _index(v, step)
        if k is None or k >= len(v):
            return _MISSING
        v = v[k][1] if isinstance(v, Object) else v[k]
    return v


def sql_value(v) -> str | None:
    """A node as SQL sees it, in text: containers as JSON, true and false as 1 and 0, null as NULL."""
    if v is _MISSING or v is None:
        return None
    if isinstance(v, bool):
        return "1" if v else "0"
    return dump(v) if isinstance(v, list) else str(v)


def edit(v, steps, new, create: bool, overwrite: bool):
    """A document with a node set.  Only the last step may create, in a container that is there."""
    if not steps:
        return new if overwrite else v
    at, step = _index(v, steps[0]), steps[0]
    there = at is not None and at < len(v)
    if len(steps) > 1:
        if not there:
            return v
        inner = edit(v[at][1] if isinstance(v, Object) else v[at], steps[1:], new, create, overwrite)
    elif there:
        if not overwrite:
            return v
        inner = new
    elif create and isinstance(v, Object) and step[0] == "key":
        return Object([*v, (step[1], new)])
    elif create and at is not None and isinstance(v, list) and not isinstance(v, Object) and at == len(v):
        return [*v, new]
    else:
        return v
    copy = type(v)(v)
    copy[at] = (v[at][0], inner) if isinstance(v, Object) else inner
    return copy


def removed(v, steps):
    if not steps:
        return _MISSING
    at = _index(v, steps[0])
    if at is None or at >= len(v):
        return v
    copy = type(v)(v)
    if len(steps) == 1:
        del copy[at]
    else:
        inner = removed(v[at][1] if isinstance(v, Object) else v[at], steps[1:])
        copy[at] = (v[at][0], inner) if isinstance(v, Object) else inner
    return copy


def _udf(f: Callable, returns: str = "string"):
    kinds = {"string": pa.string(), "bigint": pa.int64()}

    @F.arrow_udf(returns)
    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([f(*values) for values in zip(*(c.to_pylist() for c in columns))], kinds[returns])

    return run


def _args(values) -> list[Column]:
    return [v if isinstance(v, Column) else F.lit(v) for v in values]


def _strict(f):
    return lambda x, *rest: None if x is None else f(parse(x), *rest)


def json_(c) -> Column:
    return _udf(_strict(dump))(col(c))


def _valid(x):
    try:
        return None if x is None else int(parse(x) is not _MISSING)
    except ValueError:
        return 0


def json_valid(c) -> Column:
    return _udf(_valid, "bigint")(col(c))


def _type(v, p="$"):
    found = _MISSING if p is None else node(v, path(p))
    return None if found is _MISSING else kind(found)


def json_type(c, p: str = "$") -> Column:
    path(p)
    return _udf(_strict(lambda v: _type(v, p)))(col(c))


def json_extract(c, *paths: str) -> Column:
    for p in paths:
        path(p)
    if len(paths) == 1:
        return _udf(_strict(lambda v: sql_value(node(v, path(paths[0])))))(col(c))
    return _udf(_strict(lambda v: dump([None if (x := node(v, path(p))) is _MISSING else x for p in paths])))(col(c))


def _arrow_path(p: str | int) -> str:
    return f"$[{p}]" if isinstance(p, int) else p if p.startswith("$") else f'$."{p}"'


def arrow(c, p: str | int) -> Column:
    """-> : the node as JSON."""
    q = _arrow_path(p)
    return _udf(_strict(lambda v: None if (x := node(v, path(q))) is _MISSING else dump(x)))(col(c))


def arrow2(c, p: str | int) -> Column:
    """->> : the node as SQL sees it."""
    return json_extract(c, _arrow_path(p))


def _length(v, p):
    x = node(v, path(p))
    return None if x is _MISSING else len(x) if isinstance(x, list) and not isinstance(x, Object) else 0


def json_array_length(c, p: str = "$") -> Column:
    path(p)
    return _udf(_strict(lambda v: _length(v, p)), "bigint")(col(c))


def json_quote(c, number: bool = False) -> Column:
    return _udf(lambda x: "null" if x is None else str(x) if number else dump(x))(col(c))


def to_node(value, is_json: bool = False):
    if value is None or isinstance(value, bool):
        return value
    if isinstance(value, (int, float)):
        return Number(repr(value))
    return parse(value) if is_json else value


def json_array(*values, json_args: tuple[int, ...] = ()) -> Column:
    """values: columns or literals; those at json_args are JSON already."""
    return _udf(lambda *v: dump([to_node(x, k in json_args) for k, x in enumerate(v)]))(*_args(values))


def json_object(*pairs, json_args: tuple[int, ...] = ()) -> Column:
    """key, value, ...; repeated keys stay."""
    if len(pairs) % 2:
        raise ValueError("json_object takes keys and values in pairs")
    return _udf(lambda *v: dump(Object((v[k], to_node(v[k + 1], k + 1 in json_args)) for k in range(0, len(v), 2))))(*_args(pairs))


def _edited(c, pairs, create: bool, overwrite: bool, json_args: tuple[int, ...]) -> Column:
    def run(v, *rest):
        for k in range(0, len(rest), 2):
            if rest[k] is not None:
                v = edit(v, path(rest[k]), to_node(rest[k + 1], k + 1 in json_args), create, overwrite)
        return dump(v)

    return _udf(_strict(run))(col(c), *_args(pairs))


def json_set(c, *pairs, json_args: tuple[int, ...] = ()) -> Column:
    return _edited(c, pairs, True, True, json_args)


def json_insert(c, *pairs, json_args: tuple[int, ...] = ()) -> Column:
    return _edited(c, pairs, True, False, json_args)


def json_replace(c, *pairs, json_args: tuple[int, ...] = ()) -> Column:
    return _edited(c, pairs, False, True, json_args)


def json_remove(c, *paths: str | None) -> Column:
    def run(v):
        for p in paths:
            if p is None:
                return None
            v = removed(v, path(p))
            if v is _MISSING:
                return None
        return dump(v)

    return _udf(_strict(run))(col(c))
