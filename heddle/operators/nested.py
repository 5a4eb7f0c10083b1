"""Rewriting of nested records by path: fields set, removed and renamed at any depth of structs, arrays and maps.

A path is a list of names, positions and ``"*"``, whose first name is a column. Every rewrite is one expression over the
types of the column, built by recursion over its schema: no Python runs on rows, and columns that no path touches stay
as they are.

* ``set_fields``: parents that are missing or null are made (structs for names, arrays for positions), arrays grow by nulls up
  to the position, maps get the key. Other elements of an array keep their values and get the new field as null.
* ``remove_fields``: a path that is not there changes nothing; a struct loses the field, a map the key, an array's element
  becomes null. With a condition only values that satisfy it go; as a struct has its fields in every row, they become
  null there, and so do fields of single elements.
* ``sanitised``: every key with a quote or a backtick is there a second time, with underscores for them, unless there is such a
  key already; the original keys stay.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Path = Sequence[str | int]
ALL = "*"
#: Signs of keys that a JSON path cannot hold.
UNSAFE = "['\"`]"


def _both(a: Column | None, b: Column | None) -> Column | None:
    return b if a is None else a if b is None else a & b


def _named(kind: T.StructType, c: Column) -> dict[str, Column]:
    return {n: c.getField(n) for n in kind.names}


def _made(path: Path, value: Column, at: Column | None) -> Column:
    """What a missing parent is made of; null where ``at`` does not hold."""
    if not path:
        out = value
    elif isinstance(path[0], int):
        out = F.concat(F.array_repeat(F.lit(None), path[0]), F.array(_made(path[1:], value, None)))
    elif path[0] == ALL:
        raise ValueError("no elements to set in an array that is not there")
    else:
        out = F.struct(_made(path[1:], value, None).alias(path[0]))
    return out if at is None else F.when(at, out)


def _set(c: Column, kind: T.DataType, path: Path, value: Column, at: Column | None) -> Column:
    """``c`` with the value at the path, where ``at`` holds; elsewhere of the same type, with its old values."""
    if not path:
        return value if at is None else F.when(at, value).otherwise(c)
    step, rest = path[0], path[1:]
    if isinstance(kind, T.StructType) and isinstance(step, str) and step != ALL:
        own = _named(kind, c)
        own[step] = _set(own[step], kind[step].dataType, rest, value, at) if step in own else _made(rest, value, at)
        out = F.struct(*[v.alias(n) for n, v in own.items()])
        return out if at is None else F.when(at | c.isNotNull(), out)
    if isinstance(kind, T.ArrayType) and step == ALL:
        return F.transform(c, lambda x: _set(x, kind.elementType, rest, value, at))
    if isinstance(kind, T.ArrayType) and isinstance(step, int):
        size = F.coalesce(F.size(c), F.lit(0))
        base = F.coalesce(c, F.array().cast(kind))
        grows = size <= step if at is None else at & (size <= step)
        padded = F.when(grows, F.concat(base, F.array_repeat(F.lit(None).cast(kind.elementType), step + 1 - size))).otherwise(base if at is None else c)
        return F.transform(padded, lambda x, i: _set(x, kind.elementType, rest, value, _both(at, i == step)))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType) and isinstance(step, str):
        with_key = c
        if step != ALL:
            base = F.coalesce(c, F.create_map().cast(kind))
            new = F.map_concat(base, F.create_map(F.lit(step), F.lit(None).cast(kind.valueType)))
            lacks = ~F.map_contains_key(base, F.lit(step))
            with_key = F.when(lacks if at is None else at & lacks, new).otherwise(base if at is None else c)
        return F.transform_values(with_key, lambda k, v: _set(v, kind.valueType, rest, value, at if step == ALL else _both(at, k == step)))
    raise ValueError(f"{step!r} does not lead into a {kind.simpleString()}")


def set_fields(df: DataFrame, fields: Sequence[tuple[Path, Column]]) -> DataFrame:
    """``df`` with values at paths, set one after the other; a value is computed from the record as it is then."""
    for path, value in fields:
        if not path or not isinstance(path[0], str):
            raise ValueError("a path begins with the name of a column")
        name = path[0]
        if name in df.columns:
            df = df.withColumn(name, _set(F.col(f"`{name}`"), df.schema[name].dataType, path[1:], value, None))
        else:
            df = df.withColumn(name, _made(path[1:], value, None))
    return df


Condition = Callable[[Column], Column]


def _gone(value: Column, condition: Condition | None, at: Column | None) -> Column | None:
    """Where a value is to go; None: everywhere."""
    own = F.coalesce(condition(value), F.lit(False)) if condition else None
    return _both(at, own)


def _removed(c: Column, kind: T.DataType, path: Path, condition: Condition | None, at: Column | None) -> Column:
    step, rest = path[0], path[1:]
    if isinstance(kind, T.StructType) and isinstance(step, str):
        own = _named(kind, c)
        for name in [n for n in kind.names if step in (n, ALL)]:
            if rest:
                own[name] = _removed(own[name], kind[name].dataType, rest, condition, at)
            elif (gone := _gone(own[name], condition, at)) is None:
                del own[name]
            else:
                own[name] = F.when(~gone, own[name])
        return F.when(c.isNotNull(), F.struct(*[v.alias(n) for n, v in own.items()]))
    if isinstance(kind, T.ArrayType) and (isinstance(step, int) or step == ALL):

        def element(x: Column, i: Column) -> Column:
            here = at if step == ALL else _both(at, i == step)
            if rest:
                return _removed(x, kind.elementType, rest, condition, here)
            gone = _gone(x, condition, here)
            return F.lit(None).cast(kind.elementType) if gone is None else F.when(~gone, x)

        return F.transform(c, element)
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType) and isinstance(step, str):
        if rest:
            return F.transform_values(c, lambda k, v: _removed(v, kind.valueType, rest, condition, at if step == ALL else _both(at, k == step)))

        def stays(k: Column, v: Column) -> Column:
            gone = _both(None if step == ALL else k == step, _gone(v, condition, at))
            return F.lit(False) if gone is None else ~gone

        return F.map_filter(c, stays)
    return c


def remove_fields(df: DataFrame, paths: Sequence[Path], condition: Condition | None = None) -> DataFrame:
    """``df`` without what lies at the paths; ``condition`` says of a value whether it goes, null means it stays."""
    for path in paths:
        for name in [c for c in df.columns if path and path[0] in (c, ALL)]:
            c = F.col(f"`{name}`")
            if len(path) > 1:
                df = df.withColumn(name, _removed(c, df.schema[name].dataType, path[1:], condition, None))
            elif (gone := _gone(c, condition, None)) is None:
                df = df.drop(name)
            else:
                df = df.withColumn(name, F.when(~gone, c))
    return df


def safe_key(key: str | Column) -> Column:
    return F.regexp_replace(F.lit(key) if isinstance(key, str) else key, UNSAFE, "_")


def _safe_names(names: Sequence[str]) -> dict[str, str]:
    """New name to the first name that gives it, for those that are not there yet."""
    out: dict[str, str] = {}
    for n in names:
        new = "".join("_" if x in "'\"`" else x for x in n)
        if new not in names:
            out.setdefault(new, n)
    return out


def _sanitised(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        own = {n: _sanitised(v, kind[n].dataType) for n, v in _named(kind, c).items()}
        own |= {new: own[old] for new, old in _safe_names(kind.names).items()}
        return F.when(c.isNotNull(), F.struct(*[v.alias(n) for n, v in own.items()]))
    if isinstance(kind, T.ArrayType):
        return c if _flat(kind) else F.transform(c, lambda x: _sanitised(x, kind.elementType))
    if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
        values = c if _flat(kind.valueType) else F.transform_values(c, lambda _, v: _sanitised(v, kind.valueType))

        def added(done: Column, entry: Column) -> Column:
            key = safe_key(entry["key"])
            return F.when(F.map_contains_key(done, key), done).otherwise(F.map_concat(done, F.create_map(key, entry["value"])))

        # Each key that is new joins the map, so the first of those that give it wins.
        return F.aggregate(F.filter(F.map_entries(values), lambda e: e["key"].rlike(UNSAFE)), values, added)
    return c


def _flat(kind: T.DataType) -> bool:
    """Whether a type holds no keys."""
    return _flat(kind.elementType) if isinstance(kind, T.ArrayType) else not isinstance(kind, T.StructType | T.MapType)


def sanitised(df: DataFrame) -> DataFrame:
    """``df`` with sanitised keys at every depth beside the original ones; columns are keys as well."""

    def quoted(name: str) -> Column:
        return F.col("`" + name.replace("`", "``") + "`")

    own = {n: quoted(n) if _flat(df.schema[n].dataType) else _sanitised(quoted(n), df.schema[n].dataType) for n in df.columns}
    own |= {new: own[old] for new, old in _safe_names(df.columns).items()}
    return df.select(*[v.alias(n) for n, v in own.items()])
