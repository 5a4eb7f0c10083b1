"""Record pipelines: extract, filter, transform, conform, in that order."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions.values import safe_cast
from heddle.operators.nested import remove_fields as remove_paths
from heddle.operators.nested import set_fields


def records_at(df: DataFrame, column: str, path: Sequence[str], element: T.DataType, keep: Sequence[str] = ()) -> DataFrame:
    """Records below a path of a JSON text: the elements of an array, a single object, or none; '*' takes every member
    of an array on the way."""
    rows = df.select(*[F.col(f"`{k}`") for k in keep], F.col(f"`{column}`").alias("_v"))
    for part in path:
        if part == "*":
            rows = rows.withColumn("_v", F.explode(F.from_json("_v", "array<string>")))
        else:
            rows = rows.withColumn("_v", F.element_at(F.from_json("_v", "map<string,string>"), F.lit(part)))
    one = F.when(F.trim("_v").startswith("["), F.from_json("_v", T.ArrayType(element))).otherwise(F.array(F.from_json("_v", element)))
    return rows.where("_v IS NOT NULL AND trim(_v) <> ''").select(*[F.col(f"`{k}`") for k in keep], F.explode(one).alias("record")).where("record IS NOT NULL")


def add_fields(df: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Set fields by dotted path; parents that are missing are made. For positions and wildcards see ``nested.set_fields``."""
    return set_fields(df, [(path.split("."), value) for path, value in fields.items()])


def remove_fields(df: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Drop fields by dotted path; paths that do not exist change nothing. For more see ``nested.remove_fields``."""
    return remove_paths(df, [path.split(".") for path in paths])


def conformed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of a schema, cast where they can be and null where not."""
    have = set(df.columns)
    return df.select(*[(safe_cast(F.col(f"`{f.name}`"), f.dataType.simpleString()) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def conforming(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Rows whose values all cast: what the skip policy keeps."""
    bad = F.lit(False)
    for f in schema.fields:
        c = F.col(f"`{f.name}`")
        bad = bad | (c.isNotNull() & safe_cast(c, f.dataType.simpleString()).isNull())
    return df.where(~bad)


def within_cursor(df: DataFrame, cursor: str, start, end, state=None) -> DataFrame:
    """Rows strictly above the later of start and state and strictly below end."""
    low = F.greatest(F.lit(start), F.lit(state)) if state is not None else F.lit(start)
    return df.where((F.col(cursor) > low) & (F.col(cursor) < F.lit(end)))


# --- steps of one's own -----------------------------------------------------------------------------------------------

#: A step makes a frame of a frame: a transformation of records, or an extractor of records from responses.
Step = Callable[..., DataFrame]
_STEPS: dict[str, Step] = {}


def step(name: str) -> Callable[[Step], Step]:
    """Register a function (frame, options...) -> frame under a name that pipelines may use."""

    def register(do: Step) -> Step:
        if _STEPS.setdefault(name, do) is not do:
            raise ValueError(f"there is a step {name} already")
        return do

    return register


def applied(df: DataFrame, steps: Sequence[dict]) -> DataFrame:
    """``df`` after steps in order, each a dict of its ``type`` and options."""
    for one in steps:
        options = {k: v for k, v in one.items() if k != "type"}
        if one["type"] not in _STEPS:
            raise ValueError(f"no step {one['type']}: {sorted(_STEPS)}")
        df = df.transform(_STEPS[one["type"]], **options)
    return df


# --- templates ------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'[^']*'|\"[^\"]*\")|(?P<op>==|!=|<=|>=|<|>|\||\(|\)|\+|-|\*|/|,|\[|\])|(?P<name>[A-Za-z_][\w.]*))")


def template(text: str, record: dict[str, Column] | None = None, values: dict | None = None) -> Column:
    """A ``{{ }}`` expression as a Column: field references, literals, comparison, arithmetic, and/or/not, filters.

    ``record.x`` is a column; other names are looked up in ``values`` (config, state, slice) by dotted path. The text
    around several expressions is joined to them.
    """
    parts = re.split(r"\{\{(.*?)\}\}", text, flags=re.DOTALL)
    if len(parts) == 3 and not parts[0].strip() and not parts[2].strip():
        return _Parser(parts[1], record, values or {}).parse()
    return F.concat(*[_Parser(p, record, values or {}).parse().cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p])


class _Parser:
    """Recursive descent over the common subset of the template language."""

    def __init__(self, text: str, record: dict[str, Column] | None, values: dict) -> None:
        self.tokens, at, text = [], 0, text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ValueError(f"template: {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.record, self.values, self.at = record, values, 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise ValueError("template ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def parse(self) -> Column:
        out = self.any_()
        if self.peek() is not None:
            raise ValueError(f"template: {self.peek()!r}")
        return out

    def any_(self) -> Column:
        out = self.all_()
        while self.peek() == "or":
            self.take()
            out = out | self.all_()
        return out

    def all_(self) -> Column:
        out = self.not_()
        while self.peek() == "and":
            self.take()
            out = out & self.not_()
        return out

    def not_(self) -> Column:
        if self.peek() == "not":
            self.take()
            return ~self.not_()
        left = self.sum_()
        compare = {"==": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}
        if self.peek() in compare:
            op = self.take()[1]
            return getattr(left, compare[op])(self.sum_())
        return left

    def sum_(self) -> Column:
        out = self.product()
        while self.peek() in ("+", "-"):
            out = out + self.product() if self.take()[1] == "+" else out - self.product()
        return out

    def product(self) -> Column:
        out = self.filtered()
        while self.peek() in ("*", "/"):
            out = out * self.filtered() if self.take()[1] == "*" else out / self.filtered()
        return out

    def filtered(self) -> Column:
        from heddle.functions import values as V

        out = self.atom()
        filters = {"string": lambda c: c.cast("string"), "base64encode": V.base64encode, "base64decode": V.base64decode, "hash": V.salted_hash, "lower": F.lower, "upper": F.upper, "int": lambda c: c.try_cast("long"), "float": lambda c: c.try_cast("double"), "trim": F.trim}
        while self.peek() == "|":
            self.take()
            name = self.take()[1]
            if name not in filters:
                raise ValueError(f"no such filter: {name}")
            args = []
            if self.peek() == "(":
                self.take()
                while self.peek() != ")":
                    args.append(self.take()[1].strip("'\""))
                    if self.peek() == ",":
                        self.take()
                self.take()
            out = filters[name](out, *args)
        return out

    def atom(self) -> Column:
        kind, token = self.take()
        if kind == "num":
            return F.lit(float(token) if "." in token else int(token))
        if kind == "str":
            return F.lit(token[1:-1])
        if token == "(":
            out = self.any_()
            self.take()
            return out
        path = token.split(".")
        while self.peek() == "[":
            self.take()
            path.append(self.take()[1].strip("'\""))
            self.take()
        if token in ("true", "True", "false", "False"):
            return F.lit(token.lower() == "true")
        if token in ("none", "None"):
            return F.lit(None)
        if path[0] == "record":
            return self.record[path[1]] if self.record and path[1] in self.record else F.col(".".join(path[1:]))
        value = self.values
        for p in path:
            value = value.get(p) if isinstance(value, dict) else None
        return F.lit(value)


def filtered(df: DataFrame, condition: str, values: dict | None = None) -> DataFrame:
    """Rows for which a boolean template holds."""
    return df.where(F.coalesce(template(condition, values=values).cast("boolean"), F.lit(False)))
