"""The fold of JSON schemas against a walk over parsed texts."""

import json
import random

from pyspark.sql import functions as F

from heddle.functions import schemas as S


def walk(value, path=()):
    kind = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, int | float) else "string" if isinstance(value, str) else "array" if isinstance(value, list) else "object"
    yield path, kind
    for key, inner in value.items() if isinstance(value, dict) else (("[]", x) for x in value) if isinstance(value, list) else ():
        yield from walk(inner, (*path, key))


def made(draw, depth=0):
    kind = draw.choice("nbist" + ("ao" * 2 if depth < 4 else ""))
    if kind == "o":
        return {draw.choice(("a", "b", "k.x", "it's", "é", "")): made(draw, depth + 1) for _ in range(draw.randrange(4))}
    if kind == "a":
        return [made(draw, depth + 1) for _ in range(draw.randrange(4))]
    return {"n": None, "b": draw.random() < 0.5, "i": draw.choice((1, -(10**20), 2.5, 1e300)), "s": draw.choice(("", "text", "2024-01-01", "7")), "t": 0}[kind]


def test_bits_equal_walk(spark):
    draw = random.Random(6)
    values = [made(draw) for _ in range(300)]
    df = spark.createDataFrame([(json.dumps(v),) for v in values] + [(None,), ("",), ("{broken",)], "`the text` string").repartition(5)
    want = {}
    for v in values:
        for path, kind in walk(v):
            want[path] = want.get(path, 0) | S.JSON_TYPES[kind]
    got = S.type_bits(df, "the text")
    assert {tuple(r.path): r.bits for r in got.collect()} == want and got.count() == len(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert S.type_bits(df.limit(0), "the text").count() == 0


def test_schema_of_the_fold(spark):
    texts = ['{"i": 1, "n": null, "l": [1, null], "m": "x", "o": {"p": true}, "e": []}', '{"i": 2.5, "n": null, "l": [], "m": 3, "o": [4]}', "[1", None]
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    assert S.json_schema(S.type_bits(df, "j")) == {
        "type": "object",
        "properties": {
            "e": {"type": ["array", "null"]}, "i": {"type": ["number", "null"]}, "l": {"type": ["array", "null"], "items": {"type": ["number", "null"]}}, "m": {"type": ["number", "string", "null"]},
            "o": {"anyOf": [{"type": "array", "items": {"type": ["number", "null"]}}, {"type": "object", "properties": {"p": {"type": ["boolean", "null"]}}}, {"type": "null"}]},
        },
    }
    assert S.inferred_schema(df, "j").simpleString() == "struct<e:array<string>,i:double,l:array<double>,m:string,o:string>"
    assert S.inferred_schema(df.limit(0), "j").fields == [] and S.json_schema(S.type_bits(df.limit(0), "j")) == {"type": "object", "properties": {}}


def test_types_by_name(spark):
    assert spark.range(64).select(S.types_of(F.col("id").cast("int")).alias("t")).where("size(t) <> bit_count(id)").count() == 0


def test_head_of_files(spark, tmp_path):
    """No file weighs more than its first bytes; a line that begins within them counts whole."""
    for name, lines in (("a", ["x" * 9] * 10), ("b", ["y" * 100, "z"]), ("c", [])):
        (tmp_path / name).write_text("".join(f"{x}\n" for x in lines))
    got = {}
    for r in S.head_of_files(spark, f"file://{tmp_path}", 30).collect():
        got.setdefault(r.file[-1], []).append(r.value)
    assert got == {"a": ["x" * 9] * 3, "b": ["y" * 100]}
