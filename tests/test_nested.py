"""Nested rewriting against plain dictionaries."""

import copy
import json
import random

import pytest
from pyspark.sql import functions as F

from heddle.operators import nested as N

KIND = "id long, r struct<a:struct<b:long,c:string>,t:array<string>,l:array<struct<x:long,y:string>>,m:map<string,string>,d:map<string,struct<p:long>>>"


def records(n=60):
    draw = random.Random(4)
    out = []
    for i in range(n):
        lines = [None if draw.random() < 0.2 else {"x": draw.randrange(9), "y": draw.choice(("u", None, "v"))} for _ in range(draw.randrange(4))]
        r = {
            "a": draw.choice((None, {"b": i, "c": None}, {"b": None, "c": "s"})), "t": draw.choice((None, [], ["p"], ["p", None, "q", "r"])), "l": draw.choice((None, lines)),
            "m": draw.choice((None, {}, {"k": "1", "it's": "2"}, {"a`b": "3", 'a"b': "4", "k": None})), "d": draw.choice((None, {"one": {"p": 1}, "t'o": None})),
        }
        out.append((i, None if draw.random() < 0.1 else r))
    return out


def plain(x):
    if hasattr(x, "asDict"):
        return {k: plain(v) for k, v in x.asDict().items()}
    return {k: plain(v) for k, v in x.items()} if isinstance(x, dict) else [plain(v) for v in x] if isinstance(x, list) else x


def result(df):
    return {r.id: plain(r)["r"] for r in df.collect()}


def put(node, path, value):
    """A value at a path, with parents made and arrays grown; nodes are records of fixed keys, so siblings get the key too."""
    if not path:
        return value
    if isinstance(path[0], int):
        node = list(node or [])
        node += [None] * (path[0] + 1 - len(node))
        node[path[0]] = put(node[path[0]], path[1:], value)
        return node
    node = dict(node or {})
    node[path[0]] = put(node.get(path[0]), path[1:], value)
    return node


EMPTY = {"a": None, "t": None, "l": None, "m": None, "d": None}


@pytest.mark.parametrize("path", [["r", "a", "c"], ["r", "t", 0], ["r", "t", 3], ["r", "m", "k"], ["r", "m", "new"], ["r", "new", "deep", 2, "er"], ["r", "d", "one", "p"], ["r", "d", "new", "p"]])
def test_set(spark, path):
    rows = records()
    value = F.col("id").cast("long") if path[-1] == "p" else F.concat(F.lit("v"), F.col("id"))
    got = result(N.set_fields(spark.createDataFrame(rows, KIND), [(path, value)]))
    for i, r in rows:
        want = put({"r": copy.deepcopy(r)}, path, i if path[-1] == "p" else f"v{i}")["r"]
        for k, v in {**EMPTY, "a": None}.items():
            want.setdefault(k, v)
        if path[1] == "a":
            want["a"] = {"b": None} | want["a"]
        assert got[i] == want


def test_set_in_one_element_gives_the_field_to_all(spark):
    df = spark.createDataFrame([(1, {"l": [{"x": 1, "y": "a"}, None, {"x": 3, "y": None}]}), (2, None)], KIND)
    got = result(N.set_fields(df, [(["r", "l", 2, "z", "w"], F.lit(7)), (["r", "l", "*", "y"], F.lit("all"))]))
    # The wildcard makes records of elements that were null; the position does not touch its neighbours.
    assert got[1]["l"] == [{"x": 1, "y": "all", "z": None}, {"x": None, "y": "all", "z": None}, {"x": 3, "y": "all", "z": {"w": 7}}]
    assert got[2]["l"] == [{"x": None, "y": "all", "z": None}, {"x": None, "y": "all", "z": None}, {"x": None, "y": "all", "z": {"w": 7}}]


def test_set_errors(spark):
    df = spark.createDataFrame([(1, None)], KIND)
    for path in (["r", "a", "b", "c"], ["r", "t", "name"], ["r", "a", 0], [0], []):
        with pytest.raises(ValueError, match="lead|path"):
            N.set_fields(df, [(path, F.lit(1))])


def test_remove(spark):
    rows = records()
    paths = [["r", "a", "c"], ["r", "t", 1], ["r", "m", "k"], ["r", "l", 0, "x"], ["r", "d", "*", "p"], ["r", "nothing", "here"], ["r", "t", "name"], ["r", "a", "b", "c"], ["none"]]
    got = result(N.remove_fields(spark.createDataFrame(rows, KIND), paths))
    for i, r in rows:
        want = copy.deepcopy(r)
        if want is not None:
            if want["a"]:
                del want["a"]["c"]
            if want["t"] and len(want["t"]) > 1:
                want["t"][1] = None
            if want["m"]:
                want["m"].pop("k", None)
            if want["l"] and want["l"][0]:
                want["l"][0]["x"] = None
            if want["d"]:
                want["d"] = {k: v and {} for k, v in want["d"].items()}
        assert got[i] == want


def test_remove_by_condition(spark):
    rows = records()
    df = spark.createDataFrame(rows, KIND)
    got = result(N.remove_fields(df, [["r", "t", "*"], ["r", "m", "*"], ["r", "l", "*", "y"]], lambda v: v.isin("p", "2", "u")))
    for i, r in rows:
        want = copy.deepcopy(r)
        if want is not None:
            want["t"] = want["t"] and [None if v == "p" else v for v in want["t"]]
            want["m"] = want["m"] and {k: v for k, v in want["m"].items() if v != "2"}
            want["l"] = want["l"] and [x and x | {"y": None if x["y"] == "u" else x["y"]} for x in want["l"]]
        assert got[i] == want
    assert N.remove_fields(df, [["id"]]).columns == ["r"]
    assert N.remove_fields(df, [["id"]], lambda v: v < 3).where("id IS NULL").count() == 3


def clean(node):
    if isinstance(node, list):
        return [clean(x) for x in node]
    if not isinstance(node, dict):
        return node
    out = {k: clean(v) for k, v in node.items()}
    for k, v in node.items():
        out.setdefault("".join("_" if x in "'\"`" else x for x in k), clean(v))
    return out


def test_sanitised(spark):
    rows = records()
    df = spark.createDataFrame(rows, KIND).withColumn("q'q", F.struct(F.lit(1).alias("x`y"), F.array(F.struct(F.lit(2).alias('z"'))).alias("in")))
    out = N.sanitised(df)
    assert out.columns == ["id", "r", "q'q", "q_q"]
    # Spark's own order of a map's keys decides which of two comes first.
    assert result(out) == {i: clean(r) for i, r in result(df).items()}
    one = plain(out.first())
    assert one["q_q"] == one["q'q"] == {"x`y": 1, "x_y": 1, "in": [{'z"': 2, "z_": 2}]}


def test_no_python_on_rows(spark):
    df = N.sanitised(N.remove_fields(N.set_fields(spark.createDataFrame(records(), KIND), [(["r", "m", "k"], F.lit("1"))]), [["r", "t", 0]]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert json.dumps(plain(df.first()))
