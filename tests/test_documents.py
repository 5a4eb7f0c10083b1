"""Recursive splitting against strings, metadata, record ids; weighted selection and class rows against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from heddle.operators import analytics as A
from heddle.operators import graph as G
from heddle.sources import documents as D
from heddle.sources import sinks


def cut_strings(text, size, separators):
    """Pieces as strings, by recursion."""
    if len(text) <= size:
        return [text] if text else []
    if not separators:
        return [text[:size], *cut_strings(text[size:], size, ())]
    sep, out = separators[0], []
    parts = text.split(sep)
    for i, part in enumerate(parts):
        out += cut_strings(part + (sep if i + 1 < len(parts) else ""), size, separators[1:])
    return out


def chunk_strings(text, size, overlap, separators):
    out, held = [], []
    for piece in cut_strings(text, size, separators):
        if held and sum(map(len, held)) + len(piece) > size:
            out.append("".join(held))
            while held and (sum(map(len, held)) > overlap or sum(map(len, held)) + len(piece) > size):
                held = held[1:]
        held = [*held, piece]
    return out + (["".join(held)] if held else [])


def texts():
    draw = random.Random(7)
    out = ["", None, " ", "\n\n\n", "a" * 50, "word " * 30, "x" * 9 + "\n\n" + "y" * 9, "日本語 " * 20 + "𝒳" * 30]
    return out + ["".join(draw.choice(("a", "bc", " ", "\n", "\n\n", "é", "longerword")) for _ in range(draw.randrange(80))) for _ in range(150)]


@pytest.mark.parametrize(("size", "overlap"), [(20, 0), (20, 7), (1, 0), (33, 32), (1000, 100)])
def test_split_equals_strings(spark, size, overlap):
    rows = [(i, t, "kept") for i, t in enumerate(texts())]
    out = {}
    for r in D.split_text(spark.createDataFrame(rows, "id long, text string, `_keep` string"), "text", size, overlap).collect():
        assert r["_keep"] == "kept" and (rows[r.id][1][r.start : r.start + len(r.chunk)]) == r.chunk and 0 < len(r.chunk) <= size
        out.setdefault(r.id, []).append((r.chunk_no, r.chunk))
    for i, t, _ in rows:
        assert [c for _, c in sorted(out.get(i, []))] == chunk_strings(t or "", size, overlap, D.SEPARATORS)


def test_split_is_linear():
    import time

    def took(n):
        text, began = "word " * n + "z" * n, time.perf_counter()
        assert D.chunks(text, 100, 20)[-1][1] == len(text)
        return time.perf_counter() - began

    took(1000)
    assert took(400_000) < 60 * max(took(20_000), 0.002)


def test_split_errors_and_empty(spark):
    df = spark.createDataFrame([], "id long, text string")
    assert D.split_text(df, "text", 10).count() == 0
    for bad in (lambda: D.split_text(df, "text", 10, 10), lambda: D.split_text(df.withColumn("chunk", F.lit(1)), "text", 10)):
        with pytest.raises(ValueError, match="overlap|names"):
            bad()


def test_fixed_chunks(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "id long, text string")
    for size, overlap in ((10, 0), (10, 3), (7, 6)):
        want = []
        for i, t in rows:
            t, step = t or "", size - overlap
            want += [(i, n, t[n * step : n * step + size]) for n in range(max(-(-(len(t) - overlap) // step) - 1, 0) + 1)]
        assert sorted(map(tuple, sinks.split_documents(df, ["id"], "text", size, overlap).collect())) == sorted(want)


def test_documents(spark):
    df = spark.createDataFrame([(1, "Title", "body text", 3, 2.5, True, [1]), (2, None, None, None, None, None, None), (None, None, "x", 12345678, 1.0, False, [])], "id long, title string, body string, n long, x double, b boolean, l array<long>")
    got = {(r.record_id, r.chunk_no): (r.metadata, r.chunk) for r in D.documents(df, "s", ["title", "body"], ["id", "zz"], 16, most=8).collect()}
    assert got == {("s_1___not_found__", 0): ({"id": "1", "n": "3"}, "title: Title\n"), ("s_1___not_found__", 1): ({"id": "1", "n": "3"}, "body: body text"), ("s___not_found_____not_found__", 0): ({"x": "1.0"}, "body: x")}
    whole = df.select(D.metadata(df, ["title"]).alias("m")).collect()
    assert whole[0].m == {"id": "1", "body": "body text", "n": "3", "x": "2.5", "b": "true"} and whole[1].m == {"id": "2"}


@pytest.mark.parametrize("share", [0.5, 0.9, 0.01, 1.0])
def test_heaviest_equals_sorting(spark, share):
    draw = random.Random(4)
    rows = [("a", draw.randrange(5)) for _ in range(200)] + [("b", draw.choice((1, 10**6, 10**12))) for _ in range(100)] + [(None, 7), (None, None), ("c", 0), ("c", 0), ("d", -3), ("e", 2**40)]
    want = {}
    for g in {r[0] for r in rows}:
        own = sorted((max(w or 0, 0) for k, w in rows if k == g), reverse=True)
        want[g] = next(i for i in range(1, len(own) + 1) if sum(own[:i]) >= share * sum(own))
    out = A.heaviest(spark.createDataFrame(rows, "g string, w long").repartition(4), ["g"], "w", share)
    assert {r.g: r.selected for r in out.collect()} == want
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
    assert A.heaviest(spark.createDataFrame([], "g string, w long"), ["g"], "w", share).count() == 0


def test_directory_classes_equal_pairs(spark):
    draw = random.Random(9)
    paths = {"/".join(["", *(draw.choice("abc") for _ in range(draw.randrange(5))), f"f{i}"]) for i in range(160)}
    df = spark.createDataFrame([(p, p, i) for i, p in enumerate(sorted(paths))], "name string, path string, place int")
    edges = G.directory_edges(df, "name", "path", "place", most=3).collect()
    place = lambda p: tuple(x for x in p.split("/")[:-1] if x)
    links, near = {}, {}
    for e in edges:
        links["/".join(place(e.source))] = links.get("/".join(place(e.source)), 0) + 1
        near.setdefault("/".join(place(e.source)), set()).add(e.target)
    got = {r.dir: (r.members, r.near, r.links) for r in G.directory_classes(df, "name", "path", "place", most=3).collect()}
    assert {d: x[2] for d, x in got.items() if x[2]} == links and len(got) == len({place(p) for p in paths})
    assert all(len(near.get(d, set()) | ({"self"} if x[0] == 1 else set())) == x[1] for d, x in got.items() if x[2])


def test_value_classes_equal_pairs(spark):
    draw = random.Random(5)
    rows = [(draw.choice((None, *range(30))), draw.choice((None, "hot", "hot", "x", "y"))) for _ in range(200)]
    df = spark.createDataFrame(rows, "o long, v string")
    pairs = {}
    for r in G.shared_values(df, "o", "v").collect():
        pairs[r.v] = pairs.get(r.v, 0) + 1
    assert {r.v: r.links for r in G.shared_value_classes(df, "o", "v").collect()} == pairs
