"""Code elements, reports, query graphs and grouping."""

import pytest
from pyspark.sql import functions as F

from heddle.operators import architecture as X

PY = "import os\nfrom a.b import C\n\n@deco\nclass Thing(C):\n    x = 1\n    def run(self):\n        os.getcwd()\n\ndef free():\n    return Thing()\n"
JAVA = "package com.x;\nimport com.y.Z;\npublic class A extends B implements C, D {\n}\n"


def test_python_and_declared_elements(spark):
    df = spark.createDataFrame([("src/m.py", "Python", PY), ("A.java", "Java", JAVA), ("bad.py", "Python", "def ("), ("n.py", "Python", None)], "path string, language string, text string")
    got = {r.qualified_name: r for r in X.code_elements(df).collect()}
    assert set(got) == {"src.m.Thing", "src.m.free", "com.x.A"}
    assert got["src.m.Thing"].base_classes == ["C"] and got["src.m.Thing"].method_count == 1 and "os.getcwd" in got["src.m.Thing"].method_calls
    assert got["com.x.A"].base_classes == ["B", "C", "D"] and got["com.x.A"].imports == ["com.y.Z"]


@pytest.mark.parametrize("text", ["", "SELECT FROM x", "SELECT a, b* FROM x", "UPDATE x"])
def test_bad_reports(text):
    with pytest.raises(ValueError):
        X.report_query(text)


def test_report_parts():
    q = X.report_query("select a.b, c from t where x = 1 and y > 2 order by c desc limit 3 parameters include_drafts=true")
    assert q == {"fields": ["a.b", "c"], "resource": "t", "where": ("x = 1", "y > 2"), "order": "c desc", "limit": 3, "parameters": "include_drafts=true"}


def test_small_helpers():
    assert X.flat_keys({"a": {"b": 1, "c": {"d": 2}}, "e": 3}) == {"a.b": 1, "a.c.d": 2, "e": 3}
    assert X.depends_on({"db": {}}) == ["db"] and X.depends_on(["a"]) == ["a"] and X.depends_on(None) == [] and X.depends_on("x") == ["x"]


def test_query_graph_errors(spark):
    with pytest.raises(ValueError):
        X.run_query_graph({}, [])
    with pytest.raises(ValueError):
        X.run_query_graph({"t": spark.range(1)}, [{"type": "table", "name": "t"}, {"type": "what"}])


def test_cluster_names(spark):
    df = spark.createDataFrame([(["a/b/x.py", "a/b/c/y.py"], ["X"]), (["a/x.py", "b/y.py"], ["OrderStore", "OrderView"]), (["x.py", "y.py"], ["One", "Two"])], "p array<string>, n array<string>")
    assert [r[0] for r in df.select(X.cluster_name(F.col("p"), F.col("n"))).collect()] == ["B", "Order", "Component"]


def test_every_element_gets_one_group(spark):
    e = spark.createDataFrame([("a", "F", 0.9), ("b", None, None), ("c", "F", 0.1), ("d", None, None)], "id string, framework string, score double")
    edges = spark.createDataFrame([("b", "c", 1.0), ("a", "b", 1.0)], "source string, target string, weight double")
    got = {r.id: r for r in X.grouped(e, edges).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    assert got["a"].confidence == 0.3 and got["b"].group == got["c"].group and got["b"].confidence == 0.5 and got["d"].group == "single:d"
