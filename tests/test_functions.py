"""Column functions and schema functions, case by case."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.functions import names as M
from heddle.functions import schemas as S
from heddle.functions import values as V


@pytest.fixture(scope="module")
def one(spark):
    def get(column, **values):
        df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
        return df.select(column).first()[0]

    return get


def test_surrogate_key_reads_null_as_empty(one):
    import hashlib

    assert one(V.surrogate_key(["a", "b"]), a="x", b=None) == hashlib.md5(b"x-").hexdigest()


def test_concat_is_null_with_a_null(one):
    assert one(V.concat_fields(["a", "b"]), a="x", b=None) is None


@pytest.mark.parametrize(("text", "fmt", "want"), [
    ("1700000000", "%s", dt.datetime(2023, 11, 14, 22, 13, 20)), ("1700000000123", "%ms", dt.datetime(2023, 11, 14, 22, 13, 20, 123000)),
    ("2024-02-03", "%Y-%m-%d", dt.datetime(2024, 2, 3)), ("nonsense", "%Y-%m-%d", None),
])
def test_parse_datetime(one, text, fmt, want):
    got = one(V.parse_datetime("t", fmt).cast("timestamp_ntz"), t=text)
    assert got == want


def test_duration(one):
    assert one(V.duration("P1DT2H")) == dt.timedelta(days=1, hours=2)
    with pytest.raises(ValueError):
        V.duration("nothing")


def test_lsn_round_trip(one):
    assert one(V.lsn_to_long("a"), a="16/B374D848") == (0x16 << 32) + 0xB374D848
    assert one(V.long_to_lsn(V.lsn_to_long("a")), a="16/B374D848") == "16/B374D848"


def test_empty_string_to_null(one):
    assert one(V.empty_string_to_null("a"), a="") is None
    assert one(V.empty_string_to_null("a", ("null",)), a="null") is None
    assert one(V.empty_string_to_null("a"), a="null") == "null"


@pytest.mark.parametrize(("url", "want"), [("https://github.com/a/b.git", "a/b"), ("upload://x", "upload/x"), (None, "unknown")])
def test_repo_namespace(one, url, want):
    assert one(M.repo_namespace(F.lit(url))) == want


def test_unique_names_differ_without_case():
    assert M.unique_names(["HKD", "hkd", "Hkd"]) == {"HKD": "HKD", "hkd": "hkd_1", "Hkd": "Hkd_2"}
    long = M.unique_names(["x" * 80])["x" * 80]
    assert len(long) <= 63


def test_clean_keys_keep_the_originals(one):
    got = one(M.with_clean_keys(F.create_map(F.lit("a'b"), F.lit("1"), F.lit("c"), F.lit("2"))))
    assert got == {"a'b": "1", "c": "2", "a_b": "1"}


@pytest.mark.parametrize(("text", "want"), [
    ("May send the orders through a queue.", "send the orders"), ("reads", "reads"), ("one two three four five six seven eight", "one two three four five six"),
])
def test_compact_label(one, text, want):
    assert one(M.compact_label("t"), t=text) == want


def test_named_volume(one):
    assert one(M.named_volume("v"), v="data:/var/lib") == "data"
    assert one(M.named_volume("v"), v="./local:/var/lib") is None


@pytest.mark.parametrize(("schema", "want"), [
    ({"type": ["null", "string"]}, "STRING"), ({"type": ["string", "integer"]}, "STRING"), ({"type": ["object", "string"]}, "STRUCT"), ({"type": ["array", "object"]}, "ARRAY"),
    ({"type": "string", "format": "date-time"}, "TIMESTAMP_WITH_TIMEZONE"), ({"type": "number", "catalog_type": "integer"}, "INTEGER"), ({}, "UNKNOWN"), ({"oneOf": []}, "UNSUPPORTED_ONE_OF"),
])
def test_logical_type(schema, want):
    assert S.logical_type(schema) == want


def test_spark_type_keeps_order():
    kind = S.spark_type({"type": "object", "properties": {"b": {"type": "integer"}, "a": {"type": "array", "items": {"type": "number"}}}})
    assert kind == T.StructType([T.StructField("b", T.LongType()), T.StructField("a", T.ArrayType(T.DoubleType()))])


def test_inference_widens_integers(spark):
    df = spark.createDataFrame([('{"a": 1, "b": null}',), ('{"a": 2, "c": "x"}',)], "j string")
    kind = S.inferred_schema(df, "j")
    assert kind["a"].dataType == T.DoubleType() and "b" not in kind.names and kind["c"].dataType == T.StringType()


def test_datetime_formats(spark):
    df = spark.createDataFrame([("2024-01-02", "x"), ("2024-01-03", "y")], "a string, b string")
    r = S.datetime_formats(df, ["a", "b"]).first()
    assert (r.a, r.b) == ("%Y-%m-%d", None)


def test_values_are_parsed_once(spark):
    """Formats are tried on the distinct values of each column; a null fits no format."""
    df = spark.range(1000).selectExpr("date_format(date_add(DATE'2024-01-01', int(id % 7)), 'dd/MM/yyyy') AS a", "IF(id = 5, NULL, '2024-01-01') AS b", "IF(id % 2 = 0, '2024-01-01', '20240101') AS c")
    out = S.datetime_formats(df, ["a", "b", "c"])
    assert tuple(out.first()) == ("%d/%m/%Y", None, None) and tuple(S.datetime_formats(df.limit(0), ["a"]).first()) == (None,)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 2
