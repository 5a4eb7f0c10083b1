"""Fill-in-the-middle against plain Python, its inverse, and its odd cases."""

import hashlib
import re

from pyspark.sql import functions as F

from heddle.llm import fill_in_middle as M

MARKED = re.compile("<[PSM]>")


def expected(name, text):
    """(n, form, prefix, middle, suffix, output) by the contract."""
    text = text or ""
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if name is None else name}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(tokens)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or MARKED.search(text) or h[2] % 100 >= 90:
        return n, "plain", None, None, None, text
    prefix, middle, suffix = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if h[3] % 100 < 20:
        return n, "spm", prefix, middle, suffix, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", prefix, middle, suffix, f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(df):
    out = M.fill_in_middle(df, into="_fim")
    rows = out.select("doc_id", "text", "_fim.*", M.restored(F.col("_fim.output"), F.col("_fim.form")).alias("back")).collect()
    for r in rows:
        assert tuple(r)[2:8] == expected(r.doc_id, r.text)
        assert r.back == (r.text or "")
    return out, rows


def test_odd_rows(odd, empty):
    out, rows = check(odd)
    assert out.columns == [*odd.columns, "_fim"] and len(rows) == odd.count()
    assert all(r["n"] == "x" for r in out.select("row", F.col("_in").alias("n")).collect())
    assert M.fill_in_middle(empty).count() == 0


def test_marks_signs_and_many_ids(spark):
    texts = ["a<P>b", "<M>", "<S", "<<", "<S<M>", "P>x<", "a\x00b\x00", "\r\n\x0b", "\U0001d4b3é日 abc", "<p>"]
    rows = [(7 * i - 3, texts[i % len(texts)] + " word" * (i % 5)) for i in range(1500)]
    _, out = check(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.form for r in out} == {"plain", "psm", "spm"}


def test_slices_by_bytes(spark, monkeypatch):
    """Texts longer than a slice go alone; nothing is lost at the edges."""
    monkeypatch.setattr(M, "SLICE_BYTES", 100)
    rows = [(i, "word, " * (i * 13 % 60)) for i in range(300)] + [(i, None) for i in range(5)]
    _, out = check(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert len(out) == 305


def test_query_equals_sql(spark, duck, same):
    same(M.op11_fill_in_middle(spark, "/root/testdata/sf0.001"), duck.sql(M.OP11_SQL))
