"""The pipeline, stage by stage, against brute-force versions."""

from pathlib import Path

import pytest

import corpus_pipeline as P
from heddle.llm.common import scratch, shared_dir, table, written
from tests.conftest import SF
from tests.llm.test_line_passages import brute, lines_of
from tests.llm.test_near_copies import groups
from tests.llm.test_text import check_mix, check_packing


def test_stages_equal_brute_force(spark, duck):
    docs, kept = table(spark, SF, "documents"), {}
    for name, stage in P.STAGES:
        out = written(stage(spark, docs, SF), "test")
        if name != "packing":
            assert out.columns == list(P.COLUMNS)
        before, kept = kept, out.collect()
        if name == "quality rules":
            from heddle.llm.quality_rules import OP10_SQL

            assert {r.doc_id for r in kept} == {d for (d,) in duck.sql(f"SELECT doc_id FROM ({OP10_SQL}) WHERE kept").fetchall()}
        if name == "line dedup":
            gone = brute([(r.doc_id, r.text) for r in before])
            want = {r.doc_id: [r.text[a:b].removesuffix("\n") for a, b in lines_of(r.text) if (r.doc_id, a) not in gone] for r in before}
            assert {r.doc_id: [x for x in r.text.split("\n") if x.strip()] for r in kept} == {d: x for d, x in want.items() if x}
            assert all(r.n_chars == len(r.text) for r in kept)
        if name == "near-dedup":
            own = sorted(before, key=lambda r: r.doc_id)
            root = groups([r.text for r in own])
            stay = {r.doc_id for r in kept}
            assert {own[i].doc_id for i, k in enumerate(root) if i == k} <= stay
            away = [own[i].doc_id for i, k in enumerate(root) if i != k]
            assert sum(d not in stay for d in away) >= 0.9 * len(away)
        if name == "mixing":
            from heddle.llm.mixing import mix

            rows = mix(docs).collect()
            check_mix(rows)
            assert sorted(r.doc_id for r in kept) == sorted(r.doc_id for r in rows for _ in range(r.copies))
        if name == "packing":
            once = {r.doc_id: r.text for r in before}
            twice = {r.doc_id for r in before if sum(x.doc_id == r.doc_id for x in before) > 1}
            check_packing([p for p in kept], [(r.doc_id, r.text) for r in before])
            assert {p.doc_id for p in kept} == set(once) and twice
        docs = out


def test_pipeline_takes_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in P.STAGES[:4]:
            docs = written(stage(spark, docs, SF), "odd")
            assert docs.columns == list(P.COLUMNS)
        P.packing(spark, docs, SF).collect()


def test_each_stage_takes_odd_rows(spark, odd, empty):
    for _, stage in P.STAGES:
        stage(spark, odd, SF).collect()
        assert stage(spark, empty, SF).collect() == []


def tables_of(spark):
    return set(Path("/" + shared_dir(spark).removeprefix("file:").lstrip("/")).glob("heddle-*"))


@pytest.mark.parametrize(("stage", "left"), [(P.line_chunks, "cuts"), (P.near_dedup, "touched")])
def test_stages_leave_one_table(spark, stage, left):
    """Tables that the result does not read would lie beside those of the next stage."""
    before = tables_of(spark)
    out = stage(spark, table(spark, SF, "documents"), SF)
    (made,) = tables_of(spark) - before
    assert made.name.startswith(f"heddle-{left}-") and out.count() > 0


def test_scratch_deletes_what_is_not_kept(spark):
    before = tables_of(spark)
    with scratch() as keep:
        with scratch() as inner:
            a, b = inner(written(spark.range(3), "a")), written(spark.range(3), "b")
            assert b.count() == 3
        assert a.count() == 3
        c = keep(written(a, "c"))
    assert c.count() == 3 and {t.name.split("-")[1] for t in tables_of(spark) - before} == {"c"}
    with pytest.raises(ZeroDivisionError), scratch():
        written(c, "d")
        1 / 0  # noqa: B018
    assert {t.name.split("-")[1] for t in tables_of(spark) - before} == {"c"}
