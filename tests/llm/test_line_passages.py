"""Line deduplication against a brute-force search for repeated passages of several lines."""

import random

from heddle.llm import line_dedup as L
from heddle.llm.queries import QUERIES
from tests.conftest import SF


def lines_of(text):
    """(start, end, line) of the lines with words; the end includes the newline."""
    out, at = [], 0
    for line in (text or "").split("\n"):
        if line.strip():
            out.append((at, min(at + len(line) + 1, len(text))))
        at += len(line) + 1
    return out


def brute(docs):
    """{(doc, line start)} of all lines in a passage of two lines or more that stands earlier, byte by byte."""
    seen, gone = set(), set()
    for d, text in sorted(docs):
        own = lines_of(text)
        for (a, _), (b, end) in zip(own, own[1:]):
            piece = text[a:end].removesuffix("\n")
            if piece in seen:
                gone |= {(d, a), (d, b)}
            seen.add(piece)
    return gone


def removed(docs, spans):
    texts = dict(docs)
    return {(d, a) for d, start, end in spans for a, b in lines_of(texts[d]) if start <= a and b <= end}


def check(docs, rows):
    texts = dict(docs)
    assert removed(docs, [(r.doc_id, r.start, r.end) for r in rows]) == brute(docs)
    for r in rows:
        here, there = texts[r.doc_id][r.start : r.end], texts[r.keep_doc_id][r.keep_start : r.keep_end]
        assert here.removesuffix("\n") == there.removesuffix("\n")
        assert r.lines == sum(r.start <= a and b <= r.end for a, b in lines_of(texts[r.doc_id])) > 0
    at = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start >= at.get(r.doc_id, 0)
        at[r.doc_id] = r.end


def test_query_finds_every_repeated_passage(spark, duck):
    check(duck.sql("SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL").fetchall(), QUERIES["op3_line_dedup"](spark, SF).collect())


def test_short_passages_amid_other_text_go(spark, tmp_path):
    rng = random.Random(5)
    line = lambda: " ".join(f"w{rng.randrange(9**6)}" for _ in range(8))
    docs = []
    for g in range(25):
        passage = "\n".join(line() for _ in range(2 + g % 5))
        for i in range(3):
            docs.append((g * 10 + i, "\n".join([line(), line(), passage, "", line()])))
    docs += [(900, "x\nx\nx\nx\ny"), (901, "x\ny\nx\ny"), (902, ""), (903, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op3_line_dedup"](spark, str(tmp_path)).collect()
    check(docs, rows)
    assert sum(r.lines for r in rows if r.doc_id < 900) == sum(2 * (2 + g % 5) for g in range(25))


def test_no_line_is_lost_everywhere(spark):
    docs = [(1, "a\nb"), (2, "a\nb\nc"), (3, "b\nc\nd"), (4, "c\nd")]
    out = {r.doc_id: r.text for r in L.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out == {1: "a\nb", 2: "c", 3: "d", 4: ""}
