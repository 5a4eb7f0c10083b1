"""Fill-in-the-middle transformation by DuckDB inside ``mapInArrow``.

Each Arrow batch is registered with an in-memory DuckDB of the Python worker, and one SQL statement cuts, shuffles and
marks all its texts: ``regexp_extract_all`` gives the tokens, ``list_slice`` and ``array_to_string`` the three parts,
``sha256`` of the id the draws. The answer goes back as Arrow; no row becomes a Python object.

A text of n tokens is cut after the smaller and the larger of two draws from 0 to n tokens. Most texts are written prefix,
suffix, middle (``psm``), some suffix, prefix, middle (``spm``), the rest stay as they are (``plain``): every tenth or so by
draw, empty texts, and texts that hold a mark themselves, which could not be read back.

Memory: batches are cut by bytes before DuckDB sees them; a longer text goes alone. A token of one sign takes some 16
bytes in DuckDB, so a slice needs about 20 times SLICE_BYTES, or 20 times its one text.

Defined results: a null text is empty; a null id draws as the string ``1:``; repeated rows give repeated results and rows
with equal ids equal draws; an empty table gives an empty result; other columns are kept, whatever their names, and the
results come in one struct whose name the caller chooses.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import table

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of 100 texts, how many stay plain by draw, and how many of the others are written suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Bytes of text that DuckDB gets at once.
SLICE_BYTES = 1 << 20

PARTS = "n:long,form:string,prefix:string,middle:string,suffix:string,output:string"


def cut_sql(seed: str, plain_percent: int, spm_percent: int) -> str:
    """SQL over the registered ``batch`` (row, id, text), in the order of row."""
    has_mark = " OR ".join(f"contains(text, '{m}')" for m in MARKS)
    draws = ", ".join(f"('0x' || substr(h, {1 + 8 * i}, 8))::UBIGINT AS h{i + 1}" for i in range(4))
    part = "array_to_string(list_slice(tokens, {}, {}), '')".format
    p, s, m = MARKS
    return f"""
    WITH tokenized AS (
        SELECT "row", text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS tokens, sha256('{seed}:' || coalesce(id::VARCHAR, '')) AS h
        FROM (SELECT "row", id, coalesce(text, '') AS text FROM batch)
    ), drawn AS (
        SELECT *, len(tokens)::UBIGINT AS n, {draws} FROM tokenized
    ), cut AS (
        SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
            CASE WHEN text = '' OR {has_mark} OR h3 % 100 >= {100 - plain_percent} THEN 'plain' WHEN h4 % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form
        FROM drawn
    ), parts AS (
        SELECT "row", text, n, form,
            CASE WHEN form <> 'plain' THEN {part("1", "a::BIGINT")} END AS prefix,
            CASE WHEN form <> 'plain' THEN {part("a::BIGINT + 1", "b::BIGINT")} END AS middle,
            CASE WHEN form <> 'plain' THEN {part("b::BIGINT + 1", "n::BIGINT")} END AS suffix
        FROM cut
    )
    SELECT n::BIGINT AS n, form, prefix, middle, suffix,
        CASE form WHEN 'plain' THEN text
            WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle
            ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END AS output
    FROM parts ORDER BY "row"
    """


def by_bytes(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most so many bytes in a text column each; a longer text is a slice of its own."""
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy(zero_copy_only=False)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(ends.searchsorted(before + most, side="right")))
        yield batch.slice(start, end - start)
        start = end


def fill_in_middle(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", into: str = "fim", seed: str = "1", plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """``df`` with the struct ``into`` (n, form, prefix, middle, suffix, output); the parts of plain texts are null."""
    sql = cut_sql(seed.replace("'", "''"), plain_percent, spm_percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""})
        for batch in batches:
            for piece in by_bytes(batch, 2, SLICE_BYTES):
                rows = pa.table({"row": pa.array(range(piece.num_rows), pa.int64()), "id": piece.column(1), "text": piece.column(2)})
                con.register("batch", rows)
                out = con.sql(sql).to_arrow_table().cast(answer).combine_chunks()
                con.unregister("batch")
                parts = pa.StructArray.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in out.columns], fields=list(answer))
                yield pa.RecordBatch.from_arrays([piece.column(0), parts], names=["_in", "_out"])
        con.close()

    answer = pa.schema([("n", pa.int64()), *((c, pa.string()) for c in ("form", "prefix", "middle", "suffix", "output"))])
    kept = F.struct(*[F.col(f"`{c}`") for c in df.columns]) if df.columns else F.struct()
    packed = df.select(kept.alias("_in"), F.col(f"`{id_col}`").cast("decimal(38,0)").cast("string").alias("_id"), F.col(f"`{text_col}`").alias("_text"))
    out = packed.mapInArrow(run, f"_in {packed.schema['_in'].dataType.simpleString()}, _out struct<{PARTS}>")
    return out.select(*[F.col(f"_in.`{c}`").alias(c) for c in df.columns if c != into], F.col("_out").alias(into))


def restored(output: Column, form: Column) -> Column:
    """The text that was cut, from what was written and its form. The text has no marks, so each mark is where it was put."""
    p, s, m = (F.lit(x) for x in MARKS)
    first = F.substring(output, F.lit(len(MARKS[0]) + 1), F.length(output))
    head, tail = F.split_part(first, F.when(form == "psm", s).otherwise(p), F.lit(1)), F.split_part(first, F.when(form == "psm", s).otherwise(p), F.lit(2))
    second, middle = F.split_part(tail, m, F.lit(1)), F.split_part(tail, m, F.lit(2))
    return F.when(form == "plain", output).when(form == "psm", F.concat(head, middle, second)).otherwise(F.concat(second, middle, head))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, cut and written for filling in the middle; digests of what was written and of what is read back."""
    fim = fill_in_middle(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"), into="fim").select("doc_id", "fim.*")
    return fim.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


#: The same by lengths of tokens and substrings of the text, without lists of parts.
OP11_SQL = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
        list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]'), lambda x: length(x)) AS sizes
    FROM documents
), d AS (
    SELECT *, len(sizes) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(sizes) + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (len(sizes) + 1) AS y,
        CASE WHEN text = '' OR regexp_matches(text, '<[PSM]>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
            WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM t
), c AS (
    SELECT *, coalesce(list_sum(sizes[1:least(x, y)]), 0)::BIGINT AS p, coalesce(list_sum(sizes[1:greatest(x, y)]), 0)::BIGINT AS q FROM d
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text
        WHEN 'psm' THEN concat('<P>', substring(text, 1, p), '<S>', substring(text, q + 1), '<M>', substring(text, p + 1, q - p))
        ELSE concat('<S>', substring(text, q + 1), '<P>', substring(text, 1, p), '<M>', substring(text, p + 1, q - p)) END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM c
"""
