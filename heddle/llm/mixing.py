"""Mixing sources to target weights by pivotal dependent rounding.

Each source has a target of words. A document of a source wants target / source size copies: the whole part is settled,
the fraction is rounded so that a source's words stay at its target. Two documents with open fractions trade word mass
at random until one of them is integral; the other stays open and meets the next. Mass is kept exactly and every
fraction is kept in expectation. Groups of documents do this on their own and leave one open document each; those meet
in a reduction tree of fixed fan-in until one per source is left, so a source's words miss its target by less than one
document.

Defined results: a null text has size 0; documents of size 0 take no words; null sources are one source, the last; null
ids and repeated rows are documents like any other; rows that tie in id, size and source are drawn in any order, which
changes no count of copies; a very long text is one document; columns to carry are packed, so their names meet none used
here; an empty table gives an empty result. Draws depend on nothing but
ids, sizes and the seed: reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.llm.common import in_batches, slices, table, words, written

#: Weights of the sources in their order, repeating; share of all words to take; most copies of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
#: Rows of a first-level group on average, and open documents that meet at each node of the tree.
GROUP_ROWS, FAN_IN = 256, 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources by code point, null last, get the weights in turn. Targets are proportional to weight but for those that
    stop at ``most`` times their size; what those leave over goes to the others by weight, again and again. That ends
    where every open source has weight * level with one level: with sources in order of cap / weight, a source is
    capped if the level that is left when all before it are capped reaches its own. One row per source is sorted, not
    one per document.
    """
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    before = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("weight") < F.col("cap"))
    ratio = F.col("cap") / F.col("weight")
    last = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), ratio)).over(whole)
    target = F.when(last.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * last))
    return levels.select("source", "source_size", target.alias("target"))


def _draw(seed: int, a: int, b: int) -> float:
    """Uniform in [0, 1) from a seed and two integers."""
    mask = (1 << 64) - 1
    x = (seed * 0x9E3779B97F4A7C15 + a * 0xBF58476D1CE4E5B9 + b * 0x94D049BB133111EB) & mask
    for shift in (30, 27, 31):
        x = ((x ^ (x >> shift)) * 0xD6E8FEB86659FD93) & mask
    return (x >> 11) / float(1 << 53)


def trade(f: float, s: int, g: float, t: int, u: float) -> tuple[float, float]:
    """New fractions of two open documents of sizes s and t: one becomes 0 or 1, f * s + g * t stays."""
    up, down = min((1 - f) * s, g * t), min(f * s, (1 - g) * t)
    if u * (up + down) < down:  # the first gains `up` with chance down / (up + down)
        return (1.0, g - up / t) if (1 - f) * s <= g * t else (f + up / s, 0.0)
    return (0.0, g + down / t) if f * s <= (1 - g) * t else (f - down / s, 1.0)


def _reduce(seed: int, final: bool):
    """Arrow function over (node, key, doc_id, size, part, frac, ...) sorted by node: settles all but one of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = held = None
        schema = None

        def row(values: dict, frac: float) -> dict:
            whole = frac <= 1e-12 or frac >= 1 - 1e-12
            if whole:
                frac = float(round(frac))
            elif final:
                whole, frac = True, float(_draw(seed, values["key"], values["size"]) < frac)
            return values | {"frac": frac, "settled": whole}

        for batch in slices(batches):
            schema, out = batch.schema, []
            for values in batch.to_pylist():
                if held and values["node"] != node:
                    out.append(row(held, held["frac"]))
                    held = None
                node, f = values["node"], values["frac"]
                if values["size"] == 0 or f <= 0.0 or f >= 1.0:
                    out.append(row(values, 0.0 if values["size"] == 0 else f))
                elif held is None:
                    held = values
                else:
                    u = _draw(seed, held["key"] ^ (values["key"] << 1), held["size"] + values["size"])
                    a, b = trade(held["frac"], held["size"], f, values["size"], u)
                    held["frac"], values["frac"] = a, b
                    if not 1e-12 < a < 1 - 1e-12:
                        out.append(row(held, a))
                        held = values
                        if not 1e-12 < b < 1 - 1e-12:
                            out.append(row(held, b))
                            held = None
                    else:
                        out.append(row(values, b))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if held:
            yield pa.RecordBatch.from_pylist([row(held, held["frac"])], schema=schema)

    return run


def mix(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: bool = False) -> DataFrame:
    """One row per row of ``df``: doc_id, source, size, source_size, target, copies (long); ``carry`` adds the text's
    other columns of ``df`` as the struct ``row``.

    The first level has so many groups by the documents' hashes that each holds about GROUP_ROWS rows, whatever the
    sources' sizes: a source with a third of all rows is spread over as many tasks as any other rows.
    """
    size = F.size(words(F.col(f"`{text_col}`"))).cast("long")
    docs = in_batches(df).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"), *([F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")] if carry else []))
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    sizes = written(sizes, "sources")
    n = sizes.agg(F.sum("rows")).first()[0] or 0
    targets = written(source_targets(sizes.drop("rows"), weights, share, most), "targets")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    keep = targets.select(F.col("source").alias("_s"), "source_size", "target")
    part = docs.join(keep, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumn("_p", wanted)
    near = F.when(F.abs(F.col("_p") - F.round("_p")) < 1e-9, F.round("_p")).otherwise(F.col("_p"))
    groups = max(1, -(-n // GROUP_ROWS))
    key = F.xxhash64("doc_id", "size", "source", F.lit(seed))
    rows = part.withColumn("_p", near).select(
        F.pmod(F.xxhash64("doc_id", "size", F.lit(seed + 1)), F.lit(groups)).alias("group"), key.alias("key"), "doc_id", "source", "size", "source_size", "target",
        F.floor("_p").cast("long").alias("part"), (F.col("_p") - F.floor("_p")).alias("frac"), F.lit(False).alias("settled"), *(["row"] if carry else []),
    )
    done, level = None, 0
    while True:
        last = groups == 1
        node = F.concat_ws(":", F.col("group"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).alias("node")
        into = rows.select(node, *rows.columns)
        into = into.repartition("node").sortWithinPartitions("node", "key", "doc_id", "size")
        after = written(into.mapInArrow(_reduce(seed + 100 * level, last), into.schema).drop("node"), "mix")
        settled = after.where("settled")
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        groups, level = -(-groups // FAN_IN), level + 1
        rows = after.where("NOT settled").withColumn("group", F.floor(F.col("group") / FAN_IN))
    return done.select("doc_id", "source", "size", "source_size", "target", (F.col("part") + F.col("frac").cast("long")).alias("copies"), *(["row"] if carry else []))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents."""
    out = mix(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
