"""Dependency graphs: edges, merges, components, communities, proximity, upserts."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.names import simple_name, squashed
from heddle.session import cut


def merged_edges(edges: DataFrame, undirected: bool = False, tasks: int | None = None) -> DataFrame:
    """(source, target, weight) with the weights of equal edges summed; undirected: both directions are one. With ``tasks`` edges
    are dealt to so many before anything is summed: where most edges differ, sums before a shuffle only fill memory."""
    if undirected:
        edges = edges.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target"), "weight")
    if tasks:
        edges = edges.repartition(tasks, "source", "target")
    return edges.groupBy("source", "target").agg(F.sum("weight").alias("weight"))


def induced(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with both ends among ``vertices`` (id)."""
    out = edges
    for end in ("source", "target"):
        out = out.join(vertices.select(F.col("id").alias(end)).distinct(), end, "left_semi")
    return out.select(*edges.columns)


def _stars(e: DataFrame) -> DataFrame:
    """(u, v): every vertex of the edges ``e`` (u > v) that is not the smallest of its component, tied to the smallest.

    Alternating star joins: minima combined before their shuffle and joined back, until nothing changes. Their number
    grows with the logarithm of the graph, not with its diameter.
    """
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(down, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
        e = cut(pairs.select("p.u", "p.v").where("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e
        before = now


def weak_components(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """(id, component): component is the smallest id reachable when directions don't count.

    Rounds go over two edges of each vertex, those to its least and to its largest smaller neighbour: at most twice as many
    edges as vertices. What they join covers most of a graph, so all edges are looked at once more, for those between two
    of the components found; rounds over these join the rest.
    """
    ends = cut(edges.select("source", "target"))
    e = ends.where("source <> target").select(F.greatest("source", "target").alias("u"), F.least("source", "target").alias("v"))
    two = e.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    found = _stars(cut(two.select("u", F.explode(F.array_distinct(F.array("a", "b"))).alias("v"))))
    for end in ("u", "v"):
        root = found.select(F.col("u").alias("_id"), F.col("v").alias("_root"))
        e = e.join(root, F.col(end) == F.col("_id"), "left").withColumn(end, F.coalesce("_root", end)).drop("_id", "_root")
    across = cut(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if not across.isEmpty():
        over = _stars(across)
        # Ends of ``over`` are the smallest vertices of components, which have no row in ``found``.
        up = found.join(over.select(F.col("u").alias("v"), F.col("v").alias("_over")), "v", "left")
        found = cut(up.select("u", F.coalesce("_over", "v").alias("v")).unionByName(over))
    every = ends.select(F.explode(F.array("source", "target")).alias("id"))
    every = (every if vertices is None else every.unionByName(vertices.select("id"))).distinct()
    return every.join(found.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def summary(edges: DataFrame, ties: DataFrame | None = None) -> DataFrame:
    """One row: nodes, edges, density, weak components. ``ties`` are fewer edges with the same ends and the same components, if
    there are such."""
    parts = weak_components(edges if ties is None else ties).agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("component").alias("components"))
    m = merged_edges(edges).agg(F.count(F.lit(1)).alias("edges"))
    n = F.col("nodes")
    return parts.join(m).select("nodes", "edges", F.when(n > 1, F.col("edges") / (n * (n - 1))).otherwise(0.0).alias("density"), "components")


def resolved(tokens: DataFrame, elements: DataFrame, token: str, name: str) -> DataFrame:
    """Tokens resolved to elements: by the exact name, else by a simple name that one element has, else, if no element
    has the simple name, by a squashed name that one element has. Tokens without a match drop out."""
    named = elements.select(F.col(name).alias("_name")).distinct()
    by_simple = named.groupBy(simple_name("_name").alias("_simple")).agg(F.count(F.lit(1)).alias("_n1"), F.min("_name").alias("_m1"))
    by_squashed = named.groupBy(squashed(simple_name("_name")).alias("_squashed")).agg(F.count(F.lit(1)).alias("_n2"), F.min("_name").alias("_m2"))
    last = simple_name(token)
    out = tokens.withColumn("_simple", last).withColumn("_squashed", squashed(last))
    out = out.join(named, F.col(token) == F.col("_name"), "left").join(by_simple, "_simple", "left").join(by_squashed, "_squashed", "left")
    hit = F.coalesce("_name", F.when(F.col("_n1") == 1, F.col("_m1")), F.when(F.col("_n1").isNull() & (F.col("_n2") == 1), F.col("_m2")))
    return out.select(*[F.col(c) for c in tokens.columns], hit.alias("resolved")).where("resolved IS NOT NULL")


def structural_edges(elements: DataFrame) -> DataFrame:
    """Edges by imports (1.0), base classes (2.0), calls (1.5) and injections (2.0) of elements with a qualified_name
    and arrays of tokens; one per source, target and type, none to itself."""
    kinds = (("imports", "import", 1.0), ("base_classes", "inheritance", 2.0), ("method_calls", "call", 1.5), ("annotations", "injection", 2.0))
    out = None
    for column, kind, weight in kinds:
        t = elements.select(F.col("qualified_name").alias("source"), F.explode(column).alias("token"))
        t = resolved(t, elements, "token", "qualified_name").select("source", F.col("resolved").alias("target"), F.lit(kind).alias("type"), F.lit(weight).alias("weight"))
        out = t if out is None else out.unionByName(t)
    return out.where("source <> target").dropDuplicates(["source", "target", "type"])


#: Rows of a block of a key on one side, and pairs of rows that a task goes through on average.
BLOCK_ROWS, TASK_PAIRS = 1024, 8_000_000
#: Tasks whose rows one task deals out, about TASK_PAIRS / BLOCK_ROWS for each.
DEALT_TASKS = 64


def met(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """``left`` joined with ``right`` where keys may be few and their rows many: the rows of a key are dealt to blocks, every block
    of the one side meets every block of the other, and the number of tasks follows the number of pairs. Adaptive execution
    would go by the bytes of what is joined, which grow as the root of what comes out."""
    sides = [df.groupBy(*on).agg(F.count(F.lit(1)).alias(n)) for df, n in ((left, "_l"), (right, "_r"))]
    plan = cut(sides[0].join(sides[1], on).select(*on, *[F.ceil(F.col(n) / BLOCK_ROWS).cast("int").alias(f"{n}n") for n in ("_l", "_r")], (F.col("_l") * F.col("_r")).alias("_pairs")))
    tasks = (plan.agg(F.sum("_pairs")).first()[0] or 0) // TASK_PAIRS + 1
    plan = plan.drop("_pairs")

    def dealt(df: DataFrame, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        whole = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
        rows = df.join(plan, on).select(*df.columns, F.pmod(whole, F.col(own_n)).cast("int").alias(own), other_n)
        # A row is sent once for each block of the other side: a few megabytes that one task would read become most of the shuffle.
        rows = rows.repartition(tasks // DEALT_TASKS + 1, *df.columns, own)
        rows = rows.select(*df.columns, own, F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)).alias(other))
        return rows.repartition(tasks, *on, "_i", "_j")

    return dealt(left, "_i", "_ln", "_j", "_rn").join(dealt(right, "_j", "_rn", "_i", "_ln"), [*on, "_i", "_j"]).drop("_i", "_j")


#: Weights of pairs of elements whose directories are that many steps apart.
DIRECTORY_WEIGHTS = {0: 0.3, 1: 0.15, 2: 0.1}


def directory_edges(elements: DataFrame, name: str, path: str, place: str, existing: DataFrame | None = None, most: int = 20) -> DataFrame:
    """Edges both ways between elements in directories at most two steps apart, by the first ``most`` elements of each.

    An element meets another under their nearest common ancestor, at most two steps up in all: an equality join, whose rows are
    the edges themselves. Edges are the same only if names are, so only those of names that come more than once are compared.
    ``most`` is the operator's own rule, applied by place.
    """
    directory = F.regexp_extract(F.regexp_replace(F.col(path), r"\\", "/"), r"^(.*)/[^/]*$", 1)
    own = elements.select(F.col(name).alias("name"), directory.alias("dir"), F.col(place).alias("place"))
    rank = F.row_number().over(Window.partitionBy("dir").orderBy("place", "name"))
    own = own.withColumn("_rn", rank).where((F.col("_rn") <= most) & F.col("name").isNotNull())
    own = own.withColumn("_many", F.count(F.lit(1)).over(Window.partitionBy("name")) > 1)
    own = own.select("name", "_many", F.filter(F.split("dir", "/"), lambda x: x != "").alias("_p"))
    legs = own.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(2), F.size("_p")))).alias("_up"))
    above = F.array_join(F.slice("_p", 1, F.size("_p") - F.col("_up")), "/")
    below = F.when(F.col("_up") > 0, F.element_at("_p", F.size("_p") - F.col("_up") + 1))
    legs = cut(legs.select("name", "_many", above.alias("above"), below.alias("below"), "_up"))
    others = F.explode(F.sequence(F.lit(0), F.lit(2) - F.col("_up")))
    left = legs.select(F.col("name").alias("source"), F.col("_many").alias("_m1"), "above", F.col("below").alias("_b1"), F.col("_up").alias("a"), others.alias("b"))
    right = legs.select(F.col("name").alias("target"), F.col("_many").alias("_m2"), "above", F.col("below").alias("_b2"), others.alias("a"), F.col("_up").alias("b"))
    near = met(left, right, ["above", "a", "b"]).where("source <> target AND (a = 0 OR b = 0 OR _b1 <> _b2)").withColumn("steps", F.col("a") + F.col("b"))
    weight = F
    for steps, w in DIRECTORY_WEIGHTS.items():
        weight = weight.when(F.col("steps") == steps, w)
    edge = ("source", "target", F.lit("directory").alias("type"), weight.alias("weight"))
    out = near.where("NOT (_m1 OR _m2)").select(*edge)
    if not legs.where("_many").isEmpty():
        out = out.unionByName(near.where("_m1 OR _m2").select(*edge).distinct())
    return out if existing is None else out.join(existing.select("source", "target").distinct(), ["source", "target"], "left_anti")


def directory_classes(elements: DataFrame, name: str, path: str, place: str, most: int = 20) -> DataFrame:
    """Directories with how many elements they have, how many lie at most two steps away, and how many edges ``directory_edges``
    has from them: (dir, members, near, links), one row for each directory and no pairs.

    What lies within two steps is the directory, its parent and grandparent, its children and grandchildren, and the other
    children of its parent. All are sums by directory, added up below one and two steps: a directory that thousands share as an
    ancestor is summed by each task before it is shuffled, and its sum is joined back to its children, which adaptive
    execution splits. Names are taken as distinct. Edges themselves come from ``directory_edges``, for the directories asked for.
    """
    directory = F.regexp_extract(F.regexp_replace(F.col(path), r"\\", "/"), r"^(.*)/[^/]*$", 1)
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    # The operator's own rule takes the first elements of a directory; a count needs no order.
    raw = elements.select(F.col(name), directory.alias("_raw"), parts.alias("_p")).groupBy("_raw").agg(F.count(F.lit(1)).alias("_n"), F.first("_p").alias("_p"))
    own = raw.select("_p", F.least("_n", F.lit(most)).alias("_n")).groupBy("_p").agg(F.sum("_n").alias("members"))

    def up(n: int) -> Column:
        return F.when(F.size("_p") >= n, F.array_join(F.slice("_p", 1, F.size("_p") - n), "/"))

    dirs = cut(own.select(F.array_join("_p", "/").alias("dir"), up(1).alias("_up1"), up(2).alias("_up2"), "members"))
    below = [dirs.groupBy(F.col(f"_up{n}").alias("_k")).agg(F.sum("members").alias(f"_below{n}")).where("_k IS NOT NULL") for n in (1, 2)]
    above = dirs.select(F.col("dir").alias("_k"), F.col("members").alias("_own"))
    out = dirs
    for on, side, column in (("dir", below[0], "_below1"), ("dir", below[1], "_below2"), ("_up1", above, "_own"), ("_up2", above, "_own"), ("_up1", below[0], "_below1")):
        renamed = side.select(F.col("_k").alias("_on"), F.col(column).alias(f"_x{len(out.columns)}"))
        out = out.join(renamed, F.col(on) == F.col("_on"), "left").drop("_on")
    sums = [F.coalesce(F.col(c), F.lit(0)) for c in out.columns if c.startswith("_x")]
    # A directory below another counts itself among its parent's children; one without a parent counts itself here.
    near = functools.reduce(lambda a, b: a + b, sums) + F.when(F.col("_up1").isNull(), F.col("members")).otherwise(0)
    return out.select("dir", "members", near.alias("near"), (F.col("members") * (near - 1)).alias("links"))


def shared_value_classes(df: DataFrame, owner: str, value: str) -> DataFrame:
    """Values with the number of their owners and of the pairs of owners that share them: (value, owners, links). Owners of a value
    are its class; pairs come from ``shared_values``, for the values asked for. Null values are shared by none."""
    rows = df.select(F.col(owner).alias("_o"), F.col(value)).where(F.col(value).isNotNull() & F.col("_o").isNotNull()).distinct()
    n = F.col("owners")
    return rows.groupBy(value).agg(F.count(F.lit(1)).alias("owners")).withColumn("links", F.expr("owners * (owners - 1) div 2")).where(n >= 1)


# --- communities ----------------------------------------------------------------------------------------------------


def louvain(edges: list[tuple[str, str, float]], resolution: float = 1.0) -> dict[str, int]:
    """Communities of a small undirected graph by modularity moves and merges, in sorted order of names."""
    weight: dict = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            weight.setdefault(x, {})[y] = weight.get(x, {}).get(y, 0.0) + w * (0.5 if a == b else 1.0)
    home = {v: v for v in weight}
    total = sum(sum(n.values()) for n in weight.values()) or 1.0
    while True:
        degree = {v: sum(n.values()) for v, n in weight.items()}
        group, mass, moved_any = {v: v for v in weight}, dict(degree), False
        moved = True
        while moved:
            moved = False
            for v in sorted(weight):
                links: dict = {}
                for u, w in weight[v].items():
                    if u != v:
                        links[group[u]] = links.get(group[u], 0.0) + w
                old = group[v]
                mass[old] -= degree[v]
                gain = {g: w - resolution * mass[g] * degree[v] / total for g, w in links.items()}
                gain.setdefault(old, -resolution * mass[old] * degree[v] / total)
                best = min(gain, key=lambda g: (-round(gain[g], 12), g != old, g))
                mass[best] += degree[v]
                if best != old:
                    group[v], moved, moved_any = best, True, True
        if not moved_any:
            break
        home = {v: group[h] for v, h in home.items()}
        new: dict = {}
        for v, n in weight.items():
            for u, w in n.items():
                row = new.setdefault(group[v], {})
                row[group[u]] = row.get(group[u], 0.0) + w
        weight = new
    numbers = {g: i for i, g in enumerate(sorted(set(home.values())))}
    return {v: numbers[g] for v, g in home.items()}


def refined(part: dict[str, int], edges: list[tuple[str, str, float]], most: int = 15) -> dict[str, int]:
    """Communities of one member join the neighbour they are tied to most; those above ``most`` are split again where
    that gives parts."""
    groups: dict[int, set] = {}
    for v, g in part.items():
        groups.setdefault(g, set()).add(v)
    for g in sorted(groups):
        if len(groups.get(g, ())) == 1:
            (v,) = groups[g]
            ties: dict[int, float] = {}
            for a, b, w in edges:
                if v in (a, b) and a != b:
                    other = part[b if a == v else a]
                    ties[other] = ties.get(other, 0.0) + w
            if ties:
                to = min(ties, key=lambda t: (-ties[t], t))
                groups.pop(g)
                groups[to].add(v)
                part[v] = to
    fresh = max(groups, default=-1) + 1
    for g in sorted(groups):
        if len(groups[g]) > most:
            inner = [(a, b, w) for a, b, w in edges if a in groups[g] and b in groups[g]]
            again = louvain(inner, 2.0)
            for v, k in again.items():
                part[v] = fresh + k
            fresh += len(set(again.values()))
    return part


def communities(edges: DataFrame, most: int = 15) -> DataFrame:
    """(id, community): communities of each weak component, found within it; names are <component>:<number>.

    A component is one group of applyInPandas: the graphs meant here are of code elements, tens of thousands of vertices
    at most, and their components smaller.
    """
    und = merged_edges(edges, undirected=True)
    parts = weak_components(und)
    rows = und.join(parts.select(F.col("id").alias("source"), "component"), "source")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        e = list(pdf[["source", "target", "weight"]].sort_values(["source", "target"]).itertuples(index=False, name=None))
        part = refined(louvain(e), e, most)
        name = str(pdf["component"].iloc[0])
        return pd.DataFrame({"id": list(part), "community": [f"{name}:{g}" for g in part.values()]})

    kind = und.schema["source"].dataType.simpleString()
    return rows.groupBy("component").applyInPandas(solve, f"id {kind}, community string")


def confidence(method: str, size: Column) -> Column:
    """Confidence of a group: 0.3 for one member, else by how it was found."""
    by = {"framework": 0.9, "llm_direct": 0.85, "llm_refined": 0.75, "community": 0.5}
    return F.when(size <= 1, 0.3).otherwise(by[method])


def groups_of(partition: DataFrame, elements: DataFrame, name: str = "id") -> DataFrame:
    """(community, members, size, confidence) of the elements that are known."""
    known = partition.join(elements.select(F.col(name).alias("id")).distinct(), "id", "left_semi")
    out = known.groupBy("community").agg(F.sort_array(F.collect_set("id")).alias("members"))
    return out.withColumn("size", F.size("members").cast("long")).withColumn("confidence", F.lit(0.6))


# --- property graph -------------------------------------------------------------------------------------------------


def upserted_nodes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, props map): supplied properties win, others stay."""
    a, b = old.select("id", F.col("props").alias("_a")), new.select("id", F.col("props").alias("_b"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    kept = F.map_filter(F.coalesce("_a", none), lambda k, v: ~F.map_contains_key(F.coalesce("_b", none), k))
    return a.join(b, "id", "full").select("id", F.map_concat(kept, F.coalesce("_b", none)).alias("props"))


def valid_relations(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """Relations whose ends exist."""
    return induced(relations, nodes)


def evidence_nodes(nodes: DataFrame) -> DataFrame:
    """(id, owner, evidence) for each item of the evidence array of nodes: ids evidence:<node>:<place>."""
    rows = nodes.select(F.col("id").alias("owner"), F.posexplode("evidence").alias("_i", "evidence"))
    return rows.select(F.concat_ws(":", F.lit("evidence"), "owner", "_i").alias("id"), "owner", "evidence")


def relation_set(relations: DataFrame, key: Sequence[str] = ("from", "to", "type", "protocol")) -> DataFrame:
    return relations.dropDuplicates(list(key))


def outer_merged(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join with where a row comes from: left_only, right_only or both."""
    a, b = left.withColumn("_l", F.lit(True)), right.withColumn("_r", F.lit(True))
    where = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").otherwise("both")
    return a.join(b, list(on), "full").withColumn("merged", where).drop("_l", "_r")


def shared_values(df: DataFrame, owner: str, value: str) -> DataFrame:
    """Pairs of owners, in order, that share a value."""
    a = cut(df.select(F.col(owner).alias("a"), F.col(value).alias("v")).where("a IS NOT NULL AND v IS NOT NULL").distinct())
    return met(a, a.select(F.col("a").alias("b"), "v"), ["v"]).where("a < b").select("a", "b", F.col("v").alias(value))


def _whole(df: DataFrame, name: str) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def matched(nodes: DataFrame, edges: DataFrame, a: Column | None = None, r: Column | None = None, b: Column | None = None) -> DataFrame:
    """The pattern (a)-[r]->(b) as rows of three structs; each condition speaks of the columns of nodes or of edges and is
    pushed to their scan."""

    def some(df: DataFrame, condition: Column | None, name: str) -> DataFrame:
        return (df if condition is None else df.where(condition)).select(_whole(df, name))

    out = some(edges, r, "r").join(some(nodes, a, "a"), F.col("r.source") == F.col("a.id"))
    return out.join(some(nodes, b, "b"), F.col("r.target") == F.col("b.id")).select("a", "r", "b")


def rolled_back(nodes: DataFrame, edges: DataFrame, run: str, value) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without those of a run or task; edges at a node that goes, go with it. Null is no run."""
    mine = F.col(run).eqNullSafe(F.lit(value))
    gone = nodes.where(mine).select("id").distinct()
    left = edges.where(~mine)
    for end in ("source", "target"):
        left = left.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return nodes.where(~mine), left.select(*edges.columns)
