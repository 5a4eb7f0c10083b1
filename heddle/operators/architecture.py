"""Architecture extraction: code elements, ownership, name resolution, grouping, edge labels, query graphs."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators.graph import communities, confidence

ELEMENT = "qualified_name string, kind string, file_path string, language string, annotations array<string>, imports array<string>, base_classes array<string>, method_calls array<string>, field_count long, method_count long"


def python_elements(path: str, text: str) -> list[tuple]:
    """Classes and top-level functions of a Python text; none where it does not parse."""
    try:
        tree = ast.parse(text or "")
    except (SyntaxError, ValueError):
        return []
    module = re.sub(r"\.py$", "", path.replace("\\", "/")).strip("/").replace("/", ".")
    imports = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            imports += [a.name for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            imports += [f"{node.module}.{a.name}" if node.module else a.name for a in node.names]
    out = []
    for node in tree.body:
        if not isinstance(node, ast.ClassDef | ast.FunctionDef | ast.AsyncFunctionDef):
            continue
        calls = sorted({ast.unparse(c.func) for c in ast.walk(node) if isinstance(c, ast.Call)})
        body = node.body if isinstance(node, ast.ClassDef) else []
        fields = sum(isinstance(b, ast.Assign | ast.AnnAssign) for b in body)
        methods = sum(isinstance(b, ast.FunctionDef | ast.AsyncFunctionDef) for b in body)
        bases = [ast.unparse(b) for b in getattr(node, "bases", [])]
        kind = "class" if isinstance(node, ast.ClassDef) else "function"
        out.append((f"{module}.{node.name}", kind, path, "Python", [ast.unparse(d) for d in node.decorator_list], imports, bases, calls, fields, methods))
    return out


#: Declarations of languages without a parser here: (kind, pattern with the name, pattern of what follows for bases).
DECLARATIONS = {
    "Java": r"(?P<kind>class|interface|enum)\s+(?P<name>\w+)(?:\s+extends\s+(?P<base>\w+))?(?:\s+implements\s+(?P<more>[\w, ]+))?",
    "C#": r"(?P<kind>class|interface|struct)\s+(?P<name>\w+)(?:\s*:\s*(?P<more>[\w, ]+))?",
    "TypeScript": r"(?P<kind>class|interface|function)\s+(?P<name>\w+)(?:\s+extends\s+(?P<base>\w+))?(?:\s+implements\s+(?P<more>[\w, ]+))?",
    "Ruby": r"(?P<kind>class|module)\s+(?P<name>[A-Z]\w*)(?:\s*<\s*(?P<base>\w+))?",
    "Go": r"(?P<kind>type|func)\s+(?P<name>[A-Z]\w*)",
}
IMPORTS = {"Java": r"^import\s+(?:static\s+)?([\w.]+);", "C#": r"^using\s+([\w.]+);", "TypeScript": r"from\s+['\"]([^'\"]+)['\"]", "Ruby": r"^require(?:_relative)?\s+['\"]([^'\"]+)", "Go": r"^\s*(?:import\s+)?\"([^\"]+)\"$"}


def declared_elements(path: str, text: str, language: str) -> list[tuple]:
    """Declarations of a text by the pattern of its language."""
    pattern = DECLARATIONS.get(language)
    if not pattern:
        return []
    base = re.sub(r"\.[^./]*$", "", path.replace("\\", "/")).strip("/").replace("/", ".")
    package = re.search(r"^(?:package|namespace)\s+([\w.]+)", text or "", re.M)
    imports = re.findall(IMPORTS[language], text or "", re.M)
    out = []
    for m in re.finditer(r"^[ \t]*(?:(?:public|private|abstract|final|static|export|default|sealed|internal)\s+)*" + pattern, text or "", re.M):
        g = m.groupdict()
        bases = [b.strip() for b in [g.get("base") or "", *(g.get("more") or "").split(",")] if b.strip()]
        owner = package[1] if package and language in ("Java", "C#") else base
        out.append((f"{owner}.{g['name']}", g["kind"], path, language, [], imports, bases, [], 0, 0))
    return out


def code_elements(texts: DataFrame) -> DataFrame:
    """Elements of (path, language, text) rows: parsed in batches, one file at a time."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in ELEMENT.split(", ")]
        for pdf in it:
            rows = []
            for r in pdf.itertuples(index=False):
                rows += python_elements(r.path, r.text) if r.language == "Python" else declared_elements(r.path, r.text, r.language)
            yield pd.DataFrame(rows, columns=names)

    return texts.select("path", "language", "text").mapInPandas(run, ELEMENT)


# --- ownership and names --------------------------------------------------------------------------------------------


def ownership(dependencies: DataFrame, rules: Sequence[tuple[str, str, float]], name: str, text: str) -> DataFrame:
    """Each dependency with the best of the signals that hold for it: a rule (keyword, resource, confidence) holds if the
    keyword stands in the name and the resource in the text. Without any: not owned, 0.5. Rules are a written list, so
    they are one array, not a join."""
    held = F.array_compact(F.array(*[F.when(F.lower(F.col(name)).contains(k) & F.col(text).contains(r), F.lit(c)) for k, r, c in rules]))
    best = F.array_max(held)
    return dependencies.select("*", best.isNotNull().alias("owned"), F.coalesce(best, F.lit(0.5)).alias("confidence"))


def resolved_ends(edges: DataFrame, known: DataFrame, end: str, prefixes: Sequence[str] = ("container:", "component:")) -> DataFrame:
    """``edges`` with the id of an end: its name without prefix among ``known`` (id, name), else a ghost named after it."""
    bare = F.regexp_replace(F.col(end), "^(" + "|".join(re.escape(p) for p in prefixes) + ")", "")
    names = known.select(F.col("id").alias("_id"), F.lower("name").alias("_name")).groupBy("_name").agg(F.min("_id").alias("_id"))
    out = edges.withColumn("_bare", F.lower(bare)).join(names, F.col("_bare") == F.col("_name"), "left")
    ghost = F.concat(F.lit("ghost:"), F.col("_bare"))
    return out.withColumn(f"{end}_id", F.coalesce("_id", ghost)).withColumn(f"{end}_ghost", F.col("_id").isNull()).drop("_bare", "_id", "_name")


def stale(left: DataFrame, right: DataFrame, key: str, digest: str) -> DataFrame:
    """Rows of ``left`` with whether ``right`` lacks them or has another digest, stale ones first, then by key."""
    other = right.select(F.col(key), F.col(digest).alias("_d"))
    out = left.join(other, key, "left").withColumn("stale", F.coalesce(F.col("_d") != F.col(digest), F.lit(True))).drop("_d")
    return out.orderBy(F.col("stale").desc(), key)


def collection_members(paths: DataFrame, path: str, least: int = 3) -> DataFrame:
    """Manifests with whether any folder above them has ``least`` manifests or more right below its children."""
    parts = F.split(F.regexp_replace(F.col(path), "^/+", ""), "/")
    own = paths.withColumn("_p", parts)
    above = own.select(path, F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_p") - 1, F.lit(1))), lambda i: F.array_join(F.slice("_p", 1, i), "/"))).alias("folder"))
    many = above.groupBy("folder").agg(F.countDistinct(path).alias("n")).where(F.col("n") >= least).select("folder")
    member = above.join(many, "folder", "left_semi").select(path).distinct().withColumn("member", F.lit(True))
    return paths.join(member, path, "left").withColumn("member", F.coalesce("member", F.lit(False)))


# --- grouping -------------------------------------------------------------------------------------------------------


def framework_scores(elements: DataFrame, frameworks: dict[str, tuple[str, Sequence[str]]], by: str, marker: str, language: str) -> DataFrame:
    """Share of the markers of each framework that a group shows; 0 in another language."""
    seen = elements.groupBy(by).agg(F.collect_set(marker).alias("_m"), F.min(language).alias("_l"))
    rows = [F.struct(F.lit(n).alias("framework"), F.when(F.col("_l") == lang, F.size(F.array_intersect("_m", F.array(*map(F.lit, marks)))) / len(marks)).otherwise(0.0).alias("score")) for n, (lang, marks) in frameworks.items()]
    return seen.select(by, F.inline(F.array(*rows)))


def cluster_name(paths: Column, names: Column, fallback: str = "Component") -> Column:
    """Name of a group: the last folder that all paths share, else the most frequent word of its names, else a fallback."""
    folders = F.transform(paths, lambda p: F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0))))
    shared = F.aggregate(folders, F.get(folders, F.lit(0)), lambda a, b: F.filter(a, lambda x, i: x == F.get(b, i)))
    tokens = F.flatten(F.transform(names, lambda n: F.regexp_extract_all(n, F.lit("([A-Z][a-z]+)"), 1)))
    counted = F.transform(F.array_distinct(tokens), lambda t: F.struct((-F.size(F.filter(tokens, lambda x: x == t))).alias("n"), t.alias("t")))
    best = F.when(F.size(F.filter(counted, lambda c: c["n"] < -1)) > 0, F.array_min(counted)["t"])
    return F.coalesce(F.when(F.size(shared) > 0, F.initcap(F.element_at(shared, -1))), best, F.lit(fallback))


def grouped(elements: DataFrame, edges: DataFrame, least: float = 0.6) -> DataFrame:
    """(id, group, method, confidence) of all elements (id, framework, score): by framework where the score is enough,
    the others by the communities of the edges among them; elements without edges are groups of one."""
    found = elements.where((F.col("score") >= least) & F.col("framework").isNotNull()).select("id", F.col("framework").alias("group"), F.lit("framework").alias("method"))
    rest = elements.join(found.select("id"), "id", "left_anti").select("id")
    ends = edges.join(rest.select(F.col("id").alias("source")), "source", "left_semi").join(rest.select(F.col("id").alias("target")), "target", "left_semi")
    parts = communities(ends.select("source", "target", "weight"))
    own = rest.join(parts, "id", "left").select("id", F.coalesce("community", F.concat(F.lit("single:"), "id")).alias("group"), F.lit("community").alias("method"))
    both = found.unionByName(own)
    sizes = both.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    sure = F.when(F.col("method") == "framework", confidence("framework", F.col("size"))).otherwise(confidence("community", F.col("size")))
    return both.join(sizes, "group").select("id", "group", "method", sure.alias("confidence"))


def rendered_edges(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges (source, target, type, label) with both ends' types and where the label goes: beside the person, beside the
    outside system, else in the middle. Edges whose end is missing drop out."""
    kind = entities.select("id", F.lower(F.trim("type")).alias("t"))
    out = edges.join(kind.select(F.col("id").alias("source"), F.col("t").alias("source_type")), "source").join(kind.select(F.col("id").alias("target"), F.col("t").alias("target_type")), "target")
    place = F.when(F.col("source_type") == "person", "source").when(F.col("target_type") == "external", "target").otherwise("middle")
    return out.withColumn("label_at", place)


# --- query graphs ---------------------------------------------------------------------------------------------------


def flat_keys(value, above: str = "") -> dict:
    """A nested mapping with dotted keys."""
    out: dict = {}
    for k, v in value.items():
        out |= flat_keys(v, f"{above}{k}.") if isinstance(v, dict) else {above + k: v}
    return out


def depends_on(value) -> list[str]:
    """Names of a depends_on entry: a list as it is, the keys of a mapping, one name, or none."""
    return list(value) if isinstance(value, list | tuple | dict) else [value] if value else []


def report_query(text: str) -> dict:
    """Parts of a reporting query: SELECT fields FROM resource [WHERE] [ORDER BY] [LIMIT] [PARAMETERS]."""
    m = re.fullmatch(
        r"\s*SELECT\s+(?P<fields>.+?)\s+FROM\s+(?P<resource>\w+)(?:\s+WHERE\s+(?P<where>.+?))?(?:\s+ORDER\s+BY\s+(?P<order>.+?))?(?:\s+LIMIT\s+(?P<limit>\d+))?(?:\s+PARAMETERS\s+(?P<parameters>.+?))?\s*",
        text, re.IGNORECASE | re.DOTALL,
    )
    if not m:
        raise ValueError(f"no reporting query: {text!r}")
    fields = [f.strip() for f in m["fields"].split(",")]
    if not all(re.fullmatch(r"[\w.]+", f) for f in fields):
        raise ValueError(f"no field list: {m['fields']!r}")
    where = m["where"] and tuple(p.strip() for p in re.split(r"\s+AND\s+", m["where"], flags=re.IGNORECASE))
    return {"fields": fields, "resource": m["resource"], "where": where or (), "order": m["order"], "limit": m["limit"] and int(m["limit"]), "parameters": m["parameters"]}


def run_report(tables: dict[str, DataFrame], text: str) -> DataFrame:
    """A reporting query over named frames."""
    q = report_query(text)
    df = tables[q["resource"]]
    for condition in q["where"]:
        df = df.where(condition)
    if q["order"]:
        parts = [p.strip().split() for p in q["order"].split(",")]
        df = df.orderBy(*[F.col(p[0]).desc() if p[1:] and p[1].upper() == "DESC" else F.col(p[0]) for p in parts])
    df = df.limit(q["limit"]) if q["limit"] is not None else df
    return df.select(*q["fields"])


def run_query_graph(tables: dict[str, DataFrame], nodes: Sequence[dict]) -> DataFrame:
    """A builder's query graph as a frame. Nodes in order: table {name}, join {name, on, how}, filter {condition},
    aggregate {group, values: {name: expression}}, select {fields}, order {by}."""
    df = None
    for n in nodes:
        kind = n["type"]
        if kind == "table":
            df = tables[n["name"]]
        elif kind == "join":
            df = df.join(tables[n["name"]], n["on"], n.get("how", "inner"))
        elif kind == "filter":
            df = df.where(n["condition"])
        elif kind == "aggregate":
            df = df.groupBy(*n["group"]).agg(*[F.expr(e).alias(k) for k, e in n["values"].items()])
        elif kind in ("select", "field"):
            df = df.select(*n["fields"])
        elif kind == "order":
            df = df.orderBy(*n["by"])
        else:
            raise ValueError(f"no such node: {kind}")
    if df is None:
        raise ValueError("the graph has no table")
    return df
