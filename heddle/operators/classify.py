"""Keyword and pattern classification."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.values import any_of

# Layers by the first pattern found in annotations and name.
LAYERS = (
    ("controller|handler|route|endpoint", "presentation"),
    ("service|usecase|use_case|interactor", "business"),
    ("repository|dao|store|gateway", "data_access"),
    ("config|middleware|interceptor", "infrastructure"),
)
# Technologies of container types, and words of a declared type or name that tell one.
BROKERS = ("kafka", "rabbitmq", "activemq", "nats", "sqs", "pubsub", "amqp")
BLOBS = ("s3", "minio", "blob", "gcs", "cloudfront", "cdn", "object store")
DATABASES = (
    "postgres", "postgresql", "mysql", "mariadb", "mongodb", "redis", "neo4j", "sqlite", "dynamodb", "cassandra",
    "elasticsearch", "opensearch", "oracle", "mssql", "sqlserver", "rds", "aurora", "cockroachdb", "tidb",
)
SERVERLESS = ("lambda", "azure function", "cloud function", "serverless")
SHELLS = ("bash", "shell", "sh", "zsh")
MOBILE = ("ios", "android", "flutter", "react native", "swift", "kotlin", "xamarin", "ionic")
FRONTEND = ("react", "vue", "angular", "svelte", "next.js", "nuxt", "gatsby", "vite")
SERVERS = (
    "spring", "spring boot", "django", "flask", "fastapi", "rails", "express", "asp.net", "laravel", "symfony", "gin",
    "echo", "fiber", "node", "tomcat", "jetty", "quarkus", "micronaut",
)


def has_any(value: Column, parts: Sequence[str]) -> Column:
    return any_of([value.contains(p) for p in parts])


def first_match(value: Column, patterns: Sequence[tuple[str, str]], other: str) -> Column:
    """Label of the first pattern that a value contains."""
    out = F
    for pattern, label in patterns:
        out = out.when(value.rlike(pattern), label)
    return out.otherwise(other)


def layer(annotations_and_name: Column) -> Column:
    return first_match(F.lower(annotations_and_name), LAYERS, "unknown")


def container_type(technology: Column, kind: Column, name: Column) -> Column:
    """Type of a container by technology, declared type and name: the first rule that holds."""
    t, k, n = (F.lower(F.coalesce(c, F.lit(""))) for c in (technology, kind, name))
    front = ("frontend", "spa", "web", "client", "ui")
    return (
        F.when(has_any(t, BROKERS) | has_any(k, ("broker", "queue", "messaging", "event")), "MessageBroker")
        .when(has_any(t, BLOBS) | has_any(k, ("blob", "storage")), "BlobStore")
        .when(has_any(t, DATABASES) | has_any(k, ("database", "db", "store", "cache")) | has_any(n, ("db", "database", "store", "cache")), "Database")
        .when(has_any(t, SERVERLESS) | has_any(k, ("serverless", "function")), "ServerlessFunction")
        .when(has_any(t, SHELLS), "ShellScript")
        .when(has_any(t, MOBILE) | has_any(k, ("mobile",)), "MobileApp")
        .when(has_any(t, FRONTEND) & (has_any(k, front) | has_any(n, front)), "ClientSideWebApp")
        .when(has_any(t, SERVERS) | has_any(k, ("api", "backend", "service", "server", "web")), "ServerSideWebApp")
        .otherwise("Unknown")
    )


def coerced(value: Column, valid: Sequence[str]) -> Column:
    """The value if it is a valid one, else Unknown."""
    return F.when(value.isin(*valid), value).otherwise("Unknown")


def grep(df: DataFrame, keep: Sequence[str], text: str, pattern: str, around: int = 40) -> DataFrame:
    """Lines that match, numbered from 1, with a snippet of ``around`` characters on both sides of the first match."""
    lines = df.select(*keep, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("_no", "line")).where(F.col("line").rlike(pattern))
    lines = lines.withColumn("_found", F.regexp_extract(F.col("line"), f"({pattern})", 1)).withColumn("_at", F.expr("locate(_found, line)"))
    start = F.greatest(F.col("_at") - around, F.lit(1))
    snippet = F.substring(F.col("line"), start, F.col("_at") + F.length("_found") + around - start)
    return lines.select(*keep, (F.col("_no") + 1).cast("long").alias("line_no"), snippet.alias("snippet"))


def first_by_rule(df: DataFrame, text: str, order: str, rules: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """For each rule the first row, in an order, that one of its patterns matches. All rules in one pass over the texts."""
    hits = F.array_compact(F.array(*[F.when(any_of([F.col(text).rlike(p) for p in patterns]), F.lit(name)) for name, patterns in rules]))
    return df.select(order, F.explode(hits).alias("rule")).groupBy("rule").agg(F.min(order).alias(order))


def indicators(df: DataFrame, keep: Sequence[str], text: str, table: dict[str, tuple[str, str]]) -> DataFrame:
    """Every indicator that a text contains in lower case, with its labels, in table order."""
    low = F.lower(F.col(text))
    hits = F.array_compact(F.array(*[F.when(low.contains(k), F.struct(F.lit(i).alias("place"), F.lit(k).alias("indicator"), F.lit(a).alias("language"), F.lit(b).alias("framework"))) for i, (k, (a, b)) in enumerate(table.items())]))
    return df.select(*keep, F.explode(hits).alias("h")).select(*keep, "h.*")


def filter_reason(path: Column, fields: Column, methods: Column, all_static: Column, generated: str) -> Column:
    """Why an element is left out, the first reason that holds, else ''."""
    total = fields + methods
    data_only = (total > 0) & (fields / total > 0.7) & (methods < 3)
    return (
        F.when(path.rlike(generated), "generated code")
        .when(F.coalesce(data_only, F.lit(False)), "data-only class")
        .when(F.coalesce(all_static, F.lit(False)), "all-static utility class")
        .otherwise("")
    )


def majority(df: DataFrame, by: Sequence[str], value: str, place: str) -> DataFrame:
    """The most frequent value of each group; the one seen first on ties."""
    counted = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first"))
    return counted.groupBy(*by).agg(F.min_by(value, F.struct(-F.col("n"), F.col("first"))).alias(value))


def richest(df: DataFrame, by: Sequence[str], score: Column, place: str) -> DataFrame:
    """The row with the highest score of each group; the one seen first on ties."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(score.desc(), F.col(place)))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


@dataclass(frozen=True)
class Detector:
    """What to look for: whether it applies to a row, and what it finds there, an array of texts."""

    name: str
    applies: Column
    found: Column


def detected(df: DataFrame, keep: Sequence[str], detectors: Sequence[Detector]) -> DataFrame:
    """(keep..., detector, found) for all that the detectors find, in one pass; null arrays find nothing."""

    def hits(d: Detector) -> Column:
        return F.when(d.applies, F.transform(d.found, lambda x: F.struct(F.lit(d.name).alias("detector"), x.alias("found"))))

    none = F.array().cast("array<struct<detector:string,found:string>>")
    every = F.concat(*[F.coalesce(hits(d), none) for d in detectors])
    return df.select(*[F.col(f"`{k}`") for k in keep], F.explode(every).alias("_hit")).select(*[F.col(f"`{k}`") for k in keep], "_hit.*")
