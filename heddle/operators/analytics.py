"""Contributor, portfolio, review and usage analytics."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.values import any_of
from heddle.session import cut

# Substrings that tell automated accounts, in lower case.
BOT_EMAILS = ("noreply", "github-actions", "dependabot", "bot@", ".bot@", "actions@github", "renovate", "snyk-bot", "pre-commit-ci")
BOT_NAMES = ("[bot]", "-bot", "github actions", "renovate", "dependabot", "snyk bot", "pre-commit")


def top_counts(df: DataFrame, column: str, most: int, name: str = "n") -> DataFrame:
    """The ``most`` values with the highest counts; ties by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name)).orderBy(F.col(name).desc(), F.col(column)).limit(most)


def is_bot(name: Column, email: Column) -> Column:
    low_name, low_email = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(email, F.lit("")))
    return any_of([low_email.contains(s) for s in BOT_EMAILS] + [low_name.contains(s) for s in BOT_NAMES])


def contributors(df: DataFrame, name: str, email: str, commits: str, place: str, by: Sequence[str] = ()) -> DataFrame:
    """Contributors folded by lower-cased email, or name where there is none: summed commits, the name with the most
    commits (first seen on ties), the email as first seen, and the first place."""
    key = F.coalesce(F.nullif(F.lower(F.col(email)), F.lit("")), F.lower(F.col(name)))
    names = df.groupBy(*by, key.alias("contributor"), F.col(name).alias("name")).agg(
        F.sum(commits).alias("n"), F.min(place).alias("first"), F.min_by(F.col(email), F.col(place)).alias("email")
    )
    return names.groupBy(*by, "contributor").agg(
        F.min_by("name", F.struct(-F.col("n"), F.col("first"))).alias("name"), F.min_by("email", "first").alias("email"),
        F.sum("n").alias("commits"), F.min("first").alias("first"),
    )


#: Bits of a weight that one round of a selection looks at.
DIGIT = 10


def heaviest(df: DataFrame, by: Sequence[str], weight: str, share: float) -> DataFrame:
    """Per group how many of its heaviest rows have at least ``share`` of its weight together: (by..., selected long).

    No group is sorted. Equal weights fold into levels first; the level at which the share is reached is found from above, by a
    histogram of DIGIT bits of the weights in each round: sums for each group and digit, at most 2 ** DIGIT of them in a group, tell
    the digit, and only levels with that digit go on. Rounds are as many as the largest weight has digits. Weights are whole
    numbers; null and negative ones count as 0, and a group without weight needs one row.
    """
    value = F.greatest(F.coalesce(F.col(weight).cast("long"), F.lit(0)), F.lit(0))
    groups = [F.col(c).alias(f"_g{i}") for i, c in enumerate(by)]
    keys = [f"_g{i}" for i in range(len(by))]
    levels = cut(df.select(*groups, value.alias("_w")).groupBy(*keys, "_w").agg(F.count(F.lit(1)).alias("_n")))
    mass = F.sum(F.col("_w").cast("decimal(38,0)") * F.col("_n"))
    goal = levels.groupBy(*keys).agg((mass.cast("double") * share).alias("_goal"), F.max("_w").alias("_top"))
    top = goal.agg(F.max("_top")).first()[0] or 0
    found = goal.select(*keys, "_goal", F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("double").alias("_mass"), F.lit(0).cast("long").alias("_before"))
    for shift in range(max(0, top.bit_length() - 1) // DIGIT * DIGIT, -1, -DIGIT):
        # Null-safe: a null group is a group.
        same = functools.reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys], F.lit(True))
        inside = levels.alias("l").join(found.alias("f"), same & (F.shiftright("l._w", shift + DIGIT) == F.shiftright("f._prefix", shift + DIGIT)))
        digit = F.shiftleft(F.shiftright("l._w", shift), shift)
        sums = inside.groupBy(*[F.col(f"f.{k}").alias(k) for k in keys], digit.alias("_d")).agg(
            mass.cast("double").alias("_m"), F.sum("_n").alias("_c"), F.first("_goal").alias("_goal"), F.first("_mass").alias("_mass"), F.first("_before").alias("_before")
        )
        # At most 2 ** DIGIT digits of a group, heaviest first.
        histogram = F.sort_array(F.collect_list(F.struct("_d", "_m", "_c")), asc=False)
        one = sums.groupBy(*keys).agg(histogram.alias("_h"), F.first("_goal").alias("_goal"), F.first("_mass").alias("_mass"), F.first("_before").alias("_before"))
        start = F.struct(F.lit(None).cast("long").alias("d"), F.col("_mass").alias("mass"), F.col("_before").alias("before"))

        def reach(acc: Column, x: Column) -> Column:
            here = acc["mass"] + x["_m"] >= F.col("_goal")
            over = F.struct(F.when(here, x["_d"]).alias("d"), F.when(here, acc["mass"]).otherwise(acc["mass"] + x["_m"]).alias("mass"), F.when(here, acc["before"]).otherwise(acc["before"] + x["_c"]).alias("before"))
            return F.when(acc["d"].isNotNull(), acc).otherwise(over)

        found = one.withColumn("_a", F.aggregate("_h", start, reach)).select(*keys, "_goal", F.col("_a.d").alias("_prefix"), F.col("_a.mass").alias("_mass"), F.col("_a.before").alias("_before"))
        found = cut(found)
    more = F.greatest(F.ceil((F.col("_goal") - F.col("_mass")) / F.col("_prefix")), F.lit(1))
    return found.select(*[F.col(k).alias(c) for k, c in zip(keys, by, strict=True)], (F.col("_before") + F.when(F.col("_prefix") > 0, more).otherwise(1)).cast("long").alias("selected"))


def bus_factor(df: DataFrame, by: Sequence[str], person: str, commits: str, share: float = 0.5) -> DataFrame:
    """Per group the smallest number of top people who together have at least ``share`` of all commits; a row is a person."""
    return heaviest(df, by, commits, share).withColumnRenamed("selected", "bus_factor")


def top_contributor(df: DataFrame, by: Sequence[str], person: str, commits: str, first: str) -> DataFrame:
    """Per group the one with the most commits and the share of all commits, to three digits."""
    best = F.min_by(person, F.struct(-F.col(commits), F.col(first)))
    return df.groupBy(*by).agg(best.alias("top_contributor"), F.round(F.max(commits) / F.sum(commits), 3).alias("top_contributor_share"))


def activity(df: DataFrame, by: Sequence[str], ts: str, now: Column, windows: Sequence[int] = (30, 90)) -> DataFrame:
    """Per group counts in the last days, the last time, and whole days since, not below 0."""
    counts = [F.sum((F.col(ts) >= now - F.make_dt_interval(F.lit(d))).cast("long")).alias(f"count_{d}d") for d in windows]
    return df.groupBy(*by).agg(*counts, F.max(ts).alias("last_at"), F.greatest(F.datediff(now, F.max(ts)), F.lit(0)).cast("long").alias("days_since"))


def portfolio_flags(tier: Column, compliance: Column, data_class: Column, days_since: Column, factor: Column, top_share: Column, status: Column) -> dict[str, Column]:
    """The six portfolio predicates; nulls count as no."""
    flags = {
        "tier1": tier == "Tier 1",
        "high_risk": compliance == "HIGH_RISK",
        "pii": data_class.isin("PII", "Credit-Card"),
        "stale": days_since > 90,
        "single_owner": any_of([factor == 1, top_share > 0.8]),
        "deprecated": status.isin("DEPRECATED", "ARCHIVED"),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in flags.items()}


def portfolio_counts(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.sum(v.cast("long")).alias(k) for k, v in flags.items()])


def usage_totals(df: DataFrame, tokens_in: str, tokens_out: str, calls: str, speed: str) -> DataFrame:
    """Sums, runs and the mean speed to two digits, 0 without any."""
    return df.agg(
        F.coalesce(F.sum(tokens_in), F.lit(0)).alias("tokens_in"), F.coalesce(F.sum(tokens_out), F.lit(0)).alias("tokens_out"),
        F.coalesce(F.sum(calls), F.lit(0)).alias("tool_calls"), F.count(F.lit(1)).alias("runs"),
        F.coalesce(F.round(F.avg(speed), 2), F.lit(0.0)).alias("avg_speed"),
    )


def throughput(df: DataFrame, by: Sequence[str], text: str, seconds: str) -> DataFrame:
    """Tokens as a quarter of the characters, and tokens a second over 0.05 seconds at least."""
    out = df.groupBy(*by).agg(F.sum(F.floor(F.length(text) / 4)).alias("tokens_out"), F.sum(seconds).alias("_s"))
    return out.withColumn("tps", F.round(F.col("tokens_out") / F.greatest(F.col("_s"), F.lit(0.05)), 2)).drop("_s")


def fraud_score(amount: Column, devices: Column, recent: Column, cross_border: Column) -> Column:
    """Additive rules over a base of 0.15, at most 0.99, to two digits."""
    add = lambda cond, points: F.when(cond, points).otherwise(0.0)
    score = F.lit(0.15) + add(amount > 5000, 0.35) + add(devices > 3, 0.2) + add(recent > 5, 0.2) + add(cross_border, 0.1)
    return F.round(F.least(score, F.lit(0.99)), 2)


def pending(df: DataFrame, run: str, status: str, confidence: str, tie: str, skip: int, most: int) -> DataFrame:
    """A page of the pending items of the latest run, least sure first."""
    last = df.groupBy(run).agg(F.max("created_at").alias("_at")).orderBy(F.col("_at").desc(), F.col(run)).limit(1).select(run)
    own = df.join(F.broadcast(last), run, "left_semi").where(F.col(status) == "PENDING")
    return own.orderBy(F.col(confidence), F.col(tie)).offset(skip).limit(most)


def approved(df: DataFrame, status: str, confidence: str, at_least: float) -> DataFrame:
    """Pending items that are sure enough become approved."""
    return df.withColumn(status, F.when((F.col(status) == "PENDING") & (F.col(confidence) >= at_least), "APPROVED").otherwise(F.col(status)))


def decided(df: DataFrame, item: str, which, status: str, note: str | None = None, override: str | None = None) -> DataFrame:
    """One item approved, rejected or overridden; an override also replaces the suggestion."""
    hit = F.col(item) == F.lit(which)
    out = df.withColumn("status", F.when(hit, status).otherwise(F.col("status")))
    if note is not None:
        out = out.withColumn("reviewer_note", F.when(hit, note).otherwise(F.col("reviewer_note")))
    if override is not None:
        out = out.withColumn("llm_suggestion", F.when(hit, override).otherwise(F.col("llm_suggestion")))
    return out


def preview(df: DataFrame, most: int) -> DataFrame:
    """The first rows with whether there are more."""
    more = df.agg((F.count(F.lit(1)) > most).alias("truncated"))
    return df.limit(most).join(F.broadcast(more))


def event_timings(df: DataFrame, name: str, start: str, end: str, order: str = "name") -> DataFrame:
    """(name, duration in microseconds) of timed events: by name, or the longest first. An event that has not ended has no
    duration and comes last."""
    if order not in ("name", "duration"):
        raise ValueError("order is name or duration")
    duration = F.unix_micros(F.col(end).cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))
    out = df.select(F.col(name).alias("name"), duration.alias("duration"))
    return out.orderBy("name", "duration") if order == "name" else out.orderBy(F.col("duration").desc_nulls_last(), "name")
