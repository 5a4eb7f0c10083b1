"""Keys, hashes, casts, dates and cursors as Column functions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- keys -----------------------------------------------------------------------------------------------------------


def surrogate_key(cols: Sequence[ColumnOrName], separator: str = "-") -> Column:
    """md5 over the columns as text, nulls as empty, joined by ``separator`` ('~' in some dialects)."""
    return F.md5(F.concat_ws(separator, *[F.coalesce(_col(c).cast("string"), F.lit("")) for c in cols]))


def concat_fields(cols: Sequence[ColumnOrName]) -> Column:
    """Concatenation; one null makes the whole null."""
    return F.concat(*[_col(c) for c in cols])


def salted_hash(value: ColumnOrName, kind: str = "md5", salt: str | None = None) -> Column:
    """Hex digest of a value followed by a salt: md5, sha1, sha224, sha256, sha384 or sha512."""
    v = _col(value).cast("string")
    v = F.concat(v, F.lit(salt)) if salt else v
    if kind == "md5":
        return F.md5(v)
    if kind == "sha1":
        return F.sha1(v)
    bits = {"sha224": 224, "sha256": 256, "sha384": 384, "sha512": 512}
    if kind not in bits:
        raise ValueError(f"no such hash: {kind}")
    return F.sha2(v, bits[kind])


def base64encode(value: ColumnOrName) -> Column:
    return F.base64(F.encode(_col(value), "UTF-8"))


def base64decode(value: ColumnOrName) -> Column:
    return F.decode(F.unbase64(_col(value)), "UTF-8")


# --- casts ----------------------------------------------------------------------------------------------------------


def empty_string_to_null(value: ColumnOrName, null_words: Sequence[str] = ()) -> Column:
    """Null for '' and for any of ``null_words`` ('null' in one dialect)."""
    v = _col(value)
    return F.when(v.isin("", *null_words), F.lit(None)).otherwise(v)


def safe_cast(value: ColumnOrName, kind: str, strict: bool = False) -> Column:
    """Cast that gives null for what cannot be cast; ``strict`` raises instead."""
    v = _col(value)
    return v.cast(kind) if strict else v.try_cast(kind)


def cast_to_boolean(value: ColumnOrName, text_rule: bool = False) -> Column:
    """Boolean by cast, or with ``text_rule`` by whether the lower-cased text is 'true'."""
    v = _col(value)
    return F.lower(v.cast("string")) == "true" if text_rule else v.try_cast("boolean")


def boolean_to_string(value: ColumnOrName) -> Column:
    return _col(value).cast("string")


def array_to_string(value: ColumnOrName, separator: str = "|") -> Column:
    return F.array_join(_col(value), separator)


def to_text(value: ColumnOrName, is_text: bool = False) -> Column:
    """Text as it is; anything else as JSON."""
    return _col(value) if is_text else F.to_json(_col(value))


def combined(*maps: ColumnOrName) -> Column:
    """One map of several; a key in two of them is an error when it runs."""
    return F.map_concat(*[_col(m) for m in maps])


# --- dates ----------------------------------------------------------------------------------------------------------

#: strftime codes and the letters Spark has for them.
STRFTIME = {
    "%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%y": "yy", "%j": "DDD",
    "%z": "xx", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%p": "a", "%I": "hh", "%%": "%", "T": "'T'", "Z": "'Z'",
}


def spark_format(strftime: str) -> str:
    """A strftime format in Spark's letters; other letters are quoted."""
    out = []
    for part in re.findall(r"%.|[A-Za-z]|[^A-Za-z%]+", strftime):
        if part[0] == "%" and part not in STRFTIME:
            raise ValueError(f"no counterpart of {part}")
        out.append(STRFTIME.get(part, f"'{part}'" if part.isalpha() else part))
    return "".join(out)


def parse_datetime(value: ColumnOrName, fmt: str) -> Column:
    """Timestamp from text: %s epoch seconds, %s_as_float, %ms milliseconds, or strftime; null if it doesn't match."""
    v = _col(value)
    if fmt in ("%s", "%s_as_float"):
        return F.timestamp_micros((v.try_cast("double") * 1_000_000).cast("long"))
    if fmt == "%ms":
        return F.timestamp_millis(v.try_cast("long"))
    return F.try_to_timestamp(v, F.lit(spark_format(fmt)))


def format_datetime(value: ColumnOrName, fmt: str) -> Column:
    """Text of a timestamp by a strftime format; %s gives epoch seconds, %ms milliseconds."""
    v = _col(value)
    if fmt == "%s":
        return F.unix_seconds(v.cast("timestamp")).cast("string")
    if fmt == "%ms":
        return F.unix_millis(v.cast("timestamp")).cast("string")
    return F.date_format(v, spark_format(fmt))


def day_delta(days: int, fmt: str = "%Y-%m-%d") -> Column:
    return F.date_format(F.date_add(F.current_date(), days), spark_format(fmt))


def duration(iso: str) -> Column:
    """Interval literal from ISO 8601 days, hours, minutes and seconds; months and years as a year-month interval."""
    m = re.fullmatch(r"P(?:(\d+)Y)?(?:(\d+)M)?(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?", iso)
    if not m or not any(m.groups()):
        raise ValueError(f"no ISO 8601 duration: {iso}")
    y, mo, w, d, h, mi, s = (int(g or 0) for g in m.groups())
    if y or mo:
        if w or d or h or mi or s:
            raise ValueError(f"months and days do not mix: {iso}")
        return F.expr(f"make_ym_interval({y}, {mo})")
    return F.expr(f"make_dt_interval({7 * w + d}, {h}, {mi}, {s})")


def clamp(value: ColumnOrName, low: ColumnOrName | None, high: ColumnOrName | None) -> Column:
    """At least ``low``, then at most ``high``."""
    v = _col(value)
    v = F.greatest(v, _col(low)) if low is not None else v
    return F.least(v, _col(high)) if high is not None else v


def iso_text(value: ColumnOrName, digits: int = 6) -> Column:
    return F.date_format(_col(value), "yyyy-MM-dd'T'HH:mm:ss." + "S" * digits + "'Z'")


def next_billing(start: ColumnOrName, cycle: ColumnOrName) -> Column:
    """Yearly cycles last 365 days, all others 30."""
    return F.date_add(_col(start), F.when(F.lower(_col(cycle)).isin("yearly", "annual"), 365).otherwise(30))


# --- cursors --------------------------------------------------------------------------------------------------------


def without_nul(value: ColumnOrName) -> Column:
    return F.regexp_replace(_col(value), "\u0000", "")


def lsn_to_long(value: ColumnOrName) -> Column:
    """hi/lo hexadecimal log position as one 64-bit number."""
    part = F.split(_col(value), "/")
    return F.conv(F.concat(part[0], F.lpad(part[1], 8, "0")), 16, -10).cast("long")


def long_to_lsn(value: ColumnOrName) -> Column:
    v = _col(value)
    return F.concat_ws("/", F.hex(F.shiftrightunsigned(v, 32)), F.hex(v.bitwiseAND(F.lit(0xFFFFFFFF))))


def cursor_order(value: ColumnOrName, kind: str) -> Column:
    """Ordering of cursor values: nulls smallest; numbers as double, text by code point."""
    cast = {"number": "double", "integer": "double", "boolean": "boolean"}.get(kind, "string")
    return _col(value).try_cast(cast).asc_nulls_first()


def hashed_features(amount: ColumnOrName, user: ColumnOrName, currency: ColumnOrName, age_days: ColumnOrName) -> list[Column]:
    """Feature scaling of the demo model; a stable hash takes the place of a salted one."""
    return [
        _col(amount).cast("double").alias("amount"), F.pmod(F.xxhash64(_col(user)), F.lit(100)).alias("user_bucket"),
        F.pmod(F.xxhash64(_col(currency)), F.lit(50)).alias("currency_bucket"), (_col(age_days) / 365).alias("age_years"),
    ]


def any_of(conditions: Sequence[Column]) -> Column:
    """Null-safe or."""
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions], F.lit(False))
