"""Identifiers, names and labels as Column functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from heddle.functions.values import _col


def quoted(name: str) -> str:
    """A name in backticks."""
    return "`" + name.replace("`", "``") + "`"


def identifier(value) -> Column:
    """Anything but letters, digits and underscores becomes an underscore."""
    return F.regexp_replace(_col(value), "[^A-Za-z0-9_]", "_")


def table_name(value) -> Column:
    """An identifier that does not begin with a digit."""
    v = identifier(value)
    return F.when(v.rlike("^[0-9]"), F.concat(F.lit("_"), v)).otherwise(v)


def raw_table_name(stream, prefix: str = "_raw_") -> Column:
    return F.concat(F.lit(prefix), identifier(stream))


def unique_names(names: Iterable[str], longest: int = 63) -> dict[str, str]:
    """Column names that differ without regard to case and fit ``longest``: later ones get _1, _2, ..."""
    out: dict[str, str] = {}
    taken: set[str] = set()
    for name in names:
        base = name if len(name) <= longest else name[: (longest - 2) // 2] + "__" + name[-((longest - 2) // 2) :]
        new, n = base, 0
        while new.lower() in taken:
            n += 1
            new = f"{base[: longest - len(str(n)) - 1]}_{n}"
        taken.add(new.lower())
        out[name] = new
    return out


def with_clean_keys(value) -> Column:
    """A string map with its keys, and beside them the keys with quotes and backticks as underscores; the original wins."""
    m = _col(value)
    clean = F.transform_keys(m, lambda k, v: F.regexp_replace(k, "[\"'`]", "_"))
    more = F.map_filter(clean, lambda k, v: ~F.map_contains_key(m, k))
    return F.map_concat(m, more)


def logical_name(value) -> Column:
    """Dependency name without scheme, api prefix, version path, sdk or api suffix and domain; lower case."""
    v = F.regexp_replace(_col(value), "^https?://", "")
    for pattern in (r"(?i)^api\.", r"/v[0-9]+.*$", r"(?i)[-_](sdk|api)$", r"(?i)\s+(sdk|api)$", r"(?i)\.(com|io|org|net)$"):
        v = F.regexp_replace(v, pattern, "")
    return F.lower(F.regexp_replace(v, "[-_]", "_"))


def squashed(value) -> Column:
    """Lower case without underscores."""
    return F.lower(F.regexp_replace(_col(value), "_", ""))


def simple_name(value) -> Column:
    """Last dotted segment."""
    return F.element_at(F.split(_col(value), r"\."), -1)


def repo_namespace(url) -> Column:
    """owner/repo of a hosting URL, upload/<name> for an upload, else unknown."""
    v = F.regexp_replace(F.coalesce(_col(url), F.lit("")), r"(\.git)?/*$", "")
    pair = F.regexp_extract(v, r"[/:]([^/:]+/[^/:]+)$", 1)
    upload = F.regexp_extract(v, r"^upload:/*(.+)$", 1)
    return F.when(upload != "", F.concat(F.lit("upload/"), upload)).when(pair != "", pair).otherwise(F.lit("unknown"))


def qualified_name(path, element, package=None) -> Column:
    """Dotted name of a code element: its package if it has one (Java, C#), else the path without its extension."""
    p = F.regexp_replace(_col(path), r"\\", "/")
    base = F.regexp_replace(F.regexp_replace(p, r"\.[^./]*$", ""), "/", ".")
    pack = F.coalesce(_col(package), F.lit("")) if package is not None else F.lit("")
    own = p.rlike(r"\.(java|cs)$") & (pack != "")
    return F.concat_ws(".", F.when(own, pack).otherwise(base), _col(element))


def capitalised_words(value) -> Column:
    return F.regexp_extract_all(_col(value), F.lit(r"\b([A-Z][A-Za-z0-9_]*)"), 1)


def single_spaced(value) -> Column:
    return F.nullif(F.trim(F.regexp_replace(_col(value), r"\s+", " ")), F.lit(""))


def humanized(value) -> Column:
    """Dashes and underscores as spaces, words with a capital."""
    v = F.split(F.regexp_replace(_col(value), "[_-]+", " "), " ")
    return F.array_join(F.transform(v, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 20))), " ")


def compact_label(value, most_words: int = 6, most_chars: int = 42) -> Column:
    """A sentence cut to a short edge label: no closing marks or leading modal verb, ends before a connecting word,
    before a conjunction if it is still long, then after ``most_words`` words or ``most_chars`` characters."""
    whole = single_spaced(value)
    v = F.regexp_replace(F.regexp_replace(whole, r"[.?!]+$", ""), r"(?i)^(may|can|could|should|would|might)\s+", "")
    v = F.regexp_replace(v, r"(?i)^(.+?)\s(?:through|via|using|with|to|for|from|into)\s.*$", "$1")
    long = F.size(F.split(v, r"\s+")) > most_words
    v = F.when(long, F.regexp_replace(v, r"(?i)^(.+?)\s(?:and|but|while)\s.*$", "$1")).otherwise(v)
    v = F.array_join(F.slice(F.split(v, r"\s+"), 1, most_words), " ")
    v = F.when(F.length(v) > most_chars, F.concat(F.rtrim(F.substring(v, 1, most_chars - 1)), F.lit("…"))).otherwise(v)
    return F.when(v == "", whole).otherwise(v)


def protocol_of_port(port) -> Column:
    """Protocol usual on a port; TCP for others."""
    p = _col(port).cast("int")
    known = {80: "HTTP", 8080: "HTTP", 443: "HTTPS", 5432: "PostgreSQL", 3306: "MySQL", 6379: "Redis", 27017: "MongoDB", 9092: "Kafka", 5672: "AMQP"}
    out = F
    for k, v in known.items():
        out = out.when(p == k, v)
    return out.otherwise("TCP")


def named_volume(spec) -> Column:
    """Name of a volume in name:path; null for paths of the host."""
    name = F.split(_col(spec), ":")[0]
    return F.when(name.rlike(r"^[./~]") | ~_col(spec).contains(":"), F.lit(None)).otherwise(name)


def terraform_resources(text) -> Column:
    """resource "type" "name" pairs of a Terraform text, as type.name."""
    kinds = F.regexp_extract_all(_col(text), F.lit(r'resource\s+"([^"]+)"\s+"([^"]+)"'), 1)
    names = F.regexp_extract_all(_col(text), F.lit(r'resource\s+"([^"]+)"\s+"([^"]+)"'), 2)
    return F.zip_with(kinds, names, lambda a, b: F.concat_ws(".", a, b))
