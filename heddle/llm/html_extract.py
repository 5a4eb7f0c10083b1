"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags. Words score positive and tags negative; one linear scan finds the contiguous
region with the highest sum. All weights come from labelled pages: pages whose markup names their article label every
token as inside or outside. A tag's weight is how much more often it stands outside. A word's score falls by the worst
weight among the elements it stands in; an element is described by its tag, its role and the words of its class and id,
and the weights of these features are learned as a decision list: the feature that is most surely outside explains the
words below it, then the next one is chosen by the words that are left. Words of the best region with a score above 0 are
the text.

A name of an article is no feature: the scan alone decides where the text lies. Tags that HTML itself defines as
navigation, forms and the like have a fixed weight. For features that labelled pages don't show there is a prior of so
many outside words; the labels outweigh it.

Defined results: a null html is empty; a page without content gives an empty text; broken markup (unclosed tags, cut
references) is read as far as it goes; null ids and repeated rows stay; a very long page is read whole, in linear time;
without labelled pages the priors decide; all columns but the html stay, whatever their names, one named ``text`` as
``text_in``; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import in_batches, slices, table

#: Labelled pages the weights are fitted on, at most: those with the smallest hashes.
TRAINING_PAGES = 1000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|noscript|template|svg|iframe|textarea|select|title)\b.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"(?P<name>class|id|role|hidden|aria-hidden)\s*(?:=\s*(?:\"(?P<a>[^\"]*)\"|'(?P<b>[^']*)'|(?P<c>[^\s>]+)))?", re.IGNORECASE)

#: Elements that HTML defines as something else than content, and roles that say so.
NEVER_TAGS = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "head"}
NEVER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu"}
#: Words of a class or id with a prior: what such elements hold on most sites.
PRIOR_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banner", "cookie",
    "cookies", "consent", "notice", "notices", "popup", "newsletter", "subscribe", "nav", "navbar", "navigation", "menu",
    "menus", "breadcrumb", "breadcrumbs", "sidebar", "footer", "header", "comment", "comments", "form",
}
#: Outside words that the prior counts for, and the words below which a feature of labelled pages says nothing.
PRIOR, LEAST_WORDS = 50, 5
#: Elements without an end tag, and those whose text runs on in the block around them.
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ARTICLE = {"article", "main"}
#: Their start tags end an open paragraph.
BLOCKS = {"p", "div", "ul", "ol", "li", "table", "tr", "td", "th", "section", "article", "main", "nav", "header", "footer", "aside", "form", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "dl", "dt", "dd", "figure"}

#: Elements that say nothing of what they hold: of features that explain the same words they come last.
GENERIC = {"div", "p", "section", "ul", "ol", "li", "table", "tr", "td", "th", "dl", "dt", "dd"}

#: Class words that say what an element stands beside rather than what it is.
BESIDE = {"has", "with", "no", "without"}

WORD_SCORE = 1.0
#: Lowest score of a tag; the score of a tag that the labelled pages don't show.
LOWEST_TAG, OTHER_TAG = -2.0, -0.5
#: Lowest weight of a feature, that of fixed ones and of priors (so that an advert does not part an article), and the log
#: odds above which a feature says nothing.
LOWEST, ODDS = -1.3, -1.0


def features(tag: str, attrs: str, inside: bool) -> list[str]:
    """What describes an element: <tag, @role, .word of its class or id, !hidden. A header inside an article is the
    article's own."""
    out = [f"<{tag}"] if tag not in ("html", "body", *ARTICLE, *INLINE) and not (inside and tag == "header") else []
    if not attrs.strip() or tag in ("html", "body", *ARTICLE):
        return out
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m["name"].lower(), (m["a"] or m["b"] or m["c"] or "").lower()
        if name in ("class", "id"):
            found = set(re.findall(r"[a-z]+", value))
            if not found & BESIDE:
                out += sorted(f".{w}" for w in found if not (inside and w == "header"))
        elif name == "role":
            out.append(f"@{value}")
        elif name == "hidden" or value == "true":
            out.append("!hidden")
    return out


def fixed(feature: str) -> bool:
    return feature == "!hidden" or feature[1:] in (NEVER_TAGS if feature[0] == "<" else NEVER_ROLES if feature[0] == "@" else ())


def feature_weight(feature: str, weights: dict[str, float]) -> float:
    """At most 0: fixed, learned, or by the prior."""
    if fixed(feature):
        return LOWEST
    known = weights.get(feature)
    return known if known is not None else LOWEST if feature[0] == "." and feature[1:] in PRIOR_WORDS else 0.0


def tokens(html: str) -> Iterator[tuple[str, str, bool, tuple[str, ...]]]:
    """(kind, value, inside an article element, features of the elements around, outermost first); kind: tag, text."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    depth: Counter = Counter()
    around: tuple[str, ...] = ()

    def pop() -> None:
        nonlocal around
        tag, around = stack.pop()
        depth[tag] -= 1

    for m in TOKEN.finditer(html):
        inside = depth["article"] + depth["main"] > 0
        if m["text"] is not None:
            yield "text", entities.unescape(m["text"]), inside, around
            continue
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if m["close"]:
            yield "tag", tag, inside, around
            if depth[tag] and (tag in BLOCKS or tag in INLINE or stack[-1][0] == tag or tag in ("html", "body")):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        attrs = m["attrs"] or ""
        if tag in BLOCKS and stack and stack[-1][0] == "p" and not attrs.endswith("/"):
            pop()
        if tag in ("li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
            pop()
        if tag not in VOID and not attrs.endswith("/"):
            stack.append((tag, around))
            depth[tag] += 1
            # What is open without an end, thousands of times, says the same once.
            around += tuple(f for f in features(tag, attrs, inside) if f not in around)
        yield "tag", tag, depth["article"] + depth["main"] > 0, around


def token_counts(html: str) -> Counter:
    """Counts of a page that labels its own article: (tag, inside) of tags, (features, inside) of words, the features joined
    by blanks; empty for others."""
    out: Counter = Counter()
    seen = False
    for kind, value, inside, around in tokens(html):
        if kind == "tag":
            out[value, inside] += 1
        elif n := len(value.split()):
            bad = any(map(fixed, around))
            seen |= inside and not bad
            out[" " + " ".join(around), inside and not bad] += n
    return out if seen else Counter()


def decision_list(words: Counter) -> dict[str, float]:
    """Weights of features from counts of (features, inside): the surest one first; what it explains counts no more for
    the others. Those that are seen inside otherwise weigh nothing."""
    left = {k: n for k, n in words.items() if not any(map(fixed, k[0]))}
    seen = {f for (around, inside), n in left.items() if inside for f in around}
    out: dict[str, float] = {}
    while True:
        count: dict[str, list[float]] = {}
        for (around, inside), n in left.items():
            for place, f in enumerate(around):
                c = count.setdefault(f, [0, 0, 0])
                c[0 if inside else 1] += n
                c[2] = max(c[2], place)
        best = None
        for f, (here, away, place) in count.items():
            prior = PRIOR if f[0] == "." and f[1:] in PRIOR_WORDS else 0
            odds = math.log((here + 1) / (away + prior + 1))
            if odds < ODDS and away >= LEAST_WORDS:
                rank = (odds, -away, f[0] == "<" and f[1:] in GENERIC, place, f)
                best = min(best or rank, rank)
        if best is None:
            return {f: 0.0 for f in seen} | out
        out[best[-1]] = max(LOWEST, best[0])
        left = {k: n for k, n in left.items() if best[-1] not in k[0]}


def weights_of(counts: Counter) -> dict[str, float]:
    """Scores of tags: the log odds of standing outside rather than inside, beside those of words; between LOWEST_TAG and
    -0.05. Besides, the weights of features."""
    words = Counter({(tuple(k.split()), inside): n for (k, inside), n in counts.items() if k[:1] == " "})
    total = {i: sum(n for (_, inside), n in words.items() if inside == i) for i in (True, False)}
    base = math.log((total[True] + 1) / (total[False] + 1))
    out = decision_list(words)
    for tag in {t for t, _ in counts if t[:1] != " "}:
        odds = math.log((counts[tag, True] + 1) / (counts[tag, False] + 1))
        out[tag] = max(LOWEST_TAG, min(-0.05, odds - base))
    return out


def best_region(scores: list[float]) -> tuple[int, int]:
    """Begin and end of the contiguous region with the highest sum above 0, the first and shortest of equals; (0, 0) if
    there is none."""
    best, span, total, begin = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        total += s
        if total <= 0:
            total, begin = 0.0, i + 1
        elif total > best:
            best, span = total, (begin, i + 1)
    return span


def main_text(html: str | None, weights: dict[str, float]) -> str:
    """The text of the best region of a page, its blocks joined by single spaces."""
    worst: dict[tuple[str, ...], float] = {(): 0.0}
    parts, scores = [], []
    for kind, value, _, around in tokens(html or ""):
        if around not in worst:
            worst[around] = min(feature_weight(f, weights) for f in around)
        word = WORD_SCORE + worst[around]
        parts.append((kind, value, word > 0))
        scores.append(word * len(value.split()) if kind == "text" else weights.get(value, OTHER_TAG))
    begin, end = best_region(scores)
    out = []
    for kind, value, good in parts[begin:end]:
        if kind == "tag":
            out.append("" if value in INLINE else " ")
        elif good:
            out.append(value)
    return " ".join("".join(out).split())


def fit_weights(pages: DataFrame, html_col: str = "html", id_col: str = "page_id", most: int = TRAINING_PAGES) -> dict[str, float]:
    """Weights from the pages of at most ``most`` ids: those that come first by their hash. The ids are chosen without
    their pages and then broadcast, ``most`` rows; executors count, the driver gets one row per tag and one per different set
    of features."""
    ids = pages.select(F.col(f"`{id_col}`").alias("id")).where("id IS NOT NULL").distinct().orderBy(F.xxhash64("id"), "id").limit(most)
    some = in_batches(pages).select(F.col(f"`{html_col}`").alias("html"), F.col(f"`{id_col}`").alias("id")).join(F.broadcast(ids), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for h in batch.column(0):
                total.update(token_counts(h.as_py() or ""))
        rows = [(t, inside, n) for (t, inside), n in total.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["tag", "inside", "n"])

    counted = some.select("html").mapInArrow(run, "tag string, inside boolean, n long").groupBy("tag", "inside").agg(F.sum("n").alias("n"))
    return weights_of(Counter({(r.tag, r.inside): r.n for r in counted.collect()}))


def extract(pages: DataFrame, weights: dict[str, float], html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text``. A column named ``text`` in the input is kept as ``text_in``."""
    own = [c for c in pages.columns if c != html_col]
    names = ["text_in" if c == "text" else c for c in own]
    cols = [F.col(f"`{c}`").alias(n) for c, n in zip(own, names, strict=True)]
    schema = pages.select(*cols, F.lit("").alias("text")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = pa.array([main_text(h.as_py(), weights) for h in batch.column(batch.num_columns - 1)], type=pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], text], names=[*names, "text"])

    return in_batches(pages).select(*cols, F.col(f"`{html_col}`")).mapInArrow(run, schema)


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    pages = table(spark, sf_dir, "pages")
    out = extract(pages.select("page_id", "url", "html"), fit_weights(pages))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
