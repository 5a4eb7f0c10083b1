"""Secret scans by assignment-aware lexing.

Three base patterns are found as they stand. Besides, a lexer reads source and configuration syntax once from left to
right. Its states are code, comment, string and block (text in triple quotes); an assignment is a name
followed by ``=``, ``:=``, ``=>`` or ``:`` and a value of literals, bare words and names joined by ``+``:
``name = "literal"``, ``name: literal``, ``"name": "literal"``, ``name => 'literal'``, ``cfg["name"] = "literal"``,
``export NAME=literal``, ``<name>literal</name>``. Assignments in comments count, as disabled configuration does.

Constants are propagated by reference: the value of a name is a place in the text, or a sequence of values that it refers
to, so no value is ever copied into another, however long it is and of however many parts. What a score needs to know of a
value (its length, which characters it has, how many words) is counted once for each place and added up for sequences. A
literal is a secret if the score of its target name and that of the value together reach THRESHOLD; private keys, wrapped
lines of a credential and phrases of words have scores of their own.

Every character is read a bounded number of times: the time is linear in the length of a text, however long its names and
values are and however often constants refer to each other.

Defined results: a null text is empty and has no spans; null ids and repeated rows stay; very long texts are scanned
whole; an empty table gives an empty result; other columns are not read, whatever their names. Spans are in code points,
the end exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import in_batches, slices, table

KINDS = ("assign", "access", "hex", "lexed")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

#: Parts of names that mark a secret, with their scores; a name is cut at underscores, dashes, dots and case changes.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 2.5, "secret": 3.0, "token": 2.5, "apikey": 3.0,
    "credential": 2.5, "credentials": 2.5, "auth": 1.0, "bearer": 2.0, "private": 1.0, "access": 1.0, "api": 1.0,
    "key": 1.0, "salt": 1.5, "signing": 1.5, "client": 0.5, "session": 0.5,
}
#: What a name and its literal have to score together.
THRESHOLD = 4.0
#: Characters of a value up to which words like "example" make it a placeholder; words of a phrase that may be a secret, and
#: its characters at least; and characters that a word of a wrapped credential has on average.
SHORT, PHRASE, PHRASE_CHARS, WRAPPED = 100, (3, 12), 16, 16
#: Lengths beyond this count as this: constants may double each other.
HUGE = 1 << 40

#: One token of code. Runs are possessive: a character that has been read is not read again. Strings end at their line.
TOKEN = re.compile(
    r"""(?P<string>\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+')
    |(?P<comment>\#|//|/\*|\*/|<!--|-->|--(?=\s))
    |</(?P<close>[A-Za-z_][A-Za-z0-9_.\-]*+)>|<(?P<open>[A-Za-z_][A-Za-z0-9_.\-]*+)>
    |(?P<word>[A-Za-z0-9_][A-Za-z0-9_/.\-]*+)
    |(?P<op>:=|=>|==|::|=|:)
    |(?P<plus>\+)|(?P<index>[\[\]])|(?P<line>\n)|(?P<gap>[\x20\t\r]++)|(?P<other>.)""",
    re.VERBOSE | re.ASCII | re.DOTALL,
)
#: A value without quotes goes on over signs that names don't have.
BARE = re.compile(r"[A-Za-z0-9_+/.=\-]++", re.ASCII)
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.\-]*+\Z", re.ASCII)
#: Letters that may stand before a string.
PREFIXES = {"b", "r", "u", "f", "br", "rb", "fr", "rf"}
#: A word that an apostrophe goes on with, unless it is the prefix of a string.
INSIDE = re.compile(r"[^\W\d_]{3}\Z|(?<![^\W\d_])(?!(?:[bru]|br|rb|fr|rf|f)\Z)[^\W\d_]{1,2}\Z", re.IGNORECASE)
PLACEHOLDER = re.compile(r"x{4,}|\*{3,}|\.{3}|change.?me|example|placeholder|your[_-]|dummy|redacted|todo|^(?:none|null|true|false|undefined)$", re.IGNORECASE)
CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    """How much a target name points to a secret."""
    parts = [p.lower() for p in CAMEL.findall(name)]
    joined = {a + b for a, b in zip(parts, parts[1:], strict=False)}
    return sum(SENSITIVE.get(p, 0.0) for p in {*parts, *joined})


class Stats:
    """What a score needs to know of a value: length, how often it has each character (others than ASCII in 128 classes), words, ends
    of up to EDGE characters, and whether it has line breaks, is marked as a placeholder or as a private key."""

    __slots__ = ("n", "counts", "words", "head", "tail", "lines", "placeholder", "key")
    EDGE = 16

    @classmethod
    def of(cls, text: str) -> Stats:
        out = cls()
        out.n, out.words, out.lines = len(text), len(text.split()), "\n" in text
        out.counts = Counter(text)
        for c in [c for c in out.counts if c > "\x7f"]:
            n = out.counts.pop(c)
            out.counts[chr(128 + ord(c) % 128)] += n
        out.head, out.tail = text[: cls.EDGE], text[-cls.EDGE :]
        out.placeholder = bool(PLACEHOLDER.search(text))
        out.key = ("-----BEGIN" in text) + 2 * ("PRIVATE KEY" in text)
        return out

    @classmethod
    def joined(cls, parts: list[Stats]) -> Stats:
        """Of values one after the other."""
        out = cls()
        out.n, out.words, out.lines, out.placeholder, out.key = 0, 0, False, False, 0
        out.counts, out.head, out.tail = Counter(), "", ""
        for p in parts:
            if out.n < HUGE:
                out.n += p.n
                out.words += p.words
                out.counts.update(p.counts)
            out.lines, out.key = out.lines or p.lines, out.key | p.key
            out.placeholder = out.placeholder or p.placeholder or bool(PLACEHOLDER.search(out.tail + p.head))
            if len(out.head) < cls.EDGE:
                out.head = (out.head + p.head)[: cls.EDGE]
            out.tail = (out.tail + p.tail)[-cls.EDGE :]
        return out

    def score(self) -> float:
        """How much a value looks like a credential: 0 for short ones and placeholders, up to 3."""
        if self.key == 3:
            return 3.0
        if self.n < 8 or self.placeholder and self.n <= SHORT:
            return 0.0
        bits = -sum(c / self.n * math.log2(c / self.n) for c in self.counts.values())
        if bits < 2.0:
            return 0.0
        if any(c.isspace() for c in self.counts if c <= "\x7f") and self.n < WRAPPED * self.words:
            phrase = PHRASE[0] <= self.words <= PHRASE[1] and self.n >= PHRASE_CHARS and not self.lines
            return 1.0 if phrase else 0.0
        signs = "".join(self.counts)
        kinds = sum(bool(re.search(p, signs)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
        return min(3.0, 0.5 + 0.3 * bits + 0.4 * (kinds - 1))


def literal_score(value: str) -> float:
    """How much a literal looks like a credential."""
    return Stats.of(value).score()


class Value:
    """A place in a text, or values one after the other."""

    __slots__ = ("start", "end", "parts", "stats", "told")

    def __init__(self, start: int = 0, end: int = 0, parts: tuple[Value, ...] = ()) -> None:
        self.start, self.end, self.parts = start, end, parts
        self.stats: Stats | None = None
        #: Whether its places are among the spans already.
        self.told = False

    def known(self, text: str) -> Stats:
        """Its statistics; each value below it is looked at once, whoever refers to it."""
        stack = [self]
        while stack:
            v = stack[-1]
            if v.stats is None and (missing := [p for p in v.parts if p.stats is None]):
                stack += missing
                continue
            if v.stats is None:
                v.stats = Stats.joined([p.stats for p in v.parts]) if v.parts else Stats.of(text[v.start : v.end])
            stack.pop()
        return self.stats

    def places(self) -> Iterator[tuple[int, int]]:
        """Places below it that no one has asked for before."""
        stack = [self]
        while stack:
            v = stack.pop()
            if not v.told:
                v.told = True
                stack += v.parts
                if not v.parts and v.end > v.start:
                    yield v.start, v.end


class Lexer:
    """Reads a text once; ``pairs`` yields (name, value) of its assignments, in order."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.constants: dict[str, Value] = {}
        #: Up to where a quote of a kind is known not to be closed.
        self.open_until = {'"': 0, "'": 0, '"""': 0, "'''": 0}

    def token(self, at: int) -> tuple[str, int]:
        """(kind, end) of the token at ``at``. A quote that its line does not close is one of its own, and so are all that
        follow there: the line is not searched again. An apostrophe within a word opens nothing."""
        text = self.text
        sign = text[at]
        if sign in "\"'":
            if self.open_until[sign] > at or sign == "'" and INSIDE.search(text[max(at - 3, 0) : at]):
                return "other", at + 1
            if text.startswith(sign * 3, at) and self.open_until[sign * 3] <= at:
                close = text.find(sign * 3, at + 3)
                if close >= 0:
                    return "block", close + 3
                self.open_until[sign * 3] = len(text)
        m = TOKEN.match(text, at)
        if m.lastgroup == "other" and sign in "\"'":
            end = text.find("\n", at)
            self.open_until[sign] = len(text) if end < 0 else end
        return m.lastgroup, m.end()

    def pairs(self) -> Iterator[tuple[str, Value]]:
        text, at, end = self.text, 0, len(self.text)
        name = element = None  # what an assignment would go to; the open element and where its text begins
        while at < end:
            start = at
            kind, at = self.token(start)
            if kind == "word":
                word = text[start:at]
                name = word if NAME.match(word) else None
            elif kind == "string":
                # "name": value, or the index of cfg["name"] = value.
                inner = text[start + 1 : at - 1]
                name = inner if NAME.match(inner) else None
            elif kind == "op" and name and text[start:at] not in ("==", "::"):
                at, parts = self.value(at)
                if parts:
                    yield self.assigned(name, parts)
                name = None
            elif kind == "open":
                element, name = (text[start + 1 : at - 1], at), None
            elif kind == "close":
                if element and element[0] == text[start + 2 : at - 1] and start > element[1]:
                    inner = text[element[1] : start]
                    if "<" not in inner and ">" not in inner:
                        yield self.assigned(element[0], [Value(element[1], start)])
                element = name = None
            elif kind != "gap" and text[start] != "]":
                # A sign of a comment or of anything else ends what stood before it; what follows is read like code.
                name = None

    def value(self, at: int) -> tuple[int, list[Value]]:
        """Where the value that begins at ``at`` ends, and what it is joined from."""
        text, parts, n = self.text, [], len(self.text)

        def past_gap(at: int) -> int:
            return self.token(at)[1] if at < n and text[at] in " \t\r" else at

        while True:
            at = past_gap(at)
            kind, end = self.token(at) if at < n else ("", at)
            if kind == "string":
                parts.append(Value(at + 1, end - 1))
            elif kind == "block":
                parts.append(Value(at + 3, end - 3))
            elif kind == "word" and end < n and text[end] in "\"'" and text[at:end].lower() in PREFIXES:
                at = end
                continue
            elif kind == "word" or kind == "plus" and not parts:
                if (known := self.constants.get(text[at:end])) is not None:
                    parts.append(known)
                else:
                    end = BARE.match(text, at).end()
                    parts.append(Value(at, end))
            else:
                return at, parts
            at = end
            after = past_gap(at)
            if after >= n or text[after] != "+":
                return at, parts
            at = after + 1

    def assigned(self, name: str, parts: list[Value]) -> tuple[str, Value]:
        own = self.constants[name] = parts[0] if len(parts) == 1 else Value(parts=tuple(parts))
        return name, own


def lexed_spans(text: str) -> list[tuple[int, int]]:
    """Spans of literals that are secrets by the names they are assigned to, directly or through other names."""
    out: list[tuple[int, int]] = []
    for name, value in Lexer(text).pairs():
        score = name_score(name)
        if score >= 1.0 and (own := value.known(text).score()) and score + own >= THRESHOLD:
            out += value.places()
    return sorted(out)


def scan(text: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all spans of a text, in order; kind is a place in KINDS.

    A lexed span inside a base span adds nothing and is left out.
    """
    text = text or ""
    low = text.encode("utf-8", "surrogatepass").lower()
    out = []
    if any(k in low for k in (b"passw", b"secret", b"token", b"api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = sorted((s, e) for s, _, e in out)
    # Both lists are sorted: the furthest end of the base spans that begin at or before a lexed one decides.
    i, reach = 0, -1
    if any(c in text for c in "=:<"):
        for s, e in lexed_spans(text):
            while i < len(base) and base[i][0] <= s:
                reach = max(reach, base[i][1])
                i += 1
            if e > reach:
                out.append((s, 3, e))
    return sorted(out)


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind, start, end>>) of every row of ``df``."""
    kind = "id long, spans array<struct<kind:string,start:int,end:int>>"
    entry = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, type=entry)], names=["id", "spans"])

    return in_batches(df).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`")).mapInArrow(run, kind)


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all documents with the counts and the digest of the base ones."""
    out = secret_spans(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column | str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.sha2(joined(F.filter("spans", lambda s: s["kind"] != "lexed")), 256)
    return out.select(F.col("id").alias("doc_id"), count("assign"), count("access"), count("hex"), base.alias("base_sha256"), joined("spans").alias("spans"), count("lexed"))
