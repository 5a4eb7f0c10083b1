"""Packing by vector bin packing with the dot-product heuristic.

An example is a vector (tokens, 1 segment, loss-bearing tokens); a sequence has a capacity in each dimension. Sequences
are filled one at a time: of the examples that still fit, the one whose vector has the largest dot product with what the
sequence has left goes in, each dimension weighted by how much of it the examples ask for. Where documents may be cut,
a sequence that nothing fits any more is filled up with the head of the example that scores best.

Packing runs where the rows are read, in windows of bounded size, with no shuffle: what a window leaves open goes on
into the next, and what a task leaves open at its end is cut into sequences whose lengths are powers of two, which need
no padding.

Defined results: a null text is empty, an empty document is its end token alone; null ids and repeated rows are packed
like any other; a very long text is encoded whole and its full sequences go out at once; examples alike in all dimensions
tie and go in the order they came; an empty table gives an empty result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import give_back, in_batches, quiet_threads, slices, table

#: Capacity of a sequence: tokens, segments, loss-bearing tokens.
LIMITS = (1024, 256, 1024)
#: The same for conversations, where each of the three may be the one that runs out.
CONVERSATION_LIMITS = (1024, 8, 512)
#: A window is packed when it holds so many examples or so many bytes of ids.
WINDOW_ROWS, WINDOW_BYTES = 4096, 32 << 20
#: Words whose ids a tokenizing worker remembers.
CACHE_WORDS = 200_000

TOKENIZER = "byte_bpe_50k.json"


#: Words up to this code point are split alike by every version of the tables of letters and digits.
SETTLED = "\u0250"


def _byte_signs() -> dict[str, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself if it is printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(path: str) -> dict[bytes, int] | None:
    """Bytes to id of a byte-level BPE file whose ids rise in the order of its merges, so that ids are ranks; else None."""
    model = json.loads(Path(path).read_text(encoding="utf-8"))
    if model.get("normalizer") or (model.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or model["model"]["type"] != "BPE":
        return None
    vocab, merges = model["model"]["vocab"], model["model"]["merges"]
    made = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in merges]
    special = {t["content"] for t in model.get("added_tokens", ())}
    signs = _byte_signs()
    if any(x >= y for x, y in zip(made, made[1:], strict=False)) or any(c not in signs for t in vocab if t not in special for c in t):
        return None
    return {bytes(signs[c] for c in t): i for t, i in vocab.items() if t not in special}


class Ids:
    """Token ids of texts as little-endian 32-bit bytes, by the tokenizers file ``path``.

    A byte-level pre-tokenizer starts a new piece at every single space or newline between two non-space characters, so
    such a text is the sequence of its words' ids and a word is encoded once while a worker remembers it. New words go
    through the same vocabulary as ranks, several times as fast; words beyond Latin letters and texts with other white
    space go through the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        quiet_threads()
        self.path, self.tokenizer = path, None
        self.cache = Words(self.word)
        self.ranked = None
        added = json.loads(Path(path).read_text(encoding="utf-8")).get("added_tokens", ())
        self.added = [t["content"] for t in added]
        if ranks := _ranks(path):
            import public_tokenizers
            import tiktoken

            self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        del ranks
        give_back()

    def word(self, word: str) -> bytes:
        if not self.ranked or max(word) >= SETTLED:
            return self.whole(word)
        ids = self.ranked(word)
        return struct.pack(f"<{len(ids)}I", *ids)

    def whole(self, text: str) -> bytes:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def of(self, text: str) -> bytes:
        if not text:
            return b""
        # A token of its own, such as the end of a text, is one id wherever it stands.
        if any(t in text for t in self.added):
            return self.whole(text)
        # Single spaces and newlines between words, and no other white space: as many words as gaps and one, and no
        # character besides theirs.
        found, gaps = text.split(), text.count(" ") + text.count("\n")
        if len(found) != gaps + 1 or sum(map(len, found)) + gaps != len(text) or "\x00" in text:
            return self.whole(text)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        return b"".join(map(self.cache.__getitem__, text.replace("\n", "\x00\n\x00").replace(" ", "\x00 ").split("\x00")))


class Words(dict):
    """Ids of words; a new one is encoded when it is asked for."""

    def __init__(self, encode) -> None:
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = self.encode(word)
        return ids


@dataclass
class Item:
    """What is left of an example: its place in the document and its ids."""

    doc: int | None
    start: int
    ids: bytes
    loss: int
    total: int


class Packer:
    """Packs items into sequences; ``emit(item, start, length, sequence, offset)`` gets every piece."""

    def __init__(self, limits: tuple[int, int, int], emit, first_sequence: int = 0) -> None:
        self.limits, self.emit, self.sequence = limits, emit, first_sequence
        self.open: list[Item] = []
        self.bytes = 0

    def add(self, item: Item) -> None:
        """Full sequences of a long document go out at once, the tail waits. Loss tokens are spread evenly over it."""
        cap, at, n = self.limits[0], 0, len(item.ids) // 4
        if self.limits[2] >= cap:
            while n - at >= cap:
                self.emit(item, at, cap, self.sequence, 0)
                self.sequence += 1
                at += cap
        if n - at:
            self.open.append(Item(item.doc, item.start + at, item.ids[4 * at :], item.loss - min(item.loss, at), item.total))
            self.bytes += 4 * (n - at)

    def pack(self, last: bool = False) -> None:
        """Fill sequences while the window can fill them; at the end all of it."""
        cap, most, most_loss = self.limits
        items = self.open
        n_items = len(items)
        tok = [len(i.ids) // 4 for i in items]
        left = sum(tok)
        # Examples alike in every dimension score alike: a kind is scored once, its members wait in line. A cut makes a
        # new kind at most, and every cut fills a sequence.
        room = 2 * n_items + left // cap + 64
        tokens, losses, count = np.zeros(room), np.zeros(room), np.zeros(room, dtype=np.int64)
        where: dict[tuple[int, int], int] = {}
        lines: list[list[int]] = []

        def wait(k: int) -> None:
            key = (tok[k], min(items[k].loss, tok[k]))
            at = where.get(key)
            if at is None:
                at = where[key] = len(lines)
                lines.append([])
                tokens[at], losses[at] = key
            lines[at].append(k)
            count[at] += 1

        for k in range(n_items - 1, -1, -1):
            wait(k)
        # Each dimension weighs as much as the window asks of it.
        a = left / cap / cap / cap
        b = sum(min(i.loss, n) for i, n in zip(items, tok, strict=True)) / most_loss**3
        while left >= cap or last and left:
            target = cap if left >= cap else 1 << (left.bit_length() - 1)
            used = segments = lost = 0
            while used < target and segments < most and lost < most_loss:
                n = len(lines)
                rest, rest_loss = target - used, most_loss - lost
                t, l, there = tokens[:n], losses[:n], count[:n] > 0
                # The segment dimension adds the same to every example.
                points = t * (a * rest) + l * (b * rest_loss)
                fits = there & (t <= rest) & (l <= rest_loss)
                points[~fits] = -1.0
                kind = int(points.argmax())
                if points[kind] >= 0:
                    length = int(t[kind])
                else:
                    points = np.where(there, t * (a * rest) + l * (b * rest_loss), -1.0)
                    kind = int(points.argmax())
                    if points[kind] < 0:
                        break
                    length = min(rest, int(t[kind]))
                    if min(int(l[kind]), length) > rest_loss:
                        length = rest_loss
                k = lines[kind].pop()
                count[kind] -= 1
                item = items[k]
                self.emit(item, item.start, length, self.sequence, used)
                cost = min(item.loss, length)
                used, segments, lost = used + length, segments + 1, lost + cost
                tok[k] -= length
                if tok[k]:
                    items[k] = Item(item.doc, item.start + length, item.ids[4 * length :], item.loss - cost, item.total)
                    wait(k)
            left -= used
            self.sequence += 1
        self.open = [i for k, i in enumerate(items) if tok[k]]
        self.bytes = 4 * left


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(df: DataFrame, tokenizer: str, limits: tuple[int, int, int] = LIMITS, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> DataFrame:
    """Pieces of all documents of ``df`` with their places in sequences; documents may be cut.

    ``tokenizer``: path of a tokenizers file, there on every executor. All tokens of a document bear loss. Each task
    numbers its own sequences in a range of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = Ids(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        out: list[tuple] = []

        def emit(item: Item, start: int, length: int, sequence: int, offset: int) -> None:
            at = start - item.start
            out.append((item.doc, start, length, zlib.crc32(item.ids[4 * at : 4 * (at + length)]), item.total, sequence, offset))

        def rows() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in cols], names=names)

        packer = Packer(limits, emit, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = ids.of(text.as_py() or "") + end
                n = len(b) // 4
                packer.add(Item(doc, 0, b, n, n))
                if len(packer.open) >= WINDOW_ROWS or packer.bytes >= WINDOW_BYTES:
                    packer.pack()
                if len(out) >= 10_000:
                    yield rows()
        packer.pack(last=True)
        if out:
            yield rows()
        give_back()

    return in_batches(df).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, PIECES)


def pack_examples(df: DataFrame, limits: tuple[int, int, int] = LIMITS) -> DataFrame:
    """Whole examples (example_id, tokens, loss_tokens) of instruction data into sequences: example_id, start, length,
    loss_tokens, sequence_id, offset. Only an example above a limit by itself is cut, its loss tokens counted first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cap, most, most_loss = limits
        names = ["example_id", "start", "length", "loss_tokens", "sequence_id", "offset"]
        sequence = TaskContext.get().partitionId() << 33

        def fill(window: list[tuple], sequence: int) -> tuple[list[tuple], int]:
            tok, loss = np.array([w[2] for w in window], float), np.array([w[3] for w in window], float)
            weight = (tok.sum() / cap, len(window) / most, loss.sum() / most_loss)
            alive, out = np.ones(len(window), bool), []
            while alive.any():
                rest, offset = [cap, most, most_loss], 0
                while rest[1] > 0:
                    fits = alive & (tok <= rest[0]) & (loss <= rest[2])
                    if not fits.any():
                        break
                    points = tok / cap * rest[0] / cap * weight[0] + rest[1] / most / most * weight[1] + loss / most_loss * rest[2] / most_loss * weight[2]
                    k = int(np.argmax(np.where(fits, points, -1.0)))
                    alive[k] = False
                    out.append((*window[k], sequence, offset))
                    offset += window[k][2]
                    rest = [rest[0] - window[k][2], rest[1] - 1, rest[2] - window[k][3]]
                sequence += 1
            return out, sequence

        window: list[tuple] = []
        for batch in batches:
            for name, tokens, loss in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                tokens, at = tokens or 0, 0
                loss = min(loss or 0, tokens)
                while tokens - at > 0 or at == 0:
                    length = min(cap, tokens - at)
                    length = min(length, most_loss) if min(loss, length) > most_loss else length
                    part = min(loss, length)
                    window.append((name, at, length, part))
                    loss, at = loss - part, at + max(length, 1)
            while len(window) >= WINDOW_ROWS:
                out, sequence = fill(window[:WINDOW_ROWS], sequence)
                window = window[WINDOW_ROWS:]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], names=names)
        if window:
            out, sequence = fill(window, sequence)
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out, strict=True)], names=names)

    cols = [F.col(c).cast("long").alias(c) for c in ("example_id", "tokens", "loss_tokens")]
    return df.select(*cols).mapInArrow(run, "example_id long, start long, length long, loss_tokens long, sequence_id long, offset long")


def conversation_examples(df: DataFrame, tokenizer: str) -> DataFrame:
    """(example_id, tokens, loss_tokens) of conversations (conv_id, role, text): a turn has its ids and an end token; those of
    the assistant bear loss. Turns without an id belong together, as a conversation of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids(tokenizer)
        for batch in slices(batches):
            n = [len(ids.of(t.as_py() or "")) // 4 + 1 for t in batch.column(2)]
            loss = [k if r.as_py() == "assistant" else 0 for k, r in zip(n, batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(loss, pa.int64())], names=["example_id", "tokens", "loss_tokens"])

    turns = in_batches(df).select(F.col("conv_id").cast("long").alias("example_id"), "role", "text").mapInArrow(run, "example_id long, tokens long, loss_tokens long")
    return turns.groupBy("example_id").agg(F.sum("tokens").alias("tokens"), F.sum("loss_tokens").alias("loss_tokens"))


def pack_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations in sequences of at most 1024 tokens, 8 segments and 512 loss-bearing tokens."""
    return pack_examples(conversation_examples(table(spark, sf_dir, "conversations"), tokenizer_path()), CONVERSATION_LIMITS)


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public tokenizer file ``name`` lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())
