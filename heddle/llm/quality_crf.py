"""Quality by a linear-chain conditional random field over the lines of a document.

Every line is good or bad; its state depends on features of the line and of its neighbours and on the states beside it.
A document's score is the mean probability of "good" over its lines, weighted by their lengths, from the forward-backward
marginals. Training takes the documents' labels as the labels of all their lines, on a bounded sample of labelled
documents with all lines they have; scoring reads every line of every text. Inputs are the characters of the text and nothing else.

Defined results: a null or blank text is one empty line; null ids are scored and count as not held out; repeated rows
stay; an id with several texts is trained on by the one with the smallest hash; an id with several labels counts as good
if one says so; without any label all scores are 0.5; very long texts are scored whole; other columns are not read,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import discard, in_batches, slices, table, written

#: Labelled documents to train on, at most: those with the smallest hashes of their ids, as far as their lines add up to
#: TRAINING_LINES, 14 numbers each. A document is taken with all its lines or not at all.
TRAINING_DOCS, TRAINING_LINES = 2000, 100_000
THRESHOLD = 0.7

#: Classes of bytes: other, space, lower case and bytes above ASCII, upper case, digit, then signs of their own.
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[[9, 10, 11, 12, 13, 32]] = 1
_CLASS[97:123] = 2
_CLASS[128:] = 2
_CLASS[65:91] = 3
_CLASS[48:58] = 4
_CLASS[[ord(c) for c in "#$%&*+<=>@\\^_`{}~/|[]"]] = 5
_CLASS[[ord(c) for c in "!?"]] = 6
_CLASS[[ord(c) for c in ".,;:"]] = 7
CLASSES = 8
#: Features of one line; a line is described by its own, those of its neighbours and a constant.
OWN = CLASSES + 6
DIM = 3 * OWN + 1


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x OWN features, lengths in bytes) of the lines with words; of one empty line if there are none."""
    lines = [x for x in (text or "").split("\n") if x and not x.isspace()]
    if not lines:
        return np.zeros((1, OWN)), np.ones(1)
    coded = [x.encode("utf-8", "surrogatepass") for x in lines]
    length = np.fromiter(map(len, coded), dtype=np.int64, count=len(coded))
    every = np.frombuffer(b"".join(coded), dtype=np.uint8)
    owner = np.repeat(np.arange(len(coded)), length)
    share = np.bincount(owner * CLASSES + _CLASS[every], minlength=len(coded) * CLASSES).reshape(-1, CLASSES) / length[:, None]
    out = np.empty((len(coded), OWN))
    out[:, :CLASSES] = share
    seen: set[bytes] = set()
    for i, line in enumerate(coded):
        w = line.split()
        n = len(w)
        out[i, CLASSES:] = (
            np.log1p(n) / 5,
            min(length[i] / max(n, 1), 30) / 10,
            len(set(w)) / max(n, 1),
            len(set(zip(w, w[1:], strict=False))) / max(n - 1, 1) if n > 1 else 1.0,
            line in seen,
            w[-1][-1:] in b".!?" if n else False,
        )
        seen.add(line)
    return out, length.astype(float)


def with_neighbours(own: np.ndarray) -> np.ndarray:
    """Lines x DIM: own features, those of the line before and after (zeros at the ends), constant."""
    zero = np.zeros((1, OWN))
    return np.hstack([own, np.vstack([zero, own[:-1]]), np.vstack([own[1:], zero]), np.ones((len(own), 1))])


def marginals(unary: np.ndarray, lines: np.ndarray, pair: np.ndarray, share: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over a batch of chains: P(good) per line (chains x T) and, with ``share``, the expected
    transitions (2 x 2), each chain's times its share.

    ``unary``: chains x T scores of "good" against "bad"; ``lines``: length of each chain; ``pair``: 2 x 2 scores.
    """
    n, steps = unary.shape
    score = np.zeros((n, steps, 2))
    score[:, :, 1] = unary
    forward, backward = np.zeros((n, steps, 2)), np.zeros((n, steps, 2))
    forward[:, 0] = score[:, 0]
    for t in range(1, steps):
        both = forward[:, t - 1, :, None] + pair[None]
        forward[:, t] = np.logaddexp(both[:, 0], both[:, 1]) + score[:, t]
    for t in range(steps - 2, -1, -1):
        both = pair[None] + (score[:, t + 1] + backward[:, t + 1])[:, None, :]
        step = np.logaddexp(both[:, :, 0], both[:, :, 1])
        backward[:, t] = np.where((t + 1 < lines)[:, None], step, 0.0)
    total = forward + backward
    good = 1.0 / (1.0 + np.exp(np.clip(total[:, :, 0] - total[:, :, 1], -500, 500)))
    moves = np.zeros((2, 2))
    if steps > 1 and share is not None:
        z = np.logaddexp(total[:, :1, 0], total[:, :1, 1])[:, :, None, None]
        joint = forward[:, :-1, :, None] + pair[None, None] + (score[:, 1:] + backward[:, 1:])[:, :, None, :]
        real = (np.arange(1, steps)[None] < lines[:, None])[:, :, None, None]
        moves = np.einsum("n,ntab->ab", share, np.where(real, np.exp(np.minimum(joint - z, 0.0)), 0.0))
    return good, moves


def alike(size: np.ndarray, most: int = 200_000) -> Iterator[np.ndarray]:
    """Places of chains in groups of like length, so that a batch of them is little padded and holds ``most`` lines or one
    chain."""
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        top = max(size[order[at]] * 1.25, 4)
        end = at + 1
        while end < len(order) and size[order[end]] <= top and (end + 1 - at) * size[order[end]] <= most:
            end += 1
        yield order[at:end]
        at = end


def likelihood(docs: list[np.ndarray], labels: np.ndarray, theta: np.ndarray, pair: np.ndarray) -> float:
    """Mean log likelihood per line of chains (lines x DIM) whose lines all have their document's label."""
    total = 0.0
    for d, y in zip(docs, labels, strict=True):
        unary = d @ theta
        state = np.array([0.0, unary[0]])
        for u in unary[1:]:
            state = np.logaddexp(state[0] + pair[0], state[1] + pair[1]) + np.array([0.0, u])
        own = y * unary.sum() + (len(d) - 1) * pair[int(y), int(y)]
        total += (own - np.logaddexp(*state)) / len(d)
    return total / len(docs)


def gradient(batches: list[tuple], theta: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Gradient of ``likelihood`` over batches of like chains, as one vector: DIM weights, then 4 transitions."""
    out = np.zeros(DIM + 4)
    for batch, lines, labels, n in batches:
        real = np.arange(batch.shape[1])[None] < lines[:, None]
        per = real / lines[:, None] / n
        good, got = marginals(batch @ theta, lines, pair, 1 / lines / n)
        inner = np.maximum(lines - 1, 0) / lines / n
        want = np.array([[(inner * (1 - labels)).sum(), 0.0], [0.0, (inner * labels).sum()]])
        out += np.concatenate([np.einsum("nt,ntd->d", (labels[:, None] - good) * per, batch), (want - got).ravel()])
    return out


def batched(docs: list[np.ndarray], labels: np.ndarray) -> list[tuple]:
    """Chains of like length as padded arrays, with their lengths and labels."""
    size = np.array([len(d) for d in docs])
    out = []
    for group in alike(size):
        batch = np.zeros((len(group), size[group].max(), DIM))
        for row, i in enumerate(group):
            batch[row, : size[i]] = docs[i]
        out.append((batch, size[group], labels[group], len(docs)))
    return out


def fit(docs: list[np.ndarray], labels: np.ndarray, rounds: int = 100, rate: float = 0.15, decay: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (DIM) and transitions (2 x 2) by gradient ascent (Adam) on the mean log likelihood per line; every document
    counts alike however many lines it has. Deterministic."""
    batches = batched([with_neighbours(d) for d in docs], labels)
    theta = np.zeros(DIM + 4)
    m, v = np.zeros(DIM + 4), np.zeros(DIM + 4)
    for k in range(1, rounds + 1):
        grad = gradient(batches, theta[:DIM], theta[DIM:].reshape(2, 2)) - decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return theta[:DIM], theta[DIM:].reshape(2, 2)


def scores(texts: list[str | None], theta: np.ndarray, pair: np.ndarray) -> np.ndarray:
    """Score of each text. Chains of like length run together."""
    found = [line_features(t) for t in texts]
    out = np.empty(len(texts))
    size = np.array([len(f[1]) for f in found])
    for group in alike(size):
        lines = size[group]
        unary, weight = np.zeros((len(group), lines.max())), np.zeros((len(group), lines.max()))
        for row, i in enumerate(group):
            unary[row, : size[i]] = with_neighbours(found[i][0]) @ theta
            weight[row, : size[i]] = found[i][1]
        good, _ = marginals(unary, lines, pair)
        out[group] = (good * weight).sum(axis=1) / weight.sum(axis=1)
    return np.clip(out, 0.0, 1.0)


def held_out(id_col: str = "doc_id"):
    """Rows that training never sees: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def train(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most: int = TRAINING_DOCS) -> tuple[np.ndarray, np.ndarray] | None:
    """Model from at most ``most`` labelled documents outside the held-out part; None without any.

    The ids are chosen first and broadcast, ``most`` rows; the driver gets the features of one text of each, at most
    TRAINING_LINES lines in all.
    """
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    ids = ids.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    text = F.col(f"`{text_col}`")
    docs = in_batches(df).select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("hash"), text.alias("text")).join(F.broadcast(ids), "id")
    docs = docs.groupBy("id", "label").agg(F.min_by("text", "hash").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [line_features(t.as_py())[0] for t in batch.column("text")]
            n = pa.array([len(f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), n, pa.array([f.astype("<f4").tobytes() for f in found])], names=["id", "label", "n", "lines"])

    rows = written(docs.select("id", "label", "text").mapInArrow(run, "id long, label int, n long, lines binary"), "lines")
    # Sizes of at most ``most`` documents decide; one that no longer fits is passed over, later ones may still come in.
    left, chosen = TRAINING_LINES, []
    for r in rows.orderBy(F.xxhash64("id"), "id").select("id", "n").collect():
        if r.n <= left:
            left -= r.n
            chosen.append(r.id)
    own = rows.where(F.col("id").isin(chosen)).orderBy(F.xxhash64("id"), "id").collect() if chosen else []
    discard(rows)
    if not own:
        return None
    return fit([np.frombuffer(r.lines, dtype="<f4").astype(float).reshape(-1, OWN) for r in own], np.array([float(r.label > 0) for r in own]))


def classify(df: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(2).to_pylist()
            s = scores(texts, *model) if model else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    rows = in_batches(df).select(F.col(f"`{id_col}`").cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`"))
    return rows.mapInArrow(run, "id long, held_out boolean, score double, predicted int")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labelled ones outside the held-out part."""
    docs = table(spark, sf_dir, "documents")
    out = classify(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")
