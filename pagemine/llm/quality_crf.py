"""Quality by a linear-chain conditional random field over the lines of a document.

Every line is good (1) or bad (0). A line is described by what stands in it, and by the same
for the line before and after; neighbouring labels have weights of their own. Labels exist
per document, so in training each line has its document's. Scoring runs forward-backward
over the lines; the probabilities of good, weighted by line length, average to the score.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The model is fitted on so many labelled documents, on so many more of each label so that none
#: is missing, and only on documents with at most so many lines.
TRAIN_DOCS, TRAIN_PER_LABEL, TRAIN_LINES = 2500, 100, 200
EPOCHS, RATE, L2 = 300, 0.2, 1e-4
SLICE = 256

#: Character classes: 0 other, 1 lower, 2 upper, 3 other letter, 4 digit, 5 blank, 6 stop, 7 comma and the like,
#: 8 exclamation, 9 symbol, 10 bracket or quote.
_CLASSES = 11


def _class_table() -> np.ndarray:
    table = np.zeros(0x10000 + 1, np.uint8)
    for point in range(0x10000):
        c = chr(point)
        if c.isalpha():
            table[point] = 1 if c.islower() else 2 if c.isupper() else 3
        elif c.isdigit():
            table[point] = 4
        elif c.isspace():
            table[point] = 5
    for chars, kind in ((".?", 6), (",;:", 7), ("!", 8), ("#*$%&|<>@^~=+_/\\{}", 9), ("()[]\"'-", 10)):
        for c in chars:
            table[ord(c)] = kind
    table[0x10000] = 3  # everything beyond the first plane
    return table


_TABLE: list[np.ndarray] = []
_NEWLINE = 10
WORD_FEATURES = 8
BASE = _CLASSES + WORD_FEATURES + 1
FEATURES = 3 * BASE


def _word_features(line: str) -> list[float]:
    words = line.split()
    n = len(words)
    if not n:
        return [0.0] * WORD_FEATURES
    seen = Counter(words)
    same = sum(map(str.__eq__, words, words[1:]))
    length = sum(map(len, words)) / n
    return [
        min(1.0, np.log1p(n) / 8),
        len(seen) / n,
        same / n,
        max(seen.values()) / n if n > 3 else 0.0,
        min(1.0, length / 20),
        sum(len(w) == 1 for w in words) / n,
        sum(not w[-1].isalnum() for w in words) / n,
        float(words[0][0].isupper()),
    ]


def line_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines × BASE features, lengths in code points) of a text split at newlines; no text is one empty line."""
    if not _TABLE:
        _TABLE.append(_class_table())
    text = text or ""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lines = text.split("\n")
    lengths = np.fromiter(map(len, lines), np.int64, len(lines))
    at = np.repeat(np.arange(len(lines)), lengths)
    kinds = _TABLE[0][np.minimum(points[points != _NEWLINE], 0x10000)]
    counts = np.bincount(at * _CLASSES + kinds, minlength=len(lines) * _CLASSES).reshape(len(lines), _CLASSES)
    shares = counts / np.maximum(lengths, 1)[:, None]
    words = np.array([_word_features(line) for line in lines]).reshape(len(lines), WORD_FEATURES)
    return np.hstack([shares, words, np.ones((len(lines), 1))]), lengths


def with_neighbours(features: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and of the line after (zeros at the ends)."""
    none = np.zeros((1, features.shape[1]))
    return np.hstack([features, np.vstack([none, features[:-1]]), np.vstack([features[1:], none])])


@dataclass
class Crf:
    """weights: score of label 1 against 0 per feature; steps[a, b]: weight of label b after label a."""

    weights: np.ndarray
    steps: np.ndarray

    def marginals(self, features: np.ndarray) -> np.ndarray:
        """Probability of label 1 per line, given all lines: forward-backward in logarithms."""
        p, _, _ = _forward_backward((features @ self.weights)[None, :], np.array([len(features)]), self.steps)
        return p[0]

    def score(self, text: str | None) -> float:
        features, lengths = line_features(text)
        weights = np.maximum(lengths, 1 if not lengths.any() else 0)
        return float(np.clip(self.marginals(with_neighbours(features)) @ weights / weights.sum(), 0.0, 1.0))


def _forward_backward(unary: np.ndarray, lengths: np.ndarray, steps: np.ndarray):
    """For padded chains (chains × lines of scores for label 1): marginals, summed pair marginals, log partition."""
    chains, longest = unary.shape
    alive = np.arange(longest)[None, :] < lengths[:, None]
    forward, backward = np.zeros((chains, longest, 2)), np.zeros((chains, longest, 2))
    forward[:, 0, 1] = unary[:, 0]
    for t in range(1, longest):
        ahead = np.logaddexp(forward[:, t - 1, 0:1] + steps[0], forward[:, t - 1, 1:2] + steps[1])
        ahead[:, 1] += unary[:, t]
        forward[:, t] = np.where(alive[:, t, None], ahead, forward[:, t - 1])
    for t in range(longest - 2, -1, -1):
        after = backward[:, t + 1].copy()
        after[:, 1] += unary[:, t + 1]
        back = np.logaddexp(after[:, 0:1] + steps[:, 0], after[:, 1:2] + steps[:, 1])
        backward[:, t] = np.where(alive[:, t + 1, None], back, 0.0)
    total = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    one = np.exp(np.minimum(0.0, forward[:, :, 1] + backward[:, :, 1] - total[:, None]))
    pairs = np.zeros((2, 2))
    if longest > 1:
        for a in (0, 1):
            for b in (0, 1):
                inner = forward[:, :-1, a] + steps[a, b] + backward[:, 1:, b] + (unary[:, 1:] if b else 0.0) - total[:, None]
                pairs[a, b] = np.exp(np.minimum(0.0, inner))[alive[:, 1:]].sum()
    return np.where(alive, one, 0.0), pairs, total


def fit(chains: list[np.ndarray], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, l2: float = L2) -> Crf:
    """Maximise the mean log-likelihood per document by Adam; chains hold features with neighbours."""
    order = np.argsort([len(c) for c in chains], kind="stable")
    groups = []
    for at in range(0, len(order), 256):  # chains of like length are padded together
        picked = [chains[i] for i in order[at : at + 256]]
        lengths = np.array([len(c) for c in picked])
        padded = np.zeros((len(picked), lengths.max(), picked[0].shape[1]))
        for row, chain in zip(padded, picked, strict=True):
            row[: len(chain)] = chain
        groups.append((padded, lengths, np.array([labels[i] for i in order[at : at + 256]])))
    weights, steps = np.zeros(chains[0].shape[1]), np.zeros((2, 2))
    first, second = np.zeros(weights.size + 4), np.zeros(weights.size + 4)
    lines = sum(len(c) for c in chains)
    for step in range(1, epochs + 1):
        grad_w, grad_s = np.zeros_like(weights), np.zeros_like(steps)
        for padded, lengths, label in groups:
            p, pairs, _ = _forward_backward(padded @ weights, lengths, steps)
            alive = np.arange(padded.shape[1])[None, :] < lengths[:, None]
            grad_w += np.einsum("ct,ctf->f", np.where(alive, label[:, None], 0.0) - p, padded)
            for value in (0, 1):
                grad_s[value, value] += (lengths[label == value] - 1).sum()
            grad_s -= pairs
        grad = np.concatenate([grad_w / lines - l2 * weights, (grad_s / lines - l2 * steps).ravel()])
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights = weights + move[:-4]
        steps = steps + move[-4:].reshape(2, 2)
    return Crf(weights, steps)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; a null id counts as held out, as it cannot be checked."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, n_docs: int = TRAIN_DOCS, per_label: int = TRAIN_PER_LABEL, max_lines: int = TRAIN_LINES) -> Crf | None:
    """Fit on a bounded sample of labels(doc_id, quality) outside the held-out part.

    The sample: the n_docs ids with the smallest hash, so labels are as frequent as they are, and
    of each label the per_label ids with the smallest hash; of their documents those with at most
    max_lines lines. Ids with contradicting labels and null labels are not
    used. None where a label has no document.
    """
    known = (
        labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("label"), F.max("quality").alias("_max"))
        .where("label = _max")
        .select("doc_id", "label")
    )
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n_docs)
    for value in (0, 1):
        picked = picked.unionByName(known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label))
    picked = picked.distinct()

    def features(batches):
        for batch in batches:
            ids, kinds, found = [], [], []
            for doc_id, label, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "label", "text")), strict=True):
                if text is not None and text.count("\n") < max_lines:
                    ids.append(doc_id)
                    kinds.append(label)
                    found.append(line_features(text)[0].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(kinds, pa.int32()), pa.array(found, pa.binary())], names=["doc_id", "label", "features"]
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most n_docs + 2 * per_label ids are broadcast
    sample = texts.join(F.broadcast(picked), "doc_id").mapInArrow(features, "doc_id long, label int, features binary")
    rows = sample.orderBy("doc_id", "features").limit(2 * (n_docs + per_label)).toArrow()
    labels = rows.column("label").to_pylist()
    if len(set(labels)) < 2:
        return None
    chains = [with_neighbours(np.frombuffer(f, np.float32).reshape(-1, BASE).astype(float)) for f in rows.column("features").to_pylist()]
    return fit(chains, labels)


def score_documents(docs: DataFrame, model: Crf | None, threshold: float = 0.7) -> DataFrame:
    """Per row of docs(doc_id, text): doc_id, held_out, score (0 to 1), predicted, n_lines.

    Only the text enters the score. Null and empty texts are one empty line and get its score;
    without a model every score is 0.5. Null ids are held out. Repeated rows get equal scores;
    other columns are ignored; texts are read whole; an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                texts = part.column("text").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([model.score(t) if model else 0.5 for t in texts], pa.float64()),
                        pa.array([(t or "").count("\n") + 1 for t in texts], pa.int64()),
                    ],
                    names=["doc_id", "score", "n_lines"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double, n_lines long")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_lines")
