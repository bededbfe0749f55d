"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text features.

A text has one score, the sum of shared weights of its hashed words and word shapes; ordered thresholds turn the score into
P(grade >= k) = sigmoid(score - threshold[k]). That gives the expected grade and the tail probabilities that documents are
selected by: ``selected`` asks for good quality, toxic or not; ``top_selected`` for the top grade besides, good and not toxic,
with a least probability that keeps KEEP_CLEAN of the held-out documents of that grade. Weights and thresholds are learned by
gradient descent from a bounded sample of rated documents.

Null or empty text has no features: score 0, so it gets the thresholds' own probabilities, and is not selected. Unrated
documents are judged alike. Rows of labels with a null rating or unknown document are ignored; of several ratings of a
document the lowest counts, and of several texts of one id the smallest is learned from. With no ratings, every non-empty text
is selected. A null doc_id is carried; repeated rows are judged alike; very long texts are judged whole. Ties change nothing:
probabilities are compared with bounds, not ranked. Other columns are
ignored by ``classify`` and carried by ``good``, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen, slices

#: Rated documents fitted on, in expectation (chosen by a hash of doc_id), and the longest text fitted on, which bound what
#: comes to the driver; hashed weights; grades; passes over the sample.
FIT_DOCS, FIT_CHARS, BITS, GRADES, EPOCHS = 8000, 100_000, 17, 3, 12
RATE, L2, SEED = 0.35, 1e-6, 5
#: Least tail probability P(grade >= TAIL_GRADE) of a selected document.
TAIL_GRADE, SELECT = 1, 0.5
#: Share of held-out documents of the top grade that stay, the parts held out in turn, and the documents of that grade that
#: choosing the least probability takes; with fewer it is SELECT.
KEEP_CLEAN, PARTS, LEAST_CLEAN = 0.995, 5, 200

_SHAPE = bytes(0x61 if 0x61 <= c <= 0x7A or c >= 0x80 else 0x41 if 0x41 <= c <= 0x5A else 0x30 if 0x30 <= c <= 0x39 else c for c in range(256))
_RUN = re.compile(rb"(.)\1+", re.S)


class Features:
    """Hashed features of texts: log-scaled shares of word shapes and of repeats, and presence of lower-cased words."""

    def __init__(self, bits: int = BITS):
        self.mask, self.memo = (1 << bits) - 1, {}

    def of_word(self, w: bytes) -> tuple[int, int]:
        """(index of the word, index of its shape)."""
        found = self.memo.get(w)
        if found is None:
            shape = _RUN.sub(rb"\1", w.translate(_SHAPE))
            found = (zlib.crc32(b"w" + w.lower().strip(b".,;:!?")) & self.mask, zlib.crc32(b"s" + shape) & self.mask)
            if len(self.memo) > 200_000:
                self.memo.clear()
            if len(w) <= 64:
                self.memo[w] = found
        return found

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(indices, values) of a text; both empty for a null or blank one."""
        words = (text or "").encode("utf-8", "replace").split()
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.float32)
        pairs = np.array([self.of_word(w) for w in words], np.int64)
        own, shape = pairs[:, 0], pairs[:, 1]
        repeats = float(np.mean(own[1:] == own[:-1])) if len(own) > 1 else 0.0
        names, counts = np.unique(own, return_counts=True)
        kinds, times = np.unique(shape, return_counts=True)
        extra = np.array([zlib.crc32(b"f:repeat") & self.mask, zlib.crc32(b"f:distinct") & self.mask, zlib.crc32(b"f:bias") & self.mask])
        values = [np.full(len(names), 1.0) * np.minimum(1.0, 0.25 + counts / len(words)), np.sqrt(times / len(words)), np.array([repeats, len(names) / len(words), 1.0])]
        return np.concatenate([names, kinds, extra]).astype(np.int32), np.concatenate(values).astype(np.float32)


class CumulativeLink:
    """P(grade >= k | x) = sigmoid(w.x - threshold[k - 1]), k = 1 .. grades - 1, thresholds increasing."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, scores: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))

    def score(self, at: np.ndarray, values: np.ndarray) -> float:
        return float(self.weights[at] @ values) if len(at) else 0.0


def slopes(scores: np.ndarray, y: np.ndarray, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the mean -log P(grade = y), P(grade >= k) = sigmoid(score - theta[k - 1]), in each score and in theta."""
    count, n = len(scores), np.arange(len(scores))
    tail = np.concatenate([np.ones((count, 1)), 1 / (1 + np.exp(-np.clip(scores[:, None] - theta, -40, 40))), np.zeros((count, 1))], 1)
    slope = tail * (1 - tail)
    p = np.maximum(tail[n, y] - tail[n, y + 1], 1e-9)
    up, down = slope[n, y] / p, slope[n, y + 1] / p  # of log P in score - theta[y - 1], score - theta[y]
    by_theta = np.zeros(len(theta))
    np.add.at(by_theta, np.maximum(y - 1, 0), np.where(y > 0, up, 0.0) / count)
    np.add.at(by_theta, np.minimum(y, len(theta) - 1), np.where(y < len(theta), -down, 0.0) / count)
    return (down - up) / count, by_theta


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, n_grades: int = GRADES, bits: int = BITS, epochs: int = EPOCHS) -> CumulativeLink:
    """Adagrad on the ordinal likelihood. The thresholds are the first one and positive gaps, so they stay ordered."""
    w, g2 = np.zeros(1 << bits), np.full(1 << bits, 1e-2)
    share = np.array([np.mean(grades >= k) for k in range(1, n_grades)]).clip(1e-3, 1 - 1e-3)
    theta = -np.log(share / (1 - share))
    theta = np.maximum.accumulate(theta + np.arange(n_grades - 1) * 1e-3)
    first, gaps = theta[0], np.log(np.maximum(np.diff(theta), 1e-3))
    order, rng = np.arange(len(rows)), np.random.default_rng(SEED)
    t2 = np.full(n_grades - 1, 1e-2)
    cut = lambda: np.concatenate([[first], first + np.cumsum(np.exp(gaps))])
    for _ in range(epochs):
        rng.shuffle(order)
        for k in range(0, len(order), 32):
            batch = order[k : k + 32]
            at = np.concatenate([rows[i][0] for i in batch])
            values = np.concatenate([rows[i][1] for i in batch])
            who = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            ds, dt = slopes(np.bincount(who, w[at] * values, len(batch)), grades[batch], cut())
            grad = np.bincount(at, ds[who] * values, len(w)) if len(at) else np.zeros(len(w))
            grad += L2 * w
            g2 += grad * grad
            w -= RATE * grad / np.sqrt(g2)
            raw = np.concatenate([[dt.sum()], np.array([dt[j + 1 :].sum() for j in range(n_grades - 2)]) * np.exp(gaps)])
            t2 += raw * raw
            move = 0.1 * raw / np.sqrt(t2)
            first, gaps = first - move[0], gaps - move[1:]
    return CumulativeLink(w, cut())


def grade(quality, toxic):
    """0: low quality; 1: good but toxic; 2: good."""
    return F.when(quality == 0, 0).when(toxic == 1, 1).otherwise(2)


def rated(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """About fit_docs (doc_id, text, grade) rows, one an id, chosen by a hash of doc_id over the whole tables."""
    marks = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(grade(F.col("quality"), F.coalesce(F.col("toxic"), F.lit(0)))).alias("grade"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) / float(1 << 30)
    share = min(1.0, fit_docs / max(1, labels.select("doc_id").count()))
    known = docs.where(F.col("text").isNotNull() & (draw < share) & (F.length("text") <= FIT_CHARS)).groupBy("doc_id").agg(F.min("text").alias("text"))
    return known.join(marks.where(draw < share), "doc_id")


def least_top(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, part: np.ndarray, bits: int = BITS) -> float:
    """The least P(top grade) that keeps KEEP_CLEAN of the rows of that grade, each under a model of the other parts' rows."""
    if (grades == GRADES - 1).sum() < LEAST_CLEAN:
        return SELECT
    found = []
    for k in np.unique(part):
        link = fit([r for r, own in zip(rows, part) if own != k], grades[part != k], bits=bits)
        found += [link.score(*rows[i]) - link.thresholds[-1] for i in np.flatnonzero((part == k) & (grades == GRADES - 1))]
    return float(1 / (1 + np.exp(-np.quantile(found, 1 - KEEP_CLEAN))))


def fit_model(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, bits: int = BITS) -> tuple[CumulativeLink, float] | None:
    """The model and the least P(top grade), learned on the driver from the hashed features of a sample bounded by fit_docs."""

    def featured(batches):
        make = Features(bits)
        for b in slices(batches, 200):
            found = [make(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary()), b.column(2)], ["doc_id", "at", "value", "grade"])

    rows = rated(docs, labels, fit_docs).select(F.col("doc_id").cast("long"), "text", F.col("grade").cast("int")).mapInArrow(featured, "doc_id long, at binary, value binary, grade int").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["grade"], bytes(r["at"])))
    if not rows:
        return None
    pairs = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["value"], np.float32)) for r in rows]
    grades, part = np.array([r["grade"] for r in rows]), np.array([zlib.crc32(b"%d" % r["doc_id"]) % PARTS for r in rows])
    return fit(pairs, grades, bits=bits), least_top(pairs, grades, part, bits)


class Judge:
    """Judges texts under a fitted model and its least P(top grade)."""

    def __init__(self, model: tuple[CumulativeLink, float] | None, bits: int, select: float):
        self.link, self.top = model or (None, 0.0)
        self.make, self.select = Features(bits), select

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(scores, tail probabilities, whether selected, whether selected by the top grade)."""
        found = [self.make(t) for t in texts]
        full = np.array([len(f[0]) > 0 for f in found], bool)
        scores = np.array([self.link.score(*f) if self.link else 0.0 for f in found])
        tails = self.link.tails(scores) if self.link else np.ones((len(texts), GRADES - 1))
        taken = (tails[:, TAIL_GRADE - 1] >= self.select) & full
        return scores, tails, taken, taken & (tails[:, -1] >= self.top)


def classify(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, bits: int = BITS, select: float = SELECT) -> DataFrame:
    """doc_id, score, expected_grade, tail_1, tail_2 (P(grade >= 1 and 2)), selected, top_selected of every row of docs."""
    model = docs.sparkSession.sparkContext.broadcast(fit_model(docs, labels, fit_docs, bits))  # 2 ** bits weights

    def judge(batches):
        tell = Judge(model.value, bits, select)
        for b in slices(batches):
            scores, tails, taken, top = tell(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array(tails.sum(1)), pa.array(tails[:, 0]), pa.array(tails[:, 1]), pa.array(taken), pa.array(top)], ["doc_id", "score", "expected_grade", "tail_1", "tail_2", "selected", "top_selected"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(judge, "doc_id long, score double, expected_grade double, tail_1 double, tail_2 double, selected boolean, top_selected boolean")


def good(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS, bits: int = BITS, select: float = SELECT) -> DataFrame:
    """The rows of docs that classify() would mark as top_selected."""
    model = docs.sparkSession.sparkContext.broadcast(fit_model(docs, labels, fit_docs, bits))

    def judge():
        tell = Judge(model.value, bits, select)
        return lambda texts: tell(texts)[3].tolist()

    return chosen(docs, "text", judge)
