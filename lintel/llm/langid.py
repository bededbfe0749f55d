"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary of byte pieces is given; for each language the probabilities of its pieces are learned by
expectation-maximisation over all segmentations of the words of a bounded sample. A text's log-likelihood is the sum over
its words of the forward algorithm's total over every segmentation of the word, however long it is.

Null text, or text without a letter: ``und`` with score 0. A null doc_id is carried and counts as not held out, but is
never learned from. With nothing to learn from, every text is ``und``. Of languages equally likely the first by name is told.
Repeated rows are judged alike, and learned from once. Other columns of the input are ignored by ``identify`` and carried by
``confident``; an empty table gives an empty result. Very long texts are judged whole.
"""

from __future__ import annotations

import base64
import math
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen, slices

#: Documents of a language that the model is learned from, in expectation (chosen by a hash of id and text), and of all
#: languages together; the longest text learned from; how many languages are learned, the most frequent.
FIT_DOCS, FIT_ALL, FIT_CHARS, FIT_LANGS = 300, 6000, 20_000, 500
EM_ROUNDS = 4
SMOOTHING = 0.02
#: Words whose scores a worker remembers, and the longest word (bytes) it remembers.
MEMO_WORDS, MEMO_BYTES = 250_000, 40
#: Bytes of a word that are scored at once; what comes before is carried over.
BLOCK = 4096
#: Least posterior of a text that is sure of its language, and how far its log-likelihood a byte may lie below the sample's
#: median, in distances of the sample's lowest twentieth from it, and what such a distance is at least; what a text of n bytes
#: may lie below that in all, in roots of n, as the spread of a sum grows.
LEAST_SCORE, FARTHEST, LEAST_STEP, SPREAD = 0.5, 8.0, 0.1, 3.0

_KEEP = bytes(c if chr(c).isalpha() and c < 128 or c >= 128 else 32 for c in range(256))


def load_vocabulary(path: str | None = None) -> dict[bytes, int]:
    """All pieces without white space inside, and all single bytes; ids from 1."""
    pieces = {bytes([b]) for b in range(256)}
    with open(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        for line in f:
            p = base64.b64decode(line.split()[0])
            if p and b" " not in p[1:]:
                pieces.add(p)
    return {p: k for k, p in enumerate(sorted(pieces), 1)}


def words_of(text: str) -> list[bytes]:
    """Lower-cased runs of letters, as UTF-8 behind a space (as pieces at a word's start are spelled)."""
    return text.lower().encode("utf-8", "replace").translate(_KEEP).split()


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


class Trie:
    """A vocabulary's pieces by their first bytes: a sorted array of (node, byte) edges, and each node's piece id or 0."""

    def __init__(self, vocab: dict[bytes, int]):
        nodes, edges = {b"": 0}, []
        can = [p for p in vocab if len(p) == 1 or p.lstrip(b" ").translate(_KEEP).lower() == p.lstrip(b" ")]  # in words_of() a text
        self.longest = max(map(len, can))
        for p in sorted(can):
            for k in range(1, len(p) + 1):
                if p[:k] not in nodes:
                    nodes[p[:k]] = len(nodes)
                    edges.append((nodes[p[: k - 1]] << 8 | p[k - 1], nodes[p[:k]]))
        edges.sort()
        self.edge, self.child = (np.array([e[i] for e in edges], np.int64) for i in (0, 1))
        self.piece = np.zeros(len(nodes), np.int32)
        self.piece[[nodes[p] for p in can]] = [vocab[p] for p in can]

    def step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The nodes that bytes lead to; -1 where no piece goes on so."""
        key = node << 8 | byte
        at = np.minimum(np.searchsorted(self.edge, key), len(self.edge) - 1)
        return np.where(self.edge[at] == key, self.child[at], -1)


def lattice(words: list[bytes], vocab: dict[bytes, int] | Trie) -> np.ndarray:
    """ids[w, start, size - 1] of the pieces in words of one length; 0 where there is none."""
    trie = vocab if isinstance(vocab, Trie) else Trie(vocab)
    count, n = len(words), len(words[0])
    text = np.frombuffer(b"".join(words), np.uint8).reshape(count, n).astype(np.int64)
    ids = np.zeros((count, n, min(n, trie.longest)), np.int32)
    w, start = (at.ravel() for at in np.indices((count, n)))
    node = np.zeros(count * n, np.int64)
    for size in range(1, ids.shape[2] + 1):
        inside = start + size <= n
        w, start = w[inside], start[inside]
        node = trie.step(node[inside], text[w, start + size - 1])
        on = node >= 0
        w, start, node = w[on], start[on], node[on]
        if not len(w):
            break
        ids[w, start, size - 1] = trie.piece[node]
    return ids


def forward(ids: np.ndarray, prob: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """log alpha[end, w, language], alpha the probability of all segmentations of the first ``end`` bytes. prob[0] is 0.

    known: the first of them, where they are known; logarithms keep words of any length from vanishing.
    """
    count, n, k = ids.shape
    hit = ids.any(0)
    alpha = np.zeros((n + 1, count, prob.shape[1]))
    first = 1 if known is None else len(known)
    if known is not None:
        alpha[:first] = known
    for end in range(first, n + 1):
        last, total = alpha[end - 1], 0.0
        for size in range(1, min(end, k) + 1):
            if hit[end - size, size - 1]:
                total = total + (np.exp(np.minimum(alpha[end - size] - last, 700)) if size > 1 else 1.0) * prob[ids[:, end - size, size - 1]]
        alpha[end] = last + np.log(total)
    return alpha


def backward(ids: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """log beta[start, w, language], beta the probability of all segmentations of what follows ``start``."""
    count, n, k = ids.shape
    hit = ids.any(0)
    beta = np.zeros((n + 1, count, prob.shape[1]))
    for start in range(n - 1, -1, -1):
        last, total = beta[start + 1], 0.0
        for size in range(1, min(n - start, k) + 1):
            if hit[start, size - 1]:
                total = total + (np.exp(np.minimum(beta[start + size] - last, 700)) if size > 1 else 1.0) * prob[ids[:, start, size - 1]]
        beta[start] = last + np.log(total)
    return beta


def expected_counts(ids: np.ndarray, prob: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in each language, over words that occur weight[w, language] times."""
    count, n, k = ids.shape
    alpha, beta = forward(ids, prob), backward(ids, prob)
    out = np.zeros_like(prob)
    w, start, size = np.nonzero(ids)
    at = ids[w, start, size]
    use = np.exp(np.minimum(alpha[start, w] + beta[start + size + 1, w] - alpha[n, w], 700)) * prob[at] * weight[w]
    for lang in range(prob.shape[1]):
        out[:, lang] += np.bincount(at, use[:, lang], len(prob))
    return out


def log_totals(words: list[bytes], trie: Trie, prob: np.ndarray) -> np.ndarray:
    """log-probability[w, language] of words, shortest first, that are scored together up to the longest one's end."""
    n = len(words[-1])
    ends, out = np.array([len(w) for w in words]), np.zeros((len(words), prob.shape[1]))
    padded = [w.ljust(n, b"\0") for w in words]
    known = np.zeros((1, len(words), prob.shape[1]))
    for at in range(0, n, BLOCK):
        stop, low = min(n, at + BLOCK), at + 1 - len(known)
        alpha = forward(lattice([w[low:stop] for w in padded], trie), prob, known)
        inside = np.flatnonzero((ends > at) & (ends <= stop))
        out[inside] = alpha[ends[inside] - low, inside]
        known = alpha[-trie.longest :]
    return out


def by_length(words) -> dict[int, list[bytes]]:
    out: dict[int, list[bytes]] = {}
    for w in words:
        out.setdefault(len(w), []).append(w)
    return out


def together(words: list[bytes], most: int = 2000, most_bytes: int = 60_000):
    """Words in groups of about one length, shortest first; no group holds much more than most_bytes unless it is one word."""
    group: list[bytes] = []
    for w in sorted(words, key=len):
        if group and (len(w) > 1.25 * len(group[0]) or len(group) == most or len(w) * (len(group) + 1) > most_bytes):
            yield group
            group = []
        group.append(w)
    if group:
        yield group


def fit(samples: list[tuple[str, str]], vocab: dict[bytes, int], rounds: int = EM_ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, probabilities[piece id, language]) from (text, language) pairs."""
    langs = sorted({lang for _, lang in samples})
    counts: dict[bytes, np.ndarray] = {}
    for k, lang in enumerate(langs):
        for w, n in Counter(b" " + word for text, own in samples if own == lang for word in words_of(text)).items():
            counts.setdefault(w, np.zeros(len(langs)))[k] += n
    prob = np.zeros((len(vocab) + 1, len(langs)))
    lengths = np.array([0, *(len(p) for p in sorted(vocab, key=vocab.get))], float)
    prob[1:] = (0.02 ** (1 / lengths[1:]))[:, None] / len(vocab)  # a start that prefers long pieces
    trie = Trie(vocab)
    groups = []
    for ws in by_length(sorted(counts)).values():
        step = max(1, min(4000, 100_000 // len(ws[0])))
        groups += [(lattice(ws[i : i + step], trie), np.array([counts[w] for w in ws[i : i + step]])) for i in range(0, len(ws), step)]
    for _ in range(rounds):
        found = sum(expected_counts(ids, prob, weight) for ids, weight in groups) if groups else np.zeros_like(prob)
        prob[1:] = found[1:] + SMOOTHING
        prob /= prob.sum(axis=0, keepdims=True)
        prob[0] = 0
    return langs, prob


class Scorer:
    """Scores texts under every language; remembers the rows of common words in a table."""

    def __init__(self, vocab: dict[bytes, int] | Trie, prob: np.ndarray):
        self.trie, self.prob = vocab if isinstance(vocab, Trie) else Trie(vocab), prob
        self.at: dict[bytes, int] = {}
        self.table, self.used = np.empty((0, prob.shape[1])), 0

    def learn_words(self, words: list[bytes]) -> None:
        """Adds the log-probabilities of words by language to the table."""
        if self.used + len(words) > len(self.table):
            grown = np.empty((max(self.used + len(words), min(2 * self.used, MEMO_WORDS)), self.prob.shape[1]))
            grown[: self.used] = self.table[: self.used]
            self.table = grown
        for group in together(words):
            self.table[self.used : self.used + len(group)] = log_totals([b" " + w for w in group], self.trie, self.prob)
            self.at.update(zip(group, range(self.used, self.used + len(group))))
            self.used += len(group)

    def totals(self, texts: list[str]) -> list[np.ndarray]:
        """Log-likelihood of each text by language."""
        bags = [Counter(words_of(t)) for t in texts]
        words = {w for bag in bags for w in bag}
        new = [w for w in words if w not in self.at]
        if self.used + len(new) > MEMO_WORDS:
            self.at.clear()
            self.table, self.used, new = np.empty((0, self.prob.shape[1])), 0, [*words]
        if new:
            self.learn_words(new)
        get = self.at.__getitem__
        out = [np.fromiter(bag.values(), float, len(bag)) @ self.table[np.fromiter(map(get, bag), np.int64, len(bag))] for bag in bags]
        for w in new:
            if len(w) > MEMO_BYTES:
                del self.at[w]
        return out


def labelled(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: text and language known, not held out."""
    return docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & (held_out() == F.lit(False)))


def held_out():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def fit_model(docs: DataFrame, fit_docs: int = FIT_DOCS, vocab_path: str | None = None):
    """(languages, vocabulary, probabilities, least log-likelihood a byte by language), learned on the driver from about
    fit_docs documents of each language, chosen by hash over the whole table: at most FIT_ALL of FIT_CHARS, in expectation."""
    counts = labelled(docs).groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(FIT_LANGS)
    sizes = {r["lang"]: r["n"] for r in counts.collect()}
    vocab = load_vocabulary(vocab_path)
    if not sizes:
        return [], vocab, np.zeros((len(vocab) + 1, 0)), np.zeros(0)
    each, share = min(fit_docs, FIT_ALL / len(sizes)), F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, each / n))).otherwise(share)
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("langid")), F.lit(1 << 30)) / float(1 << 30)
    rows = labelled(docs).where((draw < share) & (F.length("text") <= FIT_CHARS)).select("doc_id", "text", "lang").distinct().collect()
    rows.sort(key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    if not rows:
        return [], vocab, np.zeros((len(vocab) + 1, 0)), np.zeros(0)
    langs, prob = fit([(r["text"], r["lang"]) for r in rows], vocab)
    least, scorer = np.full(len(langs), -np.inf), Scorer(vocab, prob)
    for k, lang in enumerate(langs):
        texts = [r["text"] for r in rows if r["lang"] == lang and has_letter(r["text"])]
        if texts:
            low, mid = np.quantile([s[k] / size_of(t) for s, t in zip(scorer.totals(texts), texts)], [0.05, 0.5])
            least[k] = mid - FARTHEST * max(mid - low, LEAST_STEP)
    return langs, vocab, prob, least


def size_of(text: str) -> int:
    """Bytes of a text's words, each with the space before it."""
    return max(1, sum(len(w) + 1 for w in words_of(text)))


class Judge:
    """Tells texts' languages under a model (languages, trie, probabilities, least log-likelihood a byte)."""

    def __init__(self, model):
        self.langs, trie, prob, self.least = model
        self.scorer = Scorer(trie, prob)

    def __call__(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language, posterior, log-likelihood a byte, whether both are good enough) of each text."""
        known = [bool(self.langs) and t is not None and has_letter(t) for t in texts]
        scores = iter(self.scorer.totals([t for t, ok in zip(texts, known) if ok]))
        out = []
        for t, ok in zip(texts, known):
            if not ok:
                out.append(("und", 0.0, None, False))
                continue
            s = next(scores)
            best = int(np.argmax(s))
            post = float(1 / np.exp(np.maximum(s - s[best], -700)).sum())
            n = size_of(t)
            likely = s[best] >= self.least[best] * n - SPREAD * math.sqrt(n)
            out.append((self.langs[best], post, float(s[best] / n), post >= LEAST_SCORE and bool(likely)))
        return out


def model_of(docs: DataFrame, fit_docs: int, vocab_path: str | None):
    langs, vocab, prob, least = fit_model(docs, fit_docs, vocab_path)
    return docs.sparkSession.sparkContext.broadcast((langs, Trie(vocab), prob, least))  # its size is the vocabulary's


def identify(docs: DataFrame, fit_docs: int = FIT_DOCS, vocab_path: str | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (posterior of lang_pred, 0 to 1), loglik_per_byte, sure of every row of docs."""
    model = model_of(docs, fit_docs, vocab_path)

    def predict(batches):
        judge = Judge(model.value)
        for b in slices(batches):
            found = zip(*judge(b.column(2).to_pylist()))
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, t) for c, t in zip(found, kinds))], ["doc_id", "held_out", "lang_pred", "score", "loglik_per_byte", "sure"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(), F.lit(False)), "text").mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double, loglik_per_byte double, sure boolean")


def confident(docs: DataFrame, fit_docs: int = FIT_DOCS, vocab_path: str | None = None) -> DataFrame:
    """The rows of docs whose language is told for sure: a posterior of LEAST_SCORE, and words as likely as that language's."""
    model = model_of(docs, fit_docs, vocab_path)

    def judge():
        tell = Judge(model.value)
        return lambda texts: [r[3] for r in tell(texts)]

    return chosen(docs, "text", judge)
