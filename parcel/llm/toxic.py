"""Toxicity: a support vector machine over a subsequence string kernel with Nyström landmarks.

Words are compared by the gap-weighted subsequence kernel: common subsequences of ORDER
characters count, each less the wider it is spread, so letters put between an insult's letters
lower the similarity but do not remove it. Characters that are no letters or digits are taken
out of a word first, and runs of single characters are read as one more word ("i d i o t").

Landmarks are the words of toxic training texts with the largest likelihood ratio. A text is
the sum of its words' kernel rows, as a count and as a density, mapped by the inverse root of
the landmarks' kernel matrix (Nyström); a squared-hinge SVM and a logistic curve over its
margin give the score. Kernel values below FLOOR count as zero; a letter mask and the lengths
rule out, before the dynamic program, words whose kernel value is small.

Training reads at most ``max_train`` labelled texts (a documented bound, the smallest hashes of
doc_id), none of them held out; scoring reads every whole text. Null or empty texts get the
score of no evidence. Rows are scored one by one. Labels that repeat for a doc_id count as
toxic if one does. With no training text of one of the classes every score is the share of
toxic labels, smoothed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcel.llm.bpe import slices
from parcel.llm.common import cut, documents, worker_cache

ORDER, DECAY = 3, 0.7
LANDMARKS = 64
MAX_TRAIN = 6_000
FLOOR = 0.45
MAX_WORDS = 300_000
GROUP_CHARS = 1 << 20
_SPACED = re.compile(r"(?<!\S)\S(?: \S(?!\S)){2,}")
_ALNUM = re.compile(r"[\W_]+")


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def text_words(text: str) -> list[str]:
    """Lower-cased words; spelled-out ones are added joined."""
    low = text.lower()
    words = low.split()
    for run in _SPACED.findall(low):
        words.append(run.replace(" ", ""))
    return words


def bare(word: str) -> str:
    return word if word.isalnum() else _ALNUM.sub("", word)


def codes(words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character codes padded with 0, lengths, and a 64-bit mask of the characters."""
    size = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    at = np.repeat(np.cumsum(size) - size, size)
    out = np.zeros((len(words), width), np.uint32)
    row = np.repeat(np.arange(len(words)), size)
    col = np.arange(len(flat)) - at
    keep = col < width
    out[row[keep], col[keep]] = flat[keep]
    bits = np.uint64(1) << (out % np.uint32(61)).astype(np.uint64)
    bits[out == 0] = 0
    return out, size, np.bitwise_or.reduce(bits, axis=1)


def kernel(s: np.ndarray, t: np.ndarray, order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Gap-weighted subsequence kernel of row k of s with row k of t (0: padding)."""
    n, width_t = len(s), t.shape[1]
    before = [np.ones((width_t + 1, n), np.float32)] + [
        np.zeros((width_t + 1, n), np.float32) for _ in range(order - 1)]
    total = np.zeros(n, np.float32)
    square = np.float32(decay * decay)
    tt = np.ascontiguousarray(t.T)
    for i in range(s.shape[1]):
        c = s[:, i]
        if not c.any():
            break
        same = (tt == c) & (c > 0)
        run = [np.zeros(n, np.float32) for _ in range(order)]
        hit = [np.where(same, before[k][:-1], 0) * square for k in range(order)]
        total += hit[order - 1].sum(axis=0)
        for k in range(1, order):
            before[k] *= np.float32(decay)
            for j in range(width_t):
                run[k] = run[k] * np.float32(decay) + hit[k - 1][j]
                before[k][j + 1] += run[k]
    return total


class Landmarks:
    """Kernel rows of words against the landmarks; keeps what it has met."""

    def __init__(self, words: list[str]):
        self.words = words
        self.width = 3 * max(map(len, words))
        self.codes, self.sizes, self.masks = codes(words, max(map(len, words)))
        self.norm = np.sqrt(kernel(self.codes, self.codes))
        self.allowed = np.maximum(1, np.bitwise_count(self.masks).astype(np.int64) * 3 // 10)
        self.forget()

    def forget(self) -> None:
        self.seen: set[str] = set()
        self.active: dict[str, np.ndarray] = {}

    def rows(self, words: list[str]) -> np.ndarray:
        """Normalised kernel values (words x landmarks), zero below FLOOR."""
        c, size, mask = codes(words, self.width)
        missing = np.bitwise_count(self.masks[None, :] & ~mask[:, None]).astype(np.int64)
        ok = (missing <= self.allowed) & (size[:, None] <= 3 * self.sizes) & (
            2 * size[:, None] >= self.sizes)
        w, m = np.nonzero(ok)
        out = np.zeros(ok.shape, np.float32)
        if not len(w):
            return out
        used, back = np.unique(w, return_inverse=True)
        norm = np.zeros(len(used), np.float32)
        for part in _by_length(size[used]):
            x = c[used[part], :size[used[part]].max()]
            norm[part] = np.sqrt(kernel(x, x))
        value = np.zeros(len(w), np.float32)
        for part in _by_length(size[w]):
            value[part] = kernel(c[w[part], :size[w[part]].max()],
                                 self.codes[m[part], :self.sizes[m[part]].max()])
        value /= np.maximum(norm[back] * self.norm[m], 1e-12)
        out[w, m] = np.where(value >= FLOOR, np.minimum(value, 1), 0)
        return out

    def learn(self, words: set[str]) -> None:
        if len(self.seen) > MAX_WORDS:
            self.forget()
        new = [w for w in words if w not in self.seen]
        self.seen.update(new)
        stripped: dict[str, list[str]] = {}
        for w in new:
            b = bare(w)
            if 3 <= len(b) <= self.width:
                stripped.setdefault(b, []).append(w)
        names = list(stripped)
        for at in range(0, len(names), 20_000):
            part = names[at:at + 20_000]
            rows = self.rows(part)
            for k in np.flatnonzero(rows.any(axis=1)):
                for w in stripped[part[k]]:
                    self.active[w] = rows[k]

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Per text: sum of kernel rows, and in the last column the number of words."""
        out = np.zeros((len(texts), len(self.words) + 1))
        start = size = 0
        for end, text in enumerate(texts):      # the words of GROUP_CHARS characters at a time
            if size and size + len(text) > GROUP_CHARS:
                self._add_evidence(texts[start:end], out[start:end])
                start, size = end, 0
            size += len(text)
        self._add_evidence(texts[start:], out[start:])
        return out

    def _add_evidence(self, texts: list[str], out: np.ndarray) -> None:
        words = [text_words(t) for t in texts]
        self.learn({w for ws in words for w in ws})
        active = self.active
        for k, ws in enumerate(words):
            hits = [active[w] for w in ws if w in active]
            if hits:
                out[k, :-1] = np.sum(hits, axis=0)
            out[k, -1] = len(ws)


def _by_length(size: np.ndarray) -> list[np.ndarray]:
    """Indices in groups of similar length, at most 50,000 in a group."""
    order = np.argsort(size, kind="stable")
    out = []
    for group in np.split(order, np.searchsorted(size[order], [7, 10, 14, 20, 30])):
        out += [group[k:k + 50_000] for k in range(0, len(group), 50_000)]
    return [g for g in out if len(g)]


def features(evidence: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Nyström features of the counts and of the density of the evidence, and a constant."""
    s, n = evidence[:, :-1], evidence[:, -1:]
    return np.hstack([np.log1p(s) @ root, np.sqrt(s / (n + 20)) @ root * 4,
                      np.log1p(s.sum(axis=1, keepdims=True)),
                      10 * np.sqrt(s.sum(axis=1, keepdims=True) / (n + 20)),
                      np.ones((len(s), 1))])


def fit_svm(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Squared-hinge SVM by Newton steps on the examples inside the margin."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(50):
        inside = y * (x @ w) < 1
        a = x[inside]
        new = np.linalg.solve(a.T @ a + np.diag(penalty), a.T @ y[inside])
        if np.allclose(new, w, atol=1e-6):
            break
        w = (w + new) / 2 if _ > 10 else new
    return w


def fit_curve(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve over the margins, with smoothed targets."""
    pos, neg = (y > 0).sum(), (y < 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    ab = np.array([1.0, 0.0])
    x = np.column_stack([margin, np.ones_like(margin)])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ ab, -30, 30)))
        h = x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (target - p))
        ab += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(ab[0]), float(ab[1])


def training_texts(docs: DataFrame, labels: DataFrame, max_train: int) -> DataFrame:
    """doc_id, text, toxic of at most ``max_train`` labelled texts that are not held out."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"),
                          F.col("toxic").cast("int").alias("toxic")).where(
        F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))
    ).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    return documents(docs).join(F.broadcast(marks), "doc_id").select("doc_id", "text", "toxic")


def choose_landmarks(train: DataFrame, many: int) -> list[str]:
    """Words with the largest log-likelihood ratio among those commoner in toxic texts."""
    def run(batches):
        for b in batches:
            words, toxic = [], []
            for text, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                own = {bare(w) for w in text_words(text)}
                own = [w for w in own if 4 <= len(w) <= 16]
                words += own
                toxic += [t] * len(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array(toxic, pa.int32())], names=["word", "t"])

    total = {r[0]: r[1] for r in train.groupBy("toxic").count().collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    counts = train.select("text", "toxic").mapInArrow(run, "word string, t int").groupBy("word").agg(
        F.sum("t").alias("a"), F.sum(1 - F.col("t")).alias("b"))
    a, b = F.col("a"), F.col("b")
    both = (a + b) / F.lit(float(n1 + n0))
    part = lambda k, p: F.when(k > 0, k * F.log(k / p)).otherwise(0.0)
    ratio = part(a, both * n1) + part(b, both * n0) + part(n1 - a, n1 * (1 - both)) + part(
        n0 - b, n0 * (1 - both))
    return [r[0] for r in counts.where((a >= 3) & (a * n0 > b * n1 * 4) & (a + b < n1 + n0)).orderBy(
        F.desc(ratio), "word").limit(many).collect()]


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, landmarks: int = LANDMARKS):
    """Model: dict of landmarks and numpy arrays, or the constant score without evidence."""
    train = cut(training_texts(docs, labels, max_train))
    share = train.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    n, pos = share[0], share[1] or 0
    words = choose_landmarks(train, landmarks) if 0 < pos < n else []
    if not words:
        return {"words": [], "constant": (pos + 1) / (n + 2) if n else 0.0}
    rows = train.select("doc_id", "text", "toxic").mapInArrow(
        _evidence_of(words), "toxic int, e array<double>").collect()
    y = np.array([1.0 if r[0] else -1.0 for r in rows])
    e = np.array([r[1] for r in rows])
    k = Landmarks(words).rows(words).astype(float)
    k = (k + k.T) / 2
    value, vector = np.linalg.eigh(k)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 0.05))) @ vector.T
    x = features(e, root)
    w = fit_svm(x, y)
    slope, offset = fit_curve(x @ w, y)
    return {"words": words, "root": root, "w": w, "slope": slope, "offset": offset}


def _landmarks(words: list[str]) -> Landmarks:
    return worker_cache(("toxic", *words), lambda: Landmarks(words))


def _evidence_of(words):
    def run(batches):
        for b in batches:
            e = _landmarks(words).evidence(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(2), pa.array(list(e), pa.list_(pa.float64()))], names=["toxic", "e"])
    return run


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id and score of every whole text."""
    if not model["words"]:
        return documents(docs).select("doc_id", F.lit(float(model["constant"])).alias("score"))

    def run(batches):
        known = _landmarks(model["words"])
        for ids, texts in slices(batches):
            margin = features(known.evidence(texts), model["root"]) @ model["w"]
            p = 1 / (1 + np.exp(-np.clip(model["slope"] * margin + model["offset"], -500, 500)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(p)],
                                             names=["doc_id", "score"])
        known.forget()      # the worker may serve other stages next

    return documents(docs).mapInArrow(run, "doc_id long, score double")


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    scored = score(docs, fit(docs, labels, max_train))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: dict) -> DataFrame:
    """``docs``, all columns, without the rows that score one half or more. The score is a
    column of each row's own text, so rows are not joined and repeated rows stay together."""
    if not model["words"]:
        return docs if model["constant"] < 0.5 else docs.where(F.lit(False))

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _landmarks(model["words"])
        for text in texts:
            margin = features(known.evidence(text.fillna("").tolist()), model["root"]) @ model["w"]
            yield pd.Series(1 / (1 + np.exp(-np.clip(model["slope"] * margin + model["offset"],
                                                     -500, 500))))
        known.forget()      # the worker may serve other stages next

    return docs.where(scored(F.col("text")) < 0.5)
