"""Toxicity by a linear-chain conditional random field over tokens.

Labels are of documents, so tokens are labelled first: in a toxic document a token is toxic if one of its features
(the word, or its first letters) occurs in toxic documents significantly more often than in clean ones; in
a clean document no token is. The field's feature and transition weights are fitted to those tokens on the
driver, from a bounded sample. Tasks run forward and backward over all tokens of whole texts; the marginals
give the offending spans and, through a logistic function fitted to the sample, the document's score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sampled

#: Bounds of the training sample: toxic and clean documents, and the longest text that is taken into it, in characters.
TOXIC_DOCS, CLEAN_DOCS, LONGEST = 1_200, 2_400, 8_000
#: At most so many features are kept.
MOST_FEATURES = 4_000
PREFIXES = (4, 5)
_EDGE = re.compile(r"^\W+|\W+$")
_TOKEN = re.compile(r"\S+")


def features(token: str) -> list[str]:
    """A token's features; none if it holds no letter."""
    word = _EDGE.sub("", token).lower()
    if not any(map(str.isalpha, word)):
        return []
    return ["=" + word, *[word[:n] for n in PREFIXES if len(word) > n]]


@dataclass
class Field:
    """Weights of a token being toxic, of the transitions (from, to), and of the document's logistic function."""

    weights: dict[str, float]
    bias: float
    start: float
    step: np.ndarray
    document: np.ndarray


def _near_key(words: list[str]) -> int:
    """Mostly the same for near copies of a text: the smallest hash of its three-word sequences."""
    return min((zlib.crc32(" ".join(words[k : k + 3]).encode()) for k in range(max(1, len(words) - 2))), default=0)


def telling_features(texts: list[str], toxic: list[int], most: int = MOST_FEATURES) -> list[str]:
    """Features that occur in more toxic documents than chance explains, by the G statistic.

    Its threshold grows with the number of features tried. Near copies count as one document.
    """
    counts, seen = [Counter(), Counter()], [set(), set()]
    for text, y in zip(texts, toxic, strict=True):
        words = text.split()
        if (key := _near_key(words)) not in seen[y]:
            seen[y].add(key)
            counts[y].update({f for token in set(words) for f in features(token)})
    size = [len(s) for s in seen]
    share = size[1] / sum(size)
    tried = {name: a for name, a in counts[1].items() if a > 1}
    least = 2 * np.log(len(tried) + 1) + 4
    found = []
    for name, a in tried.items():
        b = counts[0][name]
        if a / size[1] <= 2 * b / size[0]:
            continue
        g = 2 * (a * np.log(a / ((a + b) * share)) + (b * np.log(b / ((a + b) * (1 - share))) if b else 0))
        if g >= least:
            found.append((-g, name))
    return [name for _, name in sorted(found)[:most]]


def _sequences(texts: list[str], toxic: list[int], known: dict[str, int], reach: int = 12, length: int = 32):
    """Token windows for training: around toxic tokens, and one at the start of every document.

    Returns features (sequence, token, slot) with -1 for none, labels, and which tokens are real.
    """
    slots = 1 + len(PREFIXES)
    rows, had = [], {}
    for text, y in zip(texts, toxic, strict=True):
        words = text.split()
        for t in words:
            if t not in had:
                had[t] = [known[f] for f in features(t) if f in known]
        tokens = [had[t] for t in words]
        begins, upto = {0}, -1
        for k, has in enumerate(tokens):
            if has and k > upto:
                begins.add(max(0, k - reach))
                upto = k + length - reach
        rows += [(tokens[b : b + length], y) for b in sorted(begins) if tokens[b : b + length]]
    n = len(rows)
    ids, label, real = np.full((n, length, slots), -1), np.zeros((n, length), dtype=int), np.zeros((n, length), dtype=bool)
    for k, (tokens, y) in enumerate(rows):
        real[k, : len(tokens)] = True
        for t, has in enumerate(tokens):
            ids[k, t, : len(has)] = has
            label[k, t] = int(bool(has) and y)
    return ids, label, real


def forward_backward(emit: np.ndarray, start: float, step: np.ndarray, real: np.ndarray):
    """Log partition, token marginals and expected transitions of padded sequences.

    ``emit`` is a token's score of being toxic, clean scores 0; ``step`` holds the transitions' scores.
    """
    n, length = emit.shape
    score = np.stack([np.zeros_like(emit), emit], axis=2)
    a, b = np.zeros((n, length, 2)), np.zeros((n, length, 2))
    a[:, 0] = score[:, 0] + [0.0, start]
    for t in range(1, length):
        new = np.logaddexp(a[:, t - 1, :1] + step[0], a[:, t - 1, 1:] + step[1]) + score[:, t]
        a[:, t] = np.where(real[:, t, None], new, a[:, t - 1])
    for t in range(length - 2, -1, -1):
        onward = score[:, t + 1] + b[:, t + 1]
        new = np.logaddexp(step[:, 0] + onward[:, :1], step[:, 1] + onward[:, 1:])
        b[:, t] = np.where(real[:, t + 1, None], new, 0.0)
    total = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
    p = np.exp(a + b - total[:, None, None])
    pairs = a[:, :-1, :, None] + step + (score + b)[:, 1:, None, :] - total[:, None, None, None]
    moves = (np.exp(pairs) * real[:, 1:, None, None]).sum(axis=(0, 1))
    return total, p[:, :, 1] * real, moves


def fit(texts: list[str], toxic: list[int], steps: int = 80, rate: float = 0.25, shrink: float = 1e-3) -> Field | None:
    """The field of labelled documents; None unless both labels occur."""
    if len(set(toxic)) < 2:
        return None
    names = telling_features(texts, toxic)
    known = {name: k for k, name in enumerate(names)}
    ids, label, real = _sequences(texts, toxic, known)
    seen = ids >= 0
    where = np.nonzero(seen)
    of = ids[where]
    theta = np.zeros(len(names) + 6)  # features, bias, start, transitions
    theta[len(names)] = -3.0
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    f = len(names)
    told = np.zeros((2, 2))
    np.add.at(told, (label[:, :-1][real[:, 1:]], label[:, 1:][real[:, 1:]]), 1)
    n = max(1, len(label))
    for k in range(1, steps + 1):
        emit = theta[f] * real
        np.add.at(emit, where[:2], theta[of])
        _, p, moves = forward_backward(emit, theta[f + 1], theta[f + 2 :].reshape(2, 2), real)
        off = p - label * real
        grad = np.zeros_like(theta)
        np.add.at(grad, of, off[where[:2]])
        grad[f] = off.sum()
        grad[f + 1] = off[:, 0].sum()
        grad[f + 2 :] = (moves - told).reshape(-1)
        grad = grad / n + shrink * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        theta = theta - rate * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    weights = {name: float(w) for name, w in zip(names, theta, strict=False) if abs(w) > 1e-3}
    field = Field(weights, float(theta[f]), float(theta[f + 1]), theta[f + 2 :].reshape(2, 2), np.array([0.0, 1.0, 0.0]))
    x = Tagger(field).measures(texts)
    field.document = _logistic(x, np.array(toxic, dtype=float))
    return field


def _logistic(x: np.ndarray, y: np.ndarray, shrink: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights of a constant and the measures, by Newton's method with a little shrinkage."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    keep = shrink * len(y) * np.diag([0.0, *[1.0] * (x.shape[1] - 1)]) / 10 + 1e-9 * np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-6)[:, None]) + keep, x.T @ (y - p) - keep @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


class _Emissions(dict):
    """The factor exp(score) of a token; remembered, but never more than a million tokens."""

    def __init__(self, field: Field):
        self.weights, self.bias = field.weights, field.bias

    def __missing__(self, token: str) -> float:
        if len(self) > 1_000_000:
            self.clear()
        weights = self.weights
        score = self.bias + sum(weights.get(f, 0.0) for f in features(token))
        self[token] = value = float(np.exp(min(50.0, score)))
        return value


class Tagger:
    """The field over many whole texts at once: step t of all texts that have a t-th token is one vector operation."""

    def __init__(self, field: Field):
        self.field, self.emissions = field, _Emissions(field)
        self.step = np.exp(np.clip(field.step, -30, 30))
        self.start = float(np.exp(np.clip(field.start, -30, 30)))

    def marginals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat probabilities of every token being toxic, and where each text's begin.

        Forward and backward messages are kept as ratios toxic / clean, which cannot overflow.
        """
        look = self.emissions.__getitem__
        parts = [np.fromiter(map(look, text.split()), dtype=float) for text in texts]
        size = np.array([len(p) for p in parts], dtype=np.int64)
        begin = np.concatenate([[0], np.cumsum(size)])
        if not begin[-1]:
            return np.zeros(0), begin
        factor = np.concatenate(parts)
        order = np.argsort(-size, kind="stable")
        at, left = begin[:-1][order], size[order]
        active = np.searchsorted(-left, -np.arange(1, left[0] + 1), side="right")
        (s00, s01), (s10, s11) = self.step
        ahead, behind = np.empty_like(factor), np.empty_like(factor)
        m = active[0]
        ratio = factor[at[:m]] * self.start
        ahead[at[:m]] = ratio
        for t in range(1, left[0]):
            k = at[: active[t]] + t
            ratio = ratio[: active[t]]
            ratio = factor[k] * (s01 + ratio * s11) / (s00 + ratio * s10)
            ahead[k] = ratio
        last = at[:m] + left[:m] - 1
        behind[last] = 1.0
        ratio = np.ones(0)
        for t in range(left[0] - 2, -1, -1):
            n = active[t + 1]
            k = at[:n] + t
            if len(ratio) < n:  # texts that end at the token after this one
                ratio = np.concatenate([ratio, np.ones(n - len(ratio))])
            onward = factor[k + 1] * ratio
            ratio = (s10 + s11 * onward) / (s00 + s01 * onward)
            behind[k] = ratio
        both = ahead * behind
        return both / (1 + both), begin

    def measures(self, texts: list[str], p: np.ndarray | None = None, begin: np.ndarray | None = None) -> np.ndarray:
        """(texts, 2): log odds of the likeliest toxic token, and the log of one plus the number expected among likely ones."""
        if p is None:
            p, begin = self.marginals(texts)
        out = np.tile([-8.0, 0.0], (len(texts), 1))
        rows = np.flatnonzero(np.diff(begin) > 0)
        if len(rows):
            top = np.maximum.reduceat(p, begin[rows])
            likely = np.add.reduceat(np.where(p >= 0.2, p, 0.0), begin[rows])
            out[rows, 0] = np.clip(np.log(top + 1e-12) - np.log1p(-np.minimum(top, 1 - 1e-12)), -8, 8)
            out[rows, 1] = np.log1p(likely)
        return out

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Document scores, and the offending spans (begin, end) in characters: runs of tokens likelier toxic than not."""
        p, begin = self.marginals(texts)
        w = self.field.document
        z = w[0] + self.measures(texts, p, begin) @ w[1:]
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        bad = np.flatnonzero(p >= 0.5)
        for k in np.unique(np.searchsorted(begin, bad, side="right") - 1):
            spans[k] = _spans(texts[k], p[begin[k] : begin[k + 1]] >= 0.5)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30))), spans


def _spans(text: str, bad: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    before = False
    for match, is_bad in zip(_TOKEN.finditer(text), bad, strict=True):
        if is_bad and before:
            out[-1] = (out[-1][0], match.end())
        elif is_bad:
            out.append(match.span())
        before = bool(is_bad)
    return out


def learn(
    docs: DataFrame,
    labels: DataFrame,
    train_on: Column,
    toxic_docs: int = TOXIC_DOCS,
    clean_docs: int = CLEAN_DOCS,
    longest: int = LONGEST,
) -> Field | None:
    """Fits the field to (doc_id, text) and (doc_id, toxic) rows whose label row ``train_on`` holds for.

    The sample is the labelled documents with the smallest hash of their id, at most as many of each label as said,
    without texts that are null or longer than ``longest``. Labels other than 0 and 1 teach nothing; a document
    labelled both ways is in the sample with both.
    """
    rows = labels.where(train_on & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    counts = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    order = F.xxhash64(F.col("doc_id"), F.lit(17))
    # twice as many ids as documents are wanted, as some texts are too long
    room = F.when(F.col("toxic") == 1, toxic_docs).otherwise(clean_docs)
    picked = sampled(rows, "toxic", counts, 2 * max(toxic_docs, clean_docs), order, "doc_id").where(F.col("_rank") <= 2 * room)
    texts = docs.select(F.col("doc_id"), "text").where(F.col("text").isNotNull() & (F.length("text") <= longest))
    # at most 2 * (toxic_docs + clean_docs) rows of three numbers are broadcast
    found = texts.join(F.broadcast(picked), "doc_id")
    again = F.row_number().over(Window.partitionBy("toxic").orderBy("_rank", "text"))
    sample = found.withColumn("_again", again).where(F.col("_again") <= max(toxic_docs, clean_docs)).where(F.col("_again") <= room)
    got = sample.orderBy("toxic", "_again").select("text", "toxic").collect()
    return fit([r["text"] for r in got], [int(r["toxic"]) for r in got])


def score(docs: DataFrame, field: Field | None, group: int = 2_000_000) -> DataFrame:
    """(doc_id, score, predicted, spans): spans are the offending character ranges [begin, end) of the whole text.

    Only ``text`` is an input. Null and empty texts hold no token and get the score of a text without any toxic token;
    without a field all scores are 0. Texts go through in groups of about ``group`` characters. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(field) if field else None
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            values, spans, begin = np.zeros(len(texts)), [[] for _ in texts], 0
            while tagger and begin < len(texts):
                end, size = begin, 0
                while end < len(texts) and (end == begin or size < 4 * group):
                    size += len(texts[end])
                    end += 1
                values[begin:end], spans[begin:end] = tagger.score(texts[begin:end])
                begin = end
            ranges = pa.array([[{"begin": a, "end": b} for a, b in one] for one in spans], kind)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(values), pa.array((values >= 0.5).astype(np.int32)), ranges],
                names=["doc_id", "score", "predicted", "spans"],
            )

    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    schema = f"doc_id {kind}, score double, predicted int, spans array<struct<begin: bigint, end: bigint>>"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
