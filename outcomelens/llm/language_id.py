"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads blocks of bytes in both directions and gives every position a distribution over languages. It is
trained on the driver in numpy by backpropagation through time, on excerpts of a bounded number of documents a
language. Tasks label every position of every whole text and average the positions' probabilities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sampled

#: Bounds of the training sample: documents a language, and characters of a document.
DOCS_PER_LANGUAGE, EXCERPT = 400, 400
#: Excerpts of all languages together; with very many languages each has fewer, but this many at least.
EXCERPTS, FEWEST = 25_600, 8
#: How far above an even spread over the languages a document's likeliest one must be, as a share of the way to certainty.
ABOVE = 1 / 15
UNKNOWN = "und"


@dataclass
class Settings:
    hidden: int = 8
    block: int = 96
    steps: int = 240
    batch: int = 160
    rate: float = 0.02
    seed: int = 5


@dataclass
class Network:
    """Weights of both directions (inputs, recurrence, bias of the candidate) and of the output layer."""

    languages: list[str]
    block: int
    weights: dict[str, np.ndarray] = field(default_factory=dict)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _start(hidden: int, classes: int, random: np.random.Generator) -> dict[str, np.ndarray]:
    w = {}
    for way in "fb":
        w[f"x{way}"] = random.normal(0, 0.3, (257, 3 * hidden))
        w[f"u{way}"] = random.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
        w[f"c{way}"] = np.zeros(hidden)
        w[f"v{way}"] = random.normal(0, 1 / np.sqrt(hidden), (hidden, classes))
    w["o"] = np.zeros(classes)
    return w


def _run(w: dict, way: str, codes: np.ndarray) -> tuple[np.ndarray, list]:
    """States (time, row, hidden) of one direction, and what the way back needs. Code 256 is padding."""
    rows, time = codes.shape
    hidden = w[f"u{way}"].shape[0]
    states, kept = np.zeros((time, rows, hidden)), [()] * time
    h = np.zeros((rows, hidden))
    for t in range(time) if way == "f" else range(time - 1, -1, -1):
        a = w[f"x{way}"][codes[:, t]]
        u = h @ w[f"u{way}"]
        z, r = np.split(_sigmoid(a[:, : 2 * hidden] + u[:, : 2 * hidden]), 2, axis=1)
        un = u[:, 2 * hidden :] + w[f"c{way}"]
        n = np.tanh(a[:, 2 * hidden :] + r * un)
        kept[t] = (h, z, r, un, n)
        h = n + z * (h - n)
        states[t] = h
    return states, kept


def _back(w: dict, way: str, codes: np.ndarray, kept: list, d_states: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of one direction from those of its states, back through time."""
    rows, time = codes.shape
    hidden = w[f"u{way}"].shape[0]
    gx, gu, gc = np.zeros_like(w[f"x{way}"]), np.zeros_like(w[f"u{way}"]), np.zeros(hidden)
    dh = np.zeros((rows, hidden))
    for t in range(time - 1, -1, -1) if way == "f" else range(time):
        h, z, r, un, n = kept[t]
        dh = dh + d_states[t]
        dn = dh * (1 - z) * (1 - n * n)
        dz = dh * (h - n) * z * (1 - z)
        dr = dn * un * r * (1 - r)
        dun = dn * r
        into = np.concatenate([dz, dr, dun], axis=1)
        np.add.at(gx, codes[:, t], np.concatenate([dz, dr, dn], axis=1))
        gu += h.T @ into
        gc += dun.sum(axis=0)
        dh = dh * z + into @ w[f"u{way}"].T
    return {f"x{way}": gx, f"u{way}": gu, f"c{way}": gc}


def loss_and_gradients(w: dict, codes: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross entropy over the positions of a batch of blocks, every position labelled as its document."""
    forward, kept_f = _run(w, "f", codes)
    backward, kept_b = _run(w, "b", codes)
    score = forward @ w["vf"] + backward @ w["vb"] + w["o"]
    score -= score.max(axis=2, keepdims=True)
    p = np.exp(score)
    p /= p.sum(axis=2, keepdims=True)
    weight = (codes.T < 256)[:, :, None] / max(1, (codes < 256).sum())
    target = np.zeros_like(p)
    target[:, np.arange(len(label)), label] = 1
    loss = float(-(np.log(p + 1e-12) * target * weight).sum())
    d = (p - target) * weight
    grads = {"vf": np.einsum("trh,trc->hc", forward, d), "vb": np.einsum("trh,trc->hc", backward, d), "o": d.sum(axis=(0, 1))}
    grads |= _back(w, "f", codes, kept_f, d @ w["vf"].T)
    grads |= _back(w, "b", codes, kept_b, d @ w["vb"].T)
    return loss, grads


def _blocks(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts cut into padded blocks of codes, and the text that each block is of."""
    counts = [-(-len(t) // size) for t in texts]
    codes = np.full((sum(counts), size), 256, dtype=np.int16)
    flat, at = codes.reshape(-1), 0
    for text, n in zip(texts, counts, strict=True):
        flat[at : at + len(text)] = np.frombuffer(text, dtype=np.uint8)
        at += n * size
    return codes, np.repeat(np.arange(len(texts)), counts)


def train(texts: list[str], languages: list[str], settings: Settings | None = None) -> Network | None:
    """A network fitted to labelled excerpts; None without any."""
    s = settings or Settings()
    names = sorted(set(languages))
    if not names:
        return None
    random = np.random.default_rng(s.seed)
    codes, of = _blocks([t.encode() for t in texts], s.block)
    if not len(codes):
        return None
    label = np.array([names.index(x) for x in languages])[of]
    w = _start(s.hidden, len(names), random)
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    # every language is drawn as often, whatever its share
    share = 1 / np.bincount(label, minlength=len(names))[label].astype(float)
    share /= share.sum()
    for step in range(1, s.steps + 1):
        rows = random.choice(len(codes), size=min(s.batch, len(codes)), p=share)
        _, grads = loss_and_gradients(w, codes[rows], label[rows])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = s.rate * min(1.0, 2 * (1 - step / (s.steps + 1)))
        for k, g in grads.items():
            g = g * min(1.0, 1 / (norm + 1e-12))
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            w[k] = w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Network(names, s.block, w)


class Labeller:
    """The network for many blocks at once: single precision, hidden units along the first axis, reused buffers."""

    def __init__(self, network: Network, rows: int = 4096):
        self.languages, self.block, self.rows = network.languages, network.block, rows
        w = network.weights
        self.hidden = h = w["uf"].shape[0]
        # gates are tanh of half their input; halving the weights saves the product
        half = np.concatenate([np.full(2 * h, 0.5), np.ones(h)])
        f32 = lambda a: np.ascontiguousarray(a, dtype=np.float32)
        self.x = {d: f32(w[f"x{d}"] * half) for d in "fb"}
        self.u = {d: f32((w[f"u{d}"] * half).T) for d in "fb"}
        self.c = {d: f32(w[f"c{d}"])[:, None] for d in "fb"}
        self.v = {d: f32(w[f"v{d}"].T) for d in "fb"}
        self.o = f32(w["o"])[:, None]

    def _states(self, codes: np.ndarray, way: str) -> np.ndarray:
        """(time, classes, rows): what a direction adds to the scores."""
        time, rows = codes.shape
        hidden, x, u, c, v = self.hidden, self.x[way], self.u[way], self.c[way], self.v[way]
        out = np.empty((time, v.shape[0], rows), np.float32)
        h = np.zeros((hidden, rows), np.float32)
        a, m = np.empty((3 * hidden, rows), np.float32), np.empty((3 * hidden, rows), np.float32)
        for t in range(time) if way == "f" else range(time - 1, -1, -1):
            a[:] = x.take(codes[t], axis=0).T
            np.matmul(u, h, out=m)
            gates, n = a[: 2 * hidden], a[2 * hidden :]
            gates += m[: 2 * hidden]
            np.tanh(gates, out=gates)
            gates += 1
            gates *= 0.5
            un = m[2 * hidden :]
            un += c
            un *= gates[hidden:]
            n += un
            np.tanh(n, out=n)
            h -= n
            h *= gates[:hidden]
            h += n
            np.matmul(v, h, out=out[t])
        return out

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """(rows, classes): the probabilities of a block's positions added up; padding counts nothing."""
        total = np.empty((len(codes), len(self.languages)))
        for at in range(0, len(codes), self.rows):
            part = np.ascontiguousarray(codes[at : at + self.rows].T)
            score = self._states(part, "f")
            score += self._states(part, "b")
            score += self.o
            score -= score.max(axis=1, keepdims=True)
            np.exp(score, out=score)
            score /= score.sum(axis=1, keepdims=True)
            score *= (part < 256)[:, None, :]
            total[at : at + self.rows] = score.sum(axis=0).T
        return total

    def label(self, texts: list[bytes]) -> np.ndarray:
        """(texts, classes): mean probabilities over the positions of each whole text; zeros for an empty one."""
        out = np.zeros((len(texts), len(self.languages)))
        begin = 0
        while begin < len(texts):  # as many texts at a time as fill a few runs
            end, size = begin, 0
            while end < len(texts) and (end == begin or size < 4 * self.rows * self.block):
                size += len(texts[end])
                end += 1
            for text_at, codes, of in self._portions(texts[begin:end]):
                np.add.at(out, begin + text_at + of, self.sums(codes))
            begin = end
        length = np.array([max(1, len(t)) for t in texts], dtype=float)
        return out / length[:, None]

    def _portions(self, texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Blocks of the texts; a very long text comes in portions of whole blocks, so memory stays bounded."""
        most = 64 * self.rows * self.block
        if len(texts) == 1 and len(texts[0]) > most:
            for at in range(0, len(texts[0]), most):
                yield 0, *_blocks([texts[0][at : at + most]], self.block)
        else:
            yield 0, *_blocks(texts, self.block)


def learn(
    docs: DataFrame,
    train_on: Column,
    settings: Settings | None = None,
    docs_per_language: int = DOCS_PER_LANGUAGE,
    excerpt: int = EXCERPT,
) -> Network | None:
    """Fits a network to the rows of (doc_id, text, lang) that ``train_on`` holds for.

    The sample is the documents with the smallest hash of their id, at most ``docs_per_language`` of a language, and of each
    an excerpt of at most ``excerpt`` characters from a place given by the hash. Every language is learned; where there are very many, the
    sample of each is smaller, so that all together stay near ``EXCERPTS``. Rows without text or language
    teach nothing. Without any left there is no network. Of documents with equal hashes the first excerpts by code point are taken.
    """
    rows = docs.where(train_on & F.col("lang").isNotNull() & (F.length("text") > 0))
    known = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    docs_per_language = min(docs_per_language, max(FEWEST, EXCERPTS // max(1, len(known))))
    order = F.xxhash64(F.col("doc_id"), F.lit(3))
    place = F.pmod(order, F.greatest(F.length("text") - excerpt, F.lit(0)) + 1) + 1
    excerpts = rows.select("doc_id", "lang", F.substring(F.col("text"), place.cast("int"), F.lit(excerpt)).alias("_excerpt"))
    sample = sampled(excerpts, "lang", known, docs_per_language, order, "_excerpt")
    picked = sample.orderBy("lang", "_rank").collect()
    taken = Counter(r["lang"] for r in picked)
    if short := [lang for lang, n in known.items() if taken[lang] < min(n, docs_per_language)]:
        # very many rows share an id: the cut is by id and excerpt then, and equal ones teach once
        rest = excerpts.where(F.col("lang").isin(short)).distinct()
        counts = {r[0]: r[1] for r in rest.groupBy("lang").count().collect()}
        sample = sampled(rest, "lang", counts, docs_per_language, F.xxhash64(order, "_excerpt"), "_excerpt")
        picked = [r for r in picked if r["lang"] not in short] + sample.orderBy("lang", "_rank").collect()
    return train([r["_excerpt"] for r in picked], [r["lang"] for r in picked], settings)


def least_score(network: Network) -> float:
    """The score under which a text is in none of the network's languages. With one language, it is that one."""
    even = 1 / len(network.languages)
    return even + ABOVE * (1 - even) if len(network.languages) > 1 else 0.0


def recognised(docs: DataFrame, network: Network | None) -> DataFrame:
    """The rows in a known language, with ``lang_pred`` and ``score``: those without a letter go, and those no language is likely for.

    Where no label taught a network, every text with a letter stays, as ``und``.
    """
    if network is None:
        return identify(docs, None).where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    return identify(docs, network).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least_score(network)))


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """All columns of ``docs`` with ``lang_pred`` and ``score`` in their places or after them.

    Only ``text`` is an input. Null, empty and letterless texts, and every text without a network, are ``und`` with score 0.
    Of equally likely languages the first by name wins.
    """
    columns = [c for c in docs.columns if c not in ("lang_pred", "score")]
    plain = docs.select(*columns)
    schema = plain.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(network) if network else None
        for batch in batches:
            for part in (batch.slice(k, 1024) for k in range(0, batch.num_rows, 1024)):
                texts = part.column(at).to_pylist()
                readable = [bool(labeller and t and any(map(str.isalpha, t))) for t in texts]
                names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                rows = [k for k, yes in enumerate(readable) if yes]
                if rows:
                    p = labeller.label([texts[k].encode() for k in rows])
                    for k, best, most in zip(rows, p.argmax(axis=1), p.max(axis=1), strict=True):
                        names[k], scores[k] = labeller.languages[best], min(1.0, float(most))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=[*columns, "lang_pred", "score"],
                )

    return plain.mapInArrow(run, schema)


def held_out(key: str, parts: int, part: int) -> Column:
    """Whether a document is kept from training: by the CRC-32 of its id as text. A null id is never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))
