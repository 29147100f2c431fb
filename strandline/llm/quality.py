"""Quality classifier: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import bytesums
from strandline.llm.common import chunks, crc_fold, table, texts_of, unused

PASSAGE = 512
SAMPLE = 8000
SAMPLE_PASSAGES = 256
SINGLE = b"\n.,;:!?|%*&$#'\"()-_=/<>@"
#: Classes of bytes: each of SINGLE alone, then lower, upper, digit, white, other punctuation, control, high.
FINE = np.full(256, len(SINGLE) + 6, np.int64)
COARSE = np.full(256, 5, np.int64)
for _b in range(128):
    _c = chr(_b)
    _kind = 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c.isspace() else 4
    FINE[_b] = SINGLE.index(_b) if _b in SINGLE else len(SINGLE) + (5 if _b < 32 and _kind == 4 else _kind)
    COARSE[_b] = _kind
N_FINE, N_COARSE, N_WORD = len(SINGLE) + 7, 6, 6
WIDTH = N_FINE + N_COARSE**2 + N_WORD


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of PASSAGE bytes, and where each text's passages start (with the end of the last).

    Shares of byte classes and of pairs of coarse classes; mean word length, shares of words that repeat their
    predecessor or are new in the passage, words, the passage's and the text's length. An empty text is one passage.
    """
    data, starts = bytesums.joined(texts)
    sizes = np.diff(starts) - 1
    count = np.maximum(1, -(-sizes // PASSAGE))
    first = np.concatenate([[0], np.cumsum(count)])
    n = int(first[-1])
    owner = np.repeat(np.arange(len(texts)), count)
    begin = starts[owner] + (np.arange(n) - first[owner]) * PASSAGE
    end = np.minimum(begin + PASSAGE, starts[owner] + sizes[owner])
    # Each separator counts as a part of the passage before it; an empty text is its separator.
    at = np.repeat(np.arange(n), np.diff(np.append(begin, len(data))))
    length = np.maximum(end - begin, 1).astype(float)
    out = np.zeros((n, WIDTH))
    out[:, :N_FINE] = np.bincount(at * N_FINE + FINE[data], minlength=n * N_FINE).reshape(n, N_FINE) / length[:, None]
    coarse = COARSE[data]
    pair = at[1:] * N_COARSE**2 + coarse[:-1] * N_COARSE + coarse[1:]
    out[:, N_FINE : N_FINE + N_COARSE**2] = np.bincount(pair, minlength=n * N_COARSE**2).reshape(n, -1) / length[:, None]
    a, b = bytesums.words(data)
    if len(a):
        h = bytesums.span_hash(bytesums.prefix(data, 4), a, b)
        p = at[a]
        total = np.maximum(np.bincount(p, minlength=n), 1)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (owner[p[1:]] == owner[p[:-1]])
        new = _distinct(p, h)
        out[:, -6] = np.bincount(p, b - a, minlength=n) / total
        out[:, -5] = np.bincount(p, again, minlength=n) / total
        out[:, -4] = np.bincount(new, minlength=n) / total
        out[:, -3] = np.log1p(total)
    out[:, -2] = np.log1p(end - begin)
    out[:, -1] = np.log1p(sizes[owner])
    return out, first


def _distinct(p: np.ndarray, h: np.ndarray) -> np.ndarray:
    """p of each distinct pair (p, 40 bits of h)."""
    pairs = np.sort(p.astype(np.uint64) << np.uint64(40) | h >> np.uint64(24))
    return (pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] >> np.uint64(40)).astype(np.int64)


def excerpt(text: bytes) -> bytes:
    """A short stretch of whole words from the middle: short texts are too rare among the labelled to learn from alone."""
    size = 8 + zlib.crc32(text) % 120
    at = text.find(b" ", max(0, len(text) - size) // 2) + 1
    return text[at : at + size].rpartition(b" ")[0] or text[at : at + size]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass
class Attention:
    """Encoder, gate and output weights; a bag's score is the sigmoid of its attention-weighted passage code."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]

    @staticmethod
    def forward(weights: list[np.ndarray], x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        w1, b1, v, u, w, c, b = weights
        h = np.tanh(x @ w1 + b1)
        gv, gu = np.tanh(h @ v), _sigmoid(h @ u)
        e = (gv * gu) @ w
        bags, sizes = first[:-1], np.diff(first)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, bags), sizes))
        a = e / np.repeat(np.add.reduceat(e, bags), sizes)
        z = np.add.reduceat(a[:, None] * h, bags)
        return h, gv, gu, a, z, _sigmoid(z @ c + b[0])

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.forward(self.weights, (x - self.mean) / self.scale, first)[-1]


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, code: int = 24, gate: int = 12, epochs: int = 30, batch: int = 64, rate: float = 3e-3, decay: float = 1e-4, seed: int = 7) -> Attention:
    """Adam on the bags' cross-entropy; deterministic for equal input. Without both labels the score is constant."""
    rng = np.random.default_rng(seed)
    mean, scale = (x.mean(0), x.std(0) + 1e-3) if len(x) else (np.zeros(WIDTH), np.ones(WIDTH))
    shapes = [(x.shape[1], code), (code,), (code, gate), (code, gate), (gate,), (code,), (1,)]
    weights = [rng.normal(0, 1 / np.sqrt(s[0]), s) if i not in (1, 6) else np.zeros(s) for i, s in enumerate(shapes)]
    model = Attention(mean, scale, weights)
    if len(y) == 0 or y.min() == y.max():
        weights[5][:] = 0
        weights[6][:] = 4.0 * (2 * y[0] - 1) if len(y) else 4.0
        return model
    x = np.clip((x - mean) / scale, -8, 8)
    m, s, t = [np.zeros_like(q) for q in weights], [np.zeros_like(q) for q in weights], 0
    sizes = np.diff(first)
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            bags = order[at : at + batch]
            n = sizes[bags]
            own = np.concatenate([[0], np.cumsum(n)])
            rows = np.repeat(first[bags] - own[:-1], n) + np.arange(own[-1])
            xs = x[rows]
            w1, b1, v, u, w, c, b = weights
            h, gv, gu, a, z, p = Attention.forward(weights, xs, own)
            ds = (p - y[bags]) / len(bags)
            dz = np.repeat(ds[:, None] * c, n, axis=0)
            da = (dz * h).sum(1)
            de = a * (da - np.repeat(np.add.reduceat(a * da, own[:-1]), n))
            dv, du = de[:, None] * w * gu * (1 - gv**2), de[:, None] * w * gv * gu * (1 - gu)
            dh = (a[:, None] * dz + dv @ v.T + du @ u.T) * (1 - h**2)
            grads = [xs.T @ dh, dh.sum(0), h.T @ dv, h.T @ du, (gv * gu).T @ de, z.T @ ds, ds.sum(keepdims=True)]
            t += 1
            step = rate * (1 - epoch / epochs) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for i, g in enumerate(grads):
                g = g + decay * weights[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                s[i] = 0.999 * s[i] + 0.001 * g * g
                weights[i] = weights[i] - step * m[i] / (np.sqrt(s[i]) + 1e-8)
    model.weights = weights
    return model


def _clip(model: Attention, x: np.ndarray) -> np.ndarray:
    return model.mean + model.scale * np.clip((x - model.mean) / model.scale, -8, 8)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 3, held: int = 1, sample: int = SAMPLE) -> Attention:
    """Learn from at most `sample` labelled documents outside the held-out fold, those of the lowest id hashes, that
    have at most SAMPLE_PASSAGES passages, and from a short excerpt of each; of a document with several labels their rounded mean counts.

    The sample's ids are bounded and so is their broadcast; its passage features, bounded too, train on the driver.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & (crc_fold(id_col, folds) != held))
    known = known.groupBy(F.col(id_col).alias("doc_id")).agg(F.round(F.avg(label_col)).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            texts = texts_of(batch, "text")
            keep = [i for i, x in enumerate(texts) if len(x) <= PASSAGE * SAMPLE_PASSAGES]
            if not keep:
                continue
            x, first = passages([texts[i] for i in keep] + [excerpt(texts[i]) for i in keep])
            x, again = x.astype("<f4"), pa.array(keep * 2)
            bags = pa.array([x[a:b].tobytes() for a, b in zip(first, first[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(again), batch.column("y").take(again), bags], ["doc_id", "y", "x"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"doc_id {kind}, y int, x binary").collect()  # two rows for each id of the sample
    found.sort(key=lambda r: (str(r.doc_id), bytes(r.x)))
    bags = [np.frombuffer(r.x, "<f4").reshape(-1, WIDTH).astype(float) for r in found]
    x = np.concatenate(bags) if bags else np.zeros((0, WIDTH))
    return train(x, np.concatenate([[0], np.cumsum([len(q) for q in bags])]).astype(np.int64), np.array([r.y for r in found], float))


def score(docs: DataFrame, model: Attention, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with a score column (0 to 1) added; every passage of the whole text is encoded. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col, 1 << 20):
            x, first = passages(texts_of(batch, text_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(_clip(model, x), first), pa.float64())], [*batch.schema.names, score_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted of each row.

    Null or empty text: scored as one passage without bytes. Null ids: scored; their fold is that of the empty text.
    Repeated rows: each scored alike. Without labels, or with one label only, the score is constant. Empty table: no
    rows. Labels, lang, source and id are never read by a score.
    """
    model = fit(docs, labels, id_col, text_col, label_col)
    scored = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model)
    return scored.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", at_least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns as they are, whose score is at_least or more."""
    model = fit(docs, labels, id_col, text_col)
    (name,) = unused(docs, "quality")
    return score(docs, model, text_col, name).where(F.col(name) >= at_least).drop(name)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
