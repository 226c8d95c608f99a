"""Language identification: averaged hashed subword embeddings under a linear softmax.

Training runs in numpy, by stochastic gradient descent, on a bounded sample of labelled rows; a temperature
and a rejection threshold are fitted on a part of the sample that training does not see. Prediction covers
whole texts: the features are all byte 2-, 3- and 4-grams in ASCII lower case, hashed into BUCKETS rows.
Since the classifier is linear in the average, each bucket's embedding is multiplied into class scores once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from planeframe.llm import textkernel as K
from planeframe.llm.common import flat, narrow, place, released

BUCKETS, DIM, ORDERS = 1 << 15, 16, (2, 3, 4)
#: Labelled rows that are fitted: the first by a hash of their id, and at most so many.
SAMPLE_ROWS = 3000
UNKNOWN = "und"

_LETTERS = r"\p{L}"


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    table: np.ndarray  # BUCKETS x languages: the scores of each bucket's embedding
    bias: np.ndarray
    temperature: float
    #: Predictions with a lower calibrated probability are rejected.
    threshold: float


def grams(body: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the buckets at every byte and whether a whole gram of one text begins there."""
    low = K.LOWER[body].astype(np.uint32)
    n = len(low)
    left = np.repeat(off[1:], np.diff(off)) - np.arange(n)  # bytes up to the text's end
    code = low.copy()
    for order in range(2, max(ORDERS) + 1):
        m = max(0, n - order + 1)
        code[:m] = code[:m] * np.uint32(257) + low[order - 1 :][:m]
        if order in ORDERS:
            h = (code + np.uint32(order * 0x3C6EF372 & 0xFFFFFFFF)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            h *= np.uint32(0x85EBCA77)
            yield (h >> np.uint32(17)).astype(np.int32), left >= order


def bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's buckets and their share."""
    out = []
    for t in texts:
        body = np.frombuffer(t.encode(), np.uint8)
        off = np.array([0, len(body)])
        counts = np.zeros(BUCKETS, np.int64)
        for h, ok in grams(body, off):
            counts += np.bincount(h[ok], minlength=BUCKETS)
        at = np.flatnonzero(counts)
        out.append((at, (counts[at] / max(1, counts.sum())).astype(np.float32)))
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 7, steps: int = 1500, rate: float = 40.0, batch: int = 16) -> Model:
    """Fits a model. Without any labelled text it knows no language and predicts UNKNOWN throughout."""
    names = tuple(sorted(set(langs)))
    if not names:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([names.index(x) for x in langs])
    features = bags(texts)
    order = rng.permutation(len(y))
    held = order[: len(y) // 5] if len(y) >= 50 else order
    fit = order[len(y) // 5 :] if len(y) >= 50 else order
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(names)), np.float32)
    bias = np.zeros(len(names), np.float32)
    done = 0
    while done < steps:  # as many steps for a small sample as for a large one
        rng.shuffle(fit)
        for at in range(0, len(fit), batch):
            rows = fit[at : at + batch]
            eta = rate * max(0.0, 1 - done / steps)
            done += 1
            idx = [features[i][0] for i in rows]
            share = [features[i][1] for i in rows]
            mean = np.stack([s @ emb[i] if len(i) else np.zeros(DIM, np.float32) for i, s in zip(idx, share)])
            slope = _softmax(mean @ out + bias)
            slope[np.arange(len(rows)), y[rows]] -= 1
            slope /= len(rows)
            back = slope @ out.T
            out -= np.float32(eta * 0.05) * (mean.T @ slope)
            bias -= np.float32(eta * 0.01) * slope.sum(0)
            for i, s, g in zip(idx, share, back):
                emb[i] -= np.float32(eta) * s[:, None] * g[None, :]
    table = (emb @ out).astype(np.float32)
    z = np.stack([features[i][1] @ table[features[i][0]] if len(features[i][0]) else np.zeros(len(names)) for i in held]) + bias
    losses = {}
    for t in np.geomspace(0.5, 5, 40):
        p = _softmax(z / t)
        losses[t] = -np.log(np.maximum(p[np.arange(len(held)), y[held]], 1e-9)).mean()
    t = min(losses, key=losses.get)
    p = _softmax(z / t)
    right = p.argmax(1) == y[held]
    sure = np.sort(p.max(1)[right]) if right.any() else np.zeros(1)
    # rejection keeps at least 99.9 % of the rows that were predicted rightly, and never asks for more than a half
    threshold = min(0.5, 0.98 * float(sure[int(len(sure) * 0.001)]))
    return Model(names, table, bias, float(t), threshold)


def is_held_out(doc_id: Column) -> Column:
    """Documents that never train: crc32(doc_id as text) mod 4 is 2 (a null id is not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Trains on at most sample_rows labelled rows of docs(doc_id, text, lang): the first by a hash of their id."""
    labelled = narrow(docs, "doc_id", "text", "lang").filter(~is_held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    n = labelled.count()  # of ids and labels alone
    # about half as many again as are wanted pass the hash, whatever the table's size; the driver gets those only
    share = min(1.0, 1.5 * sample_rows / max(1, n))
    place = F.pmod(F.xxhash64("doc_id", "lang"), F.lit(1 << 30))
    rows = (
        labelled.filter((place < int(share * (1 << 30))) & F.col("text").rlike(_LETTERS))
        .orderBy(place, "doc_id", "lang", F.xxhash64("text"))
        .limit(sample_rows)
        .select("text", "lang")
        .collect()
    )
    return train([r[0] for r in rows], [r[1] for r in rows])


def scores(model: Model, body: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Calibrated probabilities, texts x languages."""
    n, filled = len(off) - 1, np.flatnonzero(np.diff(off))
    total, count = np.zeros((n, len(model.langs)), np.float64), np.zeros(n, np.int64)
    if len(filled):
        at = off[:-1][filled]
        for h, ok in grams(body, off):
            hit = model.table[h]
            hit[~ok] = 0
            total[filled] += np.add.reduceat(hit, at, axis=0)
            count[filled] += np.add.reduceat(ok.astype(np.int64), at)
    return _softmax((total / np.maximum(count, 1)[:, None] + model.bias) / model.temperature)


def predict(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of docs(doc_id, text); only these two are read.

    lang_pred is a learned language, or `und` with score 0.0 where the text is null, empty or without any
    letter. rejected: such rows, and those whose calibrated score lies below the model's threshold. Ties go
    to the language that sorts first. Repeated rows give repeated rows; a null doc_id stays null and is not
    held out. With keep, all columns of docs come along (positions as in docs) before lang_pred, score, rejected.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # BUCKETS x languages floats, whatever the corpus

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            body, off = K.utf8(batch.column(0))
            lettered = np.array(batch.column(1).to_pylist(), bool)
            for a, b in K.runs(off):
                ok = lettered[a:b]
                if m.langs:
                    p = scores(m, body[off[a] : off[b]], off[a : b + 1] - off[a])
                    best, top = p.argmax(1), p.max(1)
                else:
                    ok, best, top = np.zeros(b - a, bool), np.zeros(b - a, int), np.zeros(b - a)
                top = np.where(ok, top, 0.0)
                lang = [m.langs[i] if k else UNKNOWN for i, k in zip(best.tolist(), ok.tolist())]
                extra = [pa.array(lang, pa.string()), pa.array(top, pa.float64()), pa.array((~ok) | (top < m.threshold))]
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[2:], *extra], names)

    if keep:
        rows = flat(docs)
        front, text = rows.columns, F.col(f"c{place(docs, 'text')}")
        rest = rows.select(text.cast("string").alias("t"), F.coalesce(text.rlike(_LETTERS), F.lit(False)).alias("l"), *front)
        schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in front)
    else:
        front, schema = ["doc_id", "held_out"], "doc_id bigint, held_out boolean"
        rest = narrow(docs, "doc_id", "text").select(
            F.col("text").alias("t"), F.coalesce(F.col("text").rlike(_LETTERS), F.lit(False)).alias("l"), F.col("doc_id").cast("bigint").alias("doc_id"), is_held_out(F.col("doc_id")).alias("held_out")
        )
    names = [*front, "lang_pred", "score", "rejected"]
    done = rest.mapInArrow(released(work), f"{schema}, lang_pred string, score double, rejected boolean")
    return done.toDF(*docs.columns, "lang_pred", "score", "rejected") if keep else done


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose language is not rejected, with the columns of docs; null and empty texts, and those
    without a letter, are rejected, and repeated rows share their fate."""
    n = len(docs.columns)
    done = flat(predict(docs, model, keep=True))
    return done.filter(f"NOT c{n + 2}").select([f"c{i}" for i in range(n)]).toDF(*docs.columns)
