"""Language identification by error-correcting output codes.

Every language gets a codeword; one logistic classifier over hashed letter n-grams predicts each bit. Decoding adds,
for every language, the logistic losses of its codeword's bits, weighted by how well each classifier did in training,
and takes the nearest codeword; a small margin to the second flags ambiguity.

Only text and a non-null lang of rows with crc32(doc_id as text) mod 4 <> 2 are learned from, of a documented bounded
sample: about ``per_language`` rows of each language, at most twice as many in all, chosen by a hash of doc_id.
Null texts and texts without a letter are ``und`` with score 0. A null doc_id is neither held out nor learned from.
With no labelled row every text is ``und``; with one language every text with letters is that language. Empty tables
give empty results, repeated rows one row each; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from .common import setup

BINS = 4096
LETTER = re.compile(r"[^\W\d_]")
_table = np.zeros(256, np.uint8)
_table[ord("a") : ord("z") + 1] = np.arange(1, 27)
_table[128:] = 27 + np.arange(128) % 37


def features(texts: list[str]) -> np.ndarray:
    """Unit vectors of the square roots of hashed letter bigram and trigram counts."""
    raw = [f" {t.lower()} ".encode("utf-8", "replace") for t in texts]
    n = np.array([len(r) for r in raw])
    x = _table[np.frombuffer(b"".join(raw) + b"  ", np.uint8)].astype(np.uint32)
    doc = np.repeat(np.arange(len(texts)), n) * BINS
    two = x[:-2] * 64 + x[1:-1]
    three = two * 64 + x[2:]
    spot = [((c * np.uint32(2654435769)) >> np.uint32(20)).astype(np.int64) + doc for c in (two + 1, three + 5000)]
    counts = np.bincount(np.concatenate(spot), minlength=len(texts) * BINS).reshape(len(texts), BINS)
    out = np.sqrt(counts, dtype=np.float32)
    out /= np.maximum(np.sqrt(counts.sum(1, dtype=np.float32)), 1e-9)[:, None]
    return out


def codewords(k: int, seed: int = 11) -> np.ndarray:
    """k codewords of +1 and -1: all splits up to five classes, else the random code with the largest least distance."""
    if k < 2:
        return np.zeros((k, 0), np.float32)
    if k <= 5:
        cols = [[1] + [1 if s >> i & 1 else -1 for i in range(k - 1)] for s in range(2 ** (k - 1) - 1)]
        return np.array(cols, np.float32).T
    rng, bits, best, most = np.random.default_rng(seed), 8 * int(np.ceil(np.log2(k))), None, -1
    for _ in range(300):
        m = rng.choice([-1.0, 1.0], (k, bits)).astype(np.float32)
        if (np.abs(m.sum(0)) == k).any():
            continue
        apart = int(((bits - m @ m.T) / 2 + np.eye(k) * bits).min())
        if apart > most:
            best, most = m, apart
    return best


def train(x: np.ndarray, y: np.ndarray, k: int, steps: int = 120, rate: float = 0.3, decay: float = 1e-5) -> dict:
    """Classifiers of all bits at once, by Adam on the class-balanced logistic loss."""
    code = codewords(k)
    target = code[y]
    weight = (1.0 / np.maximum(np.bincount(y, minlength=k), 1))[y].astype(np.float32)
    weight /= weight.sum()
    w, b = np.zeros((x.shape[1], code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    m = [np.zeros_like(w), np.zeros_like(b)]
    v = [np.zeros_like(w), np.zeros_like(b)]
    for t in range(1, steps + 1):
        g = -target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) * weight[:, None]
        for k_, (p, grad) in enumerate(((w, x.T @ g + decay * w), (b, g.sum(0)))):
            m[k_] = 0.9 * m[k_] + 0.1 * grad
            v[k_] = 0.99 * v[k_] + 0.01 * grad * grad
            p -= rate * (m[k_] / (1 - 0.9**t)) / (np.sqrt(v[k_] / (1 - 0.99**t)) + 1e-8)
    right = np.where((x @ w + b) * target > 0, weight[:, None], 0).sum(0)
    return {"code": code, "w": w, "b": b, "trust": np.maximum(2 * right - 1, 0.01).astype(np.float32)}


def decode(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of the classes: softmax of the negative weighted losses."""
    f = x @ model["w"] + model["b"]
    loss = np.stack([(np.logaddexp(0, -c * f) * model["trust"]).sum(1) for c in model["code"]], 1)
    p = np.exp(loss.min(1, keepdims=True) - loss)
    return p / p.sum(1, keepdims=True)


def _predict(langs: list[str], model: dict | None, margin: float):
    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            lang, score, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            good = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if langs else []
            at = 0
            while at < len(good):
                part, held = [], 0
                while at < len(good) and len(part) < 128 and held < 1 << 20:
                    part.append(good[at])
                    held += len(texts[good[at]])
                    at += 1
                if len(langs) == 1:
                    p = np.ones((len(part), 1))
                else:
                    p = decode(model, features([texts[i] for i in part]))
                top = p.argmax(1)
                first = p[np.arange(len(part)), top]
                second = np.sort(p, 1)[:, -2] if p.shape[1] > 1 else np.zeros(len(part))
                for j, i in enumerate(part):
                    lang[i], score[i], unsure[i] = langs[top[j]], min(1.0, float(first[j])), bool(first[j] - second[j] < margin)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"]
            )

    return run


def fit(docs: DataFrame, per_language: int = 700, seed: int = 3) -> tuple[list[str], dict | None]:
    """Languages and model, from a bounded sample of the rows that are not held out."""
    rows = docs.where("lang is not null and text is not null and text <> '' and not held_out and doc_id is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)
    if len(langs) < 2:
        return langs, None
    share = F.lit(0.0)
    for k in langs:
        share = F.when(F.col("lang") == k, F.lit(per_language / counts[k])).otherwise(share)
    lot = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / float(1 << 53)
    sample = rows.where(lot < share).select("doc_id", "text", "lang").limit(2 * per_language * len(langs)).collect()
    sample = [r for r in sorted(sample, key=lambda r: (r.doc_id, r.lang, r.text)) if LETTER.search(r.text)]
    langs = sorted({r.lang for r in sample})
    if len(langs) < 2:
        return langs, None
    x = np.concatenate([features([r.text for r in sample[i : i + 128]]) for i in range(0, len(sample), 128)])
    return langs, train(x, np.array([langs.index(r.lang) for r in sample]), len(langs))


def identify(docs: DataFrame, per_language: int = 700, margin: float = 0.2) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous of each document."""
    setup(docs.sparkSession)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), held.alias("held_out"))
    langs, model = fit(src, per_language)
    return src.select("doc_id", "text", "held_out").mapInArrow(_predict(langs, model, margin), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def tagged(docs: DataFrame, names: list[str], per_language: int = 700, margin: float = 0.2) -> tuple[DataFrame, list[str]]:
    """The rows of docs with four more columns, and the languages learned.

    names: what to call the predicted language, its score, whether it is ambiguous, and whether there are letters; no
    column of docs. Row by row, without a join, so rows without doc_id or with a repeated one keep a prediction of
    their own.
    """
    setup(docs.sparkSession)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    langs, model = fit(docs.select("doc_id", "text", "lang", held.alias("held_out")), per_language)
    predict = _predict(langs, model, margin)

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            letters = pa.array([bool(t and LETTER.search(t)) for t in texts], pa.bool_())
            asked = pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), letters], ["doc_id", "text", "held_out"])
            (got,) = predict([asked])
            yield pa.RecordBatch.from_arrays([*b.columns, *got.columns[2:], letters], [*b.schema.names, *names])

    schema = StructType([*docs.schema.fields, *(StructField(n, t) for n, t in zip(names, (StringType(), DoubleType(), BooleanType(), BooleanType())))])
    return docs.mapInArrow(run, schema), langs


def op4_langid(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
