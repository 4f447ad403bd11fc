"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its distinct words, hashed and scaled so that they weigh
as much for long texts as for short ones; statistics of its form (shares of
upper case, digits, symbols, blanks, distinct words and lines, lengths), one
indicator per bin; and the stored n_chars, as a bin and as agreement with the
text. Each feature has a weight and a vector; the pairwise term of all features
is half the square of the summed vectors less the sum of their squares, so a
text is scored in time linear in its features.

The machine is fitted on the driver from a bounded sample: of the labelled rows
allowed, the ``sample`` ids (a parameter) with the smallest hash, one text each
(of rows that repeat an id the least text), and of those as many as have
``MOST_FEATURES`` features together. Only the features reach the driver.
Every row is scored over its whole text.

Null texts are empty and are scored like any text; null or repeated labels and
ids are allowed; without labels every score is 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkiln.llm.common import chunks, free, rows, text_of, texts

WORD_BITS = 14
BINS = 12
N_STATS = 11
SIZE = (1 << WORD_BITS) + N_STATS * BINS + 2 * BINS
#: Labelled rows that a fit uses at most.
SAMPLE = 12_000
#: Features of all sampled rows: 8 bytes each, so 256 MB for the driver at most.
MOST_FEATURES = 32 << 20
THRESHOLD = 0.3

_CLASS = np.zeros(256, np.int64)  # 0: other and letters outside ASCII
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:'\"()-?"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[[b for b in range(33, 127) if _CLASS[b] == 0]] = 6


def _bin(share: float) -> int:
    """Bins that are fine near 0 and 1."""
    edges = (0.002, 0.01, 0.03, 0.08, 0.2, 0.4, 0.6, 0.8, 0.92, 0.98, 0.995)
    return sum(share > e for e in edges)


def features(text: bytes, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values."""
    words = text.split()
    distinct = set(words)
    n = max(1, len(words))
    lines = text.split(b"\n")
    held = np.bincount(_CLASS[np.frombuffer(text, np.uint8)], minlength=7) / max(1, len(text))
    chars = len(text.decode("utf-8", "replace"))
    log = lambda x: min(BINS - 1, int(x).bit_length() // 2)
    bins = [_bin(held[1]), _bin(held[2]), _bin(held[3]), _bin(held[4]), _bin(held[5]), _bin(held[6]), _bin(len(distinct) / n), _bin(len(set(lines)) / len(lines)), min(BINS - 1, len(text) // n), log(len(words)), log(len(lines))]
    told = 0 if n_chars is None or n_chars != n_chars else int(n_chars)
    bins += [log(told), 0 if n_chars is None else 1 if told == chars else 2]
    form = [(1 << WORD_BITS) + k * BINS + b for k, b in enumerate(bins)]
    crc, mask = zlib.crc32, (1 << WORD_BITS) - 1
    hashed = np.unique(np.array([crc(w) & mask for w in distinct], np.int64))
    index = np.concatenate([hashed, np.array(form, np.int64)])
    return index, np.concatenate([np.full(len(hashed), 1 / max(1, len(hashed)) ** 0.5), np.ones(len(form))]).astype(np.float32)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def logits(self, index: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """starts: where each row's features begin; each row has some."""
        v = self.vectors[index] * value[:, None]
        total = np.add.reduceat(v, starts)
        squares = np.add.reduceat((v * v).sum(1), starts)
        return self.bias + np.add.reduceat(self.weights[index] * value, starts) + 0.5 * ((total * total).sum(1) - squares)

    def scores(self, found: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not found:
            return np.empty(0)
        starts = np.cumsum([0, *(len(i) for i, _ in found)])[:-1]
        z = self.logits(np.concatenate([i for i, _ in found]), np.concatenate([x for _, x in found]), starts)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(found: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, rank: int = 8, epochs: int = 8, rate: float = 0.1, decay: float = 1e-5, batch: int = 128, seed: int = 7) -> Machine:
    """Logistic loss, AdaGrad over small batches."""
    rng = np.random.default_rng(seed)
    m = Machine(0.0, np.zeros(SIZE, np.float32), rng.normal(0, 0.02, (SIZE, rank)).astype(np.float32))
    if len(found) == 0 or labels.min() == labels.max():
        # Nothing to tell apart: the share of label 1, half without rows.
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        return Machine(float(np.log(share / (1 - share))), m.weights, np.zeros_like(m.vectors))
    m.bias = float(np.log(labels.mean() / (1 - labels.mean())))
    seen_w, seen_v, seen_b = np.full(SIZE, 1e-6), np.full((SIZE, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = rng.permutation(len(found))
        for at in range(0, len(order), batch):
            rows_ = order[at : at + batch]
            part = [found[k] for k in rows_]
            sizes = np.array([len(i) for i, _ in part])
            starts = np.cumsum(sizes) - sizes
            index, value = np.concatenate([i for i, _ in part]), np.concatenate([x for _, x in part])
            v = m.vectors[index] * value[:, None]
            total = np.add.reduceat(v, starts)
            z = m.bias + np.add.reduceat(m.weights[index] * value, starts) + 0.5 * ((total * total).sum(1) - np.add.reduceat((v * v).sum(1), starts))
            miss = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[rows_]) / len(rows_)
            each = np.repeat(miss, sizes)
            used, where = np.unique(index, return_inverse=True)
            gw = np.bincount(where, each * value) + decay * m.weights[used]
            pull = (each * value)[:, None] * (np.repeat(total, sizes, 0) - v)
            gv = np.stack([np.bincount(where, pull[:, k]) for k in range(rank)], 1) + decay * m.vectors[used]
            seen_w[used] += gw * gw
            seen_v[used] += gv * gv
            m.weights[used] -= (rate * gw / np.sqrt(seen_w[used])).astype(np.float32)
            m.vectors[used] -= (rate * gv / np.sqrt(seen_v[used])).astype(np.float32)
            gb = float(miss.sum())
            seen_b += gb * gb
            m.bias -= rate * gb / seen_b**0.5
    return m


def fold(column: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.crc32(column.cast("string").cast("binary")) % folds


def train(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, sample: int = SAMPLE) -> Machine:
    """allowed: a condition on doc_id that labelled rows must meet."""
    told = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
    if allowed is not None:
        told = told.where(allowed)
    told = told.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # At most ``sample`` rows of two numbers.
    picked = docs.select("doc_id", text_of().alias("text"), _told(docs)).join(F.broadcast(told), "doc_id")
    picked = picked.groupBy("doc_id").agg(F.min(F.struct("text", "n_chars")).alias("row"), F.max("quality").alias("quality")).select("doc_id", "row.text", "row.n_chars", "quality")
    out = pa.schema([("doc_id", pa.int64()), ("quality", pa.int64()), ("index", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = [features(t, c) for t, c in zip(texts(batch), batch.column(2).to_pylist(), strict=True)]
            yield rows(out, doc_id=batch.column(0).cast(pa.int64()), quality=batch.column(3).cast(pa.int64()), index=[i.astype(np.int32) for i, _ in found], value=[x for _, x in found])

    found = picked.mapInArrow(run, "doc_id long, quality long, index array<int>, value array<float>")
    # A window over the bounded sample.
    upto = F.sum(F.size("index")).over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    got = found.withColumn("upto", upto).where(F.col("upto") <= MOST_FEATURES).drop("upto").toArrow()
    # Views of the batches as they came: the features are in memory once.
    rows_, ids, told = [], [], []
    for batch in got.to_batches():
        ends = batch.column("index").offsets.to_numpy().tolist()
        index, value = (batch.column(c).values.to_numpy() for c in ("index", "value"))
        rows_ += [(index[a:b], value[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        ids.append(batch.column("doc_id").to_numpy())
        told.append(batch.column("quality").to_numpy())
    order = np.argsort(np.concatenate(ids), kind="stable") if ids else []
    machine = fit([rows_[k] for k in order], np.concatenate(told)[order].astype(np.float64) if ids else np.zeros(0))
    return machine


def _told(docs: DataFrame) -> Column:
    return (F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")).alias("n_chars")


def score(docs: DataFrame, machine: Machine) -> Column:
    """The score of each row's text. The machine has a fixed size, so it goes with the function."""

    @F.pandas_udf("double")
    def scored(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, n_chars in parts:
            out = []
            for i in range(0, len(text), 64):
                pairs = zip(text.iloc[i : i + 64], n_chars.iloc[i : i + 64], strict=True)
                out.append(machine.scores([features(t.encode("utf-8", "replace"), None if pd.isna(c) else c) for t, c in pairs]))
            yield pd.Series(np.concatenate(out) if out else np.empty(0))

    return scored(text_of(), _told(docs))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted); learns from labels whose fold is not 0."""
    machine = train(docs, labels, fold(F.col("doc_id"), 5) != 0, sample)
    held_out = F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    out = docs.select("doc_id", held_out, score(docs, machine).alias("score"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are not rejected, with their columns."""
    machine = train(docs, labels, fold(F.col("doc_id"), 5) != 0, sample)
    own = free("_score", docs)
    return docs.withColumn(own, score(docs, machine)).where(F.col(own) >= threshold).drop(own)
