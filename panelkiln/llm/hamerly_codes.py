"""Vector codes of one byte a part: Lloyd's rounds on integers with Hamerly's bounds.

A component x becomes floor(1024 x); a vector is cut into PARTS equal parts, each
with a codebook of up to ENTRIES entries that starts as that part of the vectors
with the smallest ids. A round assigns every part to its nearest entry (squared
distance, the lower index of equals) and moves each used entry to the floor of
its parts' mean.

What a round knows is written for the next: of each part its entry, an upper
bound of the distance to it and one lower bound of the distance to any other
entry. When entries move, the upper bound grows by the way of its own entry and
the lower bound shrinks by the longest way of the others. Only a part whose upper
bound isn't strictly below its lower bound, nor below half the distance from its
entry to the nearest other, is measured: first against its own entry, and if that
doesn't help against all. A part that may be as near to another entry is thus
always scanned, so ties go to the lower index as in a full scan. Distances are
whole numbers: they are sums of products in double precision as long as these
stay below 2^53, and 64-bit integers beyond; larger components are refused.

Each task adds up its parts by entry, so what is shuffled a round is a bounded
number of sums; the codebooks, PARTS x ENTRIES rows, are all that the driver holds.

Vectors that are null or empty or hold null or non-finite components are dropped.
All others must have one length, a multiple of PARTS. Ids may be null (they come
last) or repeat (then the vector decides which come first); every kept row has its
own result. Fewer than ENTRIES rows make as many entries. Null labels are one
label. An empty table gives none. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelkiln.llm.common import mark, rows, settled, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bounds are taken as this much wider than computed: far more than the error of a root and a few sums.
SLACK = 1e-9


def finite(vector: str) -> Column:
    """Whether a vector has components, all of them finite numbers."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ok


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of all x to all entries, exact in their type."""
    return (x * x).sum(1)[:, None] - 2 * (x @ entries.T) + (entries * entries).sum(1)


def scan(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, its distance, the distance of the nearest other entry)."""
    exact = squares(x, entries)
    best, at, d = exact.argmin(1), np.arange(len(x)), exact.astype(np.float64)
    own = np.sqrt(d[at, best])
    d[at, best] = np.inf
    return best, own, np.sqrt(d.min(1))


class Step:
    """The way from one round's entries to the next's, of one part."""

    def __init__(self, old: np.ndarray, new: np.ndarray):
        self.entries = new
        self.way = np.sqrt(((new - old) ** 2).sum(1).astype(np.float64))
        # The longest way of any other entry.
        order = np.argsort(-self.way, kind="stable")
        self.other = np.full(len(new), self.way[order[0]])
        self.other[order[0]] = self.way[order[1]] if len(new) > 1 else 0.0
        apart = squares(new, new).astype(np.float64)
        np.fill_diagonal(apart, np.inf)
        self.half = np.sqrt(apart.min(1)) / 2

    def assign(self, x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> int:
        """Brings entries and bounds up to date in place; how many parts were scanned in full."""
        upper += self.way[own]
        lower -= self.other[own]
        bound = np.maximum(lower, self.half[own])
        fail = np.flatnonzero(upper * (1 + SLACK) + SLACK >= bound)
        upper[fail] = np.sqrt(((x[fail] - self.entries[own[fail]]) ** 2).sum(1).astype(np.float64))
        fail = fail[upper[fail] * (1 + SLACK) + SLACK >= bound[fail]]
        own[fail], upper[fail], lower[fail] = scan(x[fail], self.entries)
        return len(fail)


def _bytes(column: pa.Array) -> bytes:
    return b"".join(column.to_pylist())


def _lines(a: np.ndarray) -> list[bytes]:
    raw, width = a.tobytes(), a.itemsize * a.shape[1]
    return [raw[i : i + width] for i in range(0, len(raw), width)] if width else []


class Shape:
    """How long vectors are, and the types that hold their components and exact distances."""

    def __init__(self, length: int, largest: float):
        self.length, self.part = length, length // PARTS
        most = int(np.ceil(largest)) * SCALE + 1
        bound = 4 * self.part * most * most
        if bound >= 1 << 62:
            raise ValueError("a component is too large for exact distances")
        self.stored = np.dtype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")
        self.exact = np.float64 if bound < 1 << 53 else np.int64

    def parts(self, raw: bytes) -> np.ndarray:
        """(row, part, component) of stored vectors."""
        return np.frombuffer(raw, self.stored).reshape(-1, PARTS, self.part).astype(self.exact)


def shape_of(kept: DataFrame) -> Shape | None:
    size = F.size("v")
    least, most, large = kept.agg(F.min(size), F.max(size), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v"))))).first()
    if least is None:
        return None
    if least != most or least % PARTS:
        raise ValueError(f"vectors need one length, a multiple of {PARTS}; there are {least} to {most}")
    return Shape(least, float(large))


def assigned(df: DataFrame, label: str, shape: Shape, old: list[np.ndarray] | None, new: list[np.ndarray]) -> DataFrame:
    """Every row with its entries and bounds for the codebooks ``new``: measured if ``old`` is None, else carried from there."""
    schema = pa.schema([("vec_id", pa.int64()), ("q", pa.binary()), ("own", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary())])
    full, steps = old is None, [] if old is None else [Step(a, b) for a, b in zip(old, new, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            n = batch.num_rows
            if full:
                v = held["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, shape.length)
                q = np.floor(SCALE * v).astype(shape.stored)
                own, upper, lower = np.empty((n, PARTS), np.int64), np.empty((n, PARTS)), np.empty((n, PARTS))
            else:
                q = np.frombuffer(_bytes(held["q"]), shape.stored).reshape(n, shape.length)
                own = np.frombuffer(_bytes(held["own"]), np.uint8).reshape(n, PARTS).astype(np.int64)
                upper, lower = (np.frombuffer(_bytes(held[c])).reshape(n, PARTS).copy() for c in ("upper", "lower"))
            x = shape.parts(q.tobytes())
            for p in range(PARTS):
                part = np.ascontiguousarray(x[:, p])
                if full:
                    own[:, p], upper[:, p], lower[:, p] = scan(part, new[p])
                else:
                    a, u, d = own[:, p].copy(), upper[:, p].copy(), lower[:, p].copy()
                    steps[p].assign(part, a, u, d)
                    own[:, p], upper[:, p], lower[:, p] = a, u, d
            columns = {"vec_id": held["vec_id"], "q": _lines(q), "own": _lines(own.astype(np.uint8)), "upper": _lines(upper), "lower": _lines(lower)}
            arrays = [held["label"], *(pa.array(columns[f.name], type=f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema)]
            yield pa.RecordBatch.from_arrays(arrays, names=["label", *schema.names])

    inputs = df.select("label", "vec_id", "v") if full else df
    return inputs.mapInArrow(run, f"label {label}, vec_id long, q binary, own binary, upper binary, lower binary")


def moved(state: DataFrame, shape: Shape, books: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after a round: each used entry is the floor of the mean of its parts."""
    out = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])
    k = len(books[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((PARTS, k, shape.part), np.int64), np.zeros((PARTS, k), np.int64)
        for batch in batches:
            x = np.frombuffer(_bytes(batch.column(0)), shape.stored).reshape(-1, PARTS, shape.part).astype(np.int64)
            own = np.frombuffer(_bytes(batch.column(1)), np.uint8).reshape(-1, PARTS)
            for p in range(PARTS):
                np.add.at(sums[p], own[:, p], x[:, p])
                n[p] += np.bincount(own[:, p], minlength=k)
        part, entry = np.nonzero(n)
        yield rows(out, part=part, entry=entry, n=n[part, entry], sums=list(sums[part, entry]))

    each = state.select("q", "own").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = each.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(shape.part)))
    new = [b.copy() for b in books]
    # PARTS x ENTRIES rows at most.
    for r in total.collect():
        new[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(shape.part)]
    return new


def train(vectors: DataFrame) -> tuple[DataFrame, list[np.ndarray], Shape] | None:
    """(rows with their entries for the last codebooks, these, the shape); None without rows. ``vectors``: vec_id, embedding, label."""
    kept = vectors.where(finite("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), "label")
    shape = shape_of(kept)
    if shape is None:
        return None
    first = kept.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    start = np.floor(SCALE * np.array([r["v"] for r in first], np.float64)).astype(np.int64).reshape(-1, PARTS, shape.part)
    books, label = [np.ascontiguousarray(start[:, p]) for p in range(PARTS)], kept.schema["label"].dataType.simpleString()
    exact = lambda b: [x.astype(shape.exact) for x in b]
    since = mark()
    state = written(assigned(kept, label, shape, None, exact(books)), "codes-0")
    for i in range(1, ROUNDS + 1):
        new, before = moved(state, shape, books), state
        state = settled(kept.sparkSession, f"codes-{i}", lambda b=before, n=new: assigned(b, label, shape, exact(books), exact(n)), since)
        books = new
    return state, books, shape


def vector_codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each kept row."""
    spark = vectors.sparkSession
    out = pa.schema([("vec_id", pa.int64()), ("code", pa.string()), ("error", pa.int64())])
    trained = train(vectors)
    if trained is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    state, books, shape = trained
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(_bytes(batch.column(2)), shape.stored).reshape(-1, PARTS, shape.part).astype(np.int64)
            raw = batch.column(3).to_pylist()
            own = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, PARTS)
            error = sum(((x[:, p] - books[p][own[:, p]]) ** 2).sum(1) for p in range(PARTS))
            done = rows(out, vec_id=batch.column(1), code=[c.hex() for c in raw], error=error)
            yield pa.RecordBatch.from_arrays([batch.column(0), *done.columns], names=["label", *out.names])

    label = state.schema["label"].dataType.simpleString()
    coded = written(state.select("label", "vec_id", "q", "own").mapInArrow(run, f"label {label}, vec_id long, code string, error long"), "codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
