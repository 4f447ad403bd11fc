"""Embedding near-duplicates by E8 lattice hashing.

Unit vectors are projected to 16 random orthonormal directions, two blocks of eight,
in each of TABLES tables, scaled and shifted; a block decodes to the nearest points
of the E8 lattice: its own cell and the nearest of the 240 around it. The PROBES
pairs of cells, one of each block, that are nearest in sum are a vector's keys.
Vectors that share a key are candidates if Hamming distance of 128 sign bits doesn't
tell them far apart; candidates are verified by cosine in double precision.
Measured against brute force in 64 dimensions, pairs with a cosine of just 0.9 meet
in 98 of 100 cases, those of 0.95 in all but one of some thousand.

Groups never become pairs. Equal vectors are one item. Items that share a fine cell
of the same tables with a smaller item at an angle of RADIUS or less join the ball
around that item; RADIUS is under half the angle of the threshold, so all of a
ball are linked by the triangle inequality and only counted. A ball is one entry a
key, however many members it has: two balls whose centres are near enough are
linked whole, too far apart not at all, and between, their members are compared in
blocks of some BLOCK by BLOCK, which give counts and one link. So what is written
grows with vectors and with links between different balls.

Vectors that are null or empty, zero, or hold null or non-finite components link
with nothing and are their own component; vectors of different lengths don't link.
Null ids count as vectors and belong to components but don't name one (null if no
member has an id). Rows that repeat an id are vectors of their own. Columns but
vec_id and embedding aren't read. An empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product
from math import acos, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.llm.common import hot_join, partitions, rows, written
from panelkiln.llm.components import components
from panelkiln.llm.hamerly_codes import finite

TABLES, BLOCKS, NEAR, PROBES, SEED = 3, 2, 6, 8, 11
#: Lattice scale for 64 dimensions, where a pair at 0.9 is 0.55 apart in a block; with the root of the length otherwise. Of fine cells.
WIDTH, FINE = 3.5, 7.0
#: Radians around a ball's centre; what is taken off or added for rounding.
RADIUS, SLACK = 0.22, 1e-7
BITS = 128
#: Items of a key up to which pairs are tried by place; items of a block of a ball.
FEW, BLOCK = 64, 256


@cache
def around() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = [np.eye(8)[i] * a + np.eye(8)[j] * b for i, j in combinations(range(8), 2) for a, b in product((1, -1), repeat=2)]
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


def _even(x: np.ndarray) -> np.ndarray:
    """The nearest whole points with an even sum: of an odd one the coordinate that was rounded furthest goes the other way."""
    r = np.rint(x)
    off = x - r
    odd = np.flatnonzero(r.sum(1) % 2 != 0)
    k = np.abs(off[odd]).argmax(1)
    r[odd, k] += np.where(off[odd, k] >= 0, 1, -1)
    return r


def decoded(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8: of the even points and of those moved by one half."""
    a, b = _even(x), _even(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], a, b)


def nearest(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(points, squared distances): the own cell and the n - 1 nearest around it."""
    own = decoded(x)
    rest = x - own
    base = (rest**2).sum(1)[:, None]
    d = base - 2 * (rest @ around().T) + 2
    which = np.argpartition(d, n - 2, axis=1)[:, : n - 1]
    return np.concatenate([own[:, None], own[:, None] + around()[which]], 1), np.concatenate([base, np.take_along_axis(d, which, 1)], 1)


@cache
def directions(length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tables' orthonormal directions, their shifts, sign planes) for vectors of a length."""
    rng = np.random.default_rng([SEED, length])
    wide, each = max(length, 8 * BLOCKS), 8 * BLOCKS
    turned = [np.linalg.qr(rng.standard_normal((wide, each)))[0][:length] for _ in range(TABLES)]
    return np.concatenate(turned, 1), rng.random((TABLES, BLOCKS, 8)), rng.standard_normal((length, BITS))


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng([SEED, seed]).integers(1, 1 << 63, n, dtype=np.uint64) << np.uint64(1) | np.uint64(1)


FACTORS, TABLE_FACTORS = _odd(8 * BLOCKS, 1).reshape(BLOCKS, 8), _odd(TABLES, 2)


def _hashed(points: np.ndarray, block: int) -> np.ndarray:
    return ((2 * points).astype(np.int64).view(np.uint64) * FACTORS[block]).sum(-1, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    return (h ^ h >> np.uint64(29)).view(np.int64)


def _scaled(unit: np.ndarray, width: float) -> np.ndarray:
    """(table, row, block, coordinate)"""
    turned, shifts, _ = directions(unit.shape[1])
    x = unit @ turned * (width * sqrt(max(unit.shape[1], 8 * BLOCKS) / 64))
    return x.reshape(len(unit), TABLES, BLOCKS, 8).transpose(1, 0, 2, 3) + shifts[:, None]


def keys(unit: np.ndarray) -> np.ndarray:
    """The keys of unit vectors, TABLES x PROBES each."""
    out = []
    for t, x in enumerate(_scaled(unit, WIDTH)):
        h, d = np.tile(TABLE_FACTORS[t : t + 1] + np.uint64(unit.shape[1]), (len(unit), 1)), np.zeros((len(unit), 1))
        for b in range(BLOCKS):
            points, far = nearest(x[:, b], NEAR)
            h = (h[:, :, None] + _hashed(points, b)[:, None]).reshape(len(unit), -1)
            d = (d[:, :, None] + far[:, None]).reshape(len(unit), -1)
        which = np.argpartition(d, PROBES - 1, axis=1)[:, :PROBES]
        out.append(_mixed(np.take_along_axis(h, which, 1)))
    return np.concatenate(out, 1)


def fine_cells(unit: np.ndarray) -> np.ndarray:
    """One fine cell of both blocks in each table."""
    out = [sum(_hashed(decoded(x[:, b]), b) for b in range(BLOCKS)) for x in _scaled(unit, FINE)]
    return _mixed(np.stack(out, 1) + np.uint64(3) * TABLE_FACTORS + np.uint64(unit.shape[1]))


def signs(unit: np.ndarray) -> np.ndarray:
    """BITS sign bits as two signed integers."""
    return np.packbits(unit @ directions(unit.shape[1])[2] > 0, axis=1).view(np.int64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)).sum(-1, dtype=np.int64)


def most_bits(angle: float) -> int:
    """Sign bits in which two vectors at this angle differ at most, but for one pair in some ten millions."""
    p = angle / pi
    return int(BITS * p + 5.5 * sqrt(BITS * p * (1 - p)))


def _vectors(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, vectors in double precision) of each length."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    ends = np.cumsum(sizes)
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        yield at, flat[(ends[at] - n)[:, None] + np.arange(n)]


def _unit(v: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of large or small components stay finite.
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision."""
    top_a, top_b = np.abs(a).max(1), np.abs(b).max(1)
    plain = bool(len(a)) and min(top_a.min(), top_b.min()) > 1e-100 and max(top_a.max(), top_b.max()) < 1e100
    a, b = (a, b) if plain else (a / top_a[:, None], b / top_b[:, None])
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _angle(cos: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cos, -1, 1))


CELLS = pa.schema([("item", pa.int64()), ("cell", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64())])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        item = batch.column(0).to_numpy()
        for at, v in _vectors(batch.column(1)):
            unit = _unit(v)
            s = np.repeat(signs(unit), TABLES, 0)
            yield rows(CELLS, item=np.repeat(item[at], TABLES), cell=fine_cells(unit).ravel(), s0=s[:, 0], s1=s[:, 1])


ANGLES = pa.schema([("item", pa.int64()), ("ball", pa.int64()), ("angle", pa.float64())])


def _angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (item, ball, item's vector, ball's vector) those at an angle of RADIUS or less; the rows' lengths agree."""
    for batch in batches:
        item, ball = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for (at, a), (_, b) in zip(_vectors(batch.column(2)), _vectors(batch.column(3)), strict=True):
            angle = _angle(cosine(a, b))
            ok = angle <= RADIUS
            yield rows(ANGLES, item=item[at][ok], ball=ball[at][ok], angle=angle[ok])


def balls(items: DataFrame) -> DataFrame:
    """(item, ball, angle, s0, s1) of the items that join the ball of a smaller one; the signs are the ball's centre's."""
    cells = written(items.select("item", "v").mapInArrow(_cells, "item long, cell long, s0 long, s1 long"), "cells")
    lead = cells.groupBy("cell").agg(F.min_by(F.struct("item", "s0", "s1"), "item").alias("lead"), F.count("*").alias("rows")).where("rows > 1")
    far = F.bit_count(F.col("s0").bitwiseXOR(F.col("lead.s0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("lead.s1")))
    near = hot_join(cells, written(lead, "leads"), "cell", "rows").where(F.col("lead.item") < F.col("item")).where(far <= most_bits(RADIUS))
    chosen = written(near.groupBy("item").agg(F.min_by("lead", "lead.item").alias("lead")).select("item", F.col("lead.item").alias("ball"), "lead.s0", "lead.s1"), "chosen")
    centres = chosen.groupBy("ball").agg(F.count("*").alias("rows")).join(items.select(F.col("item").alias("ball"), F.col("v").alias("w")), "ball")
    both = hot_join(chosen.join(items.select("item", "v"), "item"), written(centres, "centres"), "ball", "rows")
    near = both.where(F.size("v") == F.size("w")).select("item", "ball", "v", "w").mapInArrow(_angles, "item long, ball long, angle double")
    return near.join(chosen.drop("ball"), "item")


KEYED = pa.schema([("key", pa.int64()), ("ball", pa.int64()), ("several", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64())])
KEYED_DDL = "key long, ball long, several long, s0 long, s1 long"


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each item's keys; of a ball's members each key once a task, as far as a bounded memory of them reaches."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        ball, joined = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        s = np.stack([batch.column(i).to_numpy() for i in (3, 4)], 1)
        for at, v in _vectors(batch.column(0)):
            unit = _unit(v)
            key, sign = keys(unit), np.where(joined[at, None], s[at], signs(unit))
            n = key.shape[1]
            keep = np.ones(key.shape, bool)
            for i in np.flatnonzero(joined[at]):
                new = [(k, ball[at[i]]) for k in key[i].tolist()]
                keep[i] = [p not in seen for p in new]
                seen.update(new)
            if len(seen) > 1_000_000:
                seen.clear()
            keep = keep.ravel()
            wide = lambda x, n=n, keep=keep: np.repeat(x, n)[keep]
            yield rows(KEYED, key=key.ravel()[keep], ball=wide(ball[at]), several=wide(joined[at].astype(np.int64)), s0=wide(sign[:, 0]), s1=wide(sign[:, 1]))


PAIRS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


class Runs:
    """Candidates within runs of equal keys."""

    def __init__(self, threshold: float):
        self.most = np.array([most_bits(acos(threshold) + k * RADIUS) for k in range(3)])

    def near(self, several: np.ndarray, signs: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return _apart(signs[i], signs[j]) <= self.most[several[i] + several[j]]

    def found(self, key: np.ndarray, ball: np.ndarray, several: np.ndarray, signs: np.ndarray) -> pa.RecordBatch:
        """Rows in order of (key, ball)."""
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (ball[1:] != ball[:-1])])
        first = np.flatnonzero(new)
        several = np.maximum.reduceat(several, first)
        key, ball, signs = key[first], ball[first], signs[first]
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        size = np.diff(edge)
        small, us, vs = np.repeat(size <= FEW, size), [], []
        for d in range(1, FEW):
            i = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
            if not len(i):
                break
            hit = i[self.near(several, signs, i, i + d)]
            us.append(ball[hit])
            vs.append(ball[hit + d])
        for k in np.flatnonzero(size > FEW):
            for i in range(edge[k], edge[k + 1], 512):
                a = np.arange(i, min(i + 512, edge[k + 1]))
                for j in range(i, edge[k + 1], 512):
                    b = np.arange(j, min(j + 512, edge[k + 1]))
                    hit = self.near(several, signs, a[:, None], b[None]) & (a[:, None] < b)
                    x, y = np.nonzero(hit)
                    us.append(ball[a[x]])
                    vs.append(ball[b[y]])
        if not us:
            return rows(PAIRS, u=[], v=[])
        pairs = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], 1), axis=0)
        return rows(PAIRS, u=pairs[:, 0], v=pairs[:, 1])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows; a key that reaches a batch's end is kept for the next."""
        held: list[np.ndarray] = []
        for batch in batches:
            new = np.stack([c.to_numpy() for c in batch.columns], 1)
            held.append(new)
            if sum(map(len, held)) < 1 << 17:
                continue
            x = np.concatenate(held)
            cut = int(np.searchsorted(x[:, 0], x[-1, 0]))
            held = [x[cut:]]
            if cut:
                yield self.found(x[:cut, 0], x[:cut, 1], x[:cut, 2], x[:cut, 3:])
        if held and sum(map(len, held)):
            x = np.concatenate(held)
            yield self.found(x[:, 0], x[:, 1], x[:, 2], x[:, 3:])


def candidates(members: DataFrame, threshold: float) -> DataFrame:
    """(u, v), u < v: balls with a key in common whose signs are near."""
    keyed = members.select("v", "ball", "joined", "s0", "s1").mapInArrow(_keyed, KEYED_DDL)
    return keyed.repartition(partitions(members.sparkSession), "key").sortWithinPartitions("key", "ball").mapInArrow(Runs(threshold), "u long, v long").distinct()


#: What a pair of balls is: apart, some members linked perhaps, all linked.
APART, PERHAPS, WHOLE = 0, 1, 2


def judged(pairs: DataFrame, centres: DataFrame, threshold: float) -> DataFrame:
    """(u, v, kind) of candidate pairs by their centres' cosine and the balls' radii."""
    out = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("kind", pa.int32())])
    limit = acos(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, reach = (batch.column(i).to_numpy() for i in range(3))
            for (at, a), (_, b) in zip(_vectors(batch.column(3)), _vectors(batch.column(4)), strict=True):
                cos = cosine(a, b)
                angle, r = _angle(cos), reach[at]
                kind = np.where(angle + r <= limit - SLACK, WHOLE, np.where(angle - r > limit + SLACK, APART, PERHAPS))
                kind = np.where(r == 0, np.where(cos >= threshold, WHOLE, APART), kind)
                yield rows(out, u=u[at], v=v[at], kind=kind)

    side = lambda x: centres.select(F.col("ball").alias(x), F.col("v").alias(f"{x}_v"), F.col("radius").alias(f"{x}_r"))
    both = pairs.join(side("u"), "u").join(side("v"), "v").where("size(u_v) = size(v_v)")
    return both.select("u", "v", (F.col("u_r") + F.col("v_r")).alias("reach"), "u_v", "v_v").mapInArrow(run, "u long, v long, kind int").where(F.col("kind") > APART)


def compared(pairs: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """(item, n, u, v): rows linked with an item over pairs of balls that may be linked, member by member in blocks."""
    out = pa.schema([("item", pa.int64()), ("n", pa.int64()), ("u", pa.int64()), ("v", pa.int64())])
    names = ["u", "v", "a_item", "a_n", "a_v", "b_item", "b_n", "b_v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = dict(zip(names, (c[i].as_py() for c in batch.columns), strict=True))
                a, b = np.array(r["a_v"]), np.array(r["b_v"])
                hit = np.stack([cosine(np.broadcast_to(x, b.shape), b) >= threshold for x in a])
                for side, n in (("a", hit @ np.array(r["b_n"])), ("b", np.array(r["a_n"]) @ hit)):
                    some = np.flatnonzero(n)
                    yield rows(out, item=np.array(r[f"{side}_item"])[some], n=n[some], u=np.full(len(some), r["u"]), v=np.full(len(some), r["v"]))

    sizes = members.groupBy("ball").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    mine = members.join(sizes, "ball").withColumn("block", F.pmod(F.xxhash64("item"), "blocks"))
    # Some BLOCK items by hash.
    held = mine.groupBy("ball", "block", "blocks").agg(F.collect_list(F.struct("item", "n", "v")).alias("m"))
    side = lambda x, y: held.select(F.col("ball").alias(x), F.col("m.item").alias(f"{y}_item"), F.col("m.n").alias(f"{y}_n"), F.col("m.v").alias(f"{y}_v"))
    return pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select(*names).mapInArrow(run, "item long, n long, u long, v long")


def embedding_groups(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    if not cos_of_radius() > threshold:
        raise ValueError("a ball's members must be linked with each other")
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"))
    usable = finite("v") & F.exists("v", lambda x: x != 0)
    digest = (F.xxhash64("v"), F.xxhash64(F.lit("v"), "v"))
    good = plain.where(usable).withColumns({"h0": digest[0], "h1": digest[1]})
    ids = written(good.select("vec_id", "h0", "h1"), "ids")
    items = good.groupBy("h0", "h1").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("v").alias("v"))
    items = written(items.withColumn("item", F.coalesce("least", "h0")), "items")
    joined = written(balls(items), "balls")
    members = items.join(joined, "item", "left").withColumns({"ball": F.coalesce("ball", "item"), "joined": F.col("ball").isNotNull(), "angle": F.coalesce("angle", F.lit(0.0)), **{s: F.coalesce(s, F.lit(0)) for s in ("s0", "s1")}})
    members = written(members, "members")
    total = written(members.groupBy("ball").agg(F.sum("n").alias("total"), F.max("angle").alias("radius"), F.min("least").alias("least")), "totals")
    pairs = candidates(members, threshold)
    centres = total.select("ball", "radius").join(items.select(F.col("item").alias("ball"), "v"), "ball")
    links = written(judged(pairs, centres, threshold), "ball-links")
    perhaps = links.where(F.col("kind") == PERHAPS).select("u", "v")
    in_doubt = perhaps.select(F.col("u").alias("ball")).unionByName(perhaps.select(F.col("v").alias("ball"))).distinct()
    met = written(compared(perhaps, members.select("ball", "item", "n", "v").join(in_doubt, "ball", "left_semi"), threshold), "met")
    whole = links.where(F.col("kind") == WHOLE).select("u", "v")
    edges = whole.unionByName(met.select("u", "v").distinct())
    each = whole.unionByName(whole.select(F.col("v").alias("u"), F.col("u").alias("v"))).join(total.select(F.col("ball").alias("v"), "total"), "v")
    outside = each.groupBy(F.col("u").alias("ball")).agg(F.sum("total").alias("outside"))
    named = components(edges.select("u", "v"))
    labelled = total.join(named, F.col("ball") == F.col("node"), "left").withColumn("label", F.coalesce("component", "ball"))
    roots = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    of_ball = written(labelled.join(roots, "label").join(outside, "ball", "left").select("ball", "component_id", (F.col("total") - 1 + F.coalesce("outside", F.lit(0))).alias("links"), F.col("total").alias("rows")), "of-ball")
    of_item = hot_join(members.select("item", "ball", "h0", "h1", "n"), of_ball, "ball", "rows").drop("rows")
    own = met.groupBy("item").agg(F.sum("n").alias("own"))
    of_item = of_item.join(own, "item", "left").select("h0", "h1", "component_id", (F.col("links") + F.coalesce("own", F.lit(0))).alias("n_links"), F.col("n").alias("rows"))
    of_row = hot_join(ids, written(of_item, "of-item"), "h1", "rows", also="h0").select("vec_id", "n_links", "component_id")
    alone = plain.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    same = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return of_row.unionByName(alone).withColumn("kept", same)


def cos_of_radius() -> float:
    """The least cosine within a ball: two members are twice RADIUS apart at most."""
    return float(np.cos(2 * RADIUS + SLACK))
