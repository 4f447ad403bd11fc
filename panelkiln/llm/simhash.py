"""SimHash near-duplicates by fuzzy hashing with the binary Golay code.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. If two
fingerprints differ in at most four bits, two of the three segments differ in at
most two bits together (the worst segment has two or more of the four, or none
has more than one and the other two have two at most). The Golay code is
perfect: every 23-bit word lies within distance 3 of one codeword. Two words at
distance 2 have a word midway, and its codeword is within 4 of both; so if a
segment's keys are all codewords within distance 4 - one, or six for the words
that lie at distance 3 from theirs - close segments share a codeword. Two bits in
a pair of segments are two in one and none in the other, or one in each. So of a
pair one segment gives its codewords, and the other itself and all words with one
of its set bits cleared: of two words that differ in one bit, one is among the
other's. For two bits in the other segment the roles change, with equal words on
the first side. All these keys have 35 bits, so among 2^35 fingerprints chance
brings a few together, not thousands. All fingerprints that share a key are
compared, which verifies the candidates.

Equal fingerprints are one class and are compared once. A key shared by few
fingerprints is checked pair by pair; one shared by many is searched breadth
first, which gives a spanning forest of its links and no more than one link a
fingerprint; one shared by more than BLOCK is cut into blocks, and each pair of
blocks is a task of its own. So no key's pairs are ever all emitted, and none is
left out.

Null texts are empty; texts without words have fingerprint zero, which is linked
like any other. Null ids belong to their class but name no component.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelkiln.llm.common import chunks, free, partitions, rows, text_of, texts, written
from panelkiln.llm.components import components

WORDS, SEED, DISTANCE = 4, 42, 4
#: The code's generator polynomial: a fixed value.
GENERATOR = 0xC75
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Fingerprints of a key up to which all pairs are checked, and beyond which it is cut into blocks.
FEW, BLOCK = 12, 50_000


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """Signed 64-bit SimHash of a text's word shingles."""
    found = text.lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = xxhash.xxh64_digest(joined, SEED)
        n = 1
    else:
        starts = np.cumsum([0, *map(len, found)]) + np.arange(len(found) + 1)
        digest = xxhash.xxh64_digest
        begin, end = starts[: len(found) - words + 1].tolist(), (starts[words:] - 1).tolist()
        hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip(begin, end, strict=True)])
        n = len(begin)
    ones = np.zeros(64, np.int64)
    held = np.frombuffer(hashes, np.uint8)
    for i in range(0, len(held), 1 << 16):
        ones += np.unpackbits(held[i : i + (1 << 16)]).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each byte at each of three places; by syndrome, up to six error patterns of weight 4 or less, -1 for none."""

    def syndrome(x: int) -> int:
        for k in range(22, 10, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - 11)
        return x

    places = np.array([[syndrome((b << 8 * k) & (1 << 23) - 1) for b in range(256)] for k in range(3)])
    unit = [syndrome(1 << k) for k in range(23)]
    patterns = np.full((2048, 6), -1, np.int64)
    filled = [0] * 2048
    for weight in range(5):
        for ks in combinations(range(23), weight):
            s = e = 0
            for k in ks:
                s ^= unit[k]
                e |= 1 << k
            patterns[s, filled[s]] = e
            filled[s] += 1
    return places, patterns


def near_codewords(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word the 12-bit indices of the codewords within distance 4: six columns, -1 for none."""
    places, patterns = golay()
    s = places[0][words & 255] ^ places[1][words >> 8 & 255] ^ places[2][words >> 16]
    errors = patterns[s]
    return np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1)


def cleared(words: np.ndarray, n: int) -> np.ndarray:
    """Each word and the words with one of its set bits cleared, -1 for bits that are not set."""
    bit = np.int64(1) << np.arange(n, dtype=np.int64)
    fewer = np.where(words[:, None] & bit, words[:, None] ^ bit, -1)
    return np.concatenate([words[:, None], fewer], 1)


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): all keys of each signed 64-bit fingerprint."""
    bits = prints.view(np.uint64)
    words = [(bits >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = [near_codewords(w) for w in words]
    out_row, out_key = [], []
    for pair, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        # (codewords, plain words): up to two bits against up to one, and up to two against none.
        for way, (a, b) in enumerate(((near[i], cleared(words[j], SEGMENTS[j][1])), (near[j], words[i][:, None]))):
            both = (a[:, :, None] >= 0) & (b[:, None, :] >= 0)
            key = (2 * pair + way) << 36 | a[:, :, None] << 24 | b[:, None, :]
            out_row.append(np.nonzero(both)[0])
            out_key.append(key[both])
    return np.concatenate(out_row), np.concatenate(out_key)


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.view(np.uint64) ^ b.view(np.uint64)) <= DISTANCE


def forest(prints: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that connect what is connected, breadth first: one a fingerprint at most."""
    left, us, vs = prints, [], []
    while len(left):
        front, left = [left[:1]], left[1:]
        while front and len(left):
            for u in front.pop():
                hit = close(left, np.full(1, u))
                if hit.any():
                    us.append(np.full(int(hit.sum()), u))
                    vs.append(left[hit])
                    front.append(left[hit])
                    left = left[~hit]
                    if not len(left):
                        break
    return us, vs


LINKS = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def bucket_links(key: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
    """Links within runs of equal keys; both arrays sorted by key."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    size = np.diff(edge)
    us, vs = [], []
    small = np.repeat(size <= FEW, size)
    for d in range(1, FEW):
        i = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
        if not len(i):
            break
        hit = i[close(prints[i], prints[i + d])]
        us.append(prints[hit])
        vs.append(prints[hit + d])
    for k in np.flatnonzero(size > FEW):
        a, b = forest(np.unique(prints[edge[k] : edge[k + 1]]))
        us += a
        vs += b
    if not us:
        return rows(LINKS, u=[], v=[])
    found = np.unique(np.stack([np.concatenate(us), np.concatenate(vs)], 1), axis=0)
    return rows(LINKS, u=found[:, 0], v=found[:, 1])


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, print) sorted by key; a run that reaches a batch's end is kept for the next."""
    key, prints = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        key, prints = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([prints, batch.column(1).to_numpy()])
        if len(key) < 1 << 18:
            continue
        cut = int(np.searchsorted(key, key[-1]))
        if cut:
            yield bucket_links(key[:cut], prints[:cut])
            key, prints = key[cut:], prints[cut:]
    if len(key):
        yield bucket_links(key, prints)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, print)"""
    out = pa.schema([("doc_id", pa.int64()), ("print", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield rows(out, doc_id=batch.column(0), print=[fingerprint(t, words) for t in texts(batch)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, print long")


def _keyed(prints: DataFrame) -> DataFrame:
    out = pa.schema([("key", pa.int64()), ("print", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_numpy()
            row, key = keys(found)
            yield rows(out, key=key, print=found[row])

    return prints.select("print").mapInArrow(run, "key long, print long")


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """(u, v): enough links between distinct fingerprints to connect all that are connected."""
    spark = prints.sparkSession
    n = partitions(spark)
    keyed = _keyed(prints)
    hot = written(keyed.groupBy("key").count().where(F.col("count") > block), "hot-keys")
    cold = keyed
    if hot.take(1):
        cold = keyed.join(hot, "key", "left_anti")
    found = cold.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_link, "u long, v long")
    if hot.take(1):
        # A row of block i goes to the pairs (i, j) and (j, i) of blocks, and is met by each other row once.
        blocks = F.ceil(F.col("count") / (block / 2)).cast("long")
        mine = F.pmod(F.xxhash64("print"), blocks)
        pairs = keyed.join(hot, "key").select("key", "print", blocks.alias("n"), mine.alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        task = F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j"))
        found = found.unionByName(pairs.select(task.alias("key"), "print").repartition(n, "key").sortWithinPartitions("key").mapInArrow(_link, "u long, v long"))
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def near_groups(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest id reachable over links of fingerprints."""
    marks = written(fingerprints(docs, words), "fingerprints")
    classes = written(marks.groupBy("print").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "classes")
    joined = components(links(classes))
    labelled = classes.join(joined, F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("component", "print").alias("label"))
    roots = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = written(labelled.join(roots, "label").select("print", "component_id"), "named")
    return resolve(marks, named, classes).select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


#: At most so many fingerprints can each have 1/HOT of all rows.
HOT = 512


def resolve(marks: DataFrame, named: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with their class's component. Classes with 1/HOT of all rows or more, HOT at most, are broadcast; others are joined."""
    at_least = max(64, -(-marks.count() // HOT))
    hot = F.broadcast(named.join(classes.where(F.col("copies") >= at_least).select("print"), "print"))
    cold = marks.join(F.broadcast(classes.where(F.col("copies") >= at_least).select("print")), "print", "left_anti")
    return marks.join(hot, "print").unionByName(cold.join(named, "print"))


def drop_near_copies(docs: DataFrame, words: int = WORDS) -> DataFrame:
    return keep_first(docs, near_groups(docs, words))


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """One document of each group stays, the one with the smallest id; all its columns are kept.

    Of rows that repeat that id one stays. A group whose ids are all null keeps one row of each text.
    """
    own, nth = free("_id", docs), free("_nth", docs)
    stay = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(own)).distinct()
    out = docs.join(stay, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")
    if docs.groupBy("doc_id").count().where("count > 1").take(1):
        text = F.xxhash64(text_of())
        first = F.row_number().over(Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), text)).orderBy(text))
        out = out.withColumn(nth, first).where(F.col(nth) == 1).drop(nth)
    return out
