"""Katz backoff language model of words, counted and evaluated in blocks of documents.

Tokens are white-space separated words with A-Z lower-cased and one end token a
document; a text's probability is the product over its tokens of P(w | v), v
being the word before (a begin mark for the first).

* P1(w): a word seen r times in training has Good-Turing probability d_r r / N; the
  mass that is left is that of one class of all unseen words, so P1 sums to one.
* P(w | v) = d_r c(v, w) / c(v) where (v, w) was seen r times; else a(v) P1(w), with
  a(v) = (1 - seen mass after v) / (1 - P1 of the words seen after v), so that each
  context sums to one exactly. Where no count after v is small enough to be
  discounted, c(v) is raised by one to leave mass. Unseen contexts back off wholly.
* d_r is Katz's Good-Turing discount for r up to K, from the counts of counts of
  each order, with the largest K from 5 down to 2 whose discounts all lie between
  0 and 1 (copies of texts disturb single counts of counts). If there is none, the
  counts of counts are smoothed by a line through their logarithms, n_r = a r^b,
  which gives proper discounts for K = 5 whenever they fall faster than 1/r. Only
  tables too small or even for that (a single count of counts, or a slower fall)
  take one half off each small count.

The work is done in blocks of some million tokens, written once as a table. Each
block counts before anything is shuffled and asks for what it needs: first the
totals of its words, then those of its word pairs; the tasks that own a range of
words or pairs sum what all blocks sent, store the model's rows (the tables
``unigrams`` and ``bigrams``, partitioned by bucket) and answer each block in the
order of its question. So a shuffled row is a packed slice of a block, a frequent word or
pair is there once a block, and no task holds more than its block or bucket. The
pairs of very frequent contexts are dealt by their second word; there are at most
8 times as many such contexts as buckets, and their sums alone pass the driver.

Words are told apart by 64-bit hashes: among n different words two share one with
a chance of about n^2 / 2^65. Null texts are empty: the end token alone. A null id
counts as training. Ids may repeat.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.llm.common import chunks, partitions, rows, shared_folder, text_of, texts
from panelkiln.llm.fm_quality import fold

#: Counts up to K are discounted.
K = 5
BLOCK_TOKENS = 2_000_000
END = b"\n"  # no word holds a line feed


def packed(values: np.ndarray) -> bytes:
    """Numbers of any width by byte planes, compressed."""
    a = np.ascontiguousarray(values)
    planes = a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() if len(a) else b""
    return struct.pack("<QB", len(a), a.itemsize) + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    n, width = struct.unpack_from("<QB", raw)
    if not n:
        return np.empty(0, kind)
    planes = pa.Codec("zstd").decompress(raw[9:], n * width, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, n).T).view(kind).ravel()


def good_turing(n: list[float], k: int) -> list[float] | None:
    """Katz's discounts of the counts 1 to k; None if one is improper. n[r]: how many types were seen r times."""
    if not all(x > 0 for x in n[1 : k + 2]):
        return None
    common = (k + 1) * n[k + 1] / n[1]
    if common >= 1:
        return None
    d = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, k + 1)]
    return d if all(0 < x < 1 for x in d) else None


def smoothed(n: list[float]) -> list[float] | None:
    """n[r] on the least-squares line through (log r, log n[r]) of the counts that occur; None for fewer than two."""
    held = [r for r in range(1, len(n)) if n[r] > 0]
    if len(held) < 2:
        return None
    slope, at_one = np.polyfit(np.log(held), np.log([n[r] for r in held]), 1)
    return [0.0, *(float(np.exp(at_one + slope * np.log(r))) for r in range(1, len(n)))]


@dataclass(frozen=True)
class Discounts:
    """d[r] for r up to K, 1 beyond. source: good-turing, smoothed (Good-Turing from smoothed counts) or half; k: its K."""

    d: tuple[float, ...]
    source: str = "good-turing"
    k: int = K

    @classmethod
    def of(cls, n: list[int]) -> Discounts:
        """n[r]: how many types were seen r times, r from 0 to K + 1."""
        for k in range(K, 1, -1):
            if d := good_turing(n, k):
                return cls((1.0, *d, *[1.0] * (K - k)), "good-turing", k)
        even = smoothed(n)
        if even and (d := good_turing(even, K)):
            return cls((1.0, *d), "smoothed", K)
        return cls((1.0, *(1 - 0.5 / r for r in range(1, K + 1))), "half", K)

    def times(self, r: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        return r * np.where(r <= K, np.array(self.d)[np.minimum(r, K)], 1.0)


@dataclass(frozen=True)
class Unigrams:
    """N, V and the probabilities of words by their count."""

    tokens: int
    types: int
    discounts: Discounts
    unseen: float  # the mass of the class of unseen words

    @classmethod
    def of(cls, tokens: int, types: int, n: list[int]) -> Unigrams:
        discounts = Discounts.of(n)
        lost = sum(r * n[r] * (1 - discounts.d[r]) for r in range(1, K + 1))
        if not tokens:
            return cls(0, 0, discounts, 1.0)
        # Without any small count, one more token stands for what is unseen.
        return cls(tokens, types, discounts, lost / tokens if lost > 0 else 1 / (tokens + 1))

    def p(self, c: np.ndarray) -> np.ndarray:
        total = self.tokens if any(x < 1 for x in self.discounts.d[1:]) and self.unseen != 1 / (self.tokens + 1) else self.tokens + 1
        return np.where(c > 0, self.discounts.times(c) / max(1, total), self.unseen)

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 1.0) / (self.tokens + 1 * (self.types + 1)))


BLOCKS = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held_out", pa.list_(pa.bool_())), ("length", pa.binary()), ("tokens", pa.binary()), ("words", pa.binary())])
BLOCK_DDL = "block long, doc_id array<long>, held_out array<boolean>, length binary, tokens binary, words binary"
SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("body", pa.list_(pa.binary()))])
SENT_DDL = "bucket int, block long, body array<binary>"
#: kind: model, reply, stats, hot.
GIVEN = pa.schema([("kind", pa.string()), ("bucket", pa.int32()), ("block", pa.int64()), ("body", pa.list_(pa.binary())), ("numbers", pa.list_(pa.float64()))])
GIVEN_DDL = "kind string, bucket int, block long, body array<binary>, numbers array<double>"


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, held_out, text; each block has its own vocabulary, numbered as words come."""
    part, nth = TaskContext.get().partitionId() << 32, 0

    def fresh():
        return defaultdict(count().__next__), [], [], [], [], 0

    def closed() -> pa.RecordBatch:
        hashes = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
        tokens = packed(np.concatenate(found).astype(np.uint32))
        return rows(BLOCKS, block=[part + nth], doc_id=[ids], held_out=[held], length=[packed(np.array(length, np.uint32))], tokens=[tokens], words=[hashes.tobytes()])

    words, ids, held, length, found, size = fresh()
    for batch in chunks(batches):
        for doc, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch), strict=True):
            split = text.lower().split()
            split.append(END)
            found.append(np.array([words[w] for w in split], np.uint32))
            ids.append(doc)
            held.append(out)
            length.append(len(split))
            size += len(split)
            if size >= BLOCK_TOKENS:
                yield closed()
                nth += 1
                words, ids, held, length, found, size = fresh()
    if ids:
        yield closed()


def slices(bucket: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    """The slices of a sorted array of buckets."""
    at = np.searchsorted(bucket, np.arange(n + 1))
    return ((b, slice(at[b], at[b + 1])) for b in range(n) if at[b] < at[b + 1])


class Block:
    """A block's arrays. Words are numbered by rank of their hash; the begin mark comes last."""

    def __init__(self, row: dict):
        self.block, self.ids, self.held = row["block"], row["doc_id"], np.array(row["held_out"], bool)
        self.length = unpacked(row["length"], "<u4").astype(np.int64)
        hashes = np.frombuffer(row["words"], np.uint64)
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.hashes = hashes[order]
        self.tokens = rank[unpacked(row["tokens"], "<u4")]
        self.train = np.repeat(~self.held, self.length)
        self.n = len(order)

    def word_bucket(self, buckets: int) -> np.ndarray:
        """Equal ranges of the hash."""
        return ((self.hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)

    def ask_words(self, buckets: int) -> Iterator[pa.RecordBatch]:
        counts = np.bincount(self.tokens[self.train], minlength=self.n).astype(np.uint32)
        for b, s in slices(self.word_bucket(buckets), buckets):
            yield rows(SENT, bucket=[b], block=[self.block], body=[[self.hashes[s].tobytes(), packed(counts[s])]])

    def take_words(self, replies: list[dict], starts: np.ndarray, total: int, docs: int) -> None:
        """Global numbers and training counts of the words, from the replies by bucket."""
        number, counts = [], []
        for r in sorted(replies, key=lambda r: r["bucket"]):
            number.append(unpacked(r["body"][0], "<u4").astype(np.int64) + starts[r["bucket"]])
            counts.append(unpacked(r["body"][1], "<u8").astype(np.int64))
        # The begin mark: numbered after all words, seen once a training document.
        self.number = np.concatenate([*number, [total]])
        self.count = np.concatenate([*counts, [docs]])

    def take_pairs(self) -> None:
        """Distinct (context, word) in order, the pair of each token, and training counts."""
        before = np.concatenate([[self.n], self.tokens[:-1]])
        before[np.cumsum(self.length)[:-1]] = self.n
        width = self.n + 1
        pairs, self.pair_of = np.unique(before * width + self.tokens, return_inverse=True)
        self.context, self.word = pairs // width, pairs % width
        self.pair_count = np.bincount(self.pair_of[self.train], minlength=len(pairs)).astype(np.uint32)

    def questions(self, buckets: int, total: int, hot: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, pairs asked for, contexts asked for), as indices; only what training can have seen.

        Contexts seen more than ``hot`` times are dealt by their second word, and not asked for.
        """
        span = total + 1
        of = lambda ranks: self.number[ranks] * buckets // span
        frequent = self.count > hot
        asked = np.flatnonzero((self.count[self.context] > 0) & (self.count[self.word] > 0))
        bucket = of(np.where(frequent[self.context[asked]], self.word[asked], self.context[asked]))
        order = np.argsort(bucket, kind="stable")
        asked, bucket = asked[order], bucket[order]
        contexts = np.unique(self.context)
        contexts = contexts[(self.count[contexts] > 0) & ~frequent[contexts]]
        at, edges = np.searchsorted(bucket, np.arange(buckets + 1)), np.searchsorted(of(contexts), np.arange(buckets + 1))
        for b in range(buckets):
            if at[b] < at[b + 1] or edges[b] < edges[b + 1]:
                yield b, asked[at[b] : at[b + 1]], contexts[edges[b] : edges[b + 1]]


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows sorted by bucket, a bucket at a time."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now and held:
                yield now, held
                held = []
            now = row["bucket"]
            held.append(row)
    if held:
        yield now, held


def given(kind: str, bucket: int, block: int | None = None, body: list[bytes] = (), numbers: list[float] = ()) -> pa.RecordBatch:
    return rows(GIVEN, kind=[kind], bucket=[bucket], block=[block], body=[list(body)], numbers=[list(numbers)])


def of_counts(c: np.ndarray) -> list[float]:
    return np.bincount(np.minimum(c, K + 2), minlength=K + 3)[: K + 2].astype(float).tolist()


def sum_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, sent in by_bucket(batches):
        hashes = [np.frombuffer(r["body"][0], np.uint64) for r in sent]
        keys, where = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(where, np.concatenate([unpacked(r["body"][1], "<u4") for r in sent])).astype(np.uint64)
        at = 0
        for r, h in zip(sent, hashes, strict=True):
            mine = where[at : at + len(h)]
            at += len(h)
            yield given("reply", bucket, r["block"], [packed(mine.astype(np.uint32)), packed(total[mine])])
        yield given("model", bucket, None, [keys.tobytes(), packed(total)])
        seen = total[total > 0].astype(np.int64)
        yield given("stats", bucket, None, [], [len(keys), len(seen), float(seen.sum()), *of_counts(seen)])


def sum_pairs(unigrams: Unigrams, hot: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, sent in by_bucket(batches):
            v, w, c, cw, cv = ([unpacked(r["body"][k], kind) for r in sent] for k, kind in ((0, "<i8"), (1, "<i8"), (2, "<u4"), (3, "<u8"), (4, "<u8")))
            asked = [unpacked(r["body"][5], "<i8") for r in sent]
            sizes = [len(x) for x in v]
            v, w, c, cw, cv = (np.concatenate(x) for x in (v, w, c, cw, cv))
            order = np.lexsort((w, v))
            new = np.ones(len(v), bool)
            new[1:] = (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1])
            where = np.empty(len(v), np.int64)
            where[order] = np.cumsum(new) - 1
            first = order[new]
            total = np.bincount(where, c, int(new.sum())).astype(np.int64)
            v, w, cw, cv = v[first], w[first], cw[first].astype(np.int64), cv[first].astype(np.int64)
            seen = total > 0
            # By context: how many words were seen 1 to K times after it, and the sum of their P1.
            contexts, at = np.unique(v, return_inverse=True)
            sums = np.stack([np.bincount(at, seen & (total == r), len(contexts)) for r in range(1, K + 1)] + [np.bincount(at, np.where(seen, unigrams.p(cw), 0.0), len(contexts))], 1)
            done = 0
            for r, n, mine in zip(sent, sizes, asked, strict=True):
                k = np.minimum(np.searchsorted(contexts, mine), max(0, len(contexts) - 1))
                found = np.where((contexts[k] == mine)[:, None], sums[k], 0.0) if len(contexts) else np.zeros((len(mine), K + 1))
                yield given("reply", bucket, r["block"], [packed(total[where[done : done + n]].astype(np.uint32)), *(packed(found[:, j].astype(np.uint32)) for j in range(K)), packed(found[:, K])])
                done += n
            _, often = np.unique(v[seen], return_counts=True)
            yield given("model", bucket, None, [packed(v[seen][np.cumsum(often) - 1] if len(often) else v[:0]), packed(often.astype(np.uint32)), packed(w[seen]), packed(total[seen].astype(np.uint32))])
            yield given("stats", bucket, None, [], of_counts(total[seen]))
            which = np.zeros(len(contexts), bool)
            which[at[cv > hot]] = True
            for j in np.flatnonzero(which):
                yield given("hot", bucket, int(contexts[j]), [], sums[j].tolist())

    return run


@dataclass
class Model:
    """What is known of a model beside its tables; path: their folder."""

    path: str
    unigrams: Unigrams
    bigrams: Discounts
    starts: np.ndarray
    total: int
    docs: int
    hot: float
    frequent: dict[int, list[float]]
    buckets: int


def backoff(c_v: np.ndarray, sums: np.ndarray, discounts: Discounts) -> tuple[np.ndarray, np.ndarray]:
    """(denominator, a) of contexts seen c_v times; sums: how many words were seen 1 to K times, and their P1."""
    few = sums[:, :K]
    lost = (few * [r * (1 - discounts.d[r]) for r in range(1, K + 1)]).sum(1)
    none = lost <= 0
    under = c_v + none
    left = np.where(none, 1.0, lost) / np.maximum(1, under)
    return under, left / (1 - sums[:, K])


def score_block(b: Block, replies: list[dict], m: Model) -> pa.RecordBatch:
    total = np.zeros(len(b.context), np.int64)
    sums = np.zeros((b.n + 1, K + 1))
    found = {r["bucket"]: r["body"] for r in replies}
    for bucket, asked, contexts in b.questions(m.buckets, m.total, m.hot):
        body = found[bucket]
        total[asked] = unpacked(body[0], "<u4")
        for j in range(K):
            sums[contexts, j] = unpacked(body[1 + j], "<u4")
        sums[contexts, K] = unpacked(body[1 + K], "<f8")
    for rank in np.flatnonzero(b.count > m.hot):
        sums[rank] = m.frequent.get(int(b.number[rank]), [0.0] * (K + 1))
    under, a = backoff(b.count, sums, m.bigrams)
    lower = m.unigrams.p(b.count[b.word])
    # The recursion: the pair's own estimate, or else the context's share of the word's.
    context = b.context
    p = np.where(total > 0, m.bigrams.times(total) / np.maximum(1, under[context]), np.where(b.count[context] > 0, a[context], 1.0) * lower)
    starts = np.cumsum(b.length) - b.length
    by_doc = lambda x: np.add.reduceat(x, starts)
    words = b.count[b.tokens]
    return rows(SCORES, doc_id=b.ids, held_out=b.held, n_tokens=b.length, n_known=by_doc((words > 0).astype(np.int64)), train_tokens=np.full(len(b.ids), m.unigrams.tokens), base_score=by_doc(m.unigrams.base(words)), score=by_doc(np.log10(p)[b.pair_of]))


SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORES_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _replies(df: DataFrame, name: str) -> DataFrame:
    """A row per block with all its replies: one for each bucket at most."""
    return df.where("kind = 'reply'").groupBy("block").agg(F.collect_list(F.struct("bucket", "body")).alias(name))


def train_and_score(docs: DataFrame, folds: int = 7, held: int = 2, path: str | None = None) -> DataFrame:
    """Scores of all documents by the model of those whose fold is not ``held``. path: where the tables go."""
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    path = path or shared_folder(spark, "katz")
    out = F.coalesce(fold(F.col("doc_id"), folds) == held, F.lit(False))

    def save(df: DataFrame, name: str, *by: str) -> DataFrame:
        df.write.partitionBy(*by).option("compression", "zstd").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), text_of().alias("text"))
    blocks = save(plain.mapInArrow(block_rows, BLOCK_DDL), "blocks")

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from Block(row).ask_words(n)

    sent = blocks.mapInArrow(ask_words, SENT_DDL).repartition(n, "bucket").sortWithinPartitions("bucket")
    words = save(sent.mapInArrow(sum_words, GIVEN_DDL), "unigrams", "kind")
    stats = words.where("kind = 'stats'").select("bucket", "numbers").toPandas()
    if not len(stats):
        return spark.createDataFrame([], SCORES_DDL)
    keys = np.zeros(n + 1)
    keys[stats["bucket"].to_numpy() + 1] = [x[0] for x in stats["numbers"]]
    sums = np.sum(np.stack(stats["numbers"]), 0)
    starts, total = np.cumsum(keys).astype(np.int64), int(sums[0])
    unigrams = Unigrams.of(int(sums[2]), int(sums[1]), [int(x) for x in sums[3:]])
    n_docs = docs.where(~out).count()
    hot = unigrams.tokens / (8 * n)

    def ready(row: dict) -> Block:
        b = Block(row)
        b.take_words(row["words_known"], starts, total, n_docs)
        b.take_pairs()
        return b

    def ask_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = ready(batch.slice(i, 1).to_pylist()[0])
                for bucket, asked, contexts in b.questions(n, total, hot):
                    v, w = b.context[asked], b.word[asked]
                    body = [packed(x) for x in (b.number[v], b.number[w], b.pair_count[asked], b.count[w].astype(np.uint64), b.count[v].astype(np.uint64), b.number[contexts])]
                    yield rows(SENT, bucket=[bucket], block=[b.block], body=[body])

    known = blocks.join(_replies(words, "words_known"), "block")
    sent = known.mapInArrow(ask_pairs, SENT_DDL).repartition(n, "bucket").sortWithinPartitions("bucket")
    pairs = save(sent.mapInArrow(sum_pairs(unigrams, hot), GIVEN_DDL), "bigrams", "kind")
    stats = pairs.where("kind = 'stats'").select("numbers").toPandas()
    counts = np.sum(np.stack(stats["numbers"]), 0) if len(stats) else np.zeros(K + 2)
    # At most 8 n contexts are that frequent; each has a row for each bucket it was dealt to, summed before it comes.
    summed = [F.sum(F.col("numbers")[j]).alias(f"s{j}") for j in range(K + 1)]
    frequent = {r[0]: [float(x) for x in r[1:]] for r in pairs.where("kind = 'hot'").groupBy("block").agg(*summed).collect()}
    model = Model(path, unigrams, Discounts.of([int(x) for x in counts]), starts, total, n_docs, hot, frequent, n)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield score_block(ready(row), row["pairs_known"] or [], model)

    return known.join(_replies(pairs, "pairs_known"), "block", "left").mapInArrow(score, SCORES_DDL)
