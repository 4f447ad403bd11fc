"""Removal of long repeated passages by run-length compressed Burrows-Wheeler indexes.

A byte goes if a string of SPAN bytes covers it that also starts in a document
with a smaller id. Texts that equal a whole text with a smaller id are told by their
SHA-256 first: such a copy of SPAN bytes or more goes entirely, and since the smaller
text has all of its strings, no other text needs its anchors. A class of copies is
so worked on once, however large. Which strings of the rest repeat is found in
three steps:

1. Anchors. Of the GRAM-byte hashes in a string, the least marks an anchor; equal
   strings have equal anchors at equal places. Blocks of documents ask, bucket by
   bucket, which of their anchors occur in more than one document, and how often.
2. Index. The surroundings of each such anchor - as far as a string with the anchor
   in it can reach, and only as far as those reach whose least gram it is - go to the
   task that owns the anchor's hash, equal ones of a block once, with the smallest id
   that has them. They are most of what is shuffled, so they go in WAVES by their keys,
   and a wave's shuffle is deleted before the next one. The distinct surroundings of an
   anchor - those that share enough bytes in place with another to share a string -
   are put in order of their smallest ids and halved, the halves again, and so
   on; of each two halves the one with the smaller ids is indexed and the other one
   streamed through the index. Level by level, the task builds the Burrows-Wheeler
   transform of many anchors' left halves (from a full suffix array, and with the
   rows beside it for comparisons: only the transform is run-compressed): suffixes
   sorted by prefix doubling, the transform cut into runs, and for each run its
   first row, where that row goes when its character is put in front, and the text
   positions at its two ends. Rows that share SPAN characters form a class, and each
   class knows the smallest id among its rows. Then the right halves are streamed
   through the index from right to left, from the empty match on, and their
   matching statistics kept: where the run's character is the next one, the match
   grows; where it isn't, the match goes on from the end of the nearest run of that
   character above or below, the one whose sampled text position has more in common
   with what was matched. Each place where a match is SPAN long or longer answers
   with the smallest id of the matched row's class.
3. Marks. Each block gets the answers in the order of its question, marks the strings
   whose smallest id is below the document's own and writes what is left.

Repetitive corpora have few distinct surroundings, and nothing is sent or indexed
once per copy: a passage in a third of all documents is a row a block. An anchor of
such a passage's edge has other surroundings in each document; so anchors that
occur more than HOT times are split: each NARROW of a string's possible offsets have
SPAN - NARROW + 1 bytes in common, the hash of those is the key of a window that
holds just these strings, and the windows are dealt by it. All strings of a window
stay together, and most of what differs between documents is outside of it.

Answers come from comparing bytes, hashes only bring candidates together. Null
texts are empty; a null id counts as larger than all others. Repeated ids don't
remove each other; rows of an empty table give none.
"""

from __future__ import annotations

import copy
import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.llm.common import bucketed, chunks, partitions, rows, setting, text_of, texts, written
from panelkiln.llm.katz import SENT, SENT_DDL, by_bucket, packed, slices, unpacked

SPAN, GRAM = 50, 16
REACH = SPAN - GRAM  # bytes on either side of an anchor
WIDE = GRAM + 2 * REACH
BLOCK_BYTES = 4 << 20
#: Distinct surroundings of one index; with their WIDE + 1 suffixes each they are some 2^18 rows, small enough for caches.
INDEX = 4_000
#: Occurrences beyond which an anchor is split, and the offsets of strings that go together then.
HOT, NARROW = 6_000, 5
#: Bits of an anchor's hash.
BITS = 40
#: Rounds in which surroundings are asked for: the shuffle of one is on disk at a time, and each reads the blocks again.
WAVES = 2
NEVER = np.iinfo(np.int64).max
#: Bytes that no UTF-8 text has.
OUTSIDE = 0xFF
FACTOR = 0x9E3779B97F4A7C15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(FACTOR, n, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) | np.uint64(1)


def gram_hashes(a: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place, by doubling."""
    h, n = a.astype(np.uint64) + np.uint64(1), 1
    while n < GRAM:
        h = h[:-n] * _power(n) + h[n:]
        n *= 2
    return _mixed(h)


def _sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over each ``width`` values in a row."""
    n = 1
    while 2 * n <= width:
        x = pick(x[:-n], x[n:])
        n *= 2
    return pick(x[: len(x) - (width - n)], x[width - n :]) if width > n else x


def anchors(a: np.ndarray, ends: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Places whose hash is the least of some SPAN bytes within a document. ends: of the documents in ``a``."""
    n, width = len(a), REACH + 1
    if n < SPAN:
        return np.empty(0, np.int64)
    whole = np.zeros(n, bool)  # a string starts here that ends in the same document
    starts = np.concatenate([[0], ends[:-1]])
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        whole[s : max(s, e - SPAN + 1)] = True
    out = []
    for s in range(0, n, step):
        low, high = max(0, s - REACH), min(n, s + step + REACH + GRAM)
        if high - low < SPAN:
            low = max(0, high - SPAN)
        h = gram_hashes(a[low:high])
        least = _sliding(h, width, np.minimum)
        least = np.where(whole[low : low + len(least)], least, np.uint64(0))
        pad = np.zeros(REACH, np.uint64)
        most = _sliding(np.concatenate([pad, least, pad]), width, np.maximum)[: len(h)]
        at = np.flatnonzero(h[: len(most)] == most) + low
        out.append(at[(at >= s) & (at < s + step)])
    return np.concatenate(out)


def _grams(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What ``gram_hashes`` mixes, at some places."""
    h = np.zeros(len(at), np.uint64)
    for k in range(GRAM):
        h = h * np.uint64(FACTOR) + (a[at + k].astype(np.uint64) + np.uint64(1))
    return h


def anchor_keys(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """BITS of another hash of the anchors: the one that chose them is small for all."""
    return _key(_grams(a, at))


def owned(at: np.ndarray, doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) offset, from REACH bytes before the anchor on, of the strings of which each anchor is the least.

    at: all anchors of the documents, in order; h: the hashes that chose them. The least gram of a string that holds an
    anchor is an anchor too, so an anchor's strings end before the next smaller anchor on either side. Which gram is a string's
    least depends on its bytes alone: wherever a string stands it is asked for by the same anchors, so the others needn't.
    """
    first, last = np.zeros(len(at), np.int64), np.full(len(at), REACH)
    for out, way in ((first, -1), (last, 1)):
        here, k = np.arange(len(at)), 0
        while len(here):
            k += 1
            here = here[(here + way * k >= 0) & (here + way * k < len(at))]
            there = here + way * k
            # Anchors up to REACH away in the same document; those that met a smaller one are done.
            near = (np.abs(at[there] - at[here]) <= REACH) & (doc[there] == doc[here])
            here, there = here[near], there[near]
            less = h[there] < h[here]
            gap = (at[there] - at[here])[less]
            out[here[less]] = REACH + gap + 1 if way < 0 else gap - 1
            here = here[~less]
    return first, last


def _key(h: np.ndarray) -> np.ndarray:
    return (_mixed(_mixed(h) * np.uint64(FACTOR)) >> np.uint64(64 - BITS)).astype(np.int64)


BLOCKS = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("length", pa.binary()), ("text", pa.binary()), ("digests", pa.binary()), ("anchors", pa.binary())])
BLOCKS_DDL = "block long, doc_id array<long>, length binary, text binary, digests binary, anchors binary"
REPLY = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("body", pa.list_(pa.binary()))])
REPLY_DDL = "block long, bucket int, body array<binary>"


def block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, nth, ids, held, size = TaskContext.get().partitionId() << 32, 0, [], [], 0

    def closed() -> pa.RecordBatch:
        a = np.frombuffer(b"".join(held), np.uint8)
        length = np.array(list(map(len, held)), np.uint32)
        at = anchors(a, np.cumsum(length, dtype=np.int64))
        digests = b"".join(hashlib.sha256(t).digest() for t in held)
        return rows(BLOCKS, block=[part + nth], doc_id=[ids], length=[packed(length)], text=[a.tobytes()], digests=[digests], anchors=[packed(np.diff(at, prepend=0).astype(np.uint32))])

    for batch in chunks(batches, BLOCK_BYTES):
        for doc, text in zip(batch.column(0).to_pylist(), texts(batch), strict=True):
            ids.append(doc)
            held.append(text)
            size += len(text)
            if size >= BLOCK_BYTES:
                yield closed()
                nth, ids, held, size = nth + 1, [], [], 0
    if ids:
        yield closed()


class Digests:
    """The texts' digests of a block in order, and which of the block's texts each is."""

    def __init__(self, row: dict):
        self.block = row["block"]
        self.ids = np.array([NEVER if d is None else d for d in row["doc_id"]], np.int64)
        digests = np.frombuffer(row["digests"], "S32") if row["digests"] else np.zeros(0, "S32")
        self.order = np.argsort(digests, kind="stable")
        self.digests = digests[self.order]
        self.keys = np.array([int.from_bytes(row["digests"][32 * i : 32 * i + BITS // 8], "big") for i in self.order.tolist()], np.int64)

    def ask(self, buckets: int) -> Iterator[pa.RecordBatch]:
        for b, s in slices(self.keys * buckets >> BITS, buckets):
            yield rows(SENT, bucket=[b], block=[self.block], body=[[self.digests[s].tobytes(), packed(self.ids[self.order[s]])]])

    def copies(self, replies: list[dict], buckets: int) -> np.ndarray:
        """Whether each text equals one with a smaller id."""
        found, out = {r["bucket"]: r["body"] for r in replies}, np.zeros(len(self.ids), bool)
        for b, s in slices(self.keys * buckets >> BITS, buckets):
            out[self.order[s]] = np.unpackbits(np.frombuffer(found[b][0], np.uint8), count=s.stop - s.start).astype(bool)
        return out


def answer_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, sent in by_bucket(batches):
        ids = [unpacked(r["body"][1], "<i8") for r in sent]
        own = np.concatenate(ids)
        distinct_, which = np.unique(np.concatenate([np.frombuffer(r["body"][0], "S32") for r in sent]), return_inverse=True)
        least = np.full(len(distinct_), NEVER)
        np.minimum.at(least, which, own)
        again, at = least[which] < own, 0
        for r, k in zip(sent, ids, strict=True):
            yield rows(REPLY, block=[r["block"]], bucket=[bucket], body=[[np.packbits(again[at : at + len(k)]).tobytes()]])
            at += len(k)


class Block:
    """A block's texts; ``copy``: those that equal a text with a smaller id, which ask nothing."""

    def __init__(self, row: dict, copy: np.ndarray | None = None):
        self.block, self.doc_ids = row["block"], row["doc_id"]
        self.copy = np.zeros(len(self.doc_ids), bool) if copy is None else copy
        self.ids = np.array([NEVER if d is None else d for d in row["doc_id"]], np.int64)
        self.length = unpacked(row["length"], "<u4").astype(np.int64)
        self.ends = np.cumsum(self.length)
        self.text = np.frombuffer(row["text"], np.uint8)
        at = np.cumsum(unpacked(row["anchors"], "<u4").astype(np.int64))
        at = at[~self.copy[np.searchsorted(self.ends, at, side="right")]]
        grams, doc = _grams(self.text, at), np.searchsorted(self.ends, at, side="right")
        keys = _key(grams)
        order = np.argsort(keys, kind="stable")
        self.at, self.keys, self.doc = at[order], keys[order], doc[order]
        self.first, self.last = (x[order].astype(np.int8) for x in owned(at, doc, _mixed(grams)))

    def distinct_keys(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys, whether several documents of the block have one, and how often it occurs, 255 at most."""
        new = np.concatenate([[True], self.keys[1:] != self.keys[:-1]]) if len(self.keys) else np.zeros(0, bool)
        first = np.flatnonzero(new)
        if not len(first):
            return self.keys, new, np.zeros(0, np.uint8)
        ids = self.ids[self.doc]
        often = np.minimum(np.diff(np.append(first, len(new))), 255).astype(np.uint8)
        return self.keys[first], np.minimum.reduceat(ids, first) < np.maximum.reduceat(ids, first), often

    def ask_keys(self, buckets: int) -> Iterator[pa.RecordBatch]:
        keys, several, often = self.distinct_keys()
        for b, s in slices(keys * buckets >> BITS, buckets):
            yield rows(SENT, bucket=[b], block=[self.block], body=[[packed(np.diff(keys[s], prepend=0)), np.packbits(several[s]).tobytes(), packed(often[s])]])

    def keep_repeated(self, replies: list[dict], buckets: int) -> None:
        """Drops the anchors that one document alone has, from the replies by bucket, and notes the hot ones."""
        keys, _, _ = self.distinct_keys()
        found = {r["bucket"]: r["body"] for r in replies}
        again, hot = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        for b, s in slices(keys * buckets >> BITS, buckets):
            for out, raw in zip((again, hot), found[b], strict=True):
                out[s] = np.unpackbits(np.frombuffer(raw, np.uint8), count=s.stop - s.start).astype(bool)
        which = np.searchsorted(keys, self.keys)
        keep = again[which] if len(keys) else np.zeros(0, bool)
        self.hot = hot[which][keep] if len(keys) else np.zeros(0, bool)
        self.at, self.keys, self.doc, self.first, self.last = (x[keep] for x in (self.at, self.keys, self.doc, self.first, self.last))

    def wave(self, w: int) -> Block:
        """The block with the anchors of one of the WAVES alone. Equal anchors are in one, whatever windows they are split into."""
        out, mine = copy.copy(self), self.keys % WAVES == w
        out.at, out.keys, out.doc, out.first, out.last, out.hot = (x[mine] for x in (self.at, self.keys, self.doc, self.first, self.last, self.hot))
        return out

    def surroundings(self) -> None:
        """Distinct surroundings of the anchors in order of key, as far as their own strings reach, the one of each anchor, and their smallest ids.

        A hot anchor becomes one for each of its windows.
        """
        parts = (REACH + 1) // NARROW
        times = np.where(self.hot, parts, 1)
        part = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        part[~np.repeat(self.hot, times)] = -1
        self.at, self.keys, self.doc, self.first, self.last = (np.repeat(x, times) for x in (self.at, self.keys, self.doc, self.first, self.last))
        starts = self.ends - self.length
        self.around = np.empty((len(self.at), WIDE), np.uint8)
        for i in range(0, len(self.at), 1 << 16):
            s = slice(i, i + (1 << 16))
            at, doc = self.at[s], self.doc[s]
            place = at[:, None] + np.arange(-REACH, GRAM + REACH)
            low, high = np.maximum(starts[doc], at - REACH + self.first[s]), np.minimum(self.ends[doc], at - REACH + self.last[s] + SPAN)
            inside = (place >= low[:, None]) & (place < high[:, None])
            self.around[s] = np.where(inside, self.text[np.clip(place, 0, max(0, len(self.text) - 1))], OUTSIDE)
        keep = np.ones(len(self.at), bool)
        for k in range(parts):
            mine = np.flatnonzero(part == k)
            if not len(mine):
                continue
            held, low = self.around[mine], k * NARROW
            held[:, :low] = OUTSIDE
            held[:, low + SPAN + NARROW - 1 :] = OUTSIDE
            shared = held[:, low + NARROW - 1 : low + SPAN]
            keep[mine] = ~(shared == OUTSIDE).any(1)
            h = np.zeros(len(mine), np.uint64)
            for j in range(shared.shape[1]):
                h = h * np.uint64(FACTOR) + (shared[:, j].astype(np.uint64) + np.uint64(1))
            self.around[mine], self.keys[mine] = held, _key(h)
        self.at, self.keys, self.doc, self.around = self.at[keep], self.keys[keep], self.doc[keep], self.around[keep]
        first, self.which = distinct(self.around, self.keys)
        self.around, self.keys = self.around[first], self.keys[first]
        self.least = np.full(len(first), NEVER)
        np.minimum.at(self.least, self.which, self.ids[self.doc])

    def ask_surroundings(self, buckets: int) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for b, s in slices(self.keys * buckets >> BITS, buckets):
            body = [codec.compress(self.around[s].tobytes(), asbytes=True), packed(np.diff(self.keys[s], prepend=0)), packed(self.least[s])]
            yield rows(SENT, bucket=[b], block=[self.block], body=[body])

    def marks(self, replies: list[dict], buckets: int) -> np.ndarray:
        """Whether each byte goes."""
        found = {r["bucket"]: r["body"] for r in replies}
        n, count, offset, least = len(self.text), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for b, _ in slices(self.keys * buckets >> BITS, buckets):
            for out, raw, kind in zip((count, offset, least), found[b], ("u1", "u1", "<i8"), strict=True):
                out.append(unpacked(raw, kind).astype(np.int64))
        count, offset, least = np.concatenate(count), np.concatenate(offset), np.concatenate(least)
        # A surrounding has runs of offsets with one smallest id; each ends where the next begins.
        last = np.concatenate([offset[1:] - 1, [REACH]]) if len(offset) else offset
        begin = np.cumsum(count) - count
        if len(count):
            last[begin + count - 1] = REACH
        change = np.zeros(n + 1, np.int64)
        for i in range(0, len(self.at), 1 << 18):
            which, at, own = self.which[i : i + (1 << 18)], self.at[i : i + (1 << 18)], self.ids[self.doc[i : i + (1 << 18)]]
            k = count[which]
            run = np.repeat(begin[which], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            smaller = least[run] < np.repeat(own, k)
            base = np.repeat(at, k)[smaller] - REACH
            change += np.bincount(base + offset[run[smaller]], minlength=n + 1)
            change -= np.bincount(base + last[run[smaller]] + SPAN, minlength=n + 1)
        return (np.cumsum(change[:n]) > 0) | np.repeat(self.copy & (self.length >= SPAN), self.length)


def distinct(around: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first rows of the distinct rows in order of key, which of them each row is). Hashes group, bytes decide."""
    h = keys.astype(np.uint64)
    for k in range(around.shape[1]):
        h = h * np.uint64(FACTOR) + around[:, k]
    h = _mixed(h)
    order = np.lexsort((h, keys))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]) | (h[order][1:] != h[order][:-1])
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]
    for i in range(0, len(which), 1 << 16):
        if not np.array_equal(around[i : i + (1 << 16)], around[first[which[i : i + (1 << 16)]]]):
            # Two rows of one key share a 64-bit hash: sort the bytes themselves.
            plain = np.concatenate([keys.astype(">i8").view(np.uint8).reshape(-1, 8), around], 1)
            _, first, which = np.unique(plain, axis=0, return_index=True, return_inverse=True)
            return first, which.ravel()
    return first, which


def ranked(keys: np.ndarray, width: int, want: bool = True) -> tuple[np.ndarray | None, np.ndarray]:
    """(dense ranks from 1 if wanted, order) of keys of ``width`` bits, equal ones in the order of their places.

    Where key and place fit one word, words are sorted: no indirection.
    """
    flat = keys.ravel()
    bits = np.uint64(int(flat.size).bit_length())
    if width + int(bits) <= 64:
        words = np.sort(flat << bits | np.arange(flat.size, dtype=np.uint64))
        order, held = (words & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), words >> bits
    else:
        order = np.argsort(flat, kind="stable")
        held = flat[order]
    if not want:
        return None, order
    new = np.ones(len(held), bool)
    new[1:] = held[1:] != held[:-1]
    out = np.empty(len(held), np.int64)
    out[order] = np.cumsum(new)
    return out.reshape(keys.shape), order


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of all suffixes in order, whether each shares SPAN symbols with the one before) of rows of symbols that end in 0.

    End marks are told apart by their row, so equal suffixes stand in the order of rows. Prefix doubling; the first
    sort takes as many symbols as fit a word beside the place.
    """
    n, m = symbols.shape
    each, place_bits = max(1, int(symbols.max(initial=1)).bit_length()), int(n * m).bit_length()
    h = max(1, min(m, (64 - place_bits) // each))
    wide = np.zeros((n, m + h), np.uint64)
    wide[:, :m] = symbols
    key = np.zeros((n, m), np.uint64)
    for k in range(h):
        key = key << np.uint64(each) | wide[:, k : k + m]
    rank, order = ranked(key, h * each)
    held, at = rank, h
    while h < m:
        # What lies beyond a row's end is 0.
        after = np.zeros_like(rank)
        after[:, :-h] = rank[:, h:]
        rank, order = ranked(rank.astype(np.uint64) << np.uint64(place_bits) | after.astype(np.uint64), 2 * place_bits, 2 * h < m)
        h *= 2
        if h <= SPAN:
            held, at = rank, h
    inner = order % m <= REACH
    same = np.zeros(len(order), bool)
    pairs = np.flatnonzero(inner[1:] & inner[:-1])
    a, b, flat = order[pairs], order[pairs + 1], held.ravel()
    step = 0
    equal = np.ones(len(pairs), bool)
    while step < SPAN:
        # Prefixes of ``at`` symbols, the last one overlapping.
        k = min(step, SPAN - at) if at < SPAN else 0
        equal &= flat[a + k] == flat[b + k]
        step += at
    same[pairs[equal] + 1] = True
    return order, same


class Marked:
    """Bits of which some are set, and how many are set up to a place."""

    def __init__(self, at: np.ndarray, n: int):
        bits = np.zeros(-(-n // 64) * 64, bool)
        bits[at] = True
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        count = np.bitwise_count(self.words).astype(np.int32)
        self.before = np.cumsum(count, dtype=np.int32) - count - 1

    def last(self, place: np.ndarray) -> np.ndarray:
        """The number, from 0, of the last set bit up to a place."""
        word = place >> 6
        return self.before[word] + np.bitwise_count(self.words[word] << (np.uint64(63) - (place & 63).astype(np.uint64)))


class RunIndex:
    """The run-length compressed transform of n rows of WIDE symbols and an end mark each, with random access to the rows.

    runs: the first row of each, heads: its character, ``goes``: where that row goes when its character is put in
    front, ``sample_first`` and ``sample``: the text positions at the run's two ends. Each class of rows with equal SPAN
    symbols has its smallest id. Bits mark the rows where runs and classes begin; their rank finds a row's run and class.
    """

    def __init__(self, around: np.ndarray, ids: np.ndarray):
        n, m = len(around), WIDE + 1
        # Symbols in the order of bytes, 0 being the end mark; bytes that the rows lack are above all.
        used = np.flatnonzero(np.bincount(around.ravel(), minlength=256))
        self.code = np.full(256, 255, np.uint8)
        self.code[used] = np.arange(1, len(used) + 1)
        symbols = np.zeros((n, m), np.uint8)
        symbols[:, :WIDE] = self.code[around]
        self.size = n * m
        self.text = np.concatenate([symbols.ravel(), np.zeros(WIDE, np.uint8)])
        order, same = suffix_order(symbols)
        # The character before each suffix; the end mark before a row's first.
        front = np.where(order % m > 0, self.text[order - 1], 0)
        self.runs = np.flatnonzero(np.concatenate([[True], front[1:] != front[:-1]]))
        self.ends = np.append(self.runs[1:], len(front)) - 1
        self.heads = front[self.runs]
        self.sample_first, self.sample = order[self.runs], order[self.ends]
        sizes = self.ends - self.runs + 1
        # Rows with one front character go, in their order, to the rows that begin with it.
        self.by_head = np.argsort(self.heads, kind="stable")
        before = np.cumsum(sizes[self.by_head]) - sizes[self.by_head]
        self.goes = np.empty(len(self.runs), np.int64)
        self.goes[self.by_head] = before
        self.keys = self.heads[self.by_head].astype(np.int64) * self.size + self.runs[self.by_head]
        self.run_marks = Marked(self.runs, len(front))
        classes = np.flatnonzero(~same)
        self.class_marks = Marked(classes, len(front))
        self.least = np.minimum.reduceat(ids[order // m], classes)

    def shared(self, symbols: np.ndarray, which: np.ndarray, place: int, at: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols from ``place`` on the rows ``which`` have in common with the text from ``at`` on, ``most`` at most."""
        n = int(most.max(initial=0))
        equal = np.zeros((len(at), n + 1), bool)
        # Rows of text of the longest match's length, from each place on.
        windows = np.lib.stride_tricks.sliding_window_view(self.text, n) if n else np.zeros((len(self.text), 0), np.uint8)
        equal[:, :n] = symbols[which, place : place + n] == windows[at]
        return np.minimum(equal.argmin(1), most)

    def stream(self, around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics of rows, from right to left: (smallest id, length) at each place where SPAN bytes can begin.

        length: of the longest match with the indexed rows that begins there; smallest id: of the rows with the same
        SPAN bytes, NEVER for a shorter match. A match doesn't reach outside a document.
        """
        k = len(around)
        symbols = self.code[around]
        outside = around == OUTSIDE
        least, lengths = np.full((k, REACH + 1), NEVER), np.zeros((k, REACH + 1), np.int64)
        # The empty match is with every row: one text begins at the first, the next at the last.
        row, length = np.where(np.arange(k) % 2, self.size - 1, 0), np.zeros(k, np.int64)
        for place in range(WIDE - 1, -1, -1):
            c = symbols[:, place]
            run = self.run_marks.last(row)
            miss = np.flatnonzero(self.heads[run] != c)
            if len(miss):
                self._jump(symbols, place, miss, row, length)
                run[miss] = self.run_marks.last(row[miss])
            row = np.where(length < 0, row, self.goes[run] + row - self.runs[run])
            length += 1
            length[outside[:, place]] = 0
            if place <= REACH:
                long = np.flatnonzero(length >= SPAN)
                lengths[:, place] = length
                least[long, place] = self.least[self.class_marks.last(row[long])]
        return least, lengths

    def _jump(self, symbols: np.ndarray, place: int, miss: np.ndarray, row: np.ndarray, length: np.ndarray) -> None:
        """Moves the rows ``miss`` to the end of a run of their next character, and their lengths to what is shared there; -1 without such a run."""
        c = symbols[miss, place].astype(np.int64)
        here, most = row[miss], length[miss]
        best, to = np.full(len(miss), -1), here.copy()
        after = np.searchsorted(self.keys, c * self.size + here)
        left = np.arange(len(miss))
        for i, rows_, samples in ((after - 1, self.ends, self.sample), (after, self.runs, self.sample_first)):
            near = self.by_head[np.clip(i[left], 0, len(self.keys) - 1)]
            ok = (i[left] >= 0) & (i[left] < len(self.keys)) & (self.heads[near] == c[left])
            near, some = near[ok], left[ok]
            common = self.shared(symbols, miss[some], place + 1, samples[near], most[some])
            better = common > best[some]
            some = some[better]
            best[some], to[some] = common[better], rows_[near[better]]
            # A match that goes on in full can't be bettered.
            left = left[best[left] < most[left]]
        row[miss], length[miss] = to, best


def answer_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for bucket, sent in by_bucket(batches):
        keys = [np.cumsum(unpacked(r["body"][0], "<i8")) for r in sent]
        several = [np.unpackbits(np.frombuffer(r["body"][1], np.uint8), count=len(k)) for r, k in zip(sent, keys, strict=True)]
        often = [unpacked(r["body"][2], "u1") for r in sent]
        _, which = np.unique(np.concatenate(keys), return_inverse=True)
        again = np.bincount(which, 1 + np.concatenate(several)) > 1
        hot = np.bincount(which, np.concatenate(often)) > HOT
        at = 0
        for r, k in zip(sent, keys, strict=True):
            mine = which[at : at + len(k)]
            yield rows(REPLY, block=[r["block"]], bucket=[bucket], body=[[np.packbits(again[mine]).tobytes(), np.packbits(hot[mine]).tobytes()]])
            at += len(k)


def halves(rank: np.ndarray, size: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """(left, right) of the pairs of neighbouring blocks of 2^level rows in each key; rank and size are a row's own in its key."""
    block = rank >> level
    return (block % 2 == 0) & (block + 1 << level < size), block % 2 == 1


def whole_strings(around: np.ndarray) -> np.ndarray:
    """Whether a string starts at each place of the rows, none of it outside."""
    inside = np.concatenate([np.zeros((len(around), 1), np.int64), np.cumsum(around != OUTSIDE, 1)], 1)
    return inside[:, SPAN : SPAN + REACH + 1] - inside[:, : REACH + 1] == SPAN


def smallest(around: np.ndarray, keys: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The smallest id known of each string of distinct surroundings in order of key: at most that of the rows that hold it.

    A key's rows are put in order of their ids. Level by level, of two neighbouring blocks of rows the left one is indexed
    and the right one streamed through the index: a match of SPAN or more is a string that also starts in a smaller id.
    Any two rows of a key meet so once, the smaller one in the index. A row whose strings have all been met takes no part in
    later levels, neither way: whoever shares one of them shares it with the smaller row too.
    """
    order = np.lexsort((least, keys))
    around, keys, least = around[order], keys[order], least[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[: len(keys)]
    sizes = np.diff(np.append(first, len(keys)))
    rank, size = np.arange(len(keys)) - np.repeat(first, sizes), np.repeat(sizes, sizes)
    whole = whole_strings(around)
    found = np.where(whole, least[:, None], NEVER)
    here = np.arange(len(keys))
    for level in range(int(sizes.max(initial=1) - 1).bit_length()):
        left, right = halves(rank[here], size[here], level)
        # An index takes keys until it has INDEX rows; a key is never cut.
        upto = np.cumsum(left)
        new = np.concatenate([[True], keys[here][1:] != keys[here][:-1]])[: len(here)]
        starts = np.flatnonzero(new)
        part = np.repeat((upto[starts] - left[starts]) // INDEX, np.diff(np.append(starts, len(here))))
        for k in range(int(part.max(initial=-1)) + 1):
            x, y = np.searchsorted(part, [k, k + 1])
            held, streamed = here[x:y][left[x:y]], here[x:y][right[x:y]]
            if len(held) and len(streamed):
                found[streamed] = np.minimum(found[streamed], RunIndex(around[held], least[held]).stream(around[streamed])[0])
        here = here[(whole[here] & (found[here] >= least[here, None])).any(1)]
    out = np.empty_like(found)
    out[order] = found
    return out


def meeting(around: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Rows that may share a string in place with another row of their key; the others need no index.

    Each NARROW of a string's possible offsets have SPAN - NARROW + 1 bytes in common: rows that share a string share those,
    at the same place, as the anchor stands at one place in all rows. Equal hashes only let a row into the index.
    """
    n, wide, x = len(keys), SPAN - NARROW + 1, np.ascontiguousarray(around.T)
    sums = np.zeros((WIDE + 1, n), np.uint64)
    for k in range(WIDE):
        sums[k + 1] = sums[k] * np.uint64(FACTOR) + (x[k].astype(np.uint64) + np.uint64(1))
    outside = np.concatenate([np.zeros((1, n), np.int16), np.cumsum(x == OUTSIDE, 0, dtype=np.int16)])
    salt, out = _mixed(keys.astype(np.uint64)), np.zeros(n, bool)
    for low in range(NARROW - 1, REACH + 1, NARROW):
        ok = np.flatnonzero(outside[low + wide] == outside[low])
        held = _mixed((sums[low + wide] - sums[low] * _power(wide))[ok] ^ salt[ok])
        order = np.argsort(held)
        same = np.flatnonzero(held[order][1:] == held[order][:-1])
        out[ok[order[same]]] = out[ok[order[same + 1]]] = True
    return out


def answer_surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codec = pa.Codec("zstd")
    for bucket, sent in by_bucket(batches):
        keys = [np.cumsum(unpacked(r["body"][1], "<i8")) for r in sent]
        around = np.concatenate([np.frombuffer(codec.decompress(r["body"][0], len(k) * WIDE, asbytes=True), np.uint8).reshape(-1, WIDE) for r, k in zip(sent, keys, strict=True)])
        sizes, keys = [len(k) for k in keys], np.concatenate(keys)
        first, which = distinct(around, keys)
        least = np.full(len(first), NEVER)
        np.minimum.at(least, which, np.concatenate([unpacked(r["body"][2], "<i8") for r in sent]))
        around, keys = around[first], keys[first]
        met = meeting(around, keys)
        found = np.where(whole_strings(around), least[:, None], NEVER)
        found[met] = smallest(around[met], keys[met], least[met])
        begins = np.ones(found.shape, bool)
        begins[:, 1:] = found[:, 1:] != found[:, :-1]
        at = 0
        for r, n in zip(sent, sizes, strict=True):
            mine = which[at : at + n]
            at += n
            row, offset = np.nonzero(begins[mine])
            body = [packed(begins[mine].sum(1).astype(np.uint8)), packed(offset.astype(np.uint8)), packed(found[mine][row, offset])]
            yield rows(REPLY, block=[r["block"]], bucket=[bucket], body=[body])


def _replies(df: DataFrame, name: str) -> DataFrame:
    """A row per block with all its replies: one for each bucket at most."""
    return df.groupBy("block").agg(F.collect_list(F.struct("bucket", "body")).alias(name))


OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
OUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def finish(b: Block, gone: np.ndarray, want: bool) -> pa.RecordBatch:
    starts = b.ends - b.length
    sums = np.concatenate([[0], np.cumsum(gone)])
    removed = sums[b.ends] - sums[starts]
    rises = gone.copy()
    rises[1:] &= ~gone[:-1]
    some = starts[b.length > 0]
    rises[some] = gone[some]
    spans = np.concatenate([[0], np.cumsum(rises)])
    left = b.text[~gone].tobytes()
    cut = np.concatenate([[0], np.cumsum(b.length - removed)]).tolist()
    kept = [left[x:y] for x, y in zip(cut, cut[1:], strict=False)]
    return rows(OUT, doc_id=b.doc_ids, n_bytes=b.length, n_removed=removed, n_spans=spans[b.ends] - spans[starts], kept_sha256=[hashlib.sha256(k).hexdigest() for k in kept], kept=kept if want else [None] * len(kept))


def remove_repeats(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): what is left of each text, as bytes if wanted."""
    spark, n = docs.sparkSession, partitions(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    # Bucketed, so that the blocks are joined with their replies in place.
    blocks = bucketed(plain.mapInArrow(block_rows, BLOCKS_DDL), f"passage_blocks_{uuid.uuid4().hex}", n, "block")

    def ask_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from Digests(row).ask(n)

    def block_of(row: dict) -> Block:
        return Block(row, Digests(row).copies(row["copies"] or [], n))

    def ask_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from block_of(batch.slice(i, 1).to_pylist()[0]).ask_keys(n)

    def ready(row: dict) -> Block:
        b = block_of(row)
        b.keep_repeated(row["keys_known"] or [], n)
        return b

    def ask_surroundings(w: int):
        def ask_wave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    b = ready(batch.slice(i, 1).to_pylist()[0]).wave(w)
                    b.surroundings()
                    yield from b.ask_surroundings(n)

        return ask_wave

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                b = ready(row)
                gone = np.zeros(len(b.text), bool)
                for w in range(WAVES):
                    part = b.wave(w)
                    part.surroundings()
                    gone |= part.marks([r | {"bucket": r["bucket"] % n} for r in row["found"] or [] if r["bucket"] // n == w], n)
                yield finish(b, gone, keep_bytes)

    def ask(df: DataFrame, question, answer, label: str) -> DataFrame:
        sent = df.mapInArrow(question, SENT_DDL).repartition(n, "bucket").sortWithinPartitions("bucket")
        # What was shuffled for the answers goes as soon as they are written.
        with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
            return written(sent.mapInArrow(answer, REPLY_DDL), label)

    copies = ask(blocks.select("block", "doc_id", "digests"), ask_copies, answer_copies, "copy-replies")
    told = blocks.hint("merge").join(_replies(copies, "copies"), "block", "left")
    keys = ask(told, ask_keys, answer_keys, "anchor-replies")
    known = told.join(_replies(keys, "keys_known").hint("merge"), "block", "left")
    waves = [ask(known, ask_surroundings(w), answer_surroundings, "passage-replies") for w in range(WAVES)]
    # Buckets of the second wave are numbered after those of the first one, and so on.
    found = reduce(DataFrame.unionByName, (x.withColumn("bucket", F.col("bucket") + w * n) for w, x in enumerate(waves)))
    return known.join(_replies(found, "found").hint("merge"), "block", "left").mapInArrow(mark, OUT_DDL)
