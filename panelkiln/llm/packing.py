"""Order-preserving packing of token streams into windows by dynamic programming.

Documents keep the order of their ids within a partition; their ids form one
stream. Windows are cut at document ends (free), sentence ends (a small
penalty; a token that ends with a stop, whatever word that closes, or holds a
line break) or, where neither comes for long, anywhere (a large penalty), so that
padding plus penalties is least. A window of ``i..j`` costs its padding, which is
``size - (j - i)``: with ``dp[i] + i`` as the key, the best start in the last
``size`` tokens is the head of a monotone queue, so each cut is settled in
constant time. Windows whose length is a power of two need no padding and are a
second kind of transition, looked up by position.

A block of about a million tokens is planned at once and ends at a document end;
blocks are independent, so nothing is shuffled, memory is bounded and a lost
task is simply run again. A null or empty text is one document of the end id
alone. Ids may be null or repeat; rows of one id stay in a row, in any order. An
empty table has no pieces. Any window size from 1 on will do.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from panelkiln.llm.common import chunks, text_of, texts
from panelkiln.llm.tokens import bpe

#: Costs in units of one padding token.
SEQUENCE, SENTENCE, ANYWHERE = 4, 6, 64
#: Lengths under the window size that are not padded; shorter powers of two would only scatter a document.
SHORT = (64, 128, 256, 512)
#: Without a natural cut for so many tokens (or a window's), cuts are allowed at this distance.
GAP = 256
BLOCK = 1 << 20

PIECE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("sequence_tokens", pa.int64())])


def cuts(natural: np.ndarray, penalty: np.ndarray, size: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """The candidate positions with those added that long gaps need, and their penalties; natural[0] is 0."""
    steps, gap = np.diff(natural), min(GAP, size)
    wide = np.flatnonzero(steps > gap)
    if not len(wide):
        return natural, penalty
    more = np.concatenate([np.arange(natural[k] + gap, natural[k + 1], gap) for k in wide])
    at = np.concatenate([natural, more])
    cost = np.concatenate([penalty, np.full(len(more), ANYWHERE)])
    order = np.argsort(at, kind="stable")
    return at[order], cost[order]


def plan(at: np.ndarray, cost: np.ndarray, size: int = 1024) -> list[int]:
    """Indices into ``at`` of the window ends, the last position among them, of least total cost."""
    pos, pen = at.tolist(), cost.tolist()
    n = len(pos)
    best, back = [0] * n, [0] * n
    where = {p: i for i, p in enumerate(pos)}
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # (dp + position, position, index), the first rising
    push, drop, head, get = queue.append, queue.pop, queue.popleft, where.get
    short = [n for n in SHORT if n < size]
    for j in range(1, n):
        p = pos[j]
        while queue[0][1] < p - size:
            head()
        value, _, i = queue[0]
        low = value + size - p
        for length in short:
            k = get(p - length)
            if k is not None and best[k] < low:
                low, i = best[k], k
        low += SEQUENCE + pen[j]
        best[j], back[j] = low, i
        key = low + p
        while queue and queue[-1][0] >= key:
            drop()
        push((key, p, j))
    ends, j = [], n - 1
    while j:
        ends.append(j)
        j = back[j]
    return ends[::-1]


def pack_block(doc_ids: list, ids: list[bytes], dtype: np.dtype, sentence: np.ndarray, first: int, size: int = 1024) -> tuple[pa.RecordBatch, int]:
    """The pieces of a block of documents, and the number of sequences. sentence: whether an id ends one."""
    stream = np.frombuffer(b"".join(ids), dtype)
    lengths = np.array([len(x) // dtype.itemsize for x in ids])
    ends = np.cumsum(lengths)
    inner = np.flatnonzero(sentence[stream]) + 1
    natural = np.unique(np.concatenate([[0], ends, inner]))
    penalty = np.full(len(natural), SENTENCE)
    penalty[np.searchsorted(natural, ends)] = 0
    at, cost = cuts(natural, penalty, size)
    windows = at[plan(at, cost, size)]
    edges = np.unique(np.concatenate([[0], windows, ends]))
    begin, length = edges[:-1], np.diff(edges)
    doc, seq = np.searchsorted(ends, begin, side="right"), np.searchsorted(windows, begin, side="right")
    doc_start, seq_start = np.concatenate([[0], ends])[doc], np.concatenate([[0], windows])[seq]
    raw = memoryview(stream.astype("<u4").tobytes())
    crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
    columns = [pa.array(doc_ids, pa.int64()).take(pa.array(doc)), begin - doc_start, length, crc, lengths[doc], first + seq, begin - seq_start, np.diff(np.concatenate([[0], windows]))[seq]]
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, pa.int64()) for x in columns], schema=PIECE), len(windows)


def pack(docs: DataFrame, path: str, end_id: int = 0, size: int = 1024) -> DataFrame:
    """Pieces of all documents. path: a tokenizers file. Only doc_id and text are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe(path)
        words = [encoder.tokenizer.decode([i]) for i in range(encoder.tokenizer.get_vocab_size())]
        sentence = np.array([w.rstrip("\"')”’」").endswith((".", "!", "?", "。", "！", "？")) or "\n" in w for w in words])
        end, sequence = np.array([end_id], encoder.dtype).tobytes(), TaskContext.get().partitionId() << 36
        doc_ids, ids, held = [], [], 0
        for batch in chunks(batches):
            encoded = encoder.encode([x.decode("utf-8", "replace") for x in texts(batch)])
            for doc, x in zip(batch.column(0).to_pylist(), encoded, strict=True):
                doc_ids.append(doc)
                ids.append(x + end)
                held += len(ids[-1]) // encoder.dtype.itemsize
                if held >= BLOCK:
                    out, n = pack_block(doc_ids, ids, encoder.dtype, sentence, sequence, size)
                    yield out
                    doc_ids, ids, held, sequence = [], [], 0, sequence + n
        if ids:
            yield pack_block(doc_ids, ids, encoder.dtype, sentence, sequence, size)[0]

    ordered = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of().alias("text")).sortWithinPartitions("doc_id")
    return ordered.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long")
