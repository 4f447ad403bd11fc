"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised (blanks become the piece mark, one stands before the text)
and cut before each run of marks that follows another character: no piece of
such a vocabulary has a mark behind another character, so nothing merges across
these cuts. A segment's characters are merged by an agenda of adjacent pairs,
the best score first and the leftmost of equals, until no pair is a piece;
characters without a piece become bytes. Decoding joins the pieces and undoes
the normalisation.

In every Arrow batch, each segment that the worker has not met before is encoded
and decoded by the sentencepiece library as well, and so is the batch's first text
as a whole; a difference stops the task. Models that the agenda can't follow
(other types, normalisers, or pieces of users) are refused. Null and empty texts
have the begin and end ids alone. Ids may be null or repeat, each row is encoded
by itself; other columns are not read; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.llm.common import chunks, rows, text_of, texts
from panelkiln.llm.tokens import Kept

MARK = "▁"
SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Types of pieces in a model file: fixed values.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Difference(RuntimeError):
    """The agenda and the library disagree."""


class MergePieces:
    def __init__(self, path: str, most: int = 300_000):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as f:
            raw = f.read()
        model = proto.ModelProto()
        model.ParseFromString(raw)
        norm = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("the agenda follows merge-type models with identity normalisation only")
        if any(p.type not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in model.pieces):
            raise ValueError("the agenda knows no pieces of users")
        self.prefix = norm.add_dummy_prefix
        self.library = SentencePieceProcessor(model_proto=raw)
        self.begin, self.end, self.unknown = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.id = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.cuts = not any(MARK in p.lstrip(MARK) for p in self.score)
        self.shown = [p.piece.replace(MARK, " ").encode() if p.type == NORMAL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else " ⁇ ".encode() if p.type == UNKNOWN else b"" for p in model.pieces]
        #: Ids of a segment that begins with one mark, by what follows the mark; of any other segment.
        self.words, self.others = Kept(most), Kept(most // 4)
        self.new: dict[str, bytes] = {}

    def agenda(self, segment: str) -> list[int]:
        """The ids of a segment."""
        symbols, score = list(segment), self.score
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in score:
                heap.append((-score[pair], i, i + 1, len(pair)))
        heapify(heap)
        while heap:
            _, i, j, size = heappop(heap)
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != size:
                continue  # one side has changed since
            symbols[i] += symbols[j]
            symbols[j] = ""
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                pair = symbols[i] + symbols[k]
                if pair in score:
                    heappush(heap, (-score[pair], i, k, len(pair)))
            h = before[i]
            if h >= 0:
                pair = symbols[h] + symbols[i]
                if pair in score:
                    heappush(heap, (-score[pair], h, i, len(pair)))
        out = []
        for s in symbols:
            if s:
                known = self.id.get(s)
                if known is not None:
                    out.append(known)
                elif self.bytes:
                    out += [self.bytes[b] for b in s.encode()]
                elif not out or out[-1] != self.unknown:
                    out.append(self.unknown)
        return out

    def _segment(self, segment: str, kept: Kept, key: str) -> bytes:
        out = kept.get(key)
        if out is None and (out := kept.again(key)) is None:
            out = self.new[segment] = kept[key] = np.array(self.agenda(segment), "<u4").tobytes()
        return out

    def _encode(self, text: str) -> bytes:
        if not text:
            return b""
        found = text.split(" ")
        if self.prefix and self.cuts and MARK not in text and "" not in found:
            out = list(map(self.words.get, found))
            if None in out:
                out = [self._segment(MARK + w, self.words, w) if x is None else x for w, x in zip(found, out, strict=True)]
            return b"".join(out)
        whole = MARK * self.prefix + text.replace(" ", MARK)
        return b"".join(self._segment(s, self.others, s) for s in (SEGMENT.findall(whole) if self.cuts else [whole]))

    def decode(self, ids: list[int]) -> bytes:
        """UTF-8 of the text."""
        out = b"".join(map(self.shown.__getitem__, ids))
        return out[1:] if self.prefix and out[:1] == b" " else out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers, without begin and end; new segments and the first text are checked."""
        self.words.turn()
        self.others.turn()
        out = [self._encode(t) for t in texts]
        self.check()
        if texts:
            want = self.library.encode(texts[0])
            if out[0] != np.array(want, "<u4").tobytes() or self.decode(want) != self.library.decode(want).encode():
                raise Difference(f"a text of {len(texts[0])} characters")
        return out

    def check(self) -> None:
        """Compares what is new with the library."""
        new, self.new = self.new, {}
        if not self.prefix:
            return
        # A segment's first mark is the one that the library puts before a text; one without was cut elsewhere.
        segments = [s for s in new if s[:1] == MARK and len(s) > 1]
        plain = [s[1:].replace(MARK, " ") for s in segments]
        for i in range(0, len(plain), 4096):
            part = plain[i : i + 4096]
            want = self.library.encode(part, num_threads=1)
            back = self.library.decode(want, num_threads=1)
            for s, p, ids, text in zip(segments[i : i + 4096], part, want, back, strict=True):
                if new[s] != np.array(ids, "<u4").tobytes():
                    raise Difference(f"ids of {p!r}")
                if self.decode(ids) != text.encode():
                    raise Difference(f"text of {p!r}")


_loaded: dict[str, MergePieces] = {}


def pieces(path: str) -> MergePieces:
    """One encoder per worker and file."""
    if path not in _loaded:
        _loaded[path] = MergePieces(path)
    return _loaded[path]


def encode_pieces(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): array<int> with begin and end ids."""
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in chunks(batches, 4 << 20):
            encoded = model.encode([t.decode("utf-8", "replace") for t in texts(batch)])
            yield rows(out, doc_id=batch.column(0), ids=[np.concatenate([[model.begin], np.frombuffer(x, "<u4"), [model.end]]).astype(np.int32) for x in encoded])

    return _texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of a table of ids; begin and end ids have no text."""
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            yield rows(out, doc_id=batch.column(0), text=[model.decode(x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))


def piece_report(docs: DataFrame, path: str) -> DataFrame:
    """Digests of each text's ids and of the text decoded from them."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        begin, end = np.array([model.begin], "<u4").tobytes(), np.array([model.end], "<u4").tobytes()
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in chunks(batches, 4 << 20):
            encoded = [begin + x + end for x in model.encode([t.decode("utf-8", "replace") for t in texts(batch)])]
            decoded = [model.decode(np.frombuffer(x, "<u4").tolist()) for x in encoded]
            yield rows(out, doc_id=batch.column(0), n_tokens=[len(x) // 4 for x in encoded], ids_sha256=list(map(sha, encoded)), decoded_sha256=[sha(x.decode("utf-8", "replace").encode()) for x in decoded])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
