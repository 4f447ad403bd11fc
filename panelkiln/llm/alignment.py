"""Alignment of two tokenizers' tokens over the same bytes, and how well their ids go together.

Each text is encoded by a byte-level BPE (A, of a space and the text) and by the
sentencepiece library with a piece model (B, which puts the space there itself). Inside
``mapInArrow`` the two lists of cumulative token ends are merged: where both have
an end, a group of tokens ends on both sides, and the A token and the B token that
end there are linked. Neither side has a token across the ends of words and of marks (``UNITS``), so a
text's groups are those of its units in turn: units that the worker has not met
before are encoded by both libraries and merged, many at a time, and their groups
and links are kept. A block of texts becomes one row with its texts' counts and
links; it also asks, one row for each distinct pair of ids in it, for that pair's
count. Spark groups these rows to the count of a pair in the whole corpus, takes
the highest count of each A id and of each B id, joins all three and sends them
back to the blocks that asked, so a pair that is everywhere is a row a block and
no text is ever repeated. An answer has no more rows than its block has links, and
a block no more than BLOCK bytes, or one text.

Texts that are null or empty, and texts whose tokens on either side don't spell
space and text (a U+2581 in a text is a space to B), have no tokens: their columns
are 0, the digest ''. Special tokens' strings in a text are plain text. Null and
repeated ids are kept as they are, a row each; every row's links count. Columns
but doc_id and text aren't read; an empty table gives none.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkiln.llm.common import LARGE_ROWS, chunks, partitions, rows, text_of, texts, written
from panelkiln.llm.pieces import BYTE, CONTROL, MARK, NORMAL, UNKNOWN
from panelkiln.llm.tokens import BpeIds, Kept

#: Bytes of text a block holds at most, unless one text has more.
BLOCK = 4 << 20
#: Units that a worker remembers, in two generations, and the characters of the longest of them.
KEPT, LONGEST = 100_000, 64
#: Characters of texts whose new units are encoded together, and new units in one text for the libraries.
TOGETHER, JOINED = 256 << 10, 64
#: Letters, or marks of ASCII but the apostrophe, perhaps with a single space before them, and a line's end, where neither side has a token across
#: what follows; anything else goes on to the next single space between two characters that aren't white space. A space before the text is part of it.
_LETTER, _MARKS = r"[^\W\d_\xb2\xb3\xb9\xbc-\xbe]", r"!-&(-/:-@\[-`{-~"
_NEXT = r" (?=\S)|\n(?= ?\S|\Z)|\Z"
UNITS = re.compile(rf" ?{_LETTER}++(?=[{_MARKS}']|{_NEXT})| ?[{_MARKS}]++(?={_LETTER}|{_NEXT})|(?<=\S)\n(?= ?\S|\Z)|(?s:.)+?(?=(?<=\S) \S|\Z)")
#: A line's end, and what stands before any other unit without a space where the libraries see it.
LINE, BEFORE = "\n", " a\n"
#: Bits of a pair that hold the B id.
BITS = 32


#: Groups' text, links as 64-bit pairs, tokens of A and of B; of what either side doesn't spell.
Aligned = tuple[bytes, bytes, int, int]
WRONG: Aligned = (b"", b"", 0, 0)


class Sides:
    """Both tokenizers: the bytes of each id, the ids' decimal forms before each separator, and what is known of units."""

    def __init__(self, a: str, b: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        self.a, self.b = BpeIds(a, 0), SentencePieceProcessor(model_file=b)
        back = {c: x for x, c in self.a.letters.items()}
        self.a_bytes = [b""] * self.a.tokenizer.get_vocab_size()
        for token, i in self.a.tokenizer.get_vocab().items():
            # Added tokens are no byte-level tokens; plain text never gives them.
            self.a_bytes[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
        model = proto.ModelProto()
        with open(b, "rb") as f:
            model.ParseFromString(f.read())
        self.b_bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else p.piece.replace(MARK, " ").encode() for p in model.pieces]
        self.a_size, self.b_size = (np.array([len(x) for x in side]) for side in (self.a_bytes, self.b_bytes))
        # An id and what follows it: ',' within a side, '|' after A's side of a group, ';' after B's.
        self.shown = [f"{i}{s}".encode() for n, after in ((len(self.a_bytes), ",|"), (len(self.b_bytes), ",;")) for i in range(n) for s in after]
        norm, kinds = model.normalizer_spec, {p.type for p in model.pieces}
        plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces and norm.add_dummy_prefix
        inner = [p.piece.lstrip(MARK) for p in model.pieces if p.type == NORMAL]
        within = not any(MARK in x or (len(x) > 1 and "\n" in x) or len(UNITS.findall(" " + x)) > 1 for x in inner)
        merges = model.trainer_spec.model_type == 2 and not model.trainer_spec.treat_whitespace_as_suffix and BYTE in kinds and kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}
        #: Only then both sides can be cut into units; else texts go to the libraries whole, and nothing is kept.
        self.cuts = self.a.splits and all(t.special for t in self.a.tokenizer.get_added_tokens_decoder().values()) and plain and within and merges
        self.units = Kept(KEPT)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts on both sides, text after text."""
        a = self.a.whole_spaced(texts)
        b = self.b.encode(texts, num_threads=1)
        return np.concatenate(a).astype(np.int64), np.concatenate([np.array(x, np.int64) for x in b])

    def learn(self, units: list[str], joined: int = JOINED) -> list[Aligned]:
        """What there is of each unit, ``joined`` of them in one text for the libraries."""
        if not units:
            return []
        seen = [u if u[0] == " " else BEFORE + u if u != LINE else BEFORE for u in units]
        plain = ["".join(seen[i : i + joined]) for i in range(0, len(seen), joined)]
        a, b = self.encode([x[1:] for x in plain])
        want = "".join(plain).encode()
        lengths, own = (np.fromiter(map(len, map(str.encode, x)), np.int64, len(x)) for x in (seen, units))
        to = np.cumsum(lengths)
        last_a, last_b = self.merged(a, b)
        # Places of the units' ends among the common ends, of which the first is the start.
        at = np.concatenate([[0], np.cumsum(self.a_size[a])[last_a]])
        cuts = [np.minimum(np.searchsorted(at, x), len(at) - 1) for x in (to - own, to)]
        spelt = all(b"".join(map(side.__getitem__, ids.tolist())) == want for side, ids in ((self.a_bytes, a), (self.b_bytes, b)))
        if not spelt or not all(np.array_equal(at[x], y) for x, y in zip(cuts, (to - own, to), strict=True)):
            return [WRONG] if len(units) == 1 else [x for u in units for x in self.learn([u], 1)]
        groups, links = self.groups(a, b, last_a, last_b).split(b";"), (a[last_a] << BITS | b[last_b]).tobytes()
        tokens = [(np.concatenate([[0], last + 1])[cuts[1]] - np.concatenate([[0], last + 1])[cuts[0]]).tolist() for last in (last_a, last_b)]
        return [(b";".join(groups[i:j]), links[8 * i : 8 * j], x, y) for i, j, x, y in zip(*(x.tolist() for x in cuts), *tokens, strict=True)]

    def align(self, texts: list[bytes]) -> Iterator[Aligned]:
        """What there is of each text: nothing where either side doesn't spell space and text."""
        held, size = [], 0
        for t in texts:
            known = t.decode("utf-8", "replace")
            # A mark in a text is a space to B, and what was replaced isn't the text's.
            right = t and MARK not in known and ("\ufffd" not in known or known.encode() == t)
            held.append((UNITS.findall(" " + known) if self.cuts else [" " + known]) if right else [])
            size += len(known)
            if size >= TOGETHER:
                yield from self._align(held)
                held, size = [], 0
        yield from self._align(held)

    def _known(self, held: list[list[str]]) -> dict[str, Aligned]:
        """What there is of the texts' units that are not among the young ones."""
        kept = self.units
        missing = list(dict.fromkeys(u for text in held for u in filterfalse(kept.__contains__, text)))
        known = {u: x for u, x in zip(missing, map(kept.old.get, missing)) if x is not None}
        new = [u for u in missing if u not in known]
        # White space at a unit's end, met only in lines' ends and at a text's end, would join what comes after it.
        alone = [u for u in {LINE, *(text[-1] for text in held if text)}.intersection(new) if u[-1].isspace()] if self.cuts else new
        if alone:
            known |= {u: self.learn([u])[0] for u in alone}
            new = [u for u in new if u not in known]
        known |= zip(new, self.learn(new), strict=True)
        return known

    def _align(self, held: list[list[str]]) -> Iterator[Aligned]:
        kept, known = self.units, self._known(held)
        wrong = any(x is WRONG for x in known.values())
        for text in held:
            found = list(map(kept.get, text))
            if None in found:
                found = [known[u] if x is None else x for u, x in zip(text, found, strict=True)]
            if not found or (wrong and any(x is WRONG for x in found)):
                yield WRONG
            else:
                groups, links, n_a, n_b = zip(*found, strict=True)
                yield b";".join(groups), b"".join(links), sum(n_a), sum(n_b)
        if self.cuts:
            kept.update((u, x) for u, x in known.items() if len(u) <= LONGEST and x is not WRONG)
            kept.turn()

    def merged(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of A tokens, places of B tokens) that end together, from both sides' ends."""
        ends_a, ends_b = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        if not len(ends_a) or not len(ends_b):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(ends_b, ends_a)
        both = np.flatnonzero(ends_b[np.minimum(at, len(ends_b) - 1)] == ends_a)
        return both, at[both]

    def groups(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
        """The groups' text: `a1,a2|b1;a3|b2,b3`."""
        end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        end_a[last_a] = end_b[last_b] = 1
        # A token comes after the other side's tokens of all earlier groups, a B token after its own group's A tokens too.
        before_a, before_b = np.concatenate([[0], last_b + 1]), np.concatenate([last_a + 1, [len(a)]])
        turn = np.empty(len(a) + len(b), np.int64)
        turn[np.arange(len(a)) + before_a[np.cumsum(end_a) - end_a]] = 2 * a + end_a
        turn[np.arange(len(b)) + before_b[np.cumsum(end_b) - end_b]] = 2 * (b + len(self.a_bytes)) + end_b
        return b"".join(map(self.shown.__getitem__, turn.tolist()))[:-1]


_loaded: dict[tuple[str, str], Sides] = {}


def sides(a: str, b: str) -> Sides:
    """One pair of encoders per worker and files."""
    if (a, b) not in _loaded:
        _loaded[a, b] = Sides(a, b)
    return _loaded[a, b]


COUNTS = ("n_a", "n_b", "n_groups", "n_links")
BLOCKS = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), *((c, pa.list_(pa.int64())) for c in COUNTS), ("groups_sha256", pa.list_(pa.string())), ("pairs", pa.binary())])
BLOCKS_DDL = "block long, doc_id array<long>, " + ", ".join(f"{c} array<long>" for c in COUNTS) + ", groups_sha256 array<string>, pairs binary"


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Blocks of texts: their ids, counts and groups' digests, and all links as pairs of ids, text by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, codec, first, n = sides(a, b), pa.Codec("zstd"), TaskContext.get().partitionId() << BITS, 0
        for batch in chunks(batches, BLOCK):
            pairs, counts, digests = [], [], []
            for groups, links, n_a, n_b in both.align(texts(batch)):
                pairs.append(links)
                counts.append((n_a, n_b, len(links) // 8, len(links) // 8))
                digests.append(hashlib.sha256(groups).hexdigest() if n_a else "")
            columns = dict(zip(COUNTS, ([list(c)] for c in zip(*counts, strict=True)), strict=True))
            # The two halves of a pair apart, which compress better so.
            links = np.frombuffer(b"".join(pairs), np.int64)
            body = codec.compress(np.concatenate([links >> BITS, links & (1 << BITS) - 1]).astype("<u4").tobytes(), asbytes=True)
            yield rows(BLOCKS, block=[first + n], doc_id=[batch.column(0).to_pylist()], groups_sha256=[digests], pairs=[body], **columns)
            n += 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, BLOCKS_DDL)


def _links(body: bytes, n: int) -> np.ndarray:
    raw = np.frombuffer(pa.Codec("zstd").decompress(body, 8 * n, asbytes=True), "<u4").astype(np.int64) if n else np.zeros(0, np.int64)
    return raw[:n] << BITS | raw[n:]


def pairs_of(blocks: DataFrame) -> DataFrame:
    """(block, pair, n): each distinct pair of a block and its links there."""
    out = pa.schema([("block", pa.int64()), ("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, each, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pair, n = np.unique(_links(body, sum(each)), return_counts=True)
                yield rows(out, block=np.full(len(pair), block), pair=pair, n=n)

    return blocks.select("block", "n_links", "pairs").mapInArrow(run, "block long, pair long, n long")


def pair_counts(asked: DataFrame) -> DataFrame:
    """(pair, links, best_a, best_b): a pair's links in the corpus, and whether they are the most of its A and of its B id."""
    counts = asked.groupBy("pair").agg(F.sum("n").alias("links")).withColumns({"a": F.shiftright("pair", BITS), "b": F.col("pair").bitwiseAND((1 << BITS) - 1)})
    counts = written(counts, "pair-counts")
    for side in "ab":
        most = counts.groupBy(side).agg(F.max("links").alias(f"most_{side}"))
        counts = counts.join(most, side)
    return counts.select("pair", "links", *((F.col("links") == F.col(f"most_{side}")).alias(f"best_{side}") for side in "ab"))


OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in (*COUNTS, "n_best", "count_sum")), ("groups_sha256", pa.string()), ("n_best_a", pa.int64())])
OUT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, n_best_a long"


ANSWERS = pa.schema([("block", pa.int64()), ("pair", pa.binary()), ("links", pa.binary()), ("best", pa.binary())])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers in order of (block, pair) as one row a block; best: 1 for the A side, 2 for the B side."""

    def row(held: list[np.ndarray]) -> pa.RecordBatch:
        x = np.concatenate(held)
        return rows(ANSWERS, block=[x[0, 0]], pair=[x[:, 1].tobytes()], links=[x[:, 2].tobytes()], best=[x[:, 3].astype(np.uint8).tobytes()])

    held: list[np.ndarray] = []
    for batch in batches:
        x = np.stack([c.to_numpy() for c in batch.columns], 1)
        cuts = np.flatnonzero(np.diff(x[:, 0])) + 1
        for part in np.split(x, cuts):
            if held and len(part) and held[-1][0, 0] != part[0, 0]:
                yield row(held)
                held = []
            if len(part):
                held.append(part)
    if held:
        yield row(held)


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            held = batch.slice(i, 1).to_pylist()[0]
            pair, links = (np.frombuffer(held[c] or b"", np.int64) for c in ("pair", "links"))
            best, each = np.frombuffer(held["best"] or b"", np.uint8), np.array(held["n_links"])
            mine = np.searchsorted(pair, _links(held["pairs"], int(each.sum())))
            cut = np.concatenate([[0], np.cumsum(each)])

            def by_text(values: np.ndarray, mine=mine, cut=cut) -> np.ndarray:
                sums = np.concatenate([[0], np.cumsum(values[mine], dtype=np.int64)])
                return sums[cut[1:]] - sums[cut[:-1]]

            yield rows(OUT, n_best=by_text(best >> 1), n_best_a=by_text(best & 1), count_sum=by_text(links), **{c: held[c] for c in ("doc_id", *COUNTS, "groups_sha256")})


def alignment_report(docs: DataFrame, a: str, b: str) -> DataFrame:
    """Per document: tokens of both sides, groups, links, links that are their B (n_best) or A id's most frequent, and the counts' sum."""
    blocks = written(align(docs, a, b), "aligned", **LARGE_ROWS)
    asked = pairs_of(blocks)
    best = F.col("best_a").cast("long") + 2 * F.col("best_b").cast("long")
    told = asked.join(pair_counts(asked), "pair").select("block", "pair", "links", best.alias("best"))
    # A block's answers are as many as its distinct pairs.
    told = told.repartition(partitions(docs.sparkSession), "block").sortWithinPartitions("block", "pair")
    told = told.mapInArrow(_packed, "block long, pair binary, links binary, best binary")
    return blocks.join(told, "block", "left").mapInArrow(_report, OUT_DDL)
