"""Token ids of whole texts by the tokenizers library, with what it has answered kept per worker.

A byte-level BPE splits a text at its pre-token pattern before it merges, so the
ids of a text are those of its pre-tokens in turn. Texts are cut at single
spaces into chunks that no pre-token crosses, chunks not met before into
pre-tokens, and only pre-tokens not met before go to the library's model. Texts
that hold one of the file's added tokens go to the library whole. What is known
is kept in two generations of a fixed size, so memory doesn't grow with the vocabulary of a corpus and frequent words stay known.

An empty text has no ids; nulls are the caller's to replace. Equal texts have
equal ids, whatever came before them.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

#: Characters with Unicode's White_Space property: fixed values.
SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of other characters with one space before it; white space up to the last before such a run; that last one.
UNIT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]")
#: The pre-token pattern of byte-level BPE vocabularies of this kind: a fixed value.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in such vocabularies: itself, or else the next free one from 256 on."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in kept]
    return {b: chr(b) for b in kept} | {b: chr(256 + i) for i, b in enumerate(others)}


class Kept(dict):
    """A cache of two generations: when the young one is full, it becomes the old one."""

    def __init__(self, most: int):
        super().__init__()
        self.most, self.old = most, {}

    def again(self, key):
        """The old generation's answer, made young; None if there is none."""
        value = self.old.get(key)
        if value is not None:
            self[key] = value
        return value

    def turn(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class BpeIds:
    """encode(texts) gives each text's ids as bytes of little-endian integers of ``dtype``."""

    def __init__(self, path: str, most: int = 400_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"] or {}
        #: Only this pre-tokenizer, without prefix space and normalizer, splits as PRETOKEN does.
        self.splits = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and spec["normalizer"] is None
        #: What the library finds in a text before it splits it; a text that holds any goes to the library whole.
        self.added = [t["content"] for t in spec.get("added_tokens") or []]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.pretokens = regex.compile(PRETOKEN).findall
        self.letters = byte_letters()
        self.tokenize = self.tokenizer.model.tokenize
        self.table = [i.to_bytes(self.dtype.itemsize, "little") for i in range(self.tokenizer.get_vocab_size())]
        #: By chunk, of the chunk with a space before it; by pre-token.
        self.chunks, self.parts = Kept(most), Kept(most // 4)

    def _library(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in encoded]

    def _model(self, pretoken: str) -> bytes:
        letters = pretoken.encode().decode("latin-1").translate(self.letters)
        table = self.table
        return b"".join([table[x.id] for x in self.tokenize(letters)])

    def _part(self, pretoken: str) -> bytes:
        out = self.parts.get(pretoken)
        if out is None and (out := self.parts.again(pretoken)) is None:
            out = self.parts[pretoken] = self._model(pretoken)
        return out

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a space and the chunk, which is put into the cache."""
        chunks = self.chunks
        if (out := chunks.again(chunk)) is not None:
            return out
        if chunk.isalpha():
            out = self._model(" " + chunk)
        elif chunk[-1] in ".,;:!?" and (word := chunk[:-1]).isalpha():
            out = (chunks.get(word) or self._chunk(word)) + self._part(chunk[-1])
        else:
            out = self._unit(" " + chunk)
        chunks[chunk] = out
        return out

    def _unit(self, unit: str) -> bytes:
        return b"".join(map(self._part, self.pretokens(unit)))

    def _whole(self, text: str) -> bytes:
        """Any text, by units: white space of any kind between words."""
        return b"".join(map(self._unit, UNIT.findall(text)))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.splits:
            return self._library(texts)
        added = self.added
        return [self._library([t])[0] if any(a in t for a in added) else self._encode(t) for t in texts]

    def whole_spaced(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of a space and each text by the library alone; the strings of its special tokens are plain text and nothing is kept."""
        self.tokenizer.encode_special_tokens = True
        encoded = self.tokenizer.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        self.tokenizer.encode_special_tokens = False
        return [np.array(x.ids, self.dtype) for x in encoded]

    def _encode(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if rest and (not first or first[-1] in SPACE):
            return self._whole(text)
        found = list(map(self.chunks.get, rest))
        if None in found:
            get = self.chunks.get
            for i, known in enumerate(found):
                if known is None:
                    chunk = rest[i]
                    if not chunk or chunk[-1] in SPACE:
                        return self._whole(text)
                    found[i] = get(chunk) or self._chunk(chunk)
            self.chunks.turn()
            self.parts.turn()
        return self._whole(first) + b"".join(found)


_loaded: dict[str, BpeIds] = {}


def bpe(path: str) -> BpeIds:
    """One encoder per worker and file."""
    if path not in _loaded:
        _loaded[path] = BpeIds(path)
    return _loaded[path]
