"""Encoding inside tasks: a tokenizer per worker.

``ChunkIds`` counts ids with a bounded cache of the pieces of text that a
tokenizer is known to treat independently: vocabularies split texts into words
before any merge, so a text may be cut at such a boundary and the parts encoded
one by one; the same parts recur. A text in which a cut could change the result
is encoded whole.

``ByteBpe`` gives the ids of a byte-level vocabulary through a faster encoder,
after checking that the two cannot differ.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re

import numpy as np

#: Chunks that a worker remembers (some 150 bytes each) before it starts over.
CACHE_ENTRIES = 1_000_000
#: Text encoded at a time, in characters; a longer text goes alone.
SLICE_CHARS = 2_000_000

# white space that Python's split() and the tokenizers' \s may see differently
_ODD = "".join(map(chr, (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C),
                         0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF)))
_ODD_SPACE = re.compile(f"[{_ODD}]")
_ASCII_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")
_SPACE_THEN_SPACE = re.compile(rf"[\s{_ODD}] ")


@functools.lru_cache(maxsize=4)
def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode_ids(tokenizer, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def slices(texts: list[str]):
    """(first, last) ranges of texts of about SLICE_CHARS characters."""
    first, total = 0, 0
    for i, t in enumerate(texts):
        if total and total + len(t) > SLICE_CHARS:
            yield first, i
            first, total = i, 0
        total += len(t)
    if first < len(texts):
        yield first, len(texts)


def byte_signs() -> dict[int, str]:
    """The sign that byte-level vocabularies write for each byte: itself where
    it prints, else the next free code point from 256 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printed]
    return {b: chr(b) for b in printed} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_SIGNS = byte_signs()


def spaced_chunks(text: str) -> list[str]:
    """Parts of a text for a tokenizer that drops white space: its words."""
    if _ODD_SPACE.search(text):
        return [x for x in _ASCII_SPACE.split(text) if x]
    return text.split()


def leading_space_chunks(text: str) -> list[str]:
    """Parts of a text for a tokenizer whose words carry the space before them:
    cut before each single space. Runs of white space are not cut: a text that
    has one ending in a space stays whole."""
    if _SPACE_THEN_SPACE.search(text):
        return [text]
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + x for x in rest]


@functools.lru_cache(maxsize=2)
def known_chunks(path: str) -> ChunkIds:
    """The worker's own ``ChunkIds``: later tasks go on with what it knows."""
    return ChunkIds(path)


@functools.lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str | None) -> ByteBpe:
    """The worker's own ``ByteBpe``."""
    return ByteBpe(path, pattern)


class ByteBpe:
    """Ids as the ``tokenizers`` library gives them.

    ``pattern``: the expression by which a byte-level vocabulary without a
    normaliser splits texts into words. The library then merges a word's bytes
    by the order of its merges; the faster encoder merges any neighbours whose
    joint bytes are a token, by the order of ids. The two agree if ids follow
    the order of merges and every token, as a word, is encoded as itself: then
    neighbours that make up a token are always the two of its own merge. Where
    that does not hold, or no pattern is given, the library itself encodes."""

    def __init__(self, path: str, pattern: str | None = None):
        self.tokenizer = load(path)
        self.fast = self._fast(json.loads(self.tokenizer.to_str()), pattern) if pattern else None

    def _fast(self, spec: dict, pattern: str):
        import tiktoken

        model, splits = spec["model"], spec["pre_tokenizer"] or {}
        vocab, special = model.get("vocab"), {a["content"]: a for a in spec["added_tokens"]}
        if (model["type"] != "BPE" or spec["normalizer"] or splits.get("type") != "ByteLevel"
                or splits.get("add_prefix_space") or not splits.get("use_regex", True)
                or model.get("ignore_merges") or model.get("unk_token") or model.get("dropout")
                or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in special.values())):
            return None
        merged = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        tokens = {t: i for t, i in vocab.items() if t not in special}
        if (any(a >= b for a, b in itertools.pairwise(merged)) or len(tokens) != len(merged) + len(BYTE_SIGNS)
                or any(len(self.tokenizer.model.tokenize(t)) != 1 for t in tokens)):
            return None
        byte_of = {sign: b for b, sign in BYTE_SIGNS.items()}
        return tiktoken.Encoding("byte-level", pat_str=pattern,
                                 mergeable_ranks={bytes(byte_of[c] for c in t): i for t, i in tokens.items()},
                                 special_tokens={c: a["id"] for c, a in special.items()})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; special strings in it are special ids."""
        if self.fast is None:
            return [np.array(x, dtype=np.uint32) for x in encode_ids(self.tokenizer, texts)]
        return [self.fast.encode_to_numpy(t, allowed_special="all") for t in texts]


class ChunkIds:
    """Number of ids of known chunks; starts over when full."""

    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.clear()

    def clear(self):
        self.code: dict[str, int] = {}
        self.length = np.zeros(0, np.int64)

    def learn(self, chunks: list[str]):
        new = [c for c in dict.fromkeys(chunks) if c not in self.code]
        if len(self.code) + len(new) > CACHE_ENTRIES:
            self.clear()
            new = list(dict.fromkeys(chunks))
        if not new:
            return
        length = np.fromiter(map(len, encode_ids(self.tokenizer, new)), np.int64, len(new))
        at = len(self.code)
        self.code.update(zip(new, range(at, at + len(new)), strict=True))
        self.length = np.concatenate((self.length, length))

    def codes(self, chunks: list[str]) -> np.ndarray:
        self.learn(chunks)
        return np.fromiter(map(self.code.__getitem__, chunks), np.int64, len(chunks))

    def counts(self, texts: list[str], split) -> np.ndarray:
        """Number of ids of each text."""
        parts = [split(t) for t in texts]
        codes = self.codes(list(itertools.chain.from_iterable(parts)))
        out = np.concatenate(([0], np.cumsum(self.length[codes])))
        ends = np.cumsum([len(p) for p in parts])
        return np.diff(np.concatenate(([0], out[ends]))) if len(ends) else np.zeros(0, np.int64)
