"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens; those not seen before are held together as ragged numpy arrays of symbols. In each round
every sequence applies its own lowest-rank pair at all its places at once, until no sequence has a pair that the
vocabulary merges. The surviving symbols of each pre-token are counted and summed by text.

Cases: a null or empty text has 0 tokens. Strings of added tokens inside texts count as one token, as the library does
by default. Very long texts and pre-tokens are counted whole. Repeated rows are counted alike; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.arrow import with_computed

#: The pattern of byte-level pre-tokens.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file: printable Latin-1 for itself, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merger:
    """Merge table of a byte-level BPE vocabulary; counts the symbols that pre-tokens end with."""

    _loaded: dict[str, Merger] = {}

    def __init__(self, path: str, memo: int = 1_000_000):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.start = np.zeros(256, dtype=np.int64)
        for char, byte in byte_symbols().items():
            self.start[byte] = vocab[char]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.width = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.none = np.int64(len(pairs))
        self.split = regex.compile(PATTERN).findall
        added = [t["content"] for t in spec.get("added_tokens", [])]
        self.added = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.added_hint = added
        self.memo, self.most = {}, memo

    @classmethod
    def of(cls, path: str) -> Merger:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], self.none)

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty piece, all pieces merged side by side."""
        left = np.fromiter(map(len, pieces), np.int64, len(pieces))
        sym = self.start[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        seq = np.repeat(np.arange(len(pieces)), left)
        while len(sym) > 1:
            rank = np.full(len(sym), self.none)  # of the pair that begins here
            same = seq[1:] == seq[:-1]
            rank[:-1][same] = self.rank(sym[:-1][same], sym[1:][same])
            first = np.flatnonzero(np.r_[True, ~same])
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.r_[first, len(sym)])
            live = low < self.none
            if not live.any():
                break
            go = rank == np.repeat(low, size)
            go &= np.repeat(live, size)
            # of overlapping places (one symbol repeated) every second one merges, from the left
            at = np.flatnonzero(go)
            run = np.r_[True, (np.diff(at) > 1)]
            pos = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[pos % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.repeat(live, size)
            keep[at + 1] = False
            gone = np.bincount(seq[at], minlength=len(pieces))
            left -= gone
            sym, seq = sym[keep], seq[keep]  # sequences that are done leave the arrays
        return left

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        words, extra = [], []
        for text in texts:
            n = 0
            if self.added and any(x in text for x in self.added_hint):
                parts = self.added.split(text)
                n = len(parts) - 1
                words.append([w for p in parts for w in self.split(p)])
            else:
                words.append(self.split(text))
            extra.append(n)
        if len(self.memo) > self.most:
            self.memo.clear()
        memo = self.memo
        new = list({w for ws in words for w in ws if w not in memo})
        for i in range(0, len(new), 50_000):
            block = new[i : i + 50_000]
            memo.update(zip(block, self.counts([w.encode("utf-8", "surrogatepass") for w in block]).tolist(), strict=True))
        return [n + sum(map(memo.__getitem__, ws)) for n, ws in zip(extra, words, strict=True)]


def count_tokens(docs: DataFrame, vocab_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens). ``vocab_path`` must exist on every machine."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def start():
        merger = Merger.of(vocab_path)

        def counted(texts: list[str]) -> dict[str, list[int]]:
            out, i = [], 0
            while i < len(texts):  # a few MB of text at once
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) < 4_000_000):
                    size += len(texts[j])
                    j += 1
                out += merger.count(texts[i:j])
                i = j
            return {"n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": out}

        return counted

    return with_computed(slim, "text", start, "n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
