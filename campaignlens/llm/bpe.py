"""Byte-level BPE encoding by a pair occurrence index, and decoding.

A partition's distinct words are laid out in one symbol array. The index maps each pair
(by its rank) to all positions where it stands; active ranks are applied in ascending
order, each to all its positions at once, and the lists of the pairs that arise beside a
merge are updated. A merged symbol's pairs rank after the merge that made it, so this
gives what merging word by word gives.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from campaignlens.llm.common import append_columns, small_batches

# The published pattern of byte-level pre-tokenisation; white space is Unicode's White_Space.
SPACE = r"\t\n\x0b\f\r \x85\xa0  -     　"
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
ASCII_SPACE = r"\t\n\x0b\f\r "
ASCII_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^{ASCII_SPACE}A-Za-z0-9]+|[{ASCII_SPACE}]+(?![^{ASCII_SPACE}])|[{ASCII_SPACE}]+"
#: A worker that knows more words than this between batches forgets them and starts anew.
KEPT_WORDS = 400_000


def gather(flat: np.ndarray, first: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Items of ``rows`` one after another, where row i of ``flat`` has ``counts[i]`` items from ``first[i]`` on."""
    n = counts[rows]
    return flat[np.repeat(first[rows] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself, or one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codes(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        self[word] = code = len(self)
        return code


class PairIndexTokenizer:
    def __init__(self, path: str):
        import re

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        chars = byte_chars()
        back = {c: b for b, c in enumerate(chars)}
        vocab = model["vocab"]
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.specials, key=len, reverse=True))) + ")") if self.specials else None
        of = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in vocab.items()}
        of |= {i: t.encode() for t, i in self.specials.items()}
        spelt = [of.get(i, b"") for i in range(max(of) + 1)]
        self.bytes, self.byte_counts = np.frombuffer(b"".join(spelt), np.uint8), np.array([*map(len, spelt)])
        self.byte_first = np.cumsum(self.byte_counts) - self.byte_counts
        self.byte_id = np.array([vocab[c] for c in chars], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = self.left << 32 | self.right
        self.key_order = np.argsort(keys, kind="stable")
        self.keys = keys[self.key_order]
        self.words = regex.compile(WORDS)
        self.ascii_words = re.compile(ASCII_WORDS)
        # re is the faster library, but its classes only agree with the pattern's where no letter-like numbers or unassigned characters stand
        self.odd = frozenset(c for c in map(chr, range(128, 0x110000)) if (kind := unicodedata.category(c)) in ("No", "Nl") or c.isalnum() != (kind[0] in "LN") or c.isdecimal() != (kind == "Nd"))
        self.plain_words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^{SPACE}\w]|_)+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.codes = Codes((t, i) for i, t in enumerate(self.specials))
        self.ids = np.array([*self.specials.values()], np.uint32)
        self.counts = np.ones(len(self.specials), np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for none."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_order[at], -1)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all (not empty) words one after another, and how many each has."""
        if not words:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        lens = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lens)
        n = int(ends[-1])
        symbol = np.full(n + 1, -1, np.int32)
        symbol[:n] = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        after[ends - 1] = n
        before[ends - lens] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray) -> None:
            rank = self._ranks(symbol[at], symbol[after[at]])
            keep = rank >= 0
            at, rank = at[keep], rank[keep]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            firsts = rank[np.concatenate([[0], cuts])].tolist()
            bounds = [0, *cuts.tolist(), len(at)]
            for i, r in enumerate(firsts):
                part = at[bounds[i] : bounds[i + 1]]
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        note(np.flatnonzero(after[:n] < n).astype(np.int32))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = self.left[r], self.right[r]
            second = after[at]
            valid = (symbol[at] == a) & (symbol[second] == b)
            at, second = at[valid], second[valid]
            if a == b and len(at) > 1:  # "aaa": the left pair is merged
                used, keep = -1, []
                for x, y in zip(at.tolist(), second.tolist()):
                    keep.append(x != used)
                    used = y if x != used else -1
                at, second = at[keep], second[keep]
            if not len(at):
                continue
            symbol[at], symbol[second] = self.made[r], -2
            nxt = after[second]
            after[at] = nxt
            before[nxt[nxt < n]] = at[nxt < n]
            prev = before[at]
            note(np.concatenate([prev[prev >= 0], at[nxt < n]]))
        alive = symbol[:n] >= 0
        upto = np.cumsum(alive)[ends - 1]
        return symbol[:n][alive].astype(np.uint32), np.diff(upto, prepend=0)

    def _split(self, text: str) -> list[str]:
        if text.isascii():
            return self.ascii_words.findall(text)
        return (self.plain_words if self.odd.isdisjoint(text) else self.words).findall(text)

    def _forget(self, keep: int) -> None:
        """Keep the words that came first, which are the frequent ones."""
        self.codes = Codes(zip(islice(self.codes, keep), range(keep)))
        self.counts = self.counts[:keep]
        self.ids = self.ids[: self.counts.sum()]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each whole text; null is empty."""
        if len(self.codes) > KEPT_WORDS:
            self._forget(KEPT_WORDS // 4)
        known, docs, code = len(self.codes), [], self.codes.__getitem__
        for text in texts:
            text = text or ""
            if self.special_split and any(s in text for s in self.specials):
                words: list = []
                for part in self.special_split.split(text):
                    words += [part] if part in self.specials else self._split(part)
            else:
                words = self._split(text)
            docs.append(np.fromiter(map(code, words), np.int64, len(words)))
        ids, counts = self.encode_words([w.encode() for w in islice(self.codes, known, None)])
        self.ids, self.counts = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts])
        first = np.cumsum(self.counts) - self.counts
        return [gather(self.ids, first, self.counts, doc).astype("<u4").tobytes() for doc in docs]

    def decode(self, ids: bytes) -> str:
        """Text of little-endian ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return gather(self.bytes, self.byte_first, self.byte_counts, np.frombuffer(ids, "<u4")).tobytes().decode("utf-8", "replace")


@lru_cache(2)
def tokenizer(path: str) -> PairIndexTokenizer:
    return PairIndexTokenizer(path)


def encode_decode(df: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """Append ``ids`` (binary: little-endian unsigned 32-bit token ids of the whole text) and ``decoded`` (their text).

    ``vocabulary`` is the path of a byte-level BPE file, the same on every machine. Null
    texts count as empty and have no ids. Columns named ``ids`` or ``decoded`` are replaced.
    """
    small_batches(df.sparkSession, 4000)

    def make():
        coder = tokenizer(vocabulary)

        def apply(texts):
            ids = coder.encode_batch(texts)
            return [pa.array(ids, pa.binary()), pa.array([coder.decode(x) for x in ids], pa.string())]

        return apply

    fields = T.StructType([T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])
    return append_columns(df, text_col, fields, make)
