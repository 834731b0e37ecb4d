"""Alignment of two tokenizers' tokens by white-space anchors.

Both tokenizers encode the whole text. Where a token of either that is marked with a space begins at the same byte, all tokens
before end there on both sides: these anchors cut a document into windows of token ids. How a window's tokens align depends on
its ids alone, so it is worked out once for each pair of id tuples of a batch of texts, and looked up for the others.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlens.llm.bpe import Codes, PairIndexTokenizer, gather
from campaignlens.llm.common import append_columns, discard, materialize, small_batches

#: Windows are looked up among those of so many characters of text. A worker that knows more words of the piece model than these between batches forgets them.
BATCH, KEPT_PIECES = 1_500_000, 200_000
MIX = np.uint64(0x9E3779B97F4A7C15)


class ByteTokenizer(PairIndexTokenizer):
    """Ids of a space and the text. Strings of special tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.special_split = None
        self.marked = self.byte_counts > 0
        self.marked[self.marked] = self.bytes[self.byte_first[self.marked]] == 32

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(ids, "<u4").astype(np.int64) for ids in self.encode_batch([" " + t for t in texts])]


class PieceTokenizer:
    """Ids of a text, before which the model puts a space. No piece has a space mark after another character, so no merge crosses the start of a word and words can be encoded once."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        spelt = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else b"" if self.model.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.bytes, self.byte_counts = np.frombuffer(b"".join(spelt), np.uint8), np.array([*map(len, spelt)])
        self.byte_first = np.cumsum(self.byte_counts) - self.byte_counts
        self.marked = np.array([p.startswith("▁") for p in pieces])
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)
        self.space = self.model.piece_to_id("▁")
        self.words = re.compile(" +[^ ]*")
        self.codes = Codes()
        self.ids, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)

    def _full(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(x, np.int64) for x in self._full(texts)]
        if len(self.codes) > KEPT_PIECES:
            self.codes, self.ids, self.counts = Codes(), self.ids[:0], self.counts[:0]
        known, code = len(self.codes), self.codes.__getitem__
        docs = []
        for text in texts:
            words = self.words.findall(" " + text) if text else []
            docs.append(np.fromiter(map(code, words), np.int64, len(words)))
        # the space before a word is the one that the model puts there; of a word that is one space nothing is left
        words = list(islice(self.codes, known, None))
        new = [[self.space] if len(w) == 1 else x for w, x in zip(words, self._full([w[1:] for w in words]))]
        self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(new), np.int64)])
        self.counts = np.concatenate([self.counts, np.array([len(x) for x in new], np.int64)])
        first = np.cumsum(self.counts) - self.counts
        return [gather(self.ids, first, self.counts, doc) for doc in docs]


def spelling(coder, ids: np.ndarray) -> bytes:
    return gather(coder.bytes, coder.byte_first, coder.byte_counts, ids).tobytes()


def numbered(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each row of ``counts`` items."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def distinct_windows(sides: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Of windows whose ids are rows of each side (ids, counts): one of each pair of id tuples, and for every window which of these it is.

    Windows are brought together by a hash; that their ids are the same is then verified.
    """
    n = len(sides[0][1])
    hashed = np.zeros(n, np.uint64)
    for k, (ids, counts) in enumerate(sides):
        x = (ids.astype(np.uint64) + np.uint64(1)) * MIX + numbered(counts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03 + 2 * k)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        hashed += np.add.reduceat(x ^ (x >> np.uint64(32)), np.cumsum(counts) - counts) * np.uint64(2 * k + 1)
    _, chosen, which = np.unique(hashed, return_index=True, return_inverse=True)
    for ids, counts in sides:
        like = chosen[which]
        if not ((counts[like] == counts).all() and (gather(ids, np.cumsum(counts) - counts, counts, like) == ids).all()):
            return np.arange(n), np.arange(n)  # two tuples of one hash: each window by itself
    return chosen, which


class Aligner:
    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = ByteTokenizer(byte_path), PieceTokenizer(piece_path)
        self.width = len(self.b.byte_counts)
        digits = [str(i).encode() for i in range(max(self.width, len(self.a.byte_counts)))]
        self.digits, self.digit_counts = np.frombuffer(b"".join(digits), np.uint8), np.array([*map(len, digits)])
        self.digit_first = np.cumsum(self.digit_counts) - self.digit_counts
        self.asked = self.made = 0

    def windows(self, docs_a: list[np.ndarray], docs_b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where windows begin in the ids of all documents one after another, on both sides, and how many each document has."""
        ids_a, ids_b = np.concatenate(docs_a), np.concatenate(docs_b)
        start_a, start_b = (np.cumsum(n) - n for n in (self.a.byte_counts[ids_a], self.b.byte_counts[ids_b]))
        anchor_a, anchor_b = self.a.marked[ids_a], self.b.marked[ids_b]
        first_a = np.cumsum([0, *map(len, docs_a)])[:-1]
        anchor_a[first_a] = anchor_b[np.cumsum([0, *map(len, docs_b)])[:-1]] = True
        begin_a, begin_b = np.flatnonzero(anchor_a), np.flatnonzero(anchor_b)
        at = np.searchsorted(start_b[begin_b], start_a[begin_a])
        shared = np.append(start_b[begin_b], -1)[at] == start_a[begin_a]
        begin_a, begin_b = begin_a[shared], begin_b[at[shared]]
        return begin_a, begin_b, np.diff(np.append(np.searchsorted(begin_a, first_a), len(begin_a)))

    def aligned(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of ids that spell the same bytes: which of A's end a group, the links ``a * width + b``, the groups as text with ``;`` after each, and how long each one's text is.

        No token is empty, so at each shared end one of A is linked with one of B.
        """
        end_a, end_b = np.cumsum(self.a.byte_counts[ids_a]), np.cumsum(self.b.byte_counts[ids_b])
        at = np.minimum(np.searchsorted(end_b, end_a), len(end_b) - 1)
        last_a = end_b[at] == end_a
        last_b = np.zeros(len(ids_b), bool)
        last_b[at[last_a]] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        sizes_a, sizes_b = np.bincount(group_a), np.bincount(group_b)
        place_a = np.arange(len(ids_a)) + (np.cumsum(sizes_b) - sizes_b)[group_a]
        place_b = np.arange(len(ids_b)) + np.cumsum(sizes_a)[group_b]
        tokens, marks = np.empty(len(ids_a) + len(ids_b), np.int64), np.empty(len(ids_a) + len(ids_b), np.uint8)
        tokens[place_a], tokens[place_b] = ids_a, ids_b
        marks[place_a], marks[place_b] = np.where(last_a, ord("|"), ord(",")), np.where(last_b, ord(";"), ord(","))
        n = self.digit_counts[tokens]
        ends = np.cumsum(n + 1)
        text = np.empty(int(ends[-1]), np.uint8)
        text[ends - 1] = marks
        written = np.ones(len(text), bool)
        written[ends - 1] = False
        text[written] = gather(self.digits, self.digit_first, self.digit_counts, tokens)
        return last_a, ids_a[last_a] * self.width + ids_b[last_b], text, np.diff(ends[place_b[last_b]], prepend=0)

    def align(self, docs_a: list[np.ndarray], docs_b: list[np.ndarray]) -> list[tuple]:
        """(groups, text, links) of each document; each distinct window is aligned once."""
        begin_a, begin_b, of_doc = self.windows(docs_a, docs_b)
        ids_a, ids_b = np.concatenate(docs_a), np.concatenate(docs_b)
        counts_a, counts_b = np.diff(np.append(begin_a, len(ids_a))), np.diff(np.append(begin_b, len(ids_b)))
        chosen, which = distinct_windows([(ids_a, counts_a), (ids_b, counts_b)])
        self.asked, self.made = self.asked + len(which), self.made + len(chosen)
        last, links, text, sizes = self.aligned(gather(ids_a, begin_a, counts_a, chosen), gather(ids_b, begin_b, counts_b, chosen))
        groups = np.add.reduceat(last.astype(np.int64), np.cumsum(counts_a[chosen]) - counts_a[chosen])
        first = np.cumsum(groups) - groups
        cuts = [0, *np.cumsum(np.add.reduceat(sizes, first)).tolist()]
        raw = text.tobytes()
        texts = [raw[i:j] for i, j in zip(cuts, cuts[1:])]
        out, at = [], 0
        for n in of_doc.tolist():
            own = which[at : at + n]
            at += n
            out.append((int(groups[own].sum()), b"".join([texts[w] for w in own.tolist()])[:-1], gather(links, first, groups, own)))
        return out

    def some(self, texts: list[str]) -> list[tuple]:
        ids = list(zip(self.a.encode(texts), self.b.encode(texts)))
        good = [i for i, t in enumerate(texts) if t and spelling(self.a, ids[i][0]) == spelling(self.b, ids[i][1]) == (" " + t).encode()]
        out: list[tuple] = [(0, 0, 0, 0, "", [], [])] * len(texts)
        for i, (n, groups, links) in zip(good, self.align([ids[i][0] for i in good], [ids[i][1] for i in good]) if good else []):
            pairs, times = np.unique(links, return_counts=True)
            out[i] = (len(ids[i][0]), len(ids[i][1]), n, len(links), hashlib.sha256(groups).hexdigest(), pairs, times)
        return out

    def batch(self, texts: list[str | None]) -> list:
        """Columns of ALIGNED for some texts."""
        given = [t or "" for t in texts]
        upto = np.cumsum([0, *map(len, given)])
        out, i = [], 0
        while i < len(given):
            j = max(i + 1, int(np.searchsorted(upto, upto[i] + BATCH, "right")) - 1)
            out += self.some(given[i:j])
            i = j
        return list(zip(*out)) if out else [[] for _ in ALIGNED.fields]


ALIGNED = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")]
    + [T.StructField("groups_sha256", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())), T.StructField("times", T.ArrayType(T.LongType()))]
)


@lru_cache(1)
def aligner(byte_path: str, piece_path: str) -> Aligner:
    return Aligner(byte_path, piece_path)


def align_tokens(df: DataFrame, byte_path: str, piece_path: str, text_col: str = "text") -> DataFrame:
    """Append the columns of ``ALIGNED``: numbers of tokens, groups and links, a digest of the groups, and the links as distinct
    ``pairs`` (A's id times the number of B's ids, plus B's id) and how many ``times`` each stands in the text.

    The paths of a byte-level BPE file and a piece model are the same on every machine. Texts that are null or empty, or that a
    tokenizer's tokens do not spell, have no tokens. Columns of these names are replaced.
    """
    small_batches(df.sparkSession, 1000)

    def make():
        return aligner(byte_path, piece_path).batch

    return append_columns(df, text_col, ALIGNED, make)


def align_corpus(df: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", common: int = 200_000) -> DataFrame:
    """One row per row of ``df``: id, the numbers and digest of ``align_tokens``, ``n_best`` and ``count_sum``.

    The count of a pair of ids is how many links of all documents hold it: ``count_sum`` adds it up over a document's links, and
    ``n_best`` are those whose count is the highest of all pairs with the same id of the piece model. Null ids and repeated rows
    are rows like others; other columns are left out; an empty table gives an empty result. Pairs that make up at least one part
    in ``common`` of all links, so at most as many, go to all tasks; the others, of which none has many links, are joined.
    """
    spark = df.sparkSession
    width = PieceTokenizer(piece_path).model.get_piece_size()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", F.monotonically_increasing_id())
    docs = materialize(align_tokens(rows, byte_path, piece_path), "aligned")
    links = docs.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnRenamed("pairs", "pair")
    totals = links.groupBy("pair").agg(F.sum("times").alias("n"))
    best = F.col("n") == F.max("n").over(Window.partitionBy(F.col("pair") % width))
    counted = materialize(totals.withColumn("best", best), "pairs")
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = F.col("n") * common >= total
    known = links.join(F.broadcast(counted.where(frequent)), "pair", "left")
    rare = known.where("n IS NULL").select("row", "pair", "times").join(counted.where(~frequent), "pair")
    add = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    parts = known.where("n IS NOT NULL").groupBy("row").agg(*add).unionByName(rare.groupBy("row").agg(*add))
    sums = parts.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = docs.drop("pairs", "times").join(sums, "row", "left")
    return out.select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256"
    )
