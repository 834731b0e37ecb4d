"""Benchmark decontamination with one Aho-Corasick automaton over normalised items.

The automaton's letters are numbered words. Of an item of a window or more it holds runs of half a window that follow each other without overlap:
every window holds one of them whole. Where one occurs in a text, the words beside it are compared with those beside it in the item.
So the automaton has about one state for each word of the benchmark, not one for each word of each window.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlens.llm.common import append_columns, discard, materialize, small_batches

# Bytes as words see them: A-Z in lower case, all ASCII but letters and digits a space; bytes from 0x80 on belong to words.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
# Letters of a known word: one from FIRST on, one from LATER on. Any other word is two that no key has.
FIRST, LATER, OTHER = 0x100, 0x3000, "\x01\x02"

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ]
)


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


@dataclass
class Place:
    """What an automaton's key stands for: items that it is the whole of, and (words before, words after, items) around it in longer ones."""

    n: int
    whole: set[str] = field(default_factory=set)
    around: dict[tuple[str, str], set[str]] = field(default_factory=dict)
    #: The same by the nearest words of a side, if there are many.
    near: dict[str, list] | None = None


#: Places of more surroundings than this are looked up by the nearest words.
MANY = 8


class Matcher:
    """Windows of some items. Each word is two letters of disjoint alphabets, so that no state has many followers and keys start at words only."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.size, self.half = size, (size + 1) // 2
        known = [(item, normal_words(text)) for item, text in items]
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, words in known for w in words))}
        base = math.isqrt(len(vocabulary)) + 1
        if base > LATER - FIRST:
            raise ValueError("too many different words for one block")
        self.codes = {w: chr(FIRST + i // base) + chr(LATER + i % base) for w, i in vocabulary.items()}
        places: dict[str, Place] = {}
        reach = size - self.half
        for item, words in known:
            text = "".join(map(self.codes.__getitem__, words))
            if 0 < len(words) < size:
                places.setdefault(text, Place(len(words))).whole.add(item)
                continue
            for at in range(0, len(words) - self.half + 1, self.half):
                end = at + self.half
                place = places.setdefault(text[2 * at : 2 * end], Place(self.half))
                place.around.setdefault((text[2 * max(0, at - reach) : 2 * at], text[2 * end : 2 * (end + reach)]), set()).add(item)
        # a window has at least ``close`` of its other words on one side
        self.close = -(-reach // 2)
        self.automaton = ahocorasick.Automaton()
        for key, place in places.items():
            if len(place.around) > MANY and self.close:
                place.near = {}
                for (before, after), ids in place.around.items():
                    for side in {"<" + before[-2 * self.close :], ">" + after[: 2 * self.close]}:
                        place.near.setdefault(side, []).append((before, after, ids))
            self.automaton.add_word(key, place)
        self.empty = not places
        if places:
            self.automaton.make_automaton()

    def hits(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, runs of hit words (first, one past the last), items found."""
        words = normal_words(text)
        if self.empty or not words:
            return len(words), [], set()
        codes = self.codes
        flat = "".join([codes.get(w, OTHER) for w in words])
        found: list[tuple[int, int]] = []
        items: set[str] = set()
        for last, place in self.automaton.iter(flat):
            end = (last + 1) // 2
            start = end - place.n
            if place.whole:
                found.append((start, end))
                items |= place.whole
            if place.near is not None:
                rows = place.near.get("<" + flat[max(0, 2 * (start - self.close)) : 2 * start], []) + place.near.get(">" + flat[2 * end : 2 * (end + self.close)], [])
            else:
                rows = [(before, after, ids) for (before, after), ids in place.around.items()]
            for before, after, ids in rows:
                n = place.n + (left := same_end(before, flat, 2 * start)) + (right := same_start(after, flat, 2 * end))
                if n >= self.size:
                    found.append((start - left, end + right))
                    items |= ids
        return len(words), merged(found), items


def same_end(words: str, flat: str, end: int) -> int:
    """How many words before ``end`` are the last ones of ``words``."""
    n, most = 0, min(len(words), end)
    while 2 * n < most and words[len(words) - 2 * n - 2 : len(words) - 2 * n] == flat[end - 2 * n - 2 : end - 2 * n]:
        n += 1
    return n


def same_start(words: str, flat: str, at: int) -> int:
    n, most = 0, min(len(words), len(flat) - at)
    while 2 * n < most and words[2 * n : 2 * n + 2] == flat[at + 2 * n : at + 2 * n + 2]:
        n += 1
    return n


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs that touch or overlap as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = 13, block_bytes: int = 16 << 20) -> DataFrame:
    """Append ``n_words``, ``n_hit`` (words inside an occurring window), ``item_ids`` (items with occurring windows, sorted
    as strings) and ``hit_spans`` (runs of hit words as code points of the original text, end exclusive).

    Each block of about ``block_bytes`` of benchmark text becomes one automaton of about 130 bytes a word (some 350 MB for 16 MB of text), built by each
    task; a benchmark of several blocks is scanned block after block over the same rows, each scan written before the next begins, so that
    one block's automaton is held at a time. Null or word-less texts have no words, windows or hits; null ids or
    texts of the benchmark take no part; repeated items count once. Columns of the result's names are replaced.
    """
    spark = df.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).dropna()
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    out = df
    for block in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block)
        sent = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])
        older, out = out, _scan(out, sent, text_col, size, merge=block > 0)
        if block < blocks - 1:
            out = materialize(out, "scanned")
            sent.unpersist()
            if block:
                discard(older)
    return out


def _scan(df: DataFrame, sent, text_col: str, size: int, merge: bool) -> DataFrame:
    """One pass of one automaton; ``merge`` joins its finds to those of the passes before."""
    given = df.withColumn("__given", F.struct(F.col(text_col).alias("text"), *([F.col("item_ids"), F.col("hit_spans")] if merge else []))) if merge else df

    def make():
        matcher = Matcher(sent.value, size)

        def apply(rows):
            counts, hit, items, spans = [], [], [], []
            for row in rows:
                text, old_items, old = (row["text"], row["item_ids"], row["hit_spans"]) if merge else (row, [], [])
                n, runs, ids = matcher.hits(text)
                if old:
                    starts = {m.start(): i for i, m in enumerate(WORD.finditer(text))}
                    stops = {m.end(): i for i, m in enumerate(WORD.finditer(text), 1)}
                    runs = merged(runs + [(starts[s["start"]], stops[s["end"]]) for s in old])
                counts.append(n)
                hit.append(sum(b - a for a, b in runs))
                items.append(sorted(ids | set(old_items)))
                at = [(m.start(), m.end()) for m in WORD.finditer(text)] if runs else []
                spans.append([{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs])
            return [counts, hit, items, spans]

        return apply

    out = append_columns(given, "__given" if merge else text_col, HITS, make)
    return out.drop("__given") if merge else out
