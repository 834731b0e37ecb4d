"""Ranked lexical search by MaxScore with bounds of term pairs.

One pass over the texts writes inverted blocks: a few thousand documents each, with the postings of all terms that a query has.
Corpus-wide counts come from the blocks and give each posting its impact, a whole number. In each block the intersection lists
of the queries' term pairs are built first, with the largest joint impact of each. The terms of least impact are then combined into
disjoint pairs: what a pair can add is bounded by its joint maximum or the larger of its single ones, which is less than their
sum. Those that together stay under the score of the last hit so far can't lift a document among the hits alone, so their lists
are only looked up for candidates that the other terms give.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlens.llm.common import discard, materialize, small_batches

#: Digits, letters and all that is not ASCII make up terms; A-Z become a-z, any other byte a space.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: A term is paired with this many of those that follow it by weight.
NEIGHBOURS = 2
#: Documents of a block.
BLOCK = 2000


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


BLOCKS = [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("lengths", "terms", "sizes", "places", "counts")]


def inverted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Blocks of ``docs`` (id, text): ids, the documents' ``lengths``, the ``terms`` of the vocabulary that occur, how many documents hold each (``sizes``), and their ``places`` and ``counts``, term after term."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([T.StructField("ids", T.ArrayType(docs.schema["id"].dataType)), *BLOCKS])

    def run(batches):
        known = sent.value.get
        for batch in batches:
            lengths, terms, places, counts = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = terms_of(text)
                lengths.append(len(words))
                own, n = np.unique(np.array([t for t in map(known, words) if t is not None], np.int32), return_counts=True)
                terms.append(own)
                counts.append(n)
                places.append(np.full(len(own), i, np.int32))
            if not lengths:
                continue
            term = np.concatenate(terms)
            by = np.argsort(term, kind="stable")
            there, sizes = np.unique(term, return_counts=True)
            rows = [np.array(lengths), there, sizes, np.concatenate(places)[by], np.concatenate(counts)[by]]
            lists = [pa.ListArray.from_arrays(pa.array([0, len(r)], pa.int32()), pa.array(r.astype(np.int32))) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0)), *lists], names=schema.names)

    return docs.select("id", "text").mapInArrow(run, schema)


class Query:
    """A query's terms in descending order of weight, and which of them are paired."""

    def __init__(self, terms: list[int], weights: np.ndarray):
        self.terms = sorted(terms, key=lambda t: (-weights[t], t))
        self.pairs = [(a, b) if a < b else (b, a) for i, a in enumerate(self.terms) for b in self.terms[i + 1 : i + 1 + NEIGHBOURS]]


class Block:
    """Postings of one block with their impacts, and the intersection lists of pairs."""

    def __init__(self, lengths, terms, sizes, places, counts, weights: np.ndarray, documents: int, total: int):
        norm = 50 + 50 * lengths.astype(np.int64) * documents // max(total, 1)
        tf = counts.astype(np.int64)
        impact = np.repeat(weights[terms], sizes) * (1_000_000_000 * tf // (1000 * tf + 20 * norm[places]))
        cuts = np.cumsum(sizes)[:-1]
        self.n = len(lengths)
        self.lists = dict(zip(terms.tolist(), zip(np.split(places, cuts), np.split(impact, cuts)))) if len(terms) else {}
        self.most = {t: int(x.max()) for t, (_, x) in self.lists.items()}
        self.joint: dict[tuple[int, int], tuple[np.ndarray, int]] = {}

    def intersect(self, pairs) -> None:
        """Keep the places that hold both terms of each pair, and the largest sum of both impacts there (0 for none)."""
        for pair in pairs:
            if pair in self.joint or pair[0] not in self.lists or pair[1] not in self.lists:
                continue
            (few, x), (many, y) = sorted((self.lists[t] for t in pair), key=lambda p: len(p[0]))
            at = np.minimum(np.searchsorted(many, few), len(many) - 1)
            both = many[at] == few
            self.joint[pair] = few[both], int((x[both] + y[at[both]]).max()) if both.any() else 0

    def bounds(self, query: Query, paired: bool = True) -> tuple[list[int], list[int]]:
        """The query's terms that occur in ascending order of their largest impact, and for each what it and those before it can add to a document at most.

        Each term is paired with the free one before it that lowers the bound most: a document holds both and no more than their joint maximum, or one alone.
        """
        most = self.most
        terms = sorted((t for t in query.terms if t in most), key=lambda t: (most[t], t))
        partners: dict[int, list[tuple[int, int]]] = {}
        for a, b in query.pairs if paired else ():
            if (a, b) in self.joint and (gain := most[a] + most[b] - max(self.joint[a, b][1], most[a], most[b])):
                partners.setdefault(a, []).append((gain, b))
                partners.setdefault(b, []).append((gain, a))
        upto, total, free = [], 0, set()
        for t in terms:
            gain, other = max((p for p in partners.get(t, ()) if p[1] in free), default=(0, None))
            if gain:
                free.discard(other)
            else:
                free.add(t)
            total += most[t] - gain
            upto.append(total)
        return terms, upto

    def search(self, query: Query, k: int, floor: int, paired: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents of the block that can be among ``k`` hits, if a hit needs ``floor`` at least. ``read`` is how many postings that took."""
        self.read = 0
        terms, upto = self.bounds(query, paired)
        score = np.zeros(self.n, np.int64)
        u = len(terms) - 1
        while u >= 0 and upto[u] >= max(floor, 1):  # this term and those before it alone could make a hit
            at, impact = self.lists[terms[u]]
            score[at] += impact
            self.read += len(at)
            if self.n >= k:
                floor = max(floor, int(np.partition(score, self.n - k)[self.n - k]))
            u -= 1
        found = np.flatnonzero(score)
        for u in range(u, -1, -1):
            found = found[score[found] + upto[u] >= floor]
            if not len(found):
                break
            at, impact = self.lists[terms[u]]
            where = np.minimum(np.searchsorted(at, found), len(at) - 1)
            hit = at[where] == found
            score[found[hit]] += impact[where[hit]]
            self.read += len(found)
        found = found[score[found] >= max(floor, 1)]
        return found, score[found]


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` highest scores, equal ones by ascending id."""
    return np.lexsort((ids, -scores))[:k]


def search_blocks(blocks: DataFrame, items: pa.Array, queries: list[Query], weights: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    """Rows (item, id, score, last) of each task's hits; ``last`` is the score of its ``k``-th hit, if it has that many."""
    id_type = blocks.schema["ids"].dataType.elementType
    names = blocks.columns
    sent = blocks.sparkSession.sparkContext.broadcast((items, queries, weights))
    schema = T.StructType([T.StructField("item", items_type(items)), T.StructField("id", id_type), T.StructField("score", T.LongType()), T.StructField("last", T.LongType())])

    def run(batches):
        items, queries, weights = sent.value
        pairs = dict.fromkeys(p for q in queries for p in q.pairs)
        hits: list = [None] * len(queries)
        kind = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(c)[i].values for c, n in enumerate(names)}
                kind = row["ids"].type
                ids = np.array(row["ids"].to_pylist())
                block = Block(*[row[f.name].to_numpy() for f in BLOCKS], weights, documents, total)
                block.intersect(pairs)
                for q, query in enumerate(queries):
                    old = hits[q]
                    found, scores = block.search(query, k, int(old[1][-1]) if old and len(old[1]) == k else 0)
                    if len(found):
                        both = (ids[found], scores) if old is None else (np.concatenate([old[0], ids[found]]), np.concatenate([old[1], scores]))
                        keep = best(both[1], both[0], k)
                        hits[q] = both[0][keep], both[1][keep]
        for q, hit in enumerate(hits):
            if hit is not None:
                n = len(hit[1])
                last = pa.array([int(hit[1][-1])] * n if n == k else [None] * n, pa.int64())
                yield pa.RecordBatch.from_arrays([items.take(pa.array([q] * n)), pa.array(hit[0].tolist(), kind), pa.array(hit[1]), last], names=schema.names)

    return blocks.mapInArrow(run, schema)


def items_type(items: pa.Array) -> T.DataType:
    from pyspark.sql.pandas.types import from_arrow_type

    return from_arrow_type(items.type)


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_terms: int = 1_000_000
) -> DataFrame:
    """The ``k`` documents of the highest scores above 0 of each item: the item, ``rank`` (from 1), the document's id and ``score``; equal scores by ascending id.

    Terms are runs of letters, digits and all that is not ASCII, A-Z in lower case. An item's terms count once each; rows of one
    item are one item of all their terms. Documents or items without an id take no part; null and empty texts have no terms, are in
    no count and never hits. Rows of equal id are documents of their own. Empty tables give an empty result, other columns are left out. Items are searched
    in blocks of about ``block_terms`` terms, so that what all tasks get is bounded; each block of items reads all documents.
    """
    spark = docs.sparkSession
    given = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    lower = F.translate(F.coalesce(F.col(item_text_col), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = materialize(
        items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term")).distinct(), "item-terms"
    )
    parts = max(1, math.ceil(asked.count() / block_terms))
    out = None
    for part in range(parts):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).toArrow()
        names = own["item"].unique()
        of_item = {v: i for i, v in enumerate(names.to_pylist())}
        vocabulary: dict[bytes, int] = {}
        terms: list[list[int]] = [[] for _ in of_item]
        for item, term in zip(own["item"].to_pylist(), own["term"].to_pylist()):
            terms[of_item[item]].append(vocabulary.setdefault(term.encode(), len(vocabulary)))
        small_batches(spark, BLOCK)
        blocks = materialize(inverted(given, vocabulary), "blocks")
        counted = F.filter("lengths", lambda n: n > 0)
        documents, total = blocks.agg(F.coalesce(F.sum(F.size(counted)), F.lit(0)), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, n: s + n)), F.lit(0))).first()
        holding = np.zeros(len(vocabulary), np.int64)
        for term, n in blocks.select(F.inline(F.arrays_zip("terms", "sizes"))).groupBy("terms").agg(F.sum("sizes")).toLocalIterator():  # at most block_terms
            holding[term] = n
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in holding.tolist()], np.int64)
        small_batches(spark, 8)
        found = materialize(search_blocks(blocks, names, [Query(t, weights) for t in terms], weights, documents, total, k), "hits")
        discard(blocks)
        out = found if out is None else out.union(found)
    # a score under some task's k-th is no hit
    floors = materialize(out.groupBy("item").agg(F.max("last").alias("floor")), "floors")
    likely = out.join(floors, "item").where("floor IS NULL OR score >= floor")
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id"))
    hits = likely.select("item", rank.alias("rank"), "id", "score").where(F.col("rank") <= k)
    return hits.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
