"""Ranked search of whole texts: accumulators from short lists, document-at-a-time skipping over long ones.

The index is a table: a row holds the postings of one term in one segment (documents, frequencies), and one row a
segment without a term holds the documents themselves. Every text is read once to build it. A lot of queries
reads the rows of its own terms, a segment at a time; each task keeps the best documents of every query, and
they are merged by windows.

In a segment a query adds up its short lists first (term at a time) and goes on with their sums as one more
list, bounded by its block maxima like the long lists. Blocks of documents are visited in order; those whose
maxima together stay below the least score that still counts are passed over, and in the others only the documents that
can still reach it are looked up in the long lists, the lists of the largest maxima first.

Scores are whole numbers; only the logarithm in a term's weight is taken in doubles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..operators.sizes import store
from .orders import partitions
from .texts import flat, id_and_bytes, ragged, slices, utf8

TOP = 10
#: Documents in a block, and open blocks that are looked at before the least score that counts is taken anew.
BLOCK, ROUND = 64, 8
#: A list is short if it has at most one posting for so many documents of the segment.
SHORT_SHARE = 16
#: Bytes of texts in a segment (one text at least), and of query texts in a lot.
SEGMENT_BYTES, LOT_BYTES = 4 * 1024 * 1024, 8 * 1024 * 1024
#: Partial best lists of a query that are merged in one task are dealt over so many first.
MERGE_PARTS = 64

INDEX = "segment bigint, term binary, n bigint, total bigint, docs binary, amounts binary, ids array<bigint>"
FOUND = "query bigint, part int, doc_id bigint, score bigint"

#: A-Z become lower case, what is neither letter, digit nor beyond ASCII becomes a blank.
_TERMS = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)], np.uint8)


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts in order, and the text of each."""
    data = _TERMS[data]
    inside = data != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    starts = np.flatnonzero(begins)
    body = data[inside]
    ends = np.concatenate([np.cumsum(inside, dtype=np.int64)[starts] - 1, [len(body)]]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(body)])
    return words, np.searchsorted(offsets, starts, "right") - 1


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index of all documents with at least one term.

    For a term of a segment: ``n`` documents, their numbers in the segment and frequencies (32-bit). For the
    segment itself the term is NULL: ``n`` documents, ``total`` terms, lengths and ids.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, limit=SEGMENT_BYTES):
                words, doc = terms(*flat(part.column(1)))
                if not len(words):
                    continue
                coded = words.dictionary_encode()
                lengths = np.bincount(doc, minlength=part.num_rows)
                held = np.flatnonzero(lengths)
                number = np.cumsum(lengths > 0) - 1
                cell, times = np.unique(coded.indices.to_numpy().astype(np.int64) * len(held) + number[doc], return_counts=True)
                term, at = cell // len(held), (cell % len(held)).astype("<i4")
                n = np.bincount(term, minlength=len(coded.dictionary))
                edges = (np.concatenate([[0], np.cumsum(n)]) * 4).astype(np.int32)
                docs_of, times_of = (pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edges), pa.py_buffer(x)]) for x in (at, times.astype("<i4")))
                nothing = pa.nulls(len(n), pa.list_(pa.int64()))
                own = pa.array(np.full(len(n), segment))
                yield pa.RecordBatch.from_arrays([own, coded.dictionary, pa.array(n), pa.nulls(len(n), pa.int64()), docs_of, times_of, nothing], names)
                ids = pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), part.column(0).take(pa.array(held)))
                sizes = lengths[held].astype("<i8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([segment]), pa.array([None], pa.binary()), pa.array([len(held)]), pa.array([int(lengths.sum())]), pa.array([None], pa.binary()), pa.array([sizes]), ids], names)
                segment += 1

    names = ["segment", "term", "n", "total", "docs", "amounts", "ids"]
    return store(id_and_bytes(docs, id_col, text_col).mapInArrow(segments, INDEX), "search_index")


def weight(documents: int, with_term: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * with_term + 1)))


class Lists:
    """The postings of a segment for all terms of a lot: documents, shares of the score, block maxima."""

    def __init__(self, term: np.ndarray, size: np.ndarray, docs: np.ndarray, times: np.ndarray, lengths: np.ndarray, weights: np.ndarray, documents: int, total: int) -> None:
        """term, size: number and postings of each list, ascending terms; docs, times: all postings."""
        self.n = len(lengths)
        self.blocks = -(-self.n // BLOCK)
        self.place = np.full(len(weights), -1, np.int64)
        self.place[term] = np.arange(len(term))
        self.size = size
        self.at = np.cumsum(size) - size
        self.docs = docs.astype(np.int64)
        mixed = 100 - 90 + (90 * lengths * documents) // total
        times = times.astype(np.int64)
        self.share = np.repeat(weights[term], size) * ((1_000_000_000 * times) // (1000 * times + 8 * mixed[self.docs]))
        row = np.repeat(np.arange(len(term)), size)
        cell = row * self.blocks + self.docs // BLOCK
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        self.cell = cell[first]
        self.cell_most = np.maximum.reduceat(self.share, first) if len(cell) else np.zeros(0, np.int64)
        self.cell_at = np.searchsorted(self.cell, np.arange(len(term) + 1) * self.blocks)
        self.short = self.size * SHORT_SHARE <= self.n

    def maxima(self, row: int) -> np.ndarray:
        """Largest share in each block."""
        out = np.zeros(self.blocks, np.int64)
        own = slice(self.cell_at[row], self.cell_at[row + 1])
        out[self.cell[own] - row * self.blocks] = self.cell_most[own]
        return out

    def search(self, wanted: np.ndarray, best: Best) -> None:
        """Offer ``best`` every document that can be among the best for the terms."""
        rows = self.place[wanted]
        rows = rows[rows >= 0]
        if not len(rows):
            return
        short, long = rows[self.short[rows]], rows[~self.short[rows]]
        # Term at a time: the sums of the short lists.
        sums = np.zeros(self.blocks * BLOCK, np.int64)
        where = ragged(self.at[short], self.size[short])
        np.add.at(sums, self.docs[where], self.share[where])
        sum_most = sums.reshape(self.blocks, BLOCK).max(1)
        # Document at a time: the sums are one list beside the long ones, largest maxima first.
        most = np.stack([self.maxima(r) for r in long]) if len(long) else np.zeros((0, self.blocks), np.int64)
        order = np.argsort(-most.max(1), kind="stable") if len(long) else []
        long, most = long[order], most[order]
        rest = np.concatenate([np.cumsum(most[::-1], 0)[::-1], np.zeros((1, self.blocks), np.int64)])  # what the lists from the k-th on can give
        bound = sum_most + rest[0]
        block = 0
        while block < self.blocks:
            open_ = block + np.flatnonzero(bound[block:] >= best.least)[:ROUND]
            if not len(open_):
                return
            block = int(open_[-1]) + 1
            doc = (open_[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            score = sums[doc]
            for k, r in enumerate(long):
                live = score + rest[k][doc // BLOCK] >= best.least
                doc, score = doc[live], score[live]
                if not len(doc):
                    break
                postings = self.docs[self.at[r] : self.at[r] + self.size[r]]
                found = np.searchsorted(postings, doc)
                found[found == len(postings)] = 0
                hit = postings[found] == doc
                score[hit] += self.share[self.at[r] + found[hit]]
            best.offer(doc, score)


class Best:
    """The best documents of a query so far: highest scores, equal ones by ascending id (NULL first)."""

    def __init__(self, top: int) -> None:
        self.top, self.least, self.rows = top, 1, []
        self.ids: list[int | None] = []

    def offer(self, doc: np.ndarray, score: np.ndarray) -> None:
        keep = score >= self.least
        if keep.any():
            ids = self.ids
            # Of many equal scores only the smallest ids can stay.
            own = sorted((-s, ids[d] is not None, ids[d] or 0) for d, s in zip(doc[keep].tolist(), score[keep].tolist()))
            self.rows = sorted(self.rows + own[: self.top])[: self.top]
            if len(self.rows) == self.top:
                self.least = max(1, -self.rows[-1][0])


def query_lots(queries: DataFrame, id_col: str, text_col: str, lot_bytes: int) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """Ids and distinct terms of the queries with a term, in lots of at most ``lot_bytes`` of text (one query at least)."""
    lot, size = [], 0
    for r in queries.select(F.col(id_col).cast("bigint").alias("id"), utf8(text_col).alias("data")).distinct().orderBy("id", "data").toLocalIterator():
        data = bytes(r["data"])
        words, _ = terms(np.frombuffer(data, np.uint8), np.array([0, len(data)], np.int64))
        own = words.unique().to_pylist()
        if not own:
            continue
        if lot and size + len(data) > lot_bytes:
            yield lot
            lot, size = [], 0
        lot.append((r["id"], own))
        size += len(data)
    if lot:
        yield lot


def _search_lot(index: DataFrame, lot: list[tuple[int | None, list[bytes]]], top: int) -> DataFrame:
    """``query, part, doc_id, score``: the best of each task for each query (its number in the lot)."""
    spark = index.sparkSession
    number = {t: i for i, t in enumerate(dict.fromkeys(t for _, own in lot for t in own))}
    wanted = [np.array([number[t] for t in own], np.int64) for _, own in lot]
    # Bounded by the lot.
    vocabulary = F.broadcast(spark.createDataFrame(pa.table({"term": pa.array(list(number), pa.binary()), "number": pa.array(range(len(number)), pa.int64())})))
    rows = index.where("term is not null").join(vocabulary, "term").select("segment", "number", "n", "total", "docs", "amounts", "ids")
    counted = {r["number"]: r["n"] for r in rows.groupBy("number").agg(F.sum("n").alias("n")).collect()}
    heads = index.where("term is null").select("segment", F.lit(-1).cast("bigint").alias("number"), "n", "total", "docs", "amounts", "ids")
    whole = heads.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).first()
    documents, total = whole["n"] or 0, whole["total"] or 0
    weights = np.array([weight(documents, counted.get(i, 0)) for i in range(len(number))], np.int64)
    shared = spark.sparkContext.broadcast((wanted, weights))

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, weights = shared.value
        best = [Best(top) for _ in wanted]
        held: list[tuple[np.ndarray, ...]] = []
        lengths, ids, now = None, [], None

        def close() -> None:
            if held:
                lists = Lists(*(np.concatenate(x) for x in zip(*held)), lengths, weights, documents, total)
                for own, b in zip(wanted, best):
                    b.ids = ids
                    lists.search(own, b)
            held.clear()

        for batch in batches:
            segment, term, n = (batch.column(i).to_numpy() for i in range(3))
            edges = [0, *(np.flatnonzero(np.diff(segment)) + 1).tolist(), len(segment)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if segment[a] != now:
                    # A segment begins with the row of its documents.
                    close()
                    now, lengths, ids = segment[a], np.frombuffer(batch.column(5)[a].as_py(), "<i8"), batch.column(6)[a].as_py()
                    a += 1
                if a < b:
                    docs, times = (flat(batch.column(i).slice(a, b - a))[0].view("<i4").copy() for i in (4, 5))
                    held.append((term[a:b], n[a:b], docs, times))
        close()
        part = TaskContext.get().partitionId() % MERGE_PARTS
        out = [(q, part, doc if there else None, -s) for q, b in enumerate(best) for s, there, doc in b.rows]
        columns = list(zip(*out)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int64(), pa.int64()])], ["query", "part", "doc_id", "score"])

    together = rows.unionByName(heads).repartition(partitions(index), "segment").sortWithinPartitions("segment", "number")
    return together.mapInArrow(evaluate, FOUND)


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", lot_bytes: int = LOT_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` documents of each query with a score above 0.

    Equal scores are ranked by ascending id, NULL first. A NULL text has no terms; a document or query without
    terms is in no result. Queries that repeat in id and text are one; repeated documents are ranked each. Empty tables give
    no rows. Lots of queries go to the executors one after the other, each reading its terms in the index.
    """
    spark = docs.sparkSession
    index, found = None, None
    for lot in query_lots(queries, query_id, query_text, lot_bytes):
        index = build_index(docs, id_col, text_col) if index is None else index
        hits = _search_lot(index, lot, top)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
        for keys in (["query", "part"], ["query"]):
            ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
            hits = ranked.drop("rank") if "part" in keys else ranked
        names = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(lot)], "query bigint, item_id bigint")
        # Bounded by the lot.
        named = hits.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
        found = named if found is None else found.unionByName(named)
    if found is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return found
