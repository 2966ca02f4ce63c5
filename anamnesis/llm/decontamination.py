"""Benchmark decontamination: passages as queries to a BM25 index of test items, pruned by block maxima.

Every passage of every document is a query. The items of an index stand in blocks; for each term
and block the index knows the largest share of an item's own full score that the term can give.
Passages whose block maxima stay below the threshold are passed over, block by block, as in
block-max WAND; only the others meet single items. What is retrieved is verified: enough
word triples of the item's question and of its answer must stand in the passage.

Passages are as long as two of the longest item of the benchmark and overlap by half, so an item that is
copied whole lies whole in a passage. Items are indexed in lots of a bounded size; a lot is one pass,
and what is found does not depend on the lots.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.sizes import store
from .texts import ragged, utf8

K1, B = 1.2, 0.75
#: Share of an item's own score, of its question's and of its answer's word triples.
THRESHOLD, QUESTION, ANSWER = 0.5, 0.5, 0.5
BLOCK_ITEMS = 8
#: Bytes of item texts in one index; it goes to the executors.
LOT_BYTES = 4 * 1024 * 1024
GRAM = 3
ANSWER_SHARE = 1 / 3
SLICE_BYTES = 1 << 20

#: Signs become blanks, A-Z lower case; other bytes stay.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

FOUND = "doc_id bigint, item_id bigint, score double, question_overlap double, answer_overlap double"


def words(data: bytes) -> list[bytes]:
    return data.translate(_WORDS).split()


def grams(terms: list[bytes], size: int = GRAM) -> set[tuple[bytes, ...]]:
    """Runs of ``size`` words."""
    return {tuple(terms[i : i + size]) for i in range(len(terms) - size + 1)}


def overlap(part: list[bytes], passage: list[bytes]) -> float:
    """Share of the part's word triples that stand in the passage; a shorter part is one gram, an empty one is always there."""
    if not part:
        return 1.0
    size = min(GRAM, len(part))
    own = grams(part, size)
    return len(own & grams(passage, size)) / len(own)


class Index:
    """Postings of a lot of items, scores as shares of each item's own."""

    def __init__(self, items: list[tuple[int, list[bytes], list[bytes]]], frequency: dict[bytes, int], n_items: int, mean_length: float, longest: int) -> None:
        """items: id, question words, answer words; frequency: items of the whole benchmark with the term; longest: words of its longest item."""
        items = sorted(items, key=lambda x: (len(x[1]) + len(x[2]), x[0]))  # blocks of about equal lengths have tight maxima
        self.ids = [i for i, _, _ in items]
        self.parts = [(q, a) for _, q, a in items]
        self.longest = longest
        self.blocks = -(-len(items) // BLOCK_ITEMS)
        postings: dict[bytes, list[tuple[int, float]]] = {}
        for k, (_, question, answer) in enumerate(items):
            terms = question + answer
            norm = K1 * (1 - B + B * len(terms) / mean_length)
            scores = {t: np.log(1 + (n_items - frequency[t] + 0.5) / (frequency[t] + 0.5)) * n * (K1 + 1) / (n + norm) for t, n in Counter(terms).items()}
            own = sum(scores.values())
            for t, s in scores.items():
                postings.setdefault(t, []).append((k, s / own))
        self.term_of = {t: i for i, t in enumerate(postings)}
        lists = list(postings.values())
        self.size = np.array([len(p) for p in lists], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.item = np.array([k for p in lists for k, _ in p], np.int64)
        self.share = np.array([s for p in lists for _, s in p])
        term = np.repeat(np.arange(len(lists)), self.size)
        cell, first = np.unique(term * self.blocks + self.item // BLOCK_ITEMS, return_index=True)
        self.block_share = np.maximum.reduceat(self.share, first)
        self.block = cell % self.blocks
        self.block_size = np.bincount(cell // self.blocks, minlength=len(lists))
        self.block_at = np.cumsum(self.block_size) - self.block_size
        self.most = np.maximum.reduceat(self.block_share, self.block_at)

    def retrieve(self, passage: np.ndarray, term: np.ndarray, passages: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Passage, item and score of all pairs at or over the threshold; the input has each term of a passage once."""
        bound = np.bincount(passage, self.most[term], passages)
        live = bound[passage] >= threshold
        passage, term = passage[live], term[live]
        # Bounds of blocks: passages whose terms together reach the threshold in no block are through.
        where = ragged(self.block_at[term], self.block_size[term])
        cell, inverse = np.unique(np.repeat(passage, self.block_size[term]) * self.blocks + self.block[where], return_inverse=True)
        open_ = np.bincount(inverse, self.block_share[where], len(cell)) >= threshold - 1e-9
        cell = cell[open_]
        live = np.isin(passage, cell // self.blocks)
        passage, term = passage[live], term[live]
        where = ragged(self.at[term], self.size[term])
        passage = np.repeat(passage, self.size[term])
        item = self.item[where]
        inside = np.isin(passage * self.blocks + item // BLOCK_ITEMS, cell)
        pair, inverse = np.unique(passage[inside] * len(self.ids) + item[inside], return_inverse=True)
        score = np.bincount(inverse, self.share[where][inside], len(pair))
        hit = score >= threshold - 1e-9
        return pair[hit] // len(self.ids), pair[hit] % len(self.ids), score[hit]

    def search(self, texts: list[bytes], threshold: float = THRESHOLD, question: float = QUESTION, answer: float = ANSWER) -> list[tuple[int, int, float, float, float]]:
        """Text number, item id, best score and overlaps of every verified pair of text and item."""
        split = [words(t) for t in texts]
        counts = np.array([len(w) for w in split], np.int64)
        half = self.longest
        halves = np.maximum(1, -(-counts // half))
        passages = np.maximum(1, halves - 1)
        first_passage = np.cumsum(passages) - passages
        total = int(passages.sum())
        which = np.repeat(np.arange(len(texts)), counts)
        term = np.fromiter((x for w in split for x in map(self.term_of.get, w, repeat(-1))), np.int64, int(counts.sum()))
        position = np.arange(len(term)) - np.repeat(np.cumsum(counts) - counts, counts)
        known = term >= 0
        which, term, chunk = which[known], term[known], position[known] // half
        keys = []
        for back in (0, 1):  # a half belongs to the passage that it begins and to the one before
            p = chunk - back
            inside = (p >= 0) & (p < passages[which])
            keys.append((first_passage[which] + p)[inside] * len(self.term_of) + term[inside])
        key = np.unique(np.concatenate(keys))
        passage, item, score = self.retrieve(key // len(self.term_of), key % len(self.term_of), total, threshold)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for p, k, s in zip(passage.tolist(), item.tolist(), score.tolist()):
            text = int(np.searchsorted(first_passage, p, "right")) - 1
            begin = (p - int(first_passage[text])) * half
            there = split[text][begin : begin + 2 * half]
            q, a = (overlap(part, there) for part in self.parts[k])
            if q >= question and a >= answer:
                pair = text, self.ids[k]
                best[pair] = max(best.get(pair, (0.0, 0.0, 0.0)), (s, q, a))
        return [(t, i, *v) for (t, i), v in sorted(best.items())]


def halves_of(terms: list[bytes]) -> tuple[list[bytes], list[bytes]]:
    """Question and answer of an item without separate columns: the last third of its words is the answer."""
    cut = len(terms) - int(len(terms) * ANSWER_SHARE)
    return terms[:cut], terms[cut:]


def item_lots(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", answer_col: str | None = None, lot_bytes: int = LOT_BYTES) -> Iterator[Index]:
    """Indexes over all items, each of items with at most ``lot_bytes`` of text (one item at least).

    ``text_col`` holds the question, or question and answer where no ``answer_col`` is named. Items
    without words are left out, a NULL answer is empty. Items come to the driver lot by lot, with the
    frequencies of the lot's terms; the counts that BM25 needs are those of all items, made by the executors.
    """
    answer = F.coalesce(F.col(answer_col).cast("binary"), F.lit(b"")) if answer_col else F.lit(b"")
    rows = benchmark.select(F.col(id_col).cast("bigint").alias("id"), utf8(text_col).alias("q"), answer.alias("a"))

    def parsed(q: bytes, a: bytes) -> tuple[list[bytes], list[bytes]]:
        return (words(q), words(a)) if answer_col else halves_of(words(q))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each item's terms, and its length beside a NULL."""
        for batch in batches:
            for q, a in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                both = [t for part in parsed(q, a) for t in part]
                if both:
                    own = [None, *{*both}]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array([len(both)] * len(own), pa.int64())], ["term", "length"])

    counted = rows.select("q", "a").mapInArrow(terms, "term binary, length bigint").groupBy("term")
    counts = store(counted.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total"), F.max("length").alias("longest")), "item_terms")
    whole = counts.where("term is null").first()
    if whole is None:
        return

    def index(lot: list[tuple[int, list[bytes], list[bytes]]]) -> Index:
        own = pa.table({"term": pa.array(list({t for _, q, a in lot for t in (*q, *a)}), pa.binary())})
        found = counts.join(F.broadcast(benchmark.sparkSession.createDataFrame(own)), "term").select("term", "n").toArrow()
        frequency = dict(zip(found["term"].to_pylist(), found["n"].to_pylist()))
        return Index(lot, frequency, whole["n"], whole["total"] / whole["n"], whole["longest"])

    lot: list[tuple[int, list[bytes], list[bytes]]] = []
    size = 0
    for r in rows.orderBy("id").toLocalIterator():
        question, reply = parsed(bytes(r["q"]), bytes(r["a"]))
        if not question and not reply:
            continue
        if lot and size + len(r["q"]) + len(r["a"]) > lot_bytes:
            yield index(lot)
            lot, size = [], 0
        lot.append((r["id"], question, reply))
        size += len(r["q"]) + len(r["a"])
    yield index(lot)


def _slices(data: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(data):
        end, size = at + 1, len(data[at])
        while end < len(data) and size + len(data[end]) <= SLICE_BYTES:
            size += len(data[end])
            end += 1
        yield at, end
        at = end


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", answer_col: str | None = None, threshold: float = THRESHOLD, lot_bytes: int = LOT_BYTES) -> DataFrame:
    """``doc_id, item_id, score, question_overlap, answer_overlap``: documents with a passage that gives away an item.

    The score is the largest share of the item's own BM25 score over the document's passages. NULL
    and empty texts match nothing; an empty benchmark gives no rows. Repeated rows are searched each. Documents are not shuffled.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(text_col).alias("data"))
    found = rows.select("doc_id").where(F.lit(False)).selectExpr("doc_id", "cast(null as bigint) item_id", "0D score", "0D question_overlap", "0D answer_overlap")
    for i, index in enumerate(item_lots(benchmark, item_id, item_text, answer_col, lot_bytes)):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        del index  # the broadcast is in a file; the driver holds one lot at a time

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for at, end in _slices(data):
                    hits = shared.value.search(data[at:end], threshold)
                    columns = list(zip(*[(ids[at + t], *rest) for t, *rest in hits])) or [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 2 + [pa.float64()] * 3)], ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        hits = rows.mapInArrow(search, FOUND)
        found = hits if i == 0 else found.unionByName(hits)
    return found


def clean_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The documents in which no passage gives away an item; all columns stay. Documents are not shuffled."""
    for index in item_lots(benchmark, **options):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        del index
        place = docs.columns.index(text_col)

        def keep(batches: Iterator[pa.RecordBatch], shared=shared, place=place) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data = [(t or "").encode() for t in batch.column(place).to_pylist()]
                bad = np.zeros(len(data), bool)
                for at, end in _slices(data):
                    bad[[at + t for t, *_ in shared.value.search(data[at:end])]] = True
                yield batch.filter(pa.array(~bad))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
