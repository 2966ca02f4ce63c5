"""Token sequences of a fixed size, packed in document order by dynamic programming.

The tokens of all documents stand one after the other, in ascending order of ids. A stretch of
them is cut into windows of at most ``WINDOW`` tokens. A window costs what it is padded by, or
``SHORT`` where its length is a power of two and it is left as it is; a cut costs nothing at the end of a
document, ``SENTENCE`` at the end of a sentence and ``INNER`` elsewhere (each in tokens). The cuts of a
stretch have the least sum of costs over all choices from its candidates: the ends of documents and
sentences, every ``STEP``-th token where no sentence ends for long, and every one of the last ``WINDOW`` tokens.

The least cost up to a cut is the least of (cost + position) among the cuts in reach, which a monotone
queue holds at its head, and of the few cuts a power of two before.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.sizes import store
from .orders import partitions
from .texts import flat
from .token_store import dealt_ids, encoder

WINDOW = 4096
SHORT, SENTENCE, INNER = 64, 8, 64
END_ID = 2
#: Where no sentence ends for LONG tokens, every STEP-th is a candidate.
LONG, STEP = 64, 16
#: Tokens that are cut together, in whole documents; the last may make them more.
STRETCH = 1 << 20
#: Documents of a bucket, at least: each bucket ends with a window that may be short.
BUCKET_DOCS = 1000

PIECES = "_bucket int, doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, _local bigint, offset bigint"


def sentence_ends(tokenizer: str) -> np.ndarray:
    """True for the ids of vocabulary entries that end a word with a full stop, a question or exclamation mark, closing signs aside."""
    model = json.loads(encoder(tokenizer).tokenizer.to_str())["model"]
    suffix = model["end_of_word_suffix"] or ""
    out = np.zeros(max(model["vocab"].values()) + 1, bool)
    for piece, i in model["vocab"].items():
        out[i] = piece.endswith(suffix) and piece.removesuffix(suffix).rstrip("\"')]").endswith((".", "!", "?"))
    return out


def candidates(ids: np.ndarray, ends: np.ndarray, enders: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stretch may be cut, ascending from 0 to its end, and what a cut there costs."""
    cost = np.full(len(ids) + 1, -1, np.int64)
    known = ids < len(enders)
    stops = np.flatnonzero(known)[enders[ids[known]]] + 1
    bounds = np.unique(np.concatenate([[0], stops, ends]))
    long, step = min(LONG, window), min(STEP, window)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > long:
            cost[a + step : b : step] = INNER
    cost[max(1, len(ids) - window) :] = INNER
    cost[stops] = SENTENCE
    cost[ends] = cost[0] = 0
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def choose_cuts(at: np.ndarray, penalty: np.ndarray, window: int = WINDOW, short: int = SHORT) -> np.ndarray:
    """Ends of the windows of least cost; ``at`` rises from 0 in steps of at most ``window``."""
    place = np.full(int(at[-1]) + 1, -1, np.int64)
    place[at] = np.arange(len(at))
    later, earlier = [], []
    size = 1
    while size < window:
        reach = int(np.searchsorted(at, size))
        found = place[at[reach:] - size]
        hit = np.flatnonzero(found >= 0)
        later.append(hit + reach)
        earlier.append(found[hit])
        size *= 2
    later = np.concatenate([*later, np.zeros(0, np.int64)])
    order = np.argsort(later, kind="stable")
    jumps = np.concatenate([*earlier, np.zeros(0, np.int64)])[order].astype(np.int64).tolist()
    last = np.searchsorted(later[order], np.arange(len(at)), "right").tolist()
    position = at.tolist()
    least, back = [0], [0]
    queue, places, keys, head, used = [0], [0], [0], 0, last[0]  # candidates in reach with rising cost + position
    for j, (here, cost, stop) in enumerate(zip(position[1:], penalty[1:].tolist(), last[1:]), 1):
        limit = here - window
        while places[head] < limit:
            head += 1
        best, origin = keys[head] - limit, queue[head]
        if used < stop:
            for i in jumps[used:stop]:
                if least[i] + short < best:
                    best, origin = least[i] + short, i
            used = stop
        best += cost
        least.append(best)
        back.append(origin)
        key = best + here
        while len(keys) > head and keys[-1] > key:
            keys.pop()
            queue.pop()
            places.pop()
        keys.append(key)
        queue.append(j)
        places.append(here)
    cuts, j = [], len(position) - 1
    while j:
        cuts.append(position[j])
        j = back[j]
    return np.array(cuts[::-1], np.int64)


def pieces(ids: np.ndarray, ends: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Document, start in it, length, window and offset in it of each run of ids that neither a document's end nor a cut divides."""
    edges = np.unique(np.concatenate([ends, cuts]))
    begin = np.concatenate([[0], edges[:-1]])
    doc = np.searchsorted(ends, begin, "right")
    sequence = np.searchsorted(cuts, begin, "right")
    first = np.concatenate([[0], ends])[doc]
    opened = np.concatenate([[0], cuts])[sequence]
    return doc, begin - first, edges - begin, sequence, begin - opened


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` of every piece of every document.

    A document is the ids of its whole text and the end id; a NULL text is empty. Sequences are numbered from 0 in document
    order; NULL ids come first, repeated rows are documents of their own, those of one id in order of their token ids.
    Texts are encoded where they are read, and the ids dealt once, to buckets of neighbouring documents;
    buckets are cut stretch by stretch, so a task holds one stretch (or one document, if that is longer). The
    driver sees one number a bucket.
    """
    width = encoder(tokenizer).width
    enders = sentence_ends(tokenizer)
    buckets = max(1, min(partitions(docs), docs.count() // BUCKET_DOCS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, sequences, held, ids_held, total = None, 0, [], [], 0

        def packed() -> pa.RecordBatch:
            nonlocal sequences, held, ids_held, total
            ids = np.concatenate(ids_held)
            doc_ids = pa.concat_arrays([d for d, _ in held])
            sizes = np.concatenate([n for _, n in held])
            ends = np.cumsum(sizes)
            cuts = choose_cuts(*candidates(ids, ends, enders, window), window)
            doc, start, length, sequence, offset = pieces(ids, ends, cuts)
            words, at = ids.astype("<u4"), np.cumsum(length) - length
            crc = [zlib.crc32(words[a:b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            columns = [pa.array(np.full(len(doc), bucket, np.int32)), doc_ids.take(pa.array(doc)), *map(pa.array, (start, length)), pa.array(crc, pa.int64()), *map(pa.array, (sizes[doc], sequences + sequence, offset))]
            sequences += len(cuts)
            held, ids_held, total = [], [], 0
            return pa.RecordBatch.from_arrays(columns, ["_bucket", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "_local", "offset"])

        for batch in batches:
            data, offsets = flat(batch.column(2))
            ids, offsets = data.view(f"<u{width}"), offsets // width
            numbers, at = batch.column(0).to_numpy(), 0
            while at < len(numbers):
                if bucket is not None and numbers[at] != bucket:
                    if held:
                        yield packed()
                    sequences = 0
                bucket = int(numbers[at])
                end = at + int(np.searchsorted(numbers[at:], bucket, "right"))
                end = min(end, max(at + 1, int(np.searchsorted(offsets, offsets[at] + STRETCH - total, "left"))))
                held.append((batch.column(1).slice(at, end - at), np.diff(offsets[at : end + 1])))
                ids_held.append(ids[offsets[at] : offsets[end]].copy())
                total += int(offsets[end] - offsets[at])
                if total >= STRETCH:
                    yield packed()
                at = end
        if held:
            yield packed()

    ordered = dealt_ids(docs, lambda text: encoder(tokenizer).encode(text), width, end_id, id_col, text_col, buckets, spread=True)
    found = store(ordered.mapInArrow(cut, PIECES), "pieces")
    counts = sorted((r["_bucket"], r["n"]) for r in found.groupBy("_bucket").agg((F.max("_local") + 1).alias("n")).collect())
    firsts, total = [], 0
    for bucket, n in counts:
        firsts.append((bucket, total))
        total += n
    # One row a bucket.
    named = F.broadcast(docs.sparkSession.createDataFrame(firsts, "_bucket int, _first bigint"))
    return found.join(named, "_bucket").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("_first") + F.col("_local")).alias("sequence_id"), "offset")
