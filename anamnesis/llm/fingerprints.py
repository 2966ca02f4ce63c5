"""Document fingerprints: quartile bucket digests.

Every window of five bytes gives six byte triplets, each hashed to one of ``BUCKETS`` counters. A
bucket is coded by the quartile of all counts that its own count falls in; the logarithm of the
length and the ratios of the quartiles complete the digest. Two digests are compared by a sum of
code, ratio and length differences that is cut off at ``BOUND`` and scaled to a likeness of 0 to 1.

A text of under five bytes has no triplets: its digest is its length alone. Equal texts have equal
digests, so two empty texts have likeness 1.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .orders import with_followers
from .texts import SLICE_BYTES

BUCKETS = 256
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 1, 4), (0, 2, 3), (0, 2, 4), (0, 3, 4))
WINDOW = 5
#: Bytes counted at a time.
STRETCH = 1 << 17
LENGTH_BASE = 1.1
LENGTH_WEIGHT = 2
#: Difference of two quartile codes; opposite ends weigh double.
STEP = np.array([[abs(a - b) if abs(a - b) < 3 else 6 for b in range(4)] for a in range(4)], np.int64)
#: Differences of this size and more count as no likeness at all.
BOUND = 400

SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _byte_tables() -> np.ndarray:
    state = np.random.Generator(np.random.PCG64(20_240_601))
    return state.integers(0, 1 << 32, (3, 256), dtype=np.uint32)


_TABLES = _byte_tables()


def triplet_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed triplets, one row of ``BUCKETS`` per text; the bytes are counted in short stretches."""
    n = len(texts)
    counts = np.zeros(n * BUCKETS, np.int64)
    at = 0
    while at < n:
        end, size = at + 1, len(texts[at])
        while end < n and size + len(texts[end]) <= STRETCH:
            size += len(texts[end])
            end += 1
        data = np.frombuffer(b"".join(texts[at:end]), np.uint8)
        row = np.repeat(np.arange(end - at, dtype=np.int32), [len(t) for t in texts[at:end]])
        for first in range(0, max(0, size - WINDOW + 1), STRETCH):
            last = min(size, first + STRETCH + WINDOW - 1)
            _count(data[first:last], row[first:last], counts[at * BUCKETS : end * BUCKETS])
        at = end
    return counts.reshape(n, BUCKETS)


def _count(data: np.ndarray, row: np.ndarray, counts: np.ndarray) -> None:
    windows = len(data) - WINDOW + 1
    base = (row[:windows] * BUCKETS).astype(np.int64)
    across = np.flatnonzero(row[:windows] != row[WINDOW - 1 :])  # windows that reach into the next text: counted, then taken off
    hashed = [table[data] for table in _TABLES]
    for salt, (i, j, k) in enumerate(TRIPLETS):
        mixed = hashed[0][i : i + windows] + hashed[1][j : j + windows]
        mixed += hashed[2][k : k + windows]
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D + 2 * salt)
        mixed >>= np.uint32(24)
        key = base + mixed
        counts += np.bincount(key, minlength=len(counts))
        counts -= np.bincount(key[across], minlength=len(counts))


def digests(texts: list[bytes]) -> np.ndarray:
    """One row per text: length code, two quartile ratios, and the bucket codes."""
    out = np.zeros((len(texts), 3 + BUCKETS), np.int64)
    if not texts:
        return out
    counts = triplet_counts(texts)
    ranked = np.sort(counts, axis=1)
    q1, q2, q3 = (ranked[:, BUCKETS * i // 4 - 1] for i in (1, 2, 3))
    lengths = np.array([len(t) for t in texts], np.float64)
    out[:, 0] = np.minimum(255, np.floor(np.log1p(lengths) / np.log(LENGTH_BASE)))
    top = np.maximum(q3, 1)
    out[:, 1] = (q1 * 15) // top
    out[:, 2] = (q2 * 15) // top
    for q in (q1, q2, q3):
        out[:, 3:] += counts > q[:, None]
    return out


def encode(digest: np.ndarray) -> str:
    """Hexadecimal form: length (2), ratios (2), codes (two bits each)."""
    codes = digest[3:].reshape(-1, 4)
    packed = (codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]).astype(np.uint8)
    return f"{digest[0]:02x}{digest[1]:x}{digest[2]:x}{packed.tobytes().hex()}"


def decode(fingerprint: str) -> np.ndarray:
    packed = np.frombuffer(bytes.fromhex(fingerprint[4:]), np.uint8).astype(np.int64)
    codes = np.stack([packed >> 6, packed >> 4 & 3, packed >> 2 & 3, packed & 3], 1).ravel()
    return np.concatenate([[int(fingerprint[:2], 16), int(fingerprint[2], 16), int(fingerprint[3], 16)], codes])


def differences(a: np.ndarray, b: np.ndarray, bound: int = BOUND) -> np.ndarray:
    """Bounded difference scores of the digests in two arrays, row by row."""
    length = np.abs(a[:, 0] - b[:, 0]) * LENGTH_WEIGHT
    ratios = np.abs(a[:, 1:3] - b[:, 1:3]).sum(1)
    return np.minimum(bound, length + ratios + STEP[a[:, 3:], b[:, 3:]].sum(1))


def likeness(a: np.ndarray, b: np.ndarray, bound: int = BOUND) -> np.ndarray:
    return 1.0 - differences(a, b, bound) / bound


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, fingerprint`` of every text. One pass, no shuffle."""
    from .texts import id_and_bytes, slices

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = part.column(1).to_pylist()
                prints = [encode(d) for d in digests(texts)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(prints, pa.string())], ["doc_id", "n_bytes", "fingerprint"])

    return id_and_bytes(docs, id_col, text_col).mapInArrow(add, "doc_id bigint, n_bytes bigint, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _compared(pairs: list[tuple[int, str, str]]) -> pa.RecordBatch:
    """pairs: id, text, next text; all of them neighbours in order."""
    own = [t.encode() for _, t, _ in pairs]
    following = [t.encode() for _, _, t in pairs]
    changed = [edited(t, f).encode() for _, t, f in pairs]
    # Texts in the list are mostly each other's followers: only those that are not get a digest of their own.
    of_own = digests(own)
    alone = [i for i in range(len(pairs)) if i + 1 == len(pairs) or following[i] != own[i + 1]]
    of_next = np.concatenate([of_own[1:], of_own[:1]])
    of_next[alone] = digests([following[i] for i in alone])
    of_edited = digests(changed)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([i for i, _, _ in pairs], pa.int64()),
            pa.array([len(t) for _, t, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
            pa.array([encode(d) for d in of_own], pa.string()),
            pa.array([encode(d) for d in of_edited], pa.string()),
            pa.array(likeness(of_own, of_edited)),
            pa.array(likeness(of_own, of_next)),
        ],
        ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order; a row is ready when the next one of its bucket has come."""
    before: tuple[int, int, str] | None = None  # bucket, id, text
    ready: list[tuple[int, str, str]] = []
    size = 0
    for batch in batches:
        for doc_id, text, bucket, after in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            text = text or ""
            if before is not None and before[0] == bucket:
                ready.append((before[1], before[2], text))
                size += len(before[2]) + len(text)
            before = None if after else (bucket, doc_id, text)
            if size >= SLICE_BYTES:
                yield _compared(ready)
                ready, size = [], 0
    if ready:
        yield _compared(ready)


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited form, and their likeness to it and to the next document.

    The next document is the one with the next larger id, for the last one the first; with equal
    ids the order is by text, NULL ids come first, and a NULL text is empty. Texts are shuffled
    once, to buckets of neighbouring ids; a task streams through them and holds two texts.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ordered = with_followers(texts).select("doc_id", "text", "_bucket", "_after")
    return ordered.mapInArrow(_walk, SCHEMA)
