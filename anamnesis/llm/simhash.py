"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 21 or 22 bits. The perfect Golay code of length
23 gives each segment one or six codeword indices, those of the codewords at most four bits away.
Two segments that differ in at most two bits share an index, because the codeword nearest to a word
between them is at most four bits from both. Of four differing bits three or more can fall into one
segment only, so two segments of any linked pair share an index each: the keys of a fingerprint are
all pairs of indices of two of its segments. Rows that share a key are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.sizes import store
from .graph import components
from .orders import partitions
from .texts import id_and_bytes

SHINGLE = 4
SEED = 42
DISTANCE = 4
SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit, width
#: Rows of one key that one task compares; keys with more are cut into blocks that are compared in pairs.
KEY_ROWS = 20_000
SMALL = 48
COUNTED = 1 << 16

#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GENERATOR = 0b110001110101


def signature(data: bytes) -> int:
    """SimHash of the word shingles of a UTF-8 text, A-Z in lower case."""
    words = data.lower().split()
    if not words:
        return 0
    n = len(words) - SHINGLE + 1
    joined = b" ".join(words)
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, COUNTED):
        bits = np.unpackbits(hashes[at : at + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.int64)
    return int((counts * 2 > n).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed 64-bit number; zero for NULL and wordless texts. ``hashed`` adds ``text_hash``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((signature(x.as_py()) for x in batch.column(1)), np.uint64, batch.num_rows)
            more = batch.columns[2:]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64)), *more], ["doc_id", "fp", "text_hash"][: 2 + len(more)])

    more = [F.xxhash64(text_col).alias("text_hash")] if hashed else []
    return id_and_bytes(docs, id_col, text_col, *more).mapInArrow(sign, "doc_id bigint, fp bigint" + ", text_hash bigint" * hashed)


class Golay:
    """Syndromes, and per syndrome the errors of weight up to three and the five of weight four."""

    def __init__(self) -> None:
        powers = []
        rest = 1
        for _ in range(23):
            powers.append(rest)
            rest <<= 1
            if rest >> 11:
                rest ^= GENERATOR
        self.powers = np.array(powers, np.int64)
        self.leader = np.zeros(2048, np.int64)
        self.weight = np.zeros(2048, np.int64)
        self.fours = np.zeros((2048, 5), np.int64)
        filled = np.zeros(2048, np.int64)
        for weight in range(1, 5):
            for bits in combinations(range(23), weight):
                error = s = 0
                for b in bits:
                    error |= 1 << b
                    s ^= powers[b]
                if weight < 4:
                    self.leader[s], self.weight[s] = error, weight
                elif self.weight[s] == 3:
                    self.fours[s, filled[s]] = error
                    filled[s] += 1

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        out = np.zeros(len(words), np.int64)
        for b in range(23):
            out ^= np.where(words >> b & 1, self.powers[b], 0)
        return out

    def indices(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Six codeword indices a word, and whether the last five are there; an index is the codeword's upper 12 bits."""
        s = self.syndrome(words)
        near = (words ^ self.leader[s])[:, None]
        far = words[:, None] ^ self.fours[s]
        return np.concatenate([near, far], 1) >> 11, self.weight[s] == 3


_golay: list[Golay] = []


def keys_of(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``row, key`` of all fingerprints: for each two segments all pairs of their indices."""
    if not _golay:
        _golay.append(Golay())
    words = prints.view(np.uint64)
    found = [_golay[0].indices((words >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)) for at, width in SEGMENTS]
    rows, keys = [], []
    for pair, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2)):
        (a, more_a), (b, more_b) = found[i], found[j]
        for x in range(6):
            for y in range(6):
                here = np.flatnonzero((more_a if x else True) & (more_b if y else np.ones(len(prints), bool)))
                rows.append(here)
                keys.append(pair << 24 | a[here, x] << 12 | b[here, y])
    return np.concatenate(rows), np.concatenate(keys)


def _links(prints: np.ndarray, sizes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked rows; groups are given by size and first row."""
    prints = prints.view(np.uint64)  # of signed numbers the bits of the absolute value would be counted
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    small = sizes <= SMALL
    row_size = np.repeat(np.where(small, sizes, 0), sizes)
    row_at = np.arange(len(prints)) - np.repeat(firsts, sizes)
    for d in range(1, int(row_size.max(initial=0))):
        i = np.flatnonzero(row_at + d < row_size)
        i = i[np.bitwise_count(prints[i] ^ prints[i + d]) <= DISTANCE]
        left.append(i)
        right.append(i + d)
    for first, size in zip(firsts[~small].tolist(), sizes[~small].tolist()):
        own = prints[first : first + size]
        for at in range(0, size, 512):
            i, j = np.nonzero(np.bitwise_count(own[at : at + 512, None] ^ own[None, at:]) <= DISTANCE)
            keep = j > i
            left.append(first + at + i[keep])
            right.append(first + at + j[keep])
    return np.concatenate(left), np.concatenate(right)


def _least_reachable(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        after = label.copy()
        np.minimum.at(after, left, low)
        np.minimum.at(after, right, low)
        after = after[after]
        if np.array_equal(after, label):
            return label
        label = after


def stars(prints: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows sorted by key: each linked fingerprint with one of its key that it can reach; distinct."""
    firsts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.concatenate([firsts, [len(keys)]]))
    several = np.repeat(sizes > 1, sizes)
    prints, sizes = prints[several], sizes[sizes > 1]
    left, right = _links(prints, sizes, np.cumsum(sizes) - sizes)
    label = _least_reachable(len(prints), left, right)
    moved = np.flatnonzero(label != np.arange(len(prints)))
    pairs = np.unique(np.stack([prints[moved], prints[label[moved]]], 1), axis=0) if len(moved) else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


STARS = "u bigint, v bigint, key bigint"


def _edges(u, v, key=None) -> pa.RecordBatch:
    keys = pa.nulls(len(u), pa.int64()) if key is None else pa.array(key, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), keys], ["u", "v", "key"])


def _compare(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Rows ``key, fp`` sorted by key. Star edges have no key; rows of keys with over ``most`` rows are handed on with theirs."""
    prints, keys = np.zeros(0, np.int64), np.zeros(0, np.int64)
    full = None  # the key whose rows are handed on
    for batch in batches:
        k = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
        p = np.concatenate([prints, batch.column(1).to_numpy(zero_copy_only=False)])
        if full is not None:
            n = int(np.searchsorted(k, full, "right"))
            if n:
                yield _edges(p[:n], p[:n], k[:n])
            k, p = k[n:], p[n:]
            if not len(k):
                keys, prints = k, p
                continue
            full = None
        last = int(np.searchsorted(k, k[-1], "left"))
        done_k, done_p, keys, prints = k[:last], p[:last], k[last:], p[last:]
        if len(keys) > most:
            full = int(keys[0])
            yield _edges(prints, prints, keys)
            keys, prints = keys[:0], prints[:0]
        if len(done_k):
            yield from _whole(done_k, done_p, most)
    if len(keys):
        yield from _whole(keys, prints, most)


def _whole(keys: np.ndarray, prints: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    _, at, sizes = np.unique(keys, return_index=True, return_counts=True)
    big = np.repeat(sizes > most, sizes)
    if big.any():
        yield _edges(prints[big], prints[big], keys[big])
        keys, prints = keys[~big], prints[~big]
    if len(keys):
        yield _edges(*stars(prints, keys))


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one pair of blocks after the other; both blocks together fit in a task."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)))
        k = np.concatenate([x for x, _ in held])
        p = np.concatenate([x for _, x in held])
        last = int(np.searchsorted(k, k[-1], "left"))
        if last:
            yield _edges(*stars(p[:last], k[:last]))
        held = [(k[last:], p[last:])]
    if held:
        yield _edges(*stars(held[0][1], held[0][0]))


def fingerprint_edges(prints: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """Edges ``u, v`` between distinct fingerprints with the components of all links of up to four bits.

    ``prints``: distinct ``fp``. The edges of a key join each linked fingerprint to one that it
    reaches by links, not to all its partners. A key with more than ``key_rows`` rows is cut into blocks, and
    every two of its blocks meet in a task of their own.
    """
    count = partitions(prints)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 4096):
                rows, keys = keys_of(fp[at : at + 4096])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fp[at : at + 4096][rows])], ["key", "fp"])

    keyed = prints.select("fp").mapInArrow(spread, "key bigint, fp bigint")
    met = keyed.repartition(count, "key").sortWithinPartitions("key")
    found = store(met.mapInArrow(lambda batches: _compare(batches, key_rows), STARS), "stars")
    edges = found.where("key is null").select("u", "v")
    over = found.where("key is not null")
    sizes = store(over.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "full_keys")
    if sizes.isEmpty():
        return edges
    blocks = over.join(sizes, "key").withColumn("blocks", F.ceil(F.col("n") * 2 / key_rows).cast("int")).withColumn("b", F.pmod(F.xxhash64("u"), F.col("blocks")))
    paired = blocks.select("u", "key", "b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    paired = paired.select(F.xxhash64("key", F.least("b", "other"), F.greatest("b", "other")).alias("pair"), F.col("u").alias("fp"))
    return edges.unionByName(paired.repartition(count, "pair").sortWithinPartitions("pair").mapInArrow(_compare_blocks, STARS).select("u", "v"))


def _rooted(nodes: DataFrame, key_rows: int = KEY_ROWS) -> DataFrame:
    """``fp, first, root`` of stored distinct fingerprints: the root is the same in a component."""
    roots = components(fingerprint_edges(nodes, key_rows))
    joined = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    return store(joined, "rooted")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_rows: int = KEY_ROWS) -> DataFrame:
    """``doc_id, fingerprint, component_id``: fingerprints linked at up to four bits, components over all links.

    Documents with the same fingerprint are one node. NULL and wordless texts have fingerprint zero
    and are linked like others. Repeated rows give repeated results; a component of NULL ids only
    has a NULL ``component_id``.
    """
    signed = store(signatures(docs, id_col, text_col), "signatures")
    nodes = store(signed.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    joined = _rooted(nodes, key_rows)
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = joined.join(least, "root").select("fp", "component_id")
    return signed.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without near copies: of each component the row with the smallest id stays, once.

    Of rows with that id the one with the least text hash is taken, among those of the component only.
    Rows with a NULL id cannot be told apart by id and all stay.
    """
    signed = signatures(docs.where(F.col(id_col).isNotNull()), id_col, text_col, hashed=True)
    nodes = store(signed.groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")), "nodes")
    chosen = _rooted(nodes).groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_kept"), F.col("first.text_hash").alias("_kept_text"))
    # The columns of the input go into one struct, so none of their names can clash.
    whole = F.struct(*[F.col(c) for c in docs.columns])
    held = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text_col).alias("text_hash"), whole.alias("row"))
    kept = held.join(chosen, (F.col("id") == F.col("_kept")) & (F.col("text_hash") == F.col("_kept_text")), "left_semi")
    # Of repeated rows one, whichever; each task folds its own first.
    one = kept.groupBy("id", "text_hash").agg(F.first("row").alias("row"))
    # The row of a NULL id is told by its id alone.
    return one.select("row.*").unionByName(docs.where(F.col(id_col).isNull()))
