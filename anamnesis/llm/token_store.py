"""Token-id files: canonical length-limited Huffman codes in blocks that are read on their own.

A file is a folder with two tables. ``codes`` has the code length of every id that occurs; the codes
follow from the lengths (canonical order), which come from the counts of all documents. ``blocks``
has the coded documents: a block holds whole documents, and its checkpoints name the bit at which
every ``CHECKPOINT``-th id begins, so all stretches between them are decoded side by side by table
look-ups.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.sizes import store
from ..session import scratch_path
from .kept import Kept
from .orders import id_buckets, partitions, spread_buckets
from .texts import flat, ragged

END_ID = 1
MAX_BITS = 18
BLOCK_IDS = 1 << 16
CHECKPOINT = 128


class WordEncoder:
    """Ids of whole texts by the tokenizers library, asked once for each distinct part.

    A text of plain letters, digits, signs and blanks is cut where the tokenizer's own pattern cuts it, and the
    parts go to the model alone. Any other text is cut at blanks, which the tokenizer drops before it merges;
    its plain stretches go the same way, every other stretch through the whole tokenizer. Files whose normaliser
    or pattern differs from those built in here are refused.
    """

    PLAIN = re.compile(r"[\n\t\r -~À-ÖØ-öø-ÿ]*")
    PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
    #: The settings that PLAIN and PARTS stand for.
    NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
    PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        settings = json.loads(self.tokenizer.to_str())
        cuts = settings["pre_tokenizer"]["pretokenizers"][0] if (settings["pre_tokenizer"] or {}).get("type") == "Sequence" else {}
        if (settings["normalizer"] or {}).get("normalizers") != self.NORMALIZERS or cuts.get("pattern") != {"Regex": self.PATTERN}:
            raise ValueError(f"{path}: not a word tokenizer with the settings that are built in here")
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.width = array(self.code).itemsize
        self.bytewise = _byte_letters()
        self.known, self.parts = Kept(self._stretch), Kept(self._part)

    def _bytes(self, ids: list[int]) -> bytes:
        values = array(self.code, ids)
        if sys.byteorder == "big":
            values.byteswap()
        return values.tobytes()

    def _part(self, part: str) -> bytes:
        letters = part if part.isascii() else "".join([self.bytewise[b] for b in part.encode()])
        return self._bytes([t.id for t in self.tokenizer.model.tokenize(letters)])

    def _stretch(self, stretch: str) -> bytes:
        if self.PLAIN.fullmatch(stretch) and "<|" not in stretch:
            return b"".join(map(self.parts.__getitem__, self.PARTS.findall(stretch.lower())))
        return self._bytes(self.tokenizer.encode(stretch, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """Little-endian ids."""
        self.known.trim()
        self.parts.trim()
        if self.PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.parts.__getitem__, self.PARTS.findall(text.lower())))
        for c in "\n\t\r":
            text = text.replace(c, " ")
        return b"".join(map(self.known.__getitem__, text.split(" ")))


def _byte_letters() -> list[str]:
    """The letter that byte-level tokenizers write for each byte: visible ones stand for themselves, the rest follow from U+0100."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code with at most ``limit`` bits (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    n = len(used)
    if n > 1 << limit:
        raise ValueError(f"{n} ids need more than {limit} bits")
    if n < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    merged, levels = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        rank = np.argsort(both, kind="stable")
        merged = both[rank]
        levels.append(rank < n)
    taken = 2 * n - 2
    for is_leaf in reversed(levels):
        leaf = int(is_leaf[:taken].sum())
        lengths[order[:leaf]] += 1
        taken = 2 * (taken - leaf)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    codes = np.zeros(len(lengths), np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if not len(order):
        return codes
    sorted_lengths = lengths[order]
    longest = int(sorted_lengths[-1])
    step = np.left_shift(1, longest - sorted_lengths)
    codes[order] = (np.cumsum(step) - step) >> (longest - sorted_lengths)
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of the ids, first bit highest, and the bit offsets of every ``CHECKPOINT``-th id."""
    size = lengths[ids]
    ends = np.cumsum(size)
    at = ends - size
    word = codes[ids] << (32 - size - (at & 7))
    byte = at >> 3
    total = (int(ends[-1]) + 7 >> 3) + 4 if len(ids) else 4
    out = np.zeros(total, np.int64)
    for i in range(4):
        out += np.bincount(byte + i, word >> (24 - 8 * i) & 255, total).astype(np.int64)
    return out.astype(np.uint8).tobytes(), at[::CHECKPOINT]


class Decoder:
    """Look-up table from the next ``bits`` bits to id and length."""

    def __init__(self, lengths: np.ndarray) -> None:
        codes = canonical_codes(lengths)
        used = np.flatnonzero(lengths)
        self.bits = int(lengths.max(initial=1))
        self.id = np.zeros(1 << self.bits, np.int64)
        self.length = np.ones(1 << self.bits, np.int64)
        width = np.left_shift(1, self.bits - lengths[used])
        at = ragged(codes[used] << (self.bits - lengths[used]), width)
        self.id[at] = np.repeat(used, width)
        self.length[at] = np.repeat(lengths[used], width)

    def unpack(self, blocks: list[tuple[bytes, np.ndarray, int]]) -> list[np.ndarray]:
        """Ids of blocks (bits, checkpoints, number of ids); all stretches of all blocks advance together."""
        data = np.concatenate([np.frombuffer(b, np.uint8) for b, _, _ in blocks]).astype(np.uint32)
        words = np.zeros(len(data), np.uint32)
        for i in range(4):
            words[: len(data) - i] |= data[i:] << np.uint32(24 - 8 * i)
        first = np.cumsum([0] + [len(b) for b, _, _ in blocks])[:-1]
        at = np.concatenate([np.asarray(c, np.int64) + 8 * f for (_, c, _), f in zip(blocks, first.tolist())])
        todo = np.concatenate([np.minimum(CHECKPOINT, n - CHECKPOINT * np.arange(len(c))) for _, c, n in blocks])
        out = np.zeros((len(at), CHECKPOINT), np.int64)
        mask, shift = (1 << self.bits) - 1, 32 - self.bits
        lanes = np.argsort(-todo, kind="stable")
        at, left = at[lanes], todo[lanes]
        rows = np.zeros((CHECKPOINT, len(at)), np.int64)
        for k in range(CHECKPOINT):
            live = int(np.searchsorted(-left, -k, "left"))  # lanes with more than k ids
            if not live:
                break
            p = at[:live]
            peek = (words[p >> 3].astype(np.int64) >> (shift - (p & 7))) & mask if shift >= 7 else ((words[p >> 3].astype(np.int64) << 8 | data[(p >> 3) + 4]) >> (shift + 8 - (p & 7))) & mask
            rows[k, :live] = self.id[peek]
            at[:live] = p + self.length[peek]
        out[lanes] = rows.T
        result, lane = [], 0
        for _, c, n in blocks:
            result.append(out[lane : lane + len(c)].ravel()[:n])
            lane += len(c)
        return result


#: Rows without ``before`` end a bucket: ``n`` is its number of ids, ``ids`` its sparse counts.
IDS = "_bucket int, doc_id bigint, before bigint, n bigint, ids binary"
BLOCKS = "start bigint, n_ids bigint, doc_ids array<bigint>, doc_lengths array<bigint>, checkpoints array<bigint>, bits binary"
COUNT = np.dtype([("id", "<i4"), ("n", "<i8")])


def dealt_ids(
    docs: DataFrame, encode: Callable[[str], bytes], width: int, end_id: int, id_col: str, text_col: str, buckets: int | None = None, spread: bool = False
) -> DataFrame:
    """``_bucket, doc_id, ids``: buckets of ascending ids, each in one partition and in order of id and token ids; a NULL text is empty.

    With ``spread`` the rows of an id that fills several buckets are dealt among them by a hash of their texts.
    """
    count = buckets or partitions(docs)
    end = int(end_id).to_bytes(width, "little")

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [encode(t or "") + end for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(ids, pa.binary())], ["_bucket", "doc_id", "ids"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    bucketed = spread_buckets(texts, "doc_id", F.col("text"), count) if spread else id_buckets(texts, "doc_id", count)
    dealt = bucketed.select("_bucket", "doc_id", "text").mapInArrow(ids_of, "_bucket int, doc_id bigint, ids binary")
    return dealt.repartitionById(count, F.col("_bucket")).sortWithinPartitions("_bucket", "doc_id", "ids")


def encoded_in_order(docs: DataFrame, encode: Callable[[str], bytes], width: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, before, n, ids`` in buckets of ascending ids; ``before`` counts the ids of the bucket's earlier documents.

    After the documents of a bucket comes a row with its sum and its counts of ids, so nothing is read again to count.
    """

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, total, counts = None, 0, np.zeros(1 << 8 * min(width, 2), np.int64)

        def summed() -> pa.RecordBatch:
            used = np.flatnonzero(counts)
            sparse = np.zeros(len(used), COUNT)
            sparse["id"], sparse["n"] = used, counts[used]
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([total], pa.int64()), pa.array([sparse.tobytes()], pa.binary())], names)

        names = ["_bucket", "doc_id", "before", "n", "ids"]
        for batch in batches:
            data, offsets = flat(batch.column(2))
            ids = data.view(f"<u{width}")
            buckets = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if bucket is not None and buckets[a] != bucket:
                    yield summed()
                    total, counts = 0, np.zeros_like(counts)
                bucket = int(buckets[a])
                at = offsets[a : b + 1] // width
                found = np.bincount(ids[at[0] : at[-1]])
                if len(found) > len(counts):
                    counts = np.concatenate([counts, np.zeros(len(found) - len(counts), np.int64)])
                counts[: len(found)] += found
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(total + at[:-1] - at[0]), pa.array(np.diff(at)), part.column(2)], names)
                total += int(at[-1] - at[0])
        if bucket is not None:
            yield summed()

    return store(dealt_ids(docs, encode, width, end_id, id_col, text_col).mapInArrow(number, IDS), "ids")


def id_counts(sums: DataFrame) -> DataFrame:
    """``id, n`` over all documents, from the sums of the buckets; each task sums what it reads first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            sparse = flat(batch.column(0))[0].view(COUNT)
            more = int(sparse["id"].max(initial=-1)) + 1 - len(total)
            if more > 0:
                total = np.concatenate([total, np.zeros(more, np.int64)])
            np.add.at(total, sparse["id"], sparse["n"])
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return sums.select("ids").mapInArrow(count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append the end id, and write codes and blocks in ascending id order.

    NULL texts are empty: one end id. Equal ids are ordered by their token ids, NULL ids come
    first. Only code lengths (as many as the vocabulary has ids) and bucket sums pass through
    the driver.
    """
    width = encoder(tokenizer).width
    encoded = encoded_in_order(docs, lambda text: encoder(tokenizer).encode(text), width, end_id, id_col, text_col)
    sums = encoded.where("before is null")
    counts = {r["id"]: r["n"] for r in id_counts(sums).collect()}
    table = np.zeros(max(counts, default=0) + 1, np.int64)
    table[list(counts)] = list(counts.values())
    lengths = code_lengths(table)
    spark = docs.sparkSession
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, length int").coalesce(1).write.parquet(f"{path}/codes")
    starts, total = {}, 0
    for bucket, n in sorted((r["_bucket"], r["n"]) for r in sums.select("_bucket", "n").collect()):
        starts[bucket] = total
        total += n
    codes = canonical_codes(lengths)

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(4))
            ids, offsets = data.view(f"<u{width}"), offsets // width
            bucket, before, n = (batch.column(i).to_pylist() for i in (0, 2, 3))
            at = 0
            while at < len(n):
                end, size = at, 0
                while end < len(n) and bucket[end] == bucket[at] and before[end] == before[at] + size and (end == at or size + n[end] <= BLOCK_IDS):
                    size += n[end]
                    end += 1
                bits, checkpoints = pack(ids[offsets[at] : offsets[end]].astype(np.int64), lengths, codes)

                def one_list(values: pa.Array) -> pa.Array:
                    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

                yield pa.RecordBatch.from_arrays(
                    [pa.array([starts[bucket[at]] + before[at]]), pa.array([size]), *(one_list(batch.column(i).slice(at, end - at)) for i in (1, 3)), one_list(pa.array(checkpoints)), pa.array([bits])],
                    ["start", "n_ids", "doc_ids", "doc_lengths", "checkpoints", "bits"],
                )
                at = end

    encoded.where("before is not null").mapInArrow(block, BLOCKS).write.parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str, digest: Callable[[np.ndarray], object], digest_type: str, arrow_type: pa.DataType) -> DataFrame:
    """``doc_id, start, n_tokens, value`` of every document; ``value`` is what ``digest`` makes of its decoded ids."""
    stored = spark.read.parquet(f"{path}/codes").collect()
    lengths = np.zeros(max((r["id"] for r in stored), default=0) + 1, np.int64)
    for r in stored:
        lengths[r["id"]] = r["length"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                start, n_ids = (part.column(i).to_numpy() for i in (0, 1))
                doc_ids, sizes, checkpoints = ([row.values for row in part.column(i)] for i in (2, 3, 4))
                bits, edges = flat(part.column(5))
                found = decoder.unpack([(bits[a:b], c.to_numpy(), n) for a, b, c, n in zip(edges, edges[1:], checkpoints, n_ids.tolist())])
                starts, values = [], []
                for s, n, ids in zip(start, sizes, found):
                    ends = np.cumsum(n.to_numpy())
                    starts.append(s + ends - n.to_numpy())
                    values += [digest(x) for x in np.split(ids, ends[:-1])]
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(doc_ids), pa.array(np.concatenate(starts)), pa.concat_arrays(sizes), pa.array(values, arrow_type)], ["doc_id", "start", "n_tokens", "value"])

    # A batch of few rows: each is a block of many ids.
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks").mapInArrow(decode, f"doc_id bigint, start bigint, n_tokens bigint, value {digest_type}")


def crc32(ids: np.ndarray) -> int:
    """Unsigned, of the ids as little-endian 32-bit numbers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all documents to a fresh file and describe each document from what is read back."""
    spark = docs.sparkSession
    path = scratch_path(spark, "token_ids")
    write_ids(docs, path, tokenizer, end_id, id_col, text_col)
    return read_ids(spark, path, crc32, "bigint", pa.int64()).withColumnRenamed("value", "ids_crc32")
