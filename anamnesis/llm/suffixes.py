"""Exact substring deduplication by suffix order and longest previous factors.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier: in a document with a
smaller id, or earlier in the same one. The suffixes of a corpus are too many to be sorted together,
so they are dealt out first: the window of ``LENGTH`` bytes at a start is named by the least hash of
its ``GRAM``-byte substrings. Equal windows have equal names, neighbouring windows mostly share one,
and a name that occurs once in the corpus, in a run that cannot repeat
a window, needs no further look. The stretches of text with a
repeated name meet in one task, which sorts their suffixes, takes the previous and the next smaller
position of each in suffix order, and finds the longest factor that also starts earlier.

A name with more than ``most`` stretches is taken further apart: the least place of each of its
windows, known by two hashes of all their bytes, is aggregated; all other starts are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.sizes import store
from .orders import partitions
from .texts import flat, ragged, utf8

LENGTH = 100
GRAM = 32
#: Grams of a window.
GRAMS = LENGTH - GRAM + 1
#: Starts of one stretch; longer runs of one name are cut.
RUN = 256
#: Stretches of one name that one task sorts.
MOST = 20_000
#: Bytes hashed at a time, and bytes of stretches sorted at a time.
STRETCH, SORTED = 1 << 20, 2 << 20
KEY_BITS, RUN_BITS = 23, 9
START_BITS = 63 - KEY_BITS
START_MASK = (1 << START_BITS) - 1
#: Short names compress better in shuffles; those that fall together only cost a further look.
NAME_BITS = 48
#: Documents without an id get one below all real ones, by the hash of their text.
NO_ID, NO_ID_BITS = -(1 << 63), 40


def _hash_tables() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(7_001)).integers(0, 1 << 64, (2, 256), dtype=np.uint64)


_TABLES = _hash_tables()
_FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _power(base: np.uint64, n: int) -> np.uint64:
    return np.uint64(pow(int(base), n, 1 << 64))


def gram_hashes(data: np.ndarray, length: int, kind: int = 0) -> np.ndarray:
    """A 64-bit hash of the ``length`` bytes at each start, made of hashes of lengths that are powers of two."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    factor = _FACTORS[kind]
    part, size = _TABLES[kind][data], 1
    whole, covered = None, 0
    while True:
        if length & size:
            if whole is None:
                whole, covered = part, size
            else:
                m = len(part) - covered
                whole = whole[:m] * _power(factor, size) + part[covered:]
                covered += size
        if covered == length:
            break
        part = part[:-size] * _power(factor, size) + part[size:]
        size *= 2
    whole = whole[:n]
    whole = (whole ^ (whole >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return whole ^ (whole >> np.uint64(32))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def window_names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Name of each window of ``LENGTH`` bytes, the low bits of the least hash of its grams, and whether several grams have that.

    The last seven bits of a hash make way for the gram's position, once rising and once falling:
    a window is narrower than 128 grams, so both least values name one position or there are several.
    """
    hashed = gram_hashes(data, GRAM) & ~np.uint64(127)
    spot = np.arange(len(hashed), dtype=np.uint64) & np.uint64(127)
    low = _sliding_least(hashed | spot, GRAMS)
    high = _sliding_least(hashed | (np.uint64(127) - spot), GRAMS)
    return low >> np.uint64(7) & np.uint64((1 << NAME_BITS) - 1), (low & np.uint64(127)) + (high & np.uint64(127)) != 127


def named_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of window starts of one name: row, first start in the row, number of starts, name, and if a window may come twice in the run."""
    rows, firsts, sizes, names, twice = [], [], [], [], []
    for at in range(0, len(data) - LENGTH + 1, STRETCH):
        name, several = window_names(data[at : at + STRETCH + LENGTH - 1])
        start = np.arange(at, at + len(name))
        row = np.searchsorted(offsets, start, "right") - 1
        inside = start + LENGTH <= offsets[row + 1]
        start, row, name, several = start[inside], row[inside], name[inside], several[inside]
        if not len(start):
            continue
        begin = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1] + 1) | (name[1:] != name[:-1])]))
        size = np.diff(np.concatenate([begin, [len(start)]]))
        # Equal windows have the gram at the same offset: two of one run need it twice in a window, or a run beyond the reach of one gram.
        again = (size > GRAMS) | np.logical_or.reduceat(several, begin)
        pieces = -(-size // RUN)
        if (pieces > 1).any():
            cut = ragged(np.zeros(len(size), np.int64), pieces) * RUN
            whole = np.repeat(size, pieces)
            begin, size, again = np.repeat(begin, pieces) + cut, np.minimum(RUN, whole - cut), np.repeat(again, pieces)
        rows.append(row[begin])
        firsts.append(start[begin] - offsets[row[begin]])
        sizes.append(size)
        names.append(name[begin])
        twice.append(again)
    if not rows:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64), np.zeros(0, bool))
    return tuple(np.concatenate(x) for x in (rows, firsts, sizes, names, twice))


def place(key: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Text key, first start and number of starts in one number; sorted by it, the starts of a text are in order."""
    return key << START_BITS | first << RUN_BITS | size


def placed(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> START_BITS, at >> RUN_BITS & ((1 << (START_BITS - RUN_BITS)) - 1), at & ((1 << RUN_BITS) - 1)


def spot(key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Text key and one start in one number, in the order of places."""
    return key << START_BITS | start


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, count in _row_groups(batch.column(2)):
            part = batch.slice(at, count)
            row, first, size, name, again = named_runs(*flat(part.column(2)))
            ids = part.column(0).to_numpy(zero_copy_only=False)
            keys = part.column(1).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(ids[row]), pa.array(place(keys[row], first, size)), pa.array(1 + again.astype(np.int32))], ["name", "doc", "at", "weight"])


def _row_groups(column: pa.Array) -> Iterator[tuple[int, int]]:
    _, offsets = flat(column)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + 4 * STRETCH, "right")) - 1)
        end = min(end, len(column))
        yield at, end - at
        at = end


def suffix_ranks(data: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Rank of the ``length`` bytes at each position, by prefix doubling; positions too near their end get -1."""
    n = len(data)
    room = ends - np.arange(n)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    first = np.zeros(n, np.uint64)
    for i in range(8):
        first = first << np.uint64(8) | padded[i : i + n]
    rank, size = np.full(n, -1, np.int64), 8
    ok = np.flatnonzero(room >= size)
    rank[ok] = np.unique(first[ok], return_inverse=True)[1]
    while size < length:
        step = min(size, length - size)
        ok = np.flatnonzero(room >= size + step)
        pair = rank[ok] * np.int64(n + 1) + rank[ok + step]
        rank = np.full(n, -1, np.int64)
        rank[ok] = np.unique(pair, return_inverse=True)[1]
        size += step
    return rank


def previous_smaller(values: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Index of the nearest smaller value before each, -1 where there is none; by pointer jumping.

    With groups (runs of equal numbers) a pointer that has left its group goes no further: it stands
    outside, as the nearest smaller value does. So a long rising group is not walked through from behind it.
    """
    link = np.arange(len(values)) - 1
    behind = np.arange(len(values))
    while len(behind):
        to = link[behind]
        on = (to >= 0) & (values[to] > values[behind])
        if group is not None:
            on &= group[to] == group[behind]
        behind = behind[on]
        link[behind] = link[link[behind]]
    return link


def repeated_starts(order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Of suffixes with a place in the corpus and a rank of their first bytes: does the longest previous factor reach that far?

    In suffix order the earlier suffix with the longest common prefix is the nearest with a
    smaller place before or behind; it shares the first bytes if its rank is the same. Beyond the
    suffixes of one rank the common prefix is too short, so the search ends there.
    """
    by = np.lexsort((order, rank))
    place_, rank_ = order[by], rank[by]
    before = previous_smaller(place_, rank_)
    behind = len(by) - 1 - previous_smaller(place_[::-1], rank_[::-1])[::-1]
    factor = (before >= 0) & (rank_[np.maximum(before, 0)] == rank_)
    factor |= (behind < len(by)) & (rank_[np.minimum(behind, len(by) - 1)] == rank_)
    out = np.zeros(len(by), bool)
    out[by] = factor
    return out


def _repeats(name: np.ndarray, doc: np.ndarray, at: np.ndarray, texts: list[bytes]) -> pa.RecordBatch:
    """Runs of repeated starts in stretches that share names; all stretches of a name are there."""
    order = np.lexsort((at, doc, name))
    name, doc, at = name[order], doc[order], at[order]
    own = np.concatenate([[True], (name[1:] != name[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])])  # repeated rows are one
    name, doc, at = name[own], doc[own], at[own]
    texts = [texts[i] for i in order[own].tolist()]
    key, first, size = placed(at)
    # Equal stretches are neighbours in suffix order: all but the first repeat at every start.
    seen: set[tuple[int, bytes]] = set()
    fresh = np.zeros(len(texts), bool)
    for i, (n, t) in enumerate(zip(name.tolist(), texts)):
        if (n, t) not in seen:
            seen.add((n, t))
            fresh[i] = True
    out = [(doc[~fresh], key[~fresh], first[~fresh], first[~fresh] + size[~fresh])]
    # A start whose window hash is alone in its name has no equal.
    own = np.flatnonzero(fresh)
    lengths = size[own] + LENGTH - 1
    data = np.frombuffer(b"".join(texts[i] for i in own.tolist()), np.uint8)
    heads = np.cumsum(lengths) - lengths
    starts = ragged(heads, size[own])
    which = np.repeat(np.arange(len(own)), size[own])
    window = gram_hashes(data, LENGTH)[starts] ^ name[own][which].view(np.uint64)
    _, group, count = np.unique(window, return_inverse=True, return_counts=True)
    twice = np.unique(name[own][which[count[group] > 1]])
    chosen = np.flatnonzero(np.isin(name[own], twice))
    if len(chosen):
        lengths, part = lengths[chosen], own[chosen]
        data = data[ragged(heads[chosen], lengths)]
        ends = np.repeat(np.cumsum(lengths), lengths)
        starts = ragged(np.cumsum(lengths) - lengths, size[part])
        which = np.repeat(np.arange(len(part)), size[part])
        offset = starts - (np.cumsum(lengths) - lengths)[which]
        # The rank within a name: names are apart in suffix order.
        ranks = suffix_ranks(data, ends)[starts]
        _, named = np.unique(name[part][which], return_inverse=True)
        hit = repeated_starts(part[which] * (2 * RUN) + offset, named * np.int64(len(data) + 1) + ranks)
        begin = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1] & (which[1:] == which[:-1])]))
        end = np.flatnonzero(hit & ~np.concatenate([hit[1:] & (which[1:] == which[:-1]), [False]]))
        p = part[which[begin]]
        out.append((doc[p], key[p], first[p] + offset[begin], first[p] + offset[end] + 1))
    columns = [np.concatenate(c) for c in zip(*out)]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["doc", "key", "first", "last"])


def _sorted_names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches ordered by name: as soon as enough bytes of whole names are there, they are sorted."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            held.append(part)
            size += part.column(3).nbytes
            if size < SORTED:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            name = table.column(0).to_numpy()
            last = int(np.searchsorted(name, name[-1], "left"))
            if last:
                yield _table_repeats(table.slice(0, last))
            held = table.slice(last).combine_chunks().to_batches()
            size = sum(b.slice(0).column(3).nbytes for b in held) if last else 0
    if held:
        yield _table_repeats(pa.Table.from_batches(held))


def _table_repeats(table: pa.Table) -> pa.RecordBatch:
    return _repeats(*(table.column(i).to_numpy() for i in range(3)), table.column(3).to_pylist())


def _but_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with their hot stretches and the spots that are the first of a window: runs of all other starts."""
    for batch in batches:
        out = [np.zeros((4, 0), np.int64)]
        for doc, stretches, firsts in zip(*(c.to_pylist() for c in batch.columns)):
            key, first, size = placed(np.array(stretches, np.int64))
            spots = np.setdiff1d(spot(np.repeat(key, size), ragged(first, size)), np.array(firsts or [], np.int64))
            if len(spots):
                cut = np.flatnonzero(np.diff(spots) != 1) + 1
                begin, end = spots[np.concatenate([[0], cut])], spots[np.concatenate([cut, [len(spots)]]) - 1]
                out.append(np.stack([np.full(len(begin), doc), begin >> START_BITS, begin & START_MASK, (end & START_MASK) + 1]))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, 1)], ["doc", "key", "first", "last"])


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with the places of their stretches and repeated names: the bytes of each stretch."""
    for batch in batches:
        for at, count in _row_groups(batch.column(2)):
            part = batch.slice(at, count)
            name, doc, where, texts = [], [], [], []
            for i, k, data, found in zip(*(c.to_pylist() for c in part.columns)):
                for s in found:
                    key, first, size = s["at"] >> START_BITS, s["at"] >> RUN_BITS & ((1 << (START_BITS - RUN_BITS)) - 1), s["at"] & ((1 << RUN_BITS) - 1)
                    if key == k:
                        name.append(s["name"])
                        doc.append(i)
                        where.append(s["at"])
                        texts.append(data[first : first + size + LENGTH - 1])
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.int64()), pa.array(doc, pa.int64()), pa.array(where, pa.int64()), pa.array(texts, pa.binary())], ["name", "doc", "at", "data"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both hashes of every window of the stretches, and where it stands."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            data, offsets = flat(part.column(2))
            key, first, size = placed(part.column(1).to_numpy())
            which = np.repeat(np.arange(len(size)), size)
            starts = ragged(offsets[:-1], size)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(gram_hashes(data, LENGTH, kind)[starts].view(np.int64)) for kind in range(2)), part.column(0).take(pa.array(which)), pa.array(spot(key[which], first[which] + starts - offsets[:-1][which]))],
                ["a", "b", "doc", "spot"],
            )


REPEATS = "doc bigint, key bigint, first bigint, last bigint"


def repeated_runs(texts: DataFrame, most: int = MOST) -> DataFrame:
    """``doc, key, first, last``: starts ``first <= s < last`` of windows that also start earlier.

    ``texts``: ``doc, key, data``; places are ordered by ``doc``, then ``key`` (tells texts with one id apart), then start.
    """
    count = partitions(texts)
    names = texts.mapInArrow(_names, "name bigint, doc bigint, at bigint, weight int")
    # Written once: the counts are read again by the join, and tell whether a name is hot at all.
    counts = store(names.groupBy("name").agg(F.sum("weight").alias("n")).where("n > 1").select("name", (F.col("n") > most).alias("hot")), "names")
    # The filter that joins on the id would add is in all uses alike, so that they share one shuffle.
    found = names.select("name", "doc", "at").where("doc IS NOT NULL").join(counts, "name").groupBy("doc").agg(F.collect_set(F.struct("name", "at", "hot")).alias("found"))

    def chosen(hot: bool) -> DataFrame:
        return found.select("doc", F.filter("found", lambda s: s["hot"] == hot).alias("found")).where(F.size("found") > 0)

    def stretches(hot: bool) -> DataFrame:
        own = texts.join(chosen(hot), "doc").select("doc", "key", "data", "found")
        return own.mapInArrow(_contents, "name bigint, doc bigint, at bigint, data binary")

    cold = stretches(False).repartition(count, "name").sortWithinPartitions("name").mapInArrow(_sorted_names, REPEATS)
    if counts.where("hot").isEmpty():
        return cold
    windows = stretches(True).select("doc", "at", "data").mapInArrow(_windows, "a bigint, b bigint, doc bigint, spot bigint")
    # The least place of a window is taken where it is read and again where it is dealt: a task sends each window once, however often it has it.
    firsts = windows.groupBy("a", "b").agg(F.min(F.struct("doc", "spot")).alias("least")).groupBy("least.doc").agg(F.collect_list("least.spot").alias("firsts"))
    own = chosen(True).select("doc", "found.at")
    hot = own.join(firsts, "doc", "left").mapInArrow(_but_first, REPEATS)
    return cold.unionByName(hot)


def removed_bytes(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte ranges covered by windows that start in the runs, joined where they touch."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        end = last + LENGTH - 1
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], end)
        else:
            out.append((first, end))
    return out


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, count in _row_groups(batch.column(2)):
            rows = []
            for doc, key, data, runs in zip(*(c.to_pylist() for c in batch.slice(at, count).columns)):
                spans = removed_bytes([(r["first"], r["last"]) for r in runs or [] if r["key"] == key])
                rest, end = hashlib.sha256(), 0
                for a, b in spans:
                    rest.update(data[end:a])
                    end = b
                rest.update(data[end:])
                rows.append((None if doc < NO_ID + (1 << NO_ID_BITS) else doc, len(data), sum(b - a for a, b in spans), len(spans), rest.hexdigest()))
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    data = utf8(text_col)
    hashed = F.xxhash64(data)
    nameless = F.lit(NO_ID) + hashed.bitwiseAND(F.lit((1 << NO_ID_BITS) - 1))
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), nameless).alias("doc"), F.shiftrightunsigned(hashed, 64 - KEY_BITS).alias("key"), data.alias("data"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every document.

    NULL texts are empty. Documents without an id come before all others, each apart; they and texts with one id
    are ordered by a hash. Rows with the same id and text are one document, whose result is repeated.
    Ids of the least 2^40 whole numbers stand for NULL.
    """
    texts = keyed_texts(docs, id_col, text_col)
    runs = repeated_runs(texts, most).groupBy("doc").agg(F.collect_set(F.struct("key", "first", "last")).alias("runs"))
    return texts.join(runs, "doc", "left").select("doc", "key", "data", "runs").mapInArrow(_kept, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
