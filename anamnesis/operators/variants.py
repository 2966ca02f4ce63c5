"""Controlled variants of definition tables (condition, code, probability) and of records."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordering import hash_key
from .pairwise import cross_products, dot_products
from .rates import absent_codes
from .sizes import settle, small_side

# How many codes are injected, and what replaces a perturbed share out of range.
TARGET = 5
LOW_SHARE, HIGH_SHARE = 5.0, 95.0


def _injected_share(mode: str) -> Column:
    p = F.col("probability")
    value = {
        "mean": F.avg(p),
        "max": F.max(p),
        "min": F.min(p),
        "half_mean": F.ceil(F.avg(p) * 0.5),
    }[mode]
    return value.cast("int")


def _with_shares(defs: DataFrame, added: DataFrame, mode: str) -> DataFrame:
    shares = defs.groupBy("condition").agg(_injected_share(mode).alias("probability"))
    return added.join(shares, "condition").select("condition", "code", F.col("probability").cast("double").alias("probability"))


def inject_connected(defs: DataFrame, mode: str = "mean", target: int = TARGET) -> DataFrame:
    """The absent codes that share most conditions with a condition's own codes, ``target`` each.

    The strength of a candidate is the sum of its co-occurrence counts with the own codes.
    """
    defs = settle(defs)
    ones = defs.select("condition", "code", F.lit(1.0).alias("w"))
    half = dot_products(ones, "code", "condition", "w")
    edges = half.select(F.col("a").alias("own"), F.col("b").alias("code"), "dot").unionByName(
        half.select(F.col("b").alias("own"), F.col("a").alias("code"), "dot")
    )
    # The own codes of a condition times the edges of a code: block products, no condition x own x code rows.
    held = defs.select(F.col("condition").alias("row"), F.col("code").alias("own"), F.lit(1.0).alias("w"))
    links = edges.select(F.col("code").alias("row"), "own", F.col("dot").alias("w"))
    strength = cross_products(held, links, "row", "own", "w").select(F.col("a").alias("condition"), F.col("b").alias("code"), F.col("dot").alias("s"))
    candidates = strength.join(defs.select("condition", "code"), ["condition", "code"], "left_anti")
    place = F.row_number().over(Window.partitionBy("condition").orderBy(F.desc("s"), "code"))
    added = candidates.withColumn("place", place).where(F.col("place") <= target).select("condition", "code")
    return _with_shares(defs, added, mode)


def inject_hashed(defs: DataFrame, mode: str = "mean", target: int = TARGET, seed: object = 0) -> DataFrame:
    """``target`` absent codes per condition in hash order."""
    defs = settle(defs)
    absent = absent_codes(defs, "condition", "code", defs.select("code"))
    key = hash_key(seed, "condition", "code")
    place = F.row_number().over(Window.partitionBy("condition").orderBy(key, "code"))
    added = absent.withColumn("place", place).where(F.col("place") <= target).select("condition", "code")
    return _with_shares(defs, added, mode)


def perturb(defs: DataFrame, percent: float, seed: object = 0) -> DataFrame:
    """Move every share up or down by ``percent`` (a hash bit decides), kept between 1 and 100."""
    up = F.substring(hash_key(seed, "condition", "code"), 1, 1) >= "8"
    moved = (F.lit(100.0) + F.when(up, F.lit(float(percent))).otherwise(F.lit(-float(percent)))) * F.col("probability") / 100
    kept = F.when(moved <= 1, LOW_SHARE).when(moved >= 100, HIGH_SHARE).otherwise(moved)
    return defs.withColumn("probability", kept)


def extend_absent(defs: DataFrame, share: float = 1.0) -> DataFrame:
    """All definitions plus every absent code at a share below the least known one."""
    defs = settle(defs)
    absent = absent_codes(defs, "condition", "code", defs.select("code"))
    known = defs.select("condition", "code", F.col("probability").cast("double").alias("probability"))
    return known.unionByName(absent.withColumn("probability", F.lit(float(share))))


def least_known_share(defs: DataFrame) -> DataFrame:
    return defs.where(F.col("probability") > 1).agg(F.min("probability").alias("least"))


def resample(
    records: DataFrame, weights: DataFrame, key: str, label: str, codes: str, seed: object = 0, weighted: bool = True
) -> DataFrame:
    """Redraw the codes of every record from its class without replacement, keeping their number.

    ``weights`` holds (label, code, weight). Candidates are drawn by exponential keys -ln(u) / w
    (plain u when not weighted), with u from a hash of record and code: the class list is joined to the
    record, the least keys are selected there without a sort, and no record x code row is made. A record whose class has
    no weights keeps its codes; one with more codes than its class has keeps those of the class.
    """
    items = F.array_sort(F.collect_list(F.struct("code", F.col("weight").cast("double").alias("weight"))))
    lists = settle(weights.groupBy(label).agg(items.alias("_w")))
    joined = records.join(small_side(lists, 48, "_w"), label, "left")
    start = F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"))

    @F.arrow_udf("array<string>")
    def draw(starts: pa.Array, lists: pa.Array, own: pa.Array) -> pa.Array:
        return _drawn(starts, lists, own, weighted)

    return joined.withColumn(codes, F.when(F.size(codes) > 0, draw(start, "_w", codes)).otherwise(F.col(codes))).drop("_w")


def _drawn(starts: pa.Array, lists: pa.Array, own: pa.Array, weighted: bool) -> pa.Array:
    """Per row as many codes of its list as it has of its own: those of the least keys, in order of code."""
    out, tables = [], {}
    offsets, flat = lists.offsets.to_numpy(), lists.values
    names, shares = flat.field("code").to_pylist(), flat.field("weight").to_numpy(zero_copy_only=False)
    wanted = pc.list_value_length(own).fill_null(0).to_pylist()
    given = lists.is_valid().to_pylist()
    md5 = hashlib.md5
    for i, (first, n) in enumerate(zip(starts.to_pylist(), wanted)):
        a, b = int(offsets[i]), int(offsets[i + 1])
        if not n or not given[i]:
            out.append(own[i].as_py())
            continue
        row = tables.get((names[a], b - a)) if b > a else []
        if row is None or row and row[0] != names[a:b]:
            row = tables[names[a], b - a] = (names[a:b], [f"-{c}".encode() for c in names[a:b]])
        head = md5(first.encode())
        digests = []
        for tail in row[1] if row else []:
            h = head.copy()
            h.update(tail)
            digests.append(h.digest()[:4])
        u = (np.frombuffer(b"".join(digests), ">u4").astype(float) + 0.5) / 4294967296.0
        keys = -np.log(u) / shares[a:b] if weighted else u
        if n < b - a:
            # The n least; a tie across the cut goes to the smaller code, which stands first.
            limit = np.partition(keys, n - 1)[n - 1]
            less = np.flatnonzero(keys < limit)
            picked = np.sort(np.concatenate([less, np.flatnonzero(keys == limit)[: n - len(less)]]))
        else:
            picked = range(b - a)
        out.append([names[a + k] for k in picked])
    return pa.array(out, pa.list_(pa.string()))


def at_least(records: DataFrame, codes: str, count: int) -> DataFrame:
    """Records with at least ``count`` codes."""
    return records.where(F.size(codes) >= count)
