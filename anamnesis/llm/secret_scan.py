"""Secret scans: pattern candidates, told apart by how widely their values are owned.

One pass finds the candidates of every whole text. Their values are hashed and counted over the
corpus by distinct repository and distinct owner. A value that many owners have is a copied
example; one that few owners have and that looks random is taken for a live credential. The base
patterns always report their spans; the counts add spans of kind ``live`` for random-looking
tokens that no base pattern covers.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.sizes import store

KINDS = ("assign", "access", "hex", "live")
#: The patterns of the contract. A match below the least length is dropped after it was consumed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, hence the same matches as runs of any length cut to 24 and more
TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}")

LEAST_ASSIGN, LEAST_ACCESS = 6, 20
#: A value that this many owners have is an example; with fewer it belongs to somebody.
EXAMPLE_OWNERS = 4
#: Bits a character that a token needs to look random.
LEAST_ENTROPY = 3.3

SPAN = "struct<start:int,kind:int,end:int,value:binary,random:boolean>"


def entropy(value: str) -> float:
    """Bits a character of the value's own letter distribution."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def looks_random(value: str) -> bool:
    """Letters and digits mixed, and varied."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and entropy(value) >= LEAST_ENTROPY


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) in order; of the last kind only tokens that overlap no base span."""
    found = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= LEAST_ASSIGN:
            found.append((m.start(), 0, m.end(), m[2]))
    for m in ACCESS.finditer(text):
        if m.end() - m.start() >= LEAST_ACCESS:
            found.append((m.start(), 1, m.end(), m[0]))
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    base = sorted((start, end) for start, _, end, _ in found)
    at, reach = 0, -1
    for m in TOKEN.finditer(text):
        while at < len(base) and base[at][0] < m.end():
            reach = max(reach, base[at][1])
            at += 1
        if reach <= m.start() and looks_random(m[0]):
            found.append((m.start(), 3, m.end(), m[0]))
    return sorted(found)


SCANNED = f"doc_id bigint, repo string, owner string, doc_key bigint, spans array<{SPAN}>"
_ARROW_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.binary()), ("random", pa.bool_())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = []
        for text in batch.column(4).to_pylist():
            spans.append([
                {"start": s, "kind": k, "end": e, "value": hashlib.sha256(v.encode()).digest(), "random": looks_random(v)}
                for s, k, e, v in candidates(text or "")
            ])
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(spans, pa.list_(_ARROW_SPAN))], ["doc_id", "repo", "owner", "doc_key", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: str = "source", owner: str | None = None) -> DataFrame:
    """Candidates of every document, written once; ``doc_key`` is the hash of the text.

    ``owner`` defaults to what stands before the first ``/`` of the repository. A NULL repository
    or owner counts as one of its own.
    """
    text = F.col(text_col).cast("string")
    repository = F.coalesce(F.col(repo).cast("string"), F.lit(""))
    holder = F.coalesce(F.col(owner).cast("string"), F.lit("")) if owner else F.substring_index(repository, "/", 1)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), repository.alias("repo"), holder.alias("owner"), F.xxhash64(text).alias("doc_key"), text.alias("text"))
    return store(rows.mapInArrow(_scan, SCANNED), "secrets")


def ownership(scanned: DataFrame) -> DataFrame:
    """``value, n_repos, n_owners``: distinct repositories and owners of every candidate value.

    The triples are made distinct first, with a map-side combine: a value in a third of all
    documents leaves each task once per repository.
    """
    each = scanned.select("repo", "owner", F.explode("spans").alias("s")).select(F.col("s.value").alias("value"), "repo", "owner")
    by_repo = each.groupBy("value", "repo", "owner").agg(F.lit(1).alias("one"))
    repos = by_repo.groupBy("value", "repo").agg(F.lit(1).alias("one")).groupBy("value").agg(F.count("one").alias("n_repos"))
    owners = by_repo.groupBy("value", "owner").agg(F.lit(1).alias("one")).groupBy("value").agg(F.count("one").alias("n_owners"))
    return repos.join(owners, "value")


def judged(scanned: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Per document with candidates: ``found``, its spans with kind and whether the value is an example."""
    each = scanned.where(F.size("spans") > 0).select("doc_id", "doc_key", F.explode("spans").alias("s"))
    each = each.select("doc_id", "doc_key", F.col("s.start").alias("start"), F.col("s.kind").alias("kind"), F.col("s.end").alias("end"), F.col("s.value").alias("value"), F.col("s.random").alias("random"))
    # Repeated rows of one document have the same spans.
    known = each.join(ownership(scanned), "value").withColumn("example", F.col("n_owners") >= example_owners)
    return known.groupBy("doc_id", "doc_key").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end", "example", "random"))).alias("found"))


def _listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s["kind"]], s["start"], s["end"])), ",")


def _of_kind(kind: int):
    return lambda s: s["kind"] == kind


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: str = "source", owner: str | None = None, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Spans of every document: base patterns, and live-looking tokens that few owners have.

    Positions are code points, end exclusive. NULL and empty texts have none. Repeated rows give
    repeated results. ``n_live`` and ``n_example`` count the reported spans by ownership.
    """
    scanned = scan(docs, id_col, text_col, repo, owner)
    known = judged(scanned, example_owners).withColumnsRenamed({"doc_id": "_id", "doc_key": "_key"})
    rows = scanned.select("doc_id", "doc_key").join(known, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("doc_key").eqNullSafe(F.col("_key")), "left")
    found = F.coalesce("found", F.array().cast("array<struct<start:int,kind:int,end:int,example:boolean,random:boolean>>"))
    rows = rows.select("doc_id", F.filter(found, lambda s: (s["kind"] < 3) | ~s["example"]).alias("all"))
    rows = rows.withColumn("base", F.filter("all", lambda s: s["kind"] < 3))
    return rows.select(
        "doc_id",
        *[F.size(F.filter("base", _of_kind(i))).cast("bigint").alias(f"n_{KINDS[i]}") for i in range(3)],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("all")).alias("spans"),
        F.size(F.filter("all", lambda s: ~s["example"] & s["random"])).cast("bigint").alias("n_live"),
        F.size(F.filter("all", lambda s: s["example"])).cast("bigint").alias("n_example"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo: str = "source", owner: str | None = None, mark: str = "[SECRET]", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """The documents with every owned secret replaced by the mark; widely copied examples stay.

    All columns and rows are kept. Overlapping spans are replaced as one.
    """
    known = judged(scan(docs, id_col, text_col, repo, owner), example_owners)
    owned = F.filter("found", lambda s: ~s["example"])
    empty = F.array().cast("array<struct<start:int,end:int>>")
    # Spans come by start: one that begins inside the span before it makes that one longer.
    merged = F.aggregate(
        owned,
        empty,
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] > s["start"]),
                               F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
    )
    # The columns of the input go into one struct, so none of their names can clash.
    text = F.col(text_col).cast("string")
    held = docs.select(F.col(id_col).cast("bigint").alias("id"), F.xxhash64(text).alias("key"), text.alias("text"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    spans = known.select(F.col("doc_id").alias("found_id"), F.col("doc_key").alias("found_key"), F.reverse(merged).alias("spans")).where(F.size("spans") > 0)
    joined = held.join(spans, F.col("id").eqNullSafe(F.col("found_id")) & F.col("key").eqNullSafe(F.col("found_key")), "left")
    cleaned = F.aggregate("spans", F.col("text"), lambda t, s: F.overlay(t, F.lit(mark), s["start"] + 1, s["end"] - s["start"]))
    clean = F.when(F.col("spans").isNull(), F.col("text")).otherwise(cleaned)
    return joined.select(*[clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
