"""URL filters: a sort-merge range join of page hosts with allow and block rules.

A host is turned round (``org,example,www,``), so a rule for a host and all its subdomains is an
interval of such keys, and the intervals of two rules are nested or apart. Pages and rules are
dealt to ranges of the key and sorted; one sweep over a range keeps the stack of the rules whose
interval is open and asks only those for the path.

A rule is added to every range that its interval touches. The ranges are cut at keys of a bounded
sample of pages, which decides where a row is judged and never how. A key that makes up many rows
is the limit of several ranges, and its rows are spread over all of them by page id.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .orders import partitions

SAMPLE_PER_RANGE = 40

EVENTS = "_bucket int, _key string, _kind int, page_id bigint, host string, path string, verdict string"
VERDICTS = "page_id bigint, host string, path string, rule string, verdict string"


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from last to first, each ended by a comma. The empty host has the empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), ","), F.lit(",")))


def _interval_end(key: str) -> str:
    """The least string after all that begin with the key."""
    return key[:-1] + chr(ord(key[-1]) + 1)


class Sweep:
    """The rules open at the present key, outermost first."""

    def __init__(self) -> None:
        self.open: list[tuple[str, str, str, str]] = []  # interval end, host, path, verdict

    def move(self, key: str) -> None:
        while self.open and self.open[-1][0] <= key:
            self.open.pop()

    def add(self, key: str, host: str, path: str, verdict: str) -> None:
        self.move(key)
        self.open.append((_interval_end(key), host, path, verdict))

    def judge(self, key: str, host: str, path: str) -> tuple[str, str] | None:
        """Rule and verdict of the longest rule that fits; of equally long ones that with the longer host, then block."""
        self.move(key)
        best = None
        for _, rule_host, rule_path, verdict in self.open:
            if path.startswith(rule_path) and (host == rule_host or host.endswith("." + rule_host)):
                rank = (len(rule_host) + len(rule_path), len(rule_host), verdict == "block")
                if best is None or rank > best[0]:
                    best = rank, rule_host + rule_path, verdict
        return best and best[1:]


def _range_cuts(pages: DataFrame, count: int) -> list[str]:
    """At most ``count - 1`` keys; a frequent key comes several times."""
    if count < 2:
        return []
    wanted, total = SAMPLE_PER_RANGE * count, pages.count()
    # Rows are drawn where they are read; as many reach the driver as there are ranges, times a constant.
    drawn = pages.select("_key").sample(min(1.0, wanted / total), seed=1) if total > wanted else pages.select("_key")
    keys = sorted(r["_key"] for r in drawn.collect())
    step = max(SAMPLE_PER_RANGE, -(-len(keys) // count))
    return keys[step::step][: count - 1] if len(keys) > step else []


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Host, path, deciding rule and verdict of every page.

    ``rules``: host, path, verdict (``allow`` or ``block``). A rule fits its host and all
    subdomains if the path of the url starts with the rule's; the longest (host and path
    together) wins. Pages without a fitting rule get the ``default`` and a NULL rule; NULL urls
    and urls without ``://`` have an empty host and path, which no rule fits. Rules with a NULL
    or empty host fit nothing; a NULL path is the empty one. Repeated pages are judged each.
    """
    url = F.col(url_col).cast("string")
    parsed = pages.select(F.col(id_col).cast("bigint").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    parsed = parsed.withColumn("_key", host_key(F.col("host")))
    count = partitions(pages)
    cuts = _range_cuts(parsed, count)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page_id, host, path, key = (c.to_pylist() for c in batch.columns)
            spans = [(bisect_left(cuts, k), bisect_right(cuts, k)) for k in key]
            at = [low if low == high else low + (p or 0) % (high - low + 1) for p, (low, high) in zip(page_id, spans)]
            n = len(at)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), batch.column(3), pa.array([1] * n, pa.int32()), *batch.columns[:3], pa.nulls(n, pa.string())], ARROW.names)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for host, path, verdict, key in zip(*(c.to_pylist() for c in batch.columns)):
                for b in range(bisect_left(cuts, key), bisect_left(cuts, _interval_end(key)) + 1):
                    rows.append({"_bucket": b, "_key": key, "_kind": 0, "page_id": None, "host": host, "path": path, "verdict": verdict})
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    rules = rules.select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''")
    rules = rules.withColumn("_key", host_key(F.col("host")))
    dealt = parsed.mapInArrow(deal, EVENTS).unionByName(rules.mapInArrow(spread, EVENTS))
    ordered = dealt.repartitionById(len(cuts) + 1, F.col("_bucket")).sortWithinPartitions("_bucket", "_key", "_kind")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, bucket = Sweep(), None
        for batch in batches:
            out = []
            for b, key, kind, page_id, host, path, verdict in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket:
                    state, bucket = Sweep(), b
                if kind == 0:
                    state.add(key, host, path, verdict)
                else:
                    found = state.judge(key, host, path)
                    out.append((page_id, host, path, *(found or (None, default))))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *[pa.string()] * 4])], ["page_id", "host", "path", "rule", "verdict"])

    return ordered.mapInArrow(sweep, VERDICTS)


ARROW = pa.schema([("_bucket", pa.int32()), ("_key", pa.string()), ("_kind", pa.int32()), ("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("verdict", pa.string())])
