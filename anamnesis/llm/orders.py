"""Documents dealt out in id order: buckets of neighbouring ids, each sorted in one task."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F

QUANTILE_ACCURACY = 10_000


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def id_buckets(df: DataFrame, id_col: str, count: int) -> DataFrame:
    """Add ``_bucket``: ascending with the id, about equal in rows, NULL ids in bucket 0.

    The limits are approximate quantiles; they only decide which task gets a row. Equal ids share
    a bucket. There are ``count`` buckets at most.
    """
    key = F.col(id_col).cast("double")
    parts = [i / count for i in range(1, count)]
    cuts = df.agg(F.percentile_approx(key, parts, max(QUANTILE_ACCURACY, 20 * count)).alias("c")).first()["c"] if parts else None
    cuts = sorted(set(cuts or []))
    if not cuts:
        return df.withColumn("_bucket", F.lit(0))
    splits = [-float("inf"), *cuts, float("inf")]
    dealt = Bucketizer(splits=splits, inputCol="_key", outputCol="_cut", handleInvalid="keep").transform(df.withColumn("_key", key))
    return dealt.withColumn("_bucket", F.coalesce(F.col("_cut").cast("int"), F.lit(0))).drop("_key", "_cut")


def spread_buckets(df: DataFrame, id_col: str, tie: Column, count: int) -> DataFrame:
    """As ``id_buckets``, NULL ids first; an id (or NULL) that fills several buckets is dealt among them by a hash of ``tie``.

    Buckets never fall as ids rise. Rows that are the same in id and ``tie`` stay together.
    """
    key = F.coalesce(F.col(id_col).cast("double"), F.lit(float("-inf")))
    parts = [i / count for i in range(1, count)]
    cuts = df.agg(F.percentile_approx(key, parts, max(QUANTILE_ACCURACY, 20 * count)).alias("c")).first()["c"] if parts else None
    cuts = sorted(cuts or [])
    if not cuts:
        return df.withColumn("_bucket", F.lit(0))
    values = sorted(set(cuts))
    at_most = [0, *(bisect_right(cuts, v) for v in values)]
    times = [1, *(cuts.count(v) if len(values) < len(cuts) else 1 for v in values)]
    named = df.withColumn("_key", key)
    finite = [v for v in values if v > float("-inf")]
    below = len(values) - len(finite)  # 1 where NULL ids fill a bucket
    if finite:
        named = Bucketizer(splits=[-float("inf"), *finite, float("inf")], inputCol="_key", outputCol="_cut", handleInvalid="keep").transform(named)
    else:
        named = named.withColumn("_cut", F.lit(0.0))
    # 1-based places in the tables: how many values are at most the key.
    place = F.col("_cut").cast("int") + F.lit(1 + below)

    def look_up(table: list, kind: str) -> Column:
        return F.element_at(F.lit(table).cast(f"array<{kind}>"), place)

    top = look_up(at_most, "int")
    among = F.when(F.col("_key") == look_up([float("nan"), *values], "double"), look_up(times, "int")).otherwise(F.lit(1))
    bucket = F.when(among > 1, top - among + F.pmod(F.xxhash64(tie), among + 1)).otherwise(top)
    return named.withColumn("_bucket", bucket.cast("int")).drop("_key", "_cut")


def with_followers(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` in id order within buckets, each bucket ended by the document that follows it.

    Adds ``_bucket`` and ``_after`` (1 for the follower, 0 otherwise). The last bucket is followed
    by the very first document. Rows with equal ids are ordered by text, NULL ids come first.
    The follower table has one id per bucket; texts are shuffled once.
    """
    count = partitions(docs)
    dealt = id_buckets(docs, "doc_id", count)
    firsts = sorted((r["_bucket"], r["first"]["doc_id"]) for r in dealt.groupBy("_bucket").agg(F.min(F.struct("doc_id")).alias("first")).collect())
    follows = [(bucket, firsts[(i + 1) % len(firsts)][1]) for i, (bucket, _) in enumerate(firsts)]
    named = docs.sparkSession.createDataFrame(follows, "_bucket int, _first bigint")
    after = docs.join(F.broadcast(named), F.col("doc_id").eqNullSafe(F.col("_first"))).select("doc_id", "text", "_bucket", F.lit(1).alias("_after"))
    own = dealt.select("doc_id", "text", "_bucket", F.lit(0).alias("_after"))
    return own.unionByName(after).repartitionById(count, F.col("_bucket")).sortWithinPartitions("_bucket", "_after", "doc_id", "text")
