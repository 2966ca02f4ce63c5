"""A manifest of a table as Merkle trees: one tree a group, one tree over the groups' roots.

Nodes of a level are rows (tree, place, digest). Each asks for its siblings by their computed places
(the place XOR 1 in binary trees, shifted slots of the run otherwise) in an equijoin of the level with itself;
the rows in slot zero then hold their whole run and emit its parent. Levels are written once each. On
the way down the siblings of a node are put before those of its ancestors, so every leaf gets its proof in one join.

All of it is DataFrame code. A run has ``arity`` rows at most, so no key is hot whatever the size of a tree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordering import running_sum
from ..operators.sizes import store
from .orders import partitions, spread_buckets

ARITY = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sha256(data: Column) -> Column:
    return F.unhex(F.sha2(data, 256))


def hex_text(data: Column) -> Column:
    return F.lower(F.hex(data))


def leaf_digest(values: Sequence[Column]) -> Column:
    """Digest of a row: each value as ``-`` if NULL, else UTF-8 byte count, colon, value."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return sha256(F.concat(*parts))


def ascii_lower(text: Column) -> Column:
    """Only A-Z change."""
    return F.translate(text, _UPPER, _LOWER)


def node_digest(*parts: Column) -> Column:
    """Digest of digests, each read as lower-case hexadecimal text."""
    return sha256(hex_text(F.concat(*parts)))


def _joined_digests(siblings: str, keep: str) -> Column:
    """The digests of the wanted siblings, one after the other."""
    return F.expr(f"aggregate(filter({siblings}, s -> {keep}), binary(''), (a, s) -> concat(a, s.digest))")


def with_siblings(nodes: DataFrame, arity: int = ARITY) -> DataFrame:
    """Add ``before`` and ``after``: the digests of the run's other nodes.

    ``nodes`` has ``tree, place, size, digest`` (size: nodes of the tree on this level) and may have more columns.
    """
    place = F.col("place")
    if arity == 2:
        wanted = F.array(place.bitwiseXOR(F.lit(1)))
    else:
        slot = place % arity
        wanted = F.array(*[place - slot + (slot + k) % arity for k in range(1, arity)])
    asked = nodes.select("tree", "place", "size", F.explode(wanted).alias("_sibling")).where("_sibling < size").drop("size")
    others = nodes.select("tree", F.col("place").alias("_sibling"), "digest")
    runs = asked.join(others, ["tree", "_sibling"]).groupBy("tree", "place").agg(F.sort_array(F.collect_list(F.struct("_sibling", "digest"))).alias("_siblings"))
    none = F.lit(b"")
    return nodes.join(runs, ["tree", "place"], "left").select(
        *nodes.columns,
        F.coalesce(_joined_digests("_siblings", "s._sibling < place"), none).alias("before"),
        F.coalesce(_joined_digests("_siblings", "s._sibling > place"), none).alias("after"),
    )


def levels_of(leaves: DataFrame, arity: int = ARITY) -> list[DataFrame]:
    """The stored levels of all trees, leaves first; a tree's last level is the one where ``size`` is 1.

    ``leaves`` is a stored table of ``tree, place, size, digest`` and more; the more stays on the first level only.
    """
    levels, nodes = [], leaves
    while True:
        most = nodes.agg(F.max("size").alias("m")).first()["m"]
        if most is None:
            return levels
        if most == 1:
            return [*levels, nodes.withColumns({"before": F.lit(b""), "after": F.lit(b"")})]
        level = store(with_siblings(nodes, arity), "merkle_level")
        levels.append(level)
        # Slot zero has nothing before it; its run is itself and what comes after.
        parents = level.where((F.col("size") > 1) & (F.col("place") % arity == 0))
        nodes = parents.select("tree", F.floor(F.col("place") / arity).cast("bigint").alias("place"), F.ceil(F.col("size") / arity).cast("bigint").alias("size"), node_digest(F.col("digest"), F.col("after")).alias("digest"))


def roots_of(levels: Sequence[DataFrame]) -> DataFrame:
    """``tree, digest`` of every tree."""
    found = [level.where("size = 1").select("tree", "digest") for level in levels]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def with_paths(levels: Sequence[DataFrame], tops: DataFrame, arity: int = ARITY) -> DataFrame:
    """The first level with ``path`` (siblings of the node, then of its ancestors) and all columns of ``tops``.

    ``tops`` has one row a tree: ``tree, path`` and more. Every node meets its one parent, from the top down.
    """
    carried = [c for c in tops.columns if c not in ("tree", "path")]
    own = F.array(F.struct("before", "after"))
    above = None
    for depth in reversed(range(len(levels))):
        level = levels[depth]
        kept = level.columns if depth == 0 else ["tree", "place"]
        # Trees that end here; one row each.
        ended = level.where("size = 1").join(tops, "tree").select(*kept, "path", *carried)
        if above is not None:
            parents = above.select("tree", F.col("place").alias("_parent"), F.col("path").alias("_path"), *carried)
            children = level.where("size > 1").withColumn("_parent", F.floor(F.col("place") / arity).cast("bigint"))
            ended = ended.unionByName(children.join(parents, ["tree", "_parent"]).select(*kept, F.concat(own, "_path").alias("path"), *carried))
        above = ended
    return above


def proof_digest(path: Column) -> Column:
    """Digest of all siblings, level by level, left to right."""
    return F.sha2(hex_text(F.aggregate(path, F.lit(b""), lambda a, p: F.concat(a, p["before"], p["after"]))), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, leaf, lambda digest, p: node_digest(p["before"], digest, p["after"]))


def numbered(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Add ``place`` and ``size``: position among the rows of the tree by id (NULL first, equal ids by their leaves) and number of them.

    Rows are dealt to buckets of neighbouring ids and ranked there; earlier buckets are added from a table of
    trees x buckets, so a tree of most rows is as many tasks as there are buckets.
    """
    dealt = spread_buckets(rows, id_col, F.col("digest"), partitions(rows))
    ranked = running_sum(dealt, ["tree"], [F.col(id_col).asc_nulls_first(), F.col("digest")], "_bucket", F.lit(1).cast("bigint"), "place", "size")
    return ranked.drop("_bucket")


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", columns: Sequence[str] = COLUMNS, text_col: str = "text", arity: int = ARITY) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    The leaves of a group form a tree in ascending order of ids, its root is the ``subroot``; the subroots, in
    order of the group (NULL first, then by bytes), form the tree of ``root``. A lone node is its own root. The
    check folds each row's leaf up its proof; where 3 divides the CRC-32 of the id's decimal digits, the text is first lower-cased (A-Z), as a
    tampered row: ``verified`` tells whether the root comes out. A NULL id is not tampered with.
    Repeated rows are leaves of their own, in any order; an empty table has no rows. Columns not named are not read.
    """
    texts = docs.select(*[F.col(c) for c in dict.fromkeys([id_col, group_col, *columns])])
    values = [F.col(c) for c in columns]
    changed = [ascii_lower(F.col(c)) if c == text_col else F.col(c) for c in columns]
    tampered = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 0, F.lit(False))
    # NULL has no mark, so it sorts before every value and is never taken for one.
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    rows = texts.select(F.col(id_col).cast("bigint").alias("doc_id"), tree.alias("tree"), leaf_digest(values).alias("digest"), F.when(tampered, leaf_digest(changed)).alias("tampered"))
    leaves = store(numbered(store(rows, "merkle_rows")), "merkle_leaves")
    levels = levels_of(leaves, arity)
    if not levels:
        return leaves.selectExpr("doc_id", "hex(digest) leaf", "'' subroot", "'' root", "'' proof_sha256", "'' folded_root", "true verified")
    subroots = roots_of(levels)
    ranked = running_sum(subroots.withColumn("_bucket", F.hex(F.substring(F.col("tree").cast("binary"), 1, 2))), [], ["tree"], "_bucket", F.lit(1).cast("bigint"), "place", "size")
    top_levels = levels_of(store(ranked.select(F.lit("").alias("tree"), "place", "size", "digest", F.col("tree").alias("_group")), "merkle_roots"), arity)
    whole = roots_of(top_levels).select("tree", F.array().cast("array<struct<before:binary,after:binary>>").alias("path"), F.col("digest").alias("root"))
    tops = with_paths(top_levels, whole, arity).select(F.col("_group").alias("tree"), "path", F.col("digest").alias("subroot"), "root")
    placed = with_paths(levels, store(tops, "merkle_tops"), arity)
    result = folded(F.coalesce("tampered", "digest"), F.col("path"))
    named = placed.select("doc_id", hex_text(F.col("digest")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"), hex_text(F.col("root")).alias("root"), proof_digest(F.col("path")).alias("proof_sha256"), hex_text(result).alias("folded_root"))
    return named.withColumn("verified", F.col("folded_root") == F.col("root"))
