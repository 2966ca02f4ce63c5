import hashlib
import zlib

import pytest

from anamnesis.llm import merkle
from tests.llm.common import frame, given

COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in COLUMNS])


def tree_of(leaves, arity):
    """Root and, for each leaf, the list of (before, after) up to it."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i, place in enumerate(at):
            first = place - place % arity
            paths[i].append((nodes[first:place], nodes[place + 1 : first + arity]))
        nodes = [h(*nodes[i : i + arity]) for i in range(0, len(nodes), arity)]
        at = [p // arity for p in at]
    return nodes[0], paths


def expected(rows, arity=8):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        own = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
        trees.append((own, *tree_of([leaf_of(r) for r in own], arity)))
    if not trees:
        return []
    root, tops = tree_of([t[1] for t in trees], arity)
    out = []
    for (own, subroot, paths), top in zip(trees, tops):
        for r, path in zip(own, paths):
            bad = dict(r)
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
                bad["text"] = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            digest = leaf_of(bad)
            for before, after in path + top:
                digest = h(*before, digest, *after)
            proof = h(*[d for before, after in path + top for d in before + after])
            out.append((r["doc_id"], leaf_of(r), subroot, root, proof, digest, digest == root))
    return out


def same(df, arity=8, rows=None):
    rows = [r.asDict() for r in df.collect()] if rows is None else rows
    got = merkle.manifest(df, arity=arity)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(repr, map(tuple, got.collect())))
    assert got == sorted(map(repr, expected(rows, arity)))
    return got


@pytest.mark.parametrize("arity", [2, 3, 8])
def test_rows(spark, arity):
    langs = ["en", None, "", "de", "éa", "zz", "fr", "es", "it", "nl"]
    rows = [(i, f"Text {i} Ä" if i % 4 else None, langs[0] if i % 2 else langs[i % 10], None if i % 7 == 0 else "S", None if i % 5 == 0 else i) for i in range(150)]
    rows += [(None, "no id A", "en", "s", 1), (10**15, "", "only", "s", 0), (-3, "MINUS", "en", "s", 5)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, tree string, place string, digest string")
    out = same(df, arity)
    assert any("True" in r for r in out) and any("False" in r for r in out)


def test_repeated_and_lone_rows(spark):
    same(frame(spark, [(3, "A"), (3, "A"), (3, "A"), (4, "B")]))
    same(frame(spark, [(3, "A long TEXT " * 50_000)]))
    same(frame(spark, []))
    assert merkle.manifest(frame(spark, [(1, None)])).first()["proof_sha256"] == h("")


def test_equal_ids(spark):
    """Rows of one id and of NULL: every proof holds under one root, whatever their order."""
    rows = [(None if i % 2 else 5, f"text {i}") for i in range(100)]
    out = merkle.manifest(frame(spark, rows)).collect()
    assert len(out) == 100 and len({r["root"] for r in out}) == 1 and len({r["proof_sha256"] for r in out}) == 100
    assert all(r["verified"] for r in out)


def test_given(spark, sf_dir):
    df, rows = given(spark, sf_dir)
    same(df, 8, rows)
