import math
import random
import re
from collections import Counter

import pytest

from anamnesis.llm import lexical_search as ls
from tests.llm.common import frame, given

PATTERN = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return PATTERN.findall((text or "").translate(LOWER))


def expected(docs, items, top=10):
    """Every document for every item."""
    counted = [(d, Counter(split(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    N, L = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for i, text in set(items):
        own = set(split(text))
        scored = []
        for d, c, n in counted:
            m = 100 - 90 + (90 * n * N) // L
            s = sum(math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, d is not None, d or 0))
        out += [(i, k + 1, d if there else None, -s) for k, (s, there, d) in enumerate(sorted(scored)[:top])]
    return out


def same(docs, items, rows, queries, **options):
    got = ls.search(docs, items, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = expected(rows, queries, options.get("top", 10))
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    return want


def made(seed, n=400):
    rnd = random.Random(seed)
    common = ["the", "of", "And", "été", "中文"]
    word = lambda: rnd.choice(common) if rnd.random() < 0.5 else rnd.choice("abcdef") + str(rnd.randint(0, 60))
    rows = [(i, rnd.choice([" ", ", ", "-"]).join(word() for _ in range(rnd.choice([0, 1, 7, 40, 300])))) for i in range(n)]
    copy = " ".join(word() for _ in range(30))
    rows += [(1000 + i, copy) for i in range(60)] + [(2000, None), (2001, "..."), (None, copy), (None, "THE a1"), (3, "of a1 a1"), (3, "of a1 a1"), (2002, "a1 " * 20_000)]
    rnd.shuffle(rows)
    items = [(i, " ".join(word() for _ in range(rnd.randint(1, 25)))) for i in range(30)]
    return rows, items + [(50, copy), (51, copy), (52, None), (53, "--"), (54, "nowhere"), (54, "nowhere"), (None, "a1 the"), (55, "a1"), (55, "The THE the")]


@pytest.mark.parametrize("segment,short", [(None, None), (2000, 16), (300, 2), (20_000, 10**6), (20_000, 1)])
def test_made(spark, monkeypatch, segment, short):
    """Any cut into segments and any limit of short lists gives the same."""
    if segment:
        monkeypatch.setattr(ls, "SEGMENT_BYTES", segment)
        monkeypatch.setattr(ls, "SHORT_SHARE", short)
    rows, items = made(segment or 1)
    benchmark = spark.createDataFrame([(*i, "x", "y") for i in items], "item_id bigint, text string, doc_id string, score string")
    assert len(same(frame(spark, rows), benchmark, rows, items, lot_bytes=200 if segment == 300 else ls.LOT_BYTES)) > 200


def test_small_tables(spark):
    items = [(1, "some Text"), (2, "other")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    for rows in ([], [(1, None)], [(1, "text")], [(i, "some text") for i in range(30)]):
        same(frame(spark, rows), benchmark, rows, items)
        assert ls.search(frame(spark, rows), none).collect() == []
    same(frame(spark, [(i, "some text") for i in range(30)]), benchmark, [(i, "some text") for i in range(30)], items, top=3)


def test_skips(monkeypatch):
    """Blocks and documents that cannot be among the best are not looked up."""
    import numpy as np

    n = 64 * 200
    lengths = np.full(n, 50, np.int64)
    rare, common = np.arange(5, dtype="<i4"), np.arange(n, dtype="<i4")
    lists = ls.Lists(np.array([0, 1]), np.array([5, n]), np.concatenate([rare, common]), np.ones(n + 5, "<i4"), lengths, np.array([ls.weight(n, 5), 1]), n, 50 * n)
    seen = []
    best = ls.Best(5)
    best.ids = list(range(n))
    offer = best.offer
    monkeypatch.setattr(best, "offer", lambda doc, score: (seen.append(len(doc)), offer(doc, score)))
    lists.search(np.array([0, 1]), best)
    assert [d for *_, d in best.rows] == [0, 1, 2, 3, 4] and len(seen) == 1


def test_given(spark, sf_dir):
    df, rows = given(spark, sf_dir)
    benchmark, items = given(spark, sf_dir, "benchmark")
    assert same(df, benchmark, [(r["doc_id"], r["text"]) for r in rows], [(i["item_id"], i["text"]) for i in items])
