import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from anamnesis.llm import graph, simhash as sh
from tests.llm.common import frame, given


def signature_by_hand(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def expected(rows):
    prints = [signature_by_hand(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    array = np.array(prints, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(array[i] ^ array) <= 4).tolist():
            parent[max(root(i), root(j))] = min(root(i), root(j))
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return [(d, f"{prints[i]:016x}", min(least[root(i)], default=None)) for i, (d, _) in enumerate(rows)]


def same(spark, rows, **options):
    got = sh.near_duplicates(frame(spark, rows), **options).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected(rows)))


def made(seed, n=80):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "Ära", "x", "wörd", "lorem", "IPSUM"]) + str(rnd.randint(0, 40))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rnd.choice([0, 1, 3, 4, 5, 60, 400]))]
        rows.append((len(rows), " ".join(words)))
        for _ in range(rnd.choice([0, 0, 1, 4])):
            copy = list(words)
            for _ in range(rnd.choice([0, 1, 2])):
                if copy:
                    copy[rnd.randrange(len(copy))] = word()
            rows.append((len(rows), "\t".join(copy) if rnd.random() < 0.2 else " ".join(copy)))
    return rows + [(None, "no id here at all"), (1000, None), (1001, " \n "), (1001, " \n "), (None, "unlike anything that others have said so far"), (1002, "a\xa0b c d e"), (1003, "w " * 20_000)]


@pytest.mark.parametrize("key_rows", [sh.KEY_ROWS, 3])
def test_made(spark, key_rows):
    same(spark, made(5), key_rows=key_rows)


def test_given(spark, sf_dir):
    _, rows = given(spark, sf_dir)
    same(spark, [(r["doc_id"], r["text"]) for r in rows])


def test_empty(spark):
    same(spark, [])
    assert sh.representatives(frame(spark, [])).collect() == []


def test_golay_keys_meet():
    """Words of 23 bits that differ in one or two bits share an index; fingerprints at four bits share a key."""
    code = sh.Golay()
    assert (code.weight == 3).sum() == 1771 and (code.fours[code.weight == 3] > 0).all()
    rnd = np.random.default_rng(3)
    words = rnd.integers(0, 1 << 23, 500)
    other = words ^ (1 << rnd.integers(0, 23, 500)) ^ (1 << rnd.integers(0, 23, 500))
    (a, more_a), (b, more_b) = code.indices(words), code.indices(other)
    for i in range(500):
        assert set(a[i, : 6 if more_a[i] else 1].tolist()) & set(b[i, : 6 if more_b[i] else 1].tolist())
    prints = rnd.integers(-(1 << 63), 1 << 63, 300)
    flips = [sum(1 << int(x) for x in rnd.choice(64, 4, replace=False)) for _ in range(300)]
    near = (prints.view(np.uint64) ^ np.array(flips, np.uint64)).view(np.int64)
    keys = lambda p: [set(k) for k in (lambda r, k: [k[r == i].tolist() for i in range(len(p))])(*sh.keys_of(p))]
    assert all(x & y for x, y in zip(keys(prints), keys(near)))


def test_components(spark):
    rnd = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(30)] + [(7, 7)] + [(200, x) for x in range(201, 260)]
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()))
    label = {x: x for e in edges for x in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: label[x] for x in linked}


def test_representatives(spark):
    rows = made(6)
    kept = sh.representatives(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    want = sorted({c for d, _, c in expected([r for r in rows if r[0] is not None])})
    got = [r["doc_id"] for r in kept.collect()]
    assert sorted(d for d in got if d is not None) == want and got.count(None) == 2


def test_representatives_of_repeated_ids(spark):
    """A text that copies nothing stays, whatever other texts carry its id."""
    rnd = random.Random(9)
    text = lambda n: " ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(n))
    rows, want = [], []
    for i in range(0, 40, 2):
        a, b, c = text(400), text(30), text(25)
        near = a + " " + text(1)
        assert (signature_by_hand(a) ^ signature_by_hand(near)).bit_count() <= 4
        rows += [(i, a), (i + 1, near), (i + 1, b), (i + 1, b), (i + 1, c)]
        want += [(i, a), (i + 1, b), (i + 1, c)]
    assert sorted((r["doc_id"], r["text"]) for r in sh.representatives(frame(spark, rows)).collect()) == sorted(want)
