import hashlib
import random

import numpy as np
import pytest

from anamnesis.llm import suffixes as sx
from tests.llm.common import frame, given


def expected(rows):
    """rows: id, text; windows are looked up one by one in order of id."""
    seen, out = {}, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - sx.LENGTH + 1):
            w = data[s : s + sx.LENGTH]
            if w in seen:
                gone[s : s + sx.LENGTH] = True
            else:
                seen[w] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def same(df, rows, **options):
    got = sorted(map(repr, map(tuple, sx.remove_repeats(df, **options).collect())))
    assert got == sorted(map(repr, expected(rows)))


def made(seed, n=60):
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("abcdé fgh\n") for _ in range(rnd.randint(20, 400))) for _ in range(12)]
    rows = [(i, "".join(rnd.choice(pool)[rnd.randint(0, 30) :] for _ in range(rnd.randint(0, 5)))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, "a" * 3000), (n + 3, "ab" * 999), (n + 4, "x" * 99), (n + 5, "x" * 100), (n + 6, "x" * 100), (None, pool[0] * 2)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_made(spark, seed):
    rows = made(seed)
    same(frame(spark, rows), rows)


def test_hot_names_and_small_steps(spark):
    """Every name with more than two stretches goes the way of hot names."""
    rows = made(3)
    same(frame(spark, rows), rows, most=2)


def test_hash_stretches(monkeypatch):
    data = np.frombuffer(("".join(random.Random(4).choice("abc") for _ in range(2000)) + "q" * 700).encode(), np.uint8)
    offsets = np.array([0, 50, 50, 1200, 2700])
    names = lambda: {(r, f + i, n) for r, f, s, n, _ in zip(*(x.tolist() for x in sx.named_runs(data, offsets))) for i in range(s)}
    whole = names()
    monkeypatch.setattr(sx, "STRETCH", 64)
    assert names() == whole and len(whole) == (1150 - 99) + (1500 - 99)


def test_given(spark, sf_dir):
    df, rows = given(spark, sf_dir)
    same(df, [(r["doc_id"], r["text"]) for r in rows])


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "unique words here " + "y" * 150), (2, "other")]
    got = sorted(map(tuple, sx.remove_repeats(frame(spark, rows + rows)).collect()))
    assert got == sorted(expected(rows) * 2)
    assert sx.remove_repeats(frame(spark, [])).collect() == []


def test_previous_smaller():
    rnd = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 300):
        v = rnd.permutation(n)
        want = [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(n)]
        assert sx.previous_smaller(v).tolist() == want


def test_suffix_ranks():
    data = np.frombuffer(b"abracadabra" * 3 + b"xyz", np.uint8)
    rank = sx.suffix_ranks(data, np.full(len(data), len(data)), 10)
    text = data.tobytes()
    ok = [i for i in range(len(text) - 9)]
    assert sorted(ok, key=lambda i: (rank[i], i)) == sorted(ok, key=lambda i: (text[i : i + 10], i))
    assert (rank[len(text) - 9 :] == -1).all()


def test_many_without_id(spark):
    """They come before all others; of a shared passage one of them keeps its copy."""
    rnd = random.Random(9)
    shared = "".join(rnd.choice("abcdefgh ") for _ in range(300))
    rows = [(None, f"{i} {shared}") for i in range(20)] + [(7, shared)]
    got = sx.remove_repeats(frame(spark, rows)).collect()
    assert [r["n_removed"] for r in got if r["doc_id"] == 7] == [300]
    without = sorted(r["n_removed"] for r in got if r["doc_id"] is None)
    assert len(without) == 20 and without[0] == 0 and without[1] >= 300


def test_repeated_starts_in_large_groups():
    rng = np.random.default_rng(5)
    for n, kinds in ((1, 1), (40, 5), (400, 3)):
        place, rank = rng.permutation(n), rng.integers(0, kinds, n)
        want = [bool(((rank == rank[i]) & (place < place[i])).any()) for i in range(n)]
        assert sx.repeated_starts(place, rank).tolist() == want


def test_one_passage_everywhere(spark):
    """A passage in every document, in several partitions: all copies but the first go, on the way of hot names too."""
    rnd = random.Random(11)
    word = lambda n: "".join(rnd.choice("abcdefgh ") for _ in range(n))
    shared = word(400)
    rows = [(i, f"{word(150)} {shared if i % 7 else shared[:250]} {word(120)}") for i in range(300)]
    df = frame(spark, rows).repartition(7)
    same(df, rows, most=20)
    same(df, rows)


@pytest.mark.parametrize("most", [3, sx.MOST])
def test_two_texts_of_one_id(spark, most):
    """They are ordered by a hash: one of them keeps the shared passage, and both rows of one text get one result."""
    rnd = random.Random(12)
    shared = "".join(rnd.choice("abcdefgh ") for _ in range(300))
    rows = [(1, "x" + shared), (1, "y" + shared), (1, "y" + shared)] + [(i, shared) for i in range(2, 9)]
    got = sx.remove_repeats(frame(spark, rows), most=most).collect()
    assert sorted(r["n_removed"] for r in got if r["doc_id"] == 1) in ([0, 0, 300], [0, 300, 300])
    assert {r["n_removed"] for r in got if r["doc_id"] != 1} == {300}


@pytest.mark.parametrize("most", [3, sx.MOST])
def test_longer_than_a_stretch(spark, most):
    rnd = np.random.default_rng(13)
    text = bytes(rnd.integers(97, 123, sx.STRETCH + 5000, dtype=np.uint8)).decode()
    rows = [(1, text + text[sx.STRETCH - 300 : sx.STRETCH + 300]), (2, "z" + text[sx.STRETCH - 200 :]), (3, text[:200] * 3)]
    same(frame(spark, rows), rows, most=most)
