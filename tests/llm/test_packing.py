import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from anamnesis.llm import orders, packing, queries
from tests.llm.common import by_id, frame, given

PATH = queries.tokenizer_path("word_bpe_49k.json")


def least(at, penalty, window, short):
    """Every cut against every earlier one."""
    cost = [0]
    for j in range(1, len(at)):
        options = []
        for i in range(j):
            n = at[j] - at[i]
            if n <= window:
                options.append(cost[i] + (short if n < window and n & (n - 1) == 0 else window - n))
                options.append(cost[i] + window - n)
        cost.append(min(options) + penalty[j])
    return cost[-1]


def cost_of(cuts, at, penalty, window, short):
    place = {a: p for a, p in zip(at, penalty)}
    total, last = 0, 0
    for c in cuts:
        n = c - last
        assert 0 < n <= window
        total += place[c] + (min(short, window - n) if n & (n - 1) == 0 else window - n)
        last = c
    assert last == at[-1]
    return total


@pytest.mark.parametrize("seed", range(40))
def test_least_cost(seed):
    rnd = random.Random(seed)
    window, short = rnd.choice([8, 16, 64]), rnd.choice([1, 3, 10])
    at = [0]
    for _ in range(rnd.randint(1, 120)):
        at.append(at[-1] + rnd.randint(1, rnd.choice([2, window])))
    penalty = [0, *(rnd.choice([0, 2, 9]) for _ in at[1:])]
    cuts = packing.choose_cuts(np.array(at), np.array(penalty), window, short).tolist()
    assert cost_of(cuts, at, penalty, window, short) == least(at, penalty, window, short)


def test_candidates():
    enders = np.zeros(10, bool)
    enders[7] = True
    ids = np.array([1, 7, 2, 2, 2] + [3] * 200 + [7, 2])
    at, cost = packing.candidates(ids, np.array([3, len(ids)]), enders, 4)
    have = dict(zip(at.tolist(), cost.tolist()))
    assert have[0] == have[3] == have[len(ids)] == 0 and have[2] == have[206] == packing.SENTENCE
    assert np.diff(at).max() <= 4 and set(range(len(ids) - 4, len(ids))) <= have.keys()


def whole(rows, docs, window=4096):
    """Every id in exactly one piece, gapless offsets, right digests; returns padding and number of ids."""
    tokenizer = Tokenizer.from_file(PATH)
    want = {}
    for d, t in docs:
        want.setdefault(d, []).append(tokenizer.encode(t or "", add_special_tokens=False).ids + [2])
    got = by_id(rows)
    assert got.keys() == want.keys()
    for d, texts in want.items():
        if len(texts) > 1:
            assert sum(r["length"] for r in got[d]) == sum(map(len, texts))
            continue
        at = 0
        for r in sorted(got[d], key=lambda r: r["start"]):
            ids = texts[0][at : at + r["length"]]
            assert (r["start"], r["doc_tokens"]) == (at, len(texts[0])) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
            at += r["length"]
        assert at == len(texts[0])
    sequences = by_id(rows, "sequence_id")
    assert sorted(sequences) == list(range(len(sequences)))
    padding = 0
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    flat = [r for s in sorted(sequences) for r in sorted(sequences[s], key=lambda r: r["offset"])]
    ids = [r["doc_id"] for r in flat if r["doc_id"] is not None]
    assert ids == sorted(ids)
    return padding, sum(r["length"] for r in rows)


def test_rows(spark):
    rows = [(5, None), (6, ""), (6, ""), (None, "x. y"), (None, None), (7, "long words. " * 10_000), (8, "no end " * 6000), (9, "q" * 5000)] + [(20 + i, f"text {i}. more! " * i) for i in range(30)]
    padding, n = whole(packing.pack(frame(spark, rows), PATH).collect(), rows)
    assert padding < n * 0.05
    assert packing.pack(frame(spark, []), PATH).collect() == []
    assert [tuple(r)[1:3] + tuple(r)[4:] for r in packing.pack(frame(spark, [(1, None)]), PATH).collect()] == [(0, 1, 1, 0, 0)]


def test_stretches_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 9000)
    monkeypatch.setattr(packing, "BUCKET_DOCS", 40)
    rnd = random.Random(4)
    rows = [(i if i % 3 else 100, " ".join(rnd.choice(["one", "two.", "three", "four!"]) for _ in range(rnd.choice([0, 3, 50, 2000])))) for i in range(300)]
    padding, n = whole(packing.pack(frame(spark, rows), PATH).collect(), rows)
    assert padding < n * 0.05


def test_given(spark, sf_dir):
    df, rows = given(spark, sf_dir)
    padding, n = whole(packing.pack(df, PATH).collect(), [(r["doc_id"], r["text"]) for r in rows])
    assert padding < n * 0.01


def test_spread_buckets(spark):
    """A repeated id and NULL fill several buckets, and no bucket falls as ids rise."""
    rows = [(None, str(i)) for i in range(300)] + [(7, str(i)) for i in range(400)] + [(i, "") for i in range(300)]
    out = orders.spread_buckets(frame(spark, rows), "doc_id", orders.F.col("text"), 10).select("doc_id", "_bucket").collect()
    assert len(out) == 1000 and max(sum(r["_bucket"] == b for r in out) for b in range(10)) < 320
    for spread in (None, 7):
        assert len({r["_bucket"] for r in out if r["doc_id"] == spread}) >= 3
    ranges = {}
    for r in out:
        ranges.setdefault(-1 if r["doc_id"] is None else r["doc_id"], []).append(r["_bucket"])
    keys = sorted(ranges)
    assert all(max(ranges[a]) <= min(ranges[b]) for a, b in zip(keys, keys[1:]))
