import hashlib
from statistics import median

import numpy as np
import pytest

from anamnesis.llm import fingerprints as fp
from tests.llm.common import frame, given


def digest_by_hand(data):
    counts = [0] * fp.BUCKETS
    for at in range(len(data) - fp.WINDOW + 1):
        for salt, (i, j, k) in enumerate(fp.TRIPLETS):
            mixed = (int(fp._TABLES[0][data[at + i]]) + int(fp._TABLES[1][data[at + j]]) + int(fp._TABLES[2][data[at + k]])) % 2**32
            counts[(mixed ^ mixed >> 15) * (0x2C1B3C6D + 2 * salt) % 2**32 >> 24] += 1
    return counts


def expected(rows):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    out = []
    for i, (doc_id, text) in enumerate(ordered):
        text, following = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        k = len(text) // 4
        changed = text[: len(text) - k] + following[:k]
        own, new, other = fp.digests([text.encode(), changed.encode(), following.encode()])
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), fp.encode(own), fp.encode(new), float(fp.likeness(own[None], new[None])[0]), float(fp.likeness(own[None], other[None])[0])))
    return out


def same(got, want):
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_counts_by_hand(monkeypatch):
    texts = [b"", b"abcd", b"hello world, hello", "é😀 naïve".encode() * 3, b"x" * 300]
    want = [digest_by_hand(t) for t in texts]
    assert fp.triplet_counts(texts).tolist() == want
    monkeypatch.setattr(fp, "STRETCH", 7)
    assert fp.triplet_counts(texts).tolist() == want


def test_encoding_is_kept():
    for d in fp.digests([b"", b"some text of words", b"z" * 5000]):
        assert (fp.decode(fp.encode(d)) == d).all()


@pytest.mark.parametrize("rows", [
    [],
    [(1, "alone in the world")],
    [(1, None), (2, ""), (3, "abc"), (3, "abc"), (3, "abd"), (None, "no id"), (None, None), (9, "ab" * 300_000), (7, "é😀ß" * 50)],
])
def test_rows(spark, rows):
    got = fp.compare_with_edits(frame(spark, rows)).collect()
    same(got, expected(rows))


def test_given(spark, sf_dir):
    df, rows = given(spark, sf_dir)
    got = fp.compare_with_edits(df).collect()
    same(got, expected([(r["doc_id"], r["text"]) for r in rows]))
    assert median(r["near_edited"] for r in got) > 0.7 > 0.4 > median(r["near_next"] for r in got)
    assert {r["doc_id"]: r["fingerprint"] for r in fp.with_fingerprint(df).collect()} == {r["doc_id"]: r["fingerprint"] for r in got}


def test_likeness_is_bounded():
    a, b = fp.digests([b"", bytes(range(256)) * 40])
    assert fp.likeness(a[None], a[None])[0] == 1.0
    assert 0.0 <= fp.likeness(a[None], b[None])[0] < 0.3
    assert np.all(fp.differences(a[None], b[None], 10) == 10)


def plain_digest(data):
    """Length code, ratios and codes of one text, one bucket after the other."""
    import math

    counts = digest_by_hand(data)
    ranked = sorted(counts)
    q1, q2, q3 = ranked[63], ranked[127], ranked[191]
    length = min(255, int(math.log(1 + len(data)) / math.log(1.1)))
    codes = [0 if c <= q1 else 1 if c <= q2 else 2 if c <= q3 else 3 for c in counts]
    return length, q1 * 15 // max(1, q3), q2 * 15 // max(1, q3), codes


def plain_text(digest):
    length, r1, r2, codes = digest
    bits = "".join(f"{c:02b}" for c in codes)
    return f"{length:02x}{r1:x}{r2:x}" + "".join(f"{int(bits[i : i + 8], 2):02x}" for i in range(0, len(bits), 8))


def plain_likeness(a, b):
    apart = 2 * abs(a[0] - b[0]) + abs(a[1] - b[1]) + abs(a[2] - b[2])
    for x, y in zip(a[3], b[3]):
        apart += 6 if abs(x - y) == 3 else abs(x - y)
    return 1 - min(400, apart) / 400


def test_digest_and_score_by_hand(spark):
    """Quartile codes, ratios, length, their text and the bounded score, all written out again."""
    import random

    rnd = random.Random(11)
    words = [rnd.choice("abcdefghé") * rnd.randint(1, 3) + str(rnd.randint(0, 30)) for _ in range(60)]
    texts = [" ".join(rnd.choice(words) for _ in range(n)) for n in (0, 1, 5, 40, 200, 200, 900)]
    texts += [texts[4].replace("a", "b"), texts[5] + " more", "é" * 700, "", texts[3]]
    digests = [plain_digest(t.encode()) for t in texts]
    assert [fp.encode(d) for d in fp.digests([t.encode() for t in texts])] == [plain_text(d) for d in digests]
    rows = {r["doc_id"]: r for r in fp.compare_with_edits(frame(spark, list(enumerate(texts)))).collect()}
    for i, text in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        k = len(text) // 4
        changed = plain_digest((text[: len(text) - k] + following[:k]).encode())
        r = rows[i]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (plain_text(digests[i]), plain_text(changed))
        assert r["near_edited"] == pytest.approx(plain_likeness(digests[i], changed), abs=1e-12)
        assert r["near_next"] == pytest.approx(plain_likeness(digests[i], digests[(i + 1) % len(texts)]), abs=1e-12)
