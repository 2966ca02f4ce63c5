import math
import random
from collections import Counter

import pytest

from anamnesis.llm import decontamination as dc
from tests.llm.common import frame, given


def standing(part, passage):
    size = min(3, len(part))
    own = {tuple(part[i : i + size]) for i in range(len(part) - size + 1)}
    return sum(any(passage[i : i + size] == list(g) for i in range(len(passage))) for g in own) / len(own) if part else 1.0


def expected(rows, items):
    """Every passage against every item, without an index."""
    parts = {i: dc.halves_of(dc.words((t or "").encode())) for i, t in items}
    parts = {i: p for i, p in parts.items() if p[0] or p[1]}
    if not parts:
        return {}
    df = Counter(t for q, a in parts.values() for t in {*q, *a})
    n, mean = len(parts), sum(len(q) + len(a) for q, a in parts.values()) / len(parts)
    half = max(len(q) + len(a) for q, a in parts.values())
    out = {}
    for doc, text in rows:
        words = dc.words((text or "").encode())
        for begin in range(0, max(1, len(words) - half), half):
            passage = words[begin : begin + 2 * half]
            for i, (q, a) in parts.items():
                terms = Counter(q + a)
                score = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * (dc.K1 + 1) / (c + dc.K1 * (1 - dc.B + dc.B * len(q + a) / mean)) for t, c in terms.items()}
                share = sum(s for t, s in score.items() if t in set(passage)) / sum(score.values())
                if share < dc.THRESHOLD - 1e-9:
                    continue
                oq, oa = (standing(x, passage) for x in (q, a))
                if oq >= dc.QUESTION and oa >= dc.ANSWER:
                    out[doc, i] = max(out.get((doc, i), (0, 0, 0)), (share, oq, oa))
    return out


def found(df, benchmark, **options):
    return {(r["doc_id"], r["item_id"]): (r["score"], r["question_overlap"], r["answer_overlap"]) for r in dc.contaminated(df, benchmark, **options).collect()}


def same(got, want):
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


def made():
    rnd = random.Random(8)
    word = lambda: rnd.choice("abcdefgh") + rnd.choice(["a", "en", "or", "é"]) * rnd.randint(1, 2)
    items = [(i, " ".join(word() for _ in range(rnd.randint(8, 30)))) for i in range(40)] + [(50, None), (51, ""), (52, "one"), (53, "x y"), (40, "same item text here for all of you"), (41, "same item text here for all of you")]
    rows = []
    for d in range(120):
        words = [word() for _ in range(rnd.choice([0, 5, 60, 400]))]
        if d % 3 == 0:
            leak = (items[d % 40][1] or "").split()
            if d % 2:
                leak[rnd.randrange(len(leak))] = "changed"
            at = rnd.randint(0, len(words))
            words[at:at] = leak
        rows.append((d, ", ".join(words).upper() if d % 5 == 0 else " ".join(words)))
    return rows + [(200, None), (201, ""), (202, "SAME item: text here, for all of you!"), (203, "w " * 10_000), (None, items[3][1])], items


def test_made(spark):
    rows, items = made()
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = expected(rows, items)
    same(found(frame(spark, rows), benchmark), want)
    assert len(want) >= 30
    # Smaller indexes have shorter passages only if their longest item is shorter; every verified pair of one lot is found in lots, too.
    assert found(frame(spark, rows), benchmark, lot_bytes=400).keys() >= want.keys()
    kept = dc.clean_documents(frame(spark, rows), benchmark)
    assert kept.columns == frame(spark, rows).columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(repr(d) for d, _ in rows if d not in {d for d, _ in want})


def test_given(spark, sf_dir):
    df, rows = given(spark, sf_dir)
    benchmark, items = given(spark, sf_dir, "benchmark")
    got = found(df, benchmark)
    whole = {(r["doc_id"], i["item_id"]) for r in rows for i in items if i["text"] in (r["text"] or "")}
    assert whole and got.keys() >= whole
    some = [r for r in rows if r["doc_id"] < 300]
    same({k: v for k, v in got.items() if k[0] < 300}, expected([(r["doc_id"], r["text"]) for r in some], [(i["item_id"], i["text"]) for i in items]))


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    one = spark.createDataFrame([(1, "some text of the test")], "item_id bigint, text string")
    some = frame(spark, [(1, "some text of the test"), (1, "some text of the test")])
    assert found(some, none) == {} and dc.clean_documents(some, none).count() == 2
    assert found(frame(spark, []), one) == {}
    assert dc.contaminated(some, one).count() == 2


def test_answer_column(spark):
    items = spark.createDataFrame([(1, "what colour has the sky", "blue of course"), (2, "who asks such things", None)], "item_id bigint, text string, answer string")
    docs = frame(spark, [(1, "what colour has the sky - blue of course"), (2, "what colour has the sky"), (3, "who asks such things")])
    assert set(found(docs, items, answer_col="answer")) == {(1, 1), (3, 2)}


def test_lots_change_nothing(spark):
    """A short item whose question and answer stand apart is found by the passages of the longest one, in its own lot, too."""
    items = [(1, " ".join(f"long{i}" for i in range(40))), (2, "alpha beta gamma delta epsilon zeta eta theta iota"), (3, "alpha long1 long2 kappa lambda mu")]
    apart = " ".join(["alpha beta gamma delta epsilon zeta", *[f"filler{i}" for i in range(40)], "eta theta iota"])
    rows = [(1, apart), (2, items[0][1]), (3, items[2][1]), (4, "nothing of these")]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = expected(rows, items)
    assert {(1, 2), (2, 1), (3, 3)} <= want.keys()
    for lot_bytes in (dc.LOT_BYTES, 60, 1):
        same(found(frame(spark, rows), benchmark, lot_bytes=lot_bytes), want)
        assert [r["doc_id"] for r in dc.clean_documents(frame(spark, rows), benchmark, lot_bytes=lot_bytes).collect()] == [4]
    assert len({id(x) for x in [*dc.item_lots(benchmark, lot_bytes=1)]}) == 3
