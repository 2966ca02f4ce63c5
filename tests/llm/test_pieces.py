import hashlib
import random

import numpy as np
import sentencepiece
from hypothesis import given as cases, settings, strategies as st

from anamnesis.llm import pieces, queries
from tests.llm.common import frame, given

MODEL = queries.tokenizer_path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
OWN = pieces.piece_model(MODEL)


def agree(texts):
    for text, ids in zip(texts, OWN.encode(texts)):
        ids = np.frombuffer(ids, "<u4").tolist()
        want = LIBRARY.encode(text)
        assert ids == want, repr(text)
        assert OWN.decode(np.array(ids, np.int64)) == LIBRARY.decode(want), repr(text)


def test_odd_texts():
    agree(["", " ", "  ", " a", "a ", "▁", "▁ x", "a▁b", "é😀\x00\n<s> </s> <0x0A> <unk>", "x" * 3000, "ab" * 2000, " " * 9, "\t\r\n", "中文字" * 40, "e\u0301", "\ufffd"])


def test_made_texts():
    rnd = random.Random(1)
    plain = [LIBRARY.id_to_piece(i).replace("▁", " ") for i in range(3, 32000)]
    agree(["".join(rnd.choice(plain) for _ in range(rnd.randint(1, 40))) for _ in range(1500)])
    agree(["".join(rnd.choice("aetonirs hé中\n▁.") for _ in range(rnd.randint(1, 200))) for _ in range(1500)])
    agree(["".join(rnd.choice(["the", "and", "ing", "ation", "er"]) for _ in range(2000)), "".join(rnd.choice("abcdefgh") for _ in range(20_000))])


@settings(max_examples=200, deadline=None)
@cases(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=5))
def test_any_text(texts):
    agree(texts)


def test_small_rounds(monkeypatch):
    """The same ids when words come in many small lots and the table of known words starts anew."""
    monkeypatch.setattr(pieces, "ROUND_SYMBOLS", 20)
    monkeypatch.setattr(pieces, "KEPT_WORDS", 3)
    agree(["some words to be merged again and again", "some other words"])


def expected(rows):
    hashed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return [(d, len(ids), hashed(",".join(map(str, ids))), hashed(LIBRARY.decode(ids))) for d, ids in ((d, LIBRARY.encode(t or "")) for d, t in rows)]


def same(df, rows):
    assert sorted(map(repr, map(tuple, pieces.round_trip(df, MODEL).collect()))) == sorted(map(repr, expected(rows)))


def test_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, " text"), (3, "long text " * 20_000), (4, "y" * 30_000)]
    same(frame(spark, rows), rows)
    same(frame(spark, []), [])
    ids = pieces.encode_texts(frame(spark, rows), MODEL)
    back = {r["doc_id"]: r["text"] for r in pieces.decode_ids(ids, MODEL).collect()}
    assert back == {d: t or "" for d, t in rows}


def test_given(spark, sf_dir):
    df, rows = given(spark, sf_dir)
    same(df, [(r["doc_id"], r["text"]) for r in rows])
