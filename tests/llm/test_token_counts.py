import random

from hypothesis import given as cases, settings, strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from anamnesis.llm import queries, token_counts as tc
from tests.llm.common import frame, given

MODEL = queries.tokenizer_path("piece_bpe_32k.model")


def greedy(word, begins, goes_on):
    at, n = 0, 0
    while at < len(word):
        pieces = goes_on if at else begins
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return -1
        at, n = end, n + 1
    return n


@settings(max_examples=300, deadline=None)
@cases(st.sets(st.text("abc", min_size=1, max_size=4)), st.sets(st.text("abc", min_size=1, max_size=4)), st.lists(st.text("abcd", max_size=9), max_size=20))
def test_small_vocabularies(begins, goes_on, words):
    automaton = tc.Automaton(begins, goes_on)
    for w in words:
        assert automaton.count(w) == greedy(w, begins, goes_on)


def test_library_agrees():
    begins, goes_on = tc.piece_vocabulary(MODEL)
    vocabulary = {t: i for i, t in enumerate(dict.fromkeys(["[UNK]", *begins, *("##" + p for p in goes_on)]))}
    library = Tokenizer(models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=10_000))
    library.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    automaton = tc.Automaton(begins, goes_on)
    rnd = random.Random(4)
    words = ["".join(rnd.choice("aeinrstlo#▁é漢.Q") for _ in range(rnd.randint(1, 20))) for _ in range(3000)]
    for w in words:
        assert max(1, automaton.count(w)) == len(library.encode(w).ids) or "##" in w


def expected(rows):
    begins, goes_on = map(set, tc.piece_vocabulary(MODEL))
    out = []
    for d, t in rows:
        counts = [greedy(w, begins, goes_on) for w in (t or "").split()]
        out.append((d, len(counts), sum(c if c > 0 else 1 for c in counts), sum(c < 0 for c in counts)))
    return out


def same(df, rows):
    assert sorted(map(repr, map(tuple, tc.token_counts(df, MODEL).collect()))) == sorted(map(repr, expected(rows)))


def test_rows(spark):
    rows = [(1, None), (2, ""), (2, ""), (None, "word"), (3, " \n\t "), (4, "漢字 😀 a▁b ##x"), (5, "running " * 20_000), (6, "x" * 400)]
    same(frame(spark, rows), rows)
    same(frame(spark, []), [])


def test_given(spark, sf_dir):
    df, rows = given(spark, sf_dir)
    same(df, [(r["doc_id"], r["text"]) for r in rows])
