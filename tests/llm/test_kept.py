from anamnesis.llm import pieces, queries, token_counts, token_store, toxicity
from anamnesis.llm.kept import ENTRY_BYTES, LONGEST_KEY, Kept


def test_bounded_and_right():
    made = []

    def make(key):
        made.append(key)
        return key.encode()

    table = Kept(make, limit=10 * (4 + ENTRY_BYTES))
    for i in range(1000):
        assert table["hot"] == b"hot" and table[f"{i:02}"[:2]] is not None
        table.trim()
        assert len(table) + len(table.old) <= 24
    assert made.count("hot") == 1
    long = "x" * (LONGEST_KEY + 1)
    assert table[long] == long.encode() and long not in table


def test_texts_without_blanks_are_not_kept():
    """Long stretches of letters, of signs beyond Latin and of mixed ones: right ids, and no copy stays."""
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), token_store.WordEncoder(path)
    texts = ["中文字" * 3000, "aB9" * 4000, "é" * 9000, "word " * 10 + "日本" * 500]
    for t in texts:
        ids = library.encode(t, add_special_tokens=False).ids
        assert list(memoryview(encoder.encode(t)).cast(encoder.code)) == ids
    assert max(map(len, [*encoder.known, *encoder.parts])) <= LONGEST_KEY
    model = pieces.PieceModel(queries.tokenizer_path("piece_bpe_32k.model"))
    once = model.encode(texts)
    assert max(map(len, model.known), default=0) <= LONGEST_KEY and model.encode(texts) == once
    toxicity.features("q" * 5000)
    assert max(map(len, toxicity._numbers), default=0) <= LONGEST_KEY


def test_bytes_of_kept_pieces(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_BYTES", 2000)
    model = pieces.PieceModel(queries.tokenizer_path("piece_bpe_32k.model"))
    fresh = pieces.PieceModel(queries.tokenizer_path("piece_bpe_32k.model"))
    for i in range(50):
        text = [f"some words {i} and more{i}"]
        assert model.encode(text) == fresh.encode(text)
        assert model.held <= 2000 + 8 * 300 and model.held >= sum(len(k) + len(v) for k, v in model.known.items())


def test_other_files_are_refused(tmp_path):
    import json

    import pytest

    settings = json.loads(open(queries.tokenizer_path("word_bpe_49k.json"), encoding="utf-8").read())
    settings["normalizer"]["normalizers"] = settings["normalizer"]["normalizers"][:2]
    (tmp_path / "other.json").write_text(json.dumps(settings), "utf-8")
    with pytest.raises(ValueError, match="not a word tokenizer"):
        token_store.WordEncoder(str(tmp_path / "other.json"))


def test_counts_of_long_words():
    automaton, known = token_counts._automaton(queries.tokenizer_path("piece_bpe_32k.model"))
    assert automaton.count("z" * 2000) != 0
