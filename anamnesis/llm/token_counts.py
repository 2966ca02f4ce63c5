"""Token counts: the lengths of greedy word pieces, counted by a longest-match automaton.

A trie of the vocabulary has two roots, for pieces that begin a word and for pieces that go on with
one. Where no child fits the next letter, the failure link leads to the state that is left after
the longest pieces seen so far are taken off, and the number of these pieces is stored with it. So a
word is read once, letter by letter, and no piece is built.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kept import LONGEST_KEY

START, GOES_ON = 0, 1
#: Words whose counts a worker keeps; beyond it the table starts anew.
KEPT_WORDS = 500_000


class Automaton:
    """``count(word)``: how many pieces the greedy longest match gives, or -1 where it gets stuck."""

    def __init__(self, begins: Iterable[str], goes_on: Iterable[str]) -> None:
        self.children: list[dict[str, int]] = [{}, {}]
        final = [False, False]
        for root, pieces in ((START, begins), (GOES_ON, goes_on)):
            for piece in pieces:
                at = root
                for letter in piece:
                    step = self.children[at].get(letter)
                    if step is None:
                        step = len(self.children)
                        self.children.append({})
                        final.append(False)
                        self.children[at][letter] = step
                    at = step
                if at != root:
                    final[at] = True
        n = len(self.children)
        self.fail: list[int] = [-1] * n
        self.popped: list[int] = [0] * n
        queue = [START, GOES_ON]
        for at in queue:
            for letter, step in self.children[at].items():
                if final[step]:
                    self.fail[step], self.popped[step] = GOES_ON, 1
                else:
                    link, taken = self.fail[at], self.popped[at]
                    while link >= 0 and letter not in self.children[link]:
                        taken += self.popped[link]
                        link = self.fail[link]
                    if link >= 0:
                        self.fail[step], self.popped[step] = self.children[link][letter], taken
                queue.append(step)

    def count(self, word: str) -> int:
        at, taken = START, 0
        children, fail, popped = self.children, self.fail, self.popped
        for letter in word:
            step = children[at].get(letter)
            while step is None:
                if fail[at] < 0:
                    return -1
                taken += popped[at]
                at = fail[at]
                step = children[at].get(letter)
            at = step
        while at != GOES_ON:
            if fail[at] < 0:
                return -1 if word else 0
            taken += popped[at]
            at = fail[at]
        return taken


def piece_vocabulary(model_file: str) -> tuple[list[str], list[str]]:
    """Pieces that begin a word and pieces that go on with it, from a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    plain = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return [p[1:] for p in plain if len(p) > 1 and p[0] == "▁" and "▁" not in p[1:]], [p for p in plain if "▁" not in p]


_loaded: dict[str, tuple[Automaton, dict[str, int]]] = {}


def _automaton(model_file: str) -> tuple[Automaton, dict[str, int]]:
    if model_file not in _loaded:
        _loaded[model_file] = Automaton(*piece_vocabulary(model_file)), {}
    return _loaded[model_file]


def token_counts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown``: greedy word pieces of every whole text.

    Words are split at white space. A word that the pieces cannot make up is one unknown token. A
    NULL or empty text has no words. One pass without a shuffle; a worker builds the automaton
    once and keeps the counts of a bounded number of words.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _automaton(model_file)
        for batch in batches:
            words_, tokens, unknown = [], [], []
            for text in batch.column(1).to_pylist():
                words = (text or "").split()
                if len(known) > KEPT_WORDS:
                    known.clear()
                n = bad = 0
                for word in words:
                    c = known.get(word)
                    if c is None:
                        c = automaton.count(word)
                        if len(word) <= LONGEST_KEY:
                            known[word] = c
                    if c < 0:
                        bad += 1
                    else:
                        n += c
                words_.append(len(words))
                tokens.append(n + bad)
                unknown.append(bad)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (words_, tokens, unknown))], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(count, "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint")
