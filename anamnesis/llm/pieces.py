"""SentencePiece encoding and decoding by vectorised merge rounds.

The words of a batch are flat numpy arrays of symbols. In each round every word finds its pair of
least rank and merges the leftmost places that have it, all words at the same time; the arrays are
compacted until no pair remains. Several places of a word are merged in one round only as far as
merging them one by one from the left would not have brought up a better pair before.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .kept import ENTRY_BYTES, KEPT_BYTES as HALF_BYTES, LONGEST_KEY
from .texts import ragged

NONE = np.int64(1) << 40
#: Longer words are cut between letters that no piece has side by side.
LONG_WORD = 64
#: Words whose ids a worker keeps, and their bytes; beyond either the table starts anew. Long ones are not kept.
KEPT_WORDS = 400_000
KEPT_BYTES = 2 * HALF_BYTES
ROUND_SYMBOLS = 1 << 18


class PieceModel:
    """Pieces, merges and byte pieces of a BPE model with byte fallback and identity normalisation."""

    SEGMENT = re.compile("▁+[^▁]*|[^▁]+")

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        self.size = size
        kinds = ["control" if model.is_control(i) else "unknown" if model.is_unknown(i) else "byte" if model.is_byte(i) else "plain" for i in range(size)]
        names = [model.id_to_piece(i) for i in range(size)]
        self.byte_id = np.zeros(256, np.int64)
        for i, kind in enumerate(kinds):
            if kind == "byte":
                self.byte_id[int(names[i][1:-1], 16)] = i
        plain = {names[i]: i for i in range(size) if kinds[i] == "plain"}
        # Letters of pieces that are no pieces themselves are symbols after the vocabulary; any other letter follows them.
        letters = sorted({c for p in plain for c in p if c not in plain})
        symbols = plain | {c: size + k for k, c in enumerate(letters)}
        self.letter_base = size + len(letters)
        self.code_of = np.arange(0x110000, dtype=np.int64) + self.letter_base
        self.letter_of = np.zeros(self.letter_base, np.int64)
        for c, i in symbols.items():
            if len(c) == 1:
                self.code_of[ord(c)] = i
                self.letter_of[i] = ord(c)
        scores = {i: model.get_score(i) for i in plain.values()}
        rank_of = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {}
        side_by_side = set()
        for piece, i in plain.items():
            for k in range(1, len(piece)):
                side_by_side.add((symbols[piece[k - 1]], symbols[piece[k]]))
                left, right = symbols.get(piece[:k]), symbols.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left * self.letter_base + right] = (rank_of[scores[i]], i)
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k][0] for k in self.pair_key.tolist()] + [NONE], np.int64)
        self.pair_into = np.array([pairs[k][1] for k in self.pair_key.tolist()] + [-1], np.int64)
        self.near_key = np.array(sorted(a * self.letter_base + b for a, b in side_by_side), np.int64)
        spelled = [
            {"plain": lambda p: p.replace("▁", " ").encode(), "byte": lambda p: bytes([int(p[1:-1], 16)]), "control": lambda p: b"", "unknown": lambda p: " ⁇ ".encode()}[kind](name)
            for name, kind in zip(names, kinds)
        ]
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        self.spelled_size = np.array([len(b) for b in spelled], np.int64)
        self.spelled_at = np.cumsum(self.spelled_size) - self.spelled_size
        self.starts_blank = np.array([k == "plain" and n.startswith("▁") for n, k in zip(names, kinds)])
        self.silent = np.array([k == "control" for k in kinds])
        self.decimal = [str(i) for i in range(size)]
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Positions in the pair table; its end where the two never merge."""
        base = self.letter_base
        key = np.where((left < base) & (right < base), left * base + right, -1)
        at = np.searchsorted(self.pair_key, key)
        at[at == len(self.pair_key)] = 0
        return np.where(self.pair_key[at] == key, at, len(self.pair_key)) if len(self.pair_key) else at

    def _cut_long(self, sym: np.ndarray, word: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Part numbers: words, long ones cut where no piece can reach across."""
        edge = word[1:] != word[:-1]
        if lengths.max(initial=0) > LONG_WORD and len(self.near_key):
            base = self.letter_base
            key = np.where((sym[:-1] < base) & (sym[1:] < base), sym[:-1] * base + sym[1:], -1)
            at = np.minimum(np.searchsorted(self.near_key, key), len(self.near_key) - 1)
            edge = edge | ((self.near_key[at] != key) & (lengths[word[1:]] > LONG_WORD))
        return np.concatenate([[0], np.cumsum(edge)])

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after the other, and how many each has."""
        lengths = np.array([len(w) for w in words], np.int64)
        letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(letters):
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        sym = self.code_of[letters]
        word = np.repeat(np.arange(len(words)), lengths)
        part = self._cut_long(sym, word, lengths)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        word_of_part = word[first]
        pair = np.full(len(sym), len(self.pair_key), np.int64)
        same = np.flatnonzero(part[1:] == part[:-1])
        pair[same] = self._find(sym[same], sym[same + 1])
        done_part, done_sym = [], []
        while len(sym):
            rank = self.pair_rank[pair]
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            size = np.diff(np.concatenate([first, [len(part)]]))
            least = np.minimum.reduceat(rank, first)
            ended = least >= NONE
            if ended.any():
                rest = np.repeat(ended, size)
                done_part.append(part[rest])
                done_sym.append(sym[rest])
                sym, part, pair, rank = sym[~rest], part[~rest], pair[~rest], rank[~rest]
                size, least = size[~ended], least[~ended]
                if not len(sym):
                    break
                first = np.cumsum(size) - size
            own = np.repeat(np.arange(len(size)), size)
            wanted = rank == least[own]
            # Of places in a row every other one, from the left.
            at = np.flatnonzero(wanted)
            run = np.concatenate([[True], at[1:] != at[:-1] + 1])
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - begin) % 2 == 0]
            at = self._until_better(sym, own, pair, least, at)
            sym[at] = self.pair_into[pair[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            changed = np.zeros(len(sym), bool)
            changed[at] = True
            sym, part, pair, changed = sym[keep], part[keep], pair[keep], changed[keep]
            changed[:-1] |= changed[1:]
            new = np.flatnonzero(changed)
            pair[new] = len(self.pair_key)
            new = new[new + 1 < len(sym)]
            new = new[part[new] == part[new + 1]]
            pair[new] = self._find(sym[new], sym[new + 1])
        part, sym = np.concatenate(done_part), np.concatenate(done_sym)
        order = np.argsort(part, kind="stable")
        return self._with_bytes(sym[order], word_of_part[part[order]], len(words))

    def _until_better(self, sym: np.ndarray, own: np.ndarray, pair: np.ndarray, least: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Merges of each word up to the first after which, taken one by one, a pair as good as this would come up."""
        same = own[at[1:]] == own[at[:-1]]
        many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        if not many.any():
            return at
        into = self.pair_into[pair[at]]
        n, end = len(sym), len(self.pair_key)
        limit = least[own[at]]
        right = np.minimum(at + 2, n - 1)
        after = np.where((at + 2 < n) & (own[right] == own[at]), self._find(into, sym[right]), end)
        before = np.maximum(at - 1, 0)
        left = sym[before]
        joined = np.concatenate([[False], at[1:] == at[:-1] + 2])
        left = np.where(joined, np.concatenate([[0], into[:-1]]), left)
        ahead = np.where((at > 0) & (own[before] == own[at]), self._find(left, into), end)
        stop = many & ((self.pair_rank[after] <= limit) | (self.pair_rank[ahead] <= limit))
        if not stop.any():
            return at
        # Merges after a word's first stop wait for a later round.
        stops = np.cumsum(stop)
        word_first = np.concatenate([[True], ~same])
        before_word = np.maximum.accumulate(np.where(word_first, stops - stop, 0))
        return at[stops - stop - before_word == 0]

    def _with_bytes(self, sym: np.ndarray, word: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no pieces become the byte pieces of their letter."""
        odd = np.flatnonzero(sym >= self.size)
        counts = np.ones(len(sym), np.int64)
        if len(odd):
            code = np.where(sym[odd] >= self.letter_base, sym[odd] - self.letter_base, self.letter_of[np.minimum(sym[odd], self.letter_base - 1)])
            spelled = [chr(c).encode("utf-8", "surrogatepass") for c in code.tolist()]
            counts[odd] = [len(b) for b in spelled]
            out = np.repeat(sym, counts)
            where = ragged((np.cumsum(counts) - counts)[odd], counts[odd])
            out[where] = self.byte_id[np.frombuffer(b"".join(spelled), np.uint8)]
            sym = out
        return sym, np.bincount(word, counts, words).astype(np.int64)

    def segments(self, text: str) -> list[str]:
        """The text behind a blank, blanks written as marks, cut before every run of marks: no piece has a mark after another letter."""
        return self.SEGMENT.findall("▁" + text.replace(" ", "▁")) if text else []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text; words are merged once and kept."""
        known = self.known
        if len(known) > KEPT_WORDS or self.held > KEPT_BYTES:
            known.clear()
            self.held = 0
        cut = [self.segments(t) for t in texts]
        missing = list(set().union(*cut).difference(known))
        at = 0
        while at < len(missing):
            end, size = at, 0
            while end < len(missing) and (end == at or size + len(missing[end]) <= ROUND_SYMBOLS):
                size += len(missing[end])
                end += 1
            ids, counts = self.merge(missing[at:end])
            data = ids.astype("<u4").tobytes()
            stop = 0
            for s, n in zip(missing[at:end], counts.tolist()):
                known[s] = data[stop : stop + 4 * n]
                stop += 4 * n
            self.held += size + len(data) + ENTRY_BYTES * (end - at)
            at = end
        out = [b"".join(map(known.__getitem__, segments)) for segments in cut]
        for s in missing:
            if len(s) > LONGEST_KEY:
                self.held -= len(s) + len(known.pop(s)) + ENTRY_BYTES
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids: marks are blanks, the blank in front goes, byte pieces are joined to letters; bytes that are no letter become U+FFFD."""
        if not len(ids):
            return ""
        data = self.spelled[ragged(self.spelled_at[ids], self.spelled_size[ids])].tobytes()
        heard = np.flatnonzero(~self.silent[ids])
        if len(heard) and self.starts_blank[ids[heard[0]]]:
            data = data[1:]
        return data.decode("utf-8", "replace")


_models: dict[str, PieceModel] = {}


def piece_model(model_file: str) -> PieceModel:
    if model_file not in _models:
        _models[model_file] = PieceModel(model_file)
    return _models[model_file]


def encode_texts(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids``: the piece ids of every whole text; none for NULL and empty ones. No shuffle."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_file)
        for batch in batches:
            ids = model.encode([t or "" for t in batch.column(1).to_pylist()])
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            ends = np.cumsum([0] + [len(b) // 4 for b in ids]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(encode, "doc_id bigint, ids array<int>")


def decode_ids(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` of lists of piece ids."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_file)
        for batch in batches:
            texts = [model.decode(np.array(ids or [], np.int64)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(decode, "doc_id bigint, text string")


def round_trip(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", batch_chars: int = 4 << 20) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text, encoded and decoded again in one pass."""

    def trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_file)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= batch_chars):
                    size += len(texts[end])
                    end += 1
                ids = [np.frombuffer(b, "<u4") for b in model.encode(texts[at:end])]
                joined = [hashlib.sha256(",".join([model.decimal[i] for i in x.tolist()]).encode()).hexdigest() for x in ids]
                decoded = [hashlib.sha256(model.decode(x).encode()).hexdigest() for x in ids]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), pa.array([len(x) for x in ids], pa.int64()), pa.array(joined), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at = end

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(trip, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
