import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from anamnesis.llm import queries, token_store as ts
from tests.llm.common import frame, given

PATH = queries.tokenizer_path("word_bpe_49k.json")


def expected(rows):
    tokenizer = Tokenizer.from_file(PATH)
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, np.array(ids[i], "<u2").tobytes()))
    out, start = [], 0
    for i in order:
        out.append((rows[i][0], start, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())))
        start += len(ids[i])
    return out


def same(df, rows):
    assert sorted(map(repr, map(tuple, ts.round_trip(df, PATH).collect()))) == sorted(map(repr, expected(rows)))


def test_rows(spark):
    odd = ["it's 'stuff <|endoftext|> <|ENDOFTEXT|>", "É e\u0301 İ I\u0307 ΑΣ œuvre ½ ² ß", "a\u00a0b\u2003c x\x1cy\x00z", "l'été c'est 'd 'll,,.. --- &amp;", "٣4٥6 中文字", "A\tB\r\nC  D"]
    rows = [(5, None), (6, ""), (6, ""), (None, "x"), (None, None), (7, "long words " * 10_000), (8, "q" * 5000)] + [(10 + i, t) for i, t in enumerate(odd)]
    same(frame(spark, rows), rows)
    same(frame(spark, []), [])
    same(frame(spark, [(1, None)]), [(1, None)])


def test_given(spark, sf_dir):
    df, rows = given(spark, sf_dir)
    same(df, [(r["doc_id"], r["text"]) for r in rows])


@pytest.mark.parametrize("n,limit", [(1, 18), (2, 18), (3, 2), (40, 6), (500, 12), (500, 9)])
def test_code_lengths(n, limit):
    """Within the limit, a whole prefix code, and as short as Huffman's where the limit does not bind."""
    import heapq

    rnd = random.Random(n)
    counts = np.zeros(n + 5, np.int64)
    counts[rnd.sample(range(n + 5), n)] = [int(1.3 ** rnd.randint(0, 30)) for _ in range(n)]
    lengths = ts.code_lengths(counts, limit)
    used = counts > 0
    assert (lengths[used] >= 1).all() and lengths.max() <= limit and (lengths[~used] == 0).all()
    assert n == 1 or sum(2.0 ** -lengths[used]) == 1.0
    if n > 1:
        heap = sorted(counts[used].tolist())
        best = 0
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            best += a + b
            heapq.heappush(heap, a + b)
        assert (counts * lengths).sum() >= best and ((counts * lengths).sum() == best or limit <= 12)


def test_blocks_decode_alone():
    rnd = np.random.default_rng(1)
    ids = np.minimum(rnd.geometric(0.02, 5000), 900)
    lengths = ts.code_lengths(np.bincount(ids))
    codes = ts.canonical_codes(lengths)
    parts = [ids[:1], ids[1:129], ids[129:129], ids[129:4000], ids[4000:]]
    blocks = [(*ts.pack(p, lengths, codes), len(p)) for p in parts]
    decoder = ts.Decoder(lengths)
    for got, want in zip(decoder.unpack(blocks), parts):
        assert got.tolist() == want.tolist()
    assert decoder.unpack([blocks[3]])[0].tolist() == parts[3].tolist()


def test_too_many_ids():
    with pytest.raises(ValueError):
        ts.code_lengths(np.ones(5, np.int64), 2)
