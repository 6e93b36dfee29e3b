import zlib

import numpy as np
import pytest
from helpers import ODD, empty, frame

from gridcheck.llm import huffman
from gridcheck.llm.byte_bpe import encoder
from gridcheck.llm.queries import tokenizer_path
from gridcheck.llm.token_counts import count_tokens, piece_counts, pre_tokens
from gridcheck.llm.token_files import open_tokens, read_checks, read_tokens, write_tokens

PIECES, BYTES = tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_50k.json")


def test_pre_tokens_count_as_the_library():
    import random

    import sentencepiece

    model, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), random.Random(1)
    alphabet = [" ", "\n", "a", "b", "the", "\t", "▁", "é", "　", "<s>", "\x00", "1", "漢"]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 12)))
        assert sum(piece_counts(pre_tokens(text), PIECES)) == len(model.encode(text)), repr(text)


@pytest.mark.parametrize("hot", [0, 100_000])
def test_token_counts(spark, hot):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = count_tokens(frame(spark), PIECES, hot_entries=hot, limit=100).collect()
    want = [(i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 100) for i, t in ODD]
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got), key=str) == sorted(want, key=str)
    assert count_tokens(empty(spark), PIECES).count() == 0


@pytest.mark.parametrize("ids, size", [(1, 5), (2, 100), (300, 1000), (60000, 100000), (3, 0)])
def test_huffman_round_trip(ids, size):
    values = (np.minimum(np.random.default_rng(0).zipf(1.2, size), ids) - 1).astype(np.uint16)
    counts = np.bincount(values, minlength=1 << 16)
    lengths = huffman.code_lengths(counts)
    used = lengths[lengths > 0].astype(float)
    assert lengths.max() <= huffman.LIMIT and (len(used) < 2 or abs((2.0**-used).sum() - 1) < 1e-9)
    bits, steps = huffman.pack(values, huffman.canonical_codes(lengths), lengths)
    assert (huffman.unpack(bits, steps, size, huffman.decoding_table(lengths)) == values).all()


def test_lengths_are_optimal_where_the_limit_does_not_bind():
    import heapq

    counts = np.random.default_rng(1).integers(1, 1000, 200)
    heap, cost = [int(c) for c in counts], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    assert int((counts * huffman.code_lengths(counts)).sum()) == cost


def test_token_files(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BYTES)
    files = write_tokens(frame(spark), BYTES)
    want, start = [], 0
    ids_of = lambda t: np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    for i, text in order:
        ids = ids_of(text)
        want.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        start += len(ids) // 4
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in read_checks(files).collect()), key=lambda r: r[1]) == want
    assert [bytes(r.ids) for r in read_tokens(files).orderBy("start").collect()] == [ids_of(t) for _, t in order]
    assert read_checks(write_tokens(empty(spark), BYTES)).count() == 0
    # another session reads the folder without what the writer knew
    again = open_tokens(spark.newSession(), files.path)
    assert (again.end_id, again.n_documents, again.n_tokens) == (2, len(ODD), start)
    assert [bytes(r.ids) for r in read_tokens(again).orderBy("start").collect()] == [ids_of(t) for _, t in order]


def test_ids_are_those_of_the_library():
    import random

    from tokenizers import Tokenizer

    library, rng = Tokenizer.from_file(BYTES), random.Random(4)
    alphabet = [" ", "  ", "\n", "\n\n", "\t", "a", "The", "don't", "'s", "12", "3", "é", "漢字", "　", "\u00a0", "!", "...", "<|endoftext|>", "<s>", "_x", "\x00", "\r", "ﬁ", "😀"]
    for _ in range(5000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(encoder(BYTES).encode(text), np.uint16).tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_tokenizers_are_refused(tmp_path):
    import json

    parts = json.loads(open(BYTES, encoding="utf-8").read())
    parts["normalizer"] = {"type": "Lowercase"}
    (tmp_path / "other.json").write_text(json.dumps(parts), encoding="utf-8")
    with pytest.raises(ValueError):
        encoder(str(tmp_path / "other.json"))
