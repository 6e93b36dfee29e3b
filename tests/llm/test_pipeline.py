"""The pipeline stage by stage on a small corpus whose outcome is known, and its last table against the library."""

import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline as P
from gridcheck.llm.queries import tokenizer_path


def test_stages_and_run(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    plain = lambda n: [word() for _ in range(n)]
    item, line = " ".join(plain(40)), " ".join(plain(12))
    rows = [(k, " ".join(plain(60 + k % 90)) + f"\n{line}\n" + " ".join(plain(30)), "hot" if k % 3 else "rare") for k in range(120)]
    near = rows[10][1].split(" ")
    near[5] = "changed"
    rows += [(200, rows[10][1], "hot"), (201, " ".join(near), "hot"), (202, "too short", "hot"), (203, None, None), (204, item + " " + " ".join(plain(60)), "hot"), (205, " ".join(["again and again"] * 60), "rare")]
    spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), ["doc_id", "text", "lang", "source", "n_chars"]
    left, held = {i for i, _, _ in rows} - {202, 203, 205}, []
    for (name, stage), gone in zip(P.STAGES[:-1], (set(), {200, 201}, {204}, set())):
        docs = P.written(stage(spark, docs, str(tmp_path)), name)
        held = docs.collect()
        left -= gone
        assert docs.columns == columns and all(r.n_chars == len(r.text) for r in held)
        if name != "mixing":
            assert {r.doc_id for r in held} == left and len(held) == len(left), name
        if name == "quality_rules":  # the line is in 80 documents of one host and 40 of the other
            assert not any(line in r.text for r in held)
    source_words = Counter()
    for r in held:
        source_words[r.source] += len(r.text.split())
    assert {r.doc_id for r in held} <= left and source_words["hot"] > 0 and source_words["rare"] > 0
    library, got = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json")), P.run(spark, str(tmp_path)).orderBy("start").collect()
    sizes = [(np.array(library.encode(r.text, add_special_tokens=False).ids + [2], "<u4")) for r in held]
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted((r.doc_id, len(x), zlib.crc32(x.tobytes())) for r, x in zip(held, sizes))
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got)


def test_empty_tables(spark, tmp_path):
    """No documents: every stage gives an empty table with the same columns, and the files hold nothing."""
    documents = spark.createDataFrame([(1, "x", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long").limit(0)
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b")], "item_id long, text string").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        docs = P.written(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == documents.columns and docs.count() == 0, name
    assert P.run(spark, str(tmp_path)).count() == 0
