"""Text tables in parts, scopes, identities of JSON values, digests, ragged rows."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from gridcheck.operators import entries as E
from gridcheck.operators import unique as U
from gridcheck.plans.compile import validate
from gridcheck.plans.contract import Contract
from gridcheck.sources import text_source as S
from gridcheck.sources import text_tables as X

TEXT = "Code\tname é€\r\nx\t\r\r\n\ny\t1\t2\nbare\rcr\r\nlong " + "ä" * 300 + "\tz\n" + "\n".join(f"{i}\tv{i}" for i in range(100))


def whole(spark, folder):
    """The cells as whole files give them; a last line end starts no line."""
    return sorted((os.path.basename(r.path), r.line, r.col_idx, r.col_name, r.col_start, r.value) for r in X.read_delimited(spark, folder).collect())


@pytest.mark.parametrize("end", ["", "\r\n"])
def test_parts_of_every_encoding_equal_whole_files(spark, tmp_path, end):
    folder = tmp_path / "in"
    os.mkdir(folder)
    text = TEXT + end
    made = {"u8.txt": text.encode(), "mark.TSV": b"\xef\xbb\xbf" + text.encode(), "le.txt": b"\xff\xfe" + text.encode("utf-16-le"), "be.csv": b"\xfe\xff" + text.encode("utf-16-be"), "ansi.txt": text.replace("€", "\x80").encode("latin-1"), "crs.tbl": text.replace("\n", "\r").encode()}
    for name, raw in made.items():
        (folder / name).write_bytes(raw)
    want = whole(spark, str(folder))
    for size in (450, 4000):
        cells, failed = S.read_cells(spark, str(folder), partBytes=size)
        assert sorted((os.path.basename(r.path), r.line, r.col_idx, r.col_name, r.col_start, r.value) for r in cells.collect()) == want, size
        assert failed.count() == 0
    assert len(want) > 1000


def test_records_at_every_cut():
    import io

    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "\r", "\n", "\r\n", "਍"]) for _ in range(rng.randint(0, 14)))
        for encoding, unit in (("utf-8", 1), ("utf-16-le", 2), ("utf-16-be", 2)):
            raw = text.encode(encoding)
            want = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            want = want[:-1] if want[-1] == "" else want
            cuts = sorted({0, len(raw), *(unit * rng.randint(0, len(raw) // unit) for _ in range(3))})
            got = [r.decode(encoding) for a, b in zip(cuts, cuts[1:]) for _, r in S.records(io.BytesIO(raw), a, b, 0, len(raw), unit, encoding == "utf-16-le")]
            assert got == want, (text, encoding, cuts)


def test_failures_are_rows_and_files_come_by_path(spark, tmp_path):
    for name, raw in {"b/two.txt": b"k\n1", "a/One.TXT": b"k\n2", "a/no.md": b"x", "a/odd.txt": b"\xff\xfeabc", "a/bad.txt": b"\xef\xbb\xbf\xff", "empty.txt": b""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    os.symlink(tmp_path / "gone", tmp_path / "a/link.txt")
    found = S.walked(str(tmp_path), ("txt",), True, True)
    assert [os.path.relpath(p, tmp_path) for p, _ in found] == ["a/One.TXT", "a/bad.txt", "a/link.txt", "a/odd.txt", "b/two.txt", "empty.txt"]
    assert [os.path.relpath(p, tmp_path) for p, _ in S.walked(str(tmp_path), ("txt",), False, False)] == ["empty.txt"]
    assert S.walked(str(tmp_path / "missing"), ("txt",), True, True)[0][1]
    rows = S.read_text_tables(spark, str(tmp_path), extensions="txt")
    assert sorted((os.path.basename(r.path), r.error) for r in rows.filter("error IS NOT NULL").collect()) == [("bad.txt", "invalid UTF-8"), ("link.txt", "No such file or directory"), ("odd.txt", "odd length")]
    assert sorted((r.stem, r.content) for r in rows.filter("error IS NULL").collect()) == [("empty", ""), ("one", "2"), ("one", "k"), ("two", "1"), ("two", "k")]


def test_equal_stems_in_two_scopes_are_two_sets(spark):
    contract = Contract.of({"tables": {"t": {"key": ["k"], "order": "k", "columns": [{"name": "r", "type": {"type": "reference", "table": "u", "column": "c"}}, {"name": "v", "unique": True}, {"name": "q", "type": {"type": "reference", "table": "w", "column": "c"}}]}}})
    t = spark.createDataFrame([(s, k, r, v, q) for s in ("a", "b", "c", None) for k, r, v, q in ((1, "x", "one", "x"), (2, "y", "two", "y"), (3, "z", "one", "z"))], "scope string, k long, r string, v string, q string")
    u = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "X"), ("b", None)], "scope string, c string")
    shared = {"u": spark.createDataFrame([("z",)], "c string")}
    found = lambda rule, **more: sorted(r.row_key for r in validate(contract, {"t": t, "u": u}, scope="scope", **more).filter(F.col("rule") == rule).collect())
    # scopes with a table of their own see only that; c and the one without a name have none: the shared one, or nothing is said
    assert found("reference", shared=shared) == ["1", "2", "a|3", "b|2", "b|3", "c|1", "c|2"]
    assert found("reference") == ["a|3", "b|2", "b|3"]
    assert found("unique") == ["3", "a|3", "b|3", "c|3"]
    # a target that only the lower tier has
    lower = {"w": spark.createDataFrame([("x",)], "c string")}
    assert [r.row_key for r in validate(contract, {"t": t.filter("scope = 'a'")}, scope="scope", shared=lower).filter("col = 'q'").orderBy("row_key").collect()] == ["a|2", "a|3"]


def test_identities_keep_their_type(spark):
    texts = ["1", '"1"', "1.0", "1e0", "0", "-0", "-0.0", "null", "null", "true", '"true"', "[1]", "[1]", '{"a":1}', '{"a":1}', '""', '""', "9007199254740993", "9007199254740992"]
    df = spark.createDataFrame([(i, t, f"k{i}") for i, t in enumerate(texts)] + [(100, None, "n1"), (101, None, "n2")], "n int, t string, k string").select("n", F.parse_json("t").alias("id"), "k")
    got = {r.n: r.outcome for r in U.load_duplicates(df, "id", "k", ["n"]).select("n", "outcome").collect()}
    assert sorted(n for n, o in got.items() if o == "duplicate-id") == [2, 3, 5, 6, 8, 16, 18] and len(got) == len(texts) + 2
    keyed = spark.createDataFrame([(1, '""'), (2, '""'), (3, "1"), (4, '"1"'), (5, "1.0")], "n int, t string").select("n", F.lit(None).cast("string").alias("id"), F.parse_json("t").alias("k"))
    assert {r.n for r in U.load_duplicates(keyed, "id", "k", ["n"]).filter("outcome = 'duplicate-key'").collect()} == {5}


def test_digest_of_many_files_and_totals(spark):
    rows = [("d" if i % 3 else "e", f"Dir\\F{i:05d}.txt", i, "utf-8", hashlib.sha256(str(i).encode()).hexdigest().upper()) for i in range(3000)]
    manifest = spark.createDataFrame(rows, "dataset string, path string, bytes long, encoding string, sha256 string").repartition(7)
    got = {r.dataset: (r.files, r.bytes, r.digest) for r in X.dataset_digests(manifest).collect()}
    for name in ("d", "e"):
        mine = sorted((p.replace("\\", "/").lower(), s.lower(), n) for d, p, n, _, s in rows if d == name)
        assert got[name] == (len(mine), sum(n for *_, n in mine), hashlib.sha256("".join(f"{s}  {p}\n" for p, s, _ in mine).encode()).hexdigest())
    plan = X.dataset_digests(manifest)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan
    files = spark.createDataFrame([("a/x.txt", b"\xff"), ("a/y.txt", b"y"), ("a/z.txt", b"z")], "path string, content binary")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    listed = spark.createDataFrame([("d", "A\\x.txt", 1, "utf-8", sha(b"\xff")), ("d", "a/y.txt", 1, "koi8", sha(b"y")), ("d", "a/z.txt", 1, "utf-8", "zz")], "dataset string, path string, bytes long, encoding string, sha256 string")
    totals = spark.createDataFrame([("d", 3, 4, "00"), ("gone", 1, 1, "00")], "dataset string, files long, bytes long, digest string")
    assert sorted((r.path, r.code) for r in X.verify_manifest(files, listed, totals).collect()) == [("A\\x.txt", "encoding"), ("a/y.txt", "unknown-encoding"), ("a/z.txt", "hash-format"), ("d", "digest"), ("d", "total-bytes"), ("gone", "missing-dataset")]


def test_evidence_of_ragged_rows(spark):
    headers = spark.createDataFrame([("t", ["*eol", "A", "b", "a", "@SkipDocs"]), ("legacy", ["x"]), ("other", ["x"])], "path string, header array<string>")
    rows = [("t", ["c", "first", "two", "last", ""]), ("t", ["", "p", "q", "r"]), ("t", ["short", "row", "out"]), ("t", ["0", "1", "", "3", "yes", "beyond"]), ("legacy", ["old"]), ("other", ["unknown"]), ("t", [])]
    rows = spark.createDataFrame(rows, "path string, cells array<string>")
    keys = lambda **more: {r.key for r in E.collect_used_rows(rows, headers, stem=F.col("path"), known=["t", "legacy"], **more).collect()}
    # a row of four cells has as many as counted columns; its skip cell is not there
    assert keys() == {"two", "last", "q", "r", "true", "3", "yes", "old"}
    assert keys(excluded=["legacy"]) == {"two", "last", "q", "r", "true", "3", "yes"}
    texts = spark.createDataFrame([("@one, @@two_3 @é",)], "text string")
    assert {"one", "two_3"} <= keys(texts=texts)


def test_small_parts_share_tasks(spark, tmp_path):
    """Parts are as small as asked for, but a task reads many of them, and many small files."""
    lines = [f"line {k}" for k in range(9000)]
    (tmp_path / "a.txt").write_bytes("\r\n".join(lines).encode())
    for k in range(40):
        (tmp_path / f"b{k:02d}.txt").write_text(f"x{k}\ny")
    found = S.read_text_tables(spark, str(tmp_path), partBytes=64, encoding="utf-8")
    assert found.rdd.getNumPartitions() <= 4
    rows = found.filter("stem = 'a'").select("part", "parts", "content").collect()
    assert [r.content for r in rows] == lines and len({r.part for r in rows}) > 1000
    numbered = S.numbered_lines(found).collect()
    assert sorted((r.line, r.content) for r in numbered if r.path.endswith("a.txt")) == list(enumerate(lines))
    assert len(numbered) == 9080


def test_lines_that_cannot_be_read_are_not_left_out(spark, tmp_path, monkeypatch):
    """A file that goes between writing and reading is an error of the query, not a smaller count."""
    from gridcheck.queries import streams_sources as Q

    spark.createDataFrame([(1, "one\ntwo"), (2, None), (3, "")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, Q.text_source(spark, str(tmp_path)).collect())) == [(0, 1), (3, 2)]

    def damaged(spark, at, **options):
        os.symlink("/no/such/file", f"{at.removeprefix('file://')}/lost.txt")
        return S.read_text_tables(spark, at, **options)

    monkeypatch.setattr(Q, "read_text_tables", damaged)
    with pytest.raises(Exception, match="lost.txt"):
        Q.text_source(spark, str(tmp_path)).collect()
