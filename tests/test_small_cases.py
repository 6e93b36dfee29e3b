"""Cases stated by hand: texts, values, loads, sources, rules, streams."""

import pytest
from pyspark.sql import functions as F

from gridcheck import violations as V
from gridcheck.functions import messages as M
from gridcheck.functions import scalar as S
from gridcheck.operators import columns as C
from gridcheck.operators import refs as R
from gridcheck.operators import slot_rules as L
from gridcheck.operators import unique as U
from gridcheck.plans.contract import Contract
from gridcheck.sources import text_tables as X
from gridcheck.streaming.revalidate import affected


def one(spark, fn, *values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


def test_scalars(spark):
    assert one(spark, S.ascii_lower, "ÀBc", None) == ["Àbc", None]
    assert one(spark, S.fixed4_key, "ab", "abcdef", "é€x") == ["61622020", "61626364", "c3a9e282"]
    assert one(spark, S.fixed4_display, "aé€") == ["aé�"]
    assert one(spark, S.utf16_len, "a😀") == [3]
    assert one(spark, lambda c: S.wrap_uint(c, 8), "256", "-1", "+257", "x", "", "99999999999999999999999") == [0, 255, 1, None, None, 99999999999999999999999 % 256]
    assert one(spark, S.strip_outer_quotes, '"a"', '"', '""', 'a"') == ["a", '"', "", 'a"']
    assert one(spark, S.text_number, None, "", " 12 ", "0x1F", "0b11", "1e3", "-Infinity", "1_0")[:7] == [0, 0, 12, 31, 3, 1000, float("-inf")]
    assert one(spark, S.format_description, "a<br>b $!skills#Bolt!$") == ["a\n\nb **Bolt** (skills)"]
    assert one(spark, S.int_prefix, " 12x", "x", "-3") == [12, None, -3]
    assert one(spark, S.path_stem, "/a/B.Txt", "b", ".x") == ["b", "b", ".x"]
    assert one(spark, S.path_ext, "/a.b/c.Tsv", "c") == ["Tsv", ""]
    got = spark.range(1).select(S.format_percent(F.lit(0.125)), S.format_percent(F.lit(1 / 3)), S.format_percent(F.lit(0.0))).first()
    assert list(got) == ["12.5%", "33.3333%", "0%"]


def test_variant_coercion(spark):
    df = spark.createDataFrame([(x,) for x in ["null", "true", '"12"', '"x"', "[]", "[5]", "[1,2]", "{}", "7", "1.5"]], "j string").select(F.parse_json("j").alias("v"))
    got = [r[0] for r in df.select(S.variant_number(F.col("v"))).collect()]
    assert got[:3] == [0, 1, 12] and got[4:6] == [0, 5] and got[8:] == [7, 1.5] and all(x != x for x in (got[3], got[6], got[7]))


@pytest.mark.parametrize("check, bad, good", [(C.not_integer, [" 12 ", "1.5", "x", " ", "9223372036854775808"], ["", "+1", "-0", "007"]), (C.not_float, [" 1.5", "1d", ".", "e5", " "], ["", "1.", ".5", "-1e-3", "NaN", "inf"]), (C.not_boolean, ["2", " 1"], ["", " ", "0", "1"]), (lambda v: C.not_uint(v, 8), ["256", "-1", "0000300"], ["255", "-0", "x", "000255", ""])])
def test_column_checks(spark, check, bad, good):
    assert one(spark, check, *bad) == [True] * len(bad)
    assert one(spark, check, *good) == [False] * len(good)


def test_load_keeps_ids_of_rejected_keys(spark):
    rows = [(1, "a", "k"), (2, "b", "k"), (3, "b", "m"), (4, "a", "n"), (5, "c", "n"), (6, None, ""), (7, "", ""), (8, "z", None)]
    df = spark.createDataFrame([(n, i, k, "f" if n < 4 else "g") for n, i, k in rows], "n int, id string, key string, file string")
    got = {r.n: r.outcome for r in U.load_duplicates(df, "id", "key", ["n"], "file").collect()}
    assert got == {1: "loaded", 2: "duplicate-key", 3: "loaded", 4: "duplicate-id-cross-file", 5: "loaded", 6: "loaded", 7: "loaded", 8: "loaded"}


def test_unique_skips_blanks_and_takes_the_first(spark):
    df = spark.createDataFrame([(1, "A"), (2, "a"), (3, " "), (4, " "), (5, None), (6, "Á"), (7, "á"), (8, "a ")], "k int, v string")
    found = U.check_unique(df, "t", ["v"], "k", V.row_key("k")).collect()
    assert sorted((r.row_key, r.args["first"]) for r in found) == [("2", "1"), ("7", "6")]


def test_references_without_target_are_silent(spark):
    long = spark.createDataFrame([("1", "c", "x")], "row_key string, col string, value string")
    assert R.check_reference(long, "t", None, "gone").count() == 0
    assert R.check_reference(long, "t", spark.createDataFrame([("y",)], "key string"), "t", policy="ignore").count() == 0
    assert R.check_reference(long, "t", spark.createDataFrame([("X",)], "key string").select(S.ascii_lower(F.col("key")).alias("key")), "t").count() == 0


def test_slots(spark):
    df = spark.createDataFrame([("a", "x", "1", "", "", "y", "2"), ("b", '""', "5", "x", "", None, "9")], "k string, Item1 string, Prob1 string, Item2 string, Prob2 string, Item3 string, Prob3 string")
    arrays = L.slot_array(df, V.row_key("k"), ["Item1", "Item2", "Item3"], ["Prob1", "Prob2", "Prob3"])
    got = sorted((r.row_key, r.col, r.code) for r in L.check_first_gap(arrays, "t").collect())
    assert got == [("a", "item3", "after-first-gap"), ("a", "weight3", "after-first-gap"), ("b", "item2", "after-first-gap"), ("b", "weight1", "orphaned"), ("b", "weight3", "after-first-gap")]
    assert C.expand_numbered(df.columns, "ITEM#") == ["Item1", "Item2", "Item3"] and C.expand_numbered(["a1", "a3"], "a#") == ["a1"]


def test_catalog(spark):
    catalog = spark.createDataFrame([("en", "a", "{x} {y}"), ("en", "b", "b"), ("de_AT", "a", "{y} {z}"), ("de_AT", "c", "c")], "locale string, key string, template string")
    assert sorted((r.key, r.code) for r in M.check_catalog_parity(catalog).collect()) == [("a", "placeholders"), ("b", "missing-key"), ("c", "extra-key")]
    found = V.violations(spark.createDataFrame([("r",)], "row_key string"), "t", "x", "y", message_key="a", args={"x": F.lit("1"), "y": F.lit(None)})
    assert M.render_messages(found, catalog, "fr").first().message == "1 " and M.render_messages(found, catalog, "DE-at").first().message == " {z}"


def test_text_sources(spark, tmp_path):
    files = {"a/One.txt": "Code\tname\r\nx\t\r\n\r\ny\t1\t2", "b/two.TSV": "k\n€", "b/skip.md": "no"}
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode("utf-8"))
    (tmp_path / "b/ansi.txt").write_bytes("k\nna\x8fve €".encode("cp1252", "replace"))
    (tmp_path / "b/wide.txt").write_bytes(b"\xff\xfe" + "k\n😀".encode("utf-16-le"))
    (tmp_path / "b/odd.txt").write_bytes(b"\xff\xfeabc")
    found = X.discover(spark, str(tmp_path)).collect()
    assert sorted(r.stem for r in found) == ["ansi", "odd", "one", "two", "wide"]
    cells = [(r.line, r.col_idx, r.col_name, r.col_start, r.value) for r in X.read_delimited(spark, str(tmp_path / "a")).orderBy("line", "col_idx").collect()]
    assert cells == [(1, 0, "Code", 0, "x"), (1, 1, "name", 2, ""), (2, 0, "Code", 0, ""), (3, 0, "Code", 0, "y"), (3, 1, "name", 2, "1"), (3, 2, None, 4, "2")]
    raw = spark.read.format("binaryFile").load(str(tmp_path / "b")).select("path", "content")
    got = {r.path.rsplit("/", 1)[1]: (r.detected_encoding, r.text, r.decode_error) for r in X.decode_text(raw).collect()}
    assert got["wide.txt"] == ("utf-16-le", "k\n😀", None) and got["odd.txt"][1:] == (None, "odd length") and got["two.TSV"][0] == "utf-8" and got["ansi.txt"][1].endswith("€")
    assert X.load_stats(X.decode_text(raw)).first().failed == 1
    large = X.read_delimited_large(spark, str(tmp_path / "a")).orderBy("line", "col_idx").collect()
    assert [(r.line, r.value) for r in large] == [(1, "x"), (1, ""), (2, ""), (3, "y"), (3, "1"), (3, "2")]
    manifest = raw.select(F.lit("d").alias("dataset"), "path", F.octet_length("content").cast("long").alias("bytes"), F.when(F.is_valid_utf8(F.col("content").cast("string")), "utf-8").otherwise("windows-1252").alias("encoding"), F.sha2("content", 256).alias("sha256"))
    assert X.verify_manifest(raw, manifest).count() == 0
    wrong = manifest.filter("path NOT LIKE '%odd%'").withColumn("sha256", F.when(F.col("path").endswith("wide.txt"), F.reverse("sha256")).otherwise(F.col("sha256")))
    assert sorted(r.code for r in X.verify_manifest(raw, wrong).collect()) == ["not-listed", "sha256"]
    assert X.dataset_digests(manifest).first().files == 5


def test_json_entries(spark):
    files = spark.createDataFrame([("a", "﻿[{\"id\": 1, \"k\": null}, 3]"), ("b", "{}"), ("c", "[1,")], "path string, text string")
    got = sorted(((r.file, r.entry, tuple(r["keys"] or ()), r.error) for r in X.read_json_entries(files).collect()), key=str)
    assert got == [("a", 0, ("id", "k"), None), ("a", 1, (), None), ("c", None, (), "Json/Syntax")]


def test_contract_chain(spark):
    c = Contract.of({"tables": {"a": {"append": ["b"], "columns": [{"name": "x"}]}, "b": {"append": ["a"], "columns": [{"name": "X", "unique": True}, {"name": "y", "type": {"type": "reference", "table": "T", "column": "c"}}]}}})
    assert [(x.name, x.unique) for x in c.columns_of("a")] == [("x", False), ("y", False)]
    assert affected(c, ["t"]) == ["a", "b", "t"]
    chain = Contract.of({"tables": {n: {"columns": [{"name": "x", "type": {"type": "reference", "table": t, "column": "x"}}]} for n, t in (("a", "b"), ("b", "c"), ("c", "d"), ("d", "c"))}})
    assert affected(chain, ["d"]) == ["c", "d"] and affected(chain, ["d"], transitive=True) == ["a", "b", "c", "d"]


def test_white_space_is_that_of_unicode(spark):
    values = [("blank", "\x0b　 "), ("ends", "  a\tb \n"), ("zero width", "​"), ("plain", "x"), ("empty", ""), ("none", None)]
    df = spark.createDataFrame(values, "k string, value string")
    got = {r.k: (r.blank, r.bare, r.leading, r.trailing, r.visible) for r in C.with_whitespace_hint(df.withColumns({"blank": S.is_blank(F.col("value")), "bare": S.trimmed(F.col("value"))})).collect()}
    assert got == {
        "blank": (True, "", 3, 3, "\x0b　 "), "ends": (False, "a\tb", 2, 2, " ␠a⇥b \n"), "zero width": (False, "​", 0, 0, "​"),
        "plain": (False, "x", 0, 0, "x"), "empty": (True, "", 0, 0, ""), "none": (True, None, None, None, None),
    }


def test_stored_booleans_have_no_plus(spark):
    df = spark.createDataFrame([("+1",), ("-1",), ("256",), ("4294967296",), ("-",), ("1 ",), ("　",), ("9" * 40,)], "v string")
    got = {r.v: (r.bad, r.general, r.low) for r in df.select("v", C.not_stored_boolean(F.col("v")).alias("bad"), C.stored_boolean(F.col("v")).alias("general"), C.stored_boolean(F.col("v"), "stored").alias("low")).collect()}
    assert got == {"+1": (True, None, None), "-1": (False, True, True), "256": (False, True, False), "4294967296": (False, False, False), "-": (True, None, None), "1 ": (True, None, None), "　": (False, None, None), "9" * 40: (False, int("9" * 40) % 2**32 != 0, int("9" * 40) % 256 != 0)}
