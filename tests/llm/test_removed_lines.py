from gridcheck.llm import quality_rules as quality_rules_module
from gridcheck.llm.quality_rules import kept_documents, quality_rules

COMMON = "Subscribe to our 100 letters now"


def words(name, n):
    letters = lambda i: str(i).translate(str.maketrans("0123456789", "abcdefghij"))  # noqa: E731  digits are alike in lines
    return " ".join(f"{name}{letters(k)}" for k in range(n))


def docs_of(spark, rows):
    data = [(i, t, s, len(t)) for i, t, s in rows]
    return spark.createDataFrame(data, "doc_id long, text string, source string, n_chars int")


def letters(i):
    return str(i).translate(str.maketrans("0123456789", "abcdefghij"))


def test_kept_texts_lose_frequent_lines(spark):
    rows = [(i, f"{words(f'd{letters(i)}x', 60)}\n\n{COMMON.replace('100', str(i))}\nlast {letters(i)}\n", "a") for i in range(80)]
    rows += [(100, rows[0][1], "b"), (101, rows[0][1], "a")]
    docs = docs_of(spark, rows)
    got = kept_documents(docs)
    assert got.schema == docs.schema
    want = {i: t if s == "b" else "\n".join(x for x in t.split("\n") if not x.startswith("Subscribe")) for i, t, s in rows}
    assert {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {i: (t, len(t)) for i, t in want.items()}


def test_frequent_lines_on_small_and_large_hosts(spark):
    page = lambda host, i: words(f"{host}d{letters(i)}x", 60)
    rows = [(i, page("a", i) + (f"\n{COMMON}" if i < 35 else ""), "a") for i in range(40)]  # a host below 50 documents
    rows += [(1000 + i, page("b", i) + (f"\n{COMMON}" if i < 55 else "\nrare words here" if i < 74 else ""), "b") for i in range(3000)]  # 1.8 % of a large one
    got = {r.doc_id: r.n_removed_lines for r in quality_rules(docs_of(spark, rows)).collect()}
    assert got == {i: int(t.endswith(COMMON)) for i, t, _ in rows}


def test_documents_with_much_common_text_are_not_copies(spark):
    common = words("common", 176)
    rows = [(i, f"{common}\n{words(f'own{letters(i)}x', 22)}", "a") for i in range(40)]  # similarity 0.78
    near = words("near", 200).split(" ")
    rows += [(1000 + i, " ".join([*near[: 2 * i], f"edit{letters(i)}", *near[2 * i + 1 :]]), "b") for i in range(70)]
    got = {r.doc_id: r for r in quality_rules(docs_of(spark, rows)).collect()}
    assert all(got[i].depleted and got[i].n_removed_words == 176 for i in range(40))
    assert all(got[1000 + i].kept and not got[1000 + i].n_removed_words for i in range(70))


def test_lines_spread_over_parts_give_the_same(spark, monkeypatch):
    page = lambda i: words(f"p{letters(i)}x", 60)
    rows = [(i, page(i) + (f"\n{COMMON}\n{COMMON}" if i % 3 else "\nown " + letters(i)), "a" if i % 5 else None) for i in range(400)]
    rows += [(1000 + i, *rows[1][1:]) for i in range(50)]  # repeated texts count once and all lose the line
    docs = docs_of(spark, rows)
    want = sorted(map(tuple, quality_rules(docs).collect()))
    monkeypatch.setattr(quality_rules_module, "BROADCAST_LINES", -1)
    assert sorted(map(tuple, quality_rules(docs).collect())) == want
    lines = spark.createDataFrame([("=a", (i, i * 7919), 5, 3) for i in range(3000)] + [("=a", (9, 9), 6, 1)], "h string, text_key struct<a: bigint, b: bigint>, line long, words int")
    found = quality_rules_module.with_frequent(lines, spark.createDataFrame([("=a", 5)], "h string, line long"), "h")
    assert found.count() == 3000 and found.columns.count("line") == 1 and "__part" not in found.columns
