import re
from collections import Counter

from helpers import empty, frame

from gridcheck.llm.quality_rules import kept_documents, quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    threes = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts, covered = Counter(threes), set()
    for k, three in enumerate(threes):
        if counts[three] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)


def test_statistics(spark):
    from helpers import ODD

    rows = [*ODD, (20, "a b c a b c a b"), (21, "x y z q x y z x y z"), (22, "l1 #$\nl1 #$\n\nl2|<>\nl1 #$"), (23, "😀 é\x0b\x0c漢 a a a a")]
    got = quality_rules(frame(spark, rows))
    assert "text" not in got.columns and "lang" in got.columns and got.columns.count("n_words") == 1
    found = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect()), key=str)
    assert found == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert quality_rules(empty(spark)).count() == 0


def test_frequent_lines(spark):
    name = lambda i: str(i).translate(str.maketrans("0123456789", "abcdefghij"))  # noqa: E731  digits are alike in lines
    body = lambda i: "\n".join(" ".join(f"d{name(i)}w{name(k)}x{name(j)}" for k in range(12)) for j in range(6))
    common = "Subscribe to our 100 letters now and read all of them today please"
    rows = [(i, body(i) + ("\n" + common.upper().replace("100", str(i)) if i % 2 else "")) for i in range(60)]
    rows += [(100 + i, f"{common}\n" * 8 + " ".join(f"u{name(i)}v{name(k)}" for k in range(20))) for i in range(3)]
    rows += [(200 + i, body("same")) for i in range(70)]  # copies are one family
    near = body("near").split(" ")
    for i in range(70):
        copy = list(near)
        copy[3 + i % 40] = f"edit{name(i)}"
        rows.append((300 + i, " ".join(copy)))
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in quality_rules(docs, least_docs=20, share=0.1).collect()}
    assert all(got[i].kept and (got[i].n_removed_words > 0) == bool(i % 2) for i in range(60))
    assert not any(got[100 + i].kept for i in range(3)) and all(got[100 + i].depleted for i in range(3))
    assert all(got[200 + i].kept and not got[200 + i].n_removed_words for i in range(70))
    assert all(got[300 + i].kept for i in range(70))
    left = kept_documents(docs, least_docs=20, share=0.1)
    assert left.columns == docs.columns and left.count() == 200
