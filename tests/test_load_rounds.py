import random

from gridcheck.operators import unique as U


def test_one_connected_group_loads_in_rounds_as_in_order(spark):
    rng = random.Random(5)
    rows = [(n, rng.choice([None, *"abcdefghijklmnop"]), rng.choice([None, "", *map(str, range(40))]), rng.choice("fg")) for n in range(400)]
    want, ids, keys = {}, {}, {}
    for n, i, k, f in rows:
        k = k or None
        if i in ids or k in keys:
            kind, file = ("id", ids[i]) if i in ids else ("key", keys[k])
            want[n] = f"duplicate-{kind}" + ("" if file == f else "-cross-file")
            continue
        want[n] = "loaded"
        ids |= {i: f} if i is not None else {}
        keys |= {k: f} if k is not None else {}
    found = U.load_duplicates(spark.createDataFrame(rows, "n int, id string, key string, file string"), "id", "key", ["n"], "file")
    assert {r.n: r.outcome for r in found.collect()} == want
    assert "InPandas" not in found._jdf.queryExecution().toString()
