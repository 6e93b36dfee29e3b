"""Formulas: cases by hand, and a random comparison with a small recursive parser of this test's own."""

import random
import re

from pyspark.sql import functions as F

from gridcheck.operators import formulas as X


def checked(spark, cases, lists=None, **more):
    rows = X.formulas(spark.createDataFrame([(str(i), c) for i, c in enumerate(cases)], "k string, f string"), F.col("k"), ["f"])
    out = {c: [] for c in cases}
    for r in X.check_formulas(rows, "t", lists, **more).collect():
        out[cases[int(r.row_key)]].append(r)
    return out


def test_structure_and_arity(spark):
    cases = {
        "min(1,2)+3": [], "min(1)": ["arity"], "(1+2": ["missing-close"], "((1": ["missing-close"], "1)": ["unexpected-close"], "1 2": ["structure"], "1+": ["structure"], "skill('a b'.lvl)": [], "-1*(-2)": [], "(1)(2)": ["structure"], "2(3)": ["structure"], "a.b": ["structure"],
        "2^3^4": ["structure"], "2^-3*4^2": [], "(2^3)^4": [], "min(max(1,2))": ["arity"], "min(max(1),2)": ["arity"], "1": [], "a ? b : c ? 1 : 2": [], "a ? b": ["structure"], "a : b": ["structure"], "()": ["structure"], "min(,1)": ["structure"], "min((1,2),3)": ["structure"], "1==2==3": [],
        # styles of arguments
        "min(1,'x')": ["structure"], "min(a.b)": ["structure"], "skill(5,1)": ["quoted-argument"], "skill()": ["quoted-argument"], "skill('x'.(1))": ["dot-identifier"], "skill('x'.lvl, 2)": ["arity"], "other('x'.a.b, 1+2)": [], "other(1, 'x')": ["structure"], "min()": ["arity"], "other()": [],
        "skill ( 'x' . lvl )": [], "sklvl('x'.a.b)": [], "min(skill('x'.a)": ["arity", "missing-close"],
        # conditions have an arity of their own
        "cond('a')": ["unknown-condition"], "cond('a',1)": ["unknown-condition"], "cond('IsType')": ["arity"], "cond('istype',1)": [], "cond('Desecrated')": [], "stat('s'.accr)": [], "stat('s'.foo)": ["invalid-parameter"],
        # decimals, '%', characters
        "1.+2": ["decimal"], "3.5": ["decimal"], "a % b": ["percent-ends-formula"], "%": ["percent-ends-formula"], "other('a%b')": [], "a&&b": ["unknown-character"], "min(1,'x": ["unterminated-quote"], "!a": ["unknown-character"], "a!=b": [],
    }
    found = checked(spark, list(cases))
    assert {c: sorted(r.code for r in rs) for c, rs in found.items()} == cases
    place = {c: (r.col_start, r.col_end) for c, rs in found.items() for r in rs}
    assert place["1 2"] == (2, 3) and place["skill(5,1)"] == (6, 7) and place["1.+2"] == (0, 2) and place["(1+2"] == (4, 4) and place["a&&b"] == (1, 2)
    severity = {c: r.severity for c, rs in found.items() for r in rs}
    assert severity["(1+2"] == severity["a % b"] == severity["3.5"] == "warning" and severity["%"] == severity["1)"] == "error"


def test_names(spark):
    one = lambda *keys: spark.createDataFrame([(k,) for k in keys], "key string")
    lists = {"scope": (one("lvl", "known"), "exact"), "skills": (one("Fire Bolt"), "ascii-ci"), "skill-names": (one("lvl", "rank"), "exact")}
    cases = {"LVL+lvl": ["LVL"], "known+min(foo,1)+bar": ["bar"], "(foo)": ["foo"], "min((foo),max(bar,1))": [], "other(foo)": [], "skill ('fire bolt'.lvl)": [], "skill ('zzz'.lvl)": ["zzz"], "skill('fire bolt'.Lvl)": ["Lvl"], "sklvl('fire bolt'.known.rank)": [], "sklvl('fire bolt'.rank.known)": ["known", "rank"], "miss('m'.x)": []}
    assert {c: sorted(r.value for r in rs) for c, rs in checked(spark, list(cases), lists).items()} == cases
    four = {"scope": (one("lvlx", "ab", "é1"), "fixed4")}
    assert {c: [r.value for r in rs] for c, rs in checked(spark, ["lvlxyz+ab", "lvly", "AB"], four).items()} == {"lvlxyz+ab": [], "lvly": ["lvly"], "AB": ["AB"]}
    nothing = {"scope": (one("x").limit(0), "exact")}
    assert [r.value for r in checked(spark, ["a"], nothing)["a"]] == ["a"]


def test_alias_hint(spark):
    rows = X.formulas(spark.createDataFrame([("1", "par12+par9")], "k string, f string"), F.col("k"), ["f"])
    hint = X.with_alias_hint(rows, spark.createDataFrame([("par1",), ("pa12",)], "key string")).collect()
    assert [(r.identifier, r.read_as, r.hint) for r in hint] == [("par12", "par1", "pa12")]


class Fault(Exception):
    pass


class Parser:
    """Recursive descent over the same grammar; raises at the first fault, remembers calls and outside names."""

    def __init__(self, text):
        self.tokens = [(m[0], m.start()) for m in re.finditer(r"[0-9]+(?:\.[0-9]*)?|[A-Za-z_]\w*|'[^']*'|[<>=!]=|\S", text)] + [("", len(text))]
        self.i, self.depth, self.calls, self.names = 0, 0, [], []

    @property
    def now(self):
        return self.tokens[self.i][0]

    def next(self):
        self.i += 1
        return self.tokens[self.i - 1][0]

    def fail(self):
        raise Fault(self.tokens[self.i][1])

    def need(self, t):
        if self.now != t:
            self.fail()
        self.i += 1

    def whole(self):
        self.expression()
        if self.now:
            self.fail()

    def expression(self):
        self.chain(["<", "<=", ">", ">=", "==", "!="], lambda: self.chain(["+", "-"], lambda: self.chain(["*", "/"], self.power)))
        if self.now == "?":
            self.next()
            self.expression()
            self.need(":")
            self.expression()

    def chain(self, operators, part):
        part()
        while self.now in operators:
            self.next()
            part()

    def power(self):
        self.unary()
        if self.now == "^":
            self.next()
            self.unary()

    def unary(self):
        while self.now == "-":
            self.next()
        t = self.now
        if re.match(r"[0-9]", t):
            self.next()
        elif t == "(":
            self.next()
            self.expression()
            self.need(")")
        elif re.match(r"[A-Za-z_]", t):
            self.next()
            if self.now == "(":
                self.next()
                self.depth += 1
                self.arguments(t.lower())
                self.depth -= 1
                self.need(")")
            elif not self.depth:
                self.names.append(t)
        else:
            self.fail()

    def arguments(self, fn):
        n = 0
        if self.now.startswith("'") or fn in X.QUOTED:
            if not self.now.startswith("'"):
                self.fail()
            self.next()
            n = 1
            while self.now == ".":
                self.next()
                if not re.match(r"\w", self.now):
                    self.fail()
                self.next()
                n += 1
            while self.now == ",":
                self.next()
                self.expression()
                n += 1
        elif self.now != ")":
            self.expression()
            n = 1
            while self.now == ",":
                self.next()
                self.expression()
                n += 1
        self.calls.append((fn, n))


def test_walk_equals_a_recursive_parser(spark):
    rng = random.Random(9)
    words = ["1", "2.5", "7.", "a", "lvl", "min", "skill", "'x'", "'y z'", "(", ")", "(", ")", ",", ".", "?", ":", "^", "-", "+", "*", "<=", "=="]

    def grown(n):
        if n <= 0:
            return rng.choice(["1", "2.5", "a", "lvl"])
        return rng.choice([
            lambda: f"{grown(n - 1)}{rng.choice('+-*/^<')}{grown(n - 2)}", lambda: f"({grown(n - 1)})", lambda: f"-{grown(n - 1)}", lambda: f"{grown(n - 2)} ? {grown(n - 2)} : {grown(n - 1)}",
            lambda: f"min({grown(n - 1)}, {grown(n - 2)})", lambda: f"skill('x'.{rng.choice(['lvl', '3'])},{grown(n - 1)})", lambda: f"other('q'.a , {grown(n - 1)})", lambda: f"f({','.join(grown(n - 2) for _ in range(rng.randint(1, 3)))})",
        ])()

    cases = []
    for i in range(3000):
        text = grown(rng.randint(0, 5)) if i % 3 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))
        if i % 3 == 1 and len(text) > 1:  # one token goes, or comes
            tokens = re.findall(r"[0-9]+(?:\.[0-9]*)?|[A-Za-z_]\w*|'[^']*'|<=|==|\S|\s+", text)
            at = rng.randrange(len(tokens))
            tokens[at : at + rng.randint(0, 1)] = [rng.choice(words)] if rng.random() < 0.5 else []
            text = "".join(tokens)
        cases.append(text.strip() or "1")
    got = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "k long, used string").repartition(4).select("k", X.walk(F.col("used")).alias("w")).collect()
    faults = 0
    for r in got:
        p = Parser(cases[r.k])
        try:
            p.whole()
            want = None
        except Fault as f:
            want = f.args[0]
            faults += 1
        assert (r.w.fault.at if r.w.fault else None) == want, (cases[r.k], r.w, want)
        if want is None:
            assert [(x.fn, x.n) for x in r.w["items"] if x.kind == "call"] == p.calls and [x.value for x in r.w["items"] if x.kind == "name"] == p.names, cases[r.k]
    assert 500 < faults < 2500


def test_a_formula_of_many_cells_is_walked_once(spark):
    """Equal formulas meet before the walk, not behind it."""
    rows = spark.range(40).selectExpr("CAST(id AS STRING) AS row_key", "'calc' AS col", "concat('min(', id % 2, ')') AS body", "concat('min(', id % 2, ')') AS used")
    found = X.check_formulas(rows, "t")
    assert sorted(r.row_key for r in found.collect()) == sorted(str(k) for k in range(40))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and plan.index("Join") < plan.index("aggregate(transform")
    assert re.search(r"\bAggregate \[", plan)
