"""Formulas in cells: one walk over a formula's characters gives all that is to be said about it.

The grammar: ``? :`` over comparisons over ``+ -`` over ``* /`` over one ``^`` a
power over unary ``-``; numbers, names, parentheses, calls.  A call is of one of two
styles.  ``min(a, b)`` takes expressions; ``skill('Name'.ident, a)`` begins with a
quoted name, behind which come dots, each with a name or number, then expressions.
The functions in ``quoted`` must be called in the second style; any other may.

The walk is a fold with a stack: each open parenthesis is a level with its style,
its count of arguments and its pending ``?``.  It stops at the first fault.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcheck.functions.scalar import ascii_lower, fixed4_key, is_blank, let, strip_outer_quotes
from gridcheck.operators.findings import FINDING, exploded, finding, gathered, resolved

#: Every character belongs to a lexeme: white space, numbers, names, quoted names, operators of two characters, others alone.
LEXEME = r"[ \t\r\n]+|[0-9]+(?:\.[0-9]*)?|[A-Za-z_][A-Za-z0-9_]*|'[^']*'|==|!=|<=|>=|(?s:.)"

# fixed values: functions and their arguments, conditions and their arguments (names in lower case)
ARITY = {"min": 2, "max": 2, "rand": 2, "skill": 2, "miss": 2, "stat": 2, "sklvl": 3, "sksrc": 2}
QUOTED = ("skill", "miss", "stat", "sklvl", "sksrc", "cond")
CONDITIONS = {"istype": 2, "isclass": 2, "monstertestelite": 2, "itemistype": 2, "itemismodtype": 2, "difficulty": 2, "desecrated": 1, "isdesecratedzonesenabled": 1}
PARAMETERS = {"stat": ("accr", "base", "mod")}
#: The list in which a function's quoted name, and its first and second name behind a dot, must be.
NAME_LISTS = {"skill": "skills", "sksrc": "skills", "sklvl": "skills", "miss": "missiles", "stat": "stats"}
DOT_LISTS = {("skill", 1): "skill-names", ("sksrc", 1): "skill-names", ("miss", 1): "missile-names", ("sklvl", 1): "scope", ("sklvl", 2): "skill-names"}


@dataclass(frozen=True)
class Language:
    """What a formula may call; ``condition`` is the function whose quoted name decides its arity."""

    arity: Mapping[str, int] = field(default_factory=lambda: ARITY)
    quoted: Sequence[str] = QUOTED
    conditions: Mapping[str, int] = field(default_factory=lambda: CONDITIONS)
    condition: str = "cond"
    parameters: Mapping[str, Sequence[str]] = field(default_factory=lambda: PARAMETERS)
    name_lists: Mapping[str, str] = field(default_factory=lambda: NAME_LISTS)
    dot_lists: Mapping[tuple[str, int], str] = field(default_factory=lambda: DOT_LISTS)


def used_part(value: Column) -> tuple[Column, Column]:
    """A cell without outer quotes and blanks; and its part before a '%' that no quoted name holds."""
    body = strip_outer_quotes(value, trim=True)
    cut = F.regexp_extract(body, r"^((?:[^%']|'[^']*')*)", 1)
    return body, F.when(body.contains("'"), F.when(body.contains("%") & (F.substring(body, F.length(cut) + 1, F.lit(1)) == "%"), cut).otherwise(body)).otherwise(F.substring_index(body, "%", 1))


_LEVEL = "struct<call:boolean,fn:string,must:boolean,name:string,at:int,args:int,dots:int,open:int,power:boolean>"
_ITEM = "struct<kind:string,fn:string,value:string,at:int,n:int>"
_STATE = f"struct<at:int,want:string,ident:string,ident_at:int,inside:int,levels:array<{_LEVEL}>,fault:struct<code:string,at:int,token:string>,items:array<{_ITEM}>>"
WALK = f"struct<fault:struct<code:string,at:int,token:string>,missing:int,items:array<{_ITEM}>>"


LEXICAL = ("unknown-character", "unterminated-quote")


def lexical_code(t: Column) -> Column:
    return F.when(t == "'", "unterminated-quote").otherwise("unknown-character")


def walk(used: Column, language: Language = Language()) -> Column:
    """The first fault with its place, open parentheses, and what was read: names, quoted names, dots, calls, decimals.

    Names are those outside any call.  A call's ``n`` is its number of
    arguments: expressions, the quoted name, each dot.
    """
    item = lambda kind, fn, value, at, n: F.struct(F.lit(kind).alias("kind"), fn.alias("fn"), value.alias("value"), at.alias("at"), n.alias("n")).cast(_ITEM)
    none, zero, empty = F.array().cast(f"array<{_ITEM}>"), F.lit(0), F.lit("")
    fields = ("call", "fn", "must", "name", "at", "args", "dots", "open", "power")
    level = lambda *values: F.struct(*(v.alias(n) for n, v in zip(fields, values))).cast(_LEVEL)
    no = F.lit(False)
    ground = level(no, empty, no, empty, zero, zero, zero, zero, no)
    states = ("at", "want", "ident", "ident_at", "inside", "levels", "fault", "items")
    state = lambda *values: F.struct(*(v.alias(n) for n, v in zip(states, values))).cast(_STATE)
    begin = state(zero, F.lit("operand"), empty, zero, zero, F.array(ground), F.lit(None), none)

    def named(t: Column) -> Column:
        head = F.substring(t, 1, 1)
        kind = (
            F.when(head.isin(" ", "\t", "\r", "\n"), "space").when(head.between("0", "9"), "number").when(head.rlike("[A-Za-z_]"), "ident").when(head == "'", F.when(F.length(t) > 1, "quoted").otherwise("bad"))
            .when(t.isin("(", ")", ",", ".", "?", ":", "^", "-"), t).when(t.isin("+", "*", "/", "<", ">", "<=", ">=", "==", "!="), "binary").otherwise("bad")
        )
        return F.struct(t.alias("t"), kind.alias("kind"), F.length(t).alias("n"))

    def judged(a: Column, kind: Column, top: Column) -> Column:
        """Whether the token may stand here, and what that depends on."""
        want, depth = a["want"], F.size(a["levels"])
        done = want.isin("after", "ident")
        operand = (want == "operand") | ((want == "first") & ~top["must"])
        closed, dotted = done & (top["open"] == 0), want == "dot"
        good = (
            F.when(kind.isin("number", "ident"), operand | dotted).when(kind == "quoted", want == "first").when(kind == "(", operand | (want == "ident"))
            .when(kind == ")", (depth > 1) & (closed | (want == "quoted") | ((want == "first") & ~top["must"]))).when(kind == ",", top["call"] & (closed | (want == "quoted")))
            .when(kind == ".", want == "quoted").when(kind == "-", operand | done).when(kind == "^", done & ~top["power"]).when(kind == ":", done & (top["open"] > 0)).when(kind == "bad", no).otherwise(done)
        )
        return F.struct(good.alias("good"), top.alias("top"), done.alias("done"), dotted.alias("dotted"), (want == "ident").alias("call"))

    def read(a: Column, x: Column, j: Column) -> Column:
        t, kind, at, want, depth = x["t"], x["kind"], a["at"], a["want"], F.size(a["levels"])
        good, top, dotted, call = j["good"], j["top"], j["dotted"], j["call"]
        code = F.when(kind == "bad", lexical_code(t)).when((kind == ")") & (depth == 1), "unexpected-close").when((want == "first") & top["must"], "quoted-argument").when(dotted, "dot-identifier").otherwise("structure")
        fault = F.when(~good, F.struct(code.alias("code"), at.alias("at"), t.alias("token")))
        more_args = F.when((want == "first") & kind.isin("number", "ident", "(", "-", "quoted"), 1).when((kind == ",") | (dotted & kind.isin("number", "ident")), 1).otherwise(0)
        changed = level(
            top["call"], top["fn"], top["must"], F.when(kind == "quoted", F.substring(t, F.lit(2), x["n"] - 2)).otherwise(top["name"]), top["at"], top["args"] + more_args,
            top["dots"] + F.when(dotted, 1).otherwise(0), top["open"] + F.when(kind == "?", 1).when(kind == ":", -1).otherwise(0),
            F.when(kind == "^", True).when(kind.isin("binary", "?", ":", ",") | ((kind == "-") & j["done"]), False).otherwise(top["power"]),
        )
        outer = F.slice(a["levels"], F.lit(1), depth - 1)
        fn = ascii_lower(a["ident"])
        opened = level(call, F.when(call, fn).otherwise(""), call & fn.isin(*language.quoted), empty, a["ident_at"], zero, zero, zero, no)
        levels = F.when((kind == ")") & (depth > 1), outer).when(kind == "(", F.concat(outer, F.array(F.when(call, top).otherwise(changed)), F.array(opened))).otherwise(F.concat(outer, F.array(changed)))
        after = F.when(kind == "number", F.when(dotted, "quoted").otherwise("after")).when(kind == "ident", F.when(dotted, "quoted").otherwise("ident")).when(kind == "quoted", "quoted").when(kind == "(", F.when(call, "first").otherwise("operand")).when(kind == ")", "after").when(kind == ".", "dot").otherwise("operand")
        name = F.when(call & (kind != "(") & (a["inside"] == 0), item("name", empty, a["ident"], a["ident_at"], zero))
        found = (
            F.when(good & (kind == "quoted"), item("quoted", top["fn"], F.substring(t, F.lit(2), x["n"] - 2), at, zero)).when(good & dotted, item("dot", top["fn"], t, at, top["dots"] + 1))
            .when(good & (kind == ")") & top["call"], item("call", top["fn"], top["name"], top["at"], top["args"])).when(good & (kind == "number") & t.contains("."), item("decimal", empty, t, at, zero))
        )
        items = F.when(call | kind.isin("quoted", ")", "number", "ident"), F.concat(a["items"], F.array_compact(F.array(name, found)))).otherwise(a["items"])
        inside = a["inside"] + F.when((kind == "(") & call, 1).when((kind == ")") & top["call"], -1).otherwise(0)
        return state(at + x["n"], after, F.when(kind == "ident", t).otherwise(a["ident"]), F.when(kind == "ident", at).otherwise(a["ident_at"]), inside, levels, fault, items)

    def step(a: Column, x: Column) -> Column:
        # a character that no token has counts before any other fault
        lexical = F.when((x["kind"] == "bad") & ~a["fault"]["code"].isin(*LEXICAL), F.struct(lexical_code(x["t"]).alias("code"), a["at"].alias("at"), x["t"].alias("token"))).otherwise(a["fault"])
        moved = state(a["at"] + x["n"], *(a[n] for n in states[1:-2]), lexical, a["items"])
        turn = let(judged(a, x["kind"], F.element_at(a["levels"], -1)), lambda j: read(a, x, j))
        return F.when(a["fault"].isNotNull() | (x["kind"] == "space"), moved).otherwise(turn)

    def end(a: Column) -> Column:
        top, want, missing = F.element_at(a["levels"], -1), a["want"], F.size(a["levels"]) - 1
        whole = want.isin("after", "ident", "quoted") & (top["open"] == 0)
        pending = F.array_compact(F.array(F.when(a["fault"].isNull() & (want == "ident") & (a["inside"] == 0), item("name", empty, a["ident"], a["ident_at"], zero)), F.when(a["fault"].isNull() & whole & top["call"], item("call", top["fn"], top["name"], top["at"], top["args"]))))
        code = F.when(~whole, F.when((want == "first") & top["must"], "quoted-argument").when(want == "dot", "dot-identifier").otherwise("structure")).when(missing > 0, "missing-close")
        fault = F.coalesce(a["fault"], F.when(code.isNotNull(), F.struct(code.alias("code"), a["at"].alias("at"), empty.alias("token"))))
        lexical = F.coalesce(fault["code"].isin(*LEXICAL), no)
        return F.struct(fault.alias("fault"), missing.alias("missing"), F.when(lexical, none).otherwise(F.concat(a["items"], pending)).alias("items")).cast(WALK)

    nothing = F.struct(F.lit(None).alias("fault"), zero.alias("missing"), none.alias("items")).cast(WALK)
    return F.when(F.trim(F.translate(used, "\t\r\n", "   ")) == "", nothing).otherwise(F.aggregate(F.transform(F.regexp_extract_all(used, F.lit(LEXEME), F.lit(0)), named), begin, step, lambda a: let(a, end)))


@dataclass(frozen=True)
class Lookup:
    """The number of a list among all targets, and how its keys compare: exact, ascii-ci or fixed4."""

    edge: int
    resolver: str = "exact"


NORMAL = {"exact": lambda c: c, "ascii-ci": ascii_lower, "fixed4": fixed4_key}


def formula_findings(col: Column | str, body: Column, used: Column, walked: Column, lookups: Mapping[str, Lookup], language: Language = Language(), decimals: Column | bool = True) -> Column:
    """All findings of one walked formula.

    ``lookups``: list -> its target; names of lists that are not there are not
    checked.  ``decimals`` says whether decimals are reported.  A fault is an
    error, but that only a last ``)`` is missing; what was read before it is
    still looked up, unless the fault is a character that no token has.
    """
    fault = walked["fault"]
    rule = F.when(fault["code"].isin(*LEXICAL), "formula-lexical").otherwise("formula-balance")
    one = F.when(fault.isNotNull(), finding(rule, fault["code"], F.when(fault["code"] == "missing-close", "warning").otherwise("error"), col, body, {"depth": walked["missing"], "token": fault["token"]}, fault["at"], fault["at"] + F.length(fault["token"])))
    cut = F.when(F.length(used) < F.length(body), finding("formula-policy", "percent-ends-formula", F.when(F.trim(used) == "", "error").otherwise("warning"), col, body, {"position": F.length(used)}, F.length(used), F.length(used) + 1))
    first = F.get(F.filter(walked["items"], lambda x: x["kind"] == "decimal"), F.lit(0))
    say = decimals if isinstance(decimals, Column) else F.lit(decimals)
    decimal = F.when(say & first.isNotNull(), finding("formula-policy", "decimal", "warning", col, body, {"first": first["value"]}, first["at"], first["at"] + F.length(first["value"])))

    # what is said of an item: constants for each kind, function and place; then one finding is made of them
    fixed = lambda rule_, code, more=0, edge=None: F.struct(F.lit(rule_).alias("rule"), F.lit(code).alias("code"), F.lit(more).alias("more"), F.lit(edge).cast("int").alias("edge"))
    asked = [("name", "", 0, "scope", "formula-identifier", "unknown-identifier", 0)]
    asked += [("quoted", f, 0, name, "formula-reference", "unresolved-name", 2) for f, name in language.name_lists.items()]
    asked += [("dot", f, n, name, "formula-identifier", "unknown-identifier", 0) for (f, n), name in language.dot_lists.items()]
    pairs = lambda d: F.create_map(*(y for k, v in d.items() for y in (F.lit(k), F.lit(v))))

    def said(x: Column) -> Column:
        value, start = x["value"], x["at"]
        of_fn = F.try_element_at(pairs(language.arity), x["fn"]) if language.arity else F.lit(None)
        expected = F.when(x["fn"] == language.condition, F.try_element_at(pairs(language.conditions), ascii_lower(value))).otherwise(of_fn) if language.conditions else of_fn
        what = F.when((x["kind"] == "call") & (x["n"] != expected), fixed("formula-arity", "arity"))
        what = what.when((x["kind"] == "quoted") & (x["fn"] == language.condition) & ~ascii_lower(value).isin(*language.conditions), fixed("formula-reference", "unknown-condition", 2))
        for fn, allowed in language.parameters.items():
            what = what.when((x["kind"] == "dot") & (x["fn"] == fn) & (x["n"] == 1) & ~value.isin(*allowed), fixed("formula-reference", "invalid-parameter"))
        resolvers: dict[str, list[int]] = {}
        for kind, fn, n, name, rule_, code, more in asked:
            if name in lookups:
                to = lookups[name]
                resolvers.setdefault(to.resolver, []).append(to.edge)
                place = (x["kind"] == kind) & (x["fn"] == fn)
                what = what.when(place & (x["n"] == n) if n else place, fixed(rule_, code, more, to.edge))

        def made(w: Column) -> Column:
            key = F.coalesce(*(F.when(w["edge"].isin(*edges), NORMAL[r](value)) for r, edges in resolvers.items())) if resolvers else F.lit(None)
            call = w["code"] == "arity"
            args = F.when(call, F.create_map(F.lit("fn"), x["fn"], F.lit("found"), x["n"].cast("string"), F.lit("expected"), expected.cast("string"))).otherwise(F.create_map(F.lit("fn"), x["fn"]))
            shown = F.when(call, x["fn"]).otherwise(value)
            return F.when(w.isNotNull(), finding(w["rule"], w["code"], "error", col, shown, None, start, start + F.length(shown) + w["more"], edge=w["edge"], key=key, arguments=args))

        return let(what, made)

    items = F.array_compact(F.transform(walked["items"], said))
    return gathered([one, cut, decimal], [items.cast(f"array<{FINDING}>")])


def formulas(df: DataFrame, key: Column, cols: Sequence[str]) -> DataFrame:
    """``row_key``, ``col``, ``value``, ``body``, ``used`` of every non-blank cell of the columns."""
    wide = df.select(key.alias("row_key"), *(F.col(c).cast("string").alias(c) for c in cols))
    long = wide.unpivot(["row_key"], list(cols), "col", "value").filter(~is_blank(F.col("value")))
    body, used = used_part(F.col("value"))
    return long.withColumn("body", body).withColumn("used", used)


def formula_tokens(rows: DataFrame) -> DataFrame:
    """The formulas with their ``tokens``: lexemes but white space and unknown characters."""
    return rows.withColumn("tokens", F.filter(F.regexp_extract_all("used", F.lit(LEXEME), F.lit(0)), lambda t: t.rlike(r"^(?:\w.*|'.*'|[=!<>]=|[-+*/^<>?:(),.])$")))


def check_formulas(rows: DataFrame, table: str, lists: Mapping[str, tuple[DataFrame, str]] | None = None, language: Language = Language(), exempt: Sequence[str] = ()) -> DataFrame:
    """All violations of formulas in one pass: characters, structure, arity, decimals, '%', names.

    ``lists``: list -> (table with ``key``, resolver); an empty table means that
    every name is unknown, a missing one that names are not checked.  Columns in
    ``exempt`` may hold decimals.
    """
    lists = lists or {}
    lookups = {name: Lookup(i, resolver) for i, (name, (_, resolver)) in enumerate(lists.items())}
    targets = {lookups[name].edge: df.select(NORMAL[resolver](F.col("key")).alias("key")) for name, (df, resolver) in lists.items()}
    decimals = ~F.col("col").isin(*exempt) if exempt else F.lit(True)
    # a formula that many cells have is walked once
    walks = rows.select("used").distinct().withColumn("__walk", walk(F.col("used"), language))
    found = formula_findings(F.col("col"), F.col("body"), F.col("used"), F.col("__walk"), lookups, language, decimals)
    return resolved(exploded(rows.join(walks, "used"), table, F.col("row_key"), found), targets)


def with_alias_hint(rows: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Identifiers par10 to par20 that are read as their first four characters: both, and ``pa`` + number if it exists.

    ``hint`` is null unless the short form and the suggestion are both in the dictionary.
    """
    names = F.filter("tokens", lambda t: ascii_lower(t).rlike(r"^par(?:1[0-9]|20)$"))
    found = formula_tokens(rows).select("row_key", "col", F.explode(F.array_distinct(names)).alias("identifier"))
    found = found.withColumn("read_as", F.substring(ascii_lower(F.col("identifier")), 1, 4)).withColumn("suggestion", F.concat(F.lit("pa"), F.substring("identifier", 4, 2)))
    keys = dictionary.select(ascii_lower(F.col("key")).alias("k")).distinct()
    short = keys.select(F.col("k").alias("read_as"), F.lit(True).alias("__a"))
    long = keys.select(F.col("k").alias("suggestion"), F.lit(True).alias("__b"))
    return found.join(short, "read_as", "left").join(long, "suggestion", "left").select("row_key", "col", "identifier", "read_as", F.when(F.col("__a") & F.col("__b"), F.col("suggestion")).alias("hint"))
