"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

NOT_SPACE = "[^\\x20\\x09-\\x0D]"

#: crc32 of a text of ASCII characters: each byte is eight steps of the register.
_CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(0, length({key})), lambda i: [ord(substr({key}, i + 1, 1))::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"""


def _add(n: str, cost: str, letter: str, line: str | None = None) -> str:
    """A path's cost, audit and lines after one more edit."""
    r = f"{n}.r" if line is None else f"list_append({n}.r, {line})"
    return f"{{'c': {n}.c + {cost}, 'a': {n}.a || '{letter}', 'r': {r}}}"


def _best(*paths: str) -> str:
    return f"list_min([{', '.join(paths)}])"


def _inserted(m: str) -> str:
    """The four states of ``m`` when up to two turns may be inserted, as select items."""
    add = lambda x, role: _add(x, "2", "I", f"'{role}:'")
    once_u = _best(f"{m}2", *(add(f"{m}{s}", "user") for s in (0, 1, 3)))
    once_a = _best(f"{m}3", add(f"{m}2", "assistant"))
    return f"{m}0 AS n0, {m}1 AS n1, {_best(once_u, add(once_a, 'user'))} AS n2, {_best(once_a, add(once_u, 'assistant'))} AS n3"


_FAR = "{'c': 1000000000000::BIGINT, 'a': '', 'r': ['']}"
_ROW = "w.role || ':' || w.text"


def _moved(state: int) -> str:
    """The cheapest path to a state over one row: deleted, kept, or with another role."""
    left = "(CASE WHEN w.fault = 3 THEN 1 ELSE 0 END)"
    froms, initial, role = {0: ([], "", ""), 1: ([0], "s", ""), 2: ([0, 1, 3], "u", "user"), 3: ([2], "a", "assistant")}[state]
    kept = [f"CASE WHEN w.fault IN (0, 3) AND w.initial = '{initial}' THEN {_add(f'p.n{s}', left, 'K', _ROW)} ELSE {_FAR} END" for s in froms]
    changed = [f"CASE WHEN w.fault IN (0, 3) THEN {_add(f'p.n{s}', f'2 + {left}', 'R', chr(39) + role + ':' + chr(39) + ' || w.text')} ELSE {_FAR} END" for s in froms if role]
    return _best(_add(f"p.n{state}", "3", "D"), *kept, *changed)


OP13 = f"""
WITH RECURSIVE keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kinds AS (SELECT *, {_CRC.format(key="key")} % 20 AS kind FROM keyed),
hurt AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) AS time, substr(role, 1, 1) AS initial FROM placed),
w AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{NOT_SPACE}') THEN 1 WHEN time > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM seen),
path AS (
    SELECT conv_id, 0::BIGINT AS pos, {_inserted('m')} FROM (SELECT DISTINCT conv_id, {{'c': 0::BIGINT, 'a': '', 'r': ['']}} AS m0, {', '.join(f'{_FAR} AS m{s}' for s in (1, 2, 3))} FROM conversations)
    UNION ALL
    SELECT conv_id, pos, {_inserted('m')} FROM (SELECT w.conv_id, w.pos, {', '.join(f'{_moved(s)} AS m{s}' for s in range(4))} FROM path p JOIN w ON w.conv_id IS NOT DISTINCT FROM p.conv_id AND w.pos = p.pos + 1)),
ended AS (SELECT conv_id, pos, {_best('n0', 'n3')} AS best FROM path QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pos DESC) = 1),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM w GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
    best.c AS cost, best.a AS audit, sha256(array_to_string(best.r[2:], chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN sums s ON e.conv_id IS NOT DISTINCT FROM s.conv_id
"""

#: The conversation that op12 adds: a user turn, then an assistant turn, both with this text.
PROBE = "\\### Assistant: </turn> ok"

OP12 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE}'),
t AS (SELECT *, row_number() OVER w - 1 AS pos, 4 + len(regexp_extract_all(text, '{NOT_SPACE}+')) AS n,
    15 + length(role) + length(text) + len(regexp_extract_all(role, '[\\\\#<:]')) + len(regexp_extract_all(text, '[\\\\#<]')) AS chars
    FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text))),
s AS (SELECT *, pos = 0 AND role = 'system' AS first_system, coalesce(sum(n) OVER w, 0) AS tokens, coalesce(sum(CASE WHEN n > 640 THEN 1 ELSE 0 END) OVER w, 0) AS longer
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
p AS (SELECT *, CASE WHEN n > 640 THEN -1 ELSE tokens // 640 END AS own FROM s),
m AS (SELECT conv_id, longer, own, min(pos) AS start, min(tokens) AS begun FROM p GROUP BY ALL),
repeated AS (SELECT p.conv_id, sum(chars) AS chars FROM p JOIN m ON p.conv_id IS NOT DISTINCT FROM m.conv_id AND CASE WHEN first_system THEN start > 0 ELSE pos < start AND begun - tokens <= 256 END GROUP BY p.conv_id),
said AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars) AS chars FROM p GROUP BY conv_id)
SELECT said.conv_id, n_turns, turns_sha256, loss_chars::BIGINT AS loss_chars, loss_sha256, (said.chars + coalesce(repeated.chars, 0))::BIGINT AS formatted_chars FROM said LEFT JOIN repeated ON said.conv_id IS NOT DISTINCT FROM repeated.conv_id
"""

OP11 = """
WITH e AS (SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END) AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v, row_number() OVER () AS row FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row AS a_row, b.row AS b_row, a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.row <> b.row),
p AS (SELECT a_row, b_row, anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a_row ORDER BY score DESC, other_id NULLS LAST) <= 5),
n AS (SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.a_row, p.b_row ORDER BY score DESC, other_id NULLS LAST)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s ON p.a_row = s.a_row AND NOT s.same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT * FROM n WHERE rank <= 5
"""

ORACLES = {"op11_hard_negatives": OP11, "op12_chat_windows": OP12, "op13_turn_repair": OP13}
