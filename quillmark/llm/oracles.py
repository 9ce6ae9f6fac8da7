"""DuckDB SQL for the operators that SQL can express on whole tables."""

from __future__ import annotations

from . import chat, mixing, repair, sharding

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS shingle FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)"""

OP10 = """
WITH h AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN nullif(min(page_id) OVER (PARTITION BY payload_digest), page_id) END AS refers_to FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM f"""


#: Weighted Jaccard similarity of item-sized windows, over all windows of every document and item that share a shingle.
OP9 = f"""
WITH i0 AS MATERIALIZED (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
i AS MATERIALIZED (SELECT *, len(ws) AS l, row_number() OVER () AS k FROM i0 WHERE len(ws) > 0),
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS ws FROM documents),
g AS MATERIALIZED (SELECT k, l, array_to_string(ws[p:p + 4], ' ') AS s, count(*) AS c FROM i, LATERAL (SELECT unnest(range(1, greatest(l - 4, 1) + 1)) AS p) GROUP BY ALL),
h AS MATERIALIZED (SELECT s, count(*) AS holders FROM g GROUP BY s),
n AS (SELECT count(*) AS n FROM i),
u AS MATERIALIZED (SELECT s, round(ln(1 + (SELECT n FROM n) / CASE WHEN holders > 1 THEN holders ELSE 1 END) * 68719476736)::HUGEINT AS w FROM h),
o AS (SELECT round(ln(1 + (SELECT n FROM n)) * 68719476736)::HUGEINT AS w),
t AS MATERIALIZED (SELECT k, l, sum(w * c) AS total FROM g JOIN u USING (s) GROUP BY ALL),
x AS MATERIALIZED (SELECT r, len(ws) AS m, p, array_to_string(ws[p:p + 4], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS p) WHERE len(ws) > 0),
y AS MATERIALIZED (SELECT x.*, sum(coalesce(u.w, (SELECT w FROM o))) OVER (PARTITION BY r ORDER BY p) AS upto, coalesce(u.w, (SELECT w FROM o)) AS w FROM x LEFT JOIN u USING (s)),
z AS MATERIALIZED (SELECT y.r, g.k, y.m, g.l, least(y.m, g.l) AS len, greatest(least(y.m, g.l) - 4, 1) AS width, y.p, y.s, y.w, g.c FROM y JOIN g USING (s) WHERE (y.m >= 5 AND g.l >= 5)),
v AS (SELECT r, k, width, "start", s, w, c, count(*) AS cw FROM z, LATERAL (SELECT unnest(range(greatest(p - width + 1, 1), least(p, m - len + 1) + 1)) AS "start") GROUP BY ALL),
q AS (SELECT r, k, width, "start", sum(w * least(c, cw)) AS common FROM v GROUP BY ALL),
f AS (SELECT q.r, q.k, common, t.total + b.w + e.upto - b.upto - common AS whole FROM q JOIN t USING (k) JOIN y b ON b.r = q.r AND b.p = q."start" JOIN y e ON e.r = q.r AND e.p = q."start" + q.width - 1),
m AS (SELECT r, k, max(common::DOUBLE / whole::DOUBLE) AS similarity FROM f WHERE 4 * common >= 3 * whole GROUP BY ALL UNION ALL
  SELECT r, k, 1.0 FROM d JOIN i ON i.l < 5 AND list_contains(list_transform(range(1, len(d.ws) - i.l + 2), lambda p: array_to_string(d.ws[p:p + i.l - 1], ' ')), array_to_string(i.ws, ' '))),
a AS (SELECT r, count(*) AS n_items, max(similarity) AS similarity FROM m GROUP BY r),
c AS (SELECT a.*, (SELECT min(item_id) FROM m JOIN i USING (k) WHERE m.r = a.r AND m.similarity = a.similarity) AS item_id FROM a)
SELECT doc_id, n_items IS NOT NULL AS contaminated, item_id, round(coalesce(similarity, 0), 9) AS similarity, coalesce(n_items, 0) AS n_items FROM d LEFT JOIN c USING (r)"""


#: CRC-32 byte by byte with the table of its polynomial; then the walk around the ring, one piece of an arc at a time.
OP8 = f"""
WITH RECURSIVE t8 AS (SELECT b, b AS v, 0 AS k FROM (SELECT unnest(range(256)) AS b) UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, k + 1 FROM t8 WHERE k < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY b) AS c FROM t8 WHERE k = 8),
docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) + 1 AS size, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 2 * strlen(coalesce(text, '')), 2),
  lambda p: ('0x' || substr(hex(encode(coalesce(text, ''))), p, 2))::BIGINT)), lambda x, y: xor(c[(xor(x, y) & 255) + 1], x >> 8))) AS text_crc32 FROM documents, crc),
nodes AS MATERIALIZED (SELECT ('0x' || substr(md5('shard-' || s || '-node-' || v), 1, 8))::BIGINT AS place, min(s) AS shard FROM (SELECT unnest(range(8)) AS s), (SELECT unnest(range({sharding.VIRTUAL_NODES})) AS v) GROUP BY 1),
arcs AS MATERIALIZED (SELECT place, shard, row_number() OVER (ORDER BY place) - 1 AS arc FROM nodes),
placed AS MATERIALIZED (SELECT *, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS place, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || size || '|' || text_crc32), 9, 4))::BIGINT % {sharding.PARTS} AS part FROM docs),
unit AS MATERIALIZED (SELECT placed.*, coalesce(arc, 0) * {sharding.PARTS} + part AS unit FROM placed ASOF LEFT JOIN arcs ON placed.place <= arcs.place),
ranked AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY place, doc_id NULLS FIRST, size, text_crc32) - 1 AS rank FROM unit),
n AS MATERIALIZED (SELECT unit, count(*) AS n FROM unit GROUP BY unit),
fixed AS MATERIALIZED (SELECT list(coalesce(n.n, 0) ORDER BY e.u) AS counts, (SELECT list(shard ORDER BY arc) FROM arcs) AS owners, count(*) AS units, (SELECT count(*) FROM docs) AS total FROM (SELECT unnest(range((SELECT count(*) FROM arcs) * {sharding.PARTS})) AS u) e LEFT JOIN n ON n.unit = e.u),
room AS MATERIALIZED (SELECT list_transform(range(8), lambda s: total // 8 + CASE WHEN s < total % 8 THEN 1 ELSE 0 END) AS room FROM fixed),
walk AS (
  SELECT 0::BIGINT AS step, false AS drain, 0::BIGINT AS own, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[] AS used, []::STRUCT(u BIGINT, lo BIGINT, hi BIGINT)[] AS queue, NULL::STRUCT(u BIGINT, lo BIGINT, hi BIGINT, shard BIGINT, slot BIGINT) AS seg
  UNION ALL
  SELECT CASE WHEN more THEN step ELSE step + 1 END, more, CASE WHEN more THEN taken ELSE 0 END, now,
    CASE WHEN more OR taken >= n THEN rest ELSE list_append(rest, {{'u': u, 'lo': taken, 'hi': n}}) END, CASE WHEN t > 0 THEN {{'u': piece.u, 'lo': piece.lo, 'hi': piece.lo + t, 'shard': s, 'slot': used[s + 1]}} END
  FROM (SELECT *, len(rest) > 0 AND now[s + 1] < room[s + 1] AS more FROM (
    SELECT *, list_concat(list_append(used[:s], used[s + 1] + t), used[s + 2:]) AS now, CASE WHEN drain THEN own ELSE t END AS taken,
      CASE WHEN NOT drain THEN queue WHEN piece.lo + t < piece.hi THEN list_prepend({{'u': piece.u, 'lo': piece.lo + t, 'hi': piece.hi}}, queue[2:]) ELSE queue[2:] END AS rest
    FROM (SELECT *, least(piece.hi - piece.lo, room[s + 1] - used[s + 1]) AS t FROM (
      SELECT walk.*, room, u, n, s, CASE WHEN drain THEN queue[1] ELSE {{'u': u, 'lo': 0::BIGINT, 'hi': n}} END AS piece FROM (
        SELECT walk.*, step % units AS u, CASE WHEN step < units THEN counts[step % units + 1] ELSE 0 END AS n, owners[(step % units) // {sharding.PARTS} + 1] AS s FROM walk, fixed
        WHERE step < units OR (step < 2 * units AND len(queue) > 0)) walk, room))))),
segs AS MATERIALIZED (SELECT seg.u AS unit, seg.lo AS lo, seg.hi AS hi, seg.shard AS shard, seg.slot AS slot FROM walk WHERE seg IS NOT NULL)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard::INT AS shard, slot + rank - lo AS slot, NULL::INT AS grown_shard FROM ranked JOIN segs ON segs.unit = ranked.unit AND rank >= lo AND rank < hi"""


def _op2() -> str:
    """Raking written out sweep by sweep over the cell table."""
    t = "coalesce(text, '')"
    chars = f"greatest(length({t}), 1)"

    def lost(marks: str) -> str:
        return f"({chars} - length(translate({t}, {marks}, '')))"

    topic = f"""CASE WHEN length({t}) = 0 THEN 'note' WHEN {lost("'#$%&*@|~^<>{}'")} * 20 >= {chars} THEN 'symbols' WHEN {lost("'0123456789'")} * 100 >= {chars} THEN 'figures'
      WHEN {chars} < 400 THEN 'note' WHEN {lost("chr(10)")} * 120 >= {chars} THEN 'lines' ELSE 'prose' END"""
    steps = [
        f"d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, {topic} AS topic, len(regexp_extract_all({t}, '{_WORD}')) AS n_tokens FROM documents)",
        "c AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS n FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)",
    ]
    for x in mixing.DIMENSIONS:
        steps.append(f"t_{x} AS MATERIALIZED (SELECT {x}, pow(sum(n), {mixing.TEMPERATURE}::DOUBLE) AS t FROM c GROUP BY {x})")
        steps.append(f"h_{x} AS MATERIALIZED (SELECT {x}, t / (SELECT sum(t) FROM t_{x}) AS h_{x} FROM t_{x})")
    steps.append("s0 AS MATERIALIZED (SELECT *, 1.0::DOUBLE AS f_source, 1.0::DOUBLE AS f_lang, 1.0::DOUBLE AS f_topic FROM c JOIN h_source USING (source) JOIN h_lang USING (lang) JOIN h_topic USING (topic))")
    now, k = "n * f_source * f_lang * f_topic", 0
    for _ in range(mixing.SWEEPS):
        for x in mixing.DIMENSIONS:
            others = ", ".join(f"f_{y}" for y in mixing.DIMENSIONS if y != x)
            steps.append(f"s{k + 1} AS MATERIALIZED (SELECT source, lang, topic, n, h_source, h_lang, h_topic, {others}, f_{x} * (h_{x} * (sum({now}) OVER ()) / (sum({now}) OVER (PARTITION BY {x}))) AS f_{x} FROM s{k})")
            k += 1
    steps.append(f"z AS MATERIALIZED (SELECT max(f_source * f_lang * f_topic) AS most FROM s{k})")
    steps += [f"g_{x} AS MATERIALIZED (SELECT {x}, min(f_{x}) AS g_{x} FROM s{k} GROUP BY {x})" for x in mixing.DIMENSIONS]
    weight = "coalesce(1 / (SELECT most FROM z), 1.0)" + "".join(f" * coalesce(g_{x}, 1.0)" for x in mixing.DIMENSIONS)
    steps.append(
        f"o AS (SELECT doc_id, source, lang, topic, n_tokens, round(least({weight}, 1.0), 9) AS probability, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|{mixing.SEED}'), 1, 8))::BIGINT / 4294967296.0 AS u"
        " FROM d " + " ".join(f"LEFT JOIN g_{x} USING ({x})" for x in mixing.DIMENSIONS) + ")"
    )
    return "WITH " + ",\n".join(steps) + "\nSELECT *, u < probability AS kept FROM o"


OP2 = _op2()


#: Every order of the five filters, every step, over the flags of each document.
OP11 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS MATERIALIZED (SELECT *, regexp_extract_all(text, '{_WORD}') AS ws, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
f AS MATERIALIZED (SELECT doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS MATERIALIZED (SELECT part, fails, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN l USING (doc_id)),
p AS (SELECT a.i AS a, b.i AS b, c.i AS c, d.i AS d, e.i AS e FROM range(1, 6) a(i), range(1, 6) b(i), range(1, 6) c(i), range(1, 6) d(i), range(1, 6) e(i)),
o AS MATERIALIZED (SELECT [a, b, c, d, e] AS seq, array_to_string(list_transform([a, b, c, d, e], lambda k: 'ABCDE'[k]), '') AS filter_order FROM p WHERE len(list_distinct([a, b, c, d, e])) = 5),
s AS (SELECT part, filter_order, step, fails[seq[step]] AS this, len(list_filter(seq[:step - 1], lambda k: fails[k])) > 0 AS before, len(list_filter(fails, lambda k: k)) AS n_fails, good, toxic FROM m, o, (SELECT unnest(range(1, 6))::INT AS step)),
t AS (SELECT part, filter_order, step, sum((NOT this AND NOT before)::INT)::BIGINT AS kept, sum((this AND NOT before)::INT)::BIGINT AS removed, sum((this AND before)::INT)::BIGINT AS redundant, sum((this AND n_fails = 1)::INT)::BIGINT AS unique_fails,
  sum((this AND NOT before)::INT * good)::BIGINT AS good_lost, sum((this AND NOT before)::INT * toxic)::BIGINT AS toxic_lost FROM s GROUP BY ALL)
SELECT *, sum(removed) OVER (PARTITION BY part, filter_order[step])::BIGINT AS shapley FROM t"""


def _op12() -> str:
    """Digests of the turns themselves; the length of the formatted text from its marks and escapes."""
    t = chat.Template()
    controls = t.pattern(r"(\\*)").replace("'", "''")
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{chat.PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{chat.PROBE}'),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM c),
b AS (SELECT *, coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY k), true) AS begins, length(regexp_replace(text, '{controls}', '\\1\\\\\\2\\3', 'g')) AS chars FROM n)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars + CASE WHEN begins THEN {len(t.open) + len(t.close) + 2} + length(url_encode(role)) ELSE {len(t.between)} END)::BIGINT AS formatted_chars
FROM b GROUP BY conv_id"""


OP12 = _op12()


def _op13() -> str:
    """The same edits with whole audits and texts carried along: the best way to each state, row by row."""
    p = repair.Prices()
    kind = "STRUCT(cost BIGINT, audit VARCHAR, text VARCHAR)"

    def moved(cost: str, audit: str, text: str) -> str:
        return f"{{'cost': {cost}, 'audit': {audit}, 'text': {text}}}"

    def stays(q: str) -> str:
        return f"CASE WHEN {q} IS NOT NULL THEN {moved(f'{q}.cost + {p.delete}', f'{q}.audit || chr(68)', f'{q}.text')} END"

    def retained(q: str, r: str, roles: str) -> str:
        named = {"s": "system", "u": "user", "a": "assistant"}[r]
        lines = "".join(f" || '{repair.ROLES[x].decode()}:' || chr(10)" for x in roles)
        kept = f"(left(role, 1) = '{r}')"
        cost = f"{q}.cost + {p.insert * len(roles)} + CASE WHEN {kept} THEN 0 ELSE {p.rerole} END + CASE WHEN cut THEN {p.cut} ELSE 0 END"
        audit = f"{q}.audit || '{'I' * len(roles)}' || CASE WHEN {kept} THEN 'K' ELSE 'R' END"
        only = f" AND {kept}" if r == "s" else ""
        return f"CASE WHEN NOT lost AND {q} IS NOT NULL{only} THEN {moved(cost, audit, f'{q}.text{lines} || CASE WHEN {kept} THEN role ELSE {chr(39)}{named}{chr(39)} END || {chr(39)}:{chr(39)} || text || chr(10)')} END"

    names = {"": "e", "s": "s", "u": "u", "a": "a"}
    after = []
    for r, x in names.items():
        ways = [stays(x)] + [retained(names[q], r, roles) for (q, to), roles in repair.GAPS.items() if to == r]
        after.append(f"list_sort(list_filter([{', '.join(ways)}], lambda w: w IS NOT NULL))[1] AS {x}")
    ends = []
    for q, x in names.items():
        tail = repair.TAILS[q]
        lines = "".join(f" || '{repair.ROLES[r].decode()}:' || chr(10)" for r in tail)
        ends.append(f"CASE WHEN {x} IS NOT NULL THEN {moved(f'{x}.cost + {p.insert * len(tail)}', f'{x}.audit || {chr(39)}{chr(73) * len(tail)}{chr(39)}', f'{x}.text{lines}')} END")
    space = r"[\x20\x09-\x0D]"
    return f"""
WITH RECURSIVE t8 AS (SELECT b, b AS v, 0 AS k FROM (SELECT unnest(range(256)) AS b) UNION ALL SELECT b, CASE WHEN v % 2 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, k + 1 FROM t8 WHERE k < 8),
crc AS MATERIALIZED (SELECT list(v ORDER BY b) AS c FROM t8 WHERE k = 8),
rows AS MATERIALIZED (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
faulty AS MATERIALIZED (SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(key) + 1), lambda p: ascii(key[p])::BIGINT)), lambda x, y: xor(c[(xor(x, y) & 255) + 1], x >> 8))) % 20 AS fault FROM rows, crc),
damaged AS MATERIALIZED (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM faulty, LATERAL (SELECT unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)))),
placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, regexp_replace(text, '{space}+$', '') AS body FROM damaged),
judged AS MATERIALIZED (SELECT *, body = '' AS blank, body <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again, left(lag(role) OVER (PARTITION BY conv_id ORDER BY k), 1) || left(role, 1) AS pair FROM placed),
marked AS MATERIALIZED (SELECT *, blank OR again AS lost, NOT blank AND NOT again AND right(body, 1) NOT IN ('.', '!', '?') AS cut FROM judged),
counts AS MATERIALIZED (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(again::INT) AS duplicate, sum(cut::INT) AS truncated, sum((pair NOT IN ('su', 'ua', 'au'))::INT) AS illegal, count(*) AS n FROM marked GROUP BY conv_id),
walk AS (
  SELECT conv_id, 0::BIGINT AS k, {moved("0", "''", "''")}::{kind} AS e, NULL::{kind} AS s, NULL::{kind} AS u, NULL::{kind} AS a FROM counts
  UNION ALL
  SELECT conv_id, k, {", ".join(after)} FROM (SELECT w.conv_id, m.k, e, s, u, a, role, text, lost, cut FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.k = w.k + 1)),
ended AS MATERIALIZED (SELECT w.conv_id, list_sort(list_filter([{", ".join(ends)}], lambda x: x IS NOT NULL))[1] AS best FROM walk w JOIN counts c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.k = c.n)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(best.text[:length(best.text) - 1], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN ended ON ended.conv_id IS NOT DISTINCT FROM i.conv_id"""


OP13 = _op13()
