"""The same results in SQL, where SQL can express an operator."""

# CRC-32 of an ASCII text, one bit a step: each byte is taken in before its eight shifts.
CRC32 = """xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(k) + 1), lambda i: [ascii(k[i])::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
 lambda c, b: xor(xor(c, b) >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT)"""

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _move(target: int, source: int, initial: str, name: str) -> str:
    """The path from one state on by a row that is kept or, for a user or an assistant, given another role."""
    mark = f"CASE WHEN left(role, 1) = '{initial}' THEN 'K' ELSE 'R' END"
    cost = f"CASE WHEN left(role, 1) = '{initial}' THEN 0 ELSE 1 END + CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END"
    line = f"CASE WHEN left(role, 1) = '{initial}' THEN role ELSE '{name}' END || ':' || text"
    ok = "fault NOT IN ('blank', 'duplicate')" + (" AND left(role, 1) = 's'" if initial == "s" else "")
    before = f"p{source}.t" + ("" if source == 0 else " || chr(10)")
    return f"CASE WHEN {ok} THEN {{c: p{source}.c + {cost}, a: p{source}.a || {mark}, t: {before} || {line}}} ELSE {_FAR} END"


_FAR = "{c: 1000000000, a: '', t: ''}"


def _drop(k: int) -> str:
    return f"{{c: p{k}.c + 2, a: p{k}.a || 'D', t: p{k}.t}}"


def _insert(source: str, name: str, first: bool = False) -> str:
    return f"{{c: {source}.c + 5, a: {source}.a || 'I', t: {source}.t || {'' if first else 'chr(10) || '}'{name}:'}}"


_CLOSE2 = f"least(q2, {_insert('q0', 'user', True)}, {_insert('q1', 'user')}, {_insert('q3', 'user')})"

DIALOGUE = f"""WITH RECURSIVE keyed AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
 coded AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32} % 20 AS code FROM keyed),
 damaged AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE code WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM coded),
 placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, rtrim(text, {_WHITE}) AS seen FROM damaged),
 faulty AS (SELECT *, CASE WHEN seen = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair FROM placed),
 counted AS (SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM faulty GROUP BY conv_id),
 walk AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {{c: 0, a: '', t: ''}} AS p0, {_FAR} AS p1, {{c: 5, a: 'I', t: 'user:'}} AS p2, {{c: 10, a: 'II', t: 'user:' || chr(10) || 'assistant:'}} AS p3 FROM faulty
  UNION ALL SELECT conv_id, i, q0, q1, z2, least(q3, {_insert('z2', 'assistant')}) FROM (SELECT *, {_CLOSE2} AS z2 FROM (SELECT walk.conv_id, f.i, {_drop(0)} AS q0, least({_drop(1)}, {_move(1, 0, 's', 'system')}) AS q1,
   least({_drop(2)}, {_move(2, 0, 'u', 'user')}, {_move(2, 1, 'u', 'user')}, {_move(2, 3, 'u', 'user')}) AS q2, least({_drop(3)}, {_move(3, 2, 'a', 'assistant')}) AS q3
   FROM walk JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM walk.conv_id AND f.i = walk.i + 1))),
 ends AS (SELECT w.conv_id, least(p0, p3) AS p FROM walk w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i)
 SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(p.c, 0) AS BIGINT) AS cost, coalesce(p.a, '') AS audit, sha256(coalesce(p.t, '')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""


_SHARE = "1 + 1000000000::HUGEINT * ({c} + 5) // ({n} + 5 * {v})"

DIVERGENCE = f"""WITH texts AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS found FROM documents),
 told AS (SELECT r, lang, source, unnest(found) AS term FROM texts),
 kept AS (SELECT lang, term, count(*) AS total FROM told GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
 sizes AS (SELECT lang, count(*) AS v, sum(total) AS n_lang FROM kept GROUP BY lang),
 groups AS (SELECT DISTINCT lang, source FROM texts),
 counts AS (SELECT lang, source, term, count(*) AS c FROM told JOIN kept USING (lang, term) GROUP BY lang, source, term),
 every AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.c, 0) AS c, sum(coalesce(c.c, 0)) OVER (PARTITION BY g.lang, g.source) AS n FROM groups g JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
 priced AS (SELECT every.*, {_SHARE.format(c="c", n="n", v="v")} AS p, {_SHARE.format(c="total", n="n_lang", v="v")} AS q FROM every JOIN sizes USING (lang)),
 pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(sum(abs(x.p - y.p)), 0) AS BIGINT) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN priced x ON x.lang = a.lang AND x.source = a.source LEFT JOIN priced y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY a.lang, a.source, b.source),
 terms AS (SELECT lang, source, term AS item, CAST(p - q AS BIGINT) AS value FROM priced WHERE c > 0 AND p > q)
 SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pairs
 UNION ALL SELECT * FROM (SELECT lang, source, 'term' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM terms) WHERE rank <= 50"""
