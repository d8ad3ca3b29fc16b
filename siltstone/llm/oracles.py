"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from siltstone.llm.licenses import BREAK, RULES, SENTENCES
from siltstone.llm.line_rules import LEAST_KEPT, LINE_DOCUMENTS

CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), sized AS (
  SELECT *,
    4 + length(replace(replace(role, '\', '\\'), ':', '\:')) + 2
      + length(replace(replace(replace(text, '\', '\\'), '</turn>', '\</turn>'), '### ', '\### ')) + 8 AS chars
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

DECONTAMINATION = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS g
  FROM item_words, generate_series(1, greatest(len(w) - 9, 1)) AS s(i) WHERE len(w) > 0
), doc_words AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), places AS (
  SELECT r, i, m, array_to_string(list_slice(w, i, i + m - 1), ' ') AS g
  FROM doc_words, (SELECT DISTINCT m FROM windows), generate_series(1, len(w) - m + 1) AS s(i)
), hits AS (SELECT r, i, p.m, item_id FROM places p JOIN windows v ON p.m = v.m AND p.g = v.g),
covered AS (SELECT r, count(DISTINCT j) AS n_hit FROM hits, generate_series(i, i + m - 1) AS t(j) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN covered USING (r) LEFT JOIN items USING (r)
"""

SUBSTRINGS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS h FROM d, generate_series(1, len(w) - 34) AS s(i)),
again AS (SELECT r, i FROM places WHERE h IN (SELECT h FROM places GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT r, list(DISTINCT j) AS js FROM (SELECT r, unnest(generate_series(i, i + 34)) AS j FROM again) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(js), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN js IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(js, k)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""

LINES = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (SELECT r, i, array_to_string(list_slice(w, i, i + 4), ' ') AS h FROM d, generate_series(1, len(w) - 4) AS s(i)),
rep AS (
  SELECT r, count(DISTINCT j) AS n FROM (
    SELECT r, unnest(generate_series(i, i + 4)) AS j FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS c FROM g) WHERE c > 1) GROUP BY r
), l AS (SELECT r, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
raw AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
norm AS (
  SELECT r, host, text, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS line FROM l
), per AS (SELECT r, host, text, line, sum(length(line) - length(replace(line, ' ', '')) + 1) AS n FROM norm WHERE line <> '' GROUP BY ALL),
common AS (SELECT host, line FROM per GROUP BY host, line HAVING count(*) > {LINE_DOCUMENTS}),
lost AS (SELECT r, sum(n) AS n FROM per SEMI JOIN common USING (host, line) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(raw.n, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_line_words
  FROM d LEFT JOIN rep USING (r) LEFT JOIN raw USING (r) LEFT JOIN lost USING (r)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * (n_words - n_line_words) > {LEAST_KEPT} * n_words AS kept
FROM m
"""


def _licenses() -> str:
    known = ", ".join(f"'{s}'" for s in SENTENCES)
    code = lambda rule: "," + ",".join(map(str, rule[2])) + ","

    def matched(rule) -> str:
        longer = [x for x in RULES if len(x[2]) > len(rule[2]) and code(rule) in code(x)]
        return " AND ".join([f"contains(c, '{code(rule)}')", *(f"NOT contains(c, '{code(x)}')" for x in longer)])

    names = ", ".join(f"CASE WHEN {matched(r)} THEN '{r[0]}' END" for r in RULES)
    bound = " OR ".join(f"({matched(r)})" for r in RULES if not r[1])
    # DuckDB's patterns look neither ahead nor behind: an end mark is put behind each sentence first.
    cut = r"string_split(regexp_replace(regexp_replace(coalesce(text, ''), '\n+', chr(1), 'g'), '([.!?;])[ \t\r]+', '\1' || chr(1), 'g'), chr(1))"
    assert BREAK == r"\n+|(?<=[.!?;])[ \t\r]+"
    return rf"""
WITH s AS (SELECT doc_id, list_filter(list_transform({cut}, lambda x: coalesce(list_position([{known}], trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g'))), 0)), lambda x: x > 0) AS ids FROM documents),
t AS (SELECT doc_id, array_to_string(ids, ',') AS sentence_ids, ',' || array_to_string(ids, ',') || ',' AS c FROM s),
u AS (SELECT doc_id, sentence_ids, list_sort(list_distinct(list_filter([{names}], lambda x: x IS NOT NULL))) AS names, {bound} AS restricted FROM t)
SELECT doc_id, sentence_ids, array_to_string(names, ',') AS licenses, CAST(len(names) AS BIGINT) AS n_licenses, restricted FROM u
"""



#: CRC-32 of an ASCII text in SQL: the table from the polynomial, then byte by byte.
CRC_TABLE = "(SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS t)"


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def _paid(weight: str, cost: int, letters: str) -> str:
    """A weight as text: six digits of cost, then the letters so far.  Null is no way at all."""
    return f"(printf('%06d', CAST(left({weight}, 6) AS BIGINT) + {cost}) || substr({weight}, 7) || '{letters}')"


def _repaired_sql() -> str:
    none, after_s, after_u, after_a = (f"w[{k}]" for k in (1, 2, 3, 4))
    others = f"least({none}, {after_s}, {after_a})"
    # Before a row stand no, one or two insertions: (nothing, after system, after user, after assistant).
    user = f"least({after_u}, {_paid(others, 5, 'I')}, {_paid(after_u, 10, 'II')})"
    assistant = f"least({after_a}, {_paid(after_u, 5, 'I')}, {_paid(others, 10, 'II')})"
    stays = lambda weight, role: f"CASE WHEN c[2] IN ('n', 't') THEN CASE WHEN c[2] = 't' THEN CASE WHEN c[1] = '{role}' THEN {_paid(weight, 5, 'K')} ELSE {_paid(weight, 6, 'R')} END WHEN c[1] = '{role}' THEN {_paid(weight, 0, 'K')} ELSE {_paid(weight, 1, 'R')} END END"
    system = f"CASE WHEN c[1] = 's' AND c[2] = 'n' THEN {_paid(none, 0, 'K')} WHEN c[1] = 's' AND c[2] = 't' THEN {_paid(none, 5, 'K')} END"
    step = f"[{_paid(none, 2, 'D')}, least({_paid(after_s, 2, 'D')}, {system}), least({_paid(user, 2, 'D')}, {stays(f'least({none}, {after_s}, {assistant})', 'u')}), least({_paid(assistant, 2, 'D')}, {stays(user, 'a')})]"
    return rf"""
WITH crc AS {CRC_TABLE}, kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS k
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) FROM kinds WHERE k <> 0)
), faults AS (
  SELECT *, left(role, 1) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM damaged
), judged AS (
  SELECT *, CASE
    WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
    WHEN seen > 1 THEN 'd'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE 'n' END AS f
  FROM faults
), listed AS (
  SELECT conv_id, list([i, f] ORDER BY turn NULLS FIRST, role, text, seen) AS codes, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, role, text, seen) AS turns,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(f = 'b') AS blank, count_if(f = 'd') AS duplicate, count_if(f = 't') AS truncated
  FROM judged GROUP BY conv_id
), weighed AS (
  SELECT *, list_reduce(codes, lambda w, c: {step}, ['000000', NULL, NULL, NULL]) AS w FROM listed
), chosen AS (
  SELECT *, least(w[1], w[4], {_paid('w[3]', 5, 'I')}, {_paid('w[2]', 10, 'II')}) AS best,
    len(list_filter(range(1, len(codes)), lambda n: (codes[n][1] || codes[n + 1][1]) NOT IN ('su', 'ua', 'au'))) AS illegal
  FROM weighed
), audited AS (
  SELECT *, CAST(left(best, 6) AS BIGINT) AS cost, substr(best, 7) AS audit FROM chosen
), steps AS (
  SELECT conv_id, n, audit[n] AS edit, turns[len(regexp_replace(audit[1:n], 'I', '', 'g'))] AS t, len(regexp_replace(audit[1:n], 'D', '', 'g')) AS place,
    CASE WHEN left(regexp_replace(audit, 'D', '', 'g'), 1) = 'K' AND left(turns[len(regexp_extract(audit, '^D*')) + 1].role, 1) = 's' THEN 1 ELSE 0 END AS systems
  FROM audited, generate_series(1, len(audit)) AS s(n)
), hashed AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN t.role WHEN (place - systems) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE t.text END, chr(10) ORDER BY n)) AS sha
  FROM steps WHERE edit <> 'D' GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN audited a ON o.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN hashed h ON o.conv_id IS NOT DISTINCT FROM h.conv_id
"""


PERIODIC = rf"""
WITH crc AS {CRC_TABLE}, hashed AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, {_crc("CAST(doc_id AS VARCHAR)")} AS h FROM documents, crc
), sized AS (
  SELECT *, h // 10 AS g, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM hashed
), planted AS (
  SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM sized
), numbered AS (
  SELECT r, doc_id, n, i, CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS word FROM planted, generate_series(0, n - 1) AS s(i)
), pairs AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM numbered x JOIN numbered y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4
), islands AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM pairs) GROUP BY r, q, island HAVING count(*) + q >= greatest(6, 4 * q)
), runs AS (
  SELECT * FROM islands x WHERE NOT EXISTS (SELECT 1 FROM islands y WHERE x.r = y.r AND y.q < x.q AND y.start <= x.start AND y.start + y.length >= x.start + x.length)
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS words FROM numbered m WHERE NOT EXISTS (SELECT 1 FROM runs x WHERE x.r = m.r AND m.i >= x.start + x.q AND m.i < x.start + x.length) GROUP BY r
), summed AS (
  SELECT r, count(*) AS n_runs, min({{'l': -length, 's': start, 'q': q}}) AS best, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM runs GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, -best.l AS length, best.q AS period, 1000 * -best.l // best.q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM planted LEFT JOIN summed USING (r) LEFT JOIN kept USING (r)
"""

ORACLES = {"op1_chat_format": CHAT, "op3_decontamination": DECONTAMINATION, "op7_substring_dedup": SUBSTRINGS, "op8_line_rules": LINES, "op10_licenses": _licenses(), "op11_repair": _repaired_sql(), "op12_periodic_runs": PERIODIC}
