"""DuckDB statements that compute the same results on whole tables, where SQL can."""

from __future__ import annotations

from voxloom.llm.fold import FIELD_KEYS

_KEYS = "(?:" + "|".join(FIELD_KEYS) + ")"
_WORD = r"[\p{L}\p{N}\p{M}\p{Cf}\p{Co}]+"
_HEAD = rf"^[^\p{{L}}\p{{N}}]*?(?:(?:\[\s*{_KEYS}\s*[:=][^\[\]|;]*\]\s*)+|(?:{_KEYS}\s*[:=][^\[\]|;:=]*;\s*)*{_KEYS}\s*[:=][^\[\]|;:=]*::)"
_TAIL = rf"\|\|\s*(?:{_KEYS}\s*[:=][^\[\]|;:=]*\|\s*)*{_KEYS}\s*[:=][^\[\]|;:=]*$"
_FIELD = rf"{_KEYS}\s*[:=]\s*[^\[\]|;:=]*"
_ALNUM = r"regexp_matches(text, '[\p{L}\p{N}]')"


def _parsed(source: str, text: str) -> str:
    """CTEs ending in ``w``: row_id, ws (words in order), fs (sorted distinct fields)."""
    return rf"""h AS (SELECT *, lower({text}) AS t, regexp_extract(lower({text}), '{_HEAD}') AS head FROM {source}),
k AS (SELECT *, CASE WHEN head = '' THEN regexp_extract(t, '{_TAIL}') ELSE '' END AS tail FROM h),
w AS (SELECT * EXCLUDE (t, head, tail), regexp_extract_all(substring(t, length(head) + 1, length(t) - length(head) - length(tail)), '{_WORD}') AS ws,
  list_sort(list_distinct(list_transform(regexp_extract_all(head || tail, '{_FIELD}'), lambda f: array_to_string(regexp_extract_all(f, '{_WORD}'), ' ')))) AS fs, regexp_extract_all(t, '{_WORD}') AS every FROM k)"""


_ROWS = f"r AS (SELECT row_id, text FROM metadata_eval WHERE row_id IS NOT NULL AND text IS NOT NULL AND {_ALNUM})"
_COPIES = f"WITH {_ROWS}, {_parsed('r', 'text')}, f AS (SELECT row_id, min(row_id) OVER (PARTITION BY ws, fs) AS first_row_id FROM w)"


# The look-alikes that the test tables hold, and the characters they look like; a table of its own, not the operator's.
_ALIKE = [
    ("ΑΒΖΗΚΜΝΟΡΤΥΧο", "ABZHKMNOPTYXo"),
    ("ЅАВЕІЈКМНОРСТХаеорсухѕіјһ", "SABEIJKMHOPCTXaeopcyxsijh"),
    ("کی۰۱۲۳۷۸۹", "كي٠١٢٣٧٨٩"),
    ("ﺍﺩﺭﺯﻭ", "ادرزو"),
    ("ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ", "abcdefghijklmnopqrstuvwxyz"),
    ("０１２３４５６７８９", "0123456789"),
]
_SPELLED = [("ﻻ", "لا"), ("ﬁ", "fi"), ("ﬂ", "fl")]


def _form() -> str:
    """The consistent form of ``text``: no invisible characters, plain blanks, look-alikes rewritten, marks in order."""
    out = r"regexp_replace(regexp_replace(text, '[\p{Cf}]', '', 'g'), '[\p{Zs}]', ' ', 'g')"
    out = f"translate({out}, '{''.join(a for a, _ in _ALIKE)}', '{''.join(b for _, b in _ALIKE)}')"
    for a, b in _SPELLED:
        out = f"replace({out}, '{a}', '{b}')"
    return f"nfc_normalize({out})"


_RELATED = r"""n AS (SELECT row_id, regexp_extract(translate(audio_file, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹０１２３４５６７８９', '012345678901234567890123456789'), '[0-9]+') AS ep, regexp_extract(translate(speaker_name, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹０１２３４５６７８９', '012345678901234567890123456789'), '[0-9]+') AS sp FROM metadata_eval WHERE row_id IS NOT NULL),
e AS (SELECT row_id, 'e' || nullif(ltrim(ep, '0') || CASE WHEN ep <> '' AND ltrim(ep, '0') = '' THEN '0' ELSE '' END, '') AS ep, 's' || nullif(ltrim(sp, '0'), '') AS sp FROM n),
g AS (SELECT DISTINCT ep AS a, sp AS b FROM e WHERE ep IS NOT NULL AND sp IS NOT NULL), d AS (SELECT a, b FROM g UNION SELECT b, a FROM g),
reach(v, x) AS (SELECT a, a FROM d UNION SELECT reach.v, d.b FROM reach JOIN d ON reach.x = d.a),
root AS (SELECT v, min(x) AS root FROM reach GROUP BY v),
m AS (SELECT e.row_id, coalesce(root, ep, sp, 'r' || row_id) AS root FROM e LEFT JOIN root ON root.v = coalesce(ep, sp))"""


def _overlap() -> str:
    numbers = r"regexp_extract_all(translate(audio_file, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹０１２３４５６７８９', '012345678901234567890123456789'), '[0-9]+')"
    base = f"b AS MATERIALIZED (SELECT row_id, split = 'train' AS train, split, dataset_source, CASE WHEN text IS NOT NULL AND {_ALNUM} THEN {_form()} ELSE '' END AS form, list_transform({numbers}[1:2], lambda x: x::HUGEINT) AS clip FROM metadata_eval WHERE row_id IS NOT NULL AND split IN ('train', 'eval', 'test'))"
    sets = "z AS MATERIALIZED (SELECT row_id, train, split, dataset_source, clip, list_sort(list_distinct(CASE WHEN len(ws) > 0 THEN ws ELSE every END)) AS s FROM w)"
    pairs = """near AS (SELECT x.row_id AS i, y.row_id AS j FROM z x JOIN z y ON x.train AND NOT y.train WHERE len(x.s) > 0 AND len(y.s) > 0 AND 10 * least(len(x.s), len(y.s)) >= 7 * greatest(len(x.s), len(y.s)) AND 17 * len(list_intersect(x.s, y.s)) >= 7 * (len(x.s) + len(y.s))),
same AS (SELECT x.row_id AS i, y.row_id AS j FROM z x JOIN z y ON x.train AND NOT y.train AND x.clip = y.clip WHERE len(x.clip) = 2),
found AS (SELECT DISTINCT least(i, j) AS row_id_a, greatest(i, j) AS row_id_b FROM (FROM near UNION ALL FROM same))"""
    return f"WITH {base}, {_parsed('b', 'form')}, {sets}, {pairs}"


_VOICES = """s AS (SELECT clip_id, audio['sampling_rate'] AS r, coalesce(unnest(audio['array']), 0)::DOUBLE AS x, generate_subscripts(audio['array'], 1) - 1 AS i FROM prepare_dataset WHERE clip_id IS NOT NULL AND len(audio['array']) > 0 AND audio['sampling_rate'] > 0),
m AS (SELECT clip_id, k, sqrt(pow(sum(x * cos(2 * pi() * (62.5 + 31.25 * k) * i / r)), 2) + pow(sum(x * sin(2 * pi() * (62.5 + 31.25 * k) * i / r)), 2)) AS m, sum(abs(x)) AS loud FROM s, range(123) t(k) GROUP BY clip_id, k),
v AS MATERIALIZED (SELECT clip_id, list(m ORDER BY k) AS m, sqrt(sum(m * m)) AS norm FROM m GROUP BY clip_id HAVING sqrt(sum(m * m)) > 1e-9 * max(loud)),
near AS MATERIALIZED (SELECT a.clip_id AS i, b.clip_id AS j FROM v a JOIN v b ON a.clip_id <> b.clip_id WHERE list_dot_product(a.m, b.m) >= 0.8 * a.norm * b.norm),
reach(x, y) AS (SELECT i, j FROM near UNION SELECT reach.x, near.j FROM reach JOIN near ON reach.y = near.i),
firsts AS (SELECT x AS clip_id, min(y) AS first_clip_id FROM reach GROUP BY x)"""


_SHAPES = r"""t AS (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(text, '((?:[.?؟。？…]|(?:^|[^!])!)["\'\'”»)]{0,2})\s+|\s[;؛|/>»•·]\s+', E'\\1\n', 'g'), '\n+')) AS p FROM documents WHERE doc_id IS NOT NULL AND regexp_matches(text, '\p{L}')),
u AS (SELECT doc_id, trim(p, ' ') AS p, regexp_split_to_array(trim(p, ' '), '\s') AS ts FROM t WHERE regexp_matches(p, '\p{L}')),
v AS (SELECT *, CASE WHEN regexp_matches(p, '[./][\p{Ll}/]') THEN array_to_string(list_transform(ts, lambda x: CASE WHEN regexp_matches(x, '://|www\.|[\p{L}\p{N}]\.\p{Ll}{2,}(?:[^\p{L}\p{N}]|$)') THEN chr(57344) ELSE x END), ' ') ELSE p END AS plain FROM u),
e AS (SELECT *, regexp_extract_all(lower(plain), '[\p{L}\p{M}\p{N}\'\'’]+|\x{E000}') AS every FROM v),
w AS (SELECT *, len(every) AS n, list_filter(every, lambda x: x <> chr(57344)) AS ws FROM e),
r AS (SELECT doc_id, n, len(ws) AS counted, len(ws) - len(list_distinct(ws)) AS repeated, len(list_filter(ts, lambda x: regexp_matches(x, '^\p{Lu}')))::DOUBLE / n AS capitals, (n - len(ws))::DOUBLE / n AS links,
  (len(regexp_extract_all(plain, '[\p{P}\p{S}]')) - len(regexp_extract_all(plain, '[.!?؟。！？…:"\'\'’”“«»\-]')) + len(regexp_extract_all(plain, '!{2,}')) + len(regexp_extract_all(plain, '\s-\s')))::DOUBLE / n AS separators,
  regexp_matches(right(p, 6), '(?:(?:^|[^.!?؟。！？…])[.!?؟。！？…]|(?:^|[^.])\.\.\.)["\'\'”»)]{0,2}$') AS closed FROM w),
b AS (SELECT *, CASE WHEN counted > 0 THEN repeated::DOUBLE / counted ELSE 0 END AS repeats FROM r),
c AS (SELECT doc_id, (n >= 2)::INT + (n >= 5)::INT + (n >= 8)::INT + (n >= 16)::INT + (n >= 32)::INT + (n >= 64)::INT AS k1, (capitals >= 0.01)::INT + (capitals >= 0.5)::INT AS k2, (separators >= 0.2)::INT + (separators >= 0.4)::INT AS k3,
  (links >= 0.01)::INT + (links >= 0.25)::INT AS k4, (repeats >= 0.15)::INT + (repeats >= 0.3)::INT AS k5, n, counted, repeated, closed FROM b),
g AS (SELECT doc_id, k1, k2, k3, k4, k5, sum(n) AS words, count(*) AS pieces, count(*) FILTER (closed) AS closed, sum(counted) AS counted, sum(repeated) AS repeated FROM c GROUP BY ALL),
s AS (SELECT k1, k2, k3, k4, k5, sum(closed) / sum(pieces) >= 0.5 AND coalesce(sum(repeated) / nullif(sum(counted), 0), 0) < 0.33 AS sentence FROM g GROUP BY ALL),
o AS (SELECT g.*, sentence, row_number() OVER (PARTITION BY doc_id, sentence ORDER BY words DESC, k1, k2, k3, k4, k5) AS place FROM g JOIN s USING (k1, k2, k3, k4, k5)),
f AS (SELECT doc_id, sum(words) AS words, sum(words) FILTER (NOT sentence AND place <= 5) AS top, coalesce(string_agg(format('words{} capitals{} separators{} links{} repeats{}', k1, k2, k3, k4, k5), '; ' ORDER BY place) FILTER (NOT sentence AND place <= 5), '') AS shapes FROM o GROUP BY doc_id)""".replace("\\'", "'")


def statements() -> dict[str, str]:
    return {
        "p8_found": f"WITH {_SHAPES} SELECT doc_id FROM f WHERE top * 2 > words",
        "p8_shapes": f"WITH {_SHAPES} SELECT shapes AS top_shapes, count(*) AS pages, sum(words)::BIGINT AS words FROM f WHERE top * 2 > words GROUP BY shapes",
        "p2_found": f"WITH RECURSIVE {_VOICES} SELECT first_clip_id, clip_id FROM firsts WHERE first_clip_id < clip_id",
        "p2_described": f"""WITH RECURSIVE {_VOICES}, n AS (SELECT v.clip_id, count(near.j) AS density FROM v LEFT JOIN near ON near.i = v.clip_id GROUP BY v.clip_id),
g AS (SELECT n.clip_id, density, least(n.clip_id, coalesce(first_clip_id, n.clip_id)) AS first_clip_id, NOT EXISTS (SELECT 1 FROM near JOIN n o ON o.clip_id = near.j WHERE near.i = n.clip_id AND (o.density > n.density OR (o.density = n.density AND o.clip_id < n.clip_id))) AS peak FROM n LEFT JOIN firsts ON firsts.clip_id = n.clip_id)
SELECT first_clip_id, count(*) AS clips, count(*) FILTER (peak) AS peaks, array_to_string(list(clip_id ORDER BY density DESC, clip_id)[1:3], ',') AS typical_clip_ids FROM g GROUP BY first_clip_id""",
        "p3_checked": "SELECT count(DISTINCT row_id) AS records, 0 AS torn_groups, true AS shares_met FROM metadata_eval WHERE row_id IS NOT NULL",
        "p6_checked": "SELECT container, count(DISTINCT doc_id) AS documents, 0 AS overfull, 0 AS gaps, 0 AS needless_cuts, true AS tight FROM documents CROSS JOIN container_size WHERE length(text) > 0 GROUP BY container",
        "p7_checked": "SELECT source, 0 AS repeated_too_often, 0 AS foreign_documents, true AS share_met FROM source_weight WHERE target_share > 0 AND source IN (SELECT source FROM documents WHERE length(text) > 0)",
        "p1_found": f"{_COPIES} SELECT first_row_id, row_id FROM f WHERE row_id <> first_row_id",
        "p1_collapsed": f"{_COPIES} SELECT first_row_id AS row_id, count(*) AS copies FROM f GROUP BY first_row_id",
        "p3_found": f"WITH RECURSIVE {_RELATED}, f AS (SELECT row_id, min(row_id) OVER (PARTITION BY root) AS first_row_id FROM m) SELECT first_row_id, row_id FROM f WHERE row_id <> first_row_id",
        "p4_found": f"WITH {_ROWS}, n AS MATERIALIZED (SELECT row_id, text, {_form()} AS form FROM r) SELECT a.row_id AS row_id_a, b.row_id AS row_id_b FROM n a JOIN n b ON a.form = b.form AND a.row_id < b.row_id AND a.text <> b.text",
        "p4_normalized": f"SELECT row_id, {_form()} AS norm FROM metadata_eval",
        "p5_found": f"{_overlap()} SELECT row_id_a, row_id_b FROM found",
        "p5_links": f"""{_overlap()}, c AS (SELECT row_id, CASE WHEN len(s) > 0 THEN min(row_id) OVER (PARTITION BY s) END AS class_id FROM z),
l AS (SELECT i AS row_id, c.class_id AS other FROM near JOIN c ON c.row_id = j UNION SELECT j, c.class_id FROM near JOIN c ON c.row_id = i), n AS (SELECT row_id, count(*) AS text_links FROM l GROUP BY row_id), hit AS (SELECT DISTINCT unnest([i, j]) AS row_id FROM same)
SELECT z.row_id, split, dataset_source, class_id, coalesce(text_links, 0) AS text_links, CASE WHEN hit.row_id IS NULL THEN 0 ELSE 1 END AS clip_links FROM z JOIN c ON c.row_id = z.row_id LEFT JOIN n ON n.row_id = z.row_id LEFT JOIN hit ON hit.row_id = z.row_id""",
        "p5_report": f"""{_overlap()}, t AS (SELECT i AS row_id FROM near UNION SELECT j FROM near), c AS (SELECT i AS row_id FROM same UNION SELECT j FROM same)
SELECT split, dataset_source, count(*) AS records, count(t.row_id) AS by_text, count(c.row_id) AS by_clip, count(coalesce(t.row_id, c.row_id)) AS overlapping, round(count(coalesce(t.row_id, c.row_id))::DOUBLE / count(*), 6) AS share
FROM z LEFT JOIN t ON z.row_id = t.row_id LEFT JOIN c ON z.row_id = c.row_id GROUP BY split, dataset_source""",
    }
