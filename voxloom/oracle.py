"""DuckDB statements with the results of the core queries."""

from __future__ import annotations

from voxloom.functions.text import ARABIC_BLOCKS, CORRECTION_PAIRS, SENTENCE_ENDS, SYMBOLS
from voxloom.operators.quality import CHECKS

_MARKS = "[\u064b-\u065f\u0670]"
_WS = "[\t-\r\x1c-\x20\x85\xa0  -     　]"


def _strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"


def _collapse(x: str) -> str:
    return _strip(f"regexp_replace({x}, '{_WS}+', ' ', 'g')")


def _words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{_WS}+'), lambda w: w <> '')"


def _ratio(x: str) -> str:
    t = f"replace({x}, ' ', '')"
    return f"CASE WHEN length({t}) = 0 THEN 0.0::DOUBLE ELSE length(regexp_replace({t}, '[^{ARABIC_BLOCKS}]', '', 'g'))::DOUBLE / length({t}) END"


def _latin(x: str) -> str:
    return f"length(regexp_replace({x}, '[^A-Za-z]', '', 'g'))"


def _repeats(x: str) -> str:
    w = _words(x)
    return f"len(list_filter(range(1, len({w}) - 1), lambda i: ({w})[i] = ({w})[i + 1] AND ({w})[i] = ({w})[i + 2])) > 0"


def _fold(x: str) -> str:
    for a, b in SYMBOLS:
        x = f"replace({x}, '{a}', '{b}')"
    return x


_CLEAN = _collapse("replace(regexp_replace(nfc_normalize(text), '[​-‏﻿]', '', 'g'), '٪', '%')")
_MAP = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in CORRECTION_PAIRS) + "}"
_CORRECT = rf"array_to_string(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'), lambda t: coalesce(list_extract(map_extract({_MAP}, t), 1), t)), '')"
_COMPARE = _collapse(rf"regexp_replace(translate(regexp_replace(text, '{_MARKS}', '', 'g'), 'إأآة', 'ااا' || 'ه'), '[^\p{{L}}\p{{N}}_{_WS[1:-1]}]', '', 'g')")
_ENDS = SENTENCE_ENDS.replace(".", r"\.").replace("?", r"\?")

_DEFAULTS = """d AS (SELECT clip_id, dataset_source, coalesce(duration, CASE WHEN audio['array'] IS NOT NULL THEN len(audio['array'])::DOUBLE / nullif(audio['sampling_rate'], 0) END) AS duration, coalesce(text, '') AS text FROM prepare_dataset)"""
_RANGE = "duration BETWEEN 2.0 AND 11.0 AND length(text) BETWEEN 10 AND 200"

_WAVES = """w AS (SELECT clip_id, dataset_source, list_transform(audio['array'], lambda x: coalesce(x, 0)::DOUBLE) AS a, audio['sampling_rate'] AS sr FROM prepare_dataset WHERE len(audio['array']) > 0 AND audio['sampling_rate'] > 0),
f AS (SELECT *, floor(sr * 0.025)::INT AS fr, (floor(sr * 0.025)::INT // 2) AS hop FROM w),
r AS (SELECT *, list_transform(range(0, len(a) - fr, hop), lambda s: sqrt(list_sum(list_transform(a[s + 1:s + fr], lambda x: x * x)) / fr)) AS rms,
  list_sort(list_transform(range(0, len(a) - fr, fr), lambda s: sqrt(list_sum(list_transform(a[s + 1:s + fr], lambda x: x * x)) / fr))) AS rms0, sqrt(list_sum(list_transform(a, lambda x: x * x)) / len(a)) AS whole FROM f),
l AS (SELECT *, list_sort(rms) AS s FROM r),
n AS (SELECT *, list_avg(s[1:greatest(1, len(s) // 10)]) AS noise, list_avg(s[len(s) // 2 + 1:]) AS sig, list_avg(rms0[1:greatest(1, len(rms0) // 10)]) AS noise0 FROM l),
m AS (SELECT clip_id, dataset_source, len(a) AS samples, len(s) AS frames, len(a)::DOUBLE / sr AS duration_s, whole AS rms, list_max(list_transform(a, lambda x: abs(x))) AS peak,
  CASE WHEN len(s) = 0 THEN 0 WHEN noise < 1e-10 THEN 100 ELSE 20 * log10(sig / noise) END AS snr_gate,
  CASE WHEN len(s) > 0 AND sig > 0 THEN 20 * log10(sig / greatest(noise, 1e-10)) END AS snr_eval,
  CASE WHEN len(rms0) > 0 AND whole > 0 THEN 20 * log10(whole / greatest(noise0, 1e-10)) END AS snr_base,
  len(list_filter(a, lambda x: abs(x) < 0.01))::DOUBLE / len(a) AS silence_ratio, len(list_filter(a, lambda x: abs(x) >= 0.99))::DOUBLE / len(a) AS clipping_ratio,
  len(list_filter(rms, lambda x: x > 0.01)) * hop::DOUBLE / sr AS speaking_s FROM n)"""

_GATE = f"""t AS (SELECT clip_id, coalesce(text, '') AS text, duration FROM prepare_dataset),
c AS (SELECT *, {_ratio("text")} AS ratio, {_latin("text")} AS latin, {_repeats("text")} AS rep, length(text) / greatest(duration, 0.1) AS rate FROM t),
{_WAVES},
g AS (SELECT c.*, m.samples, snr_gate, silence_ratio, clipping_ratio,
  CASE WHEN ratio < 0.6 THEN 'low_arabic' WHEN latin > 3 THEN 'latin_chars' WHEN rep THEN 'repeated_words' WHEN duration IS NOT NULL AND (rate < 3 OR rate > 25) THEN 'bad_char_rate'
  WHEN samples IS NULL THEN 'file_missing' WHEN snr_gate < 10 THEN 'low_snr' WHEN silence_ratio > 0.5 THEN 'excess_silence' WHEN clipping_ratio > 0.01 THEN 'clipping' END AS code FROM c LEFT JOIN m USING (clip_id)),
gate AS (SELECT clip_id, CASE WHEN code IN ('low_arabic', 'latin_chars', 'repeated_words', 'bad_char_rate') THEN 1 WHEN code IS NOT NULL THEN 2 END AS layer, code,
  CASE code WHEN 'low_arabic' THEN printf('Layer 1: Low Arabic ratio (%.2f)', ratio) WHEN 'latin_chars' THEN printf('Layer 1: Latin characters (%d)', latin)
  WHEN 'repeated_words' THEN 'Layer 1: Repeated words' WHEN 'bad_char_rate' THEN printf('Layer 1: Abnormal char rate (%.1f c/s)', rate) WHEN 'file_missing' THEN 'Layer 2: File missing'
  WHEN 'low_snr' THEN printf('Layer 2: Low SNR (%.1f dB)', snr_gate) WHEN 'excess_silence' THEN printf('Layer 2: Excessive silence (%.0f%%)', silence_ratio * 100)
  WHEN 'clipping' THEN printf('Layer 2: Clipping (%.1f%%)', clipping_ratio * 100) END AS reason FROM g)"""

_SCORED = """x AS (SELECT vec_id, label, list_transform(embedding, lambda v: v::DOUBLE) AS e FROM embeddings),
u AS (SELECT *, sqrt(list_sum(list_transform(e, lambda v: v * v))) AS norm FROM x),
p AS (SELECT label, i, sum(e[i] / norm) AS v FROM u, range(1, 65) t(i) GROUP BY label, i),
q AS (SELECT label, list(v ORDER BY i) AS c FROM p GROUP BY label),
cen AS (SELECT label, list_transform(c, lambda v: v / sqrt(list_sum(list_transform(c, lambda y: y * y)))) AS c FROM q),
sc AS (SELECT vec_id, label, list_dot_product(e, c) / norm AS similarity FROM u JOIN cen USING (label)),
st AS (SELECT label, count(*) AS size, round(avg(similarity), 4) AS mean_similarity, round(stddev_pop(similarity), 4) AS std_similarity, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percentage FROM sc GROUP BY label)"""


def _histogram(rows: str, value: str, bins: int) -> str:
    return f"""h AS (SELECT {value}::DOUBLE AS v FROM {rows} WHERE {value} IS NOT NULL AND NOT isnan({value})), e AS (SELECT min(v) AS a, max(v) AS b FROM h),
k AS (SELECT CASE WHEN b > a THEN least(floor((v - a) / (b - a) * {bins}), {bins - 1}) ELSE 0 END::BIGINT AS bin, count(*) AS n FROM h, e GROUP BY 1)
SELECT r.bin, round(a + r.bin * (b - a) / {bins}, 6) AS lo, round(a + (r.bin + 1) * (b - a) / {bins}, 6) AS hi, coalesce(n, 0) AS n FROM range({bins}) r(bin) CROSS JOIN e LEFT JOIN k ON k.bin = r.bin"""


def _text(expr: str) -> str:
    return f"SELECT row_id, {expr} AS out FROM metadata_eval"


_SPLIT = """s AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents),
k AS (SELECT doc_id, pos, CASE WHEN pos < floor(n * 0.9) THEN 'train' ELSE 'eval' END AS part FROM s)"""
_METRIC_NAMES = ("duration_s", "rms", "peak", "snr_gate", "snr_eval", "snr_base", "silence_ratio", "clipping_ratio", "speaking_s")
_ALIGN = """al AS (SELECT *, CASE WHEN whisper_text IS NULL OR similarity IS NULL OR similarity < 0.4 THEN 'low_similarity' END AS code,
  CASE WHEN whisper_text IS NULL OR similarity IS NULL THEN 'Layer 3: Whisper error (no transcript)' WHEN similarity < 0.4 THEN printf('Layer 3: Low alignment (%.2f) | Original: %s | Whisper: %s', similarity, substring(coalesce(original_text, ''), 1, 50), substring(whisper_text, 1, 50)) END AS reason FROM sanity_review)"""
_TOKENS_AT = "unnest(audio['array'])::DOUBLE AS x, generate_subscripts(audio['array'], 1) AS i"


_JUDGED = f"""{_ALIGN}, m AS (SELECT audio_file, split, coalesce(text, '') AS text FROM metadata_eval WHERE split IN ('train', 'eval')),
one AS (SELECT audio_file, CASE WHEN {_ratio('text')} < 0.6 THEN struct_pack(layer := 1, code := 'low_arabic', reason := printf('Layer 1: Low Arabic ratio (%.2f)', {_ratio('text')}))
  WHEN {_latin('text')} > 3 THEN struct_pack(layer := 1, code := 'latin_chars', reason := printf('Layer 1: Latin characters (%d)', {_latin('text')})) WHEN {_repeats('text')} THEN struct_pack(layer := 1, code := 'repeated_words', reason := 'Layer 1: Repeated words') END AS x FROM m WHERE audio_file IS NOT NULL),
three AS (SELECT audio_file, struct_pack(layer := 3, code := code, reason := reason) AS x FROM al WHERE code IS NOT NULL AND audio_file IN (SELECT audio_file FROM one)),
rej AS (SELECT audio_file, min(x) AS x FROM (SELECT * FROM one WHERE x IS NOT NULL UNION ALL FROM three) GROUP BY audio_file)"""
_CLEANED = {c: f"regexp_replace(coalesce({c}, ''), '[|\"\\r\\n\\x00]', ' ', 'g')" for c in ("audio_file", "text", "speaker_name", "original_text", "whisper_text", "similarity", "status")}
_SAMPLES = "SELECT clip_id, audio['sampling_rate'] AS sr, len(audio['array']) AS n, unnest(audio['array'])::DOUBLE AS x, generate_subscripts(audio['array'], 1) - 1 AS i FROM prepare_dataset WHERE len(audio['array']) > 0 AND audio['sampling_rate'] > 0"


# The words of numbers, written out once more for the statements.
_ONES = "'', 'واحد', 'اثنان', 'ثلاثة', 'أربعة', 'خمسة', 'ستة', 'سبعة', 'ثمانية', 'تسعة', 'عشرة', 'أحد عشر', 'اثنا عشر', 'ثلاثة عشر', 'أربعة عشر', 'خمسة عشر', 'ستة عشر', 'سبعة عشر', 'ثمانية عشر', 'تسعة عشر'"
_TENS = "'', '', 'عشرون', 'ثلاثون', 'أربعون', 'خمسون', 'ستون', 'سبعون', 'ثمانون', 'تسعون'"
_HUNDREDS = "'', 'مائة', 'مئتان', 'ثلاثمائة', 'أربعمائة', 'خمسمائة', 'ستمائة', 'سبعمائة', 'ثمانمائة', 'تسعمائة'"
_SCALES = "(1, 'ألف', 'ألفان', 'آلاف'), (2, 'مليون', 'مليونان', 'ملايين'), (3, 'مليار', 'ملياران', 'مليارات'), (4, 'تريليون', 'تريليونان', 'تريليونات'), (5, 'كوادريليون', 'كوادريليونان', 'كوادريليونات')"
_DIGITS = "'٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹０１２３４５６７８９', '012345678901234567890123456789'"


def _numbers(source: str, key: str, out: str) -> str:
    """CTEs ending in ``out`` (``key``, ``text``): the numbers of ``source`` in words, number by number and group of three by group."""
    return rf"""small AS (SELECT n, array_to_string(list_filter([[{_HUNDREDS}][n // 100 + 1], CASE WHEN n % 100 < 20 THEN [{_ONES}][n % 100 + 1] ELSE [{_ONES}][n % 10 + 1] END, CASE WHEN n % 100 < 20 THEN '' ELSE [{_TENS}][n % 100 // 10 + 1] END], lambda x: x <> ''), ' و ') AS w FROM range(1000) t(n)),
scale(k, one, two, many) AS (VALUES {_SCALES}),
tok AS (SELECT {key}, unnest(ts) AS tok, unnest(range(len(ts))) AS pos FROM (SELECT {key}, regexp_extract_all(text, '\p{{Nd}}+(?:\.\p{{Nd}}+)?(?:{_WS}*[%٪])?|[^\p{{Nd}}]+') AS ts FROM {source})),
num AS (SELECT *, ltrim(translate(regexp_extract(tok, '^\p{{Nd}}+'), {_DIGITS}), '0') AS d, translate(regexp_extract(tok, '^\p{{Nd}}+\.(\p{{Nd}}+)', 1), {_DIGITS}) AS dec FROM tok WHERE regexp_matches(tok, '^\p{{Nd}}')),
grp AS (SELECT {key}, pos, k, substring(lpad(d, 18, '0'), 16 - 3 * k, 3)::INT AS g FROM num, range(6) t(k) WHERE length(d) BETWEEN 1 AND 18),
wrd AS (SELECT {key}, pos, string_agg(CASE WHEN grp.k = 0 THEN w WHEN g = 1 THEN one WHEN g = 2 THEN two ELSE w || ' ' || CASE WHEN g % 100 BETWEEN 3 AND 10 THEN many ELSE one END END, ' و ' ORDER BY grp.k DESC) AS w FROM grp JOIN small ON n = g LEFT JOIN scale ON scale.k = grp.k WHERE g > 0 GROUP BY ALL),
said AS (SELECT num.{key}, num.pos, CASE WHEN d = '' THEN 'صفر' WHEN length(d) > 18 THEN d ELSE w END || CASE WHEN dec = '' THEN '' ELSE ' فاصلة ' || array_to_string(list_transform(string_split(dec, ''), lambda c: ['صفر', 'واحد', 'اثنان', 'ثلاثة', 'أربعة', 'خمسة', 'ستة', 'سبعة', 'ثمانية', 'تسعة'][c::INT + 1]), ' ') END || CASE WHEN regexp_matches(tok, '[%٪]$') THEN ' بالمئة' ELSE '' END AS w FROM num LEFT JOIN wrd ON wrd.{key} = num.{key} AND wrd.pos = num.pos),
put AS (SELECT tok.{key}, string_agg(coalesce(said.w, tok.tok), '' ORDER BY tok.pos) AS text FROM tok LEFT JOIN said ON said.{key} = tok.{key} AND said.pos = tok.pos GROUP BY tok.{key}),
{out} AS (SELECT o.{key}, CASE WHEN o.text IS NULL THEN NULL ELSE coalesce(put.text, '') END AS text FROM {source} o LEFT JOIN put ON put.{key} = o.{key})"""


def _normalized(table: str, key: str) -> str:
    """CTEs ending in ``normal``: cleaned, words corrected, numbers and symbols in words, cleaned again."""
    return f"c1 AS (SELECT {key}, {_CLEAN} AS text FROM {table}), c2 AS (SELECT {key}, {_CORRECT} AS text FROM c1), {_numbers('c2', key, 'c3')}, c4 AS (SELECT {key}, {_fold('text')} AS text FROM c3), normal AS (SELECT {key}, {_CLEAN} AS text FROM c4)"


def _packed(items: str, joint: str) -> str:
    """A list of strings joined one after the other as long as they fit 160 characters."""
    fits = f"length(acc[-1]) + length(x[1]) + {len(joint)} <= 160"
    return f"CASE WHEN len({items}) = 0 THEN [] ELSE list_reduce(list_transform({items}, lambda i: [i]), lambda acc, x: CASE WHEN {fits} THEN acc[:-2] || [acc[-1] || '{joint}' || x[1]] ELSE acc || x END) END"


def _chunks(source: str, lite: bool) -> str:
    """CTEs ending in ``ch`` (``doc_id``, ``cs``): sentences, long ones in packed clauses and words, short ones merged."""
    bare = _strip(f"regexp_replace(p, '[{_ENDS}]+$', '')")
    clauses = f"list_filter(list_transform(regexp_split_to_array(s, '[،؛,;]+'), lambda c: {_strip('c')}), lambda c: c <> '')"
    several = "regexp_matches(s, '[،؛,;]')"
    by_word = _packed(_words("y"), " ")
    cut = f"CASE WHEN {several} THEN {_packed(clauses, '، ')} ELSE [s] END"
    if not lite:
        cut = f"flatten(list_transform({cut}, lambda y: CASE WHEN length(y) <= 160 THEN [y] ELSE {by_word} END))"
    short = "length(acc[-1]) < 30 OR length(x[1]) < 30"
    return f"""ps AS (SELECT doc_id, regexp_extract_all(text, '[^{_ENDS}]+[{_ENDS}]*') AS ps FROM {source} WHERE text IS NOT NULL),
ss AS (SELECT doc_id, list_filter(list_transform(ps, lambda p: CASE WHEN {bare} <> '' THEN {bare} || regexp_extract(p, '[{_ENDS}]*$') END), lambda s: s IS NOT NULL) AS ss FROM ps),
cut AS (SELECT doc_id, flatten(list_transform(ss, lambda s: CASE WHEN length(s) <= 160 THEN [s] ELSE {cut} END)) AS cs FROM ss),
ch AS (SELECT doc_id, CASE WHEN len(cs) <= 1 THEN cs ELSE list_reduce(list_transform(cs, lambda c: [c]), lambda acc, x: CASE WHEN {short} THEN acc[:-2] || [acc[-1] || ' ' || x[1]] ELSE acc || x END) END AS cs FROM cut)"""


_CHUNKED = "SELECT doc_id, unnest(range(len(cs))) AS pos, unnest(cs) AS chunk FROM ch"


def _texts() -> dict[str, str]:
    """Numbers in words, the whole normalization, and the chunks."""
    every = f"WITH {_normalized('documents', 'doc_id')}, {_chunks('normal', False)}, k AS ({_CHUNKED})"
    return {
        "number_words": f"WITH {_numbers('metadata_eval', 'row_id', 'spoken')} SELECT row_id, text AS out FROM spoken",
        "normalized_text": f"WITH {_normalized('metadata_eval', 'row_id')} SELECT row_id, text AS out FROM normal",
        "chunks": f"WITH {_chunks('documents', False)} {_CHUNKED}",
        "chunks_lite": f"WITH {_chunks('documents', True)} {_CHUNKED}",
        "text_to_chunks": f"{every} SELECT doc_id, pos, chunk, length(chunk) AS chars, pos + 12345 AS chunk_seed FROM k",
    }


def _files() -> dict[str, str]:
    """The tables that files were written from."""
    review = f"WITH {_ALIGN}, v AS (SELECT audio_file, substring(original_text, 1, 50) AS original_text, substring(whisper_text, 1, 50) AS whisper_text, printf('%.2f', similarity) AS similarity, 'REJECTED' AS status FROM al WHERE code IS NOT NULL AND whisper_text IS NOT NULL AND al.similarity IS NOT NULL)"
    return {
        "metadata_files": f"SELECT row_id, {', '.join(f'{_CLEANED[c]} AS {c}' for c in ('audio_file', 'text', 'speaker_name'))} FROM metadata_eval",
        "text_files": "SELECT source, max_repeat::VARCHAR AS text FROM source_weight WHERE source IS NOT NULL",
        "listed_files": "SELECT source, length(max_repeat::VARCHAR) + 5 AS length, true AS any FROM source_weight WHERE source IS NOT NULL",
        "trainer_log": "SELECT run_id AS step, rtf AS loss FROM generation_stats WHERE rtf IS NOT NULL AND run_id > 0",
        "loss_average": "WITH c AS (SELECT run_id AS step, rtf, count(*) OVER () AS n, row_number() OVER (ORDER BY run_id) AS r FROM generation_stats WHERE rtf IS NOT NULL AND run_id > 0), w AS (SELECT *, least(50, n // 5) AS width FROM c WHERE n > 20) SELECT a.step, round(avg(b.rtf), 6) AS loss_average FROM w a JOIN w b ON b.r BETWEEN a.r - a.width + 1 AND a.r WHERE a.r >= a.width GROUP BY a.step",
        "wave_files": f"WITH a AS ({_SAMPLES}) SELECT clip_id, max(n) AS samples, max(sr) AS rate, round(sum(abs(round_even(greatest(least(coalesce(x, 0), 1), -1) * 32767, 0) / 32768)), 4) AS level FROM a GROUP BY clip_id",
        "wave_file_durations": "SELECT clip_id, round(len(audio['array'])::DOUBLE / audio['sampling_rate'], 6) AS duration FROM prepare_dataset WHERE len(audio['array']) > 0 AND audio['sampling_rate'] > 0",
        "report_file": f"WITH {_GATE} SELECT count(*) AS total, count(code) AS rejected, count(*) - count(code) AS kept, round(count(code)::DOUBLE / count(*), 6) AS rejected_share FROM gate",
        "quarantined": f"WITH {_ALIGN} SELECT row_id, CASE WHEN EXISTS (SELECT 1 FROM al WHERE al.code IS NOT NULL AND al.audio_file = v.audio_file) THEN 'rejected' ELSE 'kept' END AS place FROM metadata_eval v",
        "review_file": f"{review} SELECT {', '.join(f'{_CLEANED[c]} AS {c}' for c in ('audio_file', 'original_text', 'whisper_text', 'similarity', 'status'))} FROM v",
        "spectra": f"""WITH a AS ({_SAMPLES.replace(" AND audio['sampling_rate'] > 0", "")}), f AS (SELECT clip_id, max(n) AS n FROM a GROUP BY clip_id), g AS (SELECT clip_id, unnest(range(0, greatest(n, 256) - 255, 128)) AS s FROM f),
w AS (SELECT j, 0.5 - 0.5 * cos(2 * pi() * j / 255) AS h FROM range(256) t(j)), c AS (SELECT k, cos(2 * pi() * k / 256) AS re, sin(2 * pi() * k / 256) AS im FROM range(256) t(k)),
e AS (SELECT g.clip_id, g.s, j, coalesce(x, 0) * h AS x FROM g JOIN a ON a.clip_id = g.clip_id AND a.i BETWEEN g.s AND g.s + 255 JOIN w ON w.j = a.i - g.s),
p AS (SELECT clip_id, s, b.bin, sum(x * re) AS re, sum(x * im) AS im FROM e CROSS JOIN (SELECT unnest(range(129)) AS bin) b JOIN c ON c.k = (b.bin * j) % 256 GROUP BY ALL)
SELECT clip_id, bin, round(avg(re * re + im * im), 5) AS power FROM p GROUP BY clip_id, bin""",
        "resampled": "SELECT clip_id, CASE WHEN audio['sampling_rate'] = 16000 OR len(audio['array']) = 0 THEN len(audio['array']) ELSE round(len(audio['array']) * 16000.0 / audio['sampling_rate'])::BIGINT END AS samples FROM prepare_dataset WHERE audio['array'] IS NOT NULL AND audio['sampling_rate'] IS NOT NULL",
        "embedded": f"WITH a AS ({_SAMPLES}) SELECT clip_id, round(avg(coalesce(x, 0)), 5) AS mean, round(stddev_pop(coalesce(x, 0)), 5) AS deviation, round(max(abs(coalesce(x, 0))), 5) AS peak, max(sr)::DOUBLE AS rate FROM a GROUP BY clip_id",
        "tapered": f"WITH a AS ({_SAMPLES}), b AS (SELECT *, least(floor(sr * 10 / 1000)::INT, n // 4) AS m FROM a) SELECT clip_id, max(n) AS kept, round(sum(abs(coalesce(x, 0)) * CASE WHEN i < n - m OR m = 1 THEN 1 ELSE power(1 - (i - n + m)::DOUBLE / (m - 1), 2) END), 4) AS level FROM b GROUP BY clip_id",
        "post_processed": f"""WITH a AS ({_SAMPLES}), b AS (SELECT *, abs(coalesce(x, 0)) < 0.01 AS quiet, i - row_number() OVER (PARTITION BY clip_id, abs(coalesce(x, 0)) < 0.01 ORDER BY i) AS island FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY clip_id, quiet, island ORDER BY i) AS r FROM b), e AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY i) AS j FROM c WHERE NOT quiet OR r <= floor(sr * 350 / 1000)),
g AS (SELECT *, coalesce(max(CASE WHEN NOT quiet THEN j END) OVER (PARTITION BY clip_id), 0) + floor(sr * 150 / 1000) AS upto FROM e)
SELECT clip_id, count(*) FILTER (j <= upto) AS kept, round(coalesce(sum(abs(coalesce(x, 0))) FILTER (j <= upto), 0), 4) AS level FROM g GROUP BY clip_id""",
        "overrun_trimmed": f"""WITH a AS ({_SAMPLES}), k AS (SELECT DISTINCT clip_id, sr, n, floor(0.01 * 1.2 * sr)::INT AS goal, floor(sr * 0.025)::INT AS fr, floor(sr * 0.05)::INT AS fade FROM a),
b AS (SELECT *, greatest(0, goal - sr // 2) AS lo, least(n, goal + sr // 2) AS hi FROM k), st AS (SELECT clip_id, fr, unnest(range(lo, hi - fr, greatest(1, fr // 2))) AS s FROM b),
lv AS (SELECT st.clip_id, st.s, avg(abs(coalesce(x, 0))) AS v FROM st JOIN a ON a.clip_id = st.clip_id AND a.i >= st.s AND a.i < st.s + fr GROUP BY ALL), best AS (SELECT clip_id, arg_min(s, struct_pack(v := v, s := s)) AS s FROM lv GROUP BY clip_id),
c AS (SELECT b.clip_id, n, n::DOUBLE / sr > 1.5 * 0.01 AS long, least(n, coalesce(best.s, goal) + fade) AS kept, fade FROM b LEFT JOIN best USING (clip_id)),
e AS (SELECT clip_id, CASE WHEN long THEN kept ELSE n END AS kept, CASE WHEN long THEN least(fade, kept) ELSE 0 END AS m FROM c)
SELECT clip_id, max(kept) AS kept, round(coalesce(sum(abs(coalesce(x, 0)) * CASE WHEN i < kept - m OR m <= 1 THEN 1 ELSE 1 - (i - kept + m)::DOUBLE / (m - 1) END) FILTER (i < kept), 0), 4) AS level FROM a JOIN e USING (clip_id) GROUP BY clip_id""",
        "corpus_report": f"""WITH {_DEFAULTS}, usable AS (SELECT * FROM d WHERE {_RANGE}), embedded AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id IN (SELECT clip_id FROM usable)),
{_SCORED.replace("FROM embeddings)", "FROM embedded)")}, best AS (SELECT label FROM st ORDER BY size >= 500 DESC, CASE WHEN size >= 500 THEN -mean_similarity END, size DESC, label LIMIT 1),
y AS (SELECT duration, similarity FROM sc JOIN usable ON clip_id = vec_id WHERE label = (SELECT label FROM best))
SELECT (SELECT count(*) FROM usable) AS valid_after_filtering, count(*) AS clips, round(sum(duration) / 3600, 2) AS total_hours, round(avg(duration), 2) AS mean_duration_s, round(min(similarity), 4) AS similarity_min, round(max(similarity), 4) AS similarity_max, round(avg(similarity), 4) AS similarity_mean FROM y""",
        "distinct_counts": "SELECT dataset_source, count(*) AS n, count(DISTINCT audio_file) AS clips, count(DISTINCT text) AS texts, count(DISTINCT speaker_name) AS speakers FROM metadata_eval GROUP BY dataset_source",
        "stage_report": f"WITH {_WAVES} SELECT dataset_source, {', '.join(f'round(avg(m.{x}), 4) AS {x}' for x in ('duration_s', 'rms', 'peak', 'silence_ratio', 'speaking_s'))} FROM m WHERE dataset_source IS NOT NULL GROUP BY dataset_source",
        "rejection_listing": f"WITH {_JUDGED} SELECT audio_file, x.layer AS layer, x.code AS code, x.reason AS reason FROM rej",
        "layer_counts": f"WITH {_JUDGED} SELECT k.layer, k.code, count(rej.audio_file) AS n FROM (VALUES {', '.join(f'({layer}, {chr(39)}{code}{chr(39)})' for layer, code in CHECKS)}) k(layer, code) LEFT JOIN rej ON x.layer = k.layer AND x.code = k.code GROUP BY ALL",
        "clip_totals": f"WITH {_JUDGED}, u AS (SELECT DISTINCT m.audio_file, x FROM m LEFT JOIN rej USING (audio_file) WHERE m.audio_file IS NOT NULL) SELECT count(*) AS total, count(x) AS rejected, count(*) - count(x) AS kept, round(count(x)::DOUBLE / count(*), 6) AS rejected_share FROM u",
        "kept_metadata": f"WITH {_JUDGED} SELECT split AS origin, count(*) AS n FROM m WHERE audio_file IS NULL OR audio_file NOT IN (SELECT audio_file FROM rej) GROUP BY split",
        "speaker_runs": "WITH k AS (SELECT user_id AS seed, min(value) AS weight FROM events WHERE user_id IS NOT NULL GROUP BY 1), r AS (SELECT run_id, params['seed']::BIGINT AS seed FROM generation_stats) SELECT run_id, r.seed, weight, CASE WHEN k.seed IS NULL THEN 'unknown seed: ' || coalesce(r.seed::VARCHAR, 'null') END AS error FROM r LEFT JOIN k ON k.seed = r.seed",
        "pace_labels": "SELECT run_id, CASE WHEN rtf IS NULL THEN NULL WHEN rtf <= 0.25 THEN 'fast' WHEN rtf <= 1.0 THEN 'real time' ELSE 'slow' END AS label FROM generation_stats",
    }


def oracle_sql() -> dict[str, str]:
    checks = ", ".join(f"({layer}, '{code}')" for layer, code in CHECKS)
    code1 = "CASE WHEN ratio < 0.6 THEN 'low_arabic' WHEN latin > 3 THEN 'latin_chars' WHEN rep THEN 'repeated_words' WHEN duration IS NOT NULL AND (length(text) / greatest(duration, 0.1) NOT BETWEEN 3 AND 25) THEN 'bad_char_rate' END"
    return _files() | _texts() | {
        "corpus_flagship": f"WITH {_DEFAULTS}, c AS (SELECT dataset_source, coalesce({code1}, 'kept') AS code FROM (SELECT *, {_ratio('text')} AS ratio, {_latin('text')} AS latin, {_repeats('text')} AS rep FROM d WHERE {_RANGE})) SELECT dataset_source, code, count(*) AS n FROM c GROUP BY ALL",
        "range_filter": f"WITH {_DEFAULTS} SELECT clip_id, round(duration, 6) AS duration, length(text) AS n_chars FROM d WHERE {_RANGE}",
        "trainer_bounds": f"WITH {_DEFAULTS} SELECT clip_id FROM d WHERE duration >= 0.5 AND duration * 22050 <= 255995 AND length(text) <= 200",
        "script_profile": f"WITH t AS (SELECT row_id, coalesce(text, '') AS text FROM metadata_eval) SELECT row_id, round({_ratio('text')}, 6) AS arabic_ratio, {_latin('text')} AS latin_count, length(text) AS n_chars FROM t",
        "repeated_words": f"SELECT row_id FROM metadata_eval WHERE text IS NOT NULL AND {_repeats('text')}",
        "repeated_words_documents": f"SELECT doc_id FROM documents WHERE text IS NOT NULL AND {_repeats('text')}",
        "char_rate": "SELECT clip_id, round(length(text) / greatest(duration, 0.1), 4) AS rate, length(text) / greatest(duration, 0.1) NOT BETWEEN 3 AND 25 AS rejected FROM prepare_dataset WHERE text IS NOT NULL AND duration IS NOT NULL",
        "text_gate": f"WITH t AS (SELECT row_id, coalesce(text, '') AS text FROM metadata_eval) SELECT row_id, CASE WHEN {_ratio('text')} < 0.6 THEN 'low_arabic' WHEN {_latin('text')} > 3 THEN 'latin_chars' WHEN {_repeats('text')} THEN 'repeated_words' END AS code FROM t",
        "gate": f"WITH {_GATE} SELECT clip_id, layer, code, reason FROM gate",
        "issue_counts": f"WITH {_GATE} SELECT k.layer, k.code, count(gate.code) AS n FROM (VALUES {checks}) k(layer, code) LEFT JOIN gate ON gate.layer = k.layer AND gate.code = k.code GROUP BY k.layer, k.code",
        "gate_totals": f"WITH {_GATE} SELECT count(*) AS total, count(code) AS rejected, count(*) - count(code) AS kept, round(count(code)::DOUBLE / count(*), 6) AS rejected_share FROM gate",
        "alignment": f"WITH {_ALIGN} SELECT audio_file, similarity, reviewed_at, CASE WHEN code IS NOT NULL THEN 3 END AS layer, code FROM al",
        "review_rows": f"WITH {_ALIGN} SELECT audio_file, substring(original_text, 1, 50) AS original_text, substring(whisper_text, 1, 50) AS whisper_text, printf('%.2f', similarity) AS similarity, 'REJECTED' AS status FROM al WHERE code IS NOT NULL AND whisper_text IS NOT NULL AND similarity IS NOT NULL",
        "anti_rejected": f"WITH {_ALIGN} SELECT row_id FROM metadata_eval v WHERE NOT EXISTS (SELECT 1 FROM al WHERE al.code IS NOT NULL AND al.audio_file = v.audio_file)",
        "semi_exists": "SELECT row_id FROM metadata_eval WHERE audio_file IN (SELECT audio_file FROM sanity_review WHERE audio_file IS NOT NULL)",
        "anti_missing": "SELECT row_id FROM metadata_eval WHERE audio_file IS NOT NULL AND audio_file NOT IN (SELECT audio_file FROM sanity_review WHERE audio_file IS NOT NULL)",
        "split_union": "SELECT split AS origin, dataset_source, count(*) AS n FROM metadata_eval WHERE split IN ('train', 'eval') GROUP BY ALL",
        "flagged_sample": f"WITH {_ALIGN} SELECT CASE WHEN code IS NULL THEN 0 ELSE 1 END AS selected, count(*) AS n FROM al GROUP BY 1",
        "nfc": _text("nfc_normalize(text)"),
        "clean_text": _text(_CLEAN),
        "corrected_words": _text(_CORRECT),
        "expanded_symbols": _text(_fold("text")),
        "comparable_text": _text(_COMPARE),
        "stripped_text": _text(_strip("text")),
        "word_counts": _text(f"len({_words('text')})"),
        "sentences": f"""WITH a AS (SELECT doc_id, regexp_extract_all(text, '[^{_ENDS}]+[{_ENDS}]*') AS ps FROM documents WHERE text IS NOT NULL),
b AS (SELECT doc_id, list_filter(list_transform(ps, lambda p: CASE WHEN {_strip(f"regexp_replace(p, '[{_ENDS}]+$', '')")} <> '' THEN {_strip(f"regexp_replace(p, '[{_ENDS}]+$', '')")} || regexp_extract(p, '[{_ENDS}]*$') END), lambda s: s IS NOT NULL) AS ss FROM a)
SELECT doc_id, unnest(range(len(ss))) AS pos, unnest(ss) AS sentence FROM b""",
        "length_capped": f"SELECT doc_id, CASE WHEN {_strip(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} = '' THEN 'blank' WHEN length(text) > 500 THEN 'too_long' ELSE 'ok' END AS code FROM documents",
        "derived_paths": r"SELECT row_id, regexp_replace(audio_file, '^(.*?)(\.[^./\\]+)?$', '\1_48kHz\2') AS upsampled, regexp_replace(audio_file, '\.wav', '_stats.json', 'g') AS stats, CASE WHEN starts_with(audio_file, 'wavs/') THEN audio_file[6:] ELSE audio_file END AS short FROM metadata_eval WHERE audio_file IS NOT NULL",
        "label_tails": "SELECT row_id, list_extract(string_split(text, ': '), -1) AS tail FROM metadata_eval WHERE text IS NOT NULL",
        "emotion_counts": "SELECT coalesce(emotion_name, 'neutral') AS emotion_name, count(*) AS n FROM metadata_eval GROUP BY 1",
        "key_overlay": "WITH n AS (SELECT audio_file, original_text AS text, max(similarity) AS s FROM sanity_review GROUP BY ALL) SELECT row_id, n.s AS similarity, n.audio_file IS NOT NULL AS matched FROM metadata_eval v LEFT JOIN n ON v.audio_file = n.audio_file AND v.text = n.text",
        "centroid_values": f"WITH {_SCORED} SELECT label, unnest(range(64)) AS i, round(unnest(c), 6) AS x FROM cen",
        "cluster_scores": f"WITH {_SCORED} SELECT label, size, mean_similarity, std_similarity, percentage FROM st",
        "cluster_share": "SELECT label, count(*) AS size, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percentage FROM embeddings GROUP BY label",
        "largest_clusters": "SELECT label, count(*) AS size, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percentage FROM embeddings GROUP BY label ORDER BY size DESC, label LIMIT 5",
        **{name: f"WITH {_SCORED} SELECT label, size, mean_similarity, std_similarity, percentage FROM st ORDER BY size >= {least} DESC, CASE WHEN size >= {least} THEN -mean_similarity END, size DESC, label LIMIT 1" for name, least in (("best_cluster", 500), ("best_cluster_of_50", 50))},
        "top_n_refine": f"WITH {_SCORED} SELECT vec_id, label, round(similarity, 6) AS similarity FROM sc WHERE label = (SELECT label FROM embeddings GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) ORDER BY sc.similarity DESC, vec_id LIMIT 100",
        "top_n_refine_5000": f"WITH {_SCORED} SELECT vec_id, label, round(similarity, 6) AS similarity FROM sc WHERE label = (SELECT label FROM embeddings GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) ORDER BY sc.similarity DESC, vec_id LIMIT 5000",
        "top_per_cluster": f"WITH {_SCORED} SELECT label, row_number() OVER (PARTITION BY label ORDER BY sc.similarity DESC, vec_id) AS rank, vec_id, round(similarity, 6) AS similarity FROM sc QUALIFY rank <= 5",
        "similarity_histogram": f"WITH {_SCORED}, " + _histogram("sc", "similarity", 80),
        "duration_histogram": "WITH " + _histogram("prepare_dataset", "duration", 50),
        "split_rows": f"WITH {_SPLIT} SELECT doc_id, pos, part FROM k",
        "split_counts": f"WITH {_SPLIT} SELECT part, count(*) AS n FROM k GROUP BY part",
        "sample_n": "SELECT doc_id, source FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100",
        "numbered_files": f"WITH {_DEFAULTS} SELECT clip_id, printf('wavs/clip_%06d.wav', row_number() OVER (ORDER BY clip_id) - 1) AS file FROM d WHERE {_RANGE}",
        "carried_forward": "SELECT event_id, last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_click FROM events",
        "moving_average": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING), 6) AS average FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 5",
        "wave_metrics": f"WITH {_WAVES} SELECT clip_id, samples, frames, {', '.join(f'round(m.{x}, 4) AS {x}' for x in _METRIC_NAMES)} FROM m",
        "frame_levels": f"WITH {_WAVES} SELECT clip_id, unnest(range(len(rms))) AS frame, round(unnest(rms), 6) AS rms FROM r",
        "unit_vectors": f"WITH {_SCORED} SELECT vec_id, unnest(range(64)) AS i, round(unnest(list_transform(e, lambda v: v / norm)), 6) AS x FROM u",
        "corpus_selection": f"""WITH {_DEFAULTS}, embedded AS (SELECT vec_id, label, embedding FROM embeddings WHERE vec_id IN (SELECT clip_id FROM d WHERE {_RANGE})),
{_SCORED.replace("FROM embeddings)", "FROM embedded)")}, best AS (SELECT label FROM st ORDER BY size >= 500 DESC, CASE WHEN size >= 500 THEN -mean_similarity END, size DESC, label LIMIT 1),
y AS (SELECT vec_id AS clip_id, similarity FROM sc WHERE label = (SELECT label FROM best)),
o AS (SELECT *, row_number() OVER (ORDER BY clip_id) - 1 AS k, row_number() OVER (ORDER BY md5('42:' || clip_id), clip_id) - 1 AS pos, count(*) OVER () AS n FROM y)
SELECT clip_id, printf('wavs/clip_%06d.wav', k) AS file, round(similarity, 6) AS similarity, CASE WHEN pos < floor(n * 0.9) THEN 'train' ELSE 'eval' END AS part FROM o""",
        "formatted_dates": "SELECT row_id, strftime(recorded_at, '%Y-%m-%d %H:%M') AS day FROM metadata_eval",
        "stage_metrics": f"WITH {_WAVES} SELECT dataset_source, count(*) AS clips, {', '.join(f'round(avg(m.{x}), 4) AS {x}' for x in ('duration_s', 'rms', 'peak', 'silence_ratio', 'speaking_s'))} FROM m GROUP BY dataset_source",
        "pauses_compressed": f"""WITH a AS (SELECT clip_id, audio['sampling_rate'] AS sr, {_TOKENS_AT} FROM prepare_dataset WHERE len(audio['array']) > 0),
b AS (SELECT *, abs(x) < 0.05 AS quiet, i - row_number() OVER (PARTITION BY clip_id, abs(x) < 0.05 ORDER BY i) AS island FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY clip_id, quiet, island ORDER BY i) AS r FROM b)
SELECT clip_id, count(*) FILTER (NOT quiet OR r <= floor(sr * 2 / 1000)) AS kept, round(coalesce(sum(abs(x)) FILTER (NOT quiet OR r <= floor(sr * 2 / 1000)), 0), 4) AS level FROM c GROUP BY clip_id""",
        "tail_trimmed": f"""WITH a AS (SELECT clip_id, audio['sampling_rate'] AS sr, {_TOKENS_AT} FROM prepare_dataset WHERE len(audio['array']) > 0),
b AS (SELECT *, coalesce(max(CASE WHEN abs(x) >= 0.05 THEN i END) OVER (PARTITION BY clip_id), 0) + floor(sr / 1000) AS upto FROM a)
SELECT clip_id, count(*) FILTER (i <= upto) AS kept, round(coalesce(sum(abs(x)) FILTER (i <= upto), 0), 4) AS level FROM b GROUP BY clip_id""",
        "clamped": "SELECT clip_id, round(list_max(list_transform(audio['array'], lambda x: greatest(least(x::DOUBLE, 0.5), -0.5))), 6) AS hi, round(list_min(list_transform(audio['array'], lambda x: greatest(least(x::DOUBLE, 0.5), -0.5))), 6) AS lo FROM prepare_dataset WHERE len(audio['array']) > 0",
        "concatenated_waves": """WITH a AS (SELECT clip_id // 4 AS grp, len(audio['array']) AS n, audio['sampling_rate'] AS sr, list_sum(list_transform(audio['array'], lambda x: abs(x::DOUBLE))) AS lv FROM prepare_dataset WHERE audio['array'] IS NOT NULL AND audio['sampling_rate'] IS NOT NULL)
SELECT grp, (sum(n) + (count(*) - 1) * floor(max(sr) * 0.004) + floor(max(sr) * 0.007))::BIGINT AS samples, round(coalesce(sum(lv), 0), 4) AS level FROM a GROUP BY grp""",
        "run_totals": """WITH a AS (SELECT run_id, coalesce(len(chunks), 0) AS n, coalesce(list_sum(list_transform(chunks, lambda c: coalesce(c['duration_s'], 0))), 0) AS d, coalesce(list_sum(list_transform(chunks, lambda c: coalesce(c['generation_time_s'], 0))), 0) AS g FROM generation_stats),
b AS (SELECT run_id, n, d + greatest(n - 1, 0) * 0.4::DOUBLE + CASE WHEN n > 0 THEN 0.7::DOUBLE ELSE 0 END AS d, g FROM a) SELECT run_id, n AS n_chunks, round(d, 2) AS duration_s, round(g, 2) AS generation_s, round(g / nullif(d, 0), 3) AS rtf FROM b""",
        "totals_by_setting": "SELECT params['temperature'] AS temperature, params['top_p'] AS top_p, count(*) AS runs, sum(num_chunks)::BIGINT AS chunks, round(sum(total_duration_s), 2) AS duration_s, round(sum(total_generation_time) / nullif(sum(total_duration_s), 0), 3) AS rtf FROM generation_stats GROUP BY ALL",
        "chunk_seeds": "WITH a AS (SELECT run_id, params['seed'] AS seed, unnest(range(len(chunks))) AS pos, unnest(chunks) AS c FROM generation_stats) SELECT run_id, c['index'] AS index, c['chars'] AS chars, c['duration_s'] AS duration_s, seed + pos AS chunk_seed FROM a",
        "daily_counts": "SELECT date_trunc('day', ingested_at)::TIMESTAMP AS start, dataset_source, count(*) AS n FROM prepare_dataset WHERE ingested_at IS NOT NULL GROUP BY ALL",
    }
