"""SQL of the queries in `layers`."""

from utterlake.functions.hangul import CODA_SPELLED, CODAS, ONSET_ROMAN, ONSETS, VOWEL_ROMAN, ipa_map
from utterlake.functions.text import INVISIBLE, WS
from utterlake.plans.sql import SPLIT_WORDS, TOK, UTT, WORDS, resolved, words, year

_I = INVISIBLE.replace(r"\x{0000}-", r"\x{0001}-")


def _list(xs) -> str:
    return "[" + ", ".join("'" + x.strip().replace("'", "''") + "'" for x in xs) + "]"


def _micros(c: str) -> str:
    t = f"replace(lower(regexp_replace(coalesce({c}, ''), '[{WS}]+', '', 'g')), ',', '.')"
    h, m, s = (f"try_cast(nullif(regexp_extract({t}, '^(?:([0-9]+):)?([0-9]+):([0-9]+(?:\\.[0-9]+)?)$', {i}), '') AS DOUBLE)" for i in (1, 2, 3))
    return f"""round(CASE WHEN regexp_matches({t}, '^-?[0-9]+(\\.[0-9]+)?ms$') THEN try_cast(regexp_replace({t}, 'ms$', '') AS DOUBLE) / 1000 WHEN regexp_matches({t}, '^-?[0-9]+(\\.[0-9]+)?s?$') THEN try_cast(regexp_replace({t}, 's$', '') AS DOUBLE)
WHEN regexp_matches({t}, '^([0-9]+:)?[0-9]+:[0-9]+(\\.[0-9]+)?$') THEN coalesce({h}, 0) * 3600 + {m} * 60 + {s} END * 1000000)::BIGINT"""


def _last(table: str, keys: str, cols: str, order: str) -> str:
    return f"(SELECT {keys}, {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn_ FROM {table}) WHERE rn_ = 1)"


def _or(table: str, c: str, hit: str, d: str = "미상") -> str:
    """A value of a row that was met, blank if null; else the default."""
    return f"CASE WHEN {table}.{hit} IS NULL THEN '{d}' ELSE coalesce({table}.{c}, '') END AS {c}"


def _desc(*cols: str) -> str:
    return ", ".join(f"{c} DESC NULLS LAST" for c in cols)


_META = ["category_norm", "discourse_mode", "topic", "relation", "date", "in_ml2025_gold"]
_SPK = ["sex_norm", "age_norm", "occupation_norm", "education_ord", "birthplace_norm", "current_residence_norm"]
_EXTRA = {"original_form": "미상", "start": "", "end_sec": "", "note": "미상"}
_NAME = "string_split(path, '/')[-1]"
_INV = f"""inv AS (SELECT path, regexp_replace(regexp_extract({_NAME}, '^(.*)\\.[^.]*$', 1), ' \\([0-9]+\\)$', '') AS utt_id, lower(regexp_extract({_NAME}, '\\.([^.]*)$', 1)) AS ext FROM tiny_files WHERE NOT regexp_matches({_NAME}, '^[_.]'))"""
_MASTER = f"""{UTT}, {_INV}, {resolved('u', 'us', "string_split(utt_id, '.')[1]")},
lf AS (SELECT * FROM file_meta WHERE deleted_at IS NULL), ls_ AS (SELECT * FROM speakers_normalized WHERE deleted_at IS NULL), sm_ AS (SELECT * FROM search_master WHERE utt_id IS NOT NULL), dj_ AS (SELECT * FROM dialogue_json WHERE utt_id IS NOT NULL),
meta AS {_last('lf', 'file_id', ', '.join(_META), _desc('loaded_at', 'doc_id', *_META))},
spk AS {_last('ls_', 'year, id', ', '.join(_SPK), _desc('loaded_at', *_SPK))},
ex AS {_last('dj_', 'utt_id', ', '.join(_EXTRA), _desc('loaded_at', *_EXTRA))},
cov AS {_last('sm_', 'utt_id', 'has_wav, quarantined', _desc('loaded_at', 'has_wav', 'quarantined'))},
mst AS (SELECT us.utt_id, form, tagged, speaker_id, n_morphs, string_split(us.utt_id, '.')[1] AS session_id, CASE WHEN contains(us.utt_id, '.') THEN string_split(us.utt_id, '.')[-1] ELSE '' END AS utt_seq, {year('us.utt_id')} AS year,
  {', '.join(_or('meta', c, 'file_id') for c in _META)}, {', '.join(_or('spk', c, 'id') for c in _SPK)}, {', '.join(_or('ex', c, 'utt_id', d) for c, d in _EXTRA.items())}, {_or('cov', 'has_wav', 'utt_id', '0')}, {_or('cov', 'quarantined', 'utt_id', '')},
  CASE WHEN cov.utt_id IS NOT NULL AND us.utt_id IN (SELECT utt_id FROM inv WHERE ext = 'textgrid') THEN '1' ELSE '0' END AS has_tg_eojeol, round(({_micros('ex.end_sec')} - {_micros('ex.start')}) / 1e6, 3) AS dur, len({words('form')})::BIGINT AS n_eojeol
  FROM us LEFT JOIN meta ON meta.file_id = string_split(us.utt_id, '.')[1] LEFT JOIN spk ON spk.year = {year('us.utt_id')} AND spk.id = us.speaker LEFT JOIN ex ON ex.utt_id = us.utt_id LEFT JOIN cov ON cov.utt_id = us.utt_id)"""
_COVER = f"{_INV}, c AS (SELECT DISTINCT utt_id, year, utt_id IN (SELECT utt_id FROM inv WHERE ext = 'textgrid') AS has_textgrid, utt_id IN (SELECT utt_id FROM inv WHERE ext = 'lab') AS has_lab FROM search_master WHERE utt_id IS NOT NULL)"
_MISSING = f"{_INV}, miss AS (SELECT DISTINCT utt_id, year FROM search_master WHERE has_wav = '1' AND has_tg_eojeol = '0' AND utt_id NOT IN (SELECT utt_id FROM inv WHERE ext = 'textgrid'))"
_TIMED = f"""s0 AS (SELECT session_id, utt_id, max(form) AS form, max(start) AS start, max(end_sec) AS end_sec FROM search_master WHERE utt_id IS NOT NULL GROUP BY 1, 2),
s1 AS (SELECT session_id, utt_id, form, string_split(utt_id, '.')[-1]::INT AS num, {_micros('start')} AS b, {_micros('end_sec')} AS e FROM s0),
timed AS (SELECT * FROM s1 WHERE b IS NOT NULL AND e IS NOT NULL AND e >= b)"""
_W = """w AS (SELECT user_id, event_id, value, epoch_us(ts) / 1e6 AS xmin, epoch_us(ts) / 1e6 + 60.0 AS xmax FROM events),
p AS (SELECT *, coalesce(lead(xmin) OVER (PARTITION BY user_id ORDER BY xmin, xmax) - xmax, 999.0) AS gap FROM w),
q AS (SELECT *, CASE WHEN gap >= 0.15 THEN 'IP' WHEN gap >= 0.05 THEN 'AP' ELSE '' END AS boundary FROM p)"""
_CODE = "code AS (SELECT l_orderkey, l_linenumber, ((l_partkey * 37 + l_linenumber) % 11172)::INT AS c FROM lineitem)"
_PARTS = "list_filter(list_transform(string_split(coalesce(category, ''), '>'), lambda x_: regexp_replace(x_, '\\s+', '', 'g')), lambda x_: x_ <> '')"


def _unknown(c: str) -> str:
    return f"CASE WHEN trim(coalesce({c}, '')) IN ('', 'NA') THEN '미상' ELSE trim({c}) END"


_AGE = f"CASE WHEN {_unknown('age')} = '60대' THEN '60대 이상' ELSE {_unknown('age')} END"
_JOB = f"CASE WHEN {_unknown('occupation')} = '기술자 종자사(장치/기계 조작 및 조립 종사자)' THEN '기술자 종사자(장치/기계 조작 및 조립 종사자)' ELSE {_unknown('occupation')} END"
_HAN = "[^가-힣]"
_ROMAN1 = f"array_to_string(list_filter([{_list(ONSET_ROMAN)}[c // 588 + 1], {_list(VOWEL_ROMAN)}[(c % 588) // 28 + 1], {_list(CODA_SPELLED)}[c % 28 + 1]], lambda x_: x_ <> ''), ' ')"


def _roman_word(w: str) -> str:
    one = _ROMAN1.replace("c //", "(unicode(ch) - 44032) //").replace("(c %", "((unicode(ch) - 44032) %").replace("[c %", "[(unicode(ch) - 44032) %")
    return f"array_to_string(list_transform(string_split({w}, ''), lambda ch: {one}), ' _ ')"


_IPA = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in ipa_map().items()) + "}"
_MARKS = r"""[.,?!~…"''`()\[\]{}<>《》「」『』·:;/\\–—\s-]"""
#: The rules of pronunciation one after the other over all 2,128 boundaries: c coda, o onset.
_STOPS = "CASE WHEN c IN ('ㅋ', 'ㄲ', 'ㄱ') THEN 'ㄱ' WHEN c IN ('ㄷ', 'ㅅ', 'ㅆ', 'ㅈ', 'ㅊ', 'ㅌ', 'ㅎ') THEN 'ㄷ' WHEN c IN ('ㅂ', 'ㅍ') THEN 'ㅂ' ELSE c END"
_G2P = f"""r0 AS (SELECT coda, onset, i.i AS before_i, g.g AS stem_end, coda AS c, onset AS o FROM (SELECT unnest({_list(CODAS)}) AS coda), (SELECT unnest({_list(ONSETS)}) AS onset), (VALUES (false), (true)) AS i(i), (VALUES (false), (true)) AS g(g)),
r1 AS (SELECT coda, onset, before_i, stem_end, CASE WHEN c IN ('ㅎ', 'ㄶ', 'ㅀ') AND o IN ('ㄱ', 'ㄷ', 'ㅈ', 'ㅅ') THEN CASE c WHEN 'ㅎ' THEN '' WHEN 'ㄶ' THEN 'ㄴ' ELSE 'ㄹ' END WHEN o = 'ㅎ' AND {_STOPS} IN ('ㄱ', 'ㄷ', 'ㅂ') THEN '' ELSE c END AS c,
  CASE WHEN c IN ('ㅎ', 'ㄶ', 'ㅀ') AND o IN ('ㄱ', 'ㄷ', 'ㅈ', 'ㅅ') THEN CASE o WHEN 'ㄱ' THEN 'ㅋ' WHEN 'ㄷ' THEN 'ㅌ' WHEN 'ㅈ' THEN 'ㅊ' ELSE 'ㅆ' END WHEN o = 'ㅎ' THEN CASE {_STOPS} WHEN 'ㄱ' THEN 'ㅋ' WHEN 'ㄷ' THEN 'ㅌ' WHEN 'ㅂ' THEN 'ㅍ' ELSE o END ELSE o END AS o FROM r0),
r2 AS (SELECT * REPLACE (CASE WHEN o = 'ㅇ' THEN CASE c WHEN 'ㅎ' THEN '' WHEN 'ㄶ' THEN 'ㄴ' WHEN 'ㅀ' THEN 'ㄹ' ELSE c END ELSE c END AS c) FROM r1),
r3 AS (SELECT * REPLACE (CASE WHEN c IN ('ㄷ', 'ㅌ') AND before_i AND o IN ('ㅇ', 'ㅎ') THEN '' ELSE c END AS c, CASE WHEN c IN ('ㄷ', 'ㅌ') AND before_i AND o IN ('ㅇ', 'ㅎ') THEN CASE WHEN c = 'ㄷ' AND o = 'ㅇ' THEN 'ㅈ' ELSE 'ㅊ' END ELSE o END AS o) FROM r2),
r4 AS (SELECT * REPLACE (CASE WHEN o = 'ㅇ' AND c NOT IN ('', 'ㅇ') THEN CASE WHEN c IN ('ㄳ') THEN 'ㄱ' WHEN c = 'ㄵ' THEN 'ㄴ' WHEN c IN ('ㄺ', 'ㄻ', 'ㄼ', 'ㄽ', 'ㄾ', 'ㄿ') THEN 'ㄹ' WHEN c = 'ㅄ' THEN 'ㅂ' ELSE '' END ELSE c END AS c,
  CASE WHEN o = 'ㅇ' AND c NOT IN ('', 'ㅇ') THEN CASE c WHEN 'ㄳ' THEN 'ㅅ' WHEN 'ㄵ' THEN 'ㅈ' WHEN 'ㄺ' THEN 'ㄱ' WHEN 'ㄻ' THEN 'ㅁ' WHEN 'ㄼ' THEN 'ㅂ' WHEN 'ㄽ' THEN 'ㅅ' WHEN 'ㄾ' THEN 'ㅌ' WHEN 'ㄿ' THEN 'ㅍ' WHEN 'ㅄ' THEN 'ㅅ' ELSE c END ELSE o END AS o) FROM r3),
r5 AS (SELECT * REPLACE ({_STOPS} AS c) FROM r4),
r6 AS (SELECT * REPLACE (CASE WHEN c IN ('ㄳ', 'ㄺ') THEN 'ㄱ' WHEN c IN ('ㄵ', 'ㄶ') THEN 'ㄴ' WHEN c = 'ㄻ' THEN 'ㅁ' WHEN c IN ('ㄼ', 'ㄽ', 'ㄾ', 'ㅀ') THEN 'ㄹ' WHEN c IN ('ㄿ', 'ㅄ') THEN 'ㅂ' ELSE c END AS c) FROM r5),
r7 AS (SELECT * REPLACE (CASE WHEN c = 'ㄴ' AND o = 'ㄹ' THEN 'ㄹ' WHEN c = 'ㄹ' AND o = 'ㄴ' THEN c WHEN o IN ('ㄴ', 'ㅁ') THEN CASE c WHEN 'ㄱ' THEN 'ㅇ' WHEN 'ㄷ' THEN 'ㄴ' WHEN 'ㅂ' THEN 'ㅁ' ELSE c END ELSE c END AS c, CASE WHEN c = 'ㄹ' AND o = 'ㄴ' THEN 'ㄹ' ELSE o END AS o) FROM r6),
r8 AS (SELECT * REPLACE (CASE WHEN c IN ('ㄱ', 'ㄷ', 'ㅂ') OR (stem_end AND o IN ('ㄱ', 'ㄷ', 'ㅅ', 'ㅈ')) THEN CASE o WHEN 'ㄱ' THEN 'ㄲ' WHEN 'ㄷ' THEN 'ㄸ' WHEN 'ㅂ' THEN 'ㅃ' WHEN 'ㅅ' THEN 'ㅆ' WHEN 'ㅈ' THEN 'ㅉ' ELSE o END ELSE o END AS o) FROM r7)"""
_ORDERS = "om AS (SELECT o_orderkey, o_orderstatus, coalesce(c_mktsegment, '미상') AS segment, coalesce(n_name, '미상') AS nation, coalesce(r_name, '미상') AS region FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"
_NUMS = "list_transform(string_split(utt_id, '.')[2:], lambda x_: try_cast(x_ AS INT))"

# Pronunciation word by word: syllables as rows, their neighbours by windows, the boundary rules above as a table.
_FORMS = f"nfc_normalize(regexp_replace(coalesce(form, ''), '[{_I}]+', '', 'g'))"


def _spoken(source: str) -> str:
    """CTEs that end in ``pron``: key, n_eojeol, form_roman, pron_pred_hangul, pron_pred_roman, pron_pred_ipa, align_warn of a source with
    utt_id and form; the analysis is that of ``uv``."""
    cut = lambda part: f"regexp_extract(value, '(?s)^(.*)/([^/]*)$', {part})"
    roman = lambda o, v, c: f"array_to_string(list_filter([{o}, {v}, {c}], lambda x_: x_ <> ''), ' ')"
    at = lambda xs, i: f"{_list(xs)}[({i}) + 1]"
    stops = f"CASE {' '.join(f"WHEN c_ = '{k}' THEN '{v}'" for k, v in {'ㄱ': 'k', 'ㄴ': 'n', 'ㄷ': 't', 'ㄹ': 'l', 'ㅁ': 'm', 'ㅂ': 'p', 'ㅇ': 'ng'}.items())} ELSE '' END"
    ipa = lambda x: f"coalesce({_IPA}[{x}], '')"
    return f"""{_G2P},
pf AS (SELECT utt_id, {words('form')} AS ws FROM {source}),
pn AS (SELECT k, max(word_idx) AS m FROM uv GROUP BY 1),
pw AS (SELECT utt_id, unnest(range(1, len(ws) + 1)) AS wi, unnest(ws) AS w, len(ws) AS n FROM pf),
pg AS (SELECT *, regexp_matches(regexp_replace(w, '{_MARKS}', '', 'g'), '^[가-힣]+$') AS han, regexp_replace(w, '{_HAN}', '', 'g') AS h FROM pw),
syl AS (SELECT utt_id, wi, unnest(range(0, len(h))) AS si, unicode(unnest(string_split(h, ''))) - 44032 AS s, len(h) AS hn FROM pg WHERE han),
mo AS (SELECT k, word_idx, part_idx, regexp_replace({cut(1)}, '{_HAN}', '', 'g') AS mh, {cut(2)} AS tag FROM uv),
mp2 AS (SELECT *, sum(len(mh)) OVER (PARTITION BY k, word_idx ORDER BY part_idx) AS upto, sum(len(mh)) OVER (PARTITION BY k, word_idx) AS total, lead(mh) OVER (PARTITION BY k, word_idx ORDER BY part_idx) AS nh, lead(tag) OVER (PARTITION BY k, word_idx ORDER BY part_idx) AS nt FROM mo),
gp AS (SELECT k, word_idx, upto - 1 AS si, total FROM mp2 WHERE len(mh) > 0 AND len(coalesce(nh, '')) > 0 AND tag IN ('VV', 'VA', 'VX', 'VCP', 'VCN') AND nt IN ('EC', 'EP', 'EF', 'ETM', 'ETN', 'EG')
  AND {at(CODAS, "(unicode(right(mh, 1)) - 44032) % 28")} IN ('ㄴ', 'ㅁ', 'ㄵ', 'ㄻ', 'ㄼ', 'ㄾ') AND {at(ONSETS, "(unicode(left(nh, 1)) - 44032) // 588")} IN ('ㄱ', 'ㄷ', 'ㅅ', 'ㅈ')),
sx AS (SELECT syl.*, lead(s) OVER (PARTITION BY syl.utt_id, syl.wi ORDER BY syl.si) AS nx, gp.si IS NOT NULL AND m = n AS gap FROM syl JOIN (SELECT DISTINCT utt_id, n FROM pw) USING (utt_id) LEFT JOIN pn ON pn.k = utt_id LEFT JOIN gp ON gp.k = utt_id AND gp.word_idx = wi AND gp.si = syl.si AND gp.total = hn),
sb AS (SELECT sx.*, {at(CODAS, 's % 28')} AS c0, {at(ONSETS, 's // 588')} AS o0, r8.c AS bc, r8.o AS bo FROM sx LEFT JOIN r8 ON nx IS NOT NULL AND r8.coda = {at(CODAS, 's % 28')} AND r8.onset = {at(ONSETS, 'nx // 588')} AND r8.before_i = ((nx % 588) // 28 = 20) AND r8.stem_end = gap),
sp AS (SELECT *, CASE WHEN nx IS NULL THEN {_last_coda('c0')} ELSE bc END AS c_, coalesce(lag(bo) OVER (PARTITION BY utt_id, wi ORDER BY si), o0) AS o_, (s % 588) // 28 AS v_ FROM sb),
sr AS (SELECT *, {at(ONSET_ROMAN, "list_position(" + _list(ONSETS) + ", o_) - 1")} AS ro, {at(VOWEL_ROMAN, 'v_')} AS rv, {stops} AS rc FROM sp),
wr AS (SELECT utt_id, wi, string_agg({roman(at(ONSET_ROMAN, 's // 588'), at(VOWEL_ROMAN, 'v_'), at(CODA_SPELLED, 's % 28'))}, ' _ ' ORDER BY si) AS fr, string_agg({roman('ro', 'rv', 'rc')}, ' _ ' ORDER BY si) AS pr,
  string_agg(chr((44032 + (list_position({_list(ONSETS)}, o_) - 1) * 588 + v_ * 28 + list_position({_list(CODAS)}, c_) - 1)::INT), '' ORDER BY si) AS ph, string_agg({ipa('ro')} || {ipa('rv')} || {ipa('rc')}, '_' ORDER BY si) AS pi FROM sr GROUP BY 1, 2),
wo AS (SELECT pg.utt_id, pg.wi, n, coalesce(fr, '∅') AS fr, coalesce(ph, '∅') AS ph, coalesce(pr, '∅') AS pr, coalesce(pi, '∅') AS pi FROM pg LEFT JOIN wr ON wr.utt_id = pg.utt_id AND wr.wi = pg.wi),
po AS (SELECT utt_id, string_agg(fr, ' | ' ORDER BY wi) AS form_roman, string_agg(ph, ' ' ORDER BY wi) AS pron_pred_hangul, string_agg(pr, ' | ' ORDER BY wi) AS pron_pred_roman, string_agg(pi, ' | ' ORDER BY wi) AS pron_pred_ipa FROM wo GROUP BY 1),
pron AS (SELECT pf.utt_id, len(ws)::INT AS n_eojeol, coalesce(form_roman, '') AS form_roman, coalesce(pron_pred_hangul, '') AS pron_pred_hangul, coalesce(pron_pred_roman, '') AS pron_pred_roman, coalesce(pron_pred_ipa, '') AS pron_pred_ipa,
  CASE WHEN m > 0 AND m <> len(ws) THEN 'eojeol_tag_mismatch(' || len(ws) || '!=' || m || ')' ELSE '' END AS align_warn FROM pf LEFT JOIN po ON po.utt_id = pf.utt_id LEFT JOIN pn ON pn.k = pf.utt_id)"""


def _last_coda(c: str) -> str:
    """A coda at the end of a word."""
    return f"CASE WHEN {c} IN ('ㄱ', 'ㅋ', 'ㄲ', 'ㄳ', 'ㄺ') THEN 'ㄱ' WHEN {c} IN ('ㄷ', 'ㅅ', 'ㅆ', 'ㅈ', 'ㅊ', 'ㅌ', 'ㅎ') THEN 'ㄷ' WHEN {c} IN ('ㅂ', 'ㅍ', 'ㄿ', 'ㅄ') THEN 'ㅂ' WHEN {c} IN ('ㄵ', 'ㄶ') THEN 'ㄴ' WHEN {c} = 'ㄻ' THEN 'ㅁ' WHEN {c} IN ('ㄼ', 'ㄽ', 'ㄾ', 'ㅀ') THEN 'ㄹ' ELSE {c} END"


_UNIT = f"""CASE WHEN regexp_full_match(morph, '[가-힣]+') THEN {_roman_word('morph')} WHEN morph <> '' THEN morph ELSE value END || CASE WHEN tag <> '' THEN '/' || tag ELSE '' END"""

def grid_rows(source: str, key: str) -> str:
    """CTEs that end in ``grid`` (key, tier, idx, xmin, xmax, text): each textgrid (key, content) is cut at the names of its tiers."""
    number = r"[-\d.eE]+"
    cell = rf'intervals\s*\[\d+\]:?\s*xmin\s*=\s*{number}\s*xmax\s*=\s*{number}\s*text\s*=\s*"(?:[^"]|"")*"'
    return rf"""gf AS (SELECT {key}, string_split_regex(content, '(?m)^\s*name\s*=\s*') AS parts FROM {source}),
gt AS (SELECT {key}, unnest(parts[2:]) AS part FROM gf), gn AS (SELECT {key}, replace(regexp_extract(part, '^"((?:[^"]|"")*)"', 1), '""', '"') AS tier, part FROM gt),
gc AS (SELECT {key}, tier, unnest(regexp_extract_all(part, '{cell}')) AS cell FROM gn),
grid AS (SELECT {key}, tier, regexp_extract(cell, '^intervals\s*\[(\d+)\]', 1)::INT AS idx, regexp_extract(cell, 'xmin\s*=\s*({number})', 1)::DOUBLE AS xmin, regexp_extract(cell, 'xmax\s*=\s*({number})', 1)::DOUBLE AS xmax, replace(regexp_extract(cell, '(?s)text\s*=\s*"(.*)"$', 1), '""', '"') AS text FROM gc)"""


_GRID = f"WITH g0 AS (SELECT path, content FROM tiny_files WHERE lower(path) LIKE '%.textgrid' AND content IS NOT NULL), {grid_rows('g0', 'path')}"

SQL = {
    "master": f"WITH {_MASTER} SELECT * FROM mst",
    "master_checks": f"""WITH {_MASTER}, {SPLIT_WORDS}, nw AS (SELECT k, max(word_idx) AS n FROM uv GROUP BY 1)
SELECT count(*) AS n_rows, count(*) FILTER (WHERE category_norm = '미상') AS no_meta, count(*) FILTER (WHERE sex_norm = '미상') AS no_speaker, count(*) FILTER (WHERE original_form = '미상') AS no_transcript, count(*) FILTER (WHERE dur IS NULL) AS no_duration,
count(*) FILTER (WHERE n > 0 AND n_eojeol <> n) AS word_mismatches, (SELECT count(*) FROM u) AS n_utterances FROM mst LEFT JOIN nw ON k = utt_id""",
    "spelled_roman": f"""WITH f AS (SELECT utt_id, nfc_normalize(regexp_replace(coalesce(max(form), ''), '[{_I}]+', '', 'g')) AS form FROM search_master WHERE utt_id IS NOT NULL GROUP BY 1)
SELECT utt_id, array_to_string(list_transform({words('form')}, lambda w: CASE WHEN regexp_matches(regexp_replace(w, '{_MARKS}', '', 'g'), '^[가-힣]+$') THEN {_roman_word(f"regexp_replace(w, '{_HAN}', '', 'g')")} ELSE '∅' END), ' | ') AS form_roman FROM f""",
    "pronunciation": f"""WITH {WORDS}, nf AS (SELECT utt_id, {_FORMS} AS form FROM u), {_spoken('nf')} SELECT * FROM pron""",
    "flagship": f"""WITH {_MASTER}, {SPLIT_WORDS}, nf AS (SELECT utt_id, {_FORMS} AS form FROM u), {_spoken('nf')} SELECT mst.* EXCLUDE (form, n_eojeol), nf.form, pron.* EXCLUDE (utt_id) FROM mst JOIN nf ON nf.utt_id = mst.utt_id JOIN pron ON pron.utt_id = mst.utt_id""",
    "tagged_roman": f"""WITH {TOK.replace('tok AS (SELECT k AS utt_id,', 'tok AS (SELECT k AS utt_id, value,')}, x AS (SELECT utt_id, word_idx, string_agg({_UNIT}, ' + ' ORDER BY morph_idx) AS r FROM tok GROUP BY 1, 2) SELECT utt_id, string_agg(r, ' | ' ORDER BY word_idx) AS tagged_roman FROM x GROUP BY 1""",
    "textgrid_intervals": _GRID + " SELECT path, tier, idx, xmin, xmax, text FROM grid",
    "g2p_boundary": f"WITH {_G2P} SELECT coda, onset, before_i, stem_end, c AS spoken_coda, o AS spoken_onset FROM r8",
    "hangul_letters": f"WITH {_CODE} SELECT l_orderkey, l_linenumber, (c // 588)::INT AS onset, ((c % 588) // 28)::INT AS vowel, (c % 28)::INT AS coda, chr(44032 + c) AS syllable FROM code",
    "syllable_roman": f"""WITH {_CODE}, r AS (SELECT DISTINCT c AS code, {_ROMAN1} AS roman FROM code) SELECT code, roman, array_to_string(list_transform(string_split(roman, ' '), lambda k_: coalesce({_IPA}[k_], '⟨' || k_ || '⟩')), '') AS ipa FROM r""",
    "categories": f"""WITH p AS (SELECT DISTINCT category, {_PARTS} AS p FROM file_meta)
SELECT category, array_to_string(p, ' > ') AS category_norm, CASE WHEN len(p) >= 3 THEN replace(p[2], '대화', '') || '-' || p[3] WHEN len(p) = 0 THEN '미상' ELSE array_to_string(p, '>') END AS register, CASE WHEN len(p) = 0 THEN '미상' WHEN p[-1] = '독백' THEN '독백' ELSE '대화' END AS discourse_mode FROM p""",
    "speakers_norm": "SELECT DISTINCT year, id, sex_norm, age_norm, occupation_norm, education_norm, education_ord, birthplace_norm FROM speakers_normalized",
    "speakers_changed": f"""SELECT count(*) FILTER (WHERE trim(coalesce(sex, '')) IS DISTINCT FROM {_unknown('sex')}) AS sex, count(*) FILTER (WHERE trim(coalesce(age, '')) IS DISTINCT FROM {_AGE}) AS age, count(*) FILTER (WHERE trim(coalesce(occupation, '')) IS DISTINCT FROM {_JOB}) AS occupation FROM speakers_normalized""",
    "first_speakers": f"SELECT * FROM {_last('speakers_normalized', 'id', 'year, sex_norm, age_norm', 'loaded_at, year')}",
    "id_keys": f"""SELECT DISTINCT utt_id, string_split(utt_id, '.')[1] AS session_id, CASE WHEN contains(utt_id, '.') THEN string_split(utt_id, '.')[-1] ELSE '' END AS utt_seq, {year('utt_id')} AS year, '06_textgrid_eojeol/' || {year('utt_id')} || '/' || string_split(utt_id, '.')[1] || '/' || utt_id || '.TextGrid' AS path FROM dialogue_json WHERE utt_id IS NOT NULL""",
    "labs": f"""WITH {WORDS}, tw AS (SELECT k, word_idx, string_agg(regexp_extract(value, '(?s)^(.*)/([^/]*)$', 1), '' ORDER BY part_idx) FILTER (WHERE NOT starts_with(regexp_extract(value, '(?s)^(.*)/([^/]*)$', 2), 'S')) AS x FROM uv GROUP BY 1, 2), tl AS (SELECT k, string_agg(x, ' ' ORDER BY word_idx) FILTER (WHERE x <> '') AS tagged_lab FROM tw GROUP BY 1)
SELECT utt_id, array_to_string(list_filter(list_transform({words('form')}, lambda w: regexp_replace(w, '{_HAN}', '', 'g')), lambda w: w <> ''), ' ') AS lab,
array_to_string(list_filter(list_transform({words('form')}, lambda w: regexp_replace(w, '[.,?!~…"'']', '', 'g')), lambda w: regexp_matches(w, '^[가-힣]+$')), ' ') AS clean_lab,
coalesce(tagged_lab, '') AS tagged_lab FROM u LEFT JOIN tl ON k = utt_id""",
    "coverage_flags": f"WITH {_COVER} SELECT * FROM c",
    "coverage_summary": f"""WITH {_COVER} SELECT coalesce(year, 'total') AS year, count(*) FILTER (WHERE has_textgrid AND has_lab) AS both, count(*) FILTER (WHERE has_textgrid AND NOT has_lab) AS has_textgrid_only, count(*) FILTER (WHERE NOT has_textgrid AND has_lab) AS has_lab_only, count(*) FILTER (WHERE NOT has_textgrid AND NOT has_lab) AS neither, count(*) AS n FROM c GROUP BY ROLLUP (year)""",
    "still_missing": f"WITH {_MISSING} SELECT * FROM miss",
    "recovery": f"""WITH {_INV}, f AS (SELECT utt_id, year, bool_or(coalesce(has_wav, '') = '1' AND coalesce(has_tg_eojeol, '') = '0') AS failed, utt_id IN (SELECT utt_id FROM inv WHERE ext = 'textgrid') AS back FROM search_master WHERE utt_id IS NOT NULL GROUP BY 1, 2),
r AS (SELECT coalesce(year, 'total') AS year, count(*) FILTER (WHERE failed) AS failed, count(*) FILTER (WHERE failed AND back) AS recovered FROM f GROUP BY ROLLUP (year)) SELECT year, failed, recovered, failed - recovered AS "left", CASE WHEN failed > 0 THEN recovered / failed END AS rate FROM r""",
    "length_classes": """WITH d AS (SELECT utt_id, year, max(try_cast(dur AS DOUBLE)) AS d FROM search_master WHERE utt_id IS NOT NULL GROUP BY 1, 2)
SELECT year, count(*) FILTER (WHERE d IS NULL) AS n_absent, count(*) FILTER (WHERE d < 0.3) AS n_short, count(*) FILTER (WHERE d >= 0.3) AS n_normal, count(*) AS n_total FROM d GROUP BY year""",
    "empty_analysis": f"""WITH {UTT}, e AS (SELECT string_split(utt_id, '.')[1] AS session_id, trim(coalesce(form, '')) = '' AS blank, trim(coalesce(form, '')) <> '' AND trim(coalesce(tagged, '')) = '' AS bad FROM u) SELECT session_id, bool_or(bad) AS any_empty, count(*) FILTER (WHERE bad) AS n_empty, count(*) FILTER (WHERE blank) AS n_blank FROM e GROUP BY 1""",
    "session_order": f"""WITH d AS (SELECT DISTINCT session_id, utt_id FROM search_master WHERE utt_id IS NOT NULL) SELECT utt_id, (row_number() OVER (PARTITION BY session_id ORDER BY {_NUMS}))::INT AS spoken, (row_number() OVER (PARTITION BY session_id ORDER BY utt_id))::INT AS spelled FROM d""",
    "keyword_context": f"""WITH {_TIMED}, k AS (SELECT session_id, utt_id, num, form, contains(coalesce(form, ''), '여행') AS is_hit FROM s1),
c AS (SELECT *, (row_number() OVER w)::INT AS position, bool_or(is_hit) OVER (PARTITION BY session_id ORDER BY num, utt_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM k WINDOW w AS (PARTITION BY session_id ORDER BY num, utt_id)) SELECT session_id, utt_id, num, form, is_hit, position FROM c WHERE near""",
    "session_offsets": f"""WITH {_TIMED} SELECT session_id, utt_id, (coalesce(sum(e - b) OVER (PARTITION BY session_id ORDER BY num, utt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS "offset", (sum(e - b) OVER (PARTITION BY session_id ORDER BY num, utt_id ROWS UNBOUNDED PRECEDING))::BIGINT AS "until" FROM timed""",
    "session_tiles": f"""WITH {_TIMED}, x AS (SELECT session_id, utt_id, b / 1e6 AS xmin, e / 1e6 AS xmax FROM timed),
c AS (SELECT *, coalesce(max(xmax) OVER (PARTITION BY session_id ORDER BY xmin, xmax, utt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS cur FROM x),
t AS (SELECT session_id, cur AS xmin, greatest(xmin, cur) AS xmax, '' AS text FROM c UNION ALL SELECT session_id, greatest(xmin, cur), greatest(xmax, greatest(xmin, cur)), utt_id FROM c) SELECT * FROM t WHERE xmax - xmin > 1e-6""",
    "tiers_normalized": f"""WITH {_TIMED}, d AS (SELECT session_id, max(e) / 1e6 AS dur FROM s1 WHERE e IS NOT NULL GROUP BY 1), x AS (SELECT timed.session_id, utt_id, b / 1e6 AS xmin, least(e / 1e6, dur) AS xmax, dur FROM timed JOIN d ON d.session_id IS NOT DISTINCT FROM timed.session_id), y AS (SELECT * FROM x WHERE xmax - xmin > 1e-6),
z AS (SELECT *, lead(xmax) OVER (PARTITION BY session_id ORDER BY xmin, xmax, utt_id) IS NULL AS last FROM y), t AS (SELECT session_id, xmin, xmax, utt_id AS text FROM z UNION ALL SELECT session_id, xmax, dur, '' FROM z WHERE last) SELECT * FROM t WHERE xmax - xmin > 1e-6""",
    "pauses": f"WITH {_W} SELECT user_id, event_id, round(gap, 3) AS gap, boundary FROM q",
    "phrases": f"""WITH {_W}, s AS (SELECT *, coalesce(sum(CASE WHEN boundary <> '' THEN 1 ELSE 0 END) OVER v, 0)::BIGINT + 1 AS ap, coalesce(sum(CASE WHEN boundary = 'IP' THEN 1 ELSE 0 END) OVER v, 0)::BIGINT + 1 AS ip FROM q WINDOW v AS (PARTITION BY user_id ORDER BY xmin, xmax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, ap, ip, round(min(xmin), 3) AS xmin, round(max(xmax), 3) AS xmax, count(*) AS n_words FROM s GROUP BY 1, 2, 3""",
    "pitch_resets": """WITH e AS (SELECT user_id, event_id, value, epoch_us(ts) / 1e6 AS xmin FROM events), x AS (SELECT *, coalesce(lead(xmin) OVER (PARTITION BY user_id ORDER BY xmin, event_id), xmin) AS xmax FROM e),
y AS (SELECT *, coalesce(lead(xmin) OVER v - xmax, 999.0) AS gap, lead(value) OVER v AS nv FROM x WINDOW v AS (PARTITION BY user_id ORDER BY xmin, xmax))
SELECT user_id, event_id, round(gap, 3) AS gap, CASE WHEN gap >= 0.15 THEN 'IP' WHEN gap >= 0.05 THEN 'AP' WHEN nv > 0 AND value > 0 AND 12 * log2(nv / value) >= 2.0 THEN 'AP' ELSE '' END AS boundary FROM y""",
    "prosody_segments": f"""WITH {_W}, s AS (SELECT *, CASE WHEN value >= 66 THEN 'H%' WHEN value <= 33 THEN 'L%' ELSE 'F%' END AS tone, coalesce(sum(CASE WHEN boundary <> '' THEN 1 ELSE 0 END) OVER v, 0)::BIGINT + 1 AS ap FROM q WINDOW v AS (PARTITION BY user_id ORDER BY xmin, xmax ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, ap, round(min(xmin), 3) AS xmin, round(max(xmax), 3) AS xmax, CASE WHEN arg_max(boundary, (xmin, xmax)) = 'AP' THEN 'AP' ELSE 'IP:' || arg_max(tone, (xmin, xmax)) END AS label FROM s GROUP BY 1, 2 HAVING max(xmax) - min(xmin) > 1e-6""",
    "boundary_tones": """WITH l AS (SELECT user_id, max(ts) AS until FROM events GROUP BY 1), g AS (SELECT user_id, arg_min(value, (ts, event_id)) AS a, arg_max(value, (ts, event_id)) AS b FROM events JOIN l USING (user_id) WHERE ts >= until - INTERVAL 1 DAY GROUP BY 1)
SELECT user_id, CASE WHEN a IS NULL OR b IS NULL OR a <= 0 OR b <= 0 THEN 'NA' WHEN 12 * log2(b / a) >= 1.5 THEN 'H%' WHEN 12 * log2(b / a) <= -1.5 THEN 'L%' ELSE 'F%' END AS tone FROM g""",
    "pitch_stats": """WITH e AS (SELECT user_id, value, epoch_us(ts) / 1e6 AS t FROM events WHERE value > 0)
SELECT user_id, round(avg(value), 6) AS mean, min(value) AS lowest, max(value) AS highest, count(*) AS n, round(CASE WHEN max(t) > min(t) THEN 12 * log2(arg_max(value, t) / arg_min(value, t)) / (max(t) - min(t)) END * 1e6, 6) AS slope FROM e GROUP BY 1""",
    "minute_averages": "SELECT strftime(ts, '%Y-%m-%d %H:%M') AS minute, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1",
    "textgrid_labels": r"""WITH t AS (SELECT path, regexp_extract_all(content, 'intervals\s*\[\d+\]:?\s*xmin\s*=\s*[-\d.eE]+\s*xmax\s*=\s*[-\d.eE]+\s*text\s*=\s*"((?:[^"]|"")*)"', 1) AS l FROM tiny_files WHERE lower(path) LIKE '%.textgrid')
SELECT path, len(l)::BIGINT AS n, len(list_filter(l, lambda x_: x_ NOT IN ('', 'sil', 'sp', 'spn', '<eps>', '<unk>')))::BIGINT AS n_sound FROM t WHERE len(l) > 0""",
    "regex_search": "SELECT DISTINCT utt_id, form, pron_pred_roman FROM search_master WHERE year = '2021' AND discourse_mode = '대화' AND regexp_matches(pron_pred_roman, 'k [_.-] (KK|TT|PP|SS|JJ)')",
    "hitlist": "SELECT DISTINCT utt_id, session_id FROM search_master WHERE year = '2020' OR utt_seq = '1'",
    "located": f"""WITH {_INV}, f AS (SELECT regexp_replace(utt_id, '(?i)\\.textgrid$', '') AS utt_id, ext AS layer, CASE ext WHEN 'textgrid' THEN 1 WHEN 'bak' THEN 2 ELSE 3 END AS p, path FROM inv WHERE ext IN ('textgrid', 'bak', 'lab')),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY p, path) AS r FROM f) WHERE r = 1), d AS (SELECT DISTINCT utt_id FROM search_master WHERE utt_id IS NOT NULL)
SELECT d.utt_id, coalesce(layer, '') AS layer, coalesce(path, '') AS path, CASE WHEN b.utt_id IS NULL THEN 'not found' ELSE '' END AS note FROM d LEFT JOIN b ON b.utt_id = d.utt_id""",
    "n_insertion": f"""WITH {TOK}, n AS (SELECT *, lead(morph) OVER v AS "right", lead(tag) OVER v AS right_tag, lead(word_idx) OVER v AS rw FROM tok WINDOW v AS (PARTITION BY utt_id ORDER BY word_idx, morph_idx)),
h AS (SELECT *, unicode(right(morph, 1)) - 44032 AS a, unicode(left("right", 1)) - 44032 AS b FROM n WHERE regexp_matches(right(morph, 1), '^[가-힣]$') AND regexp_matches(left("right", 1), '^[가-힣]$'))
SELECT utt_id, word_idx, morph_idx, morph, tag, "right", right_tag, CASE WHEN word_idx = rw THEN 'inside' ELSE 'across' END AS boundary FROM h WHERE a % 28 > 0 AND b // 588 = 11 AND (b % 588) // 28 IN (2, 3, 6, 7, 12, 17, 20) AND substr(right_tag, 1, 1) NOT IN ('J', 'E')""",
    "words_by_set": f"""WITH {UTT}, t AS (SELECT {year('utt_id')} AS year, unnest({words('form')}) AS token FROM u), a AS (SELECT DISTINCT token FROM t WHERE year = '2020'), b AS (SELECT DISTINCT token FROM t WHERE year = '2021')
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'except', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""",
    "top_sessions": f"WITH {_MISSING} SELECT string_split(utt_id, '.')[1] AS session_id, count(*) AS n FROM miss GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "first_sessions": "SELECT DISTINCT session_id, utt_id FROM search_master WHERE session_id IN (SELECT DISTINCT session_id FROM search_master ORDER BY 1 LIMIT 3)",
    "seeded_sample": f"WITH {UTT} SELECT utt_id FROM u ORDER BY md5('42:' || utt_id), utt_id LIMIT 100",
    "event_props": "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "pron_compare": f"""WITH p AS (SELECT utt_id, {words('max(form)')} AS f, {words('max(pron_pred_hangul)')} AS p FROM search_master WHERE utt_id IS NOT NULL GROUP BY utt_id)
SELECT utt_id, len(f)::BIGINT AS words, len(list_filter(range(1, len(f) + 1), lambda i: f[i] = p[i]))::BIGINT AS same FROM p WHERE len(f) = len(p)""",
    "orders_master": f"WITH {_ORDERS} SELECT * FROM om",
    "orders_stratified": f"""WITH {_ORDERS}, l AS (SELECT o_orderstatus, 'segment' AS dim, segment AS stratum FROM om UNION ALL SELECT o_orderstatus, 'region', region FROM om UNION ALL SELECT o_orderstatus, 'segment_region', segment || '×' || region FROM om)
SELECT o_orderstatus, dim, stratum, count(*) AS freq, count(*) / sum(count(*)) OVER (PARTITION BY dim, stratum) * 1e6 AS per_million FROM l GROUP BY 1, 2, 3""",
}
