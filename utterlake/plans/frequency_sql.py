"""SQL of the queries in `frequency`."""

from utterlake.plans.frequency import YEARS
from utterlake.functions.hangul import CODA_SPELLED, ONSET_ROMAN, VOWEL_ROMAN, ipa_map
from utterlake.plans.sql import ARGUMENTS, DP, GOLD, MP, PAIRS, SENSES, SRL, TOK, VALUES, WORD, ZA, resolved, words, year

_PIVOT = ", ".join(f"count(*) FILTER (WHERE {year('utt_id')} = '{y}') AS freq_{y}" for y in YEARS) + ", count(*) AS freq_total"
_REG = """CASE WHEN len(p) >= 3 THEN replace(p[2], '대화', '') || '-' || p[3] WHEN array_to_string(p, '>') = '' THEN '미상' ELSE array_to_string(p, '>') END"""
_STRATA = f"""{TOK}, {resolved('u', 'us', "string_split(utt_id, '.')[1]")},
spk AS (SELECT year, id, sex_norm AS sex, age_norm AS age FROM (SELECT *, row_number() OVER (PARTITION BY year, id ORDER BY loaded_at DESC NULLS LAST, sex_norm DESC NULLS LAST, age_norm DESC NULLS LAST) AS r FROM speakers_normalized WHERE deleted_at IS NULL) WHERE r = 1),
meta0 AS (SELECT file_id, category, row_number() OVER (PARTITION BY file_id ORDER BY loaded_at DESC NULLS LAST, doc_id DESC NULLS LAST, category DESC NULLS LAST) AS r FROM file_meta WHERE deleted_at IS NULL),
meta1 AS (SELECT file_id, list_filter(list_transform(string_split(coalesce(category, ''), '>'), lambda x_: regexp_replace(x_, '\\s+', '', 'g')), lambda x_: x_ <> '') AS p FROM meta0 WHERE r = 1),
meta AS (SELECT file_id, {_REG} AS reg FROM meta1),
j AS (SELECT morph, tag, coalesce(nullif(reg, ''), '미상') AS reg, coalesce(nullif(sex, ''), '미상') AS sex, coalesce(nullif(age, ''), '미상') AS age
  FROM tok JOIN us USING (utt_id) LEFT JOIN spk ON spk.id = us.speaker AND spk.year = {year('tok.utt_id')} LEFT JOIN meta ON meta.file_id = string_split(tok.utt_id, '.')[1]),
long AS (SELECT morph, tag, 'reg' AS dim, reg AS stratum FROM j UNION ALL SELECT morph, tag, 'sex', sex FROM j UNION ALL SELECT morph, tag, 'age', age FROM j UNION ALL SELECT morph, tag, 'sex_age', sex || '×' || age FROM j),
totals AS (SELECT dim, stratum, count(*) AS tokens FROM long GROUP BY ALL)"""
_TYPE = "CASE WHEN sentence_id LIKE 'SDRW%' THEN '구어' ELSE '문어' END"
_TOP = "ana AS (SELECT surface, analysis AS top_analysis, n FROM (SELECT surface, analysis, count(*) AS n, row_number() OVER (PARTITION BY surface ORDER BY count(*) DESC, analysis) AS r FROM pairs GROUP BY surface, analysis) WHERE r = 1)"
_ML = f"ml AS (SELECT form, label, {_TYPE} AS corpus_type, count(*) AS freq FROM gmp WHERE coalesce(form, '') <> '' GROUP BY ALL)"
_WORDS = f"""{WORD},
mw AS (SELECT gword.form AS word_surface, gword.sentence_id, coalesce(string_agg(gmp.form || '/' || gmp.label, '+' ORDER BY gmp.item_no), '') AS morpheme_analysis
  FROM gword LEFT JOIN gmp ON gmp.file_id = gword.file_id AND gmp.doc_no = gword.doc_no AND gmp.sent_no = gword.sent_no AND gmp.word_id = gword.id GROUP BY gword.file_id, gword.doc_no, gword.sent_no, gword.item_no, gword.form, gword.sentence_id),
mlw AS (SELECT word_surface, morpheme_analysis, {_TYPE} AS corpus_type, count(*) AS freq FROM mw WHERE coalesce(word_surface, '') <> '' GROUP BY ALL)"""
_NORMS = f"""{SENSES},
lex AS (SELECT form AS morph, pos AS tag, list_sort(list(DISTINCT coalesce(nullif(regexp_replace(sense, '^0+', ''), ''), '1'))) AS senses FROM ws WHERE {year('sentence_id')} <= '2022' AND pos IS NOT NULL GROUP BY 1, 2),
per AS (SELECT form AS word, pos, sense, sum(1) FILTER (WHERE {year('sentence_id')} = '2023')::BIGINT AS sx, count(*) AS al FROM ws WHERE {year('sentence_id')} > '2022' GROUP BY 1, 2, 3),
ls AS (SELECT word, pos, arg_min(sense, (-sx, sense)) FILTER (WHERE sx IS NOT NULL) AS sx_sense, max(sx) / sum(sx) AS sx_share, arg_min(sense, (-al, sense)) AS all_sense, max(al) / sum(al) AS all_share FROM per GROUP BY 1, 2)"""
_DECIDED = f"""{_NORMS}, {VALUES},
types AS (SELECT morph, tag, count(*) AS freq FROM val GROUP BY 1, 2),
dec AS (SELECT t.morph, t.tag, freq, senses, all_sense, all_share, substr(t.tag, 1, 1) IN ('J', 'E', 'S') AS nt, coalesce(len(senses), 0) AS n, sx_sense, sx_share FROM types t LEFT JOIN lex USING (morph, tag) LEFT JOIN ls ON ls.word = t.morph AND ls.pos = t.tag),
d AS (SELECT morph, tag, senses, CASE WHEN nt THEN '' WHEN n = 1 THEN senses[1] WHEN sx_sense IS NOT NULL THEN sx_sense WHEN all_sense IS NOT NULL THEN all_sense ELSE '' END AS sense_id,
  CASE WHEN nt THEN NULL WHEN n = 1 THEN 1.0::DOUBLE WHEN sx_sense IS NOT NULL THEN sx_share WHEN all_sense IS NOT NULL THEN all_share END AS confidence,
  CASE WHEN nt THEN 'not_target' WHEN n = 1 THEN 'monosemous' WHEN sx_sense IS NOT NULL THEN 'ls_sxls' WHEN all_sense IS NOT NULL THEN 'ls_all' WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END AS method,
  CASE WHEN NOT nt AND n > 1 AND sx_sense IS NULL AND all_sense IS NULL THEN array_to_string(senses, '|') ELSE '' END AS candidates FROM dec),
num AS (SELECT morph, tag, (SELECT list(s ORDER BY coalesce(try_cast(s AS INT), 999), s) FROM unnest(senses) AS q(s)) AS ordered FROM lex),
st AS (SELECT val.*, sense_id, confidence, method, candidates, senses FROM val JOIN d USING (morph, tag))"""
_SAME = f"""{GOLD}, {MP}, {TOK},
both_ids AS (SELECT DISTINCT gmp.sentence_id AS utt_id FROM gmp WHERE sentence_id IN (SELECT utt_id FROM tok)),
g AS (SELECT sentence_id AS utt_id, concat_ws('/', form, label) AS item, count(*) AS g FROM gmp WHERE sentence_id IN (SELECT utt_id FROM both_ids) GROUP BY 1, 2),
o AS (SELECT utt_id, concat_ws('/', morph, tag) AS item, count(*) AS o FROM tok WHERE utt_id IN (SELECT utt_id FROM both_ids) GROUP BY 1, 2),
gs AS (SELECT sentence_id AS utt_id, list(concat_ws('/', form, label) ORDER BY item_no, concat_ws('/', form, label)) AS gl FROM gmp GROUP BY 1),
os AS (SELECT utt_id, list(concat_ws('/', morph, tag) ORDER BY word_idx, morph_idx) AS ol FROM tok GROUP BY 1),
mt0 AS (SELECT utt_id, sum(coalesce(g, 0))::BIGINT AS gold, sum(coalesce(o, 0))::BIGINT AS ours, sum(least(coalesce(g, 0), coalesce(o, 0)))::BIGINT AS tp FROM g FULL JOIN o USING (utt_id, item) GROUP BY utt_id),
mt AS (SELECT utt_id, gold, ours, tp, gl = ol AS same FROM mt0 JOIN gs USING (utt_id) JOIN os USING (utt_id)),
gf AS (SELECT sentence_id AS utt_id, max(s->>'$.form') AS gform FROM sent GROUP BY 1),
mf AS (SELECT mt.*, (trim(coalesce(gform, '')) = trim(coalesce(form, '')))::VARCHAR AS same_form FROM mt JOIN gf USING (utt_id) JOIN u USING (utt_id))"""
_ROMAN1 = "array_to_string(list_filter([{o}[(unicode(ch) - 44032) // 588 + 1], {v}[((unicode(ch) - 44032) % 588) // 28 + 1], {c}[(unicode(ch) - 44032) % 28 + 1]], lambda x_: x_ <> ''), ' ')".format(
    **{k: "[" + ", ".join(f"'{x}'" for x in xs) + "]" for k, xs in (("o", ONSET_ROMAN), ("v", VOWEL_ROMAN), ("c", CODA_SPELLED))}
)
_SPELLED = f"CASE WHEN regexp_full_match(form, '[가-힣]+') THEN array_to_string(list_transform(string_split(form, ''), lambda ch: {_ROMAN1}), ' - ') ELSE '' END"
_IPA_MAP = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in ipa_map().items()) + "}"
_IPA_OF = f"array_to_string(list_filter(list_transform(string_split(roman_mfa, '-'), lambda s_: array_to_string(list_transform(list_filter(string_split(s_, ' '), lambda q_: q_ <> ''), lambda t_: coalesce({_IPA_MAP}[t_], '⟨' || t_ || '⟩')), '')), lambda s_: s_ <> ''), '.')"
_Y = year("sentence_id")
_N = lambda cond: f"count(*) FILTER (WHERE {cond})"
_NORM_FILES = f"""{MP}, {_ML},
nmp AS (SELECT form AS morph, label AS tag, {_N(_Y + " <= '2021'")} AS mp_spoken, {_N(_Y + " > '2021'")} AS mp_written, max({_SPELLED}) AS mp_roman FROM gmp WHERE coalesce(form, '') <> '' AND coalesce(label, '') <> '' AND {_Y} <= '2022' GROUP BY 1, 2),
nls AS (SELECT form AS morph, pos AS tag, {_N(_Y + " = '2023'")} AS ls_spoken, count(*) AS ls_all, max({_SPELLED}) AS ls_roman FROM ws WHERE coalesce(pos, '') <> '' GROUP BY 1, 2),
nml AS (SELECT form AS morph, label AS tag, sum(CASE WHEN corpus_type = '구어' THEN freq ELSE 0 END)::BIGINT AS ml_spoken, sum(CASE WHEN corpus_type = '문어' THEN freq ELSE 0 END)::BIGINT AS ml_written FROM ml GROUP BY 1, 2),
nfo AS (SELECT form AS morph, label AS tag, {_N(_Y + " > '2022'")} AS freq_all, {_N(_Y + " <= '2020'")} AS freq_young, {_N(_Y + " = '2021'")} AS freq_child, {_N(_Y + " = '2022'")} AS freq_elderly FROM gmp WHERE coalesce(form, '') <> '' AND label IS NOT NULL GROUP BY 1, 2),
nlx AS (SELECT form AS morph, max({_SPELLED}) AS lex_roman FROM ws WHERE pos IS NOT NULL GROUP BY 1),
net AS (SELECT form AS morph, pos AS tag, substr(pos, 1, 1) AS etym_type, array_to_string(list_sort(list(DISTINCT sense))[1:3], '|') AS etym_origin FROM ws WHERE coalesce(pos, '') <> '' GROUP BY 1, 2)"""

SQL = {
    "morph_positions": f"WITH {TOK} SELECT * FROM tok",
    "morph_freq": f"WITH {TOK} SELECT morph, tag, count(*) AS freq FROM tok GROUP BY 1, 2",
    "morph_freq_by_year": f"WITH {TOK} SELECT morph, tag, {_PIVOT} FROM tok GROUP BY 1, 2",
    "eojeol_freq": f"WITH {PAIRS} SELECT surface, analysis, count(*) AS n FROM pairs GROUP BY 1, 2",
    "eojeol_top_analysis": f"WITH {PAIRS}, {_TOP} SELECT * FROM ana",
    "type_token_summary": f"WITH {TOK} SELECT count(*) AS tokens, count(DISTINCT (morph, tag)) AS types FROM tok",
    "token_freq": f"WITH t AS (SELECT unnest({words('text')}) AS token FROM documents) SELECT token, count(*) AS freq FROM t GROUP BY 1",
    "top_tokens": f"WITH t AS (SELECT unnest({words('text')}) AS token FROM documents) SELECT token, count(*) AS freq FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30",
    "split_modes": f"SELECT doc_id, len({words('text')})::BIGINT AS words, len(string_split(text, ' '))::BIGINT AS pieces FROM documents",
    "morph_stratified": f"WITH {_STRATA} SELECT morph, tag, dim, stratum, count(*) AS freq, count(*) / any_value(tokens) * 1e6 AS per_million FROM long JOIN totals USING (dim, stratum) GROUP BY 1, 2, 3, 4",
    "strata_totals": f"WITH {_STRATA} SELECT * FROM totals",
    "morph_dispersion": f"WITH {TOK} SELECT morph, tag, count(DISTINCT string_split(utt_id, '.')[1]) AS n_docs FROM tok GROUP BY 1, 2",
    "gold_mp": f"WITH {GOLD}, {MP} SELECT * FROM gmp",
    "gold_wsd": f"WITH {SENSES} SELECT * FROM gwsd",
    "gold_dp": f"WITH {GOLD}, {DP} SELECT * FROM gdp",
    "gold_za": f"WITH {GOLD}, {ZA} SELECT * FROM gza",
    "gold_srl": f"WITH {GOLD}, {SRL} SELECT * FROM gsrl",
    "gold_words": f"WITH {GOLD}, {WORD} SELECT * FROM gword",
    "gold_index": f"WITH {GOLD} SELECT file_id, doc_no, sent_no, sentence_id, s->>'$.form' AS form, s->>'$.speaker_id' AS speaker_id FROM sent",
    "gold_arguments": f"WITH {GOLD}, {ARGUMENTS} SELECT * FROM garg",
    "gold_membership": f"WITH {GOLD} SELECT DISTINCT file_id, CASE WHEN file_id IN (SELECT string_split(sentence_id, '.')[1] FROM sent) THEN 'True' ELSE 'False' END AS in_gold FROM file_meta WHERE file_id IS NOT NULL",
    "morph_dictionary": f"""WITH {_DECIDED}, {_NORM_FILES},
yr AS (SELECT morph, tag, {_PIVOT} FROM tok GROUP BY 1, 2), cs AS (SELECT morph, tag, n, senses, all_sense, all_share, nt FROM dec),
r AS (SELECT yr.*, coalesce(mp_spoken, 0) AS mp_spoken, coalesce(mp_written, 0) AS mp_written, coalesce(ls_spoken, 0) AS ls_spoken, coalesce(ls_all, 0) AS ls_all, coalesce(ml_spoken, 0) AS ml_spoken, coalesce(ml_written, 0) AS ml_written,
  coalesce(freq_all, 0) AS freq_all, coalesce(freq_young, 0) AS freq_young, coalesce(freq_child, 0) AS freq_child, coalesce(freq_elderly, 0) AS freq_elderly, round(log10(nullif(freq_all, 0)), 4) AS four_log10, coalesce(etym_type, '') AS etym_type, coalesce(etym_origin, '') AS etym_origin,
  CASE WHEN n = 1 THEN senses[1] WHEN all_sense IS NOT NULL THEN all_sense WHEN n > 1 THEN ordered[1] ELSE '' END AS sense_id, CASE WHEN n = 1 THEN 1.0::DOUBLE WHEN all_sense IS NOT NULL THEN all_share END AS sense_conf,
  CASE WHEN n = 1 THEN 'monosemous' WHEN all_sense IS NOT NULL THEN 'ls' WHEN n > 1 THEN 'lex_first(' || array_to_string(ordered, '|') || ')' WHEN nt THEN 'not_target' ELSE 'not_found' END AS sense_method,
  coalesce(nullif(mp_roman, ''), nullif(ls_roman, ''), lex_roman, '') AS roman, coalesce(nullif(mp_roman, ''), nullif(ls_roman, ''), lex_roman, '') AS roman_mfa
  FROM yr LEFT JOIN cs USING (morph, tag) LEFT JOIN num USING (morph, tag) LEFT JOIN nmp USING (morph, tag) LEFT JOIN nls USING (morph, tag) LEFT JOIN nml USING (morph, tag) LEFT JOIN nfo USING (morph, tag) LEFT JOIN net USING (morph, tag) LEFT JOIN nlx USING (morph))
SELECT *, {_IPA_OF} AS ipa FROM r""",
    "eojeol_dictionary": f"""WITH {PAIRS}, {_TOP}, {GOLD}, {WORD},
yr AS (SELECT surface AS eojeol, {_PIVOT} FROM pairs GROUP BY 1),
nmp AS (SELECT form AS eojeol, {_N(_Y + " <= '2021'")} AS mp_spoken, {_N(_Y + " > '2021'")} AS mp_written, max({_SPELLED}) AS mp_roman FROM gword WHERE coalesce(form, '') <> '' AND {_Y} <= '2022' GROUP BY 1),
nls AS (SELECT form AS eojeol, {_N(_Y + " = '2023'")} AS ls_spoken, {_N(_Y + " <> '2023'")} AS ls_written, max({_SPELLED}) AS ls_roman FROM gword WHERE coalesce(form, '') <> '' AND {_Y} > '2022' GROUP BY 1),
r AS (SELECT yr.*, top_analysis, coalesce(mp_spoken, 0) AS mp_spoken, coalesce(mp_written, 0) AS mp_written, coalesce(ls_spoken, 0) AS ls_spoken, coalesce(ls_written, 0) AS ls_written, coalesce(nullif(mp_roman, ''), nullif(ls_roman, ''), '') AS roman, coalesce(nullif(mp_roman, ''), nullif(ls_roman, ''), '') AS roman_mfa
  FROM yr JOIN ana ON surface = eojeol LEFT JOIN nmp USING (eojeol) LEFT JOIN nls USING (eojeol)) SELECT *, {_IPA_OF} AS ipa FROM r""",
    "ml_morph_freq": f"WITH {GOLD}, {MP}, {_ML} SELECT * FROM ml",
    "ml_word_freq": f"WITH {GOLD}, {MP}, {_WORDS} SELECT * FROM mlw",
    "ml_sense_freq": f"WITH {SENSES} SELECT form AS word, sense AS sense_id, pos, {_TYPE} AS corpus_type, count(*) AS freq FROM ws GROUP BY ALL",
    "norm_join": f"""WITH {TOK}, f AS (SELECT morph, tag, count(*) AS freq FROM tok GROUP BY 1, 2), {GOLD}, {MP}, {_ML},
n AS (SELECT form AS morph, label AS tag, sum(CASE WHEN corpus_type = '구어' THEN freq ELSE 0 END)::BIGINT AS sp, sum(CASE WHEN corpus_type = '문어' THEN freq ELSE 0 END)::BIGINT AS wr FROM ml GROUP BY 1, 2)
SELECT morph, tag, freq, coalesce(sp, 0) AS freq_ml_spoken, coalesce(wr, 0) AS freq_ml_written FROM f LEFT JOIN n USING (morph, tag)""",
    "fallback_analysis": f"""WITH {PAIRS}, {_TOP}, {GOLD}, {MP}, {_WORDS},
ga AS (SELECT word_surface, morpheme_analysis FROM (SELECT *, row_number() OVER (PARTITION BY word_surface ORDER BY n DESC, morpheme_analysis) AS r FROM (SELECT word_surface, morpheme_analysis, count(*) AS n FROM mlw WHERE morpheme_analysis <> '' GROUP BY 1, 2)) WHERE r = 1),
t AS (SELECT DISTINCT unnest({words('form')}) AS token FROM u)
SELECT token, coalesce(nullif(top_analysis, ''), morpheme_analysis, '') AS analysis FROM t LEFT JOIN ana ON ana.surface = token LEFT JOIN ga ON ga.word_surface = token""",
    "sense_norms": f"WITH {_NORMS} SELECT * FROM ls",
    "sense_layer": f"WITH {_DECIDED} SELECT utt_id, word_idx, morph_idx, morph, tag, sense_id, confidence, method, candidates FROM st",
    "sense_redecided": f"""WITH {_DECIDED}, r AS (SELECT morph, tag, candidates, CASE WHEN method IN ('not_found', 'ambiguous') AND len(ordered) >= 1 THEN ordered[1] ELSE sense_id END AS sense_id,
CASE WHEN method IN ('not_found', 'ambiguous') AND len(ordered) = 1 THEN 'lex_mono' WHEN method IN ('not_found', 'ambiguous') AND len(ordered) > 1 THEN 'lex_first' ELSE method END AS method FROM st LEFT JOIN num USING (morph, tag))
SELECT morph, tag, sense_id, method, candidates, count(*) AS n FROM r GROUP BY ALL""",
    "method_share": f"WITH {_DECIDED} SELECT method, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM st GROUP BY method",
    "sense_dictionary": f"""WITH {_DECIDED} SELECT morph, tag, freq, CASE WHEN n = 1 THEN senses[1] WHEN all_sense IS NOT NULL THEN all_sense WHEN n > 1 THEN ordered[1] ELSE '' END AS sense_id,
CASE WHEN n = 1 THEN 1.0::DOUBLE WHEN all_sense IS NOT NULL THEN all_share END AS confidence,
CASE WHEN n = 1 THEN 'monosemous' WHEN all_sense IS NOT NULL THEN 'ls' WHEN n > 1 THEN 'lex_first(' || array_to_string(ordered, '|') || ')' WHEN nt THEN 'not_target' ELSE 'not_found' END AS method FROM dec LEFT JOIN num USING (morph, tag)""",
    "sense_freq_by_year": f"""WITH {_DECIDED}, lc AS (SELECT word AS morph, pos AS tag, sense AS sense_id, sum(coalesce(sx, 0))::BIGINT AS freq_ls_spoken, sum(al)::BIGINT AS freq_ls_all FROM per GROUP BY 1, 2, 3), y AS (SELECT morph, tag, sense_id, method, max(confidence) AS confidence, {_PIVOT} FROM st GROUP BY 1, 2, 3, 4)
SELECT y.*, coalesce(freq_ls_spoken, 0) AS freq_ls_spoken, coalesce(freq_ls_all, 0) AS freq_ls_all FROM y LEFT JOIN lc USING (morph, tag, sense_id)""",
    "etymology": "WITH b AS (SELECT p_brand, list_sort(list(DISTINCT string_split(p_type, ' ')[1])) AS k, list_sort(list(DISTINCT p_type)) AS o FROM part GROUP BY 1) SELECT p_brand, CASE WHEN len(k) = 1 THEN k[1] ELSE '혼합(' || array_to_string(k, '|') || ')' END AS kind, array_to_string(o[1:3], '|') AS origins FROM b",
    "morph_matches": f"WITH {_SAME} SELECT * FROM mt",
    "morph_scores": f"""WITH {_SAME}, s AS (SELECT coalesce(same_form, 'total') AS same_form, sum(gold)::BIGINT AS gold, sum(ours)::BIGINT AS ours, sum(tp)::BIGINT AS tp, count(*) AS keys, count(*) FILTER (WHERE gold = tp AND ours = tp) AS exact, count(*) FILTER (WHERE same) AS sequences FROM mf GROUP BY ROLLUP (same_form))
SELECT same_form, gold, ours, tp, keys, exact, sequences, tp / ours AS precision, tp / gold AS recall, 2 * (tp / ours) * (tp / gold) / (tp / ours + tp / gold) AS f1 FROM s""",
    "sense_accuracy": f"""WITH {_DECIDED}, o AS (SELECT utt_id, morph, tag, arg_min(sense_id, (word_idx, morph_idx)) AS sense_id, arg_min(method, (word_idx, morph_idx)) AS method FROM st GROUP BY 1, 2, 3),
a AS (SELECT coalesce(o.method, 'absent') AS method, ws.sense = coalesce(o.sense_id, '') AS ok FROM ws LEFT JOIN o ON o.utt_id = ws.sentence_id AND o.morph = ws.form AND o.tag = ws.pos)
SELECT coalesce(method, 'total') AS method, count(*) AS n, count(*) FILTER (WHERE ok) AS ok FROM a GROUP BY ROLLUP (method)""",
}
