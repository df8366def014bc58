"""SQL that gives the rows of the queries in `registry`."""

from utterlake.functions.text import INVISIBLE, WS
from utterlake.plans.corpus_sql import SPOKEN
from utterlake.plans.layers_sql import _micros
from utterlake.plans.sql import TAGGED, words

_I = INVISIBLE.replace(r"\x{0000}-", r"\x{0001}-")
_ENDS = r"^[\p{P}\p{S}]+|[\p{P}\p{S}]+$"
_TERMS = f"""{TAGGED},
f0 AS (SELECT utt_id, nfc_normalize(regexp_replace(coalesce(max(form), ''), '[{_I}]+', '', 'g')) AS form FROM bareun_raw WHERE utt_id IS NOT NULL GROUP BY 1),
f1 AS (SELECT utt_id, unnest({words('form')}) AS w FROM f0),
t AS (SELECT 'form' AS field, regexp_replace(w, '{_ENDS}', '', 'g') AS term, utt_id FROM f1 UNION ALL SELECT 'tagged', value, k FROM tv),
c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT utt_id) AS records FROM t WHERE term <> '' GROUP BY 1, 2),
mk AS (SELECT *, CASE WHEN records <= 1 THEN 'rare' WHEN records > 0.02 * (SELECT count(*) FROM f0) THEN 'common' END AS mark FROM c)"""
# Notes of sounds and time marks stand between a pair of brackets or asterisks; hesitation sounds as the statement lists them, each also drawn out.
_PAIRS = [("(", ")"), ("（", "）"), ("<", ">"), ("[", "]"), ("{", "}"), ("【", "】"), ("*", "*")]
_NOTES = "|".join(f"[{a}][{a}][^{c}]*[{b}][{b}]" for a, b, c in (("(", ")", "()"), ("（", "）", "（）"))) + "|" + "|".join(f"[{a}][^{c}]*[{b}]" for a, b, c in ((a, b, (a + b).replace("[", r"\[").replace("]", r"\]")) for a, b in _PAIRS)).replace("[[]", r"\[").replace("[]]", r"\]")
_HESITATION = "(" + "|".join(rf"{x}+" for x in ("아", "어", "그", "엄", "에")) + r"|으*음+|으+|흐*음+|흠+|uh+m*|u+m+|e+r+m*|a+h+|h+m+|mm+)"
_EDGES = r"^[^\p{L}\p{N}&]+|[^\p{L}\p{N}&]+$"
_TURNS = f"""{SPOKEN},
txt AS (SELECT utt_id, max(original_form) AS o FROM dialogue_json GROUP BY 1),
s0 AS (SELECT session_id, sm.utt_id, any_value(speaker) AS speaker, min({_micros('start')}) AS b, coalesce(any_value(o), max(sm.original_form), '') AS o FROM search_master sm JOIN (SELECT DISTINCT utt_id, speaker FROM spoken) USING (utt_id) LEFT JOIN txt ON txt.utt_id = sm.utt_id GROUP BY 1, 2),
s1 AS (SELECT *, string_split(utt_id, '.')[-1]::BIGINT AS num, len(list_filter(list_transform({words(f"regexp_replace(regexp_replace(o, '[{_I}]+', '', 'g'), '{_NOTES}', ' ', 'g')")}, lambda w: regexp_replace(w, '{_EDGES}', '', 'g')), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}]') AND NOT regexp_full_match(w, '\\d{{1,3}}(:\\d{{1,2}}){{1,2}}([.,]\\d+)?') AND NOT regexp_full_match(lower(w), '{_HESITATION}'))) > 0 AS content FROM s0),
s2 AS (SELECT *, coalesce(last_value(b IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY num, utt_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS st FROM s1),
s3 AS (SELECT *, CASE WHEN lag(speaker) OVER v IS NULL OR lag(speaker) OVER v <> speaker THEN 1 ELSE 0 END AS new FROM s2 WHERE content WINDOW v AS (PARTITION BY session_id ORDER BY st, num, utt_id)),
s4 AS (SELECT *, (sum(new) OVER (PARTITION BY session_id ORDER BY st, num, utt_id ROWS UNBOUNDED PRECEDING))::INT AS turn_no FROM s3)"""
_LETTERS = lambda c: f"regexp_replace(nfc_normalize(lower(nfc_normalize({c}))), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"

# Statistics of texts, from their definition: lines, words between white space, a word bare of what is neither letter nor digit at its ends; symbols are neither, nor "_".
_W = r"\p{L}\p{N}_"
_TEXT = "replace(replace(replace(replace(regexp_replace(nfc_normalize(coalesce(text, '')), '[\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}\\x{00AD}]', '', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(8232), chr(10)), chr(133), chr(10))"
_STATS = f"""q0 AS (SELECT doc_id, {_TEXT} AS t FROM documents WHERE doc_id IS NOT NULL),
q1 AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM q0),
q2 AS (SELECT doc_id, line, {words('line')} AS ws, len(line) AS ink, len(regexp_replace(line, '[{_W}{WS}]+', '', 'g')) AS symbols FROM q1),
q3 AS (SELECT doc_id, ink, symbols, len(ws) > 0 AS filled, len(ws) > 0 AND regexp_matches(ws[-1], '[.?!…。]+["''”’)\\]*]*$') AS ended, list_filter(list_transform(ws, lambda w: regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')), lambda w: w <> '') AS bare FROM q2),
q4 AS (SELECT doc_id, sum(ink) AS ink, sum(symbols) AS symbols, count(*) FILTER (WHERE filled) AS lines, count(*) FILTER (WHERE ended) AS ended, sum(len(bare)) AS words, sum(list_sum(list_transform(bare, lambda w: len(w)))) AS letters,
  sum(len(list_filter(bare, lambda w: list_contains(cw.l, lower(w))))) AS common FROM q3, (SELECT coalesce(list(DISTINCT lower(word)), []) AS l FROM common_words WHERE word IS NOT NULL) AS cw GROUP BY 1)"""

SQL = {
    "p9_stats": f"WITH {_STATS} SELECT doc_id, words::BIGINT AS words, coalesce(letters / nullif(words, 0), 0.0)::DOUBLE AS mean_word_length, coalesce(symbols / nullif(ink, 0), 0.0)::DOUBLE AS symbol_ratio, coalesce(ended / nullif(lines, 0), 0.0)::DOUBLE AS punctuated_share, coalesce(common / nullif(words, 0), 0.0)::DOUBLE AS common_share FROM q4",
    "p2_counts": f"WITH {_TERMS} SELECT * FROM mk",
    "p2_found": f"WITH {_TERMS} SELECT field, term, mark FROM mk WHERE mark IS NOT NULL",
    "p3_found": f"""WITH {_TURNS} SELECT session_id, turn_no, any_value(speaker) AS speaker_id, arg_min(utt_id, (st, num, utt_id)) AS first_utt_id, arg_max(utt_id, (st, num, utt_id)) AS last_utt_id FROM s4 GROUP BY 1, 2""",
    "p7_found": f"""WITH i AS (SELECT item_id, {_LETTERS('text')} AS t FROM eval_items), g AS (SELECT item_id, substr(t, p, 40) AS gram FROM (SELECT item_id, t, unnest(range(1, greatest(len(t) - 39, 1) + 1)) AS p FROM i WHERE len(t) > 0)),
d AS (SELECT doc_id, {_LETTERS('text')} AS t FROM documents), n AS (SELECT DISTINCT len(gram) AS n FROM g),
h AS (SELECT doc_id, substr(t, p, n) AS gram FROM (SELECT doc_id, t, n, unnest(range(1, len(t) - n + 2)) AS p FROM d, n WHERE len(t) >= n)) SELECT DISTINCT doc_id, item_id FROM h JOIN g USING (gram)""",
    "p8_found": """WITH s AS (SELECT source, sum(n_chars) AS n FROM documents GROUP BY 1) SELECT m.source FROM mix_targets m LEFT JOIN s USING (source) WHERE m.max_repeats * coalesce(n, 0) < m.target_share * (SELECT sum(n_chars) FROM documents)""",
}
