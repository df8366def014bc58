"""SQL of the queries in `corpus`."""

from utterlake.plans.sql import GOLD, ROMAN, TAGGED, arr, resolved, word_ids

#: Utterances with their resolved speaker: utt_id, session_id, year, speaker, t0.
SPOKEN = f"""sm0 AS (SELECT utt_id, session_id, year, loaded_at AS t0, speaker_id FROM search_master WHERE utt_id IS NOT NULL), {resolved('sm0', 'spoken', 'session_id')}"""
_REPORT = f"""{SPOKEN},
utt AS (SELECT utt_id, any_value(year) AS year, any_value(session_id) AS session_id, any_value(speaker) AS speaker, min(t0) AS t0 FROM spoken GROUP BY 1),
ref AS (SELECT 'speaker_id' AS ref_field, utt_id AS row_key, year, year || '|' || speaker AS key, t0 FROM utt WHERE speaker <> '' AND speaker NOT LIKE '#%'
  UNION ALL SELECT 'utt_id', utt_id, '20' || substr(utt_id, 5, 2), utt_id, t0 FROM utt UNION ALL SELECT 'file_id', session_id, '20' || substr(session_id, 5, 2), session_id, min(t0) FROM utt GROUP BY session_id),
exist AS (SELECT 'speaker_id' AS ref_field, year || '|' || id AS key, loaded_at, deleted_at FROM speakers_normalized UNION ALL SELECT 'utt_id', utt_id, loaded_at, deleted_at FROM bareun_raw UNION ALL SELECT 'file_id', file_id, loaded_at, deleted_at FROM file_meta),
e AS (SELECT ref_field, key, min(loaded_at) FILTER (WHERE deleted_at IS NULL) AS live, count(*) AS n FROM exist GROUP BY 1, 2),
rep AS (SELECT r.ref_field, row_key, year, CASE WHEN n IS NULL THEN 'missing' WHEN live IS NULL THEN 'deleted' WHEN live > t0 THEN 'late' END AS state FROM ref r LEFT JOIN e ON e.ref_field = r.ref_field AND e.key = r.key)"""

_FILE = "string_split(path, '/')[-1]"
#: Complete records of the small files: text between quotes is literal, outside them commas part fields and line ends part records.
_RECORDS = f"""df AS (SELECT path, modified_at, content, lower(regexp_extract({_FILE}, '\\.([^.]*)$', 1)) AS ext, regexp_replace(regexp_extract({_FILE}, '^(.*)\\.[^.]*$', 1), '( ?\\([0-9]+\\)| ?- ?[Cc]opy( ?\\([0-9]+\\))?)$', '') AS stem FROM tiny_files WHERE coalesce(content, '') <> '' AND NOT regexp_matches({_FILE}, '^[_.]')),
cq AS (SELECT path, modified_at, string_split(regexp_replace(content, '^\\x{{FEFF}}+', ''), '"') AS q FROM df WHERE ext = 'csv'),
cr AS (SELECT path, modified_at, string_split(array_to_string(list_transform(range(1, len(q) + 1), lambda i: CASE WHEN i % 2 = 0 THEN q[i] ELSE replace(regexp_replace(q[i], '\\r\\n|\\n|\\r', chr(2), 'g'), ',', chr(1)) END), ''), chr(2)) AS recs FROM cq),
ch AS (SELECT path, modified_at, recs[2:] AS recs, list_transform(string_split(recs[1], chr(1)), lambda h: trim(h)) AS head FROM cr),
cf AS (SELECT path, modified_at, head, string_split(unnest(recs), chr(1)) AS f FROM ch WHERE list_contains(head, 'utt_id')),
cs AS (SELECT 'search_master' AS layer, trim(f[list_position(head, 'utt_id')]) AS utt_id, path, modified_at FROM cf WHERE len(f) = len(head)),
tx AS (SELECT path, modified_at, trim(stem) AS utt_id, replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM df WHERE ext = 'textgrid' AND contains(content, 'ooTextFile') AND contains(content, 'TextGrid')),
tc AS (SELECT *, try_cast(regexp_extract(t, '(?m)^[ \\t]*size[ \\t]*=[ \\t]*([0-9]+)[ \\t]*$', 1) AS INT) AS tiers, len(regexp_extract_all(t, '(?m)^[ \\t]*item[ \\t]*\\[[0-9]+\\]')) AS items,
  list_transform(regexp_extract_all(t, 'intervals[ \\t]*:[ \\t]*size[ \\t]*=[ \\t]*([0-9]+)[ \\t]*\\n', 1), lambda x: x::INT) AS sizes, len(regexp_extract_all(t, '(?m)^[ \\t]*intervals[ \\t]*\\[[0-9]+\\][ \\t]*:?\\s*xmin\\s*=\\s*[-0-9.eE]+\\s*xmax\\s*=\\s*[-0-9.eE]+\\s*text\\s*=\\s*"(?:[^"]|"")*"[ \\t]*$')) AS cells FROM tx),
rec AS (SELECT * FROM cs UNION ALL SELECT 'textgrid_eojeol', utt_id, path, modified_at FROM tc WHERE tiers = items AND items = len(sizes) AND cells = coalesce(list_sum(sizes), 0))"""

SQL = {
    "p5_found": f"WITH {_RECORDS} SELECT layer, utt_id, arg_max(path, (coalesce(modified_at, TIMESTAMP '0001-01-01'), path)) AS path FROM rec WHERE utt_id <> '' GROUP BY 1, 2",
    "p1_found": f"""WITH {GOLD}
SELECT 'sentence' AS layer, sentence_id, 0::INT AS item_no, 0::INT AS arg_no, '' AS word_id FROM sent
UNION ALL SELECT 'mp', sentence_id, item_no, 0, coalesce(array_to_string({word_ids('e')}, '|'), '') FROM mp
UNION ALL SELECT 'wsd', sentence_id, item_no, 0, coalesce(array_to_string({word_ids('e')}, '|'), '') FROM wsd
UNION ALL SELECT 'srl', sentence_id, item_no, 0, coalesce(({word_ids('p')})[1], '') FROM (SELECT *, ({arr("e->'$.predicate'")})[1] AS p FROM srl)
UNION ALL SELECT 'srl_arg', sentence_id, item_no, arg_no, unnest(CASE WHEN len({word_ids('e')}) = 0 THEN [''] ELSE list_distinct({word_ids('e')}) END) FROM arg""",
    "p4_found": f"WITH {_REPORT} SELECT ref_field, row_key, state FROM rep WHERE state IS NOT NULL",
    "p4_counts": f"WITH {_REPORT} SELECT ref_field, year, state, count(*) AS n FROM rep WHERE state IS NOT NULL GROUP BY 1, 2, 3",
    "p6_found": f"WITH {TAGGED}, {ROMAN} SELECT 'tagged' AS field, k AS utt_id, word_idx, part_idx, value FROM tv UNION ALL SELECT 'pron_pred_roman', k, word_idx, part_idx, value FROM rv",
}
