"""SQL of the queries in `tiers`."""

from utterlake.plans.layers_sql import grid_rows
from utterlake.plans.sql import ROMAN, SENSES, WORDS

_NAME = "string_split(path, '/')[-1]"
_SILENT = "text IN ('', 'sil', 'sp', 'spn', '<eps>', '<unk>')"
_GRIDS = f"""nf AS (SELECT path, modified_at, content, regexp_replace(regexp_extract({_NAME}, '^(.*)\\.[^.]*$', 1), ' ?\\([0-9]+\\)$', '') AS utt_id FROM tiny_files WHERE lower(path) LIKE '%.textgrid' AND NOT regexp_matches({_NAME}, '^[_.]') AND content IS NOT NULL),
ng AS (SELECT utt_id, arg_max(content, (coalesce(modified_at, TIMESTAMP '0001-01-01'), path)) AS content FROM nf WHERE utt_id <> '' GROUP BY 1),
{grid_rows('ng', 'utt_id')},
dr AS (SELECT utt_id, max(xmax) AS dur FROM grid GROUP BY 1)"""


def _mirror(values: str, tier: str, out: str) -> str:
    """A tier of tokens (utt_id, value, toks) on the words."""
    return f"""{out}_v AS (SELECT * FROM {values} JOIN dr USING (utt_id)),
{out} AS (SELECT utt_id, '{tier}' AS tier, xmin, xmax, CASE WHEN sound THEN toks[rk::BIGINT] ELSE '' END AS text, false AS warned FROM wr JOIN {out}_v USING (utt_id) WHERE len(toks) = n
  UNION ALL SELECT utt_id, '{tier}', 0.0::DOUBLE, dur, '[align≠]' || value, true FROM {out}_v JOIN (SELECT DISTINCT utt_id, n FROM wr) USING (utt_id) WHERE len(toks) <> n)"""


_ENRICHED = f"""{_GRIDS}, {WORDS}, {ROMAN},
wr AS (SELECT utt_id, idx, xmin, xmax, NOT {_SILENT} AS sound, sum(CASE WHEN {_SILENT} THEN 0 ELSE 1 END) OVER (PARTITION BY utt_id ORDER BY idx) AS rk, sum(CASE WHEN {_SILENT} THEN 0 ELSE 1 END) OVER (PARTITION BY utt_id) AS n FROM grid WHERE tier = 'words'),
rw AS (SELECT k, word_idx, string_agg(value, ' _ ' ORDER BY part_idx) AS x FROM rv GROUP BY 1, 2), rl AS (SELECT k AS utt_id, string_agg(x, ' | ' ORDER BY word_idx) AS value, list(x ORDER BY word_idx) AS toks FROM rw GROUP BY 1),
tw AS (SELECT k, word_idx, string_agg(value, '+' ORDER BY part_idx) AS x FROM uv GROUP BY 1, 2), tl AS (SELECT k AS utt_id, string_agg(x, ' ' ORDER BY word_idx) AS value, list(x ORDER BY word_idx) AS toks FROM tw GROUP BY 1),
{_mirror('rl', 'phones', 'mph')}, {_mirror('tl', 'morphemes', 'mmo')},
er AS (SELECT utt_id, 'words' AS tier, xmin, xmax, CASE WHEN {_SILENT} THEN '' ELSE text END AS text, false AS warned FROM grid WHERE tier = 'words' UNION ALL SELECT * FROM mph UNION ALL SELECT * FROM mmo
  UNION ALL SELECT dr.utt_id, 'utterance', 0.0::DOUBLE, dur, coalesce(form, ''), false FROM dr LEFT JOIN u ON u.utt_id = dr.utt_id)"""
_LACKS = lambda t: f"count(*) FILTER (WHERE NOT list_contains(tiers, '{t}')) AS no_{t}"
_LE = lambda at, n: "||".join(f"upper(lpad(to_hex((({n}) >> {8 * i}) & 255), 2, '0'))" for i in range(at))

SQL = {
    "enriched_tiers": f"WITH {_ENRICHED} SELECT * FROM er",
    "tier_gaps": f"WITH {_ENRICHED}, g AS (SELECT utt_id, list(DISTINCT tier) AS tiers FROM er GROUP BY 1) SELECT count(*) AS n, {_LACKS('words')}, {_LACKS('phones')}, {_LACKS('morphemes')} FROM g",
    "stitched_tiers": f"""WITH {_GRIDS}, o AS (SELECT utt_id, string_split(utt_id, '.')[1] AS session_id, dur, coalesce(sum(dur) OVER (PARTITION BY string_split(utt_id, '.')[1] ORDER BY try_cast(string_split(utt_id, '.')[-1] AS INT), utt_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS off FROM dr),
tt AS (SELECT session_id, max(off + dur) AS total FROM o GROUP BY 1), w AS (SELECT session_id, xmin + off AS xmin, xmax + off AS xmax, text, total FROM grid JOIN o USING (utt_id) JOIN tt USING (session_id) WHERE tier = 'words'),
c AS (SELECT *, coalesce(max(xmax) OVER (PARTITION BY session_id ORDER BY xmin, xmax, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE) AS cur, lead(xmax) OVER (PARTITION BY session_id ORDER BY xmin, xmax, text) IS NULL AS last FROM w),
t AS (SELECT session_id, cur AS xmin, greatest(xmin, cur) AS xmax, '' AS text FROM c UNION ALL SELECT session_id, greatest(xmin, cur), greatest(xmax, greatest(xmin, cur)), text FROM c UNION ALL SELECT session_id, greatest(xmax, greatest(xmin, cur)), total, '' FROM c WHERE last)
SELECT session_id, round(xmin, 6) AS xmin, round(xmax, 6) AS xmax, text FROM t WHERE xmax - xmin > 1e-6""",
    "contained_words": f"""WITH {_GRIDS}, p AS (SELECT utt_id, idx AS pi, xmin AS b, xmax AS e FROM grid WHERE tier = 'utterance') SELECT g.utt_id, g.idx, g.xmin, g.xmax, g.text, pi AS parent_idx FROM grid g JOIN p ON p.utt_id = g.utt_id AND (g.xmin + g.xmax) / 2 >= b AND (g.xmin + g.xmax) / 2 < e WHERE g.tier = 'words'""",
    "speech_rates": f"""WITH {_GRIDS}, s AS (SELECT utt_id, max(xmax) - min(xmin) AS dur, coalesce(sum(xmax - xmin) FILTER (WHERE tier = 'words' AND {_SILENT}), 0.0::DOUBLE) AS pause, count(*) FILTER (WHERE tier = 'words' AND NOT {_SILENT}) AS n_words FROM grid GROUP BY 1)
SELECT utt_id, round(dur, 6) AS dur, round(pause, 6) AS pause, n_words, round(CASE WHEN dur > pause THEN n_words / (dur - pause) END, 6) AS rate FROM s""",
    "spn_ratio": f"WITH {_GRIDS} SELECT utt_id, count(*) FILTER (WHERE text = 'spn') AS spn, count(*) FILTER (WHERE text <> '') AS labels, CASE WHEN count(*) FILTER (WHERE text <> '') > 0 THEN count(*) FILTER (WHERE text = 'spn') / count(*) FILTER (WHERE text <> '') END AS ratio FROM grid WHERE tier = 'words' GROUP BY 1",
    "pron_index": f"""WITH {SENSES}, x AS (SELECT CASE WHEN pos IN ('VV', 'VA') THEN form || '다' ELSE form END AS word, pos, coalesce(try_cast(sense AS INT), 999) AS n FROM ws WHERE pos IS NOT NULL),
y AS (SELECT word, pos, n, word AS pron, 0 AS stem FROM x UNION ALL SELECT left(word, len(word) - 1), pos, n, word, 1 FROM x WHERE pos IN ('VV', 'VA', 'VX', 'VCP', 'VCN', 'XSV', 'XSA') AND word LIKE '%다' AND len(word) > 1)
SELECT word, pos, arg_min(pron, (stem, n, pron)) AS pron FROM y GROUP BY 1, 2""",
    "stream_minutes": "SELECT strftime(ts, '%Y-%m-%d %H:%M') AS minute, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "wav_headers": f"""WITH f AS (SELECT DISTINCT path, size_bytes * 2 AS data_bytes FROM tiny_files)
SELECT path, data_bytes, '52494646' || {_LE(4, 'data_bytes + 36')} || '57415645666D74201000000001000100803E0000007D00000200100064617461' || {_LE(4, 'data_bytes')} AS header, round(data_bytes / 32000, 6) AS seconds FROM f""",
}
