"""Building blocks of the SQL that checks the queries: tokens, packed fields, gold annotation."""

from __future__ import annotations

from utterlake.functions.text import WS

EDGE = rf"[{WS}\x{{FEFF}}\x{{200B}}]+"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{EDGE}|{EDGE}$', '', 'g')"


def words(x: str) -> str:
    """Python's str.split()."""
    return f"list_filter(string_split_regex(coalesce({x}, ''), '[{WS}]+'), lambda x_: x_ <> '')"


_VALUES_DESC = ", ".join(f"{c} DESC NULLS LAST" for c in ("loaded_at", "form", "tagged", "speaker_id", "n_morphs"))
UTT = f"u AS (SELECT utt_id, form, tagged, speaker_id, n_morphs FROM (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY {_VALUES_DESC}) AS rn_ FROM bareun_raw WHERE utt_id IS NOT NULL) WHERE rn_ = 1)"

_LABEL = "regexp_replace(upper(translate(coalesce(speaker_id, ''), '０１２３４５６７８９ＳＤＰＫ', '0123456789SDPK')), '[^0-9A-Z가-힣]+', '', 'g')"
_NUMBER = "try_cast(nullif(regexp_extract(label, '^(?:화자|SPK|P)?0*([1-9][0-9]{0,3})$', 1), '') AS INT)"


def resolved(source: str, name: str, session: str) -> str:
    """CTEs that end in ``name``: the source and the id of its speaker, '' or a ``#`` number where the label names none."""
    return f"""{name}_ids AS (SELECT file_id AS sp_file, max(speaker_ids) AS sp_ids FROM file_meta GROUP BY 1),
{name}_lab AS (SELECT *, {session} AS sp_session, {_LABEL} AS label FROM {source}),
{name} AS (SELECT * EXCLUDE (sp_file, sp_ids, sp_session, label), CASE WHEN {_NUMBER} IS NULL THEN label ELSE coalesce(nullif(trim(string_split(sp_ids, '|')[{_NUMBER}]), ''), '#' || {_NUMBER}) END AS speaker FROM {name}_lab LEFT JOIN {name}_ids ON sp_file = sp_session)"""


def year(x: str) -> str:
    return f"'20' || substr(string_split({x}, '.')[1], 5, 2)"


def _unquote(source: str, name: str, q: str) -> str:
    lit = q.replace("'", "''")
    return f"""{name} AS (SELECT k, CASE WHEN regexp_matches(s, '^\\[?[{WS}]*{lit}') AND len(p) >= 3 AND len(p) % 2 = 1
  AND list_aggregate(list_transform(range(1, len(p) + 1, 2), lambda i: regexp_matches(p[i], '^[\\[\\],\\s]*$')), 'bool_and')
  THEN array_to_string(list_transform(range(1, len(p) + 1), lambda i: CASE WHEN i % 2 = 0 THEN p[i] WHEN i = 1 OR i = len(p) THEN '' WHEN p[i] = '' THEN '{lit}' ELSE chr(1) END), '')
  ELSE s END AS s FROM (SELECT k, s, string_split(s, '{lit}') AS p FROM {source}))"""


def packed(table: str, key: str, column: str, rules: list[tuple[str, str]], parts: str, name: str) -> str:
    """CTEs that end in ``name`` (k, word_idx, part_idx, value). parts: SQL over w that cuts a word into a list."""

    def rule(x: str) -> str:
        for pattern, to in rules:
            x = f"regexp_replace({x}, '{pattern}', {to}, 'g')"
        return x

    n = name
    return f"""{n}0 AS (SELECT {key} AS k, {strip('max(' + column + ')')} AS s FROM {table} WHERE {key} IS NOT NULL GROUP BY {key} HAVING max({column}) IS NOT NULL),
{_unquote(n + '0', n + '1', '"')},
{_unquote(n + '1', n + '2', "'")},
{n}3 AS (SELECT k, CASE WHEN contains(s, '"') THEN array_to_string(list_transform(range(1, len(string_split(s, '"')) + 1), lambda i: CASE WHEN i % 2 = 0 THEN string_split(s, '"')[i] ELSE {rule("string_split(s, chr(34))[i]")} END), '') ELSE {rule('s')} END AS s FROM {n}2),
{n}4 AS (SELECT k, list_filter(list_transform(string_split(s, chr(1)), lambda w: list_filter({parts}, lambda v: v <> '')), lambda w: len(w) > 0) AS ws FROM {n}3),
{n}5 AS (SELECT k, unnest(ws) AS w, unnest(range(1, len(ws) + 1))::INT AS word_idx FROM {n}4),
{n} AS (SELECT k, word_idx, unnest(range(1, len(w) + 1))::INT AS part_idx, unnest(w) AS value FROM {n}5)"""


TAGGED = packed(
    "bareun_raw", "utt_id", "tagged",
    [(rf"(/[A-Z]{{1,5}})[{WS}]*[+＋;][{WS}]*", r"'\1' || chr(2)"), (rf"(/[A-Z]{{1,5}})[{WS}]*,[{WS}]*", r"'\1' || chr(1)"), (rf"[{WS}|]+", "chr(1)")],
    f"list_transform(string_split(w, chr(2)), lambda z: {strip('z')})", "tv",
)
ROMAN = packed(
    "search_master", "utt_id", "pron_pred_roman", [(r"[|/;\t\r\n]+", "chr(1)")],
    f"CASE WHEN regexp_matches(w, '^[{WS}]*[∅_-][{WS}]*$') THEN ['∅'] ELSE list_transform(string_split_regex(w, '[_.-]'), lambda z: trim(regexp_replace(z, '[{WS}]+', ' ', 'g'))) END", "rv",
)
_SPLIT = [(rf"(/[A-Z]{{1,5}})[{WS}]*[+＋;][{WS}]*", r"'\1' || chr(2)"), (rf"(/[A-Z]{{1,5}})[{WS}]*,[{WS}]*", r"'\1' || chr(1)"), (rf"[{WS}|]+", "chr(1)")]
#: Tokens of the utterances ``u``, in any convention of the tagged field.
SPLIT_WORDS = packed("u", "utt_id", "tagged", _SPLIT, f"list_transform(string_split(w, chr(2)), lambda z: {strip('z')})", "uv")
WORDS = f"{UTT}, {SPLIT_WORDS}"
TOK = f"""{WORDS},
tok AS (SELECT k AS utt_id, word_idx, part_idx AS morph_idx, regexp_extract(value, '(?s)^(.*)/([^/]*)$', 1) AS morph, regexp_extract(value, '(?s)^(.*)/([^/]*)$', 2) AS tag FROM uv)"""
PAIRS = f"""{WORDS},
pw AS (SELECT k, word_idx, string_agg(value, '+' ORDER BY part_idx) AS a FROM uv GROUP BY 1, 2),
pl AS (SELECT k, list(a ORDER BY word_idx) AS t FROM pw GROUP BY 1),
l AS (SELECT utt_id, {words('form')} AS f, t FROM u JOIN pl ON k = utt_id),
pairs AS (SELECT utt_id, unnest(f) AS surface, unnest(t) AS analysis FROM l WHERE len(f) = len(t))"""
VALUES = f"{TOK}, val AS (SELECT * FROM tok)"


def arr(x: str) -> str:
    """A JSON value as a list: a lone value is one item, null none."""
    x = f"({x})"
    return f"CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN []::JSON[] WHEN json_type({x}) = 'ARRAY' THEN json_extract({x}, '$[*]') ELSE [{x}] END"


def word_ids(x: str) -> str:
    ids = arr(x + "->'$.word_id'")
    return f"list_transform({ids}, lambda q_: (q_->>'$'))"


_K = "file_id, doc_no, sent_no, sentence_id"
_no = "unnest(range(1, len(l) + 1))::INT"


def _layer(name: str, field: str) -> str:
    return f"""{name}_l AS (SELECT {_K}, {arr(f"s->'$.{field}'")} AS l FROM sent),
{name} AS (SELECT {_K}, {_no} AS item_no, unnest(l) AS e FROM {name}_l)"""


def _ids(x: str) -> str:
    return f"coalesce(array_to_string({word_ids(x)}, '|'), '')"


GOLD = f"""readable AS (SELECT file_id, received_at, regexp_replace(body, '^[\\x{{FEFF}}\\s]+', '') AS b FROM sxml WHERE file_id IS NOT NULL AND body IS NOT NULL),
newest AS (SELECT file_id, arg_max(b, received_at)::JSON AS j FROM readable WHERE json_valid(b) AND json_type(CASE WHEN json_valid(b) THEN b ELSE 'null' END) = 'OBJECT' GROUP BY file_id),
docs_l AS (SELECT file_id, {arr("j->'$.document'")} AS l FROM newest),
docs AS (SELECT file_id, {_no} AS doc_no, unnest(l) AS d FROM docs_l),
sents_l AS (SELECT file_id, doc_no, {arr("d->'$.sentence'")} AS l FROM docs),
sents AS (SELECT file_id, doc_no, {_no} AS sent_no, unnest(l) AS s FROM sents_l),
sent AS (SELECT file_id, doc_no, sent_no, coalesce(s->>'$.id', '') AS sentence_id, s FROM sents WHERE json_type(s) = 'OBJECT'),
{_layer('mp', 'MP')}, {_layer('wsd', 'WSD')}, {_layer('srl', 'SRL')}, {_layer('wd', 'word')}, {_layer('dp', 'DP')}, {_layer('za', 'ZA')},
arg_l AS (SELECT {_K}, item_no, ({arr("e->'$.predicate'")})[1] AS p, list_concat({arr("e->'$.argument'")}, {arr("e->'$.adjunct'")}) AS l, len({arr("e->'$.argument'")}) AS n_arg FROM srl),
arg AS (SELECT {_K}, item_no, p, n_arg, {_no} AS arg_no, unnest(l) AS e FROM arg_l)"""
MP = f"gmp AS (SELECT {_K}, item_no, {_ids('e')} AS word_id, e->>'$.form' AS form, e->>'$.label' AS label FROM mp)"
WSD = f"gwsd AS (SELECT {_K}, item_no, {_ids('e')} AS word_id, e->>'$.form' AS form, e->>'$.pos' AS pos, e->>'$.sense_id' AS sense_id FROM wsd)"
DP = f"gdp AS (SELECT {_K}, item_no, {_ids('e')} AS word_id, e->>'$.word_form' AS word_form, e->>'$.head' AS head, e->>'$.label' AS label FROM dp)"
WORD = f"gword AS (SELECT {_K}, item_no, e->>'$.id' AS id, e->>'$.form' AS form FROM wd)"
_PRED = f"coalesce(({word_ids('p')})[1], '')"
SRL = f"""gsrl AS (SELECT {_K}, item_no, {_PRED} AS word_id, p->>'$.form' AS form, p->>'$.lemma' AS lemma, p->>'$.sense_id' AS sense_id FROM (SELECT *, ({arr("e->'$.predicate'")})[1] AS p FROM srl))"""
ARGUMENTS = f"""garg AS (SELECT {_K}, item_no, arg_no, CASE WHEN arg_no <= n_arg THEN 'argument' ELSE 'adjunct' END AS role, e->>'$.form' AS form, e->>'$.label' AS label,
  coalesce(array_to_string(list_filter({word_ids('e')}, lambda x_, i_: list_position({word_ids('e')}, x_) = i_), '|'), '') AS word_ids, {_PRED} AS predicate_word_id, p->>'$.lemma' AS predicate_lemma, p->>'$.sense_id' AS predicate_sense_id FROM arg)"""
ZA = f"""ze_l AS (SELECT {_K}, item_no, ({arr("e->'$.predicate'")})[1] AS p, {arr("e->'$.ellipsis'")} AS l FROM za),
za_p AS (SELECT {_K}, item_no, p, {_no} AS arg_no, unnest(l) AS e FROM ze_l),
za_r AS (SELECT *, ({arr("e->'$.restored'")})[1] AS r, ({arr("e->'$.antecedent'")})[1] AS a FROM za_p),
gza AS (SELECT {_K}, item_no, arg_no, p->>'$.form' AS form, {_PRED} AS word_id, r->>'$.form' AS restored_form, r->>'$.type' AS restored_type, a->>'$.form' AS antecedent_form, a->>'$.sentence_id' AS antecedent_sentence_id FROM za_r)"""
SENSES = f"{GOLD}, {WSD}, ws0 AS (SELECT *, coalesce(nullif(regexp_replace(sense_id, '^0+', ''), ''), '0') AS sense FROM gwsd WHERE coalesce(form, '') <> '' AND sense_id IS NOT NULL), ws AS (SELECT * FROM ws0 WHERE sense NOT IN ('777', '888', '999'))"
