"""DuckDB SQL of the queries that SQL can express, over whole tables.

None for packing, the two queries of tokenizers, secret spans (SQL gives no match positions), language profiles and
the pipeline: the tests hold these against plain Python versions.
"""

from __future__ import annotations

from . import licenses, quality, urls

WORDS = "[x for x in string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') if x <> '']"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(_text(x) if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


def _js(p: str, q: str, keys: str) -> str:
    """Jensen-Shannon distance per document over shares p and q in a table of one row per document and bin."""
    part = lambda x: f"CASE WHEN {x} > 0 THEN {x} * log2({x} / (({p} + {q}) / 2)) ELSE 0 END"
    return f"SELECT {keys}, sqrt(greatest(0, sum({part(p)} + {part(q)}) / 2)) AS js"


def _quality() -> str:
    spellings = [(s, lang, w) for lang, ws in quality.COMMON_WORDS.items() for w in ws for c in {w, w.capitalize(), w.upper()} for m in ("", *".,;:!?") for s in [c + m]]
    classes = {
        "lower": "a-z", "upper": "A-Z", "digit": "0-9", "point": ".,;:''\"!?()\\-", "symbol": "#*$%&|<>", "space": "\\x20\\x09-\\x0D",
    }
    counted = ", ".join(f"length(regexp_replace(t, '[^{c}]', '', 'g')) AS c_{n}" for n, c in classes.items())
    every = [*classes, "letter", "rest"]
    return f"""WITH sp(s, lang, word) AS (VALUES {_rows(sorted(set(spellings)))}),
d AS (SELECT doc_id, lang, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
c0 AS (SELECT doc_id, lang, len(ws) AS n, length(t) AS chars, {counted}, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) - length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS c_letter FROM d),
c1 AS (SELECT *, chars - c_lower - c_upper - c_letter - c_digit - c_point - c_symbol - c_space AS c_rest FROM c0),
cl AS (UNPIVOT (SELECT doc_id, lang, n, chars, {', '.join(f'CAST(c_{x} AS BIGINT) AS {x}' for x in every)} FROM c1) ON {', '.join(every)} INTO NAME bin VALUE k),
cr AS (SELECT lang, bin, sum(k) / sum(sum(k)) OVER (PARTITION BY lang) AS q FROM cl WHERE n >= 50 GROUP BY lang, bin),
cj AS ({_js('(k / chars)', 'q', 'doc_id')} FROM cl JOIN cr USING (lang, bin) WHERE chars >= {quality.MIN_CHARS_JS} GROUP BY doc_id),
w AS (SELECT doc_id, lang, unnest(ws) AS s FROM d),
wf AS (SELECT doc_id, sp.word AS bin, count(*) AS k FROM w JOIN sp USING (lang, s) GROUP BY 1, 2),
wl AS (SELECT c.doc_id, c.lang, c.n, b.word AS bin, coalesce(k, 0) AS k FROM c0 c JOIN (SELECT DISTINCT lang, word FROM sp) b USING (lang) LEFT JOIN wf ON wf.doc_id = c.doc_id AND wf.bin = b.word),
wa AS (SELECT * FROM wl UNION ALL SELECT doc_id, lang, n, '*', n - sum(k) FROM wl GROUP BY doc_id, lang, n),
wr AS (SELECT lang, bin, sum(k) / sum(sum(k)) OVER (PARTITION BY lang) AS q FROM wa WHERE n >= 50 GROUP BY lang, bin),
wj AS ({_js('(k / n)', 'q', 'doc_id')} FROM wa JOIN wr USING (lang, bin) WHERE n >= {quality.MIN_WORDS_JS} GROUP BY doc_id),
ix AS (SELECT doc_id, unnest(generate_series(1, len(ws) - 2)) AS i, ws FROM d WHERE len(ws) > 2),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS k FROM ix),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE k > 1) GROUP BY 1),
ln AS (SELECT doc_id, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS ls FROM d),
f AS (SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words, cj.js AS cjs, wj.js AS wjs FROM d JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN cj USING (doc_id) LEFT JOIN wj USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce(cjs, 0) <= {quality.MAX_CLASS_JS} AND coalesce(wjs, 0) <= {quality.MAX_WORD_JS} AS kept FROM f"""


_REACH = """lk AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT DISTINCT a, a AS b FROM lk UNION SELECT reach.a, lk.b FROM reach JOIN lk ON reach.b = lk.a),
comp AS (SELECT a AS id, min(b) AS c FROM reach GROUP BY 1)"""

_JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 4))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)), {_REACH}
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp ON comp.id = d.doc_id"""

_VECTORS = f"""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pairs AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93), {_REACH},
deg AS (SELECT a AS id, count(*) AS n FROM lk GROUP BY 1)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept FROM v LEFT JOIN comp ON comp.id = vec_id LEFT JOIN deg ON deg.id = vec_id"""

_URLS = f"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
s(rule, verdict, rh, rp) AS (VALUES ('net/', 'block', 'net', '/'), ('example.net/en/', 'allow', 'example.net', '/en/'), ('example.com/de/', 'block', 'example.com', '/de/'), ('org/fr/', 'allow', 'org', '/fr/')),
w(word) AS (VALUES ('spam-farm'), ('cheap-pills'), ('casino'), ('free-casino'), ('poker'), ('viagra'), ('porn'), ('xxx'), ('payday-loans'), ('click-bait'), ('torrent'), ('warez')),
p(pattern) AS (VALUES {_rows([(r.name,) for r in urls.PATTERN_RULES])}),
x AS (SELECT pattern, '(?is)' || CASE WHEN starts_with(pattern, '||') THEN '^([^/]*[.])?' ELSE '' END
  || replace(replace(replace(trim(pattern, '|'), '.', '[.]'), '*', '.*'), '^', '([^a-z0-9]|\\z)') || CASE WHEN ends_with(pattern, '|') THEN '\\z' ELSE '' END AS regex FROM p),
fits AS (SELECT page_id, 1 AS rank, rule, verdict FROM h JOIN s ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  UNION ALL SELECT page_id, 0, 'word:' || word, 'block' FROM h JOIN w ON regexp_matches(host || path, '(^|[^a-z0-9])(?i:' || replace(word, '-', '[^a-z0-9]+') || ')([^a-z0-9]|$)')
  UNION ALL SELECT page_id, 0, pattern, 'block' FROM h JOIN x ON regexp_matches(host || path, regex)),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, length(rule) DESC, rule DESC) AS k FROM fits)
SELECT page_id, host, path, CASE WHEN rank = 1 THEN rule END AS rule, coalesce(verdict, 'allow') AS verdict, CASE WHEN rank = 0 THEN rule END AS pattern FROM h LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (page_id)"""

_MIX = f"""WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS w FROM d GROUP BY source),
c AS (SELECT *, 2.0 * source_size AS cap, (1.5 * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) OVER o, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER o, 0)) AS lv
  FROM s WINDOW o AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, CASE WHEN cap <= w * lv THEN cap ELSE w * first(lv) OVER (ORDER BY cap <= w * lv, cap / w, source NULLS LAST) END AS target FROM c),
f AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS times FROM t),
r AS (SELECT d.*, source_size, target, times, target - times * source_size AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY h) AS after, sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target, CAST(size * (times + CASE WHEN after < rest OR (rest > 0 AND after - own < rest AND abs(after - rest) <= abs(after - own - rest)) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""

_NORMAL = f"[x for x in [lower(trim(y, {_text(licenses.MARKS)})) for y in {WORDS}] if x <> '']"
_LICENSES = f"""WITH t(name, text) AS (VALUES {_rows([(t.name, t.text) for t in licenses.TEMPLATES])}),
ts AS (SELECT DISTINCT name, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT name, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM (SELECT name, {_NORMAL} AS ws FROM t))),
ds AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM (SELECT doc_id, {_NORMAL} AS ws FROM documents) WHERE len(ws) > 4)),
hit AS (SELECT doc_id, name, 100.0 * count(*) / any_value(n) AS percent FROM ds JOIN ts USING (g) JOIN (SELECT name, count(*) AS n FROM ts GROUP BY 1) USING (name) GROUP BY 1, 2 HAVING 100.0 * count(*) / any_value(n) >= 75),
by_doc AS (SELECT doc_id, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names, max(percent) AS best FROM hit GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_licenses, coalesce(names, '') AS licenses, CAST(best AS DOUBLE) AS best_percent FROM documents d LEFT JOIN by_doc USING (doc_id)"""

_ESCAPED = r"replace(replace(replace(replace(replace({0}, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'), '[/INST]', '[\/INST]')"
_CHAT = f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(20 + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""

_SPELLING = r"""WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
    runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS k
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{7,}')) AS run FROM documents) GROUP BY 1, 2),
    hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(id) + 1 + strlen(run)), lambda i: CAST('0x' || substr(hex(encode(id || ':' || run)), 2 * i + 1, 2) AS BIGINT))),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM runs, crc),
    v AS (SELECT CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n FROM hashed GROUP BY 1 HAVING length(word) >= 7 AND sum(k) >= 2),
    less AS (SELECT word, i, word[:i - 1] || word[i + 1:] AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
    longer AS (SELECT DISTINCT a.word, b.word AS other FROM less a JOIN v b ON a.d = b.word),
    near AS (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.d = b.d AND a.i = b.i AND a.word <> b.word UNION SELECT word, other FROM longer UNION SELECT other, word FROM longer),
    best AS (SELECT near.word, count(*) AS n_near, max(o.n) AS m, arg_min(o.word, (-o.n, encode(o.word))) AS other FROM near JOIN v o ON o.word = near.other GROUP BY 1),
    form AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN other END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
    way AS (SELECT word, form, form AS root FROM form WHERE form IS NOT NULL UNION ALL SELECT w.word, w.form, f.form FROM way w JOIN form f ON f.word = w.root WHERE f.form IS NOT NULL),
    last AS (SELECT word, root FROM way WHERE root NOT IN (SELECT word FROM form WHERE form IS NOT NULL))
    SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM form LEFT JOIN last USING (word)"""

ORACLE_SQL: dict[str, str] = {
    "op2_quality_divergence": _quality(),
    "op3_ngram_jaccard": _JACCARD,
    "op4_embedding_lsh": _VECTORS,
    "op5_url_rules": _URLS,
    "op6_source_mix": _MIX,
    "op7_license_scan": _LICENSES,
    "op9_chat_format": _CHAT,
    "op13_spelling_variants": _SPELLING,
}
