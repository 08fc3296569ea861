"""DuckDB SQL that computes the registered queries by a plain reading of their definitions."""

from __future__ import annotations

import re

#: The search text of the registered queries.
QUERY = "the ration of thering and the nation"
_TERMS = ["the", "ration", "of", "thering", "and", "the", "nation"]

#: Markdown notes for queries whose input the driver's tables don't have.
#: Four kinds of Markdown notes, by doc_id % 4, as pieces: texts as they stand, and in braces what is put in of a document (see ``pieces``).
MARKDOWN = [
    "---\ntitle: Doc {id}\ntags: [{lang}, q3]\nstatus: {source}\ndue: 2026-08-01\n---\n# Launch {id}\n## Timeline\nSee [[docs/{next}|Ideas]] and [[docs/{second}#Auth]] #urgent\n- [ ] ship it \U0001f4c5 2026-08-{day} #launch\n- [x] plan\n## Risks & more\n{text}\n",
    "# Ideas {id}\nBack to [[docs/{before}]]. {open}title{close} {open} date {close} {open}{lang}{close}\n* [ ] call due:2026-07-{day} #phone\n  - [X] old one due:2026-08-11\n- [] not a task\n{text}",
    "---\ntags: api, {lang}\nstatus: draft\n---\nNo heading here. [[{last}#^b1|top]] #draft\n- [ ] write docs\n{text}",
    "---\nstatus: active\n---\n{text}",
]


def pieces(note: str) -> list[tuple[bool, str]]:
    """(is a field, text or name) of a kind of note."""
    return [(i % 2 == 1, part) for i, part in enumerate(re.split(r"\{(\w+)\}", note)) if part]


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_TOKENS = "SELECT {id} AS id, unnest(string_split_regex(lower({text}), '[^a-z0-9]+')) AS token FROM {table}"
_Q = "q AS (SELECT unnest([" + ", ".join(_literal(t) for t in _TERMS) + "]) AS token), qc AS (SELECT token, count(*) AS q FROM q GROUP BY token)"
_NOTES = """notes AS (SELECT 'docs/' || doc_id AS id, regexp_extract(text, '^([^ \\t\\n]+[ \\t\\n]+[^ \\t\\n]+)', 1) AS title, coalesce(text, '') AS content,
  lang, source FROM documents)"""
_COUNTS = f"""counts AS (SELECT id, token, count(*) AS n FROM ({_TOKENS.format(id='id', text="title || ' ' || content", table='notes')}) WHERE token <> '' GROUP BY id, token)"""
_FNV = "list_reduce(list_transform(string_split({f}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, b: (xor(h, b) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT))"
_FEATURES = "list_concat(['w:' || token], list_transform(range(1, len(token) + 1), lambda i: 't:' || substr('#' || token || '#', i, 3)))"
_VECTORS = f"""vocab AS (SELECT DISTINCT token FROM (SELECT token FROM counts UNION ALL SELECT token FROM qc)),
feats AS (SELECT token, unnest({_FEATURES}) AS f FROM vocab),
tb AS (SELECT token, {_FNV.format(f='f')} % 2048 AS bucket, count(*) AS k FROM feats GROUP BY ALL),
vec AS (SELECT id, bucket, sum(n * k) AS tf FROM counts JOIN tb USING (token) GROUP BY id, bucket),
nrm AS (SELECT id, sum(tf * tf) AS d2 FROM vec GROUP BY id)"""
_QVEC = "qv AS (SELECT bucket, sum(q * k) AS qtf FROM qc JOIN tb USING (token) GROUP BY bucket), qn AS (SELECT sum(qtf * qtf) AS q2 FROM qv)"
_SIM = "sem AS (SELECT v.id, CAST(sum(tf * qtf) AS DOUBLE) / (sqrt(CAST(max(q2) AS DOUBLE)) * sqrt(CAST(max(d2) AS DOUBLE))) AS sim FROM vec v JOIN qv USING (bucket) JOIN nrm n ON n.id = v.id CROSS JOIN qn GROUP BY v.id)"
_LEX = "lex AS (SELECT id, sum(q * n) AS lex FROM counts JOIN qc USING (token) GROUP BY id)"
_HYBRID = """hyb AS (SELECT id, 0.5::DOUBLE * (CAST(l AS DOUBLE) / m) + 0.5::DOUBLE * s AS score FROM (
  SELECT coalesce(lex.id, sem.id) AS id, coalesce(lex, 0) AS l, coalesce(sim, 0.0::DOUBLE) AS s, (SELECT max(lex) FROM lex) AS m
  FROM lex FULL JOIN sem ON lex.id = sem.id) WHERE l > 0 OR s >= 0.15)"""


def _snippet(terms_sql: str, content: str) -> str:
    """A snippet in SQL; terms_sql is a list of tokens."""
    flat = f"trim(regexp_replace({content}, '[\\s\\x0b\\x{{85}}\\x{{a0}}]+', ' ', 'g'), ' ')"
    hit = f"coalesce(list_min(list_filter(list_transform({terms_sql}, lambda t: instr(lower({flat}), t)), lambda p: p > 0)), 1) - 1"
    return f"substr({flat}, greatest({hit} - 40, 0) + 1, 240)"


def _greedy(ranked: str, budget: int, by: str = "") -> str:
    """Ids that the walk takes from a relation (r, id, cost[, by]) named ``ranked``."""
    cols = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {cols}unnest(kept) AS id FROM (SELECT {cols}list_reduce(list(struct_pack(c := cost, i := id) ORDER BY r),
      lambda a, x: CASE WHEN a.used + x.c <= {budget} THEN struct_pack(used := a.used + x.c, kept := list_append(a.kept, x.i)) ELSE a END,
      struct_pack(used := CAST(0 AS BIGINT), kept := CAST([] AS VARCHAR[]))).kept AS kept FROM {ranked} {group})"""


_LIST = "[" + ", ".join(_literal(t) for t in _TERMS) + "]"
_MEM = """mem AS (SELECT DISTINCT ON (id) * FROM (SELECT 'mem_' || substr(sha256(type || ' ' || key || ' ' || text || ' ' || origin || ' ' || author), 1, 16) AS id, type, key, origin, text AS content FROM (
  SELECT CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'project' ELSE 'reference' END AS type, CASE role WHEN 'user' THEN 'human' ELSE 'agent' END AS author,
    conv_id || '|' || role AS key, 'turn/' || turn AS origin, text FROM conversations)))"""
_MEMSCORE = f"""ms AS (SELECT id, count(*) AS score FROM ({_TOKENS.format(id='id', text='content', table='mem')}) JOIN q USING (token) GROUP BY id)"""
_RETRIEVED = f"""hits AS (SELECT id, count(*) AS score FROM ({_TOKENS.format(id='doc_id', text='text', table='documents')}) JOIN q USING (token) GROUP BY id HAVING count(*) >= 5),
got AS (SELECT lang, doc_id AS id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tc FROM documents JOIN hits ON hits.id = doc_id),
want AS (SELECT lang, doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))"""
_PRF = """sums AS (SELECT coalesce(g.lang, w.lang) AS lang, count(g.id) AS got, count(w.id) AS want, count(CASE WHEN g.id IS NOT NULL AND w.id IS NOT NULL THEN 1 END) AS hit
  FROM got g FULL JOIN want w ON g.lang = w.lang AND g.id = w.id GROUP BY 1),
pr AS (SELECT lang, CASE WHEN got > 0 THEN hit::DOUBLE / got WHEN want = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS precision, CASE WHEN want > 0 THEN hit::DOUBLE / want ELSE 1.0::DOUBLE END AS recall FROM sums),
prf AS (SELECT lang, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0::DOUBLE END AS f1 FROM pr)"""
_EDGES = """e AS (SELECT 'nations/' || n.n_name AS src, 'regions/' || r.r_name AS dst, 0 AS pos FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE n.n_nationkey < 20
  UNION ALL SELECT 'nations/' || a.n_name, 'nations/' || b.n_name, 1 FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1 WHERE a.n_nationkey < 20)"""
_PRES = "p AS (SELECT CAST(user_id AS VARCHAR) AS device, (epoch_us(ts) // 1000) AS ts, event_type = 'error' AS gone, event_id AS seq, event_type AS note_id FROM events)"
_LAST = "last AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY device ORDER BY ts DESC, seq DESC) = 1)"
_FIELDS = {
    "id": "doc_id", "lang": "lang", "source": "source", "next": "(doc_id + 1)", "second": "(doc_id + 2)", "before": "(doc_id - 1)", "last": "(doc_id - 2)", "day": "lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0')",
    "text": "coalesce(text, '')", "open": "'{{'", "close": "'}}'",
}
_KIND = lambda note: " || ".join(_FIELDS[p] if field else _literal(p) for field, p in pieces(note))
_MD = "md AS (SELECT doc_id, 'docs/' || doc_id || '.md' AS path, CASE doc_id % 4 " + " ".join(f"WHEN {k} THEN {_KIND(note)}" for k, note in enumerate(MARKDOWN)) + " END AS raw FROM documents), "
_MD += """n AS (SELECT replace(path, '.md', '') AS id, doc_id, raw, CASE WHEN starts_with(raw, '---' || chr(10)) THEN regexp_extract(raw, '(?s)^---\\n(.*?)\\n---\\n?(.*)$', 1) END AS fm,
  CASE WHEN starts_with(raw, '---' || chr(10)) THEN regexp_extract(raw, '(?s)^---\\n(.*?)\\n---\\n?(.*)$', 2) ELSE raw END AS content FROM md)"""
_MDLINES = "ln AS (SELECT id, i - 1 AS line, ls[i] AS l FROM (SELECT id, string_split(content, chr(10)) AS ls, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS i FROM n))"
_MDHEAD = """hd AS (SELECT id, line, length(regexp_extract(l, '^(#{1,6})\\s', 1)) AS level, trim(regexp_extract(l, '^#{1,6}\\s+(.*)$', 1)) AS t FROM ln WHERE regexp_matches(l, '^#{1,6}\\s+\\S'))"""
_MDTASK = """tk AS (SELECT id AS note_id, CAST(line AS BIGINT) AS line, rtrim(regexp_extract(l, '^\\s*[-*] \\[([ xX])\\] (.*)$', 2)) AS text, regexp_extract(l, '^\\s*[-*] \\[([ xX])\\] (.*)$', 1) <> ' ' AS done
  FROM ln WHERE regexp_matches(l, '^\\s*[-*] \\[([ xX])\\] (.*)$')),
td AS (SELECT *, nullif(regexp_extract(text, '(?:due:|\\x{1F4C5}\\s*)(\\d{4}-\\d{2}-\\d{2})', 1), '') AS due FROM tk)"""


def all_sql() -> dict[str, str]:
    sql = {
        "tokenize_counts": f"SELECT id AS doc_id, token, count(*) AS n FROM ({_TOKENS.format(id='doc_id', text='text', table='documents')}) WHERE token <> '' GROUP BY ALL",
        "token_estimate": "SELECT doc_id, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens FROM documents",
        "stable_ids": f"WITH {_MEM} SELECT id, type, key, origin FROM mem",
        "search_lexical": f"WITH {_Q}, {_NOTES}, {_COUNTS}, {_LEX} SELECT id AS note_id, CAST(lex AS BIGINT) AS score FROM lex",
        "search_semantic": f"WITH {_Q}, {_NOTES}, {_COUNTS}, {_VECTORS}, {_QVEC}, {_SIM} SELECT id AS note_id, sim AS score FROM sem WHERE sim >= 0.15",
        "search_hybrid": f"WITH {_Q}, {_NOTES}, {_COUNTS}, {_VECTORS}, {_QVEC}, {_SIM}, {_LEX}, {_HYBRID} SELECT id AS note_id, score FROM hyb",
        "search_topk_budget": f"""WITH {_Q}, {_NOTES}, {_COUNTS}, {_VECTORS}, {_QVEC}, {_SIM}, {_LEX}, {_HYBRID},
            top AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS r FROM hyb QUALIFY r <= 20),
            shown AS (SELECT r, id, title, score, {_snippet(_LIST, 'content')} AS snippet FROM top JOIN notes USING (id)),
            priced AS (SELECT *, CAST(ceil(length(snippet) / 4.0) AS BIGINT) AS cost FROM shown), taken AS ({_greedy('priced', 400)})
            SELECT id AS note_id, title, score, snippet, cost AS token_count FROM priced WHERE id IN (SELECT id FROM taken)""",
        "snippets": f"SELECT doc_id, {_snippet(_LIST, 'text')} AS snippet FROM documents",
        "fnv_features": f"""WITH v AS (SELECT DISTINCT token FROM ({_TOKENS.format(id='doc_id', text='text', table='documents')}) WHERE token <> ''),
            f AS (SELECT DISTINCT token, unnest({_FEATURES}) AS feature FROM v)
            SELECT token, feature, {_FNV.format(f='feature')} AS hash, {_FNV.format(f='feature')} % 2048 AS bucket FROM f""",
        "recall_budget": f"""WITH {_Q}, {_MEM}, {_MEMSCORE}, ranked AS (SELECT row_number() OVER (ORDER BY score DESC, mem.id) AS r, mem.id, content, score,
              CAST(ceil(length(content) / 4.0) AS BIGINT) AS cost FROM mem JOIN ms ON mem.id = ms.id WHERE type = 'user'), taken AS ({_greedy('ranked', 900)})
            SELECT id, content, CAST(score AS BIGINT) AS score, cost AS token_count FROM ranked WHERE id IN (SELECT id FROM taken)""",
        "recall_conflicts": f"""WITH {_Q}, {_MEM}, {_MEMSCORE} SELECT key, string_agg(mem.id, ',' ORDER BY mem.id) AS memory_ids FROM mem JOIN ms ON mem.id = ms.id
            GROUP BY key HAVING count(DISTINCT content) > 1""",
        "memory_errors": """SELECT conv_id, turn, role, CASE WHEN role = 'system' THEN 'MISSING_PROVENANCE'
            WHEN (CASE WHEN turn % 5 <> 0 THEN 'user' ELSE role END) NOT IN ('user', 'feedback', 'project', 'reference') THEN 'INVALID_TYPE'
            WHEN turn % 3 = 0 THEN 'INVALID_INPUT' WHEN trim(CASE WHEN turn % 7 = 0 THEN ' ' ELSE text END, ' ') = '' THEN 'INVALID_INPUT'
            WHEN turn % 4 = 0 THEN 'MISSING_PROVENANCE' END AS code FROM conversations""",
        "props_filter": f"""WITH x AS (SELECT 'events/' || event_id AS id, event_type AS title, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CAST(json_extract(props, '$.k') AS VARCHAR) AS ks FROM events),
            ranked AS (SELECT row_number() OVER (ORDER BY id) AS r, id, title,
              CAST(ceil(length('{{"note_id":{{"note_id":"' || id || '"}}}}' || '{{"k":' || ks || '}}') / 4.0) AS BIGINT) AS cost FROM x WHERE k >= 10 AND k < 40 AND k <> 17 QUALIFY r <= 200),
            taken AS ({_greedy('ranked', 1500)}) SELECT id AS note_id, title, cost AS token_count FROM ranked WHERE id IN (SELECT id FROM taken)""",
        "props_sort_desc": """SELECT 'events/' || event_id AS note_id, event_type AS title, '{"k":' || CAST(json_extract(props, '$.k') AS VARCHAR) || '}' AS properties
            FROM events WHERE json_exists(props, '$.k') ORDER BY CAST(json_extract(props, '$.k') AS DOUBLE) DESC, note_id LIMIT 75""",
        "dense_topk": """WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1)
            SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, e), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))), 6) AS score FROM embeddings, q
            ORDER BY list_sum(list_transform(list_zip(embedding, e), lambda z: CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE))) DESC, vec_id LIMIT 25""",
        "graph_links": f"WITH {_EDGES} SELECT src, dst, CAST(pos AS BIGINT) AS pos FROM e",
        "graph_backlinks": f"WITH {_EDGES} SELECT src AS note_id, replace(src, 'nations/', '') AS title FROM e WHERE dst = 'regions/ASIA'",
        "graph_bfs": f"""WITH RECURSIVE {_EDGES}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
            walk AS (SELECT 'nations/NATION_7' AS id, 0 AS depth UNION SELECT b, depth + 1 FROM walk JOIN u ON a = id WHERE depth < 3)
            SELECT id AS note_id, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY id HAVING min(depth) > 0""",
        "graph_orphans": f"WITH {_EDGES}, a AS (SELECT 'regions/' || r_name AS id, r_name AS t FROM region UNION ALL SELECT 'nations/' || n_name, n_name FROM nation) SELECT id AS note_id, t AS title FROM a WHERE id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)",
        "suggest_links": f"""WITH qc AS (SELECT NULL::VARCHAR AS token WHERE false), {_NOTES}, {_COUNTS}, {_VECTORS},
            s AS (SELECT *, ' ' || array_to_string(list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda t: t <> ''), ' ') || ' ' AS hay FROM notes WHERE id = 'docs/1'),
            sv AS (SELECT bucket, tf AS qtf FROM vec WHERE id = 'docs/1'), sn AS (SELECT d2 AS q2 FROM nrm WHERE id = 'docs/1'),
            sem AS (SELECT v.id, CAST(sum(tf * qtf) AS DOUBLE) / (sqrt(CAST(max(q2) AS DOUBLE)) * sqrt(CAST(max(d2) AS DOUBLE))) AS sim FROM vec v JOIN sv USING (bucket) JOIN nrm n ON n.id = v.id CROSS JOIN sn GROUP BY v.id),
            c AS (SELECT n.id, n.title, n.content, s.title AS st, s.content AS sc, coalesce(sim, 0.0::DOUBLE) AS sim, s.hay,
              list_filter(string_split_regex(lower(n.title), '[^a-z0-9]+'), lambda t: t <> '') AS nt, [replace(n.id, 'docs/', '')] AS bt,
              CAST(n.lang = s.lang AS INT) + CAST(n.source = s.source AS INT) AS shared FROM notes n CROSS JOIN s LEFT JOIN sem ON sem.id = n.id WHERE n.id <> 'docs/1'),
            m AS (SELECT *, (length(array_to_string(nt, '')) >= 3 AND contains(hay, ' ' || array_to_string(nt, ' ') || ' ')) OR (length(bt[1]) >= 3 AND contains(hay, ' ' || bt[1] || ' ')) AS men FROM c),
            sc AS (SELECT *, (CASE WHEN men THEN 0.45::DOUBLE ELSE 0.0::DOUBLE END) + 0.3::DOUBLE * sim + 0.15::DOUBLE * (CAST(least(shared, 3) AS DOUBLE) / 3) + 0.0::DOUBLE AS score FROM m),
            top AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS r FROM sc WHERE score >= 0.2 QUALIFY r <= 15),
            shown AS (SELECT r, id, title, score, array_to_string(list_filter([CASE WHEN men THEN 'title_mentioned' END, CASE WHEN sim >= 0.15 THEN 'semantic' END, CASE WHEN shared > 0 THEN 'shared_tags' END], lambda x: x IS NOT NULL), ',') AS reasons,
              CASE WHEN men THEN {_snippet('nt', 'sc')} ELSE {_snippet("list_filter(string_split_regex(lower(st), '[^a-z0-9]+'), lambda t: t <> '')", 'content')} END AS snippet FROM top),
            priced AS (SELECT *, CAST(ceil(length(snippet) / 4.0) AS BIGINT) AS cost FROM shown), taken AS ({_greedy('priced', 600)})
            SELECT id AS note_id, title, score, reasons, snippet, cost AS token_count FROM priced WHERE id IN (SELECT id FROM taken)""",
        "eval_prf1": f"WITH {_Q}, {_RETRIEVED}, {_PRF} SELECT lang, precision, recall, f1 FROM prf",
        "token_efficiency": f"WITH {_Q}, {_RETRIEVED} SELECT lang, CASE WHEN sum(tc) > 0 THEN coalesce(sum(tc) FILTER (id IN (SELECT id FROM want)), 0)::DOUBLE / sum(tc)::DOUBLE ELSE 1.0::DOUBLE END AS efficiency FROM got GROUP BY lang",
        "eval_averages": f"WITH {_Q}, {_RETRIEVED}, {_PRF} SELECT round(avg(precision), 9) AS avg_precision, round(avg(recall), 9) AS avg_recall, round(avg(f1), 9) AS avg_f1 FROM prf",
        "scan_delta": """WITH k AS (SELECT 'n:' || doc_id AS key, sha256(text) AS hash, doc_id FROM documents),
            sh AS (SELECT key, CASE WHEN doc_id % 10 = 0 THEN 'stale' ELSE hash END AS hash FROM k WHERE doc_id % 2 = 0),
            al AS (SELECT * FROM sh UNION ALL SELECT key || '-gone', hash FROM sh WHERE key LIKE '%4')
            SELECT * FROM (SELECT coalesce(k.key, al.key) AS key, CASE WHEN al.key IS NULL THEN 'created' WHEN k.key IS NULL THEN 'deleted' WHEN k.hash <> al.hash THEN 'modified' END AS change
            FROM k FULL JOIN al ON k.key = al.key) WHERE change IS NOT NULL""",
        "log_resume": "SELECT event_id AS seq, props AS body FROM events WHERE event_id > 150",
        "log_compact": "SELECT max(event_id) AS seq, 'snapshot' AS body FROM events WHERE event_id <= 500 GROUP BY user_id UNION ALL SELECT event_id, props FROM events WHERE event_id > 500",
        "snapshot_complete": """SELECT upto, CAST(4 AS BIGINT) AS of FROM (SELECT event_id - event_id % 4 AS upto, event_id % 4 AS idx FROM events)
            WHERE upto % 16 <> 8 OR idx <> 2 GROUP BY upto HAVING count(DISTINCT idx) = 4""",
        "presence_lww": f"WITH {_PRES}, {_LAST} SELECT device, ts, note_id, seq FROM last WHERE NOT gone",
        "presence_ttl": f"WITH {_PRES}, {_LAST} SELECT device, ts FROM last WHERE NOT gone AND (SELECT max(ts) FROM p) - ts <= 86400000",
        "entitlement_fold": """WITH last AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000) DESC, event_id) = 1)
            SELECT user_id AS vault, event_id, CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'trialing' ELSE 'past_due' END AS status, event_id * 1000 AS quota_bytes
            FROM last WHERE event_type IN ('view', 'click', 'purchase')""",
        "quota_join": """WITH u AS (SELECT user_id AS vault, CAST(sum(length(props) * 1000000) AS BIGINT) AS used FROM events GROUP BY user_id)
            SELECT vault, used, coalesce(c_custkey * 1000000, 536870912)::BIGINT AS quota, used < coalesce(c_custkey * 1000000, 536870912) AS accepts
            FROM u LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = vault""",
        "version_diff": """SELECT CAST(o_orderkey AS VARCHAR) AS note_id, CASE WHEN o_orderkey % 3 = 0 THEN 'created' WHEN o_orderkey % 5 = 0 THEN 'deleted' ELSE 'updated' END AS op,
            CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS before, CASE WHEN o_orderkey % 5 <> 0 THEN 'x' || o_orderstatus END AS after FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 5 <> 0""",
        "state_vector": "SELECT user_id % 50 AS item, event_type AS client, max(event_id) AS clock FROM events GROUP BY ALL",
        "tombstones": """WITH e AS (SELECT user_id % 50 AS item, event_type AS client, event_id AS clock FROM events),
            d AS (SELECT item, client, max(clock) AS clock FROM e GROUP BY ALL), t AS (SELECT item, client, max(clock) AS seen FROM e WHERE item % 3 <> 0 AND (item % 7 <> 0 OR client <> 'error') GROUP BY ALL)
            SELECT d.item, bool_and(coalesce(clock <= seen, false)) AND d.item IN (SELECT item FROM t) AS covered FROM d LEFT JOIN t ON d.item = t.item AND d.client = t.client GROUP BY d.item""",
        "pack_parts": """WITH RECURSIVE b AS (SELECT doc_id, coalesce(strlen(text), 0) AS size, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
            w AS (SELECT r, doc_id, size AS used, CAST(0 AS BIGINT) AS part FROM b WHERE r = 1
              UNION ALL SELECT b.r, b.doc_id, CASE WHEN w.used + b.size <= 20000 THEN w.used + b.size ELSE b.size END, CASE WHEN w.used + b.size <= 20000 THEN w.part ELSE w.part + 1 END FROM w JOIN b ON b.r = w.r + 1)
            SELECT doc_id, part FROM w""",
        "budget_by_language": f"""WITH ranked AS (SELECT lang, CAST(doc_id AS VARCHAR) AS id, doc_id, cost, row_number() OVER (PARTITION BY lang ORDER BY cost DESC, doc_id) AS r
              FROM (SELECT lang, doc_id, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS cost FROM documents)), taken AS ({_greedy('ranked', 2500, 'lang')})
            SELECT lang, doc_id, cost FROM ranked WHERE id IN (SELECT id FROM taken)""",
        "note_parse": f"""WITH {_MD}, {_MDLINES}, {_MDHEAD},
            h AS (SELECT id, string_agg(level || ':' || t || ':' || trim(regexp_replace(lower(t), '[^a-z0-9]+', '-', 'g'), '-'), ';' ORDER BY line) AS headings, first(t ORDER BY line) FILTER (level = 1) AS h1 FROM hd GROUP BY id),
            lk AS (SELECT id, list_transform(regexp_extract_all(content, '\\[\\[([^\\]]+)\\]\\]', 1), lambda x: trim(string_split(string_split(x, '|')[1], '#')[1]) || '|' ||
                coalesce(CASE WHEN contains(x, '#') AND NOT contains(x, '#^') THEN trim(regexp_extract(string_split(x, '|')[1], '#(.*)$', 1)) END, '-') || '|' ||
                coalesce(CASE WHEN contains(x, '#^') THEN regexp_extract(string_split(x, '|')[1], '#\\^(.*)$', 1) END, '-') || '|' || coalesce(CASE WHEN contains(x, '|') THEN trim(regexp_extract(x, '\\|(.*)$', 1)) END, '-')) AS ls FROM n),
            tg AS (SELECT id, list_concat(CASE WHEN contains(fm, 'tags: [') THEN string_split(regexp_extract(fm, 'tags: \\[(.*?)\\]', 1), ', ') WHEN contains(fm, 'tags: ') THEN string_split(regexp_extract(fm, 'tags: ([^\\n]*)', 1), ', ') ELSE [] END,
                regexp_extract_all(content, '(?:^|\\s)#([A-Za-z0-9_/-]+)', 1)) AS ts FROM n)
            SELECT n.id, coalesce(nullif(regexp_extract(fm, 'title: ([^\\n]*)', 1), ''), h1, regexp_extract(n.id, '([^/]*)$', 1)) AS title, coalesce(headings, '') AS headings, array_to_string(ls, ';') AS links,
              array_to_string(list_filter(ts, lambda t, i: list_position(ts, t) = i), ',') AS tags, CAST(length(content) AS BIGINT) AS length FROM n LEFT JOIN h ON h.id = n.id JOIN lk ON lk.id = n.id JOIN tg ON tg.id = n.id""",
        "task_extract": f"""WITH {_MD}, {_MDLINES}, {_MDTASK} SELECT note_id, line, text, done, due, array_to_string(regexp_extract_all(text, '(?:^|\\s)#([A-Za-z0-9_/-]+)', 1), ',') AS tags,
            CAST(ceil(length(text) / 4.0) AS BIGINT) + 8 AS token_count FROM td""",
        "note_outline": f"""WITH {_MD}, {_MDLINES}, {_MDHEAD}, o AS (SELECT n.id, coalesce(nullif(regexp_extract(fm, 'title: ([^\\n]*)', 1), ''), first(t ORDER BY line) FILTER (level = 1), regexp_extract(n.id, '([^/]*)$', 1)) AS title,
              coalesce(string_agg(repeat('  ', level - 1) || '- ' || t, chr(10) ORDER BY line), '') AS w FROM n LEFT JOIN hd ON hd.id = n.id GROUP BY n.id, fm),
            c AS (SELECT *, substr(w, 1, 24) AS s FROM o), z AS (SELECT *, length(s) - instr(reverse(s), ' ') AS cut FROM c),
            y AS (SELECT id, title, length(w) > 24 AS truncated, CASE WHEN length(w) <= 24 THEN w ELSE regexp_replace(CASE WHEN instr(s, ' ') > 0 AND cut > 0 THEN substr(s, 1, cut) ELSE s END, '\\s+$', '') END AS content FROM z)
            SELECT id AS note_id, title, 'outline' AS format, content, CAST(ceil(length(content) / 4.0) AS BIGINT) AS token_count, truncated FROM y""",
        "template_schema": f"""WITH {_MD}, v AS (SELECT id, list_filter(regexp_extract_all(raw, '\\{{\\{{\\s*([A-Za-z0-9_]+)\\s*\\}}\\}}', 1), lambda x: x NOT IN ('date', 'time', 'datetime')) AS vs FROM n)
            SELECT id AS name, array_to_string(list_filter(vs, lambda x, i: list_position(vs, x) = i), ',') AS vars FROM v""",
        "vault_digest": f"""WITH {_MD}, {_MDLINES}, {_MDTASK}, {_MDHEAD},
            o AS (SELECT n.id, doc_id, coalesce(nullif(regexp_extract(fm, 'title: ([^\\n]*)', 1), ''), first(t ORDER BY line) FILTER (level = 1), regexp_extract(n.id, '([^/]*)$', 1)) AS title FROM n LEFT JOIN hd ON hd.id = n.id GROUP BY n.id, doc_id, fm),
            e AS (SELECT a.doc_id AS x, b.doc_id AS y FROM documents a JOIN documents b ON b.doc_id = a.doc_id + CASE a.doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 WHEN 2 THEN -2 END UNION ALL SELECT a.doc_id, b.doc_id FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 2 AND a.doc_id % 4 = 0),
            rec AS (SELECT 'v_' || lpad(CAST(event_id AS VARCHAR), 8, '0') AS name, event_type || ' ' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS value FROM events ORDER BY strftime(ts, '%Y-%m-%d %H:%M:%S') DESC, name DESC LIMIT 5)
            SELECT 'open_tasks' AS section, CASE WHEN due IS NULL THEN 'undated' WHEN due < '2026-08-10' THEN 'overdue' WHEN due = '2026-08-10' THEN 'today' ELSE 'upcoming' END AS name, CAST(count(*) AS VARCHAR) AS value FROM td WHERE NOT done GROUP BY 2
            UNION ALL SELECT 'status', regexp_extract(fm, 'status: ([^\\n]*)', 1), CAST(count(*) AS VARCHAR) FROM n WHERE contains(fm, 'status: ') GROUP BY 2
            UNION ALL SELECT 'orphans', id, title FROM o WHERE doc_id NOT IN (SELECT x FROM e UNION ALL SELECT y FROM e) UNION ALL SELECT 'recent', name, value FROM rec""",
    }
    return sql
