"""DuckDB statements for the queries of the mirror's own operators."""

from quillspark.functions.scalars import LATIN, LATIN_BASE, WORD_EDGES
from quillspark.plans.pipeline_sql import CURRENT, LIST, key, us
from quillspark.plans.reference import MODEL


def fold(c: str) -> str:
    return f"lower(regexp_replace(translate({c}, '{LATIN}', '{LATIN_BASE}'), '[\\x{{300}}-\\x{{36f}}]', '', 'g'))"


def terms(c: str) -> str:
    return f"list_filter(regexp_split_to_array({fold(f'coalesce({c},{chr(39)*2})')}, '[^\\p{{L}}\\p{{N}}\\p{{Co}}]+'), lambda t: t <> '')"


CHUNKS = f"ch AS (SELECT DISTINCT id AS chunk_id, {key('page_id')} AS page_id, ord, heading, text, hash FROM chunks)"
RELATIONS = f"rel AS (SELECT DISTINCT {key('from_id')} AS from_id, prop, {key('to_id')} AS to_id FROM relations WHERE trim(coalesce(to_id,'')) <> '' AND trim(coalesce(from_id,'')) <> '')"
DS = key("data_source_id")


def weight(c: str) -> str:
    """Weight of the keyword branch by a query's literals."""
    edges = "[" + WORD_EDGES.replace("'", "''") + "]+"
    words = f"list_transform(regexp_split_to_array(coalesce({c},''), '[\\s\\p{{Z}}]+'), lambda w: regexp_replace(w, '^{edges}|{edges}$', '', 'g'))"
    shape = "(NOT regexp_matches(w, '[a-z]') AND length(w) >= 4) OR regexp_matches(w, '\\p{Nd}') OR contains(w, '.')"
    literal = f"length(w) >= 3 AND (regexp_matches(w, '[_@]') OR (regexp_matches(w, '[A-Za-z]') AND ({shape})))"
    return f"(CASE WHEN len(list_filter({words}, lambda w: {literal})) > 0 THEN 1.0 ELSE 0.2 END)::DOUBLE"


QUERIES = "qs AS (SELECT query_id AS qid, max(query_text) AS text FROM search_results WHERE query_id IS NOT NULL GROUP BY 1)"
BM25 = rf"""{CURRENT}, {CHUNKS},
titled AS (SELECT ch.*, cur.title FROM ch LEFT JOIN cur ON cur.pid = ch.page_id),
fields AS (SELECT chunk_id, 'text' AS field, 1.0 AS w, {terms('text')} AS ts FROM titled
  UNION ALL SELECT chunk_id, 'heading', 1.5, {terms('heading')} FROM titled
  UNION ALL SELECT chunk_id, 'title', 3.0, {terms('title')} FROM titled),
post AS (SELECT chunk_id, field, w, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM fields),
lens AS (SELECT chunk_id, count(*) AS len FROM post GROUP BY 1),
st AS (SELECT count(*) AS n_all, avg(len) AS avg_len FROM lens),
{QUERIES},
asked AS (SELECT qid, tno, length(word) >= 4 AS pre, {terms('word')} AS toks FROM (SELECT qid, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS tno FROM
  (SELECT qid, list_filter(regexp_extract_all(coalesce(text,''), '[\p{{L}}\p{{Nd}}_]+'), lambda w: length(w) >= 2)[1:32] AS ws FROM qs))),
one AS (SELECT a.qid, a.tno, p.chunk_id, p.w FROM asked a JOIN post p ON len(a.toks) = 1 AND (p.term = a.toks[1] OR (a.pre AND starts_with(p.term, a.toks[1])))),
two AS (SELECT a.qid, a.tno, p.chunk_id, p.w FROM asked a JOIN post p ON len(a.toks) = 2 AND p.term = a.toks[1]
  JOIN post r ON r.chunk_id = p.chunk_id AND r.field = p.field AND r.pos = p.pos + 1 AND (r.term = a.toks[2] OR (a.pre AND starts_with(r.term, a.toks[2])))),
tf AS (SELECT qid, tno, chunk_id, sum(w) AS f FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY ALL),
df AS (SELECT qid, tno, count(*) AS df FROM tf GROUP BY ALL),
sc AS (SELECT tf.qid, tf.chunk_id, round(sum(greatest(ln((n_all - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / avg_len))), 6) AS score
  FROM tf JOIN df USING (qid, tno) JOIN lens USING (chunk_id), st GROUP BY ALL)"""


def bm25_pages(where: str) -> str:
    return f"""WITH {BM25},
owned AS (SELECT sc.qid, ch.page_id, sc.chunk_id, sc.score FROM sc JOIN ch USING (chunk_id) JOIN cur ON cur.pid = ch.page_id WHERE coalesce(in_trash,0) = 0{where}),
best AS (SELECT * FROM owned QUALIFY row_number() OVER (PARTITION BY qid, page_id ORDER BY score DESC, chunk_id) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM best)"""


BEST = f"""best AS (SELECT query_id AS qid, {key('page_id')} AS page_id, max(CASE WHEN NOT isnan(keyword_score) THEN keyword_score END) AS k,
  max(CASE WHEN NOT isnan(vector_score) THEN vector_score END) AS v FROM search_results GROUP BY 1, 2)"""
DECLARED = f"""sj AS (SELECT {key('id')} AS sid, max(schema_json) AS j FROM data_sources GROUP BY 1),
ds AS (SELECT sid, name, json_extract_string(j, '$."' || name || '".type') AS t FROM (SELECT sid, unnest(json_keys(j)) AS name, j FROM sj)),
decl AS (SELECT sid, name, t AS type, unnest(CASE WHEN t = 'date' THEN ['date:'||name||':start','date:'||name||':end','date:'||name||':is_datetime'] WHEN lower(name) IN ('id','url') THEN ['userDefined:'||name] ELSE [name] END) AS col,
  unnest(CASE WHEN t = 'date' THEN ['date','date','number'] ELSE [t] END) AS t FROM ds)"""
DIGEST = f"""pv AS (SELECT {key('page_id')} AS page_id, col, max(value) AS value FROM page_props WHERE col IS NOT NULL GROUP BY 1, 2),
shown AS (SELECT page_id, pv.col, CASE WHEN decl.t = 'number' AND coalesce(isfinite(try_cast(value AS double)), false) THEN regexp_replace(printf('%.4f', try_cast(value AS double)), '[.]?0+$', '') WHEN value = '__YES__' THEN 'да' WHEN value IN ('__NO__','[]','{{}}') THEN '' ELSE coalesce(value,'') END AS s FROM pv LEFT JOIN cur ON cur.pid = pv.page_id LEFT JOIN decl ON decl.sid = {DS} AND decl.col = pv.col),
lines AS (SELECT shown.page_id, col, CASE WHEN regexp_full_match(col,'date:.*:start') THEN regexp_replace(col,'^date:(.*):start$','\\1')
    WHEN regexp_full_match(col,'date:.*:end') THEN regexp_replace(col,'^date:(.*):end$','\\1 (до)') WHEN starts_with(col,'userDefined:') THEN substr(col,13) ELSE col END || ': ' || s AS line
  FROM shown LEFT JOIN cur ON cur.pid = shown.page_id
  WHERE s <> '' AND s IS DISTINCT FROM title AND NOT regexp_full_match(col,'date:.*:is_datetime')
    AND NOT (starts_with(s,'["') AND contains(s,'-') AND len(list_filter(string_split(regexp_replace(s,'^[\\[\\]]+|[\\[\\]]+$','','g'),','), lambda p: strlen(regexp_replace(trim(p),'^"+|"+$','','g')) NOT IN (32,36))) = 0))"""

BYTES = "list_transform(range(64), lambda i: (CASE WHEN h[2*i+1] >= '8' THEN -256 ELSE 0 END + ('0x' || h[2*i+1:2*i+2])::INT)::DOUBLE)"
KNN = f"""vx AS (SELECT chunk_id, scale, {BYTES} AS x FROM (SELECT chunk_id, scale, hex(vec) AS h, row_number() OVER (PARTITION BY chunk_id ORDER BY dim DESC, scale DESC NULLS LAST, vec DESC) AS n
  FROM vectors WHERE model = '{MODEL}' AND dim = 64 AND octet_length(vec) = 64) WHERE n = 1 AND scale IS NOT NULL),
qf AS (SELECT chunk_id AS vq, list_transform(x, lambda v: (v * scale::DOUBLE)::FLOAT) AS f FROM vx WHERE chunk_id % 100 = 0),
qc AS (SELECT vq, f, (list_max(list_transform(f, lambda v: abs(v))) / 127::FLOAT)::FLOAT AS s FROM qf),
qv AS (SELECT vq, s, list_transform(f, lambda v: CASE WHEN s = 0 THEN 0.0 ELSE greatest(least(sign(v) * floor(abs((v::DOUBLE * (1.0::DOUBLE / s::DOUBLE)::FLOAT::DOUBLE)::FLOAT::DOUBLE) + 0.5), 127), -127) END::DOUBLE) AS q FROM qc),
vs AS (SELECT vq, page_id, vx.chunk_id, round(list_dot_product(q, x) * scale::DOUBLE * s::DOUBLE, 6) AS score FROM qv, vx JOIN ch ON ch.chunk_id = vx.chunk_id JOIN cur ON cur.pid = ch.page_id WHERE coalesce(in_trash,0) = 0),
vbest AS (SELECT * FROM vs QUALIFY row_number() OVER (PARTITION BY vq, page_id ORDER BY score DESC, chunk_id) = 1),
vranked AS (SELECT *, row_number() OVER (PARTITION BY vq ORDER BY score DESC, chunk_id) AS rank FROM vbest)"""

STORED = f"""pv AS (SELECT {key('page_id')} AS pid, col, max(value) AS v FROM page_props WHERE value <> '' GROUP BY 1, 2),
typed AS (SELECT pv.pid, pv.col, pv.v, decl.name, decl.type FROM pv JOIN cur USING (pid) JOIN decl ON decl.sid = {DS} AND decl.col = pv.col),
items AS (SELECT * FROM typed WHERE type NOT IN ('multi_select','relation','people') OR regexp_full_match(v, '{LIST}'))"""
FIXED = " UNION ALL ".join(
    f"SELECT sid, pid, '{c}', {'pid' if c == 'id' else key('parent_id') if c == 'parent_id' else c}, NULL FROM live WHERE NOT EXISTS (SELECT 1 FROM decl WHERE decl.sid = live.sid AND decl.col = '{c}')"
    for c in ("id", "url", "title", "icon", "created_time", "last_edited_time", "content_markdown", "parent_id")
)

def slack(c: str) -> str:
    return f"coalesce(strftime(make_timestamp({us(c)}) - INTERVAL 2 MINUTE, '%Y-%m-%dT%H:%M:%SZ'), {c}, '')"


ARRIVED = f"""marks AS (SELECT {key('id')} AS sid, coalesce(in_trash,0) AS gone, watermark, {slack('watermark')} AS since FROM data_sources
  UNION ALL SELECT '', 0, meta_value, {slack('meta_value')} FROM meta WHERE meta_key = 'loose_watermark'),
arrived AS (SELECT {key('pages.id')} AS page_id, sid, last_edited_time, synced_at, in_trash FROM pages JOIN marks ON sid = {key('data_source_id')} WHERE gone = 0 AND last_edited_time >= since)"""

SQL = {
    "markdown_render": rf"""WITH {CURRENT},
lines AS (SELECT pid, unnest(ls) AS line, generate_subscripts(ls, 1) AS ord FROM (SELECT pid, string_split(coalesce(content_markdown,''), chr(10)) AS ls FROM cur)),
kinds AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,3}} +') THEN 'h' WHEN regexp_matches(line, '^[-*+] \[[ xX]\] +') THEN 't' WHEN regexp_matches(line, '^-{{3,}}$') THEN 'd' WHEN regexp_matches(line, '^[-*+] +') THEN 'b'
  WHEN regexp_matches(line, '^[0-9]+[.)] +') THEN 'n' WHEN regexp_matches(line, '^> ?') THEN 'q' WHEN regexp_matches(line, '^!\[.*\]\(.*\)$') THEN 'i' ELSE 'p' END AS kind FROM lines WHERE regexp_matches(line, '\S')),
runs AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY ord) - row_number() OVER (PARTITION BY pid, kind ORDER BY ord) AS run FROM kinds),
shown AS (SELECT pid, ord, CASE kind WHEN 'h' THEN regexp_replace(line, '^(#+) +', '\1 ') WHEN 't' THEN CASE WHEN regexp_matches(line, '^[-*+] \[[xX]\]') THEN '- [x] ' ELSE '- [ ] ' END || regexp_replace(line, '^[-*+] \[[ xX]\] +', '')
    WHEN 'd' THEN '---' WHEN 'b' THEN regexp_replace(line, '^[-*+] +', '- ') WHEN 'n' THEN row_number() OVER (PARTITION BY pid, kind, run ORDER BY ord) || regexp_replace(line, '^[0-9]+[.)] +', '. ')
    WHEN 'q' THEN regexp_replace(line, '^> ?', '> ') WHEN 'i' THEN regexp_replace(line, '^!\[\]', '![image]') ELSE line END || CASE WHEN kind IN ('t','b','n') THEN '' ELSE chr(10) END AS text FROM runs)
SELECT pid AS page_id, rtrim(string_agg(text, chr(10) ORDER BY ord), chr(10)) || chr(10) AS markdown FROM shown GROUP BY pid""",
    "sync_pass": f"""WITH {ARRIVED} SELECT page_id, last_edited_time, in_trash FROM arrived
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY {us('last_edited_time')} DESC NULLS LAST, last_edited_time DESC, {us('synced_at')} DESC NULLS LAST, synced_at DESC NULLS LAST) = 1""",
    "sync_watermarks": f"""WITH {ARRIVED}, seen AS (SELECT sid, max(last_edited_time) AS m FROM arrived GROUP BY sid)
SELECT marks.sid AS source_id, CASE WHEN m IS NULL THEN watermark ELSE greatest(m, coalesce(watermark,'')) END AS watermark FROM marks LEFT JOIN seen USING (sid) WHERE sid <> ''""",
    "eav_pivot_view": f"""WITH {CURRENT}, {DECLARED},
live AS (SELECT *, {DS} AS sid FROM cur WHERE coalesce(in_trash,0) = 0 AND coalesce(archived,0) = 0 AND {DS} IN (SELECT sid FROM sj)),
cells AS (SELECT live.sid, live.pid, decl.col, max(CASE WHEN decl.t <> 'number' THEN value END) AS value, max(CASE WHEN decl.t = 'number' THEN try_cast(value AS double) END) AS number
  FROM page_props pp JOIN live ON live.pid = {key('pp.page_id')} JOIN decl ON decl.sid = live.sid AND decl.col = pp.col GROUP BY ALL
  UNION ALL {FIXED})
SELECT sid AS source_id, pid AS page_id, col, value, number FROM cells WHERE value IS NOT NULL OR number IS NOT NULL""",
    "props_flatten": f"""WITH {CURRENT}, {DECLARED}, {STORED},
rows AS (SELECT pid AS page_id, CASE WHEN type = 'date' THEN 'date:' || name || ':start' ELSE col END AS col, CASE WHEN type = 'number' THEN NULL WHEN type = 'checkbox' THEN CASE WHEN v = '__YES__' THEN v ELSE '__NO__' END
    WHEN type IN ('multi_select','relation','people') THEN to_json(from_json(v, '["VARCHAR"]'))::VARCHAR ELSE v END AS value_str, CASE WHEN type = 'number' THEN try_cast(v AS double) END AS value_num
  FROM items WHERE type <> 'unique_id' AND (type <> 'date' OR col = 'date:' || name || ':start')
  UNION ALL SELECT pid, 'date:' || name || ':end', NULL, NULL FROM items WHERE type = 'date' AND col = 'date:' || name || ':start'
  UNION ALL SELECT pid, 'date:' || name || ':is_datetime', NULL, CASE WHEN contains(v, 'T') THEN 1.0 ELSE 0.0 END FROM items WHERE type = 'date' AND col = 'date:' || name || ':start')
SELECT page_id, col, value_str, value_num FROM rows""",
    "props_edges": f"""WITH {CURRENT}, {DECLARED}, {STORED}
SELECT DISTINCT pid AS from_id, name AS prop, unnest(from_json(v, '["VARCHAR"]')) AS to_id FROM items WHERE type = 'relation'""",
    "bm25_scores": f"WITH {BM25} SELECT qid::BIGINT AS qid, chunk_id, score FROM sc",
    "bm25_topk": bm25_pages("") + " SELECT qid::BIGINT AS qid, page_id, chunk_id, score, rank FROM ranked WHERE rank <= 10",
    "bm25_filtered": bm25_pages(" AND last_edited_time >= '2025-01-01' AND last_edited_time <= '2026-01-01'") + " SELECT qid::BIGINT AS qid, page_id, chunk_id, score FROM ranked WHERE rank <= 10",
    "keyword_only": bm25_pages("") + f""", w AS (SELECT qid, {weight('text')} AS w FROM qs)
SELECT ranked.qid::BIGINT AS qid, rank AS position, page_id, 'keyword' AS via, round(round(w / (60 + rank), 9), 6) AS score FROM ranked JOIN w USING (qid) WHERE rank <= 10""",
    "rrf_fusion": f"""WITH {QUERIES}, {BEST},
k AS (SELECT qid, page_id, row_number() OVER (PARTITION BY qid ORDER BY k DESC, page_id) AS r FROM best WHERE k IS NOT NULL),
v AS (SELECT qid, page_id, row_number() OVER (PARTITION BY qid ORDER BY v DESC, page_id) AS r FROM best WHERE v IS NOT NULL)
SELECT coalesce(k.qid, v.qid) AS qid, coalesce(k.page_id, v.page_id) AS page_id, round(coalesce(1.0::DOUBLE / (60 + v.r), 0) + coalesce({weight('text')} / (60 + k.r), 0), 9) AS score,
  CASE WHEN k.qid IS NULL THEN 'vector' WHEN v.qid IS NULL THEN 'keyword' ELSE 'both' END AS via
FROM k FULL JOIN v ON k.qid = v.qid AND k.page_id = v.page_id JOIN qs ON qs.qid = coalesce(k.qid, v.qid)""",
    "page_collapse": f"WITH {BEST} SELECT qid, count(*) AS n_pages, max(v) AS best, count(*) AS last_rank FROM best WHERE v IS NOT NULL GROUP BY qid",
    "knn_int8": f"""WITH {CURRENT}, {CHUNKS}, {KNN} SELECT vq AS qid, page_id, chunk_id, score FROM vranked WHERE rank <= 10""",
    "hybrid_search": bm25_pages("") + f""", {KNN}, {RELATIONS},
dealt AS (SELECT qs.qid, min(vq) AS vq FROM qs JOIN qv ON (vq // 100) % (SELECT count(*) FROM qs) = qs.qid % (SELECT count(*) FROM qs) GROUP BY 1),
k AS (SELECT qid, page_id, chunk_id, rank AS r FROM ranked WHERE rank <= 50),
v AS (SELECT dealt.qid, page_id, chunk_id, rank AS r FROM vranked JOIN dealt USING (vq) WHERE rank <= 50),
both_ AS (SELECT coalesce(k.qid, v.qid) AS qid, coalesce(k.page_id, v.page_id) AS page_id, k.r AS kr, v.r AS vr,
  CASE WHEN k.qid IS NULL THEN 'vector' WHEN v.qid IS NULL THEN 'keyword' ELSE 'both' END AS via FROM k FULL JOIN v ON k.qid = v.qid AND k.page_id = v.page_id),
scored AS (SELECT both_.*, round(coalesce(1.0::DOUBLE / (60 + vr), 0) + coalesce({weight('text')} / (60 + kr), 0), 9) AS score FROM both_ JOIN qs USING (qid)),
fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, kr NULLS LAST, vr NULLS LAST) AS position FROM scored QUALIFY position <= 10),
near AS (SELECT qid, position, score, to_id AS other, prop FROM rel JOIN fused ON from_id = page_id UNION ALL SELECT qid, position, score, from_id, prop FROM rel JOIN fused ON to_id = page_id),
fresh AS (SELECT near.qid, other, arg_min((position, prop), (position, prop)) AS first, max(score) AS parent FROM near JOIN cur ON cur.pid = other
  WHERE coalesce(in_trash,0) = 0 AND NOT EXISTS (SELECT 1 FROM fused f WHERE f.qid = near.qid AND f.page_id = other) GROUP BY near.qid, other),
more AS (SELECT qid, other, round(parent / 3, 9) AS score, row_number() OVER (PARTITION BY qid ORDER BY first, other) AS n FROM fresh QUALIFY n <= 10)
SELECT qid::BIGINT AS qid, position::BIGINT AS position, page_id, via, score FROM fused
UNION ALL SELECT qid::BIGINT, 10 + n, other, 'relation', score FROM more""",
    "relation_expand": f"""WITH {CURRENT}, {RELATIONS},
seeds AS (SELECT pid, row_number() OVER (ORDER BY last_edited_time DESC, pid) AS position FROM cur WHERE coalesce(in_trash,0) = 0 QUALIFY position <= 5),
near AS (SELECT position, to_id AS other, prop FROM rel JOIN seeds ON from_id = pid UNION ALL SELECT position, from_id, prop FROM rel JOIN seeds ON to_id = pid),
live AS (SELECT near.*, cur.title FROM near JOIN cur ON cur.pid = near.other WHERE coalesce(in_trash,0) = 0 AND other NOT IN (SELECT pid FROM seeds)),
best AS (SELECT other, min(position) AS p, arg_min(prop, (position, prop)) AS prop FROM live GROUP BY other)
SELECT other AS page_id, 'relation' AS via, round(1.0::DOUBLE / p / 3, 6) AS score FROM best ORDER BY p, prop, other LIMIT 10""",
    "related_out": f"""WITH {CURRENT}, {RELATIONS}
SELECT from_id AS page_id, prop, to_id, title FROM rel JOIN cur ON cur.pid = rel.to_id WHERE coalesce(in_trash,0) = 0
QUALIFY row_number() OVER (PARTITION BY from_id ORDER BY prop, title, to_id) <= 200""",
    "recall_linked": f"""WITH {CURRENT}, {RELATIONS},
both_ways AS (SELECT from_id AS page_id, to_id AS other_id, prop, true AS o FROM rel UNION ALL SELECT to_id, from_id, prop, false FROM rel),
names AS (SELECT {key('id')} AS sid, title AS source FROM data_sources)
SELECT page_id, coalesce(source, 'вне базы') AS source, other_id, prop FROM both_ways JOIN cur ON cur.pid = other_id LEFT JOIN names ON sid = {DS}
WHERE coalesce(cur.in_trash,0) = 0
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY coalesce(source, 'вне базы'), last_edited_time DESC, other_id, prop, o) <= 200""",
    "catalog_counts": f"""WITH {CURRENT} SELECT {key('s.id')} AS source_id, any_value(s.title) AS title, 'collection://' || {key('s.id')} AS view, count(cur.pid) AS rows
FROM data_sources s LEFT JOIN cur ON {key('cur.data_source_id')} = {key('s.id')} AND coalesce(cur.in_trash,0) = 0 WHERE coalesce(s.in_trash,0) = 0 GROUP BY {key('s.id')}""",
    "digest_lines": f"WITH {CURRENT}, {DECLARED}, {DIGEST} SELECT page_id, string_agg(line, chr(10) ORDER BY encode(col)) AS digest FROM lines GROUP BY page_id",
    "chunk_hash": f"WITH {CHUNKS} SELECT DISTINCT chunk_id, substr(sha256(coalesce(heading,'') || chr(0) || coalesce(text,'')),1,16) AS hash, length(text) AS runes FROM ch",
    "hash_reuse": f"""WITH {CHUNKS}, old AS (SELECT page_id, hash, row_number() OVER (PARTITION BY page_id, hash ORDER BY ord) AS k FROM ch),
edited AS (SELECT page_id, ord, heading, CASE WHEN ord = max(ord) OVER (PARTITION BY page_id) THEN coalesce(text,'') || ' *' ELSE text END AS text FROM ch),
new AS (SELECT page_id, hash, row_number() OVER (PARTITION BY page_id, hash ORDER BY ord) AS k FROM
  (SELECT DISTINCT page_id, ord, substr(sha256(coalesce(heading,'') || chr(0) || coalesce(text,'')),1,16) AS hash FROM edited))
SELECT new.page_id, count(*) AS n, count(old.k) AS n_reused FROM new LEFT JOIN old ON old.page_id = new.page_id AND old.hash = new.hash AND old.k = new.k GROUP BY new.page_id""",
    "pending_vectors": f"""WITH {CURRENT}, {CHUNKS} SELECT DISTINCT chunk_id, ch.page_id, content_runes FROM ch JOIN cur ON cur.pid = ch.page_id
WHERE coalesce(in_trash,0) = 0 AND chunk_id NOT IN (SELECT chunk_id FROM vectors WHERE model = '{MODEL}')""",
    "stale_pages": f"WITH {CURRENT} SELECT pid AS page_id, last_edited_time, content_synced FROM cur WHERE coalesce(in_trash,0) = 0 AND (coalesce(content_synced,'') = '' OR content_synced <> last_edited_time)",
    "known_minus_live": f"""WITH {CURRENT}, {RELATIONS} SELECT pid AS page_id FROM cur WHERE {DS} <> '' AND coalesce(in_trash,0) = 0 AND pid NOT IN (SELECT from_id FROM rel)""",
    "upsert_latest": f"""WITH v AS (SELECT {key('id')} AS pid, {DS} AS ds, last_edited_time, synced_at, {us('last_edited_time')} AS t FROM pages),
f AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY pid ORDER BY t, last_edited_time, synced_at, ds) = 1),
l AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY pid ORDER BY t DESC, last_edited_time DESC, synced_at DESC, ds DESC) = 1)
SELECT CASE WHEN l.ds <> '' THEN l.ds ELSE f.ds END AS data_source_id, count(*) AS n_changed FROM f JOIN l USING (pid) WHERE f.last_edited_time <> l.last_edited_time GROUP BY 1""",
    "watermark_slack": f"SELECT DISTINCT {key('id')} AS source_id, coalesce(strftime(make_timestamp({us('watermark')}) - INTERVAL 2 MINUTE, '%Y-%m-%dT%H:%M:%SZ'), watermark) AS since FROM data_sources",
    "canonical_id": f"SELECT DISTINCT coalesce(lower(replace(list_last(regexp_extract_all(url, '[0-9a-fA-F]{{8}}-?[0-9a-fA-F]{{4}}-?[0-9a-fA-F]{{4}}-?[0-9a-fA-F]{{4}}-?[0-9a-fA-F]{{12}}')),'-','')),'') AS canonical_id, {key('id')} AS page_id FROM pages",
    "accent_fold": f"SELECT term, count(*) AS n_docs FROM (SELECT doc_id, unnest(list_distinct({terms('text')})) AS term FROM documents) GROUP BY term",
    "json_props_extract": "SELECT event_type, count(json_extract_string(props,'$.k')) AS n, sum(json_extract_string(props,'$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type",
    "eav_flatten": f"""WITH s AS (SELECT {key('id')} AS source_id, unnest(json_keys(schema_json)) AS name, schema_json FROM data_sources),
t AS (SELECT source_id, name, json_extract_string(schema_json, '$."' || name || '".type') AS t FROM s)
SELECT DISTINCT source_id, unnest(CASE WHEN t = 'date' THEN ['date:'||name||':start','date:'||name||':end','date:'||name||':is_datetime'] WHEN lower(name) IN ('id','url') THEN ['userDefined:'||name] ELSE [name] END) AS col,
  unnest(CASE WHEN t = 'date' THEN ['date','date','number'] ELSE [t] END) AS type FROM t""",
    "log_tail": "SELECT event_id AS log_id, event_type FROM events ORDER BY event_id DESC LIMIT 500",
    "mirror_status": f"WITH {CURRENT}, {CHUNKS} SELECT (SELECT count(*) FROM cur) AS n_pages, (SELECT count(*) FROM cur WHERE coalesce(in_trash,0) <> 0) AS n_trashed, (SELECT count(*) FROM ch) AS n_chunks, (SELECT count(DISTINCT {key('id')}) FROM data_sources WHERE coalesce(in_trash,0) = 0) AS n_sources",
    "knn_exact": """SELECT a.vec_id, b.vec_id AS neighbour_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) <= 5""",
    "quantize_vectors": """WITH s AS (SELECT vec_id, embedding, (list_max(list_transform(embedding, lambda x: abs(x)))::DOUBLE / 127)::FLOAT AS scale FROM embeddings)
SELECT vec_id, round(scale::DOUBLE, 7) AS scale, list_sum(list_transform(embedding, lambda x: abs(greatest(least(round((x::DOUBLE * (1.0::DOUBLE / scale::DOUBLE)::FLOAT::DOUBLE)::FLOAT)::INT, 127), -127))))::BIGINT AS weight FROM s""",
    "hit_mrr": f"""WITH {BEST},
k AS (SELECT qid, page_id, row_number() OVER (PARTITION BY qid ORDER BY k DESC, page_id) AS r FROM best WHERE k IS NOT NULL),
v AS (SELECT qid, page_id, row_number() OVER (PARTITION BY qid ORDER BY v DESC, page_id) AS r FROM best WHERE v IS NOT NULL),
c AS (SELECT qid, page_id FROM k WHERE r = 1),
r AS (SELECT 'keyword' AS mode, 1 AS rank FROM c UNION ALL SELECT 'vector', coalesce(v.r, 0) FROM c LEFT JOIN v USING (qid, page_id))
SELECT mode, count(*) AS cases, count(*) FILTER (rank = 1) AS hit1, count(*) FILTER (rank BETWEEN 1 AND 3) AS hit3, count(*) FILTER (rank BETWEEN 1 AND 5) AS hit5,
  count(*) FILTER (rank = 0) AS missed, floor(count(*) FILTER (rank = 1)::DOUBLE / count(*) * 100 + 0.5)::INTEGER AS hit1_percent, round(avg(CASE WHEN rank > 0 THEN 1.0 / rank ELSE 0 END), 6)::DOUBLE AS mrr FROM r GROUP BY mode""",
    "stream_upsert": f"WITH {CURRENT} SELECT pid AS page_id, data_source_id, in_trash FROM (SELECT pid, {DS} AS data_source_id, in_trash FROM cur)",
}
