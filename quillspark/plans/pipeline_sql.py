"""DuckDB statements for the core queries p1, p2, p5 and p6."""

KEY = "(CASE WHEN regexp_full_match(replace(lower(trim(coalesce({0},''))),'-',''),'[0-9a-f]{{32}}') THEN regexp_replace(replace(lower(trim({0})),'-',''),'(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})','\\1-\\2-\\3-\\4-\\5') ELSE lower(trim(coalesce({0},''))) END)"


def key(c: str) -> str:
    return KEY.format(c)


def us(c: str) -> str:
    return f"epoch_us(try_cast({c} AS timestamptz))"


CURRENT = f"""cur AS (
  SELECT * FROM (
    SELECT *, {key('id')} AS pid, row_number() OVER (PARTITION BY {key('id')} ORDER BY {us('last_edited_time')} DESC NULLS LAST, {us('synced_at')} DESC NULLS LAST) AS version_no
    FROM pages) WHERE version_no = 1)"""

P1 = f"""WITH {CURRENT},
marks AS (
  SELECT {key('id')} AS sid, coalesce(in_trash,0) AS trashed, {us('watermark')} AS mark FROM data_sources
  UNION ALL SELECT '', 0, {us('meta_value')} FROM meta WHERE meta_key = 'loose_watermark')
SELECT pid AS page_id,
  CASE WHEN mark IS NULL OR {us('last_edited_time')} > mark THEN 'fresh' ELSE 'missed' END AS reason
FROM cur LEFT JOIN marks ON marks.sid = {key('data_source_id')}
WHERE coalesce(in_trash,0) = 0 AND coalesce(trashed,0) = 0
  AND (coalesce(indexed_hash,'') = '' OR lower(indexed_hash) IS DISTINCT FROM lower(content_hash))"""

P6 = f"""WITH {CURRENT},
p AS (SELECT pid, coalesce(in_trash,0) <> 0 AS trashed, {us('created_time')} AS created, {us('last_edited_time')} AS edited,
  strftime(make_timestamp({us('last_edited_time')}), '%Y-%m') AS edit_month FROM cur),
r AS (SELECT DISTINCT {key('from_id')} AS from_id, prop, {key('to_id')} AS to_id FROM relations WHERE trim(coalesce(to_id,'')) <> ''),
j AS (SELECT r.*, f.pid AS f_pid, f.trashed AS f_trashed, f.edited AS f_edited, coalesce(f.edit_month,'') AS edit_month,
  t.pid AS t_pid, t.trashed AS t_trashed, t.created AS t_created
  FROM r LEFT JOIN p f ON f.pid = r.from_id LEFT JOIN p t ON t.pid = r.to_id)
SELECT from_id, prop, to_id, 'from' AS side, CASE WHEN f_pid IS NULL THEN 'missing' ELSE 'trashed' END AS kind, edit_month
FROM j WHERE f_pid IS NULL OR f_trashed
UNION ALL
SELECT from_id, prop, to_id, 'to', CASE WHEN t_pid IS NULL THEN 'missing' ELSE 'trashed' END, edit_month
FROM j WHERE t_pid IS NULL OR t_trashed
UNION ALL
SELECT from_id, prop, to_id, 'to', 'late', edit_month
FROM j WHERE t_pid IS NOT NULL AND f_pid IS NOT NULL AND NOT t_trashed AND t_created > f_edited"""

P6_REPORT = f"SELECT prop, side, kind, edit_month, count(*) AS n FROM ({P6}) GROUP BY ALL"

_FOREST = f"""WITH RECURSIVE {CURRENT},
links AS (SELECT c.pid, p.pid AS parent FROM (
    SELECT pid, CASE WHEN lower(trim(coalesce(parent_type,''))) IN ('','page_id') THEN {key('parent_id')} END AS parent FROM cur) c
  LEFT JOIN cur p ON p.pid = c.parent),
tree AS (
  SELECT pid, pid AS root_id, 0 AS depth, pid AS path FROM links WHERE parent IS NULL
  UNION ALL
  SELECT l.pid, t.root_id, t.depth + 1, t.path || '/' || l.pid FROM links l JOIN tree t ON l.parent = t.pid)"""

P5 = f"""{_FOREST}
SELECT l.pid AS page_id, coalesce(t.root_id,'') AS root_id, coalesce(t.depth,-1)::INTEGER AS depth
FROM links l LEFT JOIN tree t ON t.pid = l.pid"""

P5_PATHS = f"""{_FOREST},
up AS (SELECT pid, unnest(string_split(path,'/')) AS ancestor FROM tree),
below AS (SELECT ancestor, count(*) - 1 AS n FROM up GROUP BY ancestor)
SELECT t.pid AS page_id, t.path, b.n AS n_descendants FROM tree t JOIN below b ON b.ancestor = t.pid"""

P5_DESCENDANTS = f"""{_FOREST}
, up AS (SELECT pid, unnest(string_split(path,'/')) AS ancestor FROM tree)
SELECT ancestor AS ancestor_id, pid AS page_id FROM up WHERE ancestor <> pid"""

NUMBER = r"\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?\s*"
DATE = r"[0-9]{4}-[0-9]{2}-[0-9]{2}(T([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.,][0-9]+)?)?(Z|[+-]([01][0-9]|2[0-3]):?[0-5][0-9]))?"
LIST = r'\s*\[\s*("([^"\\]|\\.)*"\s*(,\s*"([^"\\]|\\.)*"\s*)*)?\]\s*'

_CELLS = f"""WITH {CURRENT},
src AS (SELECT {key('id')} AS sid, unnest(json_keys(schema_json)) AS name, schema_json FROM data_sources),
typed AS (SELECT sid, name, json_extract_string(schema_json, '$."' || name || '".type') AS t FROM src),
decl AS (
  SELECT sid, unnest(CASE WHEN t = 'date' THEN ['date:'||name||':start','date:'||name||':end','date:'||name||':is_datetime']
    WHEN lower(name) IN ('id','url') THEN ['userDefined:'||name] ELSE [name] END) AS col,
    unnest(CASE WHEN t = 'date' THEN ['date','date','number'] ELSE [t] END) AS t FROM typed),
vals AS (
  SELECT c.pid, {key('c.data_source_id')} AS sid, pp.col, nullif(pp.value,'') AS value
  FROM page_props pp JOIN cur c ON c.pid = {key('pp.page_id')} WHERE {key('c.data_source_id')} <> '' AND pp.col IS NOT NULL),
tv AS (
  SELECT v.*, d.t, d.col IS NOT NULL AS declared,
    CASE WHEN t = 'number' THEN regexp_full_match(value,'{NUMBER}') AND coalesce(isfinite(try_cast(trim(value) AS double)),false)
      WHEN t = 'date' THEN regexp_full_match(value,'{DATE}') AND try_cast(substr(value,1,10) AS date) IS NOT NULL
      WHEN t = 'checkbox' THEN value IN ('__YES__','__NO__')
      WHEN t IN ('multi_select','people','relation') THEN regexp_full_match(value,'{LIST}')
      ELSE true END AS ok,
    CASE WHEN t = 'number' THEN try_cast(trim(value) AS double)::varchar ELSE value END AS shown
  FROM vals v LEFT JOIN decl d ON d.sid = v.sid AND d.col = v.col)"""

P2 = f"""{_CELLS}
SELECT DISTINCT pid AS page_id, col, 'undeclared' AS kind FROM tv WHERE NOT declared
UNION ALL SELECT DISTINCT pid, col, 'mistyped' FROM tv WHERE declared AND value IS NOT NULL AND NOT ok
UNION ALL SELECT pid, col, 'conflict' FROM tv WHERE declared AND value IS NOT NULL AND ok GROUP BY pid, col HAVING count(DISTINCT shown) > 1"""

P2_WIDE = f"""{_CELLS},
fit AS (SELECT pid, col, t = 'number' AS n, max(CASE WHEN t = 'number' THEN try_cast(trim(value) AS double) END) AS num, max(value) AS txt
  FROM tv WHERE declared AND value IS NOT NULL AND ok GROUP BY pid, col, t)
SELECT cur.pid AS page_id, {key('data_source_id')} AS source_id, coalesce(string_agg(col || '=' || txt, chr(10) ORDER BY encode(col)) FILTER (NOT n), '') AS texts,
  count(num) AS n_numbers, max(num) AS greatest FROM cur LEFT JOIN fit ON fit.pid = cur.pid WHERE {key('data_source_id')} <> '' GROUP BY ALL"""
