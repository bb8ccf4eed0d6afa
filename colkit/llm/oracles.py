"""DuckDB SQL for the queries that SQL can express."""

OP1 = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), q AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM q
"""

OP4 = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

_SIZES = r"""
sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '') || 'mix') AS turn FROM documents
), named AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source
), weighed AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS weight, 2 * source_size AS cap FROM named
), level AS (
  SELECT *, cap / weight AS ratio,
    (1.5 * sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0)) / sum(weight) OVER after AS level
  FROM weighed
  WINDOW before AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    after AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), targets AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce((SELECT arg_min(level, ratio) FROM level WHERE level <= ratio), 1e300) * weight) AS target FROM level
), queued AS (
  SELECT s.doc_id, s.turn, s.size, t.source_size, t.target,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.turn, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS sent
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), tags AS (
  SELECT doc_id, turn, size, (sent + k * source_size) / target AS finish FROM queued, (SELECT unnest([0, 1]) AS k) WHERE size > 0
), running AS (
  SELECT *, sum(size) OVER (ORDER BY finish, turn, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM tags WHERE finish <= 1
)
"""

OP6 = f"""
WITH {_SIZES}, mixed AS (
  SELECT doc_id, count(*) AS passes FROM running WHERE upto <= (SELECT 1.5 * sum(size) FROM sizes) GROUP BY doc_id
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(size * coalesce(passes, 0) AS BIGINT) AS taken FROM queued LEFT JOIN mixed USING (doc_id)
"""

OP3 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS shingles FROM words
), items AS (
  SELECT doc_id, len(shingles) AS n, hash(unnest(shingles)) AS h FROM sets
), links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM items a JOIN items b USING (h) WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM sets
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, m.component_id FROM sets s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON s.doc_id = m.x
"""


def _op7() -> str:
    from .queries import URL_RULES
    from .url_filter import LEVELS, MIN_SUPPORT, REJECT, SMOOTHING, VARIABLE, Z_LIMIT

    rules = sorted(URL_RULES, key=lambda r: (-len(r[1]), r[1]))
    fits = [(v, r, f"(host = '{r.partition('/')[0]}' OR suffix(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')") for v, r in rules]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for _, r, c in fits) + " END"
    ruled = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for v, _, c in fits) + " END"
    sql = f"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), hosts AS (
  SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM cut
), parsed AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substring(rest, length(raw) + 1), '^[^?#]*') AS path FROM hosts
), judged AS (
  SELECT *, {rule} AS rule, {ruled} AS ruled, string_split(path, '/') AS p FROM parsed
), pieces AS (
  SELECT *, list_transform(list_filter(CASE WHEN len(p) > {LEVELS + 1} THEN list_append(p[1:{LEVELS}], array_to_string(p[{LEVELS + 1}:], '/')) ELSE p END, lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '{VARIABLE}') THEN '*' ELSE s END) AS segs FROM judged
), t0 AS (
  SELECT host, segs, count(*) AS n, count(ruled) AS labelled, count(*) FILTER (ruled = 'block') AS blocked, '' AS template FROM pieces GROUP BY host, segs
)"""
    for k in range(LEVELS + 1):
        sql += f""", k{k} AS (
  SELECT host, template, segs[{k + 1}] AS seg, sum(n) AS n, sum(labelled) AS labelled, sum(blocked) AS blocked FROM t{k} WHERE segs[{k + 1}] IS NOT NULL GROUP BY ALL
), r{k} AS (
  SELECT *, sum(labelled) OVER w - labelled AS rest_n, sum(blocked) OVER w - blocked AS rest_b FROM k{k} WINDOW w AS (PARTITION BY host, template)
), s{k} AS (
  SELECT *, (blocked + rest_b) / nullif(CAST(labelled + rest_n AS DOUBLE), 0) AS p, blocked / nullif(CAST(labelled AS DOUBLE), 0) - rest_b / nullif(CAST(rest_n AS DOUBLE), 0) AS gap, 1.0 / nullif(CAST(labelled AS DOUBLE), 0) + 1.0 / nullif(CAST(rest_n AS DOUBLE), 0) AS per FROM r{k}
), l{k} AS (
  SELECT host, template, seg FROM s{k} WHERE seg <> '*' AND ((labelled >= {MIN_SUPPORT} AND coalesce(p * (1.0 - p) * per > 0 AND gap * gap > {Z_LIMIT * Z_LIMIT!r} * (p * (1.0 - p) * per), false)) OR (labelled = 0 AND n >= {MIN_SUPPORT}))
), t{k + 1} AS (
  SELECT t.host, t.segs, t.n, t.labelled, t.blocked, CASE WHEN t.segs[{k + 1}] IS NULL THEN t.template ELSE t.template || '/' || CASE WHEN l.seg IS NOT NULL THEN l.seg ELSE '*' END END AS template
  FROM t{k} t LEFT JOIN l{k} l ON t.host = l.host AND t.template = l.template AND t.segs[{k + 1}] = l.seg
)"""
    t = f"t{LEVELS + 1}"
    return sql + f""", base AS (
  SELECT coalesce(sum(blocked) / nullif(CAST(sum(labelled) AS DOUBLE), 0), 0) AS base FROM {t}
), by_host AS (
  SELECT host, (sum(blocked) + {SMOOTHING} * any_value(base)) / (sum(labelled) + {SMOOTHING}) AS host_purity FROM {t}, base GROUP BY host
), by_template AS (
  SELECT host, template, (sum(blocked) + {SMOOTHING} * any_value(host_purity)) / (sum(labelled) + {SMOOTHING}) AS purity FROM {t} JOIN by_host USING (host) GROUP BY host, template
)
SELECT page_id, j.host, j.path, j.rule, coalesce(j.ruled, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict
FROM pieces j JOIN {t} t ON j.host = t.host AND j.segs = t.segs JOIN by_template b ON b.host = t.host AND b.template = t.template
"""


ORACLES: dict[str, str] = {"op1_warc": OP1, "op3_ngram_join": OP3, "op4_exact_dedup": OP4, "op6_mix_sources": OP6, "op7_url_filter": _op7()}
