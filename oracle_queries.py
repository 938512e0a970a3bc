"""DuckDB twins of the registered queries, on the same Parquet tables."""

from __future__ import annotations

TOKEN_SEPARATOR = r"[^\p{L}\p{N}]+"

# Building blocks: each is "name AS (...)", in an order that resolves.
LINES = r"""
split_lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) AS parts
        FROM documents)
),
section_rows AS (
  SELECT doc_id, line_no, line, length(line) <= 40 AS is_header,
         coalesce(last_value(CASE WHEN length(line) <= 40 THEN line END IGNORE NULLS)
                    OVER (PARTITION BY doc_id ORDER BY line_no
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  'General') AS section
  FROM split_lines
)"""


MARKED = rf"""{LINES},
marked_lines AS (
  SELECT doc_id, line_no, CASE WHEN line = '' THEN line
      WHEN length(line) <= 40 THEN concat('##@--  ', line)
      ELSE concat('line-', line_no, ': ', length(line), ' ##@ ', line) END AS line
  FROM split_lines
),
marked_rows AS (
  SELECT *, starts_with(line, '##@--') AS is_header,
         coalesce(last_value(CASE WHEN starts_with(line, '##@--')
                                  THEN regexp_replace(line, '^##@--\s*', '') END IGNORE NULLS)
                    OVER (ORDER BY doc_id, line_no
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                  'General') AS section
  FROM marked_lines
  QUALIFY is_header OR regexp_matches(line, '(?s)^[a-zA-Z0-9_.-]+:.*##@')
)"""
MARKED_NAME, MARKED_HELP = (f"regexp_extract(line, '(?s)^([^:]*):.*##@(.*)$', {i})" for i in (1, 2))


def catalog(ctes: str, rows: str, name: str, help_: str) -> str:
    return f"""
WITH {ctes}
SELECT doc_id, line_no::INTEGER AS line_no, section,
       (row_number() OVER (PARTITION BY section ORDER BY doc_id, line_no))::BIGINT AS entry_pos,
       {name} AS name, {help_} AS help
FROM {rows} WHERE NOT is_header"""


def summary(ctes: str, rows: str, name: str) -> str:
    return f"""
WITH {ctes},
places AS (
  SELECT section, doc_id, line_no, is_header, line,
         row_number() OVER (PARTITION BY section ORDER BY doc_id, line_no) AS place
  FROM {rows}
)
SELECT section,
       max(CASE WHEN place = 1 THEN doc_id END) AS first_doc,
       max(CASE WHEN place = 1 THEN line_no END)::INTEGER AS first_line,
       count(*) FILTER (NOT is_header) AS n_entries,
       (SELECT max(length({name})) FROM {rows} WHERE NOT is_header)::INTEGER AS max_name_len
FROM places GROUP BY section HAVING count(*) FILTER (NOT is_header) > 0"""


def without_entries(ctes: str, rows: str) -> str:
    return f"""
WITH {ctes}
SELECT DISTINCT section FROM {rows} h WHERE is_header
  AND NOT EXISTS (SELECT 1 FROM {rows} e
                  WHERE e.section = h.section AND NOT e.is_header)"""


def postings(where: str) -> str:
    return f"""
WITH tokens AS (
  SELECT source AS tenant, doc_id, unnest(string_split_regex(lower(text), '{TOKEN_SEPARATOR}')) AS term
  FROM documents WHERE {where}
),
counts AS (
  SELECT tenant, term, doc_id, count(*)::INTEGER AS tf FROM tokens WHERE term <> '' GROUP BY ALL
)
SELECT tenant, term, doc_id, tf, count(*) OVER (PARTITION BY tenant, term) AS df FROM counts"""


def chunks(source: str = "documents", name: str = "chunks") -> str:
    """Chunks of ``source`` (doc_id, text, lang) as CTEs; the last is ``name``."""
    p = name
    return rf"""
{p}_lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM {source})
),
{p}_offsets AS (
  SELECT doc_id, line,
         coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS line_start
  FROM {p}_lines
),
{p}_headers AS (SELECT * FROM {p}_offsets WHERE length(line) <= 40),
{p}_starts AS (
  SELECT doc_id, lang, text,
         unnest(range(0, greatest(length(text) - 201, 0) + 1, 800))::BIGINT AS start
  FROM {source}
),
{p} AS (
  SELECT sha256(s.doc_id || ':' || s.start) AS chunk_id, s.doc_id,
         (s.start // 800)::INTEGER AS chunk_no, s.start::INTEGER AS start,
         s.lang AS layer, h.line AS symbol,
         substring(s.text, s.start + 1, 1000) AS text
  FROM {p}_starts s
  ASOF LEFT JOIN {p}_headers h ON s.doc_id = h.doc_id AND s.start >= h.line_start
)"""


def counted(source: str, key: str, name: str) -> str:
    """Token counts per bucket with the vector's squared length."""
    return rf"""
{name}_tokens AS (
  SELECT {key}, unnest(string_split_regex(lower(text), '{TOKEN_SEPARATOR}')) AS token
  FROM {source}
),
{name}_buckets AS (
  SELECT {key}, (('0x' || substr(md5(token), 1, 8))::BIGINT % 64)::INTEGER AS bucket,
         count(*)::DOUBLE AS n
  FROM {name}_tokens WHERE token <> '' GROUP BY ALL
),
{name} AS (
  SELECT {key}, bucket, n, sqrt(sum(n * n) OVER (PARTITION BY {key})) AS norm
  FROM {name}_buckets
)"""


COSINE = (
    "round(list_dot_product({a}, {b}) / "
    "sqrt(list_dot_product({a}, {a}) * list_dot_product({b}, {b})), 6)"
)

VECTORS = "vectors AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"

CENTROIDS = """
dims AS (
  SELECT label AS cell, i, avg(x) AS m
  FROM (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x
        FROM embeddings)
  GROUP BY ALL
),
norms AS (SELECT cell, sqrt(sum(m * m)) AS norm FROM dims GROUP BY cell),
centroids AS (
  SELECT cell, list(round(m / norm, 6) ORDER BY i) AS c FROM dims JOIN norms USING (cell)
  GROUP BY cell
)"""

CELL_RANKS = f"""
cell_ranks AS (
  SELECT vec_id, cell,
         row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, cell) AS cell_rank
  FROM (SELECT vec_id, cell, {COSINE.format(a="v", b="c")} AS score
        FROM vectors CROSS JOIN centroids)
)"""


CORPORA = """
old_docs AS (SELECT doc_id, text, lang FROM documents WHERE lang <> 'es'),
new_docs AS (
  SELECT doc_id, lang,
         CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)
              THEN text || chr(10) || 'Reviewed: low quality.' ELSE text END AS text
  FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
)"""

TENANTS = """
accounts AS (
  SELECT c_custkey AS account, r_name AS tenant, c_mktsegment AS segment
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
)"""

INVOICES = """
invoices AS (
  SELECT o_custkey AS account, date_trunc('month', o_orderdate)::DATE AS period_start,
         sum(o_totalprice::DECIMAL(18,2))::DECIMAL(28,2) AS amount
  FROM orders GROUP BY ALL
),
dated AS (
  SELECT *, (period_start + INTERVAL 1 MONTH)::DATE AS issued,
         (period_start + INTERVAL 1 MONTH)::DATE + 30 AS due_date
  FROM invoices
),
prior AS (
  SELECT *, coalesce(sum(amount) OVER (PARTITION BY account ORDER BY period_start
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM dated
),
paid AS (
  SELECT p.*, greatest(0, least(amount,
           (greatest(c_acctbal, 0) * 100)::DECIMAL(18,2) - before))::DECIMAL(28,2) AS applied
  FROM prior p JOIN customer ON account = c_custkey
),
balances AS (SELECT *, (amount - applied)::DECIMAL(28,2) AS balance FROM paid),
marked AS (
  SELECT b.*, CASE c_mktsegment WHEN 'MACHINERY' THEN DATE '1998-01-14'
                                WHEN 'HOUSEHOLD' THEN DATE '1998-01-16'
                                ELSE due_date END AS due_date_marked
  FROM balances b JOIN customer ON account = c_custkey
  WHERE issued <= DATE '1998-01-15'
)"""


def delinquency(due: str) -> str:
    late = f"balance > 0 AND {due} < DATE '1998-01-15'"
    return f"""SELECT account,
         CASE WHEN bool_or({late}) THEN 'delinquent' ELSE 'compliant' END AS status,
         sum(CASE WHEN {late} THEN balance ELSE 0 END)::DECIMAL(28,2) AS past_due,
         min(CASE WHEN {late} THEN {due} END) AS oldest_due
  FROM marked GROUP BY account"""


def billed(start: str, end: str, where: str) -> str:
    return f"""
WITH {TENANTS}
SELECT concat_ws(':', tenant, account, '{start}', '{end}') AS invoice_key, account,
       DATE '{start}' AS period_start, DATE '{end}' + 30 AS due_date,
       count(*) AS n_charges, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(28,2) AS amount
FROM orders JOIN accounts ON o_custkey = account
WHERE o_orderdate >= TIMESTAMP '{start}' AND o_orderdate < TIMESTAMP '{end}'
  AND segment <> 'BUILDING' AND {where}
GROUP BY tenant, account"""


def billed_between(start: str, end: str) -> str:
    """Charges of [start, end) as one invoice per account with a tenant."""
    return f"""
SELECT account, DATE '{start}' AS period_start, DATE '{end}' AS period_end,
       count(*) AS n_charges, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(28,2) AS amount
FROM orders JOIN accounts ON o_custkey = account
WHERE o_orderdate >= TIMESTAMP '{start}' AND o_orderdate < TIMESTAMP '{end}'"""


POINTS = r"""
points AS (
  SELECT doc_id AS point_id, lang AS layer,
         nullif(regexp_extract(text, '^([^.\n]{1,60}\.)', 1), '') AS summary
  FROM documents
)"""

# Columns of the snapshot tables by how their values are spelled in the hash.
SNAPSHOT_COLUMNS: dict[str, str] = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_acctbal:num c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey s_acctbal:num",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice:num",
    "orders": "o_orderkey o_custkey o_orderstatus o_totalprice:num o_orderdate:time o_orderpriority",
    "lineitem": (
        "l_orderkey l_partkey l_suppkey l_linenumber l_quantity:num l_extendedprice:num "
        "l_discount:num l_tax:num l_returnflag l_linestatus l_shipdate:time"
    ),
    "events": "event_id ts:time user_id event_type value:num props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id embedding:list label",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "pages": "page_id url html",
    "conversations": "conv_id turn role text",
}

SPELLED = {
    "": "{c}::VARCHAR",
    "num": "{c}::DECIMAL(28,6)::VARCHAR",
    "time": "strftime({c}, '%Y-%m-%d %H:%M:%S.%f')",
    "list": "array_to_string([x::DOUBLE::DECIMAL(28,6)::VARCHAR FOR x IN {c}], ',')",
}


def snapshot_hash(table: str) -> str:
    spelled = []
    for column in SNAPSHOT_COLUMNS[table].split():
        name, _, kind = column.partition(":")
        spelled.append(f"coalesce({SPELLED[kind].format(c=name)}, chr(0))")
    row = f"concat_ws(chr(31), {', '.join(spelled)})"
    return f"""
SELECT '{table}' AS "table", count(*) AS rows,
       coalesce(sum(('0x' || substr(md5({row}), 1, 15))::BIGINT::HUGEINT), 0)::VARCHAR AS content_hash
FROM {table}"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    # --- sections ---
    name = "split_part(line, ' ', 1)"
    help_ = "CASE WHEN contains(line, ' ') THEN substring(line, instr(line, ' ') + 1) ELSE '' END"
    sql["section_catalog"] = catalog(LINES, "section_rows", name, help_)
    sql["section_summary"] = summary(LINES, "section_rows", name)
    sql["empty_sections"] = without_entries(LINES, "section_rows")
    sql["marked_catalog"] = catalog(MARKED, "marked_rows", MARKED_NAME, MARKED_HELP)
    sql["marked_summary"] = summary(MARKED, "marked_rows", MARKED_NAME)
    sql["marked_empty_sections"] = without_entries(MARKED, "marked_rows")

    # --- chunks, vectors, search ---
    sql["chunk_documents"] = f"WITH {chunks()} SELECT * FROM chunks"

    sql["hashed_embedding"] = f"""
WITH {counted("documents", "doc_id", "counted")}
SELECT doc_id, bucket, round(n / norm, 6) AS weight FROM counted"""

    sql["semantic_search"] = f"""
WITH {chunks()},
{counted("benchmark", "item_id", "asked")},
{counted("chunks", "chunk_id, doc_id", "held")},
scored AS (
  SELECT a.item_id, h.chunk_id, h.doc_id,
         round(sum(a.n * h.n) / sqrt(any_value(a.norm * a.norm) * any_value(h.norm * h.norm)), 6) AS sim
  FROM asked a JOIN held h USING (bucket) GROUP BY ALL
)
SELECT item_id, chunk_id, doc_id, sim,
       (row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, chunk_id))::INTEGER AS rank
FROM scored QUALIFY rank <= 10"""

    sql["cosine_topk_exact"] = f"""
WITH {VECTORS},
scored AS (
  SELECT q.vec_id AS query_id, b.vec_id, {COSINE.format(a="q.v", b="b.v")} AS sim
  FROM vectors q JOIN vectors b ON q.vec_id <> b.vec_id
)
SELECT query_id, vec_id, sim,
       (row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id))::INTEGER AS rank
FROM scored QUALIFY rank <= 10"""

    sql["cosine_topk_kmeans"] = sql["cosine_topk_exact"]

    sql["ivf_cells"] = f"""
WITH {VECTORS}, {CENTROIDS}, {CELL_RANKS}
SELECT vec_id, cell FROM cell_ranks WHERE cell_rank = 1"""

    sql["cosine_topk_ivf"] = f"""
WITH {VECTORS}, {CENTROIDS}, {CELL_RANKS},
scored AS (
  SELECT p.vec_id AS query_id, m.vec_id, {COSINE.format(a="q.v", b="b.v")} AS sim
  FROM cell_ranks p
  JOIN cell_ranks m ON p.cell = m.cell AND m.cell_rank = 1 AND p.vec_id <> m.vec_id
  JOIN vectors q ON q.vec_id = p.vec_id
  JOIN vectors b ON b.vec_id = m.vec_id
  WHERE p.cell_rank <= 4
)
SELECT query_id, vec_id, sim,
       (row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id))::INTEGER AS rank
FROM scored QUALIFY rank <= 10"""

    # --- index upkeep ---
    sql["index_diff"] = f"""
WITH {CORPORA}
SELECT doc_id, CASE WHEN o.text IS NULL THEN 'insert' WHEN n.text IS NULL THEN 'delete'
                    WHEN o.text <> n.text THEN 'update' ELSE 'unchanged' END AS change
FROM old_docs o FULL OUTER JOIN new_docs n USING (doc_id)"""
    rebuilt = f"WITH {CORPORA}, {chunks('new_docs')} SELECT * FROM chunks"
    sql["index_apply"] = rebuilt
    sql["full_rebuild"] = rebuilt
    sql["index_apply_stream"] = sql["chunk_documents"]
    sql["point_index"] = f"WITH {POINTS} SELECT * FROM points"
    sql["full_rebuild_points"] = sql["point_index"]
    sql["point_vectors"] = f"""
WITH {counted("documents", "doc_id", "counted")}
SELECT doc_id AS point_id, bucket, round(n / norm, 6) AS weight FROM counted"""
    sql["dual_target_index"] = f"""
WITH {chunks()}
SELECT 'chunks' AS target, count(*) AS rows, count(DISTINCT doc_id) AS distinct_docs FROM chunks
UNION ALL
SELECT 'points', count(*), count(DISTINCT doc_id) FROM documents"""

    # --- health ---
    sql["chunk_index_health"] = f"""
WITH {chunks()}
SELECT layer, count(*) AS n_chunks, round(count(*) / sum(count(*)) OVER (), 6) AS share,
       round(count(symbol) / count(*), 6) AS symbol_coverage
FROM chunks GROUP BY layer"""
    sql["vector_index_health"] = f"""
WITH {POINTS}
SELECT layer, count(*) AS n_points, round(count(*) / sum(count(*)) OVER (), 6) AS share,
       round(count(summary) / count(*), 6) AS summary_coverage
FROM points GROUP BY layer"""

    # --- full text ---
    sql["fulltext_postings"] = postings("true")
    sql["fulltext_rebuild_tenant"] = postings("lang <> 'es' OR source = 'src3'")
    sql["fulltext_topk"] = f"""
WITH tokens AS (
  SELECT doc_id, unnest(string_split_regex(lower(text), '{TOKEN_SEPARATOR}')) AS term FROM documents
),
counts AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM tokens WHERE term <> '' GROUP BY ALL),
lengths AS (SELECT doc_id, sum(tf) AS dl FROM counts GROUP BY doc_id),
corpus AS (
  SELECT (SELECT count(*) FROM documents)::DOUBLE AS n,
         (SELECT sum(tf) FROM counts) / (SELECT count(*) FROM documents) AS avgdl
),
df AS (SELECT term, count(*)::DOUBLE AS df FROM counts GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, term FROM (
    SELECT item_id, unnest(string_split_regex(lower(text), '{TOKEN_SEPARATOR}')) AS term FROM benchmark)
  WHERE term <> ''
),
scored AS (
  SELECT item_id, doc_id,
         round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2
                   / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) AS score
  FROM asked JOIN counts USING (term) JOIN df USING (term) JOIN lengths USING (doc_id)
  CROSS JOIN corpus
  GROUP BY ALL
)
SELECT item_id, doc_id, score,
       (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank
FROM scored QUALIFY rank <= 10"""

    # --- accounts ---
    sql["tenant_scope"] = f"""
WITH {TENANTS}
SELECT account AS c_custkey, tenant FROM accounts WHERE tenant IN ('AMERICA', 'ASIA', 'EUROPE')"""
    sql["billing_run"] = billed("1998-10-01", "1998-11-01", "tenant = 'AMERICA'")
    sql["billing_run_daily"] = billed("1998-10-03", "1998-10-04", "true")
    days = [("1998-10-01", "1998-10-02"), ("1998-10-02", "1998-10-03"), ("1998-10-04", "1998-10-05")]
    by_day = [f"{billed_between(*d)} GROUP BY account" for d in days]
    on_days = " OR ".join(f"o_orderdate::DATE = DATE '{d}'" for d, _ in days)
    by_day.append(f"{billed_between('1998-10-01', '1998-11-01')} AND NOT ({on_days}) GROUP BY account")
    sql["billing_days_then_month"] = f"WITH {TENANTS}" + "\nUNION ALL".join(by_day)
    sql["billing_month_ends"] = f"""
WITH {TENANTS} {billed_between("1998-02-28", "1998-03-31")} GROUP BY account
UNION ALL {billed_between("1998-03-30", "1998-04-30")} AND o_orderdate >= TIMESTAMP '1998-03-31'
GROUP BY account"""
    sql["autopay_tenant"] = f"""
WITH {TENANTS}, {INVOICES}
SELECT account, period_start, amount, applied, balance,
       CASE WHEN balance = 0 THEN 'paid' WHEN applied > 0 THEN 'partial' ELSE 'open' END AS status
FROM balances JOIN accounts USING (account)
WHERE tenant = 'AMERICA' AND issued <= DATE '1998-01-15'"""
    sql["autopay_run"] = f"""
WITH {INVOICES}
SELECT account, period_start, amount, applied, balance,
       CASE WHEN balance = 0 THEN 'paid' WHEN applied > 0 THEN 'partial' ELSE 'open' END AS status
FROM balances"""
    sql["invoice_mark"] = f"""
WITH {INVOICES} SELECT account, period_start, due_date, due_date_marked FROM marked"""
    sql["invoice_delinquency"] = f"WITH {INVOICES} {delinquency('due_date')}"
    sql["delinquency_transitions"] = f"""
WITH {INVOICES}, old AS ({delinquency('due_date')}), new AS ({delinquency('due_date_marked')})
SELECT account, old.status AS old_status, new.status AS new_status
FROM old FULL OUTER JOIN new USING (account) WHERE old.status IS DISTINCT FROM new.status"""

    sql["semantic_search_published"] = sql["semantic_search"]

    # --- buckets, cells, blocks, charges ---
    points = POINTS.replace("FROM documents", "FROM new_docs")
    sql["bucket_chunks"] = rebuilt
    sql["bucket_points"] = f"WITH {CORPORA}, {points} SELECT * FROM points"
    sql["bucket_point_vectors"] = f"""
WITH {CORPORA}, {counted("new_docs", "doc_id", "counted")}
SELECT doc_id AS point_id, bucket, round(n / norm, 6) AS weight FROM counted"""
    sql["bucket_chunk_health"] = f"""
WITH {CORPORA}, {chunks("new_docs")}
SELECT layer, count(*) AS n_chunks, round(count(*) / sum(count(*)) OVER (), 6) AS share,
       round(count(symbol) / count(*), 6) AS symbol_coverage
FROM chunks GROUP BY layer"""
    sql["bucket_point_health"] = f"""
WITH {CORPORA}, {points}
SELECT layer, count(*) AS n_points, round(count(*) / sum(count(*)) OVER (), 6) AS share,
       round(count(summary) / count(*), 6) AS summary_coverage
FROM points GROUP BY layer"""
    bucket = "(('0x' || substr(md5(doc_id::VARCHAR), 1, 8))::BIGINT % {n})::INTEGER"
    sql["bucket_rewrites"] = f"""
WITH {chunks()}, toxic AS (SELECT doc_id FROM labels WHERE toxic = 1)
SELECT {bucket.format(n=16)} AS bucket, count(*) FILTER (doc_id NOT IN (FROM toxic)) AS n_chunks,
       bool_or(doc_id IN (FROM toxic)) AS rewritten
FROM chunks GROUP BY 1 HAVING count(*) FILTER (doc_id NOT IN (FROM toxic)) > 0"""
    sql["bucket_arrivals"] = f"""
WITH {CORPORA}, low AS (SELECT doc_id FROM labels WHERE quality = 0), toxic AS (SELECT doc_id FROM labels WHERE toxic = 1),
held AS (
  SELECT doc_id, lang, text FROM new_docs WHERE doc_id IN (FROM low)
  UNION ALL
  SELECT doc_id, lang, text FROM old_docs WHERE doc_id NOT IN (FROM toxic)
    AND doc_id NOT IN (SELECT doc_id FROM new_docs WHERE doc_id IN (FROM low))
)
SELECT {bucket.format(n=8)} AS part, count(*) AS n_documents,
       min(sha256('{{"lang":' || to_json(lang)::VARCHAR || ',"text":' || to_json(text)::VARCHAR || '}}')) AS least_hash
FROM held GROUP BY 1"""
    sql["cosine_topk_cells"] = f"""
WITH {VECTORS}, {CENTROIDS}, {CELL_RANKS},
sizes AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
asked AS (
  SELECT cell AS query_id, c AS q FROM centroids
  WHERE cell IN (SELECT label FROM sizes ORDER BY n DESC, label LIMIT 1)
     OR cell IN (SELECT label FROM sizes ORDER BY n, label LIMIT 1)
),
probes AS (
  SELECT query_id, q, cell FROM asked CROSS JOIN centroids
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {COSINE.format(a="q", b="c")} DESC, cell) <= 2
),
scored AS (
  SELECT query_id, v.vec_id, {COSINE.format(a="q", b="v.v")} AS sim
  FROM probes p JOIN cell_ranks m ON p.cell = m.cell AND m.cell_rank = 1 JOIN vectors v ON v.vec_id = m.vec_id
)
SELECT query_id, vec_id, sim,
       (row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id))::INTEGER AS rank
FROM scored QUALIFY rank <= 10"""
    sql["fulltext_topk_published"] = sql["fulltext_topk"]
    sql["billing_late_charges"] = f"""
WITH {TENANTS},
charges AS (
  SELECT account, o_orderdate::DATE AS day, o_totalprice::DECIMAL(18,2) AS amount,
         CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_orderdate < TIMESTAMP '1998-10-02' THEN 1
              WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_orderdate < TIMESTAMP '1998-10-03' THEN 2
              WHEN o_orderpriority <> '2-HIGH' AND o_orderdate < TIMESTAMP '1998-11-01' THEN 3
              ELSE 5 END AS run
  FROM orders JOIN accounts ON o_custkey = account
  WHERE o_orderdate >= TIMESTAMP '1998-10-01' AND o_orderdate < TIMESTAMP '1998-12-01'
),
runs(run, period_start, period_end) AS (
  VALUES (1, DATE '1998-10-01', DATE '1998-10-02'), (2, DATE '1998-10-02', DATE '1998-10-03'),
         (3, DATE '1998-10-01', DATE '1998-11-01'), (5, DATE '1998-11-01', DATE '1998-12-01')
)
SELECT account, period_start, period_end, run, count(*) AS n_charges, sum(amount)::DECIMAL(28,2) AS amount,
       count(*) FILTER (day < period_start) AS n_arrears,
       coalesce(sum(amount) FILTER (day < period_start), 0)::DECIMAL(28,2) AS arrears
FROM charges JOIN runs USING (run) GROUP BY account, period_start, period_end, run"""

    # --- snapshots and locations ---
    sql["snapshot_export"] = "\nUNION ALL".join(snapshot_hash(t) for t in SNAPSHOT_COLUMNS)
    sql["snapshot_import_all"] = sql["snapshot_export"]
    sql["snapshot_import_clean"] = "SELECT * FROM documents"
    sql["snapshot_damaged"] = """
SELECT * FROM (
  SELECT 'lineitem' AS "table", 'unlisted' AS problem, 0::BIGINT AS rows_listed, count(*) AS rows_found
  FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL
  SELECT 'documents', 'unlisted', 0, count(*) FROM documents WHERE lang = 'de'
) WHERE rows_found > 0"""
    sql["location_append"] = "SELECT * FROM events"
    sql["location_append_stream"] = "SELECT * FROM events"
    sql["location_latest"] = """
SELECT user_id, event_id, ts, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"""
    return sql
