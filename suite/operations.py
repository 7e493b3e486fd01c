"""Registry, tasks, graph, evaluation, verdict handling."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeweave import params as P
from lakeweave.operators import evaluate, profile, registry, rules, tasks, verdicts
from lakeweave.plans import jobs
from lakeweave.session import work_dir
from lakeweave.sources import benchlake, files
from lakeweave.sources import lake as L
from suite import common as C
from suite import matching as M
from suite import retrieval as R
from suite.common import query

NS = P.ID_NAMESPACE.replace("-", "")


def sql_uuid(seed: str) -> str:
    d = f"sha1(unhex('{NS}') || encode({seed}))"
    return (
        f"(SELECT d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' || "
        f"substr('89ab', CAST(('0x' || d[17:17]) AS INTEGER) % 4 + 1, 1) || d[18:20] || '-' || d[21:32] FROM (SELECT {d} AS d))"
    )


# Documents play uploads: their source is the tenant, and exact copies meet as duplicates.
SQL_UPLOADS = """
uploads AS (
  SELECT source AS tenant_id, 'doc' || (doc_id // 2) AS table_name, substr(sha256(text), 1, 16) AS content_hash,
         doc_id AS seq, to_timestamp(1700000000 + doc_id // 3)::TIMESTAMP AS uploaded_at FROM documents),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, content_hash ORDER BY uploaded_at, seq) AS place,
         first_value(tenant_id || ':' || table_name || ':' || content_hash) OVER (PARTITION BY tenant_id, content_hash ORDER BY uploaded_at, seq) AS seed
  FROM uploads)"""


def uploads(spark, sf_dir):
    return C.table(spark, sf_dir, "documents").selectExpr(
        "source AS tenant_id",
        "concat('doc', doc_id div 2) AS table_name",
        "substr(sha2(text, 256), 1, 16) AS content_hash",
        "doc_id AS seq",
        "timestamp_seconds(1700000000 + doc_id div 3) AS uploaded_at",
    )


@query(
    "ingest_dedup",
    f"""WITH {SQL_UPLOADS}
    SELECT tenant_id, seq, {sql_uuid("seed")} AS table_id, CASE WHEN place = 1 THEN 'INGESTED' ELSE 'REJECTED' END AS status
    FROM ordered""",
)
def ingest_dedup(spark, sf_dir):
    return registry.ingest(uploads(spark, sf_dir)).select("tenant_id", "seq", "table_id", "status")


@query(
    "ingest_dedup_known",
    f"""WITH {SQL_UPLOADS}
    SELECT tenant_id, seq, {sql_uuid("seed")} AS table_id,
           CASE WHEN seq % 2 = 1 AND place = 1 THEN 'INGESTED' ELSE 'REJECTED' END AS status
    FROM (SELECT u.tenant_id, u.seq, u.place2 AS place,
                 coalesce(k.seed, u.own) AS seed FROM (
            SELECT *, CASE WHEN EXISTS (SELECT 1 FROM ordered o WHERE o.tenant_id = x.tenant_id AND o.content_hash = x.content_hash AND o.seq % 2 = 0)
                           THEN 0 ELSE x.place END AS place2, x.seed AS own
            FROM ordered x WHERE seq % 2 = 1) u
          LEFT JOIN (SELECT tenant_id, content_hash, arg_min(tenant_id || ':' || table_name || ':' || content_hash, (uploaded_at, seq)) AS seed
                     FROM uploads WHERE seq % 2 = 0 GROUP BY ALL) k USING (tenant_id, content_hash))""",
)
def ingest_dedup_known(spark, sf_dir):
    """Odd uploads against a registry that already holds the even ones."""
    all_uploads = uploads(spark, sf_dir)
    known = registry.new_rows(registry.ingest(all_uploads.filter("seq % 2 = 0")))
    decided = registry.ingest(all_uploads.filter("seq % 2 = 1"), known)
    return decided.select("tenant_id", "seq", "table_id", "status")


# Customers and orders play registry rows, with a status by their priority or segment.
REGISTRY_EXPR = (
    "concat('t', o_orderkey) AS table_id",
    "o_orderpriority AS tenant_id",
    "'upload' AS source_system",
    "concat('/lake/', o_orderkey) AS source_uri",
    "concat('table', o_custkey) AS table_name",
    "bigint(o_totalprice) AS row_count",
    "bigint(o_orderkey % 9) AS col_count",
    "string(o_custkey % 7) AS schema_hash",
    "string(o_orderkey) AS content_hash",
    "concat('user', o_custkey % 3) AS uploaded_by",
    "o_orderdate AS uploaded_at",
    "o_orderdate + make_interval(0, 0, 0, int(o_orderkey % 40)) AS updated_at",
    "CASE o_orderstatus WHEN 'F' THEN 'READY' WHEN 'O' THEN 'ARCHIVED' ELSE 'PROFILING' END AS status",
)
SQL_REGISTRY = """
reg AS (SELECT 't' || o_orderkey AS table_id, o_orderpriority AS tenant_id, 'table' || o_custkey AS table_name,
  CAST(trunc(o_totalprice) AS BIGINT) AS row_count, o_orderkey % 9 AS col_count, CAST(o_custkey % 7 AS VARCHAR) AS schema_hash,
  'user' || (o_custkey % 3) AS uploaded_by, o_orderdate AS uploaded_at, o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER)) AS updated_at,
  CASE o_orderstatus WHEN 'F' THEN 'READY' WHEN 'O' THEN 'ARCHIVED' ELSE 'PROFILING' END AS status FROM orders)"""


def registry_rows(spark, sf_dir):
    return C.table(spark, sf_dir, "orders").selectExpr(*REGISTRY_EXPR)


NOW = "TIMESTAMP '2000-01-01 00:00:00'"


@query(
    "registry_page",
    f"""WITH {SQL_REGISTRY}, mine AS (SELECT * FROM reg WHERE tenant_id = '5-LOW' AND status = 'READY')
    SELECT table_id, table_name, tenant_id, status, row_count, col_count, uploaded_by, strftime(uploaded_at, '%Y-%m-%d') AS uploaded_on,
           (SELECT count(*) FROM mine) AS total
    FROM mine ORDER BY uploaded_at DESC, table_id LIMIT 50 OFFSET 100""",
)
def registry_page(spark, sf_dir):
    found = registry.page(registry_rows(spark, sf_dir), "5-LOW", "READY", offset=100, limit=50)
    return found.selectExpr(
        "table_id", "table_name", "tenant_id", "status", "row_count", "col_count", "uploaded_by",
        "date_format(uploaded_at, 'yyyy-MM-dd') AS uploaded_on", "total",
    )


@query(
    "registry_lookup",
    f"WITH {SQL_REGISTRY} SELECT table_id, tenant_id, status FROM reg WHERE table_id = 't7' AND tenant_id = (SELECT tenant_id FROM reg WHERE table_id = 't7')",
)
def registry_lookup(spark, sf_dir):
    """Of all tenants only the owner finds a table."""
    rows = registry_rows(spark, sf_dir)
    tenants = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    found = registry.lookup(rows, tenants[0], "t7")
    for tenant in tenants[1:]:
        found = found.unionByName(registry.lookup(rows, tenant, "t7"))
    return found.select("table_id", "tenant_id", "status")


@query(
    "archive_tables",
    f"""WITH {SQL_REGISTRY}
    SELECT table_id, CASE WHEN l.l_orderkey IS NOT NULL THEN 'ARCHIVED' ELSE status END AS status,
           strftime(CASE WHEN l.l_orderkey IS NOT NULL AND status <> 'ARCHIVED' THEN {NOW} ELSE updated_at END, '%Y-%m-%d') AS updated_on
    FROM reg LEFT JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R') l ON 't' || l.l_orderkey = table_id""",
)
def archive_tables(spark, sf_dir):
    """Tables named by returned line items are archived; some already are."""
    rows = registry_rows(spark, sf_dir)
    wanted = (
        C.table(spark, sf_dir, "lineitem")
        .filter("l_returnflag = 'R'")
        .selectExpr("concat('t', l_orderkey) AS table_id")
        .join(rows.select("table_id", "tenant_id"), "table_id")
    )
    return registry.archive(rows, wanted, F.expr(NOW)).selectExpr(
        "table_id", "status", "date_format(updated_at, 'yyyy-MM-dd') AS updated_on"
    )


@query(
    "vectors_without_archived",
    """SELECT vec_id, CASE WHEN label = 3 THEN 'DISABLED' ELSE 'READY' END AS status FROM embeddings
    WHERE vec_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')""",
)
def vectors_without_archived(spark, sf_dir):
    """Vectors of archived tables go; those of label 3 get another status."""
    emb = C.table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "concat('t', vec_id) AS table_id", "label", "'READY' AS status"
    )
    kept = registry.without_archived(emb, registry_rows(spark, sf_dir))
    return registry.set_vector_status(kept, emb.filter("label = 3"), "DISABLED").select("vec_id", "status")


@query(
    "registry_reupload",
    f"""WITH {SQL_REGISTRY},
    latest AS (SELECT tenant_id, table_name, arg_max(table_id, (uploaded_at, table_id)) AS table_id FROM reg WHERE status <> 'ARCHIVED' GROUP BY ALL),
    old AS (SELECT r.* FROM reg r JOIN latest USING (tenant_id, table_name, table_id)),
    new AS (SELECT tenant_id, table_name, table_id || 'n' AS table_id, row_count + 5 AS row_count,
                   CASE WHEN row_count % 2 = 0 THEN schema_hash ELSE schema_hash || 'x' END AS schema_hash FROM old WHERE col_count < 6)
    SELECT o.table_id, CASE WHEN n.schema_hash <> o.schema_hash THEN 'ARCHIVED' ELSE o.status END AS status,
           CASE WHEN n.schema_hash = o.schema_hash THEN n.row_count ELSE o.row_count END AS row_count, o.schema_hash
    FROM old o LEFT JOIN new n USING (tenant_id, table_name)
    UNION ALL SELECT n.table_id, 'INGESTED', n.row_count, n.schema_hash FROM new n JOIN old o USING (tenant_id, table_name) WHERE n.schema_hash <> o.schema_hash""",
)
def registry_reupload(spark, sf_dir):
    """Live tables come again: the same schema updates them, another one replaces them."""
    live = registry_rows(spark, sf_dir).filter("status <> 'ARCHIVED'")
    rest = [c for c in live.columns if c not in ("tenant_id", "table_name")]
    old = (
        live.groupBy("tenant_id", "table_name")
        .agg(F.max_by(F.struct(*rest), F.struct("uploaded_at", "table_id")).alias("r"))
        .select("tenant_id", "table_name", "r.*")
        .select(*live.columns)
    )
    new = (
        old.filter("col_count < 6")
        .withColumn("table_id", F.expr("concat(table_id, 'n')"))
        .withColumn("schema_hash", F.expr("if(row_count % 2 = 0, schema_hash, concat(schema_hash, 'x'))"))
        .withColumn("row_count", F.expr("row_count + 5"))
        .withColumn("status", F.lit("INGESTED"))
    )
    return registry.apply_reuploads(old, new, F.expr(NOW)).select("table_id", "status", "row_count", "schema_hash")


@query(
    "registry_retention",
    f"""WITH {SQL_REGISTRY} SELECT table_id, status FROM reg
    WHERE NOT (status = 'ARCHIVED' AND updated_at < {NOW} - INTERVAL 365 DAY)""",
)
def registry_retention(spark, sf_dir):
    kept = registry.collect_garbage(registry_rows(spark, sf_dir), F.expr(NOW), 365)
    return kept.select("table_id", "status")


@query(
    "rejected_requests",
    f"""WITH {SQL_REGISTRY}, req AS (SELECT l_orderkey, l_linenumber, 't' || l_orderkey AS table_id,
      CASE WHEN l_linenumber = 1 THEN '5-LOW' ELSE '2-HIGH' END AS tenant_id FROM lineitem)
    SELECT l_orderkey, l_linenumber FROM req ANTI JOIN (SELECT * FROM reg WHERE status = 'READY') r USING (table_id, tenant_id)""",
)
def rejected_requests(spark, sf_dir):
    """Line items ask for their order's table under some tenant."""
    asked = C.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "concat('t', l_orderkey) AS table_id",
        "if(l_linenumber = 1, '5-LOW', '2-HIGH') AS tenant_id",
    )
    found = registry.rejected_requests(asked, registry_rows(spark, sf_dir))
    return found.select("l_orderkey", "l_linenumber")


@query(
    "registry_recovery",
    f"""WITH {SQL_REGISTRY} SELECT table_id, 'INGESTED' AS status FROM reg WHERE status = 'PROFILING'""",
)
def registry_recovery(spark, sf_dir):
    reset, todo = registry.recover(registry_rows(spark, sf_dir))
    return reset.join(todo, "table_id", "left_semi").select("table_id", "status")


@query(
    "external_registration",
    f"""WITH p AS (SELECT *, substr(sha256(url), 1, 16) AS content_hash FROM pages)
    SELECT page_id, content_hash, {sql_uuid("'default:page' || page_id || ':' || content_hash")} AS table_id FROM p""",
)
def external_registration(spark, sf_dir):
    listed = C.table(spark, sf_dir, "pages").selectExpr(
        "page_id", "'default' AS tenant_id", "concat('page', page_id) AS table_name", "url AS source_uri"
    )
    return registry.register_external(listed, F.expr(NOW)).select("page_id", "content_hash", "table_id")


# ---- rules --------------------------------------------------------------------------------


@query(
    "subtask_rule",
    f"""WITH {C.SQL_COLUMNS},
    cells AS (SELECT table_id, ordinal, CAST(value AS VARCHAR) AS value FROM ({C.sql_cells(("int",), False, C.SCHEMAS)})
              UNION ALL SELECT table_id, ordinal, value FROM ({C.sql_cells(("str",), False, C.SCHEMAS)})),
    keys AS (SELECT table_id, bool_or(r > {P.KEY_DISTINCT_RATIO}) AS has_key FROM (
      SELECT table_id, ordinal, count(DISTINCT value) / count(*) AS r FROM cells GROUP BY ALL) GROUP BY table_id),
    q AS (SELECT k.table_id, h.hint, k.has_key FROM keys k, (VALUES (''), ('please JOIN'), ('合并 rows'), ('other')) h(hint))
    SELECT table_id || '|' || hint AS query_id, CASE WHEN hint LIKE '%JOIN%' THEN 'JOIN' WHEN hint LIKE '%合并%' THEN 'UNION'
           WHEN has_key THEN 'JOIN' WHEN hint = 'other' THEN 'UNION' ELSE 'JOIN' END AS subtask FROM q""",
)
def subtask_rule(spark, sf_dir):
    """Every given table under four hints; the last one has an outside verdict for UNION."""
    profiles = C.base_store(spark, sf_dir).profiles
    asked = profiles.select("table_id").distinct().selectExpr(
        "table_id", "explode(array('', 'please JOIN', '合并 rows', 'other')) AS hint"
    ).withColumn("query_id", F.concat_ws("|", "table_id", "hint"))
    per_query = asked.select(F.col("query_id"), "table_id").join(profiles, "table_id").drop("table_id")
    answers = asked.filter("hint = 'other'").selectExpr("query_id", "'UNION' AS subtask")
    return rules.detect_subtask(
        asked.select("query_id", "hint"), per_query.withColumnRenamed("query_id", "table_id"), answers
    )


@query(
    "scenario_rule",
    f"""WITH {C.SQL_BENCH_COLUMNS}, {M.SQL_BENCH_SIZES}
    SELECT table_id, {M.SQL_SCENARIO} AS target_rule, 'SLD' AS source_rule, 'SSD' AS hinted FROM sizes""",
)
def scenario_rule(spark, sf_dir):
    """Both rules, and a hint, for every table of the benchmark lake."""
    store = C.store(spark, sf_dir)
    plain = store.tables.select("table_id", "row_count", F.lit(None).cast("string").alias("hint"))
    out = rules.detect_scenario(plain, store.profiles).withColumnRenamed("scenario", "target_rule")
    source = rules.detect_scenario(plain, store.profiles, mode="source")
    hinted = rules.detect_scenario(plain.withColumn("hint", F.lit("SSD")), store.profiles)
    return out.join(source.withColumnRenamed("scenario", "source_rule"), "table_id").join(
        hinted.withColumnRenamed("scenario", "hinted"), "table_id"
    )


# ---- verdicts ------------------------------------------------------------------------------

# Conversations play scoring requests: a turn is a candidate, its length the score, and a
# conversation that opens with a system turn was answered with plain text instead of JSON.
SQL_RESPONSES = """
answers AS (
  SELECT conv_id, bool_or(role = 'system') AS plain, bool_and(length(text) / 1000 <= 1) AS in_range FROM conversations GROUP BY conv_id)"""


def responses(spark, sf_dir):
    entry = F.expr("named_struct('candidate_idx', turn + 1, 'score', length(text) / 1000, 'reason', role)")
    return (
        C.table(spark, sf_dir, "conversations")
        .groupBy("conv_id")
        .agg(
            F.array_sort(F.collect_list(entry)).alias("scores"),
            F.bool_or(F.col("role") == "system").alias("plain"),
            F.max("text").alias("text"),
        )
        .select(
            F.col("conv_id").alias("query_id"),
            F.lit(0).alias("batch_no"),
            F.when(F.col("plain"), F.col("text")).otherwise(F.to_json(F.struct("scores"))).alias("content"),
        )
    )


@query(
    "verdict_parse",
    f"""WITH {SQL_RESPONSES}
    SELECT conv_id AS query_id, CAST(turn + 1 AS BIGINT) AS candidate_idx, round(length(text) / 1000, 6) AS score
    FROM conversations JOIN answers USING (conv_id) WHERE NOT plain AND in_range""",
)
def verdict_parse(spark, sf_dir):
    scores, _ = verdicts.parse_table_verdicts(responses(spark, sf_dir))
    return scores.selectExpr("query_id", "bigint(candidate_idx) AS candidate_idx", "round(score, 6) AS score")


@query(
    "verdict_rejects",
    f"WITH {SQL_RESPONSES} SELECT conv_id AS query_id FROM answers WHERE plain OR NOT in_range",
)
def verdict_rejects(spark, sf_dir):
    _, rejects = verdicts.parse_table_verdicts(responses(spark, sf_dir))
    return rejects.select("query_id")


@query(
    "verdict_resolve",
    f"""WITH {SQL_RESPONSES}
    SELECT conv_id AS query_id, 't' || turn AS table_id, round(length(text) / 1000, 6) AS s3
    FROM conversations JOIN answers USING (conv_id) WHERE NOT plain AND in_range""",
)
def verdict_resolve(spark, sf_dir):
    """Numbers within a request back to the tables they stand for."""
    scores, _ = verdicts.parse_table_verdicts(responses(spark, sf_dir))
    batches = C.table(spark, sf_dir, "conversations").selectExpr(
        "conv_id AS query_id", "0 AS batch_no", "int(turn + 1) AS candidate_idx", "concat('t', turn) AS table_id"
    )
    found = verdicts.resolve_verdicts(batches, scores)
    return found.selectExpr("query_id", "table_id", "round(s3, 6) AS s3")


@query(
    "verdict_scorer",
    """SELECT doc_id, CASE WHEN length(text) % 7 = 0 THEN 0 ELSE round(least(1, length(text) / 40000), 6) END AS confidence,
      length(text) % 7 <> 0 AND length(text) % 2 = 0 AS is_equivalent FROM documents""",
)
def verdict_scorer(spark, sf_dir):
    """A scorer of the user's own over all documents; every seventh length fails and counts as no match."""

    def load():
        import json

        def ask(prompts):
            return [
                None if len(p) % 7 == 0
                else json.dumps({"reasoning": "length", "score": min(1.0, len(p) / 40000), "is_equivalent": len(p) % 2 == 0})
                for p in prompts
            ]

        return ask

    asked = C.table(spark, sf_dir, "documents").selectExpr("doc_id AS source_col_id", "doc_id AS target_col_id", "text AS prompt")
    raw = verdicts.run_scorer(asked, load, ["source_col_id", "target_col_id"], "prompt")
    good, _ = verdicts.parse_pair_verdicts(raw)
    return verdicts.attach_pair_verdicts(asked, good).selectExpr(
        "source_col_id AS doc_id", "round(confidence, 6) AS confidence", "is_equivalent"
    )


@query(
    "pair_verdict_parse",
    """SELECT doc_id, CASE WHEN n_chars / 1000 <= 1 AND length(lang || text) <= 300 THEN round(n_chars / 1000, 6) ELSE 0 END AS confidence,
      n_chars / 1000 <= 1 AND length(lang || text) <= 300 AND lang = 'en' AS is_equivalent FROM documents""",
)
def pair_verdict_parse(spark, sf_dir):
    """Documents as answers to pair requests: long texts break the bounds and count as no match."""
    docs = C.table(spark, sf_dir, "documents")
    answers = docs.select(
        F.col("doc_id").alias("source_col_id"),
        F.col("doc_id").alias("target_col_id"),
        F.expr("to_json(named_struct('reasoning', lang || text, 'score', n_chars / 1000, 'is_equivalent', lang = 'en'))").alias("content"),
    )
    good, _ = verdicts.parse_pair_verdicts(answers)
    pairs = docs.selectExpr("doc_id AS source_col_id", "doc_id AS target_col_id")
    return verdicts.attach_pair_verdicts(pairs, good).selectExpr(
        "source_col_id AS doc_id", "round(confidence, 6) AS confidence", "is_equivalent"
    )


@query(
    "verdict_cache",
    f"""WITH now AS (SELECT max(ts) AS t FROM events),
    pairs AS (SELECT DISTINCT user_id, event_type FROM events),
    fresh AS (SELECT user_id, event_type, arg_max(value, ts) AS s3 FROM events, now
              WHERE ts > t - INTERVAL {P.VERDICT_TTL_HOURS} HOUR GROUP BY ALL)
    SELECT user_id, event_type, s3 FROM pairs LEFT JOIN fresh USING (user_id, event_type)""",
)
def verdict_cache(spark, sf_dir):
    """Events play cached verdicts of (user, type) pairs; a pair without a fresh one is a miss."""
    events = C.table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0]
    key = ["user_id", "event_type"]
    hits, misses = verdicts.split_by_cache(
        events.select(*key).distinct(), events.selectExpr(*key, "value AS s3", "ts"), key, F.lit(now)
    )
    return hits.select(*key, "s3").unionByName(misses.select(*key, F.lit(None).cast("double").alias("s3")))


@query(
    "request_batches",
    f"""WITH {M.SQL_BENCH_BASE},
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, table_id) - 1 AS place FROM c2)
    SELECT query_id, table_id, place // {P.VERDICT_BATCH} AS batch_no, place % {P.VERDICT_BATCH} + 1 AS candidate_idx FROM placed""",
)
def request_batches(spark, sf_dir):
    store = C.store(spark, sf_dir)
    c2 = R.lake_layer_two(store, R.planned(store))
    return verdicts.request_batches(c2).selectExpr(
        "query_id", "table_id", "bigint(batch_no) AS batch_no", "bigint(candidate_idx) AS candidate_idx"
    )


@query(
    "table_prompts",
    f"""WITH {M.SQL_BENCH_BASE},
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, table_id) - 1 AS place FROM c2),
    shape AS (
      SELECT table_id, list({{'name': col_name, 'type': col_type}} ORDER BY ordinal) AS cols FROM bcols GROUP BY table_id),
    lists AS (
      SELECT query_id, place // {P.VERDICT_BATCH} AS batch_no,
             list({{'candidate_idx': place % {P.VERDICT_BATCH} + 1, 'name': table_id, 'columns': cols[1:{P.CANDIDATE_COLUMNS_SHOWN}]}} ORDER BY place) AS candidates
      FROM placed JOIN shape USING (table_id) GROUP BY ALL)
    SELECT query_id, batch_no, md5(CAST(to_json({{
      'task': 'JOIN',
      'relation': '{verdicts._RELATIONS['JOIN']}',
      'query': {{'name': query_id, 'columns': cols[1:{P.QUERY_COLUMNS_SHOWN}]}},
      'candidates': candidates,
      'reply': {{'scores': [{{'candidate_idx': 'integer', 'score': 'number, 0 to 1', 'reason': 'string, {verdicts._MAX_REASON} characters at most'}}]}}
    }}) AS VARCHAR)) AS request_md5
    FROM lists JOIN shape ON shape.table_id = query_id""",
)
def table_prompts(spark, sf_dir):
    store = C.store(spark, sf_dir)
    queries = R.planned(store)
    batches = verdicts.request_batches(R.lake_layer_two(store, queries))
    prompts = verdicts.table_prompts(batches, queries, store.tables, store.profiles)
    return prompts.selectExpr("query_id", "bigint(batch_no) AS batch_no", "md5(request) AS request_md5")


@query(
    "pair_prompts",
    f"""WITH RECURSIVE {M.SQL_BASE_PAIRS}
    SELECT source_table_id, target_table_id, scenario, source_column AS source_name, target_column AS target_name,
           round(round(sim_name::DOUBLE, 9), 4) AS name_similarity, round(round(sim_type::DOUBLE, 9), 4) AS type_similarity,
           CASE WHEN scenario = 'SLD' THEN round(round(m_score::DOUBLE, 9), 4) END AS mixed_score, scenario <> 'SMD' AS has_samples
    FROM scores WHERE round(m_score, 9) >= {P.THETA_CAND}
    QUALIFY row_number() OVER (PARTITION BY source_table_id, target_table_id, src_idx ORDER BY round(m_score, 9) DESC, tgt_idx) = 1""",
)
def pair_prompts(spark, sf_dir):
    """What the requests for the best column pairs of the given tables say, read back from their JSON."""
    store = C.base_store(spark, sf_dir)
    pairs = M._with_scenario(store, M._same_tenant_pairs(store))
    best = M.matching.top_targets(M.matching.pair_scores(pairs, store.features), 1)
    prompts = verdicts.pair_prompts(best, store.profiles)

    def said(path, kind="double"):
        return f"cast(get_json_object(prompt, '$.{path}') AS {kind})"

    return prompts.selectExpr(
        *M.matching.PAIR,
        f"{said('scenario', 'string')} AS scenario",
        f"{said('source.name', 'string')} AS source_name",
        f"{said('target.name', 'string')} AS target_name",
        *[f"{said('scores.' + n)} AS {n}" for n in ("name_similarity", "type_similarity", "mixed_score")],
        f"{said('source.samples', 'string')} IS NOT NULL AS has_samples",
    )


# ---- evaluation ------------------------------------------------------------------------------

SQL_UNION_TRUTH = """
truth AS (SELECT DISTINCT a.table_id AS query_id, b.table_id FROM bcols a JOIN bcols b ON a.base = b.base AND a.table_id <> b.table_id)"""


@query(
    "recall_at_k",
    f"""WITH RECURSIVE {M.SQL_DISCOVER_UNION}, {SQL_UNION_TRUTH}
    SELECT t.query_id, count(*) AS n_true, count(r.table_id) AS n_found, round(count(r.table_id) / count(*), 9) AS recall
    FROM truth t LEFT JOIN (SELECT * FROM ranking WHERE rank <= 10) r USING (query_id, table_id) GROUP BY t.query_id""",
)
def recall_at_k(spark, sf_dir):
    """Share of unionable parts among the first ten ranked tables of every query."""
    store = C.store(spark, sf_dir)
    ranking = jobs.discover(M.all_queries(store, "UNION"), store).ranking
    truth = benchlake.union_truth(C.bench_lake(spark, sf_dir))
    return evaluate.recall_at_k(ranking, truth, 10).withColumn("recall", F.round("recall", 9))


@query(
    "match_quality",
    f"""WITH RECURSIVE {M.SQL_MATCH},
    truth AS (
      SELECT a.table_id AS source_table_id, a.col_name AS source_column, b.table_id AS target_table_id, b.col_name AS target_column
      FROM bcols a JOIN bcols b ON a.base = b.base AND a.ordinal = b.ordinal AND a.table_id <> b.table_id
      JOIN ranking r ON r.query_id = a.table_id AND r.table_id = b.table_id),
    both_sides AS (
      SELECT f.source_table_id AS f, t.source_table_id AS t FROM accepted f FULL OUTER JOIN truth t
      USING (source_table_id, source_column, target_table_id, target_column))
    SELECT count(f) AS n_found, count(t) AS n_true, count_if(f IS NOT NULL AND t IS NOT NULL) AS n_right,
           round(count_if(f IS NOT NULL AND t IS NOT NULL) / count(f), 9) AS precision,
           round(count_if(f IS NOT NULL AND t IS NOT NULL) / count(t), 9) AS recall,
           round(2 * count_if(f IS NOT NULL AND t IS NOT NULL) / (count(f) + count(t)), 9) AS f1
    FROM both_sides""",
)
def match_quality(spark, sf_dir):
    """Column matches of all UNION queries against the known ones between ranked tables."""
    store = C.store(spark, sf_dir)
    found, maps = jobs.integrate(M.all_queries(store, "UNION"), store)
    truth = benchlake.match_truth(C.bench_lake(spark, sf_dir), store.profiles)
    ranked = found.ranking.selectExpr("query_id AS source_table_id", "table_id AS target_table_id")
    truth = truth.join(ranked, ["source_table_id", "target_table_id"], "left_semi")
    return evaluate.match_quality(maps, truth).selectExpr(
        "n_found", "n_true", "n_right", *[f"round({c}, 9) AS {c}" for c in ("precision", "recall", "f1")]
    )


@query(
    "layer_trace",
    f"""WITH RECURSIVE {M.SQL_DISCOVER_UNION}, {SQL_UNION_TRUTH},
    members AS (SELECT 1 AS l, query_id, table_id FROM c1 UNION ALL SELECT 2, query_id, table_id FROM c2 UNION ALL SELECT 3, query_id, table_id FROM c3),
    sizes AS (
      SELECT b.table_id AS query_id, l.l, count(m.table_id) AS n, count(t.table_id) AS n_true
      FROM blobs b CROSS JOIN (VALUES (1), (2), (3)) l(l) LEFT JOIN members m ON m.query_id = b.table_id AND m.l = l.l
      LEFT JOIN truth t ON t.query_id = m.query_id AND t.table_id = m.table_id GROUP BY ALL)
    SELECT query_id, 'L' || l AS layer, lag(n, 1, 111) OVER w AS input_size, n AS output_size,
           round((lag(n_true, 1, 7) OVER w - n_true) / 7, 9) AS recall_loss, round(1 - n / 111, 9) AS pruning
    FROM sizes WINDOW w AS (PARTITION BY query_id ORDER BY l)""",
)
def layer_trace(spark, sf_dir):
    store = C.store(spark, sf_dir)
    d = jobs.discover(M.all_queries(store, "UNION"), store)
    pool = d.queries.join(
        store.tables.groupBy("tenant_id").agg((F.count("*") - 1).alias("pool_size")), "tenant_id"
    ).select("query_id", "pool_size")
    truth = benchlake.union_truth(C.bench_lake(spark, sf_dir))
    return evaluate.layer_trace(pool, [d.c1, d.c2, d.c3], truth).selectExpr(
        "query_id", "layer", "input_size", "output_size", "round(recall_loss, 9) AS recall_loss",
        "round(pruning, 9) AS pruning",
    )


# ---- tasks and graph: orders play tasks, their line items ranked tables and mappings -----------

SQL_TASKS = """
tasks AS (SELECT o_orderkey AS task_id, CASE o_orderstatus WHEN 'F' THEN 'DISCOVER_ONLY' WHEN 'O' THEN 'MATCH_ONLY' ELSE 'INTEGRATE' END AS task_type,
  'c' || o_custkey AS query_table_id, CASE WHEN o_orderstatus = 'O' THEN 'p' || o_custkey END AS target_table_id FROM orders),
best AS (SELECT l_orderkey AS task_id, 's' || l_suppkey AS table_id, max(l_discount) AS score, max(l_tax) AS s1 FROM lineitem GROUP BY ALL),
ranking AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY round(score, 9) DESC, table_id) AS rank FROM best),
mappings AS (SELECT l_orderkey AS task_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS mapping_id,
  'p' || (l_partkey % 50) AS src, 's' || (l_suppkey % 50) AS tgt, l_discount AS confidence, l_returnflag = 'R' AS is_matched, l_linestatus AS scenario FROM lineitem)"""


def task_frames(spark, sf_dir):
    orders, items = C.table(spark, sf_dir, "orders"), C.table(spark, sf_dir, "lineitem")
    made = orders.selectExpr(
        "o_orderkey AS task_id",
        "CASE o_orderstatus WHEN 'F' THEN 'DISCOVER_ONLY' WHEN 'O' THEN 'MATCH_ONLY' ELSE 'INTEGRATE' END AS task_type",
        "concat('c', o_custkey) AS query_table_id",
        "if(o_orderstatus = 'O', concat('p', o_custkey), NULL) AS target_table_id",
        "'RUNNING' AS status",
    )
    scored = items.groupBy(F.col("l_orderkey").alias("task_id"), F.expr("concat('s', l_suppkey)").alias("table_id")).agg(
        F.max("l_discount").alias("score"), F.expr("named_struct('s1', max(l_tax))").alias("layer_scores")
    )
    mapped = items.selectExpr(
        "l_orderkey AS task_id",
        "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS mapping_id",
        "concat('p', l_partkey % 50) AS src_column_id",
        "concat('s', l_suppkey % 50) AS tgt_column_id",
        "l_discount AS confidence",
        "l_returnflag = 'R' AS is_matched",
        "l_linestatus AS scenario",
        "l_returnflag AS reasoning",
    )
    return made, tasks.ranking_rows(scored), mapped


@query(
    "task_rankings",
    f"WITH {SQL_TASKS} SELECT task_id, rank, table_id AS candidate_table, score FROM ranking",
)
def task_rankings(spark, sf_dir):
    _, ranking, _ = task_frames(spark, sf_dir)
    return ranking.selectExpr("task_id", "bigint(rank) AS rank", "candidate_table", "score")


@query(
    "task_results",
    f"""WITH {SQL_TASKS}, failed AS (SELECT DISTINCT l_orderkey AS task_id FROM lineitem WHERE l_quantity = 50)
    SELECT t.task_id, CASE WHEN f.task_id IS NULL THEN 'SUCCESS' ELSE 'FAILED' END AS status,
           CASE WHEN f.task_id IS NOT NULL THEN 0 WHEN task_type = 'DISCOVER_ONLY' THEN (SELECT count(*) FROM ranking r WHERE r.task_id = t.task_id)
                ELSE (SELECT count(*) FROM mappings m WHERE m.task_id = t.task_id) END AS output_size
    FROM tasks t LEFT JOIN failed f ON f.task_id = t.task_id""",
)
def task_results(spark, sf_dir):
    made, ranking, mapped = task_frames(spark, sf_dir)
    failures = (
        C.table(spark, sf_dir, "lineitem")
        .filter("l_quantity = 50")
        .selectExpr("l_orderkey AS task_id", "'too large' AS error_message")
        .distinct()
    )
    return tasks.finish(made, ranking, mapped, failures).select("task_id", "status", "output_size")


@query(
    "task_details",
    f"""WITH {SQL_TASKS}
    SELECT t.task_id, any_value(task_type) AS task_type,
           (SELECT string_agg(rank || '/' || table_id, ',' ORDER BY rank) FROM ranking r WHERE r.task_id = t.task_id) AS ranked,
           (SELECT string_agg(src || '>' || tgt, ',' ORDER BY mapping_id) FROM mappings m WHERE m.task_id = t.task_id) AS mapped,
           (SELECT round(sum(s1), 6) FROM ranking r WHERE r.task_id = t.task_id) AS s1
    FROM tasks t GROUP BY t.task_id""",
)
def task_details(spark, sf_dir):
    made, ranking, mapped = task_frames(spark, sf_dir)
    steps = ranking.selectExpr("task_id", "rank AS step_id", "'Retrieval' AS agent")
    return tasks.detail(made, steps, ranking, mapped).selectExpr(
        "task_id",
        "task_type",
        "concat_ws(',', transform(ranking, x -> concat(x.rank, '/', x.candidate_table))) AS ranked",
        "concat_ws(',', transform(mappings, x -> concat(x.src_column_id, '>', x.tgt_column_id))) AS mapped",
        "round(aggregate(ranking, 0D, (s, x) -> s + x.layer_scores.s1), 6) AS s1",
    ).selectExpr("task_id", "task_type", "nullif(ranked, '') AS ranked", "nullif(mapped, '') AS mapped", "s1")


@query(
    "result_sink",
    f"""WITH {SQL_TASKS} SELECT task_id, rank, table_id AS candidate_table, round(score, 9) AS score FROM ranking""",
)
def result_sink(spark, sf_dir):
    """Rankings written in two batches, one of them replayed, and read back."""
    _, ranking, _ = task_frames(spark, sf_dir)
    path = work_dir(spark, "results")
    for batch in (0, 1, 1):
        tasks.write_results(ranking.filter(F.pmod(F.xxhash64("task_id"), F.lit(2)) == batch), path, batch)
    return tasks.read_results(spark, path).selectExpr("task_id", "bigint(rank) AS rank", "candidate_table", "round(score, 9) AS score")


@query(
    "graph_nodes",
    f"""WITH {SQL_TASKS},
    seen AS (
      SELECT task_id, 'table:' || query_table_id AS id, 1 AS prio, CASE WHEN task_type = 'MATCH_ONLY' THEN 'source_table' ELSE 'query_table' END AS kind, 'normal' AS status FROM tasks
      UNION ALL SELECT task_id, 'table:' || target_table_id, 2, 'target_table', 'normal' FROM tasks WHERE target_table_id IS NOT NULL
      UNION ALL SELECT task_id, 'table:' || table_id, 3, 'candidate_table', 'normal' FROM ranking
      UNION ALL SELECT task_id, 'column:' || src, 10 + 2 * mapping_id, 'source_column', CASE WHEN is_matched THEN 'matched' ELSE 'normal' END FROM mappings
      UNION ALL SELECT task_id, 'column:' || tgt, 11 + 2 * mapping_id, 'target_column', CASE WHEN is_matched THEN 'matched' ELSE 'normal' END FROM mappings)
    SELECT task_id, id, arg_max(kind, prio) AS kind, arg_max(status, prio) AS status FROM seen GROUP BY ALL""",
)
def graph_nodes(spark, sf_dir):
    return tasks.graph_nodes(*task_frames(spark, sf_dir)).select("task_id", "id", "kind", "status")


@query(
    "graph_edges",
    f"""WITH {SQL_TASKS}
    SELECT r.task_id, 'discovery:' || query_table_id || ':' || table_id AS id, 'discovery' AS kind, 'table:' || query_table_id AS source,
           'table:' || table_id AS target, '#' || rank || ' ' || printf('%.3f', score) AS label, score AS weight, s1 AS metric FROM ranking r JOIN tasks USING (task_id)
    UNION ALL SELECT task_id, 'mapping:' || mapping_id, 'mapping', 'column:' || src, 'column:' || tgt, printf('%.3f', confidence), confidence, NULL FROM mappings""",
)
def graph_edges(spark, sf_dir):
    return tasks.graph_edges(*task_frames(spark, sf_dir)).selectExpr(
        "task_id", "id", "kind", "source", "target", "label", "weight", "metrics['s1'] AS metric"
    )


# ---- files -------------------------------------------------------------------------------------


@query(
    "csv_round_trip",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer",
)
def csv_round_trip(spark, sf_dir):
    """Customers written as CSV and read back with types and encoding found out."""
    path = work_dir(spark, "customer") + ".csv"
    C.table(spark, sf_dir, "customer").write.csv(path, header=True)
    return files.read_table(spark, path).selectExpr(
        "bigint(c_custkey) AS c_custkey", "c_name", "int(c_nationkey) AS c_nationkey", "c_acctbal", "c_mktsegment"
    )


@query(
    "csv_ragged",
    """WITH rows AS (SELECT o_orderkey // 4000 AS part, o_orderkey % 1999 = 7 AS longer, o_custkey FROM orders),
    files AS (SELECT part, count(*) AS n, count_if(longer) AS n_longer, count(DISTINCT o_custkey) AS n_values FROM rows GROUP BY part)
    SELECT part, CASE WHEN n_longer > 0 THEN 'FAILED' ELSE 'INGESTED' END AS status,
           CASE WHEN n_longer > 0 THEN n_longer || ' rows have more cells than the header' END AS error,
           CASE WHEN n_longer > 0 THEN 0 ELSE n END AS row_count, CAST(CASE WHEN n_longer > 0 THEN 0 ELSE 3 END AS BIGINT) AS col_count,
           CASE WHEN n_longer = 0 THEN n_values END AS n_values
    FROM files""",
)
def csv_ragged(spark, sf_dir):
    """Orders as CSV files with a line break in the header and in cells; some files have rows with a cell too many."""
    path = work_dir(spark, "ragged")
    line = """concat(o_orderkey, ',"', o_orderstatus, chr(10), '",', o_custkey, if(o_orderkey % 1999 = 7, ',x', ''))"""
    lines = C.table(spark, sf_dir, "orders").selectExpr("o_orderkey div 4000 AS part", f"{line} AS line")
    # Files of 4000 rows at most, so their number grows with the table and not their size.
    lines.groupBy("part").agg(
        F.expr("""concat('"order', chr(10), 'key",status,customer', chr(10), concat_ws(chr(10), collect_list(line)))""").alias("value")
    ).write.partitionBy("part").text(path)
    tables, columns, cells = files.bulk_ingest(spark, path, "x", F.current_timestamp(), pattern="*.txt")
    customers = columns.filter("col_name = 'customer'").select("table_id", "ordinal")
    different = cells.whole.join(customers, ["table_id", "ordinal"]).groupBy("table_id").agg(F.countDistinct("value").alias("n_values"))
    part = F.regexp_extract("source_uri", "part=([0-9]+)", 1).cast("bigint").alias("part")
    shape = [F.col(c).cast("bigint") for c in ("row_count", "col_count")]
    return tables.join(different, "table_id", "left").select(part, "status", "error", *shape, "n_values")


@query("csv_quoting", "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents")
def csv_quoting(spark, sf_dir):
    """Documents, with their line breaks and quotes, written as CSV and read back."""
    path = work_dir(spark, "documents") + ".csv"
    C.table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text").write.csv(
        path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False
    )
    return files.read_table(spark, path).select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


@query(
    "schema_catalog",
    f"""WITH {C.SQL_COLUMNS}, sizes AS ({" UNION ALL ".join(f"SELECT '{t}' AS table_id, count(*) AS row_count FROM {t}" for t in C.TABLES)})
    SELECT table_id AS table_name, any_value(row_count) || ' rows' AS table_desc,
           string_agg(ordinal || ':' || col_name || ':' || col_type || ':' || (ordinal = 0), ',' ORDER BY ordinal) AS columns
    FROM cols JOIN sizes USING (table_id) GROUP BY table_id""",
)
def schema_catalog(spark, sf_dir):
    """The catalog of the given tables written as a schema listing and read back."""
    path = work_dir(spark, "schema") + ".csv"
    groups = C.lake(spark, sf_dir)
    counted = L.lake_columns(groups).join(L.row_counts(groups), "table_id")
    listed = counted.orderBy("table_id", "ordinal").selectExpr(
        "table_id AS TableName", "concat(row_count, ' rows') AS TableDesc", "col_name AS ColumnName",
        "upper(col_type) AS ColumnType", "'' AS ColumnDesc", "if(ordinal = 0, 'Yes', 'NO') AS IsPK", "'NO' AS IsFK",
    )
    listed.coalesce(1).write.csv(path, header=True)
    return files.schema_catalog(spark, path).selectExpr(
        "table_name", "table_desc",
        "concat_ws(',', transform(columns, c -> concat_ws(':', string(c.ordinal), c.name, c.type, string(c.is_pk)))) AS columns",
    )


@query(
    "manifest_round_trip",
    f"""WITH {C.SQL_COLUMNS}, sizes AS ({" UNION ALL ".join(f"SELECT '{t}' AS table_id, count(*) AS row_count FROM {t}" for t in C.TABLES)})
    SELECT table_id, row_count, CAST(ordinal AS BIGINT) AS ordinal, col_name, col_type FROM cols JOIN sizes USING (table_id)""",
)
def manifest_round_trip(spark, sf_dir):
    groups = C.lake(spark, sf_dir)
    path = work_dir(spark, "manifests")
    files.write_manifests(L.catalog(groups), L.lake_columns(groups), path)
    listed, columns = files.read_manifests(spark, path)
    return listed.join(columns, "table_id").select("table_id", "row_count", "ordinal", "col_name", "col_type")


@query(
    "bulk_ingest",
    """WITH t AS (SELECT c_mktsegment AS part, count(*) AS row_count, round(avg(c_acctbal), 4) AS mean FROM customer GROUP BY ALL)
    SELECT part, row_count, CAST(4 AS BIGINT) AS col_count, 'INGESTED' AS status, mean FROM t""",
)
def bulk_ingest(spark, sf_dir):
    """Customers as one CSV file per market segment, ingested as that many tables."""
    path = work_dir(spark, "bulk")
    C.table(spark, sf_dir, "customer").repartition("c_mktsegment").write.partitionBy("c_mktsegment").csv(path, header=True)
    tables, columns, cells = files.bulk_ingest(spark, path, "default", F.expr(NOW), pattern="*.csv")
    balance = columns.filter("col_name = 'c_acctbal'").select("table_id", "ordinal")
    mean = profile.cell_summary(cells).join(balance, profile.KEY).select("table_id", F.round("mean", 4).alias("mean"))
    part = F.regexp_extract("source_uri", "c_mktsegment=([^/]*)", 1)
    return tables.join(mean, "table_id").select(part.alias("part"), "row_count", "col_count", "status", "mean")


@query(
    "bulk_ingest_parquet",
    """WITH t AS (SELECT c_mktsegment AS part, count(*) AS row_count, sum(c_custkey) AS keys FROM customer GROUP BY ALL)
    SELECT part, CAST(sum(row_count) AS BIGINT) AS row_count, CAST(4 AS BIGINT) AS col_count, CAST(sum(keys) AS DOUBLE) AS keys FROM t GROUP BY ALL""",
)
def bulk_ingest_parquet(spark, sf_dir):
    """Customers as parquet files in a folder per market segment, each file a table; counts and keys per folder."""
    path = work_dir(spark, "bulk-parquet")
    customers = C.table(spark, sf_dir, "customer").withColumn("c_custkey", F.col("c_custkey").cast("long"))
    customers.write.partitionBy("c_mktsegment").parquet(path)
    tables, columns, cells = files.bulk_ingest(spark, path, "default", F.expr(NOW), pattern="*.parquet")
    keys = columns.filter("col_name = 'c_custkey'").select("table_id", "ordinal")
    total = cells.whole.join(keys, profile.KEY).groupBy("table_id").agg(F.sum("value").alias("keys"))
    part = F.regexp_extract("source_uri", "c_mktsegment=([^/]*)", 1)
    read = tables.filter("status = 'INGESTED'").join(total, "table_id")
    return read.groupBy(part.alias("part")).agg(
        F.sum("row_count").alias("row_count"), F.max("col_count").alias("col_count"), F.sum("keys").cast("double").alias("keys")
    )


@query(
    "clean_pairs",
    f"""WITH {C.SQL_COLUMNS}, sizes AS ({" UNION ALL ".join(f"SELECT '{t}' AS table_id, count(*) AS row_count FROM {t}" for t in C.TABLES)}),
    pairs AS (SELECT a.table_id AS query_table, b.table_id AS candidate_table, a.col_name AS query_column, b.col_name AS candidate_column,
                     a.ordinal * 100 + b.ordinal AS seq
              FROM cols a JOIN cols b ON a.table_id < b.table_id AND regexp_replace(a.col_name, '^[a-z]+_', '') = regexp_replace(b.col_name, '^[a-z]+_', ''))
    SELECT query_table, candidate_table, min(seq) AS seq, arg_min(query_column, seq) AS query_column, arg_min(candidate_column, seq) AS candidate_column,
           query_table AS query_table_id, candidate_table AS candidate_table_id, any_value(row_count) AS query_rows
    FROM pairs JOIN sizes ON sizes.table_id = query_table GROUP BY ALL""",
)
def clean_pairs(spark, sf_dir):
    """Pairs of equally named columns, one per table pair, with the ids of their tables."""
    groups = C.lake(spark, sf_dir)
    columns = L.lake_columns(groups).withColumnRenamed("table_id", "table_name")
    stem = "regexp_replace(col_name, '^[a-z]+_', '') AS stem"
    a = columns.selectExpr("table_name AS query_table", "col_name AS query_column", "ordinal AS i", stem)
    b = columns.selectExpr("table_name AS candidate_table", "col_name AS candidate_column", "ordinal AS j", stem)
    same = a.join(b, "stem").filter("query_table < candidate_table")
    unknown = same.selectExpr("query_table", "candidate_table", "'missing' AS query_column", "candidate_column", "-1 AS seq")
    pairs = same.selectExpr("query_table", "candidate_table", "query_column", "candidate_column", "i * 100 + j AS seq")
    picked = files.pick_clean_pairs(pairs.unionByName(unknown), columns)
    named = picked.withColumn("query_table", F.concat("query_table", F.lit(".csv")))
    found = files.truth_by_name(named, L.lake_tables(groups))
    sizes = L.row_counts(groups).selectExpr("table_id AS query_table_id", "row_count AS query_rows")
    return found.join(sizes, "query_table_id").selectExpr(
        "query_table_name AS query_table", "candidate_table_name AS candidate_table", "bigint(seq) AS seq",
        "query_column", "candidate_column", "query_table_id", "candidate_table_id", "query_rows",
    )
