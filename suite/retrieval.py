"""Term weights, vectors, and the candidate layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeweave import params as P
from lakeweave.operators import blocks, cascade, rules, terms, vectors
from lakeweave.session import materialize
from suite import common as C
from suite.common import query

WORD = r"[\p{L}\p{N}_]+"
PART = r"[\p{L}\p{N}]+"


def sql_terms(docs: str, key: str, tokens: str, prefix: str = "") -> str:
    """CTEs ``unit(key, term, weight)`` over the texts of ``docs``."""
    return f"""
{prefix}tf AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest({tokens}) AS term FROM {docs}) GROUP BY ALL),
{prefix}size AS (SELECT count(*) AS n FROM {docs}),
{prefix}vocab AS (
  SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM {prefix}tf GROUP BY term), {prefix}size
  WHERE df >= CASE WHEN n >= 3 THEN {P.MIN_DF} ELSE 1 END AND df <= {P.MAX_DF} * n),
{prefix}raw AS (SELECT {key}, term, (1 + ln(tf)) * idf AS w FROM {prefix}tf JOIN {prefix}vocab USING (term)),
{prefix}unit AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight FROM {prefix}raw)"""


DOC_TERMS = sql_terms("documents", "doc_id", f"regexp_extract_all(lower(text), '{WORD}')")


@query(
    "document_terms",
    f"WITH {DOC_TERMS} SELECT doc_id, term, round(weight, 9) AS weight FROM unit",
)
def document_terms(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    unit = terms.unit_terms(docs, "doc_id", "text")
    return terms.postings(unit, "doc_id").withColumn("weight", F.round("weight", 9))


@query(
    "document_vocabulary",
    f"WITH {DOC_TERMS} SELECT term, df, round(idf, 9) AS idf FROM vocab",
)
def document_vocabulary(spark, sf_dir):
    docs = C.table(spark, sf_dir, "documents")
    model = terms.fit(docs, terms.term_counts(docs, "doc_id", "text"))
    return model.select("term", "df", F.round("idf", 9).alias("idf"))


@query(
    "document_neighbours",
    f"""WITH {DOC_TERMS},
    dots AS (SELECT a.doc_id AS query_id, b.doc_id AS table_id, round(sum(a.weight * b.weight), 9) AS score
             FROM unit a JOIN unit b USING (term) WHERE a.doc_id <> b.doc_id GROUP BY ALL)
    SELECT query_id, table_id, score FROM dots WHERE score > {P.JOIN_PLAN.theta_1}
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, table_id) <= 10""",
)
def document_neighbours(spark, sf_dir):
    """The ten most similar texts of every text by term cosine, over the whole collection."""
    docs = C.table(spark, sf_dir, "documents")
    model = terms.fitted(docs, "doc_id", "text")
    # A text without an id differs from none.
    unit = terms.transform(*model, "doc_id").filter("doc_id IS NOT NULL").withColumn("tenant_id", F.lit("default"))
    # Terms are only compared, so numbers stand for them in the blocks.
    coded = "transform(terms, t -> xxhash64(t)) AS terms"
    q = unit.selectExpr("doc_id AS query_id", "tenant_id", "10 AS k", f"{P.JOIN_PLAN.theta_1}D AS theta", coded, "weights")
    c = unit.selectExpr("doc_id AS table_id", "tenant_id", coded, "weights")
    # Every pair of blocks is read: small blocks only while there are fewer than two per core.
    q_rows = blocks.query_rows(docs.count(), spark.sparkContext.defaultParallelism)
    pack = blocks.pack(q_rows, "doc_id", 10, P.JOIN_PLAN.theta_1)
    packed = terms.transform(*model, "doc_id", (pack, blocks.PACKED))
    return blocks.block_top_k(q, c, blocks.sparse_scorer(1.0, 0.0, []), q_rows=q_rows, packed=packed)


SQL_COSINE = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(
    "vector_top_k",
    f"""SELECT a.vec_id AS query_id, b.vec_id AS table_id, round({SQL_COSINE}, 9) AS s2
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
    QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({SQL_COSINE}, 9) DESC, b.vec_id) <= {P.JOIN_PLAN.k_2}""",
)
def vector_top_k(spark, sf_dir):
    emb = C.table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    stored = emb.selectExpr("vec_id AS table_id", "'default' AS tenant_id", "'READY' AS status", "vector")
    q = emb.selectExpr("vec_id AS query_id", "'default' AS tenant_id", "vector")
    return vectors.top_k(q, stored)


@query(
    "vector_top_k_filtered",
    f"""SELECT a.vec_id AS query_id, b.vec_id AS table_id, round({SQL_COSINE}, 9) AS s2
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label = b.label AND b.vec_id % 5 <> 0
    QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({SQL_COSINE}, 9) DESC, b.vec_id) <= 5""",
)
def vector_top_k_filtered(spark, sf_dir):
    """Labels play tenants, and every fifth vector is archived: only READY ones of the tenant count."""
    emb = C.table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id", "string(label) AS tenant_id", "if(vec_id % 5 = 0, 'ARCHIVED', 'READY') AS status", "embedding AS vector"
    )
    q = emb.selectExpr("vec_id AS query_id", "tenant_id", "vector")
    found = vectors.top_k(q, emb.withColumnRenamed("vec_id", "table_id"), k=5)
    return found


@query(
    "vector_column_roll_up",
    f"""WITH hits AS (
      SELECT a.vec_id AS query_id, b.vec_id AS column_id, b.label AS owner_id, {SQL_COSINE} AS s2
      FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id
      QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY round({SQL_COSINE}, 9) DESC, b.vec_id) <= {P.JOIN_PLAN.k_2})
    SELECT query_id, owner_id, round(max(s2), 9) AS best, count(*) AS n_columns FROM hits GROUP BY ALL""",
)
def vector_column_roll_up(spark, sf_dir):
    """Column vectors and their owning tables, here the labels."""
    emb = C.table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector")
    stored = emb.selectExpr("vec_id AS table_id", "'default' AS tenant_id", "'READY' AS status", "vector")
    q = emb.selectExpr("vec_id AS query_id", "'default' AS tenant_id", "vector")
    owners = emb.selectExpr("vec_id AS column_id", "label AS owner_id")
    return vectors.roll_up(vectors.top_k(q, stored), owners)


@query(
    "vector_upsert",
    f"""WITH versions AS (
      SELECT vec_id, label, 1 AS version, {C.SQL_SCALED} AS vector FROM embeddings
      UNION ALL SELECT user_id AS vec_id, 100 AS label, 1 + event_id AS version,
        list_transform(range(64), lambda i: CAST(round(value * 1000) AS BIGINT) + i) AS vector FROM events)
    SELECT vec_id, arg_max(label, version) AS label, max(version) AS version,
           array_to_string(arg_max(vector, version), ',') AS vector
    FROM versions GROUP BY vec_id""",
)
def vector_upsert(spark, sf_dir):
    """Events re-write vectors; the last write per id wins, with all its components."""
    stored = C.table(spark, sf_dir, "embeddings").selectExpr("vec_id", "label", "1L AS version", f"{C.SCALED} AS vector")
    incoming = C.table(spark, sf_dir, "events").selectExpr(
        "user_id AS vec_id", "100 AS label", "1 + event_id AS version",
        "transform(sequence(0, 63), i -> cast(round(value * 1000) AS bigint) + i) AS vector",
    )
    return vectors.upsert(stored, incoming, "vec_id", "version").withColumn("vector", F.expr("array_join(vector, ',')"))


# ---- the cascade over the benchmark lake ---------------------------------------------------


def planned(store, subtask="JOIN", overrides=None):
    q = store.tables.selectExpr("table_id AS query_id", "tenant_id", f"'{subtask}' AS subtask")
    return rules.plan_queries(q, overrides)


def lake_layer_one(store, queries):
    return cascade.layer_one(queries, cascade.l1_features(store.tables, store.terms))


def lake_hits(store, queries):
    q = queries.select("query_id", "tenant_id", F.col("k_2").alias("k")).join(
        store.vectors.select(F.col("table_id").alias("query_id"), "vector"), "query_id"
    )
    return vectors.top_k(q, store.vectors)


SQL_BLOBS = f"""{C.SQL_BENCH_COLUMNS},
blobs AS (
  SELECT table_id, any_value(base) AS base,
         lower(table_id || ' ' || string_agg(col_name, ' ' ORDER BY ordinal)) AS text_blob,
         'Table: ' || table_id || '. Columns: ' || string_agg(col_name || ' (' || col_type || ')', ', ' ORDER BY ordinal) AS encoder_text,
         {", ".join(f"count_if(col_type = '{k}') AS n_{k}" for k in P.LOGICAL_TYPES)}
  FROM bcols GROUP BY table_id)"""


def sql_l1(tokens: str) -> str:
    low = " + ".join(f"least(a.n_{k}, b.n_{k})" for k in P.LOGICAL_TYPES)
    high = " + ".join(f"greatest(a.n_{k}, b.n_{k})" for k in P.LOGICAL_TYPES)
    return f"""{SQL_BLOBS}, {sql_terms("blobs", "table_id", tokens)},
dots AS (SELECT a.table_id AS query_id, b.table_id, sum(a.weight * b.weight) AS dot FROM unit a JOIN unit b USING (term) GROUP BY ALL),
l1 AS (
  SELECT a.table_id AS query_id, b.table_id,
         round({P.OMEGA_TEXT} * coalesce(d.dot, 0) + {P.OMEGA_TYPE} * ({low}) / ({high}), 9) AS s1
  FROM blobs a JOIN blobs b ON a.table_id <> b.table_id
  LEFT JOIN dots d ON d.query_id = a.table_id AND d.table_id = b.table_id),
c1 AS (SELECT * FROM l1 WHERE s1 > {P.JOIN_PLAN.theta_1}
       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s1 DESC, table_id) <= {P.JOIN_PLAN.k_1})"""


SQL_L1_NAME = sql_l1(f"regexp_extract_all(text_blob, '{PART}')")
SQL_L1_WORD = sql_l1(f"regexp_extract_all(text_blob, '{WORD}')")


@query("l1_candidates", f"WITH {SQL_L1_NAME} SELECT * FROM c1")
def l1_candidates(spark, sf_dir):
    store = C.store(spark, sf_dir)
    return lake_layer_one(store, planned(store))


@query("l1_candidates_word", f"WITH {SQL_L1_WORD} SELECT * FROM c1")
def l1_candidates_word(spark, sf_dir):
    """With whole words as terms, so that only equal column names are shared."""
    store = C.store(spark, sf_dir)
    unit = terms.unit_terms(store.tables, "table_id", "text_blob", "word")
    return cascade.layer_one(planned(store), cascade.l1_features(store.tables, unit))


@query("lake_terms", f"WITH {SQL_L1_NAME} SELECT table_id, term, round(weight, 9) AS weight FROM unit")
def lake_terms(spark, sf_dir):
    rows = terms.postings(C.store(spark, sf_dir).terms, "table_id")
    return rows.withColumn("weight", F.round("weight", 9))


SQL_HITS = f"""
{sql_terms("blobs", "table_id", f"regexp_extract_all(lower(regexp_replace(encoder_text, '([a-z0-9])([A-Z])', '{chr(92)}1 {chr(92)}2', 'g')), '{PART}')", "e_")},
buckets AS (SELECT table_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % {P.EMBEDDING_DIM} AS i, sum(weight) AS w FROM e_unit GROUP BY ALL),
dense AS (SELECT table_id, i, w / sqrt(sum(w * w) OVER (PARTITION BY table_id)) AS w FROM buckets),
ids AS (SELECT DISTINCT table_id FROM dense),
sims AS (
  SELECT a.table_id AS query_id, b.table_id, round(coalesce(d.dot, 0), 9) AS s2
  FROM ids a JOIN ids b ON a.table_id <> b.table_id LEFT JOIN (
    SELECT x.table_id AS query_id, y.table_id, sum(x.w * y.w) AS dot FROM dense x JOIN dense y USING (i) GROUP BY ALL) d
  ON d.query_id = a.table_id AND d.table_id = b.table_id),
hits AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, table_id) <= {P.JOIN_PLAN.k_2})"""


@query("l2_vector_hits", f"WITH {SQL_BLOBS}, {SQL_HITS} SELECT * FROM hits")
def l2_vector_hits(spark, sf_dir):
    store = C.store(spark, sf_dir)
    return lake_hits(store, planned(store))


def sql_c2(theta_2: float) -> str:
    return f"""
merged AS (
  SELECT query_id, table_id, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2,
         coalesce(s1 IS NOT NULL AND s2 > {theta_2}, false) AS passes
  FROM c1 FULL OUTER JOIN hits USING (query_id, table_id)),
counted AS (
  SELECT *, count_if(passes) OVER (PARTITION BY query_id) AS n_pass,
         row_number() OVER (PARTITION BY query_id ORDER BY s2 DESC, table_id) AS place FROM merged),
c2 AS (
  SELECT query_id, table_id, s1, s2, n_pass < 3 AS degraded FROM counted
  WHERE (n_pass >= 3 AND passes) OR (n_pass < 3 AND place <= 3))"""


def lake_layer_two(store, queries):
    return cascade.layer_two(queries, lake_layer_one(store, queries), lake_hits(store, queries), store.vectors.selectExpr("table_id AS query_id"))


@query(
    "l2_candidates",
    f"WITH {SQL_L1_NAME}, {SQL_HITS}, {sql_c2(P.JOIN_PLAN.theta_2)} SELECT * FROM c2",
)
def l2_candidates(spark, sf_dir):
    store = C.store(spark, sf_dir)
    return lake_layer_two(store, planned(store))


@query("l2_fallback", f"WITH {SQL_L1_NAME}, {SQL_HITS}, {sql_c2(0.93)} SELECT * FROM c2")
def l2_fallback(spark, sf_dir):
    """A strict threshold, given per query, leaves many queries with fewer than three tables."""
    store = C.store(spark, sf_dir)
    strict = store.tables.selectExpr("table_id AS query_id", "0.93D AS theta_2")
    return lake_layer_two(store, planned(store, overrides=strict))


@query(
    "l2_without_vectors",
    f"WITH {SQL_L1_NAME} SELECT query_id, table_id, s1, s1 AS s2, true AS degraded FROM c1",
)
def l2_without_vectors(spark, sf_dir):
    """No vectors at all: the second layer passes C1 through and says so."""
    store = C.store(spark, sf_dir)
    queries = planned(store)
    none = spark.createDataFrame([], "query_id string, table_id string, s2 double")
    return cascade.layer_two(queries, lake_layer_one(store, queries), none, none)


# ---- columns of the benchmark lake -----------------------------------------------------------

SQL_COLUMN_HITS = f"""{C.SQL_BENCH_COLUMNS},
texts AS (
  SELECT table_id || '.' || ordinal AS col, table_id, 'Column ' || col_name || ' of type ' || col_type || '. In table ' || table_id || '.' AS t
  FROM bcols),
{sql_terms("texts", "col", f"regexp_extract_all(lower(regexp_replace(t, '([a-z0-9])([A-Z])', '{chr(92)}1 {chr(92)}2', 'g')), '{PART}')", "c_")},
c_buckets AS (SELECT col, ('0x' || substr(md5(term), 1, 8))::BIGINT % {P.EMBEDDING_DIM} AS i, sum(weight) AS w FROM c_unit GROUP BY ALL),
c_dense AS (SELECT col, i, w / sqrt(sum(w * w) OVER (PARTITION BY col)) AS w FROM c_buckets),
c_owned AS (SELECT d.*, x.table_id FROM c_dense d JOIN texts x USING (col)),
c_sims AS (
  SELECT a.col AS query_id, a.table_id AS asking, b.col AS column_id, b.table_id, round(sum(a.w * b.w), 9) AS score
  FROM c_owned a JOIN c_owned b ON a.i = b.i AND a.table_id <> b.table_id GROUP BY ALL),
c_hits AS (
  SELECT * FROM c_sims
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, column_id) <= {P.TOP_COLUMNS})"""


def column_hits(spark, sf_dir):
    """Over the lake's own columns, under ids that SQL can write too, as they break ties."""
    store = C.store(spark, sf_dir)
    named = store.profiles.select("table_id", "ordinal", "col_name")
    columns = store.column_vectors.join(named, ["table_id", "col_name"]).withColumn(
        "column_id", F.concat_ws(".", "table_id", "ordinal")
    )
    return vectors.column_top_k(columns, columns)


@query("column_neighbours", f"WITH {SQL_COLUMN_HITS} SELECT * FROM c_hits")
def column_neighbours(spark, sf_dir):
    """The nearest columns in other tables of every column of the lake."""
    return column_hits(spark, sf_dir)


@query(
    "tables_by_columns",
    f"""WITH {SQL_COLUMN_HITS},
    per_column AS (SELECT asking, table_id, query_id, max(score) AS best FROM c_hits GROUP BY ALL),
    per_table AS (
      SELECT asking AS query_table_id, table_id, count(*) AS n_columns, max(best) AS best, round(sum(best), 6) AS total
      FROM per_column GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY query_table_id ORDER BY n_columns DESC, total DESC, table_id) AS rank
    FROM per_table QUALIFY rank <= {P.TOP_TABLES_BY_COLUMNS}""",
)
def tables_by_columns(spark, sf_dir):
    """Hits of single columns rolled up to the tables that hold them."""
    return vectors.tables_by_columns(column_hits(spark, sf_dir))
