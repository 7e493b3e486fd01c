"""Catalog and column statistics of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeweave import params as P
from lakeweave.functions import ids
from lakeweave.operators import profile
from lakeweave.session import materialize
from lakeweave.sources import lake as L
from suite import common as C
from suite.common import query

SQL_NUM = C.sql_cells(("int", "float", "date"), False, C.SCHEMAS)
SQL_TEXT = C.sql_cells(("str", "bool"), False, C.SCHEMAS)


# Non-null values of every column, counted in the tables themselves.
SQL_VALUES = f"""vals AS (
  SELECT table_id, CAST(ordinal AS INTEGER) AS ordinal, count(value) AS n_values FROM (
    SELECT table_id, ordinal, CAST(value AS VARCHAR) AS value FROM ({SQL_NUM}) UNION ALL SELECT table_id, ordinal, value FROM ({SQL_TEXT}))
  GROUP BY ALL)"""


def valued(columns, groups):
    """Catalog columns with the number of their non-null values."""
    counts = profile.cell_summary(L.lake_cells(groups)).select(*profile.KEY, "n_values")
    return columns.join(counts, profile.KEY)


@query(
    "catalog_columns",
    f"""WITH {C.SQL_COLUMNS}, {SQL_VALUES}
    SELECT table_id, CAST(ordinal AS BIGINT) AS ordinal, col_name, col_type, n_values FROM cols JOIN vals USING (table_id, ordinal)""",
)
def catalog_columns(spark, sf_dir):
    groups = C.lake(spark, sf_dir)
    return valued(L.lake_columns(groups), groups).select(
        "table_id", F.col("ordinal").cast("long").alias("ordinal"), "col_name", "col_type", "n_values"
    )


@query(
    "column_ids",
    f"""WITH {C.SQL_COLUMNS}, {SQL_VALUES},
    h AS (SELECT table_id, col_name, n_values,
                 sha1(unhex('{P.ID_NAMESPACE.replace("-", "")}') || encode(table_id || ':' || ordinal || ':' || col_name)) AS d
          FROM cols JOIN vals USING (table_id, ordinal))
    SELECT table_id, col_name, n_values,
           d[1:8] || '-' || d[9:12] || '-5' || d[14:16] || '-' ||
           substr('89ab', CAST(('0x' || d[17:17]) AS INTEGER) % 4 + 1, 1) || d[18:20] || '-' || d[21:32] AS column_id
    FROM h""",
)
def column_ids(spark, sf_dir):
    groups = C.lake(spark, sf_dir)
    return valued(L.lake_columns(groups), groups).select("table_id", "col_name", "n_values", "column_id")


SQL_ROW_COUNTS = " UNION ALL ".join(f"SELECT '{t}' AS table_id, count(*) AS row_count FROM {t}" for t in C.TABLES)


@query(
    "catalog_tables",
    f"""WITH {C.SQL_COLUMNS}, sizes AS ({SQL_ROW_COUNTS})
    SELECT c.table_id, any_value(s.row_count) AS row_count, count(*) AS col_count,
           substr(sha256(string_agg(ordinal || ':' || col_name || ':' || col_type, '|' ORDER BY ordinal)), 1, 16) AS schema_hash,
           substr(sha256(string_agg(col_name || ':' || col_type, '|' ORDER BY ordinal)), 1, 16) AS plain_schema_hash
    FROM cols c JOIN sizes s USING (table_id) GROUP BY c.table_id""",
)
def catalog_tables(spark, sf_dir):
    groups = C.lake(spark, sf_dir)
    plain = (
        L.lake_columns(groups)
        .groupBy("table_id")
        .agg(
            ids.schema_hash(
                F.collect_list(F.struct("ordinal", "col_name", "col_type")), with_ordinal=False
            ).alias("plain_schema_hash")
        )
    )
    return (
        L.catalog(groups)
        .join(plain, "table_id")
        .select("table_id", "row_count", F.col("col_count").cast("long").alias("col_count"), "schema_hash", "plain_schema_hash")
    )


def _sql_fingerprint(name: str) -> str:
    def tag(col: str) -> str:
        return f"coalesce(length(CAST({col} AS VARCHAR)) || ':' || CAST({col} AS VARCHAR), '-')"

    digest = " || ".join(tag(C.SQL_SCALED if c == "embedding" else c) for c, _ in C.SCHEMAS[name])
    return (
        f"SELECT '{name}' AS table_id, count(*) AS row_count, "
        f"sum(CAST('0x' || md5({digest})[1:15] AS BIGINT)) AS digest_sum FROM {name}"
    )


@query(
    "table_fingerprints",
    f"""WITH f AS ({" UNION ALL ".join(map(_sql_fingerprint, C.TABLES))})
    SELECT table_id, row_count, substr(sha256(row_count || ':' || CAST(digest_sum AS HUGEINT)), 1, 16) AS content_hash FROM f""",
)
def table_fingerprints(spark, sf_dir):
    return L.table_fingerprints(C.lake(spark, sf_dir)).select("table_id", "row_count", "content_hash")


@query(
    "column_ratios",
    f"""WITH cells AS (
      SELECT table_id, ordinal, CAST(value AS VARCHAR) AS value FROM ({SQL_NUM})
      UNION ALL SELECT table_id, ordinal, value FROM ({SQL_TEXT}))
    SELECT table_id, CAST(ordinal AS BIGINT) AS ordinal, count(*) AS n_rows,
           round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 9) AS null_ratio,
           round(count(DISTINCT value) / count(*), 9) AS distinct_ratio
    FROM cells GROUP BY ALL""",
)
def column_ratios(spark, sf_dir):
    groups = C.lake(spark, sf_dir)
    cells = L.lake_cells(groups)
    sizes = profile.cell_summary(cells)
    distinct = profile.distinct_counts(profile.value_counts(cells, L.largest_table(groups))).drop("n_values")
    return sizes.join(distinct, profile.KEY, "left").select(
        "table_id",
        F.col("ordinal").cast("long").alias("ordinal"),
        "n_rows",
        F.round(profile.null_ratio(F.col("n_null"), F.col("n_rows")), 9).alias("null_ratio"),
        F.round(profile.distinct_ratio(F.col("n_distinct"), F.col("n_rows")), 9).alias("distinct_ratio"),
    )


SQL_NUMERIC_STATS = """
SELECT table_id, CAST(ordinal AS BIGINT) AS ordinal,
       round(coalesce(avg(value), 0), 3) AS mean, round(coalesce(stddev_samp(value), 0), 3) AS std,
       round(coalesce(quantile_cont(value, 0.25), 0), 3) AS q25,
       round(coalesce(quantile_cont(value, 0.5), 0), 3) AS q50,
       round(coalesce(quantile_cont(value, 0.75), 0), 3) AS q75
FROM cells GROUP BY table_id, ordinal"""


def _rounded_stats(df):
    return df.select(
        "table_id",
        F.col("ordinal").cast("long").alias("ordinal"),
        *[F.round(n, 3).alias(n) for n in ("mean", "std", "q25", "q50", "q75")],
    )


@query("numeric_stats", f"WITH cells AS ({SQL_NUM}) {SQL_NUMERIC_STATS}")
def numeric_stats(spark, sf_dir):
    groups = C.lake(spark, sf_dir)
    cells, columns = L.lake_cells(groups), L.lake_columns(groups)
    # The quartiles read the counts several times.
    largest = L.largest_table(groups)
    counts = profile.value_counts(L.Cells(cells.whole, cells.real, None), largest).kept(materialize, columns)
    return _rounded_stats(profile.numeric_stats(columns, cells, counts, largest))


SPARSE_SQL = """
SELECT CAST(doc_id AS DOUBLE) AS doc_id, CAST(nullif(quality, 0) AS DOUBLE) AS quality,
       CASE WHEN toxic = 1 THEN 1.5 END AS toxic, CAST(NULL AS DOUBLE) AS nothing,
       CASE WHEN doc_id = 0 THEN 7.0 END AS single FROM labels"""


@query(
    "numeric_stats_sparse",
    f"""WITH src AS ({SPARSE_SQL}),
    cells AS (SELECT 'labels' AS table_id, 0 AS ordinal, doc_id AS value FROM src
      UNION ALL SELECT 'labels', 1, quality FROM src UNION ALL SELECT 'labels', 2, toxic FROM src
      UNION ALL SELECT 'labels', 3, nothing FROM src UNION ALL SELECT 'labels', 4, single FROM src),
    stats AS ({SQL_NUMERIC_STATS})
    SELECT s.*, r.null_ratio FROM stats s JOIN (
      SELECT ordinal, round(avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END), 9) AS null_ratio
      FROM cells GROUP BY ordinal) r USING (ordinal)""",
)
def numeric_stats_sparse(spark, sf_dir):
    """The same statistics over columns with nulls, NaN, one value, and none."""
    labels = C.table(spark, sf_dir, "labels").select(
        "doc_id",
        F.nullif("quality", F.lit(0)).alias("quality"),
        F.when(F.col("toxic") == 1, F.lit(1.5)).otherwise(F.lit(float("nan"))).alias("toxic"),
        F.lit(None).cast("double").alias("nothing"),
        F.when(F.col("doc_id") == 0, F.lit(7)).alias("single"),
    )
    groups = [L.single_table(labels, "labels")]
    cells = L.lake_cells(groups)
    stats = profile.numeric_stats(L.lake_columns(groups), cells, profile.value_counts(cells))
    sizes = profile.cell_summary(cells).select(
        "table_id",
        F.col("ordinal").cast("long").alias("ordinal"),
        F.round(profile.null_ratio(F.col("n_null"), F.col("n_rows")), 9).alias("null_ratio"),
    )
    return _rounded_stats(stats).join(sizes, ["table_id", "ordinal"])


SQL_FREQS = f"""
cells AS ({SQL_TEXT}),
sizes AS (SELECT table_id, ordinal, count(*) AS n_rows FROM cells GROUP BY ALL),
freqs AS (
  SELECT table_id, ordinal, value, count(*) AS cnt FROM cells WHERE value IS NOT NULL GROUP BY ALL)"""


def _text_cells(spark, sf_dir):
    """The texts of the given tables, and the rows of the largest."""
    groups = C.lake(spark, sf_dir)
    return L.Cells(None, None, L.lake_cells(groups).text), L.largest_table(groups)


@query(
    "value_frequencies",
    f"""WITH {SQL_FREQS}
    SELECT table_id, CAST(ordinal AS BIGINT) AS ordinal, md5(value) AS value_md5, cnt, round(cnt / n_rows, 9) AS freq
    FROM freqs JOIN sizes USING (table_id, ordinal)""",
)
def value_frequencies(spark, sf_dir):
    cells, largest = _text_cells(spark, sf_dir)
    sizes = materialize(profile.cell_summary(cells), "summary")
    freqs = profile.frequencies(profile.value_counts(cells, largest), sizes)
    return freqs.select(
        "table_id",
        F.col("ordinal").cast("long").alias("ordinal"),
        F.md5("value").alias("value_md5"),
        "cnt",
        F.round("freq", 9).alias("freq"),
    )


@query(
    "top_values",
    f"""WITH {SQL_FREQS}
    SELECT table_id, CAST(ordinal AS BIGINT) AS ordinal, value, cnt, round(cnt / n_rows, 9) AS freq,
           row_number() OVER (PARTITION BY table_id, ordinal ORDER BY cnt DESC, value) AS rank
    FROM freqs JOIN sizes USING (table_id, ordinal)
    QUALIFY rank <= {P.TOP_VALUES}""",
)
def top_values(spark, sf_dir):
    cells, largest = _text_cells(spark, sf_dir)
    sizes = materialize(profile.cell_summary(cells), "summary")
    top = profile.top_texts(cells, profile.key_counts(cells, largest).text)
    return (
        top.join(sizes.select(*profile.KEY, "n_rows"), profile.KEY)
        .withColumn("freq", F.col("cnt") / F.col("n_rows"))
        .select(
            "table_id",
            F.col("ordinal").cast("long").alias("ordinal"),
            "value",
            "cnt",
            F.round("freq", 9).alias("freq"),
            F.col("rank").cast("long").alias("rank"),
        )
    )


@query(
    "value_vocabulary",
    f"""WITH {SQL_FREQS}
    SELECT value, CAST(sum(cnt) AS BIGINT) AS cnt, count(*) AS n_columns FROM freqs
    GROUP BY value HAVING sum(cnt) >= {P.VOCAB_MIN_FREQ}""",
)
def value_vocabulary(spark, sf_dir):
    counts = profile.value_counts(*_text_cells(spark, sf_dir))
    vocab = profile.vocabulary(counts)
    spread = profile.aligned_frequencies(counts.text, vocab).groupBy("value").agg(
        F.count("*").alias("n_columns")
    )
    return vocab.join(spread, "value").select("value", "cnt", "n_columns")


@query(
    "sample_values",
    f"""WITH cells AS (
      SELECT DISTINCT table_id, ordinal, value FROM ({SQL_TEXT}) WHERE value IS NOT NULL
      UNION ALL
      SELECT DISTINCT table_id, ordinal, value FROM (
        {" UNION ALL ".join(
            f"SELECT '{t}' AS table_id, {i} AS ordinal, CAST({c} AS VARCHAR) AS value FROM {t}"
            for t, cs in C.SCHEMAS.items() for i, (c, k) in enumerate(cs) if k == "int")}))
    SELECT table_id, CAST(ordinal AS BIGINT) AS ordinal, value,
           row_number() OVER (PARTITION BY table_id, ordinal ORDER BY md5(value), value) AS rank
    FROM cells QUALIFY rank <= {P.SAMPLE_VALUES}""",
)
def sample_values(spark, sf_dir):
    """Doubles and times print differently in SQL; the check covers texts and integers."""
    groups = C.lake(spark, sf_dir)
    columns = L.lake_columns(groups)
    counts = profile.value_counts(L.lake_cells(groups), L.largest_table(groups)).kept(materialize, columns)
    samples = profile.sample_values(counts, columns)
    shown = columns.filter("col_type in ('int', 'str')")
    return samples.join(shown.select(*profile.KEY), profile.KEY, "left_semi").select(
        "table_id",
        F.col("ordinal").cast("long").alias("ordinal"),
        "value",
        F.col("rank").cast("long").alias("rank"),
    )


SQL_LINES = ", ".join(c for c, _ in C.SCHEMAS["lineitem"])


@query(
    "row_sample",
    f"""SELECT {SQL_LINES} FROM lineitem
    ORDER BY md5('{P.SAMPLE_SEED}|' || {" || '|' || ".join(f"CAST({c} AS VARCHAR)" for c, _ in C.SCHEMAS["lineitem"])}), {SQL_LINES}
    LIMIT {P.SAMPLE_ROWS}""",
)
def row_sample(spark, sf_dir):
    return profile.sample_rows(C.table(spark, sf_dir, "lineitem"))


@query("head_sample", f"SELECT * FROM orders ORDER BY o_orderkey LIMIT {P.HEAD_ROWS}")
def head_sample(spark, sf_dir):
    return profile.head_rows(C.table(spark, sf_dir, "orders"), ["o_orderkey"])


DESCRIBED = {"o_orderkey": "Order Key", "o_orderdate": "", "o_custkey": "Buyer"}


@query(
    "table_texts",
    f"""WITH {C.SQL_COLUMNS}, sizes AS ({SQL_ROW_COUNTS}),
    d AS (SELECT *, CASE col_name WHEN 'o_orderkey' THEN 'Order Key' WHEN 'o_custkey' THEN 'Buyer' END AS descr FROM cols)
    SELECT table_id, any_value(row_count) AS row_count,
           lower(table_id || ' ' || string_agg(col_name || coalesce(' ' || descr, ''), ' ' ORDER BY ordinal)) AS text_blob,
           'Table: ' || table_id || '. Columns: ' ||
             string_agg(col_name || ' (' || col_type || ')' || coalesce(' - ' || descr, ''), ', ' ORDER BY ordinal) AS encoder_text,
           string_agg(col_type, ',' ORDER BY ordinal) AS type_multiset
    FROM d JOIN sizes USING (table_id) GROUP BY table_id""",
)
def table_texts(spark, sf_dir):
    groups = [
        L.single_table(C.table(spark, sf_dir, name), name, descriptions=DESCRIBED) for name in C.TABLES
    ]
    tables = L.lake_tables(groups).join(L.row_counts(groups), "table_id")
    profiles = profile.table_profiles(tables, L.lake_columns(groups))
    return profiles.select(
        "table_id", "row_count", "text_blob", "encoder_text", F.concat_ws(",", "type_multiset").alias("type_multiset")
    )


@query(
    "column_texts",
    f"""WITH {C.SQL_COLUMNS}, {SQL_VALUES}
    SELECT table_id, col_name, n_values,
           'Column ' || col_name || ' of type ' || col_type ||
           coalesce('. Description: ' || CASE col_name WHEN 'o_orderkey' THEN 'Order Key' WHEN 'o_custkey' THEN 'Buyer' END, '') ||
           '. In table ' || table_id || '.' AS encoder_text
    FROM cols JOIN vals USING (table_id, ordinal)""",
)
def column_texts(spark, sf_dir):
    groups = [
        L.single_table(C.table(spark, sf_dir, name), name, descriptions=DESCRIBED) for name in C.TABLES
    ]
    columns = L.lake_columns(groups)
    texts = profile.column_texts(L.lake_tables(groups), columns)
    own = valued(columns, groups).select(*profile.KEY, "col_name", "n_values")
    return texts.drop("col_name").join(own, profile.KEY).select("table_id", "col_name", "n_values", "encoder_text")


@query(
    "profile_round_trip",
    f"""WITH {C.SQL_COLUMNS}, num AS ({SQL_NUM}), txt AS ({SQL_TEXT}),
    n AS (SELECT table_id, ordinal, round(avg(value), 3) AS mean FROM num GROUP BY ALL),
    t AS (SELECT table_id, ordinal, least(count(DISTINCT value), {P.TOP_VALUES}) AS n_top FROM txt GROUP BY ALL)
    SELECT c.table_id, c.col_name, n.mean, CAST(t.n_top AS BIGINT) AS n_top
    FROM cols c LEFT JOIN n USING (table_id, ordinal) LEFT JOIN t USING (table_id, ordinal)""",
)
def profile_round_trip(spark, sf_dir):
    """Profiles stored with statistics as JSON, and read back."""
    groups = C.lake(spark, sf_dir)
    profiles = profile.column_profiles(
        L.lake_columns(groups), L.lake_cells(groups), L.largest_table(groups)
    )
    loaded = profile.load_profiles(profile.store_profiles(profiles))
    return loaded.select(
        "table_id",
        "col_name",
        F.round("numeric_stats.mean", 3).alias("mean"),
        F.size("top_k").cast("long").alias("n_top"),
    )


@query(
    "profile_documents",
    f"""WITH {C.SQL_COLUMNS}, {SQL_VALUES}, sizes AS ({SQL_ROW_COUNTS})
    SELECT table_id, string_agg(col_name || ':' || col_type || ':' || round(1 - n_values / row_count, 6), ',' ORDER BY ordinal) AS columns
    FROM cols JOIN vals USING (table_id, ordinal) JOIN sizes USING (table_id) GROUP BY table_id""",
)
def profile_documents(spark, sf_dir):
    """Every table's profile as one document with its columns nested in order."""
    store = C.base_store(spark, sf_dir)
    whole = profile.assemble(store.tables.select("table_id"), store.profiles)
    one = "concat_ws(':', c.col_name, c.col_type, string(round(double(c.null_ratio), 6)))"
    return whole.selectExpr("table_id", f"concat_ws(',', transform(columns, c -> {one})) AS columns")
