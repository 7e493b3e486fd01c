"""Column pairs, verdicts, rankings and mappings."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from lakeweave import params as P

from lakeweave.functions import text
from lakeweave.operators import matching, profile, rules, verdicts
from lakeweave.plans import jobs
from lakeweave.sources import lake as L
from suite import common as C
from suite import retrieval as R
from suite.common import query

CAMEL = f"lower(regexp_replace({{0}}, '([a-z0-9])([A-Z])', '{chr(92)}1 {chr(92)}2', 'g'))"


def sql_name_tokens(name: str) -> str:
    return f"list_distinct(list_filter(string_split_regex({CAMEL.format(name)}, '[_{chr(92)}s{chr(92)}-]+'), lambda x: x <> ''))"


# Similarity of the distinct names in ``names(name)``: ``name_sims(a, b, sim_name)``.
SQL_NAME_SIMS = f"""
np AS (SELECT x.name AS a, y.name AS b FROM names x CROSS JOIN names y),
lcs AS (
  SELECT a, b, 0 AS i, list_transform(range(length(b)), lambda x: 0::BIGINT) AS row FROM np
  UNION ALL
  SELECT a, b, i + 1, list_transform(range(1, length(b) + 1), lambda j: list_max(list_prepend(row[j],
           list_transform(list_filter(range(1, j + 1), lambda k: substr(b, k, 1) = substr(a, i + 1, 1)),
                          lambda k: 1 + CASE WHEN k > 1 THEN row[k - 1] ELSE 0 END))))
  FROM lcs WHERE i < length(a)),
toks AS (SELECT name, {sql_name_tokens("name")} AS t FROM names),
name_sims AS (
  SELECT a, b,
         {P.NAME_WEIGHTS[0]} * (1 - levenshtein(a, b) / greatest(length(a), length(b), 1))
       + {P.NAME_WEIGHTS[1]} * 2.0 * row[length(b)] / (length(a) + length(b))
       + {P.NAME_WEIGHTS[2]} * len(list_intersect(x.t, y.t)) / len(list_distinct(list_concat(x.t, y.t))) AS sim_name
  FROM lcs JOIN toks x ON x.name = a JOIN toks y ON y.name = b WHERE i = length(a))"""

SQL_TYPE_SIM = (
    "CASE WHEN s.col_type = t.col_type THEN 1.0 WHEN (s.col_type || '>' || t.col_type) IN ("
    + ", ".join(f"'{a}>{b}'" for a, b in P.COMPATIBLE_TYPES)
    + f") THEN {P.TYPE_PARTIAL} ELSE 0.0 END"
)


def _rel(field: str) -> str:
    return (
        f"greatest(0, least(1, 1 - abs(x.{field} - y.{field}) / "
        f"(greatest(abs(x.{field}), abs(y.{field})) + {P.EPSILON})))"
    )


def sql_features(bench: bool) -> str:
    """CTEs ``all_cols``, ``names``, ``stats``, ``tops``, ``cat_sims`` and those of name similarity."""
    columns = C.SQL_BENCH_COLUMNS if bench else C.SQL_COLUMNS
    source = "bcols" if bench else "cols"
    return f"""{columns},
all_cols AS (SELECT table_id, ordinal, col_name, col_type FROM {source}),
names AS (SELECT DISTINCT col_name AS name FROM all_cols), {SQL_NAME_SIMS},
num_cells AS ({C.sql_cells(("int", "float", "date"), bench, C.SCHEMAS)}),
text_cells AS ({C.sql_cells(("str", "bool"), bench, C.SCHEMAS)}),
stats AS (
  SELECT c.table_id, c.ordinal, coalesce(avg(value), 0) AS mean, coalesce(stddev_samp(value), 0) AS std,
         coalesce(quantile_cont(value, 0.25), 0) AS q25, coalesce(quantile_cont(value, 0.5), 0) AS q50,
         coalesce(quantile_cont(value, 0.75), 0) AS q75
  FROM all_cols c LEFT JOIN num_cells USING (table_id, ordinal) WHERE c.col_type IN ('int', 'float', 'date')
  GROUP BY c.table_id, c.ordinal),
tops AS (
  SELECT table_id, ordinal, value, cnt / n AS freq FROM (
    SELECT table_id, ordinal, value, count(*) AS cnt,
           row_number() OVER (PARTITION BY table_id, ordinal ORDER BY count(*) DESC, value) AS place
    FROM text_cells SEMI JOIN all_cols USING (table_id, ordinal) WHERE value IS NOT NULL GROUP BY table_id, ordinal, value)
  JOIN (SELECT table_id, ordinal, count(*) AS n FROM text_cells GROUP BY ALL) USING (table_id, ordinal)
  WHERE place <= {P.TOP_VALUES}),
top_size AS (SELECT table_id, ordinal, count(*) AS n, sqrt(sum(freq * freq)) AS norm FROM tops GROUP BY ALL),
cat_sims AS (
  SELECT k.*, {P.CATEGORY_WEIGHTS[0]} * k.shared / (x.n + y.n - k.shared) + {P.CATEGORY_WEIGHTS[1]} * k.dot / (x.norm * y.norm) AS sim
  FROM (SELECT a.table_id AS s_id, a.ordinal AS s_i, b.table_id AS t_id, b.ordinal AS t_i, count(*) AS shared, sum(a.freq * b.freq) AS dot
        FROM tops a JOIN tops b USING (value) GROUP BY ALL) k
  JOIN top_size x ON x.table_id = s_id AND x.ordinal = s_i JOIN top_size y ON y.table_id = t_id AND y.ordinal = t_i)"""


def _weight(part: str) -> str:
    return "CASE scenario " + " ".join(
        f"WHEN '{n}' THEN {getattr(w, part)}" for n, w in P.SCENARIOS.items()
    ) + " END"


# ``scores`` of the column pairs of the table pairs in ``tp(source_table_id, target_table_id, scenario)``.
SQL_SCORES = f"""
components AS (
  SELECT tp.*, s.ordinal AS src_idx, t.ordinal AS tgt_idx, s.col_name AS source_column, t.col_name AS target_column,
         n.sim_name, {SQL_TYPE_SIM} AS sim_type,
         CASE WHEN s.col_type IN ('int', 'float', 'date') AND t.col_type IN ('int', 'float', 'date') THEN
                {P.NUMERIC_WEIGHTS[0]} * {_rel("mean")} + {P.NUMERIC_WEIGHTS[1]} * {_rel("std")}
                + {P.NUMERIC_WEIGHTS[2]} * ({_rel("q25")} + {_rel("q50")} + {_rel("q75")}) / 3
              WHEN s.col_type IN ('str', 'bool') AND t.col_type IN ('str', 'bool') THEN coalesce(c.sim, 0)
              ELSE 0 END AS sim_stat
  FROM tp JOIN all_cols s ON s.table_id = source_table_id JOIN all_cols t ON t.table_id = target_table_id
  JOIN name_sims n ON n.a = s.col_name AND n.b = t.col_name
  LEFT JOIN stats x ON x.table_id = s.table_id AND x.ordinal = s.ordinal
  LEFT JOIN stats y ON y.table_id = t.table_id AND y.ordinal = t.ordinal
  LEFT JOIN cat_sims c ON c.s_id = s.table_id AND c.s_i = s.ordinal AND c.t_id = t.table_id AND c.t_i = t.ordinal),
scores AS (
  SELECT *, ({_weight("text")}) * sim_name + ({_weight("struct")}) * sim_type + ({_weight("stat")}) * sim_stat AS m_score
  FROM components)"""

SQL_SCENARIO = f"CASE WHEN n = 0 THEN 'SMD' WHEN n <= {P.SSD_MAX_ROWS} THEN 'SSD' ELSE 'SLD' END"
SQL_BASE_SIZES = "sizes AS (" + " UNION ALL ".join(f"SELECT '{t}' AS table_id, count(*) AS n FROM {t}" for t in C.TABLES) + ")"
SQL_BENCH_SIZES = (
    "row_n AS ("
    + " UNION ALL ".join(
        f"SELECT '{t}_' || ({k} % 8) AS table_id, count(*) AS n FROM {t} GROUP BY 1" for t, k in C.SPLIT_KEYS.items()
    )
    + "), sizes AS (SELECT DISTINCT b.table_id, coalesce(n, 0) AS n FROM bcols b LEFT JOIN row_n USING (table_id))"
)

SQL_BASE_PAIRS = f"""{sql_features(False)}, {SQL_BASE_SIZES},
tp AS (SELECT a.table_id AS source_table_id, b.table_id AS target_table_id, {SQL_SCENARIO.replace("n ", "b.n ")} AS scenario
       FROM sizes a JOIN sizes b ON a.table_id <> b.table_id), {SQL_SCORES}"""


@query(
    "name_tokens",
    f"""WITH {C.SQL_BENCH_COLUMNS}, {SQL_BENCH_SIZES},
    used AS (SELECT col_name, CAST(sum(n) AS BIGINT) AS n_rows FROM bcols JOIN sizes USING (table_id) GROUP BY col_name)
    SELECT col_name, n_rows, array_to_string(list_sort({sql_name_tokens("col_name")}), ',') AS tokens FROM used""",
)
def name_tokens(spark, sf_dir):
    """Tokens of every column name, and the rows of the tables that have it."""
    groups = C.bench_lake(spark, sf_dir)
    names = (
        L.lake_columns(groups).join(L.row_counts(groups), "table_id", "left")
        .groupBy("col_name").agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("n_rows"))
    )
    return names.select("col_name", "n_rows", F.expr(f"concat_ws(',', array_sort({text.name_tokens('col_name')}))").alias("tokens"))


def _same_tenant_pairs(store):
    pool = profile.candidate_pool(store.tables, store.tables)
    return pool.selectExpr("query_id AS source_table_id", "table_id AS target_table_id")


def _with_scenario(store, pairs):
    hinted = store.tables.select("table_id", "row_count", F.lit(None).cast("string").alias("hint"))
    scenario = rules.detect_scenario(hinted, store.profiles)
    return pairs.join(scenario.withColumnRenamed("table_id", "target_table_id"), "target_table_id")


PAIR_COLUMNS = "source_table_id, target_table_id, scenario, source_column, target_column"


def _rounded(df, *names):
    return df.select(
        *[c.strip() for c in PAIR_COLUMNS.split(",")], *[F.round(n, 6).alias(n) for n in names]
    )


COMPONENTS = ("sim_name", "sim_type", "sim_stat", "m_score")
SQL_COMPONENTS = ", ".join(f"round({n}::DOUBLE, 6) AS {n}" for n in COMPONENTS)


@query(
    "column_pair_scores",
    f"WITH RECURSIVE {SQL_BASE_PAIRS} SELECT {PAIR_COLUMNS}, {SQL_COMPONENTS} FROM scores",
)
def column_pair_scores(spark, sf_dir):
    """All components of every column pair of the given tables, without a threshold."""
    store = C.base_store(spark, sf_dir)
    pairs = _with_scenario(store, _same_tenant_pairs(store))
    scored = matching.pair_scores(pairs, matching.column_features(store.profiles), theta_cand=0.0)
    return _rounded(scored, *COMPONENTS)


@query(
    "column_pair_scores_by_scenario",
    f"""WITH RECURSIVE {SQL_BASE_PAIRS}
    SELECT scenario, source_table_id, target_table_id, source_column, target_column, round(m_score, 6) AS m_score
    FROM (SELECT k.scenario, c.source_table_id, c.target_table_id, c.source_column, c.target_column,
            k.text * sim_name + k.struct * sim_type + k.stat * sim_stat AS m_score
          FROM components c, (VALUES {", ".join(f"('{n}', {w.text}, {w.struct}, {w.stat})" for n, w in P.SCENARIOS.items())}) k(scenario, text, struct, stat))
    WHERE round(m_score, 9) >= {P.THETA_CAND}""",
)
def column_pair_scores_by_scenario(spark, sf_dir):
    """Candidate pairs when the scenario is given instead of detected, for each of the three."""
    store = C.base_store(spark, sf_dir)
    pairs = _same_tenant_pairs(store).selectExpr("*", f"explode(array{tuple(P.SCENARIOS)}) AS scenario")
    return _rounded(matching.pair_scores(pairs, matching.column_features(store.profiles)), "m_score")


@query(
    "column_pairs_top",
    f"""WITH RECURSIVE {SQL_BASE_PAIRS}
    SELECT {PAIR_COLUMNS}, round(m_score, 6) AS m_score, place FROM (
      SELECT *, row_number() OVER (PARTITION BY source_table_id, target_table_id, src_idx ORDER BY round(m_score, 9) DESC, tgt_idx) AS place
      FROM scores WHERE round(m_score, 9) >= {P.THETA_CAND}) WHERE place <= 2""",
)
def column_pairs_top(spark, sf_dir):
    """The two best target columns per source column and target table."""
    store = C.base_store(spark, sf_dir)
    pairs = _with_scenario(store, _same_tenant_pairs(store))
    top = matching.top_targets(matching.pair_scores(pairs, matching.column_features(store.profiles)), 2)
    return top.selectExpr(
        *[c.strip() for c in PAIR_COLUMNS.split(",")], "round(m_score, 6) AS m_score", "bigint(place) AS place"
    )


@query(
    "category_similarity_full",
    f"""WITH {C.SQL_COLUMNS}, cells AS ({C.sql_cells(("str", "bool"), False, C.SCHEMAS)}),
    f AS (SELECT table_id, ordinal, value, count(*) / any_value(n) AS freq FROM cells
          JOIN (SELECT table_id, ordinal, count(*) AS n FROM cells GROUP BY ALL) USING (table_id, ordinal)
          WHERE value IS NOT NULL GROUP BY ALL),
    size AS (SELECT table_id, ordinal, count(*) AS n, sqrt(sum(freq * freq)) AS norm FROM f GROUP BY ALL),
    k AS (SELECT a.table_id AS source_table_id, a.ordinal AS src_idx, b.table_id AS target_table_id, b.ordinal AS tgt_idx,
                 count(*) AS shared, sum(a.freq * b.freq) AS dot
          FROM f a JOIN f b USING (value) WHERE a.table_id <> b.table_id GROUP BY ALL)
    SELECT source_table_id, CAST(src_idx AS BIGINT) AS src_idx, target_table_id, CAST(tgt_idx AS BIGINT) AS tgt_idx,
           round({P.CATEGORY_WEIGHTS[0]} * shared / (x.n + y.n - shared) + {P.CATEGORY_WEIGHTS[1]} * dot / (x.norm * y.norm), 6) AS sim_cat
    FROM k JOIN size x ON x.table_id = source_table_id AND x.ordinal = src_idx
    JOIN size y ON y.table_id = target_table_id AND y.ordinal = tgt_idx""",
)
def category_similarity_full(spark, sf_dir):
    """Over all values and not only the most frequent, for categorical columns of all table pairs."""
    store = C.base_store(spark, sf_dir)
    cats = store.profiles.filter("col_type IN ('str', 'bool')").select("table_id", "ordinal", "n_rows")
    freqs = store.values.join(cats, profile.KEY).selectExpr(
        "table_id", "ordinal", "value", "cnt / n_rows AS freq"
    )
    own = matching.column_features(store.profiles.filter("col_type IN ('str', 'bool')"))
    pairs = matching.expand_pairs(_same_tenant_pairs(store), own, *matching.PAIR).selectExpr(
        *matching.PAIR, "s.ordinal AS src_idx", "t.ordinal AS tgt_idx"
    )
    return matching.full_category_similarity(pairs, freqs).selectExpr(
        "source_table_id", "bigint(src_idx) AS src_idx", "target_table_id", "bigint(tgt_idx) AS tgt_idx",
        "round(sim_cat, 6) AS sim_cat",
    )


# ---- verdicts and ranking over the benchmark lake -----------------------------------------

SQL_BENCH_BASE = f"""{R.SQL_L1_NAME}, {R.SQL_HITS}, {R.sql_c2(P.JOIN_PLAN.theta_2)}"""
# The features CTEs repeat the catalog; drop their copy.
SQL_BENCH_FEATURES = sql_features(True).replace(C.SQL_BENCH_COLUMNS + ",", "", 1)

SQL_JOIN_JUDGE = f"""
vals AS (
  SELECT DISTINCT table_id, ordinal, CAST(value AS VARCHAR) AS value FROM num_cells SEMI JOIN all_cols USING (table_id, ordinal) WHERE value IS NOT NULL
  UNION ALL SELECT DISTINCT table_id, ordinal, value FROM text_cells SEMI JOIN all_cols USING (table_id, ordinal) WHERE value IS NOT NULL),
val_n AS (SELECT table_id, ordinal, count(*) AS n FROM vals GROUP BY ALL),
jc AS (
  SELECT c.query_id, c.table_id, s.ordinal AS s_i, t.ordinal AS t_i
  FROM c2 c JOIN all_cols s ON s.table_id = c.query_id JOIN all_cols t ON t.table_id = c.table_id
  JOIN name_sims n ON n.a = s.col_name AND n.b = t.col_name
  WHERE round(n.sim_name, 9) >= {P.JOIN_NAME_SIMILARITY}
    AND (s.col_type IN ('int', 'float', 'date')) = (t.col_type IN ('int', 'float', 'date'))),
contained AS (
  SELECT jc.query_id, jc.table_id, jc.s_i, jc.t_i, count(*) AS shared
  FROM jc JOIN vals a ON a.table_id = jc.query_id AND a.ordinal = jc.s_i
  JOIN vals b ON b.table_id = jc.table_id AND b.ordinal = jc.t_i AND b.value = a.value GROUP BY ALL),
ratios AS (
  SELECT k.*, shared / least(x.n, y.n) AS containment FROM contained k
  JOIN val_n x ON x.table_id = k.query_id AND x.ordinal = s_i JOIN val_n y ON y.table_id = k.table_id AND y.ordinal = t_i),
join_s3 AS (
  SELECT c.query_id, c.table_id, coalesce(max(containment), 0) AS s3 FROM c2 c LEFT JOIN ratios USING (query_id, table_id) GROUP BY ALL)"""

SQL_UNION_JUDGE = f"""
tp AS (SELECT query_id AS source_table_id, table_id AS target_table_id, 'SLD' AS scenario FROM c2), {SQL_SCORES},
union_s3 AS (
  SELECT c.query_id, c.table_id, coalesce(k.found, 0) / w.n_cols AS s3 FROM c2 c
  JOIN (SELECT table_id, count(*) AS n_cols FROM all_cols GROUP BY ALL) w ON w.table_id = c.query_id
  LEFT JOIN (SELECT source_table_id, target_table_id, count(DISTINCT src_idx) AS found FROM scores
             WHERE round(m_score, 9) >= {P.THETA_CAND} GROUP BY ALL) k ON k.source_table_id = c.query_id AND k.target_table_id = c.table_id)"""


def sql_rank(s3: str, plan: P.DiscoveryParams) -> str:
    def hat(s: str) -> str:
        return f"({s} - min({s}) OVER w) / (max({s}) OVER w - min({s}) OVER w + {P.EPSILON}) AS {s}_hat"

    return f"""
c3 AS (SELECT c2.*, v.s3 FROM c2 JOIN {s3} v USING (query_id, table_id) WHERE round(v.s3, 9) > {plan.theta_3}),
hats AS (SELECT *, {hat("s1")}, {hat("s2")}, {hat("s3")} FROM c3 WINDOW w AS (PARTITION BY query_id)),
ranking AS (
  SELECT *, {plan.w_1} * s1_hat + {plan.w_2} * s2_hat + {plan.w_3} * s3_hat AS score,
         row_number() OVER (PARTITION BY query_id ORDER BY round({plan.w_1} * s1_hat + {plan.w_2} * s2_hat + {plan.w_3} * s3_hat, 9) DESC, table_id) AS rank
  FROM hats)"""


SQL_DISCOVER_JOIN = f"{SQL_BENCH_BASE}, {SQL_BENCH_FEATURES}, {SQL_JOIN_JUDGE}, {sql_rank('join_s3', P.JOIN_PLAN)}"
SQL_DISCOVER_UNION = f"{SQL_BENCH_BASE}, {SQL_BENCH_FEATURES}, {SQL_UNION_JUDGE}, {sql_rank('union_s3', P.UNION_PLAN)}"
SQL_RANKING = """SELECT query_id, rank, table_id, round(score, 6) AS score, round(s1, 6) AS s1, round(s2, 6) AS s2, round(s3, 6) AS s3,
  round(s1_hat, 5) AS s1_hat, round(s2_hat, 5) AS s2_hat, round(s3_hat, 5) AS s3_hat, degraded FROM ranking"""


def all_queries(store, subtask):
    return store.tables.selectExpr("table_id AS query_id", "tenant_id", f"'{subtask}' AS subtask")


def _shown(ranking):
    return ranking.selectExpr(
        "query_id", "bigint(rank) AS rank", "table_id", "round(score, 6) AS score",
        *[f"round(layer_scores.{s}, 6) AS {s}" for s in ("s1", "s2", "s3")],
        *[f"round(normalized.{s}, 5) AS {s}" for s in ("s1_hat", "s2_hat", "s3_hat")],
        "degraded",
    )


@query(
    "value_containment",
    f"""WITH RECURSIVE {SQL_BENCH_BASE}, {SQL_BENCH_FEATURES}, {SQL_JOIN_JUDGE}
    SELECT query_id, table_id, CAST(s_i AS BIGINT) AS src_idx, CAST(t_i AS BIGINT) AS tgt_idx, shared AS n_shared,
           round(containment, 9) AS containment FROM ratios""",
)
def value_containment(spark, sf_dir):
    store = C.store(spark, sf_dir)
    c2 = R.lake_layer_two(store, R.planned(store))
    found = verdicts.containment(verdicts.joinable_columns(c2, store.features), store.value_keys)
    return found.selectExpr(
        "query_id", "table_id", "bigint(src_idx) AS src_idx", "bigint(tgt_idx) AS tgt_idx", "n_shared",
        "round(containment, 9) AS containment",
    )


@query("discover_join", f"WITH RECURSIVE {SQL_DISCOVER_JOIN} {SQL_RANKING}")
def discover_join(spark, sf_dir):
    """Every table of the benchmark lake as a JOIN query."""
    store = C.store(spark, sf_dir)
    return _shown(jobs.discover(all_queries(store, "JOIN"), store).ranking)


@query("discover_union", f"WITH RECURSIVE {SQL_DISCOVER_UNION} {SQL_RANKING}")
def discover_union(spark, sf_dir):
    store = C.store(spark, sf_dir)
    return _shown(jobs.discover(all_queries(store, "UNION"), store).ranking)


@query(
    "discover_without_verdicts",
    f"""WITH RECURSIVE {SQL_BENCH_BASE}, none AS (SELECT query_id, table_id, 0.0::DOUBLE AS s3 FROM c2),
    {sql_rank("none", replace(P.JOIN_PLAN, theta_3=-1.0))}
    {SQL_RANKING.replace("degraded FROM", "true AS degraded FROM")}""",
)
def discover_without_verdicts(spark, sf_dir):
    """The judge fails for every query, so they are ranked on two layers and degraded."""
    store = C.store(spark, sf_dir)
    none = spark.createDataFrame([], "query_id string, table_id string, s3 double")
    return _shown(jobs.discover(all_queries(store, "JOIN"), store, lambda queries, c2: none).ranking)


SQL_MATCH = f"""{SQL_DISCOVER_UNION}, {SQL_BENCH_SIZES},
tp2 AS (SELECT query_id AS source_table_id, r.table_id AS target_table_id, {SQL_SCENARIO} AS scenario
        FROM ranking r JOIN sizes s ON s.table_id = r.table_id),
{SQL_SCORES.replace("tp.*", "tp2.*").replace("FROM tp JOIN", "FROM tp2 JOIN").replace("components AS", "components2 AS").replace("scores AS", "scores2 AS").replace("FROM components)", "FROM components2)")},
maps AS (
  SELECT source_table_id, target_table_id, source_column, target_column, scenario,
         greatest(0, least(1, (m_score - {P.THETA_CAND}) / (1 - {P.THETA_CAND}))) AS confidence
  FROM scores2 WHERE round(m_score, 9) >= {P.THETA_CAND}
  QUALIFY row_number() OVER (PARTITION BY source_table_id, target_table_id, src_idx ORDER BY round(m_score, 9) DESC, tgt_idx) <= {P.TARGETS_PER_SOURCE}),
accepted AS (SELECT * FROM maps WHERE round(confidence, 9) >= {P.THETA_MATCH})"""


@query(
    "integrate_union",
    f"""WITH RECURSIVE {SQL_MATCH}
    SELECT source_table_id, target_table_id, source_column, target_column, scenario, round(confidence, 6) AS confidence FROM accepted""",
)
def integrate_union(spark, sf_dir):
    """Every table as a UNION query, matched against all of its ranked tables."""
    store = C.store(spark, sf_dir)
    _, maps = jobs.integrate(all_queries(store, "UNION"), store)
    return maps.selectExpr(
        "source_table_id", "target_table_id", "source_column", "target_column", "scenario",
        "round(confidence, 6) AS confidence",
    )


SQL_NEXT_PART = SQL_MATCH.replace(
    "FROM ranking r JOIN sizes s ON s.table_id = r.table_id",
    """FROM (SELECT DISTINCT a.table_id AS query_id, b.table_id FROM bcols a JOIN bcols b ON a.base = b.base AND b.part = (a.part + 1) % 8) r
          JOIN sizes s ON s.table_id = r.table_id""",
)


@query(
    "integrate_targets",
    f"""WITH RECURSIVE {SQL_NEXT_PART}
    SELECT source_table_id, target_table_id, source_column, target_column, scenario, round(confidence, 6) AS confidence FROM accepted""",
)
def integrate_targets(spark, sf_dir):
    """Every table with an explicit target, the next part of the same table, whatever is ranked."""
    store = C.store(spark, sf_dir)
    part = "int(element_at(split(query_id, '_'), -1))"
    target = f"concat(regexp_replace(query_id, '[0-9]+$', ''), ({part} + 1) % 8)"
    queries = all_queries(store, "UNION").selectExpr("*", f"{target} AS target_id")
    _, maps = jobs.integrate(queries, store)
    return maps.selectExpr(
        "source_table_id", "target_table_id", "source_column", "target_column", "scenario",
        "round(confidence, 6) AS confidence",
    )


@query("match_one_to_one")
def match_one_to_one(spark, sf_dir):
    """All ordered pairs of the given tables, one-to-one; the assignment has no SQL form."""
    store = C.base_store(spark, sf_dir)
    maps = jobs.match(_same_tenant_pairs(store), store)
    return maps.selectExpr(
        "source_table_id", "target_table_id", "source_column", "target_column", "scenario",
        "round(confidence, 6) AS confidence",
    )


@query(
    "match_one_to_one_total",
    f"""WITH RECURSIVE {SQL_BASE_PAIRS},
    maps AS (
      SELECT source_table_id, target_table_id, src_idx, tgt_idx,
             greatest(0, least(1, (m_score - {P.THETA_CAND}) / (1 - {P.THETA_CAND}))) AS confidence
      FROM scores WHERE round(m_score, 9) >= {P.THETA_CAND}
      QUALIFY row_number() OVER (PARTITION BY source_table_id, target_table_id, src_idx ORDER BY round(m_score, 9) DESC, tgt_idx) <= {P.TARGETS_PER_SOURCE}),
    edges AS (
      SELECT *, dense_rank() OVER (PARTITION BY source_table_id, target_table_id ORDER BY src_idx) AS i
      FROM maps WHERE round(confidence, 9) >= {P.THETA_MATCH}),
    choices AS (
      SELECT source_table_id, target_table_id, i, CAST(1 AS BIGINT) << CAST(tgt_idx AS BIGINT) AS bit, CAST(confidence AS DOUBLE) AS gain FROM edges
      UNION ALL SELECT DISTINCT source_table_id, target_table_id, i, CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM edges),
    plans(source_table_id, target_table_id, i, taken, total) AS (
      SELECT DISTINCT source_table_id, target_table_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM edges
      UNION ALL
      SELECT p.source_table_id, p.target_table_id, c.i, p.taken | c.bit, p.total + c.gain
      FROM plans p JOIN choices c ON c.source_table_id = p.source_table_id AND c.target_table_id = p.target_table_id
        AND c.i = p.i + 1 AND (p.taken & c.bit) = 0)
    SELECT source_table_id, target_table_id, round(max(total), 6) AS total FROM plans GROUP BY ALL""",
)
def match_one_to_one_total(spark, sf_dir):
    """The greatest total confidence of a one-to-one assignment per table pair, which SQL finds by trying all."""
    store = C.base_store(spark, sf_dir)
    maps = jobs.match(_same_tenant_pairs(store), store)
    return maps.groupBy(*matching.PAIR).agg(F.round(F.sum("confidence"), 6).alias("total"))
