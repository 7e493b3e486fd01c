"""Column pairs of table pairs: scores, cut-offs, acceptance, one-to-one assignment."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeweave import params as P
from lakeweave.functions import similarity as sim
from lakeweave.session import materialize

PAIR = ["source_table_id", "target_table_id"]

# Columns with the same value that one task compares with all others.
_COLUMNS_AT_ONCE = 256


def column_features(profiles: DataFrame) -> DataFrame:
    """One row per table with the columns as an array of what matching reads.

    Values are only compared for equality, so a 64-bit hash stands for each of the
    at most twenty; their texts may be long and would travel with every pair.
    """
    freqs = "map_from_entries(transform(top_k, x -> struct(xxhash64(x.value), x.freq)))"
    return (
        sim.with_name_features(profiles, "col_name", "name")
        .selectExpr(
            "table_id",
            f"struct(ordinal, column_id, col_name, name, col_type, numeric_stats, {freqs} AS freqs) AS c",
        )
        .groupBy("table_id")
        .agg(F.collect_list("c").alias("columns"))
    )


def expand_pairs(table_pairs: DataFrame, features: DataFrame, source: str, target: str) -> DataFrame:
    """``table_pairs`` with a row per column pair ``s, t``.

    Both tables' columns are joined on as arrays and expanded in place, so no column
    pair is shuffled.
    """
    keep = table_pairs.columns
    return (
        table_pairs.join(features.selectExpr(f"table_id AS {source}", "columns AS s_columns"), source)
        .join(features.selectExpr(f"table_id AS {target}", "columns AS t_columns"), target)
        .selectExpr(*keep, "explode(s_columns) AS s", "t_columns")
        .selectExpr(*keep, "s", "explode(t_columns) AS t")
    )


def pair_scores(
    table_pairs: DataFrame,
    features: DataFrame,
    theta_cand: float = P.THETA_CAND,
    symmetric_types: bool = False,
) -> DataFrame:
    """Column pairs of every ``(source_table_id, target_table_id, scenario)`` at or above ``theta_cand``.

    The subsequence score, the costly part, is only computed for pairs that could
    still reach the threshold with its upper bound.
    """
    keep = table_pairs.columns
    w_lev, w_seq, w_tok = P.NAME_WEIGHTS
    a, b = "s.name", "t.name"
    return (
        expand_pairs(table_pairs, features, *PAIR)
        .selectExpr(
            *keep,
            "s",
            "t",
            f"{w_lev}D * {sim.edit_similarity(a, b)} + {w_tok}D * {sim.token_similarity(a, b)} AS known",
            f"{sim.type_similarity('s.col_type', 't.col_type', symmetric_types)} AS sim_type",
            f"{sim.stat_similarity('s', 't')} AS sim_stat",
            f"{sim.scenario_weight('scenario', 'text')} AS w_text",
            f"{sim.scenario_weight('scenario', 'struct')} AS w_struct",
            f"{sim.scenario_weight('scenario', 'stat')} AS w_stat",
        )
        .selectExpr("*", "w_struct * sim_type + w_stat * sim_stat AS others")
        .filter(
            f"others + w_text * (known + {w_seq}D * {sim.subsequence_bound(a, b)}) >= {theta_cand}D - 1e-9D"
        )
        .selectExpr("*", f"known + {w_seq}D * {sim.subsequence_similarity(a, b)} AS sim_name")
        .selectExpr("*", "w_text * sim_name + others AS m_score")
        .filter(f"{sim.at_threshold('m_score')} >= {theta_cand}D")
        .selectExpr(
            *keep,
            "s.column_id AS source_col_id",
            "t.column_id AS target_col_id",
            "s.ordinal AS src_idx",
            "t.ordinal AS tgt_idx",
            "s.col_name AS source_column",
            "t.col_name AS target_column",
            "sim_name",
            "sim_type",
            "sim_stat",
            "m_score",
        )
    )


def top_targets(pairs: DataFrame, n: int = P.TARGETS_PER_SOURCE) -> DataFrame:
    """The best ``n`` target columns per source column and target table."""
    w = Window.partitionBy(*PAIR, "src_idx").orderBy(F.expr(sim.at_threshold("m_score")).desc(), "tgt_idx")
    return pairs.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def accepted(verified: DataFrame, theta: float = P.THETA_MATCH) -> DataFrame:
    """Pairs judged equivalent with enough confidence."""
    return verified.filter(f"is_equivalent AND {sim.at_threshold('confidence')} >= {theta}D")


def one_to_one(edges: DataFrame) -> DataFrame:
    """Keep the accepted pairs of a one-to-one assignment of greatest total confidence.

    A group is one table pair with at most ten edges per source column. Columns that
    share no edge, not even indirectly, are assigned separately, so the cubic step
    sees small matrices.
    """

    def assign(frame):
        import numpy as np

        def best_rows(gain):
            """Row of each column in a maximum-weight assignment; gain has rows <= columns.

            Shortest augmenting paths with potentials over costs ``-gain``.
            """
            n, m = gain.shape
            u, v = np.zeros(n), np.zeros(m)
            owner = np.full(m, -1)
            for first in range(n):
                row, reached, dist = first, np.zeros(m, bool), np.full(m, np.inf)
                via, entered, low, col = np.full(m, -1), [first], 0.0, -1
                while row >= 0:
                    step = low - gain[row] - u[row] - v
                    shorter = ~reached & (step < dist)
                    dist[shorter], via[shorter] = step[shorter], col
                    col = int(np.argmin(np.where(reached, np.inf, dist)))
                    low, reached[col] = dist[col], True
                    row = int(owner[col])
                    if row >= 0:
                        entered.append(row)
                closed = np.flatnonzero(reached)
                for c in closed:
                    if owner[c] >= 0:
                        u[owner[c]] += low - dist[c]
                    v[c] -= low - dist[c]
                u[first] += low
                while col >= 0:
                    before = int(via[col])
                    owner[col] = owner[before] if before >= 0 else first
                    col = before
            return owner

        src, tgt = frame["src_idx"].to_numpy(), frame["tgt_idx"].to_numpy()
        parent = {}

        def root(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for s, t in zip(src, tgt):
            parent[root(("s", s))] = root(("t", t))
        numbers = {}
        part = np.array([numbers.setdefault(root(("s", s)), len(numbers)) for s in src])
        keep = np.zeros(len(frame), bool)
        for p in np.unique(part):
            rows = np.flatnonzero(part == p)
            s_ids, s_at = np.unique(src[rows], return_inverse=True)
            t_ids, t_at = np.unique(tgt[rows], return_inverse=True)
            gain = np.zeros((len(s_ids), len(t_ids)))
            gain[s_at, t_at] = frame["confidence"].to_numpy()[rows]
            if gain.shape[0] <= gain.shape[1]:
                owner = best_rows(gain)
                keep[rows] = owner[t_at] == s_at
            else:
                owner = best_rows(gain.T)
                keep[rows] = owner[s_at] == t_at
        return frame[keep]

    return edges.groupBy(*PAIR).applyInPandas(assign, edges.schema)


def mappings(pairs: DataFrame) -> DataFrame:
    return pairs.select(
        *PAIR,
        "source_col_id",
        "target_col_id",
        "source_column",
        "target_column",
        "confidence",
        "scenario",
        "reasoning",
    )


def match_targets(
    queries: DataFrame,
    ranking: DataFrame | None = None,
    pool: DataFrame | None = None,
    fallback_to_pool: bool = False,
) -> DataFrame:
    """``source_table_id, target_table_id``: what each query is matched against.

    ``queries`` has ``query_id, target_id``. An explicit target wins, then the ranked
    tables; with ``fallback_to_pool`` a query without either takes its whole pool.
    """
    explicit = queries.filter("target_id IS NOT NULL").selectExpr(
        "query_id AS source_table_id", "target_id AS target_table_id"
    )
    out, open_queries = explicit, queries.filter("target_id IS NULL").select("query_id")
    if ranking is not None:
        ranked = ranking.join(open_queries, "query_id", "left_semi")
        out = out.unionByName(ranked.selectExpr("query_id AS source_table_id", "table_id AS target_table_id"))
    if pool is not None and fallback_to_pool:
        rest = open_queries
        if ranking is not None:
            rest = rest.join(ranking, "query_id", "left_anti")
        out = out.unionByName(
            pool.join(rest, "query_id", "left_semi").selectExpr(
                "query_id AS source_table_id", "table_id AS target_table_id"
            )
        )
    return out


def full_category_similarity(
    pairs: DataFrame, freqs: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = materialize
) -> DataFrame:
    """Category similarity over all values of the given column pairs that share any.

    ``pairs`` has ``source_table_id, src_idx, target_table_id, tgt_idx`` and ``freqs`` has
    ``table_id, ordinal, value, freq``. Values meet as 128 bits, and only those that more than one column holds go on, so
    nothing is copied per pair of columns. A value with more than ``_COLUMNS_AT_ONCE`` columns is divided over tasks.
    """
    w_set, w_freq = P.CATEGORY_WEIGHTS
    spark = pairs.sparkSession
    freqs = freqs.selectExpr(
        "xxhash64(table_id, ordinal) AS c", "xxhash64(value) AS v1", "xxhash64(1, value) AS v2", "freq"
    )
    held = keep(
        freqs.withColumn("m", F.count("*").over(Window.partitionBy("v1", "v2"))).filter("m > 1")
        .withColumn("blocks", F.expr(f"int(ceil(m / {_COLUMNS_AT_ONCE}))")),
        "shared-values",
    )
    # A value is held once by a column, so a pair of the same column is none of two.
    shared = spark.sql(
        """
        WITH one AS (SELECT c, v1, v2, freq, int(pmod(c, blocks)) AS block FROM {held}),
        other AS (SELECT c, v1, v2, freq, explode(sequence(0, blocks - 1)) AS block FROM {held})
        SELECT a.c AS src, b.c AS tgt, count(*) AS n_shared, sum(a.freq * b.freq) AS dot
        FROM one a JOIN other b ON a.v1 = b.v1 AND a.v2 = b.v2 AND a.block = b.block AND a.c <> b.c
        GROUP BY a.c, b.c
        """,
        held=held,
    )
    return spark.sql(
        f"""
        WITH sizes AS (SELECT c, count(*) AS n, sqrt(sum(freq * freq)) AS norm FROM {{freqs}} GROUP BY c),
        asked AS (
          SELECT *, xxhash64(source_table_id, src_idx) AS src, xxhash64(target_table_id, tgt_idx) AS tgt FROM {{pairs}})
        SELECT p.source_table_id, p.src_idx, p.target_table_id, p.tgt_idx, s.n_shared, s.dot,
               {w_set}D * n_shared / (a.n + b.n - n_shared) + {w_freq}D * dot / (a.norm * b.norm) AS sim_cat
        FROM {{shared}} s JOIN asked p ON p.src = s.src AND p.tgt = s.tgt
        JOIN sizes a ON a.c = s.src JOIN sizes b ON b.c = s.tgt
        """,
        pairs=pairs,
        freqs=freqs,
        shared=shared,
    )
