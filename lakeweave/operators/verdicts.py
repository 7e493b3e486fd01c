"""Scoring of candidates by an outside judge as batch jobs, and built-in judges.

A verdict is keyed by the pair it judges. Requests number their candidates from 1
within the request only, and the number is resolved to a table when it is parsed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeweave import params as P
from lakeweave.functions import similarity as sim
from lakeweave.operators import matching
from lakeweave.session import materialize

_BATCH_JSON = "struct<scores:array<struct<candidate_idx:int,score:double,reason:string>>>"
_PAIR_JSON = "struct<reasoning:string,score:double,is_equivalent:boolean>"
_MAX_REASON, _MAX_REASONING = 60, 300


def request_batches(c2: DataFrame, size: int = P.VERDICT_BATCH) -> DataFrame:
    """C2 with ``batch_no`` and ``candidate_idx``, best candidates first."""
    w = Window.partitionBy("query_id").orderBy(F.round("s2", 9).desc(), "table_id")
    return (
        c2.withColumn("place", F.row_number().over(w) - 1)
        .withColumn("batch_no", F.expr(f"int(place div {size})"))
        .withColumn("candidate_idx", F.expr(f"int(place % {size}) + 1"))
        .drop("place")
    )


# What a request asks for: the relation that a subtask looks for, and the form of the answer.
_RELATIONS = {
    "JOIN": "some column of the candidate shares most of its values with a column of the query table",
    "UNION": "rows of the candidate could be appended to the query table",
}
_TABLE_REPLY = f"""named_struct('scores', array(named_struct(
    'candidate_idx', 'integer', 'score', 'number, 0 to 1', 'reason', 'string, {_MAX_REASON} characters at most')))"""
_PAIR_REPLY = f"""named_struct(
    'reasoning', 'string, {_MAX_REASONING} characters at most', 'score', 'number, 0 to 1', 'is_equivalent', 'boolean')"""
# The fields of a column that a scenario has data for.
_EVIDENCE = {
    "SMD": ("name", "type", "description"),
    "SSD": ("name", "type", "description", "samples"),
    "SLD": ("name", "type", "description", "samples", "statistics"),
}


def table_prompts(batches: DataFrame, queries: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """``query_id, batch_no, request``: one JSON document per batch.

    ``queries`` has ``query_id, subtask``; ``tables`` has ``table_id, table_name``;
    ``columns`` the catalog columns. Wide tables show only their first columns.
    """
    typed = F.struct("ordinal", F.struct(F.col("col_name").alias("name"), F.col("col_type").alias("type")).alias("c"))
    shape = columns.groupBy("table_id").agg(F.array_sort(F.collect_list(typed))["c"].alias("cols"))
    nothing = "cast(array() AS array<struct<name: string, type: string>>)"
    shown = (
        tables.select("table_id", "table_name")
        .join(shape, "table_id", "left")
        .select("table_id", "table_name", F.expr(f"coalesce(cols, {nothing})").alias("cols"))
    )
    candidate = F.struct(
        "candidate_idx",
        F.col("table_name").alias("name"),
        F.slice("cols", 1, P.CANDIDATE_COLUMNS_SHOWN).alias("columns"),
    )
    lists = (
        batches.select("query_id", "batch_no", "candidate_idx", "table_id")
        .join(shown, "table_id")
        .groupBy("query_id", "batch_no")
        .agg(F.array_sort(F.collect_list(candidate)).alias("candidates"))
    )
    query = F.struct(F.col("table_name").alias("name"), F.slice("cols", 1, P.QUERY_COLUMNS_SHOWN).alias("columns"))
    relation = F.create_map(*[F.lit(x) for pair in _RELATIONS.items() for x in pair])[F.col("subtask")]
    return (
        lists.join(queries.select("query_id", "subtask"), "query_id")
        .join(shown.withColumnRenamed("table_id", "query_id"), "query_id")
        .select(
            "query_id",
            "batch_no",
            F.to_json(
                F.struct(
                    F.col("subtask").alias("task"), relation.alias("relation"), query.alias("query"), "candidates",
                    F.expr(_TABLE_REPLY).alias("reply"),
                )
            ).alias("request"),
        )
    )


def pair_prompts(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Matching pairs with ``prompt``, a JSON document; a field without data in the scenario is left out."""

    def has(field: str):
        return F.col("scenario").isin([k for k, fields in _EVIDENCE.items() if field in fields])

    own = profiles.select(
        "column_id",
        F.struct(
            F.col("column_id").alias("id"), F.col("col_name").alias("name"), F.col("col_type").alias("type"),
            F.col("col_description").alias("description"), F.col("sample_values").alias("samples"),
            F.col("numeric_stats").alias("statistics"),
        ).alias("c"),
    )

    def column(side: str):
        c = F.col(side)
        fields = [c[f].alias(f) for f in ("id", "name", "type", "description")]
        fields += [F.when(has(f), c[f]).alias(f) for f in ("samples", "statistics")]
        return F.struct(*fields).alias(side)

    scores = F.struct(
        F.round(F.round("sim_name", 9), 4).alias("name_similarity"),
        F.round(F.round("sim_type", 9), 4).alias("type_similarity"),
        F.when(has("statistics"), F.round(F.round("sim_stat", 9), 4)).alias("statistics_similarity"),
        F.when(has("statistics"), F.round(F.round("m_score", 9), 4)).alias("mixed_score"),
    )
    evidence = F.create_map(*[x for k, v in _EVIDENCE.items() for x in (F.lit(k), F.array(*[F.lit(f) for f in v]))])
    return (
        pairs.join(own.withColumnsRenamed({"column_id": "source_col_id", "c": "source"}), "source_col_id")
        .join(own.withColumnsRenamed({"column_id": "target_col_id", "c": "target"}), "target_col_id")
        .select(
            *pairs.columns,
            F.to_json(
                F.struct(
                    "scenario", evidence[F.col("scenario")].alias("evidence"), column("source"), column("target"),
                    scores.alias("scores"), F.expr(_PAIR_REPLY).alias("reply"),
                )
            ).alias("prompt"),
        )
    )


def parse_table_verdicts(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores and rejects of ``query_id, batch_no, content`` responses.

    One entry out of range or incomplete rejects its whole response.
    """
    ok = f"""scores IS NOT NULL AND forall(scores, x ->
        x IS NOT NULL AND coalesce(x.candidate_idx >= 1, false) AND coalesce(x.score BETWEEN 0 AND 1, false)
        AND coalesce(length(x.reason) <= {_MAX_REASON}, false))"""
    parsed = responses.withColumn("scores", F.from_json("content", _BATCH_JSON)["scores"]).withColumn(
        "valid", F.expr(ok)
    )
    # Of several scores for one candidate the last one in the response counts.
    scores = (
        parsed.filter("valid")
        .selectExpr("query_id", "batch_no", "posexplode(scores) AS (pos, x)")
        .groupBy("query_id", "batch_no", F.col("x.candidate_idx").alias("candidate_idx"))
        .agg(F.max_by("x.score", "pos").alias("score"))
    )
    return scores, parsed.filter("NOT valid").select(*responses.columns)


def resolve_verdicts(batches: DataFrame, scores: DataFrame) -> DataFrame:
    """``query_id, table_id, s3`` from per-request numbers."""
    return batches.join(scores, ["query_id", "batch_no", "candidate_idx"]).selectExpr(
        "query_id", "table_id", "score AS s3"
    )


def parse_pair_verdicts(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Like ``parse_table_verdicts`` for one column pair per response."""
    keys = [c for c in responses.columns if c != "content"]
    parsed = responses.withColumn("v", F.from_json("content", _PAIR_JSON)).withColumn(
        "valid",
        F.expr(
            f"""coalesce(v.score BETWEEN 0 AND 1, false) AND v.is_equivalent IS NOT NULL
            AND coalesce(length(v.reasoning) <= {_MAX_REASONING}, false)"""
        ),
    )
    good = parsed.filter("valid").selectExpr(
        *keys, "v.score AS confidence", "v.is_equivalent AS is_equivalent", "v.reasoning AS reasoning"
    )
    return good, parsed.filter("NOT valid").select(*responses.columns)


def attach_pair_verdicts(pairs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every pair with its verdict; a pair without one counts as not equivalent."""
    key = ["source_col_id", "target_col_id"]
    return (
        pairs.join(verdicts.select(*key, "confidence", "is_equivalent", "reasoning"), key, "left")
        .withColumn("confidence", F.coalesce("confidence", F.lit(0.0)))
        .withColumn("is_equivalent", F.coalesce("is_equivalent", F.lit(False)))
        .withColumn("reasoning", F.coalesce("reasoning", F.lit("no valid verdict")))
    )


def split_by_cache(
    pairs: DataFrame, cache: DataFrame, key: list[str], now, ttl_hours: int = P.VERDICT_TTL_HOURS
) -> tuple[DataFrame, DataFrame]:
    """Pairs with a verdict younger than ``ttl_hours`` (the newest), and the pairs left to score."""
    fresh = cache.filter(
        (F.col("ts") > now - F.make_interval(hours=F.lit(ttl_hours))) & (F.col("ts") <= now)
    )
    rest = [c for c in cache.columns if c not in key]
    newest = fresh.groupBy(*key).agg(F.max_by(F.struct(*rest), "ts").alias("v")).select(*key, "v.*")
    return pairs.join(newest, key), pairs.join(newest, key, "left_anti")


def run_scorer(
    requests: DataFrame, load: Callable[[], Callable], keys: list[str], prompt: str, tasks: int | None = None
) -> DataFrame:
    """``keys, content``: raw answers of a user's scorer to the prompts.

    ``load()`` runs once per task and returns a function from a list of prompts to a
    list of answers; an answer of None stands for a failed call. ``tasks`` bounds
    the number of calls under way at a time.
    """
    types = dict(requests.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", content string"
    wanted = requests.select(*keys, F.col(prompt).alias("prompt"))

    def run(frames):
        ask = load()
        for frame in frames:
            answers = ask(frame["prompt"].tolist())
            yield frame[keys].assign(content=answers)

    return (wanted.repartition(tasks) if tasks else wanted).mapInPandas(run, schema)


# ---- built-in judges --------------------------------------------------------------------


def joinable_columns(c2: DataFrame, features: DataFrame) -> DataFrame:
    """Column pairs of candidate tables with similar names and comparable values.

    ``features`` comes from ``matching.column_features``.
    """
    w_lev, w_seq, w_tok = P.NAME_WEIGHTS
    a, b = "s.name", "t.name"
    slim = features.selectExpr(
        "table_id",
        f"""transform(columns, c -> struct(c.ordinal AS ordinal, c.name AS name,
            c.col_type IN {P.NUMERIC_TYPES} AS is_number)) AS columns""",
    )
    known = f"{w_lev}D * {sim.edit_similarity(a, b)} + {w_tok}D * {sim.token_similarity(a, b)}"
    return (
        matching.expand_pairs(c2.select("query_id", "table_id"), slim, "query_id", "table_id")
        .filter("s.is_number = t.is_number")
        .selectExpr("*", f"{known} AS known")
        .filter(f"known + {w_seq}D * {sim.subsequence_bound(a, b)} >= {P.JOIN_NAME_SIMILARITY}D - 1e-9D")
        .filter(
            f"round(known + {w_seq}D * {sim.subsequence_similarity(a, b)}, 9) >= {P.JOIN_NAME_SIMILARITY}D"
        )
        .selectExpr("query_id", "table_id", "s.ordinal AS src_idx", "t.ordinal AS tgt_idx")
    )


def containment(
    pairs: DataFrame, keys: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = materialize
) -> DataFrame:
    """Share of the smaller column's different values that both columns hold.

    ``keys`` has ``c, v1, v2``, the column and 128 bits of the value, so that no text is read or shuffled. Values that the
    same columns hold are counted together under a digest of these columns, once, and only such classes are copied per pair. They
    are joined on (target column, class), which occurs once per target column, so a value that is common in the
    whole lake does not gather in one task.
    """
    spark = pairs.sparkSession
    asked = keep(
        pairs.selectExpr("*", "xxhash64(query_id, src_idx) AS src", "xxhash64(table_id, tgt_idx) AS tgt"), "asked-columns"
    )
    named = spark.sql(
        """
        WITH named AS (SELECT src AS c FROM {asked} UNION SELECT tgt FROM {asked})
        SELECT c, v1, v2 FROM {keys} LEFT SEMI JOIN named USING (c)
        """,
        asked=asked,
        keys=keys.select("c", "v1", "v2"),
    )
    # A column may hold a value more than once, as whole numbers beyond 2^53 can be one double. Sums over halves
    # of the hashes of the columns, which cannot overflow, stand for the columns that hold a value.
    classes = keep(
        spark.sql(
            """
            WITH held AS (
              SELECT c, count(*) OVER (PARTITION BY v1, v2, c) AS times, count(*) OVER v AS m,
                     struct(sum(c & 4294967295) OVER v AS a, sum(shiftrightunsigned(c, 32)) OVER v AS b,
                            sum(xxhash64(c) & 4294967295) OVER v AS d, sum(shiftrightunsigned(xxhash64(c), 32)) OVER v AS e) AS class
              FROM {named} WINDOW v AS (PARTITION BY v1, v2))
            SELECT class, c, times, count(*) / times AS n_values FROM held WHERE m > times GROUP BY class, c, times
            """,
            named=named,
        ),
        "value-classes",
    )
    return spark.sql(
        """
        WITH sizes AS (SELECT c, count(*) AS n FROM {named} GROUP BY c),
        wanted AS (SELECT a.src, a.tgt, v.class, v.times, v.n_values FROM {asked} a JOIN {classes} v ON v.c = a.src),
        shared AS (
          SELECT w.src, w.tgt, bigint(sum(w.n_values * w.times * v.times)) AS n_shared
          FROM wanted w JOIN {classes} v ON v.c = w.tgt AND v.class = w.class
          GROUP BY w.src, w.tgt)
        SELECT p.query_id, p.src_idx, p.table_id, p.tgt_idx, s.n_shared, s.n_shared / least(a.n, b.n) AS containment
        FROM shared s JOIN {asked} p ON p.src = s.src AND p.tgt = s.tgt
        JOIN sizes a ON a.c = s.src JOIN sizes b ON b.c = s.tgt
        """,
        asked=asked,
        classes=classes,
        named=named,
    )


def judge_joins(c2: DataFrame, features: DataFrame, keys: DataFrame) -> DataFrame:
    """``query_id, table_id, s3``: the best containment over similarly named columns.

    ``features`` comes from ``matching.column_features``, ``keys`` are the value keys of the store.
    """
    best = (
        containment(joinable_columns(c2, features), keys)
        .groupBy("query_id", "table_id")
        .agg(F.max("containment").alias("s3"))
    )
    return c2.select("query_id", "table_id").join(best, ["query_id", "table_id"], "left").na.fill(0.0, ["s3"])


def judge_unions(c2: DataFrame, features: DataFrame, scenario: str = "SLD") -> DataFrame:
    """``query_id, table_id, s3``: the share of query columns with a candidate counterpart."""
    pairs = c2.selectExpr(
        "query_id AS source_table_id", "table_id AS target_table_id", f"'{scenario}' AS scenario"
    )
    scored = matching.pair_scores(pairs, features)
    found = scored.groupBy(*matching.PAIR).agg(F.count_distinct("src_idx").alias("n_found"))
    widths = features.select("table_id", F.size("columns").alias("n_cols"))
    return (
        c2.selectExpr("query_id", "table_id", "query_id AS source_table_id", "table_id AS target_table_id")
        .join(found, matching.PAIR, "left")
        .join(widths.withColumnRenamed("table_id", "query_id"), "query_id")
        .selectExpr("query_id", "table_id", "coalesce(n_found, 0) / n_cols AS s3")
    )


def judge_pairs(pairs: DataFrame) -> DataFrame:
    """Column-pair verdicts from the mixed score, scaled so that the candidate threshold is 0."""
    return pairs.selectExpr(
        "*",
        f"greatest(0D, least(1D, (m_score - {P.THETA_CAND}D) / (1 - {P.THETA_CAND}D))) AS confidence",
        "true AS is_equivalent",
        "'mixed score' AS reasoning",
    )
