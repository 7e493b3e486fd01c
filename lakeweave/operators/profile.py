"""Column statistics from the long form of a lake.

One aggregation by value (``value_counts``) feeds distinct ratios, quartiles, top
values, frequency maps and vocabularies. Its key is (column, value), so neither a
huge column nor all of its many values end up in one task. Repeated values are combined
before the shuffle, except in columns of many different values (``_counted``).
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Executor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave import params as P
from lakeweave.functions import text
from lakeweave.session import materialize
from lakeweave.sources.lake import Cells

KEY = ["table_id", "ordinal"]
STATS = ("mean", "std", "q25", "q50", "q75")
_QUARTILES = (0.25, 0.5, 0.75)

# Parts of a range of values (a power of two), and tasks over which the values of one column are divided.
_PARTS = 128
_SALTS = 16

# Length of the stand-in of a text that has at least as many bytes, and characters of its beginning kept beside it.
_STAND_IN = 48
_HEAD = 64
# Groups of a column's values of which the smallest digests are compared.
_LANES = 64
# One of so many values, by its hash, gives the bound of the smallest digests.
_DIGESTED = 2
# One of so many gives the sketch of a range of many values.
_SKETCHED = 8
_MANY = 100_000

# Rows of a table up to which a task can hold all its different values.
_HELD = 1_000_000
# Different values of a column up to which they are combined before the shuffle, estimated from one of so many by hash.
_COMBINED = 50_000
_SHARE = 64
# Different values that a task counts after the shuffle, and slots per task, among which they are dealt out.
_COUNTED = 1_000_000
_SLOTS = 64


@dataclass(frozen=True)
class ValueCounts:
    """Different non-null values per column with their counts.

    ``numeric`` has ``table_id, ordinal, value`` (double), ``shown`` (the stored value as
    text) and ``cnt``; ``text`` has ``table_id, ordinal, value, cnt``, and ``head`` where ``value`` is a
    stand-in (``key_counts``).
    """

    numeric: DataFrame | None
    text: DataFrame | None

    def kept(
        self, keep: Callable[[DataFrame, str], DataFrame], columns: DataFrame, pool: Executor | None = None
    ) -> ValueCounts:
        """Written once, for the columns of the catalog only; both kinds side by side if there is a pool."""
        wanted = columns.select(*KEY)

        def written(df: DataFrame | None, name: str) -> DataFrame | None:
            return None if df is None else keep(df.join(wanted, KEY, "left_semi"), name)

        run = map if pool is None else pool.map
        return ValueCounts(*run(written, (self.numeric, self.text), ("numbers", "texts")))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _both(whole: DataFrame | None, real: DataFrame | None) -> DataFrame | None:
    if whole is None or real is None:
        return whole if real is None else real
    return whole.unionByName(real)


def _numbers(cells: Cells) -> DataFrame | None:
    whole = cells.whole
    if whole is not None:
        whole = whole.withColumn("value", F.col("value").cast("double"))
    return _both(whole, cells.real)


def _many_valued(df: DataFrame) -> DataFrame:
    """``table_id, ordinal, n_share`` of the columns with many different values, and how many of them are in the share."""
    shared = df.select(*KEY, F.xxhash64("value").alias("h")).filter(F.pmod("h", F.lit(_SHARE)) == 0).distinct()
    counted = shared.groupBy(*KEY).agg(F.count("*").alias("n_share"))
    return counted.filter(F.col("n_share") * _SHARE > _COMBINED)


def _counted(
    cells: DataFrame,
    largest: int | None,
    shown: Callable[[DataFrame], DataFrame] = lambda df: df,
    keep: Callable[[DataFrame, str], DataFrame] = materialize,
) -> DataFrame:
    """Different non-null values per column of the ``shown`` cells, with ``cnt``.

    Combining the values of a column before the shuffle takes as much memory as a split has different ones, and saves
    little if they are many. So columns with many are dealt out as they are, which holds nothing, to as many tasks
    as their values need. Tables of at most ``_HELD`` rows need no such care; if ``largest``, the row count of the
    largest, is not known, the values are looked at. That only decides the way; every cell is counted.
    """
    present = cells.filter(F.col("value").isNotNull())

    def counted(df: DataFrame) -> DataFrame:
        return df.groupBy(*df.columns).agg(F.count("*").alias("cnt"))

    if largest is not None and largest <= _HELD:
        return counted(shown(present))
    many = keep(_many_valued(present), "many-valued")
    n_share = many.agg(F.sum("n_share")).first()[0]
    if not n_share:
        return counted(shown(present))
    tasks = max(cells.sparkSession.sparkContext.defaultParallelism, -(-n_share * _SHARE // _COUNTED))
    columns = F.broadcast(many.select(*KEY))
    apart = shown(present.join(columns, KEY, "left_semi"))
    slot = F.pmod(F.xxhash64(*KEY, "value"), F.lit(tasks * _SLOTS)).cast("int")
    apart = apart.withColumn("slot", slot).repartition(tasks, "slot")
    return counted(shown(present.join(columns, KEY, "left_anti"))).unionByName(counted(apart).drop("slot"))


def value_counts(cells: Cells, largest: int | None = None) -> ValueCounts:
    """``largest``: rows of the largest table, where that is known (``_counted``)."""
    # Whole numbers are counted before they become doubles, so ids beyond 2^53 stay apart.
    as_double = [
        _counted(df, largest).selectExpr(*KEY, "double(value) AS value", "string(value) AS shown", "cnt")
        if df is not None
        else None
        for df in (cells.whole, cells.real)
    ]
    return ValueCounts(
        numeric=_both(*as_double), text=_counted(cells.text, largest) if cells.text is not None else None
    )


def stand_in(value: Column) -> Column:
    """The text itself, or 192 bits of digests of a long one; no short text is as long as those."""
    digest = F.concat(F.md5(value), F.lpad(F.hex(F.xxhash64(value)), 16, "0"))
    return F.when(F.octet_length(value) < _STAND_IN, value).otherwise(digest)


def key_counts(cells: Cells, largest: int | None = None) -> ValueCounts:
    """``value_counts`` with stand-ins for texts, so that no long text is shuffled, sorted or written.

    ``head`` is the beginning of a long text and null for one that stands for itself.
    """
    text, value = cells.text, F.col("value")
    if text is not None:
        head = F.when(F.octet_length(value) >= _STAND_IN, F.left(value, F.lit(_HEAD)))
        text = _counted(text, largest, lambda df: df.select(*KEY, stand_in(value).alias("value"), head.alias("head")))
    return ValueCounts(numeric=value_counts(Cells(cells.whole, cells.real, None), largest).numeric, text=text)


def with_texts(text: DataFrame, *picked: DataFrame) -> DataFrame:
    """``table_id, ordinal, value, whole``: the long texts that the stand-ins of ``picked`` stand for.

    ``text`` are the cells. ``picked`` should be written, as its size decides whether the cells are shuffled.
    """
    wanted = _union([df.select(*KEY, "value") for df in picked]).filter(F.octet_length("value") == _STAND_IN).distinct()
    long = text.filter(F.octet_length("value") >= _STAND_IN).select(
        *KEY, stand_in(F.col("value")).alias("key"), F.col("value").alias("whole")
    )
    return long.withColumnRenamed("key", "value").join(wanted, [*KEY, "value"]).distinct()


def resolved(picked: DataFrame, texts: DataFrame) -> DataFrame:
    """``picked`` with whole texts instead of stand-ins."""
    whole = F.coalesce("whole", "value").alias("value")
    rest = [c for c in picked.columns if c not in (*KEY, "value", "head")]
    return picked.join(texts, [*KEY, "value"], "left").select(*KEY, whole, *rest)


def column_key() -> Column:
    """A column of the lake as one number."""
    return F.xxhash64(*KEY)


def value_keys() -> list[Column]:
    """``v1, v2``: 128 bits of a value, by which equal values meet without their text."""
    return [F.xxhash64("value").alias("v1"), F.xxhash64(F.lit(1), "value").alias("v2")]


def cell_summary(cells: Cells) -> DataFrame:
    """Rows, nulls, mean and sample deviation of every column, in the stored unit."""
    numbers, parts = _numbers(cells), []
    if numbers is not None:
        parts.append(
            numbers.groupBy(*KEY).agg(
                F.count("*").alias("n_rows"),
                F.count("value").alias("n_values"),
                F.avg("value").alias("mean"),
                F.stddev_samp("value").alias("std"),
            )
        )
    if cells.text is not None:
        none = F.lit(None).cast("double")
        parts.append(
            cells.text.groupBy(*KEY)
            .agg(F.count("*").alias("n_rows"), F.count("value").alias("n_values"))
            .select("*", none.alias("mean"), none.alias("std"))
        )
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.withColumn("n_null", F.col("n_rows") - F.col("n_values"))


def distinct_counts(counts: ValueCounts) -> DataFrame:
    """Different non-null values per column, and the rows that hold them."""
    frames = [df.select(*KEY, "cnt") for df in (counts.numeric, counts.text) if df is not None]
    out = frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])
    return out.groupBy(*KEY).agg(F.count("*").alias("n_distinct"), F.sum("cnt").alias("n_values"))


def quartiles(
    numeric: DataFrame,
    largest: int | None = None,
    max_values: int = P.SCALE.values_in_order,
    keep: Callable[[DataFrame, str], DataFrame] = materialize,
) -> DataFrame:
    """Exact linearly interpolated quartiles of every numeric column, by selection of ranks.

    A range of a column's values has some of the ranks that its quartiles need, and the number of rows below
    it. At first it is the whole column. A range with more than ``max_values`` different values is cut
    into parts of about as many different values each, with edges from a sketch; the rows of each part are counted, and
    the parts that hold a wanted rank are the next ranges. The sketch decides only how even the parts are.
    So at most ``max_values`` values per range are ever put in order, however large or skewed a column is.

    Each round reads ``numeric`` twice, so it should be a written table, and fetches one number, the size of the
    largest range. ``largest``, the row count of the largest table where it is known, may spare that.
    """
    ranges = _whole_columns(numeric)
    if largest is None or largest > max_values:
        # A range of one number is not cut: different whole numbers beyond 2^53 may be the same double.
        wide = (F.col("n_values") > max_values) & (F.col("low") < F.col("high"))
        ranges, before = keep(ranges, "ranges"), None
        while (size := ranges.agg(F.max(F.when(wide, F.col("n_values")))).first()[0]) and size != before:
            before = size
            ranges = keep(ranges.filter(~wide).unionByName(_cut(numeric, ranges.filter(wide))), "ranges")
    return _interpolated(_at_ranks(numeric, ranges))


def _position(q: float) -> Column:
    return (F.col("n") - 1) * F.lit(q)


def _whole_columns(numeric: DataFrame) -> DataFrame:
    ranks = [f(_position(q)).cast("long") for q in _QUARTILES for f in (F.floor, F.ceil)]
    return (
        numeric.groupBy(*KEY)
        .agg(
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.count("*").alias("n_values"),
            F.sum("cnt").alias("n"),
        )
        .select("*", F.lit(0).cast("long").alias("below"), F.array_distinct(F.array(*ranks)).alias("ranks"))
    )


def _inside_few(numeric: DataFrame, ranges: DataFrame) -> DataFrame:
    """The same for ranges of many values each, of which there can be but few; the values are not shuffled."""
    inside = F.col("value").between(F.col("low"), F.col("high"))
    return numeric.select(*KEY, "value", "cnt").join(F.broadcast(ranges), KEY).filter(inside)


def _inside(numeric: DataFrame, ranges: DataFrame) -> DataFrame:
    """The values inside the ranges. A column is divided by a salt, as one may hold most of the values."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1)))
    salt = F.pmod(F.xxhash64("value"), F.lit(_SALTS)).cast("int")
    return (
        numeric.select(*KEY, "value", "cnt", salt.alias("salt"))
        .join(ranges.withColumn("salt", salts), [*KEY, "salt"])
        .filter(F.col("value").between(F.col("low"), F.col("high")))
    )


def _cut(numeric: DataFrame, ranges: DataFrame) -> DataFrame:
    """The parts of the ranges that hold a wanted rank."""
    shares = [i / _PARTS for i in range(1, _PARTS)]
    edges = (
        _inside_few(numeric, ranges.select(*KEY, "low", "high", "n_values"))
        .filter((F.col("n_values") < _MANY) | (F.pmod(F.xxhash64("value"), F.lit(_SKETCHED)) == 0))
        .groupBy(*KEY, "low")
        .agg(F.percentile_approx("value", shares, 10_000).alias("edges"))
    )
    # Binary search: the number of edges up to the value. A step is a column of its own, which is compiled.
    placed = _inside_few(numeric, ranges.select(*KEY, "low", "high").join(edges, [*KEY, "low"]))
    placed = placed.withColumn("part", F.lit(0))
    for step in [_PARTS >> i for i in range(1, _PARTS.bit_length())]:
        at = F.col("part")
        placed = placed.withColumn("part", F.when(F.col("value") >= F.get("edges", at + (step - 1)), at + step).otherwise(at))
    counted = (
        placed.groupBy(*KEY, F.col("low").alias("outer_low"), "part")
        .agg(
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.count("*").alias("n_values"),
            F.sum("cnt").alias("n_inside"),
        )
    )
    before = Window.partitionBy(*KEY, "outer_low").orderBy("part")
    outer = ranges.select(*KEY, F.col("low").alias("outer_low"), "n", "below", "ranks")
    upto = F.col("below") + F.sum("n_inside").over(before)
    parts = counted.join(outer, [*KEY, "outer_low"]).withColumn("upto", upto)
    parts = parts.withColumn("below", F.col("upto") - F.col("n_inside"))
    held = F.filter("ranks", lambda r: (r >= F.col("below")) & (r < F.col("upto")))
    return (
        parts.withColumn("ranks", held)
        .filter(F.size("ranks") > 0)
        .select(*KEY, "low", "high", "n_values", "n", "below", "ranks")
    )


def _at_ranks(numeric: DataFrame, ranges: DataFrame) -> DataFrame:
    """``n, rank, value`` for every wanted rank of every column."""
    order = Window.partitionBy(*KEY, "low").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    rows = _inside(numeric, ranges).withColumn("upto", F.col("below") + F.sum("cnt").over(order))
    held = F.filter("ranks", lambda r: (r >= F.col("upto") - F.col("cnt")) & (r < F.col("upto")))
    return rows.select(*KEY, "n", "value", F.explode(held).alias("rank"))


def _interpolated(found: DataFrame) -> DataFrame:
    def at(rank: Column) -> Column:
        return F.max(F.when(F.col("rank") == rank, F.col("value")))

    ends = []
    for q, name in zip(_QUARTILES, STATS[2:]):
        ends += [at(F.floor(_position(q))).alias(f"{name}_low"), at(F.ceil(_position(q))).alias(f"{name}_high")]
    out = found.groupBy(*KEY, "n").agg(*ends)

    def between(q: float, name: str) -> Column:
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        share = _position(q) - F.floor(_position(q))
        return F.when(low == high, low).otherwise(low * (1 - share) + high * share).alias(name)

    return out.select(*KEY, *[between(q, name) for q, name in zip(_QUARTILES, STATS[2:])])


def numeric_stats(
    columns: DataFrame, cells: Cells, counts: ValueCounts, largest: int | None = None
) -> DataFrame:
    """``mean, std, q25, q50, q75`` of every numeric column of the catalog.

    Dates are in Unix seconds. A column without values gets zeros, and so does the
    deviation of a single value.
    """
    stats = cell_summary(cells).select(*KEY, "mean", "std").join(
        quartiles(counts.numeric, largest), KEY, "left"
    )
    return _in_units(columns.filter(F.col("col_type").isin(*P.NUMERIC_TYPES)).join(stats, KEY, "left"))


def _in_units(joined: DataFrame) -> DataFrame:
    unit = "CASE WHEN col_type = 'date' THEN 1e6D ELSE 1D END"
    return joined.selectExpr(
        *KEY, "col_name", "col_type", *[f"coalesce({n} / {unit}, 0D) AS {n}" for n in STATS]
    )


def frequencies(counts: ValueCounts, sizes: DataFrame) -> DataFrame:
    """Full frequency map of every categorical column, as rows."""
    return counts.text.join(sizes.select(*KEY, "n_rows"), KEY).withColumn(
        "freq", F.col("cnt") / F.col("n_rows")
    )


def top_values(freqs: DataFrame, k: int = P.TOP_VALUES) -> DataFrame:
    """The ``k`` most frequent values of every column, ties by value."""
    w = Window.partitionBy(*KEY).orderBy(F.col("cnt").desc(), F.col("value"))
    return freqs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def vocabulary(counts: ValueCounts, min_freq: int = P.VOCAB_MIN_FREQ) -> DataFrame:
    """Categorical values that occur often enough across the whole lake."""
    return (
        counts.text.groupBy("value").agg(F.sum("cnt").alias("cnt")).filter(F.col("cnt") >= min_freq)
    )


def aligned_frequencies(freqs: DataFrame, vocab: DataFrame) -> DataFrame:
    return freqs.join(vocab.select("value"), "value", "left_semi")


def top_texts(
    cells: Cells,
    keys: DataFrame,
    k: int = P.TOP_VALUES,
    keep: Callable[[DataFrame, str], DataFrame] = materialize,
) -> DataFrame:
    """``top_values`` of stand-ins (``key_counts``), with the texts that they stand for."""
    picked = keep(_top_keys(keys, k), "top-keys")
    return top_values(resolved(picked, with_texts(cells.text, picked)), k)


def _top_keys(keys: DataFrame, k: int) -> DataFrame:
    """Stand-ins that may be among the ``k`` most frequent; those with equal beginnings tie."""
    w = Window.partitionBy(*KEY).orderBy(F.col("cnt").desc(), F.coalesce("head", "value"))
    return keys.withColumn("place", F.rank().over(w)).filter(F.col("place") <= k).drop("place")


def _sampled(
    counts: ValueCounts, k: int, keep: Callable[[DataFrame, str], DataFrame]
) -> DataFrame:
    """``table_id, ordinal, value, digest`` of the values with the smallest digests, ``k`` per column and ties.

    The smallest digest of each lane of half a column is found first. The ``k``-th of these is one that the
    ``k``-th of all cannot exceed, so only values up to it are put in order. ``counts`` are read twice.
    """
    parts = []
    if counts.numeric is not None:
        parts.append(counts.numeric.select(*KEY, F.col("shown").alias("value"), F.md5("shown").alias("digest")))
    if counts.text is not None:
        of_text = F.md5("value")
        if "head" in counts.text.columns:
            of_text = F.when(F.octet_length("value") == _STAND_IN, F.left("value", F.lit(32))).otherwise(of_text)
        parts.append(counts.text.select(*KEY, "value", of_text.alias("digest")))
    values = _union(parts).withColumn("first", F.conv(F.left("digest", F.lit(15)), 16, 10).cast("long"))
    part = values.filter(F.pmod(F.xxhash64("value"), F.lit(_DIGESTED)) == 0)
    least = part.groupBy(*KEY, F.pmod(F.xxhash64("first"), F.lit(_LANES)).alias("lane")).agg(F.min("first").alias("first"))
    place = F.row_number().over(Window.partitionBy(*KEY).orderBy("first"))
    kth = F.max(F.when(F.col("place") == k, F.col("first")))
    bounds = keep(least.withColumn("place", place).groupBy(*KEY).agg(kth.alias("bound")), "sample-bounds")
    # Half a column may hold too few values for a bound, or none.
    return values.join(bounds, KEY, "left").filter("bound IS NULL OR first <= bound").select(*KEY, "value", "digest")


def sample_values(
    counts: ValueCounts,
    columns: DataFrame,
    k: int = P.SAMPLE_VALUES,
    keep: Callable[[DataFrame, str], DataFrame] = materialize,
) -> DataFrame:
    """Up to ``k`` different values per column as text.

    Distributed rows have no first five, so the values with the smallest digests
    stand for them; the choice does not depend on partitioning.
    """
    return _shown_samples(_sampled(counts, k, keep), columns, k)


def _shown_samples(sampled: DataFrame, columns: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy(*KEY).orderBy("digest", "value")
    picked = sampled.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    # Dates are counted in microseconds.
    return picked.join(columns.select(*KEY, "col_type"), KEY).selectExpr(
        *KEY,
        "CASE WHEN col_type = 'date' THEN string(timestamp_micros(try_cast(value AS bigint))) ELSE value END AS value",
        "rank",
    )


def sample_rows(df: DataFrame, n: int = P.SAMPLE_ROWS, seed: int = P.SAMPLE_SEED) -> DataFrame:
    """Exactly ``n`` rows (all, if there are fewer), the same ones on every run."""
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("")) for c in map(F.col, df.columns)]))
    return df.withColumn("_digest", digest).orderBy("_digest", *df.columns).limit(n).drop("_digest")


def head_rows(df: DataFrame, order: list[str], n: int = P.HEAD_ROWS) -> DataFrame:
    return df.orderBy(*order).limit(n)


def column_profiles(
    columns: DataFrame,
    cells: Cells,
    largest: int | None = None,
    counts: ValueCounts | None = None,
    sizes: DataFrame | None = None,
    keep: Callable[[DataFrame, str], DataFrame] = materialize,
) -> DataFrame:
    """One row per catalog column with ratios, statistics, top values and samples.

    ``counts`` (``key_counts``) and ``sizes`` are the value counts and the summary of the cells where they have been
    written already.
    """
    counts = counts or key_counts(cells, largest).kept(keep, columns)
    sizes = keep(cell_summary(cells), "summary") if sizes is None else sizes
    quarts = quartiles(counts.numeric, largest, keep=keep)
    top = keep(_top_keys(counts.text, P.TOP_VALUES), "top-keys")
    sampled = keep(_sampled(counts, P.SAMPLE_VALUES, keep), "sampled")
    texts = keep(with_texts(cells.text, top, sampled), "long-texts")
    ranked = (
        top_values(resolved(top, texts))
        .join(sizes.select(*KEY, "n_rows"), KEY)
        .withColumn("freq", F.col("cnt") / F.col("n_rows"))
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value", "freq"))).alias("ranked"))
    )
    samples = (
        _shown_samples(resolved(sampled, texts), columns, P.SAMPLE_VALUES)
        .groupBy(*KEY)
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value"))).alias("samples"))
    )
    joined = columns
    for stats in (sizes, distinct_counts(counts).drop("n_values"), quarts, ranked, samples):
        joined = joined.join(stats, KEY, "left")
    unit = "CASE WHEN col_type = 'date' THEN 1e6D ELSE 1D END"
    numeric = ", ".join(f"'{n}', coalesce({n} / {unit}, 0D)" for n in STATS)
    return joined.selectExpr(
        *columns.columns,
        "coalesce(n_rows, 0) AS n_rows",
        "coalesce(n_null / n_rows, 1D) AS null_ratio",
        "coalesce(coalesce(n_distinct, 0) / n_rows, 0D) AS distinct_ratio",
        f"CASE WHEN col_type IN {P.NUMERIC_TYPES} THEN named_struct({numeric}) END AS numeric_stats",
        f"""CASE WHEN col_type IN {P.CATEGORICAL_TYPES} THEN
            coalesce(transform(ranked, x -> named_struct('value', x.value, 'freq', x.freq)), array())
            END AS top_k""",
        "coalesce(samples.value, array()) AS sample_values",
    )


def null_ratio(missing: Column, rows: Column) -> Column:
    return F.coalesce(F.try_divide(missing, rows), F.lit(1.0))


def distinct_ratio(distinct: Column, rows: Column) -> Column:
    return F.when(F.coalesce(rows, F.lit(0)) == 0, F.lit(0.0)).otherwise(
        F.coalesce(distinct, F.lit(0)) / rows
    )


def table_profiles(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Text blob, encoder text and type list of every table."""
    described = columns.groupBy("table_id").agg(
        F.sort_array(
            F.collect_list(F.struct("ordinal", "col_name", "col_type", "col_description"))
        ).alias("cols")
    )
    cols = F.coalesce(
        "cols",
        F.array().cast("array<struct<ordinal:int,col_name:string,col_type:string,col_description:string>>"),
    )
    return tables.join(described, "table_id", "left").select(
        *tables.columns,
        text.text_blob(F.col("table_name"), cols).alias("text_blob"),
        text.table_text(F.col("table_name"), cols).alias("encoder_text"),
        F.transform(cols, lambda c: c["col_type"]).alias("type_multiset"),
    )


def column_texts(tables: DataFrame, columns: DataFrame) -> DataFrame:
    joined = columns.join(tables.select("table_id", "table_name"), "table_id")
    return joined.select(
        "table_id",
        "ordinal",
        *[c for c in ("column_id", "col_name", "col_type") if c in columns.columns],
        text.column_text(
            F.col("table_name"), F.col("col_name"), F.col("col_type"), F.col("col_description")
        ).alias("encoder_text"),
    )


_STATS_JSON = (
    "struct<numeric_stats:struct<mean:double,std:double,q25:double,q50:double,q75:double>,"
    "top_k:array<struct<value:string,freq:double>>>"
)


def store_profiles(profiles: DataFrame) -> DataFrame:
    """Statistics as JSON text, the interchange form of a column catalog row."""
    return profiles.withColumn("stat_summary", F.to_json(F.struct("numeric_stats", "top_k"))).drop(
        "numeric_stats", "top_k"
    )


def load_profiles(stored: DataFrame) -> DataFrame:
    """Back from JSON; missing ratios become 0."""
    parsed = F.from_json("stat_summary", _STATS_JSON)
    return (
        stored.withColumn("stats", parsed)
        .withColumn("null_ratio", F.coalesce("null_ratio", F.lit(0.0)))
        .withColumn("distinct_ratio", F.coalesce("distinct_ratio", F.lit(0.0)))
        .withColumn("numeric_stats", F.col("stats.numeric_stats"))
        .withColumn("top_k", F.col("stats.top_k"))
        .drop("stats", "stat_summary")
    )


def assemble(tables: DataFrame, profiles: DataFrame) -> DataFrame:
    """Table profiles with their columns nested in order."""
    fields = [c for c in profiles.columns if c not in ("table_id", "ordinal")]
    nested = profiles.groupBy("table_id").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", *fields))).alias("columns")
    )
    return tables.join(nested, "table_id", "left").withColumn(
        "type_multiset", F.col("columns.col_type")
    )


def candidate_pool(queries: DataFrame, tables: DataFrame) -> DataFrame:
    """READY tables of the query's tenant other than the query itself."""
    q = queries.select(F.col("table_id").alias("query_id"), F.col("tenant_id"))
    pool = tables.filter(F.col("status") == "READY")
    return q.join(pool, "tenant_id").filter(F.col("query_id") != F.col("table_id"))


def needs_refit(fitted_tables: Column, tables: Column) -> Column:
    """True once the lake has grown by half since the term model was fitted."""
    return (tables - fitted_tables) >= P.REFIT_GROWTH * fitted_tables
