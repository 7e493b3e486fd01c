"""Term weights of texts: sublinear frequency, smoothed inverse document frequency, unit length."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave import params as P
from lakeweave.functions.text import PART_PATTERN, WORD_PATTERN
from lakeweave.session import bounded_batches, materialize, spread


def tokens_sql(text: str, tokenizer: str = "word") -> str:
    """SQL for the tokens of a text column.

    ``word`` keeps underscores inside a word, so ``user_id`` is one term. ``name``
    also splits there, at hyphens and at camel case, as for column names.
    """
    if tokenizer == "word":
        return f"regexp_extract_all(lower({text}), r'{WORD_PATTERN}', 1)"
    if tokenizer == "name":
        spaced = f"regexp_replace({text}, '([a-z0-9])(?=[A-Z])', '$1 ')"
        return f"regexp_extract_all(lower({spaced}), r'{PART_PATTERN}', 1)"
    raise ValueError(f"unknown tokenizer {tokenizer}")


def term_counts(docs: DataFrame, key: str, text: str, tokenizer: str = "word") -> DataFrame:
    """``key, term, tf``. Repeats within a text are combined before the shuffle."""
    # The outer form spares computing the tokens a second time to filter empty texts.
    tokens = spread(docs.select(key, text), key).selectExpr(key, f"explode_outer({tokens_sql(text, tokenizer)}) AS term")
    tokens = tokens.filter("term IS NOT NULL")
    return tokens.groupBy(key, "term").agg(F.count("*").alias("tf"))


def fit(docs: DataFrame, counts: DataFrame) -> DataFrame:
    """``term, df, n_docs, idf`` of the terms that are neither rare nor everywhere."""
    seen = counts.groupBy("term").agg(F.count("*").alias("df"))
    return _known(docs, seen).select("term", "df", "n_docs", "idf")


def _known(docs: DataFrame, seen: DataFrame) -> DataFrame:
    """``n_docs, idf`` beside the rows of ``seen`` whose ``df`` is neither low nor high."""
    return docs.sparkSession.sql(
        f"""
        WITH sized AS (SELECT *, (SELECT count(*) FROM {{docs}}) AS n_docs FROM {{seen}})
        SELECT *, ln((1 + n_docs) / (1 + df)) + 1 AS idf FROM sized
        WHERE df >= CASE WHEN n_docs >= 3 THEN {P.MIN_DF} ELSE 1 END AND df <= {P.MAX_DF}D * n_docs
        """,
        seen=seen,
        docs=docs,
    )


def _terms_by_key(docs: DataFrame, key: str, text: str, tokenizer: str) -> DataFrame:
    """``key, terms, counts``, a row per key. Without ``counts`` each occurrence is listed.

    Only rows whose key repeats (null too) are shuffled, as their terms have to be added up.
    """
    docs = docs.select(key, text)
    repeats = docs.groupBy(key).agg(F.count("*").alias("n_rows")).filter("n_rows > 1").select(F.col(key).alias("repeated"))
    alone, merged = docs, None
    if not repeats.isEmpty():
        same = docs[key].eqNullSafe(repeats["repeated"])
        alone, again = docs.join(repeats, same, "left_anti"), docs.join(repeats, same, "left_semi")
        merged = (
            term_counts(again, key, text, tokenizer)
            .groupBy(key)
            .agg(F.collect_list(F.struct("term", "tf")).alias("p"))
            .selectExpr(key, "p.term AS terms", "p.tf AS counts")
        )
    listed = spread(alone, key).selectExpr(key, f"{tokens_sql(text, tokenizer)} AS terms", "cast(NULL AS array<bigint>) AS counts")
    return listed if merged is None else listed.unionByName(merged)


def _coded(rows: DataFrame, key: str) -> DataFrame:
    """Texts in chunks, each with its own numbers for its terms, so that a posting takes a few bytes.

    ``chunk``, a number of it, ``keys`` of its texts, ``ends`` of their postings in ``codes`` and ``tfs``, ``names`` of
    the codes in order and in how many of the texts they are (``dfs``). The numbers of chunks hold for one run, so the
    result should be written.
    """
    most = P.SCALE.chunk_tokens

    def coded(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        numbers = iter(range(TaskContext.get().partitionId() << 32, 1 << 63))

        def listed(values, kind):
            values = pa.array(values, kind) if isinstance(values, np.ndarray) else values
            return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

        def chunk(held):
            rows = pa.Table.from_batches(held)
            terms, counts = rows["terms"].combine_chunks(), rows["counts"].combine_chunks()
            lengths = pc.list_value_length(terms).to_numpy(zero_copy_only=False)
            encoded = terms.flatten().dictionary_encode()
            order = pc.sort_indices(encoded.dictionary)
            rank = np.empty(len(order), "int64")
            rank[order.to_numpy()] = np.arange(len(order))
            tf = np.ones(len(encoded), "int64")
            tf[np.repeat(counts.is_valid().to_numpy(zero_copy_only=False), lengths)] = counts.flatten().to_numpy()
            pair = np.repeat(np.arange(len(lengths)), lengths) * len(rank) + rank[encoded.indices.to_numpy()]
            by_pair = np.argsort(pair, kind="stable")
            pair = pair[by_pair]
            starts = np.flatnonzero(np.diff(pair, prepend=-1))
            row, code = np.divmod(pair[starts], len(rank))
            columns = {
                "chunk": pa.array([next(numbers)], pa.int64()),
                "keys": listed(rows[key].combine_chunks(), None),
                "ends": listed(np.cumsum(np.bincount(row, minlength=len(lengths))), pa.int32()),
                "codes": listed(code, pa.int32()),
                "tfs": listed(np.add.reduceat(tf[by_pair], starts), pa.int64()),
                "names": listed(encoded.dictionary.take(order), None),
                "dfs": listed(np.bincount(code, minlength=len(rank)), pa.int32()),
            }
            return pa.RecordBatch.from_pydict(columns)

        held, size = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                part = part.filter(pc.greater(pc.fill_null(pc.list_value_length(part["terms"]), 0), 0))
                held, size = [*held, part], size + len(part["terms"].flatten())
                if size >= most:
                    yield chunk(held)
                    held, size = [], 0
        if size:
            yield chunk(held)

    kind = dict(rows.dtypes)[key]
    return bounded_batches(rows).mapInArrow(
        coded,
        f"chunk bigint, keys array<{kind}>, ends array<int>, codes array<int>, tfs array<bigint>, names array<string>, dfs array<int>",
    )


def _vocabulary(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """``chunk, known, idf``: per chunk those of its codes whose terms are known, and the weights of these.

    A term is shuffled once per chunk that has it, whatever the number of its texts.
    """
    held = chunks.selectExpr("chunk", "posexplode(arrays_zip(names, dfs)) AS (code, held)")
    seen = (
        held.selectExpr("chunk", "code", "held.names AS term", "held.dfs AS df")
        .groupBy("term")
        .agg(F.sum("df").alias("df"), F.collect_list(F.struct("chunk", "code")).alias("places"))
    )
    known = _known(docs, seen).selectExpr("idf", "inline(places)").groupBy("chunk")
    return known.agg(F.collect_list(F.struct("code", "idf")).alias("p")).selectExpr("chunk", "p.code AS known", "p.idf AS idf")


def transform(chunks: DataFrame, vocabulary: DataFrame, key: str, into: tuple[Callable, str] | None = None) -> DataFrame:
    """``key, terms, weights``: unit vectors; a text without known terms is absent.

    ``into``, a function of batches and its schema, gets the vectors of the texts that have a key, with numbers for their
    terms, within the task that makes them.
    """
    joined = bounded_batches(chunks.drop("dfs").join(vocabulary, "chunk"))

    def units(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                keys, ends, codes, tfs, names, known, idf = (
                    batch[c][i].values for c in ("keys", "ends", "codes", "tfs", "names", "known", "idf")
                )
                weight = np.zeros(len(names))
                weight[known.to_numpy()] = idf.to_numpy()
                row = np.repeat(np.arange(len(keys)), np.diff(ends.to_numpy(), prepend=0))
                code = codes.to_numpy()
                w = (1 + np.log(tfs.to_numpy())) * weight[code]
                kept = weight[code] > 0
                row, code, w = row[kept], code[kept], w[kept]
                w /= np.sqrt(np.bincount(row, w * w, minlength=len(keys)))[row]
                n = np.bincount(row, minlength=len(keys))
                if not len(row):
                    continue
                offsets = pa.array(np.concatenate([[0], np.cumsum(n[n > 0])]), pa.int32())
                yield pa.RecordBatch.from_pydict(
                    {
                        key: keys.take(pa.array(np.flatnonzero(n))),
                        "terms": pa.ListArray.from_arrays(offsets, names.take(pa.array(code))),
                        "weights": pa.ListArray.from_arrays(offsets, pa.array(w)),
                    }
                )

    kind = chunks.schema["keys"].dataType.elementType.simpleString()
    if into:
        finish, schema = into
        numbered = joined.withColumn("names", F.expr("transform(names, t -> xxhash64(t))"))

        def finished(batches):
            return finish(batch.filter(batch[key].is_valid()) for batch in units(batches))

        return numbered.mapInArrow(finished, schema)
    return joined.mapInArrow(units, f"`{key}` {kind}, terms array<string>, weights array<double>")


def postings(vectors: DataFrame, key: str) -> DataFrame:
    """``key, term, weight`` rows."""
    return vectors.selectExpr(key, "inline(arrays_zip(terms, weights))").toDF(key, "term", "weight")


def fitted(
    docs: DataFrame,
    key: str,
    text: str,
    tokenizer: str = "word",
    keep: Callable[[DataFrame, str], DataFrame] = materialize,
) -> tuple[DataFrame, DataFrame]:
    """What ``transform`` needs to weigh the terms of the texts, which are tokenized once: both steps read the counts.

    No posting is shuffled by its term: texts are numbered in chunks, and a chunk gets the weights of its own terms. The
    model is written too: of known size, a small one meets the chunks without a shuffle.
    """
    chunks = keep(_coded(_terms_by_key(docs, key, text, tokenizer), key), "term-counts")
    return chunks, keep(_vocabulary(docs, chunks), "vocabulary")


def unit_terms(
    docs: DataFrame,
    key: str,
    text: str,
    tokenizer: str = "word",
    keep: Callable[[DataFrame, str], DataFrame] = materialize,
) -> DataFrame:
    """Fit and transform the same texts."""
    return transform(*fitted(docs, key, text, tokenizer, keep), key)
