"""Exact top-k of every query over a candidate set, without a pair ever being shuffled.

Queries and candidates are hashed into blocks of bounded size. A cell of the grid
sees one block of each, scores them with numpy and returns only its best ``k``
candidates per query; a window over those gives the global best. The size of a
cell depends on neither the popularity of a term nor the size of a tenant, and a
few queries against many candidates form a grid one cell high, so the candidates
are not replicated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from lakeweave import params as P
from lakeweave.session import bounded_batches, materialize

_CELL = ["tenant_id", "q_block", "c_block"]


def _tenant_by_row(df: DataFrame, key: str) -> DataFrame:
    """The tenant as something that depends on the row.

    A literal would be folded out of the joins below, which would leave nested loops.
    """
    return df.withColumn("tenant_id", F.expr(f"concat(tenant_id, left(coalesce(string({key}), ''), 0))"))


def _grid(queries: DataFrame, candidates: DataFrame, q_rows: int, c_rows: int):
    queries, candidates = _tenant_by_row(queries, "query_id"), _tenant_by_row(candidates, "table_id")
    sizes = (
        queries.groupBy("tenant_id")
        .agg(F.expr(f"int(ceil(count(*) / {q_rows}))").alias("q_blocks"))
        .join(
            candidates.groupBy("tenant_id").agg(
                F.expr(f"int(ceil(count(*) / {c_rows}))").alias("c_blocks")
            ),
            "tenant_id",
        )
    )
    # Fresh aliases: both sides often come from the same table.
    q = queries.join(sizes, "tenant_id").selectExpr(
        *[f"{c} AS {c}" for c in queries.columns],
        "int(pmod(xxhash64(query_id), q_blocks)) AS q_block",
        "explode(sequence(0, c_blocks - 1)) AS c_block",
    )
    c = candidates.join(sizes, "tenant_id").selectExpr(
        *candidates.columns,
        "int(pmod(xxhash64(table_id), c_blocks)) AS c_block",
        "explode(sequence(0, q_blocks - 1)) AS q_block",
    )
    return q, c


def query_rows(rows: int, cores: int, least: int = 1024, most: int = P.SCALE.block_candidates) -> int:
    """Queries per block, so that there are two blocks per core where blocks then are neither small nor large."""
    return min(most, max(least, -(-rows // (2 * cores))))


def block_top_k(
    queries: DataFrame,
    candidates: DataFrame,
    scorer: Callable,
    q_rows: int = P.SCALE.block_queries,
    c_rows: int = P.SCALE.block_candidates,
    packed: DataFrame | None = None,
) -> DataFrame:
    """``query_id, table_id, score`` of the best candidates of the same tenant.

    ``queries`` has ``query_id, tenant_id, k, theta`` and ``candidates`` has
    ``table_id, tenant_id``, each with what ``scorer(queries, candidates)`` needs;
    that function yields one row of scores per query. A score counts if it is above
    ``theta`` (null: any); scores are compared at nine places, ties go to the
    smaller id, and a query never meets itself. Both inputs are read twice, for their
    sizes and for their rows, so costly ones should be written first.

    ``packed`` holds the queries in blocks, see ``pack``, where the candidates are the same
    rows under another name, all of one tenant. It is written once, and every pair of its
    blocks is read: no row is copied to a disk, and the two inputs are not read.
    """
    def best(q_frame, c_frame):
        import numpy as np

        out = {"query_id": [], "k": [], "table_id": [], "score": []}
        c_frame = c_frame.sort_values("table_id", kind="stable").reset_index(drop=True)
        ids = c_frame["table_id"].to_numpy()
        if len(q_frame) and len(c_frame):
            rows = zip(q_frame["query_id"], q_frame["k"], q_frame["theta"], scorer(q_frame, c_frame))
            for query_id, k, theta, scores in rows:
                scores = np.round(scores, 9)
                keep = ids != query_id
                if theta is not None and not np.isnan(theta):
                    keep &= scores > theta
                found = np.flatnonzero(keep)
                if len(found) > k:
                    edge = np.partition(scores[found], len(found) - k)[len(found) - k]
                    found = found[scores[found] >= edge]
                # Candidates are in id order, so a stable sort breaks ties by id.
                found = found[np.argsort(-scores[found], kind="stable")[:k]]
                out["query_id"] += [query_id] * len(found)
                out["k"] += [k] * len(found)
                out["table_id"] += list(ids[found])
                out["score"] += list(scores[found])
        return out

    if packed is not None:
        return _paired(packed, best, dict(queries.dtypes)["query_id"])
    return _merged(queries, candidates, best, q_rows, c_rows)


def _typed() -> Callable:
    """What makes results of a cell a frame with explicit types: a cell without results must have the same columns."""

    def typed(found):
        import pandas as pd

        kinds = {"query_id": object, "k": "int64", "table_id": object, "score": "float64"}
        return pd.DataFrame({n: pd.Series(v, dtype=kinds[n]) for n, v in found.items()})

    return typed


def _best_of_all(cells: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "table_id")
    return (
        cells.withColumn("rank", F.row_number().over(w))
        .filter("rank <= k")
        .select("query_id", "table_id", "score")
    )


def _merged(queries: DataFrame, candidates: DataFrame, best: Callable, q_rows: int, c_rows: int) -> DataFrame:
    """The best ``k`` over all cells, of each of which ``best(queries, candidates)`` gives those of one."""
    q, c = _grid(queries, candidates, q_rows, c_rows)
    typed = _typed()

    def of_cell(q_frame, c_frame):
        return typed(best(q_frame, c_frame))

    id_type = dict(queries.dtypes)["query_id"], dict(candidates.dtypes)["table_id"]
    cells = (
        q.groupBy(*_CELL)
        .cogroup(c.groupBy(*_CELL))
        .applyInPandas(
            of_cell, f"query_id {id_type[0]}, k int, table_id {id_type[1]}, score double"
        )
    )
    return _best_of_all(cells)


# What a block of sparse rows is made of: sizes, then bytes.
_SIZES = ["block", "names_n", "postings_n"]
_PARTS = ["head", "names", "codes", "weights"]
PACKED = ", ".join([*(f"{c} bigint" for c in _SIZES), *(f"{c} binary" for c in _PARTS)])


def pack(most: int, key: str = "query_id", k: int | None = None, theta: float | None = None) -> Callable:
    """What makes batches with ``key, terms, weights`` blocks of at most ``most`` rows, a row (``PACKED``) each.

    Terms are numbers; in a block they are numbered anew and written as distances, and the bytes of weights apart, all
    compressed. Without ``k`` the batches have ``k`` and ``theta``.
    """
    most = max(256, min(most, P.SCALE.block_queries))
    postings = P.SCALE.block_postings

    def packing(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        from pyspark import TaskContext

        numbers = iter(range(TaskContext.get().partitionId() << 32, 1 << 63))
        codec = pa.Codec("zstd", compression_level=1)

        def squeezed(values):
            planes = np.ascontiguousarray(values.view("uint8").reshape(len(values), -1).T)
            return codec.compress(planes.tobytes(), asbytes=True) if len(values) else b""

        def block(held):
            table = pa.Table.from_batches(held)
            terms, weights = (table[c].combine_chunks() for c in ("terms", "weights"))
            sizes = pc.list_value_length(terms).to_numpy()
            names, code = np.unique(terms.flatten().to_numpy(), return_inverse=True)
            row = np.repeat(np.arange(len(sizes)), sizes)
            order = np.argsort(row * max(1, len(names)) + code, kind="stable")
            code = code[order]
            step = np.diff(code, prepend=0)
            first = np.cumsum(sizes[sizes > 0]) - sizes[sizes > 0]
            step[first] = code[first]
            head = {"query_id": table[key], "k": table["k"] if k is None else pa.array([k] * len(sizes), pa.int32())}
            head["theta"] = table["theta"] if k is None else pa.array([theta] * len(sizes), pa.float64())
            head = pa.table(head | {"size": pa.array(sizes, pa.int64())})
            with pa.BufferOutputStream() as sink:
                with pa.ipc.new_stream(sink, head.schema) as writer:
                    writer.write_table(head)
                head = sink.getvalue().to_pybytes()
            made = [next(numbers), len(names), len(code)]
            made += [head, squeezed(names), squeezed(step.astype("int32")), squeezed(weights.flatten().to_numpy()[order])]
            return pa.RecordBatch.from_pydict({n: pa.array([v]) for n, v in zip(_SIZES + _PARTS, made)})

        held, n, size = [], 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, min(256, most))
                held, n, size = [*held, part], n + len(part), size + len(part["terms"].flatten())
                if n + 256 > most or size >= postings:
                    yield block(held)
                    held, n, size = [], 0, 0
        if n:
            yield block(held)

    return packing


def _unpacked() -> Callable:
    """What makes the rows of a block a frame again, and the names of its terms.

    Terms are numbers from 0: places in ``known``, the names of another block, or beyond them.
    """

    def unpacked(block, known=None):
        import numpy as np
        import pyarrow as pa

        codec = pa.Codec("zstd")

        def spread(data, n, kind):
            width = np.dtype(kind).itemsize
            planes = np.frombuffer(codec.decompress(data, n * width, asbytes=True) if n else b"", "uint8")
            return np.ascontiguousarray(planes.reshape(width, n).T).reshape(-1).view(kind)

        frame = pa.ipc.open_stream(block["head"]).read_all().to_pandas()
        names = spread(block["names"], block["names_n"], "int64")
        step = spread(block["codes"], block["postings_n"], "int32")
        sizes = frame.pop("size").to_numpy()
        sums, held = np.cumsum(step, dtype="int64"), sizes > 0
        first = (np.cumsum(sizes) - sizes)[held]
        code = (sums - np.repeat(sums[first] - step[first], sizes[held])).astype("int32")
        if known is not None:
            number = np.searchsorted(known, names)
            number[number == len(known)] = 0
            new = known[number] != names if len(known) else np.ones(len(names), bool)
            number[new] = len(known) + np.arange(new.sum())
            code = number.astype("int32")[code]
        ends = np.cumsum(sizes)[:-1]
        for column, values in (("terms", code), ("weights", spread(block["weights"], block["postings_n"], "float64"))):
            listed = np.empty(len(frame), object)
            for i, part in enumerate(np.split(values, ends)):
                listed[i] = part
            frame[column] = listed
        return frame, names

    return unpacked


def _paired(packed: DataFrame, best: Callable, kind: str) -> DataFrame:
    """The best ``k`` over all pairs of blocks of the same rows, which are written once. ``kind`` is the type of an id.

    The blocks that one task reads in turn for a block of queries are of bounded size, and only the best of all of
    them leave it.
    """
    # Their bytes are compressed; another codec would only hold pages of several blocks outside the heap.
    blocks = materialize(packed, "blocks", "none")
    total = blocks.agg(F.sum(sum(F.octet_length(c) for c in _PARTS))).first()[0] or 0
    parts = max(1, -(-total // P.SCALE.paired_bytes))
    columns, typed, unpacked = _SIZES + _PARTS, _typed(), _unpacked()
    left = blocks.select(*[F.col(c).alias(f"q_{c}") for c in columns])
    right = blocks.select(*[F.col(c).alias(f"c_{c}") for c in columns]).coalesce(parts)

    def of_pairs(batches):
        import pandas as pd
        import pyarrow as pa

        def reduced(found):
            found = pd.concat(found).sort_values(["query_id", "score", "table_id"], ascending=[True, False, True])
            kept = found[found.groupby("query_id").cumcount() < found["k"]]
            return pa.RecordBatch.from_pandas(kept, schema=out, preserve_index=False)

        name, found = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                if batch["q_block"][i].as_py() != name:
                    if found:
                        yield reduced(found)
                    name, found = batch["q_block"][i].as_py(), []
                    queries, names = unpacked({c: batch[f"q_{c}"][i].as_py() for c in columns})
                candidates, _ = unpacked({c: batch[f"c_{c}"][i].as_py() for c in columns}, names)
                found.append(typed(best(queries, candidates.rename(columns={"query_id": "table_id"}))))
        if found:
            yield reduced(found)

    schema = f"query_id {kind}, k int, table_id {kind}, score double"
    out = to_arrow_schema(_parse_datatype_string(schema))
    return _best_of_all(bounded_batches(left.crossJoin(right)).mapInArrow(of_pairs, schema))


def dense_top_k(
    queries: DataFrame,
    candidates: DataFrame,
    q_rows: int = P.SCALE.block_queries,
    c_rows: int = P.SCALE.block_candidates,
) -> DataFrame:
    """``block_top_k`` with ``dense_scorer``, for which most pairs are only compared in single precision.

    A pair whose rough score, with room for its error, cannot be among the best ``k`` is done with; the others are scored
    in double precision, so the result is the same. ``queries`` may have ``cells``, the only ones it meets of the candidates'
    ``cell``, and ``floor``, a score below which nothing matters.
    """
    return _merged(queries, candidates, _dense_best(), q_rows, c_rows)


# Rough scores, and numbers of exact ones, that are held at once.
_ROUGH = 2**22
_EXACT = 2**22


def _dense_best() -> Callable:
    """What ``dense_top_k`` does with a block of queries and one of candidates; it carries all that its tasks need."""

    def matrix(column):
        import numpy as np

        found = np.stack(column.to_numpy())
        return found if found.dtype.kind == "f" else found.astype("float64")

    def best(q_frame, c_frame):
        import numpy as np
        import pandas as pd

        if not len(q_frame) or not len(c_frame):
            return {"query_id": [], "k": [], "table_id": [], "score": []}
        # In id order within a cell; the place in the order of all ids breaks ties.
        c_frame = c_frame.sort_values("table_id", kind="stable").reset_index(drop=True)
        place = np.arange(len(c_frame))
        if "cells" in q_frame:
            place = np.argsort(c_frame["cell"].to_numpy(), kind="stable")
            c_frame = c_frame.iloc[place]
        ids, query_ids = c_frame["table_id"].to_numpy(), q_frame["query_id"].to_numpy()
        codes, _ = pd.factorize(np.concatenate([ids.astype(object), query_ids.astype(object)]))
        own, asking = codes[: len(ids)], codes[len(ids) :]
        left, right = matrix(q_frame["vector"]), matrix(c_frame["vector"])
        lengths = [np.sqrt(np.einsum("ij,ij->i", m, m, dtype="float64")) for m in (left, right)]
        rough = "float32" if max(x.max() for x in lengths) < 1e15 else "float64"
        rough_left, rough_right = left.astype(rough, copy=False), right.astype(rough, copy=False)
        # More than a rough score and a limit can be wrong by, and half of the last place of a rounded score.
        slack = (left.shape[1] + 8) * 2.0**-23 * lengths[0] * lengths[1].max() + 1e-9
        k = q_frame["k"].to_numpy()
        theta = q_frame["theta"].to_numpy(dtype="float64", na_value=np.nan)
        floor = q_frame["floor"].to_numpy(dtype="float64", na_value=np.nan) if "floor" in q_frame else np.full(len(k), np.nan)
        low = np.nan_to_num(np.fmax(theta, floor), nan=-np.inf) - slack

        def hits(rows, start, stop):
            """Pairs of ``rows`` and the candidates from ``start`` to ``stop`` that may be among the best, and their scores."""
            scores = rough_left[rows] @ rough_right[start:stop].T
            order = np.argsort(own[start:stop], kind="stable")
            known = own[start:stop][order]
            first, last = (np.searchsorted(known, asking[rows], side) for side in ("left", "right"))
            for i in np.flatnonzero(last > first):  # a query never meets itself
                scores[i, order[first[i] : last[i]]] = -np.inf
            least = low[rows].astype(scores.dtype)
            kept = scores >= least[:, None]
            most = int(k[rows].max())
            if stop - start > most:
                # Few are left where the floor is high; else the k-th best of these candidates is found.
                many = np.flatnonzero(np.count_nonzero(kept, axis=1) > 4 * most + 64)
                if len(many):
                    edge = np.partition(scores[many], stop - start - most, axis=1)[:, stop - start - most]
                    least[many] = np.maximum(least[many], (edge - 2 * slack[rows[many]]).astype(scores.dtype))
                    kept[many] = scores[many] >= least[many][:, None]
            i, j = np.nonzero(kept)
            other = own[start + j] != asking[rows[i]]
            i, j = i[other], j[other]
            exact = np.empty(len(i))
            step = max(1, _EXACT // left.shape[1])
            for at in range(0, len(i), step):
                part = slice(at, at + step)
                a, b = left[rows[i[part]]].astype("float64"), right[start + j[part]].astype("float64")
                exact[part] = np.einsum("ij,ij->i", a, b)
            exact = np.round(exact, 9)
            limit = theta[rows[i]]
            keep = np.isnan(limit) | (exact > limit)
            return best_of(rows[i][keep], start + j[keep], exact[keep])

        def best_of(row, at, score):
            order = np.lexsort((place[at], -score, row))
            row, at, score = row[order], at[order], score[order]
            starts = np.searchsorted(row, row, "left")
            keep = np.arange(len(row)) - starts < k[row]
            return row[keep], at[keep], score[keep]

        if "cells" in q_frame:
            cell = c_frame["cell"].to_numpy()
            met = [np.asarray(x, dtype=cell.dtype) for x in q_frame["cells"]]
            flat = np.concatenate(met)
            by_cell = np.argsort(flat, kind="stable")
            flat, owner = flat[by_cell], np.repeat(np.arange(len(met)), [len(x) for x in met])[by_cell]
            names, starts = np.unique(cell, return_index=True)
            stops = [*starts[1:], len(cell)]
            segments = [
                (owner[np.searchsorted(flat, n, "left") : np.searchsorted(flat, n, "right")], a, b)
                for n, a, b in zip(names, starts, stops)
            ]
        else:
            segments = [(np.arange(len(q_frame)), 0, len(c_frame))]
        found = []
        for rows, start, stop in segments:
            step = max(1, _ROUGH // (stop - start))
            found += [hits(rows[at : at + step], start, stop) for at in range(0, len(rows), step)]
        parts = [np.concatenate(x) for x in zip(*found)] if found else [np.empty(0, int), np.empty(0, int), np.empty(0)]
        row, at, score = best_of(*parts)
        return {"query_id": query_ids[row], "k": k[row], "table_id": ids[at], "score": score}

    return best


def dense_scorer() -> Callable:
    """Dot products of the ``vector`` columns, a bounded number of queries at a time."""

    def score(queries, candidates):
        import numpy as np

        right = np.stack(candidates["vector"].to_numpy()).astype("float64").T
        for start in range(0, len(queries), 256):
            left = np.stack(queries["vector"].to_numpy()[start : start + 256]).astype("float64")
            yield from left @ right

    return score


# Share of the pairs of a block's rows that a term brings together, from which it is a column of a dense matrix, and
# numbers of such a matrix, of scores and of products that are held at once.
_DENSE_SHARE = 0.0036
_DENSE = 2**21
_SCORES = 2**20
_PRODUCTS = 2**19


def sparse_scorer(text_weight: float, type_weight: float, kinds: list[str]) -> Callable:
    """Weighted sum of the dot product of ``terms``/``weights`` and multiset Jaccard of ``kinds``.

    Terms that most rows share are multiplied as dense matrices, the others posting by posting.
    """

    def score(queries, candidates):
        import numpy as np
        import pandas as pd

        def flat(frame):
            row = np.repeat(np.arange(len(frame)), [len(t) for t in frame["terms"]])
            # Numbers keep their type; an empty array has none of its own and is left out.
            held = [np.asarray(t) for t in frame["terms"] if len(t)]
            terms = np.concatenate([t if t.dtype.kind in "iu" else t.astype(object) for t in held] or [np.empty(0, object)])
            weights = [np.asarray(w, dtype="float64") for w in frame["weights"] if len(w)]
            return row, terms, np.concatenate(weights or [np.empty(0)])

        n, m = len(queries), len(candidates)
        (q_row, q_terms, q_w), (c_row, c_terms, c_w) = flat(queries), flat(candidates)
        if q_terms.dtype != c_terms.dtype:
            q_terms, c_terms = q_terms.astype(object), c_terms.astype(object)
        codes = np.concatenate([c_terms, q_terms])
        if codes.dtype.kind != "i" or not len(codes) or codes.min() < 0 or codes.max() > 2 * len(codes):
            codes, _ = pd.factorize(codes)
        size = codes.max() + 1 if len(codes) else 0
        c_code, q_code = codes[: len(c_row)], codes[len(c_row) :]
        c_df, q_df = (np.bincount(x, minlength=size) for x in (c_code, q_code))
        common = np.flatnonzero(c_df * q_df >= _DENSE_SHARE * n * m) if text_weight else np.empty(0, int)
        common = common[np.argsort(-(c_df * q_df)[common], kind="stable")[: _DENSE // max(1, m)]]
        column = np.full(size, -1)
        column[common] = np.arange(len(common))
        right, own = np.zeros((m, len(common))), column[c_code]
        np.add.at(right, (c_row[own >= 0], own[own >= 0]), c_w[own >= 0])
        # The other postings of the candidates by term, those of the queries by row.
        rest = (column < 0) & (c_df > 0) & (q_df > 0)
        order = np.flatnonzero(rest[c_code])
        order = order[np.argsort(c_code[order], kind="stable")]
        starts = np.cumsum(np.where(rest, c_df, 0)) - np.where(rest, c_df, 0)
        c_row, c_w = c_row[order], c_w[order]
        counts = candidates[kinds].to_numpy() if kinds else None
        step = max(1, _SCORES // max(1, m))
        for a in range(0, n, step):
            b = min(n, a + step)
            part = slice(*np.searchsorted(q_row, [a, b]))
            row, code, w = q_row[part] - a, q_code[part], q_w[part]
            own = column[code]
            left = np.zeros((b - a, len(common)))
            np.add.at(left, (row[own >= 0], own[own >= 0]), w[own >= 0])
            text = left @ right.T
            cells = text.reshape(-1)
            row, code, w = (x[rest[code]] for x in (row, code, w))
            df = c_df[code]
            done = np.cumsum(df)
            cuts = np.unique(np.searchsorted(done, np.arange(0, done[-1] if len(done) else 0, _PRODUCTS), "left"))
            for at, to in zip(cuts, [*cuts[1:], len(df)]):
                d = df[at:to]
                first = np.cumsum(d) - d
                place = np.arange(d.sum()) + np.repeat(starts[code[at:to]] - first, d)
                np.add.at(cells, np.repeat(row[at:to] * m, d) + c_row[place], np.repeat(w[at:to], d) * c_w[place])
            total = text_weight * text
            if kinds:
                for i, q in enumerate(queries[kinds].to_numpy()[a:b]):
                    low, high = np.minimum(counts, q).sum(1), np.maximum(counts, q).sum(1)
                    total[i] += type_weight * np.divide(low, high, out=np.zeros(m), where=high > 0)
            yield from total

    return score
