"""Pairwise similarities as SQL expressions over column names; all run inside the JVM.

A function takes the SQL of its inputs and returns SQL, for ``selectExpr``, ``expr``
or a query text. What depends on one name alone is computed once per column by
``with_name_features`` and not once per pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lakeweave import params as P
from lakeweave.functions.text import name_tokens

# Longest name whose match state fits one signed 64-bit word without overflow.
_WORD_BITS = 62


def with_name_features(df: DataFrame, name: str, alias: str) -> DataFrame:
    """Adds ``struct(norm, len, chars, bits, tokens)`` of a name column.

    ``bits`` maps each character to the positions where it occurs, as bits of a word;
    null for a name that is too long for that.
    """
    kept = [f"`{c}`" for c in df.columns]
    bits = """map_from_entries(transform(array_distinct(_chars), c -> struct(c, aggregate(
        transform(_chars, (x, i) -> if(x = c, shiftleft(1L, i), 0L)), 0L, (m, b) -> m | b))))"""
    return (
        df.selectExpr(*kept, rf"lower(regexp_replace({name}, r'(?U)^\s+|\s+$', '')) AS _norm")
        .selectExpr(*kept, "_norm", "filter(split(_norm, ''), c -> c <> '') AS _chars")
        .selectExpr(
            *kept,
            f"""named_struct('norm', _norm, 'len', size(_chars), 'chars', _chars,
                'bits', if(size(_chars) <= {_WORD_BITS}, {bits}, NULL),
                'tokens', {name_tokens(name)}) AS {alias}""",
        )
    )


def edit_similarity(a: str, b: str) -> str:
    return f"(1 - levenshtein({a}.norm, {b}.norm) / greatest({a}.len, {b}.len, 1))"


def _lcs_words(a: str, b: str) -> str:
    """Bit-parallel common-subsequence length (Hyyrö 2004), one step per character of b.

    A zero bit of the state marks one more matched character of a.
    """
    ones = f"(shiftleft(1L, {a}.len) - 1)"
    hits = f"transform({b}.chars, c_ -> coalesce(try_element_at({a}.bits, c_), 0L))"
    step = f"((v_ + (v_ & m_)) | (v_ - (v_ & m_))) & {ones}"
    return f"({a}.len - bit_count(aggregate({hits}, {ones}, (v_, m_) -> {step})))"


def _lcs_rows(a: str, b: str) -> str:
    """The same by the usual row recurrence, for two names beyond the word size."""
    up, diag = "get(prev_, i_)", "if(i_ > 0, get(prev_, i_ - 1), 0)"
    left = "coalesce(get(r_, size(r_) - 1), 0)"
    cells = f"transform({b}.chars, (cb_, i_) -> struct(cb_ AS cb, {up} AS up, {diag} AS diag))"
    row = f"""aggregate({cells}, cast(array() AS array<int>), (r_, x_) -> concat(r_, array(
        if(x_.cb = ca_, x_.diag + 1, greatest(x_.up, {left})))))"""
    return f"""coalesce(try_element_at(aggregate({a}.chars, transform({b}.chars, c_ -> 0), (prev_, ca_) -> {row}), -1), 0)"""


def subsequence_length(a: str, b: str) -> str:
    return f"""CASE WHEN {a}.len = 0 OR {b}.len = 0 THEN 0
        WHEN {a}.len <= {_WORD_BITS} THEN {_lcs_words(a, b)}
        WHEN {b}.len <= {_WORD_BITS} THEN {_lcs_words(b, a)}
        ELSE {_lcs_rows(a, b)} END"""


def subsequence_similarity(a: str, b: str) -> str:
    return f"coalesce(2D * ({subsequence_length(a, b)}) / nullif({a}.len + {b}.len, 0), 0D)"


def subsequence_bound(a: str, b: str) -> str:
    """No common subsequence is longer than the shorter name."""
    return f"coalesce(2D * least({a}.len, {b}.len) / nullif({a}.len + {b}.len, 0), 0D)"


def set_jaccard(a: str, b: str) -> str:
    """Jaccard of two duplicate-free arrays; both empty gives 0."""
    shared = f"size(array_intersect({a}, {b}))"
    return f"coalesce({shared} / nullif(size({a}) + size({b}) - {shared}, 0), 0D)"


def token_similarity(a: str, b: str) -> str:
    return set_jaccard(f"{a}.tokens", f"{b}.tokens")


def name_similarity(a: str, b: str) -> str:
    lev, seq, tok = P.NAME_WEIGHTS
    return (
        f"({lev}D * {edit_similarity(a, b)} + {seq}D * {subsequence_similarity(a, b)}"
        f" + {tok}D * {token_similarity(a, b)})"
    )


def type_similarity(a: str, b: str, symmetric: bool = False) -> str:
    pairs = list(P.COMPATIBLE_TYPES)
    if symmetric:
        pairs += [(t, s) for s, t in P.COMPATIBLE_TYPES]
    listed = ", ".join(f"'{s}>{t}'" for s, t in dict.fromkeys(pairs))
    return (
        f"CASE WHEN {a} = {b} THEN 1D WHEN concat({a}, '>', {b}) IN ({listed}) THEN {P.TYPE_PARTIAL}D ELSE 0D END"
    )


def relative_similarity(a: str, b: str) -> str:
    gap = f"abs({a} - {b}) / (greatest(abs({a}), abs({b})) + {P.EPSILON}D)"
    return f"greatest(0D, least(1D, 1 - {gap}))"


def numeric_similarity(a: str, b: str) -> str:
    """Of two structs ``mean, std, q25, q50, q75``; a missing side gives 0."""
    w_mean, w_std, w_quart = P.NUMERIC_WEIGHTS

    def rel(field: str) -> str:
        return relative_similarity(f"coalesce({a}.{field}, 0D)", f"coalesce({b}.{field}, 0D)")

    quart = f"({rel('q25')} + {rel('q50')} + {rel('q75')}) / 3D"
    return (
        f"if({a} IS NULL OR {b} IS NULL, 0D, "
        f"{w_mean}D * {rel('mean')} + {w_std}D * {rel('std')} + {w_quart}D * {quart})"
    )


def category_similarity(a: str, b: str) -> str:
    """Of two ``map<value, frequency>`` columns; a missing side gives 0."""
    w_set, w_freq = P.CATEGORY_WEIGHTS

    def norm(m: str) -> str:
        return f"sqrt(aggregate(map_values({m}), 0D, (acc_, v_) -> acc_ + v_ * v_))"

    shared = f"array_intersect(map_keys({a}), map_keys({b}))"
    dot = f"aggregate({shared}, 0D, (acc_, k_) -> acc_ + element_at({a}, k_) * element_at({b}, k_))"
    cosine = f"coalesce({dot} / nullif({norm(a)} * {norm(b)}, 0D), 0D)"
    jaccard = set_jaccard(f"map_keys({a})", f"map_keys({b})")
    return f"if({a} IS NULL OR {b} IS NULL, 0D, {w_set}D * {jaccard} + {w_freq}D * {cosine})"


def stat_similarity(a: str, b: str) -> str:
    """Of two structs with ``col_type, numeric_stats, freqs``, by kind of their types."""
    numeric, category = P.NUMERIC_TYPES, P.CATEGORICAL_TYPES
    return f"""CASE WHEN {a}.col_type IN {numeric} AND {b}.col_type IN {numeric}
            THEN {numeric_similarity(f"{a}.numeric_stats", f"{b}.numeric_stats")}
        WHEN {a}.col_type IN {category} AND {b}.col_type IN {category}
            THEN {category_similarity(f"{a}.freqs", f"{b}.freqs")}
        ELSE 0D END"""


def scenario_weight(scenario: str, part: str) -> str:
    """Weight of ``text``, ``struct`` or ``stat`` in a scenario; unknown gives 0."""
    cases = " ".join(f"WHEN '{n}' THEN {getattr(w, part)}D" for n, w in P.SCENARIOS.items())
    return f"CASE {scenario} {cases} ELSE 0D END"


def mixed_score(scenario: str, name: str, kind: str, stat: str) -> str:
    parts = {"text": name, "struct": kind, "stat": stat}
    return "(" + " + ".join(f"{scenario_weight(scenario, p)} * {v}" for p, v in parts.items()) + ")"


def type_jaccard(a: str, b: str) -> str:
    """Multiset Jaccard of two arrays of type names; both empty gives 0."""

    def total(fn: str) -> str:
        return " + ".join(
            f"{fn}(size(filter({a}, t_ -> t_ = '{k}')), size(filter({b}, t_ -> t_ = '{k}')))"
            for k in P.LOGICAL_TYPES
        )

    return f"coalesce(({total('least')}) / nullif({total('greatest')}, 0), 0D)"


def dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x_, y_) -> double(x_) * double(y_)), 0D, (acc_, v_) -> acc_ + v_)"


def at_threshold(score: str) -> str:
    """Scores are rounded to nine places wherever they meet a threshold or an order,
    so that the order in which a sum was taken cannot decide."""
    return f"round({score}, 9)"
