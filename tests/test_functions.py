"""Unit vectors and properties of the column expressions."""

import math
import uuid

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave import params as P
from lakeweave.functions import ids, similarity as sim, text, types


def one(spark, *exprs):
    return spark.range(1).selectExpr(*exprs).first()


def pairs(spark, rows):
    """Name pairs with their features as structs ``x`` and ``y``."""
    df = spark.createDataFrame(rows, "a string, b string")
    return sim.with_name_features(sim.with_name_features(df, "a", "x"), "b", "y")


def brute_lcs(a, b):
    prev = [0] * (len(b) + 1)
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(prev[j] + 1 if x == y else max(prev[j + 1], row[j]))
        prev = row
    return prev[-1]


def test_stable_id_equals_uuid5(spark):
    seeds = ["abc", "", "default:orders:00ff", "täble:ß:漢字"]
    df = spark.createDataFrame([(s,) for s in seeds], "s string")
    got = [r[0] for r in df.select(ids.stable_id(F.col("s"))).collect()]
    assert got == [str(uuid.uuid5(uuid.UUID(P.ID_NAMESPACE), s)) for s in seeds]


@pytest.mark.parametrize(
    "data_type, expected",
    [
        (T.ShortType(), "int"),
        (T.LongType(), "int"),
        (T.FloatType(), "float"),
        (T.DecimalType(10, 2), "float"),
        (T.BooleanType(), "bool"),
        (T.DateType(), "date"),
        (T.TimestampNTZType(), "date"),
        (T.BinaryType(), "str"),
        (T.ArrayType(T.StringType()), "str"),
        (T.MapType(T.StringType(), T.IntegerType()), "str"),
        (T.DayTimeIntervalType(), "str"),
    ],
)
def test_logical_types(data_type, expected):
    assert types.logical_type(data_type) == expected


def test_tokens(spark):
    row = spark.range(1).select(
        F.expr(text.name_tokens("'patientBirth_Date-of  birth'")),
        text.word_tokens(F.lit("Été user_id x² a-b")),
        F.expr(text.name_tokens("'__'")),
    ).first()
    assert row[0] == ["patient", "birth", "date", "of"]
    assert row[1] == ["été", "user_id", "x²", "a", "b"]
    assert row[2] == []


def test_name_similarity_vectors(spark):
    rows = [("patient_id", "PatientID"), ("", ""), ("", "abc"), ("_", "-"), (" Age ", "age")]
    got = (
        pairs(spark, rows)
        .selectExpr(
            f"{sim.name_similarity('x', 'y')} AS name",
            f"{sim.edit_similarity('x', 'y')} AS lev",
            f"{sim.subsequence_similarity('x', 'y')} AS seq",
            f"{sim.token_similarity('x', 'y')} AS tok",
        )
        .collect()
    )
    assert got[0].name > 0.6
    assert (got[1].lev, got[1].seq, got[1].tok) == (1.0, 0.0, 0.0)
    assert (got[2].lev, got[2].seq) == (0.0, 0.0)
    assert got[3].tok == 0.0
    assert got[4].name == pytest.approx(1.0)


def test_subsequence_beyond_word_size(spark):
    a, b = "ab" * 50 + "xyz", "ba" * 47 + "zyx" + "q"
    df = pairs(spark, [(a, b), (a[:62], b), (a, b[:62]), (a[:63], b[:63]), ("😀ab", "b😀a")])
    got = [r[0] for r in df.selectExpr(sim.subsequence_length("x", "y")).collect()]
    assert got == [brute_lcs(r["a"], r["b"]) for r in df.collect()]


@settings(
    max_examples=4,
    deadline=None,
    phases=[Phase.generate],
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(
    st.lists(
        st.tuples(
            st.text(alphabet="abcXY_ -é9", max_size=12), st.text(alphabet="abcXY_ -é9", max_size=12)
        ),
        min_size=20,
        max_size=40,
    )
)
def test_name_similarity_properties(spark, rows):
    got = pairs(spark, rows).selectExpr(
        "x.norm AS a",
        "y.norm AS b",
        f"{sim.subsequence_length('x', 'y')} AS lcs",
        f"{sim._lcs_rows('x', 'y')} AS lcs_rows",
        f"{sim.name_similarity('x', 'y')} AS ab",
        f"{sim.name_similarity('y', 'x')} AS ba",
        f"{sim.subsequence_similarity('x', 'y')} AS seq",
        f"{sim.subsequence_bound('x', 'y')} AS bound",
        f"{sim.name_similarity('x', 'x')} AS aa",
        "size(x.tokens) AS tokens",
    )
    for r in got.collect():
        assert r.lcs == brute_lcs(r.a, r.b)
        assert r.lcs_rows == r.lcs or not r.a or not r.b
        assert 0.0 <= r.ab <= 1.0 + 1e-12
        assert r.ab == pytest.approx(r.ba)
        assert r.seq <= r.bound + 1e-12
        if r.tokens:
            assert r.aa == pytest.approx(1.0)


def test_type_similarity(spark):
    def score(a, b, **kw):
        return sim.type_similarity(f"'{a}'", f"'{b}'", **kw)

    row = one(
        spark,
        score("int", "int"),
        score("int", "str"),
        score("str", "int"),
        score("str", "int", symmetric=True),
        score("bool", "str"),
        score("date", "str"),
    )
    assert list(row) == [1.0, 0.5, 0.0, 0.5, 0.0, 0.5]


def stats(*values):
    fields = ["mean", "std", "q25", "q50", "q75"]
    return "named_struct(" + ", ".join(f"'{n}', {v}D" for n, v in zip(fields, values)) + ")"


def test_numeric_similarity(spark):
    base, ten = stats(50, 10, 40, 50, 60), stats(500, 100, 400, 500, 600)
    none = "cast(NULL AS struct<mean:double,std:double,q25:double,q50:double,q75:double>)"
    row = one(
        spark,
        sim.numeric_similarity(base, base),
        sim.numeric_similarity(base, ten),
        sim.numeric_similarity(base, none),
        sim.relative_similarity("double('NaN')", "1D"),
        sim.relative_similarity("-1D", "1D"),
    )
    assert row[0] == pytest.approx(1.0)
    assert row[1] < 0.2
    assert row[2:] == (0.0, 1.0, 0.0)


def test_category_similarity(spark):
    a, b, none = "map('M', 0.5D, 'F', 0.5D)", "map('M', 0.6D, 'F', 0.4D)", "cast(NULL AS map<string,double>)"
    row = one(
        spark,
        sim.category_similarity(a, b),
        sim.category_similarity(a, "map('X', 1D)"),
        sim.category_similarity(a, none),
        sim.category_similarity("map('M', 0D)", a),
    )
    cosine = (0.5 * 0.6 + 0.5 * 0.4) / (math.hypot(0.5, 0.5) * math.hypot(0.6, 0.4))
    assert row[0] == pytest.approx(0.5 + 0.5 * cosine)
    assert row[0] > 0.9
    assert row[1:3] == (0.0, 0.0)
    assert row[3] == pytest.approx(0.25)


def test_type_jaccard(spark):
    row = one(
        spark,
        sim.type_jaccard("array('int', 'int', 'str')", "array('int', 'str', 'str')"),
        sim.type_jaccard("cast(array() AS array<string>)", "cast(array() AS array<string>)"),
        sim.type_jaccard("array('int')", "array('int')"),
        sim.dot("array(0.6D, 0.8D)", "array(0.6D, 0.8D)"),
    )
    assert list(row) == pytest.approx([0.5, 0.0, 1.0, 1.0])


def test_schema_hash_forms(spark):
    import hashlib

    cols = F.array(
        *[
            F.struct(
                F.lit(i).alias("ordinal"), F.lit(n).alias("col_name"), F.lit(t).alias("col_type")
            )
            for i, n, t in [(1, "name", "str"), (0, "id", "int")]
        ]
    )
    row = spark.range(1).select(ids.schema_hash(cols), ids.schema_hash(cols, with_ordinal=False)).first()
    assert row[0] == hashlib.sha256(b"0:id:int|1:name:str").hexdigest()[:16]
    assert row[1] == hashlib.sha256(b"id:int|name:str").hexdigest()[:16]


def test_mixed_score_weights(spark):
    row = one(
        spark,
        *[sim.mixed_score(f"'{s}'", "1D", "0.5D", "0.25D") for s in P.SCENARIOS],
        sim.mixed_score("'other'", "1D", "1D", "1D"),
    )
    assert [round(x, 9) for x in row] == [0.8, 0.7, 0.6, 0.0]
