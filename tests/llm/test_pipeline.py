"""The pipeline and the registered queries against plain versions and SQL."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
import brute
from lakeweave.llm import packing, quality, secrets
from lakeweave.llm.queries import ORACLES, QUERIES
from tools.check import connect, rows_of


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cursor = connect(sf_dir).execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cursor.fetchall())


def test_pipeline(spark, sf_dir):
    from tokenizers import Tokenizer

    documents = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in quality.keep(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    for d in documents:
        counts = brute.base_counts(d["text"])
        if counts["n_words"] < 10 or 100 * counts["n_repeat_words"] > 20 * counts["n_words"]:
            assert d["doc_id"] not in kept
    rows = [d for d in documents if d["doc_id"] in kept]
    sets = [brute.shingles(brute.words(brute.lower_ascii(d["text"]))) for d in rows]
    first = {}
    for d, label in zip(rows, brute.components(sets)):
        first.setdefault(label, d)
    rows = list(first.values())
    flagged = {i for i, _, _, _ in brute.contained([(d["doc_id"], d["text"]) for d in rows], items)}
    rows = [d for d in rows if d["doc_id"] not in flagged]
    own = Tokenizer.from_file(packing.vocabulary_path())
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert set(got) == {d["doc_id"] for d in rows}
    for d in rows:
        text, out, at = d["text"], [], 0
        for s, _, e, _ in brute.secrets(text):
            if s >= at:
                out += [text[at:s], "[SECRET]"]
            at = max(at, e)
        text = "".join(out) + text[at:]
        ids = [i for _, part in sorted(got[d["doc_id"]]) for i in part]
        assert ids == [*own.encode(text, add_special_tokens=False).ids, 1]


def test_packing_query(spark, sf_dir):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.vocabulary_path())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    pieces = defaultdict(list)
    for r in QUERIES["op10_sequence_packing"](spark, sf_dir).collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    assert set(pieces) == set(texts)
    for i, t in texts.items():
        ids, at = [*own.encode(t, add_special_tokens=False).ids, 1], 0
        for start, length, crc, n in sorted(pieces[i]):
            assert start == at and n == len(ids)
            assert crc == zlib.crc32(np.array(ids[at : at + length], "<u4").tobytes())
            at += length
        assert at == len(ids)


def test_personal_data_query(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op3_personal_data"](spark, sf_dir).collect():
        want = brute.personal(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [len(want[k]) for k in brute.PERSONAL]


def test_more_rules_have_trigrams():
    assert all(secrets.trigram_query(r.pattern) for r in secrets.MORE_RULES)
