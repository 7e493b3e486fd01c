"""Archive (op6), URL filter (op8), sharding (op9) and packing (op10)."""

from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from brute import prose
from lakeweave.llm import packing, sharding, urls, warc

PAGES = [
    (1, "http://a.example.net/en/x?q#f", "x" * 1000),
    (2, "http://b.org/fr/", "x" * 1000),
    (3, None, "x" * 1000),
    (None, "http://c.com/\r\nX: y", "x" * 1000),
    (4, "https://EXAMPLE.com/de/#a", "small"),
    (5, "no address", "small"),
    (6, "://", None),
    (7, "", ""),
    (8, "http://u@host.net:80/", "\u00e9" * 500),
    (9, "http://w.net", "\u00e9" * 500),
    (9, "http://w.net", "\u00e9" * 500),
    (10, "x://example.net/en/://other.org/fr/", "WARC/1.1\r\n\r\nWARC-Type: revisit\r\n\r\n" * 50),
]


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(*p, "z", "z") for p in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, key string, rule string").repartition(3)


def test_archive(spark, pages, tmp_path):
    warc.write(pages, str(tmp_path / "a"))
    rows = warc.read(spark, str(tmp_path / "a")).collect()
    assert Counter((r.page_id, bytes(r.payload)) for r in rows) == Counter(
        (i, (h or "").encode()) for i, _, h in PAGES
    )
    tops = defaultdict(int)
    for i, _, h in PAGES:
        tops[h] = max(tops[h], i or 0)
    for r in rows:
        html = bytes(r.payload).decode()
        revisit = len(r.payload) >= 1000 and r.page_id != tops[html]
        assert r.record_type == ("revisit" if revisit else "response")
        assert r.refers_to == (tops[html] if revisit else None)
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        assert rest == (b"" if revisit else bytes(r.payload)) + b"\r\n\r\n"
        assert head.startswith(b"WARC/1.1\r\nWARC-Type: ") and head.count(b"WARC-Type") == 1
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == len({h or "" for _, _, h in PAGES})
    warc.write(pages.where("false"), str(tmp_path / "b"))
    assert warc.read(spark, str(tmp_path / "b")).count() == 0


def test_a_damaged_payload_is_noticed(spark, pages, tmp_path):
    warc.write(pages, str(tmp_path / "a"))
    stored = spark.read.parquet(str(tmp_path / "a/payloads"))
    stored.selectExpr("key", "encode('other', 'UTF-8') AS payload").write.parquet(str(tmp_path / "b/payloads"))
    spark.read.parquet(str(tmp_path / "a/headers")).write.parquet(str(tmp_path / "b/headers"))
    with pytest.raises(Exception, match="does not have the key"):
        warc.read(spark, str(tmp_path / "b")).collect()


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@pytest.mark.parametrize("max_bytes", [urls.MAX_BYTES, 40])
def test_urls(spark, pages, max_bytes):
    rules = spark.createDataFrame([*RULES, RULES[0]], "host string, path string, verdict string")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages, rules, max_bytes).collect()}
    assert got == {
        (1, "a.example.net", "/en/x", "example.net/en/", "allow"),
        (2, "b.org", "/fr/", "org/fr/", "allow"),
        (3, "", "", None, "block"),
        (None, "c.com", "/\r\nX: y", None, "allow"),
        (4, "example.com", "/de/", "example.com/de/", "block"),
        (5, "", "", None, "block"),
        (6, "", "", None, "block"),
        (7, "", "", None, "block"),
        (8, "u@host.net:80", "/", None, "allow"),
        (9, "w.net", "", None, "allow"),
        (10, "example.net", "/en/://other.org/fr/", "example.net/en/", "allow"),
    }
    assert urls.judge(pages.where("false"), rules).count() == 0
    assert urls.judge(pages, rules.where("false")).where("rule IS NOT NULL").count() == 0


def test_colliding_keys(monkeypatch):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda *a, **k: 7)
    index = urls.DigestArray(urls.DigestArray.pack([(h, p, v == "block") for h, p, v in RULES]))
    assert index.find([b"x.example.net", b"y.com"], [b"/en/a", b"/de/"]) == [(b"example.net/en/", 11, False), None]


def test_keys_are_those_of_spark(spark):
    assert spark.sql("SELECT xxhash64('net/') AS h").first().h % 2**64 == xxhash.xxh64_intdigest(b"net/", urls.SEED)


def test_shards(spark, documents, texts, empty):
    more = spark.createDataFrame([(100 + i, prose(i, 20)) for i in range(300)] + [(1000, "same text " * 10)] * 100, "doc_id long, text string")
    frame = documents.select("doc_id", "text").unionByName(more)
    limit = 2000
    rows = sharding.shard(frame, limit).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in frame.collect())
    shards = defaultdict(list)
    for r in rows:
        assert len(r.prefix) == r.depth
        shards[r.prefix].append(r)
    for prefix, held in shards.items():
        size = sum(r.bytes for r in held)
        assert all((r.shard_bytes, r.shard_docs) == (size, len(held)) for r in held)
        assert size <= limit or len(held) == 1
        others = [p for p in shards if p != prefix]
        assert not any(p.startswith(prefix) for p in others)
        if prefix:  # its parent did not fit
            parent = [r for p, x in shards.items() if p.startswith(prefix[:-1]) for r in x]
            assert sum(r.bytes for r in parent) > limit and len(parent) > 1
    assert sharding.shard(empty, limit).count() == 0


def test_written_shards(spark, documents, texts, tmp_path):
    sharding.write(documents, str(tmp_path / "s"), 50_000)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert sorted(back.columns) == sorted([*documents.columns, "_shard"])
    assert Counter(map(tuple, back.select("doc_id", "text", "rk").collect())) == Counter((i, t, "x") for i, t in texts)
    sizes = back.groupBy("_shard").agg({"text": "count", "n_chars": "sum"}).collect()
    assert len(sizes) > 1


@pytest.mark.parametrize("window", [64, 2048])
def test_packing(documents, texts, empty, window):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.vocabulary_path())
    rows = packing.pack(documents, window=window).collect()
    pieces = defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length
        pieces[(r.doc_id, r.doc_tokens)].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    want = defaultdict(list)
    for i, t in texts:
        want[i].append([*own.encode(t or "", add_special_tokens=False).ids, 1])
    have = Counter()
    for (i, n), parts in pieces.items():
        same = [w for w in want[i] if len(w) == n]
        for start, ids in parts:
            assert any(w[start : start + len(ids)] == ids for w in same)
            have[i] += len(ids)
    assert have == Counter({i: sum(map(len, ws)) for i, ws in want.items()})
    _check_sequences(rows, window)
    assert packing.pack(empty, window=window).count() == 0


def _check_sequences(rows, window):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    short = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
        short += at < window
    assert short <= 1 and sorted(sequences) == list(range(len(sequences)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=64, max_size=64), st.integers(0, 3))
def test_every_remainder_has_a_place(counts, full):
    histogram = np.array(counts)
    plan = packing.make_plan(histogram, full)
    used = defaultdict(list)
    for length in range(1, 64):
        for rank in range(histogram[length]):
            parts = packing.places(plan, length, rank)
            assert sum(p[1] for p in parts) == length
            for _, size, sequence, offset in parts:
                used[sequence].append((offset, size))
    ends = []
    for parts in used.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        ends.append(at)
    assert sorted(used) == list(range(full, plan.total)) and sum(e < 64 for e in ends) <= 1


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_both_encoders_agree(text):
    from tokenizers import Tokenizer

    path = packing.vocabulary_path()
    assert packing._encoder(path)([text])[0] == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
