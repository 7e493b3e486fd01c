import pytest
from pyspark.sql import functions as F

from lakeweave.operators import profile, registry, tasks
from lakeweave.sources import files, folder


def test_csv_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,name\n1,Zoë\n2,x\n".encode("utf-8-sig"))
    (tmp_path / "b.csv").write_bytes("id,name\n1,Zoë\n".encode("latin-1"))
    a, b = (files.read_table(spark, str(tmp_path / n)) for n in ("a.csv", "b.csv"))
    assert a.columns == ["id", "name"] and a.dtypes[0][1] == "bigint"
    assert [r.name for r in a.orderBy("id").collect()] == ["Zoë", "x"]
    assert [r.name for r in b.collect()] == ["Zoë"]


def test_schema_catalog(spark, tmp_path):
    (tmp_path / "s.csv").write_text(
        "TableName,TableDesc,ColumnName,ColumnType,ColumnDesc,IsPK,IsFK\n"
        "t1, first ,id ,INT,key,yes,NO\nt1,second,name,, ,NO,YES\n,,x,int,,NO,NO\nt2,,v,Float,,NO,NO\n"
    )
    got = {r.table_name: r for r in files.schema_catalog(spark, str(tmp_path / "s.csv")).collect()}
    assert set(got) == {"t1", "t2"} and got["t1"].table_desc == "first"
    first, second = got["t1"].columns
    assert (first.ordinal, first.name, first.type, first.description, first.is_pk) == (0, "id", "int", "key", True)
    assert (second.ordinal, second.type, second.description, second.is_fk) == (1, "str", None, True)


def test_bulk_ingest_counts_bad_files_and_skips_known(spark, tmp_path):
    (tmp_path / "good.csv").write_text("id,v,flag,w\n1,2.5,true,\n2,,false,7\n")
    (tmp_path / "latin.csv").write_bytes("id,n\n1,é\n".encode("latin-1"))
    (tmp_path / "empty.csv").write_text("\n")
    (tmp_path / "zero.csv").write_text("")
    (tmp_path / "quoted.csv").write_text('id,"a ""b"" c"\n1,"two\nlines, one ""cell"""\n2,plain\n')
    (tmp_path / "header.csv").write_text("a,b\n")
    spark.range(3).selectExpr("id", "timestamp_seconds(id) AS t").toPandas().to_parquet(tmp_path / "p.parquet")
    now = F.current_timestamp()
    tables, columns, cells = files.bulk_ingest(spark, str(tmp_path), "x", now)
    status = {r.table_name: (r.status, r.row_count, r.col_count) for r in tables.collect()}
    assert status == {
        "good": ("INGESTED", 2, 4),
        "latin": ("INGESTED", 1, 2),
        "empty": ("FAILED", 0, 0),
        "header": ("FAILED", 0, 0),
        "zero": ("FAILED", 0, 0),
        "quoted": ("INGESTED", 2, 2),
        "p": ("INGESTED", 3, 2),
    }
    got = {r.col_name: r for r in profile.column_profiles(columns, cells, 3).collect()}
    assert {n: got[n].col_type for n in ("v", "flag", "w", "n", "t")} == {
        "v": "float", "flag": "bool", "w": "int", "n": "str", "t": "date"}
    assert set(got['a "b" c'].sample_values) == {'two\nlines, one "cell"', "plain"}
    assert got["w"].null_ratio == 0.5 and got["w"].numeric_stats.mean == 7.0
    assert got["t"].numeric_stats.mean == 1.0
    assert got["flag"].sample_values == ["true", "false"] or set(got["flag"].sample_values) == {"true", "false"}
    again, _, _ = files.bulk_ingest(spark, str(tmp_path), "x", now, known=tables)
    assert again.isEmpty()


def test_no_cell_of_a_csv_file_is_lost(spark, tmp_path):
    """Headers over several lines are whole; rows with more cells than the header fail their file, with a count."""
    texts = {
        "lines": '"first\nname",b\n1,2\n3,"4\n5"\n',
        "more": "a,b\n1,2\n1,2,3\n4,5,6,7\n",
        "more_empty": "a,b\n1,2,,\n",
        "quoted": 'a,b\n"1,2,3","x ""y"", z"\n"4,5",6\n',
        "less": "a,b,c\n1,2\n3\n4,5,6\n",
        "trail": 'a,"b\nb",c\n"1\n,,",2,3,4\n',
        "same": '"a\n",a,x\n1,2,3\n',
        "latin": "é,b\n1,2\n",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode("latin-1" if name == "latin" else "utf-8-sig"))
    tables, columns, cells = files.bulk_ingest(spark, str(tmp_path), "x", F.current_timestamp())
    rows = {r.table_name: r for r in tables.collect()}
    errors = {n: r.error for n, r in rows.items() if r.status == "FAILED"}
    assert errors == {
        "more": "2 rows have more cells than the header",
        "more_empty": "1 rows have more cells than the header",
        "trail": "1 rows have more cells than the header",
    }
    named = {r.table_name: r.table_id for r in rows.values()}
    found = {}
    for r in columns.orderBy("ordinal").collect():
        found.setdefault(r.table_id, []).append(r.col_name)
    assert found[named["lines"]] == ["first\nname", "b"]
    assert found[named["same"]] == ["a", "a.1", "x"]
    assert found[named["latin"]] == ["é", "b"]
    assert named["more"] not in found
    counts = {n: (r.row_count, r.col_count) for n, r in rows.items()}
    assert counts["lines"] == (2, 2) and counts["quoted"] == (2, 2) and counts["less"] == (3, 3)
    values = {(r.table_id, r.ordinal, r.value) for r in cells.text.collect()}
    assert (named["quoted"], 0, "1,2,3") in values and (named["quoted"], 1, 'x "y", z') in values
    assert (named["lines"], 1, "4\n5") in values
    with pytest.raises(ValueError, match="2 rows"):
        files.read_table(spark, str(tmp_path / "more.csv"))
    assert files.read_table(spark, str(tmp_path / "lines.csv")).columns == ["first\nname", "b"]
    assert files.read_table(spark, str(tmp_path / "less.csv")).orderBy("a").collect()[1].c is None


def test_headers_over_several_lines_are_read_once_per_kind(spark, tmp_path, monkeypatch):
    """Not a job per file; line ends, quotes and encodings keep headers apart."""
    kinds = {
        "lf": (b'"k\ney",v\n', ["k\ney", "v"]),
        "crlf": (b'"k\r\ney",v\r\n', ["k\ney", "v"]),
        "more": (b'"k\ney",v,\n', ["k\ney", "v", ""]),
        "one": (b'"k\ney"\n', ["k\ney"]),
        "latin": ('"k\n\xe9",v\n'.encode("latin-1"), ["k\n\xe9", "v"]),
        "utf8": ('"k\n\xe9",v\n'.encode(), ["k\n\xe9", "v"]),
    }
    for name, (head, _) in kinds.items():
        for i in range(4):
            (tmp_path / f"{name}_{i}.csv").write_bytes(head + f"{i},\n".encode())
    asked, plain = [], folder.header_names
    monkeypatch.setattr(folder, "header_names", lambda spark, file: asked.append(file["path"]) or plain(spark, file))
    tables, columns, _ = files.bulk_ingest(spark, str(tmp_path), "x", F.current_timestamp())
    assert len(asked) == len(kinds)
    found = {r.table_name: [] for r in tables.collect()}
    names = {r.table_id: r.table_name for r in tables.collect()}
    for r in columns.orderBy("ordinal").collect():
        found[names[r.table_id]].append(r.col_name)
    # A comma after the last name of a row makes a longer row where there is one name.
    assert found == {f"{n}_{i}": [] if n == "one" else want for n, (_, want) in kinds.items() for i in range(4)}


def test_a_large_file_is_a_table(spark, tmp_path):
    """Twenty megabytes, and the same types as a small file has."""
    line = "2024-01-01," + "x" * 90 + "\n"
    (tmp_path / "large.csv").write_text("day,v\n" + line * 200_000)
    (tmp_path / "small.csv").write_text("day,v\n" + line)
    tables, columns, _ = files.bulk_ingest(spark, str(tmp_path), "x", F.current_timestamp())
    assert {(r.table_name, r.status, r.row_count) for r in tables.collect()} == {
        ("large", "INGESTED", 200_000), ("small", "INGESTED", 1)}
    assert {(r.col_name, r.col_type) for r in columns.collect()} == {("day", "str"), ("v", "str")}


def test_lines_identify_a_file_beyond_one_value(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folder, "WHOLE_FILE", 10)
    for name, text in (("a.csv", "id\n1\n2\n" * 5), ("b.csv", "id\n1\n2\n" * 5), ("c.csv", "id\n1\n3\n" * 5)):
        (tmp_path / name).write_text(text)
    got = {r.path.rsplit("/", 1)[-1]: r.content_hash for r in files.file_hashes(spark, str(tmp_path)).collect()}
    assert len(got) == 3 and got["a.csv"] == got["b.csv"] != got["c.csv"]


def test_parquet_footers_are_read_without_the_content(spark, tmp_path):
    import pandas as pd

    times = pd.to_datetime(["2024-01-01", "2024-01-02"]).astype("datetime64[ns]")
    pd.DataFrame({"id": [1, 2], "t": times}).to_parquet(tmp_path / "p.parquet")
    (tmp_path / "broken.parquet").write_bytes(b"PAR1 no footer")
    (tmp_path / "short.parquet").write_bytes(b"PA")
    (tmp_path / "thrift.parquet").write_bytes(b"PAR1" + b"\xff" * 50 + (50).to_bytes(4, "little") + b"PAR1")
    listed = folder.listing(spark, str(tmp_path))
    limit = "spark.sql.sources.binaryFile.maxLength"
    spark.conf.set(limit, "1")  # as files of more than 2 GB: their content is no single value
    try:
        columns, cells, errors = folder.read_folder(listed)
        got = {(r.col_name, r.col_type) for r in columns.collect()}
    finally:
        spark.conf.unset(limit)
    assert got == {("id", "int"), ("t", "date")}
    failed = {r.path.rsplit("/", 1)[-1] for r in errors.collect()}
    assert failed == {"broken.parquet", "short.parquet", "thrift.parquet"}


def test_other_errors_are_not_the_files(spark, tmp_path):
    spark.range(3).toPandas().to_parquet(tmp_path / "p.parquet")
    listed = spark.createDataFrame([(f"file:{tmp_path}/gone.parquet", 10)], folder.LISTING)
    with pytest.raises(Exception, match="gone.parquet"):
        folder.read_folder(listed)


def test_large_files_keep_order_and_line_ends(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(folder, "WHOLE_FILE", 10)
    body = [f"{i},x{i}" for i in range(5000)]
    texts = {
        "a.csv": "\n".join(body) + "\n", "copy.csv": "\n".join(body) + "\n", "turned.csv": "\n".join(body[::-1]) + "\n",
        "returns.csv": "\r\n".join(body) + "\r\n", "mixed.csv": "\r".join(body[:2]) + "\n" + "\n".join(body[2:]) + "\n",
        "open.csv": "\n".join(body), "blank.csv": "\n".join(body) + "\n\n",
    }
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())

    def hashes():
        return {r.path.rsplit("/", 1)[-1]: r.content_hash for r in files.file_hashes(spark, str(tmp_path)).collect()}

    once = hashes()
    assert once["a.csv"] == once["copy.csv"] and len(set(once.values())) == len(texts) - 1
    size = "spark.sql.files.maxPartitionBytes"
    for splits in ("1k", "10m"):
        spark.conf.set(size, splits)
        try:
            assert hashes() == once
        finally:
            spark.conf.unset(size)


def test_file_hashes(spark, tmp_path):
    import hashlib

    (tmp_path / "a.csv").write_text("id\n1\n")
    got = files.file_hashes(spark, str(tmp_path)).first()
    assert got.content_hash == hashlib.sha256(b"id\n1\n").hexdigest()[:16]


def test_ingest_rejects_copies_per_tenant(spark):
    rows = [("t", "a", "h1", 1), ("t", "a", "h1", 2), ("t", "b", "h1", 3), ("u", "a", "h1", 4), ("t", "c", "h2", 5)]
    uploads = spark.createDataFrame(rows, "tenant_id string, table_name string, content_hash string, seq int").withColumn(
        "uploaded_at", F.timestamp_seconds("seq"))
    got = {r.seq: r for r in registry.ingest(uploads).collect()}
    assert [got[i].status for i in range(1, 6)] == ["INGESTED", "REJECTED", "REJECTED", "INGESTED", "INGESTED"]
    assert got[3].table_id == got[1].table_id != got[4].table_id
    archived = registry.new_rows(registry.ingest(uploads)).withColumn("status", F.lit("ARCHIVED"))
    assert registry.ingest(uploads, archived).filter("status = 'INGESTED'").isEmpty()


def test_graph_keeps_the_last_role(spark):
    made = spark.createDataFrame([(1, "INTEGRATE", "q", "t")], "task_id int, task_type string, query_table_id string, target_table_id string")
    ranking = spark.createDataFrame([(1, 1, "t", 0.91234, '{"s1":0.8}')], "task_id int, rank int, candidate_table string, score double, layer_scores string")
    maps = spark.createDataFrame(
        [(1, 1, "c1", "c2", 0.88, True, "SMD", "r"), (1, 2, "c2", "c3", 0.5, False, "SMD", None)],
        "task_id int, mapping_id int, src_column_id string, tgt_column_id string, confidence double, is_matched boolean, scenario string, reasoning string")
    nodes = {r.id: (r.kind, r.status) for r in tasks.graph_nodes(made, ranking, maps).collect()}
    assert nodes["table:q"] == ("query_table", "normal") and nodes["table:t"] == ("candidate_table", "normal")
    assert nodes["column:c1"] == ("source_column", "matched") and nodes["column:c2"] == ("source_column", "normal")
    edges = {r.id: r for r in tasks.graph_edges(made, ranking, maps).collect()}
    assert edges["discovery:q:t"].label == "#1 0.912" and edges["discovery:q:t"].metrics == {"s1": 0.8}
    assert edges["mapping:1"].label == "0.880"
