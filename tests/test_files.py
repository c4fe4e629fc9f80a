import glob
import gzip
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tabloom.functions.literals import quote_ident
from tabloom.model import ColumnMeta, TableMeta, detect_format
from tabloom.plans import imports as im
from tabloom.sinks import files as out, load as ld
from tabloom.sources import files as src, records


def put(tmp_path, name, data):
    path = tmp_path / name
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def cells(df):
    return [tuple(r) for r in df.collect()]


def text_of(path):
    return "".join(open(p, encoding="utf-8", newline="").read() for p in sorted(glob.glob(f"{path}/part-*")))


@pytest.fixture()
def sample(spark):
    return spark.createDataFrame(
        [(1, 'Ada, "the first"', "12.50", True, b"\x00\xff", None), (9007199254740993, "Bob\nNewline", "0.10", False, b"\x01\x02\x03", "x" * 10)],
        "id long, name string, price string, ok boolean, blob binary, note string").coalesce(1)


def test_csv_detects_delimiter_and_repairs_header(spark, tmp_path):
    path = put(tmp_path, "a.csv", b"\xef\xbb\xbfid;name;name;\n1;\"a;b\";\"say \"\"hi\"\"\";x\n2;\"two\nlines\"\n3;c;d;e;extra\n")
    df = src.read_delimited(spark, path, multiline=True)
    assert df.columns == ["id", "name", "name (2)", "Column 4"]
    assert cells(df) == [("1", "a;b", 'say "hi"', "x"), ("2", "two\nlines", None, None), ("3", "c", "d", "e")]


def test_csv_without_header_keeps_empty_text(spark, tmp_path):
    df = src.read_delimited(spark, put(tmp_path, "b.csv", "1,,\"\"\n2,x,y\n"), header=False)
    assert df.columns == ["Column 1", "Column 2", "Column 3"] and cells(df) == [("1", "", ""), ("2", "x", "y")]


@pytest.mark.parametrize("line,want", [("a,b;c;d", ";"), ('"x;y;z",b', ","), ("a\tb", "\t"), ("a|b|c,d", "|"), ("a,b;c", ","), ("abc", ",")])
def test_delimiter(line, want):
    assert src.detect_delimiter(line + "\nq;q;q;q;q") == want


def test_empty_file(spark, tmp_path):
    assert src.read_delimited(spark, put(tmp_path, "e.csv", "")).columns == []


def test_quoted_ends(spark):
    """Both states' ends against a plain walk; a line is split once, however many quotes it has."""
    def plain(line, sep, q):
        line, i, opening = line.removesuffix("\r"), 0, True
        while i < len(line):
            if line[i] == '"' and q:
                if line[i + 1:i + 2] == '"':
                    i += 1
                elif i + 1 == len(line) or line[i + 1] == sep:
                    q = False
            elif line[i] == '"' and opening:
                q = True
            i += 1
            opening = line[i - 1] == sep
        return q

    rng = random.Random(5)
    lines = ["".join(rng.choices('"";ab\r', k=rng.randrange(0, 12))).rstrip("\r") + rng.choice(["", "\r"]) for _ in range(3000)]
    ends = records.ends_quoted(F.col("value"), ";")
    got = spark.createDataFrame([(x,) for x in lines], "value string").select("value", ends.alias("e")).collect()
    for r in got:
        assert (r.e.from_out, r.e.from_in) == (plain(r.value, ";", False), plain(r.value, ";", True)), r.value
    assert str(ends).count("split(") == 1


def test_gzip_files_without_rows_come_first(spark, tmp_path):
    """A task without rows leaves a file that is empty, but not of length 0."""
    put(tmp_path, "part-0.csv.gz", gzip.compress(b""))
    put(tmp_path, "part-1.csv.gz", gzip.compress(b""))
    put(tmp_path, "part-2.csv.gz", gzip.compress(b"a|b\n1|2\n"))
    found = src.read_delimited(spark, str(tmp_path))
    assert found.columns == ["a", "b"] and cells(found) == [("1", "2")]
    assert src.first_bytes(spark, put(tmp_path, "none.gz", gzip.compress(b""))) == b""


def test_gzip(spark, tmp_path):
    path = put(tmp_path, "z.csv.gz", gzip.compress(b"a|b\n1|2\n"))
    assert cells(src.read_delimited(spark, path)) == [("1", "2")]
    assert detect_format("x.JSONL.gz") == "ndjson" and detect_format("x.txt") == "tsv" and detect_format("x") == "csv"


def test_tsv(spark, tmp_path):
    df = src.read_tsv(spark, put(tmp_path, "a.tsv", "id\tnote\r\n1\ttab\\there\r\n2\tback\\\\slash\\n\t\n3\n1\tid\tnote\n"))
    assert df.columns == ["id", "note"]
    assert cells(df) == [("1", "tab\there"), ("2", "back\\slash\n"), ("3", None), ("1", "id")]


def test_json_array_order_and_late_fields(spark, tmp_path):
    records = [{"b": 1, "a": {"x": [1, 2]}}, {"c": "t", "b": None}] + [{"b": i} for i in range(600)] + [{"late": 1, "b": 7}]
    df = src.read_json_array(spark, put(tmp_path, "a.json", json.dumps(records)))
    assert df.columns == ["b", "a", "c", "late"] and df.count() == 603 and df.where("late = '1'").count() == 1
    assert cells(df)[:2] == [("1", '{"x":[1,2]}', None, None), (None, None, "t", None)]
    assert src.read_json_array(spark, str(tmp_path / "a.json"), sample=500).columns == ["b", "a", "c"]
    with pytest.raises(ValueError, match="array of objects"):
        src.read_json_array(spark, put(tmp_path, "bad.json", '{"a":1}'))


def test_ndjson(spark, tmp_path):
    df = src.read_ndjson(spark, put(tmp_path, "a.ndjson", '{"z":1,"a":true}\n\n  \n{"a":false,"y":12345678901234567890.5}\n'))
    assert df.columns == ["z", "a", "y"]
    assert cells(df) == [("1", "true", None), (None, "false", "12345678901234567890.5")]
    late = put(tmp_path, "late.ndjson", "".join('{"a":%d}\n' % i for i in range(549)) + '{"late":1}\n' * 51)
    assert src.read_ndjson(spark, late).columns == ["a", "late"] and src.read_ndjson(spark, late, sample=500).columns == ["a"]


def test_blank_cells(spark, tmp_path):
    """Rows of blanks are rows, and an only column keeps its empty cells."""
    df = spark.createDataFrame([(" ", " "), ("", ""), ("x", "y"), ("a", "b")], "a string, b string").coalesce(1)
    out.write_tsv(df, str(tmp_path / "t"))
    # The last row reads like the header and is still a row.
    assert sorted(cells(src.read_tsv(spark, str(tmp_path / "t")))) == sorted(tuple(r) for r in df.collect())
    one = spark.createDataFrame([("x",), ("",), (None,), ("y",)], "a string").coalesce(1)
    out.write_delimited(one, str(tmp_path / "c"))
    assert sorted(cells(src.read_delimited(spark, str(tmp_path / "c")))) == [("",), ("",), ("x",), ("y",)]
    odd = spark.createDataFrame([("\u00a0x", "\u2003y")], "a string, b string")
    assert out.csv_lines(odd).first().value == '"\u00a0x","\u2003y"'


def test_replace_never_shows_an_empty_table(spark, tmp_path, monkeypatch):
    from tabloom.sinks import load
    target = str(tmp_path / "table")
    load.load(spark.range(3), target, "replace")

    def broken(*args):
        raise OSError("lost")

    monkeypatch.setattr(load, "rename", broken)
    with pytest.raises(OSError, match="lost"):
        load.load(spark.range(5), target, "replace")
    assert load.read_loaded(spark, target).count() == 3
    assert [n for n in os.listdir(target) if n.startswith("_staging")] == []
    monkeypatch.undo()
    assert load.load(spark.range(5), target, "replace").count() == 5 and load.load(spark.range(2), target).count() == 7


def test_csv_bytes(sample, tmp_path):
    out.write_delimited(sample, str(tmp_path / "o"), null_text="\\N")
    want = ('id,name,price,ok,blob,note\n1,"Ada, ""the first""",12.50,true,0x00FF,\\N\n'
            '9007199254740993,"Bob\nNewline",0.10,false,0x010203,xxxxxxxxxx\n')
    assert text_of(tmp_path / "o") == want
    out.write_delimited(sample, str(tmp_path / "p"), ";", header=False, bom=True)
    assert text_of(tmp_path / "p").startswith("﻿1;")
    with pytest.raises(ValueError, match="single character"):
        out.write_delimited(sample, str(tmp_path / "q"), '"')


def test_tsv_and_json_bytes(sample, tmp_path):
    out.write_tsv(sample, str(tmp_path / "t"))
    assert "Bob\\nNewline" in text_of(tmp_path / "t")
    out.write_json_array(sample, str(tmp_path / "j"), single_file=True)
    parsed = json.loads(text_of(tmp_path / "j"))
    assert list(parsed[0]) == ["id", "name", "price", "ok", "blob", "note"]
    assert parsed[0]["blob"] == "0x00FF" and parsed[0]["note"] is None and parsed[1]["id"] == 9007199254740993
    out.write_json_array(sample.limit(0).coalesce(1), str(tmp_path / "k"), single_file=True)
    assert json.loads(text_of(tmp_path / "k")) == []
    out.write_ndjson(sample, str(tmp_path / "n"))
    assert text_of(tmp_path / "n").count("\n") == 2


def test_documents_keep_extended_types(spark, tmp_path):
    df = spark.createDataFrame([('{"$oid":"65f0c0ffee00000000000001"}', None, '{"extra":{"$date":"2024-01-01T00:00:00Z"}}', b"\x01")],
                               "_id string, n long, `…` string, raw binary")
    line = out.doc_lines(df, ["_id"]).first().value
    assert json.loads(line) == {"_id": {"$oid": "65f0c0ffee00000000000001"}, "extra": {"$date": "2024-01-01T00:00:00Z"},
                                "raw": {"$binary": {"base64": "AQ==", "subType": "00"}}}


@pytest.mark.parametrize("dialect,want", [
    ("mysql", ["INSERT INTO `t` (", "(1, 'Ada, \"the first\"', 12.50, TRUE, X'00FF', NULL)", "'Bob\\nNewline'"]),
    ("postgresql", ['INSERT INTO "t" (', "'\\x00FF'::bytea", "TRUE", "'Bob\nNewline'"]),
    ("mssql", ["N'Ada, \"the first\"'", "0x00FF", ", 1, "]), ("oracle", ["HEXTORAW('00FF')", 'INSERT INTO "t"']),
    ("sqlite", ["X'00FF'", ", 1, "]), ("bigquery", ["FROM_BASE64('AP8=')", "TRUE"]),
])
def test_inserts(sample, dialect, want):
    got = "\n".join(r.value for r in out.insert_statements(sample, dialect, "t", kinds={"price": "decimal"}).collect())
    assert all(w in got for w in want), got
    assert got.count("INSERT INTO") == (2 if dialect == "oracle" else 1)


def test_insert_batches(spark):
    rows = out.insert_statements(spark.range(0, 250, 1, 1), "mssql", "dbo.t", 100).collect()
    assert [r.value.count("\n  (") for r in rows] == [100, 100, 50] and rows[0].value.endswith(";")
    assert rows[0].value.startswith("INSERT INTO [dbo].[t] ([id]) VALUES\n  (0),\n  (1)")
    assert quote_ident("mysql", "a`b") == "`a``b`"


META = TableMeta("t", (ColumnMeta("id", "int"), ColumnMeta("ok", "bool"), ColumnMeta("when", "datetime"), ColumnMeta("sum", "int", generated="id*2")))


def test_import(spark, tmp_path):
    path = put(tmp_path, "i.csv", "ID,OK?,When\n1, yes ,2024-02-29 10:00\n,,\n2,0,2024-02-29T10:00:00.5Z\n")
    df = src.read_delimited(spark, path, multiline=False, position=True)
    mapping = im.auto_map(["ID", "OK?", "When"], ["id", "ok", "when"])
    assert mapping == {"ID": "id", "OK?": "ok", "When": "when"}
    rows = im.import_rows(df, mapping, META).collect()
    assert [(r.id, r.ok, str(r.when)) for r in rows] == [(1, True, "2024-02-29 10:00:00"), (2, False, "2024-02-29 10:00:00.500000")]


def test_import_names_record_and_column(spark, tmp_path):
    lines = [f"{i},{'maybe' if i in (700, 900) else 'no'}" for i in range(1, 1000)]
    df = src.read_delimited(spark, put(tmp_path, "b.csv", "id,ok\n" + "\n".join(lines) + "\n"), multiline=False, position=True)
    with pytest.raises(im.RecordError) as e:
        im.import_rows(df, {"id": "id", "ok": "ok"}, META)
    assert (e.value.record, e.value.column) == (700, "ok") and "as true or false" in e.value.reason


@pytest.mark.parametrize("mapping,message", [
    ({"x": "id"}, "among the file's columns"), ({"id": "nope"}, "among the table's columns"), ({"id": "id", "ok": "id"}, "two file columns"),
    ({"id": ""}, "no file column goes"), ({"id": "sum"}, "from an expression"),
])
def test_mapping_checks(mapping, message):
    with pytest.raises(ValueError, match=message):
        im.check_mapping(["id", "ok"], mapping, META)


def test_load_is_all_or_nothing(spark, tmp_path):
    target = str(tmp_path / "t")
    good = spark.range(10)
    assert ld.load(good, target).count() == 10
    bad = good.select(F.when(F.col("id") == 5, F.raise_error(F.lit("bad row")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="bad row"):
        ld.load(bad, target)
    assert ld.read_loaded(spark, target).count() == 10
    assert ld.load(spark.range(3), target).count() == 13 and ld.load(spark.range(4), target, "replace").count() == 4


def test_chunks_before_a_failure_stay(spark, tmp_path):
    rows = spark.range(0, 100, 1, 1)

    def broken(df):
        return df.select(F.when(F.col("id") == 65, F.raise_error(F.lit("bad row")).cast("long")).otherwise(F.col("id")).alias("id"))

    report = ld.load_chunked(rows, str(tmp_path / "c"), broken, commit_every=20)
    assert "bad row" in report.failed or report.failed
    assert report.rows % 20 == 0 and report.rows < 100 and report.committed == report.rows // 20
    whole = ld.load_chunked(rows, str(tmp_path / "d"), commit_every=20)
    assert (whole.committed, whole.rows, whole.failed) == (5, 100, "")


def test_two_writers(spark, tmp_path, monkeypatch):
    """Of two loads that began with one version, a replace is refused if it comes second, and appends both count."""
    target = str(tmp_path / "t")
    ld.load(spark.range(3), target)
    plain, met = ld._publish, []

    def late(spark_, root, version, held):
        # Another writer is quicker.
        if not met:
            met.append(version)
            ld.load(spark.range(100, 110), target, "replace" if mode == "replace" else "append")
        plain(spark_, root, version, held)

    for mode in ("append", "replace"):
        met.clear()
        monkeypatch.setattr(ld, "_publish", late)
        if mode == "append":
            assert ld.load(spark.range(5), target).count() == 3 + 10 + 5
        else:
            with pytest.raises(ld.LoadConflict):
                ld.load(spark.range(5), target, "replace")
            assert ld.read_loaded(spark, target).count() == 10
        monkeypatch.undo()
    assert len([n for n in os.listdir(target) if n.startswith("b=")]) == 4
    assert ld.versions(spark, target) == [1, 2, 3, 4] and ld.read_loaded(spark, target, version=2).count() == 13
    assert ld.forget_versions(spark, target) == 3 and ld.read_loaded(spark, target).count() == 10


def test_threads_that_load(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor
    target = str(tmp_path / "t")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: ld.load(spark.range(i * 10, i * 10 + 10), target), range(6)))
    assert sorted(r.id for r in ld.read_loaded(spark, target).collect()) == list(range(60))
    assert len(ld.versions(spark, target)) == 6


def test_names_are_given_once(spark, tmp_path):
    (tmp_path / "a").write_text("1")
    (tmp_path / "b").write_text("2")
    (tmp_path / "c").write_text("3")
    ld.rename(spark, str(tmp_path / "a"), str(tmp_path / "x"))
    with pytest.raises(FileExistsError):
        ld.rename(spark, str(tmp_path / "b"), str(tmp_path / "x"))
    assert (tmp_path / "x").read_text() == "1" and not (tmp_path / "a").exists() and (tmp_path / "b").exists()
