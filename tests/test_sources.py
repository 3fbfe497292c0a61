import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tessel.sources import catalogue, jsonl
from tessel.streaming.ingest import ingest, windowed_counts

SOURCE = "[[sources]]\n" + "\n".join(f'{c} = "{c}-x"' for c in catalogue.REQUIRED)


def test_catalogue(spark, tmp_path):
    (tmp_path / "a.toml").write_text(SOURCE)
    df = catalogue.catalogue(spark, [tmp_path / "a.toml"])
    assert df.first()["download_mode"] == "auto" and df.columns[0] == "doc_id"
    with pytest.raises(ValueError, match="more than once: doc_id-x"):
        catalogue.catalogue(spark, [tmp_path / "a.toml"] * 2)
    (tmp_path / "b.toml").write_text("")
    with pytest.raises(ValueError, match="no sources"):
        catalogue.catalogue(spark, [tmp_path / "b.toml"])
    (tmp_path / "c.toml").write_text('[[sources]]\ntitle = "x"')
    with pytest.raises(KeyError):
        catalogue.load(tmp_path / "c.toml")


def test_line_numbers_and_errors(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text("".join(json.dumps({"id": i}) + "\n\n" for i in range(50)))
    rows = jsonl.parse_lines(jsonl.read_lines(spark, str(path)), "id int").collect()
    assert sorted((r["line_no"], r["id"]) for r in rows) == [(2 * i + 1, i) for i in range(50)]
    assert jsonl.read_jsonl(spark, str(path), "id int").count() == 50
    path.write_text('{"id": 1}\n[2]\n')
    with pytest.raises(Exception, match="a.jsonl:2"):
        jsonl.parse_lines(jsonl.read_lines(spark, str(path)), "id int").collect()


def test_titles_in_order_of_sight(spark, tmp_path):
    (tmp_path / "t").write_text('B - x\n{"title": "A - y"}\nB - x\n')
    found = jsonl.discovered([jsonl.titles(jsonl.read_lines(spark, str(tmp_path / "t")))] * 2).orderBy("at").collect()
    assert [r["title"] for r in found] == ["B - x", "A - y"]


def test_sorted_json_and_manifest(spark, tmp_path):
    jsonl.write_jsonl(spark.createDataFrame([("é", None, 1)], "b string, c string, a int").coalesce(1), str(tmp_path / "out"))
    line = next(p for p in (tmp_path / "out").glob("part-*")).read_text()
    assert line == '{"a":1,"b":"é","c":null}\n'
    files = jsonl.manifest(spark, f"{tmp_path}/out/part-*").collect()
    assert files[0]["sha256"] == hashlib.sha256(line.encode()).hexdigest() and files[0]["bytes"] == len(line.encode())


def test_append_only_what_is_missing(spark, tmp_path):
    path, rows = str(tmp_path / "t"), lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    assert [jsonl.append_missing(rows(*ids), spark, path, "id") for ids in ((1, 2, 2), (2, 3), (1,))] == [2, 1, 0]


def test_stream_takes_each_file_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    where = [str(tmp_path / x) for x in ("in", "table", "checkpoint")]
    for i, lines in enumerate(('{"id": 1}\n{"id": 2}\n', '{"id": 3}\n')):
        (tmp_path / "in" / f"{i}.json").write_text(lines)
        for _ in range(2):
            ingest(spark, where[0], "id int", where[1], where[2], "id").awaitTermination(60)
    assert sorted(r["id"] for r in spark.read.parquet(where[1]).collect()) == [1, 2, 3]


def test_windowed_counts_agree_in_batch_and_stream(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch = windowed_counts(events, "ts", "event_type")
    assert batch.agg(F.sum("n")).first()[0] == events.count()
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet("/root/testdata/sf0.001")
    query = windowed_counts(stream, "ts", "event_type", delay="3650 days").writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, batch.collect()))
