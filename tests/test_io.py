"""Readers, writers, configuration and the streaming variants."""

import json

import pytest
from pyspark.sql import functions as F

from colloquy.sources import config, io
from colloquy.streaming import incremental

SCHEMA = "id string, n int"


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json_array(spark, tmp_path):
    path = write(tmp_path / "a.json", json.dumps([{"id": "甲", "n": 1}, 7, {"id": "乙"}]))
    assert [tuple(r) for r in io.read_json_array(spark, path, SCHEMA).orderBy("source_index").collect()] == [(0, "甲", 1), (2, "乙", None)]
    with pytest.raises(Exception, match="no JSON array"):
        io.read_json_array(spark, write(tmp_path / "b.json", '{"id": 1}'), SCHEMA).collect()


def test_jsonl(spark, tmp_path):
    path = write(tmp_path / "a.jsonl", '{"id":"a","n":1}\n{"id":"b"\n{"id":"c","n":3}\n')
    assert io.read_jsonl(spark, path, SCHEMA, malformed="drop").count() == 2
    assert io.read_jsonl(spark, path, SCHEMA, malformed="drop", limit=1).count() == 1
    with pytest.raises(Exception):
        io.read_jsonl(spark, path, SCHEMA).collect()
    assert [r["line"] for r in io.bad_lines(spark, path, SCHEMA).collect()] == [2]
    gone = str(tmp_path / "none.jsonl")
    assert io.read_jsonl(spark, gone, SCHEMA, missing="empty").count() == 0
    with pytest.raises(Exception):
        io.read_jsonl(spark, gone, SCHEMA).count()


def test_roundtrip_and_fallback(spark, tmp_path):
    df = spark.createDataFrame([("甲", 1), ("乙", None)], SCHEMA)
    out = str(tmp_path / "out")
    io.write_jsonl(df, out)
    assert sorted(map(str, io.read_jsonl(spark, out, SCHEMA).collect())) == sorted(map(str, df.collect()))
    io.write_jsonl(df, out, mode="append")
    assert io.read_jsonl(spark, out, SCHEMA).count() == 4
    got = io.read_first_filled(spark, [str(tmp_path / "no"), out], SCHEMA)
    assert {r["input_source"] for r in got.collect()} == {out}
    assert io.read_first_filled(spark, [str(tmp_path / "no")], SCHEMA, df).count() == 2
    assert io.backup(spark, out) == out + ".backup" and io.backup(spark, str(tmp_path / "no")) is None
    assert io.read_jsonl(spark, out + ".backup", SCHEMA).count() == 4
    io.write_csv(df, str(tmp_path / "csv"), ["n", "id"])
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("part-*"))
    assert text.splitlines()[0] == "n,id" and ",乙" in text
    io.write_document(df.limit(1), str(tmp_path / "doc"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "doc").glob("part-*")))["id"] == "甲"
    io.write_text(spark.createDataFrame([("x",)], "value string"), str(tmp_path / "md"))
    assert io.megabytes(spark, str(tmp_path / "md")).first()[0] > 0
    assert {tuple(r) for r in io.manifest(spark, str(tmp_path), ["md", "zz"]).collect()} == {("md", True), ("zz", False)}


def test_config():
    text = "a: 1\nb:\n  c: true\n  d: [1, x]\n  e:\n    - one\n    - 2.5\nf: 'q # r'  # note\ng:\n"
    value = config.parse(text)
    assert value == {"a": 1, "b": {"c": True, "d": [1, "x"], "e": ["one", 2.5]}, "f": "q # r", "g": None}
    assert config.parse(config.dump(value)) == value
    assert config.layered({"a": 1, "b": {"c": 1, "d": 2}}, {"b": {"c": 3}, "a": None}) == {"a": 1, "b": {"c": 3, "d": 2}}
    items = [{"name": "x", "group": "g"}, {"name": "y", "group": "h"}]
    assert [i["name"] for i in config.select(items, ["g"])] == ["x"] and len(config.select(items, [])) == 2
    with pytest.raises(ValueError):
        config.select(items, ["z"])


def test_append_new_is_idempotent(spark, tmp_path):
    source, sink = tmp_path / "in", str(tmp_path / "sink")
    source.mkdir()
    write(source / "1.json", '{"id":"a","n":1}\n{"id":"b","n":2}\n')
    for turn in ("c1", "c2"):  # a second checkpoint sees the same file again
        incremental.append_new(spark, str(source), SCHEMA, lambda df: df.withColumn("m", F.col("n") + 1), sink, str(tmp_path / turn)).awaitTermination()
    write(source / "2.json", '{"id":"b","n":9}\n{"id":"c","n":3}\n')
    incremental.append_new(spark, str(source), SCHEMA, lambda df: df.withColumn("m", F.col("n") + 1), sink, str(tmp_path / "c1")).awaitTermination()
    assert sorted((r["id"], r["m"]) for r in spark.read.parquet(sink).collect()) == [("a", 2), ("b", 3), ("c", 4)]


def test_windowed_counts_as_a_stream(spark, tmp_path, small):
    batch = spark.read.parquet(f"{small}/events.parquet")
    folder = str(tmp_path / "events")
    batch.write.parquet(folder)
    stream = spark.readStream.schema(batch.schema).parquet(folder)
    events = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    q = incremental.windowed_counts(events, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from windows").first()[0] == batch.count()


def test_experiments_are_layered():
    base = {"model": {"base_model": "m"}, "lora": {"rank": 4}, "output": {"folder": "out"}}
    made = config.experiments(base, [{"name": "r16", "overrides": {"lora": {"rank": 16}}}, {"name": "plain"}])
    assert config.parse(made["r16"]) == {"model": {"base_model": "m"}, "lora": {"rank": 16}, "output": {"folder": "out/r16"}}
    assert config.parse(made["plain"])["lora"] == {"rank": 4}


def test_documents_and_bad_lines(spark, tmp_path):
    assert [tuple(r) for r in io.read_document(spark, str(tmp_path / "none.json"), "a int, b string").collect()] == [(None, None)]
    assert io.read_document(spark, write(tmp_path / "d.json", '{\n "a": 3\n}'), "a int, b string").first()["a"] == 3
    lines = ["{}" if n % 50 else "oops" for n in range(1, 401)]
    path = write(tmp_path / "long.jsonl", "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    try:
        assert sorted(r["line"] for r in io.bad_lines(spark, path, "a int").collect()) == list(range(50, 401, 50))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_config_rules():
    good = {"model": {"base_model": "m"}, "data": {"train_file": "f", "chat_template": "chatml"}, "training": {"max_seq_length": 8}, "lora": {"rank": 1}}
    config.check_sft(good)
    for bad in ({"model": {"base_model": ""}}, {"data": {"train_file": ""}}, {"training": {"max_seq_length": 0}}, {"lora": {"rank": 0}}, {"data": {"validation_split_ratio": 1.0}}, {"data": {"validation_split_size": -1}}, {"data": {"chat_template": "x"}}):
        with pytest.raises(ValueError, match=f"{next(iter(bad))}[.]{next(iter(next(iter(bad.values()))))}"):
            config.check_sft(config.layered(good, bad))
    config.check_dpo({"data": {"train_file": "f"}, "dpo": {"beta": 0.1}})
    with pytest.raises(ValueError, match="beta"):
        config.check_dpo({"data": {"train_file": "f"}, "dpo": {"beta": 0}})
