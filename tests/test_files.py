from pyspark.sql import functions as F

from corvane.sources import flatfile
from corvane.streaming import pool

TEXT = "\n\nid: 3\nreq: a: b: c\nF:\nF-prime: A ⊑ B\nnote: x\nnote: y\n\nid: 1\nreq: q\nheaders: h\nodd\n\nid: no number\nreq: z\n"


def test_flat_files_are_read(spark, tmp_path):
    (tmp_path / "g.txt").write_text(TEXT)
    got = {r.pos: r for r in flatfile.read_flat(spark, str(tmp_path / "g.txt")).collect()}
    assert got[1].id == 3 and got[1].req == "a b c" and got[1].f == "" and got[1].f_prime == "A ⊑ B" and got[1].note == "y" and got[1].headers is None
    assert got[2].id == 1 and got[2].f_prime is None and got[3].id is None and got[3].req == "z"
    kv = flatfile.records_of(spark.createDataFrame([("n", TEXT), ("empty", ""), ("none", None)], "name string, text string")).where("record_no = 2").first().kv
    assert kv["odd"] == ""


def test_flat_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, 1, "r2", "h", "F ⊑ G", "A ⊑ B", None), (1, 2, "r1", "", "", "", "n")], "id long, pos long, req string, headers string, f string, f_prime string, note string")
    out = str(tmp_path / "out")
    flatfile.write_flat(df, out, "id", one_file=True)
    got = sorted(flatfile.read_flat(spark, out + "/*.txt").collect(), key=lambda r: r.id)
    assert [(r.id, r.req, r.headers, r.f, r.f_prime, r.note) for r in got] == [(1, "r1", "", "", "", "n"), (2, "r2", "h", "F ⊑ G", "A ⊑ B", None)]
    absent = df.withColumn("f_prime", F.lit(None).cast("string"))
    assert "F-prime:\n" in absent.select(flatfile.rendered(absent).alias("t")).first().t
    assert "F-prime" not in absent.select(flatfile.rendered(absent, canonical=False).alias("t")).first().t


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path):
    n = 400
    (tmp_path / "g.txt").write_text("lead\n" + "".join(f"id: {i}\nreq: r{i} {'x' * (i % 50)}\n\n" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = flatfile.read_flat(spark, str(tmp_path / "g.txt"))
        assert spark.read.text(str(tmp_path / "g.txt")).rdd.getNumPartitions() > 5
        got = {r.pos: r for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
    assert len(got) == n and all(got[i + 1].id == i and got[i + 1].req == f"r{i} {'x' * (i % 50)}".strip() for i in range(n))


def test_list_writer_numbers_and_files_in_order(spark, tmp_path):
    df = spark.createDataFrame([(k, None if k % 3 else 100 + k, f"r{k}") for k in range(50)], "pos long, id long, req string").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        flatfile.write_flat(df, str(tmp_path / "many"), "pos", canonical=False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted((tmp_path / "many").glob("*.txt"))
    text = "".join(f.read_text() for f in files)
    assert len(files) > 1 and [line for line in text.split("\n") if line.startswith("id")] == [f"id: {k if k % 3 else 100 + k}" for k in range(50)]


def test_json_lines_and_orders(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": 1, "req": "r", "F-prime": "A ⊑ B"}\n{"id": 2, "meta": {"org": "o", "headers": "h"}}\n')
    got = sorted(flatfile.read_jsonl(spark, str(tmp_path / "a.jsonl")).collect(), key=lambda r: r.id)
    assert got[0].f_prime == "A ⊑ B" and got[1].req == "o" and got[1].headers == "h"
    flatfile.flat_from_json(spark, str(tmp_path / "a.jsonl"), str(tmp_path / "flat"))
    back = sorted(flatfile.read_flat(spark, str(tmp_path / "flat" / "*" / "*.txt")).collect(), key=lambda r: r.id)
    assert [r.req for r in back] == ["r", "o"]
    records = flatfile.records_of(spark.createDataFrame([("n", TEXT)], "name string, text string"))
    assert '"req":"a b c"' in flatfile.jsonl_of(records).where("record_no = 1").first().value
    (tmp_path / "order.txt").write_text("5\n\n 7 \nx\n5\n")
    assert [r.id for r in flatfile.read_order(spark, str(tmp_path / "order.txt")).orderBy("seq").collect()] == [5, 7, 5]
    flatfile.append_order(spark.createDataFrame([(9,)], "id long"), str(tmp_path / "o"))
    flatfile.append_order(spark.createDataFrame([(8,)], "id long"), str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).count() == 2
    flatfile.write_text(spark.createDataFrame([("t",)], "text string"), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first().value == "t"


def test_stream_grows_the_pool_once(spark, tmp_path):
    rows = [(i, i % 7, f"r{i}", None, "A ⊑ B" if i % 5 else None, "yes" if i % 11 == 0 else None) for i in range(1, 41)]
    kind = "pos long, id long, req string, headers string, f_prime string, ignore_flag string"
    source = str(tmp_path / "in")
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], kind).coalesce(1).write.mode("append").parquet(source)
    got = {r.id: r.pos for r in pool.pool_of(spark, source, files_per_batch=1).collect()}
    want = {}
    for pos, i, _, _, f, ig in rows:
        if f and not ig:
            want.setdefault(i, pos)
    assert set(got) == set(want) and sum(1 for _ in got) == len(want)


def test_windowed_counts_of_a_stream(spark, tmp_path):
    from datetime import datetime as dt

    source = str(tmp_path / "scores")
    spark.createDataFrame([("wer", 0.5, dt(2024, 1, 5)), ("wer", 0.7, dt(2024, 1, 6)), ("wer", None, dt(2024, 1, 6))], "metric string, score double, scored_at timestamp").write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    q = pool.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select n from counts").first().n == 2
