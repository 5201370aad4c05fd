"""The source with sequence numbers and the author stream, stopped, started again and given rows twice."""

import random

from pyspark.sql import functions as F

from inkstream.operators import classifier
from inkstream.sources.sequence import SequenceLog, SequenceReader
from inkstream.streaming import authors


def parquet(spark, numbers, path):
    df = spark.createDataFrame([(i, f"v{i}") for i in numbers], "seq long, value string")
    df.repartitionByRange(2, "seq").write.mode("append").parquet(path)


def test_each_number_once_over_the_seam_and_after_a_stop(spark, tmp_path):
    archive, tail, out = f"{tmp_path}/archive", f"{tmp_path}/tail", f"{tmp_path}/out"
    parquet(spark, range(1, 101), archive)
    parquet(spark, range(80, 121), tail)
    parquet(spark, [*range(110, 131), 125, 125], tail)
    spark.dataSource.register(SequenceLog)

    def run(**more):
        stream = spark.readStream.format("sequence_log").options(archive=archive, tail=tail, columns="seq long, value string", step=16, **more).load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        return sorted(r.seq for r in spark.read.parquet(out).collect())

    assert run(until=40) == list(range(1, 41))
    assert run(until=40) == list(range(1, 41))  # nothing new
    assert run(until=118) == list(range(1, 119))
    parquet(spark, range(125, 141), tail)
    assert run() == list(range(1, 141))


def test_ranges_name_only_the_files_that_overlap_them(spark, tmp_path):
    from pyspark.sql.types import StructType

    archive, tail = f"{tmp_path}/archive", f"{tmp_path}/tail"
    parquet(spark, range(1, 101), archive)
    parquet(spark, range(90, 151), tail)
    r = SequenceReader(StructType.fromDDL("seq long, value string"), {"archive": archive, "tail": tail, "step": "30"})
    assert r.initialOffset() == {"seq": 0} and r.latestOffset() == {"seq": 150}
    got = r.partitions({"seq": 20}, {"seq": 130})
    assert [(p.lo, p.hi) for p in got] == [(20, 50), (50, 80), (80, 100), (100, 130)]
    assert all("/archive/" in f for p in got[:3] for f in p.files) and all("/tail/" in f for f in got[3].files)
    assert sum(b.num_rows for p in got for b in r.read(p)) == 110
    assert r.partitions({"seq": 150}, {"seq": 150}) == []


def documents(spark):
    r = random.Random(2)
    rows = []
    for a, (n, kind) in enumerate([(70, "list"), (130, "thin"), (60, "mixed"), (20, "list"), (55, "curated")]):
        for i in range(n):
            title = {"list": f"Weekly update {i}", "curated": f"Weekly update {i}", "thin": r.choice(["", "a", f"x {i}"])}.get(kind) or " ".join(r.choices("sun moon sea wind tree book road rain".split(), k=5))
            rows.append((f"did:{a}", f"at://{a}/{i:03d}", title, "t" * (2000 if kind == "mixed" else 50), f"2024-01-{1 + i % 28:02d}T0{i % 9}:00:00"))
    return spark.createDataFrame(rows, "did string, uri string, title string, content string, indexed_at string")


def test_authors_as_all_at_once_in_any_order_of_arrival(spark, tmp_path):
    docs = documents(spark)
    curated = spark.createDataFrame([("did:4",)], "did string")
    want = sorted(tuple(r) for r in classifier.author_states(docs, curated).collect())
    assert {r[1] for r in want} == {"observing", "pending", "vetoed"}
    rows = authors.observed(docs, curated)
    end = spark.range(1).select(*(F.expr(f"TIMESTAMP '{authors.END}'").alias("at") if f.name == "at" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema))
    for k, order in enumerate([(0, 1), (1, 0, 1)]):
        at = f"{tmp_path}/{k}"
        for part in order:
            rows.where(F.expr(f"pmod(xxhash64(uri), 2) = {part}")).write.mode("append").parquet(f"{at}/inbox")
            authors.run(spark, f"{at}/inbox", rows.schema, f"{at}/state", f"{at}/out", "40 days")
        end.write.mode("append").parquet(f"{at}/inbox")
        authors.run(spark, f"{at}/inbox", rows.schema, f"{at}/state", f"{at}/out", "40 days")
        got = authors.latest_states(spark.read.schema(authors.STATES).parquet(f"{at}/out"))
        assert sorted(tuple(r) for r in got.collect()) == want


def test_a_stalled_stream_is_reported(spark, tmp_path):
    import time

    from inkstream.streaming.watch import Silence

    now, said = [0.0], []
    listener = Silence(30, lambda name, silent: said.append((name, silent)), lambda: now[0])
    spark.streams.addListener(listener)
    try:
        spark.range(5).write.parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("id long").parquet(f"{tmp_path}/in")
        query = stream.writeStream.queryName("stalled").format("noop").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="1 second").start()
        query.processAllAvailable()
        for _ in range(100):
            if listener.spoke:
                break
            time.sleep(0.1)
        listener.look()
        assert said == []
        now[0] = 31.5
        listener.look()
        listener.look()
        assert said == [("stalled", 31.5)]
        spark.range(5, 9).write.mode("append").parquet(f"{tmp_path}/in")
        query.processAllAvailable()
        for _ in range(100):
            if not listener.told:
                break
            time.sleep(0.1)
        now[0] = 70.0
        listener.look()
        assert [name for name, _ in said] == ["stalled", "stalled"]
        query.stop()
    finally:
        spark.streams.removeListener(listener)
