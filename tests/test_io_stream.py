from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lattica.common import lookup_join
from lattica.sources import io

SCHEMA = StructType([StructField("id", LongType()), StructField("name", StringType())])


def test_jsonl_keeps_bad_lines_apart(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": 1, "name": "a"}\n\n{"id": broken\n{"id": 2, "name": "b", "more": 3}\n')
    good, bad = io.read_jsonl(spark, str(tmp_path / "r.jsonl"), SCHEMA)
    assert sorted(r.id for r in good.collect()) == [1, 2]
    assert [r.value for r in bad.collect()] == ['{"id": broken']


def test_csv_round_trip_with_line_ends(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q"\n b'), (2, " x ,"), (3, None)], SCHEMA)
    io.write_csv(df, str(tmp_path / "c"))
    assert sorted(tuple(r) for r in io.read_csv(spark, str(tmp_path / "c"), SCHEMA).filter("id < 3").collect()) == [(1, 'a "q"\n b'), (2, " x ,")]


def test_upsert_and_snapshot(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "id long, v string, t int")
    new = spark.createDataFrame([(1, "c", 2), (2, "d", 4), (3, "e", 1)], "id long, v string, t int")
    got = io.upsert(old, new, ["id"], "t")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "c", 2), (2, "b", 5), (3, "e", 1)]
    assert io.same_rows(old, old).first().different == 0
    assert io.same_rows(old, new.unionByName(new)).first().different == 8
    assert io.same_rows(old.filter("false"), old.filter("false")).first().different == 0


def test_whitelist(spark, tmp_path):
    (tmp_path / "w.txt").write_text("# comment\n\nDocs/Report A.pdf\nb.PDF\n")
    assert sorted(r.name for r in io.read_lines(spark, str(tmp_path / "w.txt")).collect()) == ["b.pdf", "report a.pdf"]


def test_lookup_join_with_a_hot_key(spark):
    df = spark.range(9000).select((F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))).alias("k"), "id")
    u = df.select("k").distinct().withColumn("v", F.col("k") * 2)
    got = lookup_join(df, u, "k")
    assert got.count() == 9000 and got.filter("v <> 2 * k").count() == 0
    assert lookup_join(df.filter("false"), u, "k").count() == 0


def test_stream_counts_like_batch(spark, data):
    from lattica.streaming import stream

    got = stream.collected(stream.tumbling(stream.stream_of(spark, data, "events")), "complete")
    assert got.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{data}/events.parquet").count()
    one = stream.collected(stream.first_deliveries(stream.stream_of(spark, data, "results").select("result_id", "ingested_at"), "3650 days"), "append")
    r = spark.read.parquet(f"{data}/results.parquet")
    assert one.count() == r.select("result_id").distinct().count()
