from pyspark.sql import functions as F

from loomgraph.streaming import buffer

KIND = "doc_id long, chunk_id int, offset long, name string, type string"


def feed(spark, path, *batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_entities_are_told_once_over_batches(spark, tmp_path):
    stream = feed(spark, tmp_path / "in", [(1, 0, 3, "Ann", "Person"), (1, 0, 1, "Acme", None), (2, 0, 0, "Ann", "Person")], [(1, 1, 9, "ANN", "Place"), (1, 1, 8, "Bob", "Person"), (1, 2, 1, None, None)])
    q = run(buffer.first_seen(stream), "seen")
    assert q.exception() is None
    got = {(r.doc_id, r.name_lc) for r in spark.table("seen").collect()}
    assert got == {(1, "ann"), (1, "acme"), (1, "bob"), (2, "ann")} and spark.table("seen").count() == 4


def test_mentions_of_streamed_documents(spark, tmp_path):
    spark.createDataFrame([(1, "Ann sang. She left.")], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "docs"))
    run(buffer.stream_mentions(stream), "mentions")
    assert {(r.mention, r.pronoun_type) for r in spark.table("mentions").collect()} == {("Ann", None), ("She", "feminine")}


def test_windows_of_event_time(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", "neutral"), ("2024-01-01 00:02:00", "neutral"), ("2024-01-01 00:07:00", None)], "t string, pronoun_type string").select(F.to_timestamp("t").alias("ts"), "pronoun_type")
    rows.write.parquet(str(tmp_path / "m"))
    run(buffer.mention_rates(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "m"))), "rates", "complete")
    assert sorted(r.n for r in spark.table("rates").collect()) == [1, 2]
