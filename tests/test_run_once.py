from keyloom.plans import catalog
from keyloom.streaming import streams

SF = "/root/testdata/sf0.001"


def test_output_of_a_stream_stays_out_of_the_driver(spark):
    for name in ("stream_dedupe", "stream_liveness", "stream_replay"):
        out = catalog.QUERIES[name](spark, SF)
        assert out.count() > 0 and out.inputFiles() and all("/keyloom-stream-" in f for f in out.inputFiles())


def test_all_batches_or_the_last(spark, tmp_path):
    for n in range(3):
        spark.range(n * 10, n * 10 + 10, numPartitions=1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    assert sorted(r.id for r in streams.run_once(stream(), f"{tmp_path}/a", "append").collect()) == list(range(30))
    assert [r["count"] for r in streams.run_once(stream().groupBy().count(), f"{tmp_path}/c", "complete").collect()] == [30]


def test_an_import_is_kept_for_the_next(spark):
    files = catalog.QUERIES["import_links"](spark, SF).inputFiles()
    assert any("/keyloom-imported-" in f for f in files)
