from pyspark.sql import functions as F

from threadloom.streaming import streams


def _run(spark, df, name, mode, folder):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/cp-{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_citations_and_windows(spark, tmp_path):
    spark.createDataFrame([(["a", "b", "a"],), (["a"],)], "selected array<string>").write.parquet(f"{tmp_path}/s")
    got = _run(spark, streams.running_citations(spark.readStream.schema("selected array<string>").parquet(f"{tmp_path}/s")), "cites", "complete", tmp_path)
    assert {r["id"]: r["n_citations"] for r in got.collect()} == {"a": 2, "b": 1}
    spark.sql("select timestamp'2024-01-01 00:01:00' ts, 'x' stage, 2.0D ms union all select timestamp'2024-01-01 00:02:00', 'x', 5.0D").write.parquet(f"{tmp_path}/t")
    rows = streams.event_time(spark.readStream.schema("ts timestamp, stage string, ms double").parquet(f"{tmp_path}/t"))
    out = _run(spark, streams.stage_windows(rows), "stages", "complete", tmp_path).collect()
    assert [(r["n"], float(r["max_ms"])) for r in out] == [(2, 5.0)]


def test_duplicates_within_the_watermark_go(spark, tmp_path):
    spark.sql("select 1L thread_id, 't' turn_id, 'tool_call' kind, 'c' call_id, timestamp'2024-01-01' ts from range(3)").write.parquet(f"{tmp_path}/b")
    rows = spark.readStream.schema("thread_id long, turn_id string, kind string, call_id string, ts timestamp").parquet(f"{tmp_path}/b")
    assert _run(spark, streams.distinct_blocks(streams.event_time(rows)), "once", "append", tmp_path).count() == 1


def test_vectors_are_appended_once_per_batch(spark, tmp_path):
    spark.createDataFrame([(1, "m", [1.0, -1.0]), (2, "other", [1.0, 1.0])], "vec_id long, model_id string, vector array<float>").write.parquet(f"{tmp_path}/v")
    stream = spark.readStream.schema("vec_id long, model_id string, vector array<float>").parquet(f"{tmp_path}/v")
    streams.append_vectors(stream, f"{tmp_path}/out", f"{tmp_path}/cp", "m").trigger(availableNow=True).start().awaitTermination(120)
    assert [r["vec_id"] for r in spark.read.parquet(f"{tmp_path}/out").select(F.col("vec_id")).collect()] == [1]


def _drip(spark, folder, schema, batches):
    """A stream that gets one file a micro-batch, in order of names."""
    for k, sql in enumerate(batches):
        spark.sql(sql).coalesce(1).write.parquet(f"{folder}/{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_late_rows_are_left_out(spark, tmp_path):
    one = "select timestamp'2024-01-01 {}' ts, 'x' stage, {}D ms"
    batches = [one.format("00:01:00", 1.0), one.format("01:00:00", 2.0), one.format("01:06:00", 3.0), one.format("00:02:00", 9.0), one.format("03:00:00", 4.0)]
    rows = streams.event_time(_drip(spark, f"{tmp_path}/late", "ts timestamp, stage string, ms double", batches))
    out = _run(spark, streams.stage_windows(rows), "late_windows", "append", tmp_path).orderBy("w").collect()
    assert [(r["n"], r["max_ms"]) for r in out] == [(1, 1.0), (1, 2.0), (1, 3.0)]


def test_calls_meet_results_and_time_out_without(spark, tmp_path):
    call = "select 1L thread_id, '{}' call_id, timestamp'2024-01-01 {}' ts"
    schema = "thread_id long, call_id string, ts timestamp"
    calls = streams.event_time(_drip(spark, f"{tmp_path}/c", schema, [call.format("a", "00:00:00"), call.format("b", "00:10:00"), call.format("z", "09:00:00"), call.format("z2", "19:00:00")]))
    results = streams.event_time(_drip(spark, f"{tmp_path}/r", schema, [call.format("a", "00:05:00"), call.format("y", "00:11:00"), call.format("y", "09:00:00"), call.format("y", "19:00:00")]))
    out = _run(spark, streams.paired_calls(calls, results), "pairs", "append", tmp_path).collect()
    assert {(r["call_id"], r["is_error"]) for r in out} >= {("a", False), ("b", True)} and not [r for r in out if r["call_id"] == "z2"]


def test_scales_as_state_equal_the_batch_form(spark, tmp_path):
    from threadloom.operators.telemetry import token_scale

    row = "select 'm' model, {}L seq, 100L predicted, {}L observed, {}L budget"
    batches = [row.format(k, 60 + 37 * k % 240, 0 if k == 3 else 100) for k in range(6)]
    usage = _drip(spark, f"{tmp_path}/u", "model string, seq long, predicted long, observed long, budget long", batches)
    store = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = [r["scale"] for r in _run(spark, streams.token_scales(usage, 3), "scales", "update", tmp_path).collect()]
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    batch = spark.read.option("recursiveFileLookup", "true").parquet(f"{tmp_path}/u")
    want = {r["scale"] for r in token_scale(batch, 3).collect()}
    assert set(got) == want
