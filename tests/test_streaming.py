from driftline import streaming

SCHEMA = "id int, seq int, v string"


def put(spark, folder, *rows):
    spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def test_copy_follows_later_files(spark, tmp_path):
    source, log, progress = (str(tmp_path / name) for name in ("in", "log", "progress"))
    start = spark.createDataFrame([(1, 0, "old"), (2, 0, "kept")], SCHEMA)
    streaming.start_copy(start, log, ["id"], ["seq"])

    def current():
        stream = streaming.file_stream(spark, source, "*.parquet", SCHEMA)
        streaming.stream_upsert(stream, log, ["id"], ["seq"], progress).awaitTermination()
        rows = streaming.read_copy(spark, log, start.schema, ["id"], ["seq"]).collect()
        return {r.id: r.v for r in rows}

    put(spark, source, (1, 1, "new"), (3, 1, "added"), (3, 2, "again"))
    assert current() == {1: "new", 2: "kept", 3: "again"}
    put(spark, source, (1, 0, "late"), (2, 5, "changed"))
    assert current() == {1: "new", 2: "changed", 3: "again"}
    target = str(tmp_path / "compact")
    streaming.compact_copy(spark, log, target, start.schema, ["id"], ["seq"])
    rows = streaming.read_copy(spark, target, start.schema, ["id"], ["seq"]).collect()
    assert {r.id: r.v for r in rows} == {1: "new", 2: "changed", 3: "again"}


def test_filters_match_their_batch_form(spark, tmp_path):
    source = str(tmp_path / "in")
    put(spark, source, (1, 1, "a"), (2, 1, "b"), (3, 1, "c"), (3, 1, "c"))
    table = spark.createDataFrame([(2, 1, "b"), (3, 1, "x")], SCHEMA)
    cases = {
        "minus": (streaming.stream_minus, [1]),
        "intersect": (streaming.stream_intersect, [2, 3, 3]),
        "diff": (streaming.stream_diff_only, [1, 3, 3]),
    }
    for name, (operator, expected) in cases.items():
        stream = streaming.file_stream(spark, source, "*.parquet", SCHEMA)
        out = streaming.drain(operator(stream, table, ["id"]), str(tmp_path / name), str(tmp_path / f"{name}-p"))
        assert sorted(r.id for r in out.collect()) == expected
