"""Streams fed in several files: what a buffer holds between them, and what it gives at the end."""

from timeweave.streaming import frames as S


def feed(spark, folder, batches):
    """A stream of the batches, a file each, in any order column."""
    schema = "rec long, at long, value double, fin boolean"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def test_a_buffer_is_flushed_at_the_end_of_a_recording(spark, tmp_path):
    batches = [[(1, 2, 2.0, False), (1, 1, 1.0, False), (2, 1, 5.0, False)], [(1, 3, 3.0, False), (2, 2, 6.0, False)], [(1, 4, 4.0, False), (1, 5, 5.0, True)]]
    stream = feed(spark, str(tmp_path), batches)
    got = S.drained(S.buffered(stream, "rec", "value", 3, order="at", last="fin"), str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 3, 6.0), (1, 1, 2, 9.0)]  # of recording 2 nothing is complete yet


def test_without_an_end_what_is_incomplete_stays(spark, tmp_path):
    stream = feed(spark, str(tmp_path), [[(1, k, float(k), True) for k in range(5)]])
    got = S.drained(S.buffered(stream, "rec", "value", 2, order="at"), str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 2, 1.0), (1, 1, 2, 5.0)]
