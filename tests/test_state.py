"""State of two tables as one version; streams that are run again."""

from __future__ import annotations

import threading
import time
from pathlib import Path

import pytest
from forecourt.plans import streaming_queries
from forecourt.sources.shared import cleaned
from forecourt.streaming import ingest
from forecourt.streaming.state import State, StateConflict
from pyspark.sql import functions as F

LISTINGS, DONE = "n long", "name string"


def tables(spark, n, name):
    return {"listings": spark.range(n).select(F.col("id").alias("n")), "done": spark.createDataFrame([(name,)], DONE)}


def seen(spark, path):
    state = State(spark, path)
    return state.read("listings", LISTINGS).count(), sorted(r.name for r in state.read("done", DONE).collect())


def test_versions(spark, tmp_path):
    path = str(tmp_path / "state")
    assert seen(spark, path) == (0, []) and State(spark, path).version() == (0, {})
    assert State(spark, path).add(0, tables(spark, 3, "a")) == 1
    assert State(spark, path).add(1, tables(spark, 4, "b")) == 2
    assert seen(spark, path) == (7, ["a", "b"])
    State(spark, path).add(1, tables(spark, 5, "c"))  # the same batch again
    assert seen(spark, path) == (8, ["a", "c"])
    State(spark, path).compact({"listings": LISTINGS, "done": DONE})
    assert seen(spark, path) == (8, ["a", "c"]) and len(State(spark, path).version()[1]) == 1
    State(spark, path).vacuum()
    assert seen(spark, path) == (8, ["a", "c"]) and len(list((tmp_path / "state/data").iterdir())) == 1
    State(spark, path).clear()
    assert seen(spark, path) == (0, [])


def test_a_writer_that_dies_between_the_tables_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "state")
    State(spark, path).add(0, tables(spark, 3, "a"))
    dying = tables(spark, 9, "b")
    dying["done"] = spark.range(3).select(F.raise_error(F.lit("killed")).cast("string").alias("name"))
    with pytest.raises(Exception, match="killed"):
        State(spark, path).add(1, dying)
    assert any(p.name.startswith("1-") for p in (tmp_path / "state/data").iterdir())  # the first table was written
    assert seen(spark, path) == (3, ["a"])
    State(spark, path).add(1, tables(spark, 9, "b"))
    assert seen(spark, path) == (12, ["a", "b"])


def test_a_version_that_is_there_is_not_replaced(spark, tmp_path):
    path = str(tmp_path / "state")
    one, two = State(spark, path), State(spark, path)
    after, batches = one.version()
    one.add("x", tables(spark, 1, "a"))
    with pytest.raises(StateConflict):
        two.commit(after, batches | {"y": "data/none"})
    assert seen(spark, path) == (1, ["a"])


def test_readers_see_pairs_only(spark, tmp_path):
    path = str(tmp_path / "state")
    stop, odd = threading.Event(), []

    def read():
        while not stop.is_set():
            folders = set(State(spark, path).version()[1].values())
            for folder in folders:
                if not all((tmp_path / "state" / folder / t / "_SUCCESS").exists() for t in ("listings", "done")):
                    odd.append(folder)

    reader = threading.Thread(target=read)
    reader.start()
    try:
        for batch in range(4):
            State(spark, path).add(batch, tables(spark, 2, str(batch)))
    finally:
        stop.set()
        reader.join()
    assert not odd and seen(spark, path) == (8, ["0", "1", "2", "3"])


def test_a_batch_that_fails_half_way_is_run_again(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.range(5).write.parquet(str(tmp_path / "in/a"))
    source = lambda: spark.readStream.schema("id long").option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    failing = lambda rows: rows.withColumn("id", F.when(F.col("id") == 3, F.raise_error(F.lit("killed"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="killed"):
        ingest.append_stream(source(), out, checkpoint, failing).awaitTermination()
    for _ in range(2):
        ingest.append_stream(source(), out, checkpoint).awaitTermination()
    spark.range(5, 8).write.parquet(str(tmp_path / "in/b"))
    ingest.append_stream(source(), out, checkpoint).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(8))
    with pytest.raises(ValueError, match="unknown format"):
        ingest.append_stream(source(), out, checkpoint, format="xml")


def test_duplicates_over_a_stream_are_those_of_a_batch(spark, tmp_path):
    import random

    from forecourt.operators import dedup
    from forecourt.streaming.state import State

    r = random.Random(6)
    schema = "ord int, vin string, vehicle_url string, scraped_at timestamp_ntz, other string"
    rows = [(n, r.choice([None, "", "a", "A ", "b", "c", "d", "e"]), r.choice(["u1", "U1", "u2", "u3", None, ""]), r.choice([None, *(f"2024-01-0{d} 00:00:00" for d in range(1, 6))]), str(n)) for n in range(120)]
    r.shuffle(rows)
    frame = lambda part: spark.createDataFrame([(*x[:3], None if x[3] is None else __import__("datetime").datetime.fromisoformat(x[3]), x[4]) for x in part], schema)
    state, checkpoint, source = (str(tmp_path / x) for x in ("state", "checkpoint", "in"))
    for n, part in enumerate((rows[:50], rows[50:60], rows[60:])):
        frame(part).write.parquet(f"{source}/{n}")
        ingest.deduplicate_stream(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(source), state, checkpoint, ["ord"]).awaitTermination()
        done = frame(rows[: (50, 60, 120)[n]])
        got = ingest.deduplicated(spark, state, done, ["ord"])
        assert sorted(x.ord for x in got.collect()) == sorted(x.ord for x in dedup.deduplicate(done, ["ord"]).collect())
    again = ingest.deduplicate_stream(spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(source), state, str(tmp_path / "other"), ["ord"])
    again.awaitTermination()  # a new checkpoint: one batch of all rows in the place of batch 0
    got = ingest.deduplicated(spark, state, done, ["ord"])
    assert sorted(x.ord for x in got.collect()) == sorted(x.ord for x in dedup.deduplicate(done, ["ord"]).collect())
    held = State(spark, state)
    parts = dedup.choices(done, ["ord"])
    held.compact({"rows": done.schema, "vins": parts[0].schema, "urls": parts[1].schema})
    assert len(held.version()[1]) == 1 and ingest.deduplicated(spark, state, done, ["ord"]).count() == got.count()


def test_recent_rows_of_a_stream(spark, tmp_path):
    """Within the delay the first row of a VIN (or address) stays."""
    schema = "vin string, vehicle_url string, scraped_at timestamp_ntz"
    spark.sql("SELECT * FROM VALUES ('a', 'u1', timestamp_ntz'2024-01-01 00:00:00'), ('A', 'u2', timestamp_ntz'2024-01-01 00:00:00'), (NULL, 'U3', timestamp_ntz'2024-01-01 00:00:00'), (NULL, 'u3', timestamp_ntz'2024-01-01 00:00:00') t(vin, vehicle_url, scraped_at)").write.parquet(str(tmp_path / "in"))
    rows = ingest.recent_only(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    ingest.append_stream(rows, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r.vin or "").upper() or r.vehicle_url.lower() for r in got) == ["A", "u3"]


def taken(path):
    return sum(p.stat().st_size for p in Path(path).rglob("*") if p.is_file())


def test_lines_that_are_read_back_take_little_disk(spark, data, tmp_path, monkeypatch):
    monkeypatch.setattr(streaming_queries, "scratch", lambda _: str(tmp_path))
    got = streaming_queries.k1_json_roundtrip(spark, data)
    made = streaming_queries._constructible(spark, data)
    columns = ["vehicle_url", "year", "vin", "msrp", "description", "features"]
    assert got.exceptAll(made.select(columns)).isEmpty() and got.count() == made.count() > 0
    assert taken(tmp_path) < 6 * sum((Path(data) / f"{t}.parquet").stat().st_size for t in ("lineitem", "part", "supplier"))


def test_a_written_table_leaves_no_shuffle_files(spark, tmp_path):
    files = lambda: spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    with cleaned(spark):
        spark.range(10_000).groupBy(F.col("id") % 997).count().write.parquet(str(tmp_path / "out"))
    end = time.time() + 10
    while files() > before and time.time() < end:
        time.sleep(0.1)
    assert files() <= before and spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_streamed_rows_are_held_once(spark, data, tmp_path, monkeypatch):
    """What the state holds is gone from the stream's input, and packed."""
    import pyarrow.parquet as pq

    monkeypatch.setattr(streaming_queries, "scratch", lambda _: str(tmp_path))
    got = streaming_queries.d1_streamed_survivors(spark, data)
    assert not list((tmp_path / "in").rglob("*.parquet"))
    held = [pq.ParquetFile(p).metadata for p in (tmp_path / "state/data").rglob("*.parquet")]
    assert {m.row_group(0).column(0).compression for m in held if m.num_row_groups} == {"ZSTD"}
    assert sum(m.num_rows for m in held) > got.count() > 0
