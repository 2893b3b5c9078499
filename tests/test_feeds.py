"""Change feeds: runs that are cut off and resumed, late changes, and timers."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lexmill.operators import index as I
from lexmill.operators import search as S
from lexmill.streaming import changes as C

SCHEMA = "event_id long, ts timestamp, filename string, project_root string, op string, content string"
START = dt.datetime(2024, 1, 1)


def change(i, hours, name, content, op="upsert"):
    return (i, START + dt.timedelta(hours=hours), name, "/p", op, content)


#: Three files of the feed. The second holds a late change of f1 and one of f3, which was deleted after it.
FEED = [
    [change(1, 1, "f1", "alpha"), change(2, 2, "f2", "beta"), change(3, 5, "f3", "gamma"), change(4, 9, "f3", "", "delete")],
    [change(5, 6, "f1", "alpha two"), change(6, 0, "f1", "late"), change(7, 8, "f3", "late"), change(8, 7, "f2", "", "delete")],
    [change(9, 40, "f4", "delta"), change(10, 41, "f2", "beta again"), change(11, 10, "f1", "alpha three")],
]
LAST = {"f1": "alpha three", "f2": "beta again", "f4": "delta"}


@pytest.fixture
def feed(spark, tmp_path):
    for i, rows in enumerate(FEED):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    files = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    return files


def made(rows):
    return rows.select(F.xxhash64("filename").alias("id"), *[F.lit("").alias(c) if c != "body" else F.col("content").alias(c) for c in I.FIELDS], "project_root", "filename")


class Cut(Exception):
    pass


def test_a_feed_that_is_cut_off_ends_as_a_rebuilt_index(spark, feed, tmp_path, monkeypatch):
    path, folder, kept, calls = f"{tmp_path}/index", f"{tmp_path}/feed", C.update_index, []

    def cut(*args, **how):
        calls.append(1)
        if len(calls) == 2:  # the second batch writes its segment, but not its commit
            monkeypatch.setattr(I, "_statistics", lambda *a: (_ for _ in ()).throw(Cut()))
        return kept(*args, **how)

    statistics = I._statistics
    monkeypatch.setattr(C, "update_index", cut)
    with pytest.raises(Exception, match="Cut"):
        C.index_changes(feed, path, made, folder, 2)
    assert len(I.open_index(spark, path).segments) == 1
    monkeypatch.setattr(I, "_statistics", statistics)
    monkeypatch.setattr(C, "update_index", kept)
    C.index_changes(feed, path, made, folder, 2)
    C.index_changes(feed, path, made, folder, 2)  # nothing is left to do
    index = I.open_index(spark, path)
    assert len(index.segments) == 3
    assert {r["filename"]: r["body"] for r in index.entities().select("filename", "body").collect()} == LAST
    rebuilt = spark.createDataFrame([(0, START, f, "/p", "upsert", c) for f, c in LAST.items()], SCHEMA)
    q = S.term(spark, "alpha") | S.term(spark, "beta") | S.term(spark, "again")
    want = {r["id"]: round(r["score"], 9) for r in S.rank_bm25(made(rebuilt), q).collect()}
    assert {r["id"]: round(r["score"], 9) for r in S.rank_bm25(index, q).collect()} == want and len(want) == 2


def test_replay_resumes(spark, feed, tmp_path, monkeypatch):
    folder, kept, calls = f"{tmp_path}/state", C.apply_changes, []

    def cut(*args):
        calls.append(1)
        if len(calls) == 2:
            raise Cut
        return kept(*args)

    monkeypatch.setattr(C, "apply_changes", cut)
    with pytest.raises(Exception, match="Cut"):
        C.replay(feed, folder, 4)
    monkeypatch.setattr(C, "apply_changes", kept)
    for _ in range(2):
        assert {r["filename"]: r["content"] for r in C.replay(feed, folder, 4).collect()} == LAST


def test_quiet_files_leave_the_state(spark, feed, tmp_path):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = C.quiet_files(feed, hours=24)
        query = stream.writeStream.option("checkpointLocation", f"{tmp_path}/quiet").outputMode("append").trigger(availableNow=True).format("parquet").option("path", f"{tmp_path}/out").start()
        query.awaitTermination()
        left = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    finally:
        spark.conf.set(key, before)
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    # f3's last change was at 9 h and f1's at 10 h; f2 and f4 changed at 40 h and later. The watermark ends at 41 h.
    assert {(r["filename"], r["event_id"], r["n_seen"]) for r in rows} == {("f1", 11, 4), ("f3", 4, 3)}
    assert left[-1] < max(left)
