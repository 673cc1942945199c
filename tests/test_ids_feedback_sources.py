import io
import time
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.functions.ranking import global_index, index_within
from shelfmark.operators import evaluate, feedback, ids
from shelfmark.sources import embeddings, images, products
from shelfmark.streaming import feedback as streams


def test_global_index(spark):
    df = spark.range(0, 5000, 1, 16).select((F.col("id") * 7919 % 5000).alias("k"))
    got = global_index(df, ["k"], "idx", 10).collect()
    assert all(r["idx"] == r["k"] + 10 for r in got) and len(got) == 5000


def test_index_within_hot_group(spark):
    df = spark.range(0, 3000, 1, 8).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), (F.col("id") % 100).cast("string"))).alias("g"), F.col("id").alias("t"))
    got = index_within(df, ["g"], ["t"]).collect()
    groups = {}
    for r in sorted(got, key=lambda r: r["t"]):
        groups.setdefault(r["g"], []).append(r["pos"])
    assert len(groups["hot"]) == 1000 and all(p == list(range(1, len(p) + 1)) for p in groups.values())


def test_chunks(spark):
    df = spark.range(0, 25).select(F.col("id").alias("pid"))
    sizes = ids.chunk_assign(df, "pid", 10).groupBy("chunk").count().orderBy("chunk").collect()
    assert [tuple(r) for r in sizes] == [(0, 10), (1, 10), (2, 5)]
    present = spark.createDataFrame([("fusion", 0), ("fusion", 3), ("fusion", 10), ("image", 0)], "embedding_type string, chunk int")
    assert {tuple(r) for r in ids.chunk_gap_report(present).collect()} == {("fusion", 1), ("fusion", 2)}


def test_id_sets(spark):
    meta = spark.createDataFrame([("1",), ("2",), ("3",), ("9",)], "pid string")
    emb = spark.createDataFrame([("fusion", p) for p in "123"] + [("image", p) for p in "12"] + [("text", p) for p in "12"], "embedding_type string, pid string")
    assert {r[0] for r in ids.intersect_ids(meta, emb).collect()} == {"1", "2"}
    old = spark.createDataFrame([("a", 1), ("b", 1)], "pid string, v int")
    new = spark.createDataFrame([("b", 9), ("c", 5), ("c", 3)], "pid string, v int")
    assert {tuple(r) for r in ids.insert_if_absent(old, new, "v").collect()} == {("a", 1), ("b", 1), ("c", 3)}
    index = ids.id_mapping(spark.createDataFrame([("x", 0), ("y", 1), ("x", 2)], "pid string, at int"), "at")
    assert {tuple(r) for r in index.collect()} == {("x", 2), ("y", 1)}
    added = ids.append_new_ids(index, spark.createDataFrame([("y",), ("z",), ("w",), ("z",)], "pid string"))
    assert {tuple(r) for r in added.select("pid", "vector_id").collect()} == {("w", 3), ("z", 4)}


def test_recall_and_precision(spark):
    targets = spark.createDataFrame([(1, "a", "basic", "X"), (2, "b", "basic", "Y"), (3, "c", "natural", "X")], "query_id int, target string, query_type string, category string")
    results = spark.createDataFrame([(1, "a", 5), (2, "b", 41), (3, "z", 1)], "query_id int, pid string, rank int")
    recall = {r["query_type"]: r["recall"] for r in evaluate.recall_at_k(ids.hit_test(targets, results, 40)).collect()}
    assert recall == {None: 0.33, "basic": 0.5, "natural": 0.0}
    wide = {r["query_type"]: r["recall"] for r in evaluate.recall_at_k(ids.hit_test(targets, results, 41)).collect()}
    assert wide["basic"] == 1.0
    judged = spark.createDataFrame([("a", True), ("z", False)], "pid string, relevant boolean")
    assert {tuple(r) for r in evaluate.precision_at_k(results, judged, 20).collect()} == {(1, 0.05), (3, 0.0)}
    runs = spark.createDataFrame([("21.2min",), ("n/a",)], "duration string")
    assert [r["search_time"] for r in evaluate.duration_parse(runs).collect()] == [pytest.approx(4.24), None]


EVENTS = "event_id long, ts timestamp, session_id string, pid string, feedback boolean"


def events(spark, n, session="s1"):
    return spark.range(n).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") % 50 + 1_700_000_000).alias("ts"), F.lit(session).alias("session_id"),
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("pid"), (F.col("id") % 2 == 0).alias("feedback"),
    )


def test_fold_keeps_long_sessions_whole(spark):
    rows = events(spark, 95).unionByName(events(spark, 3, "s2"))
    bad = spark.createDataFrame([(1000, None, "s1", None, True), (1001, None, "s1", "p", None), (1002, None, "", "p", True)], EVENTS)
    folded = feedback.feedback_fold(rows.unionByName(bad), 40).orderBy("session_id", "fold").collect()
    assert [(r["session_id"], r["fold"], len(r["feedback"])) for r in folded] == [("s1", 0, 40), ("s1", 1, 40), ("s1", 2, 15), ("s2", 0, 3)]
    entries = [e["pid"] for r in folded[:3] for e in r["feedback"]]
    assert entries == [f"p{i}" for i in sorted(range(95), key=lambda i: (i % 50, i))]
    assert feedback.rejected_feedback(bad).count() == 3


def test_feedback_stream_over_several_batches(spark, tmp_path):
    source, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    rows = events(spark, 60)
    rows.filter("event_id < 30").coalesce(1).write.parquet(source)
    stream = streams.file_stream(spark, source, rows.schema, "*.parquet")
    streams.feedback_stream(stream, log, state).awaitTermination()
    # A second delivery repeats some events.
    rows.filter("event_id >= 20").coalesce(1).write.mode("append").parquet(source)
    streams.feedback_stream(streams.file_stream(spark, source, rows.schema, "*.parquet"), log, state).awaitTermination()
    got = feedback.feedback_fold(streams.read_feedback_log(spark, log), 1000).first()["feedback"]
    assert got == feedback.feedback_fold(rows, 1000).first()["feedback"]


def by_session(df):
    return sorted(tuple(r) for r in df.select("session_id", "pos", "pid", "feedback").collect())


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0), (1, 0, 2, 1)])
def test_deliveries_in_any_order(spark, tmp_path, order):
    """The stream gives the batch fold, and its state is a row per session, however many entries there are."""
    source, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    rows = events(spark, 95)
    cuts = ["event_id < 30", "event_id >= 30 AND event_id < 60", "event_id >= 60"]
    for i in order:
        rows.filter(cuts[i]).coalesce(1).write.mode("append").parquet(source)
        query = streams.feedback_stream(streams.file_stream(spark, source, rows.schema, "*.parquet"), log, state)
        query.awaitTermination()
        held = sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"])
        assert held <= rows.select("session_id").distinct().count()
    assert by_session(streams.logged_entries(spark, log)) == by_session(feedback.feedback_entries(rows))


def test_idle_sessions_are_forgotten(spark, tmp_path):
    source, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    rows = events(spark, 40)
    rows.filter("event_id < 20").coalesce(1).write.parquet(source)
    stream = streams.file_stream(spark, source, rows.schema, "*.parquet")
    query = streams.feedback_stream(stream, log, state, idle=timedelta(seconds=1), every="1 second")

    def until(reached):
        end = time.time() + 40
        while not reached():
            assert query.isActive and time.time() < end, query.exception()
            time.sleep(0.5)

    def logged(n):
        found = list((tmp_path / "log").glob("*/_SUCCESS"))
        return bool(found) and spark.read.parquet(log).count() == n

    def states():
        return [s["numRowsTotal"] for s in query.lastProgress["stateOperators"]]

    try:
        until(lambda: logged(20))
        until(lambda: states() == [0])
        rows.filter("event_id >= 20").coalesce(1).write.mode("append").parquet(source)
        until(lambda: logged(40))
    finally:
        query.stop()
    segments = spark.read.parquet(log).filter("opens").groupBy("session_id").count()
    assert segments.agg({"count": "max"}).first()[0] == 2
    assert by_session(streams.logged_entries(spark, log)) == by_session(feedback.feedback_entries(rows))


def test_search_log(spark, tmp_path):
    source, log, state = (str(tmp_path / n) for n in ("in", "log", "state"))
    spark.createDataFrame([("s", "red chair", None), (None, "lamp", None)], "session_id string, query_text string, timestamp timestamp").write.parquet(source)
    schema = spark.read.parquet(source).schema
    streams.search_log_append(streams.file_stream(spark, source, schema, "*.parquet"), log, state).awaitTermination()
    got = spark.read.parquet(log).collect()
    assert len(got) == 2 and all(r["session_id"] and r["timestamp"] for r in got)


def test_npz_chunks(spark, tmp_path):
    def save(name, **arrays):
        buffer = io.BytesIO()
        np.savez(buffer, **arrays)
        (tmp_path / name).write_bytes(buffer.getvalue())

    m = np.arange(12, dtype="float32").reshape(3, 4)
    save("fusion_embeddings_chunk_10.npz", embeddings=m, product_ids=np.array(["a", "b", "c"]))
    save("fusion_embeddings_chunk_2.npz", embeddings=m[:2], product_ids=np.array(["d", "e"]))
    save("text_embeddings.npz", embeddings=m[:1], product_ids=np.array([7]))
    save("image_embeddings_chunk_1.npz", embeddings=m, product_ids=np.array(["a"]))
    save("image_embeddings_chunk_2.npz", embeddings=m)
    (tmp_path / "image_embeddings_chunk_3.npz").write_bytes(b"not a zip")
    listed = {(r["embedding_type"], r["chunk"]) for r in embeddings.list_chunks(spark, str(tmp_path)).collect()}
    assert ("fusion", 10) in listed and ("text", 0) in listed and len(listed) == 6
    got = {(r["embedding_type"], r["chunk"], r["pid"]): list(r["embedding"]) for r in embeddings.scan_embedding_chunks(spark, str(tmp_path)).collect()}
    assert set(got) == {("fusion", 10, p) for p in "abc"} | {("fusion", 2, p) for p in "de"} | {("text", 0, "7")}
    assert got["fusion", 10, "b"] == [4.0, 5.0, 6.0, 7.0]


def test_images(spark, tmp_path):
    (tmp_path / "11.jpeg").write_bytes(b"\xff\xd8\xff\xe0rest")
    (tmp_path / "12.jpeg").write_bytes(b"broken")
    (tmp_path / "13.txt").write_bytes(b"\xff\xd8\xff")
    assert [r["pid"] for r in images.scan_images(spark, str(tmp_path)).collect()] == ["11"]
    assert images.scan_images(spark, str(tmp_path), content=False).count() == 2


def test_csv(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('Name,Pid,Description,Price\n"Red ""big"" chair",1,"two\nlines",N/A\n,2,None, 5 \n')
    got = {r["Pid"]: r for r in products.scan_products_csv(spark, str(path)).collect()}
    assert got["1"]["Name"] == 'Red "big" chair' and got["1"]["Description"] == "two\nlines" and got["1"]["Price"] is None
    assert got["2"]["Name"] is None and got["2"]["Description"] is None and got["2"]["Brand"] is None
    marked = tmp_path / "bench.csv"
    marked.write_bytes("﻿Pid,Category\n1,Furniture \n".encode())
    row = products.scan_benchmark_csv(spark, str(marked)).first()
    assert row["Pid"] == "1" and row["Category"] == "Furniture "
    clean = spark.createDataFrame([(" a ", 1.5)], "n string, p double")
    for kind in ("csv", "parquet"):
        products.write_clean_products(clean, str(tmp_path / kind), kind)
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["n"] == " a "
    with pytest.raises(ValueError):
        products.write_clean_products(clean, str(tmp_path / "x"), "xml")


def test_csv_of_another_column_order_is_an_error(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_text("Pid,Name\n1,one\n")
    (folder / "b.csv").write_text("Pid,Name\n2,two\n")
    assert {(r["Pid"], r["Name"]) for r in products.scan_products_csv(spark, str(folder)).collect()} == {("1", "one"), ("2", "two")}
    (folder / "b.csv").write_text("Name,Pid\ntwo,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        products.scan_products_csv(spark, str(folder)).collect()


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    good = spark.createDataFrame([("b", 1), ("a", 2)], "Pid string, n int")
    bad = good.withColumn("n", F.when(F.col("Pid") == "a", F.raise_error(F.lit("broken row")).cast("int")).otherwise(F.col("n")))
    for write in (products.write_clean_products, products.product_table_write, products.summary_write):
        path = str(tmp_path / write.__name__)
        write(good, path)
        with pytest.raises(Exception, match="broken row"):
            write(bad, path)
        again = (lambda: spark.read.csv(path, header=True)) if write is products.summary_write else (lambda: spark.read.parquet(path))
        assert sorted(r["Pid"] for r in again().collect()) == ["a", "b"]
        write(good.filter("Pid = 'a'"), path)
        assert [r["Pid"] for r in again().collect()] == ["a"]
        assert [p.name for p in tmp_path.iterdir() if p.name.startswith(write.__name__)] == [write.__name__]
