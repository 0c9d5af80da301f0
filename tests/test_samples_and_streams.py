"""Values of the queries without SQL, and of incremental ingest."""

import hashlib
import tempfile
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from textlist.operators import rules, sample
from textlist.plans import pipeline, rule_queries
from textlist.fixtures import table
from textlist.streaming import assemble, feed, ingest


def test_random_pick_takes_the_least_seeded_hash(spark):
    rows = [(f"f{k % 7}", f"entry {k}", k) for k in range(100)]
    got = {r["file_id"]: r["entry_id"] for r in sample.random_pick(spark.createDataFrame(rows, "file_id string, entry_id string, n int"), seed=7).collect()}

    def order(entry):
        return hashlib.md5(f"{entry}:7".encode()).hexdigest()

    assert got == {f: min((e for g, e, _ in rows if g == f), key=lambda e: (order(e), e)) for f in got}


def test_parse_lists_against_its_parts(spark, sf):
    """Owners with rules are parsed by them; each other file by the rules mined of its own seven samples, file by file."""
    entries, stored, catalog = (f.cache() for f in (rule_queries.entries(spark, sf), rule_queries.stored_rules(spark, sf), table(spark, sf, "catalog")))
    got = {r["entry_id"]: r for r in pipeline.parse_lists(entries, stored, catalog).collect()}
    owners = {r["restaurant_id"] for r in stored.select("restaurant_id").distinct().collect()}
    plain = {r["entry_id"]: r for r in rules.extract_fields(entries, stored).collect()}
    assert got.keys() == plain.keys() and {r["stage"] for r in got.values()} == {"rules_exist", "multi_stage"}
    for i, r in got.items():
        assert r["stage"] == ("rules_exist" if r["restaurant_id"] in owners else "multi_stage")
        if r["stage"] == "rules_exist":
            assert (r["fields"], r["row_confidence"]) == (plain[i]["fields"], plain[i]["row_confidence"])
    files = sorted({r["file_id"] for r in got.values() if r["stage"] == "multi_stage"})[:2]
    for f in files:  # a file by itself gives what it gives among others
        alone = pipeline.parse_lists(entries.where(F.col("file_id") == f), stored, catalog).collect()
        assert {r["entry_id"]: (r["fields"], r["provenance"]) for r in alone} == {i: (r["fields"], r["provenance"]) for i, r in got.items() if r["file_id"] == f}


def test_ingest_states(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    run = lambda: ingest.ingest(spark, f"{folder}/in", f"{folder}/entries", f"{folder}/status", f"{folder}/checkpoint", lambda df: df)
    drop = lambda rows: spark.createDataFrame(rows, ingest.LINE_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    drop([("a", "r", 1, 1, "x"), ("a", "r", 1, 2, "y"), ("b", "r", None, 1, "z"), ("b", "r", 1, 2, "w")])
    run()
    drop([("a", "r", 1, 1, "again"), ("c", "r", 1, 1, "new")])
    run()
    assert sorted(r["text"] for r in spark.read.parquet(f"{folder}/entries").collect()) == ["new", "x", "y"]
    assert {(r["file_id"], r["status"]) for r in spark.read.parquet(f"{folder}/status").collect()} == {("a", "parsed"), ("b", "error"), ("c", "parsed")}


def pieces_run(spark, folder, wait_ms=3_600_000):
    assemble.ingest_pieces(spark, f"{folder}/in", f"{folder}/entries", f"{folder}/status", f"{folder}/checkpoint", lambda df: df, wait_ms)
    texts = sorted((tuple(r[c] for c in ("file_id", "page", "line_no", "text")) for r in spark.read.parquet(f"{folder}/entries").collect()), key=lambda r: r[:3])
    return texts, sorted((r["file_id"], r["status"]) for r in spark.read.parquet(f"{folder}/status").collect())


def pieces_drop(spark, folder, rows, minute=0):
    at = datetime(2024, 1, 1) + timedelta(minutes=minute)
    spark.createDataFrame([(*r, at) for r in rows], assemble.PIECE_SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_a_file_in_three_drops_out_of_order(spark):
    """Each call is a new start of the stream from its checkpoint."""
    folder = tempfile.mkdtemp(prefix="spark-")
    pieces_drop(spark, folder, [("a", "r", 2, 2, "a4", None), ("b", "r", 1, 1, "b1", 1), ("c", "r", None, 1, "c1", 2), (None, "r", 1, 1, "x", 1)])
    assert pieces_run(spark, folder) == ([("b", 1, 1, "b1")], [("b", "parsed"), ("c", "error")])
    pieces_drop(spark, folder, [("a", "r", 1, 1, "a1", 4), ("a", "r", 2, 2, "a4 again", 4), ("c", "r", 1, 2, "c2", 2), ("c", "r", 1, 1, "c1", 2)], 5)
    assert pieces_run(spark, folder)[1] == [("b", "parsed"), ("c", "error")]
    pieces_drop(spark, folder, [("a", "r", 1, 2, None, None), ("a", "r", 2, 1, "a3", None), ("b", "r", 1, 2, "late", 1)], 3)
    texts, states = pieces_run(spark, folder)
    assert sorted(texts, key=lambda r: r[:3]) == [("a", 1, 1, "a1"), ("a", 1, 2, None), ("a", 2, 1, "a3"), ("a", 2, 2, "a4"), ("b", 1, 1, "b1")]
    assert states == [("a", "parsed"), ("b", "parsed"), ("c", "error")]


def test_a_file_out_of_time(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    pieces_drop(spark, folder, [("a", "r", 1, 1, "a1", 2)])
    assert pieces_run(spark, folder) == ([], [])
    pieces_drop(spark, folder, [("b", "r", 1, 1, "b1", 2)], 121)
    assert pieces_run(spark, folder) == ([], [("a", "error")])
    pieces_drop(spark, folder, [("a", "r", 1, 2, "too late", 2), ("b", "r", 1, 2, "b2", 2)], 122)
    assert pieces_run(spark, folder) == ([("b", 1, 1, "b1"), ("b", 1, 2, "b2")], [("a", "error"), ("b", "parsed")])


def test_many_small_files_in_two_drops(spark):
    """4000 files of two lines: a call of a file's own state, 2 ms each and several a file, would take minutes."""
    folder, began = tempfile.mkdtemp(prefix="spark-"), time.time()
    rows = lambda part: [(f"f{k}", "r", 1, part, f"{k}-{part}", 2 if part == 2 else None) for k in range(4000)]
    pieces_drop(spark, folder, [*rows(2), ("open", "r", 1, 1, "x", 2), ("zero", "r", None, None, None, 5)])
    assert pieces_run(spark, folder) == ([], [("zero", "error")])
    pieces_drop(spark, folder, rows(1))
    texts, states = pieces_run(spark, folder)
    assert texts == sorted((f"f{k}", 1, part, f"{k}-{part}") for k in range(4000) for part in (1, 2))
    assert states == sorted([*((f"f{k}", "parsed") for k in range(4000)), ("zero", "error")])
    assert time.time() - began < 60


def test_lines_sent_too_early_and_total_said_last(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    pieces_drop(spark, folder, [("a", "r", 1, 1, "a1", 9), ("b", "r", 1, 1, "b1", 2)], 200)
    assert pieces_run(spark, folder) == ([], [])
    pieces_drop(spark, folder, [("b", "r", 1, 2, "too old", 2)], 139)
    assert pieces_run(spark, folder) == ([], [])
    pieces_drop(spark, folder, [("a", "r", 1, 1, "again", 2), ("a", "r", 1, 2, "a2", None)], 150)
    assert pieces_run(spark, folder) == ([("a", 1, 1, "a1"), ("a", 1, 2, "a2")], [("a", "parsed")])
    pieces_drop(spark, folder, [("b", "r", 1, 2, "b2", None)], 199)
    assert pieces_run(spark, folder) == ([("a", 1, 1, "a1"), ("a", 1, 2, "a2"), ("b", 1, 1, "b1"), ("b", 1, 2, "b2")], [("a", "parsed"), ("b", "parsed")])


def test_a_feed_with_late_and_repeated_events(spark):
    folder, schema = tempfile.mkdtemp(prefix="spark-"), "id long, k string, s string, ts timestamp"
    event = lambda i, k, s, at: (i, k, s, datetime(2024, 1, 1) + timedelta(minutes=at))
    drops = [[event(1, "a", "uploaded", 0), event(2, "b", "uploaded", 500)], [event(5, "a", "parsed", 900), event(2, "b", "uploaded", 500)], [event(3, "a", "processing", 5), event(4, "b", "error", 500), event(6, None, "x", 1)], [event(7, "c", "uploaded", 1)]]
    seen = []
    for rows in drops:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        feed.run_feed(spark, f"{folder}/in", schema, f"{folder}/out", f"{folder}/checkpoint", "k", "s", "ts", "id")
        seen += rows
        got = {r["key"]: r["status"] for r in feed.last_states(spark, f"{folder}/out").collect()}
        whole = ingest.latest_status(spark.createDataFrame(seen, schema).where("k is not null"), "k", "s", ["ts", "id"])
        assert got == {r["k"]: r["status"] for r in whole.collect()}
    assert got == {"a": "parsed", "b": "error", "c": "uploaded"}
