"""Substring search by trigrams, and differences by digests."""

import random

from pyspark.sql import functions as F

from textlist.operators import tables, trigrams


def test_trigrams_find_what_contains_finds(spark):
    rng = random.Random(5)
    pool = ["domaine", "Blue Ring", "é", "12", "a", "of the", "ß", "x_%"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(5))) for _ in range(80)] + ["", None, "ab", "A"]
    rows = spark.createDataFrame([*enumerate(texts), (3, "domaine of the 12")], "id long, text string").cache()
    index = trigrams.build(rows).cache()
    whole = [t.lower() for t in texts if t]
    queries = ["", "a", "AB", "zz", "é", "_%", "blue ring of"] + [t[i : i + n] for n in range(1, 21, 3) for t in rng.sample(whole, 2) for i in [rng.randrange(len(t))]]
    for query in queries:
        got = sorted(r["id"] for r in trigrams.search(index, rows, query).collect())
        assert got == sorted(i for i, t in [*enumerate(texts), (3, "domaine of the 12")] if t is not None and query.lower() in t.lower()), query


def test_repeated_texts_are_indexed_once(spark):
    """Rows of few texts: postings for the texts, not for the rows, and each query finds all the rows that hold it, equal ids included."""
    said = ["Domaine 1 ring", "ring of", "x", "", "a r", None]
    data = [(f"e{k % 250}", said[k % 6]) for k in range(300)]
    rows = spark.createDataFrame(data, "id string, text string")
    texts = trigrams.texts_of(rows)
    index = trigrams.build(texts)
    assert texts.count() == 5 and index.count() == trigrams.build(spark.createDataFrame(list(enumerate(said)), "id long, text string")).count()
    queries = ["ring", "", "o", "a r", "Domaine 1 RING", "nowhere"]
    got = sorted(map(tuple, trigrams.search_all(index, texts, rows, queries).collect()))
    assert got == sorted((q, i) for q in queries for i, t in data if t is not None and q.lower() in t.lower())


def test_only_buckets_that_changed_are_read(spark):
    rows = [(k, f"name {k}", k % 5, None if k % 3 else "x") for k in range(2000)]
    before = spark.createDataFrame(rows, "id long, name string, n int, note string")
    after = before.where("id <> 17").withColumn("n", F.when(F.col("id") == 40, 9).otherwise(F.col("n"))).withColumn("note", F.when(F.col("id") == 42, None).otherwise(F.col("note")))
    after = after.unionByName(spark.createDataFrame([(5000, "new", 1, None)], before.schema)).orderBy(F.desc("id"))
    buckets = tables.changed_buckets(before, after, "id", ["name", "n", "note"], 4096).count()
    keys = spark.createDataFrame([(17,), (40,), (42,), (5000,)], "id long")
    assert buckets == keys.select(tables.bucket_of("id", 4096)).distinct().count()
    got = sorted(map(tuple, tables.audit_diff(before, after, "id", ["name", "n", "note"]).collect()))
    want = [(17, "n", "2", None), (17, "name", "name 17", None), (40, "n", "0", "9"), (42, "note", "x", None), (5000, "n", None, "1"), (5000, "name", None, "new")]
    assert got == want
    assert tables.audit_diff(before, before, "id", ["name"]).count() == 0 == tables.changed_buckets(before, before, "id", ["name"], 16).count()
