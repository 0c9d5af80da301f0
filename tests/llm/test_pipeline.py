"""Each stage of the pipeline against brute force, on the rows that the stage before it kept."""

import pytest

import corpus_pipeline
from textlist.llm import quality
from textlist.llm.common import read_table, save
from tests.llm.test_pairs import components, kept_lines, leaks, shingles, words


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = read_table(spark, sf, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = save(stage(spark, docs, sf), "test")
        out[name] = (docs, after)
        docs = after
    return out


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_columns_are_those_of_documents(stages):
    for name, (before, after) in stages.items():
        assert name == "mixing" or after.dtypes == before.dtypes


def test_quality(spark, sf, stages):
    before, after = stages["quality"]
    good = {r["doc_id"] for r in quality.quality(before, read_table(spark, sf, "labels")).collect() if r["predicted"]}
    assert {r["doc_id"] for r in after.collect()} == good
    truth = {r["doc_id"]: r["quality"] for r in read_table(spark, sf, "labels").collect()}
    assert all(i in good for i, q in truth.items() if q == 1)


def test_line_dedup(stages):
    before, after = stages["line_dedup"]
    assert dict(texts(after)) == kept_lines(texts(before))
    assert all(r["n_chars"] == len(r["text"]) for r in after.collect())


def test_near_duplicates(stages):
    before, after = stages["near_duplicates"]
    groups = components(texts(before), 5, 80)
    assert {i for i, _ in texts(after)} == {i for i, (_, c) in groups.items() if i == c}


def test_decontamination(spark, sf, stages):
    before, after = stages["decontamination"]
    items = [(r["item_id"], r["text"]) for r in read_table(spark, sf, "benchmark").collect()]
    gone = set()
    for d, t in texts(before):
        near = [(i, x) for i, x in items if shingles(x, 5) & shingles(t, 5)]
        if leaks([(d, t)], near):
            gone.add(d)
    assert {i for i, _ in texts(after)} == {i for i, _ in texts(before)} - gone


def test_mixing(stages):
    before, after = stages["mixing"]
    rows = {r["doc_id"]: r for r in after.collect()}
    assert {i: r["size"] for i, r in rows.items()} == {i: len(words(t)) for i, t in texts(before)}
    assert all(r["taken"] <= 2 * r["size"] for r in rows.values())


def test_run_gives_the_last_stage(spark, sf, stages):
    got = corpus_pipeline.run(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages["mixing"][1].collect()))


def odd_documents(spark, n=30):
    """Null and repeated ids, null, empty and very long texts, ties, and columns whose names clash with those of the operators."""
    rows = [(i, f"Some plain words about the river and the hills number {i % 7}.\nA second line that is long enough to count as one, {i % 3}.") for i in range(n)]
    rows += [(None, "no id at all, but some words"), (3, rows[3][1]), (3, "another text of the same id"), (100, None), (101, ""), (102, " \n\n "), (103, "word " * 60_000)]
    more = "lang string, source string, n_chars int, score double, size long, component long, key string, rows long, part int, line string, taken long, id long, bits long, item_id long"
    return spark.createDataFrame([(d, t, "en", None if i % 5 == 0 else "s", len(t or ""), 0.5, 1, 2, "k", 3, 4, "l", 5, 6, 7, 8) for i, (d, t) in enumerate(rows)], f"doc_id long, text string, {more}")


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_rows_and_on_none(spark, sf, name):
    docs, stage = odd_documents(spark), dict(corpus_pipeline.STAGES)[name]
    out = stage(spark, docs, sf)
    got = out.collect()
    if name == "mixing":
        assert len(got) == docs.count() and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    else:
        assert out.dtypes == docs.dtypes
        ids = [r["doc_id"] for r in docs.collect()]
        assert all(r["doc_id"] in ids for r in got)
    if name == "line_dedup":
        assert len(got) == len(ids)
    if name == "near_duplicates":
        assert [r["doc_id"] for r in got].count(3) == 1 and {100, 101, 102, 103, None} <= {r["doc_id"] for r in got}
    if name == "decontamination":
        assert len(got) == len(ids)
    assert stage(spark, docs.where("false"), sf).collect() == []
