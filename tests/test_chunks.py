"""Sections and entries of files in chunks are those of whole files."""

import random

import pytest
from pyspark.sql import functions as F

from textlist.fixtures import table
from textlist.operators import sections, segment

KINDS = ["RED WINES", "Champagne", "from burgundy", "aged merlot", 'Pinot Noir "Ring", Promo Estate, Loire 2007 12 €', "Domaine Ring", "Domaine Hill Loire 1999  45€", "(late harvest)", "old vines", "One Two", "Four Words Stand Here", "Old Estate", "magnum 12,50 €", "", "   "]


@pytest.fixture(scope="module")
def lines(spark, sf):
    """The given lines, and a file that is longer than all others, with entries over many pages."""
    rng = random.Random(4)
    long = [("long", "r", n // 5, n, rng.choice(KINDS[5:] if n % 40 > 8 else KINDS)) for n in range(400)]
    given = table(spark, sf, "lines").select("file_id", "restaurant_id", "page", "line_no", "text")
    return given.unionByName(spark.createDataFrame(long, given.schema)).cache()


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("chunk", [1, 7, 100_000])
def test_sections_in_chunks(lines, chunk):
    assert rows(sections.with_sections(lines, chunk)) == rows(sections.with_sections(lines))


@pytest.mark.parametrize("chunk", [1, 7, 100_000])
@pytest.mark.parametrize("echo", [True, False])
def test_entries_in_chunks(lines, chunk, echo):
    whole = sections.with_sections(lines)
    assert rows(segment.segment_entries(whole, echo, chunk)) == rows(segment.segment_entries(whole, echo))


def test_an_entry_spans_chunks(lines):
    long = segment.segment_entries(lines.where("file_id = 'long'"), chunk=7)
    assert long.agg(F.max("n_lines")).first()[0] > 10
