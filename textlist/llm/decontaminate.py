"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

DataFrame functions only. Words are runs of bytes that are not ASCII white space, with A-Z in lower case. A text is contaminated
by an item where some window of as many words as the item has, or the whole text where it is shorter, reaches a weighted Jaccard similarity
of ``percent`` / 100 over shingles of ``width`` words; a shingle weighs as often as it stands there.

1. A window that shares no shingle with an item cannot reach the threshold with it. The best window for an item starts at a shingle of
   that item, or ends the text: sliding a window right to its first shared shingle loses none. So the places of shared shingles, for
   the items that hold the shingle, are all that need be looked at; items of one size that share nothing with a text are never met.
   The items' shingles are broadcast only up to ``broadcast_rows`` rows; a larger set is joined by a shuffle on the shingle.
2. Windows slide over these places: a place counts in the windows that start after the place which its item's weight for the shingle makes one too many, and reach it. So each
   place is one step up and one down in a running sum, in time linear in the places but for sorting, however long the item; the sum is the exact weighted overlap of every window, and the first of the greatest stays,
   where it reaches the threshold.
3. Documents with such a window are read again, found by a broadcast only up to ``broadcast_rows`` windows. A window and its item have 64-bit SimHashes, cut into
   ``radius + 1`` parts: fingerprints within the radius equal one another in some part, so pairs without an equal part go, then
   those beyond the radius. At a similarity of 0.8 the parts are three bits wide and pass most pairs: the shingle is what selects.

The radius loses a window of the threshold's similarity with a chance of about 2e-4: its distance is 10 bits in the mean with
a deviation of 3.

Defined results: null, empty and blank texts and items match nothing; items shorter than a shingle are matched as one shingle of
their own length; very long texts are read whole; repeated rows of a document or an item count once, and rows that repeat an
id with another text are looked at one by one, the best window of all standing for the id; of windows that tie the first is given;
null ids are an id of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, save
from .line_dedup import lower_ascii

BLANK = r"[\x20\x09-\x0D]+"
LANES = 0x0000000100000001


def word_array(text: Column) -> Column:
    clean = F.trim(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\f\r"))
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, BLANK, -1))


def with_words(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``words``, a 64-bit hash of each word, and ``n_words``."""
    return df.withColumn("words", F.transform(word_array(F.col(text)), lambda x: F.xxhash64(x))).withColumn("n_words", F.size("words"))


def shingles(width: int) -> Column:
    """A 64-bit hash of each run of ``width`` of the ``words``; null where there are fewer."""
    at = F.sequence(F.lit(0), F.col("n_words") - width)
    made = F.transform(at, lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(width)]))
    return F.when(F.col("n_words") >= width, made)


def simhash(items: Column) -> tuple[Column, Column]:
    """Bit b is set where more hashes have it than not. Thirty-two running sums count two bits each, in lanes of 32 bits, more than a text has words.

    The first column is those sums, to be named ``_counts``; the second makes the fingerprint of them.
    """
    mask = F.lit(LANES).cast("long")
    half = F.size(items)

    def counted(k: int) -> Column:
        def add(acc: Column, x: Column) -> Column:
            return acc + F.shiftrightunsigned(x, k).bitwiseAND(mask)

        return F.aggregate(items, F.lit(0).cast("long"), add)

    def bits(k: int) -> Column:
        def of(c: Column) -> Column:
            parts = []
            for lane in range(2):
                n = F.shiftrightunsigned(c, 32 * lane).bitwiseAND(F.lit(0xFFFFFFFF))
                parts.append(F.when(n * 2 > half, F.shiftleft(F.lit(1).cast("long"), 32 * lane + k)).otherwise(F.lit(0).cast("long")))
            return reduce(Column.bitwiseOR, parts)

        return of(F.get(F.col("_counts"), F.lit(k)))

    return F.array(*map(counted, range(32))), reduce(Column.bitwiseOR, map(bits, range(32)))


def with_simhash(df: DataFrame, items: str) -> DataFrame:
    counts, bits = simhash(F.col(items))
    return df.withColumn("_counts", counts).withColumn("simhash", bits).drop("_counts")


def part_masks(radius: int) -> list[int]:
    """The 64 bits cut into radius + 1 parts."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    masks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def near(a: Column, b: Column, radius: int) -> Column:
    """Whether two fingerprints meet in some part and lie within the radius."""
    differ = a.bitwiseXOR(b)
    met = reduce(Column.__or__, [differ.bitwiseAND(F.lit(m).cast("long")) == 0 for m in part_masks(radius)])
    return met & (F.bit_count(differ) <= radius)


def item_prints(benchmark: DataFrame, width: int) -> DataFrame:
    """``(item, item_id, size, width, item_shingles, item_bits)`` of each distinct item; ``item`` is a hash of its id and text."""
    rows = benchmark.select("item_id", "text").where("text is not null").dropDuplicates()
    rows = with_words(rows.withColumn("item", F.xxhash64("item_id", "text")), "text").where("n_words > 0")
    rows = rows.withColumn("width", F.least(F.lit(width), F.col("n_words")))
    rows = rows.withColumn("item_shingles", F.coalesce(*[F.when(F.col("width") == w, shingles(w)) for w in range(1, width + 1)]))
    return with_simhash(rows, "item_shingles").select("item", "item_id", F.col("n_words").alias("size"), "width", "item_shingles", F.col("simhash").alias("item_bits"))


def hits(docs: DataFrame, keys: DataFrame, width: int) -> DataFrame:
    """``(doc_id, print, n_words, item, size, width, h, weight, pos)`` where a shingle of ``width`` words is an item's."""
    rows = with_words(docs, "text").withColumn("shingles", shingles(width))
    # the outer form: the plain one infers a filter on the array's size, which is pushed down and makes the array again
    rows = rows.select("doc_id", "print", "n_words", F.posexplode_outer("shingles").alias("pos", "h")).join(keys.where(F.col("width") == width), "h")
    return rows.select("doc_id", "print", "n_words", "item", "size", "width", "h", "weight", "pos")


def best_windows(found: DataFrame, percent: int) -> DataFrame:
    """``(doc_id, print, item, size, width, start, both, all)``: for each text and item the first window of the greatest overlap, where it reaches ``percent``.

    An occurrence counts in the windows that reach it, but for those that hold as many before it as the item has: these start at or before that many occurrences back.
    """
    pair = ["doc_id", "print", "item"]
    own = found.repartition(*pair).groupBy(*pair, "h").agg(F.sort_array(F.collect_set("pos")).alias("at"), *[F.max(c).alias(c) for c in ("n_words", "size", "width", "weight")])  # no more than one text has
    rows = own.select(*pair, "n_words", "size", "width", "weight", "at", F.posexplode("at").alias("i", "pos"))
    before = F.when(F.col("i") >= F.col("weight"), F.get("at", (F.col("i") - F.col("weight")).cast("int"))).otherwise(-1)
    first = F.greatest(before, F.col("pos") - (F.col("size") - F.col("width") + 1)) + 1
    start = F.greatest(F.lit(0), F.least(F.col("pos"), F.col("n_words") - F.col("size")))
    step = lambda t, up, window: F.struct(F.greatest(t, F.lit(0)).cast("int").alias("t"), F.lit(up).alias("up"), F.lit(window).alias("window"))
    rows = rows.select(*pair, "n_words", "size", "width", F.explode(F.array(step(first, 1, False), step(F.col("pos") + 1, -1, False), step(start, 0, True))).alias("s"))
    both = F.sum("s.up").over(Window.partitionBy(*pair).orderBy("s.t").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("both", both).where("s.window").groupBy(*pair).agg(F.max(F.struct("both", (-F.col("s.t")).alias("back"))).alias("m"), *[F.max(c).alias(c) for c in ("n_words", "size", "width")])
    whole = F.col("size") - F.col("width") + 1
    rows = rows.withColumn("both", F.col("m.both")).withColumn("all", whole + F.greatest(F.lit(1), F.least(whole, F.col("n_words") - F.col("width") + 1)) - F.col("both"))
    return rows.where(F.col("both") * 100 >= F.col("all") * percent).select(*pair, "size", "width", (-F.col("m.back")).alias("start"), "both", "all")


def candidates(docs: DataFrame, prints: DataFrame, broadcast_rows: int, percent: int = 80) -> DataFrame:
    """``(doc_id, print, item, size, start, both, all, bits)``: for each text and item the best window at shared shingles, and its fingerprint."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("print"))
    keys = prints.select(F.explode("item_shingles").alias("h"), "item", "size", "width").groupBy("h", "item", "size", "width").agg(F.count("*").alias("weight"))
    keys = save(keys, "item-keys")
    small = F.broadcast(keys) if keys.count() <= broadcast_rows else keys
    widths = sorted(r["width"] for r in prints.select("width").distinct().collect())  # one, unless items are shorter than a shingle
    found = reduce(DataFrame.unionByName, [hits(docs, small, w) for w in widths])
    best = save(best_windows(found, percent), "windows").withColumnsRenamed({"doc_id": "_doc", "print": "_print"})
    near_ = best.count() <= broadcast_rows
    out = []
    for w in widths:
        own = best.where(F.col("width") == w).groupBy("_doc", "_print").agg(F.collect_list(F.struct("item", "size", "start", "both", "all")).alias("at"))
        rows = docs.join(F.broadcast(own) if near_ else own, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("print") == F.col("_print")))
        rows = with_words(rows, "text").withColumn("shingles", shingles(w)).select("doc_id", "print", "shingles", F.explode("at").alias("at"))
        window = F.slice("shingles", F.col("at.start") + 1, F.greatest(F.lit(1), F.col("at.size") - w + 1))
        out.append(rows.select("doc_id", "print", "at.*", window.alias("window")))
    return with_simhash(reduce(DataFrame.unionByName, out), "window").withColumnRenamed("simhash", "bits").drop("window")


def leaking_texts(docs: DataFrame, benchmark: DataFrame, width: int = 5, percent: int = 80, radius: int = 20, broadcast_rows: int = 500_000) -> DataFrame:
    """``(doc_id, print, item_id, similarity, start_word, item_words)``: for each text and item its best window, the first on ties; ``print`` is a hash of the text."""
    prints = save(item_prints(benchmark, width), "item-prints")
    if prints.isEmpty():
        kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"doc_id {kinds[0]}, print long, item_id {kinds[1]}, similarity double, start_word int, item_words int")
    rows = candidates(docs, prints, broadcast_rows, percent).join(prints.select("item", "item_id", "item_bits"), "item")
    met = rows.where(near(F.col("bits"), F.col("item_bits"), radius)).withColumn("similarity", F.col("both") / F.col("all"))
    best = met.groupBy("doc_id", "print", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"), "size")).alias("m"))
    return best.select("doc_id", "print", "item_id", F.round("m.similarity", 6).alias("similarity"), (-F.col("m.back")).alias("start_word"), F.col("m.size").alias("item_words"))


def leaks(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """``(doc_id, item_id, similarity, start_word, item_words)``: for each contaminated pair its best window, the first on ties."""
    order = F.struct("similarity", -F.col("start_word"), "item_words")
    best = leaking_texts(docs, benchmark, **options).groupBy("doc_id", "item_id").agg(F.max_by(F.struct("similarity", "start_word", "item_words"), order).alias("m"))
    return best.select("doc_id", "item_id", "m.*")


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options: int) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose own text holds no item; a null id is looked at like any other."""
    doc, print_ = free_names(docs, "doc", "print")
    gone = leaking_texts(docs.select("doc_id", "text"), benchmark, **options).select(F.col("doc_id").alias(doc), F.col("print").alias(print_)).distinct()
    gone = save(gone, "leaking")
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[doc]) & (F.xxhash64(docs["text"]) == gone[print_]), "left_anti")


#: Without items of fewer than five words, which the tables do not have.
ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
iw AS (SELECT DISTINCT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
ds AS (SELECT doc_id, len(w) AS n, unnest(range(len(w) - 4)) AS pos, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM dw WHERE len(w) >= 5),
ic AS (SELECT item_id, size, s, count(*) AS k FROM (SELECT item_id, len(w) AS size, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM iw WHERE len(w) >= 5) GROUP BY ALL),
sh AS (SELECT ds.* FROM ds WHERE s IN (SELECT s FROM ic)),
wi AS (SELECT DISTINCT sh.doc_id, sh.n, ic.size, greatest(0, least(sh.pos, sh.n - ic.size)) AS t FROM sh JOIN ic USING (s)),
co AS (SELECT wi.doc_id, wi.n, wi.size, wi.t, ic.item_id, ic.s, count(*) AS c, any_value(ic.k) AS k
  FROM wi JOIN sh ON sh.doc_id = wi.doc_id AND sh.pos BETWEEN wi.t AND wi.t + wi.size - 5 JOIN ic ON ic.s = sh.s AND ic.size = wi.size GROUP BY ALL),
sc AS (SELECT doc_id, item_id, size, t, CAST(sum(least(c, k)) AS BIGINT) AS b, any_value(least(n, size) - 4 + size - 4) AS total FROM co GROUP BY doc_id, item_id, size, t),
ok AS (SELECT *, b::DOUBLE / (total - b) AS similarity FROM sc WHERE b * 100 >= (total - b) * 80)
SELECT doc_id, item_id, round(max(similarity), 6) AS similarity, CAST(arg_max(t, (similarity, -t)) AS INT) AS start_word, CAST(any_value(size) AS INT) AS item_words FROM ok GROUP BY doc_id, item_id
"""
