"""Input tables derived from the given ones. One SQL text serves Spark and any other engine with standard functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents".split()

LINES = """
WITH b AS (
 SELECT o.o_custkey AS fk, o.o_orderkey AS k, p.p_size AS sz, CAST(floor(p.p_retailprice) AS INT) AS pr,
        concat(upper(substr(p.p_type,1,1)), lower(substr(p.p_type,2))) AS ty,
        concat(upper(substr(split_part(p.p_name,' ',2),1,1)), substr(split_part(p.p_name,' ',2),2)) AS noun
 FROM orders o JOIN part p ON p.p_partkey = o.o_orderkey % (SELECT count(*) FROM part)),
t AS (
 SELECT fk, k, CASE
  WHEN k % 97 = 0 THEN 'Table of contents .... 3'
  WHEN k % 8 = 0 THEN CASE CAST(floor(k/8) AS BIGINT) % 3 WHEN 0 THEN 'RED WINES' WHEN 1 THEN 'Champagne' ELSE 'Dessert Wines' END
  WHEN k % 8 = 1 THEN CASE CAST(floor(k/8) AS BIGINT) % 3 WHEN 0 THEN 'from burgundy' WHEN 1 THEN 'from italy' ELSE 'from germany' END
  WHEN k % 8 = 2 THEN CASE CAST(floor(k/8) AS BIGINT) % 2 WHEN 0 THEN 'aged pinot noir' ELSE 'aged merlot' END
  WHEN k % 8 = 3 THEN concat('Pinot Noir "', noun, '", ', ty, ' Estate, Loire ', CAST(1990 + sz % 30 AS STRING), ' ', CAST(pr AS STRING), ' €')
  WHEN k % 8 = 4 THEN concat('Domaine ', noun, ' Loire ', CAST(1990 + sz % 30 AS STRING), '  ', CAST(pr AS STRING), '€')
  WHEN k % 8 = 5 THEN '(late harvest, old vines)'
  WHEN k % 8 = 6 THEN concat('Wine pairing ', CAST(pr % 100 AS STRING), '€')
  ELSE concat('Magnum Riserva DOCG ', noun, CASE WHEN sz % 2 = 0 THEN ' NV ' ELSE ' N.V. ' END,
              CASE WHEN sz % 5 = 0 THEN 'POA' ELSE concat(CAST(pr AS STRING), '.50$') END) END AS text
 FROM b),
r AS (SELECT fk, k, text, row_number() OVER (PARTITION BY fk ORDER BY k) AS rn FROM t)
SELECT CAST(fk AS STRING) AS file_id, CAST(fk % 20 AS STRING) AS restaurant_id,
       CAST(floor((rn-1)/12) AS INT) + 1 AS page, CAST(rn AS INT) AS line_no, text, 'text' AS source FROM r
"""

CATALOG = """
SELECT p_partkey AS catalog_row, concat('L', CAST(1000000 + p_partkey AS STRING)) AS lwin,
       concat('Domaine ', replace(p_brand,'#',' ')) AS producer_name, p_name AS wine,
       CASE WHEN p_size % 7 = 0 THEN NULL ELSE CAST(1990 + p_size % 30 AS STRING) END AS vintage_config,
       r_name AS region, n_name AS country, p_type AS colour
FROM part JOIN nation ON n_nationkey = p_partkey % 25 JOIN region ON r_regionkey = n_regionkey
"""

ITEMS = """
SELECT CAST(o_orderkey AS STRING) AS entry_id, p_partkey AS true_row,
  CASE o_orderkey % 4 WHEN 0 THEN lower(concat('Domaine ', replace(p_brand,'#',' '))) WHEN 1 THEN replace(p_brand,'#',' ')
                      WHEN 2 THEN concat('Estate ', replace(p_brand,'#',' '), ' & Sons') ELSE NULL END AS producer,
  CASE o_orderkey % 3 WHEN 0 THEN p_name WHEN 1 THEN concat(split_part(p_name,' ',2),' ',split_part(p_name,' ',1))
                      ELSE concat('"', p_name, ' grand cru') END AS cuvee,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(1990 + p_size % 30 AS STRING) END AS vintage,
  CASE WHEN o_orderkey % 2 = 0 THEN r_name END AS region, CASE WHEN o_orderkey % 2 = 0 THEN n_name END AS country,
  CAST(NULL AS STRING) AS grape_variety
FROM orders JOIN part ON p_partkey = o_orderkey % (SELECT count(*) FROM part)
JOIN nation ON n_nationkey = p_partkey % 25 JOIN region ON r_regionkey = n_regionkey
"""

#: Corrections: the latest for each (field, original) counts.
ALIASES = """
SELECT CASE WHEN event_id % 2 = 0 THEN 'producer' ELSE 'cuvee' END AS field,
       concat(CASE WHEN event_id % 3 = 0 THEN ' Brand ' ELSE 'brand ' END, CAST(user_id % 50 AS STRING)) AS original,
       CASE WHEN event_id % 11 = 0 THEN '' ELSE concat('Brand No ', CAST(event_id % 7 AS STRING)) END AS corrected, event_id AS seq
FROM events
"""

#: Blocks of a page as an extractor gives them, and the page's text by recognition.
BLOCKS = """
SELECT file_id, page, line_no, CASE WHEN line_no % 5 = 0 OR (CAST(file_id AS BIGINT) + page) % 4 = 0 THEN '  ' ELSE concat(' ', text, ' ') END AS text FROM lines
"""
OCR = """
SELECT file_id, page, concat(min(text), chr(10), '  ', chr(10), max(text)) AS ocr_text FROM lines GROUP BY file_id, page
"""

FILES = """
SELECT CAST(o_orderkey AS STRING) AS id, CAST(o_custkey % 20 AS STRING) AS restaurant_id,
  CASE o_orderkey % 4 WHEN 0 THEN concat('list_', substr(CAST(o_orderdate AS STRING), 1, 10), ' v1.pdf') WHEN 1 THEN concat('list', replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', ''), '.pdf')
    WHEN 2 THEN 'Carte des vins (été).pdf' ELSE '2023-13-45_20240230.pdf' END AS filename,
  CASE WHEN o_orderkey % 5 = 0 THEN substr(CAST(o_orderdate AS STRING), 1, 10) WHEN o_orderkey % 5 = 1 THEN 'soon' END AS user_date,
  CASE WHEN o_orderkey % 3 = 0 THEN concat('D:', replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', ''), '120000Z') WHEN o_orderkey % 3 = 1 THEN '' END AS creation_date,
  CASE WHEN o_orderkey % 2 = 0 THEN 'D:20230115' ELSE 'yesterday' END AS mod_date,
  CASE o_orderstatus WHEN 'F' THEN 'parsed' WHEN 'O' THEN 'uploaded' ELSE 'error' END AS status,
  CASE WHEN o_orderkey % 2 = 0 THEN concat('done; refinement_json: /tmp/r_', CAST(o_orderkey AS STRING), '.json; ok') END AS notes
FROM orders
"""

#: Stored entries, with confidences and a column that is not of the schema.
STORED = """
SELECT CAST(l_orderkey * 10 + l_linenumber AS STRING) AS entry_id, CAST(l_orderkey AS STRING) AS file_id, CAST(l_suppkey % 20 AS STRING) AS restaurant_id,
  CASE WHEN l_partkey % 6 = 0 THEN NULL WHEN l_partkey % 6 = 1 THEN '' ELSE concat('Domaine ', CAST(l_partkey % 40 AS STRING)) END AS producer,
  concat('Cuvee ', CAST(l_partkey % 90 AS STRING)) AS cuvee, CAST(1990 + l_partkey % 30 AS STRING) AS vintage,
  CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE CAST(CAST(floor(l_quantity) AS INT) AS STRING) END AS price,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE 'red' END AS type, CASE WHEN l_suppkey % 3 = 0 THEN 'Loire' ELSE 'Rioja' END AS region,
  CAST(floor(l_discount * 1000) AS DOUBLE) / CAST(100 AS DOUBLE) AS row_confidence, CASE WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'parsed' END AS status,
  CASE WHEN l_linenumber % 2 = 0 THEN concat('bin ', CAST(l_suppkey AS STRING)) END AS bin
FROM lineitem
"""

#: Rules of every third restaurant; the last does not compile.
RULESETS = """
SELECT CAST(k AS STRING) AS restaurant_id, concat('{"extraction_rules":[{"pattern":"(?P<vintage>19[0-9]{2}|20[0-9]{2}) +(?P<price>[0-9]{2,4})","confidence":0.9,"fields":["vintage","price"]},',
  '{"pattern":"(?P<producer>Domaine [A-Z][a-z]+)","confidence":0.95,"fields":["producer","cuvee"],"provenance":"lwin_match"},',
  '{"pattern":"(?P<price>[0-9]+) *€","confidence":0.8,"fields":["price"],"provenance":"restaurant_rule"},',
  '{"pattern":"(?P<cuvee>[","confidence":0.9,"fields":["cuvee"]}]}') AS rules_json
FROM (SELECT DISTINCT o_custkey % 20 AS k FROM orders ) AS r WHERE k % 3 = 0
"""

#: Another source's values for texts.
SUGGESTED = """
SELECT text AS raw_text, CASE WHEN length(text) % 2 = 0 THEN upper(substr(text, 1, 5)) END AS producer, CASE WHEN length(text) % 3 = 0 THEN substr(text, 3, 4) END AS cuvee
FROM (SELECT DISTINCT text FROM lines ) AS t
"""

VIEWS = {"rulesets": RULESETS, "suggested": SUGGESTED, "lines": LINES, "catalog": CATALOG, "items": ITEMS, "aliases": ALIASES, "blocks": BLOCKS, "ocr": OCR, "files": FILES, "stored": STORED}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or one derived from them."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    needs = [t for t in (*TABLES, *VIEWS) if t != name and f" {t}" in text]
    tables = {t: table(spark, sf_dir, t) for t in needs}
    text = text.replace("{", "{{").replace("}", "}}")
    for t in needs:
        for lead in ("FROM", "JOIN"):
            text = text.replace(f"{lead} {t} ", f"{lead} {{{t}}} ").replace(f"{lead} {t}\n", f"{lead} {{{t}}}\n").replace(f"{lead} {t})", f"{lead} {{{t}}})")
    return spark.sql(text, **{t: d for t, d in tables.items() if f"{{{t}}}" in text})


def with_views(*names: str) -> str:
    """The WITH clause that defines derived tables, for SQL of other engines."""
    order: list[str] = []
    for name in names:
        if name in ("blocks", "ocr", "suggested") and "lines" not in order:
            order.append("lines")
        if name not in order:
            order.append(name)
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in order)
