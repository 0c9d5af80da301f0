"""Field extraction by rules: an owner's rules as data, global patterns, inherited context."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.confidence import field_confidence, row_confidence
from ..functions.text import any_match, normalize_text, rx
from .dialect import translated
from .lineage import saved, tasks
from .metric_index import tiles

STATE = "struct<value:string,confidence:double,origin:string>"
CANDIDATE = "struct<value:string,floor:double,confidence:double,origin:string>"
INHERITED = {"section_header": ("section_inherit", ["region", "country", "type"]), "sub_section": ("subsection_inherit", ["subregion", "grape_variety"])}
RULES = "struct<extraction_rules:array<struct<pattern:string,confidence:double,fields:array<string>,provenance:string>>>"


def explode_rulesets(rulesets: DataFrame) -> DataFrame:
    """``(restaurant_id, rule_pos, pattern, confidence, fields, provenance)`` of rulesets kept as JSON."""
    rules = rulesets.select("restaurant_id", F.posexplode_outer(F.from_json("rules_json", RULES)["extraction_rules"]).alias("rule_pos", "r")).where("r is not null")
    return rules.select("restaurant_id", "rule_pos", "r.pattern", "r.confidence", "r.fields", "r.provenance")


def check_rules(rules: DataFrame) -> DataFrame:
    """``rules`` plus ``valid``, ``java_pattern`` with plain groups, ``groups``, name to number, and ``needs``, literals one of which a match holds.

    Rules are few and short, so this is the one place where they go through Python. What is written there is compiled inside the JVM before any use, so
    no rule stops a job: one that does not parse, or does not compile, is not valid.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            known = {p: translated(p) for p in set(f["pattern"])}  # files' rules are much alike
            out = [known[p] for p in f["pattern"]]
            yield f.assign(java_pattern=[o and o.java for o in out], groups=[o.groups if o else {} for o in out], needs=[o.needs if o else [] for o in out])

    shape = ", ".join(f"`{n}` {t}" for n, t in rules.dtypes)
    more = rules.mapInPandas(run, f"{shape}, java_pattern string, groups map<string,int>, needs array<string>")
    return more.withColumn("valid", F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col("java_pattern")).isNotNull() & F.col("java_pattern").isNotNull())


def automaton(rules: list[tuple[int, list[str]]]) -> tuple[ahocorasick.Automaton | None, list[int]]:
    """An automaton from literals to the rules, by number, that need one of them, and the rules that need none."""
    always, named = [i for i, needs in rules if not needs], {}
    for i, needs in rules:
        for literal in needs:
            named.setdefault(literal, []).append(i)
    if not named:
        return None, always
    out = ahocorasick.Automaton()
    for literal, own in named.items():
        out.add_word(literal, own)
    out.make_automaton()
    return out, always


def tried(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """``texts(owner, text_id, text)`` with the valid ``rules(owner, rule_pos, java_pattern, needs)`` that may match: ``(owner, text_id, text, rule_pos, java_pattern)``.

    The literals that an owner's rules need are one automaton, run over each of the owner's texts once; a rule is tried where one of its literals
    stands, or where it needs none. An owner with many texts or rules is many tasks, and many small owners are one call.
    """

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        own: dict[str, list[tuple[int, list[str]]]] = {}
        for i, (owner, needs) in enumerate(zip(b["owner"].to_pylist(), b["needs"].to_pylist(), strict=True)):
            own.setdefault(owner, []).append((i, needs))
        ready = {owner: automaton(some) for owner, some in own.items()}
        row, rule = [], []
        for i, (owner, text) in enumerate(zip(a["owner"].to_pylist(), a["text"].to_pylist(), strict=True)):
            if owner not in ready:
                continue
            words, always = ready[owner]
            hit = set(always)
            if text and words:
                for _, found in words.iter(text):
                    hit.update(found)
            row += [i] * len(hit)
            rule += sorted(hit)
        return pa.table({c: a[c].take(pa.array(row, pa.int64())) for c in ("owner", "text_id", "text")} | {c: b[c].take(pa.array(rule, pa.int64())) for c in ("rule_pos", "java_pattern")})

    bucket = F.pmod(F.xxhash64("owner"), F.lit(64 * tasks(texts.sparkSession))).alias("bucket")
    texts, rules = (df.where("owner is not null").select(bucket, "owner", *c) for df, c in ((texts, ("text_id", "text")), (rules, ("rule_pos", "java_pattern", "needs"))))
    kinds = {f.name: f.dataType.simpleString() for f in [*texts.schema, *rules.schema]}
    return tiles(texts, rules, ["bucket"], "text_id", "java_pattern", tile, ", ".join(f"{c} {kinds[c]}" for c in ("owner", "text_id", "text", "rule_pos", "java_pattern")))


def owner_candidates(entries: DataFrame, rules: DataFrame, key: str) -> DataFrame:
    """``(entry_id, owner)``: for each entry a map from field to the state that the owner's last matching rule gives.

    Rules are joined on the owner; a pattern is data, applied row by row inside the JVM, to the entries that its literals name.
    """
    good = saved(check_rules(rules.where(F.col(key).isNotNull())).where("valid").withColumn("owner", F.col(key)), "rules")
    fields = good.select("owner", "rule_pos", "java_pattern", "confidence", "provenance", "groups", F.explode(F.array_distinct("fields")).alias("field"))
    fields = fields.select("*", F.try_element_at("groups", F.col("field")).alias("number")).where("number is not null").drop("groups")
    hits = tried(entries.select(F.col(key).alias("owner"), F.col("entry_id").alias("text_id"), "text"), good).join(fields, ["owner", "rule_pos", "java_pattern"])
    hits = hits.withColumnRenamed("text_id", "entry_id").withColumn("value", F.expr("regexp_extract(text, java_pattern, number)")).where("value <> ''")
    origin, base = F.coalesce("provenance", F.lit("restaurant_rule")), F.coalesce("confidence", F.lit(0.8))
    hits = hits.withColumn("state", F.struct("value", field_confidence(F.col("field"), F.col("value"), origin, base).alias("confidence"), origin.alias("origin")))
    last = hits.groupBy("entry_id", "field").agg(F.max_by("state", "rule_pos").alias("state"))
    return last.groupBy("entry_id").agg(F.map_from_entries(F.collect_list(F.struct("field", "state"))).alias("owner"))


def last_value(rules: DataFrame, texts: DataFrame) -> DataFrame:
    """Every rule's value in every text of its owner, one field a rule: the named group or else the whole match, trimmed; later rules win.

    ``rules(owner, rule_pos, field, pattern, confidence)``, ``texts(owner, text_id, text)`` to ``(text_id, field, value, confidence)``.
    """
    good = saved(check_rules(rules).where("valid").withColumn("number", F.coalesce(F.try_element_at("groups", F.col("field")), F.lit(0))), "rules")
    hits = tried(texts, good).join(good.select("owner", "rule_pos", "java_pattern", "field", "confidence", "number"), ["owner", "rule_pos", "java_pattern"])
    hits = hits.where(F.expr("text rlike java_pattern")).withColumn("value", F.trim(F.expr("regexp_extract(text, java_pattern, number)")))
    hits = hits.withColumn("state", F.struct("value", F.coalesce("confidence", F.lit(0.8)).alias("confidence")))
    return hits.groupBy("text_id", "field").agg(F.max_by("state", "rule_pos").alias("state")).select("text_id", "field", "state.value", "state.confidence")


def candidate(value: Column, floor: float, confidence: Column, origin: str) -> Column:
    return F.when(value.isNotNull() & (value != ""), F.struct(value.alias("value"), F.lit(floor).alias("floor"), confidence.alias("confidence"), F.lit(origin).alias("origin")))


def candidates(field: str, text: Column, groups: str) -> Column:
    """What each pattern in order would set the field to, of those that say something."""
    out = [F.lit(None).cast(CANDIDATE)]
    for i, (_, base, fields) in enumerate(C.ENTRY_RULES):
        for j, f in enumerate(fields):
            if f == field:
                value = F.col(groups)[i][j]
                out.append(candidate(value, base, field_confidence(field, value, "global_rule", F.lit(base)), "global_rule"))
    for f, pattern, base in C.FIELD_RULES:
        if f == field:
            value = F.regexp_extract(text, rx(pattern), 1)
            out.append(candidate(value, base, field_confidence(field, value, "field_pattern_match", F.lit(base)), "field_pattern_match"))
    return F.filter(F.array(*out), lambda c: c.isNotNull())


def inherited(field: str, columns: list[str]) -> list[Column]:
    """What each heading would set the field to; null where it says nothing."""
    return [candidate(F.col(c), 0.7, F.lit(0.7), INHERITED[c][0]) for c in columns if field in INHERITED[c][1]]


def said_of(entries: DataFrame) -> DataFrame:
    """``(_raw, text, _said)``: each distinct raw text, normalised, and by field what the patterns find in it. Lists repeat their texts, and patterns are most of a parse's work."""
    spark = entries.sparkSession
    df = entries.select(F.col("raw_text").alias("_raw")).distinct().repartition(tasks(spark), "_raw").withColumn("text", normalize_text(F.col("_raw")))
    df = df.withColumn("_groups", F.array(*[all_groups(F.col("text"), p, len(fields)) for p, _, fields in C.ENTRY_RULES]))
    return df.select("_raw", "text", F.struct(*[candidates(f, F.col("text"), "_groups").alias(f) for f in C.FIELD_WEIGHTS]).alias("_said"))


def all_groups(text: Column, pattern: str, n: int) -> Column:
    """The groups of the first match, or null: one replacement instead of a search for each group. Texts without what every match has are spared it."""
    mark = "\x01"
    got = F.regexp_replace(text, rx(rf"(?s)^.*?{pattern}.*$"), mark.join(f"${j + 1}" for j in range(n)))
    sign = any_match(text, ["Château|Domaine|Estate"]) if pattern.startswith("(Château") else F.contains(text, F.lit(","))
    return F.when(sign & F.contains(got, F.lit(mark)), F.split(got, mark, -1))


def settled(owner: Column | None, said: Column, more: list[Column]) -> Column:
    """The state after all candidates, ``said`` and then ``more``: one is taken if nothing is set or what is set has less confidence than its rule."""
    start = owner if owner is not None else F.lit(None).cast(STATE)
    if more:
        said = F.concat(said, F.filter(F.array(*more), lambda c: c.isNotNull()))
    take = lambda c: F.struct(c["value"].alias("value"), c["confidence"].alias("confidence"), c["origin"].alias("origin"))
    return F.aggregate(said, start, lambda s, c: F.when(s.isNull() | (s["confidence"] < c["floor"]), take(c)).otherwise(s))


def extract_fields(entries: DataFrame, rules: DataFrame | None = None, key: str = "restaurant_id") -> DataFrame:
    """``entries(entry_id, raw_text, ...)`` plus one column for each field, the maps of confidences and origins, row confidence and review flag.

    ``rules`` has ``key``, ``rule_pos``, ``pattern``, ``confidence``, ``fields`` and ``provenance``. Rows inherit from
    ``section_header`` and ``sub_section`` where they have these columns.
    """
    entries = saved(entries, "entries")  # read for its texts and for its rows
    df = entries.drop("text").join(said_of(entries), F.col("raw_text").eqNullSafe(F.col("_raw"))).drop("_raw")
    inherit = [c for c in INHERITED if c in df.columns]
    if rules is not None:
        df = df.join(owner_candidates(df, rules, key), "entry_id", "left")
    states = {f: settled(F.try_element_at("owner", F.lit(f)) if rules is not None else None, F.col(f"_said.{f}"), inherited(f, inherit)) for f in C.FIELD_WEIGHTS}
    found = F.filter(F.array(*[F.struct(F.lit(f).alias("field"), s.alias("s")) for f, s in states.items()]), lambda x: x["s"].isNotNull())
    # made by a generator, so that a filter on a field is not pushed below it and does not run all patterns again
    df = df.select("*", F.explode_outer(F.array(found)).alias("_state"))
    df = df.withColumns({
        "fields": F.map_from_entries(F.transform("_state", lambda x: F.struct(x["field"], x["s"]["value"]))),
        "field_confidence": F.map_from_entries(F.transform("_state", lambda x: F.struct(x["field"], x["s"]["confidence"]))),
        "provenance": F.map_from_entries(F.transform("_state", lambda x: F.struct(x["field"], x["s"]["origin"]))),
    })
    df = df.withColumn("row_confidence", row_confidence(F.col("field_confidence"))).withColumn("needs_review", F.col("row_confidence") < C.REVIEW_BELOW)
    return df.drop("_said", "_state", "owner")


def result_rows(extracted: DataFrame) -> DataFrame:
    """Flat rows: the fields as columns, headings under their result names, maps and flags."""
    names = {"section": "section_header", "sub_section": "subheader", "sub_sub_section": "sub_subheader"}
    heads = [F.col(a).alias(b) for a, b in names.items() if a in extracted.columns]
    fields = [F.try_element_at("fields", F.lit(f)).alias(f) for f in C.FIELD_WEIGHTS]
    return extracted.select("entry_id", "file_id", "restaurant_id", *fields, *heads, "raw_text", "field_confidence", "provenance", "row_confidence", "needs_review")
