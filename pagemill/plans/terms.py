"""Glossary queries; entries are made from words of `benchmark`, texts from `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import glossary
from ..operators.ranks import numbered
from .registry import query, table

KINDS = ("person", "place", "thing", "title")


def entries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry for each passage: its opening words as source and variants."""
    words = F.split("text", " ")
    rows = table(spark, sf_dir, "benchmark").filter("item_id % 3 <> 2")
    return rows.select(
        "item_id",
        F.when(F.col("item_id") % 7 == 6, "").otherwise(F.array_join(F.slice(words, 1, 4), " ")).alias("source"),
        F.concat(F.lit("Name "), F.element_at(words, 2), F.lit(" "), F.element_at(words, 3), F.lit(" "), (F.col("item_id") % 50).cast("string")).alias("english"),
        F.array(F.array_join(F.slice(words, 5, 2), " "), F.lit("")).alias("variants"),
        F.element_at(F.array(*map(F.lit, KINDS)), (F.col("item_id") % 4 + 1).cast("int")).alias("type"),
        F.when(F.col("item_id") % 5 == 0, F.array_join(F.slice(words, 1, 4), " ")).otherwise("").alias("reading"),
        F.when(F.col("item_id") % 4 == 0, "it").otherwise("she").alias("pronoun"),
    )


ENTRIES_SQL = f"""
words AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
named AS (
  SELECT item_id, CASE WHEN item_id % 7 = 6 THEN '' ELSE array_to_string(w[1:4], ' ') END AS source, 'Name ' || w[2] || ' ' || w[3] || ' ' || (item_id % 50) AS english,
    [array_to_string(w[5:6], ' '), ''] AS variants, {list(KINDS)}[item_id % 4 + 1] AS type, CASE WHEN item_id % 5 = 0 THEN array_to_string(w[1:4], ' ') ELSE '' END AS reading
  FROM words
), entries AS (SELECT * FROM named WHERE item_id % 3 <> 2),
spelled AS (
  SELECT item_id, source, spelling, min(rank) AS r FROM (
    SELECT item_id, source, unnest([source] || variants || [reading]) AS spelling, generate_subscripts([source] || variants || [reading], 1) AS rank FROM entries)
  WHERE trim(spelling) <> '' GROUP BY ALL
)"""


@query(f"WITH {ENTRIES_SQL} SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY r) - 1)::INT AS rank, spelling FROM spelled")
def spellings_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.spellings(entries_of(spark, sf_dir), ["item_id"])


@query(f"WITH {ENTRIES_SQL} SELECT DISTINCT doc_id, item_id FROM documents d JOIN spelled s ON contains(d.text, s.spelling)")
def glossary_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that a text uses, by an equality join on anchors instead of a search for every pair."""
    names = glossary.spellings(entries_of(spark, sf_dir), ["item_id"]).select("item_id", "spelling")
    return glossary.relevant(table(spark, sf_dir, "documents"), names, key=["doc_id"], entry=["item_id"])


LETTERS = ("é", "ö", "ñ", "a", "y")
BOUNDARY = r"\p{L}"


@query(f"SELECT doc_id, letter FROM documents, (SELECT unnest({list(LETTERS)}) AS letter) WHERE regexp_matches(text, '(?:\\A|[^{BOUNDARY}])' || letter || '(?:[^{BOUNDARY}]|\\z)')")
def glossary_one_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-character names, only where no letter stands beside them."""
    names = spark.createDataFrame([(c, c) for c in LETTERS], "letter string, spelling string")
    return glossary.relevant(table(spark, sf_dir, "documents"), names, key=["doc_id"], entry=["letter"], boundary=BOUNDARY)


def proposed_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that responses proposed: old and new spellings, repeats, and blanks."""
    words = F.split("text", " ")
    source = F.when(F.col("item_id") % 11 == 0, " ").when(F.col("item_id") % 2 == 0, F.array_join(F.slice(words, 1, 4), " ")).otherwise(F.concat(F.element_at(words, 1), F.lit("-x")))
    english = F.concat(F.lit("NAME "), F.element_at(words, 2), F.lit(" "), F.element_at(words, 3), F.lit(" "), (F.col("item_id") % 50 + (F.col("item_id") % 3) * 7).cast("string"))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq"), source.alias("source"), english.alias("english"), F.lit("thing").alias("type"), F.when(F.col("item_id") % 4 == 1, " Female").otherwise(" She").alias("pronoun"))


PROPOSED_SQL = f"""{ENTRIES_SQL}, proposed AS (
  SELECT item_id AS seq, trim(CASE WHEN item_id % 11 = 0 THEN ' ' WHEN item_id % 2 = 0 THEN array_to_string(w[1:4], ' ') ELSE w[1] || '-x' END) AS source,
    'NAME ' || w[2] || ' ' || w[3] || ' ' || (item_id % 50 + (item_id % 3) * 7) AS english FROM words
), fresh AS (
  SELECT * FROM proposed WHERE source <> '' AND source NOT IN (SELECT spelling FROM spelled) AND source NOT IN (SELECT source FROM proposed WHERE seq % 13 = 5)
), first_entry AS (
  SELECT DISTINCT ON (lower(english)) lower(english) AS e, coalesce(nullif(source, ''), english) AS o FROM entries WHERE english <> '' ORDER BY lower(english), type, coalesce(nullif(english, ''), source)
)"""


def _admitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = proposed_of(spark, sf_dir)
    pending = rows.filter("seq % 13 = 5").select(F.trim("source").alias("source"))
    return glossary.admit(rows, pending, entries_of(spark, sf_dir))


@query(f"WITH {PROPOSED_SQL} SELECT min(seq) AS seq, source, arg_min(english, seq) AS english, 'thing' AS type, CASE WHEN min(seq) % 4 = 1 THEN '' ELSE 'she' END AS pronoun FROM fresh WHERE lower(english) NOT IN (SELECT e FROM first_entry) GROUP BY source")
def glossary_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _admitted(spark, sf_dir)[0]


@query(f"WITH {PROPOSED_SQL} SELECT source, arg_min(o, seq) AS \"of\" FROM fresh JOIN first_entry ON e = lower(english) GROUP BY source")
def glossary_new_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _admitted(spark, sf_dir)[1]


def _incoming(entries: DataFrame) -> DataFrame:
    return entries.filter("item_id % 4 = 1").withColumns({"type": F.lit("place"), "source": F.when(F.col("item_id") % 8 == 1, F.col("source")).otherwise(F.lit(""))})


INCOMING_SQL = f"""{ENTRIES_SQL}, incoming AS (SELECT item_id, CASE WHEN item_id % 8 = 1 THEN source ELSE '' END AS source, english, 'place' AS type FROM entries WHERE item_id % 4 = 1),
kept AS (
  SELECT item_id, source, english, type FROM entries WHERE source NOT IN (SELECT source FROM incoming WHERE source <> '')
    AND NOT (source = '' AND lower(english) IN (SELECT lower(english) FROM incoming WHERE source <> ''))
  UNION ALL SELECT * FROM incoming WHERE source <> ''
), merged AS (
  SELECT * FROM kept UNION ALL SELECT * FROM incoming WHERE source = '' AND lower(english) NOT IN (SELECT lower(english) FROM kept)
)"""


@query(f"WITH {INCOMING_SQL} SELECT * FROM merged")
def glossary_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = entries_of(spark, sf_dir)
    return glossary.upsert(entries, _incoming(entries)).select("item_id", "source", "english", "type")


@query(
    f"""WITH {ENTRIES_SQL}, pending AS (SELECT * FROM named WHERE item_id % 3 = 2), said AS (SELECT source, item_id FROM named WHERE source <> ''),
yes AS (SELECT source FROM said WHERE item_id % 3 = 2 AND item_id % 2 = 0), no AS (SELECT source FROM said WHERE item_id % 3 = 2 AND item_id % 4 = 1), gone AS (SELECT source FROM said WHERE item_id % 6 = 0),
approved AS (SELECT * FROM pending WHERE source IN (FROM yes)), kept AS (
  SELECT * FROM entries WHERE source NOT IN (FROM gone) AND source NOT IN (SELECT source FROM approved) AND NOT (source = '' AND lower(english) IN (SELECT lower(english) FROM approved))
  UNION ALL SELECT * FROM approved)
SELECT item_id, source, english, 'entry' AS place FROM kept UNION ALL SELECT item_id, source, english, 'pending' FROM pending WHERE source NOT IN (FROM yes) AND source NOT IN (FROM no)"""
)
def glossary_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pending terms approved, rejected and left, entries removed."""
    words = F.split("text", " ")
    entries = entries_of(spark, sf_dir)
    later = table(spark, sf_dir, "benchmark").filter("item_id % 3 = 2")
    pending = later.select(
        "item_id", F.when(F.col("item_id") % 7 == 6, "").otherwise(F.array_join(F.slice(words, 1, 4), " ")).alias("source"),
        F.concat(F.lit("Name "), F.element_at(words, 2), F.lit(" "), F.element_at(words, 3), F.lit(" "), (F.col("item_id") % 50).cast("string")).alias("english"),
        F.array(F.array_join(F.slice(words, 5, 2), " ")).alias("variants"), F.lit("thing").alias("type"), F.lit("").alias("reading"), F.lit("she").alias("pronoun"),
    )
    action = F.when(F.col("item_id") % 2 == 0, "approve").when(F.col("item_id") % 4 == 1, "reject")
    decisions = pending.select("source", action.alias("action")).unionByName(entries.filter("item_id % 6 = 0").select("source", F.lit("remove").alias("action")))
    held, left = glossary.decide(entries, pending, decisions.filter("source <> '' and action is not null").distinct())
    rows = held.withColumn("place", F.lit("entry")).select("item_id", "source", "english", "place")
    return rows.unionByName(left.withColumn("place", F.lit("pending")).select("item_id", "source", "english", "place"))


@query(
    f"""WITH {PROPOSED_SQL}, fresh_of AS (SELECT source AS v, arg_min(o, seq) AS o FROM fresh JOIN first_entry ON e = lower(english) GROUP BY source)
SELECT item_id, variants || coalesce((SELECT list(v ORDER BY v) FROM fresh_of WHERE o = coalesce(nullif(entries.source, ''), english) AND v NOT IN (SELECT unnest(variants || [entries.source, reading]))), []) AS variants FROM entries"""
)
def glossary_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spellings that answers brought for names already known, joined to their entries."""
    return glossary.add_variants(entries_of(spark, sf_dir), _admitted(spark, sf_dir)[1]).select("item_id", "variants")


@query(
    f"""WITH {ENTRIES_SQL} SELECT type AS section, row_number() OVER (PARTITION BY type ORDER BY coalesce(nullif(english, ''), source), item_id) AS place, '- **' || english || '** — ' || coalesce(sp, '(English only)') || CASE WHEN item_id % 4 = 0 THEN ' (it)' ELSE ' (she)' END AS line FROM entries LEFT JOIN (SELECT item_id, string_agg(spelling, ' / ' ORDER BY r) AS sp FROM spelled GROUP BY item_id) USING (item_id)
UNION ALL SELECT DISTINCT type, 0, '## ' || type FROM entries"""
)
def glossary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.report(entries_of(spark, sf_dir), ties=["item_id"])


@query(f"WITH {ENTRIES_SQL} SELECT item_id, row_number() OVER (ORDER BY type, coalesce(nullif(english, ''), source), item_id) AS place FROM entries")
def glossary_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries in listing order (L1)."""
    return glossary.ordered(entries_of(spark, sf_dir), ties=["item_id"]).select("item_id", "place")


@query(f"WITH {ENTRIES_SQL} SELECT item_id, row_number() OVER (ORDER BY type, english, item_id) AS place FROM entries WHERE source = '' AND english <> ''")
def glossary_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without a source, in order (L1)."""
    return glossary.canonical(entries_of(spark, sf_dir), ties=["item_id"]).select("item_id", "place")


@query(f"WITH {ENTRIES_SQL}, hits AS (SELECT DISTINCT doc_id, item_id FROM documents d JOIN spelled s ON contains(d.text, s.spelling)) SELECT doc_id, item_id, row_number() OVER (PARTITION BY doc_id ORDER BY type, source, item_id) AS place FROM hits JOIN entries USING (item_id) WHERE source <> ''")
def glossary_relevant_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries that a text uses, by type and source (L1)."""
    entries = entries_of(spark, sf_dir).filter("source <> ''")
    names = glossary.spellings(entries, ["item_id"]).select("item_id", "spelling")
    hits = glossary.relevant(table(spark, sf_dir, "documents"), names, key=["doc_id"], entry=["item_id"]).join(entries.select("item_id", "type", "source"), "item_id")
    return numbered(hits, by=["doc_id"], order=[F.col("type"), F.col("source"), F.col("item_id")]).select("doc_id", "item_id", "place")


@query("SELECT conv_id, turn, role AS speaker FROM conversations WHERE role NOT IN ('user', 'system')")
def unknown_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"))
    names = spark.createDataFrame([("user",), ("system",)], "english string")
    return glossary.unknown_speakers(lines, names).select("conv_id", "turn", "speaker")


@query(
    f"""WITH {ENTRIES_SQL}, asked AS (SELECT item_id AS asked, array_to_string(w[5:6], ' ') AS spelling FROM words UNION ALL SELECT item_id + 1000000, array_to_string(w[1:4], ' ') FROM words),
found AS (SELECT s.spelling, e.source, e.english FROM (SELECT source, spelling, min(r) AS r, any_value(type) AS type, any_value(english) AS english FROM spelled JOIN entries USING (item_id, source) GROUP BY source, spelling, type, english) s JOIN entries e USING (source, type, english)
  QUALIFY row_number() OVER (PARTITION BY s.spelling ORDER BY (e.source = s.spelling)::INT DESC, e.type, coalesce(nullif(e.english, ''), e.source), s.r) = 1)
SELECT asked, spelling, source, english FROM asked LEFT JOIN found USING (spelling)"""
)
def lookup_by_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Look-ups of entries by any spelling, a source of its own first (P16): an equality join."""
    words = F.split("text", " ")
    rows = table(spark, sf_dir, "benchmark")
    asked = rows.select(F.col("item_id").alias("asked"), F.array_join(F.slice(words, 5, 2), " ").alias("spelling"))
    asked = asked.unionByName(rows.select((F.col("item_id") + 1_000_000).alias("asked"), F.array_join(F.slice(words, 1, 4), " ").alias("spelling")))
    return glossary.get(entries_of(spark, sf_dir), asked).select("asked", "spelling", "source", "english")
