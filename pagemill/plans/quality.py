"""Residue, commentary and validation over `documents`, `pages` and `conversations`; the rules' classes are set for their languages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import leaks, validate
from .corpus import ACCENTED, NONSPACE, PARAS, STRIP
from .registry import query, table
from .terms import ENTRIES_SQL, entries_of
from ..operators import glossary

LINE = r"\n"
RESIDUE = leaks.ResidueRules(
    script=ACCENTED, measured=ACCENTED, glue="a-z .,", edge=" .,", hard_end=r"[.!?]", shape=("[éèöü]", "[a-z]"), predicate=r"(?:en|er|ment|ción)\z", particle=r"[es]\z",
    bind="[ñç]", topic="[a-z]ä[a-z]", clause=",", blanked=(r"https?://[^ \n]+|[a-z]+\.[0-9]+@[a-z0-9.]+", r"<[^>\n]{1,120}>|\$\$\$|%%%"), kept=("réêen", "einer"), flag_at=4,
)


def _blank_sql(x: str, pattern: str) -> str:
    p = pattern.replace("'", "''")
    return f"(SELECT string_agg(a || repeat(' ', coalesce(length(b), 0)), '' ORDER BY i) FROM (SELECT unnest(pa) AS a, unnest(pb) AS b, generate_subscripts(pa, 1) AS i FROM (SELECT string_split_regex({x}, '{p}') AS pa, regexp_extract_all({x}, '{p}') || [NULL] AS pb)))"


_CLEAN = "regexp_replace(coalesce(%s, ''), '[" + T.FORMAT + "]', '', 'g')"


def clean_sql(source: str, key: str, text: str, terms: str | None = None, rules: leaks.ResidueRules = RESIDUE) -> str:
    """The cleaning as CTEs; the first two patterns only (a third would need to look behind)."""
    fold = "list_reduce([c2] || {t}, lambda a, t: replace(a, t, repeat(' ', length(t))))"
    kept = list(rules.kept)
    out = f"""c0 AS (SELECT {key}, {_CLEAN % text} AS t FROM {source}),
c1 AS (SELECT {key}, {_blank_sql('t', rules.blanked[0])} AS c1 FROM c0), c2 AS (SELECT {key}, {_blank_sql('c1', rules.blanked[1])} AS c2 FROM c1),
cleaned AS (SELECT {key}, {fold.format(t=kept if terms is None else f'{kept} || (SELECT list(spelling ORDER BY rank, spelling) FROM {terms})')} AS clean FROM c2)"""
    return out


def _case(name: str, weight: int, cond: str) -> str:
    return f"CASE WHEN {cond} THEN {weight} ELSE 0 END"


def run_sql(key: str, rules: leaks.ResidueRules = RESIDUE) -> str:
    a, b = rules.shape
    signals = " + ".join(_case(n, w, f"regexp_matches({'core' if c else 'run'}, '{p}')") for n, w, p, c in rules.signals())
    return f"""lined AS (SELECT {key}, unnest(string_split(clean, chr(10))) AS l, generate_subscripts(string_split(clean, chr(10)), 1) AS line FROM cleaned),
ran AS (SELECT {key}, line::INT AS line, unnest(rs) AS run, (generate_subscripts(rs, 1) - 1)::INT AS place FROM (SELECT *, regexp_extract_all(l, '[{rules.script}][{rules.script}{rules.glue}]*') AS rs FROM lined)),
cored AS (SELECT *, regexp_replace(run, '\\A[{rules.edge}]+|[{rules.edge}]+\\z', '', 'g') AS core FROM ran),
scored AS (
  SELECT *, (CASE WHEN length(core) >= {rules.shape_chars} AND regexp_matches(core, '{a}') AND regexp_matches(core, '{b}') THEN 2 ELSE 0 END + {signals})::INT AS score FROM cored WHERE core <> ''
)"""


RUN_SQL = run_sql("%(key)s").replace("%", "%%").replace("%%(key)s", "%(key)s")


def _clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.subtract(table(spark, sf_dir, "documents").select("doc_id", "text"), rules=RESIDUE)


TERMS_SQL = f"{ENTRIES_SQL}, terms AS (SELECT spelling, min(item_id * 100 + r - 1) AS rank FROM spelled GROUP BY spelling)"


@query(f"WITH {TERMS_SQL}, {clean_sql('documents', 'doc_id', 'text', 'terms')} SELECT doc_id, sha256(clean) AS clean_sha256, length(clean) AS n FROM cleaned")
def allow_list_subtract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without addresses, markup, set phrases and every glossary spelling, in order."""
    names = glossary.spellings(entries_of(spark, sf_dir), ["item_id"]).groupBy("spelling").agg(F.min(F.col("item_id") * 100 + F.col("rank")).alias("rank"))
    clean = leaks.subtract(table(spark, sf_dir, "documents").select("doc_id", "text"), rules=RESIDUE, terms=names, key=["doc_id"], drop=True)
    return clean.select("doc_id", F.sha2("clean", 256).alias("clean_sha256"), F.length("clean").cast("long").alias("n"))


@query(f"WITH {clean_sql('documents', 'doc_id', 'text')}, {RUN_SQL % {'key': 'doc_id'}} SELECT doc_id, line, place, {STRIP % 'run'} AS run, score FROM scored WHERE score >= {RESIDUE.flag_at}")
def leak_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.report(_clean_documents(spark, sf_dir), key=["doc_id"], rules=RESIDUE)[0].drop("reasons")


def report_sql(key: str, rules: leaks.ResidueRules = RESIDUE) -> str:
    return f"""{run_sql(key, rules)}, found AS (SELECT * FROM scored WHERE score >= {rules.flag_at}),
reported AS (
  SELECT {key}, round_even(CASE WHEN {NONSPACE % 'clean'} = 0 THEN 0 ELSE len(regexp_extract_all(clean, '[{rules.measured}]')) / {NONSPACE % 'clean'} END, 4) AS residual_fraction,
    coalesce(n, 0) AS findings, coalesce(n, 0) > 0 AS flagged, worst, worst_line
  FROM cleaned LEFT JOIN (SELECT {key}, count(*) AS n, first({STRIP % 'run'} ORDER BY score DESC, line, place) AS worst, first(line ORDER BY score DESC, line, place) AS worst_line FROM found GROUP BY ALL) USING ({key})
)"""


REPORT_SQL = report_sql("%(key)s").replace("%", "%%").replace("%%(key)s", "%(key)s")


@query(f"WITH {clean_sql('documents', 'doc_id', 'text')}, {REPORT_SQL % {'key': 'doc_id'}} SELECT * FROM reported")
def leak_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.report(_clean_documents(spark, sf_dir), key=["doc_id"], rules=RESIDUE)[1]


CHATTER = leaks.ChatterRules(notation=r"%%%|###", phrases=r"(?:\A|[ ,.])(?:[Tt]hat|die|elle)(?:[ ,.]|\z)", announcement=r"(?:\A| )(?:[Tt]his|den|est|esos)(?: |,|\.)", rule=r"\A[ ]*(?:[\-*_][ ]*){3,}\z", quotes='"', substantial=25)
_SENT = f"string_split(regexp_replace(b, '([.!?。！？])[{T.SPACE}]+', '\\1' || chr(1), 'g'), chr(1))"


def verdict_sql(source: str, key: str, text: str, c: leaks.ChatterRules = CHATTER, quotes: str = '"') -> str:
    c = leaks.ChatterRules(**{n: getattr(c, n).replace("(?iU)", "(?i)").replace("(?U)", "").replace("'", "''") for n in ("notation", "phrases", "announcement", "rule")}, substantial=c.substantial)
    return f"""split AS (SELECT {key}, unnest(string_split(coalesce({text}, ''), chr(10))) AS b, generate_subscripts(string_split(coalesce({text}, ''), chr(10)), 1) - 1 AS place FROM {source}),
judged AS (
  SELECT {key}, place, b, CASE WHEN NOT (notation OR phrase OR (said AND NOT regexp_matches(b, '[{quotes}]'))) THEN 'keep' WHEN notation THEN 'remove' WHEN phrase AND NOT said THEN 'report' WHEN prose >= {c.substantial} THEN 'report' ELSE 'remove' END AS verdict
  FROM (
    SELECT *, regexp_matches(b, '{c.notation}') OR regexp_matches(b, '{c.rule}') AS notation, regexp_matches(b, '{c.phrases}') AS phrase, regexp_matches(b, '{c.announcement}') AS said,
      coalesce(list_sum(list_transform(list_filter({_SENT}, lambda s: NOT (regexp_matches(s, '{c.announcement}') OR regexp_matches(s, '{c.notation}') OR regexp_matches(s, '{c.phrases}'))), lambda s: length({STRIP % 's'}))), 0) AS prose
    FROM split WHERE regexp_matches(b, '[^{T.SPACE}]'))
)"""


@query(f"WITH {verdict_sql('documents', 'doc_id', 'text')} SELECT doc_id, coalesce(string_agg(b, chr(10) ORDER BY place) FILTER (verdict <> 'remove'), '') AS clean, count(*) FILTER (verdict = 'remove') AS removed, count(*) FILTER (verdict = 'report') AS suspicious FROM judged GROUP BY doc_id")
def chatter_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").filter(~T.blank(F.col("text")))
    found = leaks.strip_chatter(texts, key=["doc_id"], rules=CHATTER, between=LINE, glue="\n")
    return found.select("doc_id", "clean", F.size("removed").cast("long").alias("removed"), F.size("suspicious").cast("long").alias("suspicious"))


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn as source, the assistant's answer as output."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("source"), F.lead("role").over(w).alias("next"), F.lead("text").over(w).alias("output"))
    return rows.filter("role = 'user' and next = 'assistant'").select("conv_id", "turn", "source", "output")


RULES = validate.PairRules(ratio=(0.5, 2.0), paragraphs_off=2, dialogue_off=3, wholesale=0.10)


def _side(name: str) -> str:
    p = PARAS % name
    return f"len({p})::BIGINT AS {name}_paragraph_count, len(list_filter({p}, lambda p: regexp_matches(p, '[{T.QUOTES}]')))::BIGINT AS {name}_dialogue_count, {NONSPACE % f'array_to_string({p}, chr(10))'}::BIGINT AS {name}_char_count"


def pairs_sql(p: str = "p") -> str:
    """CTEs from p(k, conv_id, turn, source, output) to f: measures, failures and what warnings are made of."""
    return f"""m AS (SELECT k, conv_id, turn, output, {_side('source')}, {_side('output')}, round_even(CASE WHEN {NONSPACE % 'output'} = 0 THEN 0 ELSE len(regexp_extract_all(output, '[{RESIDUE.measured}]')) / {NONSPACE % 'output'} END, 4) AS output_source_fraction FROM {p}),
{clean_sql(p, 'k', 'output')}, {REPORT_SQL % {'key': 'k'}}, {verdict_sql(p, 'k', 'output')},
v AS (SELECT k, count(*) FILTER (verdict = 'remove') AS removed, count(*) FILTER (verdict = 'report') AS suspicious FROM judged GROUP BY k),
j AS (SELECT m.*, residual_fraction, flagged, findings, coalesce(removed, 0) AS removed, coalesce(suspicious, 0) AS suspicious, CASE WHEN source_char_count > 0 THEN output_char_count / source_char_count ELSE 0 END AS ratio FROM m JOIN reported USING (k) LEFT JOIN v USING (k)),
f AS (SELECT *, source_char_count > 0 AND (ratio < 0.5 OR ratio > 2.0) AS off,
  list_filter([CASE WHEN suspicious > 0 THEN 'commentary' END, CASE WHEN residual_fraction > 0.1 THEN 'wholesale' WHEN flagged THEN 'residue' END,
    CASE WHEN abs(output_paragraph_count - source_paragraph_count) > greatest(2, round_even(source_paragraph_count * 0.05, 0)) THEN 'paragraphs' END], lambda x: x IS NOT NULL) AS failures FROM j)"""


@query(
    f"""WITH turns AS (SELECT conv_id, turn, role, text AS source, lead(role) OVER w AS nxt, lead(text) OVER w AS output FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id * 1000 + turn AS k, conv_id, turn, source, output FROM turns WHERE role = 'user' AND nxt = 'assistant'), {pairs_sql()}
SELECT conv_id, turn, source_paragraph_count, source_dialogue_count, source_char_count, output_paragraph_count, output_dialogue_count, output_char_count, residual_fraction, output_source_fraction, findings, round(ratio, 3) AS length_ratio, failures,
  list_filter([CASE WHEN removed > 0 THEN 'removed' END, CASE WHEN source_char_count = 0 THEN 'uncounted' END, CASE WHEN off THEN 'ratio' END, CASE WHEN abs(output_dialogue_count - source_dialogue_count) > 3 THEN 'dialogue' END,
    CASE WHEN regexp_matches(output, '{T.ELLIPSIS_RUN}') THEN 'ellipsis-dots' END, CASE WHEN contains(output, '…') THEN 'ellipsis-character' END, CASE WHEN regexp_matches(output, '[「」『』]') THEN 'corner-quotes' END,
    CASE WHEN output_dialogue_count > 0 AND contains(output, '"') AND NOT regexp_matches(output, '[“”]') THEN 'straight-quotes' END], lambda x: x IS NOT NULL) AS warnings, len(failures) = 0 AS ok FROM f"""
)
def validate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validate.pairs(turn_pairs(spark, sf_dir), key=["conv_id", "turn"], script=ACCENTED, residue=RESIDUE, chatter=CHATTER, rules=RULES, between=LINE)
    return found.withColumn("findings", F.size("findings").cast("long"))


@query(
    f"""SELECT doc_id, list_filter([CASE WHEN regexp_matches(t, '{T.ELLIPSIS_RUN}') THEN 'ellipsis-dots' END, CASE WHEN contains(t, '…') THEN 'ellipsis-character' END,
  CASE WHEN regexp_matches(t, '[「」『』]') THEN 'corner-quotes' END, CASE WHEN contains(t, '"') AND NOT regexp_matches(t, '[“”]') THEN 'straight-quotes' END], lambda x: x IS NOT NULL) AS warnings
FROM (SELECT doc_id, replace(replace(text, 'ent', '..'), 'ou.', '…') AS t FROM documents)"""
)
def surface_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(F.replace("text", F.lit("ent"), F.lit("..")), F.lit("ou."), F.lit("…"))
    return table(spark, sf_dir, "documents").select("doc_id", validate.surface_warnings(text, F.lit(1)).alias("warnings"))
