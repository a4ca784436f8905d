"""Untranslated residue and stray commentary. Residue is only ever flagged; only blocks that are commentary for sure go.

Both are found inside the row of a text (higher-order functions), so neither shuffles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import HIRAGANA, JAPANESE, KANJI, QUOTES, SPACE, blank, once, script_fraction, strip, strip_format
from . import glossary
from .ranks import settled

BLANK_LINE = rf"\n[{SPACE}]*\n+"
#: Fixed value: the Japanese scripts without the middle dot, which holds kept terms together.
RUNNING = JAPANESE.replace(r"\x{30a0}-\x{30ff}", r"\x{30a1}-\x{30fa}\x{30fc}")
FINDING = "array<struct<line int, place int, run string, score int, reasons array<string>>>"


@dataclass(frozen=True)
class ResidueRules:
    """Classes and patterns by which a run of the source script is told from a kept term; weights of its signals."""

    script: str = RUNNING
    #: What the residual fraction counts.
    measured: str = JAPANESE
    glue: str = "　、。・！？，．…ー"
    edge: str = "　、。・！？，．…ー "
    # Patterns of sentence ends, predicates, particles, clauses and of what is never prose.
    hard_end: str = "[。！？.!?]"
    shape: tuple[str, str] = (f"[{KANJI}]", f"[{HIRAGANA}]")
    predicate: str = r"(?:だ|です|ます|ました|でした|である|ない|なかった|たい|ている|ていた|ていただ)\z"
    particle: str = r"[のよねわぞさぜか]\z"
    bind: str = "[をがにへ]"
    topic: str = f"[{RUNNING}][はも][{RUNNING}]"
    clause: str = "[、，]"
    blanked: tuple[str, ...] = (rf"(?:https?://|www\.)[^{SPACE}{RUNNING}、。]+", r"`[^`]*`|<[^>]{1,120}>|!?\[[^\]]*\]\([^)]*\)", rf"(?<![{RUNNING}])草+(?![{RUNNING}])")
    #: Set phrases that translations keep.
    kept: tuple[str, ...] = ("もったいない", "しょうがない", "仕方がない", "お疲れ様です", "いただきます", "ごちそうさまでした", "いってらっしゃい", "いってきます", "おかえりなさい", "ただいま", "よろしく", "おはよう", "ありがとう", "すみません", "がんばって")
    shape_chars: int = 5
    flag_at: int = 3

    def signals(self) -> list[tuple[str, int, str, bool]]:
        """(name, weight, pattern, whether on the core instead of the run); the shape is apart."""
        return [("stop", 2, self.hard_end, False), ("predicate", 2, self.predicate, True), ("bind", 1, self.bind, True), ("topic", 1, self.topic, True), ("clause", 1, self.clause, False), ("particle", 1, self.particle, True)]


def blanked(c: Column, pattern: str) -> Column:
    """Every match as spaces of its own length, so that places and lines stay."""

    def apart(c: Column) -> Column:
        parts, found = F.split(c, pattern), F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
        gaps = F.transform(found, lambda m: F.repeat(F.lit(" "), F.length(m)))
        joined = F.array_join(F.flatten(F.zip_with(parts, gaps, lambda p, g: F.array(p, F.coalesce(g, F.lit(""))))), "")
        return F.when(c.rlike(pattern), joined).otherwise(c)

    return once(c, apart)


def without_terms(c: Column, terms: Column) -> Column:
    """Every term of the array, in its order, as spaces of its length."""
    return F.aggregate(terms, c, lambda t, term: F.when(term == "", t).otherwise(F.replace(t, term, F.repeat(F.lit(" "), F.length(term)))))


def subtract(texts: DataFrame, *, text: str = "text", rules: ResidueRules = ResidueRules(), terms: DataFrame | None = None, key: list[str] | None = None, drop: bool = False) -> DataFrame:
    """Adds `clean`: the text without addresses, markup, set phrases and terms(rank, spelling). drop: the text itself goes.

    Terms need the texts' key, one row each: those that a text may hold come to it by the glossary's search (`candidates`), in
    order of rank; all others would change nothing, so what does not hold is not sorted out first. A text's spellings are replaced one after another, so a term that
    only a removed one's neighbours form is not looked for.
    """
    clean = strip_format(F.col(text))
    for pattern in rules.blanked:
        clean = blanked(clean, pattern)
    clean = without_terms(clean, F.array(*map(F.lit, rules.kept)).cast("array<string>"))
    rows = texts.withColumn("clean", clean)
    rows = rows.drop(text) if drop else rows
    if terms is None:
        return rows
    if not key:
        raise ValueError("terms are brought to texts by key")
    rows = settled(rows)  # cleaned once; the search reads it twice, the result once more
    held = glossary.candidates(rows.select(*key, "clean"), terms, key=key, text="clean", entry=["rank", "spelling"])
    own = held.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "spelling"))), lambda t: t["spelling"]).alias("__terms"))
    return rows.join(own, key, "left").withColumn("clean", without_terms(F.col("clean"), F.coalesce("__terms", F.array().cast("array<string>")))).drop("__terms")


def findings(clean: Column, rules: ResidueRules = ResidueRules()) -> Column:
    """Each run of the script that scores `flag_at` or more: line (from 1), place, run, score, reasons."""
    pattern = f"[{rules.script}][{rules.script}{rules.glue}]*"
    edge = rules.edge.replace("-", r"\-")
    a, b = rules.shape

    def judged(line: Column, place: Column, run: Column, core: Column) -> Column:
        shape = (F.length(core) >= rules.shape_chars) & core.rlike(a) & core.rlike(b)
        hits = [("shape", 2, shape)] + [(n, w, (core if on_core else run).rlike(p)) for n, w, p, on_core in rules.signals()]

        def told(hit: Column) -> Column:
            score = sum((F.when(hit[k], w).otherwise(0) for k, (_, w, _) in enumerate(hits)), F.lit(0))
            score = F.when(core == "", 0).otherwise(score)
            return F.struct((line + 1).alias("line"), place.alias("place"), strip(run).alias("run"), score.alias("score"), F.array_compact(F.array(*[F.when(hit[k], n) for k, (n, _, _) in enumerate(hits)])).alias("reasons"))

        return once(F.array(*[hit for _, _, hit in hits]), told)

    def of_line(text: Column, line: Column) -> Column:
        runs = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        cored = F.transform(runs, lambda r, k: F.struct(r.alias("run"), k.alias("place"), F.regexp_replace(r, rf"\A[{edge}]+|[{edge}]+\z", "").alias("core")))
        return F.transform(cored, lambda c: judged(line, c["place"], c["run"], c["core"]))

    every = F.flatten(F.transform(F.split(clean, "\n"), of_line))
    some = F.filter(every, lambda f: f["score"] >= rules.flag_at)
    return F.when(clean.rlike(f"[{rules.script}]"), some).otherwise(F.array().cast(FINDING))


def reported(clean: DataFrame, rules: ResidueRules = ResidueRules()) -> DataFrame:
    """Adds found (array of findings), findings (their number), flagged, worst and worst_line (the first of the highest score), residual_fraction."""
    rows = clean.withColumn("found", F.coalesce(findings(F.col("clean"), rules), F.array().cast(FINDING)))
    worst = F.array_max(F.transform("found", lambda f: F.struct(f["score"].alias("score"), (-f["line"]).alias("l"), (-f["place"]).alias("p"), f["run"].alias("run"))))
    rows = rows.withColumns({"__worst": worst, "residual_fraction": F.bround(script_fraction(F.col("clean"), rules.measured), 4)})
    return rows.withColumns({"findings": F.size("found").cast("long"), "flagged": F.size("found") > 0, "worst": F.col("__worst.run"), "worst_line": -F.col("__worst.l")}).drop("__worst")


def report(clean: DataFrame, *, key: list[str], rules: ResidueRules = ResidueRules()) -> tuple[DataFrame, DataFrame]:
    """(findings: key, line, place, run, score, reasons; per text: findings, flagged, worst, worst_line, residual_fraction)."""
    rows = reported(clean, rules)
    # an inner explode would work out all findings once more, to drop texts without any
    each = rows.select(*key, F.explode_outer("found").alias("f")).filter("f is not null")
    return each.select(*key, "f.*"), rows.select(*key, "residual_fraction", "findings", "worst", "worst_line", "flagged")


# The words of announcements. Only these may stand between a promise and its verb; whatever else does is prose.
SOON = r"just|now|simply|go\s+ahead\s+and"
PROMISE = r"i'?ll|i\s+will|let\s+me|let'?s"
WHOSE = r"the|this|your|my|a"
HOW_MUCH = r"full|whole|entire|rest\s+of\s+the"
WHAT = r"translat\w*|chapter|text|passage|version|content|section|following"
ANNOUNCEMENTS = (
    r"\blet'?s?\s+re-?do\b",
    rf"\blet\s+me\s+(?:(?:{SOON}|carefully)\s+)?(?:re-?do|re-?read|re-?translate|rewrite|start\s+over)\b",
    rf"\b(?:{PROMISE})\s+(?:(?:{SOON})\s+)?(?:translate|render|produce|provide|rewrite|give\s+you)\s+(?:(?:{WHOSE})\s+)?(?:(?:{HOW_MUCH})\s+)?(?:{WHAT})\b",
    rf"\A\s*(?:{PROMISE})\s+(?:(?:{SOON})\s+)?(?:translate|render)\s*[.!?…]?\s*\z",
    rf"\bhere(?:\s+is|'?s)\s+(?:(?:the|your|my)\s+)?translat",
    r"\bbelow\s+is\s+the\s+translat",
    r"\bthe\s+translation\s+(?:is\s+(?:as\s+follows|below)|follows|begins)",
    r"\btranslated\s+chapter\s*:",
)
# Notation that prose never has, and phrases that it may have.
NOTATION = (r"===\s*new_terms", r"\bas an ai\b", r"translator'?s?\ note\b")
PHRASES = (r"\bglossary\b", r"the narrator(?: here)? is", r"the (?:original|source) japanese\b", r"i'?ll use the (?:spelling|reading)", r"re-?reading the (?:chapter|source|glossary|names?|passage)", r"romaniz(?:e|ed|ing|ation)")


@dataclass(frozen=True)
class ChatterRules:
    """Notation never stands in prose; phrases may; announcements speak about the task itself."""

    notation: str = "(?iU)" + "|".join(NOTATION)
    phrases: str = "(?iU)" + "|".join(PHRASES)
    announcement: str = "(?iU)" + "|".join(ANNOUNCEMENTS)
    rule: str = r"(?U)\A\s*(?:[-*_]\s*){3,}\z"
    quotes: str = QUOTES
    substantial: int = 25


def _sentences(block: Column) -> Column:
    return F.split(F.regexp_replace(block, rf"([.!?。！？])[{SPACE}]+", "$1\x01"), "\x01")


def verdict(b: Column, rules: ChatterRules = ChatterRules()) -> Column:
    """keep, remove, or report (kept, but a reviewer should look)."""
    notation = b.rlike(rules.notation) | b.rlike(rules.rule)
    phrase, said = b.rlike(rules.phrases), b.rlike(rules.announcement)
    clean = F.filter(_sentences(b), lambda s: ~(s.rlike(rules.announcement) | s.rlike(rules.notation) | s.rlike(rules.phrases)))
    prose = F.aggregate(clean, F.lit(0), lambda n, s: n + F.length(strip(s)))
    meta = notation | phrase | (said & ~b.rlike(f"[{rules.quotes}]"))
    return F.when(~meta, "keep").when(notation, "remove").when(phrase & ~said, "report").when(prose >= rules.substantial, "report").otherwise("remove")


def judged_blocks(text: Column, rules: ChatterRules = ChatterRules(), between: str = BLANK_LINE) -> Column:
    """The blocks that are not blank, in order: struct(place, block, verdict)."""
    blocks = F.transform(F.split(F.coalesce(text, F.lit("")), between), lambda b, k: F.struct(k.alias("place"), b.alias("block")))
    return F.transform(F.filter(blocks, lambda x: ~blank(x["block"])), lambda x: F.struct(x["place"].alias("place"), x["block"].alias("block"), verdict(x["block"], rules).alias("verdict")))


def judge_blocks(texts: DataFrame, *, key: list[str], text: str = "text", rules: ChatterRules = ChatterRules(), between: str = BLANK_LINE) -> DataFrame:
    """A row for each block that is not blank: place, block, verdict."""
    return texts.select(*key, F.explode(judged_blocks(F.col(text), rules, between)).alias("b")).select(*key, "b.*")


def strip_chatter(texts: DataFrame, *, key: list[str], text: str = "text", rules: ChatterRules = ChatterRules(), between: str = BLANK_LINE, glue: str = "\n\n") -> DataFrame:
    """Per text: clean (kept blocks in order), removed and suspicious (arrays)."""
    rows = texts.select(*key, judged_blocks(F.col(text), rules, between).alias("__b"))

    def of(*verdicts: str) -> Column:
        return F.transform(F.filter("__b", lambda x: x["verdict"].isin(*verdicts)), lambda x: x["block"])

    return rows.select(*key, F.array_join(of("keep", "report"), glue).alias("clean"), F.transform(of("remove"), lambda b: strip(b)).alias("removed"), F.transform(of("report"), lambda b: strip(b)).alias("suspicious"))
