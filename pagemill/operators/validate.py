"""A translation held against its source."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ELLIPSIS_RUN, script_fraction
from . import leaks
from .metrics import measures
from .segment import paragraphs


@dataclass(frozen=True)
class PairRules:
    ratio: tuple[float, float] = (1.6, 3.2)
    ratio_fails: bool = False
    paragraphs_off: int = 2
    paragraphs_share: float = 0.05
    dialogue_off: int = 3
    wholesale: float = 0.10


def surface_warnings(text: Column, dialogue: Column) -> Column:
    """Breaches of writing conventions, as an array of names."""
    straight = (dialogue > 0) & text.contains('"') & ~text.rlike("[“”]")
    checks = {"ellipsis-dots": text.rlike(ELLIPSIS_RUN), "ellipsis-character": text.contains("…"), "corner-quotes": text.rlike("[「」『』]"), "straight-quotes": straight}
    return F.array_compact(F.array(*[F.when(hit, name) for name, hit in checks.items()]))


def _is(value: str) -> Callable[[Column], Column]:
    return lambda x: x == value


def pairs(rows: DataFrame, *, key: list[str], script: str, residue: leaks.ResidueRules = leaks.ResidueRules(), chatter: leaks.ChatterRules = leaks.ChatterRules(), rules: PairRules = PairRules(), between: str = leaks.BLANK_LINE, terms: DataFrame | None = None) -> DataFrame:
    """rows(key, source, output), one per key -> measures (the fraction of the source's script as it stands and without kept terms), findings, failures, warnings, ok. All within the row; only terms are joined to it."""
    counts = ("paragraph_count", "dialogue_count", "char_count")
    blocks = leaks.judged_blocks(F.col("output"), chatter, between)
    held = rows.select(*key, "output", paragraphs(F.col("source"), between).alias("__source"), paragraphs(F.col("output"), between).alias("__output"), F.transform(blocks, lambda b: b["verdict"]).alias("__verdicts"))
    held = leaks.reported(leaks.subtract(held, text="output", rules=residue, terms=terms, key=key), residue)
    sides = {f"{name}_{c}": measures(F.col(f"__{name}"), script=script)[c] for name in ("source", "output") for c in counts}
    number = {f"__{v}": F.size(F.filter("__verdicts", _is(v))) for v in ("remove", "report")}
    both = held.withColumns({**sides, **number}).select(*key, "output", *sides, *number, "residual_fraction", "flagged", F.col("found").alias("findings"), F.bround(script_fraction(F.col("output"), residue.measured), 4).alias("output_source_fraction"))
    source, out = F.col("source_char_count"), F.col("output_char_count")
    ratio = F.when(source > 0, out / source).otherwise(0.0)
    allowed = F.greatest(F.lit(rules.paragraphs_off), F.bround(F.col("source_paragraph_count") * rules.paragraphs_share, 0).cast("int"))
    off = (source > 0) & ((ratio < rules.ratio[0]) | (ratio > rules.ratio[1]))
    wholesale = F.col("residual_fraction") > rules.wholesale
    fails = {"commentary": F.col("__report") > 0, "wholesale": wholesale, "residue": ~wholesale & F.col("flagged"), "paragraphs": F.abs(F.col("output_paragraph_count") - F.col("source_paragraph_count")) > allowed, "ratio": off & F.lit(rules.ratio_fails)}
    warns = {"removed": F.col("__remove") > 0, "uncounted": source == 0, "ratio": off & F.lit(not rules.ratio_fails), "dialogue": F.abs(F.col("output_dialogue_count") - F.col("source_dialogue_count")) > rules.dialogue_off}
    named = {"failures": fails, "warnings": warns}
    arrays = {k: F.array_compact(F.array(*[F.when(hit, n) for n, hit in v.items()])) for k, v in named.items()}
    arrays["warnings"] = F.concat(arrays["warnings"], surface_warnings(F.col("output"), F.col("output_dialogue_count")))
    done = both.withColumns({"length_ratio": F.round(ratio, 3), **arrays})
    return done.withColumn("ok", F.size("failures") == 0).drop("output", "__remove", "__report", "flagged")
