"""What a chapter measures and what kind it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import JAPANESE, QUOTES, has_quote, nonspace_length, script_fraction, sha


def measures(paragraphs: Column, *, script: str = JAPANESE, quotes: str = QUOTES) -> dict[str, Column]:
    """paragraph_count, dialogue_count, char_count, source_fraction, content_hash, longest_paragraph of an array of paragraphs."""
    joined = F.array_join(paragraphs, "\n\n")
    return {
        "paragraph_count": F.size(paragraphs).cast("long"),
        "dialogue_count": F.size(F.filter(paragraphs, lambda p: has_quote(p, quotes))).cast("long"),
        "char_count": nonspace_length(joined),
        "source_fraction": F.bround(script_fraction(joined, script), 4),
        "content_hash": sha(joined),
        "longest_paragraph": F.coalesce(F.array_max(F.transform(paragraphs, F.length)), F.lit(0)).cast("long"),
    }


def chapter_metrics(chapters: DataFrame, *, script: str = JAPANESE, quotes: str = QUOTES) -> DataFrame:
    """Adds the measures to rows with `paragraphs`."""
    return chapters.withColumns(measures(F.col("paragraphs"), script=script, quotes=quotes))


#: What a prepared chapter's status is by its kind.
PREPARED = {"empty": "empty", "english": "english-source", "source": "prepared"}


def prepared(measured: DataFrame, *, min_fraction: float = 0.15) -> DataFrame:
    """Adds kind and the status that preparing gives it (A2)."""
    rows = classify(measured, min_fraction=min_fraction)
    status = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in PREPARED.items()])
    return rows.withColumn("status", status)


def classify(metrics: DataFrame, *, min_fraction: float = 0.15) -> DataFrame:
    """Adds kind: empty, english (little of the source script) or source."""
    kind = F.when(F.col("paragraph_count") == 0, "empty").when(F.col("source_fraction") < min_fraction, "english").otherwise("source")
    return metrics.withColumn("kind", kind)
