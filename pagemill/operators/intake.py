"""What may come in: works, texts, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import numbered

# Kinds of works, how they come in, and the limits of each upload.
KINDS = ("novel", "manga")
INGESTS = ("text", "docs", "images", "export")
MOST_TEXT, MOST_IMAGE, MOST_PAGES = 20 * 1024 * 1024, 25 * 1024 * 1024, 2000


def check_works(works: DataFrame) -> DataFrame:
    """works(kind, ingest) -> with `refused`: an unknown kind or way in, or a manga that does not come as images."""
    reason = F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "unknown-kind").when(~F.coalesce(F.col("ingest").isin(*INGESTS), F.lit(False)), "unknown-ingest")
    return works.withColumn("refused", reason.when((F.col("kind") == "manga") & (F.col("ingest") != "images"), "manga-needs-images"))


def check_texts(texts: DataFrame, *, most: int = MOST_TEXT, text: str = "text") -> DataFrame:
    """Texts with `refused`: empty, or beyond the limit of bytes."""
    size = F.octet_length(F.coalesce(text, F.lit("")))
    return texts.withColumn("refused", F.when(size == 0, "empty").when(size > most, "too-large"))


def check_pages(uploads: DataFrame, there: DataFrame, *, most_bytes: int = MOST_IMAGE, most_pages: int = MOST_PAGES) -> DataFrame:
    """uploads(work_id, arrival, bytes), there(work_id, pages) -> uploads with `refused`: empty, too large, or beyond the pages that a work may have, counting from what it has."""
    fit = F.when(F.coalesce("bytes", F.lit(0)) == 0, "empty").when(F.col("bytes") > most_bytes, "too-large")
    rows = uploads.withColumn("refused", fit)
    placed = numbered(rows.filter("refused is null"), by=["work_id"], order=[F.col("arrival")], name="__n").join(there.select("work_id", F.col("pages").alias("__there")), "work_id", "left")
    full = F.coalesce("__there", F.lit(0)) + F.col("__n") > most_pages
    return rows.filter("refused is not null").unionByName(placed.withColumn("refused", F.when(full, "too-many-pages")).select(*rows.columns))
