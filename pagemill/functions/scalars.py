"""Small column expressions: tolerant casts, labels, boxes, keys, resume times, failure triage."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, strip


def tolerant_bool(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin("true", "1", "yes"), F.lit(False))


def whole_json(c: Column) -> Column:
    """A text that is one JSON value and nothing else, as a variant; null where it is not (Spark's own parser takes what follows a value)."""
    held = F.try_parse_json(F.concat(F.lit("["), c, F.lit("]")))
    return F.when(F.size(F.try_variant_get(held, "$", "array<variant>")) == 1, F.try_variant_get(held, "$[0]", "variant"))


def tolerant_notes(c: Column) -> Column:
    """A JSON array of notes, or one note, as an array of strings without blanks; an object gives none, and what only begins like an array is one note."""
    one = F.array(strip(c))
    many = F.transform(F.try_variant_get(whole_json(c), "$", "array<string>"), lambda n: strip(n))
    found = F.coalesce(F.when(c.rlike(r"\A\s*\["), many), F.when(c.isNotNull() & ~c.rlike(r"\A\s*\{"), one))
    return F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda n: n != "")


def tolerant_box(c: Column) -> Column:
    """Four numbers as struct(x, y, w, h); anything else is the empty box."""
    sides = [F.try_element_at(c, F.lit(k + 1)).try_cast("double") for k in range(4)]
    fine = F.size(c) == 4
    for s in sides:
        fine = fine & s.isNotNull()
    return F.struct(*[F.when(F.coalesce(fine, F.lit(False)), s).otherwise(0.0).alias(n) for n, s in zip("xywh", sides, strict=True)])


def tolerant_int(c: Column, default: Column) -> Column:
    return F.coalesce(c.try_cast("double").cast("long"), default)


def normal_pronoun(c: Column) -> Column:
    """he, she or they, as a model proposes it; anything else is none. What a person typed stays as it is and does not come here."""
    word = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(word.isin("he", "she", "they"), word).otherwise("")


def safe_label(c: Column, most: int = 80) -> Column:
    """A file name fit for display: path and control characters go, white space is one space."""
    tail = F.regexp_replace(F.coalesce(c, F.lit("")), r"\A.*[/\\]", "")
    plain = strip(F.regexp_replace(F.regexp_replace(tail, r"[\x00-\x1f\x7f<>:\"|?*]", " "), f"[{SPACE}]+", " "))
    return F.substring(plain, 1, most)


def document_id(c: Column) -> Column:
    """The id in a /d/<id> address, or the text itself if it looks like an id, else empty."""
    found = F.regexp_extract(c, r"/d/([A-Za-z0-9_\-]{10,})", 1)
    return F.when(found != "", found).when(c.rlike(r"\A[A-Za-z0-9_\-]{20,}\z"), c).otherwise("")


def pixels_to_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """Fractions of the page; a page without size gives the empty box."""
    fine = (width > 0) & (height > 0)
    zero = F.lit(0.0)
    return F.struct(*[F.when(fine, v / size).otherwise(zero).alias(n) for n, v, size in (("x", x, width), ("y", y, height), ("w", w, width), ("h", h, height))])


def box_to_pixels(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column) -> Column:
    """The box on a picture of this size."""
    return F.struct(*[(v * size).alias(n) for n, v, size in (("x", x, width), ("y", y, height), ("w", w, width), ("h", h, height))])


def box_percent(x: Column, y: Column, w: Column, h: Column) -> Column:
    """The box in percent of the page, as it is drawn."""
    return F.struct(*[(v * 100).alias(n) for n, v in (("left", x), ("top", y), ("width", w), ("height", h))])


def box_inside(x: Column, y: Column, w: Column, h: Column, eps: float = 1e-6) -> Column:
    numbers = ~(F.isnan(x) | F.isnan(y) | F.isnan(w) | F.isnan(h))
    return F.coalesce(numbers & (w >= 0) & (h >= 0) & (x >= -eps) & (y >= -eps) & (x + w <= 1 + eps) & (y + h <= 1 + eps), F.lit(False))


def box_drawable(x: Column, y: Column, w: Column, h: Column) -> Column:
    big = float("inf")
    finite = ~(F.isnan(x) | F.isnan(y) | F.isnan(w) | F.isnan(h)) & F.abs(x).__lt__(big) & F.abs(y).__lt__(big) & F.abs(w).__lt__(big) & F.abs(h).__lt__(big)
    one, zero = F.lit(1.0), F.lit(0.0)
    shown = (F.least(one, x + w) - F.greatest(zero, x) > 0) & (F.least(one, y + h) - F.greatest(zero, y) > 0)
    return F.coalesce(finite & (w > 0) & (h > 0) & shown, F.lit(False))


def queue_key(space: Column, number: Column, kind: Column) -> Column:
    return F.concat_ws(":", space, number.cast("string"), kind)


def resume_seconds(strikes: Column, reset_in: Column, most_wait: int = 12 * 3600) -> Column:
    """Seconds to wait: a minute past the provider's reset if it is within `most_wait`, else 5 minutes doubling up to an hour."""
    backoff = F.least(F.lit(3600.0), 300 * F.pow(F.lit(2.0), F.greatest(F.lit(0), strikes - 1)))
    return F.when((reset_in >= 0) & (reset_in <= most_wait), (reset_in + 60).cast("double")).otherwise(backoff)


#: Codes, which this library names itself; what must be as it is are the conditions, their order, and what can be tried again.
# Fixed values: (code, retryable, status, condition as SQL over name, module, message, http). The vendor's own failures come before the texts of rate limits.
TRIAGE = [
    ("stopped", True, 409, "name = 'TaskAborted'"),
    ("refused", False, 409, "name = 'TaskRefused'"),
    ("vendor-auth-expired", False, 401, "vendor AND http IN (401, 403)"),
    ("vendor-not-found", False, 404, "vendor AND http = 404"),
    ("vendor-rate-limited", True, 429, "vendor AND http = 429"),
    ("vendor-error", True, 502, "vendor"),
    ("rate-limited", False, 429, "name = 'RateLimited' OR low LIKE '%usage limit%' OR low LIKE '%rate limit%'"),
    ("start-timeout", True, 503, "low LIKE '%control request timeout%' OR low LIKE '%initialize timeout%'"),
    ("engine-missing", False, 503, "name = 'CLINotFoundError' OR low LIKE '%{engine} not found%' OR low LIKE '%enoent%'"),
    ("engine-connection", True, 502, "name IN ('CLIConnectionError', 'ProcessError') OR low LIKE '%cli connection%'"),
    ("disk-full", True, 507, "name IN ('OSError', 'IOError', 'PermissionError') AND (low LIKE '%no space%' OR low LIKE '%errno 28%')"),
    ("file-locked", True, 500, "name = 'PermissionError' OR low LIKE '%winerror 32%' OR low LIKE '%being used by another%'"),
    ("missing-file", True, 404, "name = 'FileNotFoundError'"),
    ("corrupt-data", True, 500, "name = 'JSONDecodeError' OR low LIKE '%expecting value%'"),
    ("file-error", True, 500, "name IN ('OSError', 'IOError')"),
    ("bad-data", True, 500, "name IN ('ValueError', 'KeyError', 'TypeError', 'AttributeError')"),
]


def triage_code(ladder: list = TRIAGE, *, engine: str = "engine") -> Column:
    """The code for columns name, low (message in lower case), vendor, http: that of the first rule that holds. engine: what messages call the program that answers."""
    word = engine.lower().replace("'", "''")
    return F.expr("CASE " + " ".join(f"WHEN {cond.replace('{engine}', word)} THEN '{code}'" for code, _, _, cond in ladder) + " ELSE 'unknown' END")


def failure_facts(name: Column, module: Column, message: Column, response_status: Column, status_code: Column, *, vendors: tuple[str, ...]) -> list[Column]:
    """What triage asks of a failure: name, low, vendor, http.

    It is the vendor's if its module begins with one of `vendors`, or if it carries a response with a status, which no other
    client's failures do. The status is the response's, else the failure's own, if it is a whole number.
    """
    begins = F.lit(False)
    for prefix in vendors:
        begins = begins | F.coalesce(module, F.lit("")).startswith(prefix)
    status = F.coalesce(response_status.cast("string"), status_code.cast("string"))
    whole = F.when(status.rlike(r"\A\s*[+-]?\d+\s*\z"), strip(status).try_cast("int"))
    return [name.alias("name"), F.lower(F.coalesce(message, F.lit(""))).alias("low"), (begins | response_status.isNotNull()).alias("vendor"), whole.alias("http")]


# Codes of refusals by their HTTP status, and the statuses worth a second try.
HTTP_CODES = {400: "bad-request", 401: "not-connected", 403: "forbidden", 404: "not-found", 409: "conflict", 413: "too-large", 429: "rate-limited"}
HTTP_AGAIN = (401, 429, 502, 503)


def http_refusal(detail: Column, status: Column) -> Column:
    """struct(code, title, retryable) of a refusal: what its detail says of itself if that is an object with a code, else by status, the detail as title (C11)."""
    said = whole_json(detail)
    own = F.try_variant_get(said, "$.code", "string")
    by_status = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in HTTP_CODES.items() for x in pair]), status), F.lit("request-failed"))
    again = F.when(own.isNull(), status.isin(*HTTP_AGAIN)).otherwise(F.coalesce(F.try_variant_get(said, "$.retryable", "boolean"), F.lit(False)))
    return F.struct(F.coalesce(own, by_status).alias("code"), F.when(own.isNull(), F.coalesce(detail, F.lit(""))).otherwise(F.coalesce(F.try_variant_get(said, "$.title", "string"), F.lit(""))).alias("title"), F.coalesce(again, F.lit(False)).alias("retryable"))
