"""Personal data replaced by keyed surrogates of the same type and format.

Found are e-mail addresses, telephone, card, account and social security numbers, IPv4 addresses, secrets (long hex
strings and values after words such as token or password) and names of people (a title or a known first name, then
capitalised words). A surrogate is a keyed permutation of all values of its format: digits stay digits, vowels vowels,
consonants consonants, case and script and punctuation as they are; card numbers keep a right check digit, addresses their
kind (private, public), first names their gender and script. A permutation gives different values different surrogates,
and the same value always the same one, in every document.

Letters and digits beyond the listed sets go to others of their own category in their own block of code points, so that
every script keeps its script.

Collision check: a surrogate that is itself a value found in the corpus, or that two values share, is drawn again with
the next tweak until none is left; such draws reach their documents by a join. What is drawn again is a word: of a name its
surnames, which are also checked by themselves, so that all names with a surname go on sharing one; of other values (and of first names alone) the whole value.
Where a format has too few unused values, its permutation gives way after MOST_DRAWS draws to longer surrogates of the same
kind, drawn for each word by itself; what clashes after all LONGER_DRAWS fails the job, so no two values of a kind ever
share a surrogate.

The key decides all surrogates and undoes them for those who know it; it is a required argument. Values that wait in the
shared folder for the collision check are sealed with it. Null texts stay null, and texts without personal data stay as
they are. Repeated rows are handled alike; all other columns stay, whatever their names, except that they may not begin
with `_pii`. An empty table gives an empty table.
"""

from __future__ import annotations

import functools
import hashlib
import logging
import random
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save, slices

#: The setting that names the key of the registered queries; where it is unset they use a public one, fit for tests only.
KEY_SETTING, TEST_KEY = "spark.pagemill.surrogates.key", "surrogates"
ROUNDS = 8
MOST_DRAWS = 8
#: Draws of longer surrogates after those; each is longer than the one before.
LONGER_DRAWS = 8

#: First names by script and gender; a surrogate comes from the same list.
FIRST_NAMES = {
    "latin f": "Mary Anna Emma Laura Sophie Maria Julia Sarah Claire Lucia Elena Marta Carmen Ingrid Helga Ursula Monique Camille Isabel Alice Emily Linda Susan Karen Nancy Lisa Sandra Ashley Donna Carol".split(),
    "latin m": "James John Robert Michael William David Thomas Daniel Paul Mark George Peter Hans Klaus Jürgen Wolfgang Pierre Jean Luc Antoine Carlos Luis Miguel Javier Pedro Diego Richard Charles Joseph Steven".split(),
    "cyrillic f": "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана".split(),
    "cyrillic m": "Иван Сергей Алексей Дмитрий Андрей Михаил Николай Павел".split(),
}
#: The zeros of all scripts: \d finds them and the nine after each.
ZEROS = [k for k in range(sys.maxunicode) if unicodedata.category(chr(k)) == "Nd" and unicodedata.digit(chr(k)) == 0]
DIGIT = "[" + "".join(rf"\x{{{z:x}}}-\x{{{z + 9:x}}}" for z in ZEROS) + "]"
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Herr", "Frau", "Mme", "Sr", "Sra")
#: Letters and digits that stand in for each other.
ALPHABETS = [a for base in ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåæ", "èéêë", "ìíîï", "òóôõöø", "ùúûü", "çñ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ") for a in dict.fromkeys([base, base.upper()])]
ALPHABETS += ["".join(chr(z + k) for k in range(10)) for z in ZEROS if z != ord("0")]
SET_OF = {c: a for a in ALPHABETS for c in a}
HEX = {"lower": "0123456789abcdef", "upper": "0123456789ABCDEF"}

NAMES = "|".join(n for own in FIRST_NAMES.values() for n in own)
WORD = r"[^\W\d_]+"
PATTERNS = {
    "email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
    "secret": r"(?:(?<=token)|(?<=secret)|(?<=password)|(?<=api_key)|(?<=apikey))\s*[=:]\s*[\"']?[\w+/-]{8,}|(?<![\w])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![\w])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)",
    "account": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\w|[.-]\d)",
    "name": rf"(?<!\w)(?:(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\.? (?=[^\W\d_a-zß-ÿ])|(?=(?:{NAMES}) [^\W\d_a-zß-ÿ]))(?!(?P<again>{WORD})(?: (?P=again)){{1}}){WORD}(?: [^\W\d_a-zß-ÿ]{WORD}){{0,2}}",
}
FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
#: After a title or first name: nothing that PATTERNS["name"] rules out.
CAPITAL = r"[^\x00-@\[-`a-zß-ÿ]"
#: A text without any of these has nothing to find (every branch of PATTERNS asks for one); RE2 runs it over whole columns.
HINT = rf"@|{DIGIT}{{3}}|{DIGIT}\.{DIGIT}|\+{DIGIT}|[A-Z]{{2}}{DIGIT}{{2}} ?[A-Z0-9]{{4}}|[0-9a-fA-F]{{32}}|token|secret|password|api_?key|(?:Mr|Mrs|Ms|Dr|Herr|Frau|Mme|Sr|Sra)\.? {CAPITAL}|(?:{NAMES}) {CAPITAL}"


def keyed(key: str, *what: object) -> int:
    return int.from_bytes(hashlib.blake2b(repr(what).encode(), key=key.encode()[:64], digest_size=32).digest(), "big")


def permuted(places: list[int], sizes: list[int], key: str, tweak: object) -> list[int]:
    """A keyed permutation of all values with these numbers of choices by place: an alternating Feistel network."""
    middle = len(sizes) // 2

    def number(part: range) -> tuple[int, int]:
        n, top = 0, 1
        for i in part:
            n, top = n * sizes[i] + places[i], top * sizes[i]
        return n, top

    (left, left_top), (right, right_top) = number(range(middle)), number(range(middle, len(sizes)))
    for r in range(0, ROUNDS, 2):
        left = (left + keyed(key, tweak, sizes, r, right)) % left_top
        right = (right + keyed(key, tweak, sizes, r + 1, left)) % right_top
    out = [0] * len(sizes)
    for part, n in ((range(middle), left), (range(middle, len(sizes)), right)):
        for i in reversed(part):
            n, out[i] = divmod(n, sizes[i])
    return out


@functools.cache
def set_of(c: str) -> str:
    """Characters that stand in for c: its listed set, or those of its category in its block of 64 code points (or of 256, 1024, 4096 where it is alone); empty for what is neither letter nor digit."""
    if c in SET_OF or not c.isalnum():
        return SET_OF.get(c, "")
    for width in (64, 256, 1024, 4096):
        low = ord(c) // width * width
        own = [x for x in map(chr, range(low, low + width)) if x not in SET_OF and unicodedata.category(x) == unicodedata.category(c) and unicodedata.normalize("NFC", x) == x]
        if len(own) > 1 and c in own:
            return "".join(own)
    return ""


def shuffled_text(text: str, key: str, tweak: object, one_set: str = "") -> str:
    """All letters and digits permuted within their sets (or all characters within one set); other characters stay."""
    own = [one_set or set_of(c) for c in text]
    at = [i for i, a in enumerate(own) if a]
    if not at:
        return text
    new = permuted([own[i].index(text[i]) for i in at], [len(own[i]) for i in at], key, (tweak, "".join("\0" if a else c for a, c in zip(own, text))))
    out = list(text)
    for i, k in zip(at, new):
        out[i] = own[i][k]
    return "".join(out)


def check_digit(digits: str) -> str:
    total = sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits))))
    return str(-total % 10)


def ip_kind(parts: list[int]) -> str:
    a, b = parts[:2]
    if a == 127 or a == 0 or a >= 224:
        return f"special {a}"
    return "private" if a == 10 or (a, b) == (192, 168) or a == 172 and 16 <= b < 32 else "public"


@functools.lru_cache(maxsize=64)
def first_name_cycle(key: str, group: str, tweak: object) -> dict[str, str]:
    """Each name of a list to the next one in a keyed order, so that none stays."""
    names = list(FIRST_NAMES[group])
    random.Random(keyed(key, group, tweak)).shuffle(names)
    return dict(zip(names, names[1:] + names[:1]))


GROUP_OF = {n: g for g, own in FIRST_NAMES.items() for n in own}


def invented(like: str, size: int, *what: object) -> str:
    """Keyed letters (or digits, for a number) in the script of a word, capitalised like it."""
    if like.isdecimal():
        sets = ["0123456789"]
    else:
        sets = ["бвгджзклмнпрст", "аеиоу"] if re.search("[а-яА-Я]", like) else ["bcdfghjklmnprstvz", "aeiou"]
    n, out = keyed(*what), ""
    for k in range(size):
        n, place = divmod(n, len(sets[k % len(sets)]))
        out += sets[k % len(sets)][place]
    return out[:1].upper() + out[1:] if like[:1].isupper() else out


def surnames(value: str) -> list[str]:
    """The words of a name that are neither titles nor listed first names."""
    return list(dict.fromkeys(w for w in value.split(" ") if w.rstrip(".") not in TITLES and w not in GROUP_OF))


def words_of(kind: str, value: str) -> list[str]:
    """What is drawn by itself: a name's surnames, else the whole value."""
    return (surnames(value) if kind == "name" else []) or [value]


def longer_surrogate(kind: str, value: str, key: str, draw: int) -> str:
    """A surrogate of the same kind beyond the value's format, drawn for this value alone; addresses keep to four numbers."""
    more, what = 2 * (draw - MOST_DRAWS), (key, kind, draw, value)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        hosts = (shuffled_text(x, key, ("host", draw)) for x in host.split("."))
        return f"{invented('a', max(len(local), 4) + more, *what)}@{'.'.join(hosts)}.{top}"
    if kind == "ip":
        parts = [int(x) for x in value.split(".")]
        new, like = parts, ip_kind(parts)
        while True:
            new = permuted(new, [256] * 4, key, (kind, draw, value))
            if ip_kind(new) == like:
                return ".".join(map(str, new))
    if kind == "secret":
        head = re.match(r"\s*[=:]\s*[\"']?", value)
        head = head[0] if head else ""
        size = len(value) - len(head) + more
        digits = f"{keyed(*what):064x}"
        if not head and value == value.upper():
            digits = digits.upper()
        return head + (digits * (size // 64 + 1))[:size]
    if kind == "card":
        digits = "".join(str(int(c)) for c in value if c.isdigit())
        new = invented("1", len(digits) - 1 + more, *what)
        return new + check_digit(new)
    head = re.match(r"\+\d{1,3}(?=[ .(-])", value) if kind == "phone" else None
    head = head[0] if head else ""
    return head + shuffled_text(value[len(head) :], key, (kind, draw, value)) + invented("1", more, *what)


def name_surrogate(value: str, key: str, draws: dict[str, int]) -> str:
    """Titles stay, first names go round their list, surnames are drawn each by itself; first names alone get a surname where their list is full."""
    own, out = surnames(value), []
    whole = 0 if own else draws.get(value, 0)
    for w in value.split(" "):
        draw = draws.get(w, 0)
        if w.rstrip(".") in TITLES:
            out.append(w)
        elif w in GROUP_OF:
            out.append(first_name_cycle(key, GROUP_OF[w], min(whole, MOST_DRAWS))[w])
        elif draw > MOST_DRAWS:
            out.append(invented(w, max(len(w), 4) + 2 * (draw - MOST_DRAWS), key, "name", draw, w))
        else:
            out.append(shuffled_text(w, key, ("name", draw)))
    if whole > MOST_DRAWS:
        out.append(invented(value.split(" ")[-1], 4 + 2 * (whole - MOST_DRAWS), key, "name", whole, value))
    return " ".join(out)


@functools.lru_cache(maxsize=200_000)
def surrogate(kind: str, value: str, key: str, draws: tuple[int, ...] = ()) -> str:
    """The surrogate of a value; draws: the number of each of words_of's draws (none: 0). Beyond MOST_DRAWS surrogates get longer."""
    if kind in ("name", "surname"):
        return name_surrogate(value, key, dict(zip(words_of(kind, value), draws)))
    draw = draws[0] if draws else 0
    if draw > MOST_DRAWS:
        return longer_surrogate(kind, value, key, draw)
    tweak = (kind, draw)
    if kind == "email":
        local, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{shuffled_text(local, key, tweak)}@{'.'.join(shuffled_text(x, key, ('host', draw)) for x in host.split('.'))}.{top}"
    if kind == "ip":
        parts = [int(x) for x in value.split(".")]
        new, like = parts, ip_kind(parts)
        while True:  # along the cycle to the next address of this kind, itself at the latest
            new = permuted(new, [256] * 4, key, tweak)
            if ip_kind(new) == like:
                return ".".join(map(str, new))
    if kind == "secret":
        head = re.match(r"\s*[=:]\s*[\"']?", value)
        word = value[head.end() :] if head else value
        for digits in HEX.values():
            if len(word) >= 32 and all(c in digits for c in word):
                return value[: len(value) - len(word)] + shuffled_text(word, key, tweak, digits)
        return value[: len(value) - len(word)] + shuffled_text(word, key, tweak)
    if kind == "card":
        own = [SET_OF[c] for c in value if c.isdigit()]
        digits = "".join(str(int(c)) for c in value if c.isdigit())
        right = check_digit(digits[:-1]) == digits[-1]
        new = digits
        while True:
            if right:
                new = shuffled_text(new[:-1], key, tweak)
                new += check_digit(new)
                break
            new = shuffled_text(new, key, tweak)
            if check_digit(new[:-1]) != new[-1]:
                break
        rest = iter(a[int(d)] for a, d in zip(own, new, strict=True))
        return "".join(next(rest) if c.isdigit() else c for c in value)
    if kind == "phone" and (head := re.match(r"\+\d{1,3}(?=[ .(-])", value)):
        return head[0] + shuffled_text(value[head.end() :], key, (tweak, head[0]))
    return shuffled_text(value, key, tweak)


def sealed(value: str, key: str) -> bytes:
    """The value hidden under the key, the same for equal values: a keyed digest, then the bytes with that digest's key stream."""
    raw = value.encode()
    tag = hashlib.blake2b(raw, key=key.encode()[:64], digest_size=16, person=b"seal").digest()
    return tag + bytes(a ^ b for a, b in zip(raw, key_stream(tag, key, len(raw))))


def key_stream(tag: bytes, key: str, size: int) -> bytes:
    blocks = (hashlib.blake2b(tag + k.to_bytes(8, "big"), key=key.encode()[:64], person=b"stream").digest() for k in range(-(-size // 64)))
    return b"".join(blocks)[:size]


def opened(data: bytes, key: str) -> str:
    tag, rest = data[:16], data[16:]
    return bytes(a ^ b for a, b in zip(rest, key_stream(tag, key, len(rest)))).decode()


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all personal data, left to right."""
    return [(m.lastgroup, m.start(), m.end()) for m in FIND.finditer(text)] if text else []


def hinted(texts: pa.Array) -> list[bool]:
    return pc.fill_null(pc.match_substring_regex(texts, HINT), False).to_pylist()


def found_values(docs: DataFrame, key: str) -> DataFrame:
    """A row for each place, and one of kind surname for each surname there: doc_id, kind, value, surrogate, words; the last three sealed."""
    types = [pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.list_(pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seal = functools.lru_cache(maxsize=200_000)(lambda text: sealed(text, key))
        for batch in batches:
            for part in slices(batch):
                hint = pa.array(hinted(part.column("text")))
                rows = []
                for doc_id, text in zip(part.column("doc_id").filter(hint).to_pylist(), part.column("text").filter(hint).to_pylist(), strict=True):
                    for kind, a, b in find(text):
                        own = [("surname", w) for w in surnames(text[a:b])] if kind == "name" else []
                        for k, value in [(kind, text[a:b]), *own]:
                            rows.append((doc_id, k, seal(value), seal(surrogate(k, value, key)), [seal(w) for w in words_of(k, value)]))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=["doc_id", "kind", "value", "surrogate", "words"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, kind string, value binary, surrogate binary, words array<binary>")


def redraws(values: DataFrame, key: str) -> DataFrame | None:
    """values(kind, value, surrogate, words), distinct, sealed -> (kind, value, draws) of those that had to be drawn again; None: none had to."""

    @F.udf("binary")  # few rows
    def draw_again(kind, value, draws):
        return sealed(surrogate(kind, opened(bytes(value), key), key, tuple(draws)), key)

    originals = values.select("kind", F.col("value").alias("surrogate"))
    settled = values.withColumn("draws", F.transform("words", lambda _: F.lit(0)))
    changed = False
    for draw in range(1, MOST_DRAWS + LONGER_DRAWS + 2):
        taken = settled.join(originals, ["kind", "surrogate"], "left_semi").select("kind", "value", F.lit("taken").alias("why"))
        shared = settled.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
        shared = settled.join(shared, ["kind", "surrogate"], "left_semi").select("kind", "value", F.lit("shared").alias("why"))
        clash = save(taken.unionByName(shared).groupBy("kind", "value").agg(F.max(F.col("why") == "taken").alias("taken"), F.max(F.col("why") == "shared").alias("shared")), "clashes")
        if clash.isEmpty():
            return settled.filter(F.exists("draws", lambda d: d > 0)).select("kind", "value", "draws") if changed else None
        if draw > MOST_DRAWS + LONGER_DRAWS:
            both = clash.agg(F.count_if("taken"), F.count_if("shared")).first()
            raise RuntimeError(f"after {draw - 1} draws {both[0]} surrogates equal other values and {both[1]} are shared; raise LONGER_DRAWS")
        pool = F.when(F.col("kind") == "surname", "name").otherwise(F.col("kind")).alias("pool")  # a surname and the names with it are drawn together
        words = settled.join(clash, ["kind", "value"], "left_semi").select(pool, F.explode("words").alias("word")).distinct()
        each = settled.select("kind", "value", pool, F.posexplode("words").alias("k", "word")).join(words, ["pool", "word"])
        again = each.groupBy("kind", "value").agg(F.collect_set("k").alias("again"))  # every value with such a word
        own = settled.join(again, ["kind", "value"]).withColumn("draws", F.transform("draws", lambda d, k: F.when(F.array_contains("again", k), F.lit(draw)).otherwise(d))).drop("again")
        own = own.withColumn("surrogate", draw_again("kind", "value", "draws"))
        settled = save(settled.join(again, ["kind", "value"], "left_anti").unionByName(own), "draws")
        changed = True
    raise AssertionError("the last round returns or fails")


def session_key(spark) -> str:
    """The key that the session names, or the public one of tests."""
    found = spark.conf.get(KEY_SETTING, None)
    if not found:
        logging.getLogger(__name__).warning("%s is not set: surrogates are made with a public key", KEY_SETTING)
    return found or TEST_KEY


def replace_private(docs: DataFrame, key: str) -> DataFrame:
    """docs with text replaced, all other columns as they are, and _pii_entities: the kinds, places and surrogates."""
    if not key:
        raise ValueError("a key is needed")
    values = save(found_values(docs, key), "values")
    again = redraws(values.select("kind", "value", "surrogate", "words").distinct(), key)
    drawn = again is not None
    if again is not None:
        own = values.filter("kind <> 'surname'").select("doc_id", "kind", "value").distinct().join(again, ["kind", "value"])
        own = own.groupBy("doc_id").agg(F.collect_list(F.struct("kind", "value", "draws")).alias("_pii_again"))
        docs = docs.join(own.withColumnRenamed("doc_id", "_pii_doc"), F.col("doc_id").cast("long").eqNullSafe(F.col("_pii_doc")), "left").drop("_pii_doc")
    columns = [f for f in docs.schema if f.name != "_pii_again"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns) + ", _pii_entities array<struct<kind string, start int, end int, surrogate string>>"
    found = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts, entities = part.column("text").to_pylist(), [[] for _ in range(part.num_rows)]
                changed = part.column("_pii_again").to_pylist() if drawn else None
                for k, hint in enumerate(hinted(part.column("text"))):
                    if not hint:
                        continue
                    text, out, at = texts[k], [], 0
                    own = {(r["kind"], opened(r["value"], key)): tuple(r["draws"]) for r in (changed[k] or ())} if changed else {}
                    for kind, a, b in find(text):
                        new = surrogate(kind, text[a:b], key, own.get((kind, text[a:b]), ()))
                        out += [text[at:a], new]
                        at = b
                        entities[k].append({"kind": kind, "start": a, "end": b, "surrogate": new})
                    texts[k] = "".join([*out, text[at:]])
                cols = [pa.array(texts, pa.string()) if f.name == "text" else part.column(f.name) for f in columns]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(entities, found)], names=[f.name for f in columns] + ["_pii_entities"])

    return docs.mapInArrow(run, schema)
