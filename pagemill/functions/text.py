"""Column expressions over text: white space, scripts, quotes, headings, page furniture.

Classes are explicit code points, so that Java, RE2 and Python mean the same by them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes (bodies of a bracket expression).
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
INVISIBLE = r"\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{206f}\x{3164}\x{feff}\x{ffa0}"
FORMAT = r"\x{ad}\x{600}-\x{605}\x{61c}\x{6dd}\x{70f}\x{8e2}\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{206f}\x{feff}\x{fff9}-\x{fffb}"
JAPANESE = r"\x{3041}-\x{309f}\x{30a0}-\x{30ff}\x{31f0}-\x{31ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{ff66}-\x{ff9f}\x{3005}-\x{3007}\x{303b}"
KANJI = r"\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}"
HIRAGANA = r"\x{3041}-\x{309f}"
QUOTES = r"\"\x{201c}\x{201d}\x{300c}\x{300d}\x{300e}\x{300f}"
QUOTE_PAIRS = (("「", "」"), ("『", "』"), ("“", "”"), ("‘", "’"), ("《", "》"), ("〈", "〉"), ("〝", "〟〞"))
ENDS_SENTENCE = rf"[。！？.!?」』”)）][{SPACE}]*\z"
STARTS_ON = rf"\A[{SPACE}]*[」』、，をがにへとのもは]"
ELLIPSIS_RUN = r"(?:\A|[^.])\.\.(?:[^.]|\z)|\.{4,}"

# Headings are a numbered counter, a kind word, or an English one; folded to plain width, without a full stop.
NUMERAL = "0-9〇一二三四五六七八九十百千"
AFTER = rf"(?:\z|[{SPACE}:：.\-–—「『（(【・])"
HEADING = "|".join(
    [
        rf"(?:chapter|ch\.?|episode|ep\.?|part|vol\.?|volume)[{SPACE}]*[0-9]+(?:[^0-9\p{{L}}_]|\z)",
        rf"第?[{SPACE}]*[{NUMERAL}]{{1,6}}[{SPACE}]*[話章巻部回]{AFTER}",
        rf"(?:プロローグ|エピローグ|序章|終章|外伝|間章|閉幕){AFTER}",
        r"(?:prologue|epilogue|interlude)(?:[^0-9\p{L}_]|\z)",
    ]
)
HEADING = rf"(?i)\A[{SPACE}]*(?:{HEADING})"
FULL_STOP = rf"[。．.][{SPACE}]*\z"
SENTENCE_END = rf"[。．！？.!?][{SPACE}]*\z"

# Fixed value: the dashes that stand round a printed page number.
DASHES = "-‐‑‒–—―ー~〜"
PAGE_NUMBER = rf"\A[{DASHES.replace('-', chr(92) + '-')}]+[{SPACE}]*[0-9]{{1,4}}[{SPACE}]*[{DASHES.replace('-', chr(92) + '-')}]+\z"
#: Fixed value: endings of bare web addresses.
TOP_LEVELS = "com|net|org|jp|io|co|me|info|site|xyz|app|tv|cc|to|ru|link|online|club|top|biz|us|uk|kr|cn|fun|moe|blog|page|web"
WEB_ADDRESS = rf"\A(?:https?://)?(?:www\.)?(?:[a-z0-9](?:[a-z0-9\-]*[a-z0-9])?\.)+(?:{TOP_LEVELS})(?:/[^{SPACE}]*)?\z"

#: Characters whose compatibility form (NFKC) is another single character, and those that become several, each with its form.
COMPATIBLE = {c: n for c in map(chr, [*range(0x80, 0xD800), *range(0xF900, 0x10000)]) if (n := unicodedata.normalize("NFKC", c)) != c and n}
SINGLE = {c: n for c, n in COMPATIBLE.items() if len(n) == 1}
SEVERAL = {c: n for c, n in COMPATIBLE.items() if len(n) > 1}


#: The characters of SPACE.
SPACES = "".join(chr(k) for a, b in ((0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)) for k in range(a, b + 1))


def once(c: Column, of: Callable[[Column], Column]) -> Column:
    """of(c), with c worked out once however often `of` names it; within arrays and branches each name would be worked out anew."""
    return F.element_at(F.transform(F.array(c), of), 1)


def strip(c: Column | str) -> Column:
    """Without white space at both ends, wide and control spaces included; looks at the ends only."""
    return F.btrim(c, F.lit(SPACES))


def blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(rf"[^{SPACE}]")


def without_space(c: Column) -> Column:
    return F.regexp_replace(c, rf"[{SPACE}]+", "")


def strip_invisibles(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"[{INVISIBLE}]", "")


def strip_format(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), f"[{FORMAT}]", "")


def folded(c: Column) -> Column:
    """Compatibility forms as plain ones (NFKC character by character; marks of their own are not joined to letters), for decisions only. Works within arrays, too; `nfkc` is exact."""
    text = F.coalesce(c, F.lit(""))
    plain = F.replace(F.replace(F.translate(text, "".join(SINGLE), "".join(SINGLE.values())), F.lit("…"), F.lit("...")), F.lit("‥"), F.lit(".."))
    table = F.create_map(*[F.lit(x) for pair in SEVERAL.items() for x in pair])
    spelled = F.array_join(F.transform(F.split(plain, ""), lambda x: F.coalesce(F.element_at(table, x), x)), "")
    return F.when(~text.rlike(r"[^\x00-\x7f]"), text).when(plain.rlike(f"[{_class(SEVERAL.keys() - {'…', '‥'})}]"), spelled).otherwise(plain)


@F.pandas_udf(StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """NFKC, exactly. Only texts beyond ASCII leave the JVM: the order and composition of marks and of Hangul are beyond a table of characters."""
    text = F.coalesce(c, F.lit(""))
    return F.coalesce(_composed(F.when(text.rlike(r"[^\x00-\x7f]"), text)), text)


def _class(chars: Iterable[str]) -> str:
    """The body of a bracket expression for characters, neighbours as ranges."""
    runs: list[list[int]] = []
    for k in sorted(map(ord, chars)):
        if runs and runs[-1][1] == k - 1:
            runs[-1][1] = k
        else:
            runs.append([k, k])
    return "".join(rf"\x{{{a:x}}}-\x{{{b:x}}}" for a, b in runs)


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "\r\n?", "\n")


def nonspace_length(c: Column) -> Column:
    return F.length(without_space(F.coalesce(c, F.lit("")))).cast("long")


def script_fraction(c: Column, script: str = JAPANESE) -> Column:
    """Characters of the script over all that are no white space; 0 for none."""
    return once(nonspace_length(c), lambda n: F.when(n == 0, 0.0).otherwise(F.regexp_count(c, F.lit(f"[{script}]")) / n))


def has_quote(c: Column, quotes: str = QUOTES) -> Column:
    return c.rlike(f"[{quotes}]")


def looks_like_heading(line: Column, heading: str = HEADING) -> Column:
    wide = folded(line)
    return ~blank(line) & wide.rlike(heading) & ~wide.rlike(FULL_STOP)


def unclosed_quote(c: Column, pairs: tuple = QUOTE_PAIRS) -> Column:
    """Whether one of the pairs is open at the end: the sum of steps less its lowest running value below zero."""
    chars = F.split(F.coalesce(c, F.lit("")), "")

    def depth(opener: str, closers: str) -> Column:
        def step(d: Column, ch: Column) -> Column:
            return F.when(ch == opener, d + 1).when(ch.isin(*closers), F.greatest(d - 1, F.lit(0))).otherwise(d)

        return F.aggregate(chars, F.lit(0), step) > 0

    some = c.rlike("[" + "".join(o for o, _ in pairs) + "]")  # most texts have none and skip the folds
    return F.coalesce(some, F.lit(False)) & reduce(lambda a, b: a | b, [depth(o, k) for o, k in pairs])


def furniture_kind(c: Column) -> Column:
    """`page-number`, `watermark` or null, from the text alone."""
    plain = strip(nfkc(c))
    joined = F.lower(F.array_join(F.transform(F.split(plain, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), strip), ""))
    return F.when(plain == "", None).when(plain.rlike(PAGE_NUMBER), "page-number").when(joined.rlike(WEB_ADDRESS), "watermark")


def first_visible(c: Column) -> Column:
    """The first character that is no white space, or empty."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), f"[^{SPACE}]", 0)


def sha(c: Column) -> Column:
    return F.sha2(c, 256)
