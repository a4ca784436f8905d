"""Rules on small made-up rows: text, segments, leaks, layout, seams, lines, responses, files, streams."""

import unicodedata
import random
import json
import struct

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from pagemill.functions import scalars
from pagemill.functions import text as T
from pagemill.operators import glossary, incremental, layout, leaks, lines, metrics, ranks, regions, requests, scripts, seams, segment
from pagemill.sources import files
from pagemill.streaming import events as E
from pagemill.streaming import jobs


def column_of(spark, column, values):
    """The column for each of the texts, in one job."""
    rows = spark.createDataFrame(list(enumerate(values)), "k int, x string").withColumn("v", column)
    return [r.v for r in rows.orderBy("k").collect()]


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("v")).first()["v"]


HEADINGS = {"第7話 冬の橋": True, "第４５話": True, "五回目の手紙も届かない": False, "第四回目の検査は、長かった。": False, "Chapter 3": True, "Chapters of my life": False, "プロローグ": True, "一部だけ残った": False, "epilogue": True, "": False, "5回": True, "第⑫話": True, "第3話…": False}


def test_headings(spark):
    assert dict(zip(HEADINGS, column_of(spark, T.looks_like_heading(F.col("x")), HEADINGS))) == HEADINGS


def test_text_expressions(spark):
    assert one(spark, T.strip(F.col("x")), x="　 a b \x1f") == "a b"
    assert one(spark, T.script_fraction(F.col("x")), x="かな ab") == 0.5
    assert one(spark, T.script_fraction(F.col("x")), x=" \n") == 0.0
    assert one(spark, T.unclosed_quote(F.col("x")), x="「a」』「b") is True
    assert one(spark, T.unclosed_quote(F.col("x")), x="a」「b」") is False
    assert one(spark, T.strip_invisibles(F.col("x")), x="a​b﻿") == "ab"
    assert one(spark, T.furniture_kind(F.col("x")), x="- 12 -") == "page-number"
    assert one(spark, T.furniture_kind(F.col("x")), x="www.ex\nample.com") == "watermark"
    assert one(spark, T.furniture_kind(F.col("x")), x="12") is None
    assert one(spark, T.furniture_kind(F.col("x")), x="see example.com now") is None
    assert one(spark, scalars.resume_seconds(F.col("x"), F.lit(None).cast("int")), x=20) == 3600.0
    assert [one(spark, scalars.normal_pronoun(F.col("x")), x=p) for p in (" She ", "Female", "her", "M", "THEY", "it", "")] == ["she", "", "", "", "they", "", ""]


def test_segments(spark):
    docs = spark.createDataFrame([(1, "第1話 駅\r\n\r\nA。\r\n---\nB one line"), (2, "a\n\nb"), (3, "  "), (4, None), (5, "---\n***")], "k int, text string")
    got = {(r.k, r.idx): (r.title, r.paragraphs) for r in segment.by_separator(docs, key=["k"]).collect()}
    assert got == {(1, 1): ("第1話 駅", ["A。"]), (1, 2): ("Chapter 2", ["B one line"]), (2, 1): ("a", ["b"]), (5, 1): ("Chapter 1", ["---\n***"])}
    docs = spark.createDataFrame([(1, "note\n第1話\nx\n\ny\n第2話\n第3話\nz"), (2, "plain"), (3, "")], "k int, text string")
    got = {(r.k, r.idx): (r.title, r.paragraphs) for r in segment.by_heading(docs, key=["k"]).collect()}
    assert got == {(1, 1): ("Chapter 1", ["note"]), (1, 2): ("第1話", ["x", "y"]), (1, 3): ("第3話", ["z"]), (2, 1): ("Chapter 1", ["plain"])}
    assert segment.single(docs, key=["k"]).count() == 2


def test_metrics_and_done(spark):
    rows = spark.createDataFrame([(1, ["「かな」", "ab"]), (2, [])], "k int, paragraphs array<string>")
    got = {r.k: r for r in metrics.classify(metrics.chapter_metrics(rows)).collect()}
    assert (got[1].paragraph_count, got[1].dialogue_count, got[1].char_count, got[1].source_fraction, got[1].kind) == (2, 1, 6, 0.3333, "source")
    assert got[2].kind == "empty" and got[2].longest_paragraph == 0
    assert one(spark, incremental.is_done("no-such-kind", F.col("x"), F.col("x"), F.col("x")), x="validated") is False


def test_residue(spark):
    text = "He said もったいない.\n彼は駅で待っていた。\nhttps://x.jp/彼は行った。 草 <b>だ。</b>"
    rows = spark.createDataFrame([(1, text), (2, "plain"), (3, None)], "k int, text string")
    findings, per = leaks.report(leaks.subtract(rows), key=["k"])
    assert [(r.line, r.run) for r in findings.filter("k = 1").orderBy("line").collect()][0] == (2, "彼は駅で待っていた。")
    flags = {r.k: (r.flagged, r.worst_line) for r in per.collect()}
    assert flags[1][0] and flags[1][1] == 2 and flags[2] == (False, None) and flags[3] == (False, None)
    terms = spark.createDataFrame([(0, "彼は駅で待っていた")], "rank int, spelling string")
    assert not leaks.report(leaks.subtract(rows, terms=terms, key=["k"]), key=["k"])[1].filter("flagged and worst_line = 2").count()
    rules = leaks.ResidueRules()
    assert max(w for _, w, _, _ in rules.signals()) < rules.flag_at


def test_chatter(spark):
    blocks = ["Here is the translation of the chapter.", "She ran.", "* * *", "Let me redo this chapter. The rain fell on the old station all night.", "“Let me translate the text,” he said.", "the glossary says so"]
    rows = spark.createDataFrame([(1, "\n\n".join(blocks)), (2, "")], "k int, text string")
    verdicts = [r.verdict for r in leaks.judge_blocks(rows, key=["k"]).orderBy("place").collect()]
    assert verdicts == ["remove", "keep", "remove", "report", "keep", "report"]
    got = leaks.strip_chatter(rows, key=["k"]).first()
    assert len(got.removed) == 2 and len(got.suspicious) == 2 and "She ran." in got.clean


def boxes(spark, rows):
    cells = [(1, k, f"r{k}", *map(float, r), "t", "bubble", k, "", "none") for k, r in enumerate(rows)]
    return spark.createDataFrame(cells, "page_id int, list_pos int, region_id string, x double, y double, w double, h double, text string, kind string, ord int, join_prev string, join_glue string")


@pytest.mark.parametrize(
    ("rows", "rtl"),
    [
        ([(0, 0, 0.4, 0.4), (0.5, 0, 0.4, 0.4), (0, 0.5, 0.4, 0.4), (0.5, 0.5, 0.4, 0.4)], [1, 0, 3, 2]),
        ([(0, 0, 0.9, 0.2), (0, 0.3, 0.4, 0.4), (0.5, 0.3, 0.4, 0.4)], [0, 2, 1]),
        ([(0.6, 0, 0.3, 0.9), (0, 0, 0.5, 0.4), (0, 0.5, 0.5, 0.4)], [0, 1, 2]),
        ([(0, 0, 0, 0), (0.5, 0.5, 0, 0)], [0, 1]),
        ([(float("nan"), 0, 0.1, 0.1), (0.2, 0.5, 0.3, 0.2)], [0, 1]),
        ([(0, 0, 0.5, 0.5), (0.4, 0.4, 0.5, 0.5)], [1, 0]),
    ],
)
def test_reading_order(spark, rows, rtl):
    got = layout.reading_order(boxes(spark, rows)).orderBy("proposed")
    assert [r.list_pos for r in got.collect()] == rtl


def test_pages_that_need_many_passes(spark):
    """A spiral: every pass cuts one box off. The passes double for this page only; the query does not fail."""
    x0, y0, x1, y1, rows = 0.0, 0.0, 1.0, 1.0, []
    for k in range(22):
        w, h = (x1 - x0) / 5, (y1 - y0) / 5
        box = [(x0, y0, x1 - x0, h * 0.8), (x1 - w * 0.8, y0, w * 0.8, y1 - y0), (x0, y1 - h * 0.8, x1 - x0, h * 0.8), (x0, y0, w * 0.8, y1 - y0)][k % 4]
        rows.append(box)
        x0, y0, x1, y1 = (x0 + w * (k % 4 == 3), y0 + h * (k % 4 == 0), x1 - w * (k % 4 == 1), y1 - h * (k % 4 == 2))
    pages = boxes(spark, rows).unionByName(boxes(spark, [(0, 0, 0.4, 0.4), (0.5, 0, 0.4, 0.4)]).withColumn("page_id", F.lit(2)))
    assert {r.page_id for r in layout.reading_order(pages, slack=0).filter("not settled").collect()} == {1}
    got = layout.exact_order(pages, slack=0)
    assert got.count() == 24
    order = [r.list_pos for r in got.filter("page_id = 1").orderBy("proposed").collect()]
    first = [k for k in range(22) if k % 4 in (0, 1)]  # the top and the right come before what they are cut off from
    assert order == first + [k for k in reversed(range(22)) if k % 4 in (2, 3)]


def test_reversed(spark):
    rows = [(0, 0, 0.4, 0.4), (0.5, 0, 0.4, 0.4)]
    assert layout.check(boxes(spark, rows)).first().asDict() == {"page_id": 1, "regions": 2, "disagreement": 2, "reversed": True}
    assert layout.check(boxes(spark, rows[::-1])).first().reversed is False


def test_reads_and_furniture(spark):
    """The measured size wins, ids are places in the response, watermark is not believed, a turned page is distrusted."""
    one = '{"text": " a ", "kind": "odd", "box": [10, 20, 30, 40], "order": 5}, {"text": " "}, {"text": "b", "kind": "sfx", "box": ["20", 10, 20, 20], "order": "1", "join_prev": "gap"}, {"text": "sign", "kind": "watermark"}, {"text": "-7-"}, "no region"'
    raw = f'Sure: ```json\n{{"width": 100, "height": 200, "meta": {{"confidence": "High ", "heading": " 第1話 ", "starts_mid_sentence": "Yes", "ends_mid_word": true, "notes": ["n1", " "]}}, "regions": [{one}]}}\n```'
    plain = '{"width": 50, "height": 10, "meta": {"confidence": "sure", "notes": "one"}, "regions": [{"text": "x", "box": [5, 5, 5, 5]}]}'
    rows = spark.createDataFrame([(1, raw), (2, "no"), (3, None), (4, plain), (5, '{"cut": ["off'), (6, raw)], "page_id int, raw string")
    sizes = spark.createDataFrame([(1, 200.0, 100.0), (4, 0.0, 0.0), (6, 400.0, 100.0)], "page_id int, width double, height double")
    found, meta, rejects = regions.parse_reads(rows, sizes)
    got = [(r.page_id, r.region_id, round(r.x, 3), r.text, r.kind, r.ord, r.join_prev) for r in found.orderBy("page_id", "list_pos").collect()]
    assert got[:4] == [(1, "r0", 0.05, "a", "body", 3, ""), (1, "r2", 0.1, "b", "sfx", 0, "gap"), (1, "r3", 0.0, "sign", "body", 1, ""), (1, "r4", 0.0, "-7-", "page-number", 2, "")]
    assert got[4] == (4, "r0", 0.1, "x", "body", 0, "") and got[5][2] == 0.025
    flags = {r.page_id: r for r in meta.collect()}
    assert flags[1].turned and flags[1].confidence == "low" and flags[1].notes == ["n1", regions.TURNED] and flags[1].heading == "第1話"
    assert (flags[1].starts_mid_sentence, flags[1].ends_mid_sentence, flags[1].ends_mid_word) == (True, False, True)
    assert (flags[6].turned, flags[6].confidence, flags[6].width) == (False, "high", 400.0)
    assert (flags[4].confidence, flags[4].notes, flags[4].width) == ("low", ["one"], 50.0) and sorted(r.page_id for r in rejects.collect()) == [2, 3, 5]
    assert [(r.page_id, r.region_id) for r in regions.gaps(found).collect()] == [(1, "r2"), (6, "r2")]
    assert [r.ord for r in regions.with_orders(found.withColumn("ord", F.lit(9) - F.col("list_pos"))).filter("page_id = 1").orderBy("list_pos").collect()] == [3, 2, 1, 0]
    marked = regions.mark_furniture(spark.createDataFrame([(1, "x", "watermark"), (2, "― 7 ―", "body"), (3, "x", "page-number")], "k int, text string, kind string"))
    assert {r.k: (r.kind, r.changed) for r in marked.collect()} == {1: ("body", True), 2: ("page-number", True), 3: ("page-number", False)}
    assert regions.mark_furniture(marked.drop("changed")).filter("changed").count() == 0
    wrong = regions.violations(found.withColumn("kind", F.when(F.col("page_id") == 6, "odd").otherwise(F.col("kind"))), meta)
    assert {r.page_id: r.confidence for r in regions.distrust(meta, wrong).collect()}[6] == "low"


ADDRESSES = [f"scans.{t}" for t in "com net org jp io co me info site xyz app tv cc to ru link online club top biz us uk kr cn fun moe blog page web".split()] + ["www.read.top", "ＲＥＡＤ．ｃｏｍ", "my\nscans.\nmoe", "https://a.b-c.blog/x?y"]
NUMBERS = ["－２６－", "—9—", "~ 1234 ~", "-②-"]
NO_FURNITURE = ["visit scans.moe", "mr.tanaka", "a..com", "1−1", "26", "-12345-", "- a -", "", None]


def test_furniture_both_ways(spark):
    got = column_of(spark, T.furniture_kind(F.col("x")), ADDRESSES + NUMBERS + NO_FURNITURE)
    assert got == ["watermark"] * len(ADDRESSES) + ["page-number"] * len(NUMBERS) + [None] * len(NO_FURNITURE)


STAYS = [  # prose that speaks like an announcement
    "Let us go home and start over.", "“Let me translate that for you,” said Ren.", "Let me write you a letter, Aya decided.", "I will give you the best version of myself.", "Let's redecorate.", "I apologise. Let me check the map.",
    "The translation exam was hard, and the text even harder.", "Here is the key to the attic.", "I'll carefully provide an answer.", "Let me gently rewrite history.", "Let me quietly translate.",
]
GOES = [
    "Let me translate.", "I'll now translate!", "let's render…", "Let me redo this.", "Let's re-do it.", "Let me carefully re-read it.", "Let me go ahead and start over.", "I will now provide the full translation.", "I'll just give you the rest of the chapter.",
    "Here's your translation:", "Here is the translated text", "Below is the translation of it.", "The translation follows.", "The translation is as follows", "Translated chapter:", "===NEW_TERMS===", "As an AI, I can not say.", "translator's note: a pun", "* * *", "___",
]
LOOKED_AT = [
    "Aya looked the word up in the glossary.", "Re-reading the passage twice, Kei put the lamp out.", "They argued about romanization all night.", "Let me redo this line. The rain had not let up since the morning bell.",
    "I'll translate the chapter. Meanwhile, Kei ran across the wet platform.", "The original Japanese was ambiguous, the clerk said.",
]


def test_commentary_both_ways(spark):
    blocks = {**dict.fromkeys(STAYS, "keep"), **dict.fromkeys(GOES, "remove"), **dict.fromkeys(LOOKED_AT, "report")}
    assert dict(zip(blocks, column_of(spark, leaks.verdict(F.col("x")), blocks))) == blocks


LEAKS = ["犬は橋の下で眠っていた。", "何してるの、君は。", "The door shut.　明日また来ますから、待っていてください。", "https://a.jp/x彼は何も言わなかった。", "ｶﾀｶﾅは読めないのだ。", "彼\u200bは\u200b駅\u200bへ行った。", "そんなことは言っていない", "草原を走る彼が見えた。"]
NO_LEAKS = ["The sign read 本日休業.", "Tanaka・Sato・田中・佐藤・鈴木", "もったいない! she said.", "She left.", "令和三年五月", "東京・大阪・名古屋", "草 草草 lol", "お好み焼き", "もういい", "www www", "！？。", "", "see `彼は行った。` and <b title=彼は行った。>x</b>"]


def test_residue_both_ways(spark):
    texts = spark.createDataFrame(list(enumerate(LEAKS + NO_LEAKS)), "k int, text string")
    got = [r.flagged for r in leaks.reported(leaks.subtract(texts)).orderBy("k").collect()]
    wrong = [t for t, flag, want in zip(LEAKS + NO_LEAKS, got, [True] * len(LEAKS) + [False] * len(NO_LEAKS)) if flag != want]
    assert wrong == []


def test_middle_dot_is_glue(spark):
    """A middle dot starts no run, is no topic's neighbour and is cut from the ends."""
    found = spark.createDataFrame([(1, "・彼は・行く・")], "k int, clean string").select(leaks.findings(F.col("clean"), leaks.ResidueRules(flag_at=0)).alias("f")).first().f
    assert [(x.run, "topic" in x.reasons) for x in found] == [("彼は・行く・", False)]


def test_residue_of_a_long_line_is_fast(spark):
    import time

    began = time.perf_counter()
    row = leaks.reported(spark.createDataFrame([(1, "「あい」" * 20_000)], "k int, clean string")).first()
    assert row.findings == 0 and time.perf_counter() - began < 20


def test_openers_of_pages(spark):
    """What opens a quotation or bracket of its own does not go on with an open one; straight quotes too."""
    cases = [("「今日は雨だ。", first + "続き", "finished-sentence") for first in "\"'“‘「『（([【《〈〝"]
    cases += [("「今日は雨だ。", "彼は言った", "open-quotation"), ("〝今日は", "続き", "open-quotation"), ("〝今日は〞", "続き", "no-signal"), ("終わった。", "次", "finished-sentence"), ("続く", "次", "no-signal"), ("「開いた", "  ", "no-signal"), ("a", "b", "chapter")]
    rows = [(k, side, 2 * k + side, text, "第2話" if side and reason == "chapter" else None) for k, (before, after, reason) in enumerate(cases) for side, text in enumerate((before, after))]
    pages = spark.createDataFrame(rows, "work_id int, ord int, page_id int, text string, heading string").withColumns({c: F.lit(False) for c in ("ends_mid_word", "ends_mid_sentence", "starts_mid_sentence")})
    got = [r.reason for r in seams.propose(pages).filter("ord = 1").orderBy("work_id").collect()]
    assert got == [reason if reason != "chapter" else "heading" for *_, reason in cases]


def test_tolerant_casts(spark):
    cell = lambda c, x: one(spark, c(F.col("x")), x=x)
    assert [cell(scalars.tolerant_notes, x) for x in ('["a", " ", 3]', " one ", "", "{}", "[faint scan] left", "[]")] == [["a", "3"], ["one"], [], [], ["[faint scan] left"], []]
    assert tuple(cell(scalars.tolerant_box, ["1", "2.5", "3", "4"])) == (1.0, 2.5, 3.0, 4.0) and tuple(cell(scalars.tolerant_box, ["1", "x", "3", "4"])) == (0.0,) * 4 and tuple(cell(scalars.tolerant_box, ["1"])) == (0.0,) * 4
    sides = [F.lit(v) for v in (0.25, 0.5, 0.1, 0.2)]
    assert tuple(one(spark, scalars.box_to_pixels(*sides, F.lit(800), F.lit(600)), x=1)) == (200.0, 300.0, 80.0, 120.0)
    assert tuple(one(spark, scalars.box_percent(*sides), x=1)) == (25.0, 50.0, 10.0, 20.0)
    assert one(spark, T.folded(F.col("x")), x="第１２話…㊤ﾊ①") == "第12話...上ハ1"
    rng = random.Random(5)
    pools = ["aeé\u0301\u0323\u0307 ", "ｶﾞﾊﾟハ\u3099㌔㍿①", "\u1112\u1161\u11ab한ㅎㅏ\uffa1", "ﬁ²½Å\u212b\u0345\u0300", "plain ASCII "]
    made = ["".join(rng.choice(rng.choice(pools)) for _ in range(rng.randint(0, 12))) for _ in range(300)] + ["", "ASCII only", None]
    got = column_of(spark, T.nfkc(F.col("x")), made)
    assert got == [unicodedata.normalize("NFKC", t or "") for t in made]


def test_assembly(spark):
    cells = [(1, 1, 1, "ok", "One ends", None, ""), (1, 2, 2, "ok", " here. ", None, "sentence"), (1, 3, 3, "ok", "  ", None, "chapter"), (1, 4, 4, "edited", "Two", "第2話", "chapter"), (1, 5, 5, "skipped", "no", None, "chapter"), (1, 6, 6, "ok", "Three", None, "gap")]
    pages = spark.createDataFrame(cells, "work_id int, ord int, seq int, status string, text string, heading string, join_prev string").withColumns({"page_id": F.col("seq"), "join_glue": F.lit("space")})
    made, warnings = seams.chapters(pages)
    assert [(r.idx, r.title, r.text) for r in made.orderBy("idx").collect()] == [(1, "Chapter 1", "One ends here."), (2, "第2話", "第2話\n\nTwo\n\nThree")]
    assert [r.seq for r in warnings.collect()] == [6]
    runs, _ = seams.spans(pages)
    assert [(r.idx, r.title, r.page_ids) for r in runs.orderBy("idx").collect()] == [(1, "Chapter 1", [1, 2]), (2, "Chapter 2", [3]), (3, "第2話", [4, 6])]


def test_saved_order_with_hints(spark):
    rows = spark.createDataFrame([(1, k, f"r{k}", t, k) for k, t in enumerate("aab")] + [(2, 0, "r0", "x", 0)], "page_id int, list_pos int, region_id string, text string, ord int")
    saved = spark.createDataFrame([(1, 0, "b", "r9"), (1, 1, "a", "r1"), (1, 2, "a", "r1"), (2, 0, "gone", "r0")], "page_id int, rank int, text string, region_id_hint string")
    got, bad = lines.apply_order(rows, saved)
    assert {(r.page_id, r.region_id): r.ord for r in got.collect()} == {(1, "r0"): 2, (1, "r1"): 1, (1, "r2"): 0, (2, "r0"): 0}
    assert [r.page_id for r in bad.collect()] == [2]


def test_glossary(spark):
    entries = spark.createDataFrame([("東京", "Tokyo", ["とうきょう"], "place", ""), ("木", "Ki", [], "person", ""), ("", "Anna", [], "person", "")], "source string, english string, variants array<string>, type string, reading string")
    chapters = spark.createDataFrame([(1, "とうきょうへ"), (2, "大木さん"), (3, "木さん"), (4, None)], "k int, text string")
    hits = glossary.relevant(chapters, glossary.spellings(entries, ["source"]), key=["k"], entry=["source"])
    assert sorted(map(tuple, hits.collect())) == [(1, "東京"), (3, "木")]
    proposed = spark.createDataFrame([(1, "アンナ", "ANNA", "person", "f"), (2, "東京", "x", "place", ""), (3, "新", "New", "thing", " HE "), (4, "新", "Other", "thing", ""), (5, None, "y", "thing", "")], "seq int, source string, english string, type string, pronoun string")
    queued, variants, rejected = glossary.admit(proposed, proposed.filter("false").select("source"), entries)
    assert [(r.source, r.pronoun) for r in queued.collect()] == [("新", "he")]
    assert [tuple(r) for r in variants.collect()] == [("Anna", "アンナ")]
    assert sorted(r.seq for r in rejected.collect()) == [2, 4, 5]


def test_records(spark):
    raw = "Sure!\n```tsv\n1:r0\tAnn\tHello\tthere\n1:r1\tHi\n1:r1\tBo\tagain\n9:r9\tX\ty\n1:r2\tC\t \n1:r2\tC\tlate\n```\n===NEW_TERMS===\n[{\"source\": \" 葵 \", \"english\": \"Aoi\", \"pronoun\": \"Female\", \"variants\": [\"あおい\", \" \"], \"note\": 3}, \"junk\", {\"english\": \"No source\"}]\n1:r3\tno\tline\nplain"
    rows = spark.createDataFrame([(1, raw), (2, None), (3, "l1\tA\t\nl1\tA\tHello"), (4, "x\ty\n===NEW_TERMS===\n[{]"), (5, "===NEW_TERMS=== none ===NEW_TERMS=== []")], "k int, raw string")
    expected = spark.createDataFrame([(1, f"1:r{i}") for i in range(4)] + [(2, "z"), (3, "l1"), (4, "x"), (5, "q")], "k int, id string")
    got, defects, terms = requests.parse_records(rows, expected, key=["k"])
    assert sorted((r.k, r.id, r.speaker, r.english) for r in got.collect()) == [(1, "1:r0", "Ann", "Hello\tthere"), (1, "1:r1", "", "Hi"), (1, "1:r2", "C", "late"), (3, "l1", "A", "Hello"), (4, "x", "", "y")]
    assert {r.k: (r.unexpected, r.duplicate, r.ignored, r.missing) for r in defects.collect()} == {1: (1, 1, 1, 1), 2: (0, 0, 0, 1), 3: (0, 0, 0, 0), 4: (0, 0, 0, 0), 5: (0, 0, 0, 1)}
    found = {r.k: r for r in terms.collect()}
    assert [t.asDict() for t in found[1].terms] == [{"source": "葵", "english": "Aoi", "type": "other", "note": "3", "pronoun": "Female", "register": "", "first_person": "", "reading": "", "variants": ["あおい"]}]
    assert {k: r.warnings for k, r in found.items()} == {1: ["blank-term"], 2: ["no-terms-mark"], 3: ["no-terms-mark"], 4: ["terms-unreadable"], 5: []}


def test_prose_responses(spark):
    raw = {
        1: "Let me translate.\n\nRain fell.\n\n***\n\nShe slept.\n===NEW_TERMS===\n[{\"source\": \"雨\", \"type\": \"Term\", \"reading\": \"あめ\"}] ===NEW_TERMS=== [1]",
        2: "Rain.", 3: "Let me translate this chapter. Then Haru closed the shutters and lay down.\n===NEW_TERMS===\n", 4: "A===NEW_TERMS===[\"junk\", {\"source\": \"s\", \"english\": \"E\"}, 5]", 5: None, 6: "A\n===NEW_TERMS===\n{\"a\": [1}",
    }
    rows = spark.createDataFrame(list(raw.items()), "k int, raw string")
    got = {r.k: r for r in requests.parse_prose(rows, key=["k"]).collect()}
    assert {k: r.body for k, r in got.items()} == {1: "Rain fell.\n\nShe slept.", 2: "Rain.", 3: "Let me translate this chapter. Then Haru closed the shutters and lay down.", 4: "A", 5: "", 6: "A"}
    assert {k: r.warnings for k, r in got.items()} == {1: ["commentary-removed", "terms-unreadable"], 2: ["no-terms-mark"], 3: ["commentary-mixed", "no-terms-array"], 4: [], 5: ["no-terms-mark", "no-text"], 6: ["no-terms-array"]}
    assert [(t.source, t.english, t.type) for t in got[4].terms] == [("s", "E", "other")]
    one = spark.createDataFrame([(1, 'A===NEW_TERMS===[{"source": "雨", "type": "Term", "reading": "あめ"}] done')], "k int, raw string")
    assert [(t.source, t.type, t.reading) for t in requests.parse_prose(one, key=["k"]).first().terms] == [("雨", "term", "あめ")]


def test_files(spark):
    rows = [(1, "日本語".encode()), (2, b"\xef\xbb\xbfabc"), (3, "彼は駅で待っていた。".encode("cp932")), (4, "彼は駅で待っていた。".encode("euc_jp")), (5, b"\x81\x00\xff"), (6, None)]
    got = {r.k: (r.encoding, r.text) for r in files.decoded(spark.createDataFrame(rows, "k int, content binary")).collect()}
    assert got[1] == ("utf-8", "日本語") and got[2] == ("utf-8-bom", "abc") and got[3] == ("cp932", "彼は駅で待っていた。") and got[4] == ("euc_jp", "彼は駅で待っていた。")
    assert got[5][0] == "replaced" and got[6] == (None, None)
    jpeg = b"\xff\xd8" + (b"\xff\xe1" + struct.pack(">H", 60_000) + b"x" * 59_998) * 2 + b"\xff\xc2" + struct.pack(">HBHH", 17, 8, 600, 800) + b"0" * 20
    webp = b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<I", 10) + b"\0" * 4 + (639).to_bytes(3, "little") + (479).to_bytes(3, "little")
    images = spark.createDataFrame([("a", jpeg), ("b", webp), ("c", b"\0\0\0\x18ftypheic"), ("d", b""), ("e", jpeg[:100])], "path string, content binary")
    got = {r.path: (r.kind, r.width, r.height, r.refused) for r in files.image_inventory(images).collect()}
    png = lambda w: b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", w, 9)
    big = {r.path: r.width for r in files.image_inventory(spark.createDataFrame([("f", png(199_999)), ("g", png(200_001))], "path string, content binary")).collect()}
    assert big == {"f": 199_999, "g": 0}
    assert got["a"] == ("jpeg", 800, 600, None) and got["b"] == ("webp", 640, 480, None) and got["c"][3] == "convert-first" and got["d"][0] == "unknown" and got["e"][:3] == ("jpeg", 0, 0)


def test_exports_of_any_depth(spark):
    para = lambda t: {"paragraph": {"elements": [{"textRun": {"content": t}}]}}
    table = lambda *content: {"table": {"tableRows": [{"tableCells": [{"content": list(content)}]}]}}
    tab = {"tabProperties": {"title": " "}, "documentTab": {"body": {"content": [para("a\u200b\n"), para(" \n"), table(para("b"), table(para("c")), para("d")), para("e")]}}}
    deep = {"documentTab": {"body": {"content": [para("leaf")]}}}
    for k in range(6):
        deep = {"documentTab": {"body": {"content": [para(f"level {k}")]}}, "childTabs": [deep]}
    raw = json.dumps({"title": "T", "tabs": [{**tab, "childTabs": [deep, {"documentTab": {}}]}, {"tabProperties": {"title": "Two"}}]})
    got = files.flatten_documents(spark.createDataFrame([(1, raw), (2, "[]"), (3, None), (4, "{")], "k int, raw string"), key=["k"]).collect()
    assert [(r.idx, r.title, r.paragraphs) for r in got] == [(1, "Chapter 1", ["a", "b", "c", "d", "e", *(f"level {k}" for k in reversed(range(6))), "leaf"]), (2, "Two", [])]


def test_plausible_decoding(spark):
    """Text with marks beyond kana and kanji: the right decoding has more of them."""
    for text in ("※「〈ＡＢＣ〉～々〆」ー！", "〔第３章〕　彼は言った…ｱｲ", "㈱", "①②③"):
        data = text.encode("cp932")
        assert files.decode(data) == (text, "cp932")


def test_extractors(spark):
    """Assembly takes text and heading from wherever it is told."""
    pages = spark.createDataFrame([(1, 1, 1, 1, "ok", "raw", {"t": "One"}), (1, 2, 2, 2, "ok", "raw", {"t": "Two", "h": "Part 2"})], "work_id int, ord int, seq int, page_id int, status string, text string, read map<string,string>")
    pages = pages.withColumns({"heading": F.lit(None).cast("string"), "join_prev": F.lit("chapter"), "join_glue": F.lit("none"), **{c: F.lit(False) for c in ("ends_mid_word", "ends_mid_sentence", "starts_mid_sentence")}})
    text, heading = (lambda p: F.col("read")["t"]), (lambda p: F.col("read")["h"])
    assert [(r.title, r.text) for r in seams.chapters(pages, text_of=text, heading_of=heading)[0].orderBy("idx").collect()] == [("Chapter 1", "One"), ("Part 2", "Part 2\n\nTwo")]
    assert [r.reason for r in seams.propose(pages, heading_of=heading).orderBy("ord").collect()] == [None, "heading"]
    assert [r.title for r in seams.spans(pages, heading_of=heading)[0].orderBy("idx").collect()] == ["Chapter 1", "Part 2"]


def test_places_of_large_groups(spark):
    rows = spark.createDataFrame([(k % 3 if k % 3 else None, (k * 7919) % 500) for k in range(500)], "g int, v int")
    got = ranks.numbered(rows, by=["g"], order=[F.col("v")]).collect()
    for g in (None, 1, 2):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.place)
        assert [r.place for r in own] == list(range(1, len(own) + 1)) and [r.v for r in own] == sorted(r.v for r in own)
    assert [r.place for r in ranks.numbered(rows, by=[], order=[F.col("v")]).orderBy("v").collect()] == list(range(1, 501))


def test_script_rounds(spark):
    """Chunks go out one after another; a poor answer counts, one to what was not asked does not; the tail has English where there is some."""
    lines = spark.createDataFrame([(1, p, k, f"{p}:r{k}", "bubble", f"word{p}{k} " * 3, k // 2) for p in (1, 2, 3) for k in range(3)] + [(2, 1, 0, "1:r0", "sfx", "BANG", None), (2, 1, 1, "1:r1", "sfx", " ", 1)], "work_id int, page_seq int, place int, id string, kind string, text string, panel int")
    blocks = {(r.work_id, r.page_seq): (r.block, r.ids) for r in scripts.script_blocks(lines, key=["work_id"]).collect()}
    assert blocks[1, 1] == ("Page 1\n1:r0\t[bubble]\tword10 word10 word10\n1:r1\t[bubble]\tword11 word11 word11\nPage 1, panel 1\n1:r2\t[bubble]\tword12 word12 word12", ["1:r0", "1:r1", "1:r2"])
    assert blocks[2, 1] == ("Page 1\n1:r0\t[sfx]\tBANG", ["1:r0"])
    none = spark.createDataFrame([], "work_id int, chunk_no int, raw string")

    def respond(due):
        raw = F.when(F.col("chunk_no") == 1, "no records").otherwise(F.concat(F.element_at("ids", -1), F.lit("\tWho\tEnglish\n9:r9\tx\ty")))
        return due.select("work_id", "chunk_no", raw.alias("raw")).unionByName(spark.createDataFrame([(7, 0, "never asked"), (1, 99, "nor this")], none.schema))

    due = lambda tail: lambda responses: scripts.due_scripts(lines, responses, key=["work_id"], threshold=90, tail=tail)
    asked, responses = scripts.rounds(due(2), respond, none)
    got = {(r.work_id, r.chunk_no): r for r in asked.collect()}
    assert {k: r.round for k, r in got.items()} == {(1, 0): 0, (2, 0): 0, (1, 1): 1, (1, 2): 2} and {(r.work_id, r.chunk_no) for r in responses.collect()} == set(got)
    assert got[1, 0].tail == "" and got[1, 1].tail == "word11 word11 word11\nword12 word12 word12\t->\tEnglish" and got[1, 2].tail == "word21 word21 word21\nword22 word22 word22"
    assert got[1, 1].message.startswith("Part 2 of 3; done up to part 1.\n\nHow the last part ended:\n\nword11") and got[1, 1].system == scripts.CONTRACT and got[2, 0].message == "Lines, in this order:\n\nPage 1\n1:r0\t[sfx]\tBANG"
    assert {r.tail for r in due(0)(none).collect()} == {""}
    assert scripts.rounds(lambda r: scripts.due_scripts(lines.filter("false"), r, key=["work_id"]), respond, none)[0].count() == 0


def test_replay_keeps_a_thousand_events_of_each_work(spark, tmp_path):
    """The replay buffer is the newest 1,000 recorded events: a work with fewer keeps all, one with more loses its oldest."""
    from pagemill.plans.work import replay_tail

    base = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    work = F.when(F.col("id") < 1_100, F.lit(1)).otherwise(F.lit(2)).cast(base.schema["user_id"].dataType)
    kind = F.when(F.col("id") % 10 == 0, "view").otherwise("purchase")
    own = {"event_id": F.col("id").cast(base.schema["event_id"].dataType), "user_id": work, "event_type": kind, "props": F.lit('{"k": 1}')}
    rows = spark.range(2_000).select(*[own.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in base.schema])
    rows = rows.unionByName(rows.filter("user_id = 1").withColumns({"event_id": F.col("event_id") + 5_000}))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = {k: sorted(r.event_id for r in replay_tail(spark, str(tmp_path)).filter(f"work_id = {k}").collect()) for k in (1, 2)}
    recorded = [i for i in [*range(1_100), *range(5_000, 6_100)] if i % 10]
    assert got == {1: recorded[-1_000:], 2: [i for i in range(1_100, 2_000) if i % 10]}
