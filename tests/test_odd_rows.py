"""Queries against their SQL twins on rows that the given tables don't have."""

import duckdb
import pytest

from pagemill.operators import glossary
from pagemill.plans import ORACLES, QUERIES

TEXTS = [None, "", " ", "\n", "\n\n\n", "Chapter 3\nPart 9", "one\nPrologue\n\ntwo", "a\x01b\x02c\nepilogue\nd\x01", "\x02", "x\r\nVol. 4\r\ny\r\n", "　\n５回\n　", "Part 2.\nEp 3: z"]


def twin_rows(spark, path, name, tables):
    """What the query and its twin give on tables {name: (schema, rows)}, sorted."""
    con = duckdb.connect()
    for t, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet/*.parquet'")
    found, expected = QUERIES[name](spark, str(path)), con.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(expected.columns)
    return sorted(map(tuple, found.select(*expected.columns).collect()), key=repr), sorted(expected.fetchall(), key=repr)


MARKED = ["`a`<b>https://x.jp/y `c`", "<b>`駅で待っていた。`</b>", "彼は駅で待っていた。もったいない。\nhttps://x.jp/彼は行った。", "[図](x) ![](y)彼を待つ。"]


@pytest.mark.parametrize("name", ["default_headings", "default_findings", "default_residue"])
def test_twins_on_odd_texts(spark, tmp_path, name):
    rows = [(11 * k + k % 11 + j, t) for k, t in enumerate(TEXTS + MARKED * (name != "default_headings")) for j in (0, 200, 403)]
    found, expected = twin_rows(spark, tmp_path, name, {"documents": ("doc_id long, text string", rows)})
    assert found == expected


@pytest.mark.parametrize("name", ["default_findings", "default_residue"])
def test_each_step_of_cleaning_is_worked_out_once(spark, name):
    """Three patterns and the runs are searched once each (and the counted script): nested uses and inferred filters would multiply the searches."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 4 + (name == "default_residue")


def test_candidates_hold_every_spelling_of_a_text(spark):
    """By the numbers of grams and by the grams themselves: names of one to six characters, beyond the basic plane, too."""
    names = ["a", "é", "😀", "ab", "x😀y", "駅前", "橋の下", "abcd", "abcdef", "a b c", "nowhere", "zz"]
    texts = [None, "", "a", "é", "the 😀", "x😀y ab", "駅前の橋の下で", "abcdef a b c", "zz\nzz", "b", "abc def"]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    terms = spark.createDataFrame([(n, n) for n in names], "name string, spelling string")
    want = {(k, n) for k, t in enumerate(texts) for n in names if n in (t or "")}
    for bound in (glossary.SENT_OUT, 0):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(glossary, "SENT_OUT", bound)
            found = {(r.k, r.name) for r in glossary.candidates(docs, terms, key=["k"], entry=["name"]).collect()}
            assert want <= found
            assert {(r.k, r.name) for r in glossary.relevant(docs, terms, key=["k"], entry=["name"], boundary=None).collect()} == want


def test_the_allow_list_cleans_texts_once(spark):
    plan = QUERIES["allow_list_subtract"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RLIKE" not in plan and "regexp_extract_all" not in plan
