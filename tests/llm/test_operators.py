"""The ten operators against plain versions, round trips and planted cases, on small tables with odd rows."""

import hashlib
import itertools
import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from pagemill.llm import bpe, fingerprints, langid, media, neardup, packing, pii, tokenfile, toxicity, warc

SF = "/root/testdata/sf0.001"
ODD = [
    "", None, " ", "\n\n", "a", "Hello world", "Hello world", "hello WORLD  twice\n\nlines ", "x\ty\r\nz", "don't I'LL we've 12345 a1b2 ²½ Ⅷ", "<|endoftext|> hi <|startoftext|>there", "<| no",
    "Straße ÀÉ İstanbul ΣΑΣ é caf\xa0x   y\x1fz\x1c", "日本語テキスト😀 ok", "àb ö", "word " * 3000, "zq" * 4000, "aaaa" * 50 + " hahahahaha", "___ -- ... !!!", "\x00\x01 null",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, "en", "clash") for k, t in enumerate(ODD)] + [(None, "no id", "de", "x"), (None, None, None, None), (5, ODD[5], "en", "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fingerprint string").withColumns({"ids": F.lit(1), "file": F.lit("c"), "score": F.lit(0.5), "place": F.lit("p"), "run": F.lit(0), "n_chars": F.lit(3).cast("long")})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def empty(frame):
    return frame.filter("false")


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_is_the_librarys(docs, name):
    enc = bpe.Encoder(bpe.vocabulary(name))
    texts = [t or "" for t in ODD] + [r.text for r in docs.select("text").collect()]
    ids, offsets = enc.encode(pa.array(texts, pa.large_string()))
    for t, a, b in zip(texts, offsets, offsets[1:]):
        want = enc.library.encode(t, add_special_tokens=False).ids
        assert ids[a:b].tolist() == want
        assert enc.decode(ids[a:b]) == enc.library.decode(want, skip_special_tokens=False)


def test_bpe_speculation_is_exact_for_all_tokens():
    """Every pair of a few hundred tokens: compatible exactly where the merges leave the pair alone."""
    m = bpe.Encoder(bpe.vocabulary("byte_bpe_50k.json")).merges
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 30_000, 3000), rng.integers(0, 30_000, 3000)
    names = {i: t for t, i in bpe.Encoder(bpe.vocabulary("byte_bpe_50k.json")).library.get_vocab().items()}
    words = [names[int(i)] + names[int(j)] for i, j in zip(a, b)]
    width = max(map(len, words))
    letters = np.array([[*map(ord, w), *[bpe.PAD] * (width - len(w))] for w in words], np.int64)
    merged = m.merge(letters)
    alone = np.array([r[r >= 0].tolist() == [i, j] for r, i, j in zip(merged, a, b)])
    fine = m._compatible(a, b)
    own = np.array([len(m.merge(np.array([[*map(ord, names[int(i)])]]))[0]) >= 0 for i in a])
    assert (alone <= fine)[own].all() and (fine & ~alone).sum() <= 3  # the few are tokens that no text gives


def test_long_words_are_the_librarys():
    rng = np.random.default_rng(9)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        enc = bpe.Encoder(bpe.vocabulary(name))
        for n, letters in ((513, "abcdefghijklmnopqrstuvwxyz"), (3000, "aab"), (200_000, "etaoinshrdlué"), (1000, "a"), (5000, "日本語テキ"), (700, "0"), (700, "-=")):
            text = "".join(rng.choice(list(letters), n))
            assert enc.encode(pa.array([text]))[0].tolist() == enc.library.encode(text, add_special_tokens=False).ids


def test_bpe_rows(odd):
    got = bpe.bpe_round_trip(odd)
    assert got.count() == odd.count() and bpe.bpe_round_trip(empty(odd)).count() == 0
    r = got.filter("doc_id = 0").first()
    assert (r.n_tokens, r.ids_sha256, r.decoded) == (0, hashlib.sha256(b"").hexdigest(), "")


def test_fingerprints(odd, docs):
    got = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    for k, (i, t) in enumerate(rows):
        u, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        own, new, following = fingerprints.simhash(pa.array([t, edited, u]))
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(t)
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (own.hex(), new.hex())
        assert got[i].near_next == fingerprints.likeness([own], [following])[0]
    assert fingerprints.edited_fingerprints(odd).count() == odd.count() and fingerprints.edited_fingerprints(empty(odd)).count() == 0
    assert fingerprints.edited_fingerprints(docs.limit(1)).first().near_next == 1.0


def test_permuted_tables_find_all_in_radius(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 256, (40, 32), dtype=np.uint8)
    rows = []
    for k, b in enumerate(base):
        for d in range(6):
            bits = np.unpackbits(b)
            bits[rng.choice(256, d, replace=False)] ^= 1
            rows.append((10 * k + d, bytearray(np.packbits(bits).tobytes())))
    fps = spark.createDataFrame(rows, "doc_id long, fingerprint binary")
    got = {(r.query_id, r.doc_id): r.distance for r in fingerprints.within_radius(fps.filter("doc_id % 10 = 0"), fps, 3).collect()}
    codes = {i: np.unpackbits(np.frombuffer(bytes(f), np.uint8)) for i, f in rows}
    want = {(q, i): int((codes[q] != codes[i]).sum()) for q in codes if q % 10 == 0 for i in codes}
    assert got == {k: v for k, v in want.items() if v <= 3}


def test_fingerprint_report_counts_rows_in_radius(spark, docs, odd, monkeypatch):
    """Against all pairs; with every key of the permuted tables split."""
    rows = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") * 100).alias("doc_id"), "text"))
    monkeypatch.setattr(fingerprints, "HOT_KEY", 2)
    got = fingerprints.fingerprint_report(rows).collect()
    codes = np.array([np.unpackbits(np.frombuffer(bytes.fromhex(r.fingerprint), np.uint8)) for r in got])
    for k, r in enumerate(got):
        asked = r.doc_id is not None and r.doc_id % 100 == 0
        assert r.n_within == (int(((codes != codes[k]).sum(1) <= 3).sum()) if asked else None)
    assert fingerprints.fingerprint_report(empty(odd)).count() == 0


def test_one_doc_id_fills_several_ranges(spark):
    rows = spark.createDataFrame([(7 if k % 4 else None if k % 8 else k, f"text {k} of many words {k * k}") for k in range(400)], "doc_id long, text string")
    got = fingerprints.edited_fingerprints(rows).collect()
    assert len(got) == 400
    data = sorted(((-(2**63) if r.doc_id is None else r.doc_id, -h, r.text) for r, h in ((r, r.h) for r in rows.withColumn("h", F.xxhash64("text")).collect())), reverse=True)
    want = {}
    for (_, _, t), (_, _, u) in zip(data, data[1:] + data[:1]):
        want[hashlib.sha256((t[: len(t) - len(t) // 2] + u[: len(t) // 2]).encode()).hexdigest()] = fingerprints.likeness(fingerprints.simhash(pa.array([t])), fingerprints.simhash(pa.array([u])))[0]
    assert {r.edited_sha256: r.near_next for r in got} == want


def test_runs_of_one_value_are_shared_by_checksum():
    bounds = np.array([3, 5, 5, 5, 9])
    ids, sums = np.repeat([1, 3, 4, 5, 7, 9, 12], 100), np.tile(np.arange(100) << 25, 7)
    runs = tokenfile.run_of(bounds, ids, sums)
    order = np.lexsort((sums, ids))
    assert (np.diff(runs[order]) >= 0).all() and len(np.unique(runs[ids == 5])) == 4 and len(np.unique(runs[ids == 4])) == 1


def test_files_follow_the_bytes(spark, tmp_path, monkeypatch):
    """One doc_id with most rows does not end in one file, and starts go on over it."""
    monkeypatch.setattr(tokenfile, "FILE_BYTES", 2000)
    rows = spark.createDataFrame([(7 if k % 3 else k, f"text {k} of some words") for k in range(600)], "doc_id long, text string")
    manifest = tokenfile.write_tokens(rows, f"file://{tmp_path}/c")
    got = sorted(tokenfile.read_tokens(spark, manifest).collect(), key=lambda r: r.start)
    assert len(manifest) > 5 and max(m["documents"] for m in manifest) < 300
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in rows.collect())
    assert [r.start for r in got] == [sum(r.n_tokens for r in got[:k]) for k in range(len(got))]
    assert not list((tmp_path / "c").glob(".part-*"))


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("hot", [neardup.HOT_GROUP, 3])
def test_near_duplicates(spark, docs, odd, hot):
    rows = docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    got = {r.doc_id: r for r in neardup.near_duplicates(rows, hot=hot).collect()}
    data = [(r.doc_id, plain_fingerprint(r.text)) for r in rows.filter("doc_id is not null").distinct().orderBy("doc_id").collect()]
    codes = np.array([f for _, f in data], np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(codes[:, None] ^ codes[None]) <= 3, 1))
    label = neardup.components(len(data), a, b)
    for k, (i, f) in enumerate(data):
        assert (got[i].fingerprint, got[i].component_id) == (f"{f:016x}", data[label[k]][0])
    assert got[None].component_id is None and neardup.near_duplicates(empty(odd)).count() == 0


def test_dense_groups_are_linked_whole():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2**63, 3, dtype=np.uint64)
    codes = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 4000).astype(np.uint64)) for c in centre] + [rng.integers(0, 2**63, 500, dtype=np.uint64)]))
    codes = codes[np.argsort(neardup.gray_rank(codes))]
    label = neardup.link_groups(np.zeros(len(codes)), codes, 3)
    a, b = np.nonzero(np.triu(np.bitwise_count(codes[:, None] ^ codes[None]) <= 3, 1))
    assert (label == neardup.components(len(codes), a, b)).all()


@pytest.mark.parametrize("radius", [3, 4, 8, 11])
@pytest.mark.parametrize("hot", [neardup.HOT_GROUP, 3])
def test_blocks_of_any_radius_lose_no_pair(spark, radius, hot):
    assert len(neardup.blocks(F.lit(0), radius + 1, range(64))) == radius + 1
    rng = np.random.default_rng(radius)
    codes = rng.integers(0, 2**64, 60, dtype=np.uint64)
    bits = [rng.choice(64, radius, replace=False) for _ in codes]
    bits[0] = np.array([64 * k // (radius + 1) for k in range(radius)])  # one difference in each block but the last
    codes = np.r_[codes, [c ^ np.uint64(sum(1 << int(x) for x in b)) for c, b in zip(codes, bits)]]
    fps = spark.createDataFrame([(int(c), k) for k, c in enumerate(codes.view(np.int64))], "fp long, id long")
    edges = neardup.link_stars(fps, radius, hot).collect()
    label = neardup.components(len(codes), np.array([e.u for e in edges]), np.array([e.v for e in edges]))
    assert (label[:60] == label[60:]).all()


def similar_pairs(rows, least=0.8):
    """All pairs of rows (id, text) whose sets of 5-word shingles have this similarity, by brute force."""
    sets, holders, found = {}, {}, set()
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset([None])
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    for own in holders.values():
        found |= {(a, b) for a in own for b in own if a < b}
    return {(a, b) for a, b in found if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])}


@pytest.mark.parametrize("split", [neardup.SPLIT, 2])
def test_near_copies_are_all_pairs_at_four_fifths(spark, docs, odd, split):
    """Copies with edited words, from nearly equal to just below the limit, and a chain whose ends are unlike."""
    rng = np.random.default_rng(8)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").unionByName(odd.select((F.col("doc_id") + 10_000).alias("doc_id"), "text")).filter("doc_id is not null").distinct().collect()]
    for k in range(300):
        w = [f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(20, 400)))]
        edited = list(w)
        for at in rng.choice(len(w), max(1, int(len(w) * rng.choice([0.005, 0.01, 0.02, 0.025]))), replace=False):
            edited[at] = "edited"
        rows += [(20_000 + 2 * k, " ".join(w)), (20_001 + 2 * k, " ".join(edited))]
    chain = [f"c{x}" for x in range(100)]
    rows += [(30_000 + k, " ".join([*chain[4 * k :], *(f"d{x}" for x in range(4 * k))])) for k in range(6)]
    want = sorted(similar_pairs(rows))
    assert len(want) > 200
    got = {r.doc_id: r.component_id for r in neardup.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), split=split).collect()}
    place = {i: k for k, i in enumerate(sorted(i for i, _ in rows))}
    label = neardup.components(len(rows), *(np.array([place[p[j]] for p in want]) for j in (0, 1)))
    ids = sorted(place)
    linked = sum(got[a] == got[b] for a, b in want)
    assert linked == len(want), f"recall {linked / len(want)}"
    assert [got[i] for i in ids] == [ids[k] for k in label]  # nothing else is linked
    assert neardup.near_copies(empty(odd)).count() == 0


def test_no_link_depends_on_the_tables(spark, monkeypatch):
    """With one SimHash table of keys that hardly any pair shares, all pairs at four fifths are linked all the same."""
    monkeypatch.setattr(neardup, "tables_for", lambda *_: (32, 1))
    rows = []
    for k in range(40):
        w = [f"w{k}x{x}" for x in range(14 + 10 * k)]
        cut = (len(w) - 4) * 8 // 10 + 4 if k % 2 else len(w) - 1
        rows += [(3 * k, " ".join(w)), (3 * k + 1, " ".join(w[:cut])), (3 * k + 2, " ".join(w[: len(w) // 2]))]
    want = similar_pairs(rows)
    got = {r.doc_id: r.component_id for r in neardup.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(want) >= 40 and {(a, b) for a, b in itertools.combinations(sorted(got), 2) if got[a] == got[b]} == want


def test_simhash_tables_hold_pairs_at_four_fifths(spark):
    """Candidates of the stage come by SimHash: pairs at the limit are near and share a table, also where crowded groups are dealt as blocks; unlike ones are not."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(40):
        own = rng.integers(0, 2**64, 500, dtype=np.uint64)
        rows += [(2 * k + j, len(s), neardup.wide_fingerprint(s).tolist()) for j, s in enumerate((own[:450], own[50:]))]
    fps = spark.createDataFrame(rows, "node long, size long, fp array<long>")
    for hot in (neardup.HOT_GROUP, 1):
        held = {}
        for r in neardup.near_fingerprints(fps, 0.8, hot).collect():
            held.setdefault(r.key, set()).add(r.node)
        assert {(min(g), max(g)) for g in held.values()} == {(2 * k, 2 * k + 1) for k in range(40)}


def test_a_common_passage_makes_no_candidates(spark):
    """Texts that share a third are no candidates, and a pair that shares many tables is one group."""
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 2**64, 150, dtype=np.uint64)
    sets = [np.r_[passage, rng.integers(0, 2**64, 150, dtype=np.uint64)] for _ in range(80)]
    sets.append(np.r_[sets[0][:290], rng.integers(0, 2**64, 10, dtype=np.uint64)])
    fps = spark.createDataFrame([(k, len(s), neardup.wide_fingerprint(s).tolist()) for k, s in enumerate(sets)], "node long, size long, fp array<long>")
    assert sorted(r.node for r in neardup.near_fingerprints(fps, 0.8, neardup.HOT_GROUP).collect()) == [0, 80]


def test_the_stage_drops_near_copies(spark, odd):
    import corpus_pipeline

    text = " ".join(f"w{k}" for k in range(200))
    rows = odd.limit(0).unionByName(odd.limit(1).withColumns({"doc_id": F.lit(1).cast("long"), "text": F.lit(text)})).unionByName(odd.limit(1).withColumns({"doc_id": F.lit(2).cast("long"), "text": F.lit(re.sub(r"w(40|90|150)\b", "x", text))}))
    assert {(1, 2)} == similar_pairs([(r.doc_id, r.text) for r in rows.collect()])
    assert neardup.keep_representatives(rows).count() == 2  # beyond 3 bits
    kept = corpus_pipeline.near_dedup(spark, rows, SF)
    assert [r.doc_id for r in kept.collect()] == [1] and kept.columns == odd.columns


def test_keep_representatives(odd):
    kept = neardup.keep_representatives(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert len([i for i in ids if i is not None]) == len(set(ids) - {None}) and ids.count(None) == 2
    assert 0 in ids and 2 not in ids and 5 in ids and 6 not in ids


def test_toxicity_tells_gapped_insults(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeiourstlnm"), 5)) for _ in range(400)]
    said = lambda k: " ".join(rng.choice(words, 40)) + (" " + ["grumbold", "snorfle"][k // 4 % 2] + " " + " ".join(rng.choice(words, 5)) if k % 4 == 0 else "")
    rows = [(k, said(k)) for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels)
    held = got.filter("held_out").join(labels, "doc_id").collect()
    assert held and all(r.predicted == r.toxic for r in held)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in got.collect())
    planted = [(9001, "rstln grum-bold aeiou"), (9002, "grumb0old"), (9003, "s n o r f l e"), (9004, " ".join(words[:30])), (9005, None), (9006, "")]
    every = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(every, labels).filter("doc_id > 9000").collect()}
    assert min(scores[9001], scores[9003]) >= toxicity.CUT and scores[9004] < toxicity.CUT and scores[9005] == scores[9006]
    assert scores[9002] > scores[9004]


def test_toxicity_odd_tables(spark, odd):
    labels = spark.createDataFrame([(1, None), (2, 0), (None, 1)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(odd, labels)
    assert got.count() == odd.count() and got.filter("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.score_toxicity(empty(odd), empty(labels)).count() == 0
    assert toxicity.keep_civil(odd, empty(labels)).columns == odd.columns


def test_language(spark, docs, odd):
    got = langid.predict_language(docs).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.filter("held_out and lang_pred <> lang").count() == 0 and got.filter("rejected").count() == 0
    model = langid.fit(docs)
    rows = {r.doc_id: r for r in langid.predict_language(odd.filter("doc_id is not null").dropDuplicates(["doc_id"]), model=model).collect()}
    for k in (0, 1, 2, 3, 18):
        assert (rows[k].lang_pred, rows[k].score, rows[k].rejected) == ("und", 0.0, True)
    assert rows[13].rejected and langid.predict_language(empty(odd)).count() == 0
    assert langid.keep_identified(docs).count() == docs.count()


def test_texts_of_left_out_languages_are_rejected(spark):
    """Without any row of a language its texts are mostly rejected, and those of the others mostly not; a dirty label column is bounded."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for out in ("de", "fr", "es"):
        model = langid.fit(docs.filter(F.col("lang") != out))
        got = langid.predict_language(docs, model=model).join(docs.select("doc_id", "lang"), "doc_id")
        r = got.agg(F.avg(F.when(F.col("lang") == out, F.col("rejected").cast("int"))).alias("strangers"), F.avg(F.when(F.col("lang") != out, F.col("rejected").cast("int"))).alias("known")).first()
        assert r.strangers > 0.9 and r.known < 0.01, (out, r)
    dirty = docs.withColumn("lang", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("x"), F.col("doc_id").cast("string"))).otherwise(F.col("lang")))
    assert langid.fit(dirty, most_languages=4).languages == ["de", "en", "es", "fr"]
    few = langid.fit(docs, sample_chars=20_000)
    assert langid.predict_language(docs, model=few).join(docs.select("doc_id", "lang"), "doc_id").filter("lang_pred <> lang").count() < 30


def test_limits_lie_between_fitting_and_strange_texts():
    ce = np.array([[1.0, 4.0], [1.2, 4.2], [5.0, 1.1], [5.2, 1.3]])
    got = langid.limits(ce, np.array([0, 0, 1, 1]), 2)
    assert 1.2 < got[0] < 5.2 and 1.3 < got[1] < 4.2
    assert np.isfinite(langid.limits(ce[:2, :1], np.array([0, 0]), 1)).all() and langid.limits(ce[:2], np.array([0, 0]), 2)[1] == np.inf


def test_kneser_ney_sums_to_one():
    words = ["ab", "abc", "ba", "bca", "cab"]
    m = langid.Model(["x"], [(words, np.array([3, 2, 4, 1, 1]))])
    m.floor = 1 / 4  # a, b, c and the end
    total = sum(np.exp(m.word_scores(["ab" + c])[0, 0]) for c in "abc")
    prefix = np.exp(m.word_scores(["ab"])[0, 0])
    assert prefix > 0 and total > 0  # word ends differ, so check one context directly
    probs = []
    for c in "abc":
        (_, where, orders), *_ = langid.grams(["ab" + c])
        p = m.floor
        for n, (g, ctx, _) in enumerate(orders):
            k = np.searchsorted(m.keys[n], g[2])
            v = m.values[n][k, 0] if k < len(m.keys[n]) and m.keys[n][k] == g[2] else 0.0
            j = np.searchsorted(m.contexts[n], ctx[2])
            w = m.backs[n][j, 0] if j < len(m.contexts[n]) and m.contexts[n][j] == ctx[2] else 1.0
            p = v + w * p
        probs.append(p)
    (_, where, orders), *_ = langid.grams(["ab"])
    p = m.floor
    for n, (g, ctx, _) in enumerate(orders):
        k, j = np.searchsorted(m.keys[n], g[2]), np.searchsorted(m.contexts[n], ctx[2])
        v = m.values[n][k, 0] if k < len(m.keys[n]) and m.keys[n][k] == g[2] else 0.0
        p = v + (m.backs[n][j, 0] if j < len(m.contexts[n]) and m.contexts[n][j] == ctx[2] else 1.0) * p
    assert abs(sum(probs) + p - 1) < 1e-5


def test_packing(docs, odd):
    for frame in (docs, odd.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1)) * 10 + F.monotonically_increasing_id() % 10)):
        enc = bpe.Encoder(bpe.vocabulary("byte_bpe_50k.json")).library
        rows = packing.pack_documents(frame).collect()
        by_doc, by_seq = {}, {}
        for r in rows:
            by_doc.setdefault(r.doc_id, []).append(r)
            by_seq.setdefault(r.sequence_id, []).append(r)
            assert 1 <= r.length <= 1024 and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        for d in frame.collect():
            got = [i for r in sorted(by_doc[d.doc_id], key=lambda r: r.piece) for i in r.ids]
            assert got == [*enc.encode(d.text or "", add_special_tokens=False).ids, 2]
        for own in by_seq.values():
            own.sort(key=lambda r: r.offset)
            assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= 1024
        bound = packing.lower_bound(np.array([r.length for r in rows]))
        assert bound <= len(by_seq) <= bound * 1.02 + 1
    assert packing.pack_documents(empty(odd)).count() == 0


def test_packing_rounds(spark, monkeypatch):
    """Several rounds, each with fewer sequences, and certificates that hold."""
    monkeypatch.setattr(packing, "GROUP_PIECES", 1000)
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.integers(1, 1025, 3000)] + [1024] * 20
    rows = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, length long")
    got = packing.pack(rows).collect()
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(sizes))
    by_seq = {}
    for r in got:
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert all(sum(r.length for r in own) <= 1024 and sorted(r.offset for r in own)[0] == 0 for own in by_seq.values())
    bound = packing.lower_bound(np.array(sizes))
    assert bound <= len(by_seq) <= bound * 1.02
    assert all(r.group_bound <= r.group_sequences for r in got) and max(r.round for r in got if r.round < packing.WHOLE) >= 1
    assert sum(r.round == packing.WHOLE for r in got) >= 20 and all(r.length == 1024 for r in got if r.round == packing.WHOLE)


def test_packing_ends_where_nothing_is_gained(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 10)
    rows = spark.createDataFrame([(k, 600) for k in range(300)], "doc_id long, length long")
    assert len({r.sequence_id for r in packing.pack(rows).collect()}) == 300


@pytest.mark.parametrize("sizes", [[600] * 10, [1024] * 3, [513] * 4 + [511] * 4, [342] * 9, []])
def test_lower_bounds_certify(sizes):
    best = packing.best_fit_decreasing(np.array(sorted(sizes, reverse=True), np.int64))
    assert packing.lower_bound(np.array(sizes, np.int64)) == len(set(best.tolist()))


def test_media(odd):
    got = media.media_round_trip(odd).collect()
    for r, text in ((r, ODD[r.doc_id]) for r in got if r.doc_id is not None):
        raw = (text or "").encode()
        payload = raw + b" " * (192 if not raw else -len(raw) % 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id == 5}) == 1
    data = bytes(np.random.default_rng(0).integers(0, 256, 192 * 37, dtype=np.uint8)) + b"\xff" * 192 * 5
    frames, length, _ = media.read_avi(media.write_avi(data))
    assert b"".join(media.payload_of(media.decode_coefficients(f)[1]) for f in frames)[:length] == data
    assert media.media_round_trip(empty(odd)).count() == 0 and media.clip_rows(empty(media.document_videos(odd))).count() == 0
    clips = media.clip_rows(media.document_videos(odd)).groupBy("doc_id").agg(F.sum("frames").alias("n"), F.count("problem").alias("p")).collect()
    assert len(clips) == len({r.doc_id for r in odd.collect()}) and not any(r.p for r in clips)
    one = [r for r in got if r.doc_id == 15][0]
    assert sum(c.frames for c in one.clips) == len(media.read_avi(bytes(one.media))[0])


def test_shots_are_cut_where_the_picture_changes():
    dark, light = (np.stack([media.histogram([np.full(100, v, np.uint8)])] * n) for v, n in ((20, 5), (220, 4)))
    assert [(a, n) for a, n, _ in media.shots(np.concatenate([dark, light]))] == [(0, 5), (5, 4)]


def write_jpeg(planes, factors, quantiser, restart=0, grey=False):
    """A plain baseline encoder: planes (samples) of components with sampling factors, codes made for the symbols that occur."""
    high, wide = max(v for _, v in factors), max(h for h, _ in factors)
    height, width = planes[0].shape
    units_y, units_x = -(-height // (8 * high)), -(-width // (8 * wide))
    k = np.arange(8)
    cosine = np.cos((2 * k[:, None] + 1) * k[None] * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)
    zigzag, blocks = media._zigzag(), []
    for plane, (h, v) in zip(planes, factors):
        full = np.zeros((units_y * v * 8, units_x * h * 8))
        full[:] = np.pad(plane, ((0, max(0, full.shape[0] - plane.shape[0])), (0, max(0, full.shape[1] - plane.shape[1]))), mode="edge")[: full.shape[0], : full.shape[1]]
        cut = full.reshape(units_y * v, 8, units_x * h, 8).swapaxes(1, 2) - 128
        freq = np.einsum("yv,abyx,xu->abvu", cosine, cut, cosine).reshape(units_y * v, units_x * h, 64)
        blocks.append(np.rint(freq[:, :, zigzag] / quantiser).astype(int))
    symbols, before, number = [], [0] * len(planes), 0
    order = [(0, y, x) for y in range(-(-height // 8)) for x in range(-(-width // 8))] if grey else [(i, uy * v + dy, ux * h + dx) for uy in range(units_y) for ux in range(units_x) for i, (h, v) in enumerate(factors) for dy in range(v) for dx in range(h)]
    per_unit = 1 if grey else sum(h * v for h, v in factors)
    for n, (i, y, x) in enumerate(order):
        if restart and n and n % (restart * per_unit) == 0:
            symbols.append(None)
            before = [0] * len(planes)
        own = blocks[i][y, x]
        diff, before[i] = own[0] - before[i], own[0]
        symbols.append((0, abs(int(diff)).bit_length(), int(diff)))
        last = max(np.flatnonzero(own[1:]) + 1, default=0)
        run = 0
        for v in own[1 : last + 1].tolist():
            if v == 0:
                run += 1
                continue
            while run > 15:
                symbols.append((1, 0xF0, 0))
                run -= 16
            symbols.append((1, run << 4 | abs(v).bit_length(), v))
            run = 0
        if last < 63:
            symbols.append((1, 0, 0))
    tables, code = [], []
    for c in (0, 1):
        used = sorted({s for t in symbols if t and t[0] == c for s in [t[1]]})
        size = max(2, len(used).bit_length() + 1)
        counts = [0] * 16
        counts[size - 1] = len(used)
        tables.append(bytes(counts) + bytes(used))
        code.append({s: f"{j:0{size}b}" for j, s in enumerate(used)})
    parts, bits = [], ""
    for t in [*symbols, None]:
        if t is None:
            bits += "1" * (-len(bits) % 8)
            parts.append(bytes(int(bits[j : j + 8], 2) for j in range(0, len(bits), 8)).replace(b"\xff", b"\xff\0"))
            bits = ""
            continue
        c, symbol, value = t
        width_ = symbol & 15 if c else symbol
        bits += code[c][symbol] + (f"{value if value > 0 else value + (1 << width_) - 1:0{width_}b}" if width_ else "")
    scan = b"".join(p + (bytes([0xFF, 0xD0 + j % 8]) if j + 1 < len(parts) else b"") for j, p in enumerate(parts))
    comps = b"".join(bytes([j + 1, h << 4 | v, 0]) for j, (h, v) in enumerate(factors))
    head = media.segment(0xDB, b"\0" + bytes(quantiser.astype(np.uint8))) + media.segment(0xC4, b"\x00" + tables[0] + b"\x10" + tables[1]) + media.segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(factors)]) + comps)
    head += media.segment(0xDD, restart.to_bytes(2, "big")) if restart else b""
    return b"\xff\xd8" + head + media.segment(0xDA, bytes([len(factors)]) + b"".join(bytes([j + 1, 0]) for j in range(len(factors))) + b"\0\x3f\0") + scan + b"\xff\xd9"


def smooth(rng, height, width):
    y, x = np.mgrid[0:height, 0:width]
    return 128 + 60 * np.sin(x / rng.uniform(5, 9)) + 50 * np.cos(y / rng.uniform(4, 8))


@pytest.mark.parametrize(("factors", "restart", "grey"), [([(1, 1)], 0, True), ([(2, 2)], 3, True), ([(1, 1)] * 3, 0, False), ([(2, 2), (1, 1), (1, 1)], 2, False), ([(2, 1), (1, 1), (1, 1)], 0, False)])
def test_any_baseline_picture_is_decoded(factors, restart, grey):
    rng = np.random.default_rng(6)
    height, width = 37, 45
    high, wide = max(v for _, v in factors), max(h for h, _ in factors)
    planes = [smooth(rng, -(-height * v // high), -(-width * h // wide)) for h, v in factors]
    got = media.decode_frame(write_jpeg(planes, factors, np.arange(1, 65) // 16 + 1, restart, grey))
    assert got.shape == (height, width, len(factors))
    for k, ((h, v), plane) in enumerate(zip(factors, planes)):
        full = plane.repeat(high // v, 0).repeat(wide // h, 1)[:height, :width]
        assert np.abs(got[:, :, k] - np.clip(full, 0, 255)).max() <= 8


def test_the_short_cut_gives_the_same_coefficients():
    data = bytes(np.random.default_rng(3).integers(0, 256, 3072, dtype=np.uint8))
    frame = media.read_avi(media.write_avi(data))[0][0]
    other = frame.replace(b"JFIF", b"JFXX")  # no longer this module's header
    assert all((a == b).all() for a, b in zip(media.decode_coefficients(frame)[1], media.decode_coefficients(other)[1]))


def test_real_videos_and_damaged_ones(spark):
    rng = np.random.default_rng(4)
    quant = np.full(64, 2)
    first, second = smooth(rng, 24, 32) * 0.3, 255 - smooth(rng, 24, 32) * 0.3
    frames = [write_jpeg([(first if k < 4 else second) + rng.normal(0, 1, first.shape)], [(1, 1)], quant, grey=True) for k in range(9)]
    frames[2] = b"\xff\xd8 no picture"
    body = b"".join(media.chunk(b"00dc", f) for f in frames)
    avi = lambda b: b"RIFF" + (len(b) + 4).to_bytes(4, "little") + b"AVI " + b
    rows = [(1, bytearray(avi(media.listed(b"movi", body)))), (2, bytearray(b"no video")), (3, None), (4, bytearray(avi(media.listed(b"movi", b""))))]
    got = media.clip_rows(spark.createDataFrame(rows, "id int, file binary"), "id", "file").orderBy("id", "clip").collect()
    assert [(r.id, r.first_frame, r.frames, r.width, r.height) for r in got if r.id == 1] == [(1, 0, 3, 32, 24), (1, 4, 5, 32, 24)]
    assert got[0].problem == "1 of 9 pictures can't be decoded" and abs(got[1].start_s - 4 / 25) < 1e-9
    assert [(r.id, r.clip, bool(r.problem)) for r in got[2:]] == [(2, None, True), (3, None, True), (4, None, True)]


KEY = "a key of the tests"
PRIVATE = "mail bosbt.42@mail8.example.com from 42.144.35.254, call +1 (692) 555-7228, card 4539578763621486, ssn 555-12-3456. Anna Müller met Иван Петров; Anna Müller paid."


def test_surrogates(spark, odd):
    rows = spark.createDataFrame([(1, PRIVATE, "x"), (2, PRIVATE.replace("Anna", "Mary"), "y"), (3, "The and attion to 12 345.", "z"), (4, None, None), (None, PRIVATE, "w")], "doc_id long, text string, surrogate string")
    got = {r.doc_id: r for r in pii.replace_private(rows, KEY).collect()}
    text = got[1].text
    for value in ("bosbt.42@mail8.example.com", "42.144.35.254", "555-7228", "4539578763621486", "555-12-3456", "Müller", "Петров"):
        assert value not in text
    assert got[None].text == text and got[3].text == "The and attion to 12 345." and got[4].text is None
    kinds = [e.kind for e in got[1]._pii_entities]
    assert kinds == ["email", "ip", "phone", "card", "ssn", "name", "name", "name"]
    first, third = got[1]._pii_entities[5].surrogate, got[1]._pii_entities[7].surrogate
    assert first == third and first.split()[0] in pii.FIRST_NAMES["latin f"] and got[1]._pii_entities[6].surrogate.split()[0] in pii.FIRST_NAMES["cyrillic m"]
    card = got[1]._pii_entities[3].surrogate
    assert pii.check_digit(card[:-1]) == card[-1] and re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1]._pii_entities[2].surrogate)
    assert pii.replace_private(odd, KEY).count() == odd.count() and pii.replace_private(empty(odd), KEY).count() == 0


def test_surrogates_are_permutations_and_clashes_are_redrawn(spark):
    for kind, values in (("phone", [f"555-{a:03d}-{b:04d}" for a in range(20) for b in range(100)]), ("card", [f"{k:016d}" for k in range(3000)]), ("ip", [f"10.0.{a}.{b}" for a in range(20) for b in range(99)]), ("email", [f"a{k}@b.org" for k in range(10)])):
        assert len({pii.surrogate(kind, v, KEY) for v in values}) == len(values)
    values = [f"a{k}@b.org" for k in range(10)] + [f"e{k}@c.org" for k in range(10)]
    rows = spark.createDataFrame([(k, f"write to {v} now") for k, v in enumerate(values)], "doc_id long, text string")
    clash = pii.surrogate("email", values[0], KEY)
    assert clash not in values
    rows = rows.unionByName(spark.createDataFrame([(99, f"and {clash} too")], rows.schema))
    got = {r.doc_id: r.text.split()[-2] for r in pii.replace_private(rows, KEY).collect()}
    assert len(set(got.values())) == len({*values, clash}) and not set(got.values()) & {*values, clash}


def test_redraws_keep_a_surname_together(spark):
    """The surname that one name would get is in the corpus, so it is drawn again, for every name that has it."""
    taken = pii.surrogate("name", "Frau Müller", KEY).split()[1]
    texts = ["Anna Müller is here", "Frau Müller is here", "Hans Müller is here", f"Frau {taken} is here"]
    got = [r.text.split() for r in pii.replace_private(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).orderBy("doc_id").collect()]
    assert got[0][1] == got[1][1] == got[2][1] not in ("Müller", taken) and got[3][1] not in (taken, got[0][1])


def test_no_entity_stays_in_any_script(spark):
    values = ["Dr 山田", "Dr Ωmega", "Dr ვანო", "Frau Ǆabc", "山@例え.jp", "한국@서울.kr", "юрий@ямал.рф", "token=東京東京東京東京", "Sr Ñandú"]
    got = {r.doc_id: r for r in pii.replace_private(spark.createDataFrame([(k, f"so {v} it") for k, v in enumerate(values)], "doc_id long, text string"), KEY).collect()}
    for k, v in enumerate(values):
        words = [w for w in re.split(r"[ @=.]", v) if w not in ("Dr", "Frau", "Sr", "token", "jp", "kr", "рф")]
        assert got[k]._pii_entities and not any(w in got[k].text for w in words), (v, got[k].text)
    assert re.search("[一-鿿]{2}", got[0].text) and re.search("[가-힣]{2}@[가-힣]{2}", got[5].text)


def test_values_are_sealed_in_the_shared_folder(spark):
    found = pii.found_values(spark.createDataFrame([(1, PRIVATE)], "doc_id long, text string"), KEY).collect()
    assert {r.kind for r in found} == {"email", "ip", "phone", "card", "ssn", "name", "surname"}
    opened = {pii.opened(r.value, KEY) for r in found}
    assert {"555-12-3456", "Anna Müller", "Müller"} <= opened
    assert not any(v.encode() in bytes(r.value) + bytes(r.surrogate) + b"".join(map(bytes, r.words)) for r in found for v in opened)
    assert pii.sealed("a", KEY) == pii.sealed("a", KEY) != pii.sealed("a", "other")
    with pytest.raises(ValueError, match="key"):
        pii.replace_private(spark.createDataFrame([(1, PRIVATE)], "doc_id long, text string"), "")


def test_full_formats_get_longer_surrogates(spark):
    """Every value of a format is in the corpus, so none of its permutations is free of clashes."""
    names = [f"Dr {n}" for n in pii.FIRST_NAMES["cyrillic m"] + pii.FIRST_NAMES["latin f"]] + [f"Иван {a}{b}" for a in "БВГДЖЗКЛМНПРСТФХЦЧШЩ" for b in "аеиоуыэюя"]
    mails = [f"{a}@b.org" for a in "aeiou"] + [f"{a}@{b}.org" for a in "aeiou" for b in "cdfghjklmnpqrstvwxyz"]
    values = [*names, *mails, "1.2.3.4", "01.2.3.4", "Dr 田中"] + [f"+1 {a:02d} {b:02d}" for a in range(100) for b in range(100)]
    rows = spark.createDataFrame([(k, f"so ; {v} ; it is @") for k, v in enumerate(values)], "doc_id long, text string")
    got = {r.doc_id: r.text.split(" ; ")[1] for r in pii.replace_private(rows, KEY).collect()}
    assert len(set(got.values())) == len(values) and not set(got.values()) & set(values)
    assert all(got[k].startswith("Dr ") for k in range(8)) and "田" not in "".join(got.values())


def test_clashes_that_stay_fail_the_job(spark, monkeypatch):
    monkeypatch.setattr(pii, "surrogate", lambda kind, value, key, draws=(): "Dr Same")
    seal = lambda v: bytearray(pii.sealed(v, KEY))
    same = spark.createDataFrame([("name", seal(f"Dr {x}"), seal("Dr Same"), [seal(x)]) for x in "AB"], "kind string, value binary, surrogate binary, words array<binary>")
    monkeypatch.setattr(pii, "MOST_DRAWS", 1)
    monkeypatch.setattr(pii, "LONGER_DRAWS", 1)
    with pytest.raises(RuntimeError, match="0 surrogates equal other values and 2 are shared"):
        pii.redraws(same, KEY)


def generated_values(rng, count):
    """Values of every kind and shape that the patterns allow, also with digits and letters of other scripts."""
    digits = ["0123456789"] * 4 + ["".join(chr(z + k) for k in range(10)) for z in pii.ZEROS]

    def d(least, most=None):
        return "".join(rng.choice(list(own), int(rng.integers(least, (most or least) + 1))))

    for _ in range(count):
        own = digits[int(rng.integers(len(digits)))]
        sep = lambda: str(rng.choice(["", " ", ".", "-"]))
        letters = lambda n: "".join(rng.choice(list("ABCDEFGHXYZ"), n))
        title, first = str(rng.choice("Mr Mrs Ms Dr. Herr Frau Mme Sr Sra.".split())), str(rng.choice(pii.NAMES.split("|")))
        last = str(rng.choice(["Miller", "Élan", "Ωmega", "ωmega", "иванов", "田中", "Ǆabc", "ªb", "ıb", "ĀB", "Āb", "²b"]))
        yield from (
            f"+{d(1, 3)}" + "".join(sep() + d(2, 4) for _ in range(int(rng.integers(2, 6)))),
            f"({d(2, 4)}){sep()}{d(3)}-{d(4)}", f"{d(3)} {d(3)}.{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", ".".join(str(x) for x in rng.integers(0, 256, 4)), f"{d(1)}.{d(1)}.{d(1)}.{d(1)}",
            f"{letters(2)}{d(2)} {letters(4)} {letters(4)} {letters(4)}", f"{letters(2)}{d(2)}{letters(4)}{d(4)}{letters(4)}{letters(1)}", d(13, 19), f"{d(4)}-{d(4)}-{d(4)}-{d(4)}",
            f"a{d(0, 2)}@b.ñ", f"token{sep()}={letters(9)}", f"secret: {last * 8}", f"api_key={letters(8)}", f"apikey={letters(8)}", f"password = '{letters(8)}", "ab12" * 8, "AB12" * 9,
            f"{title} {last}", f"{title} {first} {last}", f"{first} {last}", f"{first} {last} {last}x",
        )


def test_hint_leaves_out_no_text_with_private_data():
    values = ["+45 12 34 56 78", "+47 22-33-44-55", "+49 30 12 34 56 78", "DE12 ABCD EFGH IJKL", "Herr иванов", "٣.٣.٣.٣", *generated_values(np.random.default_rng(4), 500)]
    texts = [t for v in values for t in (v, f"so {v} it is", f"so {v[:-1]}", f"{v[1:]} so")]
    found = [pii.find(t) for t in texts]
    assert {k for own in found for k, _, _ in own} == set(pii.PATTERNS) and all(pii.find(v) for v in values[:6])
    missed = [t for t, own, hint in zip(texts, found, pii.hinted(pa.array(texts)), strict=True) if own and not hint]
    assert not missed


def test_values_in_other_digits_and_without_other_hints_are_replaced(spark):
    values = ["+45 12 34 56 78", "٠١٢-٣٤٥-٦٧٨٩", "४५३९५७८७६३६२१४८६", "٣.٤.٥.٦", "DE12 ABCD EFGH IJKL"]
    rows = spark.createDataFrame([(k, f"so {v} it is") for k, v in enumerate(values)] + [(90 + k, f"so {v} it is, 123456") for k, v in enumerate(values)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.replace_private(rows, KEY).collect()}
    assert all(v not in got[k] and got[90 + k] == f"{got[k]}, 123456" for k, v in enumerate(values))
    card = got[2].split()[1]
    assert {ord(c) - 0x966 for c in card} <= set(range(10)) and len(card) == 16


def test_token_files(spark, odd, docs, tmp_path):
    manifest = tokenfile.write_tokens(docs, f"file://{tmp_path}/a", files=5)
    assert len(manifest) == 5
    enc = bpe.Encoder(bpe.vocabulary("word_bpe_49k.json")).library
    got = {r.doc_id: r for r in tokenfile.read_tokens(spark, manifest).collect()}
    before = 0
    for r in docs.orderBy("doc_id").collect():
        ids = [*enc.encode(r.text, add_special_tokens=False).ids, 1]
        assert (got[r.doc_id].ids, got[r.doc_id].start, got[r.doc_id].ids_crc32) == (ids, before, zlib.crc32(np.array(ids, "<u4").tobytes()))
        before += len(ids)
    few = tokenfile.read_tokens(spark, manifest, wanted=[3, 77]).collect()
    assert sorted(r.doc_id for r in few) == [3, 77] and all(got[r.doc_id] == r for r in few)
    assert tokenfile.token_file_digest(odd).count() == odd.count()
    assert tokenfile.write_tokens(empty(odd), f"file://{tmp_path}/b") == []
    path = tmp_path / "a" / "part-000000.tok.zst"
    data = bytearray(path.read_bytes())
    data[20] ^= 1
    path.write_bytes(bytes(data))
    with pytest.raises(Exception, match="damaged|decompress|corrupt|Error"):
        tokenfile.read_tokens(spark, manifest).count()


def replica(spark, pages, folder, per_file=16):
    return warc.records(warc.read_warc(warc.write_warc(pages, f"file://{folder}", per_file)), per_file)


def test_warc_audit(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(60).unionByName(spark.createDataFrame([(None, "u", "h"), (None, None, None), (3, None, None), (2**60 + 1, "v", "w"), (-5, "neg", "x" * 200_000)], "page_id long, url string, html string"))
    same = warc.audit(replica(spark, pages, tmp_path / "a"), replica(spark, pages.orderBy(F.desc("page_id")), tmp_path / "b"), 16)
    assert same.count() == 0
    other = pages.filter("page_id is null or page_id <> 8").withColumn("html", F.when(F.col("page_id") == 5, "changed").when(F.col("page_id") == 2**60 + 1, "W").otherwise(F.col("html"))).unionByName(spark.createDataFrame([(250_000, "x", "y")], pages.schema))
    got = {(r.page_id, r.status) for r in warc.audit(replica(spark, pages, tmp_path / "c"), replica(spark, other, tmp_path / "d"), 16).collect()}
    assert got == {(5, "changed"), (2**60 + 1, "changed"), (8, "missing"), (9, "moved"), (250_000, "extra")}
    assert warc.audit(replica(spark, empty(pages), tmp_path / "e"), replica(spark, empty(pages), tmp_path / "f"), 16).count() == 0
    assert warc.audit(replica(spark, pages, tmp_path / "g"), replica(spark, empty(pages), tmp_path / "h"), 16).filter("status <> 'missing'").count() == 0


def test_the_root_covers_offsets_and_all_files(spark, tmp_path):
    recs = spark.createDataFrame([(f, s, s, 10, f"{f * 100 + s:064x}") for f in (-3, 0, 40) for s in range(20)], "file long, slot long, page_id long, length long, digest string").withColumns({"stored_length": F.col("length"), "stored_digest": F.col("digest"), "before": F.lit("")})
    levels = warc.widths(20, 44)
    roots = [warc.tree(r.withColumn("file", F.col("file") + 3), levels)[-1].collect() for r in (recs, recs.withColumn("stored_length", F.when(F.col("slot") == 3, 11).otherwise(F.when(F.col("slot") == 4, 9).otherwise(10))), recs.filter("file <> -3 or slot <> 7"))]
    assert [len(r) for r in roots] == [1, 1, 1] and len({r[0].hash for r in roots}) == 3 and roots[0][0].stored == roots[1][0].stored == 600


def test_damage_in_a_stored_file_is_located(spark, tmp_path):
    """One bit, bytes between records, a file cut off: the records beside stay sound."""
    pages = spark.createDataFrame([(k, f"http://a/{k}", f"<p>{k * 7919}</p>" * 50) for k in range(40)], "page_id long, url string, html string")
    sound = replica(spark, pages, tmp_path / "a", 100)
    for name, spoil, want in (
        ("bit", lambda d, at: d[: at[7] + 40] + bytes([d[at[7] + 40] ^ 16]) + d[at[7] + 41 :], {(7, "changed")}),
        ("head", lambda d, at: d[: at[9]] + b"\0" + d[at[9] + 1 :], {(9, "changed")}),
        ("between", lambda d, at: d[: at[12]] + b"some bytes" + d[at[12] :], {(12, "changed")}),
        ("cut", lambda d, at: d[: at[39] - 5], {(38, "changed"), (39, "missing")}),
        ("lost", lambda d, at: d[: at[20]] + d[at[21] :], {(20, "missing")}),
        ("start", lambda d, at: b"x" * 9 + d, {(0, "changed")}),
        ("time", lambda d, at: d[: at[7] + 4] + b"1234" + d[at[7] + 8 :], {(7, "stored")}),
        ("system", lambda d, at: d[: at[39] + 9] + b"\x07" + d[at[39] + 10 :], {(39, "stored")}),
        ("swapped", lambda d, at: d[: at[3]] + d[at[4] : at[5]] + d[at[3] : at[4]] + d[at[5] :], {(3, "moved"), (4, "moved"), (5, "moved")}),
    ):
        folder = tmp_path / name
        warc.write_warc(pages, f"file://{folder}", 100)
        path = folder / "0.warc.gz"
        data = path.read_bytes()
        at = [r[3] for r in warc.warc_rows(path.open("rb"), len(data))]
        path.write_bytes(spoil(data, at))
        got = warc.audit(sound, warc.records(warc.read_warc(warc.warc_files(spark, str(folder))), 100), 100).collect()
        found = {(r.page_id if r.page_id is not None else r.slot, r.status) for r in got}
        assert {x for x in found if x[1] != "moved" or name == "swapped"} == want, name


def test_archives_of_other_makers(spark, tmp_path):
    """Names without numbers or with the same one, record ids of any kind: files are known by path, records by id."""
    record = lambda i, body: f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:{i}>\r\nWARC-Target-URI: http://x/{i}\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n".encode()
    files = {"A-00001": range(5), "B-00001": range(5, 9), "deep/plain": range(9, 12)}
    for root in ("one", "two"):
        for name, ids in files.items():
            path = tmp_path / root / f"{name}.warc.gz"
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(b"".join(warc.gzip_member(record(i, "changed" if root == "two" and i == 6 else f"body {i}")) for i in ids if not (root == "two" and i == 10)))
    listed = [warc.warc_files(spark, f"{tmp_path}/{r}/*.gz").unionByName(warc.warc_files(spark, f"{tmp_path}/{r}/deep/*.gz")) for r in ("one", "two")]
    one, two = (warc.records(warc.read_warc(f), 64, root=f"file://{tmp_path}/{r}") for f, r in zip(listed, ("one", "two")))
    assert {r.file for r in one.select("file").distinct().collect()} == {f"{n}.warc.gz" for n in files}
    got = sorted((r.file, r.status) for r in warc.audit(one, two, 64).collect())
    assert got == [("B-00001.warc.gz", "changed"), ("deep/plain.warc.gz", "missing"), ("deep/plain.warc.gz", "moved")]
    assert warc.audit(one, one, 64).count() == 0


def test_warc_files(spark, tmp_path):
    text = warc.record_text(F.col("id"), F.col("u"), F.col("h"))
    rows = [bytes(r.t, "utf-8") for r in spark.createDataFrame([(1, "http://a/é", "<p>ü</p>"), (2, "http://b", "")], "id long, u string, h string").select(text.alias("t")).collect()]
    (tmp_path / "1.warc").write_bytes(rows[0] + b"broken" + rows[1] + rows[0][:-1])
    (tmp_path / "2.warc.gz").write_bytes(warc.gzip_member(rows[0]) + warc.gzip_member(b"no record") + warc.gzip_member(rows[1]))
    got = sorted(warc.read_warc(warc.warc_files(spark, str(tmp_path)), keep=True).collect(), key=lambda r: (r.path.endswith("gz"), r.ordinal))
    assert [r.type for r in got] == ["response", "damaged", "response", "damaged"] + ["response", "damaged", "response"]
    assert {r.digest for r in got if r.type == "response"} == {hashlib.sha256(r).hexdigest() for r in rows} and [r.content for r in got if r.type == "response"] == rows * 2
    assert (got[2].offset, got[2].stored_offset) == (len(rows[0]) + 6,) * 2 and got[0].uri == "http://a/é" and got[1].content == b"broken"


def test_warc_reading_is_linear(tmp_path, monkeypatch):
    """Records over several windows, and twice the file in about twice the time."""
    import time

    monkeypatch.setattr(warc, "WINDOW", 1000)
    record = b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 5000\r\n\r\n" + b"y" * 5000 + b"\r\n\r\n"
    for stored in (record, warc.gzip_member(record)):
        (tmp_path / "big").write_bytes(stored * 3 + b"junk" * 900 + stored)
        got = list(warc.warc_rows((tmp_path / "big").open("rb"), (tmp_path / "big").stat().st_size))
        assert [r[5] for r in got] == ["x", "x", "x", "damaged", "x"] and {r[8] for r in got if r[5] == "x"} == {hashlib.sha256(record).hexdigest()}
    monkeypatch.setattr(warc, "WINDOW", 4 << 20)
    seconds = []
    for n in (4000, 16000):
        (tmp_path / "long").write_bytes(record * n)
        began = time.perf_counter()
        assert sum(1 for _ in warc.warc_rows((tmp_path / "long").open("rb"), len(record) * n)) == n
        seconds.append(time.perf_counter() - began)
    assert seconds[1] < 12 * seconds[0] + 1


def test_stages_on_odd_rows(spark, odd):
    """Nulls, empty and long texts, repeated rows and ids, clashing names, and no rows at all, stage by stage."""
    import corpus_pipeline

    clash = odd.withColumns({"own_id": F.lit(1), "own_hash": F.lit(2), "judged_id": F.lit(3), "_first": F.lit(4), "component_id": F.lit(5), "hash": F.lit(6), "node": F.lit(7)})
    rows = clash.unionByName(clash.filter("doc_id = 5").withColumn("text", F.lit("another text of the same doc_id, with more words")))
    wide = {"toxicity": 24, "language ID": None, "SimHash near-dedup": None, "PII": 24}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, rows, SF)
        assert got.dtypes == rows.dtypes, name
        assert wide[name] is None or got.count() == rows.count(), name
        assert stage(spark, empty(rows), SF).count() == 0, name
    kept = corpus_pipeline.near_dedup(spark, rows, SF)
    texts = [(r.doc_id, r.text) for r in kept.collect()]
    assert len([t for t in texts if t[0] == 5]) == 2 and len([t for t in texts if t[0] is None]) == 2 and 6 not in dict(texts)
    packed = corpus_pipeline.packing(spark, rows, SF)
    assert packed.filter("length <> size(ids)").count() == 0 and corpus_pipeline.packing(spark, empty(rows), SF).count() == 0


def test_what_stages_leave_is_deleted(spark):
    from pagemill.llm import common

    folder = common.shared_dir(spark).removeprefix("file:")
    mark = common.made()
    a, b = common.save(spark.range(5), "one"), common.save(spark.range(6), "two")
    common.discard(spark, mark, keep=1)
    assert b.count() == 6 and common.made() == mark + 1 and a.inputFiles() and not [f for f in a.inputFiles() if os.path.exists(f.removeprefix("file://"))] and os.path.isdir(folder)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, SF)
        assert kept.columns == docs.columns, name
        kept = spark.createDataFrame(kept.collect(), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept.collect()}
    whole = corpus_pipeline.run(spark, SF).collect()
    key = lambda r: (r.doc_id, r.piece, r.length, r.ids_crc32)
    assert sorted(map(key, whole)) == sorted(map(key, packed))
