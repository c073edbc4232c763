"""Manifest, resampling and toxicity against brute-force versions and held-out labels."""

import collections
import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sitescope.llm import common, merkle, resampling, toxicity

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"
CRC = lambda m, r: F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % m == r


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(leaves):
    """(root, for each leaf the (left, right) of every level)."""
    steps, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[k : k + 16] for k in range(0, len(level), 16)]
        for i, k in enumerate(at):
            run, place = runs[k // 16], k % 16
            steps[i].append(("".join(run[:place]), "".join(run[place + 1 :])))
        at, level = [k // 16 for k in at], [H(*run) for run in runs]
    return level[0], steps


def brute_manifest(rows):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, text: H(said(r[0]), said(r[1]), said(r[2]), said(r[3]), said(text))
    lower = lambda t: t and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    by = collections.defaultdict(list)
    for r in rows:
        start = leaf(r, lower(r[4])) if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 else leaf(r, r[4])
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(r, r[4]), start, r[0]))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [brute_tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])]) for s in names]
    root, above = brute_tree([t[0] for t in trees])
    out = []
    for s, (subroot, steps), up in zip(names, trees, above):
        for x, own in zip(sorted(by[s], key=lambda x: x[:3]), steps):
            now = x[3]
            for left, right in own + up:
                now = H(left, now, right)
            out.append((x[4], x[2], subroot, root, H(*(a + b for a, b in own + up)), now, now == root))
    return collections.Counter(out)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_manifest(spark):
    rnd = random.Random(5)
    rows = [(k, rnd.choice(["a", "é", "z", None, "b"]), "en", k % 7, f"Text {k} Ü") for k in range(300)]
    rows += [(5000, "lone", None, None, None), (5001, "", "en", 0, ""), (None, "a", "en", 1, "X"), (None, None, None, None, None), (7, "a", "en", 1, "Again"), (2**53 + 1, "z", "en", 1, "A" * 300_000)]
    rows += [(9001, "twin", "en", 1, "Same")] * 3 + [(k, f"source {k}", "en", 1, "one") for k in range(6000, 6020)]
    got = merkle.manifest(table(spark, rows), CRC(5, 0))
    assert collections.Counter(map(tuple, got.collect())) == brute_manifest(rows)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("n", [1, 16, 17, 256, 257])
def test_manifest_of_one_source(spark, n):
    rows = [(k, "s", "en", k, f"T{k}") for k in range(n)]
    assert collections.Counter(map(tuple, merkle.manifest(table(spark, rows), CRC(5, 0)).collect())) == brute_manifest(rows)


def test_manifest_of_several_tiers(spark):
    """More leaves than a block holds, beside a source of few."""
    rows = [(k, "hot" if k % 50 else "few", "en", k, "t") for k in range(4700)]
    assert collections.Counter(map(tuple, merkle.manifest(table(spark, rows), CRC(5, 0)).collect())) == brute_manifest(rows)


def test_manifest_of_nothing_and_of_clashing_columns(spark):
    assert merkle.manifest(table(spark, []), CRC(5, 0)).count() == 0
    rows = [(k, "s", "en", k, "T") for k in range(20)]
    more = table(spark, rows).select("*", *(F.lit("x").alias(c) for c in ("rank", "n", "block", "digest", "steps", "name", "unnamed", "leaf", "d0", "part", "at")))
    assert collections.Counter(map(tuple, merkle.manifest(more, CRC(5, 0)).collect())) == brute_manifest(rows)


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [zlib.crc32(w.encode()) % 10_000 for w in re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", low)]


def brute_draw(rows, target):
    s, t = collections.Counter(), collections.Counter()
    for _, x in rows:
        s.update(features(x))
    for x in target:
        t.update(features(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + 10_000) / ((s[b] + 1) * (sum(t.values()) + 10_000))))
    out = []
    for i, x in rows:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(b) for b in features(x))
        out.append([i, len(features(x)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for k, r in enumerate(fit[: len(fit) * 10 // 100]):
        r[4] = k + 1
    return collections.Counter(map(tuple, out))


@pytest.fixture(scope="module")
def mixed():
    rnd = random.Random(2)
    vocabulary = ["".join(rnd.choice(["Th", "er", "é", "9", "re", "_x"]) for _ in range(rnd.randint(1, 4))) for _ in range(200)]
    rows = [(k, " ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([0, 5, 19, 20, 21, 80, 400])))) for k in range(150)]
    return rows + [(None, rows[3][1]), (900, None), (901, ""), (902, "the " * 70_000), (903, "漢字 ünder-score " * 30), (904, rows[5][1]), (904, rows[5][1]), (2**53 + 1, rows[6][1])]


@pytest.mark.parametrize("target", [["The re9 er er", None, "é 9 re " * 50], []], ids=["target", "no target"])
def test_resampling(spark, mixed, target):
    docs = spark.createDataFrame(mixed, "doc_id long, text string").withColumn("weight", F.lit("x")).withColumn("rank", F.lit(1)).repartition(4)
    got = resampling.resample(docs, spark.createDataFrame([(x,) for x in target], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert collections.Counter(map(tuple, got.collect())) == brute_draw(mixed, target)


def test_resampling_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).count() == 0


def test_bit_slices():
    import numpy as np

    rnd = np.random.default_rng(1)
    for top in (1, 2, 9, 70_000):
        counts, gains = rnd.integers(0, top, resampling.BUCKETS), rnd.integers(-12_000, 9_000, resampling.BUCKETS)
        assert resampling.weight_of(counts, resampling.gain_planes(gains)) == int((counts * gains).sum())


def test_fold():
    for spelled in ("Idiot", "1d10t", "ID!OT", "іdіоt", "ｉｄｉｏｔ", "ídïöt", "id\u200bi\u00adot"):
        assert toxicity.fold(spelled) == toxicity.fold("idiot"), spelled
    assert toxicity.fold("a, 42 b!") == " a  b " and toxicity.fold(" .. ") == "  " and toxicity.fold("") == "  "


def test_lexicon_finds_the_longest_of_what_begins_at_a_place():
    lexicon = toxicity.Lexicon({" kii": 3.0, " kiimer ": 0.0, " kiii  process ": 0.0, " foo": 2.0})
    found = lambda text: [p for _, p in lexicon.hits(toxicity.fold(text))]
    assert found("kill them, Kilmer kills; kill process foo") == [" kii", " kiimer ", " kii", " kiii  process ", " foo"]
    assert found("kilmer skill") == [" kiimer "] and found("") == []
    assert lexicon.measures(toxicity.fold("kill all foo")) == (5.0, 3) and lexicon.measures(toxicity.fold(" ,")) == (0.0, 0)
    rnd = random.Random(4)
    patterns = {" " + "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 3))) + rnd.choice(["", " "]) for _ in range(9)}
    some = toxicity.Lexicon(dict.fromkeys(patterns, 1.0))
    for _ in range(200):
        text = toxicity.fold(" ".join("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 4))) for _ in range(12)))
        want, at = [], 0
        while at < len(text):
            here = max((p for p in patterns if text.startswith(p, at)), key=len, default=None)
            want += [here] if here else []
            at += len(here) if here else 1
        assert [p for _, p in some.hits(text)] == want


def planted(spark, n=600):
    rnd = random.Random(7)
    vocabulary = ["".join(rnd.choice(["th", "er", "on", "an", "re", "ti"]) for _ in range(rnd.randint(1, 4))) for _ in range(400)]
    rows, labels = [], []
    for k in range(n):
        w = [rnd.choice(vocabulary) for _ in range(rnd.choice([5, 30, 120]))]
        toxic = k % 6 == 0
        if toxic:
            for _ in range(1 + len(w) // 25):
                w.insert(rnd.randrange(len(w)), rnd.choice(["zounds", "Drat", "zonkers"]))
        elif k % 6 == 1:
            w += ["drat", "catcher", "again"]
        rows.append((k, " ".join(w)))
        labels.append((k, int(toxic)))
    rows += [(5001, "such a z0und5 and dr@t, zonkers zonkers"), (5002, "the drat catcher came"), (5003, None), (5004, ""), (None, "zonkers zounds"), (5005, " ,. "), (5006, "zonkers " * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("toxic", F.lit(1)).repartition(4)
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark):
    docs, labels = planted(spark)
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs, labels.unionByName(spark.createDataFrame([(None, 1), (3, None), (99999, 1)], labels.schema)), CRC(4, 2)).collect()}
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    right = sum(got[k]["predicted"] == int(k % 6 == 0) for k in range(600) if got[k]["held_out"])
    assert right >= 0.97 * sum(got[k]["held_out"] for k in range(600))
    assert got[5001]["predicted"] == 1 and got[5006]["predicted"] == 1 and got[None]["predicted"] == 1 and not got[None]["held_out"]
    assert got[5002]["predicted"] == 0 and got[5003]["score"] == got[5004]["score"] == got[5005]["score"] < 0.3
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k in range(600))


def test_toxicity_learns_nothing_from_what_is_held_out(spark):
    docs, labels = planted(spark, 300)
    held = CRC(4, 2)
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    score = lambda x: {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, x, held).collect()}
    assert score(labels) == score(turned)


def test_toxicity_without_labels_or_documents(spark):
    docs, labels = planted(spark, 30)
    assert {r["score"] for r in toxicity.score_documents(docs, labels.limit(0), CRC(4, 2)).collect()} == {0.0}
    assert toxicity.score_documents(docs.limit(0), labels, CRC(4, 2)).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_toxicity_of_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    found = toxicity.op13_toxicity(spark, d).where("held_out").join(common.read(spark, d, "labels"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in found}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.02 * n[0, 0]
