"""Ids of any size with nulls, columns of clashing names, repeated ids, empty tables, odd characters, and the queries' columns."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pytest

import corpus_pipeline as P
from sitescope.llm import bpe, common, jaccard, packing, quality, queries, secrets, simhash, substrings, suffix_tree, warc

BIG = 2**53 + 1
IDS = (BIG, BIG + 2, None, BIG + 4)
#: Names that operators use for columns of their own.
CLASHING = ("spans", "n_words", "n_removed", "score", "kept", "__key", "row", "key", "chunk", "masked", "id", "unnamed", "label", "title.dotted")


def prose(seed, n):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice(["th", "er", "on", "an", "re", "ti"]) for _ in range(rnd.randint(1, 4))) for _ in range(2000)]
    return " ".join(rnd.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="module")
def few(spark):
    return spark.createDataFrame([(i, prose(k % 3, 80)) for k, i in enumerate(IDS)], "doc_id long, text string").coalesce(1)


def test_ids_pass_unchanged(spark, few):
    from pyspark.sql import functions as F

    want = collections.Counter(IDS)
    found = {
        "secrets": secrets.find_secrets(few), "packing": packing.pack(few), "substrings": substrings.drop_repeats(few), "quality": quality.assess(few, None),
        "bpe": bpe.digests(few), "ids": bpe.encode_documents(few), "simhash": simhash.compare_edited(few), "jaccard": jaccard.similar_documents(few), "suffix_tree": suffix_tree.score_documents(few, F.lit(False)),
    }
    for name, out in found.items():
        assert collections.Counter(r["doc_id"] for r in out.collect()) == want, name
    least = {r["doc_id"]: r["component_id"] for r in found["jaccard"].collect()}
    assert least[BIG + 4] == BIG and least[BIG] == BIG and least[BIG + 2] == BIG + 2


def test_warc_ids_pass_unchanged(spark, tmp_path):
    pages = spark.createDataFrame([(BIG, "u", "x" * 200), (BIG + 2, None, "x" * 200), (None, "v", "x" * 200), (BIG + 4, "w", None)], "page_id long, url string, html string").coalesce(1)
    files = common.cut(warc.write_archives(warc.mark_revisits(pages), f"file://{tmp_path}/a"))
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in warc.read_archives(files, "file://").collect()}
    assert got == {BIG: ("response", None), BIG + 2: ("revisit", BIG), None: ("revisit", BIG), BIG + 4: ("response", None)}
    none = common.cut(warc.write_archives(warc.mark_revisits(pages.limit(0)), f"file://{tmp_path}/b"))
    assert warc.read_archives(none, "file://").count() == 0


def test_warc_frequent_payload(spark, tmp_path):
    """A payload that most pages share is dealt over tasks, with one response."""
    pages = spark.createDataFrame([(k, "u", "y" * 150 if k % 4 else f"{k}" * 100) for k in range(2400)], "page_id long, url string, html string")
    got = warc.mark_revisits(pages).where("refers_to is not null").select("refers_to").distinct().collect()
    assert [r[0] for r in got] == [1] and warc.mark_revisits(pages).count() == 2400


@pytest.fixture(scope="module")
def clashing(spark):
    from pyspark.sql import functions as F

    texts = [prose(k, 120) for k in range(6)]
    texts += [texts[0], texts[1] + " " + " ".join(texts[2].split()[20:70]), "see secret=abcdefgh1234 " + prose(9, 90)]
    rows = spark.createDataFrame([(k if k % 4 else None, t, len(t)) for k, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    return rows.select("*", *(F.concat(F.lit(c), F.coalesce("doc_id", F.lit(0)).cast("string")).alias(c) for c in CLASHING))


@pytest.fixture(scope="module")
def labels_dir(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(k, 1) for k in range(5)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


@pytest.mark.parametrize("stage", P.STAGES[:-1], ids=lambda s: s[0])
def test_stages_take_any_columns_along(spark, clashing, labels_dir, stage):
    out = stage[1](spark, clashing, labels_dir)
    assert out.columns == clashing.columns and [f.dataType for f in out.schema] == [f.dataType for f in clashing.schema]
    rows = out.collect()
    assert rows and all(r[c] == f"{c}{r['doc_id'] or 0}" for r in rows for c in CLASHING)
    if stage[0] in ("substring_dedup", "secret_scans"):
        assert all(r["n_chars"] == len(r["text"]) for r in rows) and len(rows) == clashing.count()


@pytest.mark.parametrize("stage", P.STAGES, ids=lambda s: s[0])
def test_stages_on_an_empty_table(spark, clashing, labels_dir, stage):
    assert stage[1](spark, clashing.limit(0), labels_dir).count() == 0


def test_one_of_each_when_ids_repeat(spark):
    a, b, c = prose(1, 90), prose(2, 90), prose(3, 90)
    near = b.replace(b.split()[45], "changed", 1)
    rows = [(3, a), (5, a), (5, b), (9, near), (11, b), (11, b), (None, c), (None, c), (None, a), (7, ""), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter(map(tuple, jaccard.one_of_each(docs, 5, 80, 100).collect()))
    assert got == collections.Counter([(3, a), (5, b), (None, c), (7, ""), (7, None)])
    twice = spark.createDataFrame([(3, a), (3, a), (4, a)], "doc_id long, text string")
    assert [tuple(r) for r in jaccard.one_of_each(twice, 5, 80, 100).collect()] == [(3, a)]


def test_join_spread(spark):
    from pyspark.sql import functions as F

    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k")).unionByName(spark.createDataFrame([(-1, None)], "id long, k long"))
    right = spark.createDataFrame([(7, "hot"), (8, "x")], "k long, v string")
    got = common.join_spread(left, right, "k")
    assert got.columns == ["k", "id", "v"] and got.count() == 3001
    assert {r["v"]: r["n"] for r in got.groupBy("v").agg(F.count("*").alias("n")).collect()} == {"hot": 1001, "x": 1, None: 1999}


def test_slices_bound_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"text": ["a" * 30, None, "b" * 50, "é" * 10, ""] * 20, "k": list(range(100))})
    parts = list(common.slices([batch], rows=7, size=60))
    assert [t for _, texts in parts for t in texts] == [(x or "").encode() for x in batch.column("text").to_pylist()]
    assert all(len(texts) <= 7 and (len(texts) == 1 or sum(map(len, texts)) <= 60) for _, texts in parts)
    assert [k for b, _ in parts for k in b.column("k").to_pylist()] == list(range(100))


def test_packing_takes_the_shortest_pack():
    # 90 and 60 leave packs with room 10 and 40: 8 goes to the one with more room
    assert sorted(packing.shortest_pack_first({90: 1, 60: 1, 8: 1}, 100)) == [((60, 8), 1), ((90,), 1)]
    # one copy to each of the equal packs
    assert sorted(packing.shortest_pack_first({70: 3, 5: 2}, 100)) == [((70,), 1), ((70, 5), 2)]


@pytest.mark.parametrize("low", range(0, 0x30000, 0x10000))
def test_bpe_every_character(low):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib, own = (f(public_tokenizers.path("word_bpe_49k.json")) for f in (Tokenizer.from_file, bpe.load))
    texts = [t for x in range(low, low + 0x10000) if not 0xD800 <= x < 0xE000 for c in [chr(x)] for t in (c, f"aB{c}c1 {c}{c}é")]
    for at in range(0, len(texts), 4096):
        part = texts[at : at + 4096]
        for t, e in zip(part, lib.encode_batch(part, add_special_tokens=False)):
            assert own.encode(t) == e.ids, ascii(t)


def test_bpe_digests_match_library(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["", None, "Hello, World's 42 ౜Ɤ été", "<|endoftext|> x", "ab" * 3000, "\x00�"]
    got = {r["doc_id"]: r for r in bpe.digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        text = lib.decode(ids, skip_special_tokens=False)
        assert (got[k]["n_tokens"], got[k]["ids_sha256"], got[k]["decoded_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_long_word():
    import public_tokenizers

    own = bpe.load(public_tokenizers.path("word_bpe_49k.json"))
    word = "".join(random.Random(1).choice("abcdefgh") for _ in range(400_000))
    assert own.decode(own.encode(word)).replace("</w>", "").replace(" ", "") == word


def test_secrets_base_columns(spark, tmp_path):
    rnd = random.Random(11)
    bits = ["token", "api_key", "APIKEY", "passwd", "secret", " = ", ":", '"', "'", "abcdefgh", "x", "/+.=-_", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "f" * 16, " ", "é", "\n", "="]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60))) for _ in range(300)] + [None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in secrets.op1_secrets(spark, str(tmp_path)).collect()}
    for k, t in enumerate(texts):
        t, found = t or "", []
        found += [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 8]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
        names = ("assign", "access", "hex")
        joined = ",".join(f"{names[kind]}:{s}:{e}" for s, kind, e in sorted(found))
        r = got[k]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(f[1] == kind for f in found) for kind in range(3)]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert ",".join(x for x in r["spans"].split(",") if not x.startswith("random")) == joined


def test_quality_scores(spark):
    """Scores and verdicts by counting each hashed n-gram one by one."""
    rnd = random.Random(12)
    texts = [prose(k, rnd.choice([30, 60, 200])) if k % 4 else " ".join(f"junk{rnd.randrange(40)}" for _ in range(80)) for k in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = {k: int(k % 4 > 0) for k in range(0, 120, 1) if k % 3}
    got = {r["doc_id"]: r for r in quality.assess(docs, spark.createDataFrame(list(labels.items()), "doc_id long, quality int")).collect()}
    hashed = {w: int(common.word_hashes([w.encode()])[0][0]) for t in texts for w in t.split()}
    shift = 64 - int(math.log2(quality.BUCKETS))

    def grams(t):
        h = [hashed[w] for w in t.split()]
        pairs = [int(common.mix(np.array([a * 0x9E3779B97F4A7C15 + b & (1 << 64) - 1], np.uint64))[0]) for a, b in zip(h, h[1:])]
        return [x >> shift for x in h + pairs]

    fit = {k for k in labels if quality._fit_half(k)}
    raw, good = (collections.Counter(g for k, t in enumerate(texts) if k in own for g in grams(t)) for own in (range(120), {k for k in fit if labels[k]}))
    n_raw, n_good, b, prior = sum(raw.values()), sum(good.values()), quality.BUCKETS, quality.PRIOR
    share = lambda g: (raw[g] + 0.5) / (n_raw + 0.5 * b)
    ratio = lambda g: math.log((good[g] + prior * b * share(g)) / (n_good + prior * b) / share(g))
    want = [sum(map(ratio, grams(t))) / len(grams(t)) for t in texts]
    assert all(abs(got[k]["score"] - want[k]) < 1e-9 for k in range(120))
    least = quality.threshold([(got[k]["score"], q) for k, q in labels.items() if k not in fit and len(texts[k].split()) >= 50])
    assert least > -math.inf and all(got[k]["kept"] == (not got[k]["base_failed"] and got[k]["score"] >= least) for k in range(120))


CONTRACT = {
    "op1": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op2": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op3": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op4": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    "op5": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op6": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op7": "page_id bigint, host string, path string, rule string, verdict string",
    "op8": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op9": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op10": "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint",
    "op11": "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    "op12": "doc_id bigint, n_features bigint, weight bigint, score bigint, rank bigint",
    "op13": "doc_id bigint, held_out boolean, score double, predicted int",
}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("contract")
    rows = [(k, t, "en", "s" if k % 2 else None, len(t or "")) for k, t in enumerate([prose(k % 5, 70) for k in range(12)] + [None, ""])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, prose(3, 40))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(1, "http://a.com/x", "<p>" + "z" * 200), (2, None, None), (3, "http://b.net/es/", "<p>" + "z" * 200)], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return str(folder)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_contract_columns(spark, tables, name):
    out = queries.QUERIES[name](spark, tables)
    assert ", ".join(f"{c} {k}" for c, k in out.dtypes).startswith(CONTRACT[name.split("_")[0]])
    rows = out.collect()
    key = out.columns[0]
    assert {r[key] for r in rows} == ({1, 2, 3} if key == "page_id" else set(range(14)))


def test_simhash_classes(spark, tables):
    got = {r["doc_id"]: r for r in simhash.op6_simhash(spark, tables).collect()}
    assert all(got[k]["near_class"] == k % 5 and got[k]["fingerprint"] == got[k % 5]["fingerprint"] for k in range(12))
    assert got[12]["near_class"] == got[13]["near_class"] == 12 and set(got[12]["fingerprint"]) == {"0"}


def test_simhash_order_over_many_parts(spark):
    """Null ids and one id of many rows are dealt over several parts; each document still meets the next of the order."""
    rnd = random.Random(13)
    rows = [(rnd.choice([None, 5, rnd.randrange(100)]), prose(k, rnd.randint(1, 20))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = sorted(((i, t) for i, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), hashlib.sha256(x[1].encode()).digest()))
    want = collections.Counter((i, hashlib.sha256(simhash.edited(t, order[(k + 1) % 300][1]).encode()).hexdigest()) for k, (i, t) in enumerate(order))
    assert collections.Counter((r["doc_id"], r["edited_sha256"]) for r in simhash.compare_edited(docs).collect()) == want
    assert simhash.in_order(docs).where("not halo").select("part").distinct().count() >= 4


def test_url_rules_beyond_broadcast(spark, monkeypatch):
    """Many rules are joined by token instead of broadcast, with equal verdicts; empty tables and repeated pages."""
    from sitescope.llm import url_filters

    urls = ["http://www.example.com/en/1", "http://x.net/es/", "http://a.org/casino/", None, "", "http://x.net/es/", "http://m.a.net/login"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = url_filters.rule_table(spark)
    few = sorted(map(str, url_filters.judge(pages, rules).collect()))
    monkeypatch.setattr(url_filters, "MAX_RULES", 0)
    assert sorted(map(str, url_filters.judge(pages, rules).collect())) == few and len(few) == 7
    assert url_filters.judge(pages.limit(0), rules).count() == 0
