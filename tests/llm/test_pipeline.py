"""The pipeline's stages on planted cases."""

import random

from sitescope.llm import common

import corpus_pipeline as P


def planted(spark, folder):
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choice(["th", "er", "on", "an", "re", "ti"]) for _ in range(rnd.randint(1, 4))) for _ in range(2000)]
    words = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    rows = [(k, " ".join(words(150))) for k in range(40)]
    near = rows[3][1].split()
    near[70] = "changed"
    passage = " ".join(words(60))
    rows += [(100, rows[3][1]), (101, " ".join(near)), (102, " ".join(words(80)) + " " + passage), (103, passage + " " + " ".join(words(80)))]
    rows += [(104, " ".join(words(100)) + " token = 0123456789abcdef0123456789abcdef0"), (105, "a b c " * 100), (106, None)]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1) for k in range(40)], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    return dict(rows), passage


def test_stages(spark, tmp_path):
    texts, passage = planted(spark, tmp_path)
    docs = common.read(spark, str(tmp_path), "documents")
    columns = docs.columns
    seen = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != P.STAGES[-1][0]:
            assert docs.columns == columns
        seen[name] = {r["doc_id"]: r["text"] if "text" in docs.columns else None for r in docs.collect()}
    assert set(seen["quality_rules"]) == set(texts) - {105, 106}
    assert set(seen["near_duplicates"]) == set(seen["quality_rules"]) - {100, 101}
    cut = seen["substring_dedup"]
    assert passage in cut[102] and passage not in cut[103] and cut[7] == texts[7]
    assert "0123456789abcdef" not in seen["secret_scans"][104] and seen["secret_scans"][7] == texts[7]
    assert set(seen["packing"]) == set(seen["secret_scans"])


def test_run(spark, tmp_path):
    planted(spark, tmp_path)
    assert P.run(spark, str(tmp_path)).count() >= 40
