"""Whole jobs within bounds: all labels, all sizes, memory."""

import random
import tracemalloc
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitescope.llm import common, jaccard, quality, substrings, suffix_tree


def made(n, seed=3):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(3000)]
    return [" ".join(rnd.choice(words) for _ in range(300)) for _ in range(n)]


def test_paths_hold_little_of_each_word():
    texts = [t.encode() for t in made(1500)]
    tracemalloc.start()
    paths = substrings.Paths(texts, np.arange(1500), np.ones(1500, bool), substrings.WINDOW, substrings.K)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(paths.first) > 50_000 and peak < 75 * 1500 * 300


def test_paths_of_slices_are_those_of_the_whole(spark, monkeypatch):
    texts = made(40)
    texts = [t if k % 3 else t[:150] + " " + texts[0][100:400] + " " + t[150:] for k, t in enumerate(texts)] + ["", "one two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {}
    for k, t in enumerate(texts):
        words = t.split()
        for i in range(len(words) - 12):
            first.setdefault(tuple(words[i : i + 13]), k)
    gone = {}
    for k, t in enumerate(texts):
        words = t.split()
        gone[k] = len({p for i in range(len(words) - 12) if first[tuple(words[i : i + 13])] < k for p in range(i, i + 13)})
    encoded = [t.encode() for t in texts]
    whole = substrings.Paths(encoded, np.arange(42), np.ones(42, bool), 13, 5)
    assert {r["doc_id"]: r["n_removed"] for r in substrings.drop_repeats(docs).collect()} == gone and sum(gone.values()) > 100
    monkeypatch.setattr(substrings, "SLICE_BYTES", 500)
    sliced = substrings.Paths(encoded, np.arange(42), np.ones(42, bool), 13, 5)
    assert len(sliced.hashes) > 10
    for name in ("first", "last", "node", "label", "check", "doc", "n_words", "entry"):
        assert (getattr(sliced, name) == getattr(whole, name)).all()
    chosen = np.arange(0, len(whole.first), 3)
    assert all((a == b).all() for a, b in zip(sliced.windows(chosen), whole.windows(chosen)))


def test_quality_learns_from_all_labels(spark):
    """Labels of other ids, however many, change nothing: none displaces a document's own."""
    rnd = random.Random(5)
    texts = [t if k % 4 else " ".join(f"junk{rnd.randrange(40)} x{rnd.randrange(400)}" for _ in range(60)) for k, t in enumerate(made(80))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    quality_of = F.when((F.col("doc_id") < 80) & (F.col("doc_id") % 4 == 0), 0).otherwise(1).alias("quality")
    own, many = (spark.range(n).select(F.col("id").alias("doc_id"), quality_of) for n in (80, 100_000))
    a, b = ({r["doc_id"]: (r["score"], r["kept"]) for r in quality.assess(docs, labels).collect()} for labels in (own, many))
    assert a == b and not any(kept for k, (_, kept) in b.items() if k % 4 == 0)


def test_quality_threshold_of_tables(spark):
    """The threshold found on tables is the plain one."""
    rnd = random.Random(6)
    for n in (3, 700, 3000):
        scores = [(rnd.choice([rnd.gauss(q, 1), round(rnd.gauss(q, 1), 1)]), q) for q in (rnd.randrange(2) for _ in range(n))]
        scored = spark.createDataFrame([(k, 50, s) for k, (s, _) in enumerate(scores)], "doc_id long, n_words long, score double")
        known = spark.createDataFrame([(k, q) for k, (_, q) in enumerate(scores)], "doc_id long, quality int")
        assert quality._held_out_threshold(scored, known) == quality.threshold(scores)
    half = spark.range(-300, 300).union(spark.range(1 << 62, (1 << 62) + 300)).toDF("doc_id").select("doc_id", F.expr(quality.FIT_HALF).alias("fit")).collect()
    assert all(r["fit"] == quality._fit_half(r["doc_id"]) for r in half)


@pytest.fixture
def no_broadcast(spark):
    """Spark broadcasts nothing by itself."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def test_quality_leaves_texts_where_they_are(spark, monkeypatch, no_broadcast):
    """Whatever Spark may broadcast by itself, the labels go to the texts."""
    docs = spark.createDataFrame(list(enumerate(made(80))), "doc_id long, text string")
    labels = spark.range(100_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    plans, count = [], quality.count_features
    monkeypatch.setattr(quality, "count_features", lambda own: (plans.append(own._jdf.queryExecution().executedPlan().toString()), count(own))[1])
    quality.fit(docs, labels)
    assert len(plans) == 2 and "BroadcastHashJoin" in plans[1] and "SortMergeJoin" not in plans[1]


def test_quality_target_is_of_the_ids_labelled_good(spark, no_broadcast):
    """Neighbouring, far, negative, repeated and missing ids, by masks that are broadcast and by a join of masks."""
    rnd = random.Random(9)
    ids = [*range(-130, 200), *(rnd.randrange(-(1 << 63), 1 << 63) for _ in range(300)), -(1 << 63), (1 << 63) - 1]
    rows = [(k, f"{k} {n}") for n, k in enumerate([*ids, *ids[::7], None, None])]
    marks = [(k, rnd.choice([0, 1, 1, None])) for k in [*rnd.sample(ids, 500), *rnd.sample(ids, 200), 5000, None]]
    lowest = {}
    for k, q in marks:
        if k is not None and q is not None:
            lowest[k] = min(q, lowest.get(k, 1))
    want = sorted(t for k, t in rows if lowest.get(k) == 1 and quality._fit_half(k))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = quality.labelled(spark.createDataFrame(marks, "doc_id long, quality int"))
    assert len(want) > 100
    assert all(sorted(r["text"] for r in quality.trusted_texts(docs, known, most).collect()) == want for most in (quality.MASKS, 0))


def test_suffix_tree_is_the_same_wherever_dealing_begins(spark):
    """Contexts whose successors are dealt over buckets get the test and the weight of all others."""
    rnd = random.Random(8)
    texts = [" ".join(rnd.choice(["the", "of", "a"]) + " " + rnd.choice([f"w{rnd.randrange(60)}", f"v{rnd.randrange(9)}"]) for _ in range(120)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4, "doc_id")
    few, many = (
        {r["doc_id"]: r["score"] for r in suffix_tree.score_documents(docs, F.col("doc_id") % 5 == 0, deal=deal).collect()} for deal in (suffix_tree.HOT, 40)
    )
    assert len(few) == 60 and all(abs(few[k] - many[k]) < 1e-6 for k in few)


def stages_run(spark, work):
    """What the work returns, and how many stages it ran."""
    sc, group = spark.sparkContext, uuid.uuid4().hex
    sc.setJobGroup(group, "counted")
    try:
        out = work()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = [tracker.getStageInfo(s) for s in {s for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds}]
    return out, sum(s is not None and s.numCompletedTasks > 0 for s in stages)


@pytest.mark.parametrize("edges, most", [([(0, k) for k in range(1, 40)], 12), ([(9 - k, 10 - k) for k in range(10)] + [(20, 22), (21, 22)], 55), ([], 12)])
def test_components_take_few_stages(spark, edges, most):
    """Each stage has a task for each partition, however small the graph; stars are done at once."""
    frame = spark.createDataFrame(edges, "a long, b long")
    found, stages = stages_run(spark, lambda: dict(map(tuple, common.components(frame).collect())))
    assert found == {k: 0 if k < 20 or len(edges) == 39 else 20 for e in edges for k in e}
    assert stages <= most


def test_similar_documents_take_few_stages(spark, monkeypatch):
    """Three sets that link, but meet only where smaller sets without a link are the centres: the second round finds them."""
    monkeypatch.setattr(jaccard, "FEW", 2)
    rows = [(k, " ".join([f"own{k}", *(f"c{i}" for i in range(20))])) for k in range(3)]
    rows += [(100 + 3 * i + j, " ".join([f"c{i}", *(f"e{x}" for x in range(4 + 2 * j))])) for i in range(20) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rounds, verify = [], jaccard.Join.verify
    monkeypatch.setattr(jaccard.Join, "verify", lambda self, pairs: (rounds.append(1), verify(self, pairs))[1])
    found, stages = stages_run(spark, lambda: {r["doc_id"]: r["component_id"] for r in jaccard.similar_documents(docs, 1).collect()})
    assert found == {k: k if k > 2 else 0 for k, _ in rows} and len(rounds) == 2
    assert stages <= 105
