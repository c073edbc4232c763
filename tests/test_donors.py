"""Donor suggestions where many pages share tokens: few rows leave each part, and the best are those of all pairs."""

import collections
import random

from pyspark.sql import functions as F

from sitescope.operators import links as L

PAGES = "site string, key string, path string, tokens array<string>, outgoing int, status_code int"


def test_a_rare_token_s_pages_do_not_leave_as_pairs(spark):
    pages = [("s", f"k{k:03}", f"/p{k}", ["shared", f"own{k}"], k % 30, 200) for k in range(150)]
    rows = spark.createDataFrame(pages, PAGES).select("site", "key", F.split(F.substring("path", 2, 9), "/").alias("steps"), "tokens", F.size("tokens").alias("size"), "outgoing")
    rows = rows.withColumn("marks", F.transform("tokens", lambda x: F.xxhash64(x))).withColumn("ways", L._ways())
    t = rows.withColumnRenamed("key", "target").withColumn("places", F.lit(3))
    found = L._by_rare_tokens(t, rows.withColumnRenamed("key", "donor"), spark.createDataFrame([], "site string, token string")).collect()
    assert collections.Counter(collections.Counter(r["target"] for r in found).values()) == {3: 150}
    assert {r["donor"] for r in found if r["target"] == "k000"} == {"k020", "k021", "k022"}


def test_the_best_of_all_pairs_where_classes_and_beginnings_mix(spark):
    rnd = random.Random(11)
    words = [f"w{k}" for k in range(14)]
    pages = [(f"s{k % 2}", f"k{k:03}", "/" + "/".join(rnd.choice("ab") for _ in range(rnd.randint(0, 4))), rnd.sample(words, rnd.randint(0, 7)), rnd.randint(0, 30), rnd.choice([200, 200, 404])) for k in range(160)]
    edge = [(f"s{k % 2}", f"k{rnd.randrange(80) * 2 + k % 2:03}", f"k{rnd.randrange(10) * 2 + k % 2:03}") for k in range(120)]  # some targets have many links
    targets = [r[:2] for r in pages[:60]]
    for frequent in (3, 25):
        found = L.suggest_donors(spark.createDataFrame(targets, "site string, key string"), spark.createDataFrame(pages, PAGES), spark.createDataFrame(edge, "site string, src_key string, dst_key string"), frequent=frequent)
        got = sorted((r["target"], r["rank"], r["donor"], r["score"], r["overlap"]) for r in found.collect())
        want = []
        for site, target, path, tokens, *_ in pages[:60]:
            ranked = []
            for other, donor, way, more, out, status in pages:
                if other == site and donor != target and status == 200 and (site, donor, target) not in edge:
                    both, prefix = len(set(tokens) & set(more)), 0
                    for x, y in zip(path.strip("/").split("/"), way.strip("/").split("/")):
                        if x != y:
                            break
                        prefix += 1
                    if both or prefix:
                        score = both / max(1, len(tokens) + len(more) - both) * 100 + 8 * prefix + min(out, 20) * 0.15
                        ranked.append((-round(score, 9), donor, both))
            want += [(target, k + 1, donor, round(-less, 1), both) for k, (less, donor, both) in enumerate(sorted(ranked)[:3])]
        assert [x[:3] + x[4:] for x in got] == sorted(x[:3] + x[4:] for x in want)
        assert all(abs(x[3] - y[3]) < 0.11 for x, y in zip(got, sorted(want)))
