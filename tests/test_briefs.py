"""Texts against their own briefs, held against a search of every place for every phrase."""

import collections
import random
import re

import pytest

from sitescope.functions import words as W
from sitescope.operators import briefs as B

REQUIREMENTS = "brief_id long, requirement int, phrase string, min int, max int"
DOCS = "doc_id long, brief_id long, text string"


def every_match(text, phrase, forms=True):
    """(first, last, exact) of each place where the phrase's words stand in order within one sentence."""
    tokens, query = W.tokens_of(text), re.findall(W.WORD, phrase)
    out = []
    for i in range(len(tokens) - len(query) + 1):
        own = tokens[i : i + len(query)]
        if not query or own[0][6] != own[-1][6]:
            continue
        exact = all(t[1] == W.normal_word(q) for t, q in zip(own, query))
        if exact or forms and all(t[2] == W.stem(q) for t, q in zip(own, query)):
            out.append((i, i + len(query) - 1, exact))
    return out


def claimed(text, phrases, forms=True):
    """(requirement, first, last, exact): longer phrases first, then in the given order."""
    taken, out = set(), []
    for k in sorted(phrases, key=lambda k: (-len(re.findall(W.WORD, phrases[k])), k)):
        for a, b, exact in every_match(text, phrases[k], forms):
            if not taken.intersection(range(a, b + 1)):
                taken.update(range(a, b + 1))
                out.append((k, a, b, exact))
    return out


def case(seed):
    rnd = random.Random(seed)
    vocabulary = ["насос", "насоса", "насосы", "вода", "воды", "the", "The", "of", "of-the", "ёж", "1"]
    text = lambda n: " ".join(rnd.choice(vocabulary) + rnd.choice(["", "", "", ".", "!", ","]) for _ in range(n))
    briefs = {b: {k: " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 3))) for k in range(4)} for b in range(5)}
    briefs[4] = {0: "the the", 1: "...", 2: "насос", 3: "насосы"}
    docs = [(k, rnd.choice([0, 0, 1, 2, 4, 9, None]), text(rnd.choice([0, 3, 30, 120]))) for k in range(60)]
    docs += [(2**53 + 1, 0, text(40)), (2**53 + 2, 0, text(40)), (None, 0, text(40)), (None, 4, "the the the"), (700, 1, None), (701, 1, ""), (702, 4, "The the the. The the")]
    return docs, briefs


@pytest.mark.parametrize("forms", [True, False])
def test_matches_and_claims(spark, forms):
    docs, briefs = case(3)
    frame = spark.createDataFrame(docs + docs[:3], DOCS).coalesce(1)
    asked = spark.createDataFrame([(b, k, p, k % 3, k % 3 + 1) for b, own in briefs.items() for k, p in own.items()] + [(None, 0, "the", 1, 1)], REQUIREMENTS)
    found = B.matches(frame, asked, forms)
    want = collections.Counter((i, b, k, *m) for i, b, t in docs for k, p in briefs.get(b, {}).items() for m in every_match(t or "", p, forms))
    assert collections.Counter((r["doc_id"], r["brief_id"], r["requirement"], r["first"], r["last"], r["exact"]) for r in found.collect()) == want
    assert want
    held = B.independent(found)
    own = collections.Counter((i, b, *m) for i, b, t in docs for m in claimed(t or "", briefs.get(b, {}), forms))
    assert collections.Counter((r["doc_id"], r["brief_id"], r["requirement"], r["first"], r["last"], r["exact"]) for r in held.collect()) == own
    n = collections.Counter((i, b, k) for (i, b, k, *_), m in own.items() for _ in range(m))
    status = {(r["doc_id"], r["brief_id"], r["requirement"]): (r["n"], r["status"]) for r in B.keyword_status(frame, asked, held).collect()}
    assert set(status) == {(i, b, k) for i, b, _ in docs for k in briefs.get(b, {})}
    assert all(s == (n[key], "missing" if n[key] < key[2] % 3 else "excess" if n[key] > key[2] % 3 + 1 else "ok") for key, s in status.items())


def test_only_a_brief_s_own_phrases_count(spark):
    docs = spark.createDataFrame([(1, 1, "red shoes"), (2, 2, "red shoes"), (3, None, "red shoes")], DOCS)
    asked = spark.createDataFrame([(1, 0, "red", 1, 1), (2, 0, "shoes", 2, 3)], REQUIREMENTS)
    held = B.independent(B.matches(docs, asked))
    assert sorted((r["doc_id"], r["first"]) for r in held.collect()) == [(1, 0), (2, 1)]
    status = {r["doc_id"]: (r["status"], r["delta"]) for r in B.keyword_status(docs, asked, held).collect()}
    assert status == {1: ("ok", 0), 2: ("missing", 1)}


def test_readiness_by_the_brief_s_figures(spark):
    docs = spark.createDataFrame([(1, 1, "red x red shoes blue"), (2, 2, "plain text"), (3, 7, "no brief"), (4, 1, None)], DOCS)
    asked = spark.createDataFrame([(1, 0, "red", 0, 1), (1, 1, "hat", 2, 3)], REQUIREMENTS)
    lists = spark.createDataFrame([(1, 0, "blue"), (1, 1, "green")], "brief_id long, requirement int, phrase string")
    targets = spark.createDataFrame([(1, 100, None), (2, 2, 50)], "brief_id long, words long, chars long")
    held = B.independent(B.matches(docs, asked))
    out = B.readiness(B.keyword_status(docs, asked, held), B.spacing(held), B.coverage(docs, lists, B.matches(docs, lists)), B.volume(docs, targets))
    got = {r["doc_id"]: (r["missing"], r["excess"], r["spacing"], r["missing_lsi"], r["issues"], r["ready"]) for r in out.collect()}
    assert got == {1: (2, 1, 1, 1, "missing,excess,spacing,lsi,short", False), 2: (0, 0, 0, 0, "", True), 3: (0, 0, 0, 0, "", True), 4: (2, 0, 0, 2, "missing,lsi,short", False)}
    deltas = {r["doc_id"]: (r["word_delta"], r["char_delta"]) for r in B.volume(docs, targets).collect()}
    assert deltas == {1: (95, None), 2: (0, 40), 3: (None, None), 4: (100, None)}


def test_many_stems_and_empty_tables(spark, monkeypatch):
    docs = spark.createDataFrame([(1, 1, "w1 w2. w2 w3")], DOCS)
    asked = spark.createDataFrame([(1, 0, "w1 w2", 0, 1), (1, 1, "w2", 0, 1)], REQUIREMENTS)
    monkeypatch.setattr(B, "WANTED", 1)
    assert sorted((r["requirement"], r["first"]) for r in B.independent(B.matches(docs, asked)).collect()) == [(0, 0), (1, 2)]
    for d, a in ((docs.limit(0), asked), (docs, asked.limit(0))):
        held = B.independent(B.matches(d, a))
        assert held.count() == 0 and B.spacing(held).count() == 0


def test_parsed_briefs_lead_to_requirements(spark):
    from sitescope.operators import texts as T

    text = "Добавьте в текст ключевые слова\n- насос: 1-2\n- вода: 0-3\nДобавьте в текст LSI\nдом\nСтруктура статьи"
    parsed = T.parse_briefs(spark.createDataFrame([(5, text)], "brief_id int, text string"))
    assert [tuple(r) for r in B.requirements_of(parsed).collect()] == [(5, 0, "насос", 1, 2), (5, 1, "вода", 0, 3)]
    assert [tuple(r) for r in B.lists_of(parsed).collect()] == [(5, 0, "дом")]


def test_tokens_keep_ids(spark):
    ids = (2**53 + 1, None, 2**53 + 2)
    got = W.tokenize(spark.createDataFrame([(i, "a b.") for i in ids], "doc_id long, text string").coalesce(1)).collect()
    assert collections.Counter(r["doc_id"] for r in got) == {i: 2 for i in ids}
