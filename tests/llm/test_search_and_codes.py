"""Operators 11 to 13 against plain loops, and on awkward rows."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import codebooks, lexical, personal
from tests.llm import brute

WORDS = [a + b for a in ("the", "on", "er", "ing", "Éa") for b in ("re", "nd", "at", "sh", "le", "ou", "ti")]


def _docs(spark, rows, extra=""):
    return spark.createDataFrame(rows, "doc_id long, text string" + extra)


# personal data

PIECES = ["a@b.co", "x.y+z@mail-1.example.com.", "a@b", "@", "..", "1.2.3.4", "300.1.2.3", "1.2.3.4.5.6.7.8.9", "000000000000000000000255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "4111111111111111 5500000000000004",
          "+1 (826) 555-4081", "+49 30 1234567", "+1 (826) 555-4081 190.137.223.204", "+12", "+1-", "+", "é", "\n", " ", "-", "7", "12", "٣٤", "tel 826-555-4081", "joe at host dot com", "x", "%", "v1.2.3", "9" * 30]


def _base(text):
    return ",".join(f"{personal.KINDS[k]}:{a}:{b}" for a, k, b in brute.personal_spans(text))


def test_base_spans_of_random_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PIECES) + rng.choice(["", " ", " ", "-", "."]) for _ in range(rng.randrange(25))) for _ in range(600)]
    rows = list(enumerate([*texts, None, "", "9" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+" + "1 " * 50_000]))
    got = {r.doc_id: r for r in personal.report(_docs(spark, rows).repartition(3)).collect()}
    assert len(got) == len(rows)
    for i, text in rows[:602]:
        want = _base(text)
        assert got[i].base_sha256 == brute.sha(want), text
        kinds = [k for _, k, _ in brute.personal_spans(text)]
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [kinds.count(k) for k in range(4)]
        assert set(filter(None, want.split(","))) <= set(got[i].spans.split(","))
    assert got[602].n_card == got[603].n_email == 0 and got[604].n_ip == 25_000


def test_spans_that_votes_add(spark):
    rng = random.Random(4)
    prose = lambda: " ".join(rng.choice(WORDS) for _ in range(12))
    rows = []
    for k in range(200):
        number = "".join(rng.choice("0123456789") for _ in range(15))
        good = next(number + c for c in "0123456789" if brute.luhn(number + c))
        bad = next(number + c for c in "0123456789" if not brute.luhn(number + c))
        rows.append(f"{prose()} card {good} {prose()} joe{k}@mail.example.com, token {bad}")
        rows.append(f"{prose()} call +1 (826) 555-{1000 + k} {prose()} release {bad} {prose()}")
        rows.append(f"{prose()} version {k}.{k % 9}")
    hidden = {
        "one +1 (826) 555-4081 190.137.223.204 two": "+1 (826) 555-4081",
        "one 4111111111111111 5500000000000004 two": "5500000000000004",
        "tel 826-555-4081 two": "826-555-4081",
        "mail joe.x [at] host [dot] com two": "joe.x [at] host [dot] com",
    }
    texts = [*rows, *hidden]
    got = {r.doc_id: r for r in personal.report(_docs(spark, list(enumerate(texts)))).collect()}
    for i in range(len(rows)):
        assert got[i].n_added == 0 and brute.sha(got[i].spans) == got[i].base_sha256, (texts[i], got[i].spans)
    for i, text in enumerate(texts[len(rows) :], len(rows)):
        spans = [tuple(map(int, s.split(":")[1:])) for s in got[i].spans.split(",")]
        assert hidden[text] in [text[a:b] for a, b in spans], (text, spans)
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:], strict=False))
        assert hidden[text] not in personal.removed(text, spans)


def test_estimated_reliabilities():
    """Of labelers with known errors, expectation-maximisation finds the classes of the spans again."""
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.3
    right = [0.95, 0.9, 0.7, 0.6, 0.55, 0.8]
    vote = np.stack([np.where(rng.random(len(truth)) < 0.2, 0, np.where((rng.random(len(truth)) < p) == truth, 1, 2)) for p in right], 1)
    code = np.full(len(truth), 2)
    for k in range(vote.shape[1]):
        code = code * 3 + vote[:, k]
    codes, where, counts = np.unique(code, return_inverse=True, return_counts=True)
    form, length, back = personal.votes(codes)
    assert (form == 0).all() and (length == 2).all() and (back[where] == vote).all()
    chance = personal.estimated(codes, counts.astype(float))
    weight = personal.classifier(codes, counts.astype(float), chance)
    assert ((chance[where] >= 0.5) == truth).mean() > 0.94
    assert ((personal.scores(codes, weight)[where] >= 0.5) == truth).mean() > 0.94
    assert abs(chance @ counts / counts.sum() - 0.3) < 0.02


def test_newton_meets_the_gradient():
    """At the classifier's weights the gradient of the regularised likelihood, by differences, is zero."""
    codes = np.arange(0, personal.CODES, 97)
    rng = np.random.default_rng(2)
    counts, chance = rng.integers(1, 9, len(codes)).astype(float), rng.random(len(codes))
    weight = personal.classifier(codes, counts, chance)

    def loss(w):
        p = personal.scores(codes, w)
        return -(counts * (chance * np.log(p) + (1 - chance) * np.log(1 - p))).sum() + 0.25 * (w * w).sum()

    for k in range(len(weight)):
        step = np.zeros(len(weight))
        step[k] = 1e-4
        assert abs(loss(weight + step) - loss(weight - step)) / 2e-4 < 1e-2


def test_personal_awkward(spark):
    rows = [(1, "a@b.co", "en", 3), (1, "a@b.co", "en", 3), (None, None, None, None), (2, "", None, 1), (None, "1.2.3.4", "x", 2)]
    docs = _docs(spark, rows, ", `spans` string, `a.b` int")
    got = sorted(repr((r.doc_id, r.n_email, r.n_ip, r.spans)) for r in personal.report(docs).collect())
    assert got == sorted(map(repr, [(1, 1, 0, "email:0:6"), (1, 1, 0, "email:0:6"), (None, 0, 0, ""), (2, 0, 0, ""), (None, 0, 1, "ip:0:7")]))
    assert personal.report(docs.limit(0)).count() == 0
    assert [r.n_added for r in personal.report(docs.filter("text = ''")).collect()] == [0]


# vector codes


def _vectors(spark, rows, extra=""):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int" + extra)


def test_vector_codes(spark):
    rng = random.Random(6)
    rows = [(i, [float(np.float32(rng.gauss(0, 0.4))) for _ in range(32)], rng.choice([0, 0, 0, 1, None])) for i in rng.sample(range(1000), 200)]
    rows += [(2000 + k, rows[3][1], 7) for k in range(90)]
    dropped = [(3000, None, 1), (3001, [0.0] * 31 + [float("nan")], 1), (3002, [None] + [0.0] * 31, 1), (3003, [float("inf")] * 32, 0)]
    got = codebooks.report(_vectors(spark, rows + dropped).repartition(5)).collect()
    want, books = brute.vector_codes([(i, v) for i, v, _ in rows])
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted(want)
    labels, sums = {i: y for i, _, y in rows}, {}
    for i, _, e in want:
        sums[labels[i]] = sums.get(labels[i], 0) + e
    assert all(r.label_error == sums[labels[r.vec_id]] for r in got)
    assert {r.codebooks_sha256 for r in got} == {brute.sha(",".join(str(x) for part in books for entry in part for x in entry))}


def test_vector_codes_with_few_and_awkward_rows(spark):
    rows = [(5, [0.5] * 16, 1), (5, [0.25] * 16, 1), (None, [0.5] * 16, None), (7, [1.0] * 8, 1), (8, [], 2), (9, None, 2), (6, [-0.001] * 16, None)]
    vectors = _vectors(spark, [(*r, "x") for r in rows], ", `code` string")
    got = sorted(((repr(r.vec_id), r.code or "", r.error, r.label_error) for r in codebooks.report(vectors).collect()), key=repr)
    # seeds: 5 with its lesser vector, then 6; -0.001 becomes -1; 0.5 is nearest to 0.25 and moves it to floor((64 + 128 + 128) / 3)
    far = 16 * (64 - 106) ** 2, 16 * (128 - 106) ** 2
    want = [("5", "00" * 16, far[0], sum(far)), ("5", "00" * 16, far[1], sum(far)), ("6", "01" * 16, 0, far[1]), ("7", "", None, sum(far)), ("8", "", None, None), ("None", "00" * 16, far[1], far[1])]
    assert got == sorted(want, key=repr)
    assert codebooks.report(vectors.limit(0)).count() == 0
    assert codebooks.report(vectors.filter("vec_id IS NULL")).collect()[0].code is None
    with pytest.raises(ValueError, match="17 components"):
        codebooks.report(_vectors(spark, [(1, [0.0] * 17, 1)]))


def test_vectors_too_large_are_refused(spark):
    with pytest.raises(Exception, match="too large for exact distances"):
        codebooks.report(_vectors(spark, [(1, [1e30] * 16, 1), (2, [0.0] * 16, 1)])).collect()


def test_decoded_vectors(spark):
    rng = random.Random(2)
    vectors = _vectors(spark, [(i, [rng.randrange(-512, 512) / 256 for _ in range(16)], 0) for i in range(40)])
    books = codebooks.fit(vectors)
    back = {r.vec_id: r.approximate for r in codebooks.decoded(codebooks.coded(vectors, books), books).collect()}
    for r in vectors.collect():
        assert len(back[r.vec_id]) == 16 and max(abs(a - b) for a, b in zip(back[r.vec_id], r.embedding, strict=True)) < 1.2
    # as many entries as rows: each row is an entry, until means of equal parts meet
    assert sum(back[r.vec_id] == list(r.embedding) for r in vectors.collect()) > 30


# ranked search


def _text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_ranked_search(spark):
    rng = random.Random(8)
    docs = [(i, _text(rng, rng.choice([1, 5, 30, 200]))) for i in rng.sample(range(10_000), 400)]
    docs += [(20_000 + k, docs[5][1]) for k in range(60)] + [(30_000, None), (30_001, ""), (30_002, " -- "), (30_003, "THE " * 3000)]
    items = [(k, _text(rng, rng.choice([1, 2, 8, 40]))) for k in range(30)] + [(40, docs[5][1]), (41, None), (42, "?"), (43, "nowhere"), (44, "Éare ÉARE éare 7")]
    got = lexical.search(_docs(spark, docs).repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.item_id, r.rank, r.doc_id, r.score) for r in got.collect()) == sorted(brute.ranked(docs, items))


def test_small_trees_blocks_and_shards(spark, monkeypatch):
    """Results don't depend on how documents fall into shards and items into blocks."""
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 300)
    rng = random.Random(9)
    docs = [(i, _text(rng, 25)) for i in range(300)]
    items = [(k, _text(rng, 6)) for k in range(7)]
    got = lexical.search(_docs(spark, docs), spark.createDataFrame(items, "item_id long, text string"), k=5)
    assert sorted((r.item_id, r.rank, r.doc_id, r.score) for r in got.collect()) == sorted(brute.ranked(docs, items, 5))


@pytest.mark.parametrize("seed", range(4))
def test_tree_search(seed):
    """Branch and bound against all sums, with ties; and it opens few nodes where one range stands out."""
    rng = np.random.default_rng(seed)
    n, t = 3000, 12
    held = rng.random((n, t)) < 0.3
    part = rng.integers(1, 4, (n, t)) * held
    doc, term = np.nonzero(held)
    tree = lexical.Tree(np.arange(n) * 2, doc, term, part[doc, term])
    for k in (1, 7, 20):
        item = np.array([0, 3, 5]), np.array([2, 1, 1])
        best = []
        tree.search(item, best, k)
        score = part[:, item[0]] @ item[1]
        want = sorted(((int(s), -2 * i) for i, s in enumerate(score) if s > 0), reverse=True)[:k]
        assert sorted(best, reverse=True) == want
    part[:40, 0] = 50
    held[:40, 0] = True
    doc, term = np.nonzero(held)
    tree, best = lexical.Tree(np.arange(n), doc, term, part[doc, term]), []
    assert tree.search((np.array([0]), np.array([1])), best, 20) <= 5
    assert sorted(-i for _, i in best) == list(range(20))


def test_ranked_awkward(spark):
    docs = _docs(spark, [(None, "one two", 1), (None, "one two", 2), (3, "one two", 3), (3, "one two", 3), (4, None, 4), (None, None, None)], ", `rank` int").withColumn("a.b", F.lit(1))
    items = spark.createDataFrame([("q", "ONE"), (None, "two two"), ("q", "one"), ("r", None)], "item_id string, text string")
    got = lexical.search(docs, items).collect()
    assert sorted((repr(r.item_id), r["rank"], repr(r.doc_id)) for r in got) == sorted((i, k + 1, d) for i in ("'q'", "'q'", "None") for k, d in enumerate(["3", "3", "None", "None"]))
    assert lexical.search(docs.limit(0), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0


def test_terms_are_those_of_the_pattern():
    text = "Ab_c9 Éé-x\x7fy\x00z ÀB٣"
    data, first = lexical._terms([text])
    assert len(data) == len(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)) and first.tolist() == [0, len(data)]
