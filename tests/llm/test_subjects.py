from __future__ import annotations

import random

import numpy as np
import pytest

from tideline.llm import subjects as S

WORDS = {
    "cooking": "flour butter oven skillet broth garlic onion pastry dough simmer ladle recipe".split(),
    "astronomy": "planet orbit comet nebula quasar eclipse telescope asteroid galaxy pulsar moon redshift".split(),
    "law": "court statute verdict plaintiff tort docket counsel appeal injunction covenant tribunal warranty".split(),
}
FOREIGN = {"cooking": "mehl ofen zwiebel teig brühe knoblauch pfanne rezept".split()}
PLAIN = "return value index list error open file count name range table state".split()
DOCS = "doc_id long, text string, subject string"
LABELS = "doc_id long, subject string, rater string"


def text(r, subjects, n=60, words=WORDS):
    out = [r.choice(PLAIN) for _ in range(n)]
    for s in subjects:
        out += [r.choice(words[s]) for _ in range(n // len(subjects))]
    r.shuffle(out)
    return "\n".join(" ".join(w if r.random() < 0.5 else w.capitalize() + "Value" for w in out[k : k + 6]) for k in range(0, len(out), 6))


def corpus(spark, n=600):
    r = random.Random(1)
    names = sorted(WORDS)
    rows, truth, labels = [], {}, []
    for i in range(n):
        own = {r.choice(names)} | ({r.choice(names)} if i % 5 == 0 else set())
        words = FOREIGN if i % 4 == 3 else WORDS
        if words is FOREIGN:
            own = {"cooking"}
        body = text(r, sorted(own), words=words)
        if i % 7 == 0:
            body = "// SPDX-License-Identifier: X\n// court statute verdict plaintiff tort docket counsel appeal\n" * 3 + body
        rows.append((i, body, "clash"))
        truth[i] = own
        if i < 200:
            labels += [(i, s, "a") for s in own]
    labels += [(3, "law", "errs"), (7, "nothing", "a"), (None, "law", "a"), (5, None, "a"), (10**6, "law", "a")]
    rows += [(n, None, ""), (n + 1, "", ""), (n + 2, " \n\t ", ""), (n + 3, "x" * 200_000, "")]
    listed = spark.createDataFrame([(s, " ".join(WORDS[s][:4])) for s in names], "subject string, description string")
    return spark.createDataFrame(rows, DOCS).repartition(4), listed, spark.createDataFrame(labels, LABELS), truth


def scores(found, truth):
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert set(got) <= set(truth)
    hit = sum(len(got.get(i, set()) & t) for i, t in truth.items())
    return hit / sum(map(len, got.values())), hit / sum(map(len, truth.values()))


def test_held_out_accuracy(spark):
    docs, listed, labels, truth = corpus(spark)
    found = S.subject_areas(docs, listed, labels)
    assert found.count() == found.distinct().count()
    # Documents below 200 are labelled: only the others tell.
    precision, recall = scores(found.filter("doc_id >= 200"), {i: t for i, t in truth.items() if i >= 200})
    assert precision > 0.9 and recall > 0.9


def test_without_labels_descriptions_seed(spark):
    docs, listed, labels, truth = corpus(spark)
    english = {i: t for i, t in truth.items() if i % 4 != 3}
    found = S.subject_areas(docs.filter("doc_id % 4 <> 3 or doc_id >= 600"), listed, labels.limit(0))
    precision, recall = scores(found, english)
    assert precision > 0.9 and recall > 0.9


def test_empty(spark):
    docs, listed, labels, _ = corpus(spark, 40)
    assert S.subject_areas(docs.limit(0), listed, labels).count() == 0
    assert S.subject_areas(docs, listed.limit(0), labels).count() == 0
    assert S.subject_areas(docs.filter("text is null"), listed, labels).count() == 0


def test_terms():
    assert S.terms("MembraneRow fooBar_baz HTTPServer x1 MUTACIÓN_CÉLULA") == {
        "membrane": 1, "row": 1, "foo": 1, "bar": 1, "baz": 1, "http": 1, "server": 1, "mutación": 1, "célula": 1,
    }
    assert S.terms("// Copyright court\n# statute\nlet planet = 1") == {"let": 1, "planet": 1}
    assert S.terms("// court\nlet planet = 1") == {"court": 1, "let": 1, "planet": 1}
    assert S.terms("# licence court\n") == {"licence": 1, "court": 1}


def test_decomposition_brute_force(spark):
    """The basis spans what a full decomposition finds, and space.project equals the dense product."""
    docs, *_ = corpus(spark, 200)
    vectors = S.term_vectors(docs)
    space = S.fit_space(vectors)
    rows = vectors.collect()
    a = np.zeros((len(rows), len(space.weights)))
    for i, r in enumerate(rows):
        for d, n in zip(r.dims, r.counts):
            if space.position[d] >= 0:
                a[i, space.position[d]] = np.log1p(n) * space.weights[space.position[d]]
    a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-12)
    e = {r.doc_id: np.frombuffer(r.e, np.float32) for r in S.embeddings(vectors, space).collect()}
    for i, r in enumerate(rows):
        p = a[i] @ space.basis
        if np.linalg.norm(p):
            assert np.allclose(e[r.doc_id], p / np.linalg.norm(p), atol=1e-4)
    kept = np.linalg.norm(a @ space.basis) ** 2
    best = (np.linalg.svd(a, compute_uv=False)[: space.basis.shape[1]] ** 2).sum()
    assert kept > 0.97 * best


def test_scripts_without_spaces():
    """Sentences that share words share terms, and words of two characters count."""
    assert S.terms("价格 getPrice") == {"价格": 1, "get": 1, "price": 1}
    assert S.terms("税率表，税率") == {"税率": 2, "率表": 1}
    a, b = S.terms("# 法院判决赔偿原告的损失"), S.terms("# 原告上诉，法院判决无效")
    assert {"法院", "判决", "原告"} <= a.keys() & b.keys()
    assert S.terms("법원 판결").keys() == {"법원", "판결"} and "ที่" not in S.terms("ศาลที่") and len(S.terms("ศาลที่")) == 5
    assert S.terms("plainWords überall") == {"plain": 1, "words": 1, "überall": 1}


def test_too_many_subjects_are_refused(spark):
    listed = spark.range(S.MAX_SUBJECTS + 1).selectExpr("concat('s', id) AS subject", "'' AS description")
    with pytest.raises(ValueError, match="subjects"):
        S.subject_areas(spark.createDataFrame([], "doc_id long, text string"), listed, spark.createDataFrame([], LABELS))


def test_subjects_are_assigned_by_cosine(spark, monkeypatch):
    """Every row found is near to a centroid of its subject; none is without the cosine."""
    docs, listed, labels, truth = corpus(spark)
    found, centroids, names = S.fitted(docs, listed, labels)
    rows = found.collect()
    near = centroids.cosines(np.array([np.frombuffer(r.e, np.float32) for r in rows]))
    assert near.shape == (len(rows), len(names)) and -1 <= near.min() and near.max() <= 1 + 1e-6
    candidates = {(r.doc_id, names[s]) for r, c in zip(rows, near) for s in np.flatnonzero(c >= S.COSINE)}
    assert {tuple(r) for r in S.subject_areas(docs, listed, labels).collect()} <= candidates
    true = {(i, s) for i, t in truth.items() for s in t}
    assert len(candidates & true) > 0.95 * len(true) and len(candidates) < 2 * len(true)


@pytest.mark.parametrize("shape", [(5,), (700, 3), (1, 2)])
def test_sums_of_arrays(spark, monkeypatch, shape):
    """Put together in blocks, with blocks that are empty in some tasks or in all."""
    monkeypatch.setattr(S, "SUM_BLOCK", 64)

    def part(batches):
        out = np.zeros(shape)
        for b in batches:
            for x in b.column("id").to_pylist():
                out.reshape(-1)[x % out.size // 2] += x
        return out

    want = np.zeros(shape)
    for x in range(1000):
        want.reshape(-1)[x % want.size // 2] += x
    for n in (1, 7, 40):
        assert np.array_equal(S._summed(spark.range(1000, numPartitions=n), part, shape, np.float64), want)
    assert not S._summed(spark.range(0), part, shape).any()
