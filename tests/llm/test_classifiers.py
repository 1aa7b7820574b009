import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkseek.llm.common import fold, hash_sample
from sparkseek.llm.quality import SEGMENT, _segments, _within, block_marginals, forward_backward, learn_quality, line_features, score_quality
from sparkseek.llm.queries import op8_toxicity, op9_quality
from sparkseek.llm.toxicity import Linear, _mark, _ratio, features, fit_nnpu, learn_toxicity, score_toxicity, words

SF = "/root/testdata/sf0.01"


def auc(y, score):
    rank = pd.Series(score).rank().to_numpy()
    return (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())


@pytest.mark.parametrize(("query", "label", "least"), [(op8_toxicity, "toxic", 0.7), (op9_quality, "quality", 0.97)])
def test_held_out_ranking(spark, query, label, least):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().drop_duplicates("doc_id")
    out = query(spark, SF).toPandas()
    assert out["score"].between(0, 1).all() and ((out["score"] >= 0.3) == (out["predicted"] == 1)).all()
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = out[out["held_out"]].merge(labels, on="doc_id")
    assert auc(held[label].to_numpy(), held["score"].to_numpy()) >= least


def test_marginals_agree_with_enumeration():
    rng = np.random.default_rng(1)
    sizes = np.array([1, 4, 3])
    evidence, moves = rng.normal(size=8), rng.normal(size=(2, 2))
    good, expected = forward_backward(evidence, sizes, moves)
    want, transitions, at = [], np.zeros((2, 2)), 0
    for n in sizes:
        total, ones, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(evidence[at + t] * y[t] for t in range(n)) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
            total += w
            ones += w * np.array(y)
            for a, b in zip(y, y[1:], strict=False):
                pairs[a, b] += w
        want += list(ones / total)
        transitions += pairs / total
        at += n
    assert np.allclose(good, want) and np.allclose(expected, transitions)


def test_long_chains_have_exact_marginals():
    rng = np.random.default_rng(3)
    for sizes in ([1, 40, 7, 16, 0, 33], [200], [8, 8], [1]):
        sizes = np.array(sizes)
        evidence, moves = rng.normal(size=sizes.sum()) * 2, rng.normal(size=(2, 2)) * 2
        for block in (1, 2, 8, 16, 1000):
            assert np.allclose(block_marginals(evidence, sizes, moves, block), forward_backward(evidence, sizes, moves)[0])


def test_training_segments_are_all_of_a_text():
    text = "\n".join(map(str, range(SEGMENT * 40 + 3))).encode()
    parts = _segments(text)
    assert len(parts) == 41 and b"\n".join(parts) == text and _segments(b"") == [b""]
    assert _within([(1, 5, 10, 60), (1, 3, 11, 50), (0, 9, 12, 500), (1, 4, 13, 60), (1, 6, 14, 1)], 100) == {11, 13, 12}


def test_line_features_count_lines():
    base, length, sizes = line_features([b"", b"One two.\nAND!\n", "é".encode()])
    assert sizes.tolist() == [1, 3, 1] and length.tolist() == [0, 8, 4, 0, 2] and np.isfinite(base).all()


def test_quality_awkward_rows(spark, docs, awkward):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 0), (6, 1, 1), (8, 0, 0), (9, 0, 1), (None, 1, 1), (3, None, None), (99, 1, 0), (4, 0, 0)], "doc_id long, quality int, toxic int")
    frame = docs(awkward)
    model = learn_quality(frame, labels, fold("doc_id", 5) >= 0)
    out = score_quality(frame, model, score_col="score").toPandas()
    assert len(out) == len(awkward) and out["score"].between(0, 1).all()
    assert out.columns.tolist() == [*frame.columns, "score"]
    assert (score_quality(frame, None).toPandas()["quality_score"] == 1).all()
    assert learn_quality(frame, labels.where("quality = 1"), fold("doc_id", 5) >= 0) is None
    assert learn_quality(docs([]), labels, fold("doc_id", 5) >= 0) is None
    assert score_quality(docs([]), model).count() == 0


def test_toxicity_awkward_rows(spark, docs, awkward):
    labels = spark.createDataFrame([(4, 1), (5, 1), (6, 0), (None, 1), (3, None), (99, 1)], "doc_id long, toxic int")
    frame = docs(awkward)
    model = learn_toxicity(frame, labels, fold("doc_id", 4) >= 0)
    out = score_toxicity(frame, model).toPandas()
    assert len(out) == len(awkward) and out["score"].between(0, 1).all()
    assert learn_toxicity(frame, labels.where("toxic = 0"), fold("doc_id", 4) >= 0).score("one") < 1e-9
    assert learn_toxicity(docs([]), labels, fold("doc_id", 4) >= 0).weights == {}
    assert score_toxicity(docs([]), Linear({}, 0.0)).count() == 0


def test_nnpu_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(2)
    texts = ["vile " + " ".join(f"w{rng.integers(50)}" for _ in range(8)) if i % 4 == 0 else " ".join(f"w{rng.integers(50)}" for _ in range(8)) for i in range(800)]
    positive = np.array([i % 4 == 0 and i % 8 == 0 for i in range(800)])  # half of the toxic texts are confirmed
    names = sorted(set().union(*map(words, texts)))
    rows = [[names.index(w) for w in sorted(words(t))] for t in texts]
    w, b = fit_nnpu(rows, positive, len(names), prior=0.25)
    scores = np.array([1 / (1 + np.exp(-(b + w[r].sum()))) for r in rows])
    truth = np.array([i % 4 == 0 for i in range(800)])
    assert (w >= 0).all() and scores[truth].min() > scores[~truth].max() and scores[truth].min() >= 0.3


def test_toxicity_finds_held_out_and_lone_words(spark):
    """At the threshold: most held-out toxic texts, few others, and clean texts into which one known word or a new form of it is put."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = learn_toxicity(docs, labels, fold("doc_id", 4) != 2)
    held = docs.join(labels.where(fold("doc_id", 4) == 2), "doc_id").select("doc_id", "text", "toxic", "lang")
    scores = held.select("doc_id", "toxic", "lang", "text").toPandas()
    scores["score"] = [model.score(t) for t in scores["text"]]
    toxic, clean = scores[scores["toxic"] == 1], scores[scores["toxic"] == 0]
    assert (toxic["score"] >= 0.3).mean() >= 0.85 and (clean["score"] < 0.3).mean() >= 0.96
    lone = clean[(clean["lang"] == "en") & (clean["score"] < 0.3)]["text"].head(100)
    assert np.mean([model.score(t[: len(t) // 2] + " idiot " + t[len(t) // 2 :]) >= 0.3 for t in lone]) >= 0.98
    sample = score_toxicity(docs.limit(200), model).toPandas().merge(docs.limit(200).toPandas(), on="doc_id")
    assert np.allclose(sample["score"], [model.score(t) for t in sample["text"]])


def test_toxicity_features_and_marks(spark):
    assert features("abc") == ["abc"] and features("abcde") == ["abcde", "abc*", "abcd*"]
    assert len(features("x" * 1000)[0]) == 33 and words("A b\nA " + "c " * 3_000_000) == {"a", "b", "c"}
    long = " ".join(f"w{i}" for i in range(600_000))
    assert _mark("") != _mark("one") and _mark(long) == min(_mark(long[:2_500_000]), _mark(long[2_400_000:]))
    ratio = spark.range(1).select(_ratio(F.lit(10), F.lit(10), 100, 100).alias("x"), _ratio(F.lit(30), F.lit(0), 100, 100).alias("y")).first()
    want = 2 * (30 * np.log(30 / 15) + 70 * np.log(70 / 85) + 100 * np.log(100 / 85))
    assert abs(ratio["x"]) < 1e-9 and abs(ratio["y"] - want) < 1e-9


def test_toxicity_ignores_columns_with_clashing_names(spark, docs, awkward):
    labels = spark.createDataFrame([(4, 1), (5, 1), (6, 0)], "doc_id long, toxic int")
    frame = docs(awkward)
    names = ["id", "positive", "y", "f", "a", "c", "g", "mark", "found", "score", "place", "__place"]
    more = frame.select("*", *[F.lit(1).alias(n) for n in names])
    one, two = (sorted(score_toxicity(x, learn_toxicity(x, labels, fold("doc_id", 4) >= 0)).collect(), key=str) for x in (frame, more))
    assert one == two


def test_hash_sample_is_bounded_and_repeatable(spark):
    rows = spark.range(1000)
    a, b = (sorted(r[0] for r in hash_sample(x, "id", 50).collect()) for x in (rows, rows.repartition(7)))
    assert a == b and len(a) == 50
    assert hash_sample(rows, "id", 2000).count() == 1000
