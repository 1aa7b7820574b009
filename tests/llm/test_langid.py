import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkseek.llm.common import fold
from sparkseek.llm.langid import DIMENSIONS, _PIECE, learn_profiles, letter_vectors, predict_languages, text_vectors
from sparkseek.llm.queries import op5_langid


def _letter(code):
    return letter_vectors(np.array([code]))[0]


def brute_vector(text):
    out = np.zeros(DIMENSIONS)
    cleaned = " ".join("".join(c if c.isalpha() else " " for c in f" {text.lower()} ").split())
    shown = f" {cleaned} "
    for a, b, c in zip(shown, shown[1:], shown[2:], strict=False):
        if cleaned:
            out += np.roll(_letter(ord(a)), 2) * np.roll(_letter(ord(b)), 1) * _letter(ord(c))
    return out


def test_bound_and_bundled_vectors():
    texts = ["Hello, World!", "a", "", "été 12 übel", None, "no--no"]
    got = text_vectors(texts)
    for row, text in zip(got, texts, strict=True):
        assert np.array_equal(row, brute_vector(text or ""))


def test_long_texts_lose_no_trigram():
    unit = "Der Weg, été! " * 9 + "漢字かな" + "..." * 5
    long = (unit * (2 * _PIECE // len(unit) + 1))[: 2 * _PIECE + 7]
    for text in (long, "x" + long, "xy" + long, "-" * _PIECE + long, long + "?"):
        counts = {}
        shown = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
        shown = " " + " ".join(shown.split()) + " "
        for a, b, c in zip(shown, shown[1:], shown[2:], strict=False):
            counts[a, b, c] = counts.get((a, b, c), 0) + 1
        want = sum(n * np.roll(_letter(ord(a)), 2) * np.roll(_letter(ord(b)), 1) * _letter(ord(c)) for (a, b, c), n in counts.items())
        got = text_vectors(["ab", text, None])
        assert np.array_equal(got[1], want) and np.array_equal(got[0], brute_vector("ab"))


def test_letter_vectors_are_balanced_and_unlike():
    v = letter_vectors(np.arange(97, 123))
    assert set(np.unique(v)) == {-1, 1} and np.abs(v.mean()) < 0.05
    assert np.abs(v @ v.T - DIMENSIONS * np.eye(26)).max() < 6 * DIMENSIONS**0.5


def test_memory_of_many_different_letters():
    import tracemalloc

    text = "".join(chr(0x4E00 + (i * 7919) % 20_000) for i in range(500_000))
    text_vectors(["warm"])
    tracemalloc.start()
    text_vectors([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20


def test_columns_with_clashing_names(docs, awkward):
    frame = docs([(*r, "en" if r[1] == "one" else None) if len(r) == 3 else r for r in awkward])
    more = frame.select("*", *[F.lit(1).alias(n) for n in ("name", "n", "h", "bound", "v", "i", "x", "lang_pred", "score")])
    one, two = (sorted(predict_languages(x, learn_profiles(x, fold("doc_id", 5) >= 0)).collect(), key=str) for x in (frame, more))
    assert one == two


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = op5_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert len(out) > 100 and (out["lang"] == out["lang_pred"]).mean() >= 0.97


def test_awkward_rows(docs, awkward):
    frame = docs([(*r, "en" if r[1] == "one" else None) if len(r) == 3 else r for r in awkward])
    profiles = learn_profiles(frame, fold("doc_id", 5) >= 0)
    got = predict_languages(frame, profiles).toPandas()
    assert len(got) == len(awkward)
    assert set(got["lang_pred"]) == {"en", "und"}
    assert got["score"].between(0, 1).all()
    silent = got[got["doc_id"].isin([1, 2, 3, 8])]
    assert (silent["lang_pred"] == "und").all() and (silent["score"] == 0).all()
    assert learn_profiles(docs([]), F.lit(True)) == {}
    nothing = predict_languages(frame, {}).toPandas()
    assert (nothing["lang_pred"] == "und").all() and nothing["score"].max() == pytest.approx(0)
    assert predict_languages(docs([]), profiles).count() == 0
