"""Columns whose names the operators use themselves change nothing."""

import pytest
from pyspark.sql import functions as F

from sparkseek.llm.linededup import dedup_lines
from sparkseek.llm.mixing import mix_sources
from sparkseek.llm.packing import best_fit_packing
from sparkseek.llm.quality import score_quality
from sparkseek.llm.simhash import drop_near_duplicates, simhash_groups
from sparkseek.llm.spotsigs import edited_fingerprints
from sparkseek.llm.substring import dedup_substrings
from sparkseek.llm.topk import top_k_products

NAMES = (
    "id print n k i j a b fp node root h h1 h2 s e cover first copy copies size cluster shard bin_id words key at tail block place least keys "
    "sid weight cap ratio turn target taken passes budget bound line position lost lost_print own_print quality_score score rank query_id v"
).split()


def _wide(frame):
    return frame.select("*", *[F.lit(7).alias(n) for n in NAMES])


@pytest.mark.parametrize("run", [simhash_groups, mix_sources, dedup_substrings, edited_fingerprints, best_fit_packing])
def test_documents(docs, awkward, run):
    frame = docs(awkward)
    one, two = (sorted(run(x).collect(), key=str) for x in (frame, _wide(frame)))
    assert one == two and len(one) >= len({r[0] for r in awkward})


def test_operators_that_keep_all_columns(docs, awkward):
    frame = docs(awkward)
    wide = _wide(frame)
    for run in (drop_near_duplicates, dedup_lines, lambda x: score_quality(x, None, score_col="quality_score_")):
        one, two = run(frame), run(wide)
        assert two.columns[: len(wide.columns)] == wide.columns
        keep = [c for c in one.columns if c in two.columns]
        assert sorted(map(str, one.select(keep).collect())) == sorted(map(str, two.select(keep).collect()))


def test_vectors(spark):
    rows = [(i, [float(i % 7), 1.0, -float(i % 5)]) for i in range(300)] + [(None, [1.0, 2.0, 3.0]), (900, None), (901, []), (100, [9.0, 9.0, 9.0]), (0, [0.0, 1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    wide = frame.select("*", *[F.lit(7).alias(n) for n in NAMES if n != "embedding"])
    one, two, blocks = (
        sorted(x.collect()) for x in (
            top_k_products(frame, F.col("vec_id") % 100 == 0), top_k_products(wide, F.col("vec_id") % 100 == 0),
            top_k_products(frame, F.col("vec_id") % 100 == 0, block=1),
        )
    )
    assert one == two == blocks and len(one) == 30
