"""Routes on small frames: what matches, what scores, what is refused."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkseek.engine import Constraints, Engine
from sparkseek.functions.text import fold, has_phrase, phrase_count, tokens
from sparkseek.operators import bm25, dense, fusion, graph, history, positions, structural
from sparkseek.operators.history import reachable
from sparkseek.plans.compile import Compiler
from sparkseek.plans.errors import QueryError
from sparkseek.queries import QUERIES
from sparkseek.sources.catalog import Catalog
from sparkseek.sources.snapshot import Snapshot
from sparkseek.sources.chunkers import byte_windows, chunk_ids, cut, line_windows
from sparkseek.streaming.ingest import Ingest, freshness

NOW = 1_706_745_600_000


@pytest.fixture(scope="module")
def engine(spark):
    chunks = spark.createDataFrame(
        [
            (1, "a", "a/needle.py", "py", "needle needle needle haystack"), (2, "a", "a/x.py", "py", "needle haystack needle"), (3, "b", "b/y.go", "go", "one Needle in hay"),
            (4, "b", "b/z.go", "go", "of the of the thing"), (5, "c", "c/n.go", "go", "nothing here at all"), (6, "c", "c/o.go", "go", ""), (7, "c", "c/p.go", "go", None),
        ],
        "candidate_id long, repo string, path string, lang string, text string",
    ).withColumns({"start_line": F.lit(1), "end_line": F.lit(1)})
    return Engine(Snapshot(chunks=chunks), NOW)


def ids(df):
    return [r["candidate_id"] for r in df.collect()]


def test_matches_and_order(engine):
    assert ids(engine.lexical("needle"))[0] == 1 and sorted(ids(engine.lexical("needle"))) == [1, 2, 3]
    assert ids(engine.lexical('"of the"')) == [4] and ids(engine.lexical("'eedle h'")) == [1, 2]
    assert ids(engine.lexical("needle -haystack")) == [3] and ids(engine.lexical("'Needle' case:yes")) == [3]
    assert sorted(ids(engine.lexical("/hay(stack)?/"))) == [1, 2, 3] and ids(engine.lexical("nothing OR thing lang:go repo:b")) == [4]
    assert engine.lexical("needle lang:py lang:go").count() == 0  # a contradiction is empty, not wrong
    assert engine.lexical("needle", constraints=Constraints(frozenset({"go"}))).count() == 1


def test_bm25_by_hand(engine):
    n, df, mean = 7, 3, (4 + 3 + 4 + 5 + 4) / 7  # the empty and the null text have no tokens but count
    got = {r["candidate_id"]: r["score"] for r in engine.lexical("needle OR zzz").collect()}
    for i, (tf, length) in {1: (3, 4), 2: (2, 3), 3: (1, 4)}.items():
        idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
        assert got[i] == pytest.approx(idf * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * length / mean)), abs=1e-6)


def test_refusals(engine):
    for text, code in (("match{ a }", "UNSUPPORTED_LEAF"), ("a author:x", "UNSUPPORTED_FILTER"), ("repo.has.topic(x)", "DOMAIN_UNAVAILABLE"), ("a type:commit", "UNSUPPORTED_COMBO")):
        with pytest.raises(QueryError) as e:
            engine.lexical(text)
        assert e.value.code == code
    for k in (0, 10_001):
        with pytest.raises(QueryError):
            engine.lexical("a", k)


def test_keyset_pages_meet(engine):
    whole = engine.lexical("'e'", 10).collect()
    first = whole[0]
    key = [first[c] for c in ("score", "repo", "path", "start_line", "end_line", "candidate_id")]
    assert [r["candidate_id"] for r in engine.lexical("'e'", 10, after=key).collect()] == [r["candidate_id"] for r in whole[1:]]


def test_explain(engine):
    assert engine.explain(99, "needle")["outcome"] == "NotIndexed" and engine.explain(5, "needle")["outcome"] == "NotMatched"
    got = engine.explain(1, "needle boost:2")
    assert got["outcome"] == "Matched" and got["emitted"] == pytest.approx(2 * got["engine_score"])
    assert engine.rendered(engine.lexical("needle", 1), "needle")[0]["spans"][0] == (0, 6)


def test_code_search_goldens(spark):
    rows = [(1, "needle needle needle haystack"), (2, "needle haystack needle"), (3, "a needle here")]
    chunks = spark.createDataFrame([(i, "r", f"f{i}.txt", "txt", t, 1, 1) for i, t in rows], "candidate_id long, repo string, path string, lang string, text string, start_line int, end_line int")
    got = {r["candidate_id"]: r["score"] for r in Engine(Snapshot(chunks=chunks), NOW).code_search("needle").collect()}
    assert got == {1: 109, 2: 107, 3: 105}


def test_phrases_overlap_and_long_tokens_keep_their_place(spark):
    df = spark.createDataFrame([("a a a b",), ("a " + "x" * 300 + " b",), ("",), ("b a",)], "t string").select(tokens(fold(F.col("t"))).alias("t"))
    got = df.select(phrase_count(F.col("t"), ["a", "a"]), has_phrase(F.col("t"), ["a", "b"])).collect()
    assert [tuple(r) for r in got] == [(2, True), (0, False), (0, False), (0, False)]


def test_fusion_by_hand(spark):
    a = fusion.lane(spark.createDataFrame([("x", 3.0), ("y", 2.0)], "candidate_id string, score double"), "a", 10, order=[("score", True)])
    b = fusion.lane(spark.createDataFrame([("y", 9.0), ("z", 8.0)], "candidate_id string, score double"), "b", 10, order=[("score", True)])
    got = [(r["id"], round(r["score"], 9)) for r in fusion.fused_page(fusion.rrf([a, b], "a"), 10).collect()]
    assert got == [("y", round(1 / 62 + 1 / 61, 9)), ("x", round(1 / 61, 9)), ("z", round(1 / 62, 9))]


def test_dense_search(spark):
    rows = spark.createDataFrame([(i, "p", 1, 1, [float(i == j) for j in range(4)]) for i in range(4)], "candidate_id long, path string, start_line int, end_line int, vector array<float>")
    assert ids(dense.top_k(rows, [0.0, 1.0, 0.5, 0.0], 2)) == [1, 2]
    overlay = rows.where("candidate_id = 1").withColumn("vector", F.array(*[F.lit(1.0).cast("float")] * 4))
    assert dense.overlaid(rows, overlay, ["candidate_id"]).count() == 4
    with pytest.raises(QueryError):
        dense.check_budget(10**6, 768, 10, 8, 1000)


def test_trace_puts_the_files_of_frames_first(spark, engine):
    vectors = spark.createDataFrame([(i, [1.0, i / 10], "r", p) for i, p in ((1, "a/needle.py"), (3, "b/y.go"), (4, "b/z.go"), (5, "c/n.go"))], "candidate_id long, vector array<double>, repo string, path string")
    named = vectors.withColumn("repo", F.substring("path", 1, 1)).withColumns({"start_line": F.lit(1), "end_line": F.lit(1), "lang": F.lit("go"), "corpus": F.lit("c")})
    traced = Engine(Snapshot(chunks=engine.s.chunks, embeddings=named, model_id="two"), NOW, embed=lambda _: [1.0, 0.1], model_id="two")
    plain = [r["id"] for r in traced.hybrid("needle OR thing", [1.0, 0.1], 10, by_file=True).collect()]
    got = [r["id"] for r in traced.test_trace("--- FAIL: needle thing\n  c/n.go:12\n  b/z.go:7", 10).collect()]
    assert got[:2] == ["c\0c/n.go", "b\0b/z.go"] and sorted(got) == sorted(plain) and plain[:2] != got[:2]
    assert [r["candidate_id"] for r in traced.semantic("text", 2).collect()] == [1, 3]
    with pytest.raises(QueryError):
        Engine(traced.s, NOW, model_id="other").semantic("text", 2)


def test_history_walk(spark):
    chain = [(str(i), [str(i - 1)] if i else [], i) for i in range(40)] + [("m", ["39", "s"], 50), ("s", ["3"], 20), ("other", [], 5)]
    commits = spark.createDataFrame(chain, "sha string, parents array<string>, committer_time_ms long")
    assert {r["sha"] for r in reachable(commits, "m").collect()} == {*map(str, range(40)), "m", "s"}
    assert {r["sha"] for r in reachable(commits, "s").collect()} == {"s", "3", "2", "1", "0"}
    assert reachable(commits, "nowhere").count() == 0
    # A ladder of merges: every commit has both commits below it as parents, in either order; and a parent that is not stored.
    ladder = [(f"{side}{i}", [f"{x}{i - 1}" for x in (("a", "b") if i % 2 else ("b", "a"))] if i else ["gone"], i) for i in range(40) for side in "ab"]
    commits = spark.createDataFrame(ladder, "sha string, parents array<string>, committer_time_ms long")
    assert {r["sha"] for r in reachable(commits, "b20").collect()} == {"b20", *(f"{x}{i}" for i in range(20) for x in "ab")}


def test_history_walk_over_buckets(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"c{i}", [f"c{rng.randrange(max(0, i - 30), i)}" for _ in range(rng.choice((1, 1, 1, 2, 3)))] if i % 97 else [], i // 3 if i % 50 else None) for i in range(600)]
    rows += [("c400", ["c20", None, "gone"], 7), ("c401", None, 9), (None, ["c1"], 1), ("c10", ["c599"], 3)]  # a sha that is stored twice, a circle
    parents = {}
    for sha, up, _ in rows:
        parents.setdefault(sha, set()).update(up or ())
    commits = spark.createDataFrame(rows, "sha string, parents array<string>, committer_time_ms long")
    monkeypatch.setattr(history, "BUCKET", 40)
    for entries, anchors in ((10_000, ("c599", "c450", "c97", "gone")), (3, ("c450",))):
        monkeypatch.setattr(history, "MOST_ENTRIES", entries)
        for anchor in anchors:
            seen, stack = set(), [anchor]
            while stack:
                x = stack.pop()
                if x in parents and x is not None and x not in seen:
                    seen.add(x)
                    stack += parents[x]
            want = sorted((s, str(t)) for s, _, t in rows if s in seen)
            assert sorted((r["sha"], str(r["committer_time_ms"])) for r in reachable(commits, anchor).collect()) == want


def entries_of(spark, rows):
    return spark.createDataFrame(rows, "identity string, owner_path string, score_millis long, tokens long, search_text string")


def test_repo_map_walk(spark):
    rows = entries_of(spark, [(str(i), "o", 10, t, "alpha") for i, t in enumerate((50, 100, 30))])
    got = graph.select_entries(rows, "alpha", 10, 90)
    assert [r["identity"] for r in got.taken] == ["0", "2"] and got.drop_codes == ["token_budget_exhausted"] and not got.degrade_codes and got.dropped == 1
    got = graph.select_entries(rows.where("identity > 0"), "alpha", 10, 90)
    assert [r["identity"] for r in got.taken] == ["1"] and got.degrade_codes == ["token_budget_floor_applied"]
    got = graph.select_entries(rows, "nothing", 10, 1000)  # unmatched entries stay
    assert [r["identity"] for r in got.taken] == ["0", "1", "2"] and got.degrade_codes == ["query_terms_unmatched"] and got.drop_codes == []
    got = graph.select_entries(rows, "", 2, 1000, focus=["2"])
    assert [r["identity"] for r in got.taken] == ["2", "0"] and got.drop_codes == ["top_k_exhausted"] and got.dropped == 1
    free = entries_of(spark, [(str(i), "o", 10, 0, "") for i in range(5)])
    assert len(graph.select_entries(free, "", 10, 3).taken) == 3  # an entry costs one token at least
    assert graph.select_entries(rows.limit(0), "alpha", 10, 90).taken == []


def test_published_index_answers_without_the_text(spark, engine, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/lake")
    catalog.publish("chunks", 1, engine.s.chunks)
    catalog.index(1)
    catalog.seal(1)
    catalog.activate(1, None)
    indexed = Engine(catalog.snapshot(), NOW)
    plan = indexed.lexical("needle -haystack")._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("\n") if "FileScan" in x]
    assert scans and not any("text:string" in x for x in scans)
    assert any("term" in x.split("PushedFilters")[1].split("ReadSchema")[0] for x in scans if "positions" in x)
    for q in ("needle", "needle -haystack", '"of the"', "needle OR thing", "hay needle", "b.y", 'NOT nothing one', '"the of" thing', "'eedle h' AND needle", "absent"):
        one, two = (x.lexical(q).select("candidate_id", "score").collect() for x in (engine, indexed))
        assert one == two, q
    why = indexed.explain(1, "needle AND haystack")
    assert why["outcome"] == "Matched" and why == engine.explain(1, "needle AND haystack") | {"domains": why["domains"]}


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 40), st.sampled_from(["red", "blue", "red blue"])), max_size=30), st.integers(1, 8), st.integers(0, 100), st.integers(1, 4))
def test_repo_map_pages_agree_with_one_walk(spark, rows, k, budget, page):
    made = [(f"{i:02d}", "o", score, tokens, text) for i, (score, tokens, text) in enumerate(rows)]
    ordered = sorted(made, key=lambda r: (-("red" in r[4]), -r[2], r[0]))
    want, used = [], 0
    for r in ordered:
        cost = max(1, r[3])
        if len(want) < k and (used + cost <= budget or not want):
            want.append(r[0])
            used += cost
    got = graph.select_entries(entries_of(spark, made), "red", k, budget, page=page)
    assert [r["identity"] for r in got.taken] == want


def test_activation_survives_a_writer_that_stopped(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/lake")
    for g in (1, 2, 3):
        catalog.seal(g)
    catalog.activate(1, None)
    (tmp_path / "lake/_activations/1.json").write_bytes(b"")
    assert catalog.active() == 1
    catalog.activate(2, 1)
    catalog.activate(3, 2)
    assert catalog.active() == 3 and catalog.rollback() == 2 and catalog.active() == 2
    assert catalog.status().where("active").first()["generation"] == 2


def test_stored_vectors_are_unit_vectors(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/lake")
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 2.0])], "candidate_id long, vector array<float>")
    catalog.publish("embeddings", 1, rows)
    assert [r["vector"] for r in catalog.read("embeddings", 1).orderBy("candidate_id").collect()] == [pytest.approx([0.6, 0.8]), [0.0, 1.0]]
    for bad in ([float("nan"), 1.0], [0.0, 0.0], [1.0, 2.0, 3.0], None):
        with pytest.raises(Exception, match="NOT_NORMALIZED"):
            catalog.publish("embeddings", 2, rows.unionAll(spark.createDataFrame([(3, bad)], "candidate_id long, vector array<float>")).coalesce(1))


def test_structural_or_keeps_bindings_and_phrases_are_runs_of_tokens(spark):
    rows = [(1, 1, 0, -1, 0, "list", 0, 3, ""), (1, 1, 1, 0, 1, "word", 0, 1, "the"), (1, 1, 2, 0, 2, "word", 1, 2, "cat"), (1, 1, 3, 0, 3, "word", 2, 3, "the")]
    nodes = spark.createDataFrame(rows, 'tree_id long, candidate_id long, node_id long, parent_id long, ord long, kind string, start long, `end` long, text string')
    a, b = structural.match_trees(nodes, "$x cat"), structural.match_trees(nodes, "the $y")
    both = structural.either(a, b)
    assert both.count() == 2  # one span, two sets of bindings
    assert structural.either(both, a).count() == 2
    assert structural.match_trees(nodes, '$x where { $x == "he" }').count() == 0
    assert structural.match_trees(nodes, '$x where { $x == "the" }').count() == 2
    assert structural.match_trees(nodes, '$...xs where { $...xs == "the cat" }').count() == 2


def test_history_and_runtime_case_and_content(spark):
    commits = spark.createDataFrame([("a", "Ann", "ann", "Fix the Parser", 1), ("b", "ann", "Bob", "fix the parser again", 2)], "sha string, author string, committer string, message string, committer_time_ms long")
    chunks = spark.createDataFrame([(1, "r", "A/x", "en", 1, 1, "Red text"), (2, "r", "a/y", "en", 1, 1, "red text")], "candidate_id long, repo string, path string, lang string, start_line int, end_line int, text string")
    dirty = spark.createDataFrame([(1, 1), (2, 1)], "candidate_id long, applied_at_ms long")
    engine = Engine(Snapshot(chunks=chunks, commits=commits, dirty=dirty), NOW)
    shas = lambda q: sorted(r["sha"] for r in engine.history(q).collect())
    assert shas("type:commit author:ann") == ["a", "b"] and shas("type:commit author:ann case:yes") == ["b"]
    assert shas("type:commit Parser case:yes") == ["a"] and shas('type:commit content:"fix the" again') == ["b"]
    assert shas("type:commit content:'Parser' case:yes") == ["a"]
    assert sorted(ids(engine.runtime("dirty:only content:red"))) == [1, 2] and ids(engine.runtime("dirty:only red case:yes")) == [2]
    assert ids(engine.runtime("dirty:only file:A/ case:yes")) == [1] and sorted(ids(engine.runtime("dirty:only file:a/"))) == [1, 2]
    with pytest.raises(QueryError):
        engine.history("type:commit content:/x/")


def test_graph(spark):
    edges = spark.createDataFrame([("call", "a", "b"), ("import", "a", "c"), ("call", "c", "a")], "kind string, source string, target string")
    assert [(r["kind"], r["neighbour"]) for r in graph.neighbours(edges, ["a"]).collect()] == [("call", "b"), ("import", "c")]


def test_generations(spark, tmp_path):
    catalog = Catalog(spark, f"file://{tmp_path}/lake")
    schema = "candidate_id long, repo string, path string, lang string, text string, start_line int, end_line int"
    base = spark.createDataFrame([(1, "r", "a", "en", "old text", 1, 1), (2, "r", "b", "en", "kept text", 1, 1), (3, "r", "c", "en", "gone text", 1, 1)], schema)
    assert catalog.publish("chunks", 1, base, event="e1") and not catalog.publish("chunks", 1, base, event="e1")
    with pytest.raises(QueryError):
        catalog.publish("chunks", 1, base.limit(1), event="e1")
    with pytest.raises(QueryError):
        catalog.resolve()
    catalog.seal(1)
    catalog.activate(1, None)
    fresh = spark.createDataFrame([(1, "r", "a", "en", "new téxt", 1, 1)], schema)
    catalog.publish("chunks", 2, fresh, parent=1, tombstones=base.where("path = 'c'"))
    assert Engine(catalog.snapshot(), NOW).lexical("'old'").count() == 1  # published is not visible
    catalog.seal(2, 1)
    with pytest.raises(QueryError):
        catalog.activate(2, None)
    catalog.activate(2, 1)
    assert sorted(ids(Engine(catalog.snapshot(), NOW).lexical("/./"))) == [1, 2]
    assert ids(Engine(catalog.snapshot(), NOW).lexical("'téxt'")) == [1]
    assert catalog.rollback() == 1 and catalog.active() == 1
    with pytest.raises(QueryError):
        catalog.publish("chunks", 2, fresh)


def test_stream_batches_apply_once(spark, tmp_path):
    ingest = Ingest(Catalog(spark, f"file://{tmp_path}/lake"), "s")
    source = tmp_path / "in"
    rows = [(1, "a", 1, "row"), (2, "b", 1, "row")]
    schema = "id long, v string, at long, kind string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(schema).parquet(str(source)).writeStream.foreachBatch(ingest.sink()).option("checkpointLocation", str(tmp_path / "c"))
    stream.trigger(availableNow=True).start().awaitTermination(120)
    spark.createDataFrame([(1, "a2", 2, "row"), (2, "", 2, "tombstone")], schema).coalesce(1).write.mode("append").parquet(str(source))
    stream.trigger(availableNow=True).start().awaitTermination(120)
    assert [(r["id"], r["v"]) for r in ingest.state(spark, ["id"], "at").select("id", "v").collect()] == [(1, "a2")]
    again = spark.createDataFrame(rows, schema)
    assert ingest.apply(again, 9) and not ingest.apply(again, 9)


def test_compaction_keeps_the_state(spark, tmp_path):
    ingest = Ingest(Catalog(spark, f"file://{tmp_path}/lake"), "s")
    schema = "id long, v string, at long, kind string"
    batches = [[(1, "a", 1, "row"), (2, "b", 1, "row")], [(2, "", 3, "tombstone"), (3, "c", 3, "row")], [(2, "late", 2, "row"), (1, "a2", 4, "row")]]
    state = lambda: sorted((r["id"], r["v"]) for r in ingest.state(spark, ["id"], "at").collect())
    for n, rows in enumerate(batches[:2], 1):
        assert ingest.apply(spark.createDataFrame(rows, schema), n)
    assert state() == [(1, "a"), (3, "c")] and ingest.compact(spark, ["id"], "at") == 2 and state() == [(1, "a"), (3, "c")]
    assert ingest.apply(spark.createDataFrame(batches[2], schema), 3) and state() == [(1, "a2"), (3, "c")]
    assert not ingest.apply(spark.createDataFrame(batches[0], schema), 1)  # a replay of what was compacted
    assert ingest.compact(spark, ["id"], "at") == 3 == ingest.compact(spark, ["id"], "at") and state() == [(1, "a2"), (3, "c")]
    with pytest.raises(QueryError):
        ingest.apply(spark.createDataFrame(batches[0], schema), 2)
    with pytest.raises(QueryError):
        ingest.apply(spark.createDataFrame(batches[0], schema), 9, parent=1)


def test_freshness_contributions_and_chunk_ids(spark):
    rows = spark.createDataFrame([(i, 0, i) for i in range(1, 101)], "id long, staged long, seen long")
    assert freshness(rows, "staged", "seen").first().asDict() == {"p50": 50, "p95": 95, "p99": 99}
    old = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "owner string, x int")
    fresh, affected = old.where("owner = 'a'").withColumn("x", F.lit(9)), old.where("owner <> 'c'").select("owner")
    assert sorted(map(tuple, graph.delta_applied(old, affected, fresh).collect())) == [("a", 9), ("c", 3)]
    parts = spark.createDataFrame([("r", "p", 0, "x"), ("r", "p", 1, "x"), ("r", "q", 0, "x")], "repo string, path string, ord int, text string")
    one, two = (sorted(r["candidate_id"] for r in chunk_ids(x).collect()) for x in (parts, parts.repartition(3)))
    assert one == two and len(set(one)) == 3


def test_nearest_pairs_are_the_ranked_pairs(spark, monkeypatch):
    rng = random.Random(3)
    usual = [[rng.gauss(0, 1) for _ in range(5)] for _ in range(300)]
    odd = [None, [0.0] * 5, [1.0, None, 0.0, 0.0, 0.0], [math.nan] * 5, [1.0, 2.0], [1e-200] * 5, [1e200] * 5]
    vectors = usual + usual[:40] + [[2 * x for x in usual[0]]] * 30 + odd
    rows = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<double>").withColumn("regions", F.array(F.col("id") % 7, F.col("id") % 4))
    queries = rows.where("id % 20 = 0 or id > 360").select(F.col("id").alias("query_id"), F.col("v").alias("q"), F.array(F.col("id") % 3, F.lit(5).cast("long")).alias("regions"))
    monkeypatch.setattr(dense, "QUERY_BLOCK", 9)
    for asked, stored in ((queries.drop("regions"), rows.drop("regions")), (queries, rows)):
        pairs = asked.withColumnRenamed("regions", "probed").crossJoin(stored)
        pairs = pairs.where(F.arrays_overlap("probed", "regions")) if "regions" in asked.columns else pairs
        want = {tuple(map(str, r)) for r in dense.ranked_pairs(pairs, 6, "id").select("query_id", "id", "score", "rank").collect()}
        got = dense.nearest_pairs(asked, stored, 6, "id")
        assert {tuple(map(str, r)) for r in got.select("query_id", "id", "score", "rank").collect()} == want


def test_dense_recall_stores_no_pairs(spark, small):
    plan = QUERIES["dense_regions_recall"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan and "Join Inner" not in plan


def test_overlaps_of_one_path_are_cut_into_tiles(spark, monkeypatch):
    spans = spark.createDataFrame([("p", i, i * 7 % 200, i * 7 % 200 + i % 90) for i in range(60)] + [("q", 99, 5, 5)], "path string, symbol_id int, s int, e int")
    pieces = spark.createDataFrame([("p", i, i * 3 % 220, i * 3 % 220 + i % 130) for i in range(300)] + [("q", 1, 0, 9), ("r", 2, 0, 9), ("p", 0, 0, 0)], "path string, chunk int, start_line int, end_line int")
    want = sorted(tuple(r) for r in spans.join(pieces, "path").where("s <= end_line and e >= start_line").collect())
    monkeypatch.setattr(positions, "TILE_PAIRS", 500)
    got = positions.span_overlaps(spans, pieces)
    assert sorted(tuple(r) for r in got.select("path", "symbol_id", "s", "e", "chunk", "start_line", "end_line").collect()) == want
    assert max(r[0] for r in got.groupBy(F.spark_partition_id()).count().select("count").collect()) < len(want) / 4
    assert positions.span_overlaps(spans.limit(0), pieces).count() == 0


@pytest.mark.parametrize("text", ["repo.has.content('needle') OR thing", "repo.has.file(path:/y/) needle", "NOT repo.has.content('needle') 'the'", "needle -haystack"])
def test_joins_carry_no_texts(engine, text):
    rows = Compiler(engine.s, engine.plan(text)[0], NOW).compile().rows
    assert not {"text", "__text", "__tokens"} & set(rows.columns)
    plan = engine.lexical(text)._jdf.queryExecution().optimizedPlan()
    joins = [x for x in plan.toString().split("\n") if "Join" in x]
    assert all("text" not in x for x in joins)


def test_index_of_some_terms_is_that_part_of_the_index(spark):
    rng = random.Random(1)
    words = ["of", "the", "often", "Trash", "ärger", "a_b", "x" * 300]
    texts = [" ".join(rng.choices(words, k=rng.randrange(40))) for _ in range(60)] + [None, "", "...", "the"]
    chunks = spark.createDataFrame([(i // 2 if i > 58 else i, t) for i, t in enumerate(texts)], "candidate_id long, text string")
    terms = ["the", "of", "trash", "ärger", "absent"]
    index, totals = bm25.index_of(chunks, terms)
    names = ["term", "candidate_id", "tf", "positions"]
    rows = [sorted(map(str, x.select(*names).collect())) for x in (index, bm25.postings(chunks).where(F.col("term").isin(*terms)))]
    assert rows[0] == rows[1] and totals.collect() == bm25.totals(chunks).collect()
    assert bm25.index_of(chunks, [])[0].count() == 0 and bm25.index_of(chunks, [])[1].collect() == bm25.totals(chunks).collect()


def test_frequencies_of_all_words_are_one_pass(spark):
    chunks = spark.createDataFrame([(1, "of the of the"), (2, "of it"), (3, "the end")], "candidate_id long, text string")
    scorer = bm25.IndexScorer(bm25.postings(chunks), bm25.totals(chunks))
    scorer.want(["of", "the"])
    rows = scorer.joined(chunks).select("candidate_id", scorer.score(["of", "the"]).alias("score"), scorer.score(["the"]).alias("lone"))
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert plan.count(" AS df0") == plan.count(" AS df1") and " AS df#" not in plan
    assert [r["candidate_id"] for r in rows.where("score > 0").collect()] == [1]


def test_windows_in_batches_of_bounded_bytes(spark):
    texts = ["", None, "é\r\nab\n" * 30, "x" * 70, "日本\r語\n", *(f"line {i}\n" * (i % 9) for i in range(40))]
    files = spark.createDataFrame([("r", str(i), "en", t) for i, t in enumerate(texts)], "repo string, path string, lang string, text string").coalesce(1)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    got = line_windows(files, 16, 4)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString() and int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
    want = {(str(i), k, s, e, t.encode()[s:e].decode("utf-8", "replace")) for i, t in enumerate(texts) if t for k, (s, e) in enumerate(byte_windows(t, 16, 4))}
    assert {tuple(r) for r in got.select("path", "ord", "start_byte", "end_byte", "text").collect()} == want
    for how in ("lines", "blocks"):
        rows = cut(files, 20, how).orderBy("ord").collect()
        assert all("".join(r["text"] for r in rows if r["path"] == str(i)) == (t or "") for i, t in enumerate(texts))
