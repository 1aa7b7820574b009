import random

from sparkseek.llm.linededup import dedup_lines


def brute(rows):
    places = {}
    for i, t in sorted({(r[0], r[1]) for r in rows if r[1] is not None}):
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            if "".join(lines[p : p + 3]).strip(" "):
                places.setdefault(tuple(lines[p : p + 3]), []).append((i, t, p))
    gone = {}
    for at in places.values():
        for i, t, p in sorted(at)[1:]:
            gone.setdefault((i, t), set()).update((p, p + 1, p + 2))
    return {(i, t): "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ())) for i, t, *_ in rows if t is not None}


def test_agrees_with_brute_force(docs, awkward):
    rng = random.Random(1)
    rows = [(20 + i, "\n".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 40)))) for i in range(60)]
    rows += [r for r in awkward if r[0]]
    texts = {r[0]: r[1] for r in rows}
    got = dedup_lines(docs(rows)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    for r in got:
        before = texts[r["doc_id"]]
        assert r["text"] == (None if before is None else want[r["doc_id"], before])
        if before is not None:
            assert r["line_dedup"]["n_lines"] == before.count("\n") + 1
            left = r["text"].count("\n") + 1 if r["text"] or r["line_dedup"]["removed_lines"] < before.count("\n") + 1 else 0
            assert r["line_dedup"]["removed_lines"] == before.count("\n") + 1 - left


def test_other_columns_and_nulls(spark, docs, awkward):
    frame = spark.createDataFrame([(1, "a\nb\nc", 1, "r", 5), (2, "x\na\nb\nc\ny", 2, "r", 6), (None, "a\nb\nc", 3, "q", 7)], "doc_id long, text string, lines int, row string, h1 int")
    out = dedup_lines(frame)
    assert out.columns == [*frame.columns, "line_dedup"]
    got = {r["lines"]: (r["text"], r["row"], r["h1"]) for r in out.collect()}
    assert got == {3: ("a\nb\nc", "q", 7), 1: ("", "r", 5), 2: ("x\ny", "r", 6)}  # a null id comes first
    assert dedup_lines(docs([])).count() == 0
    assert dedup_lines(docs(awkward)).count() == len(awkward)
