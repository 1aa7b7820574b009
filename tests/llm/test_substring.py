import random

from sparkseek.llm.substring import dedup_substrings, merged, sentences, spans


def brute(rows):
    seen, out = {}, {}
    keyed = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    for _, i, text in keyed:
        cover = []
        for h1, h2, s, e in spans(text):
            if (h1, h2) in seen:
                cover.append((s, e))
            else:
                seen[h1, h2] = (i, s)
        at, left = 0, []
        for s, e in merged(cover):
            left.append(text[at:s])
            at = e
        out[i, text] = "".join(left) + text[at:]
    return out


def story(rng, n):
    return " ".join(" ".join(f"v{rng.randrange(900)}" for _ in range(rng.randint(3, 14))) + "." for _ in range(n))


def test_agrees_with_brute_force(docs, awkward):
    rng = random.Random(2)
    passages = [story(rng, 8) for _ in range(3)]
    rows = [(10 + i, story(rng, 4) + " " + rng.choice(passages) + " " + story(rng, 3)) for i in range(30)]
    rows += [r[:2] for r in awkward if r[0]]
    got = {(r["doc_id"], t): r["text"] for r, t in ((r, dict(rows)[r["doc_id"]] or "") for r in dedup_substrings(docs(rows)).collect())}
    want = brute(rows)
    assert {k: v or "" for k, v in got.items()} == want
    kept = " ".join(v or "" for v in got.values())
    assert all(kept.count(p[20:-20]) == 1 for p in passages if any(p in (r[1] or "") for r in rows))


def test_spans_and_sentences():
    assert sentences("A b. C d!\nE") == [(0, 5), (5, 10), (10, 11)]
    assert sentences("") == []
    text = " ".join(f"w{i}" for i in range(30)) + "."
    assert [(s, e) for _, _, s, e in spans(text)] == [(0, len(text))]  # one long sentence is a span by itself
    assert list(spans("short one. short two.")) == []


def test_columns_and_empty_table(docs):
    passage = "the passage that occurs twice has a first sentence. and it has a second one of quite a few more words too."
    got = {r["doc_id"]: r for r in dedup_substrings(docs([(1, passage), (2, "Before it. " + passage), (3, None)])).collect()}
    assert got[1]["text"] == passage and got[2]["text"] == "Before it. " and got[3]["text"] is None
    assert got[2]["removed_sentences"] == 2 and got[2]["removed_chars"] == len(passage)
    assert [(x["s"], x["e"]) for x in got[2]["removed_spans"]] == [(11, 11 + len(passage))]
    assert dedup_substrings(docs([])).count() == 0


def test_short_runs_and_the_end_of_a_passage(docs):
    """Eight words in two sentences are a run, and a passage's short last sentences belong to it."""
    short, ends = "six words are in this one. two more. ", "here is a passage of some words. its end. goes. "
    rows = [(1, f"{short}Then one goes on. {ends}Nothing more."), (2, f"Before. {short}Between. {ends}After it all."), (3, None)]
    got = {r["doc_id"]: r["text"] for r in dedup_substrings(docs(rows)).collect()}
    assert got == {1: rows[0][1], 2: "Before. Between. After it all.", 3: None}


def plain_brute(rows, least_words=8, long_sentence=25):
    """From texts whose sentences end in a stop and a space: every run by looking at all pairs of sentences."""
    first, out = {}, {}
    for i, text in sorted(rows):
        parts = [p + ". " for p in text.split(". ")[:-1]] + [text.split(". ")[-1]]
        parts = [p for p in parts if p]
        words = [tuple(p.lower().split()) for p in parts]
        n = len(parts)
        enough = {(a, b) for a in range(n) for b in range(a + 2, n + 1) if sum(map(len, words[a:b])) >= least_words}
        runs = {(a, b) for a, b in enough if not any((a, c) in enough for c in range(a + 2, b)) or not any((c, b) in enough for c in range(a + 1, b - 1))}
        runs |= {(a, a + 1) for a in range(n) if len(words[a]) >= long_sentence}
        gone = set()
        for a, b in sorted(runs):
            where = (i, a)
            if first.setdefault(tuple(words[a:b]), where) != where:
                gone |= set(range(a, b))
        out[i] = ("".join(p for k, p in enumerate(parts) if k not in gone), len(gone))
    return out


def test_agrees_with_a_brute_force_of_its_own(docs):
    rng = random.Random(12)
    pool = [" ".join(f"q{rng.randrange(300)}" for _ in range(rng.choice([1, 2, 3, 5, 9, 14, 26]))) for _ in range(60)]
    rows = []
    for i in range(60):
        parts = [rng.choice(pool) if rng.random() < 0.5 else " ".join(f"u{i}_{k}_{x}" for x in range(rng.randint(1, 12))) for k in range(rng.randint(1, 14))]
        if i % 3 == 0:
            at = rng.randrange(50)
            parts[1:1] = pool[at : at + 6]
        rows.append((i, ". ".join(parts) + "."))
    got = {r["doc_id"]: (r["text"], r["removed_sentences"]) for r in dedup_substrings(docs(rows)).collect()}
    want = plain_brute(rows)
    assert got == want and sum(n for _, n in want.values()) > 40
