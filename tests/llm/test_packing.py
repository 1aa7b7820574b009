import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sparkseek.llm.packing import best_fit_packing, pack


def brute(items, capacity):
    """Best fit by looking at every bin."""
    room, held, out = [], [], []
    for at, (size, source, cluster) in enumerate(items):
        piece = 0
        while size > capacity:
            room.append(0)
            held.append(None)
            out.append((at, piece, capacity, len(room) - 1))
            piece, size = piece + 1, size - capacity
        if not size:
            continue
        fits = [
            (room[b], b) for b in range(len(room))
            if room[b] >= size and held[b] is not None and source not in held[b][0] and (cluster is None or cluster not in held[b][1])
        ]
        if fits:
            b = min(fits)[1]
        else:
            b = len(room)
            room.append(capacity)
            held.append((set(), set()))
        room[b] -= size
        held[b][0].add(source)
        held[b][1].add(cluster)
        out.append((at, piece, size, b))
    return out


def test_search_finds_the_tightest_compatible_bin():
    rng = random.Random(6)
    for _ in range(30):
        items = sorted(((rng.randint(0, 70), rng.randrange(5), rng.choice([None, 0, 1, 2, 3])) for _ in range(80)), reverse=True, key=lambda x: x[0])
        assert pack(items, 50) == brute(items, 50)


def test_constraints_hold_and_nothing_is_lost(docs, awkward):
    rng = random.Random(7)
    rows = [(100 + i, " ".join(f"w{i % 40}" for _ in range(rng.choice([0, 3, 500, 1999, 2048, 5000]))), f"s{rng.randrange(9)}") for i in range(200)] + awkward
    frame = docs(rows)
    out = best_fit_packing(frame).collect()
    words, texts = defaultdict(int), {}
    for i, t, *s in rows:
        words[i] += len((t or "").split())
        texts[i] = (t, s[0] if s else None)
    got = defaultdict(int)
    bins = defaultdict(list)
    for r in out:
        got[r["doc_id"]] += r["words"]
        if r["bin_id"] is None:
            assert r["words"] == 0
        else:
            bins[r["bin_id"]].append(r)
    assert dict(got) == dict(words)
    for held in bins.values():
        assert sum(r["words"] for r in held) == held[0]["bin_words"] <= 2048 and len(held) == held[0]["bin_documents"]
        named = [texts[r["doc_id"]] for r in held if r["doc_id"] is not None]
        assert max(Counter(source for _, source in named).values(), default=1) == 1
        assert max(Counter((text or "").lower().strip() for text, _ in named).values(), default=1) == 1
    again = best_fit_packing(frame.orderBy(F.rand(3))).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    assert best_fit_packing(docs([])).count() == 0
