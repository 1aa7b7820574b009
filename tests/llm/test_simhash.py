import random
import re

import numpy as np
import pytest
import xxhash

from sparkseek.llm.bitslice import link_groups
from sparkseek.llm.components import components
from sparkseek.llm.simhash import PRINT_RADIUS, PRINT_WORDS, drop_near_duplicates, near_duplicate_groups, similar_pairs, simhash_groups, wide_print


def brute_print(text, shingle=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    runs = [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def closure(ids, linked):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(ids)):
        groups.setdefault(find(i), []).append(ids[i])
    return [min((x for x in groups[find(i)] if x is not None), default=None) for i in range(len(ids))]


def some_texts(n, seed=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 120))) for _ in range(n // 2)]
    for t in texts[: n // 2]:
        words = t.split()
        words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(" ".join(words).upper() if rng.random() < 0.3 else " ".join(words))
    return texts


def test_groups_agree_with_brute_force(docs, awkward):
    rows = [*awkward, *((100 + i, t) for i, t in enumerate(some_texts(120)))]
    got = sorted((r["doc_id"] or 0, r["fingerprint"], r["component_id"] or 0) for r in simhash_groups(docs(rows)).collect())
    prints = [brute_print(r[1]) for r in rows]
    roots = closure([r[0] for r in rows], lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3)
    assert got == sorted((r[0] or 0, f"{p:016x}", c or 0) for r, p, c in zip(rows, prints, roots, strict=True))


@pytest.mark.parametrize("size", [40, 700])
def test_bit_slices_lose_no_link(size):
    rng = np.random.default_rng(size)
    centres = rng.integers(0, 1 << 63, 6).astype(np.uint64)
    prints = centres[rng.integers(0, 6, size)]
    for _ in range(3):
        prints = prints ^ (np.uint64(1) << rng.integers(0, 64, size).astype(np.uint64))
    sizes = np.array([3, size - 3])
    label = link_groups(prints[:, None], sizes, 3)
    group = np.repeat([0, 1], sizes)
    want = closure(list(range(size)), lambda i, j: group[i] == group[j] and int(prints[i] ^ prints[j]).bit_count() <= 3)
    least = {}
    for i, x in enumerate(label.tolist()):
        least.setdefault(x, i)
    assert [least[x] for x in label.tolist()] == want


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(201, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame([*edges, (7, 7), (1, 0)], "a long, b long")).collect()}
    ids = sorted({x for e in edges for x in e})
    both = {frozenset(e) for e in edges}
    want = dict(zip(ids, closure(ids, lambda i, j: frozenset((ids[i], ids[j])) in both), strict=True))
    assert got == {k: v for k, v in want.items() if k != v}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_five_word_shingles(docs):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(5000)}" for _ in range(200)] for _ in range(30)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for i, w in enumerate(base):  # one changed word leaves 5-word shingles alike by about 0.95, three by 0.86
        changed = list(w)
        for _ in range(1 + 2 * (i % 2)):
            changed[rng.randrange(200)] = "changed"
        rows.append((100 + i, " ".join(changed)))
    got = {r["doc_id"]: r["group_id"] for r in near_duplicate_groups(docs(rows)).collect()}
    assert got == {i: i % 100 for i, _ in rows}


def test_links_are_exact(docs):
    """Ten changed words leave five-word shingles alike by 0.6, five by 0.77, four by 0.81; only the last is a copy."""
    rng = random.Random(9)
    rows, want = [], {}
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        changed, n = list(words), (4, 5, 10)[i % 3]
        for j in range(n):
            changed[10 + 200 // n * j + rng.randrange(5)] = f"changed{j}"
        rows += [(i, " ".join(words)), (100 + i, " ".join(changed))]
        want |= {i: i, 100 + i: i if n == 4 else 100 + i}
    assert {r["doc_id"]: r["group_id"] for r in near_duplicate_groups(docs(rows)).collect()} == want


def brute_wide_print(text):
    words = text.split()
    hashes = {xxhash.xxh64_intdigest(" ".join(words[i : i + 5]).encode(), 42) for i in range(len(words) - 4)}
    out = 0
    for k, add in enumerate((0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)):
        mixed = []
        for x in hashes:
            if k:
                x ^= add
                x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
                x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
                x ^= x >> 31
            mixed.append(x)
        out |= sum(1 << 64 * k + b for b in range(64) if 2 * sum(x >> b & 1 for x in mixed) > len(mixed))
    return out


def test_near_duplicates_are_linked_by_fingerprints(docs):
    """At a small radius only those copies are found whose SimHash is within it, at the default one all."""
    rng = random.Random(11)
    rows, far = [], {}
    for i in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        changed = list(words)
        changed[20 + rng.randrange(160)] = "changed"
        rows += [(i, " ".join(words)), (100 + i, " ".join(changed))]
        far[i] = (brute_wide_print(rows[-2][1]) ^ brute_wide_print(rows[-1][1])).bit_count()
    radius = sorted(far.values())[30]
    assert 10 <= sum(x <= radius for x in far.values()) <= 50
    got = {r["doc_id"]: r["group_id"] for r in near_duplicate_groups(docs(rows), radius=radius).collect()}
    assert got == {i: i % 100 if far[i % 100] <= radius else i for i, _ in rows}
    assert {r["doc_id"]: r["group_id"] for r in near_duplicate_groups(docs(rows)).collect()} == {i: i % 100 for i, _ in rows}


def test_radius_reaches_all_sets_alike_by_the_least_share():
    rng = np.random.default_rng(12)
    for shared, a, b in [(4, 0, 1), (5, 0, 1), (8, 1, 1), (12, 1, 2), (12, 0, 3), (20, 2, 3), (100, 12, 13), (400, 0, 100), (400, 50, 50)]:
        for _ in range(60):
            x = rng.integers(0, 1 << 63, shared + a + b).astype(np.uint64) << np.uint64(1) | rng.integers(0, 2, shared + a + b).astype(np.uint64)
            one, other = wide_print(x[: shared + a], PRINT_WORDS), wide_print(np.concatenate([x[:shared], x[shared + a :]]), PRINT_WORDS)
            assert sum((p ^ q).bit_count() for p, q in zip(one, other, strict=True)) <= PRINT_RADIUS


def test_similar_pairs_agree_with_sets():
    rng = random.Random(10)
    sets = [set(rng.sample(range(6000), 3000)), {1, 2, 3, 4}, {1, 2, 3, 4, 5}, {2, 3, 4, 5}, set(), set()]
    sets += [{x for x in sets[0] if rng.random() < keep} for keep in (0.79, 0.8, 0.81, 0.95, 0.96)]
    flat = np.concatenate([np.array(sorted(x), np.int64) for x in sets])
    got = set(zip(*(x.tolist() for x in similar_pairs(flat, np.cumsum([len(x) for x in sets]))), strict=True))
    pairs = [(i, j) for j in range(len(sets)) for i in range(j)]
    assert got == {(i, j) for i, j in pairs if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}


def test_candidates_do_not_depend_on_the_size(docs, monkeypatch):
    """One rule at every size, and one that finds pairs down to a similarity of 0.8."""
    rng = random.Random(8)
    rows = []
    for i in range(60):  # 17 changed words in a row: 175 of 217 shingles are shared, 0.806
        words = [f"w{i}_{j}" for j in range(200)]
        at = 20 + rng.randrange(140)
        changed = [*words[:at], *(f"changed{i}_{j}" for j in range(17)), *words[at + 17 :]]
        rows += [(i, " ".join(words)), (100 + i, " ".join(changed))]
    for least in (1 << 22, 1):
        monkeypatch.setattr("sparkseek.llm.simhash.TWO_BANDS_FROM", least)
        got = {r["doc_id"]: r["group_id"] for r in near_duplicate_groups(docs(rows)).collect()}
        assert got == {i: i % 100 for i, _ in rows}


def test_one_of_each_group_stays(spark, docs, awkward):
    rows = spark.createDataFrame(
        [(1, "a b c d e f g", 7, "x"), (2, "A b c d e f g", 7, "y"), (3, "other words that stand alone", 7, "z"), (3, "other words that stand alone", 7, "z")],
        "doc_id long, text string, lost int, turn string",
    )
    kept = drop_near_duplicates(rows)
    assert kept.columns == rows.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    ids = [r["doc_id"] for r in drop_near_duplicates(docs(awkward)).collect()]
    assert ids.count(None) == 2 and 7 in ids and 9 in ids and 5 not in ids
    assert drop_near_duplicates(docs([])).count() == 0
    assert simhash_groups(docs([])).count() == 0


def test_rows_that_share_an_id_are_told_apart_by_text(docs):
    rows = [(1, "a b c d e f g"), (2, "other words that stand alone"), (2, "A b c d e f g"), (3, "one text"), (3, "another text"), (3, "one text")]
    assert sorted(r[:2] for r in drop_near_duplicates(docs(rows)).collect()) == [rows[0], rows[1], rows[4], rows[3]]
