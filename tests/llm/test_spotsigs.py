import hashlib
import random
import re
import zlib

from sparkseek.llm.spotsigs import ANCHORS, edited_fingerprints, fingerprint_text, jaccard, signatures, spotsigs_pairs


def brute(rows):
    line = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    out = []
    for k, (i, text) in enumerate(line):
        text, other = text or "", line[(k + 1) % len(line)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        a, b, c = signatures(text), signatures(edited), signatures(other)
        out.append((i or 0, len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint_text(a), fingerprint_text(b), round(jaccard(a, b), 9), round(jaccard(a, c), 9)))
    return sorted(out)


def prose(rng, n):
    anchors = sorted(ANCHORS)[:20]
    return " ".join(rng.choice(anchors) if rng.random() < 0.3 else f"w{rng.randrange(400)}" for _ in range(n))


def test_edited_texts_agree_with_brute_force(docs, awkward):
    rng = random.Random(3)
    rows = [(10 + 3 * i, prose(rng, rng.randint(0, 60))) for i in range(150)] + [r[:2] for r in awkward if r[0]]
    got = sorted((r[0] or 0, r[1], r[2], r[3], r[4], round(r[5], 9), round(r[6], 9)) for r in edited_fingerprints(docs(rows)).collect())
    assert got == brute(rows)


def test_null_ids_and_empty_tables(docs, awkward):
    assert edited_fingerprints(docs(awkward)).count() == len(awkward)
    assert edited_fingerprints(docs([])).count() == 0
    only = edited_fingerprints(docs([(5, "the only one of them")])).collect()
    assert len(only) == 1 and only[0]["near_next"] == 1.0


def test_chains_follow_anchors():
    assert len(signatures("the quick brown fox")) == 1  # one anchor, two content words
    assert len(signatures("the quick of brown fox")) == 2
    assert set(signatures("The quick brown")) == set(signatures("the, quick - brown"))
    assert len(signatures("")) == 0 and len(signatures("!?")) == 1


def test_pairs_agree_with_brute_force(docs):
    rng = random.Random(8)
    rows = [(i, prose(rng, 80)) for i in range(40)]
    for i in range(40):
        words = rows[i][1].split()
        for _ in range(i % 4):
            words[rng.randrange(len(words))] = "new"
        rows.append((100 + i, " ".join(words)))
    rows += [(500, None), (501, "")]
    pairs, classes = spotsigs_pairs(docs(rows))
    named = {r["doc_id"]: r["class_id"] for r in classes.collect()}
    sets = {i: signatures(t or "") for i, t in rows}
    assert all(named[i] == min(j for j in sets if sets[j].tobytes() == sets[i].tobytes()) for i in sets)
    reps = sorted(set(named.values()))
    want = {(a, b): round(jaccard(sets[a], sets[b]), 9) for a in reps for b in reps if a < b and len(sets[a]) and len(sets[b]) and jaccard(sets[a], sets[b]) >= 0.8}
    assert {(r["a"], r["b"]): round(r["similarity"], 9) for r in pairs.collect()} == want and want


def plain_chains(text):
    """Every anchor with the next two words that are none, by looking ahead from each place; without any, see the module."""
    found = re.findall(r"\w+", text.lower())
    out = set()
    for k, w in enumerate(found):
        after = [x for x in found[k + 1 :] if x not in ANCHORS][:2]
        if w in ANCHORS and len(after) == 2:
            out.add((w, *after))
    return out


def test_fingerprints_agree_with_a_brute_force_of_their_own(docs):
    rng = random.Random(13)
    rows = [(i, prose(rng, rng.randint(20, 90))) for i in range(60)]
    texts = dict(rows)
    for r in edited_fingerprints(docs(rows)).collect():
        text, other = texts[r["doc_id"]], texts[(r["doc_id"] - 1) % 60]
        edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        a, b, c = map(plain_chains, (text, edited, other))
        assert a and b and c
        for chains, shown in ((a, r["fingerprint"]), (b, r["edited_fingerprint"])):
            assert shown == "".join(sorted({f"{zlib.crc32(' '.join(x).encode()):08x}" for x in chains}))
        assert abs(r["near_edited"] - len(a & b) / len(a | b)) < 1e-9 and abs(r["near_next"] - len(a & c) / len(a | c)) < 1e-9
