"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its evidence is what it looks like and what the lines
before and after it look like; the chain adds how labels follow one another.
The marginal that a line is good comes from a forward and a backward pass, and a
document's quality is the mean of its lines' marginals, weighted by length.

Training uses at most ``SAMPLE`` labelled documents of each class, those of the
smallest hashes, and of these the first by hash that have ``LINES`` lines together (the
last one whole). All their lines are learnt from, in chains of ``SEGMENT`` lines. A document's
label is that of all its lines. Scoring reads every line of every text; a long chain is
walked in blocks side by side that pass their messages on, so its marginals are exact.

Defined cases: a null or empty text is one empty line; without labels of both
classes, or in an empty table, every score is 1; a document that is labelled twice has its
highest label; repeated rows are scored alike; a very long text is one of a group of its
own, in memory a few numbers for each line; other columns are kept and not read.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, checkpointed, hash_sample

SAMPLE, LINES, SEGMENT, BLOCK = 1500, 100_000, 64, 1024
EPOCHS, RATE, DECAY = 80, 0.1, 1e-3
THRESHOLD = 0.3

_KIND = np.zeros(256, np.uint8)  # 0: other ASCII
for _c in range(256):
    _x = chr(_c)
    _KIND[_c] = (
        1 if "a" <= _x <= "z" else 2 if "A" <= _x <= "Z" else 3 if "0" <= _x <= "9" else 4 if _x in " \t\r\v\f" else 5 if _x in ".,;:'\"?()-"
        else 6 if _x == "!" else 7 if _x == "|" else 8 if _c >= 128 else 0
    )
_KINDS, FEATURES = 9, 15


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of the texts, the lines' lengths, and the lines in each text."""
    parts = [t.split(b"\n") for t in texts]
    lines = [line for part in parts for line in part]
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    kinds = _KIND[np.frombuffer(b"".join(lines), np.uint8)]
    at = np.repeat(np.arange(len(lines)), length)
    counts = np.bincount(at * _KINDS + kinds, minlength=len(lines) * _KINDS).reshape(-1, _KINDS)
    out = np.zeros((len(lines), FEATURES))
    safe = np.maximum(length, 1)
    out[:, :_KINDS] = counts / safe[:, None]
    letters = np.maximum(counts[:, 1] + counts[:, 2] + counts[:, 8] / 2, 1)
    out[:, 9] = counts[:, 2] / letters
    for i, line in enumerate(lines):
        words = line.split()
        n = len(words)
        if n:
            out[i, 10] = min(length[i] / n, 40) / 10
            out[i, 11] = sum(map(eq, words, words[1:])) / n
            out[i, 12] = 1 - len(set(words)) / n if n > 8 else 0
            out[i, 13] = line.rstrip()[-1:] in b".?!\""
    out[:, 14] = np.log1p(length) / 5
    return out, length, np.array([len(p) for p in parts])


def with_neighbours(base: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each line's features, those of the lines before and after it, whether there are any, and 1."""
    begins = np.cumsum(sizes) - sizes
    first = np.zeros(len(base), bool)
    last = np.zeros(len(base), bool)
    first[begins[sizes > 0]] = True
    last[(begins + sizes - 1)[sizes > 0]] = True
    before = np.zeros_like(base)
    after = np.zeros_like(base)
    before[1:] = base[:-1]
    after[:-1] = base[1:]
    before[first] = 0
    after[last] = 0
    return np.concatenate([base, before, after, first[:, None], last[:, None], np.ones((len(base), 1))], axis=1)


def _log_add(a, b):
    return np.logaddexp(a, b)


class Chain:
    """Weights of a two-state chain: evidence for good, and the four transitions."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, mean: np.ndarray, scale: np.ndarray):
        self.weights, self.moves, self.mean, self.scale = weights, moves, mean, scale

    def evidence(self, base: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return with_neighbours((base - self.mean) / self.scale, sizes) @ self.weights

    def marginals(self, evidence: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return block_marginals(evidence, sizes, self.moves)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        base, length, sizes = line_features(texts)
        evidence = self.evidence(base, sizes)
        good = self.marginals(evidence, sizes)
        doc = np.repeat(np.arange(len(texts)), sizes)
        weight = np.maximum(length, 1e-9)
        return np.clip(np.bincount(doc, good * weight, minlength=len(texts)) / np.bincount(doc, weight, minlength=len(texts)), 0, 1)


def _longest_first(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    begins = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    return order, begins[order], sizes[order]


def block_marginals(evidence: np.ndarray, sizes: np.ndarray, moves: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Marginals of state 1, exact for chains of any length.

    Chains are cut into blocks that are walked side by side: once from either state of the
    first item to get what a block does to a message, then, with the messages that
    come in at both ends, for the marginals.
    """
    sizes = np.asarray(sizes)
    if not len(sizes) or sizes.max() <= block:
        return forward_backward(evidence, sizes, moves)[0]
    parts = -(-np.maximum(sizes, 1) // block)
    chain = np.repeat(np.arange(len(sizes)), parts)
    within = np.arange(len(chain)) - np.repeat(np.cumsum(parts) - parts, parts)
    length = np.minimum(block, sizes[chain] - within * block)
    begins = np.cumsum(length) - length
    order, starts, longest = _longest_first(length)
    through = np.zeros((len(chain), 2, 2))  # log sum over ways from the first item's state to the last one's
    walk = np.array([[[0.0, -np.inf], [-np.inf, 0.0]]]).repeat(len(chain), axis=0)
    active = np.searchsorted(-longest, -np.arange(int(longest[0])), "left")
    for t in range(1, int(longest[0])):
        own = walk[: active[t]]
        e = evidence[starts[: active[t]] + t]
        to0 = _log_add(own[:, :, 0] + moves[0, 0], own[:, :, 1] + moves[1, 0])
        to1 = _log_add(own[:, :, 0] + moves[0, 1], own[:, :, 1] + moves[1, 1]) + e[:, None]
        own[:, :, 0], own[:, :, 1] = to0, to1
    through[order] = walk
    first = np.zeros((len(chain), 2))
    first[length > 0, 1] = evidence[begins[length > 0]]
    enter, leave = np.zeros((len(chain), 2)), np.zeros((len(chain), 2))
    for k in range(1, len(chain)):
        if within[k]:
            last = _log_add(*(enter[k - 1] + first[k - 1])[:, None] + through[k - 1])
            enter[k] = _log_add(*last[:, None] + moves)
            enter[k] -= enter[k].max()
    for k in range(len(chain) - 2, -1, -1):
        if within[k + 1]:
            begin = _log_add(*(through[k + 1] + leave[k + 1]).T) + first[k + 1]
            leave[k] = _log_add(*(moves + begin).T)
            leave[k] -= leave[k].max()
    return forward_backward(evidence, length, moves, enter, leave)[0]


def forward_backward(
    evidence: np.ndarray, sizes: np.ndarray, moves: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 for each item, and expected transition counts; chains side by side, longest first.

    ``enter`` and ``leave`` are log messages to each chain's first and last item.
    """
    order, begins, sizes = _longest_first(np.asarray(sizes))
    n = len(evidence)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    if leave is not None:
        some = sizes > 0
        beta[(begins + sizes - 1)[some]] = leave[order][some]
    steps = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(steps), "left")  # chains longer than t
    for t in range(steps):
        at = begins[: active[t]] + t
        if t:
            p = alpha[at - 1]
            a0 = _log_add(p[:, 0] + moves[0, 0], p[:, 1] + moves[1, 0])
            a1 = _log_add(p[:, 0] + moves[0, 1], p[:, 1] + moves[1, 1])
        else:
            a0, a1 = (np.zeros((len(at), 2)) if enter is None else enter[order[: active[t]]]).T
        alpha[at, 0], alpha[at, 1] = a0, a1 + evidence[at]
    for t in range(steps - 2, -1, -1):
        at = begins[: active[t + 1]] + t
        q = beta[at + 1].copy()
        q[:, 1] += evidence[at + 1]
        beta[at, 0] = _log_add(moves[0, 0] + q[:, 0], moves[0, 1] + q[:, 1])
        beta[at, 1] = _log_add(moves[1, 0] + q[:, 0], moves[1, 1] + q[:, 1])
    both = alpha + beta
    total = _log_add(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    expected = np.zeros((2, 2))
    first = np.ones(n, bool)
    first[begins[sizes > 0]] = False
    later = np.flatnonzero(first)  # all items but the first of each chain
    if len(later):
        for a in (0, 1):
            for b in (0, 1):
                e = alpha[later - 1, a] + moves[a, b] + (evidence[later] if b else 0) + beta[later, b] - total[later]
                expected[a, b] = np.exp(e).sum()
    return good, expected


def fit_chain(base: np.ndarray, sizes: np.ndarray, label: np.ndarray, epochs: int = EPOCHS) -> Chain:
    """Maximise the likelihood of chains whose items all have the chain's label; classes weigh alike."""
    mean, scale = base.mean(axis=0), base.std(axis=0) + 1e-6
    x = with_neighbours((base - mean) / scale, sizes)
    y = np.repeat(label.astype(float), sizes)
    weights, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
    seen = np.zeros((2, 2))
    for c in (0, 1):
        seen[c, c] = (sizes[label == c] - 1).sum()
    n = len(y)
    share = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    m, v = np.zeros(len(weights) + 4), np.zeros(len(weights) + 4)
    for t in range(1, epochs + 1):
        good, expected = forward_backward(x @ weights, sizes, moves)
        gradient = np.concatenate([x.T @ ((good - y) * share) / n + DECAY * weights, ((expected - seen) / n + DECAY * moves).ravel()])
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        step = RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        weights = weights - step[:-4]
        moves = moves - step[-4:].reshape(2, 2)
    return Chain(weights, moves, mean, scale)


def _bytes(column: pa.Array) -> list[bytes]:
    return [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in column.cast(pa.large_binary())]


def _segments(text: bytes) -> list[bytes]:
    """All of a text's lines, ``SEGMENT`` at a time."""
    lines = text.split(b"\n")
    return [b"\n".join(lines[k : k + SEGMENT]) for k in range(0, len(lines), SEGMENT)]


def _within(sizes: list[tuple[int, int, int, int]], most: int) -> set[int]:
    """Ids of each class' first documents by place that have ``most`` lines together."""
    out: set[int] = set()
    used: dict[int, int] = {}
    for y, _, i, lines in sorted(sizes):
        if used.get(y, 0) < most:
            out.add(i)
        used[y] = used.get(y, 0) + lines
    return out


def learn_quality(
    docs: DataFrame, labels: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE,
    lines: int = LINES,
) -> Chain | None:
    """Learn from the labels on whose id ``learns`` holds; None without both classes."""
    told = labels.where(learns).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y")).where("id is not null and y is not null")
    chosen = hash_sample(told.where("y = 1"), "id", sample).unionByName(hash_sample(told.where("y = 0"), "id", sample))
    # At most two times SAMPLE rows of two numbers: a broadcast of bounded size.
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")
    texts = checkpointed(texts)
    count = F.coalesce(F.regexp_count("text", F.lit("\n")), F.lit(0)) + 1
    sized = texts.select("y", F.xxhash64("id").alias("place"), "id", count.alias("lines")).collect()
    whole = _within([tuple(r) for r in sized], lines)

    def run(batches):
        for batch in batches:
            for text, i, y in zip(_bytes(batch.column(1)), batch.column(0), batch.column(2), strict=True):
                if i.as_py() not in whole:
                    continue
                parts = _segments(text)
                base, _, sizes = line_features(parts)
                ends = np.cumsum(sizes)
                rows = [base[e - n : e].ravel() for e, n in zip(ends, sizes, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i.as_py()] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array([y.as_py()] * len(parts), pa.int32()), pa.array(rows, pa.list_(pa.float64()))],
                    ["id", "part", "y", "x"],
                )

    table = arrow_map(texts.select("id", "text", "y"), run, "id long, part int, y int, x array<double>").toArrow()
    table = table.sort_by([("id", "ascending"), ("part", "ascending")]).combine_chunks()
    y = table.column("y").to_numpy()
    if not (y == 1).any() or not (y == 0).any():
        return None
    lists = table.column("x").chunk(0)
    sizes = lists.value_lengths().to_numpy() // FEATURES
    return fit_chain(lists.flatten().to_numpy().reshape(-1, FEATURES), sizes, y)


def score_quality(docs: DataFrame, model: Chain | None, text_col: str = "text", score_col: str = "quality_score") -> DataFrame:
    """All columns of ``docs`` and a double ``score_col``; the text passes Python once."""
    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{score_col}` double"
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            texts, scores = _bytes(batch.column(at)), []
            group, size = [], 0
            for t in [*texts, None]:
                if t is None or size + len(t) > 1 << 23:
                    if group:
                        scores.append(model.scores(group) if model else np.ones(len(group)))
                    group, size = [], 0
                if t is not None:
                    group.append(t)
                    size += len(t)
            score = np.concatenate(scores) if scores else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*batch.schema.names, score_col])

    return arrow_map(docs, run, schema)
