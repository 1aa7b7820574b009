"""SimHash fingerprints and near-duplicate groups by bit-sliced comparison.

Fingerprints are computed in one Arrow pass over whole texts. Candidates meet
in buckets of equal bands; a bucket that grows beyond a tile is cut into tiles
that meet in pairs, so no task ever holds an unbounded group, and within a tile
``bitslice`` finds the links and returns a spanning forest, never all pairs.
The forests of all buckets go to ``components``.

Defined cases: a null text is an empty text; a text without words has
fingerprint zero and is linked like any other; fewer words than a shingle make
one shingle of the whole sequence; repeated rows get the same result each; a very long
text is read in slabs; an empty table gives an empty result; further columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitslice import Union, link_groups
from .common import arrow_map, checkpointed, free_name, word_slabs
from .components import components

SEED = 42
#: Rows of a bucket that are compared at once; a bucket of more is cut into tiles of this size.
TILE = 2048
#: From so many distinct fingerprints on, ``simhash_groups`` keys buckets by two bands instead of one; either is exact.
TWO_BANDS_FROM = 1 << 22
#: Rows that a Python worker gathers before it compares them.
_GATHER = 1 << 16


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits set."""
    total = np.zeros(64, np.int64)
    for s in range(0, len(hashes), 255 * 512):
        part = hashes[s : s + 255 * 512]
        rows = -(-len(part) // 255)
        padded = np.zeros(rows * 255, np.uint64)
        padded[: len(part)] = part
        bits = np.unpackbits(padded.view(np.uint8), bitorder="little").reshape(255, rows * 64)
        total += bits.sum(axis=0, dtype=np.uint8).reshape(rows, 64).sum(axis=0, dtype=np.int64)
    return total


def _pack(bits: np.ndarray) -> int:
    return int(np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: bytes, shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of the space-joined shingles, in slabs; ASCII letters lower-cased."""
    import xxhash

    digest, tail, any_full = xxhash.xxh64_intdigest, [], False
    for words in word_slabs(text.lower()):
        words = tail + words
        if len(words) >= shingle:
            joined = b" ".join(words)
            sizes = np.fromiter(map(len, words), np.int64, len(words))
            starts = np.cumsum(sizes + 1) - sizes - 1
            ends = (starts + sizes)[shingle - 1 :].tolist()
            cuts = [digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends)]  # noqa: B905
            yield np.array(cuts, np.uint64)
            any_full = True
        tail = words[len(words) - shingle + 1 :] if len(words) >= shingle else words
        if shingle == 1:
            tail = []
    if not any_full and tail:
        yield np.array([digest(b" ".join(tail), SEED)], np.uint64)


def simhash64(text: bytes, shingle: int = 3) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    total, n = np.zeros(64, np.int64), 0
    for hashes in shingle_hashes(text, shingle):
        total += _bit_counts(hashes)
        n += len(hashes)
    return _pack(2 * total > n)


_MIX = [np.uint64(x) for x in (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """Another 64 bits of each hash."""
    if k == 0:
        return hashes
    x = hashes ^ _MIX[k]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def wide_print(hashes: np.ndarray, words: int) -> list[int]:
    """The SimHash of ``64 * words`` bits of a set of shingles, 64 bits at a time."""
    return [_pack(2 * _bit_counts(_mixed(hashes, k)) > len(hashes)) for k in range(words)]


def _texts(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.large_binary()):
        yield (x.as_buffer().to_pybytes() if x.is_valid else b"")


def _text_print(text_col: str) -> Column:
    """A text's MD5; a null text is an empty one."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """``(doc_id, fp long)``: the 64-bit SimHash of each whole text."""

    def run(batches):
        for batch in batches:
            prints = np.array([simhash64(t, shingle) for t in _texts(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(narrow, run, "doc_id long, fp long")


def _linker(words: int, radius: int, confirm: int | None):
    """Spanning forests of the tiles of a sorted partition."""

    def flush(table: pa.Table):
        keys = [table.column(c).to_numpy() for c in ("k", "i", "j")]
        change = np.zeros(table.num_rows, bool)
        change[0] = True
        for x in keys:
            change[1:] |= x[1:] != x[:-1]
        sizes = np.diff(np.append(np.flatnonzero(change), table.num_rows))
        flat = table.column("fp").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        prints = flat.view(np.uint64).reshape(table.num_rows, -1)
        other = prints[:, words:] if confirm is not None else None
        label = link_groups(np.ascontiguousarray(prints[:, :words]), sizes, radius, other, confirm or 0)
        child = np.flatnonzero(label != np.arange(len(label)))
        node = table.column("node").combine_chunks()
        return pa.RecordBatch.from_arrays([node.take(pa.array(child)), node.take(pa.array(label[child]))], ["a", "b"])

    return _by_tile(flush, _GATHER)


def _by_tile(flush, gather: int):
    """``flush`` over whole tiles of a sorted partition, of so many rows at least, or the last ones."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < gather:
                continue
            table = pa.Table.from_batches(held)
            keys = [table.column(c).to_numpy() for c in ("k", "i", "j")]
            differ = np.zeros(table.num_rows, bool)
            for x in keys:
                differ |= x != x[-1]
            cut = int(np.flatnonzero(differ)[-1]) + 1 if differ.any() else 0
            if cut:
                yield flush(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
            rows = table.num_rows - cut
        if rows:
            yield flush(pa.Table.from_batches(held))

    return run


def _forest(nodes: DataFrame, keys: Column, words: int, radius: int, confirm: int | None = None, tile: int = TILE) -> DataFrame:
    """``nodes(node, fp array<long>)`` and their bucket keys to ``edges(a, b)``."""
    kind = nodes.schema["node"].dataType.simpleString()
    keyed = nodes.select("node", "fp", F.explode(keys).alias("k"))
    counts = keyed.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    placed = (
        keyed.join(counts, "k")
        .select("k", "node", "fp", tiles.alias("t"), F.pmod(F.xxhash64("node"), tiles).cast("int").alias("p"))
        .select("k", "node", "fp", "p", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("q"))
        .select("k", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "node", "fp")
    )
    dealt = placed.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    return arrow_map(dealt, _linker(words, radius, confirm), f"a {kind}, b {kind}")


def _narrow_keys(fp: Column, two: bool) -> Column:
    """Radius 3 leaves one of four 16-bit bands alike, and then one of the four 12-bit parts of the rest."""
    keys = []
    for b in range(4):
        band = F.shiftrightunsigned(fp, 16 * b).bitwiseAND(F.lit(0xFFFF))
        if not two:
            keys.append(band.bitwiseOR(F.lit(b << 48)))
            continue
        rest = F.shiftleft(F.shiftrightunsigned(fp, 16 * (b + 1)), 16 * b) if b < 3 else F.lit(0).cast("long")
        low = fp.bitwiseAND(F.lit((1 << (16 * b)) - 1))
        rest = rest.bitwiseOR(low)
        for s in range(4):
            part = F.shiftrightunsigned(rest, 12 * s).bitwiseAND(F.lit(0xFFF))
            keys.append(F.shiftleft(band, 12).bitwiseOR(part).bitwiseOR(F.lit((4 * b + s) << 48)))
    return F.array(*keys)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``docs``.

    Fingerprints link at ``radius`` (at most 3) or fewer differing bits;
    ``component_id`` is the smallest id that can be reached. The search is
    exact: bands are pigeonholes, and no bucket is capped.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius must be 0 to 3: four bands are pigeonholes for 3 bits at most")
    rows = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    prints = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    two = prints.count() >= TWO_BANDS_FROM
    nodes = prints.select(F.col("fp").alias("node"), F.array("fp").alias("fp"))
    edges = _forest(nodes, _narrow_keys(F.element_at("fp", 1), two), 1, radius)
    roots = components(edges)
    placed = prints.join(roots, prints.fp == roots.node, "left").select(
        "fp", "least_id", F.coalesce("root", "fp").alias("root")
    )
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = placed.join(least, "root").select("fp", "component_id")
    text = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(named, "fp").select("doc_id", text, "component_id")


#: Least Jaccard similarity of the shingles of a link, as a fraction.
SHARE = (4, 5)
#: MinHash bands and the minima in each: a pair at a Jaccard similarity of s shares none with
#: a probability of (1 - s ** BAND_ROWS) ** BANDS, at 0.8 that is 5.3e-6 and at 0.85 6.1e-9.
BANDS, BAND_ROWS = 40, 6
_DRAWS = np.random.default_rng(SEED).integers(1, 1 << 64, (3, BANDS * BAND_ROWS), np.uint64)
#: Shingles whose minima are taken at once.
_MINIMA = 512


def band_keys(hashes: Iterator[np.ndarray]) -> np.ndarray:
    """The keys of the MinHash bands of a set of shingles, given in slabs."""
    least = np.full(BANDS * BAND_ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    times, plus, weight = _DRAWS[0] | np.uint64(1), _DRAWS[1], _DRAWS[2] | np.uint64(1)
    for slab in hashes:
        for s in range(0, len(slab), _MINIMA):
            np.minimum(least, (slab[s : s + _MINIMA, None] * times + plus).min(axis=0), out=least)
    key = ((least ^ (least >> np.uint64(32))) * weight).reshape(BANDS, BAND_ROWS).sum(axis=1, dtype=np.uint64)
    return _mixed(key + np.arange(BANDS, dtype=np.uint64), 1)


#: The SimHash of a set of shingles has so many words of 64 bits, and links at so many differing bits or fewer.
#: Sets alike by 0.8 or more differ in a bit with a probability of 0.1875 at most (four shingles of
#: five) and exceed the radius with one of 1.0e-9 at most; two unrelated texts stay within it with one of 3.2e-7.
PRINT_WORDS, PRINT_RADIUS = 4, 88


def _candidates(nodes: DataFrame) -> DataFrame:
    """``nodes(node, keys)`` to ``(node, root)``: what bands join, directly or over others; lone nodes are left out."""
    keyed = nodes.select("node", F.explode("keys").alias("k"))
    least = keyed.groupBy("k").agg(F.min("node").alias("b"), F.max("node").alias("top")).where("b <> top").select("k", "b")
    # Written, so that the join below has a shuffle of its own on each side and a hot key's rows can be split.
    least = checkpointed(least)
    roots = components(keyed.join(least, "k").select(F.col("node").alias("a"), "b"))
    return checkpointed(roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct()))


#: Shingles of the texts of a tile, about.
_TILE_SHINGLES = 1 << 21
#: Rows with their shingles that a Python worker gathers before it compares them.
_GATHER_SETS = 1 << 12
#: Shingles of a tile that are multiplied at once.
_COLUMNS = 2048


def similar_pairs(sets: np.ndarray, ends: np.ndarray, share: tuple[int, int] = SHARE) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of sets whose Jaccard similarity is at least ``share``, exactly; a set ends where ``ends`` says."""
    n, sizes = len(ends), np.diff(ends, prepend=0)
    owner = np.repeat(np.arange(n), sizes)
    _, column, counts = np.unique(sets, return_inverse=True, return_counts=True)
    renamed = np.cumsum(counts > 1) - 1  # what only one set has is in no intersection
    shared = counts[column] > 1
    column, owner = renamed[column[shared]], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    common = np.zeros((n, n), np.int64)
    cuts = np.searchsorted(column, np.arange(0, int(column[-1]) + 1 + _COLUMNS, _COLUMNS)) if len(column) else []
    for k in range(len(cuts) - 1):
        s, e = cuts[k], cuts[k + 1]
        has = np.zeros((n, _COLUMNS), np.float32)
        has[owner[s:e], column[s:e] - k * _COLUMNS] = 1
        common += (has @ has.T).astype(np.int64)
    over, under = share
    a, b = np.nonzero(common * (over + under) >= over * (sizes[:, None] + sizes[None, :]))
    once = a < b
    return a[once], b[once]


def _set_linker(radius: int):
    """Spanning forests of the tiles: fingerprints within the radius on bit planes, then the similarity of the sets."""

    def flush(table: pa.Table) -> pa.RecordBatch:
        keys = [table.column(c).to_numpy() for c in ("k", "i", "j")]
        change = np.zeros(table.num_rows, bool)
        change[0] = True
        for x in keys:
            change[1:] |= x[1:] != x[:-1]
        sizes = np.diff(np.append(np.flatnonzero(change), table.num_rows))
        prints = table.column("fp").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        close = link_groups(prints.reshape(table.num_rows, -1), sizes, radius)
        order = np.argsort(close, kind="stable")
        order = order[np.bincount(close, minlength=table.num_rows)[close[order]] > 1]
        bounds = np.flatnonzero(np.diff(close[order], prepend=-1, append=-1)) if len(order) else np.zeros(1, np.int64)
        union = Union(table.num_rows)
        lists = table.column("shingles").combine_chunks()
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            rows = order[s:e]
            own = lists.take(pa.array(rows))
            ends = np.cumsum(own.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            a, b = similar_pairs(own.flatten().to_numpy(zero_copy_only=False), ends)
            union.add(rows[a], rows[b])
        child = np.flatnonzero(union.label != np.arange(table.num_rows))
        node = table.column("node").combine_chunks()
        return pa.RecordBatch.from_arrays([node.take(pa.array(child)), node.take(pa.array(union.label[child]))], ["a", "b"])

    return _by_tile(flush, _GATHER_SETS)


def _similar(met: DataFrame, radius: int = PRINT_RADIUS, tile: int = TILE, tile_shingles: int = _TILE_SHINGLES) -> DataFrame:
    """``met(node, root, n, fp, shingles)`` to ``edges(a, b)``: forests of the exact links among what has the same root."""
    kind = met.schema["node"].dataType.simpleString()
    sums = met.groupBy("root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("all"))
    tiles = F.ceil(F.greatest(F.col("rows") / F.lit(tile), F.col("all") / F.lit(tile_shingles), F.lit(1))).cast("int")
    placed = (
        met.join(sums, "root")
        .select(F.xxhash64("root").alias("k"), "node", "fp", "shingles", tiles.alias("t"), F.pmod(F.xxhash64("node"), tiles).cast("int").alias("p"))
        .select("k", "node", "fp", "shingles", "p", F.explode(F.sequence(F.lit(0), F.col("t") - 1)).alias("q"))
        .select("k", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"), "node", "fp", "shingles")
    )
    dealt = placed.repartition("k", "i", "j").sortWithinPartitions("k", "i", "j")
    return arrow_map(dealt, _set_linker(radius), f"a {kind}, b {kind}")


def near_duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = PRINT_RADIUS
) -> DataFrame:
    """``(doc_id, print, group_id, group_print)`` at a five-word-shingle similarity of 0.8 or more.

    A 64-bit fingerprint at radius 3 only finds copies far closer than that, so
    each set of shingles has a SimHash of 256 bits. No bands of it are pigeonholes at
    ``radius``: buckets are what MinHash bands join, by the same rule at every size.
    In these the fingerprints are compared on bit planes, in tiles, and the Jaccard
    similarity of the whole sets of shingles decides on every pair of what they link.
    ``group_id`` is the smallest id of the component of links. A row is named by its
    id and the ``print`` of its text, and so is the first of its group: ids may clash.
    Nothing is capped.
    """

    def hashes(text: bytes) -> np.ndarray:
        slabs = [np.unique(x) for x in shingle_hashes(text, shingle)]
        return np.unique(np.concatenate(slabs)) if slabs else np.zeros(0, np.uint64)

    def lists(rows: list, width: int) -> pa.Array:
        flat = np.array(rows, np.uint64).reshape(len(rows), width).view(np.int64)
        return pa.ListArray.from_arrays(np.arange(0, flat.size + 1, width, dtype=np.int32), flat.ravel())

    def run(batches):
        import xxhash

        for batch in batches:
            keys, names, sizes, prints = [], [], [], []
            for t in _texts(batch.column(2)):
                own = hashes(t)
                keys.append(band_keys([own]))
                names.append(xxhash.xxh3_128_digest(own.tobytes()))
                sizes.append(len(own))
                prints.append(wide_print(own, PRINT_WORDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.binary()), pa.array(sizes, pa.int64()), lists(keys, BANDS), lists(prints, PRINT_WORDS)],
                ["doc_id", "print", "node", "n", "keys", "fp"],
            )

    def sets(batches):
        for batch in batches:
            own = [hashes(t) for t in _texts(batch.column(4))]
            ends = np.cumsum([0, *map(len, own)]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *own]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.ListArray.from_arrays(ends, flat)], ["node", "root", "n", "fp", "shingles"]
            )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), _text_print(text_col).alias("print"), text.alias("text"))
    rows = checkpointed(arrow_map(narrow, run, "doc_id long, print binary, node binary, n long, keys array<long>, fp array<long>"))
    nodes = rows.groupBy("node").agg(
        F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "print")).alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("fp").alias("fp")
    )
    nodes = checkpointed(nodes)
    met = nodes.select("node", "least.print", "n", "fp").join(_candidates(nodes), "node")
    texts = narrow.groupBy("print").agg(F.first("text").alias("text"))
    met = met.join(texts, "print").select("node", "root", "n", "fp", "text")
    met = checkpointed(arrow_map(met, sets, "node binary, root binary, n long, fp array<long>, shingles array<long>"))
    roots = components(_similar(met, radius))
    placed = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    first = placed.groupBy("root").agg(F.min("least").alias("first"))
    named = placed.join(first, "root").select("node", F.col("first.doc_id").alias("group_id"), F.col("first.print").alias("group_print"))
    return rows.select("doc_id", "print", "node").join(named, "node").select("doc_id", "print", "group_id", "group_print")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each group the smallest id stays.

    Of rows that repeat an id and text one stays, and copies are dropped before they are
    shuffled; rows of one id with different texts are different documents. Rows whose id is
    null all stay. All columns are kept.
    """
    known = docs.where(F.col(id_col).isNotNull())
    groups = near_duplicate_groups(known, id_col, text_col)
    gone, text, own = (free_name(x, docs.columns) for x in ("lost", "lost_print", "own_print"))
    copies = groups.where("doc_id <> group_id or print <> group_print")
    lost = copies.select(F.col("doc_id").alias(gone), F.col("print").alias(text)).distinct()
    named = known.withColumn(own, _text_print(text_col))
    kept = named.join(lost, (F.col(id_col) == F.col(gone)) & (F.col(own) == F.col(text)), "left_anti")
    return kept.dropDuplicates([id_col, own]).drop(own).unionByName(docs.where(F.col(id_col).isNull()))
