"""Near-duplicates by SimHash: fingerprints, compared exactly, tile against tile.

Distinct fingerprints are dealt to blocks, and within a block, by a hash, to tiles of bounded size, which are written to the
shared folder and memory-mapped by the tasks that compare them. Two fingerprints within `radius` bits have population counts,
also of their halves or quarters, that differ by `radius` at most, so tile pairs of blocks farther apart are skipped and
nothing is lost. A tile pair is compared whole with numpy's exclusive-or and bit counts; of its links only a spanning forest
leaves the task, so a group of thousands of near copies never becomes pairs.

`classes` links fingerprints by a radius alone. `keep_one`, for the pipeline, asks for a similarity of shingle sets and uses no
fingerprint: two sets of a Jaccard similarity of s share one of the first n - ceil(s n) + 1 of their n shingles in any order
common to all sets. The sets are written to the shared folder, those first shingles are shuffled in packed blocks, and sets that
meet in one are compared whole, so no pair is missed and none is linked below s. Shingles that a sample of the sets shows to be
common come last in the order; that saves comparisons and decides nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, components, drop_folder, field, forest, give_back, map_array, new_folder, packed, slices, texts, write_bytes
from .lm import _dealt, _gather, _split, merge, unpack

#: Fingerprints in a tile at most, on average.
TILE = 8192
#: Distinct fingerprints from which blocks are made by quarters instead of halves.
FINE_FROM = 1_000_000
#: Hashes in a file of shingle sets, hashes or entries that a task holds before it passes them on, and entries in a bucket.
FILE_HASHES, HELD, BUCKET = 1_000_000, 500_000, 250_000
#: One in so many sets is sampled for common shingles if there are many; those in so many sets, at an estimate, are common; so many are kept.
SAMPLE, COMMON, MOST_COMMON = 8, 32, 500_000


def _shingles(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of `width` words, A-Z in lower case; of all words where there are fewer; none without words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: max(1, len(words) - width + 1)]
    ends = ends[min(width, len(words)) - 1 :]
    parts = map(joined.__getitem__, map(slice, starts.tolist(), ends.tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(starts))


def _majority(hashes: np.ndarray) -> np.uint64:
    """A bit is set if over half the hashes have it."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65536):
        total += np.unpackbits(hashes[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), bitorder="little").view(np.uint64)[0]


def fingerprint(text: bytes, width: int = 4) -> int:
    """The SimHash of a text given as UTF-8: words are lower-cased A-Z; shingles of `width` words, repeats included;
    a shorter text is one shingle, a text without words gives zero; a bit is set if over half the hashes have it."""
    return int(_majority(_shingles(text, width)))


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(k, fp) of each document; fp as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, raw in slices(b):
                fp = np.fromiter((fingerprint(x, width) for x in raw), np.uint64, len(raw)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=["k", "fp"])

    return docs.mapInArrow(run, "k long, fp long")


def _fingerprinted(docs: DataFrame, width: int) -> DataFrame:
    """(k, h, fp) of each document: id, hash of the text, fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, raw in slices(b):
                fp = np.fromiter((fingerprint(x, width) for x in raw), np.uint64, len(raw)).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(fp)], names=["k", "h", "fp"])

    return docs.select("k", "t", F.xxhash64("t").alias("h")).mapInArrow(run, "k long, h long, fp long")


def _part_counts(parts: int) -> list:
    bits = 64 // parts
    mask = (1 << bits) - 1
    return [F.bit_count(F.shiftrightunsigned("fp", i * bits).bitwiseAND(F.lit(mask if bits < 64 else -1))) for i in range(parts)]


def _compare(where: str, radius: int):
    """Links of tile pairs (x, y, same)."""

    def tile(name: str) -> np.ndarray:
        return map_array(where, name, "<u8").reshape(-1, 2)  # v, fp

    def links(x: np.ndarray, y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        u, v = np.ascontiguousarray(x[:, 1]), np.ascontiguousarray(y[:, 1])
        step = max(1, (1 << 18) // max(1, len(y)))
        for i in range(0, len(x), step):
            p, q = np.nonzero(np.bitwise_count(u[i : i + step, None] ^ v[None, :]) <= radius)
            p += i
            if same:
                p, q = p[p < q], q[p < q]
            for j in range(0, len(p), 1 << 15):  # a dense group gives many at once
                s, t = p[j : j + (1 << 15)], q[j : j + (1 << 15)]
                a, b = forest(np.concatenate([a, x[s, 0].view(np.int64)]), np.concatenate([b, y[t, 0].view(np.int64)]))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for x, y, same in zip(*(t.column(i).to_pylist() for i in range(3)), strict=True):
                a, b = links(tile(x), tile(y), same)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def near_links(nodes: DataFrame, where: str, parts: int, radius: int, tile: int = TILE) -> DataFrame:
    """Links (a, b) that connect the vertices v of `nodes` (v, fp) wherever two fingerprints differ in `radius` bits at most.

    A block has the fingerprints with the same population counts of their `parts` parts, and is dealt into tiles. Two blocks can
    hold such a pair only if their counts differ by `radius` in all; these pairs, and those of their tiles, come from a join on
    the counts, so nothing about blocks is handled by the driver. Tiles are written to the folder `where`, which must last until
    the links are used.
    """
    spark = nodes.sparkSession
    names = [f"p{i}" for i in range(parts)]
    named = nodes.select("v", "fp", *[c.cast("int").alias(n) for c, n in zip(_part_counts(parts), names, strict=True)])
    # one row per block: at most (64 / parts + 1) ^ parts of them, whatever the input
    blocks = named.groupBy(*names).agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")).withColumn("c", sum(F.col(n) * 65**i for i, n in enumerate(names)))
    blocks = checkpoint(blocks)
    total = blocks.agg(F.sum("tiles")).first()[0]
    if not total:
        return spark.createDataFrame([], "a long, b long")
    tiled = named.join(F.broadcast(blocks), names).groupBy("c", F.pmod(F.xxhash64("v"), F.col("tiles")).cast("int").alias("i")).agg(F.collect_list(F.struct("v", "fp")).alias("x"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for t in batches:
            for c, i, x in zip(*(t.column(j) for j in range(3)), strict=True):
                s = x.values
                write_bytes(where, f"{c}-{i}", [np.column_stack([s.field("v").to_numpy().view(np.uint64), s.field("fp").to_numpy().view(np.uint64)]).astype("<u8").tobytes()])
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    tiled.mapInArrow(put, "n long").agg(F.sum("n")).collect()
    # each block with all counts within the radius: part by part, with what is left of it
    moved = blocks.withColumn("left", F.lit(radius))
    for n in names:
        moved = moved.withColumn("d", F.explode(F.sequence(-F.col("left"), F.col("left")))).withColumn("left", F.col("left") - F.abs("d")).withColumn(n, F.col(n) + F.col("d"))
    moved = moved.select("c", F.col("tiles").alias("x"), *names)
    todo = moved.join(blocks.withColumnsRenamed({"c": "e", "tiles": "y"}), names).where("c <= e").select("c", "x", "e", "y")
    todo = todo.select("c", "e", "y", F.explode(F.sequence(F.lit(0), F.col("x") - 1)).alias("i")).select("c", "e", "i", F.explode(F.sequence(F.lit(0), F.col("y") - 1)).alias("j"))
    todo = todo.where("c <> e or i <= j").withColumn("same", (F.col("c") == F.col("e")) & (F.col("i") == F.col("j")))
    todo = todo.select(F.concat_ws("-", "c", "i").alias("x"), F.concat_ws("-", "e", "j").alias("y"), "same")
    todo = todo.repartition(max(24, 4 * spark.sparkContext.defaultParallelism, total // 8), F.xxhash64("x", "y"))
    return todo.mapInArrow(_compare(where, radius), "a long, b long")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: `doc_id`, `fingerprint` (16 hex digits), `component_id`: the smallest id reachable over links
    of at most `radius` differing bits, `component_rows`: rows of the component.

    A text without words has the fingerprint zero and links like any other. A null id is never the smallest while
    another id is in the component, and repeated rows each get a row. Extra columns are ignored.
    """
    fp = checkpoint(fingerprints(texts(docs, id_col, text_col), width))
    own = checkpoint(fp.groupBy("fp").agg(F.min("k").alias("low"), F.count("*").alias("n")))
    parts = 4 if own.count() >= FINE_FROM else 2
    where = new_folder(docs.sparkSession, "tiles")
    roots = components(near_links(own.select(F.col("fp").alias("v"), "fp"), where, parts, radius))
    drop_folder(where)
    joined = own.join(roots, own.fp == roots.v, "left").select("fp", "low", "n", F.coalesce("root", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("n").alias("component_rows"))
    by_fp = joined.join(least, "root").select("fp", "component_id", "component_rows")
    return _hot_join(fp, by_fp).select(F.col("k").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_rows")


def _hot_join(many: DataFrame, one: DataFrame, salts: int = 16) -> DataFrame:
    """many-to-one on `fp`; a fingerprint that a third of all rows share is spread over `salts` tasks."""
    one = one.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.withColumn("s", F.pmod(F.xxhash64("k"), F.lit(salts)).cast("int")).join(one, ["fp", "s"])


# --------------------------------------------------------------------------- similarity of shingle sets
def _store_sets(docs: DataFrame, where: str, width: int) -> DataFrame:
    """(k, h, v, n, f, o) of each document: id, hash of the text, hash of the set of shingles, its size, and where it is written:
    in file f, from place o on, the size and the sorted hashes. A file is named by its content, so a repeated task does no harm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, ids, size = [], ([], []), 0

        def out() -> pa.RecordBatch:
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            data = np.concatenate([y for x in sets for y in (np.array([len(x)], np.uint64), x)]).astype("<u8").tobytes()
            name = xxhash.xxh64_intdigest(data)
            write_bytes(where, f"{name:016x}", [data])
            v = np.fromiter((xxhash.xxh64_intdigest(x.tobytes()) for x in sets), np.uint64, len(sets)).view(np.int64)
            f = np.full(len(sets), name, np.uint64).view(np.int64)
            cols = [pa.array(x, pa.int64()) for x in (*ids, v, n, f, np.cumsum(n + 1) - n - 1)]
            return pa.RecordBatch.from_arrays(cols, names=["k", "h", "v", "n", "f", "o"])

        for b in batches:
            for part, raw in slices(b):
                got = [np.unique(_shingles(x, width)) for x in raw]
                sets += got
                ids[0].extend(part.column(0).to_pylist())
                ids[1].extend(part.column(2).to_pylist())
                size += sum(map(len, got))
                if size > FILE_HASHES:
                    yield out()
                    sets, ids, size = [], ([], []), 0
        if sets:
            yield out()

    return docs.select("k", "t", F.xxhash64("t").alias("h")).mapInArrow(run, "k long, h long, v long, n long, f long, o long")


def _read_sets(where: str, files: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(file number, place, set) of batches of (file number, places)."""
    for b in batches:
        for i, places in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x = np.asarray(map_array(where, files[i], "<u8"))
            for o in places:
                yield i, o, x[o + 1 : o + 1 + int(x[o])]


def _common_shingles(places: DataFrame, where: str, files: list[str], parts: int, least: int) -> None:
    """Write the shingles that at least `least` of the sets have, MOST_COMMON at most, and their counts."""
    bits = (parts - 1).bit_length()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for _, _, x in _read_sets(where, files, batches):
            held.append(x)
            n += len(x)
            if n > HELD:
                keys, c = np.unique(np.concatenate(held), return_counts=True)
                yield _split(keys, 64 - bits, c)
                held, n = [], 0
                give_back()
        if held:
            keys, c = np.unique(np.concatenate(held), return_counts=True)
            yield _split(keys, 64 - bits, c)

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in _gather(batches):
            keys, c = merge(blocks)
            keys, c = keys[c >= least], c[c >= least]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(c)], names=["h", "c"])

    got = _dealt(places.mapInArrow(count, "b int, data binary"), parts).mapInArrow(often, "h long, c long").orderBy(F.desc("c"), "h").limit(MOST_COMMON).toArrow()
    h, c = (got.column(i).to_numpy() for i in range(2))
    h = h.astype(np.int64).view(np.uint64)
    order = np.argsort(h)
    write_bytes(where, "common.h", [h[order].astype("<u8").tobytes()])
    write_bytes(where, "common.c", [c[order].astype("<u4").tobytes()])


def prefix(x: np.ndarray, similarity: float, common: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 of a set of n sorted hashes, common ones last; two sets so similar share one of them."""
    n = len(x)
    p = n - math.ceil(similarity * n - 1e-9) + 1
    if not len(common):
        return x[:p]
    at = np.minimum(np.searchsorted(common, x), len(common) - 1)
    known = common[at] == x
    rare = x[~known]
    if len(rare) >= p:
        return rare[:p]
    last = np.flatnonzero(known)
    return np.concatenate([rare, x[last[np.argsort(count[at[last]], kind="stable")[: p - len(rare)]]]])


def similar_pairs(sets: list[np.ndarray], labels: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Pairs that connect the sets wherever two are as similar as that, and `labels` (of sets connected before) differ."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    order = np.argsort(n, kind="stable")
    labels, out = labels.copy(), []
    for at, a in enumerate(order[:-1].tolist()):
        x, rest = sets[a], order[at + 1 :]
        rest = rest[(labels[rest] != labels[a]) & (similarity * n[rest] <= n[a] + 1e-9)]
        found = []
        for b in rest.tolist():
            y = sets[b]
            both = int(np.count_nonzero(x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y))
            if both >= similarity * (len(x) + len(y) - both) - 1e-9:
                found.append(b)
        if found:
            out += [(a, b) for b in found]
            labels[np.isin(labels, labels[found])] = labels[a]
            if (labels == labels[0]).all():
                break
    return out


def set_links(own: DataFrame, where: str, files: list[str], similarity: float) -> DataFrame:
    """Links (a, b) that connect the sets `own` (i, o, n) wherever the Jaccard similarity of two is at least `similarity`. A vertex
    is the number of the file times 2^32 plus the place."""
    sets = own.where("n > 0")
    place = lambda d: d.groupBy("i").agg(F.collect_list("o").alias("o"))
    n, hashes = sets.agg(F.count("*"), F.sum("n")).first()
    if not n:
        return own.sparkSession.createDataFrame([], "a long, b long")
    parts = 1 << max(3, int(hashes * (1 - similarity) // BUCKET).bit_length())
    one_in = SAMPLE if n > 1000 * SAMPLE else 1
    _common_shingles(place(sets.where(F.pmod(F.xxhash64("i", "o"), F.lit(one_in)) == 0)), where, files, parts, max(3, COMMON // one_in))
    shift = 64 - (parts - 1).bit_length()

    def block(keys: list[np.ndarray], at: list[tuple[int, int]]) -> pa.RecordBatch:
        lens, at = np.fromiter(map(len, keys), np.int64, len(keys)), np.array(at, np.int64).reshape(-1, 2)
        x = np.concatenate(keys)
        order = np.argsort(x, kind="stable")
        return _split(x[order], shift, np.repeat(at[:, 0], lens)[order], np.repeat(at[:, 1], lens)[order])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, count = (np.asarray(map_array(where, f"common.{c}", t)) for c, t in (("h", "<u8"), ("c", "<u4")))
        keys, at, size = [], [], 0
        for i, o, x in _read_sets(where, files, batches):
            keys.append(prefix(x, similarity, common, count))
            at.append((i, o))
            size += len(keys[-1])
            if size > HELD:
                yield block(keys, at)
                keys, at, size = [], [], 0
        if keys:
            yield block(keys, at)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps: dict[int, np.ndarray] = {}
        now, blocks = None, []

        def read(d: int) -> np.ndarray:
            i, o = d >> 32, d & 0xFFFFFFFF
            if i not in maps:
                maps[i] = np.asarray(map_array(where, files[i], "<u8"))
            return maps[i][o + 1 : o + 1 + int(maps[i][o])]

        def links() -> pa.RecordBatch:
            keys, d = np.concatenate([b[0] for b in blocks]), np.concatenate([(b[1] << 32) | b[2] for b in blocks])
            order = np.lexsort((d, keys))
            keys, d = keys[order], d[order]
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
            many = np.diff(cuts) > 1
            up: dict[int, int] = {}
            seen: set[bytes] = set()
            pairs: list[tuple[int, int]] = []

            def find(x: int) -> int:
                while (y := up.get(x, x)) != x:
                    up[x] = x = up.get(y, y)
                return x

            for a, z in zip(cuts[:-1][many].tolist(), cuts[1:][many].tolist(), strict=True):
                name = d[a:z].tobytes()
                if name in seen:
                    continue
                seen.add(name)
                own = d[a:z].tolist()
                labels = np.array([find(x) for x in own])
                if (labels == labels[0]).all():
                    continue
                for s, t in similar_pairs([read(x) for x in own], labels, similarity):
                    pairs.append((own[s], own[t]))
                    up[find(own[s])] = find(own[t])
            got = np.array(pairs, np.int64).reshape(-1, 2)
            return pa.RecordBatch.from_arrays([pa.array(got[:, 0]), pa.array(got[:, 1])], names=["a", "b"])

        for t in batches:
            for b, data in zip(t.column(0).to_pylist(), t.column(1), strict=True):
                if b != now and blocks:
                    yield links()
                    blocks = []
                    give_back()
                now = b
                blocks.append(unpack(data.as_py()))
        if blocks:
            yield links()

    return _dealt(place(sets).mapInArrow(prefixes, "b int, data binary"), parts).mapInArrow(verify, "a long, b long")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents, one of each group of near-duplicates: the row with the smallest id of its component.

    Near-duplicates are texts whose sets of shingles have a Jaccard similarity of at least `similarity`, and texts that are so
    only over others; all texts without words are one group. A null id is never the smallest while another id is in the
    component. Of the rows of a component with its smallest id (or none) that with the smallest hash of the text stays, and of
    those with equal texts the first by a hash of the whole row; components that share an id, or have none, each keep a row.
    """
    where = new_folder(docs.sparkSession, "sets")
    fp = checkpoint(_store_sets(texts(docs), where, width))
    names = sorted(r["f"] for r in fp.select("f").distinct().collect())  # one per file of sets
    files = [f"{f % 2**64:016x}" for f in names]
    number = docs.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), "f long, i long")
    own = fp.groupBy("v", "n").agg(F.min(F.struct("f", "o")).alias("at"), F.min(F.struct(F.col("k").isNull().alias("none"), "k", "h")).alias("low"))
    own = checkpoint(own.select("n", "low", F.col("at.f").alias("f"), F.col("at.o").alias("o")).join(F.broadcast(number), "f").withColumn("d", F.shiftleft("i", 32).bitwiseOR(F.col("o"))))
    roots = components(set_links(own, where, files, similarity))
    joined = own.join(roots, own.d == roots.v, "left").select("low", F.coalesce("root", "d").alias("root"))
    c = checkpoint(joined.groupBy("root").agg(F.min("low").alias("low")).select("low.k", "low.h"))
    drop_folder(where)
    return _kept(docs, fp, c)


def keep_near(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """The documents, one of each component of fingerprints as `classes` links them: the row that `keep_one` would choose."""
    fp = checkpoint(_fingerprinted(texts(docs), width))
    own = checkpoint(fp.groupBy("fp").agg(F.min(F.struct(F.col("k").isNull().alias("none"), "k", "h")).alias("low")))
    where = new_folder(docs.sparkSession, "tiles")
    roots = components(near_links(own.select(F.col("fp").alias("v"), "fp"), where, 4 if own.count() >= FINE_FROM else 2, radius))
    joined = own.join(roots, own.fp == roots.v, "left").select("low", F.coalesce("root", "fp").alias("root"))
    c = checkpoint(joined.groupBy("root").agg(F.min("low").alias("low")).select("low.k", "low.h"))
    drop_folder(where)
    return _kept(docs, fp, c)


def _kept(docs: DataFrame, fp: DataFrame, c: DataFrame) -> DataFrame:
    """The rows of `docs` with the ids and text hashes `c` (k, h), one for each; `fp` has k and h of all rows."""
    rows = packed(docs).withColumn("h", F.xxhash64(F.coalesce(field("text"), F.lit(""))))
    kept = rows.join(c.withColumnRenamed("h", "ch"), field("doc_id").cast("long").eqNullSafe(F.col("k")) & (F.col("h") == F.col("ch")), "left_semi")
    if fp.groupBy("k", "h").count().where("count > 1").limit(1).count():  # repeated rows: one more pass settles which stays
        kept = kept.withColumn("x", F.xxhash64("r")).groupBy(field("doc_id").alias("k"), "h").agg(F.min_by("r", "x").alias("r"))
    return kept.select("r.*")
