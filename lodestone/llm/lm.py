"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model, counted in Spark, kept as sorted hash arrays in
the shared folder, and memory-mapped by the workers that score.

Each shuffle is of packed blocks (sorted integers as compressed differences) instead of rows:
1. words: each task counts its words; blocks are dealt by the first bits of the word's 64-bit hash and merged into sorted
   shards `w-*.h` (hashes) and `w-*.n` (counts). The place of a hash in all shards is the word's id.
2. grams of the order: the ids of a gram become one key that scatters evenly, so no frequent word makes a large block; merged
   into sorted shards `g<k>-*.k` (keys) and `g<k>-*.c` (counts; larger ones than a byte holds in `g<k>-*.o`). The key is a
   bijection of the ids where they fit 64 bits together, else a 64-bit hash that the ids travel beside.
3. each lower order down to two: a gram counts once for each kind of gram that it ends (one at the start of a text, which ends
   none, as often as it occurs), and keeps in `g<k>-*.s` what follows it: the sum, and kinds seen once, twice, more often.
4. single words: the same by id, in `s-*.a`.
Scoring needs no shuffle; arrays are mapped when first asked for, a bounded number at once. The driver holds the number of
grams in each shard and a few sums, nothing that is per word or per gram.
"""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Maps, crc_remainder, new_folder, slices, texts, write_bytes

#: The end token's hash input: no word contains a newline.
END = xxhash.xxh64_intdigest(b"\n")
#: Distinct words, and grams, that a task holds before it passes them on.
HELD_WORDS, HELD_GRAMS = 300_000, 2_000_000
#: Grams in a shard, and ids in a range of the context arrays, on average.
SHARD_GRAMS, RANGE_IDS = 1_500_000, 1 << 20
#: Words in a shard, at a guess of how many kinds so much text has.
SHARD_WORDS = 500_000
#: Bits up to which the ids of a gram are its key.
KEY_BITS = 64


# --------------------------------------------------------------------------- packed blocks
def _planes(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes())


def _from_planes(data: bytes, n: int, dtype: str) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(1, n * size))
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(dtype)


def pack(keys: np.ndarray, *counts: np.ndarray) -> bytes:
    """Sorted 64-bit keys and their counts as bytes."""
    parts = [_planes(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))] + [_planes(c.astype("<u8")) for c in counts]
    return struct.pack("<qB", len(keys), len(parts)) + b"".join(struct.pack("<q", len(p)) for p in parts) + b"".join(parts)


def unpack(data: bytes) -> list[np.ndarray]:
    n, k = struct.unpack_from("<qB", data)
    lens, at = struct.unpack_from(f"<{k}q", data, 9), 9 + 8 * k
    out = []
    for i, size in enumerate(lens):
        x = _from_planes(data[at : at + size], n, "<u8")
        out.append(x.astype(np.int64) if i else np.cumsum(x, dtype=np.uint64))
        at += size
    return out


def merge(blocks: list[list[np.ndarray]], same: int = 0) -> list[np.ndarray]:
    """Blocks of sorted keys and counts as one; counts of equal keys are summed, but for the last `same` ones, which are equal."""
    keys = np.concatenate([b[0] for b in blocks])
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    summed = len(blocks[0]) - same
    columns = (np.concatenate([b[i] for b in blocks])[order] for i in range(1, len(blocks[0])))
    return [keys[head], *(np.add.reduceat(c, head) if i < summed else c[head] for i, c in enumerate(columns, 1))]


def _gather(batches: Iterator[pa.RecordBatch], same: int = 0) -> Iterator[tuple[int, list[list[np.ndarray]]]]:
    """The blocks of each number, from batches sorted by it."""
    at, held = None, []
    for b in batches:
        for i, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if i != at and held:
                yield at, held
                held = []
            at = i
            held.append(unpack(data.as_py()))
            if len(held) >= 64:
                held = [merge(held, same if i >= 0 else 0)]
    if held:
        yield at, held


def _dealt(df: DataFrame, parts: int) -> DataFrame:
    return df.repartition(parts, "b").sortWithinPartitions("b")


def _rows(b: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(data, pa.binary())], names=["b", "data"])


def _split(keys: np.ndarray, shift: int, *counts: np.ndarray) -> pa.RecordBatch:
    """A block for each value of keys >> shift."""
    top = (keys >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(keys), np.int64)
    cuts = np.concatenate([[0], np.flatnonzero(top[1:] != top[:-1]) + 1, [len(top)]]) if len(top) else np.zeros(1, np.int64)
    return _rows([int(top[a]) for a in cuts[:-1]], [pack(keys[a:z], *(c[a:z] for c in counts)) for a, z in zip(cuts[:-1], cuts[1:], strict=True)])


# --------------------------------------------------------------------------- the model
@dataclass
class Level:
    """Of the grams of one length: the first bits of a key that tell its shard, grams in each shard, discounts."""

    bits: int
    sizes: list[int] = field(default_factory=list)
    discount: tuple[float, float, float] = (0.5, 1.0, 1.5)


@dataclass
class Model:
    """Where the arrays are, and a few sums. Ids run over the words in order of their hashes; then come start and unknown."""

    where: str
    order: int
    word_bits: int
    words: list[int] = field(default_factory=list)  # in each shard
    tokens: int = 0  # N
    texts: int = 0
    levels: dict[int, Level] = field(default_factory=dict)  # by length, from two on
    low_discount: tuple[float, float, float] = (0.5, 1.0, 1.5)
    low_kinds: int = 0  # what the counts of single words add up to
    low_mass: float = 1.0

    @property
    def vocabulary(self) -> int:
        return sum(self.words)

    @property
    def bits(self) -> int:
        return max(1, int(self.vocabulary + 2).bit_length())

    def width(self, k: int) -> int:
        """Bits of the keys of k words."""
        return 64 if self.wide(k) else k * self.bits

    def wide(self, k: int) -> bool:
        return k * self.bits > KEY_BITS


_ODD = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def _scatter(x: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of numbers of so many bits, whose first bits depend on all."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    for m in _ODD:
        x = (x * np.uint64(m)) & mask
        x = x ^ (x >> half)
    return (x * np.uint64(_ODD[0])) & mask


def _unscatter(x: np.ndarray, bits: int) -> np.ndarray:
    mask, half = np.uint64((1 << bits) - 1), np.uint64((bits + 1) // 2)
    back = [np.uint64(pow(m, -1, 1 << 64)) for m in _ODD]
    x = (x * back[0]) & mask
    for m in back[::-1]:
        x = x ^ (x >> half)
        x = (x * m) & mask
    return x


def gram_keys(model: Model, ids: list[np.ndarray]) -> np.ndarray:
    """The keys of grams given as ids of their first, second, ... words."""
    x = np.zeros(len(ids[0]), np.uint64)
    for i in ids:
        x = _scatter(x ^ i.astype(np.uint64), 64) if model.wide(len(ids)) else (x << np.uint64(model.bits)) | i.astype(np.uint64)
    return x if model.wide(len(ids)) else _scatter(x, model.width(len(ids)))


def ids_of(model: Model, k: int, keys: np.ndarray) -> list[np.ndarray]:
    """The ids of the words of grams whose keys aren't wide."""
    x, mask = _unscatter(keys, model.width(k)), np.uint64((1 << model.bits) - 1)
    return [((x >> np.uint64(model.bits * (k - 1 - i))) & mask).astype(np.int64) for i in range(k)]


def before(first: np.ndarray, x: np.ndarray, none) -> np.ndarray:
    """What stands one place before, within each text; `none` at a text's first place."""
    out = np.concatenate([x[:1], x[:-1]])
    out[first] = none
    return out


class Words:
    """Ids and counts of words, from the mapped shards."""

    def __init__(self, model: Model):
        self.model, self.maps = model, Maps(model.where)
        self.base = np.concatenate([[0], np.cumsum(model.words)]).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id, count); unknown words have the id after the start's, and 0."""
        order = np.argsort(hashes)
        x, v = hashes[order], self.model.vocabulary
        ids, counts = np.full(len(x), v + 1, np.int64), np.zeros(len(x), np.int64)
        top = (x >> np.uint64(64 - self.model.word_bits)).astype(np.int64)
        for s in np.unique(top).tolist():
            a, z = np.searchsorted(top, s), np.searchsorted(top, s, side="right")
            if self.model.words[s]:
                own = self.maps(f"w-{s:05d}.h", "<u8")
                at = np.searchsorted(own, x[a:z])
                ok = (at < len(own)) & (own[np.minimum(at, len(own) - 1)] == x[a:z])
                ids[a:z][ok] = self.base[s] + at[ok]
                counts[a:z][ok] = self.maps(f"w-{s:05d}.n", "<u8")[at[ok]]
        out, n = np.empty_like(ids), np.empty_like(counts)
        out[order], n[order] = ids, counts
        return out, n

    def sequences(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place of each text, ids, counts) of all tokens of the texts, one end token each."""
        words = [x.lower().split() for x in raw]
        kinds = list(set(chain.from_iterable(words)))
        ids, counts = self.find(np.append(np.fromiter(map(xxhash.xxh64_intdigest, kinds), np.uint64, len(kinds)), np.uint64(END)))
        place = dict(zip(kinds, range(len(kinds)), strict=True))
        lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(lens) - 1
        at = np.full(int(lens.sum()), len(kinds), np.int64)
        inner = np.ones(len(at), bool)
        inner[ends] = False
        at[inner] = np.fromiter(map(place.__getitem__, chain.from_iterable(words)), np.int64, len(at) - len(ends))
        first = ends - lens + 1
        return first, ids[at], counts[at]

    def histories(self, first: np.ndarray, cur: np.ndarray, order: int) -> list[np.ndarray]:
        """[ids, ids one before, two before, ...]: the start's id before a text, then -1."""
        out = [cur]
        for i in range(1, order):
            out.append(before(first, out[-1], self.model.vocabulary if i == 1 else -1))
        return out


def _discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's estimates from how many kinds were seen once, twice, three and four times; half a count where one is missing."""
    if not all(n[:4]):
        return (0.5, 1.0, 1.5)
    y = n[0] / (n[0] + 2 * n[1])
    got = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2])
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(got))


def _shard_bits(docs: DataFrame) -> int:
    """Shards for the words of so much text, as its size is estimated from the files' statistics, by Heaps' law."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    tokens = size / 4 if size < 1 << 60 else 3e7 * docs.rdd.getNumPartitions()  # of an unknown size: by partitions of 128 MB
    kinds = min(tokens, 60 * max(tokens, 1) ** 0.65)
    return max(3, int(kinds // SHARD_WORDS).bit_length(), (docs.sparkSession.sparkContext.defaultParallelism - 1).bit_length())


def train(docs: DataFrame, order: int = 2) -> Model:
    """Count a model over all rows of `docs` (columns k, t). `order`: words in the longest grams, two at least."""
    if order < 2:
        raise ValueError("an order of two at least")
    spark = docs.sparkSession
    where = new_folder(spark, "lm")
    model = Model(where, order, _shard_bits(docs))
    shift = 64 - model.word_bits

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            h, n = np.fromiter(map(xxhash.xxh64_intdigest, held), np.uint64, len(held)), np.fromiter(held.values(), np.int64, len(held))
            order = np.argsort(h)
            return _split(h[order], shift, n[order])

        for b in batches:
            for _, raw in slices(b):
                held.update(chain.from_iterable(x.lower().split() for x in raw))
                held[b"\n"] += len(raw)
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    def word_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b, blocks in _gather(batches):
            h, n = merge(blocks)
            write_bytes(where, f"w-{b:05d}.h", [h.astype("<u8").tobytes()])
            write_bytes(where, f"w-{b:05d}.n", [n.astype("<u8").tobytes()])
            rows.append((b, len(h), int(n.sum()), int(n[h == np.uint64(END)].sum())))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["b", "words", "tokens", "texts"])

    got = _dealt(docs.mapInArrow(words, "b int, data binary"), 1 << model.word_bits).mapInArrow(word_shards, "b long, words long, tokens long, texts long").collect()  # a row per shard
    sizes = {r["b"]: r["words"] for r in got}
    model.words = [sizes.get(i, 0) for i in range(1 << model.word_bits)]
    model.tokens, model.texts = sum(r["tokens"] for r in got), sum(r["texts"] for r in got)
    if not model.tokens:
        return model
    for k in range(2, order + 1):
        model.levels[k] = Level(min(model.width(k), max(3, int(model.tokens // SHARD_GRAMS).bit_length())))
    v = model.vocabulary

    def block(ids: list[np.ndarray], *counts: np.ndarray) -> tuple[np.ndarray, ...]:
        """Grams (rows may repeat) as sorted distinct keys, their counts summed, and the ids where keys don't tell them."""
        keys, carried = gram_keys(model, ids), ids if model.wide(len(ids)) else []
        own = np.argsort(keys, kind="stable")
        return tuple(merge([[keys[own], *(c[own] for c in counts), *(i[own] for i in carried)]], len(carried)))

    def put(k: int, x: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return _split(x[0], model.width(k) - model.levels[k].bits, *x[1:])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held, n = Words(model), [], 0

        def out() -> pa.RecordBatch:
            ids = [np.concatenate([h[i] for h in held]) for i in range(order)]
            return put(order, block(ids, np.ones(len(ids[0]), np.int64)))

        for b in batches:
            for _, raw in slices(b):
                first, cur, _ = reader.sequences(raw)
                past = reader.histories(first, cur, order)[::-1]
                whole = past[0] >= 0
                held.append(past if whole.all() else [x[whole] for x in past])
                n += int(whole.sum())
                if n > HELD_GRAMS:
                    yield out()
                    held, n = [], 0
        if n:
            yield out()

    def starts(k: int):
        """Grams of k words at the start of texts, for an order below the model's."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = Words(model)
            for b in batches:
                for _, raw in slices(b):
                    first, cur, _ = reader.sequences([b" ".join(x.split(None, k)[:k]) for x in raw])
                    past = reader.histories(first, cur, k)[::-1]
                    at = past[0] == v
                    if at.any():
                        ids = [x[at] for x in past]
                        one = np.ones(len(ids[0]), np.int64)
                        yield put(k, block(ids, one, 0 * one, 0 * one, 0 * one, 0 * one))

        return run

    def shards(k: int):
        carried = k if model.wide(k) else 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, blocks in _gather(batches, carried):
                if b < 0:  # sums of the orders above go on
                    yield _rows([b], [pack(*merge(blocks))])
                    continue
                x = merge(blocks, carried)
                keys, n = x[0], x[1]
                name = f"g{k}-{b:06d}"
                write_bytes(where, f"{name}.k", [keys.astype("<u8").tobytes()])
                write_bytes(where, f"{name}.c", [np.minimum(n, 255).astype(np.uint8).tobytes()])
                large = np.flatnonzero(n >= 255)
                write_bytes(where, f"{name}.o", [np.stack([large, n[large]], axis=1).astype("<i8").tobytes()])
                if k < order:
                    write_bytes(where, f"{name}.s", [_narrow(np.stack(x[2:6], axis=1))])
                ids = x[len(x) - k :] if carried else ids_of(model, k, keys)
                once, twice, zero = (n == 1).astype(np.int64), (n == 2).astype(np.int64), 0 * n
                ends, starts_ = (ids[1:], np.ones(len(n), np.int64), zero, zero, zero, zero), (ids[:-1], zero, n, once, twice, 1 - once - twice)
                for own, *columns in (ends, starts_):
                    yield put(k - 1, block(own, *columns)) if k > 2 else _split(*_by_id(own[0], columns))
                of = np.bincount(np.minimum(n, 5), minlength=6)[1:5]
                yield _rows([-2 * k], [pack(np.arange(4, dtype=np.uint64), of)])
                yield _rows([-2 * k - 1], [pack(np.array([b], np.uint64), np.array([len(n)]))])

        return run

    def _by_id(ids: np.ndarray, columns: list[np.ndarray]) -> tuple:
        own = np.argsort(ids, kind="stable")
        x = merge([[ids[own].astype(np.uint64), *(c[own] for c in columns)]])
        return x[0], (RANGE_IDS - 1).bit_length(), *x[1:]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for b, blocks in _gather(batches):
            keys, *n = merge(blocks)
            if b < 0:
                rows += [(b, int(k), int(x)) for k, x in zip(keys, n[0], strict=True)]
                continue
            out = np.zeros((min(RANGE_IDS, v + 2 - b * RANGE_IDS), 5), np.int64)
            out[keys.astype(np.int64) - b * RANGE_IDS] = np.stack(n, axis=1)
            write_bytes(where, f"s-{b:05d}.a", [_narrow(out)])
            of = np.bincount(np.minimum(out[:, 0], 5), minlength=6)[1:6]
            rows += [(-1, i, int(x)) for i, x in enumerate([*of, out[:, 0].sum()])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["b", "i", "n"])

    packed = "b int, data binary"
    found = docs.mapInArrow(grams, packed)
    for k in range(order, 1, -1):
        own = found if k == order else found.union(docs.mapInArrow(starts(k), packed))
        found = _dealt(own, 1 << model.levels[k].bits).mapInArrow(shards(k), packed)
    ranges = -(-(v + 2) // RANGE_IDS)
    rows = _dealt(found, ranges + 2 * order).mapInArrow(contexts, "b long, i long, n long").groupBy("b", "i").agg(F.sum("n").alias("n")).collect()  # a row per shard and a few sums
    of = lambda b: {r["i"]: r["n"] for r in rows if r["b"] == b}
    for k, level in model.levels.items():
        sums, sizes = of(-2 * k), of(-2 * k - 1)
        level.sizes = [sizes.get(i, 0) for i in range(1 << level.bits)]
        level.discount = _discounts([sums.get(i, 0) for i in range(4)])
    low = of(-1)
    model.low_discount = d = _discounts([low.get(i, 0) for i in range(4)])
    model.low_kinds = low[5]
    model.low_mass = (d[0] * low.get(0, 0) + d[1] * low.get(1, 0) + d[2] * (low.get(2, 0) + low.get(3, 0) + low.get(4, 0))) / model.low_kinds
    return model


def _narrow(x: np.ndarray) -> bytes:
    """Counts in 32 bits each where all fit, else in 64; the file's size tells which."""
    return x.astype("<u4" if not x.size or int(x.max()) < 1 << 32 else "<u8").tobytes()


def _widened(x: np.ndarray, rows: int, columns: int) -> np.ndarray:
    return x.view("<u4" if x.nbytes == 4 * rows * columns else "<u8").reshape(rows, columns)


class Scorer:
    """Scores texts in one process."""

    def __init__(self, model: Model):
        self.model, self.words, self.maps = model, Words(model), Maps(model.where)

    def grams(self, k: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """(counts, what follows: sum, kinds seen once, twice, more often) of sorted distinct keys; zeros for unknown ones. Nothing
        follows grams of the model's order."""
        level, out = self.model.levels[k], np.zeros(len(keys), np.int64)
        after = np.zeros((len(keys), 4)) if k < self.model.order else None
        top = keys >> np.uint64(self.model.width(k) - level.bits)
        cuts = np.searchsorted(top, np.arange((1 << level.bits) + 1, dtype=np.uint64))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            a, z, size = cuts[s], cuts[s + 1], level.sizes[s]
            if not size:
                continue
            name = f"g{k}-{s:06d}"
            own = self.maps(f"{name}.k", "<u8")
            at = np.searchsorted(own, keys[a:z])
            at[at == size] = 0
            ok = own[at] == keys[a:z]
            n = np.where(ok, self.maps(f"{name}.c", "u1")[at], 0).astype(np.int64)
            if (large := np.flatnonzero(n == 255)).size:
                more = self.maps(f"{name}.o", "<i8").reshape(-1, 2)
                n[large] = more[np.searchsorted(more[:, 0], at[large]), 1]
            out[a:z] = n
            if after is not None:
                after[a:z][ok] = _widened(self.maps(f"{name}.s", "u1"), size, 4)[at[ok]]
        return out, after

    def single(self, ids: np.ndarray) -> np.ndarray:
        """The row of each id (of distinct sorted ones): count, and what follows; zeros for the unknown."""
        out, part, v = np.zeros((len(ids), 5)), ids // RANGE_IDS, self.model.vocabulary
        for s in np.unique(part).tolist():
            a, z = np.searchsorted(part, s), np.searchsorted(part, s, side="right")
            out[a:z] = _widened(self.maps(f"s-{s:05d}.a", "u1"), min(RANGE_IDS, v + 2 - s * RANGE_IDS), 5)[ids[a:z] - s * RANGE_IDS]
        return out

    def __call__(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, known tokens, base score, score) of each text."""
        m = self.model
        n, v = m.tokens, m.vocabulary
        first, cur, count = self.words.sequences(raw)
        tokens = np.diff(np.append(first, len(cur)))
        base = np.add.reduceat(np.log10((count + 0.1) / (n + 0.1 * (v + 1))), first)
        known = np.add.reduceat((count > 0).astype(np.int64), first)
        if not n:
            return tokens, known, base, np.zeros(len(raw))
        past = self.words.histories(first, cur, m.order)
        ids, at = np.unique(np.append(cur, v), return_inverse=True)
        rows, low = self.single(ids), m.low_discount
        ends = rows[:, 0]
        p_low = np.maximum(ends - np.select([ends == 0, ends == 1, ends == 2], [0, low[0], low[1]], low[2]), 0) / m.low_kinds + m.low_mass / (v + 1)
        p = p_low[at[:-1]]
        # what follows each context, by context, and which of them each place has; the start is the context of first places
        after, of = rows[:, 1:], before(first, at[:-1], at[-1])
        for k in range(2, m.order + 1):
            valid = slice(None) if k == 2 else np.flatnonzero(past[k - 1] >= 0)
            d, ctx = m.levels[k].discount, of[valid]
            keys, inv = np.unique(gram_keys(m, [x[valid] for x in past[k - 1 :: -1]]), return_inverse=True)
            c, follow = self.grams(k, keys)
            seen = after[:, 0]
            gamma = np.where(seen > 0, (after[:, 1:] @ np.array(d)) / np.maximum(seen, 1), 1.0)
            own = np.maximum(c - np.select([c == 0, c == 1, c == 2], [0, d[0], d[1]], d[2]), 0)[inv]
            p[valid] = own / np.maximum(seen, 1)[ctx] + gamma[ctx] * p[valid]
            if follow is not None:
                at = np.full(len(cur), len(keys))
                at[valid] = inv
                after, of = np.append(follow, np.zeros((1, 4)), axis=0), before(first, at, len(keys))
        return tokens, known, base, np.add.reduceat(np.log10(p), first)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """k, n_tokens, n_known, base_score, score of each row of `docs` (columns k, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            for part, raw in slices(b):
                n, known, base, score = scorer(raw)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(score)], names=["k", "n_tokens", "n_known", "base_score", "score"])

    return docs.mapInArrow(run, "k long, n_tokens long, n_known long, base_score double, score double")


def perplexity(docs: DataFrame, folds: int = 10, order: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every row.

    Rows of fold 0 are held out, all others are learned from. A null text is the end token alone. Repeated rows count each
    time. Without a row to learn from, the only token kind left is the unknown one, with probability 1 (score 0).
    """
    rows = texts(docs)
    held = crc_remainder(F.col("k"), folds) == 0
    model = train(rows.where(~held), order)
    got = scores(rows, model)
    return got.select(
        F.col("k").alias("doc_id"), held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
