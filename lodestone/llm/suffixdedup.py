"""Exact substring dedup: every byte covered by a string of `length` bytes that also starts anywhere else is removed.

A suffix array of the whole corpus would be many times the corpus, so first the places are found where a repeat is possible
at all, and only their suffixes are sorted:

1. Each window of `length` bytes has an anchor: the least hash of its GRAM-byte strings, the leftmost of equal ones. Equal
   windows have equal anchors at equal distances. Neighbouring windows with the same anchor form one segment. Identical
   segments are folded to one with a count, whatever the number of copies; two of them go on, so that they meet in the order.
2. Segments whose anchor string occurs in no other segment can't repeat. Those left are dealt out by anchor string. A window
   has half of its other bytes, at least, on one side of its anchor string, so a group of more than SPLIT segments is dealt out
   twice over: by the hash of those bytes to the right, for the windows that have them there, and of those to the left.
3. There the suffixes that start at anchors are sorted, and so are the reversed prefixes that end at them, by deep-shallow
   sorting: multikey quicksort (three-way partitions, eight bytes a character) to SHALLOW bytes; groups that still tie are
   ordered by blind tries, which branch on single bytes and compare whole strings once for each insertion.
4. A window at distance d before its anchor repeats if another segment shares d bytes to the left and length - d bytes to the
   right of it: for each d, both orders are cut where neighbours share less, and segments in the same two classes match.
   That takes length - GRAM steps over the segments and never their pairs.
5. Repeated windows go back to all copies of their segment and are merged into spans.

What an order of bounded size can't hold, an anchor string in more than HOT different segments, is left to an exact count of its
windows by their 128-bit hashes, spread over all tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_folder, slices, small_batches

#: Bytes of an anchor string.
GRAM = 64
#: Depth in bytes to which the multikey quicksort goes.
SHALLOW = 128
#: Segments that a task sorts at once; groups of one anchor string that are dealt out by more bytes; and that are counted instead.
AT_ONCE, SPLIT, HOT = 20_000, 500, 200_000
#: Bytes hashed at once; places in such a block take the low bits of an anchor's sort key.
BLOCK, PLACE = 1 << 20, np.uint64(21)

_rng = np.random.default_rng(7)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = int(_rng.integers(1, 2**61)) * 8 + 5
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if 0 not in _powers or len(_powers[0][0]) < n:
        m = max(n, BLOCK + 1024)
        up, down = np.full(m, _BASE, np.uint64), np.full(m, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[0] = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers[0]


def gram_hashes(x: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the `gram` bytes from each place on."""
    up, down = _power(len(x) + 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(_TABLE[x] * up[: len(x)], out=total[1:])
    h = (total[gram:] - total[:-gram]) * down[: len(x) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours: running minima from both ends of blocks of that width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    fore = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], fore[width - 1 : n])


def segments(raw: list[bytes], length: int, gram: int = GRAM) -> Iterator[tuple[np.ndarray, ...]]:
    """(text number, start, windows, anchor's distance from start, anchor hash, two hashes of the bytes) of all segments."""
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    whole = b"".join(raw)
    x = np.frombuffer(whole, np.uint8)
    for at in range(0, len(x) - length + 1, BLOCK):
        part = x[at : at + BLOCK + length - 1]
        h = gram_hashes(part, gram)
        low = sliding_min((h >> PLACE << PLACE) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        start = at + np.arange(len(low))
        doc = np.searchsorted(begin, start, side="right") - 1
        start = start[start + length <= begin[doc + 1]]
        if not len(start):
            continue
        key = low[start - at]
        doc = np.searchsorted(begin, start, side="right") - 1
        head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]))
        n = np.diff(np.append(head, len(start)))
        s, anchor = start[head], (key[head] & np.uint64((1 << int(PLACE)) - 1)).astype(np.int64)
        both = np.array([divmod(xxhash.xxh3_128_intdigest(whole[a:z]), 1 << 64) for a, z in zip(s.tolist(), (s + n + length - 1).tolist(), strict=True)], np.uint64).reshape(-1, 2)
        yield doc[head], s - begin[doc[head]], n, anchor + at - s, h[anchor], both[:, 0], both[:, 1]


# --------------------------------------------------------------------------- deep-shallow sorting
def shared(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    m = min(len(a), len(b))
    return m - ((int.from_bytes(a[:m], "big") ^ int.from_bytes(b[:m], "big")).bit_length() + 7) // 8


class BlindTrie:
    """Strings in order, by branching bytes only: nodes [depth, children by byte, a string below]; leaves are lists of equal strings."""

    def __init__(self, strings: list[bytes]):
        self.s, self.root = strings, None

    def _byte(self, i: int, depth: int) -> int:
        own = self.s[i]
        return own[depth] if depth < len(own) else -1

    def add(self, i: int) -> None:
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, tuple):  # blindly down to some leaf
            depth, kids, some = node
            node = kids.get(self._byte(i, depth)) or [some]
        j = node[0]
        common = shared(self.s[i], self.s[j])
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < common:
            parent, node = node, node[1][self._byte(i, node[0])]
        if common == len(self.s[i]) == len(self.s[j]):  # equal: to their leaf, which may hang below a node of that very depth
            (node[1][-1] if isinstance(node, tuple) else node).append(i)
            return
        if isinstance(node, tuple) and node[0] == common:
            node[1][self._byte(i, common)] = [i]
            return
        fork = (common, {self._byte(i, common): [i], self._byte(j, common): node}, j)
        if parent is None:
            self.root = fork
        else:
            parent[1][self._byte(i, parent[0])] = fork

    def order(self) -> Iterator[int]:
        stack = [self.root] if self.root is not None else []
        while stack:
            node = stack.pop()
            if isinstance(node, tuple):
                stack += [node[1][c] for c in sorted(node[1], reverse=True)]
            else:
                yield from node


def multikey_quicksort(char: np.ndarray, lens: np.ndarray, group: np.ndarray, shallow: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first, tied): strings by group, then by their bytes up to `shallow`; whether a place starts a run of equals, and
    whether the run there ties at that depth with bytes left to compare.

    `char` has the strings eight bytes a character. Three-way partitions of all groups go side by side: each part takes a pivot,
    what is smaller or larger stays at its character, what is equal goes on to the next one, until it ends there or is deep enough.
    """
    n = len(lens)
    order = np.argsort(group, kind="stable")
    first = np.concatenate([[True], group[order][1:] != group[order][:-1]])[:n]
    depth, ended = np.zeros(n, np.int64), np.zeros(n, bool)  # of the part that a place is in
    rng = np.random.default_rng(11)
    while True:
        start = np.flatnonzero(first)
        size = np.diff(np.append(start, n))
        live = (size > 1) & ~ended[start] & (depth[start] < shallow)
        if not live.any():
            break
        start, size = start[live], size[live]
        part = np.repeat(np.arange(len(start)), size)
        place = np.arange(len(part)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
        own, at = order[place], depth[place]
        c, left = char[own, at // 8], np.clip(lens[own] - at, 0, 8)
        pivot = np.cumsum(size) - size + (rng.random(len(size)) * size).astype(np.int64)
        pc, pleft = c[pivot][part], left[pivot][part]
        side = np.where(c == pc, np.sign(left - pleft), np.where(c < pc, -1, 1))
        sub = np.argsort(3 * part + side, kind="stable")
        order[place] = own[sub]
        side, pleft = side[sub], pleft[sub]
        first[place[1:]] |= (side[1:] != side[:-1]) & (part[1:] == part[:-1])
        equal = side == 0
        depth[place[equal & (pleft == 8)]] += 8
        ended[place[equal & (pleft < 8)]] = True
    return order, first, ~ended


def deep_shallow(strings: list[bytes], group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """(order, shared): the strings of each group in order, and what each shares with the one before; -1 at a group's first."""
    n = len(strings)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lens = np.fromiter(map(len, strings), np.int64, n)
    width = -(-max(int(lens.max()), shallow) // 8) * 8
    flat = np.zeros((n, width), np.uint8)
    flat[np.repeat(np.arange(n), lens), np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)] = np.frombuffer(b"".join(strings), np.uint8)
    order, first, tied = multikey_quicksort(flat[:, : -(-shallow // 8) * 8].view(">u8").astype(np.uint64), lens, group, shallow)
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, n))
    deep = (size > 1) & tied[start]
    for a, z in zip(start[deep].tolist(), (start + size)[deep].tolist(), strict=True):
        trie = BlindTrie(strings)
        for i in order[a:z].tolist():
            trie.add(i)
        order[a:z] = list(trie.order())
    common = np.full(n, -1, np.int64)
    for a in range(1, n, 4096):
        z = min(n, a + 4096)
        x, y = order[a:z], order[a - 1 : z - 1]
        differ = flat[x] != flat[y]
        least = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common[a:z] = np.where(group[x] == group[y], np.minimum(least, np.minimum(lens[x], lens[y])), -1)
    return order, common


def repeated(parts: list[bytes], anchor: np.ndarray, windows: np.ndarray, group: np.ndarray, length: int, gram: int = GRAM, shallow: int = SHALLOW, side: np.ndarray | None = None) -> np.ndarray:
    """For segments: which of their windows (by start, row by row) another segment of the group has as well. `side`: 0 where all
    windows of a segment are asked for, 1 and 2 where only those that reach enough bytes to the right or left of the anchor string."""
    n = len(parts)
    at = anchor.tolist()
    low, high = np.zeros(n, np.int64), np.full(n, length - gram)
    if side is not None:
        half = reach(length, gram)
        high[side == 1], low[side == 2] = half, half + 1
    right_order, right = deep_shallow([p[a:] for p, a in zip(parts, at, strict=True)], group, shallow)
    left_order, left = deep_shallow([p[:a][::-1] for p, a in zip(parts, at, strict=True)], group, shallow)
    found = np.zeros((n, length - gram + 1), bool)
    for d in range(length - gram + 1):
        own = np.flatnonzero((anchor >= d) & (anchor - d < windows) & (low <= d) & (d <= high))
        if len(own) < 2:
            continue
        r, s = np.empty(n, np.int64), np.empty(n, np.int64)
        r[right_order] = np.cumsum(right < length - d)
        s[left_order] = np.cumsum(left < d)
        pair = r[own] * (n + 1) + s[own]
        order = np.argsort(pair)
        same = pair[order][1:] == pair[order][:-1]
        hit = np.append(same, False) | np.concatenate([[False], same])
        own = own[order[hit]]
        found[own, anchor[own] - d] = True
    return found


def reach(length: int, gram: int) -> int:
    """Windows that start at most so far before their anchor string are dealt out by the bytes after it, others by those before it."""
    return (length - gram) // 2


def deals(text: bytes, anchor: int, windows: int, length: int, gram: int) -> list[tuple[int, int]]:
    """(side, hash) of the groups of a segment that is dealt out by more than its anchor string."""
    half, out = reach(length, gram), []
    if anchor - windows < half:  # a window starts `half` bytes before the anchor or less, so it ends length - half after that at least
        out.append((1, _signed(xxhash.xxh3_64_intdigest(text[anchor : anchor + length - half], 1))))
    if anchor > half:
        out.append((2, _signed(xxhash.xxh3_64_intdigest(text[anchor - half - 1 : anchor], 2))))
    return out


# --------------------------------------------------------------------------- on Spark
def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63))).alias("k"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    return rows.withColumn("th", F.xxhash64("t"))


def _ints(*cols) -> list[pa.Array]:
    return [pa.array(np.asarray(c).astype(np.int64) if np.asarray(c).dtype != np.uint64 else np.asarray(c).view(np.int64)) for c in cols]


SEGMENT = "k long, th long, start long, n long, anchor long, key long, h1 long, h2 long"


def spans(docs: DataFrame, length: int = 400, gram: int = GRAM, hot: int = HOT, split: int = SPLIT, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows, found): rows are (k, t, th); found has for each (k, th) with repeats `w`, the runs (first, last) of repeated windows."""
    spark = docs.sparkSession
    rows = _texts(docs, id_col, text_col)
    where = new_folder(spark, "suffix")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, raw in slices(b):
                k, th = part.column(0).to_numpy(), part.column(2).to_numpy()
                for doc, *rest in segments(raw, length, gram):
                    yield pa.RecordBatch.from_arrays(_ints(k[doc], th[doc], *rest), names=["k", "th", "start", "n", "anchor", "key", "h1", "h2"])

    rows.mapInArrow(cut, SEGMENT).write.parquet(f"{where}/segments")
    every = spark.read.schema(SEGMENT).parquet(f"{where}/segments")
    kinds = every.groupBy("key", "h1", "h2", "anchor", "n").agg(F.count("*").alias("copies"), F.first("k").alias("k"), F.first("th").alias("th"), F.first("start").alias("start"))
    kinds.write.parquet(f"{where}/kinds")
    kinds = spark.read.parquet(f"{where}/kinds")
    # segments that can repeat; a frequent anchor string is spread over 8 tasks
    of_key = kinds.groupBy("key").agg(F.count("*").alias("variants"), F.sum("copies").alias("total")).where("total > 1")
    of_key = of_key.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(7))))
    alive = kinds.withColumn("s", F.pmod("h1", F.lit(8)).cast("int")).join(of_key, ["key", "s"]).drop("s")
    alive.write.parquet(f"{where}/alive")
    alive = spark.read.parquet(f"{where}/alive")
    how = F.when(F.col("variants") > hot, 2).when(F.col("variants") > split, 1).otherwise(0)
    wanted = alive.groupBy("k", "th").agg(F.collect_list(F.struct("key", "h1", "h2", "start", "n", "anchor", F.least("copies", F.lit(2)).alias("copies"), how.alias("how"))).alias("w"))
    joined = rows.join(wanted, ["k", "th"], "left").select("k", "t", "w")
    names = ["key", "h1", "h2", "x", "y", "c", "side", "b"]

    def bring(batches: Iterator[pa.RecordBatch], want_hot: bool) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()  # a repeated row brings its segments again
        for b in batches:
            asked = b.filter(b.column(2).is_valid())
            for part, raw in slices(asked):
                out: list[tuple] = []
                for text, ws in zip(raw, part.column(2).to_pylist(), strict=True):
                    for w in ws:
                        if (w["how"] == 2) != want_hot or (w["h1"], w["h2"]) in seen:
                            continue
                        seen.add((w["h1"], w["h2"]))
                        own = text[w["start"] : w["start"] + w["n"] + length - 1]
                        if want_hot:
                            for i in range(w["n"]):
                                x = xxhash.xxh3_128_intdigest(own[i : i + length])
                                out.append((0, w["h1"], w["h2"], _signed(x >> 64), _signed(x & (2**64 - 1)), i, 0, b""))
                        else:
                            for side, key in deals(own, w["anchor"], w["n"], length, gram) if w["how"] else [(0, 0)]:
                                out.append((w["key"] ^ key, w["h1"], w["h2"], w["anchor"], w["n"], w["copies"], side, own))
                    if len(seen) > 200_000:
                        seen.clear()
                if out:
                    cols = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:7]), pa.array(cols[7], pa.binary())], names=names)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, last = 0, None
        for b in batches:
            keys = b.column(0).to_numpy()
            for a, z in _pieces(keys):
                if n + (z - a) > AT_ONCE and n and keys[a] != last:
                    yield from _sorted(held, length, gram)
                    held, n = [], 0
                held.append(b.slice(a, z - a))
                n, last = n + z - a, keys[z - 1]
        if held:
            yield from _sorted(held, length, gram)

    schema = "key long, h1 long, h2 long, x long, y long, c long, side long, b binary"
    alive_n, hot_n = alive.agg(F.count("*"), F.sum((F.col("variants") > hot).cast("long"))).first()
    parts = max(spark.sparkContext.defaultParallelism, -(-(alive_n or 0) // AT_ONCE))
    brought = joined.mapInArrow(lambda it: bring(it, False), schema)
    found = brought.repartition(parts, "key").sortWithinPartitions("key", "side", "h1", "h2").mapInArrow(sort, "h1 long, h2 long, a long, z long")
    if hot_n:  # anchor strings in more than `hot` different segments: windows one by one, counted by hash, never in one task
        each = joined.mapInArrow(lambda it: bring(it, True), schema).select("h1", "h2", "x", "y", F.col("c").alias("a")).distinct()
        twice = each.groupBy("x", "y").count().where("count > 1").select("x", "y", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("s"))
        found = found.union(each.withColumn("s", F.pmod("h1", F.lit(8)).cast("int")).join(twice, ["x", "y", "s"]).select("h1", "h2", "a", F.col("a").alias("z")))
        whole = alive.where((F.col("variants") > hot) & (F.col("copies") > 1))
        found = found.union(whole.select("h1", "h2", F.lit(0).cast("long").alias("a"), (F.col("n") - 1).alias("z")))
    placed = every.join(found, ["h1", "h2"]).select("k", "th", (F.col("start") + F.col("a")).alias("a"), (F.col("start") + F.col("z")).alias("z"))
    return rows, placed.groupBy("k", "th").agg(F.collect_set(F.struct("a", "z")).alias("w"))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _pieces(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
    at = 0
    for z in cuts[1:].tolist():  # several small groups at a time
        if z - at >= 2048 or z == len(keys):
            yield at, z
            at = z


def _sorted(held: list[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_batches(held)
    key, h1, h2, anchor, n, copies, side = (t.column(i).to_numpy() for i in range(7))
    new = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (key[1:] != key[:-1]) | (side[1:] != side[:-1])
    one = np.flatnonzero(np.concatenate([[True], new]))
    one = np.repeat(one, copies[one])  # of copies, two
    key, h1, h2, anchor, n, side = key[one], h1[one], h2[one], anchor[one], n[one], side[one]
    group = np.cumsum(np.concatenate([[False], (key[1:] != key[:-1]) | (side[1:] != side[:-1])]))
    hit = repeated(t.column(7).take(pa.array(one)).to_pylist(), anchor, n, group, length, gram, side=side)
    hit[1:][one[1:] == one[:-1]] = False  # the second of two copies has what the first has
    edge = np.diff(hit.astype(np.int8), axis=1, prepend=0, append=0)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    yield pa.RecordBatch.from_arrays(_ints(h1[row], h2[row], first, last), names=["h1", "h2", "a", "z"])


def dedup(docs: DataFrame, length: int = 400, gram: int = GRAM, hot: int = HOT, split: int = SPLIT, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, `kept`: the remaining bytes of each row's text.

    Matches never cross documents; strings are judged on the input, not on what is left. A null text is empty; texts shorter
    than `length` bytes are never changed. Repeated rows are copies of each other like any others. Cutting bytes may split
    characters, so `kept` is binary. Extra columns are ignored.
    """
    rows, found = spans(docs, length, gram, hot, split)
    joined = rows.join(found, ["k", "th"], "left").select("k", "t", "w")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, raw in slices(b):
                out: list[list] = [[] for _ in range(6)]
                for k, text, w in zip(part.column(0).to_pylist(), raw, part.column(2).to_pylist(), strict=True):
                    kept, removed, runs, at = [], 0, 0, 0
                    end = -1
                    for a, z in sorted((x["a"], x["z"] + length) for x in w or ()):
                        if a > end:
                            if end >= 0:
                                removed, runs = removed + end - begin, runs + 1
                                at = end
                            kept.append(text[max(at, 0) : a])
                            begin = a
                        end = max(end, z)
                    if end >= 0:
                        removed, runs, at = removed + end - begin, runs + 1, end
                    kept.append(text[at:])
                    left = b"".join(kept)
                    for col, v in zip(out, (None if k == -(2**63) else k, len(text), removed, runs, hashlib.sha256(left).hexdigest(), left if with_kept else None), strict=True):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.string()), pa.array(out[5], pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = joined.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return done if with_kept else done.drop("kept")
