"""Benchmark decontamination by the q-gram lemma.

Texts and items are compared in a plain form: A-Z in lower case, runs of other ASCII than letters and digits as one space.
An item of m bytes that occurs in a text with k edits at most shares at least m + 1 - q (k + 1) q-grams with it, all within
k + 1 neighbouring diagonals (place in the text minus place in the item). Shared q-grams are counted in diagonal bands
that overlap by k, so that each such occurrence lies whole in one of them; bands that reach the bound are verified by an
alignment restricted to the band. Nothing else is dropped, so every occurrence within the budget is found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, texts

#: Bytes of a q-gram: one 64-bit word, compared whole.
Q = 8
#: Edits allowed as a share of an item's length.
RATE = 0.08
#: Items of fewer bytes in plain form match without edits and as whole words only: with an edit they may share no q-gram at all.
SHORTEST = 2 * Q
#: Bytes of the windows in which a longer item is also searched for by `decontaminate`; they overlap by half.
WINDOW = 160
#: Bytes of items that go to the workers at once; more items take more passes over the documents.
BLOCK_BYTES = 8 << 20
#: Bytes of texts that are searched at once; each takes some fifty bytes of arrays.
SEARCHED = 1 << 19
_SPACE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def plain(text: bytes) -> bytes:
    return b" ".join(text.lower().translate(_SPACE).split())


def words64(x: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one number."""
    if len(x) < Q:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(x) - Q + 1,), "<u8", x, strides=(1,)).copy()


def align(item: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int]:
    """(edits, end): the fewest edits that turn `item` into a part of `text` on diagonals low to high, and where it ends first."""
    far, width = 1 << 20, high - low + 1
    at = np.arange(low, high + 1)
    d = np.where((at >= 0) & (at <= len(text)), 0, far)
    ramp = np.arange(width)
    padded = np.full(width + len(item) + 1, 256, np.int16)  # text under the band, nothing outside it
    a, b = max(0, low), min(len(text), high + len(item))
    if b > a:
        padded[a - low : b - low] = text[a:b]
    for i in range(len(item)):
        step = d + (padded[i : i + width] != item[i])
        step[:-1] = np.minimum(step[:-1], d[1:] + 1)
        j = at + i + 1
        step[(j < 0) | (j > len(text))] = far
        d = np.minimum.accumulate(step - ramp) + ramp
        d[(j < 0) | (j > len(text))] = far
    best = int(np.argmin(d))
    return int(d[best]), int(at[best]) + len(item)


class Finder:
    """Items ready for search."""

    def __init__(self, items: list[tuple[int | None, bytes]], rate: float = RATE):
        kept = [(i, plain(t)) for i, t in items]
        short = [(i, t) for i, t in kept if 0 < len(t) < SHORTEST]
        kept = [(i, t) for i, t in kept if len(t) >= SHORTEST]
        self.ids = [i for i, _ in kept + short]
        self.by_word: dict[bytes, list[tuple[int, bytes]]] = {}  # short items by their first word
        for n, (_, t) in enumerate(short, len(kept)):
            self.by_word.setdefault(t.split()[0], []).append((n, b" " + t + b" "))
        self.items = [np.frombuffer(t, np.uint8) for _, t in kept]
        m = np.array([len(t) for _, t in kept], np.int64)
        self.m, self.k = m, np.minimum((rate * m).astype(np.int64), m // Q - 1)  # the bound stays 1 at least
        self.need, self.stride = m + 1 - Q * (self.k + 1), np.maximum(64, self.k + 1)
        codes = [words64(x) for x in self.items]
        lens = np.array([len(c) for c in codes], np.int64)
        every = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.codes, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        self.of = np.repeat(np.arange(len(codes)), lens)[order]
        self.at = (np.concatenate([np.arange(n) for n in lens]) if len(lens) else np.zeros(0, np.int64))[order]
        self.seen = np.zeros(1 << 22, bool)
        self.seen[self._slot(self.codes)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)

    def search(self, raw: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item number, edits, start, end) of all occurrences; places are those of the plain form. Of
        occurrences of one item that overlap, the one with the fewest edits."""
        docs = [plain(x) for x in raw]
        lens = np.fromiter(map(len, docs), np.int64, len(docs))
        begin = np.concatenate([[0], np.cumsum(lens + Q)])[:-1]
        x = np.frombuffer(bytes(Q).join(docs), np.uint8)
        code = words64(x)
        out = self._short(docs)
        if not len(code) or not self.items:
            return out
        pos = np.flatnonzero(self.seen[self._slot(code)])
        code = code[pos]
        which = np.searchsorted(self.codes, code)
        which[which == len(self.codes)] = 0
        ok = self.codes[which] == code
        pos, which = pos[ok], which[ok]
        n = self.first[which + 1] - self.first[which]
        take = np.repeat(self.first[which] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
        item, diag = self.of[take], np.repeat(pos, n) - self.at[take]
        band = np.floor_divide(diag, self.stride[item])
        twice = diag - band * self.stride[item] < self.k[item]
        item, band = np.concatenate([item, item[twice]]), np.concatenate([band, band[twice] - 1])
        key, count = np.unique((item << 40) + band + (1 << 30), return_counts=True)
        item, band = key >> 40, (key & ((1 << 40) - 1)) - (1 << 30)
        ok = count >= self.need[item]
        found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for i, b in zip(item[ok].tolist(), band[ok].tolist(), strict=True):
            k, m, low = int(self.k[i]), int(self.m[i]), b * int(self.stride[i])
            high = low + int(self.stride[i]) + k
            for d in range(max(0, int(np.searchsorted(begin, low, side="right")) - 1), len(docs)):
                if begin[d] > high + m:
                    break
                if lens[d] < m - k or begin[d] + lens[d] < low:
                    continue
                for hit in self._verify(i, docs[d], low - int(begin[d]) - k, high - int(begin[d]) + k, 0, len(docs[d])):
                    if hit not in found.setdefault((d, i), []):
                        found[d, i].append(hit)
        for (d, i), hits in found.items():
            kept: list[tuple[int, int, int]] = []
            for h in sorted(hits):
                if all(h[2] <= o[1] or h[1] >= o[2] for o in kept):
                    kept.append(h)
            out += [(d, i, *h) for h in kept]
        return out

    def _short(self, docs: list[bytes]) -> list[tuple[int, int, int, int, int]]:
        out = []
        for d, doc in enumerate(docs) if self.by_word else ():
            padded = b" " + doc + b" "
            for w in self.by_word.keys() & set(doc.split()):
                for i, item in self.by_word[w]:
                    at = padded.find(item)
                    while at >= 0:
                        out.append((d, i, 0, at, at + len(item) - 2))
                        at = padded.find(item, at + len(item) - 1)
        return out

    def _verify(self, i: int, doc: bytes, low: int, high: int, a: int, z: int) -> list[tuple[int, int, int]]:
        """The occurrences in doc[a:z] on diagonals low to high, none over another: one, and those before and after it."""
        own, k = self.items[i], int(self.k[i])
        low, high = max(low, a - k), min(high, z - len(own) + k)
        if low > high:
            return []
        edits, start = 0, doc.find(own.tobytes(), max(a, low), min(z, max(a, high) + len(own)))
        end = start + len(own)
        if start < 0:
            text = np.frombuffer(doc, np.uint8)[a:z]
            edits, end = align(own, text, low - a, high - a)
            if edits > k:
                return []
            least = max(0, end - len(own) - k)
            _, back = align(own[::-1], text[least:end][::-1], -k, k)  # the start, from the end backwards
            start, end = a + end - back, a + end
        before = self._verify(i, doc, low, min(high, start - len(own) + k), a, start)
        return [*before, (edits, start, end), *self._verify(i, doc, max(low, end - k), high, end, z)]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items in blocks of about BLOCK_BYTES; their size is asked for first."""
    own = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t"))
    total = own.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    for b in range(n):
        part = own if n == 1 else own.where(F.pmod(F.xxhash64("t"), F.lit(n)) == b)
        yield [(r["i"], r["t"].encode()) for r in part.distinct().collect()]


def passages(items: list[tuple[int | None, bytes]]) -> list[tuple[int | None, bytes]]:
    """The items, and the windows of those longer than a window: any part of WINDOW * 3 / 2 bytes holds one whole."""
    out = list(items)
    for i, t in items:
        p = plain(t)
        if len(p) > WINDOW:
            out += [(i, p[min(a, len(p) - WINDOW) :][:WINDOW]) for a in range(0, len(p) - WINDOW // 2, WINDOW // 2)]
    return out


def occurrences(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, edits, start, end: one row per occurrence of a whole item in a row's text; places in the plain form.
    Parts of an item have no row.

    A null or empty text or item has none; an item of fewer than SHORTEST bytes occurs without edits, as whole words. Repeated
    rows each give their rows; items with the same text each match, also those without an id. Extra columns are ignored.
    """
    out = None
    for items in _blocks(benchmark, "item_id", "text"):
        finder = Finder(items, rate)

        def run(batches: Iterator[pa.RecordBatch], finder=finder) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part, raw in slices(b, most=SEARCHED):
                    hits = finder.search(raw)
                    k = part.column(0).to_pylist()
                    cols = ([k[h[0]] for h in hits], [finder.ids[h[1]] for h in hits], [h[2] for h in hits], [h[3] for h in hits], [h[4] for h in hits])
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "edits", "start", "end"])

        found = texts(docs).mapInArrow(run, "doc_id long, item_id long, edits long, start long, end long")
        out = found if out is None else out.union(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents without those in which an item occurs, or a window of WINDOW bytes of a longer one, each within the edits
    allowed for its length; all columns stay. Decided row by row, with no shuffle."""
    small_batches(docs.sparkSession)
    names = list(docs.columns)
    at = names.index("text")
    for items in _blocks(benchmark, "item_id", "text"):
        finder = Finder(passages(items), rate)

        def run(batches: Iterator[pa.RecordBatch], finder=finder) -> Iterator[pa.RecordBatch]:
            for b in batches:
                t = b.rename_columns(["t" if i == at else f"c{i}" for i in range(b.num_columns)])
                for part, raw in slices(t, most=SEARCHED):
                    keep = np.ones(len(raw), bool)
                    keep[[h[0] for h in finder.search(raw)]] = False
                    yield part.filter(pa.array(keep)).rename_columns(names)

        docs = docs.mapInArrow(run, docs.schema)
    return docs
