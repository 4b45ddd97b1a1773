"""Many phrases in many texts: an automaton over bytes (Aho and Corasick, 1975) in flat arrays.

Phrases are cut into shards of a checked size. A shard's automaton is built level by level, with numpy, goes out by broadcast,
and reads the texts of an Arrow batch side by side: they are cut into pieces of a fixed length that overlap by the longest
phrase, and one step takes the next byte of all pieces at once. The cost is that of the texts' bytes, whatever the number of
phrases in a shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of phrases in a shard, texts in a step in bytes, and the least length of a piece.
SHARD_BYTES, SLICE_BYTES, PIECE = 1 << 17, 4 << 20, 512


@dataclass
class Automaton:
    """The states of all prefixes of some distinct phrases, the root first and shorter prefixes before longer ones.

    letter: the column of `go` for each byte, 0 for bytes of no phrase; go: the next state, failures resolved; phrase: the
    phrase that ends in a state, or -1; also: the state of the longest proper suffix in which a phrase ends, or 0.
    """

    letter: np.ndarray
    go: np.ndarray
    phrase: np.ndarray
    also: np.ndarray
    longest: int

    @classmethod
    def of(cls, phrases: list[bytes]) -> Automaton:
        sizes = np.array([len(p) for p in phrases], np.int64)
        if not len(phrases) or sizes.min() == 0:
            raise ValueError("phrases must not be empty")
        flat, starts = np.frombuffer(b"".join(phrases), np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        used = np.unique(flat)
        letter = np.zeros(256, np.int32)
        letter[used] = np.arange(1, len(used) + 1)
        width, longest = len(used) + 1, int(sizes.max())
        at = np.zeros(len(phrases), np.int64)  # the state that each phrase has come to
        levels, total = [], 1
        for d in range(longest):
            on = np.flatnonzero(sizes > d)
            step = at[on] * width + letter[flat[starts[on] + d]]
            new, inverse = np.unique(step, return_inverse=True)
            at[on] = total + inverse
            levels.append((new // width, (new % width).astype(np.int64), total))
            total += len(new)
        go, fail = np.zeros((total, width), np.int32), np.zeros(total, np.int64)
        phrase, also = np.full(total, -1, np.int32), np.zeros(total, np.int32)
        phrase[at] = np.arange(len(phrases))
        for d, (parent, c, first) in enumerate(levels):
            own = first + np.arange(len(parent))
            # what follows a parent's failure state is known, as that state is shorter; a child of the root fails to the root
            fail[own] = go[fail[parent], c] if d else 0
            go[parent, c] = own
            also[own] = np.where(phrase[fail[own]] >= 0, fail[own], also[fail[own]])
            # the children's rows begin as those of their failure states, whose own children are entered already
            go[own] = go[fail[own]]
        return cls(letter, go, phrase, also, longest)

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, phrase, end) of every occurrence; `end` is the place after its last byte."""
        keep = max(PIECE, 4 * self.longest)  # new bytes of a piece
        lap = self.longest - 1
        sizes = np.array([len(t) for t in texts], np.int64)
        pieces = np.maximum(1, -(-sizes // keep))
        owner = np.repeat(np.arange(len(texts)), pieces)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        begin = np.cumsum(sizes) - sizes
        data = self.letter[np.frombuffer(b"".join(texts), np.uint8)]
        new = nth * keep  # where the piece's own bytes begin in its text
        low = np.maximum(0, new - lap)
        high = np.minimum(new + keep, sizes[owner])
        order = np.argsort(low - high, kind="stable")  # the longest piece first, so that those that are done are at the end
        owner, new, low, high = owner[order], new[order], low[order], high[order]
        base, length = begin[owner] + low, high - low
        state, found = np.zeros(len(owner), np.int32), []
        live = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), side="left")
        ends = (self.phrase >= 0) | (self.also > 0)
        go, width = self.go.reshape(-1), self.go.shape[1]
        for i, n in enumerate(live.tolist()):
            s = go[state[:n].astype(np.int64) * width + data[base[:n] + i]]
            state[:n] = s
            hit = np.flatnonzero(ends[s])
            if len(hit):
                end = low[hit] + i + 1
                mine = end > new[hit]  # the bytes before are another piece's own
                found.append((owner[hit[mine]], s[hit[mine]], end[mine]))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        text, s, end = (np.concatenate(x) for x in zip(*found, strict=True))
        out = []
        while len(text):
            is_end = self.phrase[s] >= 0
            out.append((text[is_end], self.phrase[s[is_end]].astype(np.int64), end[is_end]))
            s = self.also[s]
            go_on = s > 0
            text, s, end = text[go_on], s[go_on], end[go_on]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _sliced(b: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Ids and texts of a batch, at most about SLICE_BYTES of text each."""
    ids, texts, at = b.column(0), b.column(1).cast(pa.large_binary()).to_pylist(), 0
    sizes = np.cumsum([len(t) for t in texts])
    while at < len(texts):
        before = int(sizes[at - 1]) if at else 0
        to = min(max(at + 1, int(np.searchsorted(sizes, before + SLICE_BYTES, side="right"))), len(texts))
        yield ids.slice(at, to - at), texts[at:to]
        at = to


def find(docs: DataFrame, phrases: DataFrame, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", phrase_col: str = "phrase") -> DataFrame:
    """(doc, phrase, n, first): how often each phrase stands in a text, and the byte at which it first does.

    docs: any ids and texts; phrases: a column of texts, of which the distinct, non-empty ones are looked for byte by byte, also
    inside of words. Occurrences may overlap. A null text or phrase is in nothing; each row of `docs` is a document of its own,
    whatever its id. Phrases come to the driver a shard at a time.
    """
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    wanted = phrases.select(F.col(phrase_col).cast("string").alias("p")).where("length(p) > 0").distinct()
    shards = max(1, math.ceil((wanted.agg(F.sum(F.octet_length("p"))).first()[0] or 0) / shard_bytes))
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("t")).where("t is not null")
    schema, out = f"doc {kind.simpleString()}, phrase string, n long, first long", None
    for i in range(shards):
        own = wanted if shards == 1 else wanted.where(F.pmod(F.xxhash64("p"), F.lit(shards)) == i)
        names = own.toArrow().column(0).to_pylist()  # about shard_bytes
        if not names:
            continue
        held = spark.sparkContext.broadcast((Automaton.of([p.encode() for p in names]), names))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            machine, names = held.value
            sizes = np.array([len(p.encode()) for p in names])
            for b in batches:
                for ids, texts in _sliced(b):
                    text, which, end = machine.scan(texts)
                    key, inverse, n = np.unique(text * len(names) + which, return_inverse=True, return_counts=True)
                    first = np.full(len(key), np.iinfo(np.int64).max)
                    np.minimum.at(first, inverse, end - sizes[which])
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(key // len(names))), pa.array([names[k] for k in (key % len(names)).tolist()], pa.string()), pa.array(n.astype(np.int64)), pa.array(first)], names=["doc", "phrase", "n", "first"])

        got = rows.mapInArrow(run, schema)
        out = got if out is None else out.union(got)
    if out is None:
        return spark.createDataFrame([], schema)
    return out
