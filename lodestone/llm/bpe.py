"""Byte-level BPE, encoding and decoding, with the merges done in batched numpy rounds.

The symbols of many pieces lie in one flat array. Each round looks up the ranks of the pairs that changed (binary search over
the sorted keys of all merges), takes the lowest rank of each piece, and joins its pairs at once. Pieces without any pair left
leave the array. Pieces are remembered by a worker, so those that come often are merged once.

A long piece has many rounds, each of which would look at all of it. Such a piece goes by rising rank instead, and a round
touches only the pairs of its rank. Both are exact: no merge makes a pair of a lower rank than its own, which is checked when
the vocabulary is read.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import process_state, slices, small_batches, texts
from .tokens import _byte_letters, vocabulary

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
#: Symbols from which on a piece goes by rising rank.
LONG = 1_024
#: Pieces that a worker remembers, of two generations each, and the longest of them in characters.
CACHE, CACHED_CHARS = 200_000, 64
#: Symbols merged together.
FLAT = 1 << 19
NONE = np.int32(2**31 - 1)
#: The highest code point up to which all releases of Unicode that are in use agree about letters and digits.
SETTLED = 0x557
#: How the byte-level pre-tokenizer splits a text: a fixed value of the format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Splitter:
    """Pieces of a text as the byte-level pre-tokenizer of the library makes them.

    The two libraries may know different releases of Unicode. Where `regex` calls a character a letter or number that this
    Python doesn't know as assigned, the pre-tokenizer itself is asked once, and its answer holds. Texts of settled characters
    go through a pattern with plain ranges, which is faster.
    """

    def __init__(self, path: str):
        import regex
        import tokenizers

        ask = tokenizers.Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.find = regex.compile(SPLIT).findall
        newer = [c for c in range(SETTLED + 1, 0x110000) if unicodedata.category(chr(c)) == "Cn"]
        likely = regex.compile(r"[\p{L}\p{N}]").findall("".join(map(chr, newer)))
        self.odd = _ranges([ord(c) for c in likely if len(ask("!" + c)) == 1])  # no letter or number there
        self.is_odd = re.compile(f"[{self.odd}]").search if self.odd else None
        self.find_odd = None
        self.far = re.compile(f"[^\x00-{chr(SETTLED)}]").search
        letter, number = (_ranges([c for c in range(SETTLED + 1) if unicodedata.category(chr(c))[0] == k]) for k in "LN")
        blank = _ranges([c for c in range(SETTLED + 1) if regex.match(r"\s", chr(c))])
        near = SPLIT.replace(r"[^\s\p{L}\p{N}]", f"[^{blank}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]").replace(r"\s", f"[{blank}]").replace(r"\S", f"[^{blank}]")
        # words first: no other piece begins as they do
        word = f" ?[{letter}]+"
        self.find_near = re.compile(word + "|" + near.replace(f"|{word}", "", 1)).findall

    def __call__(self, text: str) -> list[str]:
        if not self.far(text):
            return self.find_near(text)
        if self.is_odd is None or not self.is_odd(text):
            return self.find(text)
        if self.find_odd is None:
            import regex

            other = SPLIT.replace(r"[^\s\p{L}\p{N}]", f"(?:OTHER|[{self.odd}])").replace(r"\p{L}", rf"[\p{{L}}--[{self.odd}]]").replace(r"\p{N}", rf"[\p{{N}}--[{self.odd}]]")
            self.find_odd = regex.compile("(?V1)" + other.replace("OTHER", r"[^\s\p{L}\p{N}]")).findall
        return self.find_odd(text)


def _ranges(codes: list[int]) -> str:
    """Sorted code points as what stands within the brackets of a pattern."""
    out, i = [], 0
    while i < len(codes):
        k = i
        while k + 1 < len(codes) and codes[k + 1] == codes[k] + 1:
            k += 1
        out.append(rf"\U{codes[i]:08x}-\U{codes[k]:08x}")
        i = k + 1
    return "".join(out)


class Bpe:
    """The ids of texts, and the texts of ids, by one vocabulary file of the tokenizers library (byte-level, no normalizer)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        model, pre = j["model"], j["pre_tokenizer"] or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or j["normalizer"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError(f"{path} is no plain byte-level BPE")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in j["added_tokens"]):
            raise ValueError(f"{path} has added tokens with conditions")
        vocab, letters = model["vocab"], _byte_letters()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], np.int64) for i in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        born = np.full(len(vocab) + 1, -1, np.int64)
        born[self.made[::-1]] = np.arange(len(pairs))[::-1]  # by the first merge that makes it
        if (np.maximum(born[left], born[right]) >= np.arange(len(pairs))).any():
            raise ValueError(f"{path} has a merge that comes before those of its parts")
        key = left << 32 | right
        self.order = np.argsort(key, kind="stable")
        self.keys, self.rank = key[self.order], self.order.astype(np.int32)
        self.of_byte = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        back = {c: b for b, c in letters.items()}
        self.dtype = np.dtype("<u2" if max([*vocab.values(), *(t["id"] for t in j["added_tokens"])]) < 1 << 16 else "<u4")
        self.bytes_of = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.split = Splitter(path)
        self.memory = [{}, {}]

    # ------------------------------------------------------------------ merges
    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE where it is no merge."""
        key = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.rank[at], NONE)

    def merge(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of pieces of `sizes`, one after another, with all merges done; and their new sizes."""
        n = len(sizes)
        word, sym = np.repeat(np.arange(n, dtype=np.int32), sizes), symbols.astype(np.int32)
        r = np.full(len(sym), NONE)
        inner = np.flatnonzero(word[1:] == word[:-1]) if len(word) else np.zeros(0, np.int64)
        r[inner] = self.ranks(sym[inner], sym[inner + 1])
        done = []
        while len(sym):
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.minimum.reduceat(r, heads)
            each = np.repeat(low, np.diff(np.concatenate([heads, [len(sym)]])))
            if (low == NONE).any():
                out = each == NONE
                done.append((word[out], sym[out]))
                sym, word, r, each = (x[~out] for x in (sym, word, r, each))
                if not len(sym):
                    break
            hit = np.flatnonzero(r == each)
            run = np.flatnonzero(np.concatenate([[True], np.diff(hit) != 1]))  # in a run of one symbol every other pair
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.concatenate([run, [len(hit)]])))) % 2 == 0]
            sym[hit] = self.made[r[hit]]
            stay = np.ones(len(sym), bool)
            stay[hit + 1] = False
            sym, word, r = sym[stay], word[stay], r[stay]
            at = hit - np.arange(len(hit))
            at = np.concatenate([at, at[at > 0] - 1])
            inside = at + 1 < len(sym)
            inside[inside] = word[at[inside]] == word[at[inside] + 1]
            r[at] = NONE
            at = at[inside]
            r[at] = self.ranks(sym[at], sym[at + 1])
        if not done:
            return symbols[:0].astype(np.int32), np.zeros(n, np.int64)
        word, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return sym[order], np.bincount(word, minlength=n)

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """The symbols of one piece with all merges done, by rising rank: a round looks at the pairs of its rank only."""
        n, sym = len(symbols), symbols.astype(np.int32)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        r = np.full(n, NONE)
        r[:-1] = self.ranks(sym[:-1], sym[1:])
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def put(at: np.ndarray) -> None:
            at = at[r[at] != NONE]
            at = at[np.argsort(r[at], kind="stable")]
            if not len(at):
                return
            own = r[at]
            cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            for k, part in zip(own[cuts].tolist(), np.split(at, cuts[1:]), strict=True):
                if k not in waiting:
                    waiting[k] = []
                    heapq.heappush(heap, k)
                waiting[k].append(part)

        put(np.arange(n))
        while heap:
            rank = heapq.heappop(heap)
            hit = np.unique(np.concatenate(waiting.pop(rank)))
            hit = hit[r[hit] == rank]
            if not len(hit):
                continue
            chained = np.concatenate([[False], before[hit[1:]] == hit[:-1]])
            run = np.flatnonzero(~chained)
            hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(np.concatenate([run, [len(hit)]])))) % 2 == 0]
            gone = after[hit]
            sym[hit] = self.made[rank]
            sym[gone], r[gone] = -1, NONE
            nxt = after[gone]
            after[hit] = nxt
            before[nxt[nxt < n]] = hit[nxt < n]
            at = np.unique(np.concatenate([hit, before[hit][before[hit] >= 0]]))
            r[at] = NONE
            at = at[after[at] < n]
            r[at] = self.ranks(sym[at], sym[after[at]])
            put(at)
        return sym[sym >= 0]

    def _learn(self, pieces: list[str], known: dict[str, bytes]) -> None:
        raw = [p.encode("utf-8", "replace") for p in pieces]
        flat, n = [], 0
        for i, b in enumerate(raw):
            if len(b) >= LONG:
                known[pieces[i]] = self.merge_long(self.of_byte[np.frombuffer(b, np.uint8)]).astype(self.dtype).tobytes()
                continue
            flat.append(i)
            n += len(b)
            if n >= FLAT:
                self._learn_flat([pieces[k] for k in flat], [raw[k] for k in flat], known)
                flat, n = [], 0
        self._learn_flat([pieces[k] for k in flat], [raw[k] for k in flat], known)

    def _learn_flat(self, pieces: list[str], raw: list[bytes], known: dict[str, bytes]) -> None:
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        sym, sizes = self.merge(self.of_byte[np.frombuffer(b"".join(raw), np.uint8)], sizes)
        whole, ends = sym.astype(self.dtype).tobytes(), (np.cumsum(sizes) * self.dtype.itemsize).tolist()
        for p, a, z in zip(pieces, [0, *ends], ends, strict=False):
            known[p] = whole[a:z]

    # ------------------------------------------------------------------ texts
    def encode(self, batch: list[str]) -> list[np.ndarray]:
        """The ids of each text; strings of special tokens in a text become their ids, as in the library."""
        parts: list[list[tuple[list[str], int | None]]] = []
        for t in batch:
            if self.cut is None:
                parts.append([(self.split(t), None)])
                continue
            bits = self.cut(t)
            parts.append([(self.split(x), None) if i % 2 == 0 else ([], self.special[x]) for i, x in enumerate(bits)])
        if len(self.memory[0]) > CACHE:
            self.memory[:] = [{}, self.memory[0]]
        young, old = self.memory
        kinds = set(chain.from_iterable(p for ps in parts for p, _ in ps))
        missing = kinds.difference(young)
        back = [p for p in missing if p in old]
        young.update(zip(back, map(old.__getitem__, back), strict=True))
        fresh = missing.difference(back)
        self._learn(list(fresh), young)
        ids = young.__getitem__
        out = [np.frombuffer(b"".join([b"".join(map(ids, p)) if s is None else np.array([s], self.dtype).tobytes() for p, s in ps]), self.dtype) for ps in parts]
        for p in fresh:
            if len(p) > CACHED_CHARS:
                del young[p]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of some ids; bytes that are no UTF-8 become replacement characters. Unknown ids are left out."""
        get = self.bytes_of.get
        return b"".join([get(i, b"") for i in ids.tolist()]).decode("utf-8", "replace")


def _bpe(path: str) -> Bpe:
    """The vocabulary, read once by a worker process."""
    held = vars(process_state()).setdefault("bpe", {})
    if path not in held:
        held[path] = Bpe(path)
    return held[path]


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of every row. A null or empty text has no ids; repeated rows are each encoded; a null id stays
    null. Extra columns are ignored."""
    path = path or vocabulary(DEFAULT_VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for batch in batches:
            for part, raw in slices(batch):
                ids = bpe.encode([x.decode("utf-8", "replace") for x in raw])
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids).astype(np.int32) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids, text of every row of ids. Null ids are no ids and give the empty text; special tokens are kept."""
    path = path or vocabulary(DEFAULT_VOCABULARY)
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(path)
        for b in batches:
            ids, out = b.column(1), []
            ends, flat = ids.offsets.to_numpy(), ids.values.to_numpy(zero_copy_only=False)
            for a, z, there in zip(ends[:-1].tolist(), ends[1:].tolist(), ids.is_valid().to_pylist(), strict=True):
                out.append(bpe.decode(flat[a:z]) if there else "")
            yield pa.RecordBatch.from_arrays([b.column(0), ids, pa.array(out, pa.string())], names=["doc_id", "ids", "text"])

    return encoded.selectExpr(f"`{id_col}` AS doc_id", f"CAST(`{ids_col}` AS array<int>) AS ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
