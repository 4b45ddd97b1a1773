"""Token ids of whole texts by the tokenizers library, for documents in Arrow batches."""

from __future__ import annotations

import itertools
import os
import re
from array import array
from collections.abc import Iterable

import numpy as np

from .common import give_back, process_state

#: The vocabulary file used unless another path is given.
DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Chunks whose ids a worker remembers: of two generations each, the older one goes when the newer is full.
CACHE = 400_000
#: A word of letters that have no other form to be normalised to, and marks after it that begin no contraction.
_WORD = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!\"#$%&()*+,\-./:;=?@\[\\\]^_`{|}~]*)").fullmatch


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from 256 on in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


def vocabulary(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids as little-endian unsigned integers: 16 bits if the vocabulary allows, else 32.

    `by_chunk`: encode each run of non-space bytes once and remember it. That gives the library's own result for
    vocabularies whose pre-tokenizer drops white space and never reaches across it, as the default one, and so is done for
    that file only unless asked for; with any other vocabulary texts are encoded whole.
    """

    def __init__(self, path: str, by_chunk: bool | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.by_chunk = os.path.basename(path) == DEFAULT_VOCABULARY if by_chunk is None else by_chunk
        self.letters = _byte_letters()
        # remembered for the life of the worker process, over its tasks, unless `forget` is called
        self.memory = vars(process_state()).setdefault("ids", {}).setdefault(path, [{}, {}])

    def forget(self) -> None:
        """Give back what is remembered: Spark deals tasks in turn to all workers that an executor has, and earlier stages may have
        left it more than it has cores, so each would fill a memory of its own."""
        self.memory[:] = [{}, {}]
        give_back()

    def _encode(self, raw: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in raw], add_special_tokens=False)
        return [np.array(x.ids, self.dtype).tobytes() for x in got]

    def _learn(self, chunks: list[bytes], known: dict[bytes, bytes], old: dict[bytes, bytes]) -> None:
        """Ids of chunks that neither generation knows, though it may know their words. A word of plain letters is one piece of the
        pre-tokenizer whatever marks follow, so it goes straight to the vocabulary's model and the marks are encoded apart; all else
        goes through the whole tokenizer."""
        model, code, rest = self.tokenizer.model.tokenize, self.dtype.char, []
        for c in chunks:
            m = _WORD(c)
            if m is None:
                rest.append(c)
                continue
            word, marks = m.groups()
            ids = known.get(word) or old.get(word)
            if ids is None:
                letters = word.decode() if word.isascii() else word.decode("latin-1").translate(self.letters)
                ids = array(code, [t.id for t in model(letters)]).tobytes()
            known[word] = ids
            if marks:
                if marks not in known:
                    known[marks] = old.get(marks) or self._encode([marks])[0]
                known[c] = ids + known[marks]
        for i in range(0, len(rest), 20_000):
            known.update(zip(rest[i : i + 20_000], self._encode(rest[i : i + 20_000]), strict=True))

    def encode(self, raw: list[bytes]) -> list[np.ndarray]:
        if not self.by_chunk:
            return [np.frombuffer(x, self.dtype) for x in self._encode(raw)]
        # the vocabulary is lower case; only special tokens, which begin with <|, are told by case
        chunks, ends = [], [0]
        for x in raw:
            chunks += (x if b"<|" in x else x.lower()).split()
            ends.append(len(chunks))
        if len(self.memory[0]) > CACHE:
            self.memory[:] = [{}, self.memory[0]]
        young, old = self.memory
        ids = list(map(young.get, chunks))
        gaps = [i for i, x in enumerate(ids) if x is None]
        missing = set(map(chunks.__getitem__, gaps))
        young.update((c, old[c]) for c in missing if c in old)
        self._learn([c for c in missing if c not in old], young, old)
        for i in gaps:
            ids[i] = young[chunks[i]]
        return [np.frombuffer(b"".join(ids[a:b]), self.dtype) for a, b in itertools.pairwise(ends)]


def ended(ids: Iterable[np.ndarray], end: int, dtype: np.dtype) -> Iterable[np.ndarray]:
    """Each document's ids with the end id."""
    tail = np.array([end], dtype)
    return (np.concatenate([x, tail]) for x in ids)
