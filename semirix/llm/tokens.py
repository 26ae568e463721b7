"""Token ids of whole texts by public tokenizer files, whose path is a parameter.

``WordTokenizer`` serves tokenizers that drop white space and cut every word on its own: the words of a block are told apart by
a 64-bit hash, each different word is encoded once and kept, and the ids of the texts are gathered from there. The ids are those
of encoding the texts directly. The cache is bounded and lives in the executor's Python worker.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from semirix.llm._text import U64, Words

_TOOLS: dict[str, object] = {}


class WordTokenizer:
    """A ``tokenizers`` file without tokens across white space."""

    def __init__(self, path: str, most: int = 2_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tool, self.most = Tokenizer.from_file(path), most
        self.tool.encode_special_tokens = True  # their strings in a text are ordinary text
        vocabulary = self.tool.get_vocab()
        self.total = max(vocabulary.values()) + 1
        self.width = np.uint16 if self.total <= 1 << 16 else np.uint32
        self.final = np.zeros(self.total, bool)  # ids that end a piece of a word
        self.final[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.keys, self.at, self.size, self.ids = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.width)

    def _learn(self, keys: np.ndarray, words: list[str]) -> None:
        """Encodes new words, whose keys are sorted.

        A word of letters, with or without one mark behind, has one or two pieces at least, and a piece's last id says that it
        is the last. So many of them are encoded as one text and told apart by their pieces. Only if a text has more pieces than
        these, and for all other words, each word is encoded by itself.
        """
        pieces = np.fromiter((1 if w.isalpha() else 2 if w[-1] in ".,;:!?" and w[:-1].isalpha() else 0 for w in words), np.int64, len(words))
        plain, alone = np.flatnonzero(pieces), np.flatnonzero(pieces == 0).tolist()
        size, order, ids = np.zeros(len(words), np.int64), [], []
        chunks = [plain[i : i + 1000] for i in range(0, len(plain), 1000)]
        for chunk, e in zip(chunks, self.tool.encode_batch_fast([" ".join([words[i] for i in c.tolist()]) for c in chunks], add_special_tokens=False), strict=True):
            got = np.array(e.ids, self.width)
            ends, last = np.flatnonzero(self.final[got]) + 1, np.cumsum(pieces[chunk])
            if len(ends) != last[-1] or ends[-1] != len(got):
                alone += chunk.tolist()
                continue
            size[chunk] = np.diff(ends[last - 1], prepend=0)
            order.append(chunk)
            ids.append(got)
        for i, e in zip(alone, self.tool.encode_batch_fast([words[i] for i in alone], add_special_tokens=False), strict=True):
            ids.append(np.array(e.ids, self.width))
            size[i] = len(ids[-1])
        order = np.concatenate([*order, np.array(alone, np.int64)]).astype(np.int64)
        at = np.empty(len(words), np.int64)
        at[order] = len(self.ids) + np.concatenate([[0], np.cumsum(size[order])[:-1]])
        self.ids = np.concatenate([self.ids, *ids])
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, place, keys), np.insert(self.at, place, at), np.insert(self.size, place, size)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the n + 1 offsets of the texts in them."""
        w = Words(texts)
        if not len(w.starts):
            return np.zeros(0, self.width), np.zeros(w.n + 1, np.int64)
        u, first, inv = np.unique(w.hashes(), return_index=True, return_inverse=True)
        place = np.searchsorted(self.keys, u)
        new = (self.keys[np.minimum(place, len(self.keys) - 1)] != u) if len(self.keys) else np.ones(len(u), bool)
        if new.any():
            if len(self.keys) + int(new.sum()) > self.most:
                self._clear()
                new[:] = True
            self._learn(u[new], w.words(first[new]))
        row = np.searchsorted(self.keys, u)[inv]
        size = self.size[row]
        end = np.concatenate([[0], np.cumsum(size)])
        flat = np.repeat(self.at[row] - end[:-1], size) + np.arange(end[-1])
        return self.ids[flat], end[w.first]


class ByteTokenizer:
    """A ``tiktoken`` file of ranks."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tool = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.total = max(ranks.values()) + 1
        self.width = np.uint16 if self.total < 1 << 16 else np.uint32

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        got = [self.tool.encode_ordinary_batch([t], num_threads=1)[0] if len(t) > 1 << 20 else self.tool.encode_ordinary(t) for t in pc.fill_null(texts, "").to_pylist()]
        size = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for x in got for i in x), self.width, int(size.sum())), np.concatenate([[0], np.cumsum(size)])


def tokenizer(path: str, pattern: str | None = None):
    """The tokenizer of a file, made once in a Python worker."""
    if path not in _TOOLS:
        _TOOLS[path] = WordTokenizer(path) if path.endswith(".json") else ByteTokenizer(path, pattern)
    return _TOOLS[path]


def ended(ids: np.ndarray, offs: np.ndarray, last: int) -> tuple[np.ndarray, np.ndarray]:
    """The same texts with id ``last`` after each."""
    return np.insert(ids, offs[1:], last), offs + np.arange(len(offs))


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    """Runs of whole rows with about ``size`` tokens each, by the column n."""
    run, total = [], 0
    for b in batches:
        n, i = np.cumsum(b.column("n").to_numpy(zero_copy_only=False).astype(np.int64)), 0
        while i < b.num_rows:
            j = max(i + 1, int(np.searchsorted(n, (n[i - 1] if i else 0) + size - total, "right")))
            run.append(b.slice(i, j - i))
            total += int(n[min(j, b.num_rows) - 1] - (n[i - 1] if i else 0))
            i = j
            if total >= size:
                yield run
                run, total = [], 0
    if run:
        yield run
