"""Packed token matrices: best-fit-decreasing packing with a segment tree over free capacities.

Each task packs the rows that it reads, in shards of about ``shard`` tokens, so nothing is shuffled, memory is bounded and the
slack is one partly filled sequence in a shard. A document longer than a sequence is cut into full pieces and a rest, without
loss. The pieces go, longest first, to the fullest sequence that still holds them: the tree's leaves are the capacities 0 to
``length``, a node counts the sequences below it, and the search goes down to the least capacity that is large enough.

A row of the result is a row of the id matrix: ids (little-endian, padded to ``length``), cumulative segment lengths, the
places where positions restart at 0 (the segments' starts), and which part of which document each segment is.

``write`` puts them into flat files that a trainer maps into memory.

Defined results: a null or empty text is its end id alone. Null ids of documents are carried. Repeated rows are packed each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semirix.llm._store import table
from semirix.llm._text import blocks, released
from semirix.sources.binary import _at
from semirix.llm.tokens import ended, shards, tokenizer


class Capacities:
    """Multiset of bins by free capacity, with a search for the least capacity >= n."""

    def __init__(self, most: int):
        self.leaves = 1 << int(most).bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: dict[int, list[int]] = {}

    def add(self, free: int, name: int) -> None:
        self.bins.setdefault(free, []).append(name)
        i = free + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        """(free, name) of a bin with the least free capacity >= n, removed."""
        i, count = n + self.leaves, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        free = i - self.leaves
        name = self.bins[free].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return free, name


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of piece numbers; each bin's sizes sum to ``length`` at most. Equal sizes go in order."""
    bins, room = [], Capacities(length)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        got = room.take(sizes[i])
        if got is None:
            bins.append([])
            got = length, len(bins) - 1
        free, name = got
        bins[name].append(i)
        room.add(free - sizes[i], name)
    return bins


def pack(docs: DataFrame, path: str, pattern: str | None, last: int, length: int = 4096, shard: int = 4 << 20, pad: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """sequence_id, ids, n_tokens, cu_seqlens, position_resets, doc_ids, starts: a row for each sequence."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"sequence_id long, ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{kind}>, starts array<long>"

    def encoded(batches, width):
        tool = tokenizer(path, pattern)
        for b in blocks(batches, size=4 << 20):
            ids, offs = ended(*tool.encode(b.column("text")), last)
            parts = [ids[x:y].astype(width).tobytes() for x, y in zip(offs[:-1], offs[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(np.diff(offs)), pa.array(parts, pa.binary())], ["id", "n", "ids"])

    def run(batches):
        task, made = TaskContext.get().partitionId() << 40, 0
        width = np.uint16 if max(last, pad) < 1 << 16 and tokenizer(path, pattern).width == np.uint16 else np.uint32
        for part in shards(encoded(batches, width), shard):
            names = pa.concat_arrays([b.column("id") for b in part])
            ids = [np.frombuffer(x.as_buffer(), width) for b in part for x in b.column("ids")]
            pieces = [(d, s, min(length, len(x) - s)) for d, x in enumerate(ids) for s in range(0, len(x), length)]
            rows = []
            for members in best_fit_decreasing([p[2] for p in pieces], length):
                row, ends = np.full(length, pad, width), [0]
                for m in members:
                    d, s, n = pieces[m]
                    row[ends[-1] : ends[-1] + n] = ids[d][s : s + n]
                    ends.append(ends[-1] + n)
                rows.append((task | made, row.tobytes(), ends[-1], ends, ends[:-1], [pieces[m][0] for m in members], [pieces[m][1] for m in members]))
                made += 1
            cols = list(zip(*rows, strict=True))
            offs = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in cols[5]])]), pa.int32())
            owners = pa.ListArray.from_arrays(offs, names.take(pa.array([i for x in cols[5] for i in x])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.list_(pa.int32())), pa.array(cols[4], pa.list_(pa.int32())), owners, pa.array(cols[6], pa.list_(pa.int64()))],
                ["sequence_id", "ids", "n_tokens", "cu_seqlens", "position_resets", "doc_ids", "starts"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(released(run), schema)


def write(packed: DataFrame, path: str) -> DataFrame:
    """The matrices as flat little-endian files, to be mapped into memory; (part, sequences, tokens) of each part.

    A part has ``NNNNNN.ids`` (the rows of ids one after the other, 2 or 4 bytes each), ``NNNNNN.lengths`` (int32: the cumulative segment lengths
    of all rows, each from 0 on; without its last one a row's are the places where positions restart) and ``NNNNNN.rows`` (int64: where each
    row's begin in these, and where the last ends). A task writes under other names first, so one that is lost or runs twice leaves no half;
    an existing folder is an error. ``path`` is a folder that all executors share, or a URI that Arrow knows.
    """
    system, name = _at(path)
    system.create_dir(name, recursive=True)
    if system.get_file_info(fs.FileSelector(name)):
        raise FileExistsError(path)

    def run(batches):
        task, (system, name) = TaskContext.get(), _at(path)
        own, rows, tokens = f"{name}/.{task.partitionId()}-{task.taskAttemptId()}", [np.zeros(1, np.int64)], 0
        with system.open_output_stream(own + ".ids") as ids, system.open_output_stream(own + ".lengths") as lengths:
            for b in batches:
                for x in b.column("ids"):
                    ids.write(x.as_buffer())
                cu = b.column("cu_seqlens")
                lengths.write(cu.flatten().to_numpy().astype("<i4").tobytes())
                rows.append(rows[-1][-1] + np.cumsum(pc.list_value_length(cu).to_numpy().astype(np.int64)))
                tokens += int(b.column("n_tokens").to_numpy().sum())
        at = np.concatenate(rows)
        with system.open_output_stream(own + ".rows") as out:
            out.write(at.astype("<i8").tobytes())
        for kind in ("ids", "lengths", "rows"):
            if len(at) > 1:
                system.move(f"{own}.{kind}", f"{name}/{task.partitionId():06}.{kind}")
            else:
                system.delete_file(f"{own}.{kind}")
        if len(at) > 1:
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int64()), pa.array([len(at) - 1], pa.int64()), pa.array([tokens], pa.int64())], ["part", "sequences", "tokens"])

    return table(packed.select("ids", "cu_seqlens", "n_tokens").mapInArrow(released(run), "part long, sequences long, tokens long"), "parts")


def read(path: str, part: int, length: int = 4096) -> tuple[np.ndarray, list[np.ndarray]]:
    """The id matrix of a part in a local folder, mapped, and each row's cumulative segment lengths."""
    base = f"{path}/{part:06}"
    rows, lengths = np.fromfile(f"{base}.rows", "<i8"), np.fromfile(f"{base}.lengths", "<i4")
    ids = np.memmap(f"{base}.ids", np.uint8, "r")
    width = len(ids) // (length * (len(rows) - 1))
    return ids.view(f"<u{width}").reshape(-1, length), [lengths[a:b] for a, b in zip(rows[:-1], rows[1:], strict=True)]
