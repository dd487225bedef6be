"""Problem 8: filling containers of fixed capacity with texts.

Method: bounded-space online packing.  Each task keeps a fixed number of open windows;
an item goes into the window that it fills best; when none has room the fullest is closed
and emitted.  The windows left open at the end of the tasks are merged in a second step,
whole windows being its items, in groups of bounded size.

Sizes are tokens of a public tokenizer; its file is a parameter.  A text is divided only
if it exceeds the capacity by itself: into full containers and a rest, which is packed.
"""

from __future__ import annotations

import base64
import bisect
import functools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.lookalike import _slices
from millrace.session import written

CAPACITY = 2048
OPEN_WINDOWS = 64
TOKENIZER = os.path.join(os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
#: How the tokenizer cuts text before merging; a fixed value that belongs to its vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Windows left over by this many tasks are merged together.
TASKS_PER_MERGE = 64
_PIECES = "window bigint, left boolean, fill int, doc_id bigint, piece int, token_start bigint, n_tokens int"


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class OpenWindows:
    """A bounded set of open windows, kept in order of their room."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.rooms: list[tuple[int, int]] = []  # (room, window), ascending
        self.items: dict[int, list] = {}
        self.made = 0

    def add(self, size: int, item) -> tuple[int, int, list] | None:
        """Place an item; the window (number, fill, items) that was closed for it or by it, if any."""
        closed = None
        at = bisect.bisect_left(self.rooms, (size, -1))
        if at < len(self.rooms):
            room, w = self.rooms.pop(at)  # the least room that suffices
        else:
            if len(self.rooms) >= self.limit:
                closed = self._close(0)  # the fullest
            room, w = self.capacity, self.made
            self.made += 1
            self.items[w] = []
        self.items[w].append(item)
        room -= size
        if room:
            bisect.insort(self.rooms, (room, w))
            return closed
        return (w, self.capacity, self.items.pop(w)) if closed is None else self._also(closed, w)

    def _also(self, closed: tuple[int, int, list], w: int) -> tuple[int, int, list]:
        bisect.insort(self.rooms, (0, w))  # full: the next to be closed
        return closed

    def _close(self, at: int) -> tuple[int, int, list]:
        room, w = self.rooms.pop(at)
        return w, self.capacity - room, self.items.pop(w)

    def rest(self) -> Iterator[tuple[int, int, list]]:
        while self.rooms:
            yield self._close(0)


def _pack(path: str, capacity: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, windows = _encoder(path), OpenWindows(capacity, limit)
        base = TaskContext.get().partitionId() << 32
        out: list[tuple] = []

        def emit(closed, left: bool) -> None:
            if closed:
                w, fill, items = closed
                out.extend((base + w, left, fill, *i) for i in items)

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
            cols = list(zip(*out, strict=True)) or [[]] * len(kinds)
            out.clear()
            names = [c.split()[0] for c in _PIECES.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names)

        for whole in batches:
            for b in _slices(whole, "text"):
                for doc, text in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
                    n = len(encoder.encode_ordinary(text)) if text else 0
                    start = piece = 0
                    while n > start:
                        size = min(capacity, n - start)
                        emit(windows.add(size, (doc, piece, start, size)), False)
                        start, piece = start + size, piece + 1
                if len(out) > 20_000:
                    yield batch()
        for closed in windows.rest():
            emit(closed, True)
        yield batch()

    return run


def _merge(capacity: int, limit: int):
    def run(t: pa.Table) -> pa.Table:
        # largest first: every window left over is known here
        rows = sorted(zip(t["fill"].to_pylist(), t["window"].to_pylist(), strict=True), reverse=True)
        windows, pairs = OpenWindows(capacity, max(limit, len(rows))), []
        for fill, w in rows:
            closed = windows.add(fill, w)
            if closed:
                pairs += [(x, closed[2][0]) for x in closed[2]]
        for _, _, items in windows.rest():
            pairs += [(x, items[0]) for x in items]
        return pa.table({"window": pa.array([a for a, _ in pairs], pa.int64()), "merged": pa.array([b for _, b in pairs], pa.int64())})

    return run


def pack(
    df: DataFrame, id_col: str, text_col: str, capacity: int = CAPACITY, tokenizer: str = TOKENIZER,
    open_windows: int = OPEN_WINDOWS, tasks_per_merge: int = TASKS_PER_MERGE,
) -> DataFrame:
    """``container_id, doc_id, piece, token_start, n_tokens``: where each part of each text goes.

    ``piece`` numbers the parts of a divided text from 0.  Texts that are null or empty have
    no tokens and give no row.  Repeated rows are packed like any.  The pieces of the first
    step, a few numbers each, are written to the shared folder, so that texts are tokenized
    once.
    """
    x = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    pieces = written(x.mapInArrow(_pack(tokenizer, capacity, open_windows), _PIECES), "pieces")
    left = pieces.filter("left").select("window", "fill").distinct()
    group = F.shiftright(F.col("window"), 32) / tasks_per_merge
    merged = left.groupBy(F.floor(group).alias("g")).applyInArrow(_merge(capacity, open_windows), "window bigint, merged bigint")
    done = pieces.filter(~F.col("left")).select(F.col("window").alias("container_id"), "doc_id", "piece", "token_start", "n_tokens")
    rest = pieces.filter("left").join(merged, "window").select(F.col("merged").alias("container_id"), "doc_id", "piece", "token_start", "n_tokens")
    return done.unionByName(rest)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens, and the share of their room left unused."""
    fills = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("fill"))
    waste = 1 - F.sum("fill") / (F.count(F.lit(1)) * F.lit(capacity))
    return fills.agg(F.count(F.lit(1)).alias("containers"), F.sum("fill").alias("tokens"), waste.alias("unused"))
