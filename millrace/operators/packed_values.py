"""Problem 2: several values packed in one field.

Method: a finite-state tokenizer that tracks quoting, escapes and nesting depth and emits
values with ordinals at delimiters outside quotes.

The automaton runs on all distinct texts of an Arrow batch at once: one step takes the
i-th character of every text still running, as vectors of states, depths and marks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Characters with a role in packed fields.
DELIMITERS = "|,;/\t\n\r｜，；／、،؛"
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "＂": "＂", "`": "`"}
BRACKETS = {"[": "]", "(": ")", "{": "}", "<": ">", "【": "】", "［": "］", "（": "）"}
ESCAPE = "\\"

# states
_START, _PLAIN, _QUOTED, _ESCAPED, _CLOSED = range(5)
_CELLS = 4_000_000  # characters of a batch that run together, padding included


def _strip_brackets(s: str) -> tuple[str, int]:
    """The text inside brackets that enclose the whole field, and how many pairs there were."""
    depth = 0
    while True:
        s = s.strip()
        close = BRACKETS.get(s[:1])
        if not close or not s.endswith(close) or len(s) < 2 or _closes_at(s, s[0], close) != len(s) - 1:
            return s, depth
        s, depth = s[1:-1], depth + 1


def _closes_at(s: str, opening: str, close: str) -> int:
    """Where the bracket that opens ``s`` closes, quotes skipped; -1 if nowhere."""
    depth, quote, i, fresh = 0, "", 0, True
    while i < len(s):
        c = s[i]
        if quote:
            if c == ESCAPE:
                i += 1
            elif c == quote:
                quote = ""
        elif fresh and c in QUOTES:
            quote, fresh = QUOTES[c], False
        elif c == opening:
            depth, fresh = depth + 1, True
        elif c == close:
            depth -= 1
            if not depth:
                return i
        elif c in DELIMITERS:
            fresh = True
        elif not c.isspace():
            fresh = False
        i += 1
    return -1


def tokenize(texts: list[str], nested: bool = True) -> list[list[str]]:
    """The values of each text, in order.

    A quotation mark opens only where a value begins, and closes only where nothing but
    blanks stand between it and the next delimiter or the end; doubled or escaped marks
    inside are one mark.  A mark that never closes that way is an ordinary character.
    With ``nested``, delimiters inside brackets within a value do not count either; brackets
    that have no partner are ordinary characters.
    """
    out: list[list[str]] = [[] for _ in texts]
    inner = [_strip_brackets(t)[0] for t in texts]
    order = sorted(range(len(inner)), key=lambda i: len(inner[i]))  # texts of one length run together
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(inner[order[end]]) <= _CELLS:
            end += 1
        _run([inner[i] for i in order[at:end]], order[at:end], out, nested)
        at = end
    return out


def _unpaired(text: str, at: list[int]) -> list[int]:
    """Of the brackets at the given places those without a partner of their kind."""
    open_at: list[int] = []
    alone = []
    for i in at:
        if text[i] in BRACKETS:
            open_at.append(i)
        elif open_at and BRACKETS[text[open_at[-1]]] == text[i]:
            open_at.pop()
        else:
            alone.append(i)
    return alone + open_at


def _run(texts: list[str], where: list[int], out: list[list[str]], nested: bool, ignored: np.ndarray | None = None) -> None:
    """Values of the texts to their places in ``out``; ``ignored`` marks brackets that are ordinary characters."""
    n, width = len(texts), max(map(len, texts), default=0)
    if not width:
        return
    flat = np.frombuffer("".join(t.ljust(width, "\0") for t in texts).encode("utf-32-le"), np.uint32).reshape(n, width)
    length = np.array([len(t) for t in texts])
    is_delim = np.isin(flat, [ord(c) for c in DELIMITERS])
    is_blank = np.isin(flat, [ord(c) for c in "  　    \t\n\r\v\f"]) & ~is_delim
    closer = np.zeros_like(flat)
    for a, b in QUOTES.items():
        closer[flat == ord(a)] = ord(b)
    opens = np.isin(flat, [ord(c) for c in BRACKETS])
    shuts = np.isin(flat, [ord(c) for c in BRACKETS.values()])
    if ignored is not None:
        opens, shuts = opens & ~ignored[:, :width], shuts & ~ignored[:, :width]
    inside = np.arange(width)[None, :] < length[:, None]
    plain = np.zeros((n, width), bool)  # characters outside quotes
    # the next character that is no blank: a mark closes a value only before a delimiter or the end
    ends = np.ones((n, width + 1), bool)
    for i in range(width - 1, -1, -1):
        ends[:, i] = ~inside[:, i] | is_delim[:, i] | (is_blank[:, i] & ends[:, i + 1])
    doubled_later = np.zeros((n, width), bool)
    doubled_later[:, :-1] = flat[:, 1:] == flat[:, :-1]
    # whether a mark opened at i can close at all
    last_close: dict[int, np.ndarray] = {}
    for b in {ord(b) for b in QUOTES.values()}:
        ok = (flat == b) & ends[:, 1:]
        far = np.where(ok, np.arange(width)[None, :], -1).max(1)
        last_close[b] = far
    state = np.zeros(n, np.int8)
    quote = np.zeros(n, np.uint32)
    depth = np.zeros(n, np.int32)
    skip = np.zeros(n, bool)
    keep = np.zeros((n, width), bool)  # characters that belong to a value
    cut = np.zeros((n, width), bool)  # delimiters that count
    for i in range(width):
        c, live = flat[:, i], inside[:, i]
        skipped = skip & live
        skip[:] = False
        go = live & ~skipped
        q = go & (state == _QUOTED)
        esc = go & (state == _ESCAPED)
        keep[:, i] |= esc
        state[esc] = _QUOTED
        nxt = flat[:, i + 1] if i + 1 < width else np.zeros(n, np.uint32)
        special = (nxt == quote) | (nxt == ord(ESCAPE))
        to_esc = q & (c == ord(ESCAPE)) & special
        state[to_esc] = _ESCAPED
        mark = q & (c == quote) & ~to_esc
        twice = mark & doubled_later[:, i] & inside[:, min(i + 1, width - 1)]
        keep[:, i] |= twice
        skip |= twice
        close = mark & ~twice & ends[:, i + 1]
        state[close] = _CLOSED
        keep[:, i] |= (q & ~to_esc & ~mark) | (mark & ~twice & ~close)
        free = go & ((state == _START) | (state == _PLAIN) | (state == _CLOSED)) & ~q & ~esc
        starts = free & (state == _START) & (closer[:, i] != 0)
        if starts.any():
            can = np.zeros(n, bool)
            for b, far in last_close.items():
                can |= (closer[:, i] == b) & (far > i)
            starts &= can
            quote[starts] = closer[starts, i]
            state[starts] = _QUOTED
        rest = plain[:, i] = free & ~starts
        depth += rest & opens[:, i]
        depth -= rest & shuts[:, i] & (depth > 0)
        stop = rest & is_delim[:, i]
        if nested:
            stop &= depth == 0
        cut[:, i] |= stop
        depth[stop] = 0
        state[stop] = _START
        text = rest & ~stop & ~is_blank[:, i]
        state[text & (state == _START)] = _PLAIN
        keep[:, i] |= rest & ~stop
    again, off = [], np.zeros((n, width), bool) if ignored is None else ignored[:, :width].copy()
    if nested:
        brackets = plain & (opens | shuts)
        for r in np.flatnonzero(brackets.any(1)).tolist():
            if alone := _unpaired(texts[r], np.flatnonzero(brackets[r]).tolist()):
                off[r, alone] = True
                again.append(r)
    for r in sorted(set(range(n)) - set(again)):
        s, k = texts[r], keep[r]
        values, start = out[where[r]], 0
        for e in [*np.flatnonzero(cut[r]).tolist(), len(s)]:
            v = "".join(ch for ch, y in zip(s[start:e], k[start:e], strict=True) if y).strip()
            if v:
                values.append(v)
            start = e + 1
    if again:  # a bracket fewer each time
        _run([texts[r] for r in again], [where[r] for r in again], out, nested, off[again])


def _split(column: pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    codes = pc.dictionary_encode(column)
    words = [w for w in codes.dictionary.to_pylist()]
    values = pa.array(tokenize(words) if words else [], pa.list_(pa.string()))
    return values.take(codes.indices)


def split_packed(df: DataFrame, col: str, pos: str = "pos", value: str = "value", keep: list[str] | None = None) -> DataFrame:
    """One row per value of ``col`` with its position from 1.

    Null, empty and blank fields and those of delimiters only give no row.  Pieces without
    text take no position.  ``keep`` names the columns to carry along, by default all but
    ``col``; those named like ``pos`` or ``value`` give way to the operator's.  Length is
    unbounded: texts are processed in groups of like length.
    """
    own = {pos.lower(), value.lower()}
    cols = [c for c in (keep if keep is not None else df.columns) if c.lower() not in own and (keep is not None or c != col)]

    def split(c: pa.Array) -> pa.Array:
        return _split(c)

    x = df.select(*cols, F.arrow_udf(split, T.ArrayType(T.StringType()))(F.col(col).cast("string")).alias("_mr_values"))
    return x.select(*cols, F.posexplode("_mr_values").alias("_mr_p", value)).select(*cols, (F.col("_mr_p") + 1).alias(pos), value)
