"""Problem 9: evaluation texts leaking into training text.

Method: an FM-index per shard of the corpus.  The shard's words become one sequence of
numbers; test phrases are searched backwards through the ranks of a wavelet tree, all
phrases at once; occurrences are located by sampled suffix positions; overlapping
occurrences merge into spans to be removed.

The index knows nothing of the test set: its alphabet is the shard's own vocabulary.
``build_index`` gives it as rows, a shard each, that can be kept; ``search_index`` asks it for
any set of items, as often as there are sets.  Shards are runs of an input partition with a
bounded number of words, so nothing is shuffled, and every occurrence lies within a document
and therefore within a shard.  Before they are compared, words get one form (problem 10),
and letters the representative of all that differ from them in case or shape alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import charforms as cf
from millrace.llm.fm_index import FMIndex
from millrace.llm.lookalike import _slices
from millrace.session import written

MIN_WORDS = 13
SHARD_WORDS = 1_500_000
#: Test items searched in one pass over the index, by number and by their text; a larger set takes several passes.
ITEMS_PER_PASS = 20_000
ITEM_BYTES_PER_PASS = 32 << 20
_BETWEEN = r"[^\p{L}\p{N}]+"


def folded(texts: pa.Array) -> pa.Array:
    """Texts in the form in which their words are compared."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    for change, pattern in ((cf.one_form, cf.NEEDS_FORM), (cf.fold_shape, cf.ODD_CASE)):
        odd = pc.match_substring_regex(texts, pattern)
        if pc.any(odd).as_py():
            texts = pc.replace_with_mask(texts, odd, pa.array([change(t) for t in texts.filter(odd).to_pylist()], pa.string()))
    texts = pc.utf8_lower(texts)
    for letter, instead in cf.COMMON.items():
        texts = pc.replace_substring(texts, letter, instead)
    return texts


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and where each text's words begin (one more than texts)."""
    parts = pc.split_pattern_regex(pc.utf8_trim(folded(texts), " \n\t"), _BETWEEN)
    flat, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not real.all():  # punctuation at either end leaves empty pieces
        flat = flat.filter(pa.array(real))
        offsets = np.r_[0, np.cumsum(real)][offsets]
    return flat, offsets


class Phrases:
    """All runs of ``min_words`` words of the test items, as numbers of their vocabulary."""

    def __init__(self, items: list[tuple[int, str]], min_words: int) -> None:
        flat, offsets = words(pa.array([t for _, t in items], pa.string()))
        self.vocabulary = pc.unique(flat)
        ids = pc.index_in(flat, self.vocabulary).to_numpy(zero_copy_only=False).astype(np.int64)
        rows, owner = [], []
        for i, (item, _) in enumerate(items):
            own = ids[offsets[i] : offsets[i + 1]]
            if len(own) >= min_words:
                rows.append(np.lib.stride_tricks.sliding_window_view(own, min_words))
                owner.append(np.full(len(own) - min_words + 1, item, np.int64))
        rows = np.concatenate(rows) if rows else np.zeros((0, min_words), np.int64)
        owner = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        self.patterns, which = np.unique(rows, axis=0, return_inverse=True) if len(rows) else (rows, owner)
        order = np.argsort(which, kind="stable")
        self.owners = owner[order]
        self.owner_at = np.r_[0, np.cumsum(np.bincount(which, minlength=len(self.patterns)))].astype(np.int64)
        self.min_words = min_words


INDEX = "words bigint, tree binary, top int, marks binary, kept binary, vocabulary binary, doc_id binary, starts binary"
_INDEX_ARROW = pa.schema([("words", pa.int64()), ("tree", pa.binary()), ("top", pa.int32()), *((c, pa.binary()) for c in ("marks", "kept", "vocabulary", "doc_id", "starts"))])


def _packed_words(vocabulary: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("w", pa.string())])) as w:
        w.write_batch(pa.record_batch([vocabulary.cast(pa.string())], ["w"]))
    return sink.getvalue().to_pybytes()


def _shard(flat: list[pa.Array], docs: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    """The index row of one shard: words of its documents, each preceded by a separator."""
    codes = pa.chunked_array(flat).combine_chunks().dictionary_encode()
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    n = np.concatenate(counts)
    begin = np.r_[0, np.cumsum(n)[:-1]]
    seq = np.insert(codes.indices.to_numpy().astype(np.int64) + 1, begin, 0)
    starts = begin + np.arange(len(n)) + 1  # of the documents' first words in the sequence
    index = FMIndex.build(seq, len(codes.dictionary))
    tree, marks, kept = index.packed()
    row = [[len(codes)], [tree], [len(codes.dictionary)], [marks], [kept], [_packed_words(codes.dictionary)], [np.concatenate(docs).tobytes()], [starts.astype(np.int32).tobytes()]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _INDEX_ARROW, strict=True)], schema=_INDEX_ARROW)


def _indexer(shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat, docs, counts, total = [], [], [], 0
        for whole in batches:
            for b in _slices(whole, "text"):
                w, offsets = words(b["text"])
                n = np.diff(offsets)
                flat.append(w.cast(pa.string()))
                docs.append(b["id"].to_numpy()[n > 0])  # texts without words have no place in the sequence
                counts.append(n[n > 0])
                total += len(w)
                if total >= shard_words:
                    yield _shard(flat, docs, counts)
                    flat, docs, counts, total = [], [], [], 0
        if total:
            yield _shard(flat, docs, counts)

    return run


def build_index(docs: DataFrame, id_col: str, text_col: str, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The FM-index of a corpus, a row per shard (``INDEX``); to be written by the caller, for any number of searches.

    Null and empty texts and null ids are not part of it.  A text is never cut, so that one
    very long text makes a larger shard.
    """
    x = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return x.mapInArrow(_indexer(shard_words), INDEX)


def _spans(row: dict, phrases: Phrases) -> pa.RecordBatch:
    """Merged spans ``id, item, first_word, last_word`` of one shard."""
    vocabulary = pa.ipc.open_stream(row["vocabulary"]).read_all()["w"].combine_chunks()
    known = pc.fill_null(pc.index_in(phrases.vocabulary, vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    patterns = known[phrases.patterns]
    # a phrase with a word that the shard does not have does not occur in it
    may = np.flatnonzero((patterns > 0).all(1))
    doc_id, starts = np.frombuffer(row["doc_id"], np.int64), np.frombuffer(row["starts"], np.int32).astype(np.int64)
    if not len(may):
        return _span_batch([np.zeros(0, np.int64)] * 4)
    index = FMIndex.unpacked(row["words"] + len(doc_id), row["top"], row["tree"], row["marks"], row["kept"])
    lo, hi = index.search(patterns[may])
    n = hi - lo
    hit = np.flatnonzero(n)
    rows = np.repeat(lo[hit] - np.r_[0, np.cumsum(n[hit])[:-1]], n[hit]) + np.arange(n[hit].sum())
    at, which = index.locate(rows), may[np.repeat(hit, n[hit])]
    # a phrase can belong to several items
    reps = phrases.owner_at[which + 1] - phrases.owner_at[which]
    item = phrases.owners[np.repeat(phrases.owner_at[which] - np.r_[0, np.cumsum(reps)[:-1]], reps) + np.arange(reps.sum())] if len(which) else np.zeros(0, np.int64)
    at = np.repeat(at, reps)
    d = np.searchsorted(starts, at, side="right") - 1
    order = np.lexsort((at, item, d))
    d, item, at = d[order], item[order], at[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (at[1:] > at[:-1] + phrases.min_words)] if len(d) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    last = np.r_[first[1:] - 1, len(d) - 1].astype(np.int64) if len(first) else first
    return _span_batch([doc_id[d[first]], item[first], at[first] - starts[d[first]], at[last] - starts[d[first]] + phrases.min_words - 1])


def _span_batch(cols: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["id", "item", "first_word", "last_word"])


def _searcher(items, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(items.value, min_words)
        for b in batches:
            for i in range(b.num_rows if len(phrases.patterns) else 0):
                yield _spans(b.slice(i, 1).to_pylist()[0], phrases)

    return run


def search_index(
    index: DataFrame, items: DataFrame, item_id: str, item_text: str, min_words: int = MIN_WORDS,
    items_per_pass: int = ITEMS_PER_PASS, bytes_per_pass: int = ITEM_BYTES_PER_PASS,
) -> DataFrame:
    """``id, item, first_word, last_word``: spans of indexed documents that hold text of the items.

    Items are broadcast in blocks bounded by number and by bytes (an item that is larger by
    itself is a block), each searched in a pass over the index.
    """
    t = items.filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("bigint").alias("i"), F.col(item_text).cast("string").alias("t"))
    n = t.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()
    passes = max(1, -(-n["n"] // items_per_pass), -(-n["b"] // bytes_per_pass))
    out = None
    for p in range(passes):
        block = t if passes == 1 else t.filter(F.pmod(F.xxhash64("i"), F.lit(passes)) == p)
        rows = [(r["i"], r["t"]) for r in block.collect()]  # a block, up to the evenness of the hash
        items_there = index.sparkSession.sparkContext.broadcast(rows)
        found = index.mapInArrow(_searcher(items_there, min_words), "id bigint, item bigint, first_word bigint, last_word bigint")
        out = found if out is None else out.unionByName(found)
    return out


def leaked_spans(
    docs: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str,
    min_words: int = MIN_WORDS, shard_words: int = SHARD_WORDS, items_per_pass: int = ITEMS_PER_PASS,
) -> DataFrame:
    """``id, item, first_word, last_word``: spans of documents that hold test text.

    A span is a longest run of words, numbered from 0 within the document, covered by
    occurrences of ``min_words`` consecutive words of one item.  Items shorter than that
    cannot occur; null and empty texts hold no words.  Repeated documents are each
    reported.  The index is written to the shared folder and searched there.
    """
    index = written(build_index(docs, id_col, text_col, shard_words), "fm-index")
    return search_index(index, items, item_id, item_text, min_words, items_per_pass)
