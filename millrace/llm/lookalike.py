"""Problem 10: text that looks the same but differs in its characters.

Method: script-aware repair.  Widths, blanks, hyphens, joined letters, accents and signs
get one form first.  Then the dominant script of each token is determined; in tokens of
mixed scripts the look-alike letters are substituted by their twins of that script, but
only when the result exists in the vocabulary of the corpus.  Two additions complete it:
a token made of look-alikes alone has no script of its own and is read in that of its
document; and a suspect token that the vocabulary does not decide keeps its letters in the
canonical text, while for comparison its shape, one representative per look, is used.

One pass over the texts yields their hashes, the distinct words of each batch and the
suspect tokens; it is written to the shared folder.  Only texts with suspect tokens, a few
percent, meet the vocabulary by a join on the token; the vocabulary is never gathered.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import charforms as cf
from millrace.session import written

#: Letters with the marks that stand on them, which a foreign letter keeps apart from itself.
_TOKEN = re.compile(r"(?:[^\W\d_][\u0300-\u036f]*)+")
_SCRIPTS = (cf.LATIN, cf.CYRILLIC, cf.GREEK)
_NOT_LETTERS = r"[^\p{L}\p{M}]+"
_SLICE_BYTES = 16 << 20


def _signed(v: int) -> tuple[int, int]:
    return (v >> 64) - (1 << 63), (v & (1 << 64) - 1) - (1 << 63)


def hash_pair(text: str) -> tuple[int, int]:
    """128 bits of the text as two signed numbers."""
    return _signed(xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass")))


def suspects(text: str) -> dict[str, list[str]]:
    """Tokens of a text in one form that may hold look-alikes, with their readings in order.

    A token has a reading in a script if substituting twins leaves no letter of another of
    the three scripts.  Readings are ordered by the token's dominant script; if the token
    could be read in several, that of the document comes first.
    """
    tokens = Counter(_TOKEN.findall(text))
    kinds: dict[str, Counter] = {}
    whole: Counter = Counter()
    for t, n in tokens.items():
        k = Counter(s for c in t if (s := cf.script(c)) in _SCRIPTS)
        kinds[t] = k
        for s, m in k.items():
            whole[s] += m * n
    context = whole.most_common(1)[0][0] if whole else cf.LATIN
    out = {}
    for t, k in kinds.items():
        letters = [c for c in ud.normalize("NFD", t) if not ud.combining(c)]
        mixed = len(k) > 1
        alone = len(k) == 1 and context not in k and all(c in cf.TWIN_CHARS for c in letters)
        if not (mixed or alone) or not any(c in cf.TWIN_CHARS for c in letters):
            continue
        readings = []
        for s in _SCRIPTS:
            new = cf.into(t, s)
            if new != t and all(cf.script(c) in (s, cf.OTHER, "") for c in new):
                readings.append((s != context if mixed else False, -k.get(s, 0), new))
        if alone:
            readings = [r for r in readings if cf.script(r[2][0]) == context]
        out[t] = [r[2] for r in sorted(readings)]
    return out


def _slices(b: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of bounded text, so that long texts do not pile up in memory."""
    sizes = pc.fill_null(pc.binary_length(b[column]), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if total + n > _SLICE_BYTES and i > start:
            yield b.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield b.slice(start)


def words_of(texts: pa.Array) -> pa.Array:
    """Distinct lower-case words of a batch of texts."""
    parts = pc.split_pattern_regex(pc.drop_null(texts), _NOT_LETTERS)
    return pc.unique(pc.utf8_lower(pc.unique(pc.list_flatten(parts))))


_SCAN = T.StructType(
    [
        T.StructField("word", T.StringType()), T.StructField("id", T.LongType()), T.StructField("raw_hi", T.LongType()), T.StructField("raw_lo", T.LongType()),
        T.StructField("key_hi", T.LongType()), T.StructField("key_lo", T.LongType()), T.StructField("changed", T.BooleanType()), T.StructField("form", T.StringType()),
        T.StructField("suspects", T.ArrayType(T.StructType([T.StructField("token", T.StringType()), T.StructField("readings", T.ArrayType(T.StringType()))]))),
    ]
)
_SCAN_ARROW = pa.schema(
    [
        ("word", pa.string()), ("id", pa.int64()), ("raw_hi", pa.int64()), ("raw_lo", pa.int64()), ("key_hi", pa.int64()), ("key_lo", pa.int64()), ("changed", pa.bool_()),
        ("form", pa.string()), ("suspects", pa.list_(pa.struct([("token", pa.string()), ("readings", pa.list_(pa.string()))]))),
    ]
)


def _bytes_of(texts: pa.Array) -> Iterator[memoryview]:
    """The bytes of each text where they lie in the Arrow buffer; of a null none."""
    texts = texts.cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
    data = memoryview(texts.buffers()[2] or b"")
    return (data[a:b] for a, b in zip(ends, ends[1:], strict=False))


def _flags(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.fill_null(pc.match_substring_regex(texts, pattern), False).to_numpy(zero_copy_only=False)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in _slices(whole, "text"):
            b = part.filter(pc.is_valid(part["text"]))
            texts, ids = b["text"], b["id"].to_pylist()
            change, foreign = _flags(texts, cf.NEEDS_FORM), _flags(texts, cf.FOREIGN_TWIN)
            raw = [_signed(xxhash.xxh3_128_intdigest(x)) for x in _bytes_of(texts)]
            key, form, tokens = list(raw), [None] * len(raw), [None] * len(raw)
            changed, looked, words = np.zeros(len(raw), bool), np.flatnonzero(change | foreign), []
            for i, text in zip(looked.tolist(), texts.take(pa.array(looked)).to_pylist(), strict=True):
                one = cf.one_form(text) if change[i] else text
                changed[i] = one != text
                found = suspects(one) if foreign[i] or changed[i] else {}
                if found:
                    key[i], form[i] = (None, None), one
                    tokens[i] = [{"token": t, "readings": r} for t, r in found.items()]
                elif changed[i]:
                    key[i] = hash_pair(one)
                # words of suspect tokens are no evidence
                words.append(_TOKEN.sub(lambda m: " " if m[0] in found else m[0], one) if found else one)  # noqa: B023
            plain = texts.filter(pa.array(~(change | foreign))).cast(pa.string())
            vocabulary = words_of(pa.concat_arrays([plain, pa.array(words, pa.string())]))
            n, m = len(raw), len(vocabulary)
            cols = [pa.nulls(n, pa.string()), ids, *zip(*raw, strict=True), *zip(*key, strict=True)] if n else [[]] * 6
            cols = [pa.array(c, f.type) for c, f in zip([*cols, changed, form, tokens], _SCAN_ARROW, strict=True)]
            yield pa.RecordBatch.from_arrays(cols, schema=_SCAN_ARROW)
            yield pa.RecordBatch.from_arrays([vocabulary.cast(pa.string()), *[pa.nulls(m, f.type) for f in list(_SCAN_ARROW)[1:]]], schema=_SCAN_ARROW)


def scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts: rows of words, and a row per non-null text (see the module)."""
    x = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return written(x.mapInArrow(_scan, _SCAN), "lookalike")


def decide(scanned: DataFrame) -> DataFrame:
    """``id, token, repaired``: per text and suspect token its first reading in the vocabulary, else null.

    A reading counts as known if it occurs as a clean word, or as the reading of suspect
    tokens in two texts or more.
    """
    s = scanned.filter(F.col("suspects").isNotNull()).select("id", F.explode("suspects").alias("s"))
    one = s.select("id", F.col("s.token").alias("token"), F.posexplode_outer("s.readings").alias("rank", "reading")).withColumn("word", F.lower("reading"))
    clean = scanned.filter(F.col("word").isNotNull()).select("word").distinct()
    shared = one.filter(F.col("word").isNotNull()).groupBy("word").agg(F.min("id").alias("a"), F.max("id").alias("b")).filter("a < b").select("word")
    known = clean.unionByName(shared).distinct().withColumn("known", F.lit(True))
    j = one.join(known, "word", "left")
    return j.groupBy("id", "token").agg(F.min_by("reading", F.when(F.col("known"), F.col("rank"))).alias("repaired"))


_DONE = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("raw_hi", T.LongType()), ("raw_lo", T.LongType()), ("key_hi", T.LongType()), ("key_lo", T.LongType()), ("canonical", T.StringType()), ("repaired", T.IntegerType()), ("undecided", T.IntegerType()))])


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for r in b.to_pylist():
            fixes = {f["token"]: f["repaired"] for f in r["fixes"]}
            text = _TOKEN.sub(lambda m: fixes.get(m[0]) or m[0], r["form"])  # noqa: B023
            compare = _TOKEN.sub(lambda m: (fixes[m[0]] or cf.shape(m[0])) if m[0] in fixes else m[0], r["form"])  # noqa: B023
            done = sum(v is not None for v in fixes.values())
            rows.append((r["id"], r["raw_hi"], r["raw_lo"], *hash_pair(compare), text, done, len(fixes) - done))
        kinds = [pa.int64()] * 5 + [pa.string(), pa.int32(), pa.int32()]
        cols = list(zip(*rows, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], [f.name for f in _DONE])


def canonical(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per non-null text: ``id, raw_hi, raw_lo, key_hi, key_lo, canonical, repaired, undecided, changed``.

    ``raw`` and ``key`` are 128-bit hashes of the text as written and of its form for
    comparison; texts look the same exactly if their keys are equal.  ``canonical`` is the
    repaired text of texts with suspect tokens, null for others, whose canonical text is
    ``charforms.one_form``.  ``repaired`` and ``undecided`` count distinct suspect tokens.
    Ids are expected to be unique; null texts give no row, empty ones are texts.  The result
    is computed whenever it is read: written first, texts are repaired once.
    """
    s = scan(df, id_col, text_col)
    docs = s.filter(F.col("id").isNotNull())
    plain = docs.filter(F.col("suspects").isNull()).select(
        "id", "raw_hi", "raw_lo", "key_hi", "key_lo", F.lit(None).cast("string").alias("canonical"), F.lit(0).alias("repaired"), F.lit(0).alias("undecided"), "changed"
    )
    fixes = decide(s).groupBy("id").agg(F.collect_list(F.struct("token", "repaired")).alias("fixes"))
    odd = docs.filter(F.col("suspects").isNotNull()).select("id", "raw_hi", "raw_lo", "form")
    done = odd.join(fixes, "id").mapInArrow(_repair, _DONE).withColumn("changed", F.lit(True))
    return plain.unionByName(done)


_LOOK, _SPELLING = ["key_hi", "key_lo"], ["raw_hi", "raw_lo"]
#: Members of a look that meet the others of it in one task at most.
MEMBERS_PER_SLICE = 2_000


def look_classes(keys: DataFrame) -> DataFrame:
    """One row per text whose look has several spellings: ``id, look, spelling, members`` and the hashes.

    ``look`` and ``spelling`` are the smallest id of the texts that look the same, and of
    those that are the same; ``members`` counts the texts of the look.  Counts are made per
    spelling before they are shuffled, so that copies do not gather.
    """
    spellings = keys.groupBy(*_LOOK, *_SPELLING).agg(F.min("id").alias("spelling"), F.count(F.lit(1)).alias("_n"))
    looks = spellings.groupBy(*_LOOK).agg(F.min("spelling").alias("look"), F.sum("_n").alias("members"), F.count(F.lit(1)).alias("_s")).filter("_s > 1").drop("_s")
    classes = spellings.drop("_n").join(looks, _LOOK)
    return keys.select("id", *_LOOK, *_SPELLING).join(classes, [*_LOOK, *_SPELLING]).select("id", "look", "spelling", "members")


def same_look_pairs(classes: DataFrame, members_per_slice: int = MEMBERS_PER_SLICE) -> DataFrame:
    """``doc_id_a, doc_id_b``: texts that look the same and are not the same, of ``look_classes``.

    A look with many members is cut: each slice of it meets all others of the look in tasks
    of its own.  Repeated texts make no pairs with each other.
    """
    slices = F.ceil(F.col("members") / members_per_slice).cast("int")
    left = classes.select(F.col("id").alias("i"), F.col("spelling").alias("a"), "look", F.pmod(F.xxhash64("id"), slices.cast("bigint")).cast("int").alias("slice"))
    right = classes.select(F.col("id").alias("j"), F.col("spelling").alias("b"), "look", F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    x = left.join(right, ["look", "slice"]).filter("i < j and a != b")
    return x.select(F.col("i").alias("doc_id_a"), F.col("j").alias("doc_id_b"))
