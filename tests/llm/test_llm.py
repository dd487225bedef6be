"""Problems 8 to 10 against brute force, and the odd inputs each must bear."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import charforms as cf
from millrace.llm import leakage, lookalike, packing
from millrace.llm.fm_index import FMIndex, suffix_array

# --- 8


def _packed(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    return packing.pack(df, "doc_id", "text", **kw).collect()


def test_every_token_is_placed_once_and_nothing_is_split_in_vain(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice(["alpha", "beta", "gamma"]) for _ in range(rnd.choice([3, 40, 90, 250]))) for _ in range(150)] + [None, "", "a", "a"]
    capacity = 100
    rows = _packed(spark, texts, capacity=capacity, open_windows=4, tasks_per_merge=2)
    enc = packing._encoder(packing.TOKENIZER)
    size = {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    by_doc, by_box = collections.defaultdict(list), collections.Counter()
    for r in rows:
        by_doc[r["doc_id"]].append((r["piece"], r["token_start"], r["n_tokens"]))
        by_box[r["container_id"]] += r["n_tokens"]
    assert max(by_box.values()) <= capacity
    assert set(by_doc) == {i for i, n in size.items() if n}
    for i, pieces in by_doc.items():
        pieces.sort()
        assert [p[0] for p in pieces] == list(range(-(-size[i] // capacity)))
        assert sum(p[2] for p in pieces) == size[i] and [p[1] for p in pieces] == [k * capacity for k in range(len(pieces))]
    assert sum(by_box.values()) / (capacity * len(by_box)) > 0.9


def test_packing_nothing(spark):
    assert _packed(spark, [None, ""]) == []
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(df, "doc_id", "text").count() == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 10), max_size=60), st.integers(1, 4))
def test_open_windows_keep_capacity_and_items(sizes, limit):
    w, out = packing.OpenWindows(10, limit), []
    for i, s in enumerate(sizes):
        if c := w.add(s, (i, s)):
            out.append(c)
        assert len(w.rooms) <= limit + 1
    out += list(w.rest())
    assert sorted(i for *_, items in out for i in items) == list(enumerate(sizes))
    assert all(fill == sum(s for _, s in items) <= 10 for _, fill, items in out)


# --- 9


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=120), st.integers(1, 4))
def test_fm_index_finds_and_locates_all_occurrences(seq, m):
    seq = np.array(seq * 2, np.int64)
    full = np.r_[seq + 1, 0]
    assert suffix_array(full, 3).tolist() == sorted(range(len(full)), key=lambda i: full[i:].tolist())
    fm = FMIndex.build(seq, 4, every=4)
    fm = FMIndex.unpacked(len(seq), 4, *fm.packed())
    patterns = np.random.default_rng(0).integers(1, 5, (8, m))
    lo, hi = fm.search(patterns)
    for p, a, b in zip(patterns, lo, hi, strict=True):
        want = [i for i in range(len(seq) - m + 1) if (seq[i : i + m] == p).all()]
        assert sorted(fm.locate(np.arange(a, b)).tolist()) == want


def _leaks(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    return sorted((r["id"], r["item"], r["first_word"], r["last_word"]) for r in leakage.leaked_spans(d, "doc_id", "text", i, "item_id", "text", **kw).collect())


def test_leaks_whole_partial_and_disguised(spark):
    words = [f"w{i}" for i in range(30)]
    item = " ".join(words)
    docs = [
        (1, "Before, " + item.upper().replace(" ", ",\n") + " after"), (2, "x " + " ".join(words[5:18])), (3, " ".join(words[5:17])), (4, " ".join(words[:12]) + " x " + " ".join(words[12:24])),
        (5, item.replace("w1", "w​1").replace("w2", "ｗ２")), (6, None), (7, ""), (8, " ".join(words[:13]) + " gap " + " ".join(words[13:29])), (1, "Before, " + item), (9, " ".join(words[:13] * 2)),
    ]
    got = _leaks(spark, docs, [(77, item), (78, " ".join(words[2:16])), (79, "too short"), (80, None)])
    assert (1, 77, 1, 30) in got and (2, 77, 1, 13) in got and (5, 77, 0, 29) in got
    assert {(d, i) for d, i, *_ in got} == {(1, 77), (1, 78), (2, 77), (5, 77), (5, 78), (8, 77), (9, 77)}
    assert [x for x in got if x[0] == 8] == [(8, 77, 0, 12), (8, 77, 14, 29)]
    assert [x for x in got if x[0] == 9] == [(9, 77, 0, 25)]  # adjoining spans are one


def test_leaks_match_brute_force_over_small_shards_and_passes(spark):
    rnd = random.Random(4)
    vocabulary = [f"t{i}" for i in range(9)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=12))) for i in range(12)]
    docs = [(i, " ".join(rnd.choices([*vocabulary, "zz"], k=rnd.randrange(0, 60)))) for i in range(80)]
    docs += [(100 + i, "zz " + items[i % 12][1][: rnd.randrange(5, 36)]) for i in range(30)]
    n, want = 4, set()
    for d, t in docs:
        w = t.split()
        for i, x in items:
            v = x.split()
            if any(w[a : a + n] == v[b : b + n] for a in range(len(w) - n + 1) for b in range(len(v) - n + 1)):
                want.add((d, i))
    got = {(d, i) for d, i, *_ in _leaks(spark, docs, items, min_words=n, shard_words=50, items_per_pass=5)}
    assert got == want and want


def test_leaks_in_other_scripts_in_either_case(spark):
    ru = "вода в насосе остаётся холодной а корпус и вал машины стоят на месте весь день у дома"
    gr = "το νερό στην αντλία μένει κρύο και ο άξονας της μηχανής είναι σταθερός όλη τη μέρα εδώ"
    de = "Die Größe der Straße und das Maß der Füße bleiben stets außen gleich groß bis zum Schluß der Messung"
    for item in (ru, gr, de):
        docs = [(1, item), (2, "before " + item.upper() + " after"), (3, item.title()), (4, item.translate({ord(t): a for a, ts in cf.TWINS.items() for t in ts})), (5, item.upper().translate({ord(t): a for a, ts in cf.TWINS.items() for t in ts}))]
        assert {d for d, *_ in _leaks(spark, docs, [(7, item)])} == {1, 2, 3, 4, 5}
        assert {d for d, *_ in _leaks(spark, docs[:1], [(7, item.upper())])} == {1}


def test_case_and_shape_are_folded_for_every_twin():
    same = lambda *c: len(set(leakage.folded(pa.array(c)).to_pylist())) == 1
    for a, twins in cf.TWINS.items():
        for t in twins:
            assert same(a, t), (a, t)
            if t not in cf._PALOCHKA:  # its small form looks like another letter than its capital
                assert same(a, a.lower(), a.upper(), t.lower(), t.upper()), (a, t)
    greek = [chr(o) for o in range(0x391, 0x3CA) if chr(o).isalpha()]
    assert all(same(c, c.lower(), c.upper()) for c in greek + [chr(o) for o in range(0x410, 0x450)])
    assert not same("o", "e") and not same("é", "e") and same("É", "é", "É") and same("ё", "Ё", "Ë")


def test_an_index_is_searched_for_any_items(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    docs = spark.createDataFrame([(i, " ".join(words[i : i + 20])) for i in range(20)], "doc_id bigint, text string")
    leakage.build_index(docs, "doc_id", "text", shard_words=60).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    for lo in (0, 7, 25):
        items = spark.createDataFrame([(lo, " ".join(words[lo : lo + 14]))], "item_id bigint, text string")
        for bound in (1 << 20, 10):
            got = {r["id"] for r in leakage.search_index(index, items, "item_id", "text", bytes_per_pass=bound).collect()}
            assert got == {i for i in range(20) if min(i + 20, lo + 14) - max(i, lo) >= 13}


def test_nothing_to_search(spark):
    assert _leaks(spark, [], [(1, "a b c")], min_words=2) == []
    assert _leaks(spark, [(1, "a b c")], [], min_words=2) == []


# --- 10


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("Ｈｅｌｌｏ１", "Hello1", True), ("a b", "a b", True), ("re­sult", "result", True), ("ﬁnal", "final", True), ("café", "café", True), ("5 µm", "5 μm", True), ("3 K", "3 K", True),
        ("co‑op", "co-op", True), ("a​b", "ab", True), ("10 mm", "10 mm", True), ("２ kΩ", "2 kΩ", True), ("ｶﾞ", "ガ", True),
        ("mm²", "mm2", False), ("cafe", "café", False), ("Final", "final", False), ("a.b", "a;b", False), ("ab", "a b", False), ("a\nb", "a b", False), ("“a”", '"a"', False), ("a—b", "a-b", False),
    ],
)
def test_forms(a, b, same):
    assert (cf.one_form(a) == cf.one_form(b)) is same


def test_rules_hold_for_every_character_that_needs_form():
    flagged = pa.array([chr(o) for o in range(0x20, 0x3000) if not 0xD800 <= o < 0xE000])
    hit = pa.compute.match_substring_regex(flagged, cf.NEEDS_FORM).to_pylist()
    assert [c for c, h in zip(flagged.to_pylist(), hit, strict=True) if not h and cf.one_form(c) != c] == []


def test_suspect_tokens_and_their_readings():
    found = lookalike.suspects("the pаce of μm and Ωm")
    assert found["pаce"][0] == "pace" and found.get("μm", []) == [] and "the" not in found
    assert lookalike.suspects("plain words only") == {}
    russian = "машина и сосна стоит на горе"
    assert lookalike.suspects(russian) == {}
    assert lookalike.suspects(russian.replace("сосна", "cосна"))["cосна"] == ["сосна"]
    assert lookalike.suspects("some English words and А alone")["А"] == ["A"]


def _pairs(spark, docs):
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    rows = lookalike.canonical(df, "doc_id", "text").collect()
    got = {(r["doc_id_a"], r["doc_id_b"]) for r in lookalike.same_look_pairs(lookalike.look_classes(lookalike.canonical(df, "doc_id", "text")), members_per_slice=3).collect()}
    return {r["id"]: r for r in rows}, got


def test_pairs_that_look_the_same(spark):
    ru = "Насос стоит на машине, и вода течёт в корпус"
    docs = [
        (1, "The valve opens a port"), (2, "The vаlve opens a port"), (3, "The valve opens а port"), (4, "the valve opens a port"), (5, "The valve opens a port"),
        (6, ru), (7, ru.replace("стоит", "cтоит")), (8, "Zоrblax uniquе"), (9, "Zorblаx unique"), (10, None), (11, ""), (12, "​"), (13, "5 μm"), (14, "5 µm"), (15, "mm²"), (16, "mm2"),
    ]
    rows, got = _pairs(spark, docs)
    assert got == {(1, 2), (1, 3), (2, 3), (2, 5), (3, 5), (6, 7), (8, 9), (11, 12), (13, 14)}
    assert rows[2]["canonical"] == "The valve opens a port" and rows[3]["canonical"] == "The valve opens a port" and rows[7]["canonical"] == ru
    assert 10 not in rows and rows[1]["changed"] is False and rows[2]["repaired"] == 1
    assert rows[8]["canonical"] == "Zorblax unique"  # known from two texts


def test_words_not_in_the_vocabulary_stay_but_compare_by_shape(spark):
    rows, got = _pairs(spark, [(1, "qwхq stands alone in here"), (2, "nothing else")])
    assert got == set() and rows[1]["undecided"] == 1 and rows[1]["canonical"] == "qwхq stands alone in here"


def test_pairs_of_random_disguises_match_brute_force(spark):
    rnd = random.Random(9)
    base = ["The copper spacer keeps a close eye on some axis", "Die Spaltposition bleibt ohne Spiel exakt", "Вода в насосе остаётся холодной", "Rare peace"]
    swap = {a: ts[0] for a, ts in cf.TWINS.items()} | {t: a for a, ts in cf.TWINS.items() for t in ts}
    docs = []
    for i in range(120):
        t = "".join(swap[c] if c in swap and rnd.random() < 0.1 else c + "‍" * (rnd.random() < 0.03) for c in rnd.choice(base))
        docs.append((i, t))
    docs += [(200 + i, b) for i, b in enumerate(base)]
    want = set()
    for a, x in docs:
        for b, y in docs:
            if a < b and x != y and cf.shape(cf.one_form(x)) == cf.shape(cf.one_form(y)):
                want.add((a, b))
    _, got = _pairs(spark, docs)
    assert got <= want
    assert len(got) / len(want) > 0.97, sorted(want - got)[:5]


def test_no_texts(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert lookalike.same_look_pairs(lookalike.look_classes(lookalike.canonical(df, "doc_id", "text"))).count() == 0


def test_classes_of_looks(spark):
    docs = [(1, "same"), (2, "sаme"), (3, "same"), (4, "sаme"), (5, "other"), (6, "other")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    rows = lookalike.look_classes(lookalike.canonical(df, "doc_id", "text")).collect()
    assert sorted(tuple(r) for r in rows) == [(1, 1, 1, 4), (2, 1, 2, 4), (3, 1, 1, 4), (4, 1, 2, 4)]
