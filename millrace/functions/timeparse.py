"""Timestamp text to wall-clock readings, a batch at a time on Arrow arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAY_US = 86_400_000_000

#: Readings that can compete for one text.  Other texts have one reading, "plain".
READINGS = ["MDY", "DMY", "YMD", "packed", "epoch", "plain"]
#: Years in which an event of the data can lie; readings outside keep a small likelihood.
PLAUSIBLE = (1990, 2100)

# Offsets in minutes of the zone abbreviations that are accepted.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120,
    "EEST": 180, "MSK": 180, "IST": 330, "JST": 540, "KST": 540, "AWST": 480, "ACST": 570, "ACDT": 630,
    "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "BRT": -180, "BRST": -120, "ART": -180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "AKST": -540, "AKDT": -480, "HST": -600,
}
# English month names by their first three letters.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|"
    "nov(?:ember)?|dec(?:ember)?"
)
_WEEKDAY = r"(?:(?:mon(?:day)?|tues?(?:day)?|wed(?:nesday)?|thu(?:rs)?(?:day)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?),?[ ]+)?"
_TIME = r"(?:(?:[ T]|, ?)[ ]*(?P<hh>\d{1,2}):(?P<mi>\d{2})(?::(?P<ss>\d{2})(?:[.,](?P<frac>\d{1,9}))?)?[ ]*(?:(?P<half>[ap])\.?m\.?)?)?"
_ZONE = r"[ ]*(?P<zone>[a-z]{1,5}|[+-]\d{1,2}(?::?\d{2})?)?[ ]*(?:\[(?P<region>[a-z_]+(?:/[a-z0-9_+-]+)*)\])?"


def _whole(date: str, time: str = _TIME) -> str:
    return rf"(?i)^{date}{time}{_ZONE}$"


#: One pattern per way of writing, tried in this order on what the ones before left.
_WRITTEN = [
    _whole(r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})"),
    _whole(r"(?P<s1>\d{1,4})/(?P<s2>\d{1,2})/(?P<s3>\d{1,4})"),
    _whole(r"(?P<d>\d{1,2})\.(?P<m>\d{1,2})\.(?P<y>\d{4}|\d{2})"),
    _whole(rf"{_WEEKDAY}(?P<d>\d{{1,2}})[ -](?P<name>{_MONTH})\.?,?[ -](?P<y>\d{{4}}|\d{{2}})"),
    _whole(rf"{_WEEKDAY}(?P<name>{_MONTH})\.? (?P<d>\d{{1,2}}),? (?P<y>\d{{4}})"),
    _whole(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})", r"T(?P<hh>\d{2})(?P<mi>\d{2})(?:(?P<ss>\d{2})(?:[.,](?P<frac>\d{1,9}))?)?"),
]
#: What the batch parser gives for each text.
_FIELDS = {c: T.LongType() for c in ("plain", "mdy", "dmy", "ymd", "packed", "epoch")}
SCHEMA = T.StructType(
    [T.StructField("sig", T.IntegerType()), *(T.StructField(c, t) for c, t in _FIELDS.items())]
    + [T.StructField("timed", T.BooleanType()), T.StructField("dated", T.BooleanType()), T.StructField("off", T.IntegerType()), T.StructField("region", T.StringType())]
)
NONE = np.iinfo(np.int64).min


def _num(x: pa.Array) -> np.ndarray:
    """Digits as numbers, -1 where there are none."""
    return pc.cast(pc.if_else(pc.equal(x, ""), "-1", x), pa.int64()).to_numpy(zero_copy_only=False)


def days_in_month(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    table = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])
    return table[np.clip(m, 0, 12)] + (leap & (m == 2))


def day_number(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970 of dates of the Gregorian calendar, NONE where the three aren't one."""
    ok = (y >= 1) & (y <= 9999) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= days_in_month(y, m))
    months = (np.where(ok, y, 1970) - 1970) * 12 + np.where(ok, m, 1) - 1
    days = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) + d - 1
    return np.where(ok, days, NONE)


def _wall(day: np.ndarray, h: np.ndarray, mi: np.ndarray, s: np.ndarray, us: np.ndarray) -> np.ndarray:
    ok = (day != NONE) & (h >= 0) & (h < 24) & (mi >= 0) & (mi < 60) & (s >= 0) & (s < 60)
    return np.where(ok, np.where(ok, day, 0) * DAY_US + ((h * 60 + mi) * 60 + s) * 1_000_000 + us, NONE)


def _year(x: pa.Array) -> np.ndarray:
    """Years of two digits are 20xx; of one or three there are none."""
    n, v = pc.utf8_length(x).to_numpy(zero_copy_only=False), _num(x)
    return np.where(n == 4, v, np.where(n == 2, v + 2000, -1))


def _two(x: pa.Array) -> np.ndarray:
    return np.where(pc.utf8_length(x).to_numpy(zero_copy_only=False) <= 2, _num(x), -1)


def _offset(zone: str) -> int | None:
    z = zone.upper()
    if z[0] in "+-":
        d = z[1:].replace(":", "")
        h, m = (int(d), 0) if len(d) <= 2 else (int(d[:-2]), int(d[-2:]))
        return (h * 60 + m) * (-1 if z[0] == "-" else 1) if h <= 18 and m < 60 else None
    return ABBREVIATIONS.get(z)


def _digits(s: pa.Array, out: dict[str, np.ndarray], at: np.ndarray) -> None:
    n = pc.utf8_length(s).to_numpy(zero_copy_only=False).astype(np.int64)
    v = pc.cast(pc.utf8_slice_codeunits(s, 0, 18), pa.int64()).to_numpy(zero_copy_only=False)  # all but the ns of a nanosecond count

    def cut(a: int, k: int) -> np.ndarray:
        return np.where(n >= a + k, v // 10 ** np.maximum(np.minimum(n, 18) - a - k, 0) % 10**k, 0)

    y = cut(0, 4)
    day = day_number(y, cut(4, 2), cut(6, 2))
    packed = _wall(day, cut(8, 2), cut(10, 2), cut(12, 2), cut(14, 3) * 1000)
    out["packed"][at] = np.where(np.isin(n, (8, 12, 14, 17)) & (y >= 1900) & (y < 2200), packed, NONE)
    epoch = np.full(len(v), NONE)
    for lo, hi, num, den in ((9, 10, 1_000_000, 1), (12, 13, 1000, 1), (15, 16, 1, 1), (18, 18, 1, 1000), (19, 19, 1, 100)):
        k = (n >= lo) & (n <= hi)
        epoch[k] = v[k] // den * num
    out["epoch"][at] = epoch
    out["dated"][at] = n == 8
    out["timed"][at] = n != 8


def parse(texts: pa.Array) -> pa.Array:
    """Every reading of each text as a wall clock in microseconds, and the set of readings.

    ``sig`` is a bit set over READINGS in the low bits, and of those whose value isn't
    plausible in the bits above; 0 where the text is null or no real date or time.
    """
    n = len(texts)
    codes = pc.dictionary_encode(pc.utf8_trim_whitespace(texts.cast(pa.string())))
    if isinstance(codes, pa.ChunkedArray):
        codes = codes.combine_chunks()
    words, index = codes.dictionary, codes.indices
    k = len(words)
    one = {c: np.full(k, NONE) for c in ("plain", "mdy", "dmy", "ymd", "packed", "epoch")} | {"timed": np.zeros(k, bool), "dated": np.zeros(k, bool)}
    w_off, w_region = np.full(k, NONE), np.full(k, None, object)
    bad_zone = np.zeros(k, bool)
    number = pc.match_substring_regex(words, r"^\d{8,19}$").to_numpy(zero_copy_only=False)
    at = np.flatnonzero(number)
    if len(at):
        _digits(words.take(pa.array(at)), one, at)
    left = np.flatnonzero(~number)
    for pattern in _WRITTEN:
        if not len(left):
            break
        got = pc.extract_regex(words.take(pa.array(left)), pattern)
        hit = got.is_valid().to_numpy(zero_copy_only=False)
        at, left = left[hit], left[~hit]
        if not len(at):
            continue
        g = got.filter(pa.array(hit))
        names = [f.name for f in g.type]
        f = lambda c: g.field(names.index(c))  # noqa: B023, E731
        zero = lambda c: np.maximum(_num(f(c)), 0)  # noqa: B023, E731
        timed = pc.not_equal(f("hh"), "").to_numpy(zero_copy_only=False)
        h = zero("hh")
        if "half" in names:
            half = pc.utf8_lower(f("half"))
            pm, am = (pc.equal(half, c).to_numpy(zero_copy_only=False) for c in "pa")
            h = np.where(pm | am, np.where((h >= 1) & (h <= 12), h % 12 + 12 * pm, -1), h)
        us = _num(pc.utf8_slice_codeunits(pc.utf8_rpad(f("frac"), 6, "0"), 0, 6))
        clock = (h, zero("mi"), zero("ss"), us)
        if "s1" in names:
            s = {i: f(f"s{i}") for i in (1, 2, 3)}
            for order, c in (("MDY", "mdy"), ("DMY", "dmy"), ("YMD", "ymd")):
                p = {u: s[i + 1] for i, u in enumerate(order)}
                one[c][at] = _wall(day_number(_year(p["Y"]), _two(p["M"]), _two(p["D"])), *clock)
        else:
            if "name" in names:
                low = pc.utf8_slice_codeunits(pc.utf8_lower(f("name")), 0, 3)
                month = pc.index_in(low, pa.array(MONTHS)).to_numpy(zero_copy_only=False) + 1
            else:
                month = _two(f("m"))
            one["plain"][at] = _wall(day_number(_year(f("y")), month.astype(np.int64), _two(f("d"))), *clock)
        one["timed"][at], one["dated"][at] = timed, ~timed
        zones = f("zone").dictionary_encode()
        table = [_offset(z) if z else NONE for z in zones.dictionary.to_pylist()]
        z = np.array([NONE + 1 if t is None else t for t in table])[zones.indices.to_numpy()]
        bad_zone[at] = z == NONE + 1
        w_off[at] = z
        w_region[at] = [r or None for r in f("region").to_pylist()]
    bits = np.zeros(k, np.int64)
    for i, c in enumerate(("mdy", "dmy", "ymd", "packed", "epoch", "plain")):
        ok = (one[c] != NONE) & ~bad_zone
        year = np.where(ok, one[c], 0).astype("datetime64[us]").astype("datetime64[Y]").astype(np.int64) + 1970
        odd = (year < PLAUSIBLE[0]) | (year >= PLAUSIBLE[1])
        bits |= np.where(ok, (1 << i) | np.where(odd & (c != "plain"), 1 << (len(READINGS) + i), 0), 0)
    null = index.is_null().to_numpy(zero_copy_only=False)
    ix = pc.fill_null(index, 0).to_numpy(zero_copy_only=False)
    if k == 0:
        bits, ix = np.zeros(1, np.int64), np.zeros(n, np.int64)
        one = {c: np.full(1, NONE) if v.dtype != bool else np.zeros(1, bool) for c, v in one.items()}
        w_off, w_region = np.full(1, NONE), np.full(1, None, object)
    cols = [pa.array(np.where(null, 0, bits[ix]).astype(np.int32))]
    for c in ("plain", "mdy", "dmy", "ymd", "packed", "epoch"):
        v = one[c][ix]
        cols.append(pa.array(v, mask=(v == NONE) | null))
    cols += [pa.array(one["timed"][ix]), pa.array(one["dated"][ix])]
    v = w_off[ix]
    cols.append(pa.array(np.where(v < -10_000, 0, v).astype(np.int32), mask=(v < -10_000) | null))
    cols.append(pa.array(w_region).cast(pa.string()).take(pa.array(ix)))
    return pa.StructArray.from_arrays(cols, ["sig", "plain", "mdy", "dmy", "ymd", "packed", "epoch", "timed", "dated", "off", "region"])


def parse_text(text: Column) -> Column:
    """The readings of a text column as one struct column."""
    return F.arrow_udf(parse, SCHEMA)(text)


def clock_to_utc(us: Column, zone: Column) -> Column:
    """UTC microseconds of a wall clock reading in a region.

    A reading that occurs twice gives the earlier instant; one in a skipped hour is
    read with the offset before the jump.
    """
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(us), zone))
