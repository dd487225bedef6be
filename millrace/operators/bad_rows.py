"""Problem 3: rows of delimited text that fail to parse.

Method: from the schema one anchored regular expression is generated that a whole good row
matches; only rows that fail it go on to patterns of ever longer field prefixes, in two
series.  Those of structure tell the first field that is not well quoted or not there, and
so whether quoting or the number of columns is broken; those of values tell the first field
that cannot be accepted.  The reason is read off where they fail.  All of it are Catalyst
expressions in one pass, no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PAD = "[ \\t]*"


@dataclass(frozen=True)
class Field:
    """A column of the row: ``kind`` is ``int``, ``decimal`` or ``text``; bounds are inclusive."""

    name: str
    kind: str = "text"
    low: int = 0
    high: int = 0


RATING_FIELDS = (Field("user_id", "int", 1, 2_147_483_647), Field("movie_id", "int", 1, 2_147_483_647), Field("rating", "decimal", 1, 5), Field("rated_at"))


def _digits_up_to(high: int) -> str:
    """A pattern of the integers 1..high in ASCII digits, leading zeros allowed."""
    s, alts = str(high), []
    if len(s) > 1:
        alts.append(f"[1-9][0-9]{{0,{len(s) - 2}}}")
    for i, ch in enumerate(s):
        lo = 1 if i == 0 else 0
        if int(ch) > lo:
            alts.append(f"{s[:i]}[{lo}-{int(ch) - 1}][0-9]{{{len(s) - i - 1}}}")
    return f"0*+(?:{'|'.join([*alts, s])})"


def _value(f: Field) -> str | None:
    if f.kind == "int":
        if f.low != 1:
            raise ValueError("integers start at 1")
        return _digits_up_to(f.high)
    if f.kind == "decimal":
        # low <= whole part < high with any fraction, or high itself with a fraction of zeros
        whole = "|".join(str(i) for i in range(f.low, f.high))
        return f"0*+(?:(?:{whole})(?:\\.[0-9]+)?|{f.high}(?:\\.0+)?)"
    return None


class RowPatterns:
    """The regular expressions generated from a schema."""

    def __init__(self, fields: tuple[Field, ...], sep: str = ",", quote: str = '"') -> None:
        q, s = re.escape(quote), re.escape(sep)
        self.quoted = f"{q}(?:[^{q}]|{q}{q})*+{q}"
        self.bare = f"(?!{q})[^{q}{s}]*+"
        self.any = f"(?:{self.quoted}|{self.bare})"
        self.sep, self.fields = s, fields
        self.end = "(?:\\r\\n|\\r|\\n)?\\z"  # a line end that came along with the row
        good = [self._good(f, q) for f in fields]
        head = "(?s)\\A"
        self.row = head + s.join(good) + self.end
        #: shape[i]: fields 0..i are well quoted; ends[i]: and nothing follows them.
        self.shape = [f"{head}{self.any}(?:{s}{self.any}){{{i}}}(?:{s}|{self.end})" for i in range(len(fields))]
        self.ends = [f"{head}{self.any}(?:{s}{self.any}){{{i}}}{self.end}" for i in range(len(fields))]
        #: What follows the last field of the schema is well quoted too.
        self.rest = f"{head}{self.any}(?:{s}{self.any})*+{self.end}"
        #: prefix[i]: fields 0..i are acceptable.
        self.prefix = [head + s.join(good[: i + 1]) + f"(?:{s}|{self.end})" for i in range(len(fields))]

    def _good(self, f: Field, q: str) -> str:
        v = _value(f)
        return self.any if v is None else f"(?:{q}{_PAD}{v}{_PAD}{q}|{_PAD}{v}{_PAD})"

    def field(self, i: int) -> str:
        """A pattern whose group 1 is the i-th field of a well quoted row."""
        return f"(?s)\\A(?:{self.any}{self.sep}){{{i}}}({self.any})(?:{self.sep}|{self.end})"


def classify(df: DataFrame, line: str, fields: tuple[Field, ...] = RATING_FIELDS, sep: str = ",", quote: str = '"') -> DataFrame:
    """``df`` with ``reason`` (null for good rows), ``broken_at`` and ``broken_field``.

    Reasons, the first that applies: ``broken_quoting``, ``column_count``,
    ``invalid_value``.  ``broken_at`` is the place, from 1, of the first field whose prefix
    pattern fails, of rows of every reason, and ``broken_field`` its name.  Where all fields
    of the schema pass, what follows them is broken: the place is one beyond the last, without
    a name.  A null line has no fields: ``column_count``, broken at the first.  Columns of
    these names in ``df`` give way to the operator's.
    """
    p, c = RowPatterns(fields, sep, quote), F.col(line)
    n = len(fields)
    misshapen, place = F.lit(n), F.lit(n + 1)
    for i in range(n - 1, -1, -1):
        misshapen = F.when(~c.rlike(p.shape[i]), F.lit(i)).otherwise(misshapen)
        place = F.when(~c.rlike(p.prefix[i]), F.lit(i + 1)).otherwise(place)
    # a row that ends, well quoted, before the field that is missing is short; one that goes on after all fields is long
    short = F.lit(False)
    for i in range(1, n):
        short = short | ((F.col("_mr_at") == i) & c.rlike(p.ends[i - 1]))
    reason = (
        F.when(F.col("_mr_at") < n, F.when(short, "column_count").otherwise("broken_quoting"))
        .when(~c.rlike(p.ends[n - 1]), F.when(c.rlike(p.rest), "column_count").otherwise("broken_quoting"))
        .when(F.col("broken_at") <= n, "invalid_value")
    )
    bad = c.isNull() | ~c.rlike(p.row)
    x = df.withColumn("broken_at", F.when(bad, F.when(c.isNull(), F.lit(1)).otherwise(place)))
    x = x.withColumn("_mr_at", F.when(F.col("broken_at").isNotNull(), misshapen))
    x = x.withColumn("reason", F.when(c.isNull(), "column_count").when(F.col("broken_at").isNotNull(), reason)).drop("_mr_at")
    return x.withColumn("broken_field", F.get(F.array(*[F.lit(f.name) for f in fields]), F.col("broken_at") - 1))


def rejected(df: DataFrame, line: str, fields: tuple[Field, ...] = RATING_FIELDS, **csv) -> DataFrame:
    """Rows that cannot be loaded, with ``reason``, ``broken_at`` and ``broken_field``."""
    return classify(df, line, fields, **csv).filter(F.col("reason").isNotNull())


def _unquoted(c: Column, quote: str) -> Column:
    q = re.escape(quote)
    inner = F.regexp_replace(F.regexp_replace(c, f"(?s)\\A{q}(.*){q}\\z", "$1"), q + q, quote)
    return F.when(c.startswith(quote), inner).otherwise(c)


def loaded(df: DataFrame, line: str, fields: tuple[Field, ...] = RATING_FIELDS, sep: str = ",", quote: str = '"') -> DataFrame:
    """The good rows with their fields as typed columns.

    The other columns of ``df`` stay, except those of the fields' names and ``reason``,
    ``broken_at`` and ``broken_field``, which give way.
    """
    p = RowPatterns(fields, sep, quote)
    good = classify(df, line, fields, sep, quote).filter(F.col("reason").isNull()).drop("reason", "broken_at", "broken_field")
    cols, row = {}, F.regexp_replace(F.col(line), p.end, "")
    for i, f in enumerate(fields):
        raw = _unquoted(F.regexp_extract(row, p.field(i), 1), quote)
        cols[f.name] = raw if f.kind == "text" else F.trim(F.translate(raw, "\t", " ")).try_cast("int" if f.kind == "int" else "double")
    return good.withColumns(cols)
