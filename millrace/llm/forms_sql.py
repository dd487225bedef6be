"""Forms and shapes of text in SQL, for comparison: the tables of ``charforms`` as ``translate`` and ``replace``."""

from __future__ import annotations

import unicodedata as ud

from millrace.llm import charforms as cf


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _mapped(expr: str, table: dict[str, str | None]) -> str:
    """``expr`` with characters replaced: single ones by one translate, which also drops those that become nothing."""
    one = {a: b for a, b in table.items() if b and len(b) == 1}
    gone = [a for a, b in table.items() if not b]
    out = f"translate({expr}, {_text(''.join(one) + ''.join(gone))}, {_text(''.join(one.values()))})"
    for a, b in table.items():
        if b and len(b) > 1:
            out = f"replace({out}, {_text(a)}, {_text(b)})"
    return out


def form(expr: str) -> str:
    """``charforms.one_form``."""
    lines = f"replace(replace({expr}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    table = {chr(o): v for o, v in cf.FORMS.items() if o and v != chr(o) and not 0xD800 <= o < 0xE000}
    return f"nfc_normalize({_mapped(lines, table)})"


def shape(expr: str) -> str:
    """``charforms.shape`` of text in one form."""
    table = dict(cf._TO_LATIN)
    for o in range(0xC0, 0x2000):  # letters that stand for a letter and its marks
        parts = ud.normalize("NFD", chr(o))
        if len(parts) > 1 and parts[0] in table:
            table[chr(o)] = ud.normalize("NFC", table[parts[0]] + parts[1:])
    return f"nfc_normalize({_mapped(expr, table)})"


def folded(expr: str) -> str:
    """The form in which words of leaked passages are compared (``leakage.folded``)."""
    out = f"lower(nfc_normalize({_mapped(form(expr), cf._CLASS)}))"
    for letter, instead in cf.COMMON.items():
        out = f"replace({out}, {_text(letter)}, {_text(instead)})"
    return out


def _grams(table: str, key: str, n: int) -> str:
    words = f"SELECT {key} AS id, regexp_extract_all({folded('text')}, '[\\p{{L}}\\p{{N}}]+') AS w FROM {table} WHERE {key} IS NOT NULL AND text IS NOT NULL"
    return f"SELECT id, i - 1 AS pos, array_to_string(w[i:i + {n - 1}], ' ') AS gram FROM (SELECT id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM ({words}))"


def leaks(n: int) -> str:
    """CTE ``hit (doc_id, item_id, pos)``: where ``n`` consecutive words of an item stand in a document."""
    return f"""g AS ({_grams('eval_items', 'item_id', n)}), d AS ({_grams('documents', 'doc_id', n)}),
hit AS (SELECT DISTINCT d.id AS doc_id, g.id AS item_id, d.pos FROM d JOIN g USING (gram))"""


def looks() -> str:
    """CTE ``look (doc_id, key, text)``: documents with the shape of their text in one form."""
    return f"look AS (SELECT doc_id, md5({shape(form('text'))}) AS key, text FROM documents WHERE text IS NOT NULL)"
