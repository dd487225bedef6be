"""Characters that look the same: which differ only in form, and which are twins across scripts.

All tables are built from Unicode properties by rule, but for the letters of equal shape.
"""

from __future__ import annotations

import unicodedata as ud

# Letters of equal shape, Latin first, then their twins in other scripts.
TWINS = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν",
    "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", "Q": "Ԛ", "W": "Ԝ",
    "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оο", "p": "р", "q": "ԛ",
    "s": "ѕ", "w": "ԝ", "x": "х", "y": "у",
}
# Hyphens of every kind; the soft one shows nothing.
HYPHENS = "‐‑﹣－⁃"
# Signs shaped like a letter that Unicode does not equate with it canonically.
SIGNS = {"µ": "μ", "∑": "Σ", "∏": "Π", "∆": "Δ", "ℹ": "i", "℃": "°C", "℉": "°F"}

LATIN, CYRILLIC, GREEK, OTHER = "latin", "cyrillic", "greek", "other"


def script(ch: str) -> str:
    """Script of a letter, of those that have twins; "" for other characters."""
    o = ord(ch)
    if not ch.isalpha():
        return ""
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return LATIN
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return GREEK
    if 0x400 <= o < 0x530:
        return CYRILLIC
    return OTHER


def _form_table() -> dict[int, str | None]:
    """What one character becomes by form alone; None for those that show nothing."""
    t: dict[int, str | None] = {}
    ranges = [(0, 0x3100), (0xFB00, 0xFB50), (0xFE00, 0xFE70), (0xFEFF, 0xFFF0), (0xE0000, 0xE0200), (0x1D100, 0x1D200)]
    for lo, hi in ranges:
        for o in range(lo, hi):
            ch = chr(o)
            kind = ud.category(ch)
            name = ud.name(ch, "")
            if ch == "\n":
                continue
            if ch in "\t" or kind == "Zs":
                t[o] = " "
            elif kind in ("Cf", "Cc") or "VARIATION SELECTOR" in name or o in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
                t[o] = "\n" if ch in "\x85" else None
            elif kind in ("Zl", "Zp"):
                t[o] = "\n"
            elif ch in HYPHENS:
                t[o] = "-"
            elif ch in SIGNS:
                t[o] = SIGNS[ch]
            elif "FULLWIDTH" in name or "HALFWIDTH" in name or "LIGATURE" in name or "ROMAN NUMERAL" in name or "DIGRAPH" in name or (0xFE30 <= o < 0xFE70 and name.startswith("SMALL")):
                new = ud.normalize("NFKC", ch)
                if new != ch:
                    t[o] = new
    t.pop(0x20, None)
    t[0x20] = " "
    return t


FORMS = _form_table()
_CHANGING = [o for o, v in FORMS.items() if v != chr(o)]


def _char_class(points: list[int]) -> str:
    """A character class in the syntax of RE2, which scans whole Arrow buffers in linear time."""
    out, points = [], sorted(points)
    at = 0
    while at < len(points):
        end = at
        while end + 1 < len(points) and points[end + 1] == points[end] + 1:
            end += 1
        out.append(f"\\x{{{points[at]:x}}}-\\x{{{points[end]:x}}}")
        at = end + 1
    return f"[{''.join(out)}]"


#: Characters that a canonical composition can change: marks, singletons and conjoining jamo.
_COMPOSING = [o for o in range(0x80, 0x30000) if ud.combining(chr(o)) or 0x1100 <= o < 0x1200 or (ud.decomposition(chr(o)) and ud.normalize("NFC", chr(o)) != chr(o))]
#: RE2 class of characters for which one_form can change a text.
NEEDS_FORM = _char_class([o for o in set(_CHANGING) | set(_COMPOSING) if not 0xD800 <= o < 0xE000])

_TO_LATIN = {t: a for a, ts in TWINS.items() for t in ts}
_BY_SCRIPT: dict[str, dict[str, str]] = {LATIN: dict(_TO_LATIN), CYRILLIC: {}, GREEK: {}}
for _a, _ts in TWINS.items():
    for _s in (CYRILLIC, GREEK):
        _own = next((t for t in _ts if script(t) == _s), None)
        if _own:
            for _c in {_a, *_ts} - {_own}:
                _BY_SCRIPT[_s][_c] = _own
_INTO = {s: str.maketrans(t) for s, t in _BY_SCRIPT.items()}
_SHAPE = str.maketrans(_TO_LATIN)
TWIN_CHARS = set(_TO_LATIN) | set(TWINS)
#: RE2 class of letters outside Latin that have a twin.
FOREIGN_TWIN = _char_class([ord(c) for c in _TO_LATIN])


# The letter without a small form of its own shape: its case is no link, only its looks are.
_PALOCHKA = "ӀӏӏӀ"


def _classes() -> dict[str, str]:
    """Letters to one representative of all that differ from it in case or in script alone.

    Links of case and of shape are followed to their end, so that it does not matter which
    is undone first.  Latin letters are their own small forms.
    """
    link: dict[str, str] = {}

    def root(c: str) -> str:
        while link.get(c, c) != c:
            c = link[c]
        return c

    def rank(c: str) -> tuple:
        return (script(c) != LATIN, not c.islower(), c)

    def join(a: str, b: str) -> None:
        a, b = sorted((root(a), root(b)), key=rank)
        link[b] = a
        link.setdefault(a, a)

    for o in range(0x80, 0x2000):
        c = chr(o)
        if c.isalpha() and c not in _PALOCHKA and script(c) in (CYRILLIC, GREEK) and len(ud.normalize("NFD", c)) == 1:
            for d in (c.lower(), c.upper()):
                if len(d) == 1 and d.isalpha():
                    join(c, d)
    for a, ts in TWINS.items():
        join(a, a.lower())
        for t in ts:
            join(a, t)
    return {c: root(c) for c in link if root(c) != c}


_CLASS = _classes()
for _o in range(0xC0, 0x2000):  # letters that stand for a letter and its marks
    _parts = ud.normalize("NFD", chr(_o))
    if len(_parts) > 1 and _parts[0] in _CLASS:
        _CLASS[chr(_o)] = ud.normalize("NFC", _CLASS[_parts[0]] + _parts[1:])
_FOLD = str.maketrans(_CLASS)
#: Letters of formulas, common enough in any text to be replaced, once lower-cased, without a look at each character; in capitals the sharp s is two letters.
COMMON = {c: _CLASS[c] for c in "αβημστ"} | {"ß": "ss"}
#: RE2 class of letters whose representative is neither their lower case nor what COMMON makes of it.
ODD_CASE = _char_class([ord(c) for c, r in _CLASS.items() if COMMON.get(c.lower(), c.lower()) != r])


def fold_shape(text: str) -> str:
    """Letters by the representative of their class: with COMMON replaced in lower case, texts that differ in case or in equal shapes are equal."""
    return ud.normalize("NFC", ud.normalize("NFC", text).translate(_FOLD))


def one_form(text: str) -> str:
    """The text with widths, blanks, hyphens, joined letters, accents and signs in one form, and without what shows nothing.

    Letter case, the presence of accents and blanks, raised and lowered digits, line
    breaks and other punctuation stay as they are.
    """
    return ud.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n").translate(FORMS))


def into(text: str, script: str) -> str:
    """The text with twins of other scripts replaced by those of ``script``, marks kept on them."""
    return ud.normalize("NFC", ud.normalize("NFD", text).translate(_INTO[script]))


def shape(text: str) -> str:
    """One representative of all texts of equal shape, letter by letter: for comparison only."""
    return ud.normalize("NFC", ud.normalize("NFD", text).translate(_SHAPE))
