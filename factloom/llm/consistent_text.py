"""One consistent form for text that looks the same: widths, marks, spaces, invisible and look-alike characters.

Everything happens on the code points of whole Arrow batches: table gathers for classes and replacements, offsets for
expansions, sorted pair keys for the composition of marks. No string is touched one by one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLAIN, DROP, SPACE, WIDTH, JOINED, MARK, ALIKE, OTHER = range(8)

# Letters of other alphabets that look like Latin ones.
ALIKE_CYRILLIC = "А A В B Е E І I Ј J К K М M Н H О O Р P С C Ѕ S Т T У Y Х X Ү Y Ԍ G Ԛ Q Ԝ W а a г r е e о o р p с c у y х x ѕ s і i ј j ԁ d ԛ q ԝ w һ h ү y ӏ l к k м m т t в b н h п n"
ALIKE_GREEK = "Α A Β B Ε E Ζ Z Η H Ι I Κ K Μ M Ν N Ο O Ρ P Τ T Υ Y Χ X α a ι i κ k ν v ο o ρ p υ u χ x τ t γ y η n ϲ c ϳ j"
ALIKE_CHEROKEE = "Ꭺ A Ᏼ B Ꮯ C Ꭰ D Ꭼ E Ꮐ G Ꮋ H Ꭻ J Ꮶ K Ꮮ L Ꮇ M Ꮲ P Ꭱ R Ꮪ S Ꭲ T Ꮩ V Ꮃ W Ꮓ Z"
ALIKE_LATIN = "ɡ g ɑ a"
ALIKE_ARMENIAN = "Ս U Օ O Տ S Լ L հ h ո n ս u օ o ց g զ q յ j ք p ռ n տ s ա w"


@cache
def _tables() -> dict[str, np.ndarray]:
    """Class of each code point, its replacement (start and length in a pool), letters by script, combining class, composition pairs.

    Replacements and all letters with marks stand decomposed in the pool; what belongs together is composed at the end.
    """
    size = 0x110000
    kind = np.zeros(size, np.uint8)
    start = np.arange(size, dtype=np.int64)
    length = np.ones(size, np.int64)
    pool = list(range(size))  # a code point stands for itself unless it gets an entry of its own at the end
    letter, latin, mark, symbol = (np.zeros(size, bool) for _ in range(4))
    order = np.zeros(size, np.uint8)  # canonical combining class
    alike = np.arange(size, dtype=np.uint32)
    pairs: dict[int, int] = {}

    def replace(c: int, text: str) -> None:
        text = unicodedata.normalize("NFD", text)
        start[c], length[c] = len(pool), len(text)
        pool.extend(map(ord, text))

    for c in [*range(0x30000), *range(0xE0000, 0xE0200)]:
        ch = chr(c)
        category = unicodedata.category(ch)
        if category[0] == "C" and category != "Cf":
            continue
        letter[c], mark[c], symbol[c] = category[0] == "L", category[0] == "M", category in ("So", "Sk", "Sm")
        if letter[c] and c < 0x2C80 or 0xA720 <= c < 0xA800 or 0xFB00 <= c < 0xFB07:
            latin[c] = letter[c] and (unicodedata.name(ch, "").startswith("LATIN") or ch in "ªº")
        shape = unicodedata.decomposition(ch)
        order[c] = unicodedata.combining(ch)
        if category == "Zs" and c != 0x20:
            kind[c] = SPACE
            replace(c, " ")
        elif shape.startswith(("<wide>", "<narrow>")):
            kind[c] = WIDTH
            replace(c, chr(int(shape.split()[1], 16)))
        elif shape.startswith("<compat>") and category[0] == "L":
            parts = "".join(chr(int(x, 16)) for x in shape.split()[1:])
            if len(parts) > 1 and all(unicodedata.category(x)[0] == "L" for x in parts):
                kind[c] = JOINED
                replace(c, unicodedata.normalize("NFKD", ch))
        elif shape and shape[0] != "<":
            replace(c, ch)
            if unicodedata.normalize("NFC", ch) != ch:
                kind[c] = OTHER  # another character stands for this one
            elif " " in shape:
                base, accent = (int(x, 16) for x in shape.split())
                pairs[base << 32 | accent] = c
                kind[accent] = MARK
        if order[c]:
            kind[c] = MARK
    kind[[*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]] = MARK  # vowels and finals of Hangul syllables
    visible_formats = {*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2}
    for c in [*range(0x30000), *range(0xE0000, 0xE0200)]:
        if unicodedata.category(chr(c)) == "Cf" and c not in visible_formats:
            kind[c] = DROP
    kind[[0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]] = DROP
    for table in (ALIKE_CYRILLIC, ALIKE_GREEK, ALIKE_CHEROKEE, ALIKE_LATIN, ALIKE_ARMENIAN):
        words = table.split()
        for a, b in zip(words[::2], words[1::2]):
            kind[ord(a)], alike[ord(a)] = ALIKE, ord(b)
    for c in np.flatnonzero((kind == PLAIN) & (length > 1)):  # a look-alike with a mark
        if kind[pool[start[c]]] == ALIKE:
            kind[c] = OTHER
    keys = np.array(sorted(pairs), np.uint64)
    whole = np.array([pairs[int(k)] for k in keys], np.uint32)
    joiner = np.zeros(size, bool)
    joiner[[0x200C, 0x200D, *range(0xFE00, 0xFE10), *range(0xE0020, 0xE0080)]] = True
    shaped = symbol.copy()  # what a joiner or variation selector shapes visibly: symbols, Arabic, Indic and the like
    shaped[0x590:0x1100] |= letter[0x590:0x1100] | mark[0x590:0x1100]
    shaped[0x1F000:0x20000] = True
    return {"kind": kind, "start": start, "length": length, "pool": np.array(pool, np.uint32), "letter": letter, "latin": latin, "mark": mark, "alike": alike, "order": order, "keys": keys, "whole": whole, "joiner": joiner, "shaped": shaped}


def code_points(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all values, and the number of code points of each."""
    if values.offset:
        values = pa.concat_arrays([values])
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64 if pa.types.is_large_string(values.type) else np.int32)[: len(values) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    leading = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
    return np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32), np.diff(leading[offsets - offsets[0]])


def _strings(points: np.ndarray, lengths: np.ndarray) -> pa.Array:
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    ends = np.r_[0, np.cumsum(width)][np.r_[0, np.cumsum(lengths)]]
    data = points.astype("<u4").tobytes().decode("utf-32-le").encode()
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data)])


def _pair(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The character that two compose to, 0 for none; Hangul syllables by arithmetic."""
    t = _tables()
    key = first.astype(np.uint64) << np.uint64(32) | second
    where = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
    out = np.where(t["keys"][where] == key, t["whole"][where], 0).astype(np.int64)
    a, b = first.astype(np.int64), second.astype(np.int64)
    vowel = (a >= 0x1100) & (a < 0x1113) & (b >= 0x1161) & (b < 0x1176)
    final = (a >= 0xAC00) & (a < 0xD7A4) & ((a - 0xAC00) % 28 == 0) & (b > 0x11A7) & (b < 0x11C3)
    return np.where(vowel, 0xAC00 + ((a - 0x1100) * 21 + b - 0x1161) * 28, np.where(final, a + b - 0x11A7, out))


def _composed(points: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decomposed text in canonical order and composed: marks sorted by class, each joined to its base unless another of its class stands between.

    Marks that join nothing stand from the highest class down (above the letter before below), so canonically equal
    texts get one form whatever order they had; it is canonically equal to NFC.
    """
    order = _tables()["order"][points]
    base = (order == 0) | np.r_[True, owner[1:] != owner[:-1]]
    segment = np.cumsum(base) - 1
    if ((order[1:] < order[:-1]) & (order[1:] > 0) & ~base[1:]).any():
        at = np.lexsort((order, segment))
        points, order = points[at], order[at]
        base = np.r_[True, segment[1:] != segment[:-1]]
    while True:
        starts = np.flatnonzero(base)
        counts = np.diff(np.r_[starts, len(points)])
        keep = np.ones(len(points), bool)
        open_ = np.flatnonzero((counts > 1) & (order[starts] == 0))
        last = np.zeros(len(starts), np.int64)  # class of the last mark that stayed
        for k in range(1, int(counts[open_].max(initial=1))):
            open_ = open_[counts[open_] > k]
            head, mark = starts[open_], starts[open_] + k
            whole = _pair(points[head], points[mark])
            joins = (whole > 0) & (last[open_] < order[mark])
            points[head[joins]] = whole[joins]
            keep[mark[joins]] = False
            last[open_[~joins]] = order[mark[~joins]]
        points, owner, order, base = points[keep], owner[keep], order[keep], base[keep]
        second = np.flatnonzero(base[1:] & base[:-1] & (order[1:] == 0) & (owner[1:] == owner[:-1])) + 1  # neighbours without marks between
        whole = _pair(points[second - 1], points[second])
        second, whole = second[whole > 0], whole[whole > 0]
        first = np.r_[True, second[1:] != second[:-1] + 1][: len(second)]  # of overlapping pairs the left one
        while len(first) and not (first | np.r_[True, first[:-1]]).all():  # three in a row: the third is free again
            first |= np.r_[False, ~first[:-1]] & np.r_[True, second[1:] == second[:-1] + 1]
        second, whole = second[first], whole[first]
        if not len(second):
            at = np.lexsort((-np.where(order == 0, 256, order.astype(np.int64)), np.cumsum(base)))
            return points[at], owner
        points[second - 1] = whole
        keep = np.ones(len(points), bool)
        keep[second] = False
        points, owner, order, base = points[keep], owner[keep], order[keep], base[keep]


def _normalise(points: np.ndarray, owner: np.ndarray, alike: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Consistent code points and their owners."""
    t = _tables()
    before = np.r_[np.uint32(0), points[:-1]]
    before[np.r_[True, owner[1:] != owner[:-1]]] = 0
    drop = (t["kind"][points] == DROP) & ~(t["joiner"][points] & t["shaped"][before])
    points, owner = points[~drop], owner[~drop]
    if not len(points):
        return points, owner
    length, start = t["length"][points], t["start"][points]
    within = np.arange(length.sum()) - np.repeat(np.r_[0, np.cumsum(length)[:-1]], length)
    points, owner = t["pool"][np.repeat(start, length) + within], np.repeat(owner, length)
    if not alike:
        return _composed(points, owner)
    in_word = t["letter"][points] | t["mark"][points]
    begins = in_word & ~np.r_[False, in_word[:-1] & (owner[1:] == owner[:-1])]
    word = np.where(in_word, np.cumsum(begins), 0)
    kind = t["kind"][points]
    letters, latin = t["letter"][points], t["latin"][points]
    n_words = int(word.max()) + 1
    has_latin = np.bincount(word[latin & (kind != ALIKE)], minlength=n_words) > 0
    has_other = np.bincount(word[letters & ~latin & (kind != ALIKE)], minlength=n_words) > 0
    swap = (kind == ALIKE) & (has_latin & ~has_other)[word]
    return _composed(np.where(swap, t["alike"][points], points), owner)


def _counted(points: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return points, np.bincount(owner, minlength=n)


def consistent_array(values: pa.Array, alike: bool = True) -> tuple[pa.Array, np.ndarray]:
    """Consistent form of each value (nulls stay null), and which values were not in it; without alike, letters of other alphabets stay."""
    values = values.cast(pa.large_string())
    changed = np.zeros(len(values), bool)
    candidates = np.flatnonzero(pc.fill_null(pc.invert(pc.string_is_ascii(values)), False).to_numpy(zero_copy_only=False))
    if len(candidates):
        some = values.take(pa.array(candidates))
        points, lengths = code_points(some)
        odd = np.r_[0, np.cumsum(_tables()["kind"][points] != PLAIN)]
        ends = np.r_[0, np.cumsum(lengths)]
        suspect = odd[ends[1:]] > odd[ends[:-1]]
        owner = np.repeat(np.arange(len(lengths)), lengths)
        mine = suspect[owner]
        if not suspect.any():
            return values, changed
        candidates, renumber = candidates[suspect], np.cumsum(suspect) - 1
        forms = _strings(*_counted(*_normalise(points[mine], renumber[owner[mine]], alike), len(candidates)))
        is_new = pc.not_equal(forms, some.filter(pa.array(suspect))).to_numpy(zero_copy_only=False)
        if is_new.any():
            changed[candidates[is_new]] = True
            values = pc.replace_with_mask(values, pa.array(changed), forms.filter(pa.array(is_new)))
    return values, changed


def _forms(table: str, fields: list[str], changed_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, field in enumerate(fields, 1):
                form, changed = consistent_array(batch.column(i))
                key = batch.column(0)
                mask = pa.array(changed)
                if changed_only:
                    form, key, mask = form.filter(mask), key.filter(mask), mask.filter(mask)
                n = len(key)
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array([table] * n), pa.array([field] * n), key, form.cast(pa.string()), mask], names=["table_name", "field", "row_key", "form", "changed"])

    return forms


def consistent_text(df: DataFrame, table: str, key: str, fields: list[str], changed_only: bool = False) -> DataFrame:
    """(table_name, field, row_key, form, changed): a row for each value of the fields, in its consistent form.

    changed says that the value was not in that form; changed_only leaves only those out. Null values keep a null
    form and are never changed; empty texts stay empty. key is cast to bigint; rows repeat as often as the table has
    them. Other columns are not read, so their names can't clash. One scan, no shuffle.

    Replaced: full-width and half-width forms, space characters but U+0020 (line breaks and tabs stay), joined letters, and letters of
    another alphabet that look like Latin ones in words that are Latin otherwise; dropped: characters without a shape
    of their own, unless they shape the character before them (emoji, Arabic, Indic); composed: accents apart from
    their letters, in any order, Hangul syllables from their parts, and characters that stand for another one (Kelvin
    sign). Words wholly in another alphabet stay, even if all their letters look like Latin ones, as do digits of other
    alphabets, superscripts, fractions, signs, quotes and dashes.
    """
    narrow = df.select(F.col(key).cast("long").alias("row_key"), *[F.col(f).alias(f"v{i}") for i, f in enumerate(fields)])
    return narrow.mapInArrow(_forms(table, fields, changed_only), "table_name string, field string, row_key long, form string, changed boolean")
