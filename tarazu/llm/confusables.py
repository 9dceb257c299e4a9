"""Letters drawn alike, by rule from the Unicode consortium's confusables, as every Spark installation holds them in its ICU library.

A confusable stands for a prototype text.  Letters of one prototype are drawn alike; they are written as the ASCII letter among them that has their case,
else as the ASCII letter that is the prototype, else as the first of them that has their case.  A letter that is drawn like a letter with marks is written
as that.  Digits and other signs are never letters, and letters of joining scripts (Arabic and its like), drawn by their place in the word, never
those of others.
"""

from __future__ import annotations

import functools
import os
import struct
import sys
import unicodedata
import zipfile
from pathlib import Path

#: Letters whose prototype is not what they are drawn like here, or that have none.
OVERRIDES = {"Ԛ": "Q", "ӏ": "l", "Լ": "L"}
_DATA = "com/ibm/icu/impl/data/icudata/confusables.cfu"


def icu_library() -> Path:
    """The ICU library of the Spark installation: below ``SPARK_HOME``, else beside the Python package."""
    import pyspark

    for home in (os.environ.get("SPARK_HOME"), str(Path(pyspark.__file__).parent)):
        found = sorted(Path(home).glob("jars/icu4j-*.jar")) if home else []
        if found:
            return found[-1]
    raise RuntimeError("no ICU library in the Spark installation: set SPARK_HOME")


def prototypes(library: Path | None = None) -> dict[str, str]:
    """Each confusable character with the text it can be confused with."""
    with zipfile.ZipFile(library or icu_library()) as held:
        data = held.read(_DATA)
    order, utf16 = (">", "utf-16-be") if data[8] else ("<", "utf-16-le")
    data = data[struct.unpack(order + "H", data[:2])[0] :]
    # Offset and length of the keys, of the index of their texts, and of the texts.
    keys_at, n, index_at, _, texts_at, _ = struct.unpack(order + "6I", data[12:36])
    out = {}
    for key, at in zip(struct.unpack(f"{order}{n}I", data[keys_at : keys_at + 4 * n]), struct.unpack(f"{order}{n}H", data[index_at : index_at + 2 * n])):
        units = (key >> 24) + 1
        begin = texts_at + 2 * at
        out[chr(key & 0xFFFFFF)] = chr(at) if units == 1 else data[begin : begin + 2 * units].decode(utf16)
    return out


@functools.cache
def letters_alike() -> tuple[dict[str, str], dict[str, str]]:
    """``(signs, composed)``: the letter that each letter drawn like another is written as, and the letter with marks that a letter is drawn like."""
    kind, of = unicodedata.category, prototypes()
    groups: dict[str, list[str]] = {}
    composed: dict[str, str] = {}
    for code in range(sys.maxunicode + 1):
        c = chr(code)
        if kind(c)[0] != "L" or unicodedata.bidirectional(c) == "AL" or unicodedata.normalize("NFKD", c) != c:
            continue
        shown = of.get(c, c)
        if len(shown) > 1 and kind(shown[0])[0] == "L" and all(kind(x)[0] == "M" for x in shown[1:]):
            composed[c] = shown
        else:
            groups.setdefault(shown, []).append(c)
    signs = {}
    for shown, own in groups.items():
        ascii_letters = [c for c in own if c.isascii()]
        for c in own:
            same_case = [x for x in ascii_letters or own if kind(x) == kind(c)]
            sign = same_case[0] if same_case else shown if shown in ascii_letters else ascii_letters[0] if ascii_letters else c
            if sign != c:
                signs[c] = sign
    return {**signs, **OVERRIDES}, composed
