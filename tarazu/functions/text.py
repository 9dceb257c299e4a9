"""Text functions on Columns: normalization, tokens, folding and small formatters.  All run in the JVM."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The character replacements of the project's normalizer.
YEH_KAF = {"ي": "ی", "ى": "ی", "ك": "ک"}
HAMZA_CARRIERS = {"آ": "ا", "أ": "ا", "إ": "ا", "ؤ": "و"}
PERSIAN_DIGITS, ARABIC_DIGITS, LATIN_DIGITS = "۰۱۲۳۴۵۶۷۸۹", "٠١٢٣٤٥٦٧٨٩", "0123456789"
KASHIDA = "ـ"
MARKS = "".join(map(chr, range(0x064B, 0x0653)))
ZWNJ, JOINERS = "‌", "‍‎‏"

_DIGITS = {**dict(zip(PERSIAN_DIGITS, LATIN_DIGITS)), **dict(zip(ARABIC_DIGITS, LATIN_DIGITS))}
_NORMAL = {**YEH_KAF, **HAMZA_CARRIERS, **_DIGITS, ZWNJ: " "}
_DELETED = KASHIDA + MARKS + JOINERS


def _translate(c: Column, table: dict[str, str], deleted: str = "") -> Column:
    return F.translate(c, "".join(table) + deleted, "".join(table.values()))


def normalize(c: Column) -> Column:
    """One spelling for letters and digits, no marks, single blanks, lower case.  Null stays null."""
    return F.trim(F.regexp_replace(F.lower(_translate(c, _NORMAL, _DELETED)), r"(?U)\s+", " "))


def tokenize(c: Column) -> Column:
    """Runs of letters, digits and underscores of the normalized text."""
    return F.regexp_extract_all(normalize(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokenize(c))


def fold(c: Column) -> Column:
    """Only letters that were typed on another keyboard, and digits."""
    return _translate(c, {"ي": "ی", "ك": "ک", **_DIGITS})


def search_key(c: Column) -> Column:
    """Folded, lower case, without any blank: for substring search."""
    return F.regexp_replace(F.lower(fold(c)), r"(?U)[\s‌]+", "")


#: Separators between the parts of a title, besides blanks.
SEPARATORS = "،,/\\()[]:;«»\"'"


def title_tokens(c: Column) -> Column:
    """Distinct words of a title with ZWNJ removed; keeps hyphens and the madda."""
    cut = r"(?U)[\s،,/\\()\[\]:;«»\"']+"
    words = F.split(F.regexp_replace(F.lower(fold(c)), ZWNJ, ""), cut)
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def md_escape(c: Column) -> Column:
    """A backslash before every character that Markdown or HTML could read as markup."""
    return F.regexp_replace(c, r"([\\`*_{}\[\]()<>#+\-.!|~$&])", r"\\$1")


def plain_number(c: Column) -> Column:
    """A decimal as plain digits: no exponent, no zeros at the end of the fraction, no point without one."""
    shown = c.cast("decimal(38,6)").cast("string")
    return F.regexp_replace(F.regexp_replace(shown, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")


def format_number(c: Column) -> Column:
    """Thousands separators, no trailing zeros of the fraction."""
    return F.regexp_replace(F.format_number(c.cast("decimal(38,6)"), 6), r"\.?0+$", "")


def _single_forms() -> dict[str, str]:
    """Every character whose compatibility form is one other character: width, position in the word, style."""
    table = {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code < 0xE000 or code > 0xFFFF:
            continue
        c = chr(code)
        if c.isspace():
            table[c] = " "
        elif unicodedata.category(c) == "Nd":
            table[c] = str(unicodedata.digit(c))
        elif len(k := unicodedata.normalize("NFKC", c)) == 1 and k != c:
            table[c] = k
    return {**table, **YEH_KAF, "ە": "ه", "ہ": "ه", **{c: YEH_KAF[k] for c, k in table.items() if k in YEH_KAF}}


def fold_label(c: Column) -> Column:
    """A short category text in one form: characters of other widths and positions replaced, invisible ones
    removed, blanks (ZWNJ among them) single.  Null stays null."""
    plain = F.regexp_replace(F.regexp_replace(c, ZWNJ, " "), r"[\p{Cf}\x{fe00}-\x{fe0f}]", "")
    return F.trim(F.regexp_replace(_translate(plain, _single_forms()), r"(?U)\s+", " "))
