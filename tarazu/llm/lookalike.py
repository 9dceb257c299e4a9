"""One form for texts that look the same, whatever code points encode them.

Method, per token: every character stands for a drawn sign that one or more scripts can spell.  The sets of scripts of a token's
characters are intersected.  An empty intersection of the characters' own scripts is a mixed-script token; a token of one script whose
signs another script can spell too is a whole-script confusable.  Of the scripts that can spell the whole token the first in
``SCRIPTS`` is chosen and the token is written in it; a token that no single script can spell is written sign by sign.  What remains
(width, positional forms, composition of marks, digits, blanks, invisible characters) is normalized.  Equal forms mean equal signs in the
same order with the same word breaks, and the other way round.

Letter case, vowel marks, kashida and the madda are signs of their own and stay.
"""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarazu.llm.confusables import letters_alike

#: Scripts in order of preference.
SCRIPTS = ("Latin", "Arabic", "Cyrillic", "Greek", "Armenian", "Cherokee")

# Letters of the Arabic script that are drawn like another of it, as the project writes them; and signs drawn alike.
SAME_SCRIPT = {"ي": "ی", "ى": "ی", "ې": "ی", "ك": "ک", "ڪ": "ک", "ە": "ه", "ہ": "ه", "ھ": "ه"}
SAME_SIGN = {"\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-", "\u2043": "-", "\u02d7": "-", "\u2044": "/", "\u2215": "/"}
#: Characters that are blanks here although Unicode does not call them so.
ZWNJ = "\u200c"

_HAMZA = "\u0654"


@functools.cache
def script_of(c: str) -> str:
    """The script of a letter by its name; Common for what belongs to all scripts."""
    if not c.isalpha():
        return "Common"
    first = unicodedata.name(c, "").split(" ")[0].title()
    return first if first else "Common"


@functools.cache
def _spelled_by() -> dict[str, dict[str, str]]:
    """For each sign that letters of several scripts show, how each of them spells it."""
    out: dict[str, dict[str, str]] = {}
    for letter, sign in sorted(letters_alike()[0].items()):
        out.setdefault(sign, {script_of(sign): sign}).setdefault(script_of(letter), letter)
    return out


def sign_of(c: str) -> str:
    """The sign that a letter shows: one of the letters drawn like it."""
    return letters_alike()[0].get(c, c)


@functools.cache
def spellings(c: str) -> dict[str, str] | None:
    """How each script spells the sign that ``c`` shows; None if any script goes with it (digits, signs, marks)."""
    own = script_of(c)
    return None if own == "Common" else _spelled_by().get(sign_of(c), {own: c})


def resolve(token: str) -> tuple[str, str]:
    """``(kind, script)`` of a token in decomposed form: kind is ``single``, ``mixed`` (no script of its own characters'
    scripts is common to all), ``whole`` (one script, but another could spell all of it) or ``common``; script is the one to write it in, or
    '' if none can."""
    own, can = None, None
    for c in token:
        s = spellings(c)
        if s is None:
            continue
        at = {script_of(c)}
        own = at if own is None else own & at
        can = set(s) if can is None else can & set(s)
    if can is None:
        return "common", ""
    chosen = next((s for s in SCRIPTS if s in can), min(can, default=""))
    if not own:
        return "mixed", chosen
    return ("whole" if len(can) > 1 else "single"), chosen


def _spelled(token: str) -> str:
    """A decomposed token in the chosen script; the sign's first spelling where no script has all."""
    script = resolve(token)[1]
    out = []
    for c in token:
        s = spellings(c)
        out.append(c if s is None else s.get(script) or sign_of(c))
    return "".join(out)


def _composed(text: str) -> str:
    # NFC has no composed form for the Persian yeh with hamza: it is written with the Arabic yeh's.
    return unicodedata.normalize("NFC", text).replace("ی" + _HAMZA, "ئ")


@functools.lru_cache(maxsize=1 << 16)
def _token_form(token: str) -> str:
    return _composed(_spelled(token))


@functools.cache
def _same() -> dict[str, str]:
    return {**SAME_SCRIPT, **SAME_SIGN}


def _shown(c: str) -> str:
    """What a character is replaced by before tokens are looked at, decomposed; '' if it is invisible, a blank if it shows as one."""
    code, kind, same = ord(c), unicodedata.category(c), _same()
    if c == ZWNJ or c.isspace():
        return " "
    if kind == "Cf" or 0xFE00 <= code <= 0xFE0F or 0xE0100 <= code <= 0xE01EF or code in (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x2065, 0x3164, 0xFFA0):
        return ""
    marked = letters_alike()[1]
    plain = [same.get(x, x) for y in unicodedata.normalize("NFKD", c) for x in marked.get(y, y)]
    return "".join(str(unicodedata.digit(x)) if unicodedata.category(x) == "Nd" else x for x in plain)


@functools.cache
def _table() -> dict[int, str]:
    """What every character is replaced by, by rule."""
    every = (chr(code) for code in range(sys.maxunicode + 1) if not 0xD800 <= code < 0xE000)
    return {ord(c): new for c in every if (new := _shown(c)) != c}


#: Texts of these characters alone are in their form already, apart from blanks.
_PLAIN = re.compile("[ -~ابپتثجچحخدذرزژسشصضطظعغفقکگلمنوهیآء،؛؟ـ]*")
#: Tokens of these characters alone need no look at their scripts.
_ONE_SCRIPT = re.compile("[!-~؀-ۿ]*")
_BLANKS = re.compile(r" {2,}")


def look(text: str | None) -> str | None:
    """The one form of a text.  Null stays null; an empty text, or one of blanks and invisible characters only, is ''."""
    if text is None:
        return None
    if _PLAIN.fullmatch(text):
        return _BLANKS.sub(" ", text).strip(" ")
    # Marks are put in canonical order first, so that a base and its marks are one sequence however they were typed.
    flat = unicodedata.normalize("NFD", text.translate(_table()))
    return " ".join([_composed(t) if _ONE_SCRIPT.fullmatch(t) else _token_form(t) for t in flat.split(" ") if t])


@F.pandas_udf(T.StringType())
def _look_udf(texts: pd.Series) -> pd.Series:
    forms = {t: look(t) for t in texts.unique() if isinstance(t, str)}  # repeated texts of a batch are looked at once
    return pd.Series([forms[t] if isinstance(t, str) else None for t in texts], dtype="object")


def look_same_form(c: Column) -> Column:
    """The one form of a text column: two texts look the same exactly if their forms are equal.  Null stays null.
    An Arrow-batched function, as Spark has no Unicode normalization of its own."""
    return _look_udf(c)


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("tokens", "mixed", "whole")]))
def _token_kinds(texts: pd.Series) -> pd.DataFrame:
    out = []
    for t in texts:
        kinds = [resolve(x)[0] for x in unicodedata.normalize("NFD", t.translate(_table())).split(" ") if x] if isinstance(t, str) else []
        out.append((len(kinds), kinds.count("mixed"), kinds.count("whole")))
    return pd.DataFrame(out, columns=["tokens", "mixed", "whole"])


def script_findings(c: Column) -> Column:
    """A struct with the number of tokens, of mixed-script tokens and of whole-script confusables of a text; zeros for null."""
    return _token_kinds(c)
