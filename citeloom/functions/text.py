"""Normalisation of titles and names.

Each rule is a plain function of strings, and a column function that runs it. The column
functions keep ASCII text without markup in the JVM and send only the rest to Python, in
Arrow batches; a row that needs no Python reaches the batch as null.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters that have no canonical decomposition.
_SPELLED = str.maketrans({
    "ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH", "ŋ": "ng",
    "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ı": "i", "ĸ": "k",
})
#: German and Nordic spellings of letters that decompose.
_WRITTEN_OUT = str.maketrans({base: short for base, short in zip("äöüÄÖÜåÅ", "ae oe ue Ae Oe Ue aa Aa".split(), strict=True)})
_ACCENT = re.compile(r"""\\["'`^~=.]\s*\{?(\w)\}?""")
_NAMED = re.compile(r"\\[A-Za-z]+\{(\w)\}")
_SPACED = re.compile(r"\\[A-Za-z]+\s+(\w)")
_MACROS = [(f"\\{m}", m if m not in ("aa", "AA") else m[0]) for m in ("ss", "o", "O", "l", "L", "aa", "AA", "ae", "AE", "oe", "OE", "i", "j")]
_TAG = re.compile(r"<[^>]{1,40}>")
_OTHER = re.compile(r"[^0-9a-zA-Z]+")
_BRACES = str.maketrans("", "", "{}")


def strip_accents(text: str) -> str:
    """ASCII for accented letters; letters that don't decompose are spelled."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.translate(_SPELLED)) if not unicodedata.combining(c))


def expand_diacritics(text: str) -> str:
    """As strip_accents, but umlauts and rings are written out as two letters."""
    return strip_accents(text.translate(_WRITTEN_OUT))


def delatex(text: str) -> str:
    """Accent macros as the letters they stand on, then glyph macros, in that order."""
    for form in (_ACCENT, _NAMED, _SPACED):
        text = form.sub(r"\1", text)
    for macro, letters in _MACROS:
        text = text.replace(macro, letters)
    return text


def _plain(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


def norm_text(text: str) -> str:
    """Lower-case ASCII words: entities resolved, tags, LaTeX, braces, accents and marks gone."""
    text = _TAG.sub(" ", html.unescape(text))
    return _plain(strip_accents(delatex(text).translate(_BRACES)))


def _surname(name: str) -> str:
    name = delatex(name).translate(_BRACES).strip()
    return name.partition(",")[0] if "," in name else name.rpartition(" ")[2]


def family_key(name: str) -> str:
    """The last word of the surname."""
    return norm_text(_surname(name)).rpartition(" ")[2]


def family_keys(name: str) -> set[str]:
    """All keys that a name may go by: both foldings of the surname, whole, joined, and its last word.

    Without a comma the surname may be the last word, the last two, or the one before the last.
    """
    raw = delatex(name).translate(_BRACES).strip()
    if "," in raw:
        surnames = [raw.partition(",")[0]]
    else:
        words = raw.split()
        surnames = [words[-1], " ".join(words[-2:]), words[-2]] if len(words) > 1 else [raw]
    keys: set[str] = set()
    for surname in surnames:
        for fold in (strip_accents, expand_diacritics):
            whole = _plain(fold(surname))
            keys |= {whole, whole.replace(" ", ""), whole.rpartition(" ")[2]}
    return {k for k in keys if len(k) > 1}


def _mapped(function, returns: T.DataType = T.StringType()):
    @F.pandas_udf(returns)
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None or (isinstance(v, float) and v != v) else function(v))

    return run


_strip_accents = _mapped(strip_accents)
_expand = _mapped(expand_diacritics)
_delatex = _mapped(delatex)
_norm = _mapped(norm_text)
_key = _mapped(family_key)


def _key_lists(names: Iterable[str | None]) -> list[list[str]]:
    return [sorted(family_keys(n)) for n in names if n]


_key_sets = _mapped(_key_lists, T.ArrayType(T.ArrayType(T.StringType())))
_keys = _mapped(lambda name: sorted(family_keys(name)), T.ArrayType(T.StringType()))
_each_key = _mapped(lambda names: [family_key(n) for n in names if n], T.ArrayType(T.StringType()))


def _ascii(c: Column) -> Column:
    return ~c.rlike(r"[^\x00-\x7F]")


def strip_accents_col(c: Column) -> Column:
    return F.coalesce(_strip_accents(F.when(~_ascii(c), c)), c)


def expand_diacritics_col(c: Column) -> Column:
    return F.coalesce(_expand(F.when(~_ascii(c), c)), c)


def delatex_col(c: Column) -> Column:
    return F.coalesce(_delatex(F.when(F.contains(c, F.lit("\\")), c)), c)


def ascii_norm(c: Column) -> Column:
    """norm_text of ASCII text without markup, in the JVM."""
    return F.trim(F.regexp_replace(F.lower(F.translate(c, "{}", "")), "[^0-9a-z]+", " "))


def _letters() -> tuple[dict[str, str], dict[str, str]]:
    """What norm_text makes of Latin letters and marks by themselves: one character, as it is for most, or several."""
    one, many = {}, {}
    for c in map(chr, [*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2070), 0x20AC, 0x2122]):
        if not unicodedata.combining(c):
            plain = _OTHER.sub(" ", strip_accents(c).lower())
            (one if len(plain) == 1 else many)[c] = plain
    return one, {c: plain for c, plain in many.items() if c in "ßæÆœŒþÞŋ"}


_ONE, _MANY = _letters()


def norm_col(c: Column) -> Column:
    latin = F.translate(c, "".join(_ONE), "".join(_ONE.values()))
    for letter, plain in _MANY.items():
        latin = F.replace(latin, F.lit(letter), F.lit(plain))
    easy = F.when(c.rlike(r"[^\x00-\x7F]"), latin).otherwise(c)
    hard = easy.rlike(r"[^\x00-\x7F]") | c.rlike(r"[&<\\]")
    return F.when(hard, _norm(F.when(hard, c))).otherwise(ascii_norm(easy))


def squash_col(norm: Column) -> Column:
    """Of a normalised text: without blanks, so that hyphens and line breaks don't matter."""
    return F.replace(norm, F.lit(" "), F.lit(""))


def family_key_col(c: Column) -> Column:
    return _key(c)


def family_keys_col(c: Column) -> Column:
    return _keys(c)


def each_family_key(names: Column) -> Column:
    """The key of each name of an array."""
    return _each_key(names)


def key_sets(names: Column) -> Column:
    """The key set of each name of an array, each beside its name's place: names without keys keep an empty set."""
    return _key_sets(names)
