"""String functions as column expressions; only NFKC and case folding need Python (Arrow batches)."""

from __future__ import annotations

import string
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of Unicode-aware regular expressions, which Java's class lacks in part.
WS = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
#: Visible ASCII is passed over at one comparison, before classes of many ranges are tried.
_NOT_SEEN = "(?![!-~])"
PUNCTUATION = string.punctuation
# Letters and numerals of Unicode 14 to 15.1, which Java 17 doesn't know.
_NEWER = """
870-887 889-88e 8b5 8c8-8c9 c5d cdd 170d 171f 1b4c 2c2f 2c5f 9ffd-9fff a7c0-a7c1 a7d0-a7d1 a7d3 a7d5-a7d9 a7f2-a7f4 10570-1057a
1057c-1058a 1058c-10592 10594-10595 10597-105a1 105a3-105b1 105b3-105b9 105bb-105bc 10780-10785 10787-107b0 107b2-107ba 10f70-10f81
11071-11072 11075 1123f-11240 11740-11746 11ab0-11abf 11f02 11f04-11f10 11f12-11f33 11f50-11f59 12f90-12ff0 1342f 13441-13446
16a70-16abe 16ac0-16ac9 1aff0-1aff3 1aff5-1affb 1affd-1affe 1b11f-1b122 1b132 1b155 1d2c0-1d2d3 1df00-1df1e 1df25-1df2a 1e030-1e06d
1e290-1e2ad 1e4d0-1e4eb 1e4f0-1e4f9 1e7e0-1e7e6 1e7e8-1e7eb 1e7ed-1e7ee 1e7f0-1e7fe 2a6de-2a6df 2b735-2b739 2ebf0-2ee5d 31350-323af
"""
WORD = "[\\p{L}\\p{N}_" + "".join("-".join(f"\\x{{{x}}}" for x in r.split("-")) for r in _NEWER.split()) + "]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once: inside lambdas, expressions are otherwise evaluated again for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def normalize_whitespace(c) -> Column:
    """Runs of white space become one space; ends are trimmed. Single spaces, which are most of it, aren't touched."""
    return F.trim(F.regexp_replace(_col(c), f"{_NOT_SEEN}(?:{WS.replace('-\\x20', '-\\x1f')}{WS}*| {_NOT_SEEN}{WS}+)", " "))


def strip(c) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(_col(c), f"\\A{WS}+|{WS}+\\z", "")


def is_blank(c) -> Column:
    """Null, empty or white space only; reads a text up to its first other character."""
    return F.coalesce(~_col(c).rlike(f"[^{WS[1:]}"), F.lit(True))


def lstrip(c) -> Column:
    return F.regexp_replace(_col(c), f"\\A{WS}+", "")


def rstrip(c) -> Column:
    return F.regexp_replace(_col(c), f"{WS}+\\z", "")


#: Bytes of text that are Python strings at once.
_SLICE = 1 << 20


def sliced(values: pa.Array, make, kind: pa.DataType) -> pa.Array:
    """``make(value)`` of each value, some of them as Python objects at a time."""
    step = max(1, len(values) * _SLICE // max(1, values.nbytes))
    made = [pa.array([make(x) for x in values.slice(at, step).to_pylist()], kind) for at in range(0, len(values), step)]
    return pa.concat_arrays(made) if made else pa.array([], kind)


def _fold(texts: pa.Array) -> pa.Array:
    return sliced(texts, lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold(), pa.string())


def _ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


# Beyond Latin letters that NFKC keeps, alone or before any of them.
_COMPOSED = "[^\\x00-\\x9f\\xa1-\\xa7\\xa9\\xab-\\xae\\xb0\\xb1\\xb6\\xb7\\xbb\\xbf-\\u012f\\u0134-\\u013e\\u0141-\\u0148\\u014a-\\u017e]"


def nfkc_casefold(c) -> Column:
    """NFKC, then full case folding. Only texts with other than composed Latin letters and ASCII go to Python."""
    other = F.when(~_ascii(_col(c)) & _col(c).rlike(f"(?![\\x00-\\x7f]){_COMPOSED}"), _col(c))
    return F.coalesce(F.arrow_udf(_fold, "string")(other), _latin_folded(_col(c)))


def _latin_folded(c: Column) -> Column:
    """Case folding of Latin letters. The empty string keeps the optimizer from taking lower(upper(x)) for lower(x)."""
    return F.replace(F.lower(F.concat(c, F.lit(""))), F.lit("ß"), F.lit("ss"))


# Beyond Latin letters that lower case folds as well.
_UNUSUAL = "(?![\\x00-\\x7f])[^\\x00-\\xb4\\xb6-\\u012f\\u0132-\\u0148\\u014a-\\u017e]"
#: Stands for the dotless i while upper case would merge it; a code point that is no character.
_ASIDE = "\uffff"
# Cherokee folds to its capitals, which lower case turns into small letters.
_SMALL = "".join(map(chr, [*range(0x13F8, 0x13FE), *range(0xAB70, 0xABC0)]))
_CAPITAL = "".join(map(chr, [*range(0x13F0, 0x13F6), *range(0x13A0, 0x13F0)]))


def _folded(c: Column) -> Column:
    """Upper case expands what has no single lower case, and lower case folds the rest. The translations keep what upper case would merge,
    fold what it leaves alone, and stop the optimizer from dropping the inner conversion."""
    up = F.upper(F.translate(c, "ıẞϴ", f"{_ASIDE}ßθ"))
    return F.translate(F.lower(F.translate(up, _ASIDE, _ASIDE)), f"ς{_ASIDE}{_SMALL}", f"σı{_CAPITAL}")


def casefold(c) -> Column:
    """Full case folding in the JVM. Texts that hold the code point put aside are folded around it."""
    whole = F.array_join(F.transform(F.split(_col(c), _ASIDE), _folded), _ASIDE)
    odd = F.when(F.contains(_col(c), F.lit(_ASIDE)), whole).otherwise(_folded(_col(c)))
    return F.when(_ascii(_col(c)), F.lower(F.concat(_col(c), F.lit("")))).when(_col(c).rlike(_UNUSUAL), odd).otherwise(_latin_folded(_col(c)))


def normalize_question(c) -> Column:
    """The key under which questions count as the same."""
    return normalize_whitespace(nfkc_casefold(_col(c)))


def normalize_answer(c) -> Column:
    """Lower case, no ASCII punctuation, no English articles, single spaces.

    An article stands between characters that are no part of words: letters, numerals of any kind and the underscore are, combining marks
    aren't, as in Python and unlike Java's word boundary. (Looking behind, Java counts UTF-16 units, of which a character has up to two.)
    """
    lowered = F.translate(F.lower(_col(c)), PUNCTUATION, "")
    # what ASCII alone decides comes first: the classes of words, of some hundred ranges, are tried at few places
    near = "(?=a|the)(?<![a-z0-9])(?=(?:an?|the)(?![a-z0-9]))"
    return normalize_whitespace(F.regexp_replace(lowered, f"{near}(?<!{WORD}{{1,2}})(a|an|the)(?!{WORD})", " "))


def answer_tokens(c) -> Column:
    """Words of the normalised answer; an empty one has none."""
    return F.filter(F.split(normalize_answer(c), " "), lambda t: t != "")


def occurrences(c, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(_col(c)) - F.length(F.replace(_col(c), F.lit(part), F.lit("")))) / len(part)).cast("int")


def split_title(c) -> tuple[Column, Column]:
    """(title, text) of a passage: the first line and the rest; without a line end all is text."""
    cut = F.instr(_col(c), "\n")
    head = F.substring_index(_col(c), "\n", 1)
    title = F.when(cut > 0, F.trim(strip(head), F.lit('"'))).otherwise("")
    body = strip(F.when(cut > 0, F.substr(_col(c), cut + 1)).otherwise(_col(c)))
    return title, body


def truncated(c, most: int | None) -> Column:
    """At most so many characters, without white space at a cut."""
    if most is None:
        return _col(c)
    return F.when(F.length(_col(c)) > most, rstrip(F.substring(_col(c), 1, most))).otherwise(_col(c))


def observation(hits: Column, most: int | None = None) -> Column:
    """Hits (array of rank, title, text) as the text between information tags."""
    shown = F.transform(hits, lambda h: F.concat(F.lit("["), h["rank"].cast("string"), F.lit("] Title: "), h["title"], F.lit("\nContent: "), truncated(h["text"], most)))
    return F.concat(F.lit("\n\n<information>"), F.array_join(shown, "\n\n"), F.lit("</information>\n\n"))


def unwrapped_observation(c, strict: bool = False) -> Column:
    """The text inside one pair of information tags; null, or with ``strict`` an error, for anything else."""
    pattern = f"(?s)\\A{WS}*<information>(.*?)</information>{WS}*\\z"
    found = F.when(_col(c).rlike(pattern), F.regexp_extract(_col(c), pattern, 1))
    return F.coalesce(found, F.raise_error(F.lit("an observation isn't in information tags")).cast("string")) if strict else found


def last_think(c) -> Column:
    """The content of the last think element, null without one."""
    return F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.regexp_extract_all(_col(c), F.lit("(?s)<think>(.*?)</think>"), F.lit(1))), -1)
