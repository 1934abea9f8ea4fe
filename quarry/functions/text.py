"""Column -> Column text helpers.  All of them are native Spark expressions.

Regex dialect notes (Java regex, as used by Spark):
* ``\\w`` is ASCII in Java; Python's ``\\w`` is Unicode.  ``[\\p{L}\\p{N}_]+``
  reproduces Python's word class and also runs unchanged in DuckDB (RE2).
* ``\\s`` is ASCII unless ``(?U)`` is set; Python's ``str`` patterns and
  ``str.strip`` treat U+00A0 and friends as whitespace, so every pattern that
  must behave like Python whitespace carries ``(?U)``.
* Spark ``trim`` removes spaces only, hence :func:`strip_ws`.
* ``lpad`` truncates longer strings, hence :func:`zfill`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values (must equal the reference's behaviour) ----
# Python's whitespace (str.isspace): ASCII whitespace, U+001C-U+001F, U+0085, U+00A0,
# U+1680, U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.  Written with
# \x{...} escapes, the class means the same set in Java regex and in RE2.
PY_WS_CHARS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
PY_WS = "[" + PY_WS_CHARS + "]"
PY_NON_WS = "[^" + PY_WS_CHARS + "]"
# the same set as literal characters (for btrim)
PY_WS_SET = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
             + "\u2028\u2029\u202f\u205f\u3000")
# Python-compatible word token: Unicode letters, digits and underscore.
WORD_PATTERN = r"[\p{L}\p{N}_]+"
# Sentence boundary: whitespace run that follows '.', '!' or '?'.
SENTENCE_SPLIT = r"(?<=[.!?])" + PY_WS + "+"
# Title followed by one or more capitalised names.
TITLES = ["Dr", "Prof", "Professor", "Mr", "Ms", "Mrs"]
MENTION_PATTERN = (r"(?U)\b(?:" + "|".join(TITLES) + r")\.?" + PY_WS + r"+[A-Z][a-z]+(?:"
                   + PY_WS + r"+[A-Z][a-z]+)*")
# Modal verbs used by the persuasion heuristic.
MODALS = ["should", "must", "could", "would", "may", "might", "shall", "will"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quote_regex(term: str) -> str:
    """A literal term as a Java pattern."""
    return "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def words(c) -> Column:
    """All word tokens (Python ``re.findall(r'\\w+', x)``), as array<string>."""
    return F.regexp_extract_all(_col(c), F.lit(WORD_PATTERN), 0)


def lower_words(c) -> Column:
    """Tokens of ``lower(c)`` - the tokenisation of the persuasion heuristic."""
    return words(F.lower(_col(c)))


def sentences(c) -> Column:
    """Split after sentence punctuation (keeps trailing empties like ``re.split``)."""
    return F.split(_col(c), SENTENCE_SPLIT)


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading and trailing Unicode whitespace.

    ``btrim`` with the whitespace set touches only the two ends of the string
    (a regex would be retried at every whitespace run of a long text).
    """
    return F.btrim(_col(c), F.lit(PY_WS_SET))


def zfill(s, width) -> Column:
    """Python ``str.zfill`` for non-negative numbers: pad, never truncate."""
    s = _col(s).cast("string")
    w = width if isinstance(width, Column) else F.lit(int(width))
    return F.lpad(s, F.greatest(w, F.length(s)).cast("int"), "0")


def article_filename(num, width) -> Column:
    """``article_<zero-filled num>.txt``."""
    return F.concat(F.lit("article_"), zfill(num, width), F.lit(".txt"))


def count_in(tokens, terms) -> Column:
    """Number of elements of ``tokens`` that belong to the fixed set ``terms``."""
    lits = [F.lit(t) for t in terms]
    return F.size(F.filter(_col(tokens), lambda x: x.isin(*lits)))


def ratio(k, n) -> Column:
    """``k / n`` as double, 0.0 when ``n`` is 0."""
    return F.when(_col(n) > 0, _col(k).cast("double") / _col(n)).otherwise(F.lit(0.0))


def term_density(text, terms=MODALS, places: int = 3) -> Column:
    """Share of word tokens of ``lower(text)`` found in ``terms``, rounded.

    Spark ``round`` is half-up on the decimal value, Python ``round`` is
    half-even on the binary value; they differ on exact ties such as 1/16.
    """
    toks = lower_words(text)
    return F.round(ratio(count_in(toks, terms), F.size(toks)), places)


def mentions(c, pattern: str = MENTION_PATTERN) -> Column:
    """All title-and-name matches (group 0), array<string>."""
    return F.regexp_extract_all(_col(c), F.lit(pattern), 0)


def line_value(body, label: str, nonblank: bool = False) -> Column:
    """Value of the first line that starts with ``label:``, stripped, else ''.

    The match is line-anchored (``(?m)``) and the optional whitespace after the
    colon cannot run into the next line.  With ``nonblank`` a line whose value
    is blank is skipped, as ``^Links:\\s*(\\S.*)`` does.
    """
    lab = label.replace("/", "\\/")
    if nonblank:
        pat = rf"(?m)^{lab}:(?:(?![\n\r]){PY_WS})*({PY_NON_WS}.*)$"
    else:
        pat = rf"(?m)^{lab}:(.*)$"
    return strip_ws(F.regexp_extract(_col(body), pat, 1))


def first_match(body, pattern: str) -> Column:
    """Group 1 of the first line matching ``pattern`` (``(?m)``), stripped, else ''."""
    return strip_ws(F.regexp_extract(_col(body), "(?m)" + pattern, 1))
