"""HTML text extraction as native column expressions (H1-H4 building blocks).

The semantics follow a lenient HTML parser's ``get_text``:
* comments and the contents of ``script``/``style`` are not text;
* a text node is the text between two tags; ``strip=True`` strips every text
  node, drops empty ones and joins the rest (with '' or a separator);
* an unclosed ``<p>`` ends at the next ``<p>``, at ``</p>`` or at a block-level
  tag (start or end), as HTML's implied end tags do;
* character references are decoded per text node in one pass, so ``&amp;lt;``
  stays ``&lt;``;
* an element of another name that begins alike (``<article-teaser>``) is another element;
* elements of one name nest: their start and end tags are matched by depth, a prefix sum over the page's tags.

No Python runs per row; everything below is regex / array expressions.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.text import strip_ws

# ---- fixed values ----
# Unicode values that HTML gives the numeric references 128-159 (code page 1252), in order
CP1252 = ("\u20ac\x81\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\x8d\u017d\x8f"
          "\x90\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\x9d\u017e\u0178")
# names and values of the named references: HTML's own table, as the standard library holds it
NAMED = html5
# names that HTML also reads without a semicolon, longest first
BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
# tags whose start or end closes an open paragraph
BLOCK_TAGS = ["address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption",
              "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu",
              "nav", "ol", "pre", "section", "table", "ul", "li", "body", "html"]

_COMMENT = r"(?s)<!--.*?-->"
# what a removed comment / script / style leaves behind: an empty tag, so the text
# before and after it stay separate text nodes (as a parser keeps them)
REMOVED = "<>"
_RAW = [r"(?is)<script\b[^>]*>.*?</script\s*>", r"(?is)<style\b[^>]*>.*?</style\s*>"]
_TAG = r"<[^>]*>"
_P_OPEN = r"(?i)<p(?:\s[^>]*)?>"
_P_END = r"(?is)</p\s*>.*|<(?:/?(?:" + "|".join(BLOCK_TAGS) + r"))(?=[\s/>]).*"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(html) -> Column:
    """Drop comments and script/style elements (their text is never document text)."""
    out = F.regexp_replace(_c(html), _COMMENT, REMOVED)
    for pat in _RAW:
        out = F.regexp_replace(out, pat, REMOVED)
    return out


def _character(num: Column) -> Column:
    """The character of a numeric reference, by HTML's rules: code page 1252 for 128-159, U+FFFD for
    zero, surrogates and numbers beyond Unicode."""
    c1 = F.substr(F.lit(CP1252), (num - 127).cast("int"), F.lit(1))
    utf32 = F.decode(F.unhex(F.lpad(F.hex(F.when((num > 159) | (num < 128), num).otherwise(63)), 8, "0")), "UTF-32")
    bad = (num == 0) | ((num >= 0xD800) & (num <= 0xDFFF)) | (num > 0x10FFFF)
    return F.when(bad, F.lit("\ufffd")).when((num >= 128) & (num <= 159), c1).otherwise(utf32)


def unescape(text) -> Column:
    """Decode character references in one pass, so what a reference yields is never read again."""
    parts = F.split(_c(text), "(?=&)")
    # folded to one constant map when the plan is made
    names = F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in NAMED.items())), F.lit("\x01"), F.lit("\x02"))
    bare = "^&(" + "|".join(BARE) + ")"

    def number(digits: Column, base: int, most: int) -> Column:
        # leading zeros don't count; more digits than any code point has are a number beyond Unicode
        short = F.regexp_replace(digits, "^0+(?=.)", "")
        value = F.conv(F.when(F.length(short) <= most, short).otherwise(F.lit("7FFFFFFF" if base == 16 else "2147483647")), base, 10)
        return _character(value.cast("long"))

    def one(p: Column) -> Column:
        dec = F.regexp_extract(p, "^&#([0-9]+)", 1)
        hexa = F.regexp_extract(p, "^&#[xX]([0-9a-fA-F]+)", 1)
        name = F.regexp_extract(p, "^&([A-Za-z][A-Za-z0-9]*;)", 1)
        short = F.regexp_extract(p, bare, 1)
        return (F.when(dec != "", F.concat(number(dec, 10, 7), F.regexp_replace(p, "^&#[0-9]+;?", "")))
                .when(hexa != "", F.concat(number(hexa, 16, 6), F.regexp_replace(p, "^&#[xX][0-9a-fA-F]+;?", "")))
                .when(F.map_contains_key(names, name), F.concat(F.element_at(names, name), F.regexp_replace(p, "^&[A-Za-z0-9]+;", "")))
                .when(short != "", F.concat(F.element_at(names, short), F.substr(p, F.length(short) + 2)))
                .otherwise(p))

    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("&"), one(p)).otherwise(p)), "")


def text_nodes(fragment) -> Column:
    """Stripped, non-empty text nodes of an HTML fragment (array<string>)."""
    nodes = F.transform(F.split(_c(fragment), _TAG),
                        lambda t: strip_ws(F.when(t.contains("&"), unescape(t)).otherwise(t)))
    return F.filter(nodes, lambda t: t != "")


def get_text(fragment, separator: str = "") -> Column:
    """``get_text(separator=..., strip=True)`` of a fragment."""
    return F.array_join(text_nodes(fragment), separator)


# ---- fixed values: elements whose end tag, which HTML demands, also ends what is still open inside ----
CONTAINERS = ["address", "article", "aside", "details", "div", "fieldset", "figure", "footer", "form", "header", "main",
              "nav", "section"]
_CHUNK, _LEVELS = 1024, 3       # 1024^3 tags: more than a page of two gigabytes holds


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(a: Column, levels: int = _LEVELS) -> Column:
    """Prefix sums of (s, m) moves; s is the sum so far and m its least value, at most 0.

    Chunks are folded by themselves, and the chunks' totals are prefix-summed in the same way, so a page of many
    tags costs no more a tag than one of few.
    """
    def add(x: Column, y: Column) -> Column:
        return F.struct((x["s"] + y["s"]).alias("s"), F.least(x["m"], x["s"] + y["m"]).alias("m"))

    def fold(chunk: Column) -> Column:
        none = F.struct(F.lit(0).alias("s"), F.lit(0).alias("m"))
        start = F.struct(none.alias("last"), F.slice(F.array(none), 1, 0).alias("out"))
        return F.aggregate(chunk, start, lambda acc, x: let(add(acc["last"], x), lambda n: F.struct(
            n.alias("last"), F.array_append(acc["out"], n).alias("out"))), lambda acc: acc["out"])

    def joined(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.element_at(c, -1))
        return F.when(F.size(chunks) == 1, F.get(chunks, F.lit(0))).otherwise(
            let(_running(totals, levels - 1), lambda before: F.flatten(F.transform(chunks, lambda c, i: F.when(
                i > 0, F.transform(c, lambda x: add(F.get(before, i - 1), x))).otherwise(c)))))

    if levels == 1:
        return fold(a)
    return let(a, lambda v: let(F.transform(F.sequence(F.lit(1), F.size(v), F.lit(_CHUNK)), lambda at: fold(F.slice(v, at, F.lit(_CHUNK)))), joined))


def depths(moves) -> Column:
    """How many elements are open after each move (+1 a start tag, -1 an end tag, 0 neither); end tags without a
    start tag don't count."""
    held = F.transform(_c(moves), lambda v: F.struct(v.alias("s"), F.least(v, F.lit(0)).alias("m")))
    return F.transform(_running(held), lambda x: x["s"] - x["m"])


def tag_parts(html, tags: list[str]) -> Column:
    """The page cut before each start and end tag of these names (array<string>)."""
    return F.split(_c(html), rf"(?i)(?=</?(?:{'|'.join(tags)})[\s/>])")


def moves(parts, tags: list[str]) -> Column:
    """+1 for a part that begins with a start tag of these names, -1 for an end tag, else 0 (array<int>)."""
    name = rf"(?:{'|'.join(tags)})[\s/>]"
    return F.transform(_c(parts), lambda p: F.when(p.rlike(f"(?i)^<{name}"), 1).when(p.rlike(f"(?i)^</{name}"), -1).otherwise(0))


def spans(moves, depth) -> Column:
    """(first, last) of every element in document order: the part of its start tag, and that of the end tag that
    brings the depth back (NULL when there is none).

    At one depth, start and end tags alternate: sorted by depth and place, a start tag's end tag comes next.
    """
    at = F.transform(_c(moves), lambda v, i: F.struct(
        F.when(v == 1, F.get(_c(depth), i)).when((v == -1) & (i > 0), F.get(_c(depth), i - 1)).otherwise(0).alias("level"),
        i.alias("place"), v.alias("move")))
    level = F.array_sort(F.filter(at, lambda e: (e["level"] > 0) & (e["move"] != 0)))

    def paired(v: Column) -> Column:
        def one(e: Column, k: Column) -> Column:
            after = F.get(v, k + 1)
            return F.struct(e["place"].alias("first"), F.when((after["level"] == e["level"]) & (after["move"] == -1), after["place"]).alias("last"),
                            e["move"].alias("move"))
        return F.transform(v, one)
    return F.array_sort(F.transform(F.filter(let(level, paired), lambda e: e["move"] == 1),
                                    lambda e: F.struct(e["first"].alias("first"), e["last"].alias("last"))))


def first_element(html, tag: str) -> Column:
    """Inner HTML of the first ``<tag>``; NULL when absent.

    Elements of the same name inside it are counted, so it ends at its own end tag; one that
    is never closed runs to the end of the page.  The page is cut at the tags of that
    name only, and the pieces are folded once.
    """
    start, end = rf"(?i)^<{tag}(?=[\s/>])", rf"(?i)^</{tag}(?=[\s/>])"
    parts = F.split(_c(html), rf"(?i)(?=</?{tag}[\s/>])")
    state = F.struct(F.lit(0).alias("depth"), F.lit(None).cast("string").alias("out"))  # depth -1: closed

    def step(a: Column, p: Column) -> Column:
        opens, closes, depth = p.rlike(start), p.rlike(end), a["depth"]
        first = opens & (depth == 0)
        return (F.when(depth < 0, a)
                .when(first, F.struct(F.lit(1).alias("depth"), F.regexp_replace(p, rf"(?is)^<{tag}(?=[\s/>])[^>]*>", "").alias("out")))
                .when(closes & (depth == 1), F.struct(F.lit(-1).alias("depth"), a["out"].alias("out")))
                .when(depth > 0, F.struct((depth + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"),
                                          F.concat(a["out"], p).alias("out")))
                .otherwise(a))
    return F.aggregate(parts, state, step, lambda a: a["out"])


def paragraphs(fragment) -> Column:
    """Inner HTML of each ``<p>`` in a fragment, with implied end tags (array<string>)."""
    pieces = F.split(_c(fragment), _P_OPEN)
    after = F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1)))
    return F.transform(after, lambda p: F.regexp_replace(p, _P_END, ""))
