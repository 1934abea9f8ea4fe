"""The HTML column chain of :mod:`quarry.functions.html` as DuckDB SQL (oracle use only)."""

from quarry.functions import html as H
from quarry.functions.text import PY_WS


# as in quarry.functions.html, without the look-ahead that RE2 lacks
_P_END = r"(?is)</p\s*>.*|<(?:/?(?:" + "|".join(H.BLOCK_TAGS) + r"))[\s/>].*"


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{PY_WS}+|{PY_WS}+$', '', 'g')"


def clean(t: str) -> str:
    out = f"regexp_replace({t}, {sql_str(H._COMMENT)}, {sql_str(H.REMOVED)}, 'g')"
    for pat in H._RAW:
        out = f"regexp_replace({out}, {sql_str(pat)}, {sql_str(H.REMOVED)}, 'g')"
    return out


# ---- fixed values: the character references that the shipped pages and the inserted markup hold ----
REFERENCES = {"&quot;": '"', "&apos;": "'", "&#39;": "'", "&lt;": "<", "&gt;": ">", "&nbsp;": "\u00a0", "&copy;": "\u00a9",
              "&middot;": "\u00b7", "&eacute;": "\u00e9", "&bull;": "\u2022", "&#146;": "\u2019", "&#9999999;": "\ufffd",
              "&#38;lt;": "&lt;", "&amp;": "&", "&amp": "&", "&quot": '"'}


def unescape(t: str) -> str:
    out = t
    for k, v in REFERENCES.items():
        # what a reference yields is not read again: its ampersand waits as a control character
        out = f"replace({out}, {sql_str(k)}, {sql_str(v.replace('&', chr(1)))})"
    return f"replace({out}, chr(1), '&')"


def get_text(frag: str, sep: str = "") -> str:
    return (f"array_to_string(list_filter(list_transform(regexp_split_to_array({frag}, '<[^>]*>'), "
            f"lambda t: {strip(unescape('t'))}), lambda t: t <> ''), {sql_str(sep)})")


def first_element(doc: str, tag: str) -> str:
    pat = rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>"
    return f"CASE WHEN regexp_matches({doc}, {sql_str(pat)}) THEN regexp_extract({doc}, {sql_str(pat)}, 1) END"


def _move(tags: list[str]) -> str:
    name = "(?:" + "|".join(tags) + r")[\s/>]"
    return f"CASE WHEN regexp_matches(part, '(?i)^<{name}') THEN 1 WHEN regexp_matches(part, '(?i)^</{name}') THEN -1 ELSE 0 END"


def quote_ctes(src: str, key: str = "page_id") -> dict[str, str]:
    """CTEs over cleaned pages (key, doc): ``q_text`` (key, pos, q: each block quote's HTML) and ``q_rest`` (key, rest: the page
    without them)."""
    names = "|".join(["blockquote", *H.CONTAINERS])
    w = f"(PARTITION BY {key} ORDER BY i)"
    return {
        "q_cut": rf"SELECT {key}, string_split(regexp_replace(doc, '(?i)(</?(?:{names})[\s/>])', chr(1) || '\1', 'g'), chr(1)) AS parts FROM {src}",
        "q_part": f"SELECT {key}, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, len(parts) + 1 AS n FROM q_cut",
        "q_move": f"SELECT *, {_move(['blockquote'])} AS v, {_move(H.CONTAINERS)} AS c FROM q_part",
        "q_sum": f"SELECT *, sum(v) OVER {w} AS s, sum(c) OVER {w} AS sc FROM q_move",
        "q_depth": f"SELECT *, s - least(0, min(s) OVER {w}) AS d, sc - least(0, min(sc) OVER {w}) AS dc FROM q_sum",
        "q_before": f"SELECT *, coalesce(lag(d) OVER {w}, 0) AS before FROM q_depth",
        "q_level": "SELECT *, CASE v WHEN 1 THEN d ELSE before END AS level FROM q_before WHERE v = 1 OR v = -1 AND before > 0",
        "q_pair": f"SELECT *, lead(i) OVER (PARTITION BY {key}, level ORDER BY i) AS next_i, lead(v) OVER (PARTITION BY {key}, level ORDER BY i) AS next_v FROM q_level",
        "q_own": f"SELECT {key}, i AS first, dc, CASE WHEN next_v = -1 THEN next_i ELSE n END AS own FROM q_pair WHERE v = 1",
        "q_span": f"SELECT o.{key}, o.first, coalesce(min(e.i), any_value(o.own)) AS last FROM q_own o LEFT JOIN q_depth e "
                  f"ON e.{key} = o.{key} AND e.i >= o.first AND e.i < o.own AND e.dc < o.dc GROUP BY o.{key}, o.first",
        "q_text": f"SELECT s.{key}, row_number() OVER (PARTITION BY s.{key} ORDER BY s.first) - 1 AS pos, string_agg(p.part, '' ORDER BY p.i) AS q "
                  f"FROM q_span s JOIN q_part p ON p.{key} = s.{key} AND p.i >= s.first AND p.i < s.last GROUP BY s.{key}, s.first",
        "q_rest": f"SELECT p.{key}, string_agg(CASE WHEN EXISTS (SELECT 1 FROM q_span s WHERE s.{key} = p.{key} AND p.i >= s.first AND p.i < s.last) "
                  f"THEN '<blockquote>' ELSE p.part END, '' ORDER BY p.i) AS rest FROM q_part p GROUP BY p.{key}",
    }


def paragraphs(frag: str) -> str:
    return (f"list_transform(regexp_split_to_array({frag}, {sql_str(H._P_OPEN)})[2:], "
            f"lambda p: regexp_replace(p, {sql_str(_P_END)}, ''))")
