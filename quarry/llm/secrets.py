"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

Base kinds, leftmost and non-overlapping per kind (``assign``, ``access``, ``hex``), stay as
they are.  The kind ``random`` adds runs of key characters that a tiktoken vocabulary
can hardly shorten: fewer than ``ratio`` characters per token, or ``letter_ratio`` where they are letters only.  Natural words,
names and paths merge into longer tokens.  A run is measured over its parts of four characters or more between the
signs ``/ _ + -``, so a key in dashed groups counts as a whole.  Left out are strings known to be no secrets: hexadecimal
digests of the usual lengths, UUIDs, runs without a letter (numbers, dates), identifiers of fewer than 16 characters in such
parts, and whatever a base span already covers.

Spans are code points, end exclusive.  Defined results: null and empty texts have no
spans (the digest of the empty string); repeated rows each get the same result; an empty table gives an empty table; spans that
start alike are listed in the order of the kinds; kept columns travel in a struct, so names can't clash; texts are scanned whole,
in time that grows with their length, very long runs included.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import cache

from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import attach

# Fixed patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
LEAST = {"assign": 6, "access": 20, "hex": 24}

#: every access and hex match, and every random string, lies in such a run
RUN = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
CUES = ("passw", "secret", "token", "api")
RANDOM = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
PARTS = re.compile(r"[/_+-]+")


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@cache
def encoding(path: str):
    """The vocabulary as a tiktoken encoding, one per Python worker."""
    import public_tokenizers
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def measured(s: str) -> list[str]:
    """The parts of a run that its tokens are counted over; none for digests, identifiers, numbers and the like."""
    bare = s.rstrip("=")
    if UUID.match(s):
        return []
    parts = [p for p in PARTS.split(bare) if len(p) >= 4 and not (len(p) in DIGEST_LENGTHS and DIGEST.match(p))]
    if sum(map(len, parts)) < 16 or not any(c.isalpha() for p in parts for c in p):
        return []
    return parts


def is_random(s: str, encode, ratio: float, letter_ratio: float, chunk: int = 512) -> bool:
    parts = measured(s)
    if not parts:
        return False
    chars = sum(map(len, parts))
    tokens = sum(len(encode(p[i:i + chunk])) for p in parts for i in range(0, len(p), chunk))
    return chars < (ratio if any(c.isdigit() for p in parts for c in p) else letter_ratio) * tokens


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base kinds."""
    out = []
    lower = text.lower()
    if any(c in lower for c in CUES) or not text.isascii():
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
    for run in RUN.finditer(text):
        for k, pattern in ((1, ACCESS), (2, HEX)):
            out += [(m.start(), k, m.end()) for m in pattern.finditer(text, *run.span()) if m.end() - m.start() >= LEAST[KINDS[k]]]
    return sorted(out)


def random_spans(text: str, base: list[tuple[int, int, int]], encode, ratio: float, letter_ratio: float) -> list[tuple[int, int, int]]:
    """Runs of random characters that no base span (``base`` is sorted by start) touches."""
    out, k, covered = [], 0, 0  # covered: the furthest end of the base spans that start before the run's end
    for run in RUN.finditer(text):
        for m in RANDOM.finditer(text, *run.span()):
            a, b = m.span()
            while k < len(base) and base[k][0] < b:
                covered = max(covered, base[k][2])
                k += 1
            if covered <= a and is_random(m.group(), encode, ratio, letter_ratio):
                out.append((a, 3, b))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, keep: list[str], path: str | None = None, ratio: float = 2.2,
         letter_ratio: float = 1.9) -> DataFrame:
    """``row`` (the kept columns), the spans of every text, and the digest of the base ones."""
    path = path or tokenizer_path()

    def start():
        encode = encoding(path).encode_ordinary

        def fn(texts):
            out = {"spans": [], "base_sha256": [], "found": []}
            for text in texts:
                base = base_spans(text) if text else []
                every = sorted([*base, *(random_spans(text, base, encode, ratio, letter_ratio) if text else [])])
                out["found"].append([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in every])
                out["spans"].append(joined(every))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            return out
        return fn
    return attach(docs, keep, ["text"], "found array<struct<kind:string,start:long,end:long>>, base_sha256 string, spans string", start)


def report(docs: DataFrame, path: str | None = None, ratio: float = 2.2, letter_ratio: float = 1.9) -> DataFrame:
    """The contract's digest: counts per base kind, the base digest and all spans."""
    df = scan(docs, ["doc_id"], path, ratio, letter_ratio)

    def number(kind: str):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return df.select(F.col("row.doc_id").alias("doc_id"),
                     *map(number, KINDS[:3]),
                     "base_sha256", "spans")
