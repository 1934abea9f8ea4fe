"""Benchmark decontamination with a generalised suffix automaton over the words of test items.

The automaton of a block of items holds every word sequence that occurs in an
item.  A document's words are streamed through it; the state and the length of
the longest match that ends at each word tell which windows end there.

* window: ``window`` consecutive words of an item; an item with fewer words,
  but not none, is one window as a whole;
* hit: a document word inside any occurrence of a window;
* contaminated: some word is hit and the hit share is at least ``coverage``.

Equal items are one text with all their ids, found by a grouping in Spark; texts longer than a part of a block are
cut into chunks that overlap by ``window - 1`` words, and the ids of a text into groups of bounded size, so an entry (chunk,
ids) is bounded whatever the items are.  Entries are matched in blocks of about ``block_chars`` characters, each
broadcast by itself: the broadcast is bounded however many items there are, and however many are equal.
One block (the usual case) is one map over the documents, no shuffle.  The automaton knows for each state which windows end there
and its nearest ancestor where a shorter item ends, so a word costs a few steps however repetitive the texts are.

Defined results: null or word-less texts have no words and no hits; null or
empty items never match; items that repeat a text all count; rows that repeat
an item_id count once; a null item_id is written ``null``; repeated document
rows each get the same result; an empty benchmark leaves every document clean, an empty table stays empty; very long texts are
matched whole in time that grows with their length; kept columns travel in a struct, so names can't clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import attach, col, map_batches, normal_words, text_key, written

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class WordAutomaton:
    """Generalised suffix automaton over words, with the windows that end in each state."""

    def __init__(self, items: list[tuple[list[str], list[bytes], bool]], window: int = 13):
        """items: (item_ids, words, whole); ``whole`` is False for chunks of a longer item."""
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        items = [(i, w, whole) for i, w, whole in items if w]
        for _, words, _ in items:
            last = 0
            for w in words:
                last = self._extend(last, w)
        by_length = sorted(range(1, len(self.length)), key=self.length.__getitem__)
        #: for each state the one that holds the last ``window`` words of its matches
        self.holding = [0] * len(self.length)
        for s in by_length:
            self.holding[s] = s if self.length[self.link[s]] < window else self.holding[self.link[s]]
        #: state -> items with a full window whose last words this state holds
        self.full: dict[int, set[str]] = {}
        #: state -> (number of words, items) of short items that end exactly there
        self.short: dict[int, tuple[int, set[str]]] = {}
        for item, words, whole in items:
            if len(words) < window:
                if whole:
                    s = 0
                    for w in words:
                        s = self.next[s][w]
                    self.short.setdefault(s, (len(words), set()))[1].update(item)
                continue
            for s in {self.holding[s] for _, s, n in self.stream(words) if n >= window}:
                self.full.setdefault(s, set()).update(item)
        #: for each state itself or its nearest ancestor where a short item ends, else 0
        self.marked = [0] * len(self.length)
        for s in by_length:
            self.marked[s] = s if s in self.short else self.marked[self.link[s]]
        self.least = min([window] * bool(self.full) + [n for n, _ in self.short.values()], default=0)

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = self._state({}, length[last] + 1, 0)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        c = self._state(dict(self.next[q]), self.length[p] + 1, self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _state(self, nxt: dict, length: int, link: int) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def stream(self, words: list[bytes]):
        """(position, state, match length) where the longest match is at least ``least`` words."""
        nxt, link, length, least = self.next, self.link, self.length, getattr(self, "least", self.window)
        s = n = 0
        for i, w in enumerate(words):
            t = nxt[s].get(w)
            if t is None:
                while s and t is None:
                    s = link[s]
                    t = nxt[s].get(w)
                if t is None:
                    n = 0
                    continue
                n = length[s]
            s = t
            n += 1
            if n >= least:
                yield i, s, n

    def match(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged hit spans [start, end) in words, and the ids of items with occurring windows."""
        spans: list[list[int]] = []
        if not self.least:
            return spans, set()
        full, short, marked, holding, link = self.full, self.short, self.marked, self.holding, self.link
        at_full: set[int] = set()
        at_short: set[int] = set()
        for i, s, n in self.stream(words):
            back = 0
            if n >= self.window and (h := holding[s]) in full:
                back = self.window
                at_full.add(h)
            s = marked[s]
            while s:  # each a shorter item: fewer than ``window`` of them
                if short[s][0] <= n:
                    back = max(back, short[s][0])
                    at_short.add(s)
                s = marked[link[s]]
            if back:
                a = i + 1 - back
                while spans and spans[-1][1] >= a:
                    a = min(a, spans.pop()[0])
                spans.append([a, i + 1])
        return spans, set().union(*[full[s] for s in at_full], *[short[s][1] for s in at_short])


class Block:
    """Items to match against; their automaton is built where it is first used, once per Python worker."""

    def __init__(self, items: list[tuple[list[str], list[bytes], bool]], window: int):
        self.items, self.window = items, window

    def __getstate__(self):
        return {"items": self.items, "window": self.window}

    @cached_property
    def automaton(self) -> WordAutomaton:
        return WordAutomaton(self.items, self.window)


def chunked(words: list[bytes], window: int, most: int) -> list[list[bytes]]:
    """The words in chunks of ``most`` that overlap by ``window - 1``, so every window lies in one; none without words."""
    if len(words) <= most:
        return [words] if words else []
    return [words[i:i + most] for i in range(0, len(words) - window + 1, most - window + 1)]


def entries(items: DataFrame, window: int, most_chars: int, ids_a_group: int = 10_000) -> DataFrame:
    """k, words (a chunk of the text's, joined by a space), whole and ids: every distinct text with words, in bounded rows."""
    body = F.coalesce(col(items, "text"), F.lit(""))
    name = F.coalesce(col(items, "item_id").cast("string"), F.lit("null"))
    keyed = items.select(F.xxhash64(body).alias("a"), F.xxhash64(F.lit(1), body, F.length(body)).alias("b"), name.alias("id"), body.alias("text"))
    groups = max(1, -(-items.count() // ids_a_group))
    ids = (keyed.select("a", "b", "id").distinct().groupBy("a", "b", F.pmod(F.xxhash64("id"), F.lit(groups)).alias("g"))
           .agg(F.collect_list("id").alias("ids")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                words = normal_words(text)
                most = max(2 * window, most_chars * max(1, len(words)) // max(1, len(text)))  # words of about most_chars
                parts = chunked(words, window, most)
                for i, p in enumerate(parts):
                    yield pa.RecordBatch.from_pydict({"a": pa.array([a]), "b": pa.array([b]), "part": pa.array([i], pa.int32()),
                                                      "whole": pa.array([len(parts) == 1]), "words": pa.array([b" ".join(p).decode()])})
    texts = keyed.groupBy("a", "b").agg(F.first("text").alias("text"))
    return (map_batches(texts, cut, "a long, b long, part int, whole boolean, words string").join(ids, ["a", "b"])
            .select(F.xxhash64("a", "b", "part", "g").alias("k"), "words", "whole", "ids"))


def item_blocks(items: DataFrame, window: int, block_chars: int) -> list:
    """Broadcast blocks of items, each bounded."""
    spark = items.sparkSession
    rows = written(entries(items, window, max(1, block_chars // 8)), "benchmark")
    size = F.length("words") + F.aggregate("ids", F.lit(0), lambda n, x: n + F.length(x) + 4)
    total = rows.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-2 * total // block_chars)) if total > block_chars else 1
    out = []
    for b in range(n):
        part = rows if n == 1 else rows.where(F.pmod("k", F.lit(n)) == b)
        held = [(list(r.ids), r.words.encode().split(b" "), r.whole) for r in part.toLocalIterator()]
        out.append(spark.sparkContext.broadcast(Block(held, window)))
    return out


def merged(spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Overlapping and touching spans (start, end, c_start, c_end) made one."""
    out: list[tuple[int, int, int, int]] = []
    for a, b, c, d in sorted(spans):
        if out and out[-1][1] >= a:
            first = out.pop()
            a, b, c, d = first[0], max(b, first[1]), first[2], max(d, first[3])
        out.append((a, b, c, d))
    return out


def without(text: str | None, spans: list[tuple[int, int, int, int]], least: int) -> str | None:
    """The text without the spans of ``least`` words or more; None if there is none to cut."""
    gone = [(c, d) for a, b, c, d in spans if b - a >= least]
    if not gone:
        return None
    return "".join(text[a:b] for a, b in zip([0, *[d for _, d in gone]], [*[c for c, _ in gone], len(text)]))


FIELDS = "n_words long, spans array<struct<start:int,end:int,c_start:int,c_end:int>>, item_ids array<string>"
SPAN = ("start", "end", "c_start", "c_end")


def _matcher(block, cut_words: int | None):
    def start():
        auto = block.value.automaton

        def fn(texts):
            out = {"n_words": [], "spans": [], "item_ids": [], "new_text": []}
            for text in texts:
                words = normal_words(text)
                spans, found = auto.match(words) if words else ([], ())
                if spans:
                    places = [m.span() for m in WORD.finditer(text)]
                    spans = [(a, b, places[a][0], places[b - 1][1]) for a, b in spans]
                out["n_words"].append(len(words))
                out["spans"].append([dict(zip(SPAN, s)) for s in spans])
                out["item_ids"].append(sorted(found))
                if cut_words is not None:
                    out["new_text"].append(without(text, spans, cut_words))
            return out
        return fn
    return start


def _joiner(cut_words: int | None):
    """Merges what several blocks found in a text."""
    def start():
        def fn(n_words, spans, ids, texts=None):
            out = {"n_words": n_words, "spans": [], "item_ids": [sorted(set(x)) for x in ids], "new_text": []}
            for i, held in enumerate(spans):
                own = merged([tuple(s[f] for f in SPAN) for s in held])
                out["spans"].append([dict(zip(SPAN, s)) for s in own])
                if cut_words is not None:
                    out["new_text"].append(without(texts[i], own, cut_words))
            return out
        return fn
    return start


def find_hits(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, window: int = 13,
              block_chars: int = 1_500_000, cut_words: int | None = None) -> DataFrame:
    """``row`` (the kept columns), n_words, spans (in words and code points) and item_ids of each document; with ``cut_words`` also
    new_text, the text without spans of that many words or more, null where it has none."""
    keep = docs.columns if keep is None else keep
    blocks = item_blocks(items, window, block_chars)
    fields = FIELDS if cut_words is None else FIELDS + ", new_text string"
    if len(blocks) == 1:
        return attach(docs, keep, ["text"], fields, _matcher(blocks[0], cut_words))
    body = [] if cut_words is None else [col(docs, "text").alias("text")]
    keyed = docs.select(F.struct(*text_key(docs)).alias("key"), F.struct(*[col(docs, c).alias(c) for c in keep]).alias("row"), *body)
    parts = None
    for block in blocks:
        one = attach(docs.select(F.struct(*text_key(docs)).alias("key"), "text"), ["key"], ["text"], FIELDS,
                     _matcher(block, None)).select("row.key", "n_words", "spans", "item_ids").dropDuplicates(["key"])
        parts = one if parts is None else parts.unionByName(one)
    # a row per block and document
    found = parts.groupBy("key").agg(F.max("n_words").alias("in_words"), F.flatten(F.collect_list("spans")).alias("in_spans"),
                                     F.flatten(F.collect_list("item_ids")).alias("in_ids"))
    both = keyed.join(found, "key")
    return attach(both, ["row"], ["in_words", "in_spans", "in_ids", *["text"] * len(body)], fields, _joiner(cut_words)).select(
        "row.row", *[f.split()[0] for f in ("n_words", "spans", "item_ids")], *["new_text"] * len(body))


def n_hit():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def contaminated(percent: int = 5):
    return (n_hit() > 0) & (F.lit(100) * n_hit() >= F.lit(percent) * F.col("n_words"))


def report(docs: DataFrame, items: DataFrame, window: int = 13, percent: int = 5) -> DataFrame:
    """The contract's digest per document."""
    hits = find_hits(docs, items, ["doc_id"], window)
    return hits.select(F.col("row.doc_id").alias("doc_id"), "n_words", n_hit().alias("n_hit"),
                       F.size("item_ids").cast("long").alias("n_items"),
                       F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"),
                       contaminated(percent).alias("contaminated"))


def remove_spans(docs: DataFrame, items: DataFrame, window: int = 13, percent: int = 5,
                 span_words: int | None = None) -> DataFrame:
    """The documents without contaminated ones; in the others, hit spans of ``span_words``
    words (default: a window) or more are cut from the text.  Same columns as ``docs``."""
    hits = find_hits(docs, items, window=window, cut_words=window if span_words is None else span_words)
    return with_text(hits.where(~contaminated(percent)).select("row", F.coalesce("new_text", "row.text").alias("new_text")), docs)


def with_text(df: DataFrame, docs: DataFrame) -> DataFrame:
    """``row`` with ``new_text`` as its text; an integer n_chars follows the text."""
    def value(c: str):
        old = F.col("row")[c]
        if c == "text":
            return F.col("new_text")
        if c == "n_chars" and docs.schema[c].dataType.typeName() in ("long", "integer"):
            return F.when(F.col("new_text").eqNullSafe(F.col("row")["text"]), old).otherwise(
                F.length("new_text").cast(docs.schema[c].dataType))
        return old
    return df.select(*[value(c).alias(c) for c in docs.columns])
