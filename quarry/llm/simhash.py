"""SimHash near-duplicates found by multi-index hashing.

Fingerprint: words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased, every
``shingle`` consecutive ones joined by a space (repeats included; fewer words: the
whole sequence; none: fingerprint zero), hashed by XXH64 with seed 42; a bit is 1
if it is set in over half of the hashes.

Links: two fingerprints of at most ``max_bits`` differing bits differ by at most
``max_bits // segments`` in one of ``segments`` equal segments.  Every distinct
fingerprint files itself under all values of each segment's Hamming ball of half
that radius, so such two meet under some value between them; full distances are
then verified.  With 4 bits and two 32-bit segments a fingerprint has 66 entries,
and unrelated fingerprints meet about once in eight million pairs.

Fingerprints that meet under a value are linked by a spanning forest of their
verified links, not by all pairs: components are the same.  Entries go in two waves: first a segment's own value (an entry a
segment, so fewer links than entries), whose components are found; then the whole balls, where only values under which different
components meet count, and only links between components are kept.  A value that more than ``block`` fingerprints share is indexed
once more, in the same two waves, by halves of the bits outside its segment; what more than ``block`` still share then is split into
blocks, every pair of blocks a group of its own.  So a group is bounded and no link between components is lost.

Defined results: null, empty and blank texts share fingerprint zero and are
linked like any other; exact copies meet in the grouping by fingerprint; rows
that repeat id and text are one document; null ids don't count as the smallest
id of a component unless there is no other (then the component id is null); an empty table gives an empty table; very long texts
are hashed whole, their bits counted a part at a time; columns of ``docs`` travel in a struct, so names can't clash.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quarry.llm.common import attach, col, map_batches, written
from quarry.llm.components import components

#: counts of a byte's bits, bit by bit
BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
SLOTS = np.arange(8) * 256


def fingerprint(text: str | None, shingle: int = 4) -> int:
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(whole, 42)
    ends = list(accumulate(map(len, words), lambda at, n: at + n + 1))  # where each word ends
    h = xxhash.xxh64_intdigest
    starts = [0, *[e + 1 for e in ends]]
    hashes = np.fromiter((h(whole[a:b], 42) for a, b in zip(starts, ends[shingle - 1:])), np.uint64, len(words) - shingle + 1)
    counts = np.zeros((8, 8), np.int64)
    for at in range(0, len(hashes), 200_000):
        part = hashes[at:at + 200_000].view(np.uint8).reshape(-1, 8)
        counts += np.bincount((part + SLOTS).ravel(), minlength=2048).reshape(8, 256) @ BITS
    return int(np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").reshape(8).view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, k_h (hash of the text) and fp of every row."""
    def start():
        def fn(texts):
            return {"fp": [f - (1 << 64) if (f := fingerprint(t, shingle)) >> 63 else f for t in texts]}
        return fn

    keyed = docs.select(col(docs, "doc_id").alias("doc_id"), col(docs, "text").alias("text"),
                        F.xxhash64(F.coalesce(col(docs, "text"), F.lit(""))).alias("k_h"))
    return attach(keyed, ["doc_id", "k_h"], ["text"], "fp long", start).select("row.doc_id", "row.k_h", "fp")


def ball(bits: int, radius: int) -> list[int]:
    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]


def _signed(n: int) -> int:
    return n if n < 1 << 63 else n - (1 << 64)


def values(fp: Column, lo: int, hi: int, max_bits: int, parts: int, tag: int = 0) -> list[list[Column]]:
    """The values under which a fingerprint files itself by the bits [lo, hi) cut into ``parts`` segments: its own ones, and all of
    the balls.  Different segments' values differ in a tag above their bits."""
    edges = [lo + (hi - lo) * i // parts for i in range(parts + 1)]
    radius = (max_bits // parts + 1) // 2
    out: list[list[Column]] = [[], []]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        part = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit(_signed((1 << (b - a)) - 1))) if b - a < 64 else fp
        # a whole or nearly whole word has no room for a tag; it is the only segment then
        mark = (tag * parts + i) << (b - a) if b - a < 60 else 0
        for m in ball(b - a, radius):
            value = part.bitwiseXOR(F.lit(_signed((m | mark) & (1 << 64) - 1)))
            out[1].append(value)
            if not m:
                out[0].append(value)
    return out


def forest(fps: list[int], max_bits: int, roots: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links of at most ``max_bits`` between the fingerprints; with ``roots`` only those of its links that
    join different components."""
    left = np.unique(np.array(fps, np.int64).view(np.uint64))
    out = []
    while len(left):
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            u, front = front[0], front[1:]
            near = np.bitwise_count(left ^ u) <= max_bits
            if near.any():
                got = left[near]
                out += [(int(np.int64(u.astype(np.int64))), int(v)) for v in got.astype(np.int64)]
                front, left = np.concatenate([front, got]), left[~near]
    if roots is None:
        return out
    of, parent = dict(zip(fps, roots)), {r: r for r in roots}

    def find(r: int) -> int:
        while parent[r] != r:
            parent[r] = r = parent[parent[r]]
        return r
    kept = []
    for a, b in out:
        x, y = find(of[a]), find(of[b])
        if x != y:
            parent[x] = y
            kept.append((a, b))
    return kept


def _forests(groups: DataFrame, max_bits: int) -> DataFrame:
    """a, b: the links in groups of (fp, root)."""
    def run(batches):
        for batch in batches:
            found = [e for g in batch.column(0).to_pylist() for e in forest([x["fp"] for x in g], max_bits, [x["root"] for x in g])]
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found], pa.int64()),
                                              "b": pa.array([b for _, b in found], pa.int64())})
    return map_batches(groups, run, "a long, b long")


def met(rows: DataFrame, on: list[str], name: str) -> DataFrame:
    """The rows (fp, root) that fingerprints of other components share ``on`` with, and how many share it (n), written.

    Counted by a grouping with map-side combine, then joined, so that a hot value's rows can be split.
    """
    counts = written(rows.groupBy(*on).agg(F.count("*").alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1"))
                     .where("n > 1 and r0 <> r1").select(*on, "n"), f"{name}-counts")
    return written(rows.join(counts, on), name)


def _in_blocks(rows: DataFrame, on: list[str], block: int) -> DataFrame:
    """Groups of the rows that share ``on``; one of more than ``block`` rows is split, a group for each pair of its blocks."""
    blocks = F.ceil(F.col("n") / block).cast("int")
    member = F.struct("fp", "root")
    return (rows.withColumn("own", F.pmod(F.xxhash64("fp"), blocks).cast("int"))
            .select(*on, "fp", "root", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
            .groupBy(*on, F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
            .agg(F.collect_list(member).alias("fps")).where(F.size("fps") > 1).select("fps"))


def waves(fps: DataFrame, own: list[Column], every: list[Column], on: list[str], max_bits: int, link) -> DataFrame:
    """a, b: links between the components of ``fps`` (``on``, fp, root) that meet under ``own`` values, then, their components
    known, under ``every`` one.  ``link`` turns rows that share a value into links."""
    def filed(rows: DataFrame, keys: list[Column]) -> DataFrame:
        return rows.select(*on, "fp", "root", F.explode(F.array(*keys)).alias("key"))
    first = written(link(met(filed(fps, own), [*on, "key"], "simhash-own"), [*on, "key"]).distinct(), "simhash-links")
    if len(every) == len(own):
        return first
    roots = joined_roots(fps.select("fp", "root").distinct(), first)
    later = fps.drop("root").join(roots.select("fp", "root"), "fp")
    return first.unionByName(link(met(filed(later, every), [*on, "key"], "simhash-met"), [*on, "key"]).distinct())


def joined_roots(of: DataFrame, links: DataFrame) -> DataFrame:
    """``of`` (fp, root) with the components that the links join made one, written."""
    ends = [of.withColumnsRenamed({"fp": x, "root": f"r{x}"}) for x in ("a", "b")]
    between = links.join(ends[0], "a").join(ends[1], "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    moved = components(between).select(F.col("node").alias("root"), F.col("root").alias("to"))
    return written(of.join(moved, "root", "left").select("fp", F.coalesce("to", "root").alias("root")), "simhash-roots")


def links(fps: DataFrame, max_bits: int = 4, segments: int = 2, block: int = 2048) -> DataFrame:
    """a, b: edges between distinct fingerprints that span all links of at most ``max_bits``."""
    own, every = values(F.col("fp"), 0, 64, max_bits, segments)
    width, around = 64 // segments, len(every) // segments  # values in a ball

    def again(rows: DataFrame) -> DataFrame:
        """Links under values that more than a block share: by halves of the bits outside the value's segment."""
        turned = F.shiftleft("fp", 64 - width).bitwiseOR(F.shiftrightunsigned("fp", width))
        out = F.when(F.shiftrightunsigned("outer", width) == 0, turned).otherwise(F.col("fp"))  # the other bits, lowest
        return waves(rows.select(F.col("key").alias("outer"), "fp", "root"), *values(out, 0, 64 - width, max_bits, 2), ["outer"], max_bits,
                     lambda r, by: _forests(_in_blocks(r, by, block), max_bits))

    def link(rows: DataFrame) -> DataFrame:
        small = _forests(rows.where(F.col("n") <= block).groupBy("key").agg(F.collect_list(F.struct("fp", "root")).alias("fps")).select("fps"), max_bits)
        hot = rows.where(F.col("n") > block)
        if hot.isEmpty():
            return small
        return small.unionByName(again(hot) if segments == 2 else _forests(_in_blocks(hot, ["key"], block), max_bits))

    # first wave: a segment's own value
    alone = fps.select("fp", F.col("fp").alias("root"))
    shared = met(alone.select("fp", "root", F.explode(F.array(*own)).alias("key")), ["key"], "simhash-own")
    first = written(link(shared).distinct(), "simhash-links")
    if len(every) == len(own):
        return first
    # second wave: the balls.  Of a value near no crowded one few fingerprints file themselves, so one shuffle gathers them; a root that
    # is the fingerprint itself travels as null
    roots = joined_roots(alone, first).select("fp", F.nullif("root", "fp").alias("root"))
    rows = roots.select("fp", "root", F.explode(F.array(*every)).alias("key"))
    crowded = shared.where(F.col("n") > block // around).select("key").distinct()
    more = []
    if not crowded.isEmpty():
        near = crowded.select(F.explode(F.array(*[F.col("key").bitwiseXOR(F.lit(m)) for m in ball(width, (max_bits // segments + 1) // 2)])).alias("key")).distinct()
        near = written(near, "simhash-crowded")
        more.append(link(met(rows.join(near, "key", "left_semi").withColumn("root", F.coalesce("root", "fp")), ["key"], "simhash-met")))
        rows = rows.join(near, "key", "left_anti")
    groups = (rows.groupBy("key").agg(F.collect_list(F.struct("fp", "root")).alias("held")).where(F.size("held") > 1)
              .select(F.transform("held", lambda x: F.struct(x["fp"].alias("fp"), F.coalesce(x["root"], x["fp"]).alias("root"))).alias("fps"))
              .where(F.exists("fps", lambda x: x["root"] != F.col("fps")[0]["root"])))
    found = _forests(groups, max_bits)
    for m in more:
        found = found.unionByName(m)
    return first.unionByName(found.distinct())


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, segments: int = 2) -> DataFrame:
    """doc_id, k_h, fp and first (no_id, doc_id, k_h of the smallest document) of every row's component."""
    fps = written(fingerprints(docs, shingle), "simhash-fps")
    distinct = written(fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k_h")).alias("first")),
                       "simhash-distinct")
    roots = components(written(links(distinct.select("fp"), max_bits, segments), "simhash-all")).withColumnRenamed("node", "fp")
    of = distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    # written, so that the join deals both sides anew and can split a large component's rows
    least = written(of.groupBy("root").agg(F.min("first").alias("first")), "simhash-least")
    return fps.join(of.select("fp", "root").join(least, "root").select("fp", "first"), "fp")


def report(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """The contract's digest: doc_id, fingerprint, component_id."""
    return near_duplicates(docs, shingle, max_bits).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_first(docs: DataFrame, shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One document of each component: the one of the smallest id (ties: smallest text hash; of
    rows that repeat both, one).  Same columns as ``docs``."""
    def key(doc_id, text_hash):  # one value, never null: the join and the grouping share one shuffle of the texts
        return F.concat(F.when(doc_id.isNull(), F.lit("n")).otherwise(F.concat(F.lit("d"), doc_id.cast("string"))), F.lit(":"), F.hex(text_hash))

    chosen = near_duplicates(docs, shingle, max_bits).select(key(F.col("first.doc_id"), F.col("first.k_h")).alias("key")).distinct()
    nested = docs.select(F.struct(*[col(docs, c).alias(c) for c in docs.columns]).alias("row"),
                         key(col(docs, "doc_id"), F.xxhash64(F.coalesce(col(docs, "text"), F.lit("")))).alias("key"))
    return nested.join(chosen, "key", "left_semi").groupBy("key").agg(F.first("row").alias("row")).select("row.*")
