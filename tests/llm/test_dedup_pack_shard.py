"""Line dedup, SimHash, packing and sharding against brute force, round trips and invariants."""

import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quarry.llm import linededup, packing, sharding, simhash
from quarry.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = "doc_id long, text string, row string, n_words long, later string, label int, fp string, salt int, new_text string"


def docs(spark, rows, schema=SCHEMA):
    width = schema.count(",") + 1
    return spark.createDataFrame([tuple([*r, *[None] * (width - len(r))]) for r in rows], schema)


def py_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    parts = [b" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def py_components(fps):
    """smallest id reachable over links of at most four bits, by repeated merging"""
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_copies(n, seed):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    out = []
    for i in range(n):
        if out and r.random() < 0.5:
            words = r.choice(out).split(" ")
            if r.random() < 0.6 and len(words) > 60:
                words[r.randrange(len(words))] = r.choice(vocab)
            out.append(" ".join(words))
        else:
            out.append(" ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 3, 4, 5, 80, 300, 600]))))
    return out


def test_fingerprint_by_definition():
    for t in [None, "", " \n", "One", "a b c", "A b C d", "x " * 50, *near_copies(30, 1)]:
        assert simhash.fingerprint(t) == py_fingerprint(t)


def test_simhash_components_by_brute_force(spark):
    texts = near_copies(160, 2) + [None, "", "  "]
    df = docs(spark, [(i * 7 % 1000, t) for i, t in enumerate(texts)])
    fps = {i * 7 % 1000: py_fingerprint(t) for i, t in enumerate(texts)}
    want = py_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.report(df).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert len(set(want.values())) < len(want) - 20
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_links_in_blocks_lose_nothing(spark):
    r = random.Random(4)
    centre = r.getrandbits(64)
    values = sorted({centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))) for _ in range(250)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    edges = simhash.links(fps, block=16)
    assert all(bin((e.a ^ e.b) & (2**64 - 1)).count("1") <= 4 for e in edges.collect())
    got = {r.node: r.root for r in components(edges).collect()}
    want = py_components({s: v for s, v in zip(signed, values)})
    assert {v: got.get(v, v) for v in signed} == want


def test_near_pair_across_segments_meets():
    keys = simhash.ball(32, 1)
    assert len(keys) == 33 and len(set(keys)) == 33


def test_family_under_one_segment_has_few_edges(spark):
    """thousands of fingerprints share half of their bits: the value is indexed once more, and the links span without repeating"""
    r = random.Random(5)
    low = r.getrandbits(32)
    family = {low | (x := r.getrandbits(8) * 0x01010101 & 0xFFFFFFFF) << 32 for _ in range(60)}
    while len(family) < 6000:
        base = r.choice(tuple(family)) if len(family) < 400 or r.random() < 0.02 else last
        last = base ^ 1 << (32 + r.randrange(32)) ^ 1 << (32 + r.randrange(32))
        family.add(last)
    family |= {f ^ 0b111 for f in r.sample(sorted(family), 300)} | {r.getrandbits(64) for _ in range(200)}
    signed = [v - (1 << 64) if v >> 63 else v for v in sorted(family)]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), block=256).collect()
    assert len(edges) < 2 * len(signed)
    assert all(bin((e.a ^ e.b) & (2**64 - 1)).count("1") <= 4 for e in edges)
    parent = {v: v for v in signed}

    def find(v):
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v
    for e in edges:
        parent[find(e.a)] = find(e.b)
    values, left, n = np.array(sorted(family), np.uint64), set(range(len(family))), 0
    while left:  # components by brute force
        front, n = [left.pop()], n + 1
        while front:
            near = np.flatnonzero(np.bitwise_count(values ^ values[front.pop()]) <= 4)
            new = left.intersection(near.tolist())
            left -= new
            front += new
    assert len({find(v) for v in signed}) == n


def test_forest_joins_components_only():
    fps = [0, 1, 3, 7, 1 << 40, 1 << 40 | 1]
    assert len(simhash.forest(fps, 4)) == 5
    assert simhash.forest(fps, 4, [0, 0, 0, 0, 9, 9]) == [(0, 1 << 40)] or len(simhash.forest(fps, 4, [0, 0, 0, 0, 9, 9])) == 1
    assert simhash.forest(fps, 4, [5] * 6) == []


@pytest.mark.parametrize("schema", [SCHEMA, EXTRA])
def test_edge_rows(spark, schema):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (None, None), (2, ""), (3, "x\ny\nz\nx\ny\nz"), (3, None), (4, "l " * 20000)]
    for part in (rows, []):
        df = docs(spark, part, schema)
        got = simhash.report(df).collect()
        assert len(got) == len(part)
        by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
        assert by.get(1, 1) == 1
        assert linededup.remove_lines(df).columns == df.columns
        assert linededup.report(df).count() == len(part)
        assert simhash.keep_first(df).count() == (4 if part else 0)
        packed = packing.report(df).collect()
        assert sum(r.piece == 0 for r in packed) == len(part)
        placed = sharding.report(df).collect()
        assert sorted(r.shard for r in placed) == list(range(len(part)))


def test_components_of_a_long_chain(spark):
    edges = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in components(edges).collect()} == {0}


def test_lines_later_occurrences_go(spark):
    a = "one\ntwo\nthree\nfour"
    df = docs(spark, [(1, a), (2, "zero\none\n \ntwo \nthree\nfive"), (3, "three\nfour\none"), (4, "k\nk\nk\nk\nk"), (5, "one\ntwo")])
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in linededup.report(df).collect()}
    assert got == {1: (a, 4, 0), 2: ("zero\n \nfive", 5, 3), 3: ("three\nfour\none", 3, 0), 4: ("k", 5, 4), 5: ("one\ntwo", 2, 0)}


def test_every_line_survives_somewhere(spark):
    r = random.Random(9)
    texts = ["\n".join(r.choice("abcdefg") for _ in range(r.randint(0, 30))) for _ in range(40)]
    df = docs(spark, list(enumerate(texts)))
    out = [x.text for x in linededup.report(df).collect()]
    assert {x for t in texts for x in t.split("\n")} - {""} == {x for t in out for x in t.split("\n")} - {""}
    windows = [(d, i, tuple(t.split("\n")[i:i + 3])) for d, t in enumerate(texts) for i in range(len(t.split("\n")) - 2)]
    first = {}
    for d, i, w in windows:
        first.setdefault(w, (d, i))
    gone = {(d, i + j) for d, i, w in windows if first[w] != (d, i) for j in range(3)}
    want = ["\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in enumerate(texts)]
    assert sorted(out) == sorted(want)


def test_long_lines_repeat_between_other_lines_and_in_short_texts(spark):
    def words(n, mark):
        return " ".join(f"{mark}{i}" for i in range(n))
    long, half, other = words(51, "a"), words(26, "b"), words(25, "c")
    texts = [long, f"{long} ", f"x\n{long}\ny", f"{half}\n{other}", f"u\n{half}\n \n{other}\nv", f"p\n{half}\nq", words(50, "d"), words(50, "d"),
             f"{long}\n{long}", None, ""]
    want = [long, "", "x\ny", f"{half}\n{other}", "u\n \nv", f"p\n{half}\nq", words(50, "d"), words(50, "d"), "", None, ""]
    got = {x.doc_id: x.text for x in linededup.remove_lines(docs(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_encoder_equals_the_tokenizer():
    e = packing.Encoder(packing.tokenizer_path(), most=50)
    r = random.Random(5)
    alphabet = "aB'sSt.,!3½é́ \x85 İΣς<|>startoftext \n\t日ß$̈ÀŸ"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    texts += ["A.B it's DON'T x'S", "<|startoftext|>a <|STARTOFTEXT|>", "naïve café ̈H̱", "\x00a\x1c\x7f b"]
    r.shuffle(texts)
    texts += texts[:500]  # met again after the tables changed over
    for lot in (1, 200, 1 << 23):
        for t, ids in zip(texts, e.many(texts, lot)):
            assert np.frombuffer(ids, "<u4").tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids
        assert len(e.young) <= 50 and len(e.old) <= 50
    assert e.many([]) == [] and e.many([None, "", " \n"]) == [b""] * 3


def test_packing_round_trip(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice(["alpha", "beta", "the", "zz9", "Quux."]) for _ in range(r.choice([0, 1, 5, 40, 700, 9000]))) for _ in range(120)]
    df = docs(spark, list(enumerate(texts)))
    got = packing.pack(df, ["doc_id"], with_ids=True).collect()
    e = packing.Encoder(packing.tokenizer_path())
    for d, t in enumerate(texts):
        own = sorted((x for x in got if x.row.doc_id == d), key=lambda x: x.piece)
        ids = np.frombuffer(e.ids(t), "<u4").tolist() + [1]
        assert [i for x in own for i in x.ids] == ids
        assert [x.start for x in own] == [4096 * k for k in range(len(own))]
        assert all(x.length == 4096 for x in own[:-1])
        assert all(x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes()) for x in own)
    bins = {}
    for x in got:
        bins.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(bins) <= first_fit_decreasing([x.length for x in got], 4096)


def first_fit_decreasing(lengths, most):
    left = []
    for n in sorted(lengths, reverse=True):
        k = next((i for i, r in enumerate(left) if r >= n), None)
        if k is None:
            left.append(most - n)
        else:
            left[k] -= n
    return len(left)


@pytest.mark.parametrize("seed", range(6))
def test_plan_needs_no_more_bins_than_first_fit_decreasing(seed):
    r = random.Random(seed)
    lengths = [min(4096, int(r.lognormvariate(5 + seed / 2, 1.2)) + 1) for _ in range(3000)]
    counts = {n: lengths.count(n) for n in set(lengths)}
    rows = packing.plan(counts)
    last = max(range(len(rows)), key=lambda i: rows[i][3])
    bins = max(int(s) + -(-(counts[int(n)] - int(f)) // int(u)) if not any(x[0] == n and x[1] > f for x in rows) else int(s) + 1
               for n, f, u, s, _ in rows.tolist()) if last >= 0 else 0
    assert -(-sum(lengths) // 4096) <= bins <= first_fit_decreasing(lengths, 4096)


@pytest.mark.parametrize("score", ["dot", "norm"])
def test_plan_respects_every_capacity(score):
    r = random.Random(7)
    counts = {n: r.randint(1, 9) for n in r.sample(range(1, 257), 90)}
    rows = packing.plan(counts, 256, 4, 256 ** 2, score=score)
    bins, seen = {}, {n: set() for n in counts}
    for n, first, uses, seq, off in rows.tolist():
        nexts = [x for x in rows.tolist() if x[0] == n and x[1] > first]
        last = nexts[0][1] if nexts else counts[n]
        for k in range(first, last):
            seen[n].add(k)
            bins.setdefault(seq + (k - first) // uses, []).append((off + (k - first) % uses * n, n))
    assert all(seen[n] == set(range(c)) for n, c in counts.items())
    for b in bins.values():
        assert len(b) <= 4 and sum(n for _, n in b) <= 256 and sum(n * n for _, n in b) <= 256 ** 2
        at = 0
        for off, n in sorted(b):
            assert off == at
            at += n


def test_sharding_even_and_uncut(spark):
    r = random.Random(8)
    texts = [f"single {i}" for i in range(700)] + ["hot"] * 150 + [f"pair {i // 2}" for i in range(300)] + ["", None]
    r.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {x.doc_id: x for x in sharding.report(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    by = {}
    for i, t in rows:
        x = got[i]
        assert (x.size, x.text_crc32) == (len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
        assert (x.law, x.grown_shard) == ("rows", None)
        by.setdefault(x.shard, []).append(x.slot)
    assert sorted(by) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    where = {}
    for i, t in rows:
        where.setdefault(t or "", set()).add(got[i].shard)
    assert sum(len(s) > 1 for t, s in where.items() if t != "hot") <= 2
    assert len(where["hot"]) <= 8
    plan = sharding.shard(docs(spark, rows))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("sizes, most_cut", [([2] * 800, 15), ([20] * 80, 15), ([45] * 25 + [1] * 475, 0), ([530] + [2] * 400 + [1] * 270, 8)])
def test_sharding_gathers_where_most_rows_are_linked(spark, sizes, most_cut):
    texts = [f"text {g}" for g, n in enumerate(sizes) for _ in range(n)]
    got = {x.doc_id: x for x in sharding.report(docs(spark, list(enumerate(texts)))).collect()}
    slots, where = {}, {}
    for i, t in enumerate(texts):
        slots.setdefault(got[i].shard, []).append(got[i].slot)
        where.setdefault(t, set()).add(got[i].shard)
    assert sorted(slots) == list(range(16)) and all(sorted(s) == list(range(100)) for s in slots.values())
    assert sum(len(where[f"text {g}"]) > 1 for g, n in enumerate(sizes) if n <= 100) <= most_cut
    assert all(len(where[f"text {g}"]) <= 8 for g, n in enumerate(sizes) if n > 100)
