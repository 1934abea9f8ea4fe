"""Sum-of-squares packing, periodic runs and whitening against brute force, round trips and numpy."""

import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from quarry.llm import levels, packing, periodic, whitening
from quarry.llm.common import table

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, row string, in_text string, start string, length int, runs string, new_text string"


def docs(spark, rows, schema="doc_id long, text string, lang string"):
    width = schema.count(",") + 1
    return spark.createDataFrame([tuple([*r, *[None] * (width - len(r))]) for r in rows], schema)


# --- packing ---------------------------------------------------------------------------------------------

def squares(count, size):
    return sum(int(c) ** 2 for c in count[1:size])


@pytest.mark.parametrize("seed", range(4))
def test_level_minimises_the_sum_of_squares(seed):
    r, size = random.Random(seed), 16
    lv = levels.Levels(size, 10 ** 9)
    for i in range(400):
        s = r.choice([1, 2, 3, 5, 7, 9, 12, 15])
        options = {}
        for h in range(size - s + 1):
            if not h or lv.count[h]:
                after = lv.count.copy()
                if h:
                    after[h] -= 1
                if h + s < size:
                    after[h + s] += 1
                options[h] = squares(after, size)
        h = lv.level(s)
        assert options[h] == min(options.values())
        lv.place((i, 0, s, s, b"\0" * 4 * s))
        assert squares(lv.count, size) == options[h]
        assert [len(w) for w in lv.windows] == lv.count[:size].tolist()


def laid(rows, size):
    """checks that sequences are gapless and padded nowhere; returns the number of sequences"""
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at and length > 0
            at += length
        assert at == size or at < size and at & (at - 1) == 0
    return len(bins)


@pytest.mark.parametrize("most_open", [3, 10 ** 6])
def test_sum_of_squares_round_trip(spark, most_open):
    r = random.Random(6)
    texts = [" ".join(r.choice(["alpha", "beta", "the", "zz9", "Quux."]) for _ in range(r.choice([0, 1, 5, 40, 700]))) for _ in range(150)]
    texts += [None, "", "word " * 20_000] + ["the same"] * 40
    got = levels.pack(docs(spark, list(enumerate(texts))), ["doc_id"], size=256, most_open=most_open, with_ids=True).collect()
    e = packing.Encoder(packing.tokenizer_path())
    for d, t in enumerate(texts):
        own = sorted((x for x in got if x.row.doc_id == d), key=lambda x: x.start)
        ids = np.frombuffer(e.ids(t), "<u4").tolist() + [1]
        assert [i for x in own for i in x.ids] == ids and {x.doc_tokens for x in own} == {len(ids)}
        assert [x.start for x in own] == np.cumsum([0, *[x.length for x in own[:-1]]]).tolist()
        assert all(x.ids_crc32 == zlib.crc32(np.array(x.ids, "<u4").tobytes()) for x in own)
    total = sum(x.length for x in got)
    assert laid(got, 256) <= total // 256 + 9 * 4 * (1 + (most_open == 3) * 40)


def test_documents_stay_whole_while_they_are_placed():
    lv = levels.Levels(256, 10 ** 9)
    r, left = random.Random(1), []
    for n in (3_000, 27_000):
        for i in range(n):
            lv.add((n, i), b"\0" * 4 * r.randint(1, 255))
        left.append(lv.n_open)
    assert all(p[2] == p[3] for p in lv.out) and len(lv.out) > 25_000
    assert left[1] < 3 * left[0]  # ten times the documents, far fewer than ten times the open windows
    lv.lay_out()
    assert sum(p[2] < p[3] for p in lv.out) <= 4 * left[1]
    assert sum(p[2] for p in lv.out) == sum({p[0]: p[3] for p in lv.out}.values())


def test_packing_of_a_whole_table(spark):
    rows = levels.report(table(spark, SF, "documents")).collect()
    assert rows[0].asDict().keys() == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    laid(rows, 2048)
    assert {r.doc_id for r in rows} == {r.doc_id for r in table(spark, SF, "documents").select("doc_id").collect()}


def test_packing_edge_tables(spark):
    assert levels.report(docs(spark, [])).collect() == []
    odd = docs(spark, [(None, None, "x"), (1, "a b", "x"), (1, "a b", "x")], ODD)
    rows = levels.pack(odd).collect()
    assert sorted(r.length for r in rows if r.row.text) == [3, 3] or sum(r.length for r in rows) == 7
    assert sum(r.length for r in rows) == 7 and rows[0].row.asDict().keys() == set(odd.columns)


# --- runs ------------------------------------------------------------------------------------------------

def brute_runs(words, least=12):
    t, best = np.unique(np.array(words, object).astype(str), return_inverse=True)[1] if words else np.zeros(0, int), {}
    for q in range(1, len(t) // 2 + 1):
        at = 0
        same = [*(t[:-q] == t[q:]).tolist(), False]
        for i, s in enumerate(same):
            if not s:
                if i - at + q >= max(least, 2 * q) and i > at:
                    best.setdefault((at, i + q), q)
                at = i + 1
    return sorted((a, b, q) for (a, b), q in best.items())


def side_by_side(texts):
    t, ends = [], []
    for k, x in enumerate(texts):
        t += [*x, -1 - k]
        ends.append(len(t))
    return np.array(t, np.int32), np.array(ends)


def repetitive(r):
    kind = r.random()
    if kind < 0.3:
        return [r.randint(0, r.choice([0, 1, 2, 3])) for _ in range(r.randint(0, 150))]
    if kind < 0.7:
        base = [r.randint(0, r.choice([1, 2, 5, 50])) for _ in range(r.randint(1, 12))]
        for _ in range(r.randint(1, 3)):
            m = r.randint(1, 6)
            base = (base * m)[:max(1, len(base) * m - r.randint(0, len(base)))] + [r.randint(0, 3) for _ in range(r.randint(0, 4))]
            if r.random() < 0.3:
                base[r.randrange(len(base))] = r.randint(0, 3)
        return (base * r.randint(1, 4))[:300]
    if kind < 0.8:
        a, b = [0], [0, 1]
        while len(b) < 250:
            a, b = b, b + a
        return b[r.randint(0, 50):][:r.randint(50, 250)]
    q = r.randint(8, 90)
    s = r.randint(0, q - 1)
    return [2] * r.randint(0, 3) + (([0] * (q - 1) + [1]) * 4)[s:s + 2 * q + r.randint(0, q // 2)] + [r.randint(0, 2) for _ in range(3)]


@pytest.mark.parametrize("direct", [8, 16, 32])
def test_runs_by_brute_force(direct):
    r = random.Random(direct)
    found = 0
    for _ in range(60):
        texts = [repetitive(r) for _ in range(5)]
        t, ends = side_by_side(texts)
        want = [(a + o, b + o, q) for x, o in zip(texts, [0, *ends]) for a, b, q in brute_runs(x)]
        assert periodic.runs_of(t, ends, direct=direct) == sorted(want)
        found += len(want)
    assert found > 500


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 1), max_size=90), max_size=4))
def test_runs_of_two_letters(texts):
    t, ends = side_by_side(texts)
    want = [(a + o, b + o, q) for x, o in zip(texts, [0, *ends]) for a, b, q in brute_runs(x)]
    assert periodic.runs_of(t, ends, direct=8) == sorted(want)


def contract(doc_id, text):
    """the digest straight from the contract"""
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = [(a, b - a, q) for a, b, q in brute_runs([w.hex() for w in words])]
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
    lines = "".join(f"{a},{m},{q}\n" for a, m, q in sorted(runs, key=lambda x: (x[0], x[2])))
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    start, length, period = best or (None, None, None)
    return (doc_id, len(runs), start, length, period, 1000 * length // period if best else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_runs_report_by_the_contract(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect() if len((r.text or "").split()) < 3000]
    phrase = " ".join(f"w{i}" for i in range(50))
    rows += [(10_000 + i, t) for i, t in enumerate([None, "", " \n\t ", "a " * 11, "a " * 12, f"x {phrase} {phrase} {phrase} y", "é b " * 20,
                                                    "a\x1cb \x85 " * 15, " lead" * 14])]
    rows += [(r, " ".join(map(str, repetitive(random.Random(r))))) for r in range(20_000, 20_060)]
    got = sorted(map(tuple, periodic.report(docs(spark, rows)).collect()))
    assert got == sorted(contract(*r) for r in rows)
    assert sum(r[1] > 0 for r in got) > 40 and any(r[4] and r[4] > 32 for r in got)
    assert [t for _, t in periodic.report(docs(spark, [])).dtypes] == ["bigint"] * 6 + ["string"] * 2


def test_collapse_keeps_columns_and_odd_rows(spark):
    odd = docs(spark, [(None, None, "r"), (1, "to be " * 9, "r"), (1, "to be " * 9, "r"), (2, " a  b ", "r")], ODD)
    out = periodic.collapse(odd)
    assert out.columns == odd.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect() if r.text is not None) == [(1, "to be"), (1, "to be"), (2, " a  b ")]
    assert periodic.report(docs(spark, [])).count() == 0 and periodic.report(docs(spark, [(None, "a " * 20)])).first().n_runs == 1


@pytest.mark.parametrize("make", [lambda n: "a " * n, lambda n: ("a " * 999 + "b ") * (n // 1000), lambda n: "a " * (n // 2) + "b " + "a " * (n // 2),
                                  lambda n: " ".join(map(str, np.random.default_rng(1).integers(0, 2, n)))])
def test_long_texts_take_time_in_proportion(make):
    def took(n):
        text, best = make(n), 9e9
        for _ in range(3):
            t0 = time.process_time()
            periodic.Lot([text], None, 12, 32)
            best = min(best, time.process_time() - t0)
        return best
    took(50_000)
    assert took(600_000) < 2.5 * took(300_000) + 0.1


# --- whitening -------------------------------------------------------------------------------------------

def vectors(spark, rows, schema="vec_id long, embedding array<float>, label int"):
    width = schema.count(", ") + 1
    return spark.createDataFrame([tuple([*r, *[None] * (width - len(r))]) for r in rows], schema)


def by_numpy(vecs):
    x = np.floor(64 * np.array(vecs, np.float32).astype(float)).astype(np.int64) + 1_000_000
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    c = (n * u - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    return x, n, s, e[::-1], v[:, ::-1]


def held_against_numpy(spark, vecs, rank, rows=None):
    x, n, s, e, v = by_numpy(vecs)
    k = min(16, rank)
    got = {}
    for r in whitening.report(vectors(spark, rows or [(i, w) for i, w in enumerate(np.array(vecs, np.float32).tolist())])).collect():
        got[r.vec_id, r.component] = r
    ids = sorted({i for i, _ in got})
    assert sorted(got) == [(i, c) for i in ids for c in range(1, k + 1)]
    w = np.array([[got[i, c].whitened for c in range(1, k + 1)] for i in ids])
    assert all(r.n == n and r.identity_error < 1e-9 for r in got.values())
    assert [got[i, 1].deviation for i in ids] == [int(d) for d in ((n * x - s) ** 2).sum(axis=1)]
    assert np.allclose([got[ids[0], c].explained for c in range(1, k + 1)], e[:k] / e.sum(), rtol=1e-9)
    apart = np.append(np.diff(e[:k + 1]) / e[0] < -1e-6, True) if len(e) > k else np.append(np.diff(e[:k]) / e[0] < -1e-6, True)
    want = (n * x - s) / n @ v[:, :k] / np.sqrt(e[:k])
    for c in range(k):
        if apart[c] and (not c or apart[c - 1]):  # a single eigenvector, but for its sign
            assert min(np.abs(w[:, c] - want[:, c]).max(), np.abs(w[:, c] + want[:, c]).max()) < 1e-6
    return w, x


def test_whitening_equals_numpy(spark):
    r = np.random.default_rng(1)
    held_against_numpy(spark, r.standard_normal((300, 20)) * np.linspace(3, 0.3, 20), 20)
    held_against_numpy(spark, r.standard_normal((5, 20)), 4)  # fewer vectors than dimensions
    held_against_numpy(spark, r.integers(-3, 4, (200, 3)) @ r.integers(-2, 3, (3, 9)), 3)  # dependent dimensions
    held_against_numpy(spark, r.standard_normal((300, 6)) * [1e4, 1e3, 100, 10, 1, 1], 6)
    held_against_numpy(spark, np.repeat(r.standard_normal((40, 5)), 7, axis=0), 5)  # equal vectors count once


def test_whitening_of_equal_variances(spark):
    eye = np.vstack([np.eye(6), -np.eye(6)])
    w, x = held_against_numpy(spark, eye, 6)
    assert np.allclose(w.T @ w / len(w), np.eye(6), atol=1e-9)


def test_whitening_odd_rows(spark):
    r = np.random.default_rng(2)
    vecs = r.standard_normal((30, 4)).astype(np.float32).tolist()
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0]), (102, [float("nan"), 1.0, 1.0, 1.0]), (103, [float("inf"), 1.0, 1.0, 1.0]), (104, []), (105, [1.0])]
    held_against_numpy(spark, vecs, 4, [*bad, *[(i, v) for i, v in enumerate(vecs)]])
    for rows in ([], bad[:5], [(1, [1.0, 2.0])] * 3):
        assert whitening.report(vectors(spark, rows)).collect() == []
    odd = vectors(spark, [(i, v) for i, v in enumerate(vecs)] + [(None, vecs[0])], "vec_id long, embedding array<float>, row string, x int, whitened string, n int")
    out = whitening.whiten(odd)
    assert out.count() == 31 and out.first().row.asDict().keys() == set(odd.columns)
    huge = whitening.whiten(vectors(spark, [(1, [3e38, 1.0]), (2, [-3e38, 0.5]), (3, [0.0, 0.25])]), ["vec_id"]).collect()
    assert len(huge) == 3 and all(np.isfinite(h.whitened).all() for h in huge)
