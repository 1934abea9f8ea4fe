"""The corpus pipeline against a brute-force version of its stages."""

import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from test_dedup_pack_shard import py_components, py_fingerprint
from test_text_operators import py_hits, py_kept

import __spark_entry__ as E
from quarry.llm import packing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, later int"


def corpus(seed):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(500)]

    def line(n=None):
        return " ".join(r.choice(vocab) for _ in range(n or r.randint(5, 14)))
    items = [(i, line(30)) for i in range(6)]
    shared = "\n".join(line() for _ in range(4))
    passages = [[line(60)], [line(30), line(25)], [line(51)], [line(50)]]
    texts = []
    for _ in range(90):
        lines = [line() for _ in range(r.randint(3, 25))]
        if r.random() < 0.3:
            at = r.randint(0, len(lines))
            lines[at:at] = shared.split("\n")
        if r.random() < 0.3:
            lines.insert(r.randint(0, len(lines)), r.choice(items)[1])
        if r.random() < 0.3:
            at = r.randint(0, len(lines))
            lines[at:at] = r.choice(passages)
        texts.append("\n".join(lines))
    for i in range(30):
        t = r.choice(texts[:90])
        texts.append(t if i % 2 else t.replace(t.split()[10], "zz", 1))
    texts += [None, "", "few words", "### $$ && " * 30, "LOUD WORDS HERE " * 20, "same " * 60, texts[0], line(9000).replace(" ", "\n", 40)]
    docs = [(i, t, "en", "s", None if t is None else len(t), "x", 1) for i, t in enumerate(texts)]
    return docs + [docs[5], (None, line(40), "en", "s", 0, None, None)], items


def py_pipeline(docs, items):
    docs = sorted({(d[0], d[1]) for d in docs if py_kept(d[1])}, key=lambda x: (x[0] is not None, x[0] or 0))
    first, out = {}, []
    for d, t in docs:
        lines = t.split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(" \t\r\x0b\x0c")]
        gone = set()
        for p in range(len(at)):
            for n in (1, 2, 3):  # three lines, or one or two of over 50 words together
                w = tuple(lines[i].strip(" \t\r\x0b\x0c") for i in at[p:p + n])
                if len(w) == n and (n == 3 or len(" ".join(w).split()) > 50) and first.setdefault(w, (d, p)) != (d, p):
                    gone |= set(at[p:p + n])
        out.append((d, "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    fps = {(d is None, d or 0): py_fingerprint(t) for d, t in out}
    comp = py_components(fps)
    out = [(d, t) for d, t in out if comp[(d is None, d or 0)] == (d is None, d or 0)]
    final = []
    for d, t in out:
        words, hit, _ = py_hits(t, items, 13)
        if hit and 20 * len(hit) >= len(words):
            continue
        spots = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t)]
        runs = "".join("x" if i in hit else "." for i in range(len(words)))
        for m in reversed(list(re.finditer("x{13,}", runs))):
            t = t[:spots[m.start()][0]] + t[spots[m.end() - 1][1]:]
        final.append((d, t))
    return final


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    docs, items = corpus(1)
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_run_by_brute_force(spark, tree):
    docs, items = corpus(1)
    want = py_pipeline(docs, items)
    assert 20 < len(want) < 90
    encoder = packing.Encoder(packing.tokenizer_path())
    pieces = set()
    for d, t in want:
        ids = np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4")
        pieces |= {(d, i, at, len(ids[at:at + 4096]), zlib.crc32(ids[at:at + 4096].tobytes())) for i, at in enumerate(range(0, len(ids), 4096))}
    got = corpus_pipeline.run(spark, tree).collect()
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got} == pieces and len(got) == len(pieces)
    for s in {r.sequence_id for r in got}:
        own = sorted((r.offset, r.length) for r in got if r.sequence_id == s)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 4096


def test_quality_stage_judges_every_script(spark, tree):
    russian = "Документ о порте USB " + " ".join(f"это обычное слово номер{'абвгдежз'[i % 8]}" for i in range(8))
    good = [russian, russian.replace("USB", "NATO"),
            "यह एक साफ दस्तावेज है USB " + " ".join(f"शब्द{'कखगघङचछज'[i % 8]}{'टठडढण'[i % 5]}" for i in range(24)),
            "。 ".join("".join(chr(0x4E00 + (i * 61 + j * 7) % 9000) for j in range(45)) for i in range(24)) + " USB",
            " ".join("".join(chr(0x0E01 + (i * 5 + j * 3) % 46) for j in range(50)) for i in range(24)),
            "ordinary words of a plain and clean English text that goes on for long enough to hold more than twenty different words here"]
    bad = [russian.upper(), good[-1].upper(), " ".join("x" * (60 + i) for i in range(24)),
           " ".join(chr(0x430 + i) * 60 for i in range(24)), "。 " * 30]
    df = spark.createDataFrame([(i, t, "", "", 0, "", 0) for i, t in enumerate(good + bad)], SCHEMA)
    kept = corpus_pipeline.STAGES[0][1](spark, df, tree)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(len(good)))


def test_stages_keep_columns_and_empty_tables(spark, tree):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "decontamination", "best-fit packing"]
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, tree)
        assert out.count() == 0
        if name != "best-fit packing":
            assert out.schema.simpleString() == empty.schema.simpleString()


def test_registered():
    names = set(E.queries())
    assert {"pipeline"} <= names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(E.oracle_sql()) <= names
