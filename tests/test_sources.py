"""Sources and sinks: shard probing, CSV fidelity, whole-text and record reads, feeds, archives."""

import gzip
import json
import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quarry.operators import catalog as CG
from quarry.operators.feeds import flatten_feed
from quarry.sources import files as S
from quarry.sources import sinks as K
from quarry.sources.archive import read_warc_html


def _write_shards(root):
    os.makedirs(f"{root}/Corpus/a", exist_ok=True)
    os.makedirs(f"{root}/Corpus/Word_lemma_PoS", exist_ok=True)
    pd.DataFrame({"TextID": [1, 1, 2], "wordID": [10, 11, 10]}).to_parquet(f"{root}/Corpus/a/tok1.parquet")
    pd.DataFrame({"text_id": [3], "word_id": [11], "ID": [1]}).to_parquet(f"{root}/Corpus/a/tok2.parquet")
    pd.DataFrame({"wordID": [10, 11], "word": ["Cats", "ran"], "lemma": ["cat", "run"],
                  "PoS": ["N", "V"]}).to_parquet(f"{root}/Corpus/Word_lemma_PoS/lex.parquet")
    pd.DataFrame({"textID": [1, 2], "year": [1900, 1901], "genre": ["news", "fic"]}).to_csv(
        f"{root}/Corpus/texts.csv", index=False)
    pd.DataFrame({"other": [1]}).to_parquet(f"{root}/Corpus/unrelated.parquet")
    with open(f"{root}/Corpus/broken.parquet", "wb") as f:
        f.write(b"not a parquet file")


def test_shard_catalog_and_roles(spark, tmp_dir):
    _write_shards(tmp_dir)
    cat = S.shard_catalog(spark, tmp_dir)
    roles = {os.path.basename(r.path): (r.role, r.error is not None)
             for r in CG.shard_roles(cat).collect()}
    assert roles["tok1.parquet"] == ("tokens", False)
    assert roles["tok2.parquet"] == ("tokens", False)
    assert roles["lex.parquet"] == ("words", False)
    assert roles["texts.csv"] == ("texts", False)
    assert roles["unrelated.parquet"] == (None, False)
    assert roles["broken.parquet"] == (None, True)        # unreadable shard skipped, not fatal
    classified = cat.join(CG.shard_roles(cat).select("path", "role"), "path").withColumn("tier", F.lit("classified"))
    tokens = CG.resolve_role(spark, classified, "tokens", CG.normalise_tokens)
    assert sorted(tuple(r) for r in tokens.collect()) == [(1, 10, None), (1, 11, None), (2, 10, None), (3, 11, 1)]
    words = CG.resolve_role(spark, classified, "words", CG.normalise_words)
    assert sorted(r.pos for r in words.collect()) == ["N", "V"]
    texts = CG.resolve_role(spark, classified, "texts", CG.normalise_texts)
    assert sorted((r.textID, r.year) for r in texts.collect()) == [(1, 1900), (2, 1901)]
    assert CG.resolve_role(spark, classified, "nothing") is None
    with pytest.raises(ValueError):
        CG.require_inputs(None, words, texts)
    with pytest.warns(UserWarning):
        CG.require_inputs(tokens, words, None)


def test_union_relaxed_widens(spark):
    a = spark.createDataFrame([(1, 2.5)], "id int, v double")
    b = spark.createDataFrame([(2, "x")], "id bigint, s string")
    u = CG.union_relaxed([a, b])
    assert u.dtypes == [("id", "bigint"), ("v", "double"), ("s", "string")]
    assert u.count() == 2
    mixed = [spark.createDataFrame([(v,)], f"v {t}") for v, t in ((16777217, "int"), (0.5, "float"))]
    assert sorted(r.v for r in CG.union_relaxed(mixed).collect()) == [0.5, 16777217.0]
    exact = spark.sql("SELECT CAST(1.25 AS DECIMAL(5,2)) AS v")
    assert CG.union_relaxed([exact, mixed[0]]).dtypes == [("v", "decimal(12,2)")]


def test_rename_candidates_keeps_others(spark):
    df = spark.createDataFrame([(1, "x", "N", 5)], "WORD_ID int, Form string, poS string, extra int")
    out = CG.rename_candidates(df, CG.WORD_RENAMES)
    assert out.columns == ["wordID", "word", "pos", "extra"]


def test_csv_roundtrip_fidelity(spark, tmp_dir):
    rows = [(1, 'quote "here", comma', "multi\nline"), (2, "", None), (3, None, "plain")]
    df = spark.createDataFrame(rows, "id long, a string, b string")
    path = K.write_csv(df, f"{tmp_dir}/out")
    back = S.read_csv_strings(spark, path, "id long, a string, b string")
    got = sorted(tuple(r) for r in back.collect())
    assert got[0] == rows[0]
    assert got[1][1] == "" and got[1][2] is None            # '' stays '', NULL stays NULL
    assert got[2] == rows[2]
    # the file is readable by pandas (doubled quotes, embedded newline)
    pdf = pd.concat(pd.read_csv(os.path.join(path, f)) for f in os.listdir(path) if f.endswith(".csv"))
    assert sorted(pdf["id"]) == [1, 2, 3]


def test_write_if_any(spark, tmp_dir):
    empty = spark.createDataFrame([], "x int")
    assert K.write_if_any(empty, K.write_parquet, f"{tmp_dir}/e") is False
    assert not os.path.exists(f"{tmp_dir}/e")
    assert K.write_if_any(spark.range(3), K.write_parquet, f"{tmp_dir}/f") is True


def test_writes_are_observed_and_run_their_input_once(spark, tmp_dir):
    from pyspark.sql import functions as F
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(len(b))
            yield b
    df = spark.range(10).select(F.col("id").alias("k"), F.when(F.col("id") % 3 > 0, "x").alias("t")).mapInPandas(counted, "k long, t string")
    assert K.write_observed(df, K.write_parquet, f"{tmp_dir}/a", profile=["t", "k"]) == {"rows": 10, "missing_t": 4, "missing_k": 0}
    assert runs.value == 10
    # an empty result leaves what stands there, one with rows takes its place
    assert K.write_observed(df.where("k < 0"), K.write_parquet, f"{tmp_dir}/a")["rows"] == 0
    assert spark.read.parquet(f"{tmp_dir}/a").count() == 10
    assert K.write_if_any(df.where("k < 4"), K.write_csv, f"{tmp_dir}/b") and K.write_if_any(df.where("k < 4"), K.write_parquet, f"{tmp_dir}/a")
    assert spark.read.parquet(f"{tmp_dir}/a").count() == 4 and sorted(os.listdir(tmp_dir)) == ["a", "b"]


def test_whole_texts_and_records(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/articles")
    for i, t in [(1, "  first  \n"), (2, "second")]:
        with open(f"{tmp_dir}/articles/article_00{i}.txt", "w") as f:
            f.write(t)
    got = {r.filename: r.text for r in S.read_whole_texts(spark, f"{tmp_dir}/articles").collect()}
    assert got == {"article_001.txt": "  first  \n", "article_002.txt": "second"}
    sep = "\n" + "_" * 60 + "\n"
    recs = [f"Document {i} of 40\n\nbody {i}\n" + "x" * 5000 for i in range(1, 41)]
    with open(f"{tmp_dir}/dump.txt", "w") as f:
        f.write(sep.join(recs))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        df = S.read_dump_records(spark, f"{tmp_dir}/dump.txt", sep)
        assert df.rdd.getNumPartitions() > 1
        assert sorted(r.record for r in df.collect()) == sorted(recs)     # none lost at split points
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_feed_pages_flatten(spark, tmp_dir):
    page = {"status": "ok", "totalResults": 3, "articles": [
        {"source": {"id": None, "name": "Wire"}, "author": None, "title": "Dr Ann Lee speaks",
         "description": None, "url": "u1", "publishedAt": "2024-01-01T00:00:00Z", "content": "c"},
        {"source": None, "author": "A", "title": "t", "description": "d", "url": "u2",
         "publishedAt": "p", "content": None}]}
    os.makedirs(f"{tmp_dir}/feed")
    with open(f"{tmp_dir}/feed/page1.json", "w") as f:
        json.dump(page, f, indent=2)
    with open(f"{tmp_dir}/feed/page2.json", "w") as f:
        json.dump({"status": "ok", "totalResults": 0, "articles": []}, f)
    flat = flatten_feed(S.read_feed_pages(spark, f"{tmp_dir}/feed")).collect()
    assert len(flat) == 2
    by_url = {r.url: r for r in flat}
    assert by_url["u1"].source == "Wire" and by_url["u1"].author == "" and by_url["u1"].description == ""
    assert by_url["u2"].source == "" and by_url["u2"].content == ""


def _warc_record(rtype, uri, payload):
    head = (f"WARC/1.0\r\nWARC-Type: {rtype}\r\nWARC-Target-URI: {uri}\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    return head + payload + b"\r\n\r\n"


def test_warc_reader(spark, tmp_dir):
    html = "<html><article><p>café</p></article></html>".encode() + b"\xff"
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + html
    other = b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG"
    packed = gzip.compress(b"<article>zip</article>")
    chunked = b"%x\r\n%s\r\n%x;x=y\r\n%s\r\n0\r\n\r\n" % (10, packed[:10], len(packed) - 10, packed[10:])
    coded = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + chunked
    data = (_warc_record("warcinfo", "", b"software: x") + _warc_record("request", "http://a", b"GET /")
            + _warc_record("response", "http://a", body) + _warc_record("response", "http://b", other)
            + _warc_record("response", "http://c", coded))
    os.makedirs(f"{tmp_dir}/warc")
    with gzip.open(f"{tmp_dir}/warc/one.warc.gz", "wb") as f:
        f.write(data)
    rows = read_warc_html(spark, f"{tmp_dir}/warc").collect()
    assert [(r.url, r.html) for r in rows] == [("http://a", "<html><article><p>café</p></article></html>"),
                                              ("http://c", "<article>zip</article>")]


def test_archive_splits_by_gzip_member(spark, tmp_dir):
    from quarry.sources.archive import write_warc
    sizes = [0, 1, 50, 400, 3000, 20_000]
    pages = [(f"http://x/{i}", "text/html" if i % 3 else "image/png", f"<p>é{i}</p>" + os.urandom(sizes[i % 6]).hex()) for i in range(120)]
    df = spark.createDataFrame(pages, "url string, content_type string, body string").coalesce(1)
    path = write_warc(df, f"{tmp_dir}/a")
    files = [f for f in os.listdir(path) if not f.startswith(".")]
    assert len(files) == 1 and files[0].endswith(".warc.gz")
    want = sorted((u, h) for u, t, h in pages if t == "text/html")
    plain = f"{tmp_dir}/b/one.warc"
    os.makedirs(f"{tmp_dir}/b")
    with gzip.open(f"{path}/{files[0]}") as f, open(plain, "wb") as g:
        g.write(f.read())
    single = f"{tmp_dir}/c/one.warc.gz"  # the whole archive as one member
    os.makedirs(f"{tmp_dir}/c")
    with gzip.open(single, "wb") as f, open(plain, "rb") as g:
        f.write(g.read())
    for root, splits in ((path, (0, 997, 20_000, 1 << 30)), (f"{tmp_dir}/b", (0, 5_000, 100_000)), (f"{tmp_dir}/c", (0, 4_000))):
        for split in splits:
            out = read_warc_html(spark, root, split_bytes=split)
            size = os.path.getsize(os.path.join(root, next(f for f in os.listdir(root) if not f.startswith("."))))
            assert out.rdd.getNumPartitions() == (-(-size // split) if split else 1)
            rows = out.collect()
            assert sorted((r.url, r.html) for r in rows) == want, (root, split)
            assert len({(r.archive, r.record_pos, r.record_no) for r in rows}) == len(rows)


def test_damaged_and_nested_archives(spark, tmp_dir):
    from quarry.sources.archive import record_bytes, write_warc
    member = [gzip.compress(record_bytes("response", f"http://x/{i}", "text/html", f"<p>{i}</p>")) for i in range(6)]
    os.makedirs(f"{tmp_dir}/d")
    with open(f"{tmp_dir}/d/one.warc.gz", "wb") as f:  # the third member is cut short, noise holds the signature
        f.write(b"".join(member[:2]) + member[2][:40] + b"\x1f\x8b\x08 no member" + b"".join(member[3:]))
    got = sorted(r.url for r in read_warc_html(spark, f"{tmp_dir}/d").collect())
    assert got == [f"http://x/{i}" for i in (0, 1, 3, 4, 5)]
    inner = gzip.compress(record_bytes("response", "http://inner", "text/html", "<p>in</p>"))
    df = spark.createDataFrame([("http://o", "application/gzip", inner), ("http://p", "text/html", b"<p>out</p>")], "url string, content_type string, body binary")
    assert [r.url for r in read_warc_html(spark, write_warc(df.coalesce(1), f"{tmp_dir}/e"), split_bytes=0).collect()] == ["http://p"]
    assert read_warc_html(spark, write_warc(df.limit(0), f"{tmp_dir}/f")).collect() == []


def test_discovery_and_fallback(spark, tmp_dir):
    from quarry.operators import corpus as C
    _write_shards(tmp_dir)
    tokens, words, texts = CG.load_corpus(spark, tmp_dir)
    assert tokens.count() == 4 and words.count() == 2 and texts.count() == 2
    prods = C.corpus_products(tokens, words, texts, trend_lemma="cat")
    assert set(prods) == {"by_year_word", "by_year_lemma_pos", "top_lemmas_per_year", "lemma_trend"}
    assert sorted((r.year, r.n) for r in prods["lemma_trend"].collect()) == [(1900, 1), (1901, 1)]
    # texts only outside Corpus/ as Parquet: the project-wide fallback finds them
    os.remove(f"{tmp_dir}/Corpus/texts.csv")
    os.makedirs(f"{tmp_dir}/Sources")
    pd.DataFrame({"doc_id": [1], "date_year": [1950]}).to_parquet(f"{tmp_dir}/Sources/t.parquet")
    pd.DataFrame({"doc_id": [2], "year": [1960]}).to_csv(f"{tmp_dir}/Sources/t.csv", index=False)
    _, _, texts2 = CG.load_corpus(spark, tmp_dir)
    assert [(r.textID, r.year) for r in texts2.collect()] == [(1, 1950)]      # Parquet wins over CSV
    # the lexicon classified by its columns, no forced folder at all
    os.rename(f"{tmp_dir}/Corpus/Word_lemma_PoS", f"{tmp_dir}/Corpus/lexicon")
    assert CG.load_corpus(spark, tmp_dir)[1].count() == 2
    os.rename(f"{tmp_dir}/Corpus/lexicon", f"{tmp_dir}/Corpus/Word_lemma_PoS")
    # no lexicon anywhere: an error
    os.remove(f"{tmp_dir}/Corpus/Word_lemma_PoS/lex.parquet")
    with pytest.raises(ValueError):
        CG.load_corpus(spark, tmp_dir)


def test_probe_reads_whole_headers_and_raises(spark, tmp_dir):
    wide = [f"c{i}" for i in range(12000)] + ["wordID", 'two\nlines "q"']
    with open(f"{tmp_dir}/wide.csv", "w", newline="") as f:
        import csv
        csv.writer(f).writerow(wide)
        csv.writer(f).writerow(["1"] * len(wide))
    assert S.shard_catalog(spark, tmp_dir).first().columns == wide
    gone = spark.createDataFrame([("file:///no/such/shard.parquet",)], "path string")
    with pytest.raises(Exception):
        gone.mapInPandas(S._probe, S.CATALOG_SCHEMA).collect()


def test_scan_union_of_globs(spark, tmp_dir):
    pd.DataFrame({"a": [1]}).to_parquet(f"{tmp_dir}/x1.parquet")
    got = S.scan_union(spark, [f"{tmp_dir}/x*.parquet", f"{tmp_dir}/nothing*.parquet"])
    assert [r.a for r in got.collect()] == [1]
    assert S.scan_union(spark, [f"{tmp_dir}/nothing*.parquet"]) is None


def test_split_csv_equals_multiline_reader(spark, tmp_dir):
    import random
    r = random.Random(1)
    cells = ["plain", 'a "q" b', 'multi\nline\n"x"\n', "", "   ", 'comma, "', "cr\r\nlf", '"', "\n", None]
    rows = [(i, r.choice(cells), r.choice(["x", None, "", "y\nz"])) for i in range(1500)]
    schema = "id long, a string, b string"
    path = K.write_csv(spark.createDataFrame(rows, schema).repartition(3), f"{tmp_dir}/c")
    for size in (7, 1500, 1 << 20):  # ranges that cut records, quotes and characters
        df = S.read_csv_split(spark, path, schema, range_bytes=size)
        assert sorted(map(tuple, df.collect()), key=str) == sorted(rows, key=str), size
    assert S.read_csv_split(spark, path).columns == ["id", "a", "b"]
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.index("MapInArrow") < plan.index("Exchange")  # lines are read above the last exchange
    one = next(f for f in os.listdir(path) if f.endswith(".csv"))
    os.makedirs(f"{tmp_dir}/z")
    with open(f"{path}/{one}", "rb") as f, gzip.open(f"{tmp_dir}/z/a.csv.gz", "wb") as g:
        g.write(f.read())
    assert sorted(map(str, S.read_csv_split(spark, f"{tmp_dir}/z", schema, range_bytes=100).collect())) == sorted(
        map(str, S.read_csv_split(spark, f"{path}/{one}", schema).collect()))


def test_sinks_text_and_keyed(spark, tmp_dir):
    df = spark.createDataFrame([("first text",), ("second\ntext",)], "text string").coalesce(1)
    path = K.write_text_blocks(df, "text", f"{tmp_dir}/blocks")
    body = "".join(open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.startswith("part-"))
    assert body.split("\n\n")[:2] == ["first text", "second\ntext"]
    keyed = spark.createDataFrame([("article_001.txt", "x")], "filename string, text string")
    out = K.write_keyed_table(keyed, f"{tmp_dir}/articles")
    assert spark.read.parquet(out).first().filename == "article_001.txt"
    twice = spark.createDataFrame([("f", "old", 1), ("f", "new", 2), ("g", "x", 1)], "filename string, text string, pos int")
    out = K.write_keyed_table(twice, f"{tmp_dir}/last", order="pos")
    assert sorted((r.filename, r.text) for r in spark.read.parquet(out).collect()) == [("f", "new"), ("g", "x")]


def test_listing_helpers(spark, tmp_dir):
    from quarry.operators.profile import iso_window
    from quarry.sources.archive import first_archives
    os.makedirs(f"{tmp_dir}/cc")
    for n in ["c.warc.gz", "a.warc.gz", "b.txt", "d.warc.gz"]:
        with open(f"{tmp_dir}/cc/{n}", "wb") as f:      # zero-byte files yield no split in Spark
            f.write(b"x")
    got = [os.path.basename(r.path) for r in first_archives(spark, f"{tmp_dir}/cc", 2).collect()]
    assert got == ["a.warc.gz", "c.warc.gz"]
    lo, hi = iso_window(F.lit("2024-01-08").cast("date"), 7)
    assert tuple(spark.range(1).select(lo, hi).first()) == ("2024-01-01", "2024-01-08")


def test_archive_to_article_texts(spark, tmp_dir):
    from quarry.sources.archive import archive_article_texts
    pages = [b"<html><article><p>First <b>one</b></p><p>two</p></article></html>", b"<html><p>no article</p></html>"]
    data = b"".join(_warc_record("response", f"http://x/{i}",
                                 b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + p) for i, p in enumerate(pages))
    os.makedirs(f"{tmp_dir}/w")
    with gzip.open(f"{tmp_dir}/w/a.warc.gz", "wb") as f:
        f.write(data)
    rows = archive_article_texts(spark, f"{tmp_dir}/w", out=f"{tmp_dir}/texts").collect()
    assert [(r.url, r.text) for r in rows] == [("http://x/0", "First one two")]
    written = "".join(open(os.path.join(f"{tmp_dir}/texts", f)).read()
                      for f in os.listdir(f"{tmp_dir}/texts") if f.startswith("part-"))
    assert written.strip() == "First one two"


def test_layout_inventory_per_folder(spark, tmp_dir):
    for folder, names in {"Corpus/a": ["x.parquet", "y.parquet", "z.csv"], "Sources": ["t.parquet"],
                          "Text": ["n.txt"]}.items():
        os.makedirs(f"{tmp_dir}/{folder}", exist_ok=True)
        for n in names:
            with open(f"{tmp_dir}/{folder}/{n}", "wb") as f:
                f.write(b"x")
    files = S.list_files(spark, tmp_dir)
    got = {r.folder.rsplit("/", 1)[-1]: (r.n, r.pq) for r in files.groupBy("folder").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("name").endswith(".parquet")).alias("pq")).collect()}
    assert got == {"a": (3, 2), "Sources": (1, 1), "Text": (1, 0)}
    only_pq = sorted(r.name for r in S.list_files(spark, tmp_dir, "*.parquet").collect())
    assert only_pq == ["t.parquet", "x.parquet", "y.parquet"]
