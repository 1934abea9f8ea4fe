"""Shard discovery, role classification and normalisation (corpus front end).

Roles come from lower-cased column names; shards are then projected onto
one canonical schema per role.  Everything is driven by column names, so a
shard's schema decides the plan; no data is read to classify it.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- fixed values: column-name candidates per role (lower case) ----
TEXTID_NAMES = ["textid", "text_id", "docid", "doc_id"]
WORDID_NAMES = ["wordid", "word_id"]
WORDISH_NAMES = ["word", "token", "form", "lemma", "pos", "upos", "xpos", "tag"]
YEARISH_NAMES = ["year", "date_year", "decade", "genre", "section"]
# exploration labels (non-exclusive)
FULLTEXT_NAMES = ["text", "body", "content", "full_text"]
WORDS_LABEL_NAMES = ["lemma", "word", "pos", "tag"]
METADATA_NAMES = ["year", "decade", "genre", "section"]

# canonical rename maps (standard name -> candidates, first present wins)
TOKEN_RENAMES = {"textID": TEXTID_NAMES, "wordID": WORDID_NAMES, "occID": ["id", "occurrence_id"]}
WORD_RENAMES = {"wordID": WORDID_NAMES, "word": ["word", "token", "form"], "lemma": ["lemma"],
                "pos": ["pos", "upos", "xpos", "tag"]}
TEXT_RENAMES = {"textID": TEXTID_NAMES, "year": ["year", "date_year"], "decade": ["decade"],
                "genre": ["genre", "section"]}

TOKENS_SCHEMA = T.StructType([T.StructField("textID", T.LongType()), T.StructField("wordID", T.LongType()),
                              T.StructField("occID", T.LongType())])
WORDS_SCHEMA = T.StructType([T.StructField("wordID", T.LongType()), T.StructField("word", T.StringType()),
                             T.StructField("lemma", T.StringType()), T.StructField("pos", T.StringType())])
TEXTS_SCHEMA = T.StructType([T.StructField("textID", T.LongType()), T.StructField("year", T.IntegerType()),
                             T.StructField("decade", T.IntegerType()), T.StructField("genre", T.StringType())])


def _lower_map(df: DataFrame) -> dict[str, str]:
    out: dict[str, str] = {}
    for c in df.columns:
        out.setdefault(c.lower(), c)
    return out


def _first(cols: dict[str, str], candidates) -> str | None:
    for k in candidates:
        if k in cols:
            return cols[k]
    return None


# ---------------------------------------------------------------- N1-N3
def _normalise(df: DataFrame, renames: dict[str, list[str]], types: dict[str, str], keep_missing: bool, lenient: bool) -> DataFrame:
    cols = _lower_map(df)
    out = []
    for name, dtype in types.items():
        src = _first(cols, renames[name])
        if src is not None:
            c = F.col(f"`{src}`")
            out.append((c.try_cast(dtype) if lenient else c.cast(dtype)).alias(name))
        elif keep_missing:
            out.append(F.lit(None).cast(dtype).alias(name))
    return df.select(out)


def normalise_tokens(df: DataFrame, keep_missing: bool = True, lenient: bool = False) -> DataFrame:
    """textID, wordID (long) and the optional occurrence id ``id`` -> occID.

    ``lenient`` casts with ``try_cast`` (a bad value becomes NULL); by default a bad value raises.
    """
    return _normalise(df, TOKEN_RENAMES | {"occID": ["id"]}, {"textID": "bigint", "wordID": "bigint", "occID": "bigint"}, keep_missing, lenient)


def normalise_words(df: DataFrame, keep_missing: bool = True, lenient: bool = False) -> DataFrame:
    """wordID long; word, lemma and pos strings."""
    return _normalise(df, WORD_RENAMES, {"wordID": "bigint", "word": "string", "lemma": "string", "pos": "string"}, keep_missing, lenient)


def normalise_tagged(df: DataFrame, keep_missing: bool = True, lenient: bool = False) -> DataFrame:
    """Tagged layout (per-token rows keyed by textID, no wordID)."""
    return _normalise(df, WORD_RENAMES | {"textID": TEXTID_NAMES}, {"textID": "bigint", "word": "string", "lemma": "string", "pos": "string"},
                      keep_missing, lenient)


def normalise_lexicon(df: DataFrame) -> DataFrame:
    """A words shard by its own columns: the lexicon layout if it has a wordID, else the tagged one; absent columns stay absent."""
    cols = _lower_map(df)
    tagged = _first(cols, WORDID_NAMES) is None and _first(cols, TEXTID_NAMES) is not None
    return (normalise_tagged if tagged else normalise_words)(df, keep_missing=False)


def normalise_texts(df: DataFrame, keep_missing: bool = True, lenient: bool = False) -> DataFrame:
    """textID long, year int (year or date_year), decade int, genre string (genre or section)."""
    return _normalise(df, TEXT_RENAMES, {"textID": "bigint", "year": "int", "decade": "int", "genre": "string"}, keep_missing, lenient)


# ---------------------------------------------------------------- N4
def rename_candidates(df: DataFrame, mapping: dict[str, list[str]]) -> DataFrame:
    """Rename the first present candidate of each standard name (case-insensitive).

    Other columns are kept.  Candidates are compared in lower case, so mixed
    case spellings such as ``PoS`` match as ``pos``.
    """
    cols = _lower_map(df)
    ren: dict[str, str] = {}
    for std, cands in mapping.items():
        src = _first(cols, [c.lower() for c in cands])
        if src is not None and src not in ren:
            ren[src] = std
    return df.withColumnsRenamed(ren) if ren else df


# ---------------------------------------------------------------- N6
_INTEGER_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}


def _widen(types: list[str]) -> str:
    """The type that holds every value of the given types, else string.

    Integers widen to the larger one; integers with decimals to a decimal of enough digits; a
    float or double with anything numeric to double (float alone stays).
    """
    types = sorted({t for t in types if t != "void"})
    if len(types) <= 1:
        return types[0] if types else "string"
    decimals = [tuple(map(int, t[8:-1].split(","))) for t in types if t.startswith("decimal(")]
    integers = [t for t in types if t in _INTEGER_DIGITS]
    floats = [t for t in types if t in ("float", "double")]
    if len(decimals) + len(integers) + len(floats) < len(types):
        return "string"
    if floats:
        return "double"
    if decimals:
        scale = max(s for _, s in decimals)
        whole = max([p - s for p, s in decimals] + [_INTEGER_DIGITS[t] for t in integers])
        return f"decimal({whole + scale},{scale})" if whole + scale <= 38 else "string"
    return max(integers, key=_INTEGER_DIGITS.__getitem__)


def union_relaxed(frames: list[DataFrame]) -> DataFrame:
    """Vertical union by name with type widening (cast first, then union).

    Columns missing from a frame become NULL.  Mixed numeric types widen to
    one that holds all their values; anything else mixed becomes string.  Casting
    before the union avoids Spark's ANSI int/string union coercion.
    """
    frames = [f for f in frames if f is not None]
    if not frames:
        return None
    names: list[str] = []
    for f in frames:
        for c in f.columns:
            if c not in names:
                names.append(c)
    target = {}
    for n in names:
        target[n] = _widen([dict(f.dtypes)[n] for f in frames if n in f.columns])
    aligned = [f.select([(F.col(f"`{n}`") if n in f.columns else F.lit(None)).cast(target[n]).alias(n)
                         for n in names]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b), aligned)


# ---------------------------------------------------------------- C2-C4
def _has_any(cols: Column, names) -> Column:
    return F.arrays_overlap(cols, F.array(*[F.lit(n) for n in names]))


def role_flags(catalog: DataFrame, cols_col: str = "columns") -> DataFrame:
    """Add has_textid / has_wordid / has_wordish / has_yearish from lower-cased names."""
    low = F.transform(F.col(cols_col), lambda c: F.lower(c))
    return catalog.withColumns({
        "has_textid": _has_any(low, TEXTID_NAMES),
        "has_wordid": _has_any(low, WORDID_NAMES),
        "has_wordish": _has_any(low, WORDISH_NAMES),
        "has_yearish": _has_any(low, YEARISH_NAMES),
    })


def shard_roles(catalog: DataFrame, cols_col: str = "columns") -> DataFrame:
    """Exclusive role, first match wins: tokens, words, texts, else NULL."""
    f = role_flags(catalog, cols_col)
    t, w, wi, y = (F.col("has_textid"), F.col("has_wordid"), F.col("has_wordish"), F.col("has_yearish"))
    role = (F.when(t & w & ~(wi | y), F.lit("tokens"))
            .when(w & wi & ~t, F.lit("words"))
            .when(t & y & ~w, F.lit("texts")))
    return f.withColumn("role", role)


def shard_labels(catalog: DataFrame, cols_col: str = "columns", path_col: str = "path",
                 limit: int | None = None) -> DataFrame:
    """C4: non-exclusive labels of all shards, or of the first ``limit`` by path."""
    low = F.transform(F.col(cols_col), lambda c: F.lower(c))
    shown = catalog if limit is None else catalog.orderBy(path_col).limit(limit)
    return (shown.withColumns({"full_text": _has_any(low, FULLTEXT_NAMES),
                          "words": _has_any(low, WORDS_LABEL_NAMES),
                          "metadata": _has_any(low, METADATA_NAMES)}))


# ---------------------------------------------------------------- C5/C6
ROLE_TIERS = ["classified", "forced_words_folder", "parquet", "csv"]
FORCED_WORDS_FOLDER = "Word_lemma_PoS"


def resolve_role(spark: SparkSession, catalog: DataFrame, role: str, normalise=None, reader=None) -> DataFrame | None:
    """Pick the shards of one role by discovery tier, read and normalise them.

    ``catalog`` has columns (path, format, columns, tier, role).  The first
    tier that has shards wins (classified, then the forced ``Word_lemma_PoS``
    folder, then project-wide Parquet, then CSV).  Shards are read once per
    schema (format + column list), normalised, then unioned with widening.
    What reaches the driver is a row per (folder, schema): a folder whose shards of that
    format all have the role and the schema is read as a folder; file paths are
    listed only for the shards of mixed folders.
    """
    rank = F.element_at(F.create_map(*[x for i, t in enumerate(ROLE_TIERS) for x in (F.lit(t), F.lit(i))]), F.col("tier"))
    mine = catalog.filter(F.col("role") == role).withColumn("rank", rank)
    best = mine.agg(F.min("rank")).first()[0]
    if best is None:
        return None
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    mine = mine.filter(F.col("rank") == best).withColumn("folder", folder)
    every = (catalog.select("path", "format", "columns").distinct().withColumn("folder", folder)
             .groupBy("folder", "format").agg(F.count(F.lit(1)).alias("all_files")))
    own = mine.groupBy("folder", "format", "columns").agg(F.count_distinct("path").alias("files"))
    rows = own.join(every, ["folder", "format"]).collect()
    groups: dict[tuple, tuple[list[str], list[str]]] = {}
    for r in rows:
        whole, single = groups.setdefault((r["format"], tuple(r["columns"])), ([], []))
        if r["files"] == r["all_files"]:
            whole.append(r["folder"])
        else:
            part = mine.filter((F.col("folder") == r["folder"]) & (F.col("format") == r["format"])
                               & (F.col("columns") == F.array(*[F.lit(c) for c in r["columns"]])))
            single += [x["path"] for x in part.select("path").distinct().toLocalIterator()]
    frames = []
    for (fmt, _cols), (whole, single) in sorted(groups.items()):
        for paths in (sorted(whole), sorted(single)):
            if paths:
                df = reader(paths, fmt) if reader is not None else _read_shards(spark, paths, fmt, paths[0] in whole)
                frames.append(normalise(df) if normalise is not None else df)
    return union_relaxed(frames)


def _read_shards(spark: SparkSession, paths: list[str], fmt: str, folders: bool) -> DataFrame:
    from quarry.sources.files import read_csv_split
    if fmt == "csv":
        return read_csv_split(spark, [f"{p}/*.csv" for p in paths] if folders else paths)
    reader = spark.read.option("pathGlobFilter", "*.parquet") if folders else spark.read
    return reader.parquet(*paths)


def discovery_catalog(spark: SparkSession, base: str, corpus_folder: str = "Corpus") -> DataFrame:
    """Every shard under ``base`` with its role and discovery tier.

    Tiers: ``classified`` (shards under ``base/Corpus``), ``forced_words_folder``
    (any Parquet shard under ``Corpus/Word_lemma_PoS`` counts as lexicon),
    ``parquet`` / ``csv`` (project-wide fallback, words and texts only).  The tree is listed
    and probed once, the result (a row per shard) written to the shared folder; a tier whose
    folder is absent simply has no shards.
    """
    from quarry.session import shared_dir
    from quarry.sources.files import shard_catalog
    path = shared_dir(spark, "shards")
    top = spark._jvm.org.apache.hadoop.fs.Path(base.rstrip("/"))
    root = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString()
    shard_roles(shard_catalog(spark, base.rstrip("/"))).filter(F.col("error").isNull()).write.parquet(path)
    shards = spark.read.parquet(path)
    corpus = F.col("path").startswith(f"{root}/{corpus_folder}/")
    forced = F.col("path").startswith(f"{root}/{corpus_folder}/{FORCED_WORDS_FOLDER}/") & (F.col("format") == "parquet")
    wide = F.col("role").isin("words", "texts")
    tiers = F.array_compact(F.array(
        F.when(corpus, F.struct(F.lit("classified").alias("tier"), F.col("role").alias("role"))),
        F.when(forced, F.struct(F.lit("forced_words_folder").alias("tier"), F.lit("words").alias("role"))),
        F.when(wide, F.struct(F.col("format").alias("tier"), F.col("role").alias("role"))),
        F.struct(F.lit("unused").alias("tier"), F.lit(None).cast("string").alias("role"))))
    return (shards.select("path", "format", "columns", F.explode(tiers).alias("t"))
            .select("path", "format", "columns", "t.role", "t.tier"))


def load_corpus(spark: SparkSession, base: str, corpus_folder: str = "Corpus"):
    """P1 front end: discover, classify, fall back, validate and normalise.

    Returns (tokens, words, texts); texts may be None (with a warning).  ``words`` has the columns its
    shards have: without a wordID it is the tagged layout, keyed by textID.
    """
    from quarry.sources.files import path_exists
    if not path_exists(spark, base):
        require_inputs(None, None, None)
    cat = discovery_catalog(spark, base, corpus_folder)
    tokens = resolve_role(spark, cat.filter(F.col("tier").isin("classified", "unused")), "tokens", normalise_tokens)
    words = resolve_role(spark, cat, "words", normalise_lexicon)
    texts = resolve_role(spark, cat, "texts", normalise_texts)
    require_inputs(tokens, words, texts)
    return tokens, words, texts


def require_inputs(tokens, words, texts):
    """Tokens and words are required; texts only warn."""
    missing = [name for name, df in (("token occurrences", tokens), ("a lexicon", words)) if df is None]
    if missing:
        raise ValueError(f"the corpus folder holds no shard with {' or '.join(missing)}")
    if texts is None:
        warnings.warn("the corpus has no text metadata: years and genres stay unknown")
