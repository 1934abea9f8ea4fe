"""Emotion scoring (D5) behind one protocol: ``scorer.score(df, text_col) -> df + label, score``.

``LexiconScorer`` (default) runs fully in the JVM: one pass over the token
array maps each token to its label through a literal map, then per-label
counts, argmax (ties to the alphabetically first label) and the winning
share.  No shuffle, no Python worker.

``PandasModelScorer`` plugs any batch model (e.g. a text classifier) in as an
iterator pandas UDF: the model is loaded once per Python worker and fed Arrow
batches.  With ``dedupe=True`` only distinct texts are scored and joined back
- worth it when a model call is far more expensive than a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.text import lower_words

# ---- fixed values: default emotion lexicon (label -> terms, lower case) ----
EMOTION_LEXICON = {
    "anger": ["angry", "anger", "furious", "hate", "outrage", "rage", "not", "never"],
    "disgust": ["awful", "disgust", "disgusting", "gross", "nasty", "vile"],
    "fear": ["afraid", "danger", "fear", "panic", "risk", "threat", "worried"],
    "joy": ["agree", "delight", "glad", "good", "great", "happy", "hope", "love"],
    "sadness": ["grief", "lonely", "loss", "sad", "sorrow", "sorry", "tears"],
    "surprise": ["amazed", "asked", "shock", "sudden", "surprise", "unexpected"],
}
NEUTRAL = "neutral"


def _equals(value):
    return lambda x: x == F.lit(value)


class LexiconScorer:
    """Label = most frequent lexicon label among the text's lower-cased tokens."""

    def __init__(self, lexicon: dict[str, list[str]] | None = None, neutral: str = NEUTRAL, places: int = 3):
        self.lexicon = lexicon or EMOTION_LEXICON
        self.labels = sorted(self.lexicon)
        self.neutral = neutral
        self.places = places
        term_to_label: dict[str, str] = {}
        for lab in self.labels:
            for t in self.lexicon[lab]:
                term_to_label.setdefault(t, lab)
        self.term_to_label = term_to_label

    def score(self, df: DataFrame, text_col: str, label_col: str = "emotion_label",
              score_col: str = "emotion_score", tokens_col: str | None = None) -> DataFrame:
        """Add (label, score).  Intermediates are separate projections so the
        tokenisation runs once per row (Catalyst does not merge a projection
        into one that would repeat an expensive expression).  ``tokens_col``
        reuses an existing array of lower-cased tokens."""
        lex = F.create_map(*[x for kv in sorted(self.term_to_label.items()) for x in (F.lit(kv[0]), F.lit(kv[1]))])
        toks = F.col(tokens_col) if tokens_col else lower_words(F.coalesce(F.col(text_col), F.lit("")))
        hits = F.filter(F.transform(toks, lambda w: F.try_element_at(lex, w)), lambda lab: lab.isNotNull())
        tmp = [f"_c{i}" for i in range(len(self.labels))]
        out = df.withColumn("_hits", hits)
        out = out.withColumns({t: F.size(F.filter("_hits", _equals(lab))) for t, lab in zip(tmp, self.labels)})
        best = F.greatest(*[F.col(t) for t in tmp]) if len(tmp) > 1 else F.col(tmp[0])
        out = out.withColumns({"_best": best, "_total": F.size("_hits")})
        label = F.when(F.col("_total") == 0, F.lit(self.neutral))
        for t, lab in zip(tmp, self.labels):
            label = label.when(F.col(t) == F.col("_best"), F.lit(lab))
        score = (F.when(F.col("_total") == 0, F.lit(0.0))
                 .otherwise(F.round(F.col("_best").cast("double") / F.col("_total"), self.places)))
        return out.withColumns({label_col: label, score_col: score}).drop("_hits", "_best", "_total", *tmp)


SCORE_STRUCT = T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])


class PandasModelScorer:
    """Model plug-in: ``predict(texts: pd.Series) -> pd.DataFrame[label, score]``.

    ``load`` (optional) builds the model once per Python worker and its
    result is passed to ``predict`` as ``model``.
    """

    def __init__(self, predict: Callable, load: Callable | None = None, dedupe: bool = True):
        self.predict = predict
        self.load = load
        self.dedupe = dedupe

    def _udf(self):
        predict, load = self.predict, self.load

        @F.pandas_udf(SCORE_STRUCT)
        def _score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = load() if load is not None else None
            for s in batches:
                out = predict(s.fillna(""), model) if load is not None else predict(s.fillna(""))
                yield out[["label", "score"]].reset_index(drop=True)
        return _score

    def score(self, df: DataFrame, text_col: str, label_col: str = "emotion_label",
              score_col: str = "emotion_score") -> DataFrame:
        udf = self._udf()
        if not self.dedupe:
            return (df.withColumn("_s", udf(F.col(text_col)))
                    .withColumns({label_col: F.col("_s.label"), score_col: F.col("_s.score")}).drop("_s"))
        from quarry.operators.corpus import hot_keys, split_hot_keys
        body = F.coalesce(F.col(text_col), F.lit(""))                               # the model gets '' for NULL
        keyed = df.withColumns({"_a": F.xxhash64(body), "_b": F.xxhash64(F.lit(1), body, F.length(body))})   # 128 bits of hash
        # one of each text travels, then only its hash and result
        texts = (keyed.groupBy("_a", "_b").agg(F.first(body).alias("_t")).withColumn("_s", udf(F.col("_t")))
                 .select("_a", "_b", F.col("_s.label").alias(label_col), F.col("_s.score").alias(score_col)))
        hot = hot_keys(keyed.select("_a"), ["_a"])["_a"]                            # a boilerplate sentence is a hot key
        return split_hot_keys(keyed, texts, ["_a", "_b"], hot).drop("_a", "_b")


def lexicon_sql(text_sql: str, lexicon: dict[str, list[str]] | None = None, neutral: str = NEUTRAL,
                places: int = 3) -> tuple[str, str]:
    """The lexicon scorer as DuckDB SQL expressions (label, score) over ``text_sql`` (oracle use)."""
    sc = LexiconScorer(lexicon, neutral, places)
    w = f"regexp_extract_all(lower({text_sql}), '[\\p{{L}}\\p{{N}}_]+')"
    cnt = {}
    for lab in sc.labels:
        terms = sorted(t for t, l in sc.term_to_label.items() if l == lab)
        cnt[lab] = f"len(list_filter({w}, lambda x: x IN ({', '.join(repr(t) for t in terms)})))"
    total = "(" + " + ".join(cnt.values()) + ")"
    best = "greatest(" + ", ".join(cnt.values()) + ")"
    label = f"CASE WHEN {total} = 0 THEN '{neutral}' " + " ".join(
        f"WHEN {cnt[lab]} = {best} THEN '{lab}'" for lab in sc.labels) + " END"
    score = f"CASE WHEN {total} = 0 THEN 0.0 ELSE round(CAST({best} AS DOUBLE) / {total}, {places}) END"
    return label, score
