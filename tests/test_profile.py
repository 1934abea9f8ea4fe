"""Profiling operators against pandas."""

import pandas as pd
import pytest

from quarry.operators import profile as P


@pytest.fixture()
def people(spark):
    # Name is a scalar broadcast to every row, as in the inline frame of the reference
    from quarry.sources.files import inline_frame
    return inline_frame(spark, {"Name": 3, "Age": [25, 30, 35, 40, 28, None],
                                "City": ["New York", "Los Angeles", "Chicago", "New York", "Chicago", None]},
                        "Name long, Age long, City string")


def test_people(spark, people):
    assert [r.Name for r in people.collect()] == [3] * 6
    means = {r.City: r.mean_Age for r in P.mean_by(people, "City", "Age").collect()}
    assert means == {"Chicago": 31.5, "Los Angeles": 30.0, "New York": 32.5}
    assert sorted(r.Age for r in P.filter_greater(people, "Age", 30).collect()) == [35, 40]
    senior = [r.Senior for r in P.flag_greater(people, "Age", 30, "Senior").orderBy("Age").collect()]
    assert senior.count(True) == 2 and None not in senior


def test_describe_matches_pandas(spark):
    vals = [1.0, 2.5, 2.5, 7.0, 10.0, None, -3.0]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    d = P.describe(df, "x").first()
    s = pd.Series(vals, dtype=float).describe()
    for ours, theirs in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"),
                         ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")]:
        assert abs(d[ours] - s[theirs]) < 1e-9, ours
    approx = P.describe(df, "x", exact=False).first()
    assert approx["p50"] in vals


def test_counts_and_info(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("a", 2.0), (None, 3.0)], "k string, v double")
    assert P.row_count(df).first().n_rows == 4
    assert {r.column_name: r.n_missing for r in P.missing_counts(df).collect()} == {"k": 1, "v": 1}
    vc = [(r.k, r.n) for r in P.value_counts(df, "k").collect()]
    assert vc == [("a", 2), ("b", 1)]                                   # NULL dropped, sorted
    assert [(r.k, r.n) for r in P.value_counts(df, "k", top=1).collect()] == [("a", 2)]
    mc = {r.k: (r.mean_v, r.count_v) for r in P.mean_and_count(df, "k", "v").collect()}
    assert mc == {"a": (1.5, 2), "b": (None, 0)}
    assert P.mean_and_count(df, "k", "certainty_flag") is None          # only if the column exists
    info = {r.column_name: (r.ordinal, r.dtype, r.non_null) for r in P.frame_info(df).collect()}
    assert info == {"k": (1, "string", 3), "v": (2, "double", 3)}
    assert [r.k for r in P.preview(df.dropna(), "v", 2).collect()] == ["a", "a"]


def test_exact_percentiles_large_groups(spark):
    import random
    rnd = random.Random(7)
    rows = [("a", float(rnd.randint(0, 300))) for _ in range(4000)] + \
           [("b", rnd.gauss(0, 1)) for _ in range(3000)] + [("c", 5.0)] * 50
    df = spark.createDataFrame(rows, "k string, x double")
    got = {r.k: (r.p10, r.p50, r.p99) for r in P.exact_percentiles(df, "x", [0.1, 0.5, 0.99], ["k"]).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "x"])
    for k, grp in pdf.groupby("k"):
        want = [grp["x"].quantile(q) for q in (0.1, 0.5, 0.99)]
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[k], want)), k


@pytest.mark.parametrize("size", [7, 3000])
def test_exact_percentiles_drop_nan_at_any_size(spark, size):
    """Ties, a constant group, a null group, NaN and NULL values; few rows and many ranges give the same plan."""
    import random
    rnd = random.Random(11)
    nan = float("nan")
    rows = ([("a", float(rnd.randint(0, 50))) for _ in range(size)] + [("b", rnd.choice([rnd.gauss(0, 1), nan])) for _ in range(size)]
            + [("c", 5.0)] * 400 + [("d", 1.0), ("e", nan), ("e", None)] + [(None, 2.0), (None, 3.0)])
    df = spark.createDataFrame(rows, "k string, x double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: [r[f"p{round(p * 100)}"] for p in probs] for r in P.exact_percentiles(df, "x", probs, ["k"]).collect()}
    pdf = pd.DataFrame(rows, columns=["k", "x"]).dropna(subset=["x"])
    assert set(got) == {"a", "b", "c", "d", None}
    for k, grp in pdf.groupby("k", dropna=False):
        want = [grp["x"].quantile(q) for q in probs]
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[k if isinstance(k, str) else None], want)), (k, got, want)
    whole = P.exact_percentiles(df, "x", [0.5]).first()
    assert abs(whole["p50"] - pdf["x"].quantile(0.5)) < 1e-9
    assert P.describe(df, "x").first()["count"] == len(pdf)


def test_recent_selection_matches_brute_force(spark):
    import datetime as dt
    import random
    import re
    rnd = random.Random(3)
    texts = ["Dr Ann spoke", "no title here", "Mr. Bob", "Drive home", "the Prof said", "Ms", "MsX"]
    rows = []
    for i in range(400):
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(hours=rnd.randint(0, 24 * 20))
        rows.append((i, ts, rnd.choice(["en", "de"]), rnd.choice(texts)))
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz, lang string, text string")
    got = [r.id for r in P.recent_selection(df, "ts", "text", "2024-01-12", days=7, order_tie="id",
                                            pages=2, page_size=10).collect()]
    lo, hi = dt.date(2024, 1, 5), dt.date(2024, 1, 12)
    pat = re.compile(r"\b(?:Dr|Prof|Professor|Mr|Ms)\b")
    keep = [r for r in rows if lo <= r[1].date() <= hi and r[2] == "en" and pat.search(r[3])]
    keep.sort(key=lambda r: (-r[1].timestamp(), r[0]))
    assert got == [r[0] for r in keep[:20]]
