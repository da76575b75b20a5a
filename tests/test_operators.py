import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from loomgrid.operators import columns, fill, fuzzy, pairwise, ranks, rows, selection
from loomgrid.operators import profile as prof
from loomgrid.operators.filters import FilterError, filter_rows


def test_row_operators(spark):
    df = spark.createDataFrame([(1, "1", "x"), (2, "1", "x"), (3, "2", "y"), (4, "1", "x"), (5, "", "  ")], "id int, a string, b string")
    assert [r.id for r in rows.remove_duplicates(df, "id").orderBy("id").collect()] == [1, 3, 5]
    assert rows.remove_empty_rows(df, ("id",)).count() == 4
    assert [r.id for r in rows.remove_rows_with_pattern(df, "a", "1").orderBy("id").collect()] == [3, 5]
    assert rows.remove_rows_with_pattern(df, "none", "1").count() == 5
    assert rows.keep_only_numeric_rows(df, ["a"]).count() == 4
    assert rows.keep_only_numeric_rows(df, []).count() == 5
    key = spark.createDataFrame([("B", "A", "")], "b string, a string, c string").select(rows.dedupe_key(["b", "a", "c"]).alias("k")).first().k
    assert key == "a=A|b=B|c="


def test_ranks_across_partitions(spark):
    df = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5003).alias("o"), (F.col("id") % 3).alias("g"))
    found = ranks.numbered(df, ["o"], "pos", ["g"]).toPandas()
    assert (found.groupby("g")["o"].rank().astype(int) == found["pos"]).all()
    assert ranks.numbered(df.limit(0), ["o"]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_order_statistics(spark, seed):
    rng = random.Random(seed)
    values = [rng.choice([None, round(rng.gauss(0, 9), 1)]) for _ in range(1 + 900 * seed)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(3)
    known = sorted(v for v in values if v is not None)
    found = {r.fraction: r.value for r in selection.at_ranks(df, {"x": F.col("x")}, (0.0, 0.25, 0.5, 0.9, 1.0)).collect()}
    assert found == {p: known[min(int(p * len(known)), len(known) - 1)] for p in (0.0, 0.25, 0.5, 0.9, 1.0)} if known else found == {}
    if known:
        assert selection.medians(df, {"x": F.col("x")})["x"] == pytest.approx(statistics.median(known))


def filled(spark, values, strategy, constant=""):
    df = spark.createDataFrame(list(enumerate(values)), "id int, a string")
    return [r.a for r in fill.fill_missing(df, strategy, ["a"], constant, "id").orderBy("id").collect()]


def test_fills(spark):
    assert filled(spark, ["", "data"], "constant", "DEFAULT") == ["DEFAULT", "data"]
    assert filled(spark, ["10", "", "20"], "mean") == ["10", "15.0", "20"]
    assert filled(spark, ["10", "", "x"], "mean") == ["10", "", "x"]
    assert filled(spark, ["5", "", "10", "15"], "median") == ["5", "10.0", "10", "15"]
    assert filled(spark, ["A", "", "A", "B"], "mode") == ["A", "A", "A", "B"]
    assert filled(spark, ["A", "", None], "forward") == ["A", "A", "A"]
    assert filled(spark, ["", None, "B"], "backward") == ["B", "B", "B"]
    assert filled(spark, ["", "10", "", "", "40", ""], "interpolate") == ["", "10", "20.0", "30.0", "40", ""]
    assert filled(spark, ["", "1"], "unknown") == ["", "1"]


def test_fills_across_partitions(spark):
    rng = random.Random(4)
    values = [str(k) if rng.random() < 0.02 else None for k in range(3000)]
    wanted, last = [], None
    for v in values:
        last = v or last
        wanted.append(last)
    df = spark.createDataFrame(list(enumerate(values)), "id int, a string").repartition(6)
    assert [r.a for r in fill.fill_missing(df, "forward", ["a"], order="id").orderBy("id").collect()] == wanted


def test_scaling(spark):
    df = spark.createDataFrame([(1, "10", "10", "5"), (2, "50", "20", "5"), (3, "90", "30", "x")], "id int, a string, b string, c string")
    assert [r.a for r in fill.min_max(df, ["a"]).orderBy("id").collect()] == ["0.0", "0.5", "1.0"]
    assert [float(r.b) for r in fill.z_score(df, ["b"]).orderBy("id").collect()] == pytest.approx([-1.224744871, 0.0, 1.224744871])
    assert [r.c for r in fill.min_max(df, ["c"]).orderBy("id").collect()] == ["5", "5", "x"]


def test_columns(spark):
    df = spark.createDataFrame([("John Doe", "A"), ("X", "")], "n string, m string")
    assert [tuple(r) for r in columns.split_column(df, "n", " ", ["first", "last"]).select("first", "last").collect()] == [("John", "Doe"), ("X", None)]
    assert columns.split_column(df, "n", " ").columns == ["n", "m", "n_part1", "n_part2"]
    assert [r.b for r in columns.merge_columns(df, ["n", "m"], " ", "b").collect()] == ["John Doe A", "X"]


def merged(spark, values, **options):
    df = spark.createDataFrame(list(enumerate(values)), "id int, v string")
    return [r.v for r in fuzzy.merge_similar_values(df, ["v"], "id", **options).orderBy("id").collect()]


def test_fuzzy_merge(spark):
    assert merged(spark, ["Apple Inc", "Apple Inc.", "Apple  Inc", "Microsoft"], trim=True) == ["Apple Inc"] * 3 + ["Microsoft"]
    assert merged(spark, ["John Smith", "Jon Smith", "Jane Doe"], algorithm="jaro_winkler", threshold=0.9, prefer="first") == ["John Smith", "John Smith", "Jane Doe"]
    assert len(set(merged(spark, ["BOSTON", "Boston", "boston", "Los Angeles"], threshold=0.95, case_insensitive=True))) == 2
    assert merged(spark, ["USA", "U.S.A.", "U.S.A"], threshold=0.65, prefer="shortest") == ["USA", "U.S.A", "U.S.A"]
    assert merged(spark, ["NY", "N.Y.", "N.Y"], threshold=0.65, prefer="longest") == ["N.Y", "N.Y.", "N.Y"]
    assert merged(spark, ["iPhone", "iPad", ""], threshold=0.99) == ["iPhone", "iPad", ""]
    assert len(set(merged(spark, ["Software Engineer", "Software Eng", "Hardware Engineer"], algorithm="cosine", threshold=0.7))) == 1


def test_merge_in_blocks_gives_what_one_task_gives(spark):
    import random

    draw = random.Random(5)
    words = ["".join(draw.choice("abcd") for _ in range(draw.randint(3, 6))) for _ in range(120)]
    values = [draw.choice(words) for _ in range(300)]
    for prefer in ("most_frequent", "longest", "first", "alphabetical"):
        for algorithm in ("levenshtein", "jaro_winkler"):
            options = {"algorithm": algorithm, "threshold": 0.7, "prefer": prefer}
            if prefer != "most_frequent" and algorithm == "jaro_winkler":
                continue
            assert merged(spark, values, most=40, **options) == merged(spark, values, **options)
    assert merged(spark, ["", None], most=0) == ["", None]


def test_merge_in_many_blocks_takes_few_rounds(spark):
    values = [f"Supplier#{k:09d}" for k in range(0, 400, 11)] + [chr(97 + k % 26) * (3 + k // 26) for k in range(180)]
    values += [v + "x" for v in values[-60:]]
    before = len(ranks._MADE)
    found = merged(spark, values, most=2, threshold=0.9, prefer="first")
    assert len(ranks._MADE) - before < 12  # one table for each round
    assert found == merged(spark, values, threshold=0.9, prefer="first")
    assert len(set(found)) < len(set(values))


@pytest.mark.parametrize("algorithm", ["levenshtein", "jaro_winkler", "cosine"])
def test_indexed_seeds_are_the_first_similar_ones(algorithm, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(fuzzy, "CHUNK", 4)
    for threshold in (0.3, 0.6, 0.8, 0.85, 0.9, 1.0):
        forms = ["".join(rng.choice("abcé") for _ in range(rng.choice([1, 2, 5, 9, 11, 24]))) for _ in range(60)]
        forms += [f[:k] + rng.choice("abc") + f[k + rng.randint(0, 1) :] for f in forms for k in [rng.randint(0, len(f) - 1)]]
        wanted, seeds = {}, []
        for k, form in enumerate(forms):
            wanted[k] = next((s for s in seeds if fuzzy.similarity(forms[s], form, algorithm, threshold) >= threshold), k)
            seeds += [k] if wanted[k] == k else []
        assert fuzzy.seeded(list(enumerate(forms)), algorithm, threshold) == (wanted, [(s, forms[s]) for s in seeds])


def test_seeds_are_compared_with_few_values(monkeypatch):
    calls, own = [], fuzzy.similarity
    monkeypatch.setattr(fuzzy, "similarity", lambda *a: calls.append(a) or own(*a))
    names = [(k, f"Supplier#{k:09d}") for k in range(3000)]
    found, seeds = fuzzy.seeded(names, "levenshtein", 0.9)
    assert len(found) == 3000 and len(calls) < 10 * len(names)
    monkeypatch.setattr(fuzzy, "MOST_INDEXED", 100)
    part, few = fuzzy.seeded(names, "levenshtein", 0.9)
    assert 0 < len(part) < 3000 and part == {k: found[k] for k in range(len(part))} and few == seeds[: len(few)]
    monkeypatch.setattr(fuzzy, "MOST_SCANNED", 5)
    part, few = fuzzy.seeded(names[:300], "jaro_winkler", 0.99)
    assert len(few) == 5 and 5 <= len(part) < 300


def test_banded_distance_is_exact():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 9))) for _ in "ab")
        for most in range(6):
            found = fuzzy._edit_distance(a, b, most)
            assert (found == plain(a, b)) if plain(a, b) <= most else found > most


def test_profile_routing(spark):
    df = spark.createDataFrame([(k, v, f"u{k}") for k, v in enumerate(["1", "2", "x", "5", "7"])], "id int, v string, u string")
    out = prof.profile(df, "id")
    row = out["continuous"].where("feature = 'v'").first()
    assert (row["count"], row.min, row.max, row.q1) == (2, 5.0, 7.0, 5.0)
    assert {r.feature: r.kind for r in out["types"].collect()} == {"v": "continuous", "u": "categorical"}
    last = spark.createDataFrame(list(enumerate(["1", "2", "3", "n/a"])), "id int, v string")
    assert [tuple(r) for r in prof.profile(last, "id")["categories"].collect()] == [("v", "n/a", 1)]
    many = spark.createDataFrame([(k, f"t{k}") for k in range(11)], "id int, u string")
    assert prof.profile(many, "id")["omitted"].first().reason == "Too many unique values (100.0%)"
    forced = prof.profile(spark.createDataFrame([(1, "foo")], "id int, v string"), "id", overrides={"v": "continuous"})
    assert forced["continuous"].first().mean == 1.0
    with pytest.raises(ValueError):
        prof.profile(df, "id", overrides={"v": "date"})


def test_histogram_edges(spark):
    flat = prof.histogram(spark.createDataFrame([(3.0,), (3.0,)], "x double"), F.col("x")).collect()
    assert [(r.bin, r.n, r.label) for r in flat] == [(0, 2, "[3.000000 - 3.000000]")]
    ten = prof.histogram(spark.range(100).select(F.col("id").cast("double").alias("x")), F.col("x")).collect()
    assert sum(r.n for r in ten) == 100 and len(ten) <= 10


def test_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0, 7.0), (2.0, 4.0, 7.0), (3.0, 6.0, 7.0)], "a double, b double, c double")
    assert {(r.feature1, r.feature2): r.value for r in pairwise.covariance(df, ["a", "b"]).collect()} == {("a", "b"): 2.0, ("b", "a"): 2.0}
    assert {(r.feature1, r.feature2) for r in pairwise.pearson(df, ["a", "b", "c"]).collect()} == {("a", "b"), ("b", "a")}
    gaps = spark.createDataFrame([(1.0, 2.0), (None, 4.0), (3.0, 6.0)], "a double, b double")
    assert pairwise.covariance(gaps, ["a", "b"]).first().value == 4.0
    ties = spark.createDataFrame([(1, 3), (2, 1), (2, 1), (4, 2)], "a int, b int")
    assert pairwise.spearman(ties, ["a", "b"]).first().value == pytest.approx(-1 / 3)
    cells = spark.createDataFrame([("a", 1, 1.0), ("a", 3, 2.0), ("b", 1, 5.0), ("b", 2, 6.0)], "feature string, rid int, x double")
    assert sorted(tuple(r) for r in pairwise.by_position(cells, ["a", "b"]).collect()) == [(1, 1.0, 5.0), (2, 2.0, 6.0)]


def test_chi_square(spark):
    assert pairwise.chi_square_tail(0.271574651504035, 2) == pytest.approx(0.873028283380073, abs=1e-12)
    assert pairwise.chi_square_tail(60, 4) == pytest.approx(math.exp(-30) * 31, rel=1e-12)
    table = [("A", "X", 10), ("A", "Y", 20), ("A", "Z", 30), ("B", "X", 6), ("B", "Y", 9), ("B", "Z", 17)]
    df = spark.createDataFrame([(a, b) for a, b, n in table for _ in range(n)], "f1 string, f2 string")
    counts = pairwise.contingency(df, {"f1": F.col("f1"), "f2": F.col("f2")})
    assert pairwise.chi_square(counts).first().p_value == pytest.approx(0.873028283380073, abs=1e-12)
    lonely = spark.createDataFrame([("f1", "A"), ("f1", "B"), ("f1", "C"), ("f2", "X"), ("f2", "Y"), ("f2", "Z")], "feature string, value string")
    assert math.isnan(pairwise.chi_square(counts, lonely).first().p_value)


def chosen(spark, data, schema, tree):
    return [r[0] for r in filter_rows(spark.createDataFrame(data, schema), tree).collect()]


def cond(kind, wanted, value):
    return {"type": kind, "filterType": wanted, "value": value}


def chain(*conditions, operators=()):
    return {"conditions": list(conditions), "operators": list(operators)}


def test_filters(spark):
    people = [("25", "Alice"), ("30", "Bob"), ("15", "Charlie")]
    older = chain(cond("greater", "continuous", 18))
    for name in ("age", "age (people.csv)", "age (my people file.xlsx)"):
        assert chosen(spark, [(n, a) for a, n in people], "name string, age string", {"operator": "AND", "conditions": {name: older}}) == ["Alice", "Bob"]
    one = lambda values, tree: chosen(spark, [(v,) for v in values], "c string", tree)
    both = chain(cond("greater", "continuous", 15), cond("less", "continuous", 25), operators=["AND"])
    assert one(["10", "20", "30"], {"operator": "AND", "conditions": {"c": both}}) == ["20"]
    assert one(["1.5", "2.3", "4.7"], {"operator": "AND", "conditions": {"c": ["2.3", "4.7"]}}) == ["2.3", "4.7"]
    assert one(["1.5", "10"], {"operator": "AND", "conditions": {"c": chain(cond("greater", "continuous", 12))}}) == ["1.5"]
    assert one(["a"], {"conditions": {}}) == ["a"] and one(["a"], {"operator": "OR", "conditions": {}}) == [] and one(["a"], {"operator": "XOR", "conditions": {}}) == []
    assert one(["10"], {"operator": "AND", "conditions": {"c": {"conditions": [cond("equal", "continuous", 10)]}}}) == []
    assert one(["2020-05-01", "", None, "x"], {"operator": "AND", "conditions": {"c": chain(cond("between", "date", ["01/01/2020", "2020-12-31"]))}}) == ["2020-05-01"]
    with pytest.raises(FilterError):
        one(["1"], {"operator": "AND", "conditions": {"c": 123}})
    with pytest.raises(FilterError):
        one(["1"], {"operator": "AND", "conditions": {"c": chain({"type": "equal", "value": 1})}})


def test_scratch_tables_can_be_released(spark):
    df = ranks.scratch(spark.range(5))
    assert df.count() == 5 and ranks.release(spark) >= 1 and ranks.release(spark) == 0


def test_neighbours_of_one_large_partition(spark):
    """The frames run from the far end only, so a partition costs its rows and not their square."""
    from loomgrid.operators.fill import fill_missing

    n = 300_000
    df = spark.range(n).select("id", F.when(F.col("id").isin(0, n - 1), F.col("id").cast("string")).alias("v")).coalesce(1)
    done = {k: fill_missing(df, k, ["v"], order="id") for k in ("forward", "backward", "interpolate")}
    assert [done["forward"].where(f"v = '{x}'").count() for x in (0, n - 1)] == [n - 1, 1]
    assert [done["backward"].where(f"v = '{x}'").count() for x in (0, n - 1)] == [1, n - 1]
    assert done["interpolate"].where("abs(cast(v as double) - id) > 1e-6").count() == 0
    assert "unboundedfollowing" not in done["backward"]._jdf.queryExecution().optimizedPlan().toString().lower()


def test_cleaning_plan_grows_with_the_number_of_functions_only(spark):
    from loomgrid.plans.cleaning import CleaningOptions, clean

    df = spark.createDataFrame([("1", " a ", "01/02/2020")], "id string, a string, b string")
    size = lambda **o: len(clean(df, CleaningOptions(**o), "id")._jdf.queryExecution().optimizedPlan().toString())
    few = dict(trim_whitespace=True, standardize_dates=True)
    many = dict(few, remove_leading_zeros=True, remove_extra_spaces=True, standardize_case=True, case_mode="title", remove_punctuation=True, replace_values=True, replacement_map={"x": "y"}, fill_missing_values=True, fill_strategy="constant", normalize_urls=True, standardize_phone_numbers=True, round_decimals=True, merge_similar_values=True, fuzzy_match_columns=["a"])
    assert size(**many) < 8 * size(**few)
