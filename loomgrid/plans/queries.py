"""The registered queries over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.functions import numeric, text
from loomgrid.functions.scalars import blank, num
from loomgrid.operators import columns as cols
from loomgrid.operators import fill, fuzzy, metadata, pairwise, policy, rows
from loomgrid.operators import profile as prof
from loomgrid.operators.filters import filter_rows
from loomgrid.plans.mapping import harmonize
from loomgrid.sources.tables import clean_text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def _read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def _c(name: str) -> Column:
    return F.col(name)


def _rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _dated(df: DataFrame) -> DataFrame:
    """Days as ISO text, which every engine hands over alike."""
    return df.select(*[F.col(c).cast("string").alias(c) if t == "date" else F.col(c) for c, t in df.dtypes])


#: events with gaps: the value is missing where a user signs up
_GAPS = "CASE WHEN event_type = 'signup' THEN NULL ELSE value END"
_RANKED = "SELECT {x} AS x, row_number() OVER (ORDER BY {x}) AS rn, count(*) OVER () AS n FROM {t} WHERE {x} IS NOT NULL"
_QUARTILE = "max(CASE WHEN rn = least(floor({p} * n), n - 1) + 1 THEN x END)"
_QUARTILES = ", ".join(f"{_QUARTILE.format(p=p)} AS {name}" for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3")))


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events", "event_id", "event_type", "user_id", "value")
    return events.withColumn("value", F.when(_c("event_type") != "signup", _c("value")))


@query(f"SELECT 'o_totalprice' AS feature, max(n)::BIGINT AS count, min(x) AS min, max(x) AS max, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std_dev, {_QUARTILES} FROM ({_RANKED.format(x='o_totalprice', t='orders')})")
def q01_continuous_stats(spark, sf_dir):  # noqa: ANN001, ANN201
    stats = prof.continuous_stats(_read(spark, sf_dir, "orders", "o_totalprice"), {"o_totalprice": _c("o_totalprice")})
    return stats.withColumns({"mean": F.round("mean", 4), "std_dev": F.round("std_dev", 4)})


@query(f"SELECT 'value' AS feature, count(*) FILTER (WHERE v IS NULL) AS missing, count(v) AS present FROM (SELECT {_GAPS} AS v FROM events)")
def q02_missing_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    return prof.missing_counts(prof.typed_cells(_gaps(spark, sf_dir), "event_id", ["value"]))


_MIXED = "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(event_id AS VARCHAR) END AS cell, CASE WHEN event_id % 3 = 0 THEN 'categorical' ELSE 'continuous' END AS kind FROM events"


@query(f"""WITH m AS ({_MIXED}), l AS (SELECT arg_max(kind, event_id) AS kind FROM m), c AS (SELECT max(event_id) AS cut FROM m, l WHERE m.kind <> l.kind)
    SELECT 'cell' AS feature, l.kind, c.cut, (SELECT count(*) FROM m WHERE m.event_id > coalesce(c.cut, -1)) AS kept FROM l, c""")
def q03_type_resolution(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = prof.typed_cells(_mixed(spark, sf_dir), "event_id", ["cell"])
    types = prof.resolve_types(cells)
    kept = prof.retained(cells, types).groupBy("feature").agg(F.count(F.lit(1)).alias("kept"))
    return types.join(F.broadcast(kept), "feature").select("feature", "kind", "cut", "kept")  # a row for each column


def _mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events", "event_id", "event_type")
    return events.select("event_id", F.when(_c("event_id") % 3 == 0, _c("event_type")).otherwise(_c("event_id").cast("string")).alias("cell"))


@query(f"""WITH m AS ({_MIXED}), l AS (SELECT arg_max(kind, event_id) AS kind FROM m), c AS (SELECT max(event_id) AS cut FROM m, l WHERE m.kind <> l.kind)
    SELECT (SELECT count(*) FROM m, c WHERE m.event_id > coalesce(c.cut, -1)) AS cells, (SELECT count(*) FROM m) AS rows""")
def q04_totals_both_modes(spark, sf_dir):  # noqa: ANN001, ANN201
    df = _mixed(spark, sf_dir)
    cells = prof.typed_cells(df, "event_id", ["cell"])
    kept = prof.retained(cells)
    by_cells, by_rows = prof.totals(cells, kept, df), prof.totals(cells, kept, df, "rows")
    return by_cells.withColumnRenamed("total", "cells").crossJoin(F.broadcast(by_rows.withColumnRenamed("total", "rows")))  # one row each


@query(f"""WITH r AS ({_RANKED.format(x='o_totalprice', t='orders')}), s AS (SELECT min(x) AS lo, max(x) AS hi, max(n) AS n, {_QUARTILES} FROM r),
    w AS (SELECT lo, hi, greatest(2 * (q3 - q1) / cbrt(n), (hi - lo) / 10) AS width FROM s), b AS (SELECT *, ceil((hi - lo) / width)::INTEGER AS bins FROM w),
    h AS (SELECT least(floor((x - lo) / width), bins - 1)::INTEGER AS bin, count(*) AS n FROM r, b GROUP BY 1), g AS (SELECT unnest(range(0, bins))::INTEGER AS bin, lo, width FROM b)
    SELECT g.bin, round(lo + g.bin * width, 4) AS lo, round(lo + (g.bin + 1) * width, 4) AS hi, coalesce(h.n, 0) AS n FROM g LEFT JOIN h USING (bin)""")
def q05_histogram(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(prof.histogram(_read(spark, sf_dir, "orders", "o_totalprice"), _c("o_totalprice")).drop("label"))


@query(f"""WITH s AS (SELECT {_QUARTILES} FROM ({_RANKED.format(x='l_extendedprice', t='lineitem')}))
    SELECT l_orderkey, l_linenumber, l_extendedprice AS value FROM lineitem, s WHERE l_extendedprice < q1 - 1.5 * (q3 - q1) OR l_extendedprice > q3 + 1.5 * (q3 - q1)""")
def q06_outliers(spark, sf_dir):  # noqa: ANN001, ANN201
    return prof.outliers(_read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice"), _c("l_extendedprice"), ["l_orderkey", "l_linenumber"])


def _categories(spark: SparkSession, sf_dir: str, table: str, key: str, *columns: str) -> DataFrame:
    return prof.category_counts(prof.typed_cells(_read(spark, sf_dir, table, key, *columns), key, list(columns)))


@query("SELECT 'o_orderpriority' AS feature, trim(o_orderpriority) AS value, count(*) AS n FROM orders GROUP BY 2")
def q07_category_counts(spark, sf_dir):  # noqa: ANN001, ANN201
    return _categories(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")


@query("""SELECT 'c_mktsegment' AS feature, rank, value, n, round(n / total * 100, 4) AS percent FROM (SELECT c_mktsegment AS value, count(*) AS n, sum(count(*)) OVER () AS total,
    row_number() OVER (ORDER BY count(*) DESC, c_mktsegment)::INTEGER AS rank FROM customer GROUP BY c_mktsegment) WHERE rank <= 2""")
def q08_modes(spark, sf_dir):  # noqa: ANN001, ANN201
    counts = _categories(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    total = counts.groupBy("feature").agg(F.sum("n").alias("total"))
    top = prof.modes(counts, 1).drop("percent").join(F.broadcast(total), "feature")  # one row
    return _rounded(top.select("feature", "rank", "value", "n", (_c("n") / _c("total") * 100).alias("percent")))


@query("""SELECT feature, d AS distinct_values, CASE WHEN n > 10 AND d / n * 100 >= 50 THEN 'unique' ELSE 'categories' END AS why FROM (
    SELECT 'c_name' AS feature, count(*)::DOUBLE AS n, count(DISTINCT c_name) AS d FROM customer UNION ALL SELECT 'o_orderstatus', count(*), count(DISTINCT o_orderstatus) FROM orders)
    WHERE (n > 10 AND d / n * 100 >= 50) OR d > 200""")
def q09_omitted_columns(spark, sf_dir):  # noqa: ANN001, ANN201
    counts = _categories(spark, sf_dir, "customer", "c_custkey", "c_name").unionByName(_categories(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus"))
    return prof.omitted(counts).select("feature", "distinct_values", F.when(F.startswith("reason", F.lit("Too many unique")), "unique").otherwise("categories").alias("why"))


@query(f"""WITH r AS ({_RANKED.format(x="date_diff('day', DATE '1970-01-01', o_orderdate::DATE)", t='orders')}), s AS (SELECT min(x) AS earliest, max(x) AS latest, trunc(avg(x))::INTEGER AS mean, {_QUARTILES}, stddev_pop(x) AS sd, count(*) AS count FROM r)
    SELECT (DATE '1970-01-01' + earliest::INTEGER)::VARCHAR AS earliest, (DATE '1970-01-01' + latest::INTEGER)::VARCHAR AS latest, (DATE '1970-01-01' + mean)::VARCHAR AS mean, (DATE '1970-01-01' + median::INTEGER)::VARCHAR AS median, (DATE '1970-01-01' + q1::INTEGER)::VARCHAR AS q1, (DATE '1970-01-01' + q3::INTEGER)::VARCHAR AS q3, round(sd, 4) AS std_dev, count FROM s""")
def q10_date_stats(spark, sf_dir):  # noqa: ANN001, ANN201
    return _dated(_rounded(prof.date_stats(_read(spark, sf_dir, "orders", "o_orderdate"), _c("o_orderdate"))))


@query("SELECT o_orderdate::DATE::VARCHAR AS day, count(*) AS n FROM orders GROUP BY 1")
def q11_date_histogram(spark, sf_dir):  # noqa: ANN001, ANN201
    return _dated(prof.date_histogram(_read(spark, sf_dir, "orders", "o_orderdate"), _c("o_orderdate")))


@query("SELECT 'event_type' AS feature, event_type AS cell, row_number() OVER (ORDER BY min(event_id))::DOUBLE AS code FROM events GROUP BY event_type")
def q12_forced_codes(spark, sf_dir):  # noqa: ANN001, ANN201
    return prof.forced_codes(prof.typed_cells(_read(spark, sf_dir, "events", "event_id", "event_type"), "event_id", ["event_type"]))


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _pair_sql(measure: str) -> str:
    pairs = [(a, b) for k, a in enumerate(_NUMBERS) for b in _NUMBERS[k + 1 :]]
    return " UNION ALL ".join(f"SELECT '{x}' AS feature1, '{y}' AS feature2, round({measure.format(a=a, b=b)}, 4) AS value FROM lineitem" for a, b in pairs for x, y in ((a, b), (b, a)))


@query(_pair_sql("covar_samp({a}, {b})"))
def q13_covariance(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(pairwise.covariance(_read(spark, sf_dir, "lineitem", *_NUMBERS), _NUMBERS))


@query(_pair_sql("corr({a}, {b})"))
def q14_pearson(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(pairwise.pearson(_read(spark, sf_dir, "lineitem", *_NUMBERS), _NUMBERS))


@query("""WITH r AS (SELECT rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS a, rank() OVER (ORDER BY user_id) + (count(*) OVER (PARTITION BY user_id) - 1) / 2 AS b FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL)
    SELECT x AS feature1, y AS feature2, round((SELECT corr(a, b) FROM r), 4) AS value FROM (VALUES ('value', 'user_id'), ('user_id', 'value')) AS t(x, y)""")
def q15_spearman(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(pairwise.spearman(_read(spark, sf_dir, "events", "value", "user_id"), ["value", "user_id"]))


@query(f"""WITH a AS (SELECT value AS x, row_number() OVER (ORDER BY event_id) AS pos FROM (SELECT event_id, {_GAPS} AS value FROM events) WHERE value IS NOT NULL), b AS (SELECT user_id AS y, row_number() OVER (ORDER BY event_id) AS pos FROM events WHERE user_id IS NOT NULL)
    SELECT count(*) AS pairs, round(covar_samp(x, y), 4) AS covariance, round(corr(x, y), 4) AS pearson FROM a JOIN b USING (pos)""")
def q16_positional_pairs(spark, sf_dir):  # noqa: ANN001, ANN201
    df = _gaps(spark, sf_dir)
    cells = df.select(F.col("event_id").alias("rid"), F.explode(F.array(F.struct(F.lit("value").alias("feature"), _c("value").alias("x")), F.struct(F.lit("user_id").alias("feature"), _c("user_id").cast("double").alias("x")))).alias("c")).select("c.feature", "rid", "c.x").where("x is not null")
    wide = pairwise.by_position(cells, ["value", "user_id"])
    both = wide.where("value is not null and user_id is not null")
    return _rounded(both.agg(F.count(F.lit(1)).alias("pairs"), F.covar_samp("value", "user_id").alias("covariance"), F.try_divide(F.covar_pop("value", "user_id"), F.stddev_pop("value") * F.stddev_pop("user_id")).alias("pearson")))


def _order_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _read(spark, sf_dir, "orders", "o_orderstatus", "o_orderpriority")
    as_category = lambda c: F.when(prof.kind_of(_c(c)) == prof.CATEGORY, F.trim(c))
    return pairwise.contingency(df, {c: as_category(c) for c in df.columns})


_CONTINGENCY = "SELECT 'o_orderpriority' AS feature1, 'o_orderstatus' AS feature2, o_orderpriority AS value1, o_orderstatus AS value2, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL AND o_orderstatus IS NOT NULL GROUP BY 3, 4"


@query(_CONTINGENCY)
def q17_contingency(spark, sf_dir):  # noqa: ANN001, ANN201
    return _order_categories(spark, sf_dir)


@query(f"""WITH c AS ({_CONTINGENCY}), a AS (SELECT value1, sum(n) AS n1 FROM c GROUP BY 1), b AS (SELECT value2, sum(n) AS n2 FROM c GROUP BY 1), g AS (SELECT a.*, b.*, (SELECT sum(n) FROM c) AS t FROM a, b)
    SELECT 'o_orderpriority' AS feature1, 'o_orderstatus' AS feature2, round(sum(power(coalesce(n, 0) - n1 * n2 / t, 2) / (n1 * n2 / t)), 4) AS statistic, ((count(DISTINCT g.value1) - 1) * (count(DISTINCT g.value2) - 1)) AS df FROM g LEFT JOIN c ON c.value1 = g.value1 AND c.value2 = g.value2""")
def q18_chi_square_stat(spark, sf_dir):  # noqa: ANN001, ANN201
    return _rounded(pairwise.chi_square(_order_categories(spark, sf_dir)).drop("p_value"))


def _condition(kind: str, wanted: str, value: object) -> dict:
    return {"type": kind, "filterType": wanted, "value": value}


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey > 100")
def q19_filter_and(spark, sf_dir):  # noqa: ANN001, ANN201
    tree = {"operator": "AND", "conditions": {"c_mktsegment": "BUILDING", "c_custkey (customer.csv)": {"conditions": [_condition("greater", "continuous", "100")], "operators": []}}}
    return filter_rows(_read(spark, sf_dir, "customer"), tree).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') OR o_orderstatus = 'P'")
def q20_filter_or_in(spark, sf_dir):  # noqa: ANN001, ANN201
    tree = {"operator": "OR", "conditions": {"o_orderpriority": ["1-URGENT", "2-HIGH"], "o_orderstatus": "P", "o_custkey": None}}
    return filter_rows(_read(spark, sf_dir, "orders"), tree).select("o_orderkey", "o_orderpriority")


@query("SELECT p_partkey, p_size FROM part WHERE ((p_size > 5 AND p_size < 20) OR p_size = 40)")
def q21_filter_chain(spark, sf_dir):  # noqa: ANN001, ANN201
    chain = {"conditions": [_condition("greater", "continuous", 5), _condition("less", "continuous", 20), _condition("equal", "continuous", 40)], "operators": ["AND", "OR"]}
    return filter_rows(_read(spark, sf_dir, "part"), {"operator": "AND", "conditions": {"p_size": chain}}).select("p_partkey", "p_size")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def q22_filter_between_date(spark, sf_dir):  # noqa: ANN001, ANN201
    df = _read(spark, sf_dir, "orders", "o_orderkey", "o_orderdate").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    tree = {"operator": "AND", "conditions": {"day": {"conditions": [_condition("between", "date", ["01.01.1995", "31/12/1996"])], "operators": []}}}
    return filter_rows(df, tree).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE replace(CAST(l_discount AS VARCHAR), '.', '')::DOUBLE > 5")
def q23_filter_german_number(spark, sf_dir):  # noqa: ANN001, ANN201
    tree = {"operator": "AND", "conditions": {"l_discount": {"conditions": [_condition("greater", "continuous", "5")], "operators": []}}}
    return filter_rows(_read(spark, sf_dir, "lineitem"), tree).select("l_orderkey", "l_linenumber")


@query(f"SELECT 'o_totalprice' AS feature, max(n)::BIGINT AS count, min(x) AS min, max(x) AS max, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std_dev, {_QUARTILES} FROM ({_RANKED.format(x='o_totalprice', t='orders')} AND o_orderstatus = 'F')")
def q24_filtered_profile(spark, sf_dir):  # noqa: ANN001, ANN201
    df = filter_rows(_read(spark, sf_dir, "orders"), {"operator": "AND", "conditions": {"o_orderstatus": "F"}})
    return _rounded(prof.continuous_stats(df.select("o_totalprice"), {"o_totalprice": _c("o_totalprice")}))


def _texts(spark: SparkSession, sf_dir: str, function: Callable[[Column], Column]) -> DataFrame:
    return _read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", function(_c("text")).alias("text"))


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents")
def q25_trim_spaces(spark, sf_dir):  # noqa: ANN001, ANN201
    return _texts(spark, sf_dir, lambda c: text.squeeze(text.trim(c)))


@query(r"SELECT doc_id, trim(regexp_replace(text, '[\r\n]+', ' ', 'g')) AS text FROM documents")
def q26_line_breaks(spark, sf_dir):  # noqa: ANN001, ANN201
    return _texts(spark, sf_dir, text.join_lines)


@query("SELECT n_nationkey, upper(n_name) AS upper, lower(n_name) AS lower, upper(substr(n_name, 1, 1)) || lower(substr(n_name, 2)) AS sentence, list_aggregate(list_transform(string_split(lower(n_name), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), 'string_agg', ' ') AS title FROM nation")
def q27_case_modes(spark, sf_dir):  # noqa: ANN001, ANN201
    return _read(spark, sf_dir, "nation").select("n_nationkey", *[text.case(_c("n_name"), m).alias(m) for m in ("upper", "lower", "sentence", "title")])


@query(r"SELECT doc_id, regexp_replace(text, '[!-/:-@\[-`{-~]', '', 'g') AS text FROM documents")
def q28_punctuation(spark, sf_dir):  # noqa: ANN001, ANN201
    return _texts(spark, sf_dir, text.drop_punctuation)


@query(r"SELECT doc_id, regexp_replace(text, '\p{C}', '', 'g') AS text FROM documents")
def q29_non_printable(spark, sf_dir):  # noqa: ANN001, ANN201
    return _texts(spark, sf_dir, text.drop_unprintable)


@query(r"SELECT doc_id, regexp_replace(text, '[^a-zA-Z0-9\s.,_-]', '', 'g') AS text FROM documents")
def q30_special_chars(spark, sf_dir):  # noqa: ANN001, ANN201
    return _texts(spark, sf_dir, text.drop_special)


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE c_mktsegment END AS segment FROM customer")
def q31_replace_values(spark, sf_dir):  # noqa: ANN001, ANN201
    return _read(spark, sf_dir, "customer").select("c_custkey", text.replace_values(_c("c_mktsegment"), {"BUILDING": "B", "MACHINERY": "M"}).alias("segment"))


@query("""SELECT c_custkey, CASE WHEN starts_with(c_name, 'Customer#') THEN substr(c_name, 10) ELSE c_name END AS stripped, CASE WHEN ends_with(c_mktsegment, 'ING') THEN left(c_mktsegment, length(c_mktsegment) - 3) ELSE c_mktsegment END AS stem,
    CASE WHEN length(c_mktsegment) < 12 THEN lpad(c_mktsegment, 12, '*') ELSE c_mktsegment END AS padded FROM customer""")
def q32_strip_pad(spark, sf_dir):  # noqa: ANN001, ANN201
    return _read(spark, sf_dir, "customer").select("c_custkey", text.strip_prefix(_c("c_name"), "Customer#").alias("stripped"), text.strip_suffix(_c("c_mktsegment"), "ING").alias("stem"), text.pad(_c("c_mktsegment"), 12, "*", "left").alias("padded"))


@query("SELECT c_custkey, CASE WHEN regexp_matches(substr(c_name, 10), '^0+[0-9]') THEN ltrim(substr(c_name, 10), '0') ELSE substr(c_name, 10) END AS number FROM customer")
def q33_leading_zeros(spark, sf_dir):  # noqa: ANN001, ANN201
    return _read(spark, sf_dir, "customer").select("c_custkey", text.drop_leading_zeros(text.strip_prefix(_c("c_name"), "Customer#")).alias("number"))


_EMAIL = r"[a-zA-Z0-9._%+-]+@([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})"


@query(f"SELECT 'd' AS kind, doc_id AS id, NULLIF(regexp_extract(text, '{_EMAIL}', 1), '') AS domain FROM documents UNION ALL SELECT 'c', conv_id * 1000 + turn, NULLIF(regexp_extract(text, '{_EMAIL}', 1), '') FROM conversations")
def q34_email_domain(spark, sf_dir):  # noqa: ANN001, ANN201
    d = _read(spark, sf_dir, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), text.email_domain(_c("text")).alias("domain"))
    return d.unionAll(_read(spark, sf_dir, "conversations").select(F.lit("c"), F.col("conv_id") * 1000 + F.col("turn"), text.email_domain(_c("text"))))


@query(f"SELECT conv_id, turn, CASE WHEN contains(text, '@') AND NOT regexp_full_match(text, '{_EMAIL}') THEN '' ELSE text END AS text FROM conversations")
def q35_validate_email(spark, sf_dir):  # noqa: ANN001, ANN201
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", text.valid_email(_c("text")).alias("text"))


_URL = r"^(https?://)([^/]+)(/[^?]*)?(\?.*)?$"


@query(f"SELECT page_id, {', '.join(f'''NULLIF(regexp_extract(url, '{_URL}', {k}), '') AS {name}''' for k, name in ((1, 'protocol'), (2, 'domain'), (3, 'path'), (4, 'query')))} FROM pages")
def q36_url_components(spark, sf_dir):  # noqa: ANN001, ANN201
    return _read(spark, sf_dir, "pages").select("page_id", *[v.alias(k) for k, v in text.url_parts(_c("url")).items()])


@query("SELECT page_id, CASE WHEN starts_with(url, 'http://') OR starts_with(url, 'https://') THEN regexp_replace(lower(url), '/$', '') ELSE url END AS url FROM pages")
def q37_normalize_urls(spark, sf_dir):  # noqa: ANN001, ANN201
    return _read(spark, sf_dir, "pages").select("page_id", text.normal_url(_c("url")).alias("url"))


@query(r"""SELECT conv_id, turn, CASE WHEN length(d) >= 10 THEN '+1 (' || substr(right(d, 10), 1, 3) || ') ' || substr(right(d, 10), 4, 3) || '-' || right(d, 4) ELSE text END AS text
    FROM (SELECT conv_id, turn, text, regexp_replace(text, '[^0-9]', '', 'g') AS d FROM conversations)""")
def q38_phone(spark, sf_dir):  # noqa: ANN001, ANN201
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", text.phone(_c("text"), "international").alias("text"))


@query("SELECT l_orderkey, l_linenumber, floor(l_extendedprice + 0.5)::BIGINT AS rounded, trunc(l_extendedprice)::BIGINT AS truncated FROM lineitem")
def q39_numeric_modes(spark, sf_dir):  # noqa: ANN001, ANN201
    price = _c("l_extendedprice").cast("string")
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", numeric.standard_number(price, "int_round").cast("bigint").alias("rounded"), numeric.standard_number(price, "int_trunc").cast("bigint").alias("truncated"))


@query("SELECT l_orderkey, l_linenumber, floor(l_extendedprice * 10 + 0.5) / 10 AS price, floor(l_tax * 10 + 0.5) / 10 AS tax FROM lineitem")
def q40_round_decimals(spark, sf_dir):  # noqa: ANN001, ANN201
    made = lambda c: numeric.round_decimals(_c(c).cast("string"), 1).cast("double")
    return _read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", made("l_extendedprice").alias("price"), made("l_tax").alias("tax"))


@query(f"""WITH g AS (SELECT event_id, {_GAPS} AS v FROM events), s AS (SELECT avg(v) AS mean, median(v) AS median FROM g), m AS (SELECT v AS mode FROM g WHERE v IS NOT NULL GROUP BY v ORDER BY count(*) DESC, CAST(v AS VARCHAR) LIMIT 1)
    SELECT event_id, coalesce(v, 0) AS constant, round(coalesce(v, mean), 4) AS mean, round(coalesce(v, median), 4) AS median FROM g, s""")
def q41_fill_constant_mean_median(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = _gaps(spark, sf_dir).select("event_id", *[_c("value").cast("string").alias(k) for k in ("constant", "mean", "median")])
    filled = fill.fill_missing(cells, "constant", ["constant"], "0")
    filled = fill.fill_missing(fill.fill_missing(filled, "mean", ["mean"]), "median", ["median"])
    return filled.select("event_id", _c("constant").cast("double").alias("constant"), F.round(_c("mean").cast("double"), 4).alias("mean"), F.round(_c("median").cast("double"), 4).alias("median"))


@query("""WITH g AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_orderpriority END AS p FROM orders), m AS (SELECT p FROM g WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1)
    SELECT o_orderkey, coalesce(g.p, m.p) AS p FROM g, m""")
def q41b_fill_mode(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = _read(spark, sf_dir, "orders").select("o_orderkey", F.when(_c("o_orderkey") % 7 != 0, _c("o_orderpriority")).alias("p"))
    return fill.fill_missing(cells, "mode", ["p"])


@query(f"""WITH g AS (SELECT event_id, {_GAPS} AS v FROM events)
    SELECT event_id, last_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS forward, first_value(v IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM g""")
def q42_fill_forward_backward(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = _gaps(spark, sf_dir).select("event_id", *[_c("value").cast("string").alias(k) for k in ("forward", "backward")])
    filled = fill.fill_missing(fill.fill_missing(cells, "forward", ["forward"], order="event_id"), "backward", ["backward"], order="event_id")
    return filled.select("event_id", _c("forward").cast("double").alias("forward"), _c("backward").cast("double").alias("backward"))


@query(f"""WITH g AS (SELECT event_id, {_GAPS} AS v, row_number() OVER (ORDER BY event_id) AS r FROM events),
    n AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS pv, last_value(CASE WHEN v IS NOT NULL THEN r END IGNORE NULLS) OVER a AS pr, first_value(v IGNORE NULLS) OVER b AS nv, first_value(CASE WHEN v IS NOT NULL THEN r END IGNORE NULLS) OVER b AS nr
    FROM g WINDOW a AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(CASE WHEN v IS NULL AND pv IS NOT NULL AND nv IS NOT NULL THEN pv + (nv - pv) * (r - pr) / (nr - pr) ELSE v END, 4) AS value FROM n""")
def q43_interpolate(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = _gaps(spark, sf_dir).select("event_id", _c("value").cast("string").alias("value"))
    return fill.fill_missing(cells, "interpolate", ["value"], order="event_id").select("event_id", F.round(_c("value").cast("double"), 4).alias("value"))


@query("""SELECT s_suppkey, round((s_acctbal - min(s_acctbal) OVER ()) / (max(s_acctbal) OVER () - min(s_acctbal) OVER ()), 4) AS minmax, round((s_acctbal - avg(s_acctbal) OVER ()) / stddev_pop(s_acctbal) OVER (), 4) AS zscore FROM supplier""")
def q44_minmax_zscore(spark, sf_dir):  # noqa: ANN001, ANN201
    cells = _read(spark, sf_dir, "supplier").select("s_suppkey", _c("s_acctbal").cast("string").alias("minmax"), _c("s_acctbal").cast("string").alias("zscore"))
    done = fill.z_score(fill.min_max(cells, ["minmax"]), ["zscore"])
    return done.select("s_suppkey", F.round(_c("minmax").cast("double"), 4).alias("minmax"), F.round(_c("zscore").cast("double"), 4).alias("zscore"))


@query("SELECT p_brand, size, CASE WHEN size < 10 THEN 'small' WHEN size < 30 THEN 'medium' WHEN size < 45 THEN 'large' ELSE 'bin_3' END AS size_binned FROM (SELECT DISTINCT p_brand, p_size AS size FROM part WHERE p_size >= 0)")
def q45_bin_dedupe(spark, sf_dir):  # noqa: ANN001, ANN201
    df = rows.remove_duplicates(_read(spark, sf_dir, "part").select("p_brand", F.col("p_size").alias("size")))
    return cols.bin_column(df, "size", [0, 10, 30, 45], ["small", "medium", "large"])


@query("""WITH b AS (SELECT DISTINCT p_brand AS v FROM part) SELECT x.v AS a, y.v AS b, round(CASE WHEN x.v = y.v THEN 1 ELSE 1 - levenshtein(x.v, y.v) / greatest(length(x.v), length(y.v)) END, 4) AS levenshtein, round(jaro_winkler_similarity(x.v, y.v), 4) AS jaro_winkler
    FROM b x JOIN b y ON x.v < y.v""")
def q46_similarity_pairs(spark, sf_dir):  # noqa: ANN001, ANN201
    brands = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("a")).distinct()
    pairs = brands.join(F.broadcast(brands.withColumnRenamed("a", "b")), F.col("a") < F.col("b"))  # the query is about all pairs of the few brands
    return _rounded(pairs.select("a", "b", fuzzy.levenshtein_similarity(_c("a"), _c("b")).alias("levenshtein"), fuzzy.jaro_winkler_similarity(_c("a"), _c("b")).alias("jaro_winkler")))


def _ref(file: str, column: str) -> dict:
    return {"var": f"node::{file}::{column}"}


def _standard(target: str, file: str, inputs: list[str], logic_and_values: list[tuple[dict, str]]) -> dict:
    return {"mappingType": "standard", "targetField": target, "inputs": [{"sourceId": f"node::{file}", "column": c} for c in inputs], "rules": [{"logic": logic, "then": {"kind": "literal", "value": value}} for logic, value in logic_and_values]}


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE '' END AS state FROM orders")
def q47_map_standard(spark, sf_dir):  # noqa: ANN001, ANN201
    status = _ref("orders.csv", "o_orderstatus")
    spec = {"mappings": [_standard("o_orderkey", "orders.csv", ["o_orderkey"], []), _standard("state", "orders.csv", ["o_orderstatus"], [({"==": [status, "F"]}, "done"), ({"==": [status, "O"]}, "open")])]}
    return harmonize(_read(spark, sf_dir, "orders"), spec, "orders.csv").select(_c("o_orderkey").cast("bigint").alias("o_orderkey"), "state")


def _between(file: str, column: str, low: object, high: object) -> dict:
    return {"and": [{">=": [{"to_number": [_ref(file, column)]}, low]}, {"<": [_ref(file, column), high]}]}


@query("SELECT c_custkey, CASE WHEN c_acctbal BETWEEN -1000 AND 0 THEN 'debt' WHEN c_acctbal BETWEEN 0 AND 5000 THEN 'some' WHEN c_acctbal BETWEEN 5000 AND 100000 THEN 'much' ELSE '' END AS balance FROM customer")
def q48_map_range(spark, sf_dir):  # noqa: ANN001, ANN201
    file, column = "customer.csv", "c_acctbal"
    ranges = [(_between(file, column, -1000, 0), "debt"), (_between(file, column, 0, 5000), "some"), (_between(file, column, 5000, 100000), "much")]
    spec = {"mappings": [_standard("c_custkey", file, ["c_custkey"], []), _standard("balance", file, [column], ranges)]}
    return harmonize(_read(spark, sf_dir, "customer"), spec, file).select(_c("c_custkey").cast("bigint").alias("c_custkey"), "balance")


@query("SELECT c_custkey, (c_mktsegment = 'BUILDING')::INTEGER::VARCHAR AS building, (c_mktsegment = 'MACHINERY' OR c_acctbal BETWEEN 0 AND 100)::INTEGER::VARCHAR AS machinery_or_poor FROM customer")
def q49_one_hot(spark, sf_dir):  # noqa: ANN001, ANN201
    file, segment = "customer.csv", _ref("customer.csv", "c_mktsegment")
    outputs = [{"targetField": "building", "logic": {"==": [segment, "BUILDING"]}}, {"targetField": "machinery_or_poor", "logic": {"or": [{"==": ["MACHINERY", segment]}, _between(file, "c_acctbal", 0, 100)]}}]
    spec = {"mappings": [_standard("c_custkey", file, ["c_custkey"], []), {"mappingType": "one-hot", "inputs": [{"column": "c_mktsegment"}, {"column": "c_acctbal"}], "outputs": outputs}]}
    return harmonize(_read(spark, sf_dir, "customer"), spec, file).withColumn("c_custkey", _c("c_custkey").cast("bigint"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = floor(l_quantity) THEN l_quantity END AS whole FROM lineitem")
def q50_typed_passthrough(spark, sf_dir):  # noqa: ANN001, ANN201
    file = "lineitem.csv"
    rule = {"logic": {"isInteger": [_ref(file, "l_quantity")]}, "then": {"kind": "source-value", "sourceId": f"node::{file}", "column": "l_quantity"}}
    spec = {"mappings": [_standard(k, file, [k], []) for k in ("l_orderkey", "l_linenumber")] + [{"targetField": "whole", "inputs": [{"sourceId": f"node::{file}", "column": "l_quantity"}], "rules": [rule]}]}
    done = harmonize(_read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity"), spec, file)
    return done.select(_c("l_orderkey").cast("bigint").alias("l_orderkey"), _c("l_linenumber").cast("int").alias("l_linenumber"), num(_c("whole")).alias("whole"))


@query("""SELECT kind, id, NOT (contains(t, '<script>') OR contains(t, '<iframe>') OR contains(t, 'javascript:') OR contains(t, 'vbscript:')) AS passes FROM (
    SELECT 'page' AS kind, page_id AS id, html AS t FROM pages UNION ALL SELECT 'url', page_id, url FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents)""")
def q51_content_screen(spark, sf_dir):  # noqa: ANN001, ANN201
    pages = _read(spark, sf_dir, "pages")
    parts = [pages.select(F.lit(k).alias("kind"), F.col("page_id").alias("id"), clean_text(_c(c)).alias("passes")) for k, c in (("page", "html"), ("url", "url"))]
    return parts[0].unionAll(parts[1]).unionAll(_read(spark, sf_dir, "documents").select(F.lit("document"), "doc_id", clean_text(_c("text"))))


@query("""WITH f AS (SELECT n_name || '.csv' AS name FROM nation UNION ALL SELECT 'parsed_' || n_name || '.csv' FROM nation WHERE n_nationkey % 2 = 0)
    SELECT lower(regexp_replace(regexp_replace(name, '\\.[^.]*$', ''), '^parsed[_-]', '')) AS dataset, count(*) AS files FROM f GROUP BY 1""")
def q52_dataset_groups(spark, sf_dir):  # noqa: ANN001, ANN201
    nation = _read(spark, sf_dir, "nation")
    names = nation.select(F.concat("n_name", F.lit(".csv")).alias("name")).unionAll(nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("parsed_"), "n_name", F.lit(".csv"))))
    return metadata.dataset_groups(names.withColumn("modified", F.lit("2020-01-01").cast("timestamp"))).select("dataset", F.size("files").cast("bigint").alias("files"))


@query("SELECT r_regionkey, regexp_replace(regexp_replace(lower(r_name || ' & more.'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM region")
def q53_slug(spark, sf_dir):  # noqa: ANN001, ANN201
    return _read(spark, sf_dir, "region").select("r_regionkey", metadata.slug(F.concat("r_name", F.lit(" & more."))).alias("slug"))


@query("SELECT c_custkey, string_split(c_name, '#')[1] AS word, string_split(c_name, '#')[2] AS number, concat_ws('/', c_name, c_mktsegment) AS both FROM customer")
def q54_split_merge(spark, sf_dir):  # noqa: ANN001, ANN201
    df = cols.split_column(_read(spark, sf_dir, "customer"), "c_name", "#", ["word", "number"])
    return cols.merge_columns(df, ["c_name", "c_mktsegment"], "/", "both").select("c_custkey", "word", "number", "both")


@query("SELECT o_orderkey, year(o_orderdate)::VARCHAR AS day_year, month(o_orderdate)::VARCHAR AS day_month, day(o_orderdate)::VARCHAR AS day_day, strftime(o_orderdate, '%d/%m/%Y') AS written FROM orders")
def q55_date_components(spark, sf_dir):  # noqa: ANN001, ANN201
    df = _read(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("day"))
    return cols.with_date_parts(df, ["day"]).withColumn("written", numeric.standard_date(_c("day"), "DD/MM/YYYY")).drop("day")


@query("SELECT p_partkey, trunc(p_retailprice)::BIGINT AS whole, p_retailprice AS price, lower(CASE WHEN p_size > 25 THEN 'TRUE' ELSE p_type END) = 'true' AS flag FROM part")
def q56_convert_types(spark, sf_dir):  # noqa: ANN001, ANN201
    df = _read(spark, sf_dir, "part").select("p_partkey", *[_c("p_retailprice").cast("string").alias(n) for n in ("whole", "price")], F.when(_c("p_size") > 25, "TRUE").otherwise(_c("p_type")).alias("flag"))
    done = cols.convert_types(df, {"whole": "integer", "price": "float", "flag": "boolean"})
    return done.select("p_partkey", _c("whole").cast("bigint").alias("whole"), _c("price").cast("double").alias("price"), _c("flag").cast("boolean").alias("flag"))


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def q57_normalize_unicode(spark, sf_dir):  # noqa: ANN001, ANN201
    return _texts(spark, sf_dir, lambda c: text.unicode_form(c, "NFC"))


#: Customers' names with signs whose UTF-8 bytes were read as Windows-1252, and what was meant.
_MISREAD, _MEANT = "MÃ¼ller, JosÃ© â€“ ", "Müller, José – "


@query(f"SELECT doc_id AS id, text FROM documents UNION ALL SELECT -c_custkey, '{_MEANT}' || c_name FROM customer")
def q58_fix_encoding(spark, sf_dir):  # noqa: ANN001, ANN201
    names = _read(spark, sf_dir, "customer").select((-_c("c_custkey")).alias("id"), text.fix_encoding(F.concat(F.lit(_MISREAD), "c_name")).alias("text"))
    return _texts(spark, sf_dir, text.fix_encoding).withColumnRenamed("doc_id", "id").unionByName(names)


@query("SELECT s_suppkey, count(*) AS n FROM supplier WHERE trim(s_name) <> '' GROUP BY s_suppkey")
def q59_row_operators(spark, sf_dir):  # noqa: ANN001, ANN201
    df = rows.remove_empty_rows(_read(spark, sf_dir, "supplier", "s_suppkey", "s_name"), ("s_suppkey",))
    df = rows.keep_only_numeric_rows(rows.remove_rows_with_pattern(df, "s_name", r"^\s*$"), ["s_suppkey"])
    return df.where(~blank(_c("s_name"))).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"))


@query()
def q60_merge_similar_values(spark, sf_dir):  # noqa: ANN001, ANN201
    df = _read(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("kind"))
    return fuzzy.merge_similar_values(df, ["kind"], "p_partkey", "levenshtein", 0.8)


@query("""WITH d AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, * FROM lineitem), m AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM d),
    c AS (SELECT * REPLACE (CASE l_returnflag WHEN 'R' THEN 'RETURNED' ELSE upper(l_returnflag) END AS l_returnflag) FROM d)
    SELECT id, l_orderkey::VARCHAR AS l_orderkey, l_partkey::VARCHAR AS l_partkey, l_suppkey::VARCHAR AS l_suppkey, l_linenumber::VARCHAR AS l_linenumber, l_quantity::VARCHAR AS l_quantity, round((l_extendedprice - lo) / (hi - lo), 4) AS l_extendedprice,
    l_discount::VARCHAR AS l_discount, l_tax::VARCHAR AS l_tax, l_returnflag, l_linestatus, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate, l_returnflag || ' ' || l_linestatus AS flags,
    CASE WHEN l_quantity < 10 THEN 'bin_0' WHEN l_quantity < 25 THEN 'bin_1' WHEN l_quantity < 50 THEN 'bin_2' ELSE 'bin_3' END AS l_quantity_binned FROM c, m""")
def q61_cleaning_pipeline(spark, sf_dir):  # noqa: ANN001, ANN201
    from loomgrid.plans.cleaning import CleaningOptions, clean

    df = _read(spark, sf_dir, "lineitem").withColumn("id", _c("l_orderkey") * 10 + _c("l_linenumber"))
    options = CleaningOptions(remove_empty_rows=True, remove_duplicates=True, replace_values=True, replacement_map={"R": "returned"}, fill_missing_values=True, fill_strategy="constant", fill_constant_value="?", trim_whitespace=True, standardize_case=True, case_mode="upper", standardize_dates=True, remove_leading_zeros=True, merge_columns=True, columns_to_merge=["l_returnflag", "l_linestatus"], merged_column_name="flags", normalize_data=True, normalize_columns=["l_extendedprice"], bin_data=True, bin_column="l_quantity", bin_edges=[0, 10, 25, 50], merge_similar_values=True, fuzzy_match_columns=["l_returnflag"])
    return clean(df, options, "id").withColumn("l_extendedprice", F.round(_c("l_extendedprice").cast("double"), 4))


@query("""SELECT 'no operator' AS rule, c_custkey FROM customer UNION ALL SELECT 'categorical equal', c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'
    UNION ALL SELECT 'missing cell', c_custkey FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey < 50""")
def q62_filter_edges(spark, sf_dir):  # noqa: ANN001, ANN201
    df = _read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").withColumn("gap", F.when(_c("c_custkey") % 3 != 0, _c("c_custkey").cast("string")))
    only = lambda column, *conditions: {"operator": "AND", "conditions": {column: {"conditions": list(conditions), "operators": []}}}
    trees = {
        "no operator": {"conditions": {"c_mktsegment": "none"}}, "unknown operator": {"operator": "XOR", "conditions": {"c_mktsegment": "BUILDING"}}, "empty chain": only("c_mktsegment"),
        "categorical equal": only("c_mktsegment", _condition("equal", "categorical", "BUILDING")), "categorical greater": only("c_mktsegment", _condition("greater", "categorical", "A")),
        "missing cell": only("gap", _condition("less", "continuous", 50)), "missing column": only("none", _condition("less", "continuous", 50)), "unknown kind": only("gap", _condition("less", "other", 50)),
    }
    out = None
    for rule, tree in trees.items():
        kept = filter_rows(df, tree).select(F.lit(rule).alias("rule"), "c_custkey")
        out = kept if out is None else out.unionByName(kept)
    return out


@query(f"SELECT event_id, {_GAPS} AS value, event_type FROM events")
def q63_unknown_modes_change_nothing(spark, sf_dir):  # noqa: ANN001, ANN201
    df = fill.fill_missing(_gaps(spark, sf_dir), "guess", ["value"])
    return df.select("event_id", "value", text.case(_c("event_type"), "shout").alias("event_type"))


@query("""WITH b AS (SELECT DISTINCT p_brand AS v FROM part UNION SELECT n_name FROM nation UNION SELECT 'ab'),
    g AS (SELECT v, CASE WHEN length(v) < 3 THEN [v] ELSE list_distinct(list_transform(range(1, length(v) - 1), lambda i: substr(v, i::INTEGER, 3))) END AS t FROM b)
    SELECT x.v AS a, y.v AS b, round(len(list_intersect(x.t, y.t)) / (sqrt(len(x.t)) * sqrt(len(y.t))), 4) AS cosine FROM g x JOIN g y ON x.v < y.v""")
def q64_trigram_cosine(spark, sf_dir):  # noqa: ANN001, ANN201
    names = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("a")).union(_read(spark, sf_dir, "nation").select("n_name")).union(spark.createDataFrame([("ab",)], "a string")).distinct()
    pairs = names.join(F.broadcast(names.withColumnRenamed("a", "b")), F.col("a") < F.col("b"))  # the query is about all pairs of the few names
    return _rounded(pairs.select("a", "b", fuzzy.cosine_similarity(_c("a"), _c("b")).alias("cosine")))


_SHORT = r"regexp_replace(regexp_replace(printf('%.2f', {x}), '(\.\d*?)0+$', '\1'), '\.$', '')"


@query(f"""WITH r AS ({_RANKED.format(x='l_quantity', t='lineitem')}), s AS (SELECT min(x) AS lo, max(x) AS hi, max(n) AS n, {_QUARTILES} FROM r),
    w AS (SELECT lo, hi, greatest(2 * (q3 - q1) / cbrt(n), (hi - lo) / 10) AS width FROM s), b AS (SELECT *, unnest(range(0, ceil((hi - lo) / width)::INTEGER))::INTEGER AS bin FROM w)
    SELECT bin, '[' || {_SHORT.format(x='lo + bin * width')} || ' - ' || {_SHORT.format(x='lo + (bin + 1) * width')} || ']' AS label FROM b""")
def q65_histogram_labels(spark, sf_dir):  # noqa: ANN001, ANN201
    return prof.histogram(_read(spark, sf_dir, "lineitem", "l_quantity"), _c("l_quantity")).select("bin", "label")


@query(f"SELECT 'value' AS feature, round(count(*) FILTER (WHERE v IS NULL) / count(*) * 100, 4) AS percent_missing FROM (SELECT {_GAPS} AS v FROM events)")
def q66_percent_missing(spark, sf_dir):  # noqa: ANN001, ANN201
    counts = prof.missing_counts(prof.typed_cells(_gaps(spark, sf_dir), "event_id", ["value"]))
    return counts.select("feature", F.round(_c("missing") / (_c("missing") + _c("present")) * 100, 4).alias("percent_missing"))


@query("SELECT min(p_partkey) AS p_partkey, p_brand, p_size FROM part GROUP BY p_brand, p_size")
def q67_first_of_equal_rows(spark, sf_dir):  # noqa: ANN001, ANN201
    return rows.remove_duplicates(_read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size"), "p_partkey")


@query("SELECT event_id, CASE event_id % 5 WHEN 2 THEN '12abc' ELSE event_id::VARCHAR END AS cell FROM events WHERE event_id % 5 IN (2, 3)")
def q68_rows_that_go(spark, sf_dir):  # noqa: ANN001, ANN201
    kind, number = _c("event_id") % 5, _c("event_id").cast("string")
    cell = F.when(kind == 0, " ").when(kind == 1, "abc").when(kind == 2, "12abc").when(kind == 3, number).otherwise(F.concat(number, F.lit(" gone")))
    df = rows.remove_empty_rows(_read(spark, sf_dir, "events", "event_id").withColumn("cell", cell), ("event_id",))
    return rows.keep_only_numeric_rows(rows.remove_rows_with_pattern(df, "cell", "gone$"), ["cell"])


@query("SELECT 'p_brand=' || p_brand || '|p_size=' || p_size AS key, min(p_partkey) AS p_partkey FROM part GROUP BY p_brand, p_size")
def q69_dedupe_key(spark, sf_dir):  # noqa: ANN001, ANN201
    df = _read(spark, sf_dir, "part", "p_partkey", "p_size", "p_brand").withColumn("key", rows.dedupe_key(["p_size", "p_brand"]))
    return rows.first_rows(df, ["key"], ["p_partkey"]).select("key", "p_partkey")


@query(r"SELECT n_nationkey, regexp_replace(regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS dataset FROM nation")
def q70_logical_ids(spark, sf_dir):  # noqa: ANN001, ANN201
    name = F.concat(F.when(_c("n_nationkey") % 2 == 0, "parsed_").otherwise(""), "n_name", F.lit(".csv"))
    return _read(spark, sf_dir, "nation").select("n_nationkey", policy.logical_id(name).alias("dataset"))


@query("SELECT n_name AS name FROM nation WHERE n_regionkey = 2 AND n_name <> 'NATION_7'")
def q71_shared_files(spark, sf_dir):  # noqa: ANN001, ANN201
    files = _read(spark, sf_dir, "nation").select(F.sha2("n_name", 256).alias("fingerprint"), F.concat(F.lit("r"), "n_regionkey").alias("dataset"), F.col("n_name").alias("name"))
    manifest = policy.share(policy.share(spark.createDataFrame([], policy.MANIFEST), files, "r1"), files, "r2")
    manifest = policy.deleted(policy.unshare(manifest, "r1"), hashlib.sha256(b"NATION_7").hexdigest())
    return policy.downloadable(files, manifest).select("name")


@query(f"""WITH c AS (SELECT l_orderkey, l_linenumber, (l_extendedprice * l_extendedprice * l_extendedprice) * (l_extendedprice * l_extendedprice * l_extendedprice) AS x FROM lineitem), s AS (SELECT {_QUARTILES} FROM ({_RANKED.format(x='x', t='c')}))
    SELECT l_orderkey, l_linenumber FROM c, s WHERE x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1)""")
def q72_outliers_of_a_skewed_column(spark, sf_dir):  # noqa: ANN001, ANN201
    cube = _c("l_extendedprice") * _c("l_extendedprice") * _c("l_extendedprice")
    return prof.outliers(_read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice"), cube * cube, ["l_orderkey", "l_linenumber"]).drop("value")
