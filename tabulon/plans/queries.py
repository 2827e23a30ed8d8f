"""Registered queries of the library's own operators over the driver's tables, each with the same in DuckDB's SQL where SQL has it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.functions import metrics, values
from tabulon.operators import anomaly, clean, cluster, drift, encode, forecast, importance, profile, splits, train
from tabulon.operators.quantiles import exact_quantiles
from tabulon.sources import writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
DIGITS = 6

#: A table with dirt, made from customer by expressions that Spark and DuckDB read alike.
DIRTY = (
    "c_custkey AS id",
    "CASE WHEN c_custkey % 7 = 0 THEN upper(c_mktsegment) WHEN c_custkey % 11 = 0 THEN concat('  ', lower(c_mktsegment), ' ') WHEN c_custkey % 13 = 0 THEN 'N/A' WHEN c_custkey % 17 = 0 THEN NULL ELSE initcap_(c_mktsegment) END AS segment",
    "CASE WHEN c_custkey % 19 = 0 THEN 'n/a' WHEN c_custkey % 23 = 0 THEN concat('(', CAST(c_custkey % 50 AS VARCHAR(9)), ')') ELSE concat('$', CAST(c_custkey % 97 + 1 AS VARCHAR(9)), ',', lpad(CAST(c_custkey % 1000 AS VARCHAR(9)), 3, '0')) END AS income",
    "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_acctbal END AS balance",
    "CASE WHEN c_custkey % 10 < 8 THEN 'no' ELSE 'yes' END AS churned",
    "CAST(NULL AS VARCHAR(9)) AS nothing",
)
_DIRTY = [x.replace("initcap_(c_mktsegment)", "c_mktsegment") for x in DIRTY]
DIRTY_SQL = "(select " + ", ".join(_DIRTY) + " from customer)"
TOKENS = ", ".join(f"'{t}'" for t in values.MISSING)
CLEAN_SQL = f"(select id, case when lower(trim(segment)) in ({TOKENS}) then null else trim(segment) end as segment, case when lower(trim(income)) in ({TOKENS}) then null else trim(income) end as income, balance, churned from {DIRTY_SQL})"
#: Labels and scores made from lineitem by rule, to measure.
SCORED = ("l_orderkey * 8 + l_linenumber AS id", "CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y", "floor((l_quantity * 7 + l_discount * 300 + CASE WHEN l_returnflag = 'R' THEN 90 ELSE 0 END) / 5) / 96 AS s", "l_returnflag AS truth", "CASE WHEN l_quantity < 12 THEN 'A' WHEN l_quantity < 30 THEN 'N' ELSE 'R' END AS guess", "l_extendedprice AS actual", "l_quantity * 1500.0 + 100 AS predicted")
SCORED_SQL = "(select " + ", ".join(SCORED) + " from lineitem)"
SPLIT_DAY = "1998-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr(*_DIRTY)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*SCORED)


def query(sql: str | None = None, doubles: str = "", digits: int = DIGITS) -> Callable:
    """Register a function as a query. doubles: columns that both sides round to digits, since sums depend on their order."""
    names = doubles.split()

    def wrap(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in names}) if names else df

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = f"select * replace ({', '.join(f'round(cast({c} as double), {digits}) + 0.0 as {c}' for c in names)}) from ({sql})" if names else sql
        return f

    return wrap


# --- profile

_STATS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _stats_sql(c: str, source: str) -> str:
    return f"select '{c}' as \"column\", count(*) as n, count(*) - count({c}) as n_missing, 1 - count({c}) / count(*) as missing_share, count(distinct {c}) as n_unique, avg({c}) as mean, stddev_samp({c}) as std, min({c}) as min, quantile_cont({c}, 0.5) as median, max({c}) as max, skewness({c}) as skew from {source}"


@query(" union all ".join(_stats_sql(c, "lineitem") for c in _STATS), "missing_share mean std min median max skew", digits=7)
def profile_numeric(spark, sf_dir):  # noqa: ANN001, ANN201
    return profile.numeric_profile(table(spark, sf_dir, "lineitem"), list(_STATS))


@query(_stats_sql("balance", DIRTY_SQL), "missing_share mean std min median max skew")
def profile_missing(spark, sf_dir):  # noqa: ANN001, ANN201
    return profile.numeric_profile(dirty(spark, sf_dir), ["balance"])


@query()
def profile_kinds(spark, sf_dir):  # noqa: ANN001, ANN201
    return profile.kinds_frame(table(spark, sf_dir, "orders"))


@query()
def profile_issues(spark, sf_dir):  # noqa: ANN001, ANN201
    return profile.issues(dirty(spark, sf_dir), "churned")


@query("""with long as (select 'o_orderstatus' as "column", o_orderstatus as value from orders union all select 'o_orderpriority', o_orderpriority from orders),
c as (select "column", value, count(*) as n, count(*) / sum(count(*)) over (partition by "column") as share, row_number() over (partition by "column" order by count(*) desc, value) as k from long where value is not null group by 1, 2)
select "column", value, n, share from c where k <= 3""", "share")
def value_counts_top(spark, sf_dir):  # noqa: ANN001, ANN201
    return profile.value_shares(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], 3)


@query("""with c as (select event_type, count(*) as c from events where event_type is not null group by 1)
select cast(sum(c) as bigint) as n, count(*) as n_classes, min(c) / sum(c) as minority_share, max(c) / min(c) as ratio, count(*) > 1 and ((min(c) / sum(c) < 0.2 and max(c) / min(c) > 3) or max(c) / min(c) > 10) as imbalanced from c""", "minority_share ratio")
def target_imbalance(spark, sf_dir):  # noqa: ANN001, ANN201
    return profile.imbalance(table(spark, sf_dir, "events"), "event_type")


@query("with c as (select c_nationkey, c_mktsegment, count(*) as c from customer group by all) select cast(sum(c) as bigint) as n_rows, cast(sum(c - 1) as bigint) as n_duplicates from c")
def duplicate_rows(spark, sf_dir):  # noqa: ANN001, ANN201
    return profile.duplicate_rows(table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment"))


@query("""with x as (select 'n_name' as "column", n_name as v, cast(n_regionkey as varchar) as y from nation union all select 'n_regionkey', cast(n_regionkey as varchar), cast(n_regionkey as varchar) from nation),
p as (select "column", v, count(distinct y) as t from x group by 1, 2)
select "column", count(*) as n_values, max(t) as most_targets, max(t) = 1 as determines from p group by 1""")
def functional_dependencies(spark, sf_dir):  # noqa: ANN001, ANN201
    return profile.dependencies(table(spark, sf_dir, "nation"), ["n_name", "n_regionkey"], "n_regionkey")


@query("""with x as (select l_extendedprice as y, l_extendedprice as same, l_extendedprice * 2 + l_tax as follows, l_tax from lineitem)
select 'same' as "column", bool_and(same = y) as identical, corr(same, y) as corr, true as leak from x
union all select 'follows', bool_and(follows = y), corr(follows, y), bool_and(follows = y) or abs(corr(follows, y)) >= 0.98 from x
union all select 'l_tax', bool_and(l_tax = y), corr(l_tax, y), bool_and(l_tax = y) or abs(corr(l_tax, y)) >= 0.98 from x""", "corr")
def leaks(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_extendedprice as y", "l_extendedprice as same", "l_extendedprice * 2 + l_tax as follows", "l_tax")
    return profile.target_links(rows, ["same", "follows", "l_tax"], "y")


@query("select quantile_cont(o_totalprice, 0.05) as p05, quantile_cont(o_totalprice, 0.25) as q1, quantile_cont(o_totalprice, 0.5) as median, quantile_cont(o_totalprice, 0.95) as p95 from orders", "p05 q1 median p95")
def quantiles(spark, sf_dir):  # noqa: ANN001, ANN201
    found = exact_quantiles(table(spark, sf_dir, "orders"), {"x": F.col("o_totalprice")}, [0.05, 0.25, 0.5, 0.95])["x"]
    return spark.createDataFrame([tuple(found or [None] * 4)], "p05 double, q1 double, median double, p95 double")


@query("""with b as (select min(l_quantity) as lo, max(l_quantity) as hi from lineitem)
select cast(least(floor((l_quantity - lo) / (hi - lo) * 20), 19) as integer) as bin, count(*) as n from lineitem, b group by 1""")
def histogram(spark, sf_dir):  # noqa: ANN001, ANN201
    from tabulon.plans.report import histogram as bins

    return bins(table(spark, sf_dir, "lineitem"), "l_quantity", 20)


@query("with c as (select o_orderstatus, o_orderpriority as v, count(*) as n from orders group by 1, 2) select o_orderstatus, v as mode from (select *, row_number() over (partition by o_orderstatus order by n desc, v) as k from c) where k = 1")
def mode_by_group(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.mode("o_orderpriority", True).alias("mode"))


# --- clean

@query(f"select id, segment, income, balance, churned from {CLEAN_SQL}", "balance")
def clean_placeholders(spark, sf_dir):  # noqa: ANN001, ANN201
    return clean.drop_empty_columns(clean.blank_placeholders(dirty(spark, sf_dir)))


@query(f"select id, try_cast(regexp_replace(regexp_replace(income, '[,\\s$€£¥₹%]', '', 'g'), '^\\((.*)\\)$', '-\\1') as double) as income from {CLEAN_SQL}", "income")
def clean_numbers(spark, sf_dir):  # noqa: ANN001, ANN201
    return clean.convert(clean.blank_placeholders(dirty(spark, sf_dir)), {"income": ("numeric", "")}).select("id", "income")


@query(f"""with c as (select lower(trim(segment)) as f, segment, count(*) as n from {CLEAN_SQL} where segment is not null group by 1, 2),
b as (select f, segment from (select *, row_number() over (partition by f order by n desc, segment) as k from c) where k = 1)
select d.id, b.segment from {CLEAN_SQL} d left join b on lower(trim(d.segment)) = b.f""")
def clean_spellings(spark, sf_dir):  # noqa: ANN001, ANN201
    return clean.unify_spellings(clean.blank_placeholders(dirty(spark, sf_dir)), ["segment"]).select("id", "segment")


@query("select distinct c_nationkey, c_mktsegment from customer")
def clean_duplicates(spark, sf_dir):  # noqa: ANN001, ANN201
    return clean.drop_duplicates(table(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment"))


@query("""with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events)
select event_id, greatest(least(value, b + 1.5 * (b - a)), a - 1.5 * (b - a)) as value from events, q""", "value")
def clean_clip(spark, sf_dir):  # noqa: ANN001, ANN201
    return clean.clip_outliers(table(spark, sf_dir, "events").select("event_id", "value"), ["value"])


@query("""with q as (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events),
f as (select event_id, value, value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a) as far from events, q)
select event_id, value from f where not far or (select avg(far::int) from f) > 0.1""", "value")
def clean_remove(spark, sf_dir):  # noqa: ANN001, ANN201
    return clean.remove_outliers(table(spark, sf_dir, "events").select("event_id", "value"), ["value"])


@query(f"""with m as (select quantile_cont(balance, 0.5) as m from {CLEAN_SQL}),
c as (select segment, count(*) as n from {CLEAN_SQL} where segment is not null group by 1),
t as (select segment from c order by n desc, segment limit 1)
select id, coalesce(balance, m.m) as balance, coalesce(d.segment, t.segment) as segment from {CLEAN_SQL} d, m, t""", "balance")
def clean_impute(spark, sf_dir):  # noqa: ANN001, ANN201
    return clean.impute(clean.blank_placeholders(dirty(spark, sf_dir)), ["balance"], ["segment"]).select("id", "balance", "segment")


@query("""with c as (select p_brand as v, count(*) as n, row_number() over (order by count(*) desc, p_brand) as k from part group by 1), t as (select v, k from c where k <= 2)
select p_partkey, cast(coalesce(p_brand = (select v from t where k = 1), false) as integer) as first_value, cast(coalesce(p_brand = (select v from t where k = 2), false) as integer) as second_value, cast(p_brand not in (select v from t) as integer) as other from part""")
def clean_one_hot(spark, sf_dir):  # noqa: ANN001, ANN201
    out = clean.one_hot(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), ["p_brand"], 2)
    return out.toDF("p_partkey", "first_value", "second_value", "other")


@query("select p_size, p_partkey from part where p_size in (select p_size from part group by 1 having count(*) >= 2)")
def clean_single_classes(spark, sf_dir):  # noqa: ANN001, ANN201
    return clean.drop_single_classes(table(spark, sf_dir, "part").select("p_size", "p_partkey"), "p_size")


@query()
def clean_all(spark, sf_dir):  # noqa: ANN001, ANN201
    return clean.clean(dirty(spark, sf_dir), target="churned", outliers="clip", fill=True).data


# --- scalar functions

@query("select o_orderkey, year(o_orderdate)::int as year, month(o_orderdate)::int as month, day(o_orderdate)::int as day, (isodow(o_orderdate) - 1)::int as dayofweek, hour(o_orderdate)::int as hour, (isodow(o_orderdate) >= 6)::int as is_weekend from orders")
def date_parts(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "orders").select("o_orderkey", *values.date_parts(F.col("o_orderdate")))


@query("select p_partkey, case when p_retailprice = floor(p_retailprice) then cast(cast(p_retailprice as bigint) as varchar) else null end as whole from part")
def category_text(spark, sf_dir):  # noqa: ANN001, ANN201
    c = F.col("p_retailprice")
    return table(spark, sf_dir, "part").select("p_partkey", F.when(c == F.floor(c), values.category(c, "double")).alias("whole"))


@query("select o_orderkey, cast(strptime(strftime(o_orderdate, '%d/%m/%Y'), '%d/%m/%Y') as timestamp) as parsed from orders")
def dates_from_text(spark, sf_dir):  # noqa: ANN001, ANN201
    text = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("x"))
    return text.select("o_orderkey", values.date(F.col("x"), values.guess_date_format(text, "x")).alias("parsed"))


@query("""with w as (select p_partkey, unnest(regexp_extract_all(lower(p_name), '\\b\\w\\w+\\b')) as term from part), c as (select p_partkey, term, count(*) as tf from w group by 1, 2),
k as (select term, count(*) as df, sum(tf) as total from c group by 1 order by total desc, term limit 300), n as (select count(*) as n from part),
r as (select p_partkey, term, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) as w from c join k using (term), n)
select p_partkey, term, w / sqrt(sum(w * w) over (partition by p_partkey)) as weight from r""", "weight")
def tf_idf(spark, sf_dir):  # noqa: ANN001, ANN201
    return encode.tf_idf(table(spark, sf_dir, "part"), "p_partkey", "p_name")


# --- encoding, splits

@query("""with m as (select quantile_cont(balance, 0.5) as m from """ + DIRTY_SQL + """ t), f as (select id, coalesce(balance, m) as b, (balance is null)::int::double as miss from """ + DIRTY_SQL + """ t, m)
select id, (b - (select avg(b) from f)) / (select stddev_pop(b) from f) as balance, miss as balance__missing from f""", "balance balance__missing")
def encode_numeric(spark, sf_dir):  # noqa: ANN001, ANN201
    df = dirty(spark, sf_dir)
    return encode.fit_encoding(df, ["balance"], []).table(df, ["id"])


@query("""with c as (select p_type as v, row_number() over (order by count(*) desc, p_type) as k from part group by 1), k as (select v from c where k <= 4)
select (select count(distinct p_type) from part) > 5 as grouped, sum((p_type in (select v from k))::int)::bigint as common, sum((p_type not in (select v from k))::int)::bigint as rare from part""")
def encode_levels(spark, sf_dir):  # noqa: ANN001, ANN201
    df = table(spark, sf_dir, "part").select("p_type")
    e = encode.fit_encoding(df, [], ["p_type"], levels=5)
    names = [n for n, _ in e.columns()]
    known = [F.col(f"`{n}`") for n in names if n != "p_type=other"]
    return e.table(df).agg(F.lit(e.rare["p_type"]).alias("grouped"), F.sum(sum(known[1:], known[0])).cast("long").alias("common"), F.sum(F.col("`p_type=other`")).cast("long").alias("rare"))


@query("with c as (select event_type as class, count(*) as n from events group by 1) select class, n, sum(n) over () / (count(*) over () * n) as weight from c", "weight")
def class_weights(spark, sf_dir):  # noqa: ANN001, ANN201
    return encode.class_weights(table(spark, sf_dir, "events"), "event_type")


_PLACE = "md5(concat_ws(':', cast(o_orderkey as varchar), '42'))"


@query(f"select o_orderkey, row_number() over (partition by o_orderstatus order by {_PLACE}) <= floor(count(*) over (partition by o_orderstatus) * 0.2) as is_test from orders")
def split_holdout(spark, sf_dir):  # noqa: ANN001, ANN201
    return splits.holdout(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus").select("o_orderkey", "is_test")


@query(f"select o_orderkey, ((row_number() over (partition by o_orderstatus order by {_PLACE}) - 1) % 5)::int as fold from orders")
def split_folds(spark, sf_dir):  # noqa: ANN001, ANN201
    return splits.folds(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 5, "o_orderstatus").select("o_orderkey", "fold")


@query(f"select o_orderkey from orders order by {_PLACE} limit 100")
def sample_exact(spark, sf_dir):  # noqa: ANN001, ANN201
    return splits.sample(table(spark, sf_dir, "orders").select("o_orderkey"), 100, "o_orderkey")


# --- metrics

@query(f"select truth as actual, guess as predicted, count(*) as n, count(*) / sum(count(*)) over (partition by truth) as row_share from {SCORED_SQL} group by 1, 2", "row_share")
def metric_confusion(spark, sf_dir):  # noqa: ANN001, ANN201
    return metrics.confusion(scored(spark, sf_dir), "truth", "guess")


_PER_CLASS = f"""with d as {SCORED_SQL}, l as (select truth as label from d union select guess from d),
c as (select label, sum((truth = label)::int) as support, sum((guess = label)::int) as chosen, sum((truth = label and guess = label)::int) as tp from l, d group by 1),
p as (select label, coalesce(tp / nullif(chosen, 0), 0) as precision, coalesce(tp / nullif(support, 0), 0) as recall, support::bigint as support, tp::bigint as tp from c),
f as (select label, precision, recall, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1, support, tp from p)"""


@query(_PER_CLASS + " select * from f", "precision recall f1")
def metric_per_class(spark, sf_dir):  # noqa: ANN001, ANN201
    return metrics.per_class(scored(spark, sf_dir), "truth", "guess")


@query(_PER_CLASS + " select sum(tp) / sum(support) as accuracy, avg(case when support > 0 then recall end) as balanced_accuracy, avg(precision) as precision, avg(recall) as recall, avg(f1) as f1_macro from f", "accuracy balanced_accuracy precision recall f1_macro")
def metric_classification(spark, sf_dir):  # noqa: ANN001, ANN201
    return metrics.classification(scored(spark, sf_dir), "truth", "guess")


@query(f"""with d as {SCORED_SQL}, r as (select y, s, rank() over (order by s) + (count(*) over (partition by s) - 1) / 2 as r from d),
a as (select (sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) as roc_auc from r),
g as (select s, sum(y) as pos, count(*) as n from d group by 1), w as (select pos, sum(pos) over (order by s desc) as tp, sum(n) over (order by s desc) as m, sum(pos) over () as p from g)
select roc_auc, (select sum(pos / p * tp / m) from w) as average_precision from a""", "roc_auc average_precision")
def metric_ranking(spark, sf_dir):  # noqa: ANN001, ANN201
    return metrics.ranking(scored(spark, sf_dir), "y", "s")


@query(f"select avg(-ln(case when y = 1 then p else 1 - p end)) as log_loss, avg((s - y) * (s - y)) as brier from (select y, s, least(greatest(s, 1e-15), 1 - 1e-15) as p from {SCORED_SQL})", "log_loss brier")
def metric_log_loss(spark, sf_dir):  # noqa: ANN001, ANN201
    return scored(spark, sf_dir).agg(metrics.log_loss(F.col("y"), F.col("s")).alias("log_loss"), metrics.brier(F.col("y"), F.col("s")).alias("brier"))


@query(f"""select sqrt(avg((actual - predicted) ** 2)) as rmse, avg(abs(actual - predicted)) as mae, 1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*)) as r2, avg(abs((actual - predicted) / actual)) as mape,
avg(actual - predicted) as residual_mean, stddev_pop(actual - predicted) as residual_std, quantile_cont(actual - predicted, 0.05) as p05, quantile_cont(actual - predicted, 0.95) as p95 from {SCORED_SQL}""", "rmse mae r2 mape residual_mean residual_std p05 p95")
def metric_regression(spark, sf_dir):  # noqa: ANN001, ANN201
    return metrics.regression(scored(spark, sf_dir), "actual", "predicted")


_BINS = f"""with b as (select y, s, ntile(10) over (order by s, id) as k from {SCORED_SQL}), m as (select k, count(*) as n, avg(s) as m, avg(y) as share from b group by 1),
g as (select *, sum(case when prev = m then 0 else 1 end) over (order by k) as g from (select *, lag(m) over (order by k) as prev from m)),
c as (select (g - 1)::int as bin, sum(n)::bigint as n, sum(m * n) / sum(n) as mean_probability, sum(share * n) / sum(n) as share from g group by g)"""


@query(_BINS + " select * from c", "mean_probability share")
def metric_calibration(spark, sf_dir):  # noqa: ANN001, ANN201
    return metrics.calibration(scored(spark, sf_dir), "y", "s", 10, "id")


@query(_BINS + ", e as (select sum(n * abs(mean_probability - share)) / sum(n) as ece from c) select ece, case when ece <= 0.03 then 'good' when ece <= 0.08 then 'fair' else 'poor' end as verdict from e", "ece")
def metric_calibration_error(spark, sf_dir):  # noqa: ANN001, ANN201
    return metrics.calibration_error(metrics.calibration(scored(spark, sf_dir), "y", "s", 10, "id"))


_MULTI = ("CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y1", "CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS p1", "CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS y2", "CASE WHEN l_tax > 0.03 THEN 1 ELSE 0 END AS p2")


@query("with d as (select " + ", ".join(_MULTI) + """ from lineitem), s as (select sum(y1 * p1) as a1, sum(y1) as t1, sum(p1) as q1, sum(y2 * p2) as a2, sum(y2) as t2, sum(p2) as q2, avg((y1 = p1 and y2 = p2)::int) as exact_match, avg((y1 <> p1)::int + (y2 <> p2)::int) / 2 as hamming from d)
select 2 * (a1 + a2) / (t1 + t2 + q1 + q2) as f1_micro, (2 * a1 / (t1 + q1) + 2 * a2 / (t2 + q2)) / 2 as f1_macro, exact_match, hamming, (a1 + a2) / (q1 + q2) as precision_micro, (a1 + a2) / (t1 + t2) as recall_micro from s""", "f1_micro f1_macro exact_match hamming precision_micro recall_micro")
def metric_multilabel(spark, sf_dir):  # noqa: ANN001, ANN201
    return metrics.multilabel(table(spark, sf_dir, "lineitem").selectExpr(*_MULTI), [("y1", "p1"), ("y2", "p2")])


@query(f"""with d as {SCORED_SQL}, g as (select s, sum(y) as pos, count(*) as n from d group by 1), w as (select s, sum(pos) over o as tp, sum(n) over o as m, sum(pos) over () as p, sum(n) over () as a, row_number() over o as k, count(*) over () as c from g window o as (order by s desc))
select s, tp / p as tpr, (m - tp) / (a - p) as fpr, tp / m as precision from w where k % greatest(1, ceil(c / 150)::int) = 0 or k = c""", "s tpr fpr precision")
def metric_curve(spark, sf_dir):  # noqa: ANN001, ANN201
    return metrics.curve(scored(spark, sf_dir), "y", "s")


@query(f"with d as {SCORED_SQL}, g as (select s, sum(y) as pos, count(*) as n from d group by 1), w as (select s, sum(pos) over (order by s desc) as tp, sum(n) over (order by s desc) as m, sum(pos) over () as p from g) select s as threshold from w order by 2 * tp / (m + p) desc, s desc limit 1", "threshold")
def metric_best_threshold(spark, sf_dir):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(float(train.best_threshold(scored(spark, sf_dir))),)], "threshold double")


# --- drift

def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, sf_dir, "orders").withColumn("month", F.month("o_orderdate"))
    return orders.where(f"o_orderdate < '{SPLIT_DAY}'"), orders.where(f"o_orderdate >= '{SPLIT_DAY}'").withColumn("o_totalprice", F.col("o_totalprice") * 1.1)


_OLD = f"(select *, month(o_orderdate) as month from orders where o_orderdate < '{SPLIT_DAY}')"
_NEW = f"(select * replace (o_totalprice * 1.1 as o_totalprice), month(o_orderdate) as month from orders where o_orderdate >= '{SPLIT_DAY}')"


def _psi_sql(c: str) -> str:
    cut = f"list_distinct(quantile_cont({c}, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))"
    bins = lambda t: f"(select len(list_filter(e, lambda v: v <= {c})) as b, count(*) as n from {t} t, cuts group by 1)"
    return f"""(with cuts as (select {cut} as e from {_OLD} t), k as (select unnest(range(0, len(e) + 1)) as b from cuts),
x as (select k.b, greatest(coalesce(o.n, 0) / sum(coalesce(o.n, 0)) over (), 1e-4) as e, greatest(coalesce(w.n, 0) / sum(coalesce(w.n, 0)) over (), 1e-4) as a from k left join {bins(_OLD)} o using (b) left join {bins(_NEW)} w using (b)),
y as (select e / sum(e) over () as e, a / sum(a) over () as a from x), p as (select sum((a - e) * ln(a / e)) as psi from y),
s as (select avg({c}) as m, min({c}) as lo, max({c}) as hi, 1 - count({c}) / count(*) as miss from {_OLD} t), n as (select avg({c}) as m, 1 - count({c}) / count(*) as miss, avg(({c} < (select lo from s) or {c} > (select hi from s))::int) as outside from {_NEW} t)
select '{c}' as "column", greatest(psi, 0) as psi, outside, (n.m - s.m) / greatest(hi - lo, 1e-12) as shift, s.m as mean_before, n.m as mean_now, s.miss as missing_before, n.miss as missing_now from p, s, n)"""


_DRIFT = f"select *, case when psi > 0.25 or outside > 0.2 then 'major' when psi > 0.1 or outside > 0.05 then 'moderate' else 'stable' end as status from ({_psi_sql('o_totalprice')} union all {_psi_sql('month')})"


@query(_DRIFT, "psi outside shift mean_before mean_now missing_before missing_now")
def drift_numeric(spark, sf_dir):  # noqa: ANN001, ANN201
    old, new = _halves(spark, sf_dir)
    return drift.numeric_drift(old, new, ["o_totalprice", "month"])


@query(f"select case when bool_or(status = 'major') then 'major' when bool_or(status <> 'stable') then 'moderate' else 'stable' end as verdict, count(*) filter (where status <> 'stable') as n_changed from ({_DRIFT})")
def drift_verdict(spark, sf_dir):  # noqa: ANN001, ANN201
    old, new = _halves(spark, sf_dir)
    return drift.verdict(drift.ordered(drift.numeric_drift(old, new, ["o_totalprice", "month"])))


_CATS = ("select o_orderpriority as v from orders where o_orderdate < '1998-01-01'", "select case when o_orderkey % 3 = 0 then '9-NEW' else o_orderpriority end as v from orders where o_orderdate >= '1998-01-01'")


@query(f"""with o as (select v, count(*) / sum(count(*)) over () as e from ({_CATS[0]}) group by 1), w as (select v, count(*) / sum(count(*)) over () as a from ({_CATS[1]}) group by 1),
u as (select coalesce(sum(a), 0) as a from w where v not in (select v from o)),
x as (select greatest(e, 1e-4) as e, greatest(coalesce(a, 0), 1e-4) as a from o left join w using (v) union all select 1e-4, greatest(a, 1e-4) from u),
y as (select e / sum(e) over () as e, a / sum(a) over () as a from x), p as (select sum((a - e) * ln(a / e)) as psi from y)
select 'v' as "column", psi, a as outside, case when psi > 0.25 or a > 0.2 then 'major' when psi > 0.1 or a > 0.05 then 'moderate' else 'stable' end as status from p, u""", "psi outside")
def drift_categories(spark, sf_dir):  # noqa: ANN001, ANN201
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderdate < '1998-01-01'").selectExpr("o_orderpriority as v")
    new = orders.where("o_orderdate >= '1998-01-01'").selectExpr("case when o_orderkey % 3 = 0 then '9-NEW' else o_orderpriority end as v")
    return drift.category_drift(old, new, ["v"])


@query(f"with w as (select v, count(*) / sum(count(*)) over () as share from ({_CATS[1]}) group by 1) select 'v' as \"column\", v as value, share from w where v not in ({_CATS[0]})", "share")
def drift_new_values(spark, sf_dir):  # noqa: ANN001, ANN201
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderdate < '1998-01-01'").selectExpr("o_orderpriority as v")
    new = orders.where("o_orderdate >= '1998-01-01'").selectExpr("case when o_orderkey % 3 = 0 then '9-NEW' else o_orderpriority end as v")
    return drift.new_values(old, new, ["v"])


@query(f"with s as (select min(o_orderdate) as a, max(o_orderdate) as b from {_OLD} t) select 'o_orderdate' as \"column\", avg((o_orderdate < a or o_orderdate > b)::int) as outside, max(o_orderdate) as latest_now from {_NEW} t, s", "outside")
def drift_dates(spark, sf_dir):  # noqa: ANN001, ANN201
    return drift.date_drift(*_halves(spark, sf_dir), "o_orderdate")


# --- series and forecasts

#: All orders; those of three days of each month are put two days later, which leaves gaps to fill.
_MOVED = "case when day(o_orderdate) in (5, 6, 17) then o_orderdate + interval 2 day else o_orderdate end"
_GAPS = f"(select o_orderpriority as g, {_MOVED} as d, o_totalprice as v from orders)"


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderpriority as g", f"{_MOVED} as d", "o_totalprice as v")
    return forecast.series(rows, "d", "v", ["g"], "day")


_SERIES = f"""p as (select g, date_trunc('day', d) as ts, sum(v) as y from {_GAPS} group by 1, 2), b as (select g, min(ts) as lo, max(ts) as hi from p group by 1),
k as (select g, unnest(generate_series(lo::timestamp, hi::timestamp, interval 1 day)) as ts from b),
j as (select k.g, k.ts, row_number() over (partition by k.g order by k.ts) - 1 as t, y from k left join p on k.g = p.g and k.ts = p.ts),
f as (select *, last_value(y ignore nulls) over a as y0, last_value(case when y is not null then t end ignore nulls) over a as t0, first_value(y ignore nulls) over z as y1, first_value(case when y is not null then t end ignore nulls) over z as t1 from j
 window a as (partition by g order by ts rows between unbounded preceding and current row), z as (partition by g order by ts rows between current row and unbounded following)),
s as (select g, ts::timestamp as ts, t, case when y is not null then y when y0 is null then y1 when y1 is null then y0 else y0 + (y1 - y0) * (t - t0) / (t1 - t0) end as y, y is null as filled from f)"""


@query(f"with {_SERIES} select * from s", "y")
def series_regular(spark, sf_dir):  # noqa: ANN001, ANN201
    return _series(spark, sf_dir)


@query("""with d as (select distinct epoch_us(ts) / 86400000000.0 as d from events), g as (select quantile_cont(d - l, 0.5) as days from (select d, lag(d) over (order by d) as l from d) where l is not null)
select days, case when days < sqrt(1 / 24 * 1.0) then 'hour' when days < sqrt(7.0) then 'day' else 'week' end as unit from g""", "days")
def series_frequency(spark, sf_dir):  # noqa: ANN001, ANN201
    return forecast.frequency(table(spark, sf_dir, "events"), "ts")


@query(f"""with {_SERIES} select g, ts, t, y, y - lag(y) over w as diff, lag(y, 1) over w as lag_1, lag(y, 7) over w as lag_7, case when count(y) over (partition by g order by ts rows between 3 preceding and 1 preceding) = 3 then avg(y) over (partition by g order by ts rows between 3 preceding and 1 preceding) end as mean_3,
(isodow(ts) - 1)::int as weekday, month(ts)::int as month, dayofyear(ts)::int as dayofyear from s window w as (partition by g order by ts)""", "y diff lag_1 lag_7 mean_3")
def series_features(spark, sf_dir):  # noqa: ANN001, ANN201
    return forecast.features(_series(spark, sf_dir), ["g"], "day", forecast.Recipe([1, 7], [3], 7))


_NAIVE = f"""{_SERIES}, r as (select *, row_number() over (partition by g order by ts desc) as back from s), l as (select g, y as naive from r where back = 15),
q as (select g, 7 - (back - 14) as place, y as seasonal from r where back > 14 and back <= 21),
n as (select r.g, r.ts, 15 - back as step, y as actual, naive, seasonal from r join l using (g) left join q on q.g = r.g and q.place = (14 - back) % 7 where back <= 14)"""


@query(f"with {_NAIVE} select * from n", "actual naive seasonal")
def forecast_naive(spark, sf_dir):  # noqa: ANN001, ANN201
    return forecast.naive(_series(spark, sf_dir), ["g"], 14, 7).withColumn("step", F.col("step").cast("long"))


@query(f"with {_NAIVE} select g, avg(abs(actual - seasonal)) as mae, sqrt(avg((actual - seasonal) ** 2)) as rmse, avg(seasonal - actual) as bias, avg(abs((actual - seasonal) / nullif(actual, 0))) as mape, avg(abs(actual - naive)) as baseline_mae, avg(abs(actual - seasonal)) / avg(abs(actual - naive)) as vs_baseline from n group by 1", "mae rmse bias mape baseline_mae vs_baseline")
def forecast_errors(spark, sf_dir):  # noqa: ANN001, ANN201
    return forecast.errors(forecast.naive(_series(spark, sf_dir), ["g"], 14, 7), "actual", "seasonal", "naive", ["g"])


@query(f"with {_NAIVE}, e as (select step, sum((actual - naive) ** 2) as s, count(*) as c from n group by 1), pooled as (select step, sqrt(sum(s) over (order by step range between 2 preceding and 2 following) / sum(c) over (order by step range between 2 preceding and 2 following)) as rmse from e) select step, rmse, 1.2816 * max(rmse) over (order by step) as width from pooled", "rmse width")
def forecast_band(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = forecast.naive(_series(spark, sf_dir), ["g"], 14, 7).withColumn("e", F.col("actual") - F.col("naive")).withColumn("step", F.col("step").cast("long"))
    return forecast.step_spread(rows, "step", "e")


@query()
def forecast_next(spark, sf_dir):  # noqa: ANN001, ANN201
    return forecast.forecast(_series(spark, sf_dir), ["g"], "day", 14)


@query(f"with {_SERIES}, a as (select g, avg(y) as a from s group by 1) select g, (isodow(ts) - 1)::int as place, avg(y) as mean, avg(y) / any_value(a) as relative from s join a using (g) group by 1, 2", "mean relative")
def insight_season(spark, sf_dir):  # noqa: ANN001, ANN201
    return forecast.profile(_series(spark, sf_dir), "day", ["g"])


@query(f"with {_SERIES} select g, regr_slope(y, t) as slope, avg(y) as mean, regr_slope(y, t) * (max(t) - min(t)) / abs(avg(y)) as change from s group by 1", "slope mean change")
def insight_trend(spark, sf_dir):  # noqa: ANN001, ANN201
    return forecast.trend(_series(spark, sf_dir), ["g"])


@query(f"with {_SERIES}, x as (select *, (isodow(ts) >= 6)::int as weekend, t % 5 as beat from s) select 'weekend' as input, avg(case when weekend = 1 then y end) / avg(case when weekend = 0 then y end) - 1 as lift, corr(weekend, y) as corr from x union all select 'beat', null, corr(beat, y) from x", "lift corr")
def insight_inputs(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = _series(spark, sf_dir).withColumns({"weekend": (F.weekday("ts") >= 5).cast("int"), "beat": F.col("t") % 5})
    return forecast.input_effects(rows, ["weekend", "beat"])


@query(f"with {_SERIES}, h as (select distinct date_trunc('day', o_orderdate)::date as day from orders where day(o_orderdate) = 25) select g, ts, (ts::date in (select day from h))::int as is_holiday, ((ts::date + 1) in (select day from h))::int as day_before, ((ts::date - 1) in (select day from h))::int as day_after, (select count(*) from h where day > ts::date - 7 and day <= ts::date) as holidays from s")
def holiday_features(spark, sf_dir):  # noqa: ANN001, ANN201
    days = table(spark, sf_dir, "orders").where("day(o_orderdate) = 25").select(F.to_date("o_orderdate").alias("day")).distinct()
    rows = forecast.holidays_within(forecast.holidays(_series(spark, sf_dir).select("g", "ts"), days), days, 7)
    return rows.select("g", "ts", "is_holiday", "day_before", "day_after", "holidays")


@query(f"with {_SERIES}, r as (select g, ts, row_number() over (partition by g order by ts desc) as steps_back from s) select g, ts, steps_back::int as steps_back, case when steps_back <= 42 then floor((steps_back - 1) / 14)::int end as fold from r")
def backtest_folds(spark, sf_dir):  # noqa: ANN001, ANN201
    return splits.backtest_folds(_series(spark, sf_dir).select("g", "ts"), "ts", ["g"], 14, 3)


@query("select event_type, date_trunc('day', ts) as ts, count(*) as n, sum(value) as total, avg(value) as mean from events group by 1, 2", "total mean")
def resample_daily(spark, sf_dir):  # noqa: ANN001, ANN201
    from tabulon.streaming.chunks import resample

    out = resample(table(spark, sf_dir, "events"), "ts", "value", group=["event_type"])
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


# --- anomalies

_ANOM = ("l_quantity", "l_extendedprice", "l_discount")


def _mad_sql(columns: tuple[str, ...], source: str) -> str:
    med = ", ".join(f"quantile_cont({c}, 0.5) as m_{c}, stddev_pop({c}) as s_{c}" for c in columns)
    mad = ", ".join(f"quantile_cont(abs({c} - m_{c}), 0.5) * 1.4826 as d_{c}" for c in columns)
    z = ", ".join(f"abs(({c} - m_{c}) / (case when d_{c} > 1e-9 then d_{c} when s_{c} > 1e-9 then s_{c} else 1 end)) as z_{c}" for c in columns)
    big, square = ", ".join(f"z_{c}" for c in columns), " + ".join(f"z_{c} * z_{c}" for c in columns)
    return f"m as (select {med} from {source}), d as (select {mad} from {source}, m), z as (select t.*, {z} from {source} t, m, d), r as (select *, 0.5 * greatest({big}) + 0.5 * sqrt(({square}) / {len(columns)}) as robust from z)"


@query(f"with {_mad_sql(_ANOM, 'lineitem')} select l_orderkey, l_linenumber, robust from r", "robust")
def anomaly_robust(spark, sf_dir):  # noqa: ANN001, ANN201
    df = table(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", anomaly.robust_distance(list(_ANOM), anomaly.robust_scales(df, list(_ANOM))).alias("robust"))


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "value", "event_type")
    rows = rows.withColumn("robust", F.round(anomaly.robust_distance(["value"], anomaly.robust_scales(rows, ["value"])), 9)).withColumn("size", F.abs("value"))
    return anomaly.ensemble(anomaly.percentile_scores(rows, ["robust", "size"], "event_id"), ["robust", "size"], 0.02)


_FLAG = f"{_mad_sql(('value',), 'events')}, e as (select event_id, event_type, value, round(robust, 9) as robust, abs(value) as size from r), q as (select *, (cume_dist() over (order by robust) + cume_dist() over (order by size)) / 2 as anomaly_score from e)"


@query(f"with {_FLAG} select event_id, anomaly_score, anomaly_score >= (select quantile_cont(anomaly_score, 0.98) from q) as is_anomaly from q", "anomaly_score")
def anomaly_flags(spark, sf_dir):  # noqa: ANN001, ANN201
    return _flagged(spark, sf_dir).select("event_id", "anomaly_score", "is_anomaly")


@query(f"with {_FLAG}, k as (select robust, size, event_type, event_id from q) select avg((event_type = 'purchase')::int) as precision_at_k from (select event_type from k order by robust desc, event_id limit 50)", "precision_at_k")
def anomaly_precision(spark, sf_dir):  # noqa: ANN001, ANN201
    return anomaly.precision_at(_flagged(spark, sf_dir).withColumn("t", F.col("event_type") == "purchase"), "robust", "t", 50, "event_id")


@query(f"with {_FLAG} select count(*) / 50 as overlap from (select event_id from q order by robust desc, event_id limit 50) where event_id in (select event_id from q order by size desc, event_id limit 50)", "overlap")
def anomaly_overlap(spark, sf_dir):  # noqa: ANN001, ANN201
    return anomaly.top_overlap(_flagged(spark, sf_dir), "robust", "size", 50, "event_id")


@query("with c as (select event_type, count(*) / sum(count(*)) over () as p from events group by 1) select event_id, -ln(greatest(p, 1e-6)) / ln(20) as rare_event_type from events join c using (event_type)", "rare_event_type")
def anomaly_rarity(spark, sf_dir):  # noqa: ANN001, ANN201
    return anomaly.rarity(table(spark, sf_dir, "events").select("event_id", "event_type"), ["event_type"]).select("event_id", "rare_event_type")


@query("""with m as (select quantile_cont(value, 0.5) as m, stddev_pop(value) as s from events), d as (select quantile_cont(abs(value - m), 0.5) * 1.4826 as d from events, m),
c as (select event_type, count(*) / sum(count(*)) over () as p from events group by 1),
x as (select event_id, abs((value - m) / (case when d > 1e-9 then d when s > 1e-9 then s else 1 end)) as a, -ln(greatest(p, 1e-6)) / ln(20) as b from events join c using (event_type), m, d)
select event_id, case when greatest(a, b) < 1.5 then 'an unusual combination' when a >= 1.5 and b >= 1.5 then case when b > a then 'event_type; value' when a > b then 'value; event_type' else 'event_type; value' end when a >= 1.5 then 'value' else 'event_type' end as reasons from x""")
def anomaly_reasons(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = anomaly.rarity(table(spark, sf_dir, "events").select("event_id", "value", "event_type"), ["event_type"])
    return anomaly.reasons(rows, ["value"], ["event_type"]).select("event_id", "reasons")


@query()
def anomaly_forest(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return anomaly.isolation_forest(rows, ["c_acctbal", "c_nationkey"], "c_custkey", trees=100).select("c_custkey", "iforest")


@query()
def anomaly_lof(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey")
    return anomaly.local_outlier_factor(rows, ["c_acctbal", "c_nationkey"], "c_custkey")


# --- groups

_GROUPED = "(select c_custkey, c_acctbal, c_nationkey::double as nation, c_mktsegment, case when c_acctbal < 0 then 0 when c_acctbal < 5000 then 1 else 2 end as label from customer)"


def _grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_acctbal", "cast(c_nationkey as double) as nation", "c_mktsegment", "case when c_acctbal < 0 then 0 when c_acctbal < 5000 then 1 else 2 end as label")


@query(f"with s as (select label, row_number() over (order by count(*) desc, label) - 1 as c from {_GROUPED} group by 1) select c_custkey, c::int as cluster from {_GROUPED} join s using (label)")
def cluster_labels(spark, sf_dir):  # noqa: ANN001, ANN201
    return cluster.relabelled(_grouped(spark, sf_dir), "label").select("c_custkey", "cluster")


@query(f"""with d as {_GROUPED}, c as (select label, count(*) as n, avg(c_acctbal) as a, avg(nation) as b from d group by 1), g as (select count(*) as n, avg(c_acctbal) as a, avg(nation) as b from d),
w as (select d.label, sum((c_acctbal - a) ** 2 + (nation - b) ** 2) as w, avg(sqrt((c_acctbal - a) ** 2 + (nation - b) ** 2)) as s from d join c using (label) group by 1),
ch as (select sum(c.n * ((c.a - g.a) ** 2 + (c.b - g.b) ** 2)) / (count(*) - 1) / ((select sum(w) from w) / (any_value(g.n) - count(*))) as calinski_harabasz from c, g),
db as (select avg(r) as davies_bouldin from (select max((wx.s + wy.s) / sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2)) as r from c x join w wx using (label), c y join w wy using (label) where x.label <> y.label group by x.label))
select * from ch, db""", "calinski_harabasz davies_bouldin")
def cluster_separation(spark, sf_dir):  # noqa: ANN001, ANN201
    return cluster.separation(_grouped(spark, sf_dir), "label", ["c_acctbal", "nation"])


@query(f"""with d as {_GROUPED}, p as (select c_custkey, label, c_acctbal as x, nation as y from d order by md5(concat_ws(':', cast(c_custkey as varchar), '42')), c_custkey limit 5000),
m as (select a.c_custkey, a.label, b.label as other, sum(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) as s, count(*) as n from p a, p b group by 1, 2, 3),
o as (select c_custkey, label, s / nullif(n - 1, 0) as a, n from m where other = label), q as (select c_custkey, min(s / n) as b from m where other <> label group by 1),
r as (select label, case when a is null then 0 else (b - a) / greatest(a, b) end as v from o join q using (c_custkey))
select cast(label as varchar) as label, count(*) as n, avg(v) as silhouette from r group by 1""", "silhouette")
def cluster_silhouette(spark, sf_dir):  # noqa: ANN001, ANN201
    return cluster.silhouette(_grouped(spark, sf_dir), "label", ["c_acctbal", "nation"], "c_custkey")


@query(f"""with l as (select cast(label as varchar) as cluster, 'c_acctbal' as "column", c_acctbal as x from {_GROUPED} union all select cast(label as varchar), 'nation', nation from {_GROUPED}),
a as (select "column", avg(x) as m, stddev_samp(x) as s from l group by 1), g as (select cluster, "column", avg(x) as mean from l group by 1, 2 union all select 'all', "column", m from a)
select cluster, "column", mean, (mean - m) / s as z from g join a using ("column")""", "mean z")
def cluster_numeric(spark, sf_dir):  # noqa: ANN001, ANN201
    return cluster.describe_numeric(_grouped(spark, sf_dir), "label", ["c_acctbal", "nation"])


@query(f"""with c as (select cast(label as varchar) as cluster, c_mktsegment as value, count(*) as n from {_GROUPED} group by 1, 2), s as (select *, n / sum(n) over (partition by cluster) as share, row_number() over (partition by cluster order by n desc, value) as k from c),
o as (select value, sum(n) / (select sum(n) from c) as p from c group by 1) select cluster, 'c_mktsegment' as "column", value, share, share / p as lift from s join o using (value) where k = 1""", "share lift")
def cluster_categories(spark, sf_dir):  # noqa: ANN001, ANN201
    return cluster.describe_categories(_grouped(spark, sf_dir), "label", ["c_mktsegment"])


@query()
def cluster_kmeans(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = _grouped(spark, sf_dir)
    vectors = encode.fit_encoding(rows, ["c_acctbal", "nation"], []).vectors(rows, ["c_custkey"])
    return cluster.relabelled(cluster.kmeans(vectors, 3, starts=2).transform(vectors)).select("c_custkey", "cluster")


# --- importance

_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_UNION = " union all ".join(f"select '{c}' as \"column\", {c} as x, l_returnflag as y, l_quantity as q from lineitem" for c in _COLS)


@query(f"""with r as ({_UNION}), p as (select "column", y, count(*) as n, avg(x) as m, var_pop(x) * count(*) as w from r group by 1, 2), a as (select "column", avg(x) as a from r group by 1)
select "column", (sum(n * (m - a) ** 2) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))) as score from p join a using ("column") group by 1""", "score")
def importance_f_test(spark, sf_dir):  # noqa: ANN001, ANN201
    return importance.f_test(table(spark, sf_dir, "lineitem"), list(_COLS), "l_returnflag")


@query(f"""with r as ({_UNION}) select "column", corr(x, q) ** 2 / (1 - corr(x, q) ** 2) * (count(*) - 2) as score from r where "column" <> 'l_quantity' group by 1""", "score")
def importance_f_regression(spark, sf_dir):  # noqa: ANN001, ANN201
    return importance.f_regression(table(spark, sf_dir, "lineitem"), list(_COLS[1:]), "l_quantity")


@query(f"""with r as (select "column", rank() over (partition by "column" order by x) + (count(*) over (partition by "column", x) - 1) / 2 as a, rank() over (partition by "column" order by q) + (count(*) over (partition by "column", q) - 1) / 2 as b from ({_UNION}))
select "column", abs(corr(a, b)) as score from r where "column" in ('l_extendedprice', 'l_tax') group by 1""", "score")
def importance_rank(spark, sf_dir):  # noqa: ANN001, ANN201
    return importance.rank_correlation(table(spark, sf_dir, "lineitem"), ["l_extendedprice", "l_tax"], "l_quantity")


@query(f"""with r as ({_UNION}), b as (select "column", min(x) as lo, max(x) as hi from r group by 1), p as (select "column", y, sum((x - lo) / (hi - lo)) as o, count(*) as n from r join b using ("column") group by 1, 2),
e as (select *, n / sum(n) over (partition by "column") * sum(o) over (partition by "column") as e from p) select "column", sum((o - e) ** 2 / e) as score from e group by 1""", "score")
def importance_chi_square(spark, sf_dir):  # noqa: ANN001, ANN201
    return importance.chi_square(table(spark, sf_dir, "lineitem"), list(_COLS), "l_returnflag")


@query(f"""with r as ({_UNION}) select "column", var_samp(x) / (max(x) - min(x)) ** 2 as score from r group by 1""", "score")
def importance_variance(spark, sf_dir):  # noqa: ANN001, ANN201
    return importance.variance(table(spark, sf_dir, "lineitem"), list(_COLS))


_MI = f"""r as ({_UNION}), c as (select "column", quantile_cont(x, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from r group by 1), b as (select "column", len(list_filter(list_distinct(e), lambda v: v <= x)) as k, y from r join c using ("column")),
j as (select "column", k, y, count(*) as n from b group by 1, 2, 3), p as (select *, sum(n) over (partition by "column") as t, sum(n) over (partition by "column", k) as nx, sum(n) over (partition by "column", y) as ny from j)"""


@query(f"with {_MI} select \"column\", sum(n / t * ln(n * t / (nx * ny))) as score from p group by 1", "score")
def importance_mutual_information(spark, sf_dir):  # noqa: ANN001, ANN201
    return importance.mutual_information(table(spark, sf_dir, "lineitem"), list(_COLS), "l_returnflag")


# votes of three methods on the columns of lineitem
_VOTES = f"""votes as (
  select 'f' as method, "column", sum(n * (m - a) ** 2) / (count(*) - 1) / (sum(w) / (sum(n) - count(*))) as score from (select "column", y, count(*) as n, avg(x) as m, var_pop(x) * count(*) as w from ({_UNION}) group by 1, 2) join (select "column", avg(x) as a from ({_UNION}) group by 1) using ("column") group by 2
  union all
  select 'chi2', "column", sum((o - e) ** 2 / e) from (select *, n / sum(n) over (partition by "column") * sum(o) over (partition by "column") as e from (select "column", y, sum((x - lo) / (hi - lo)) as o, count(*) as n from ({_UNION}) join (select "column", min(x) as lo, max(x) as hi from ({_UNION}) group by 1) using ("column") group by 1, 2)) group by 2
  union all
  select 'variance', "column", var_samp(x) / (max(x) - min(x)) ** 2 from ({_UNION}) group by 2)"""


@query(f"""with {_VOTES}, w as (select * from votes where method <> 'variance'),
r as (select *, rank() over (partition by method order by score desc) as r, score / max(score) over (partition by method) as part from w), o as (select "column", avg(r) as mean_rank, avg((r <= 2)::int) as agreement, avg(part) as score from r group by 1)
select "column", mean_rank, row_number() over (order by mean_rank, "column")::int as consensus_rank, agreement, score from o""", "mean_rank agreement score")
def importance_consensus(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = table(spark, sf_dir, "lineitem")
    found = {"f": importance.f_test(rows, list(_COLS), "l_returnflag"), "chi2": importance.chi_square(rows, list(_COLS), "l_returnflag"), "variance": importance.variance(rows, list(_COLS))}
    votes = None
    for name, part in found.items():
        part = part.select(F.lit(name).alias("method"), "column", "score")
        votes = part if votes is None else votes.unionByName(part)
    return importance.consensus(votes, top=2)


@query()
def importance_forest(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_totalprice", "cast(o_custkey as double) as o_custkey", "case when o_totalprice > 150000 then 1 else 0 end as y")
    found = importance.forest(rows, ["o_totalprice", "o_custkey"], "y", True, trees=10)
    return spark.createDataFrame(list(found.items()), "column string, score double")


@query()
def importance_redundancy(spark, sf_dir):  # noqa: ANN001, ANN201
    _, pairs, vif = importance.redundancy(table(spark, sf_dir, "lineitem"), list(_COLS))
    del pairs
    return spark.createDataFrame(list(vif.items()), "column string, vif double")


# --- training and scoring

@query()
def train_compare(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_acctbal", "c_mktsegment", "c_nationkey", "case when c_acctbal > 4000 then 'rich' else 'poor' end as y")
    fitted = train.train(rows, "y", "c_custkey", ["baseline", "linear", "tree"], k=2)
    return spark.createDataFrame([(r["model"], r["score"]) for r in fitted.leaderboard], "model string, score double")


@query()
def train_predict(spark, sf_dir):  # noqa: ANN001, ANN201
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand", "p_retailprice")
    return train.train(rows, "p_retailprice", "p_partkey", ["baseline", "linear"], k=2).predict(rows, ["p_partkey"])


@query()
def table_fingerprint(spark, sf_dir):  # noqa: ANN001, ANN201
    return spark.createDataFrame([(writers.fingerprint(table(spark, sf_dir, "nation")),)], "fingerprint string")


# --- alignment and sets

@query("select event_type as v, 'events' as side from (select distinct event_type from events) union all select o_orderpriority, 'orders' from (select distinct o_orderpriority from orders)")
def union_all(spark, sf_dir):  # noqa: ANN001, ANN201
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("v")).distinct().withColumn("side", F.lit("events")).unionByName(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("v")).distinct().withColumn("side", F.lit("orders")))


@query("with c as (select o_custkey, sum(o_totalprice) as total from orders group by 1) select c_mktsegment, count(total) as buyers, sum(total) as total, max_by(c_custkey, total) as best from customer left join c on o_custkey = c_custkey group by 1", "total")
def flagship(spark, sf_dir):  # noqa: ANN001, ANN201
    """Totals of each segment's customers: orders are summed before the join, so it moves one row a customer."""
    sums = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("total"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return customers.join(sums, customers["c_custkey"] == sums["o_custkey"], "left").groupBy("c_mktsegment").agg(F.count("total").alias("buyers"), F.sum("total").alias("total"), F.max_by("c_custkey", "total").alias("best"))


@query("select c_custkey, c_nationkey, rank() over (order by n desc)::int as place from (select c_custkey, c_nationkey, count(*) over (partition by c_nationkey) as n from customer)")
def group_order(spark, sf_dir):  # noqa: ANN001, ANN201
    """Groups in order of size, as group-wise models take them: counts first, then a rank over the few groups."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    sizes = rows.groupBy("c_nationkey").agg(F.count("*").alias("n"))
    per = sizes.groupBy("n").agg(F.sum("n").alias("m"))
    place = per.withColumn("place", (F.sum("m").over(Window.orderBy(F.desc("n"))) - F.col("m") + 1).cast("int")).select("n", "place")
    return rows.join(F.broadcast(sizes), "c_nationkey").join(F.broadcast(place), "n").select("c_custkey", "c_nationkey", "place")
