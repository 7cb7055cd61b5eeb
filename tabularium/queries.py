"""One query for each operator, over the driver's tables, and the SQL that DuckDB gives the same rows for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import grouped, language
from .functions import primitives as P
from .functions import text as X
from .models import evaluation, registry, stacking
from .models import metrics as M
from .operators import association as A
from .operators import neighbours, profile, rows
from .plans import describe, history, infer, runs, selection, synthesis
from .sources import readers, writers
from .sources.shared import checkpointed, remove, shared_dir
from .streaming import monitor

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, make: Callable, sql: str | None = None, rounded: str = "", digits: int = 4) -> None:
    """Register a query. The columns in ``rounded`` are rounded on both sides, as sums of doubles depend on their order; a little is
    added first, so that exact ties don't hang on the last bit."""
    columns = rounded.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = make(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        return out.withColumns({c: F.round(F.col(c).cast("double") + F.lit(3.7e-7), digits) + F.lit(0.0) for c in columns}) if columns else out

    QUERIES[name] = run
    if sql:
        SQL[name] = f"select * replace ({', '.join(f'round({c}::double + 3.7e-7::double, {digits}) + 0.0 as {c}' for c in columns)}) from ({sql})" if columns else sql


LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def stack(columns: list[str], table: str, kind: str = "double", extra: str = "") -> str:
    """SQL of an unpivoted table."""
    return " union all ".join(f"select '{c}' as feature, {c}::{kind} as value{extra} from {table}" for c in columns)


# --- profile (A1-A21) ----------------------------------------------------------------------------------------------

add("dataset_profile", lambda t: profile.dataset_profile(t("orders")), """select count(*)::bigint as n_rows, 6::bigint as n_columns, sum((o_orderkey is null)::int + (o_custkey is null)::int + (o_orderstatus is null)::int + (o_totalprice is null)::int + (o_orderdate is null)::int + (o_orderpriority is null)::int)::bigint as missing_cells,
  sum((o_orderkey is null)::int + (o_custkey is null)::int + (o_orderstatus is null)::int + (o_totalprice is null)::int + (o_orderdate is null)::int + (o_orderpriority is null)::int) / (count(*) * 6.0)::double as missing_ratio,
  (select sum(n - 1)::bigint from (select count(*) as n from orders group by all)) as duplicate_rows, 3::bigint as n_numeric, 2::bigint as n_categorical, 1::bigint as n_datetime from orders""".replace("group by all", "group by o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"), "missing_ratio")

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
_PROFILE_SQL = f"""with v as ({stack(CUSTOMER, "customer", "varchar")}), facts as (select feature, count(value) as n_non_null, count(*) as n_rows, count(distinct value) as n_unique from v group by feature),
k as (select * from (values (0, 'c_custkey', 'numeric'), (1, 'c_name', 'string'), (2, 'c_nationkey', 'numeric'), (3, 'c_acctbal', 'numeric'), (4, 'c_mktsegment', 'string')) k(ordinal, feature, kind)),
p as (select *, n_unique::double / n_rows as unique_ratio, case when kind = 'numeric' then 'numeric' when n_unique > 20 and n_unique::double / n_rows > 0.5 then 'text' else 'categorical' end as role from facts join k using (feature))
select ordinal::int as ordinal, feature, kind, role, n_non_null::bigint as n_non_null, (n_rows - n_non_null)::bigint as n_missing, (n_rows - n_non_null)::double / n_rows as missing_rate, n_unique::bigint as n_unique, unique_ratio,
concat_ws(',', case when n_unique <= 1 then 'CONSTANT' end, case when regexp_matches(lower(feature), 'id|uuid|guid') or unique_ratio > 0.9 then 'ID_LIKE' end, case when role = 'categorical' and n_unique > 50 then 'HIGH_CARDINALITY' end) as flags from p"""
add("column_profile", lambda t: profile.column_profile(t("customer")).drop("inferred_type", "recommendations").withColumn("flags", F.array_join("flags", ",")), _PROFILE_SQL, "missing_rate unique_ratio", 6)


def _types_sql(table: str, kinds: dict[str, str]) -> str:
    """SQL of the types and hints of a table's columns, from what they hold."""
    own = ", ".join(f"({i}, '{c}', '{k}')" for i, (c, k) in enumerate(kinds.items()))
    return f"""with v as ({stack(list(kinds), table, "varchar")}), facts as (select feature, count(value) as n_non_null, count(*) as n_rows, count(distinct value) as n_unique, bool_and(lower(value) in ('0', '1', '0.0', '1.0', 'true', 'false')) as two from v group by feature),
k as (select * from (values {own}) k(ordinal, feature, kind)),
p as (select *, n_unique::double / n_rows as unique_ratio, case when kind = 'numeric' and two then 'boolean' when kind = 'string' then case when n_unique > 20 and n_unique::double / n_rows > 0.5 then 'text' else 'categorical' end else kind end as role from facts join k using (feature)),
f as (select *, n_unique <= 1 as constant, regexp_matches(lower(feature), 'id|uuid|guid') or unique_ratio > 0.9 as id_like, role = 'categorical' and n_unique > 50 as high from p)
select feature, role, case when constant then 'constant' when id_like then 'id_like' when role = 'numeric' then 'numeric' when role = 'boolean' then 'bool' when role in ('datetime', 'text') then role when n_unique <= 20 then 'categorical_low' else 'categorical_high' end as inferred_type,
concat_ws(',', case when constant then 'drop_constant_feature' end, case when id_like then 'do_not_use_as_raw_feature' end, case when n_non_null < n_rows then case when role = 'numeric' then 'impute_median' else 'impute_most_frequent_or_category' end end, case when 1 - n_non_null::double / n_rows > 0.3 then 'high_missing_rate' end, case role when 'numeric' then 'candidate_for_scaling' when 'categorical' then case when high then 'use_target_encoding_or_hashing' else 'candidate_for_one_hot' end when 'text' then 'use_text_embeddings,tfidf_or_ngram_features' when 'datetime' then 'extract_datetime_features' when 'boolean' then 'binary_feature' end) as recommendations from f"""


def _holey(t):
    """Orders with gaps and a yes-or-no column."""
    return t("orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority", F.when(F.col("o_orderkey") % 5 > 1, F.col("o_orderstatus")).alias("o_state"), (F.col("o_orderkey") % 2).alias("odd"))


_HOLEY = "(select o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority, case when o_orderkey % 5 > 1 then o_orderstatus end as o_state, o_orderkey % 2 as odd from orders)"
add("profile_types_and_hints", lambda t: profile.column_profile(_holey(t)).select("feature", "role", "inferred_type", F.array_join("recommendations", ",").alias("recommendations")), _types_sql(_HOLEY, {"o_orderkey": "numeric", "o_custkey": "numeric", "o_totalprice": "numeric", "o_orderdate": "datetime", "o_orderpriority": "string", "o_state": "string", "odd": "numeric"}))
add("profile_warnings", lambda t: profile.warnings(profile.column_profile(t("customer"))), f"select feature, unnest(string_split(flags, ',')) as warning from ({_PROFILE_SQL}) where flags <> ''")
add("null_stats", lambda t: rows.null_ratios(t("conversations")), " union all ".join(f"select '{c}' as feature, avg(({c} is null)::int)::double as null_ratio from conversations" for c in ("conv_id", "turn", "role", "text")), "null_ratio")
add("numeric_stats", lambda t: profile.numeric_stats(t("lineitem"), LI), f"""select feature, count(value)::bigint as count, avg(value) as mean, stddev_samp(value) as std, min(value) as min, quantile_cont(value, 0.25) as p25, quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.75) as p75, max(value) as max, skewness(value) as skew, kurtosis(value) as kurtosis from ({stack(LI, "lineitem")}) group by feature""", "mean std min p25 p50 p75 max skew kurtosis", 3)
add("describe_quantiles", lambda t: profile.numeric_stats(t("orders"), ["o_totalprice"], (0.05, 0.25, 0.5, 0.75, 0.95)).select("feature", "p05", "p25", "p50", "p75", "p95", "skew"), "select 'o_totalprice' as feature, quantile_cont(o_totalprice, 0.05) as p05, quantile_cont(o_totalprice, 0.25) as p25, quantile_cont(o_totalprice, 0.5) as p50, quantile_cont(o_totalprice, 0.75) as p75, quantile_cont(o_totalprice, 0.95) as p95, skewness(o_totalprice) as skew from orders", "p05 p25 p50 p75 p95 skew", 2)
add("categorical_stats", lambda t: profile.categorical_stats(t("part"), ["p_brand", "p_type"]), f"""with c as (select feature, value, count(*) as count from ({stack(["p_brand", "p_type"], "part", "varchar")}) where value is not null group by 1, 2), f as (select *, count::double / (select count(*) from part) as freq from c),
s as (select feature, count(*) as n_unique, count(*) filter (freq < 0.01) as n_rare from f group by 1) select feature, rank::bigint as rank, value, count::bigint as count, freq, n_unique::bigint as n_unique, n_rare::bigint as n_rare from (select *, row_number() over (partition by feature order by count desc, value) as rank from f) join s using (feature) where rank <= 10""", "freq", 6)
add("text_stats", lambda t: profile.text_stats(t("conversations"), ["text", "role"]), f"""select feature, avg(length(value)) as avg_chars, min(length(value))::bigint as min_chars, max(length(value))::bigint as max_chars, avg(length(regexp_extract_all(value, '\\S+'))) as avg_tokens from ({stack(["text", "role"], "conversations", "varchar")}) where value is not null group by 1""", "avg_chars avg_tokens")
add("example_values", lambda t: profile.example_values(t("orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey"), f"""select feature, rank::bigint as rank, value from (select feature, value, row_number() over (partition by feature order by min(seen_at), value) as rank from ({stack(["o_orderstatus", "o_orderpriority"], "orders", "varchar", ", o_orderkey as seen_at")}) where value is not null group by feature, value) where rank <= 5""")
_TARGET = """with c as (select {c}::varchar as class, count(*) as n from {t} group by 1), o as (select sum(n) as n_rows, coalesce(sum(n) filter (class is null), 0) as n_missing, count(class) as n_unique, max(n) filter (class is not null) as most, min(n) filter (class is not null) as least from c),
k as (select *, {kind} as problem_type from o) select '{c}' as target, problem_type, n_rows::bigint as n_rows, n_missing::bigint as n_missing, n_unique::bigint as n_unique, case when problem_type <> 'regression' and n_unique >= 2 then most::double / least end as imbalance_ratio, coalesce(case when problem_type <> 'regression' and n_unique >= 2 then most::double / least > 5 end, false) as is_imbalanced,
case when problem_type = 'binary' then (select class from c where class is not null order by n desc, class limit 1) end as positive_class from k"""
_NUMERIC_KIND = "case when n_unique <= 2 then 'binary' when n_unique <= 20 and n_unique::double / n_rows < 0.2 then 'multiclass' else 'regression' end"
_TEXT_KIND = "case when n_unique <= 2 then 'binary' when n_unique <= 20 then 'multiclass' else 'high_cardinality_classification' end"
for _t, _c, _k in (("orders", "o_orderpriority", _TEXT_KIND), ("labels", "toxic", _NUMERIC_KIND), ("orders", "o_totalprice", _NUMERIC_KIND), ("customer", "c_name", _TEXT_KIND)):
    add(f"target_profile_{_c}", lambda t, a=_t, b=_c: profile.target_profile(t(a), b), _TARGET.format(t=_t, c=_c, kind=_k), "imbalance_ratio")
add("targets_profile", lambda t: profile.targets_profile(t("orders"), ["o_orderpriority", "o_totalprice"]), " union all ".join(f"select * from ({_TARGET.format(t='orders', c=c, kind=k)})" for c, k in (("o_orderpriority", _TEXT_KIND), ("o_totalprice", _NUMERIC_KIND))), "imbalance_ratio")
add("target_notes", lambda t: profile.target_notes(t("events").select((F.col("event_id") % 20 == 0).cast("int").alias("rare"), "event_type"), "rare").union(profile.target_notes(t("lineitem").select((F.col("l_linenumber") % 20 == 0).cast("int").alias("never")), "never")), "select 'rare' as target, unnest(['very_dominant_class', 'imbalanced_classes']) as note where (select avg((event_id % 20 <> 0)::int) from events) > 0.9 union all select 'never', unnest(['very_dominant_class', 'constant_target'])")
add("class_counts", lambda t: profile.class_counts(t("orders").withColumn("c", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))), "c", 2), "select o_orderstatus as class, count(*)::bigint as count, count(*)::double / sum(count(*)) over () as proportion from orders where o_orderkey % 3 <> 0 group by 1 order by 2 desc, 1 limit 2", "proportion", 6)
add("skew_hints", lambda t: profile.skew_hints(profile.numeric_stats(t("lineitem").select("l_quantity", F.exp(F.col("l_quantity") / 5).alias("e")), ["l_quantity", "e"])), "select feature, 'consider_non_linear_transform' as recommendation from (select 'l_quantity' as feature, l_quantity as v from lineitem union all select 'e', exp(l_quantity / 5) from lineitem) group by 1 having abs(skewness(v)) > 1")
add("class_distribution", lambda t: profile.class_distribution(t("lineitem"), "l_returnflag"), "select l_returnflag as class, count(*)::bigint as count, count(*)::double / sum(count(*)) over () as proportion from lineitem group by 1 order by 2 desc, 1 limit 30", "proportion", 6)

# --- association (A22-A34) -----------------------------------------------------------------------------------------

add("leakage", lambda t: A.leakage(t("part").withColumn("copy", F.col("p_retailprice") * 2 + F.col("p_size") * 0.001).drop("p_name"), "p_retailprice"), "select feature, r as correlation from (select feature, corr(value, y) as r from (select 'p_partkey' as feature, p_partkey::double as value, p_retailprice as y from part union all select 'p_size', p_size::double, p_retailprice from part union all select 'copy', p_retailprice * 2 + p_size * 0.001, p_retailprice from part) group by 1) where abs(r) >= 0.97", "correlation", 6)
_PREP = f"({stack(LI, 'lineitem', 'double', ', dense_rank() over (order by l_returnflag) - 1 as y')})"


def _prepared(t):
    return A.prepare(t("lineitem"), LI, "l_returnflag")


add("pearson_scores", lambda t: A.pearson_scores(_prepared(t), LI), f"select feature, corr(value, y) as pearson from {_PREP} group by 1", "pearson", 6)
add("spearman_scores", lambda t: A.spearman_scores(_prepared(t), LI), f"select feature, corr(rx, ry) as spearman from (select feature, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2.0 as rx, rank() over (partition by feature order by y) + (count(*) over (partition by feature, y) - 1) / 2.0 as ry from {_PREP}) group by 1", "spearman", 6)
_K = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
add("kendall_scores", lambda t: A.kendall_scores(A.prepare(t("lineitem"), _K, "l_returnflag"), _K), f"""with c as (select feature, value, y, count(*)::double as n from ({stack(_K, 'lineitem', 'double', ', dense_rank() over (order by l_returnflag) - 1 as y')}) group by 1, 2, 3),
s as (select a.feature, sum(a.n * b.n * sign(a.value - b.value) * sign(a.y - b.y)) / 2 as s from c a join c b using (feature) group by 1), x as (select feature, sum(n * (n - 1) / 2) as tx, sum(n) as total from (select feature, value, sum(n) as n from c group by 1, 2) group by 1), z as (select feature, sum(n * (n - 1) / 2) as ty from (select feature, y, sum(n) as n from c group by 1, 2) group by 1)
select feature, s / sqrt((total * (total - 1) / 2 - tx) * (total * (total - 1) / 2 - ty)) as kendall from s join x using (feature) join z using (feature)""", "kendall", 6)
_D = ["l_linenumber", "l_linestatus", "l_shipmonth"]
_JOINT = """with j as (select feature, value, y, count(*)::double as n from (select 'l_linenumber' as feature, l_linenumber::varchar as value, l_returnflag as y from lineitem union all select 'l_linestatus', l_linestatus, l_returnflag from lineitem union all select 'l_shipmonth', month(l_shipdate)::varchar, l_returnflag from lineitem) group by 1, 2, 3),
e as (select *, sum(n) over (partition by feature, value) as nx, sum(n) over (partition by feature, y) as ny, sum(n) over (partition by feature) as total from j)"""
_month = lambda t: t("lineitem").withColumn("l_shipmonth", F.month("l_shipdate"))
add("mutual_information", lambda t: A.mutual_information(_month(t), _D, "l_returnflag"), _JOINT + " select feature, sum(n / total * ln(n * total / (nx * ny))) as mutual_info from e group by 1", "mutual_info", 8)
add("chi_square", lambda t: A.chi_square(_month(t), _D, "l_returnflag"), _JOINT + " select feature, sum(n * n * total / (nx * ny)) - max(total) as chi2, ((count(distinct value) - 1) * (count(distinct y) - 1))::bigint as dof, sqrt(greatest(sum(n * n * total / (nx * ny)) - max(total), 0) / (max(total) * (least(count(distinct value), count(distinct y)) - 1))) as cramers_v from e group by 1", "chi2 cramers_v", 5)
_PHI = "(0.5 + sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 150), lambda k: exp((2 * k + 1) * ln(abs({z})) - lgamma(2 * k + 2) + k * ln(2) + lgamma(k + 1)))))"  # the normal's distribution function by its series
_CHI = "(total * list_sum(list_transform(w, lambda c: pow(list_sum(list_transform(range(1, 601), lambda i: c[i] * pow({r}, i))), 2))))"
add("phi_k", lambda t: A.phi_k(_month(t), _D, "l_returnflag"), "with recursive " + _JOINT.removeprefix("with ") + f""", facts as (select feature, sum(n * n * total / (nx * ny)) - max(total) - (count(distinct value) - 1) * (count(distinct y) - 1) as want, max(total) as total from e group by 1),
lev as (select feature, 0 as axis, value as v, sum(n) as n from j group by all union all select feature, 1, y, sum(n) from j group by all),
pl as (select *, sum(n) over (partition by feature, axis order by coalesce(try_cast(v as double), 0), v) as upto, sum(n) over (partition by feature, axis) as total from lev),
bis as (select distinct feature, axis, upto / total as s, -9.1::double as lo, 9.0::double as hi, 0 as it from pl where upto < total
  union all select feature, axis, s, case when {_PHI.format(z="((lo + hi) / 2)")} < s then (lo + hi) / 2 else lo end, case when {_PHI.format(z="((lo + hi) / 2)")} < s then hi else (lo + hi) / 2 end, it + 1 from bis where it < 55),
her as (select feature, axis, s, lo as z, 1 as k, 0.0::double as before, exp(-lo * lo / 2) / sqrt(2 * pi()) as now from bis where it = 55
  union all select feature, axis, s, z, k + 1, now, (z * now - sqrt(k - 1) * before) / sqrt(k) from her where k < 600),
g as (select feature, axis, s, list(now / sqrt(k) order by k) as g from her group by 1, 2, 3),
f as (select pl.feature, pl.axis, list_transform(range(1, 601), lambda i: (coalesce(a.g[i], 0) - coalesce(b.g[i], 0)) / sqrt(n / total)) as f from pl left join g a on a.feature = pl.feature and a.axis = pl.axis and a.s = (upto - n) / total left join g b on b.feature = pl.feature and b.axis = pl.axis and b.s = upto / total),
w as (select a.feature, list(list_transform(range(1, 601), lambda i: a.f[i] * b.f[i])) as w from f a join f b using (feature) where a.axis = 0 and b.axis = 1 group by 1),
root as (select feature, total, want, w, 0.0::double as lo, 1.0::double as hi, 0 as it from facts join w using (feature)
  union all select feature, total, want, w, case when {_CHI.format(r="((lo + hi) / 2)")} < want then (lo + hi) / 2 else lo end, case when {_CHI.format(r="((lo + hi) / 2)")} < want then hi else (lo + hi) / 2 end, it + 1 from root where it < 40)
select feature, case when want <= 0 then 0 else hi end as phik from root where it = 40""", "phik", 4)
add("mic", lambda t: A.mic(A.prepare(t("lineitem"), LI, "l_returnflag"), LI, "_y"))
_EV = ["event_id", "user_id", "value"]
_EVENTS = f"({stack(_EV, 'events', 'double', ', dense_rank() over (order by event_type) - 1 as y')})"
_SCORES = f"""(select feature, corr(value, y) as p, corr(rx, ry) as s, any_value(m) as m from (select *, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2.0 as rx, rank() over (partition by feature order by y) + (count(*) over (partition by feature, y) - 1) / 2.0 as ry from {_EVENTS})
  left join (select 'user_id' as feature, sum(n / total * ln(n * total / (nx * ny))) as m from (select count(*)::double as n, sum(count(*)) over (partition by user_id) as nx, sum(count(*)) over (partition by event_type) as ny, sum(count(*)) over () as total from events group by user_id, event_type)) using (feature) group by feature)"""


def _scores(t):
    """Scores of the events' columns for their type; mutual information of one of them."""
    data = A.prepare(t("events"), _EV, "event_type")
    found = rows.join_scores([A.pearson_scores(data, _EV), A.spearman_scores(data, _EV)])
    return found.join(A.mutual_information(t("events"), ["user_id"], "event_type"), "feature", "left")


_SHARE = lambda c: f"abs({c}) / (max(abs({c})) over () + 1e-9)"
_PLACE = lambda c: f"coalesce((coalesce({c}, 0) - min(coalesce({c}, 0)) over ()) / nullif(max(coalesce({c}, 0)) over () - min(coalesce({c}, 0)) over (), 0), 0)"
add("combined_score", lambda t: A.combined_score(_scores(t), ["pearson", "spearman", "mutual_info"]), f"select feature, p as pearson, s as spearman, m as mutual_info, ({_SHARE('p')} + {_SHARE('s')} + coalesce({_SHARE('m')}, 0)) / (2 + (m is not null)::int) as combined_score from {_SCORES}", "pearson spearman mutual_info combined_score", 6)
add("top_features", lambda t: A.top_features(_scores(t), 2), f"select feature, w as weighted_score from (select feature, (0.2 * {_PLACE('p')} + 0.2 * {_PLACE('s')} + 0.25 * {_PLACE('m')}) * case when regexp_matches(lower(feature), 'id|code') then 0.1 else 1 end as w from {_SCORES}) order by w desc, feature limit 2", "weighted_score", 6)
add("heat_map", lambda t: A.heat_map(_scores(t)), f"select feature, metric, case metric when 'pearson' then p when 'spearman' then s else m end as value from {_SCORES}, (select unnest(['pearson', 'spearman', 'mutual_info']) as metric)", "value", 6)
add("correlation_matrix", lambda t: A.correlation_matrix(t("lineitem"), LI), " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as correlation from lineitem" for i, a in enumerate(LI) for b in LI[i + 1 :]), "correlation", 6)
add("correlation_strength", lambda t: A.correlation_matrix(t("lineitem"), LI).select("a", "b", A.strength(F.col("correlation")).alias("band")), " union all ".join(f"select '{a}' as a, '{b}' as b, case when abs(corr({a}, {b})) > 0.5 then 'strong' when abs(corr({a}, {b})) > 0.2 then 'moderate' else 'weak' end as band from lineitem" for i, a in enumerate(LI) for b in LI[i + 1 :]))
add("insight_tiers", lambda t: A.insight_tier(profile.column_profile(t("lineitem").select(*LI, "l_returnflag"), ["l_returnflag"]), A.pearson_scores(_prepared(t), LI)).select("feature", "tier"), f"select feature, case when u > 0.9 then 'low' when r >= 0.3 then 'high' when r >= 0.1 then 'medium' else 'medium' end as tier from (select feature, abs(corr(value, y)) as r, count(distinct value)::double / count(*) as u from {_PREP} group by 1)")

def _psi(n: str) -> str:
    """SQL of the digamma function of a whole number."""
    x = f"({n} + 8.0::double)"
    return f"(ln({x}) - 0.5 / {x} - (1 / 12.0 - (1 / 120.0 - (1 / 252.0 - 1 / 240.0 / {x} ** 2) / {x} ** 2) / {x} ** 2) / {x} ** 2 - (" + " + ".join(f"1 / ({n} + {i}.0::double)" for i in range(8)) + "))"


def _plane_sql(rows: str, k: int = 3) -> str:
    """SQL of mutual information by nearest neighbours in the plane, from all pairs of rows of (feature, x, y)."""
    near = lambda c: f"(select count(*) from p b where b.feature = r.feature and case when r.reach > 0 then b.{c} > r.{c} - (r.reach * (1 - 1e-9::double) - abs(r.{c}) * 1e-15::double) and b.{c} < r.{c} + (r.reach * (1 - 1e-9::double) - abs(r.{c}) * 1e-15::double) else b.{c} = r.{c} end)"
    return f"""with p as (select feature, row_number() over () as i, x / stddev_pop(x) over (partition by feature) as x, y / stddev_pop(y) over (partition by feature) as y, count(*) over (partition by feature) as total from ({rows}) where x is not null and y is not null),
    r as (select a.feature, a.i, a.x, a.y, a.total, min(greatest(abs(a.x - b.x), abs(a.y - b.y)), {k})[{k}] as reach, count(*) filter (a.x = b.x and a.y = b.y) + 1 as alike from p a join p b on a.feature = b.feature and a.i <> b.i group by 1, 2, 3, 4, 5),
    n as (select *, {near("x")} as nx, {near("y")} as ny from r)
    select feature, greatest(0, {_psi("max(total)")} + avg({_psi(f"case when reach > 0 then {k} else alike end")} - {_psi("nx")} - {_psi("ny")})) as mutual_info from n group by feature"""


def _spending(t):
    """A row a customer with orders: what they come to."""
    return t("orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean_price"), F.max("o_totalprice").alias("max_price"), F.sum(F.floor(F.col("o_totalprice") / 50000)).cast("double").alias("steps"), F.sum("o_totalprice").alias("spent"))


def _near_sql(rows: str, k: int = 3) -> str:
    """SQL of mutual information by nearest neighbours, from all pairs of distinct values of (feature, value, level)."""
    return f"""with s0 as (select feature, level, value, count(*) as n from ({rows}) group by all), s as (select *, sum(n) over (partition by feature, level) as size from s0 qualify size > 1),
  d as (select a.*, abs(a.value - b.value) as d, sum(b.n) over (partition by a.feature, a.level, a.value order by abs(a.value - b.value)) as have from s a join s b on a.feature = b.feature and a.level = b.level and a.value <> b.value),
  r as (select s.*, case when s.n - 1 >= least({k}, s.size - 1) then 0 else (select min(d.d) from d where d.feature = s.feature and d.level = s.level and d.value = s.value and s.n - 1 + d.have >= least({k}, s.size - 1)) end as r from s),
  m as (select a.feature, a.level, a.value, a.n, a.size, a.r, sum(b.n) as m from r a join s b on a.feature = b.feature and case when a.r > 0 then b.value > a.value - a.r and b.value < a.value + a.r else a.value = b.value end group by all)
  select feature, greatest(0, {_psi("sum(n)")} + sum(n * (case when r > 0 then {_psi(f"least({k}, size - 1)")} else {_psi("n")} end - {_psi("size")} - {_psi("m")})) / sum(n)) as mutual_info from m group by 1"""


_NEAR = ["c_mktsegment", "c_nationkey"]
_SPENDING = "(select o_custkey, avg(o_totalprice) as mean_price, max(o_totalprice) as max_price, sum(floor(o_totalprice / 50000))::double as steps, sum(o_totalprice) as spent from orders group by 1)"
_FLOATS = ["mean_price", "max_price", "steps"]
add("mutual_information_plane", lambda t: neighbours.information(_spending(t), _FLOATS, "spent", [*_FLOATS, "spent"]), _plane_sql(" union all ".join(f"select '{c}' as feature, {c} as x, spent as y from {_SPENDING}" for c in _FLOATS)), "mutual_info", 4)

add("mutual_information_neighbours", lambda t: neighbours.information(t("customer"), ["c_acctbal"], "c_mktsegment", ["c_acctbal"]), _near_sql("select 'c_acctbal' as feature, c_acctbal as value, c_mktsegment as level from customer"), "mutual_info", 8)
add("mutual_information_continuous_target", lambda t: neighbours.information(t("customer"), _NEAR, "c_acctbal", ["c_acctbal"]), _near_sql(" union all ".join(f"select '{c}' as feature, c_acctbal as value, {c}::varchar as level from customer" for c in _NEAR)), "mutual_info", 8)
_ASSOCIATED = ["l_quantity", "l_discount", "l_linenumber", "l_linestatus"]
_MIXED = "select 'l_quantity' as feature, l_quantity as value, least(floor((l_quantity - (select min(l_quantity) from lineitem)) / (select max(l_quantity) - min(l_quantity) from lineitem) * 10), 9) as level, dense_rank() over (order by l_returnflag) - 1 as y from lineitem union all select 'l_discount', l_discount, least(floor((l_discount - (select min(l_discount) from lineitem)) / (select max(l_discount) - min(l_discount) from lineitem) * 10), 9), dense_rank() over (order by l_returnflag) - 1 from lineitem union all select 'l_linenumber', l_linenumber, l_linenumber, dense_rank() over (order by l_returnflag) - 1 from lineitem union all select 'l_linestatus', dense_rank() over (order by l_linestatus) - 1, dense_rank() over (order by l_linestatus) - 1, dense_rank() over (order by l_returnflag) - 1 from lineitem"
add("associate_all", lambda t: runs.associate(t("lineitem").select(*_ASSOCIATED, "l_returnflag"), _ASSOCIATED, "l_returnflag", ("pearson", "spearman", "mutual_info")), f"""with v as ({_MIXED}), r as (select *, rank() over (partition by feature order by value) + (count(*) over (partition by feature, value) - 1) / 2.0 as rx, rank() over (partition by feature order by y) + (count(*) over (partition by feature, y) - 1) / 2.0 as ry from v),
  c as (select feature, corr(value, y) as pearson, corr(rx, ry) as spearman from r group by 1), j as (select feature, level, y, count(*)::double as n from v group by 1, 2, 3), e as (select *, sum(n) over (partition by feature, level) as nx, sum(n) over (partition by feature, y) as ny, sum(n) over (partition by feature) as total from j),
  m as (select feature, sum(n / total * ln(n * total / (nx * ny))) as mutual_info from e where feature in ('l_linenumber', 'l_linestatus') group by 1
    union all select * from ({_near_sql("select feature, value, y as level from v where feature in ('l_quantity', 'l_discount')")}))
  select feature, pearson, spearman, mutual_info, (abs(pearson) / (max(abs(pearson)) over () + 1e-9) + abs(spearman) / (max(abs(spearman)) over () + 1e-9) + abs(mutual_info) / (max(abs(mutual_info)) over () + 1e-9)) / 3 as combined_score from c join m using (feature)""", "pearson spearman mutual_info combined_score", 6)

# --- projections and filters (F1-F14), sources and sinks over them ------------------------------------------------

add("feature_projection", lambda t: t("nation").select(*profile.features_of(t("nation"), ["n_regionkey"])), "select n_nationkey, n_name from nation")
add("drop_columns", lambda t: rows.drop_columns(t("nation"), ["n_name", "absent"]), "select n_nationkey, n_regionkey from nation")
add("unique_columns", lambda t: rows.unique_columns(t("customer").withColumnRenamed("c_nationkey", "n_nationkey"), t("nation"), "n_nationkey"), "select n_name, n_regionkey, n_nationkey from nation")
add("align_columns", lambda t: rows.align(t("nation"), ["n_regionkey", "extra", "n_nationkey"]), "select n_regionkey, 0::int as extra, n_nationkey from nation")
add("null_ratio_filter", lambda t: (lambda d: d.select(*rows.usable_columns(d, 0.5)))(t("orders").withColumn("sparse", F.when(F.col("o_orderkey") % 10 == 0, 1)).withColumn("const", F.lit(1))), "select * from orders")
add("clean_labels", lambda t: X.clean_labels(t("orders").withColumn("label", F.when(F.col("o_orderkey") % 7 == 0, " N/A ").when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit(" "), "o_orderpriority")).otherwise(F.col("o_orderpriority"))), "label", "o_orderkey"), "select trim(o_orderpriority) as label, min(o_orderkey) as at from orders where o_orderkey % 7 <> 0 group by 1")
_LOG = "select event_id as sample_order, case when event_type = 'error' then null else value end as score from events"


def _log(t):
    return t("events").select(F.col("event_id").alias("sample_order"), F.when(F.col("event_type") != "error", F.col("value")).alias("score"))


add("valid_samples", lambda t: rows.valid_samples(_log(t)), f"select * from ({_LOG}) where score is not null")
add("valid_groups", lambda t: profile.valid_groups(t("part"), ["p_brand", "p_type"]), f"select feature, count(*)::bigint as n_groups from (select feature, value, count(*) as c from ({stack(['p_brand', 'p_type'], 'part', 'varchar')}) group by 1, 2 having count(*) >= 5) group by 1 having count(*) >= 2")

# --- joins, groups, dedup (J1-J11, U1-U5, A35-A42) -----------------------------------------------------------------



def _joined_scores(t):
    data = A.prepare(t("lineitem"), [*LI, "l_linenumber"], "l_returnflag")
    return rows.join_scores([A.pearson_scores(data, LI), A.spearman_scores(data, LI), A.kendall_scores(data, _K)])


add("join_scores", _joined_scores, f"select feature, pearson, spearman, kendall from (select feature, corr(value, y) as pearson from {_PREP} group by 1) join ({SQL['spearman_scores'].split(' from (', 1)[1][:-1]}) using (feature) join ({SQL['kendall_scores'].split(' from (', 1)[1][:-1]}) using (feature)", "pearson spearman kendall", 6)
add("parent_features", lambda t: rows.group_feature(t("orders"), "o_custkey", "o_totalprice", F.avg, "mean_price").select("o_orderkey", "mean_price"), "select o_orderkey, avg(o_totalprice) over (partition by o_custkey) as mean_price from orders", "mean_price", 1)
add("parent_features_null_key", lambda t: rows.group_feature(t("orders").withColumn("k", F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey"))), "k", "o_totalprice", F.max, "top").select("o_orderkey", "top"), "select o_orderkey, case when o_custkey % 3 <> 0 then max(o_totalprice) over (partition by o_custkey) end as top from orders")
add("lookup_codes", lambda t: rows.encode(t("orders"), "o_orderpriority", rows.level_codes(t("orders").where("o_orderpriority <> '5-LOW'"), "o_orderpriority"), "code").select("o_orderkey", "code"), "select o_orderkey, coalesce(c, -1)::bigint as code from orders left join (select o_orderpriority, row_number() over (order by o_orderpriority) - 1 as c from (select distinct o_orderpriority from orders where o_orderpriority <> '5-LOW')) using (o_orderpriority)")
add("annotation_upsert", lambda t: rows.upsert_annotations(t("nation").select(F.col("n_name").alias("name"), F.lit(None).cast("string").alias("note")), t("nation").select(F.col("n_name").alias("name"), F.upper("n_name").alias("note"), (F.col("n_nationkey") / 25).alias("confidence")).union(t("region").select("r_name", F.lit("new"), F.lit(None).cast("double")))), "select coalesce(n.n_name, a.name) as name, a.note from nation n full join (select n_name as name, upper(n_name) as note from nation where n_nationkey / 25.0 >= 0.6 union all select r_name, 'new' from region) a on n.n_name = a.name")
add("group_column_candidates", lambda t: rows.group_columns(t("lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_orderkey"]), f"select feature, count(*)::bigint as n_groups, avg(c) as avg_size from (select feature, value, count(*) as c from ({stack(['l_returnflag', 'l_linestatus', 'l_linenumber', 'l_orderkey'], 'lineitem', 'varchar')}) group by 1, 2) group by 1 having count(*) between 2 and 50 and avg(c) >= 5 order by 3 desc, 1 limit 5", "avg_size")
add("union_tables", lambda t: rows.union_tables([t("customer").select("c_name", F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("acctbal")), t("supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("acctbal"), "s_name")]), "select c_name, c_nationkey as nationkey, c_acctbal as acctbal, null::varchar as s_name from customer union all select null, s_nationkey, s_acctbal, s_name from supplier")
add("distinct_first", lambda t: rows.distinct_first(t("orders").select("o_orderstatus", "o_orderpriority", "o_orderkey"), "o_orderkey"), "select o_orderstatus, o_orderpriority, min(o_orderkey) as o_orderkey from orders group by 1, 2")
_SPARSE = "select distinct case when o_orderkey % 3 <> 0 then o_orderstatus end as a, case when o_orderkey % 4 <> 0 then o_orderpriority end as b, case when o_orderkey % 5 = 0 then (o_custkey % 4)::varchar end as c from orders"
add("dominated_rows", lambda t: rows.drop_dominated(t("orders").select(F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus")).alias("a"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderpriority")).otherwise(F.lit(" ")).alias("b"), F.when(F.col("o_orderkey") % 5 == 0, (F.col("o_custkey") % 4).cast("string")).alias("c")), ["a", "b", "c"]), f"with s as ({_SPARSE}) select a, b, c from s x where (a is not null or b is not null or c is not null) and not exists (select 1 from s y where (x.a is null or x.a = y.a) and (x.b is null or x.b = y.b) and (x.c is null or x.c = y.c) and (x.a is distinct from y.a or x.b is distinct from y.b or x.c is distinct from y.c))")
add("group_sizes", lambda t: profile.group_sizes(t("orders"), "o_orderpriority"), "select o_orderpriority, count(*)::bigint as n from orders group by 1")
add("progress", lambda t: rows.progress(_log(t)), f"select count(*)::bigint as total, count(score)::bigint as valid, (count(*) - count(score))::bigint as failed, max(score) as best, (select sample_order from ({_LOG}) where score is not null order by score desc, sample_order limit 1) as best_order, max(sample_order) as last_order, 100.0::double * count(score) / count(*) as success_rate, avg(score) as mean_score, stddev_pop(score) as std_score from ({_LOG})", "success_rate mean_score std_score", 6)
add("score_histogram", lambda t: rows.score_histogram(_log(t)), f"select score, count(*)::bigint as n from ({_LOG}) where score is not null group by 1")
add("running_best", lambda t: rows.running_best(_log(t)), f"select sample_order, score, max(score) over (order by sample_order rows between unbounded preceding and current row) as best_so_far, case when score is null then 0.0::double else score - coalesce(max(score) over (order by sample_order rows between unbounded preceding and 1 preceding), 0) end as delta, coalesce(score is not null and (max(score) over (order by sample_order rows between unbounded preceding and 1 preceding) is null or score > max(score) over (order by sample_order rows between unbounded preceding and 1 preceding)), false) as is_best from ({_LOG})", "delta", 6)

# --- windows, sorts, samples, splits (W1-W9, T1-T12) ---------------------------------------------------------------


def _by_user(primitive):
    def run(t):
        events = t("events").select("event_id", "user_id", "value", F.struct("ts", "event_id").alias("at"))
        return grouped.running_by(events, "user_id", "at", [("x", primitive, "value")]).select("event_id", "x")

    return run


for _n, _f in (("cum_sum", "sum(value) over w"), ("cum_mean", "avg(value) over w"), ("cum_min", "min(value) over w"), ("cum_max", "max(value) over w"), ("diff", "value - lag(value) over (partition by user_id order by ts, event_id)")):
    add(f"primitive_{_n}", _by_user(_n), f"select event_id, {_f} as x from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)", "x", 2)
add("primitive_percentile", lambda t: P.percentile(t("customer"), "c_acctbal", "x").select("c_custkey", "x"), "select c_custkey, (rank() over (order by c_acctbal) + (count(*) over (partition by c_acctbal) - 1) / 2.0) / count(c_acctbal) over () as x from customer", "x", 8)
add("leaderboard_rank", lambda t: rows.leaderboard(t("supplier"), "s_acctbal", "s_suppkey"), "select s_suppkey, row_number() over (order by s_acctbal desc, s_suppkey) as rank from supplier")
add("top_n", lambda t: rows.top_n(t("customer"), "c_acctbal", 10, "c_custkey"), "select * from customer order by c_acctbal desc, c_custkey limit 10")
add("best_row", lambda t: rows.best_row(t("customer"), "c_mktsegment", "c_acctbal", "c_custkey"), "select c_mktsegment, c_custkey from (select *, row_number() over (partition by c_mktsegment order by c_acctbal desc, c_custkey) as r from customer) where r = 1")
add("last_n", lambda t: rows.last_n(_log(t)), f"select * from ({_LOG}) order by sample_order desc limit 15")
add("sample_exact", lambda t: rows.sample_exact(t("orders"), "o_orderkey", 100).select("o_orderkey"), "select o_orderkey from orders order by md5('42:' || o_orderkey), o_orderkey limit 100")
add("split_stratified", lambda t: rows.split(t("orders"), "o_orderkey", "o_orderstatus").select("o_orderkey", "split"), "select o_orderkey, case when row_number() over (partition by o_orderstatus order by md5('42:' || o_orderkey), o_orderkey) <= ceil(count(*) over (partition by o_orderstatus) * 0.2) then 'test' else 'train' end as split from orders")
add("folds_stratified", lambda t: rows.folds(t("orders"), "o_orderkey", 5, "o_orderpriority").select("o_orderkey", "fold"), "select o_orderkey, ((row_number() over (partition by o_orderpriority order by md5('42:' || o_orderkey), o_orderkey) - 1) % 5)::int as fold from orders")
add("folds_plain", lambda t: rows.folds(t("customer"), "c_custkey", 3).select("c_custkey", "fold"), "select c_custkey, ((row_number() over (order by md5('42:' || c_custkey), c_custkey) - 1) % 3)::int as fold from customer")
add("priority_quota", lambda t: selection.quota(t("part").select(F.concat(F.lit("f"), F.col("p_partkey")).alias("feature"), F.col("p_retailprice").alias("importance")), ["f3", "f7", "f11"], 20).select("feature", F.col("rank").cast("long").alias("rank")), "select feature, r as rank from (select 'f' || p_partkey as feature, row_number() over (order by ('f' || p_partkey) in ('f3', 'f7', 'f11') desc, p_retailprice desc, 'f' || p_partkey) as r from part) where r <= 20")

# --- primitives (P1-P42) -------------------------------------------------------------------------------------------

_AGG_SQL = {"count": "count(*)::bigint", "sum": "sum(l_extendedprice)", "mean": "avg(l_extendedprice)", "min": "min(l_extendedprice)", "max": "max(l_extendedprice)", "median": "median(l_extendedprice)", "std": "stddev_samp(l_extendedprice)", "num_unique": "count(distinct l_extendedprice)::bigint", "skew": "case when count(*) > 2 then skewness(l_extendedprice) end"}
add("primitives_aggregate", lambda t: grouped.aggregates(t("lineitem"), "l_suppkey", [(f"x_{n}", n, "l_extendedprice") for n in _AGG_SQL]), f"select l_suppkey, {', '.join(f'{e} as x_{n}' for n, e in _AGG_SQL.items())} from lineitem group by 1", "x_sum x_mean x_min x_max x_median x_std x_skew", 2)
add("primitive_mode", lambda t: grouped.aggregates(t("lineitem"), "l_partkey", [("x", "mode", "l_linenumber")]), "select l_partkey, l_linenumber as x from (select l_partkey, l_linenumber, row_number() over (partition by l_partkey order by count(*) desc, l_linenumber) as r from lineitem group by 1, 2) where r = 1")
add("primitives_boolean", lambda t: t("lineitem").withColumn("b", F.when(F.col("l_linenumber") != 3, F.col("l_quantity") > 25)).groupBy("l_suppkey").agg(P.AGGREGATES["percent_true"].make(F.col("b")).alias("pct"), P.AGGREGATES["num_true"].make(F.col("b")).alias("n")), "select l_suppkey, avg((l_linenumber <> 3 and l_quantity > 25)::int)::double as pct, count(*) filter (l_linenumber <> 3 and l_quantity > 25)::bigint as n from lineitem group by 1", "pct", 6)
add("primitives_time", lambda t: P.time_aggregates(t("orders"), "o_custkey", "o_totalprice", "o_orderdate", "o_orderkey", F.lit("2020-01-01").cast("timestamp_ntz")), "select o_custkey, arg_min(o_totalprice, (o_orderdate, o_orderkey)) as first, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as last, epoch(timestamp '2020-01-01') - epoch(max(o_orderdate)) as time_since_last, epoch(timestamp '2020-01-01') - epoch(min(o_orderdate)) as time_since_first, case when isfinite(regr_slope(o_totalprice, epoch(o_orderdate) / 86400)) then regr_slope(o_totalprice, epoch(o_orderdate) / 86400) end as trend from orders group by 1", "time_since_last time_since_first trend", 3)
add("primitive_entropy", lambda t: P.entropy(t("lineitem"), "l_suppkey", "l_linenumber"), "select l_suppkey, entropy(l_linenumber) * ln(2) as entropy from lineitem group by 1", "entropy", 6)
add("primitive_n_most_common", lambda t: P.n_most_common(t("lineitem"), "l_suppkey", "l_linenumber"), "select l_suppkey, max(l_linenumber) filter (r = 1) as most_common_1, max(l_linenumber) filter (r = 2) as most_common_2, max(l_linenumber) filter (r = 3) as most_common_3 from (select l_suppkey, l_linenumber, row_number() over (partition by l_suppkey order by count(*) desc, l_linenumber) as r from lineitem group by 1, 2) group by 1")
_TIME_SQL = {"year": "year(ts)", "month": "month(ts)", "day": "day(ts)", "weekday": "isodow(ts) - 1", "hour": "hour(ts)", "minute": "minute(ts)", "is_weekend": "isodow(ts) > 5", "week": "week(ts)", "quarter": "quarter(ts)"}
add("primitives_datetime", lambda t: t("events").select("event_id", *[P.TRANSFORMS[n].make(F.col("ts")).alias(f"x_{n}") for n in _TIME_SQL]), "select event_id, " + ", ".join(f"({e})::{'boolean' if n == 'is_weekend' else 'int'} as x_{n}" for n, e in _TIME_SQL.items()) + " from events")
add("primitives_row", lambda t: t("conversations").select("conv_id", "turn", P.TRANSFORMS["num_characters"].make(F.col("text")).alias("chars"), P.TRANSFORMS["num_words"].make(F.col("text")).alias("words"), P.TRANSFORMS["is_null"].make(F.col("text")).alias("missing"), P.TRANSFORMS["not"].make(F.col("turn") > 1).alias("early"), P.TRANSFORMS["negate"].make(F.col("turn")).alias("minus"), P.TRANSFORMS["absolute"].make(-F.col("turn")).alias("plus")), "select conv_id, turn, length(text)::int as chars, length(regexp_extract_all(text, '\\S+'))::int as words, text is null as missing, not (turn > 1) as early, -turn as minus, abs(-turn) as plus from conversations")
add("primitives_latlong", lambda t: t("nation").select("n_nationkey", F.struct((F.col("n_nationkey") * 1.5).alias("lat"), (F.col("n_regionkey") * 2.5).alias("lon")).alias("p")).select("n_nationkey", P.TRANSFORMS["latitude"].make(F.col("p")).alias("lat"), P.TRANSFORMS["longitude"].make(F.col("p")).alias("lon")), "select n_nationkey, n_nationkey * 1.5::double as lat, n_regionkey * 2.5::double as lon from nation", "lat lon")

# --- the feature language (V1-V23) ---------------------------------------------------------------------------------

_PROGRAM = """a = square(l_quantity)
b = logarithm(l_quantity)
c = square_root(l_extendedprice)
d = sigmoid(l_discount)
e = residual(l_quantity / 7)
f = minimum(l_quantity, l_linenumber)
g = maximum(l_quantity, l_linenumber)
h = l_extendedprice / (l_quantity - 1)
i = where(l_tax > 0.05, 1, 0)
j = combine(l_returnflag, l_linestatus)
k = fillna(logarithm(l_tax), 0)
drop l_shipdate"""
add("language_row", lambda t: language.apply(t("lineitem").select("l_orderkey", "l_linenumber", *LI, "l_returnflag", "l_linestatus", "l_shipdate"), _PROGRAM, ("l_orderkey",)), "select l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_quantity * l_quantity as a, case when l_quantity > 0 then ln(l_quantity) end as b, sqrt(l_extendedprice) as c, 1 / (1 + exp(-l_discount)) as d, l_quantity / 7 - floor(l_quantity / 7) as e, least(l_quantity, l_linenumber) as f, greatest(l_quantity, l_linenumber) as g, case when l_quantity <> 1 then l_extendedprice / (l_quantity - 1) end as h, case when l_tax > 0.05 then 1 else 0 end as i, l_returnflag || '_' || l_linestatus as j, coalesce(case when l_tax > 0 then ln(l_tax) end, 0) as k from lineitem", "a b c d e f g h k", 4)
_GROUP_PROGRAM = """a = frequency(p_type)
b = group_min(p_brand, p_retailprice)
c = group_max(p_brand, p_retailprice)
d = group_mean(p_brand, p_retailprice)
e = group_median(p_brand, p_retailprice)
f = group_std(p_brand, p_retailprice)
g = group_rank(p_brand, p_retailprice)
h = group_nunique(p_brand, p_type)
i = combine_frequency(p_brand, p_type)"""
add("language_group", lambda t: language.apply(t("part").drop("p_name"), _GROUP_PROGRAM).select("p_partkey", *"abcdefghi"), "select p_partkey, count(*) over (partition by p_type) / (count(*) over ())::double as a, min(p_retailprice) over w as b, max(p_retailprice) over w as c, avg(p_retailprice) over w as d, median(p_retailprice) over w as e, stddev_samp(p_retailprice) over w as f, rank() over (partition by p_brand order by p_retailprice) + (count(*) over (partition by p_brand, p_retailprice) - 1) / 2.0 as g, (select count(distinct q.p_type) from part q where q.p_brand = part.p_brand)::bigint as h, count(*) over (partition by p_brand, p_type) / (count(*) over ())::double as i from part window w as (partition by p_brand)", "a b c d e f g i", 4)

# --- encoding, imputing, text (E1-E28) -----------------------------------------------------------------------------

add("label_encoder", lambda t: rows.level_codes(t("part"), "p_brand"), "select p_brand as value, row_number() over (order by p_brand) - 1 as code from (select distinct p_brand from part)")
add("train_encoding", lambda t: rows.fit_encode(t("part").where("p_retailprice < 910").select("p_partkey", "p_type", "p_retailprice"), t("part").select("p_partkey", "p_type", "p_retailprice"), ["p_type"])[1], "select p_partkey::double as p_partkey, coalesce(c, -1)::double as p_type, p_retailprice from part left join (select p_type, row_number() over (order by p_type) - 1 as c from (select distinct p_type from part where p_retailprice < 910)) using (p_type)")
add("impute_median", lambda t: rows.impute_median(t("customer").select("c_custkey", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("x")), ["x"]), "select c_custkey, coalesce(case when c_custkey % 4 <> 0 then c_acctbal end, (select median(c_acctbal) from customer where c_custkey % 4 <> 0)) as x from customer", "x", 4)
add("impute_text", lambda t: rows.impute_text(t("orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("x")), ["x"]), "select o_orderkey, case when o_orderkey % 4 <> 0 then o_orderstatus else 'MISSING' end as x from orders")
add("finite_values", lambda t: t("customer").select("c_custkey", rows.finite(F.when(F.col("c_custkey") % 3 == 0, F.lit(float("inf"))).when(F.col("c_custkey") % 3 == 1, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))).alias("x")), "select c_custkey, case when c_custkey % 3 = 2 then c_acctbal end as x from customer")
add("standard_scaling", lambda t: rows.standardize(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]), "select c_custkey, (c_acctbal - (select avg(c_acctbal) from customer)) / (select stddev_pop(c_acctbal) from customer) as c_acctbal from customer", "c_acctbal", 6)
add("numeric_coercion", lambda t: rows.to_numbers(t("events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.col("event_type").alias("none")), ["k", "none"]), "select event_id, try_cast(json_extract_string(props, '$.k') as double) as k, try_cast(event_type as double) as none from events")
add("whitespace", lambda t: t("conversations").select("conv_id", "turn", X.normalize_space(F.col("text")).alias("text")), "select conv_id, turn, regexp_replace(trim(text), '\\s+', ' ', 'g') as text from conversations")
add("json_salvage", lambda t: t("events").select("event_id", F.get_json_object(X.salvage_json(F.concat(F.lit("Here: "), "props", F.lit(" done"))), "$.k").alias("k")), "select event_id, json_extract_string(regexp_extract('Here: ' || props || ' done', '(?s)\\{.*\\}'), '$.k') as k from events")
add("row_text", lambda t: t("nation").select("n_nationkey", X.row_text(["n_name", "n_nationkey"], "n_regionkey").alias("s")), "select n_nationkey, 'If n_name is ' || n_name || ', n_nationkey is ' || n_nationkey || ', Then n_regionkey is ' || n_regionkey || '.' as s from nation")
_SPELLED = ["ROC_AUC", " f1-score", "", "rmse", "acc", "R_Squared"]  # as people write them, by order and priority
add("metric_names", lambda t: t("orders").groupBy(X.metric_name(F.coalesce(F.get(F.array(*map(F.lit, _SPELLED)), (F.col("o_orderkey") % 9).cast("int")), F.col("o_orderpriority"))).alias("m")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first")), f"select case o_orderkey % 9 when 0 then 'auc' when 1 then 'f1' when 2 then 'auto' when 3 then 'rmse' when 4 then 'accuracy' when 5 then 'r2' else lower(trim(o_orderpriority)) end as m, count(*)::bigint as n, min(o_orderkey) as first from orders group by 1")
add("history_truncation", lambda t: X.truncate_history(t("conversations"), last=2), "select conv_id, turn, role, text from (select *, row_number() over (partition by conv_id order by turn) as u, row_number() over (partition by conv_id order by turn desc) as d from conversations) where role = 'system' or u = 1 or d <= 2")
add("inferred_parameters", lambda t: infer.infer(t("nation").select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, "regression").when(F.col("n_nationkey") % 3 == 1, "binary").otherwise("multiclass").alias("problem_type"), (F.col("n_nationkey") % 2 == 0).alias("is_imbalanced"), (F.col("n_nationkey").cast("long") * 4000).alias("n_rows"), (F.col("n_nationkey").cast("long") * 3).alias("n_features"), (F.col("n_nationkey") % 2).cast("long").alias("n_text"), (F.col("n_nationkey") / 30.0).alias("missing_ratio"))).select("n_nationkey", "task", "metric", "feature_format", F.col("max_samples").cast("long").alias("max_samples"), F.col("time_budget").cast("long").alias("time_budget")), """select n_nationkey, case when n_nationkey % 3 = 0 then 'regression' else 'classification' end as task, case when n_nationkey % 3 = 0 then 'rmse' when n_nationkey % 3 = 1 and n_nationkey % 2 <> 0 then 'accuracy' when n_nationkey % 3 = 1 then 'f1' else 'f1_macro' end as metric,
  case when n_nationkey * 3 <= 5 then 'basic' when (case when n_nationkey * 3 > 50 then 0.4 when n_nationkey * 3 > 20 then 0.2 else 0 end) + (case when n_nationkey % 2 > 0 then 0.2 else 0 end) + (case when n_nationkey / 30.0 > 0.3 then 0.2 else 0 end) > 0.5 then 'hierarchical' else 'tags' end as feature_format, case when n_nationkey * 3 <= 10 then 10 when n_nationkey * 3 > 30 then 25 else 15 end::bigint as max_samples, case when n_nationkey * 4000 < 1000 then 60 when n_nationkey * 4000 > 50000 then 300 else 120 end::bigint as time_budget from nation""")

_TEXT_PROGRAM = """a = contains(p_type, 'BRASS')
b = extract(p_brand, 'Brand#(.)')
c = length(p_type)
d = bucket(p_retailprice, 900, 1900, 5)
e = is_null(to_number(p_type))
f = replace(p_size, 7, 70)
g = round(p_retailprice / 3, 1)
h = absolute(p_size - 25)
i = to_integer(p_retailprice)
j = to_text(p_size)"""
add("language_text", lambda t: language.apply(t("part"), _TEXT_PROGRAM).select("p_partkey", *"abcdefghij"), "select p_partkey, contains(p_type, 'BRASS') as a, nullif(regexp_extract(p_brand, 'Brand#(.)', 1), '') as b, length(p_type)::int as c, case when p_retailprice < 900 then 0 when p_retailprice >= 1900 then 6 else floor((p_retailprice - 900) / 200) + 1 end::bigint as d, try_cast(p_type as double) is null as e, case when p_size = 7 then 70 else p_size end::int as f, round_even(p_retailprice / 3, 1) as g, abs(p_size - 25)::int as h, trunc(p_retailprice)::bigint as i, p_size::varchar as j from part", "g", 1)
_DESCRIBED = ["l_quantity", "l_discount", "l_tax"]


def _insights(t):
    return describe.insights(t("lineitem").select(*_DESCRIBED, "l_returnflag"), "l_returnflag")


_LINES = f"(select feature, replace(feature, '_', ' ') as about, min(value) as lo, max(value) as hi, corr(value, y) as r from ({stack(_DESCRIBED, 'lineitem', 'double', ', dense_rank() over (order by l_returnflag) - 1 as y')}) group by 1)"
add("feature_lines_basic", lambda t: describe.lines(_insights(t), "basic").select("line"), f"select '- ' || feature || ': ' || about || ' (numerical variable within range [' || lo::varchar || ', ' || hi::varchar || '])' as line from {_LINES}")
add("feature_lines_tags", lambda t: describe.lines(_insights(t), "tags").select("line"), f"select '- ' || feature || ': ' || about || ' [NUM] ' || case when abs(r) >= 0.3 then '[HIGH_PRED] ' else '' end || printf('[CORR:%.2f] (%.2f to %.2f)', r, lo, hi) as line from {_LINES}")
add("feature_lines_hierarchical", lambda t: describe.lines(_insights(t), "hierarchical").select("section", "line"), f"select case when abs(r) >= 0.3 then 'high' else 'medium' end as section, '- ' || feature || ': ' || about || printf(' [CORR: %.2f] (%.1f-%.1f)', r, lo, hi) as line from {_LINES}")
add("features_by_value", lambda t: describe.high_value(describe.insights(t("part").select("p_partkey", "p_size", (F.col("p_retailprice") + F.col("p_size") * 20).alias("mixed"), "p_retailprice"), "p_retailprice"), 0.3).select("feature"), "select feature from (select feature, corr(value, y) as r from (select 'p_partkey' as feature, p_partkey::double as value, p_retailprice as y from part union all select 'p_size', p_size, p_retailprice from part union all select 'mixed', p_retailprice + p_size * 20, p_retailprice from part) group by 1) where abs(r) >= 0.3")


def _programs(t):
    made = F.concat(F.lit("f"), (F.col("sample_order") % 7).cast("string"), F.lit(" = value * 2  # twice\nvalue = absolute(value)\ndrop c"), (F.col("sample_order") % 5).cast("string"))
    return _log(t).withColumn("function", made)


_PROGRAMS = f"(select *, 'f' || sample_order % 7 as made, 'c' || sample_order % 5 as gone from ({_LOG}))"
add("evolution_history", lambda t: history.evolution(_programs(t), ["value", "c0", "c1"]).drop("sample_time", "evaluate_time", "timestamp"), f"select sample_order, score, case when score is null then 0.0::double else score - coalesce(max(score) over (order by sample_order rows between unbounded preceding and 1 preceding), 0) end as score_delta, coalesce(score is not null and (max(score) over (order by sample_order rows between unbounded preceding and 1 preceding) is null or score > max(score) over (order by sample_order rows between unbounded preceding and 1 preceding)), false) as is_best, 1::int as n_features_created, 1::int as n_features_dropped, made as features_created, gone as features_dropped, score is null as has_error from {_PROGRAMS}", "score score_delta", 6)


def _uneven(t):
    """Programs that create one or two columns, transform one in half of the rows, and drop none, one or two."""
    n = F.col("sample_order")
    lines = F.array_compact(F.array(F.lit("a = value + 1"), F.when(n % 3 == 0, "b = a * a  # twice"), F.when(n % 2 == 0, "value = absolute(value)"), F.when(n % 4 > 0, "drop c0"), F.when(n % 4 == 3, "drop c1")))
    return _log(t).withColumn("function", F.array_join(lines, "\n"))


add("evolution_timeline", lambda t: history.timeline(_uneven(t), ["value", "c0", "c1"]).select("sample_order", "total_features", F.array_join("transformed", ",").alias("transformed"), F.array_join("created", ",").alias("created"), F.array_join("dropped", ",").alias("dropped")), f"select sample_order, (3 + 1 + (sample_order % 3 = 0)::int - (sample_order % 4 > 0)::int - (sample_order % 4 = 3)::int)::int as total_features, case when sample_order % 2 = 0 then 'value' else '' end as transformed, case when sample_order % 3 = 0 then 'a,b' else 'a' end as created, case sample_order % 4 when 0 then '' when 3 then 'c0,c1' else 'c0' end as dropped from ({_LOG})")
add("most_created", lambda t: history.most_changed(_programs(t), ["value"], "created", 3), f"select made as feature, count(*)::bigint as n from {_PROGRAMS} group by 1 order by 2 desc, 1 limit 3")
add("most_dropped", lambda t: history.most_changed(_programs(t), ["value"], "dropped", 3), f"select gone as feature, count(*)::bigint as n from {_PROGRAMS} group by 1 order by 2 desc, 1 limit 3")
add("convergence", lambda t: history.convergence(_log(t)), f"select max(sample_order) as sample_order from (select sample_order, score > coalesce(max(score) over (order by sample_order rows between unbounded preceding and 1 preceding), -1e308) as best from ({_LOG}) where score is not null) where best")

# --- metrics and models (M1-M13, G1-G8) ----------------------------------------------------------------------------


def _predictions(t):
    return t("lineitem").select((F.col("l_linenumber") % 3).alias("label"), (F.col("l_quantity").cast("int") % 3).alias("prediction"))


_PRED = "(select l_linenumber % 3 as label, l_quantity::int % 3 as prediction from lineitem)"
add("confusion_matrix", lambda t: M.confusion(_predictions(t)), f"select label as actual, prediction as predicted, count(*)::bigint as n from {_PRED} group by 1, 2")
add("classification_metrics", lambda t: M.classification(_predictions(t)), f"""with k as (select unnest([0, 1, 2]) as c), s as (select c, count(*) filter (label = c) as w, count(*) filter (prediction = c) as called, count(*) filter (label = c and prediction = c) as tp from {_PRED}, k group by c), m as (select *, tp / called::double as p, tp / w::double as r, 2.0 * tp / (called + w) as f from s)
select sum(tp) / sum(w)::double as accuracy, sum(f * w) / sum(w) as f1, sum(p * w) / sum(w) as precision, sum(r * w) / sum(w) as recall, avg(f) as f1_macro, sum(tp) / sum(w)::double as f1_micro from m""", "accuracy f1 precision recall f1_macro f1_micro", 6)
_BIN = "(select (l_returnflag = 'R')::int as label, l_discount * 5 + l_tax as probability from lineitem)"


def _binary(t):
    return t("lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_discount") * 5 + F.col("l_tax")).alias("probability"))


add("auc", lambda t: M.auc(_binary(t)), f"select (sum(r) filter (label = 1) - n1 * (n1 + 1) / 2.0) / (n1 * n0) as auc from (select label, rank() over (order by probability) + (count(*) over (partition by probability) - 1) / 2.0 as r from {_BIN}), (select sum(label)::double as n1, sum(1 - label)::double as n0 from {_BIN}) group by n1, n0", "auc", 6)
add("logloss", lambda t: M.logloss(_binary(t)), f"select avg(-ln(least(greatest(case when label = 1 then probability else 1 - probability end, 1e-15), 1 - 1e-15))) as logloss from {_BIN}", "logloss", 6)
_SCORES3 = "(select l_orderkey, l_linenumber as line, l_linenumber % 3 as label, [l_discount * 5 + 0.1, l_tax * 3 + 0.1, l_quantity / 100] as p from lineitem)"


def _three(t):
    return t("lineitem").select((F.col("l_linenumber") % 3).alias("label"), F.array(F.col("l_discount") * 5 + 0.1, F.col("l_tax") * 3 + 0.1, F.col("l_quantity") / 100).alias("probabilities"))


add("multiclass_auc", lambda t: M.multiclass_auc(_three(t)), f"select sum(a * n1) / sum(n1) as auc from (select c, n1, (sum(r) filter (hit) - n1 * (n1 + 1) / 2.0) / (n1 * n0) as a from (select *, count(*) filter (hit) over (partition by c)::double as n1, count(*) filter (not hit) over (partition by c)::double as n0 from (select c, label = c as hit, rank() over (partition by c order by p[c + 1]) + (count(*) over (partition by c, p[c + 1]) - 1) / 2.0 as r from {_SCORES3}, (select unnest([0, 1, 2]) as c))) group by c, n1, n0)", "auc", 6)
add("multiclass_logloss", lambda t: M.multiclass_logloss(_three(t)), f"select avg(-ln(least(greatest(p[label + 1] / list_sum(p), 1e-15), 1 - 1e-15))) as logloss from {_SCORES3}", "logloss", 6)
add("regression_metrics", lambda t: M.regression(t("lineitem").select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 1500).alias("prediction"))), "select sqrt(avg((p - y) ** 2)) as rmse, avg((p - y) ** 2) as mse, avg(abs(p - y)) as mae, 1 - avg((p - y) ** 2) / var_pop(y) as r2, avg(abs((p - y) / y)) filter (y <> 0) * 100 as mape from (select l_extendedprice as y, l_quantity * 1500 as p from lineitem)", "rmse mse mae r2 mape", 1)
add("fold_scores", lambda t: M.fold_summary(rows.folds(t("customer"), "c_custkey", 4).groupBy("fold").agg(F.avg("c_acctbal").alias("m")), "m"), "select avg(m) as mean, stddev_pop(m) as std, min(m) as min, max(m) as max, median(m) as median from (select avg(c_acctbal) as m from (select c_acctbal, (row_number() over (order by md5('42:' || c_custkey), c_custkey) - 1) % 4 as fold from customer) group by fold)", "mean std min max median", 3)
_RED = ["l_quantity", "l_extendedprice", "l_discount", "twice"]


def _with_twice(t):
    return t("lineitem").withColumn("twice", F.col("l_quantity") * 2 + F.col("l_tax")).withColumn("_y", (F.col("l_returnflag") == "R").cast("double"))


_PAIRS = " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from s" for i, a in enumerate(_RED) for b in _RED[i + 1 :])
add("redundant_features", lambda t: selection.redundant(A.correlation_matrix(_with_twice(t), _RED), A.pearson_scores(_with_twice(t), _RED), 0.6), f"with s as (select *, l_quantity * 2 + l_tax as twice, (l_returnflag = 'R')::int::double as y from lineitem), p as ({_PAIRS}), t as ({' union all '.join(f'select {chr(39)}{c}{chr(39)} as f, abs(corr({c}, y)) as r from s' for c in _RED)}) select distinct case when tb.r < ta.r then b else a end as feature from p join t ta on p.a = ta.f join t tb on p.b = tb.f where abs(p.r) > 0.6")
add("priority_redundant_features", lambda t: selection.priority_redundant(A.correlation_matrix(_with_twice(t), _RED), ["l_quantity"], 0.6), f"with s as (select *, l_quantity * 2 + l_tax as twice from lineitem), p as ({_PAIRS}) select distinct case when a = 'l_quantity' and b <> 'l_quantity' then b else a end as feature from p where abs(r) > 0.6")


def _model_table(t):
    """All orders as a learning task: a row an order, from all its lines."""
    return t("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("qty"), F.avg("l_discount").alias("disc"), F.count("*").cast("double").alias("n"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("target"))


def _cv(t):
    d = _model_table(t)
    return registry.score_table(d.sparkSession, registry.cross_validate(d, ["qty", "disc", "n"], "target", "l_orderkey", task="classification", models=["decisiontree", "logistic"], k=2))


add("cross_validation", _cv)
add("fold_sizes", lambda t: rows.folds(_model_table(t), "l_orderkey", 3, "target").groupBy("target", "fold").agg(F.count("*").alias("n")), """with d as (select target, count(*) as n from (select l_orderkey, max((l_returnflag = 'R')::int) as target from lineitem group by 1) group by 1) select target::int as target, fold::int as fold, (n // 3 + (fold < n % 3)::int)::bigint as n from d, (select unnest([0, 1, 2]) as fold)""")


def _stack_board(t):
    """What an ensemble over two families is made of: the leaderboard's names, and rows and width of the out-of-fold table by fold and class."""
    d, fitted = _model_table(t), {}
    registry.cross_validate(d, ["qty", "disc", "n"], "target", "l_orderkey", task="classification", models=["decisiontree", "logistic"], k=3, fitted=fitted)
    table = stacking.out_of_fold(registry.folded(d, ["qty", "disc", "n"], "target", "l_orderkey", 3, "target"), fitted, "classification", 2)
    board = stacking.cross_validate(table, "classification", 2)
    return table.groupBy(F.col("label").cast("int").alias("target"), "fold").agg(F.count("*").alias("n"), F.max(F.size(vector_to_array("stacked"))).alias("width")).withColumn("folds", F.lit(len(board.folds)))


add("stacked_out_of_fold", _stack_board, """with d as (select target, count(*) as n from (select l_orderkey, max((l_returnflag = 'R')::int) as target from lineitem group by 1) group by 1) select target::int as target, fold::int as fold, (n // 3 + (fold < n % 3)::int)::bigint as n, 2::int as width, 3::int as folds from d, (select unnest([0, 1, 2]) as fold)""")
add("feature_selection", lambda t: (lambda d: d.sparkSession.createDataFrame([(c,) for c in selection.select_features(d.drop("l_orderkey"), "target").selected], "feature string"))(_model_table(t)))
add("automl_leaderboard", lambda t: (lambda d, r: d.sparkSession.createDataFrame(r.leaderboard, "model string, score double"))(d := _model_table(t), runs.automl(d, "target", "l_orderkey", models=["decisiontree", "logistic"], k=2)))
_OF_TEXT = {"IS_NULL": "{c} is null", "NUM_CHARACTERS": "length({c})::int", "NUM_WORDS": "length(regexp_extract_all({c}, '\\S+'))::int"}
_OF_TIME = {"IS_NULL": "{c} is null"} | {f.upper(): f"{e.replace('ts', '{c}')}{'' if f == 'is_weekend' else '::int'}" for f, e in _TIME_SQL.items() if f != "minute"}
_FEATURES = ", ".join(f'{e.format(c=c)} as "{n}({c})"' for c, made in (("o_orderstatus", _OF_TEXT), ("o_orderdate", _OF_TIME), ("o_orderpriority", _OF_TEXT)) for n, e in made.items())
add("synthesized_features", lambda t: synthesis.synthesize(t("orders").withColumn("target", (F.col("o_totalprice") > 200000).cast("int")).drop("o_totalprice", "o_custkey"), "target", "o_orderkey", synthesis.SynthesisConfig(select=None, max_groups=1)).table, f"""select o_orderkey, o_orderstatus, o_orderdate, o_orderpriority, (o_totalprice > 200000)::int as target, {_FEATURES}, count(*) over (partition by o_orderstatus)::bigint as "o_orderstatus_groups.COUNT(main)" from orders""")
_FE = "select o_orderkey, year(o_orderdate)::int as y, o_orderstatus = 'F' as f from orders"
_STACK = synthesis.SynthesisConfig(max_depth=4, aggregates=("count", "mean", "entropy", "time_since_last", "last", "n_most_common"), transforms=("year", "absolute", "cum_sum", "percentile"), groups=("o_orderpriority",), select=None, time="o_orderdate", asof="2030-01-01")


def _stacked(t):
    made = synthesis.synthesize(t("orders").select("o_orderkey", "o_orderdate", "o_orderpriority", F.floor("o_totalprice").cast("double").alias("o_totalprice"), F.lit(1).alias("target")), "target", "o_orderkey", _STACK).table
    return made.toDF(*[c.lower().replace("o_orderpriority_groups.", "").replace("main.", "").replace("(", "_").replace(")", "").replace("[", "_").replace("]", "") for c in made.columns]).drop("target")


add("synthesized_stack", _stacked, """with f as (select * replace (floor(o_totalprice)::double as o_totalprice), year(o_orderdate)::int as y from orders), g as (select o_orderpriority, count(*) as n, avg(o_totalprice) as m, epoch(timestamp '2030-01-01') - epoch(max(o_orderdate)) as since, arg_max(o_totalprice, (o_orderdate, o_orderkey)) as latest, avg(y) as my, avg(abs(o_totalprice)) as ma from f group by 1)
  select o_orderkey, o_orderdate, o_orderpriority, o_totalprice, y as year_o_orderdate, abs(o_totalprice) as absolute_o_totalprice, sum(o_totalprice) over (order by o_orderkey rows between unbounded preceding and current row) as cum_sum_o_totalprice, (rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2.0) / count(*) over () as percentile_o_totalprice,
  n::bigint as count_main, m as mean_o_totalprice, since as time_since_last_main, latest as last_o_totalprice, n::bigint as absolute_count_main, m as absolute_mean_o_totalprice, abs(since) as absolute_time_since_last_main, my as mean_year_o_orderdate, ma as mean_absolute_o_totalprice, my as absolute_mean_year_o_orderdate, ma as absolute_mean_absolute_o_totalprice from f join g using (o_orderpriority)""", "percentile_o_totalprice mean_o_totalprice absolute_mean_o_totalprice mean_year_o_orderdate mean_absolute_o_totalprice absolute_mean_year_o_orderdate absolute_mean_absolute_o_totalprice", 4)
add("evaluation_detailed", lambda t: (lambda d, r: d.sparkSession.createDataFrame([(m, v["mean"], v["std"]) for m, v in r["models"].items()], "model string, mean double, std double"))(d := _model_table(t), evaluation.evaluate_features_detailed(d, "target", "l_orderkey", metric="accuracy", using="screening")))


def _stored(write, read):
    """Features written below the shared folder and read from there; the folder goes once they are."""

    def run(t):
        table = t("orders").select("o_orderkey", P.TRANSFORMS["year"].make(F.col("o_orderdate")).alias("y"), (F.col("o_orderstatus") == "F").alias("f"))
        spark = table.sparkSession
        folder = shared_dir(spark)
        try:
            return checkpointed(read(spark, write(table, f"{folder}/features")))
        finally:
            remove(spark, folder)

    return run


add("feature_store", _stored(writers.write_features, lambda s, p: s.read.parquet(p)), _FE)
add("feature_csv", _stored(writers.write_csv, lambda s, p: readers.read_csv(s, p, schema="o_orderkey long, y int, f boolean")), _FE)
add("feature_json", _stored(writers.write_json, lambda s, p: s.read.schema("o_orderkey long, y int, f boolean").json(p)), _FE)

# --- events (streaming operators on the finished table) ------------------------------------------------------------

add("event_windows", lambda t: monitor.windowed_counts(t("events")).withColumn("window_start", F.unix_timestamp("window_start")), "select epoch(time_bucket(interval '1 hour', ts))::bigint as window_start, event_type, count(*)::bigint as n, sum(value) as total from events group by 1, 2", "total", 3)
add("event_sessions", lambda t: monitor.sessions(t("events")).withColumn("session_start", F.unix_micros("session_start")), "select user_id, epoch_us(min(ts)) as session_start, count(*)::bigint as n from (select *, sum(new) over (partition by user_id order by ts rows between unbounded preceding and current row) as s from (select *, case when ts < lag(ts) over (partition by user_id order by ts) + interval '30 minutes' then 0 else 1 end as new from events)) group by user_id, s")
add("profile_report", lambda t: runs.profile_dataset(t("customer"), ["c_mktsegment"]).columns.select("feature", "role", "inferred_type", F.array_join("recommendations", ",").alias("recommendations")), _types_sql("customer", {"c_custkey": "numeric", "c_name": "string", "c_nationkey": "numeric", "c_acctbal": "numeric"}))
