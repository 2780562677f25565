"""Distributions, plot data and the rolling average."""

from __future__ import annotations

from pyspark.sql import functions as F

import sparkprofile as sp
from sparkprofile.functions.normal import INV_A, INV_B, INV_C, INV_D, INV_E, INV_F

from .base import SPARSE_COLUMNS, SPARSE_SQL, long_sql, query, rounded

EVENT_NUMBERS = ["event_id", "user_id", "value"]
# Three shapes: right-skewed events.value, discrete user ids, uniform prices.
SHAPES = f"long AS ({long_sql('events', ['user_id', 'value'])} UNION ALL {long_sql('lineitem', ['l_quantity', 'l_extendedprice'])})"


def shapes(operator, t, **options):
    parts = operator(t.events, ["user_id", "value"], **options)
    return parts.unionByName(operator(t.lineitem, ["l_quantity", "l_extendedprice"], **options))


MOMENTS = """
means AS (SELECT "column", avg(x) AS m FROM long GROUP BY "column"),
s AS (SELECT "column", count(x) AS n, avg(x) AS mean, stddev_pop(x) AS sd_pop, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi,
             CASE WHEN count(x) < 3 OR stddev_pop(x) = 0 THEN 0.0 ELSE avg(pow(x - m, 3)) / pow(stddev_pop(x), 3) END AS g1,
             CASE WHEN count(x) < 4 OR stddev_pop(x) = 0 THEN 0.0 ELSE avg(pow(x - m, 4)) / pow(stddev_pop(x), 4) - 3 END AS g2
      FROM long JOIN means USING ("column") GROUP BY "column")"""


@query(
    "moments_pop",
    f"""WITH {SHAPES}, {MOMENTS} SELECT "column", round(g1, 6) AS skewness, round(g2, 6) AS kurtosis FROM s""",
)
def moments_pop(t):
    return rounded(shapes(sp.moments_pop, t))


@query(
    "quartiles",
    f"""WITH {SHAPES}
SELECT "column", min(x) AS min, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS median,
       round(quantile_cont(x, 0.75), 6) AS q75, max(x) AS max,
       round(quantile_cont(x, 0.75) - quantile_cont(x, 0.25), 6) AS iqr FROM long GROUP BY "column" """,
)
def quartiles(t):
    return rounded(shapes(sp.quartiles, t))


def histogram_sql(long: str, bins: int = 30) -> str:
    return f"""
WITH {long},
e AS (SELECT "column", CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS a,
             CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS b FROM long GROUP BY "column"),
g AS (SELECT "column", a, b, (b - a) / {bins}.0::DOUBLE AS step, i FROM e, range({bins}) r(i)),
k AS (SELECT "column", i, step, i * step + a AS lower, CASE WHEN i = {bins - 1} THEN b ELSE (i + 1) * step + a END AS upper FROM g),
f AS (SELECT "column", x, count(*) AS c FROM long GROUP BY "column", x)
SELECT k."column", CAST(i AS INTEGER) AS bin, round(lower, 6) AS lower, round(upper, 6) AS upper,
       round((lower + upper) / 2, 6) AS center, round(step, 6) AS width, CAST(coalesce(sum(c), 0) AS BIGINT) AS count
FROM k LEFT JOIN f ON f."column" = k."column" AND x >= lower AND (x < upper OR (i = {bins - 1} AND x <= upper))
GROUP BY k."column", i, lower, upper, step"""


@query("histogram", histogram_sql(SHAPES))
def histogram(t):
    return rounded(shapes(sp.histogram, t))


@query(
    "histogram_markers",
    f"""WITH {SHAPES}
SELECT "column", count(x) AS total_count, CAST(0 AS BIGINT) AS non_finite_count, round(avg(x), 7) AS mean,
       round(quantile_cont(x, 0.5), 6) AS median FROM long GROUP BY "column" """,
)
def histogram_markers(t):
    return rounded(shapes(sp.histogram_markers, t), mean=7)


# The normal distribution in SQL: series near zero, continued fraction in the tail.
def tail_sql(z: str) -> str:
    """P(Z > z) for z >= 0."""
    series = f"{z} * list_reduce(list_transform(range(141, 1, -2), lambda k: k::DOUBLE), lambda acc, k: 1 + {z} * {z} / k * acc, 1.0::DOUBLE)"
    fraction = f"list_reduce(list_transform(range(160, 0, -1), lambda k: k::DOUBLE), lambda acc, k: {z} + k / acc, {z} + 1.0::DOUBLE)"
    density = f"exp(-0.5 * {z} * {z}) / sqrt(2 * pi())"
    return f"CASE WHEN {z} < 2.5 THEN 0.5 - {density} * ({series}) ELSE {density} / ({fraction}) END"


RANKED = f"""
f AS (SELECT "column", x, count(*) AS c FROM long GROUP BY "column", x),
r AS (SELECT "column", x, c, sum(c) OVER (PARTITION BY "column" ORDER BY x) AS up FROM f)"""
SCORED = """
z AS (SELECT "column", n, mean, sd_pop, sd, c, x, up, up - c AS low, (x - mean) / {sd} AS z, abs((x - mean) / {sd}) AS a
      FROM r JOIN s USING ("column")),
t AS (SELECT *, """ + tail_sql("a") + """ AS q FROM z)"""
# The distribution of sqrt(n) D up to the term in n^(-3/2); below 3e-14 from 4 on.
KS_P = """
root AS (SELECT *, sqrt(n) * d AS y FROM gap),
series AS (SELECT *, y * y AS v,
    (SELECT {'e0': sum(e), 'e1': sum(a * e), 'e2': sum(a * a * e), 'e3': sum(a * a * a * e)}
     FROM (SELECT a, exp(-a / (2 * y * y)) AS e FROM (SELECT pow(pi() * (k + 0.5), 2) AS a FROM range(-16, 16) t(k)))) AS h,
    (SELECT {'e1': sum(a * e), 'e2': sum(a * a * e)}
     FROM (SELECT a, exp(-a / (2 * y * y)) AS e FROM (SELECT pow(pi() * k, 2) AS a FROM range(-16, 17) t(k)))) AS w FROM root),
p AS (SELECT *, CASE WHEN y >= 4 THEN 0 WHEN y < 0.04 THEN 1 ELSE least(1, greatest(0, 1 - sqrt(pi() / 2) * (
        h.e0 / y + (h.e1 - v * h.e0) / (6 * pow(y, 4) * sqrt(n))
        + (((6 * pow(v, 3) + 2 * v * v) * h.e0 + (2 * v * v - 5 * v) * h.e1 + (1 - 2 * v) * h.e2) / (72 * pow(y, 7)) - w.e1 / (36 * pow(y, 3))) / n
        + (((5 - 30 * v) * h.e3 + (212 * v * v - 60 * v) * h.e2 + (135 * v * v - 96 * pow(v, 3)) * h.e1 - (30 * pow(v, 3) + 90 * pow(v, 4)) * h.e0)
           / (6480 * pow(y, 10)) + (3 * v * w.e1 - w.e2) / (216 * pow(y, 6))) / pow(n, 1.5)))) END AS p FROM series)"""


@query(
    "ks_normal",
    f"""
WITH {SHAPES}, {MOMENTS}, {RANKED}, {SCORED.format(sd="sd_pop")},
gap AS (SELECT "column", n, max(greatest(up / n - CASE WHEN z > 0 THEN 1 - q ELSE q END,
                                         CASE WHEN z > 0 THEN 1 - q ELSE q END - low / n)) AS d FROM t GROUP BY "column", n), {KS_P}
SELECT "column", round(d, 6) AS statistic, round(p, 6) AS p_value, p > 0.05 AS is_normal FROM p""",
)
def ks_normal(t):
    return rounded(shapes(sp.ks_normal, t))


@query(
    "anderson_darling",
    f"""
WITH {SHAPES}, {MOMENTS}, {RANKED}, {SCORED.format(sd="sd")},
l AS (SELECT "column", n, up * up - low * low AS odd, 2 * n * c AS twice,
             CASE WHEN z > 0 THEN ln(1 - q) ELSE ln(q) END AS lower, CASE WHEN z > 0 THEN ln(q) ELSE ln(1 - q) END AS upper FROM t),
a AS (SELECT "column", n, -n - sum(odd * lower + (twice - odd) * upper) / n AS a2 FROM l GROUP BY "column", n)
SELECT "column", round(a2, 4) AS statistic, round(0.752 / (1 + 0.75 / n + 2.25 / (n::DOUBLE * n)), 6) AS critical_value,
       a2 < 0.752 / (1 + 0.75 / n + 2.25 / (n::DOUBLE * n)) AS is_normal FROM a""",
)
def anderson_darling(t):
    return rounded(shapes(sp.anderson_darling, t), statistic=4)


DAGOSTINO = """
d1 AS (SELECT *, n::DOUBLE AS k FROM s),
d2 AS (SELECT *, g1 * sqrt((k + 1) * (k + 3) / (6 * (k - 2))) AS y,
              3 * (k * k + 27 * k - 70) * (k + 1) * (k + 3) / ((k - 2) * (k + 5) * (k + 7) * (k + 9)) AS b2,
              (g2 + 3 - 3 * (k - 1) / (k + 1)) / sqrt(24 * k * (k - 2) * (k - 3) / ((k + 1) * (k + 1) * (k + 3) * (k + 5))) AS x,
              6 * (k * k - 5 * k + 2) / ((k + 7) * (k + 9)) * sqrt(6 * (k + 3) * (k + 5) / (k * (k - 2) * (k - 3))) AS rb FROM d1),
d3 AS (SELECT *, sqrt(2 * (b2 - 1)) - 1 AS w2, 6 + 8 / rb * (2 / rb + sqrt(1 + 4 / (rb * rb))) AS a FROM d2),
d4 AS (SELECT *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, 1 + x * sqrt(2 / (a - 4)) AS den FROM d3),
d5 AS (SELECT *, (1 - 2 / (9 * a) - sign(den) * pow((1 - 2 / a) / abs(den), 1.0 / 3)) / sqrt(2 / (9 * a)) AS z2 FROM d4),
dp AS (SELECT "column", n, z1 * z1 + z2 * z2 AS k2 FROM d5)"""


@query(
    "dagostino_pearson",
    f"""
WITH {SHAPES}, {MOMENTS}, {DAGOSTINO}
SELECT "column", round(k2, 4) AS statistic, round(exp(-k2 / 2), 6) AS p_value, exp(-k2 / 2) > 0.05 AS is_normal FROM dp""",
)
def dagostino_pearson(t):
    return rounded(shapes(sp.dagostino_pearson, t), statistic=4)


def horner_sql(coefficients: tuple[float, ...], x: str) -> str:
    text = repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        text = f"({text} * {x} + {c!r})"
    return text


def quantile_sql(p: str) -> str:
    """Standard normal quantile of the column ``p`` (AS 241)."""
    near, far = f"(0.180625 - ({p} - 0.5) * ({p} - 0.5))", f"sqrt(-ln(least({p}, 1 - {p})))"
    centre = f"({p} - 0.5) * {horner_sql(INV_A, near)} / {horner_sql(INV_B, near)}"
    shoulder = f"{horner_sql(INV_C, f'({far} - 1.6)')} / {horner_sql(INV_D, f'({far} - 1.6)')}"
    tail = f"{horner_sql(INV_E, f'({far} - 5)')} / {horner_sql(INV_F, f'({far} - 5)')}"
    return (
        f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN {centre} "
        f"ELSE sign({p} - 0.5) * CASE WHEN {far} <= 5 THEN {shoulder} ELSE {tail} END END"
    )


@query(
    "shapiro_wilk",
    f"""
WITH long AS ({long_sql("customer", ["c_custkey", "c_nationkey", "c_acctbal"])}
     UNION ALL {long_sql("nation", ["n_nationkey", "n_regionkey"])} UNION ALL {long_sql("orders", ["o_totalprice", "o_custkey"])}),
u AS (SELECT "column", x, row_number() OVER (PARTITION BY "column" ORDER BY x) AS i, (count(*) OVER (PARTITION BY "column"))::DOUBLE AS n FROM long),
p AS (SELECT *, (i - 0.375::DOUBLE) / (n + 0.25::DOUBLE) AS p FROM u WHERE n >= 12),
m AS (SELECT *, {quantile_sql("p")} AS m FROM p),
g AS (SELECT "column", n, 1 / sqrt(n) AS u, sum(m * m) AS mm, sum(m * x) AS mx, -min(m) FILTER (i = 1) AS t1, -min(m) FILTER (i = 2) AS t2,
             min(x) FILTER (i = 1) AS x1, min(x) FILTER (i = 2) AS x2, min(x) FILTER (i = n - 1) AS xm, min(x) FILTER (i = n) AS xn,
             n * var_pop(x) AS ssq FROM m GROUP BY "column", n),
a AS (SELECT *, t1 / sqrt(mm) + {horner_sql((0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056), "u")} AS a1,
             t2 / sqrt(mm) + {horner_sql((0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633), "u")} AS a2 FROM g),
w AS (SELECT *, (mm - 2 * t1 * t1 - 2 * t2 * t2) / (1 - 2 * a1 * a1 - 2 * a2 * a2) AS phi, ln(n) AS l FROM a),
v AS (SELECT *, pow(a1 * (xn - x1) + a2 * (xm - x2) + (mx - t1 * (xn - x1) - t2 * (xm - x2)) / sqrt(phi), 2) / ssq AS w FROM w),
z AS (SELECT *, (ln(1 - w) - {horner_sql((-1.5861, -0.31082, -0.083751, 0.0038915), "l")})
                / exp({horner_sql((-0.4803, -0.082676, 0.0030302), "l")}) AS z FROM v),
q AS (SELECT *, abs(z) AS a FROM z),
e AS (SELECT *, CASE WHEN z > 0 THEN {tail_sql("a")} ELSE 1 - ({tail_sql("a")}) END AS pv FROM q)
SELECT "column", round(w, 6) AS statistic, round(pv, 6) AS p_value, pv > 0.05 AS is_normal, n > 5000 AS extrapolated FROM e""",
)
def shapiro_wilk(t):
    return rounded(
        sp.shapiro_wilk(t.customer).unionByName(sp.shapiro_wilk(t.nation)).unionByName(sp.shapiro_wilk(t.orders, ["o_totalprice", "o_custkey"]))
    )


@query("normality_vote")
def normality_vote(t):
    return sp.normality_vote(t.events).unionByName(sp.normality_vote(t.supplier)).unionByName(sp.normality_vote(t.nation))


TYPES = f"""
t AS (SELECT "column", n, g1, g2, mean, sd_pop, lo, u FROM s JOIN (SELECT "column", count(DISTINCT x) AS u FROM long GROUP BY "column") USING ("column")),
k AS (SELECT *, CASE WHEN n < 10 THEN 'unknown' WHEN abs(g1) < 0.5 AND abs(g2) < 0.5 THEN 'approximately_normal'
  WHEN g1 > 1 THEN 'right_skewed' WHEN g1 < -1 THEN 'left_skewed' WHEN g2 > 3 THEN 'heavy_tailed' WHEN g2 < -1 THEN 'light_tailed'
  WHEN u < 10 THEN 'discrete' WHEN (CASE WHEN mean = 0 THEN 0 ELSE sd_pop / mean END) < 0.1 THEN 'uniform'
  WHEN lo >= 0 AND g1 > 0.5 THEN 'exponential' ELSE 'unknown' END AS distribution_type FROM t)"""
EVENT_LONG = f"long AS ({long_sql('events', EVENT_NUMBERS)})"


@query(
    "distribution_type",
    f"""WITH {SHAPES}, {MOMENTS}, {TYPES} SELECT "column", distribution_type FROM k""",
)
def distribution_type(t):
    return shapes(sp.distribution_type, t)


@query(
    "analyze_distributions",
    f"""
WITH {SHAPES}, {MOMENTS}, {TYPES},
q AS (SELECT "column", quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q75,
             min(x) AS min, max(x) AS max FROM long GROUP BY "column")
SELECT "column", n AS count, distribution_type, round(g1, 6) AS skewness, round(g2, 6) AS kurtosis, min, round(q25, 6) AS q25,
       round(median, 6) AS median, round(q75, 6) AS q75, max, round(q75 - q25, 6) AS iqr, n > 10 AS kde_available
FROM k JOIN q USING ("column")""",
)
def analyze_distributions(t):
    out = shapes(sp.analyze_distributions, t)
    return rounded(
        out.select(
            "column", "count", "distribution_type", "skewness", "kurtosis", "min", "q25", "median", "q75", "max", "iqr",
            "kde_available",
        )
    )


@query(
    "distribution_summary",
    f"""
WITH {EVENT_LONG}, {MOMENTS}
SELECT count(*) AS total_numeric_columns, '' AS normal_columns,
       coalesce(string_agg("column", ',' ORDER BY "column") FILTER (abs(g1) > 1), '') AS skewed_columns,
       coalesce(string_agg("column", ',' ORDER BY "column") FILTER (g2 > 3), '') AS heavy_tailed_columns FROM s""",
)
def distribution_summary(t):
    out = sp.distribution_summary(t.events)
    return out.withColumns({c: F.array_join(c, ",") for c in ("normal_columns", "skewed_columns", "heavy_tailed_columns")})


KDE_SQL = f"""
WITH long AS ({long_sql("events", ["user_id", "value"])}), {MOMENTS},
f AS (SELECT "column", x, count(*) AS c FROM long GROUP BY "column", x),
g AS (SELECT "column", i, n, sd * pow(n, -0.2) AS h, lo - 0.1 * (hi - lo) + i * ((hi - lo) * 1.2 / 99) AS gx FROM s, range(100) r(i))
SELECT "column", CAST(i AS INTEGER) AS point, round(gx, 6) AS x,
       round(sum(c * exp(-0.5 * pow((gx - x) / h, 2))) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 8) AS density
FROM g JOIN f USING ("column") GROUP BY "column", i, gx"""


@query("kde", KDE_SQL)
def kde(t):
    return rounded(sp.kde(t.events, ["user_id", "value"]), density=8)


def fit_sql(name: str, location: str, scale: str, cdf: str) -> str:
    return f"""
SELECT "column", '{name}' AS distribution, location, scale, max(greatest(up / n - {cdf}, {cdf} - (up - c) / n)) AS d, n
FROM (SELECT *, {location} AS location, {scale} AS scale FROM r JOIN s USING ("column")) GROUP BY "column", location, scale, n"""


@query(
    "fit_distribution",
    f"""
WITH {SHAPES}, {MOMENTS}, {RANKED},
gap AS ({fit_sql("expon", "lo", "mean - lo", "(1 - exp(-(x - location) / scale))")}
        UNION ALL {fit_sql("uniform", "lo", "hi - lo", "((x - location) / scale)")}), {KS_P}
SELECT "column", distribution, round(location, 6) AS location, round(scale, 6) AS scale, round(d, 6) AS ks_statistic,
       round(p, 6) AS ks_p_value, CASE WHEN p > 0.05 THEN 'good' ELSE 'poor' END AS goodness_of_fit FROM p""",
)
def fit_distribution(t):
    out = shapes(sp.fit_distribution, t, name="expon").unionByName(shapes(sp.fit_distribution, t, name="uniform"))
    return rounded(out.drop("shape"))


@query(
    "fit_normal",
    f"""
WITH {SHAPES}, {MOMENTS}, {RANKED}, {SCORED.format(sd="sd_pop")},
gap AS (SELECT "column", n, mean, sd_pop, max(greatest(up / n - CASE WHEN z > 0 THEN 1 - q ELSE q END,
                                         CASE WHEN z > 0 THEN 1 - q ELSE q END - low / n)) AS d FROM t GROUP BY ALL), {KS_P}
SELECT "column", round(mean, 6) AS location, round(sd_pop, 6) AS scale, round(d, 6) AS ks_statistic, round(p, 6) AS ks_p_value FROM p""",
)
def fit_normal(t):
    out = shapes(sp.fit_distribution, t, name="norm")
    return rounded(out.select("column", "location", "scale", "ks_statistic", "ks_p_value"))


@query("fit_gamma")
def fit_gamma(t):
    return sp.fit_distribution(t.events, ["value"], name="gamma")


# --- plot data ---------------------------------------------------------------------------------


@query(
    "box_stats",
    f"""
WITH {SHAPES},
q AS (SELECT "column", quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q75 FROM long GROUP BY "column"),
j AS (SELECT *, x BETWEEN q25 - 1.5 * (q75 - q25) AND q75 + 1.5 * (q75 - q25) AS inside FROM long JOIN q USING ("column"))
SELECT "column", round(any_value(q25), 6) AS q25, round(any_value(median), 6) AS median, round(any_value(q75), 6) AS q75,
       round(avg(x), 7) AS mean, min(x) FILTER (inside) AS whisker_low, max(x) FILTER (inside) AS whisker_high,
       count(*) FILTER (NOT inside) AS flier_count FROM j GROUP BY "column" """,
)
def box_stats(t):
    return rounded(shapes(sp.box_stats, t), mean=7)


QQ = f"""
WITH u AS (SELECT value AS sample, row_number() OVER (ORDER BY value) AS i, (count(*) OVER ())::DOUBLE AS n FROM events),
p AS (SELECT *, CASE WHEN i = n THEN pow(0.5::DOUBLE, 1 / n) WHEN i = 1 THEN 1 - pow(0.5::DOUBLE, 1 / n)
                     ELSE (i - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END AS p FROM u),
q AS (SELECT i AS position, {quantile_sql("p")} AS theoretical, sample FROM p)"""


@query("qq_points", f"{QQ} SELECT position, round(theoretical, 6) AS theoretical, sample FROM q")
def qq_points(t):
    return rounded(sp.qq_points(t.events, "value"))


@query(
    "qq_line",
    f"""{QQ} SELECT round(regr_slope(sample, theoretical), 6) AS slope, round(regr_intercept(sample, theoretical), 6) AS intercept,
                    round(corr(sample, theoretical), 6) AS r FROM q""",
)
def qq_line(t):
    return rounded(sp.qq_line(sp.qq_points(t.events, "value")))


LINE_DRAW = "md5('42|' || l_orderkey || '|' || l_linenumber || '|' || l_partkey), l_orderkey, l_linenumber, l_partkey"


@query(
    "scatter_points",
    f"""SELECT l_quantity AS x, l_extendedprice AS y, l_returnflag AS hue
FROM (SELECT * FROM lineitem ORDER BY {LINE_DRAW} LIMIT 100000)""",
)
def scatter_points(t):
    return sp.scatter_points(t.lineitem, "l_quantity", "l_extendedprice", "l_returnflag", keys=["l_orderkey", "l_linenumber", "l_partkey"])


@query(
    "linear_fit",
    """
SELECT round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 6) AS intercept,
       round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, CAST(regr_count(l_extendedprice, l_quantity) AS BIGINT) AS n FROM lineitem""",
)
def linear_fit(t):
    return rounded(sp.linear_fit(t.lineitem, "l_quantity", "l_extendedprice"))


@query(
    "pair_grid",
    f"""SELECT l_quantity, l_extendedprice, l_discount, l_returnflag
FROM (SELECT * FROM lineitem ORDER BY {LINE_DRAW} LIMIT 5000)""",
)
def pair_grid(t):
    return sp.pair_grid(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"], "l_returnflag", keys=["l_orderkey", "l_linenumber", "l_partkey"])


@query(
    "categorical_bar",
    """
WITH f AS (SELECT p_brand AS value, count(*) AS count FROM part GROUP BY p_brand),
r AS (SELECT *, row_number() OVER (ORDER BY count DESC, value) AS rank, sum(count) OVER () AS total FROM f)
SELECT CAST(rank AS INTEGER) AS rank, value, count, round(100.0 * count / total, 6) AS percentage FROM r WHERE rank <= 20""",
)
def categorical_bar(t):
    return rounded(sp.categorical_bar(t.part, "p_brand"))


@query(
    "missing_heatmap",
    f"""
WITH s AS ({SPARSE_SQL}), d AS (SELECT * FROM s ORDER BY md5('42|' || event_id), event_id LIMIT 500)
SELECT {", ".join(f"{c} IS NULL AS {c}" for c in SPARSE_COLUMNS)} FROM d""",
)
def missing_heatmap(t):
    return sp.missing_heatmap(t.sparse, keys=["event_id"])


@query(
    "violin_stats",
    f"""
WITH {SHAPES}, d AS (SELECT "column", count(x) AS n FROM long GROUP BY "column")
SELECT "column", round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.5), 6) AS median,
       round(quantile_cont(x, 0.75), 6) AS q75, 100 AS points FROM long GROUP BY "column" """,
)
def violin_stats(t):
    def both(df, names):
        parts = sp.violin_stats(df, names)
        points = parts["density"].groupBy("column").agg(F.count(F.lit(1)).cast("int").alias("points"))
        return parts["quartiles"].select("column", "q25", "median", "q75").join(F.broadcast(points), "column")

    out = both(t.events, ["user_id", "value"]).unionByName(both(t.lineitem, ["l_quantity", "l_extendedprice"]))
    return rounded(out)


def rolling_sql(source: str, key: str) -> str:
    frame = f"OVER (ORDER BY ts, {key} ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)"
    return f"""
WITH s AS ({source})
SELECT {key}, ts, value, CASE WHEN count(value) {frame} = 30 THEN round(avg(value) {frame}, 6) END AS rolling FROM s"""


@query("rolling_average", rolling_sql("SELECT * FROM events", "event_id"))
def rolling_average(t):
    return rounded(sp.rolling_average(t.events, "ts", "value", tie=["event_id"]))


@query(
    "rolling_average_nulls",
    rolling_sql(
        "SELECT event_id, ts, CASE WHEN event_id % 40 = 0 THEN NULL ELSE value END AS value FROM events", "event_id"
    ),
)
def rolling_average_nulls(t):
    holes = t.events.withColumn("value", F.when(F.col("event_id") % 40 != 0, F.col("value")))
    return rounded(sp.rolling_average(holes, "ts", "value", tie=["event_id"], chunk_rows=1000))


@query("rolling_average_small_chunks", rolling_sql("SELECT * FROM events", "event_id"))
def rolling_average_small_chunks(t):
    """The window is longer than a chunk."""
    return rounded(sp.rolling_average(t.events, "ts", "value", tie=["event_id"], window=30, chunk_rows=10))
