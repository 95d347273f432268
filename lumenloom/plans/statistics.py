"""Inference over document-level presence."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenloom.operators import cube, stats
from lumenloom.registry import query
from lumenloom.sources import tables as T

_D = f"WITH {T.SQL_CAPS}, {T.SQL_MENTS}"
_CELLS = f"""{_D}, y AS (SELECT CAST(event_year AS INTEGER) AS year, count(*) AS n FROM caps WHERE event_year IN ('2019', '2023', '2024', '2025') GROUP BY 1),
k AS (SELECT CAST(c.event_year AS INTEGER) AS year, m.aspect, count(DISTINCT m.document_id) AS k FROM ments m JOIN caps c USING (document_id) WHERE c.event_year IN ('2019', '2023', '2024', '2025') AND aspect IS NOT NULL GROUP BY ALL),
cells AS (SELECT a.aspect, y.year, coalesce(k, 0) AS k, n FROM (SELECT DISTINCT aspect FROM ments WHERE aspect IS NOT NULL) a CROSS JOIN y LEFT JOIN k ON k.aspect = a.aspect AND k.year = y.year)"""
_CHI = """, s AS (SELECT *, sum(k) OVER (PARTITION BY aspect)::DOUBLE / sum(n) OVER (PARTITION BY aspect) AS p FROM cells),
chi AS (SELECT aspect, sum(coalesce((k - n * p) ** 2 / nullif(n * p, 0), 0) + coalesce((k - n * p) ** 2 / nullif(n * (1 - p), 0), 0)) AS statistic, CAST(sum(n) AS BIGINT) AS n, min(least(n * p, n * (1 - p))) AS least_expected FROM s GROUP BY 1)"""
YEARS = ("2019", "2023", "2024", "2025")


def cells(spark, d):
    """Documents with an aspect (k) of all documents (n), per year, dense."""
    caps = T.captions(spark, d, "event_year").filter(F.col("event_year").isin(*YEARS)).select("document_id", F.col("event_year").cast("int").alias("year"))
    m = T.mentions(spark, d, "aspect").filter("aspect IS NOT NULL").select("document_id", "aspect")
    n = caps.groupBy("year").agg(F.count("*").alias("n"))
    k = m.join(caps, "document_id").groupBy("aspect", "year").agg(F.countDistinct("document_id").alias("k"))
    grid = cube.dense_grid(m.select("aspect").distinct(), n)
    return grid.join(k, ["aspect", "year"], "left").select("aspect", "year", F.coalesce("k", F.lit(0).cast("bigint")).alias("k"), "n")


@query("wilson_by_year", _CELLS + " SELECT aspect, year, k, n, round(greatest(0, ((k::DOUBLE / n) + 3.841458820694124 / (2 * n) - 1.959963984540054 * sqrt((k::DOUBLE / n) * (1 - k::DOUBLE / n) / n + 3.841458820694124 / (4.0 * n * n))) / (1 + 3.841458820694124 / n)), 9) AS low, round(least(1, ((k::DOUBLE / n) + 3.841458820694124 / (2 * n) + 1.959963984540054 * sqrt((k::DOUBLE / n) * (1 - k::DOUBLE / n) / n + 3.841458820694124 / (4.0 * n * n))) / (1 + 3.841458820694124 / n)), 9) AS high FROM cells")
def wilson_by_year(spark, d):
    """Prevalence per year with its interval."""
    low, high = stats.wilson(F.col("k"), F.col("n"))
    return cells(spark, d).select("aspect", "year", "k", "n", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@query("chi_square_by_aspect", _CELLS + _CHI + " SELECT aspect, round(statistic, 8) AS statistic, n, round(sqrt(statistic / n), 9) AS cramers_v, round(least_expected, 8) AS least_expected, least_expected >= 5 AS adequate FROM chi")
def chi_square_by_aspect(spark, d):
    """Change over the years, tested per aspect."""
    x = stats.chi_square(cells(spark, d), ["aspect"], "year", "k", "n")
    return x.select("aspect", F.round("statistic", 8).alias("statistic"), "n", F.round("cramers_v", 9).alias("cramers_v"), F.round("least_expected", 8).alias("least_expected"), "adequate")


def _tests(spark, d):
    x = stats.chi_square(cells(spark, d), ["aspect"], "year", "k", "n").withColumn("p", stats.chi_square_p("statistic", F.col("df").cast("bigint")))
    return stats.adjust(x.withColumn("family", F.lit("year")), ["family"], "p", ["aspect"])


@query("year_tests")
def year_tests(spark, d):
    """p-values with both corrections and the effect band."""
    return _tests(spark, d).select("aspect", "statistic", "df", "p", "p_bh", "p_holm", "cramers_v", cube.effect_band(F.col("cramers_v")).alias("effect"))


_APPROX = "exp(-0.717 * z - 0.416 * z * z)"


@query("adjusted_values", f"""WITH d AS (SELECT coalesce(nullif(source, ''), 'unknown') AS family, coalesce(nullif(lang, ''), 'unknown') AS id, coalesce(event_year = '2024', FALSE)::INT AS k FROM documents), g AS (SELECT family, id, count(*) AS n, sum(k) AS k FROM d GROUP BY ALL), a AS (SELECT sum(k)::DOUBLE / sum(n) AS p0 FROM g), z AS (SELECT family, id, CASE WHEN n * p0 * (1 - p0) >= 1 THEN abs(k - n * p0) / sqrt(n * p0 * (1 - p0)) END AS z FROM g, a),
t AS (SELECT family, id, round({_APPROX}, 12) AS p FROM z), u AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, id) AS r FROM t WHERE p IS NOT NULL),
v AS (SELECT *, p * m / r AS bh, p * (m - r + 1) AS ho FROM u) SELECT id, family, p, round(least(1, min(bh) OVER (PARTITION BY family ORDER BY p DESC, id DESC ROWS UNBOUNDED PRECEDING)), 10) AS p_bh, round(least(1, max(ho) OVER (PARTITION BY family ORDER BY p, id ROWS UNBOUNDED PRECEDING)), 10) AS p_holm FROM v UNION ALL SELECT id, family, p, NULL, NULL FROM t WHERE p IS NULL""")
def adjusted_values(spark, d):
    """Both corrections over tests of one year's share in each language of each source; languages with few documents are not tested.

    The p-values are those of a common approximation to the normal tail, which SQL can compute as well.
    """
    t = T.read(spark, d, "documents", "source", "lang", "event_year").groupBy(T.filled("source").alias("family"), T.filled("lang").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("event_year") == "2024").alias("k"))
    t = t.crossJoin(F.broadcast(t.agg((F.sum("k") / F.sum("n")).alias("p0"))))  # one row
    var = F.col("n") * F.col("p0") * (1 - F.col("p0"))
    t = t.withColumn("z", F.when(var >= 1, F.abs(F.col("k") - F.col("n") * F.col("p0")) / F.sqrt(var))).select("family", "id", F.round(F.exp(-0.717 * F.col("z") - 0.416 * F.col("z") * F.col("z")), 12).alias("p"))
    return stats.adjust(t, ["family"], "p", ["id"]).select("id", "family", "p", F.round("p_bh", 10).alias("p_bh"), F.round("p_holm", 10).alias("p_holm"))


@query("pairwise_years", _CELLS + """ SELECT a.aspect, a.year AS year_a, b.year AS year_b, round(b.k::DOUBLE / b.n - a.k::DOUBLE / a.n, 9) AS difference, round(b.k::DOUBLE / b.n - a.k::DOUBLE / a.n - 1.959963984540054 * sqrt((b.k::DOUBLE / b.n) * (1 - b.k::DOUBLE / b.n) / b.n + (a.k::DOUBLE / a.n) * (1 - a.k::DOUBLE / a.n) / a.n), 9) AS low, round(b.k::DOUBLE / b.n - a.k::DOUBLE / a.n + 1.959963984540054 * sqrt((b.k::DOUBLE / b.n) * (1 - b.k::DOUBLE / b.n) / b.n + (a.k::DOUBLE / a.n) * (1 - a.k::DOUBLE / a.n) / a.n), 9) AS high, round(((b.k + 0.5::DOUBLE) * (a.n - a.k + 0.5::DOUBLE)) / ((b.n - b.k + 0.5::DOUBLE) * (a.k + 0.5::DOUBLE)), 8) AS odds_ratio FROM cells a JOIN cells b ON a.aspect = b.aspect AND a.year < b.year""")
def pairwise_years(spark, d):
    """Contrasts of every pair of years: a self join of aspects x years cells."""
    c = cells(spark, d)
    a = c.select("aspect", F.col("year").alias("year_a"), F.col("k").alias("k0"), F.col("n").alias("n0"))
    b = c.select("aspect", F.col("year").alias("year_b"), "k", "n")
    diff, low, high = stats.difference(F.col("k"), F.col("n"), F.col("k0"), F.col("n0"))
    return a.join(b, "aspect").filter("year_a < year_b").select("aspect", "year_a", "year_b", F.round(diff, 9).alias("difference"), F.round(low, 9).alias("low"), F.round(high, 9).alias("high"), F.round(stats.odds_ratio(F.col("k"), F.col("n"), F.col("k0"), F.col("n0")), 8).alias("odds_ratio"))


@query("logit_years", _CELLS + """ SELECT b.aspect, b.year, CASE WHEN a.k > 0 AND a.k < a.n AND b.k > 0 AND b.k < b.n THEN round(ln(b.k::DOUBLE / (b.n - b.k)) - ln(a.k::DOUBLE / (a.n - a.k)), 9) END AS beta, CASE WHEN a.k > 0 AND a.k < a.n AND b.k > 0 AND b.k < b.n THEN round(sqrt(1.0::DOUBLE / b.k + 1.0::DOUBLE / (b.n - b.k) + 1.0::DOUBLE / a.k + 1.0::DOUBLE / (a.n - a.k)), 9) END AS se FROM cells b JOIN cells a ON a.aspect = b.aspect AND a.year = 2019 WHERE b.year <> 2019""")
def logit_years(spark, d):
    """Log odds of each year against the first, closed form."""
    c = cells(spark, d)
    base = c.filter("year = 2019").select("aspect", F.col("k").alias("k0"), F.col("n").alias("n0"))
    k, n, k0, n0 = (F.col(x).cast("double") for x in ("k", "n", "k0", "n0"))
    beta, se = stats.logit_contrast(F.nullif(k, F.lit(0.0)), n, F.nullif(k0, F.lit(0.0)), n0)
    return c.filter("year <> 2019").join(F.broadcast(base), "aspect").select("aspect", "year", F.round(beta, 9).alias("beta"), F.round(se, 9).alias("se"))


@query("stable_aspects", _CELLS + " SELECT aspect, min(k) AS least_documents, CAST(sum(k) AS BIGINT) AS documents FROM cells GROUP BY 1 HAVING min(k) >= 5 AND sum(k) >= 50")
def stable_aspects(spark, d):
    """Aspects that may be tested: enough documents in all and in every year, fixed before any test."""
    return cells(spark, d).groupBy("aspect").agg(F.min("k").alias("least_documents"), F.sum("k").alias("documents")).filter("least_documents >= 5 AND documents >= 50")


@query("pairwise_after_omnibus")
def pairwise_after_omnibus(spark, d):
    """Contrasts of years only for aspects whose test over all years is significant after correction."""
    good = _tests(spark, d).filter("p_bh < 0.05").select("aspect")
    return pairwise_years(spark, d).join(F.broadcast(good), "aspect", "left_semi")


@query("emphasis")
def emphasis(spark, d):
    """Aspects worth emphasis: tested by a rule fixed before, significant, with at least a small effect and enough support."""
    may = stable_aspects(spark, d).select("aspect", F.lit(True).alias("eligible"))
    sup = cells(spark, d).groupBy("aspect").agg(F.sum("k").alias("documents"))
    t = _tests(spark, d).select("aspect", "p_bh", "cramers_v").join(sup, "aspect").join(F.broadcast(may), "aspect", "left")
    ok = F.coalesce("eligible", F.lit(False)) & F.coalesce(F.col("p_bh") < 0.05, F.lit(False)) & (F.col("cramers_v") >= 0.1) & (F.col("documents") >= 100)
    return t.select("aspect", F.coalesce("eligible", F.lit(False)).alias("eligible"), "p_bh", "cramers_v", "documents", ok.alias("emphasis"))
