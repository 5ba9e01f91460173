"""Scoring, comparison and interval queries on the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cluemill.operators import geometry, ordering, scoring
from cluemill.session import table

WEIGHTS = {"price": 0.5, "size": 0.3, "odd": 0.2}
CUTS = ((-0.5, "gentle"), (0.5, "steady"))


def _parts(spark, sf_dir):
    odd = F.when(F.col("p_partkey") % 7 != 0, (F.col("p_partkey") % 10).cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"), odd.alias("odd"))


def zscore_bands(spark, sf_dir):
    """Parts scored on three measures, one of which a seventh lacks."""
    rows = _parts(spark, sf_dir)
    scored = scoring.weighted_z(rows, scoring.baseline(rows, list(WEIGHTS)), WEIGHTS)
    return scored.select("p_partkey", F.round("score", 6).alias("score"), scoring.band(F.col("score"), CUTS, "tough").alias("band"))


def baseline_stats(spark, sf_dir):
    base = scoring.baseline(_parts(spark, sf_dir), list(WEIGHTS))
    return base.select(*[F.round(c, 6).alias(c) for c in base.columns])


def percentile_rank(spark, sf_dir):
    return scoring.percentile(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", "percentile")


def spearman(spark, sf_dir):
    return scoring.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")


def group_best_of(spark, sf_dir):
    """Per supplier: mean quantity of returned items against the best mean of the other flags; a win if no less."""
    means = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_quantity").alias("m"))
    rows = means.groupBy("l_suppkey").agg(F.max(F.when(F.col("l_returnflag") == "R", F.col("m"))).alias("ours"), F.max(F.when(F.col("l_returnflag") != "R", F.col("m"))).alias("best"))
    return rows.where("ours IS NOT NULL AND best IS NOT NULL").select("l_suppkey", F.round("ours", 6).alias("ours"), F.round("best", 6).alias("best"), (F.col("ours") >= F.col("best")).alias("win"))


def axis_unpivot(spark, sf_dir):
    """Mean of each measure by line status, and their gap."""
    rows = table(spark, sf_dir, "lineitem").unpivot(["l_linestatus"], ["l_quantity", "l_discount", "l_tax"], "axis", "v")
    means = rows.groupBy("axis").agg(F.avg(F.when(F.col("l_linestatus") == "O", F.col("v"))).alias("o"), F.avg(F.when(F.col("l_linestatus") == "F", F.col("v"))).alias("f"))
    return means.select("axis", F.round("o", 6).alias("open_mean"), F.round("f", 6).alias("final_mean"), F.round(F.col("o") - F.col("f"), 6).alias("gap"))


def cond_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_shipdate").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_discount") >= 0.05).alias("reduced"), F.count_if((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 25)).alias("kept_large"))


def dim_default(spark, sf_dir):
    """Customers by nation name; nations of the first region only are known, the others take the default."""
    nation = table(spark, sf_dir, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return table(spark, sf_dir, "customer").join(F.broadcast(nation), "c_nationkey", "left").groupBy(F.coalesce("n_name", F.lit("elsewhere")).alias("nation")).agg(F.count(F.lit(1)).alias("n"))


def anti_both_ways(spark, sf_dir):
    """Customers without an order in 1995, and orders of that year without a customer."""
    year = table(spark, sf_dir, "orders").where(F.year("o_orderdate") == 1995).select(F.col("o_custkey").alias("c_custkey")).distinct()
    customers = table(spark, sf_dir, "customer").select("c_custkey")
    return customers.join(year, "c_custkey", "left_anti").withColumn("side", F.lit("no order")).unionByName(year.join(customers, "c_custkey", "left_anti").withColumn("side", F.lit("no customer")))


def span_depth(spark, sf_dir):
    """Per part the most shipments whose three-day spans overlap, by a sweep over starts and ends instead of pairs."""
    day = F.datediff("l_shipdate", F.lit("1990-01-01"))
    steps = table(spark, sf_dir, "lineitem").select("l_partkey", F.explode(F.array(F.struct(day.alias("d"), F.lit(1).alias("s")), F.struct((day + 3).alias("d"), F.lit(-1).alias("s")))).alias("x")).groupBy("l_partkey", F.col("x.d").alias("d")).agg(F.sum("x.s").alias("s"))
    running = F.sum("s").over(Window.partitionBy("l_partkey").orderBy("d"))
    return steps.withColumn("depth", running).groupBy("l_partkey").agg(F.max("depth").alias("depth"))


def day_runs(spark, sf_dir):
    """Longest run of days in a row with an order, per priority."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", F.datediff("o_orderdate", F.lit("1990-01-01")).alias("d"), F.lit(True).alias("hit")).distinct()
    return geometry.longest_runs(rows, ["o_orderpriority"], "d", "hit")


def min_median_max(spark, sf_dir):
    """Least, upper median and greatest price, and a histogram of width 200."""
    rows = table(spark, sf_dir, "part").withColumn("bin", F.floor(F.col("p_retailprice") / 200))
    middle = ordering.value_quantiles(rows, ["bin"], "p_retailprice", (50,)).select("bin", F.col("value").alias("middle"))
    return rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("p_retailprice").alias("least"), F.max("p_retailprice").alias("most")).join(middle, "bin")


def best_tuple(spark, sf_dir):
    """Per brand the part with the greatest (size, price, key)."""
    rows = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.max(F.struct("p_size", "p_retailprice", "p_partkey")).alias("m"))
    return rows.select("p_brand", F.col("m.p_partkey").alias("p_partkey"), F.col("m.p_size").alias("p_size"))


NAMES = """zscore_bands baseline_stats percentile_rank spearman group_best_of axis_unpivot cond_counts dim_default anti_both_ways span_depth
day_runs min_median_max best_tuple""".split()
QUERIES = {name: globals()[name] for name in NAMES}

_P = "p AS (SELECT p_partkey, p_retailprice AS price, CAST(p_size AS DOUBLE) AS size, CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_partkey % 10 AS DOUBLE) END AS odd FROM part)"
_STATS = ", ".join(f"avg({c}) AS {c}_mean, coalesce(stddev_samp({c}), 0) AS {c}_sd" for c in WEIGHTS)
_Z = " + ".join(f"coalesce(({c} - {c}_mean) / {c}_sd * {w}, 0)" for c, w in WEIGHTS.items())
_W = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w} END" for c, w in WEIGHTS.items())
_RANK = "rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"
SQL = {
    "zscore_bands": f"WITH {_P}, b AS (SELECT {_STATS} FROM p), s AS (SELECT p_partkey, ({_Z}) / ({_W}) AS s FROM p, b) SELECT p_partkey, round(s, 6) AS score, CASE WHEN s < -0.5 THEN 'gentle' WHEN s < 0.5 THEN 'steady' ELSE 'tough' END AS band FROM s",
    "baseline_stats": f"WITH {_P}, b AS (SELECT {_STATS} FROM p) SELECT " + ", ".join(f"round({c}_{k}, 6) AS {c}_{k}" for c in WEIGHTS for k in ("mean", "sd")) + " FROM b",
    "percentile_rank": "SELECT c_custkey, CAST(round_even(100 * percent_rank() OVER (ORDER BY c_acctbal), 0) AS INTEGER) AS percentile FROM customer",
    "spearman": f"WITH r AS (SELECT {_RANK.format('l_quantity')} AS a, {_RANK.format('l_extendedprice')} AS b FROM lineitem) SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r",
    "group_best_of": "WITH m AS (SELECT l_suppkey, l_returnflag, avg(l_quantity) AS m FROM lineitem GROUP BY 1, 2), g AS (SELECT l_suppkey, max(m) FILTER (l_returnflag = 'R') AS ours, max(m) FILTER (l_returnflag <> 'R') AS best FROM m GROUP BY 1) SELECT l_suppkey, round(ours, 6) AS ours, round(best, 6) AS best, ours >= best AS win FROM g WHERE ours IS NOT NULL AND best IS NOT NULL",
    "axis_unpivot": " UNION ALL ".join(f"SELECT '{c}' AS axis, round(avg({c}) FILTER (l_linestatus = 'O'), 6) AS open_mean, round(avg({c}) FILTER (l_linestatus = 'F'), 6) AS final_mean, round(avg({c}) FILTER (l_linestatus = 'O') - avg({c}) FILTER (l_linestatus = 'F'), 6) AS gap FROM lineitem" for c in ("l_quantity", "l_discount", "l_tax")),
    "cond_counts": "SELECT l_shipdate, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_discount >= 0.05) AS reduced, count(*) FILTER (l_returnflag = 'N' AND l_quantity > 25) AS kept_large FROM lineitem GROUP BY 1",
    "dim_default": "SELECT coalesce(n_name, 'elsewhere') AS nation, count(*) AS n FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 0) ON n_nationkey = c_nationkey GROUP BY 1",
    "anti_both_ways": "SELECT c_custkey, 'no order' AS side FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995) UNION ALL SELECT DISTINCT o_custkey, 'no customer' FROM orders WHERE year(o_orderdate) = 1995 AND o_custkey NOT IN (SELECT c_custkey FROM customer)",
    "span_depth": "WITH x AS (SELECT l_partkey, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS d, 1 AS s FROM lineitem UNION ALL SELECT l_partkey, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) + 3, -1 FROM lineitem), g AS (SELECT l_partkey, d, sum(s) AS s FROM x GROUP BY 1, 2), r AS (SELECT l_partkey, sum(s) OVER (PARTITION BY l_partkey ORDER BY d) AS depth FROM g) SELECT l_partkey, CAST(max(depth) AS BIGINT) AS depth FROM r GROUP BY 1",
    "day_runs": "WITH d AS (SELECT DISTINCT o_orderpriority, date_diff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders), i AS (SELECT o_orderpriority, d - row_number() OVER (PARTITION BY o_orderpriority ORDER BY d) AS i FROM d) SELECT o_orderpriority, max(n) AS longest FROM (SELECT o_orderpriority, i, count(*) AS n FROM i GROUP BY 1, 2) GROUP BY 1",
    "min_median_max": "WITH p AS (SELECT CAST(floor(p_retailprice / 200) AS BIGINT) AS bin, p_retailprice AS v FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY bin) AS n FROM p) SELECT bin, max(n) AS n, min(v) AS least, max(v) AS most, max(v) FILTER (k = n // 2) AS middle FROM r GROUP BY 1",
    "best_tuple": "SELECT p_brand, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey DESC) AS k FROM part) WHERE k = 1",
}
