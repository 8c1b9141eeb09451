"""Significance and intervals. Event types stand in for systems, users and days for the units that they are compared on."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlowe.operators import inference
from marlowe.plans.analysis import copies
from marlowe.plans.ranking import UNIT, cells, rounded, units
from marlowe.plans.registry import query, table

#: Simpson's rule with 1,000 strips over [0, h] of a density f(u), without its constant.
SIMPSON = "({h} / 3000 * list_sum(list_transform(range(1001), lambda i: (CASE WHEN i IN (0, 1000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {f})))"
STUDENT = "greatest(0, 1 - 2 * exp(lgamma(n / 2) - lgamma((n - 1) / 2)) / sqrt((n - 1) * pi()) * " + SIMPSON.format(h="t", f="pow(1 + pow(t * i / 1000, 2) / (n - 1), -n / 2)") + ")"
NORMAL = "greatest(0, 1 - 2 / sqrt(2 * pi()) * " + SIMPSON.format(h="z", f="exp(-pow(z * i / 1000, 2) / 2)") + ")"


@query(f"""WITH RECURSIVE ways AS (SELECT 0 AS r, [1.0::DOUBLE] || list_transform(range(1275), lambda i: 0.0::DOUBLE) AS c UNION ALL SELECT r + 1, list_transform(range(1276), lambda i: c[i + 1] + CASE WHEN i > r THEN c[i - r] ELSE 0 END) FROM ways WHERE r < 50),
{UNIT}, v AS (SELECT 'user' AS panel, event_type, user_id::VARCHAR AS unit, v FROM u UNION ALL SELECT 'day', event_type, day, round(v, 9) FROM (SELECT date_trunc('day', ts)::VARCHAR AS day, event_type, avg(value) AS v FROM events GROUP BY ALL)),
m AS (SELECT a.panel, a.event_type AS a, b.event_type AS b, b.v - a.v AS d, round(abs(b.v - a.v), 9) AS size FROM v a JOIN v b ON a.panel = b.panel AND a.unit = b.unit AND a.event_type < b.event_type),
k AS (SELECT panel, a, b, size, count(*) AS c, count_if(d > 0) AS up FROM m WHERE size > 0 GROUP BY ALL), r AS (SELECT *, sum(c) OVER (PARTITION BY panel, a, b ORDER BY size) - (c - 1) / 2 AS rank FROM k),
w AS (SELECT panel, a, b, sum(c) AS m, sum(rank * up) AS w_plus, sum(rank * (c - up)) AS w_minus, sum(c * c * c - c) AS tied FROM r GROUP BY ALL),
s AS (SELECT panel, a, b, count(*) AS n, avg(d) AS mean_diff, stddev_pop(d) AS std_diff, abs(avg(d)) / (stddev_samp(d) / sqrt(count(*))) AS t FROM m GROUP BY ALL),
j AS (SELECT *, abs(w_plus - m * (m + 1) / 4) / sqrt(m * (m + 1) * (2 * m + 1) / 24 - tied / 48) AS z FROM s JOIN w USING (panel, a, b) WHERE n > 1),
p AS (SELECT *, {STUDENT} AS t_p, CASE WHEN n <= 50 AND m = n AND tied = 0 THEN least(1, 2 * least(list_sum((SELECT c FROM ways WHERE ways.r = j.n)[1:(w_plus + 1)::BIGINT]), list_sum((SELECT c FROM ways WHERE ways.r = j.n)[(w_plus + 1)::BIGINT:])) / pow(2, n)) ELSE {NORMAL} END AS wilcoxon_p FROM j)
SELECT panel, a, b, n, round(mean_diff, 6) AS mean_diff, round(std_diff, 6) AS std_diff, round(mean_diff / std_diff, 6) AS cohens_d, round(t_p, 6) AS t_p, round(w_plus, 6) AS w_plus, round(w_minus, 6) AS w_minus, round(wilcoxon_p, 6) AS wilcoxon_p, least(t_p, wilcoxon_p) < 0.05 AS significant FROM p""")
def paired_significance(spark, sf_dir):
    """STA-02 with both p: over users, and over days, which are few enough for the exact distribution."""
    by_user = inference.paired_significance(units(spark, sf_dir), "event_type", "user_id", "v")
    by_day = inference.paired_significance(cells(spark, sf_dir).withColumn("v", F.round("v", 9)), "event_type", "day", "v")
    return rounded(by_user.select(F.lit("user").alias("panel"), "*").unionByName(by_day.select(F.lit("day").alias("panel"), "*")))


DAYS = "SELECT event_type, date_trunc('day', ts)::VARCHAR AS day, round(avg(value), 4) AS x, count(*) AS y FROM events GROUP BY ALL"
DRAW = "('0x' || substr(md5(b::VARCHAR || ':' || day), 1, 8))::BIGINT / 4294967296.0"


@query(f"""WITH u AS ({DAYS}), d AS (SELECT event_type, b, x, y, {copies('h')} AS w FROM (SELECT u.*, b, {DRAW} AS h FROM u, range(2000) t(b))),
r AS (SELECT event_type, b, w, sum(w) OVER (PARTITION BY event_type, b ORDER BY x) - (sum(w) OVER (PARTITION BY event_type, b, x) - 1) / 2 AS rx, sum(w) OVER (PARTITION BY event_type, b ORDER BY y) - (sum(w) OVER (PARTITION BY event_type, b, y) - 1) / 2 AS ry FROM d WHERE w > 0),
c AS (SELECT event_type, b, corr(rx, ry) AS rho FROM (SELECT r.* FROM r, range(6) g(i) WHERE i < w) GROUP BY ALL HAVING min(rx) < max(rx) AND min(ry) < max(ry)),
o AS (SELECT event_type, rank() OVER (PARTITION BY event_type ORDER BY x) + (count(*) OVER (PARTITION BY event_type, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY event_type ORDER BY y) + (count(*) OVER (PARTITION BY event_type, y) - 1) / 2 AS ry FROM u),
p AS (SELECT event_type, count(*) AS n, corr(rx, ry) AS rho FROM o GROUP BY 1), i AS (SELECT event_type, quantile_cont(rho, 0.025) AS low, quantile_cont(rho, 0.975) AS high FROM c GROUP BY 1)
SELECT event_type, n, round(rho, 6) AS rho, round(low, 6) AS low, round(high, 6) AS high FROM p LEFT JOIN i USING (event_type)""")
def bootstrap_correlation(spark, sf_dir):
    """STA-05: a day's mean value against its number of events, 2,000 replicates of days."""
    days = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").cast("string").alias("day")).agg(F.round(F.avg("value"), 4).alias("x"), F.count("*").alias("y"))
    return rounded(inference.bootstrap_correlation(days, "event_type", "day", "x", "y"))
