"""B area queries."""

from corvid.operators import bins
from corvid.plans import views
from corvid.plans.catalog import register

W = 10  # the bin width the reference asks for


@register("b2_success_by_length_bin", "B", oracle=f"""
WITH {views.SAMPLES_SQL}
SELECT CAST(floor(length / {W}) * {W} AS BIGINT) AS bin_start,
       CAST(floor(length / {W}) * {W} AS BIGINT) + {W} AS bin_end,
       round(avg(CASE WHEN result = 'Success' THEN 1.0 ELSE 0.0 END), 6) AS success_rate,
       count(*) AS n_functions
FROM samples GROUP BY 1""")
def b2(spark, d):
    return bins.success_by_length_bin(views.samples(spark, d), W)


@register("b3_fill_empty_bins", "B", oracle=f"""
WITH {views.SAMPLES_SQL},
binned AS (
  SELECT CAST(floor(length / {W}) * {W} AS BIGINT) AS bin_start,
         round(avg(CASE WHEN result = 'Success' THEN 1.0 ELSE 0.0 END), 6) AS success_rate,
         count(*) AS n_functions
  FROM samples GROUP BY 1),
axis AS (
  SELECT unnest(generate_series(min(bin_start), max(bin_start), {W})) AS bin_start FROM binned)
SELECT a.bin_start, a.bin_start + {W} AS bin_end, b.success_rate,
       coalesce(b.n_functions, 0) AS n_functions
FROM axis a LEFT JOIN binned b USING (bin_start)""")
def b3(spark, d):
    return bins.fill_empty_bins(bins.success_by_length_bin(views.samples(spark, d), W), W)
