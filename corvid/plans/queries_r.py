"""R area queries: runs, grid, outcomes, rubric scores, token costs."""

from pyspark.sql import functions as F

from corvid.operators import runs as R
from corvid.plans import views
from corvid.plans.catalog import register

TS = "yyyy-MM-dd HH:mm:ss"
TS_SQL = "%Y-%m-%d %H:%M:%S"


@register("r2_parse_run_name", "R", oracle=f"""
WITH {views.RUNS_SQL}
SELECT task, run_name,
       regexp_extract(run_name, '^run_(.+)_([0-9]{{8}}_[0-9]{{6}})$', 1) AS agent,
       strftime(try_strptime(regexp_extract(run_name, '^run_(.+)_([0-9]{{8}}_[0-9]{{6}})$', 2), '%Y%m%d_%H%M%S'),
                '{TS_SQL}') AS started_at
FROM runs""")
def r2(spark, d):
    p = R.parse_run_name(F.col("run_name"))
    return views.runs(spark, d).select("task", "run_name", p.agent.alias("agent"),
                                       F.date_format(p.started_at, TS).alias("started_at"))


@register("r3_run_outcome", "R", oracle=f"""
WITH {views.RUNS_SQL}
SELECT task, run_name, return_code,
       CASE WHEN return_code <> 0 THEN 'failed' ELSE 'succeeded' END AS outcome,
       CASE WHEN return_code <> 0 THEN 'error_log_' || run_name || '.txt' END AS error_log
FROM runs""")
def r3(spark, d):
    return R.run_outcome(views.runs(spark, d).select("task", "run_name", "return_code"))


_AGENTS_SQL = ", ".join(f"('{a}')" for a in views.AGENTS)


@register("r4_run_grid", "R", oracle=f"""
WITH {views.TASKS_SQL}, agents(agent) AS (VALUES {_AGENTS_SQL})
SELECT category, task, agent FROM tasks, agents""")
def r4(spark, d):
    return R.run_grid(views.tasks(spark, d), views.AGENTS)


@register("r5_pending_runs", "R", oracle=f"""
WITH {views.TASKS_SQL}, {views.RUNS_SQL}, agents(agent) AS (VALUES {_AGENTS_SQL}),
grid AS (SELECT category, task, agent FROM tasks, agents)
SELECT category, task, agent FROM grid g
WHERE NOT EXISTS (SELECT 1 FROM runs r WHERE r.task = g.task AND r.category = g.category
                  AND regexp_extract(r.run_name, '^run_(.+)_([0-9]{{8}}_[0-9]{{6}})$', 1) = g.agent)""")
def r5(spark, d):
    grid = R.run_grid(views.tasks(spark, d), views.AGENTS)
    return R.pending_runs(grid, views.runs(spark, d).select("category", "task", "run_name"))


@register("r6_manifest_check", "R", oracle=f"""
WITH {views.TASKS_SQL}, {views.RUNS_SQL},
declared AS (SELECT category, count(*) AS n FROM tasks GROUP BY category),
actual AS (SELECT t.category, count(DISTINCT t.task) AS n
           FROM tasks t WHERE (t.category, t.task) IN (SELECT (category, task) FROM runs) GROUP BY t.category)
SELECT coalesce(d.category, a.category) AS category,
       coalesce(d.n, 0) AS declared, coalesce(a.n, 0) AS actual,
       CASE WHEN coalesce(d.n, 0) = coalesce(a.n, 0) THEN 'ok' ELSE 'mismatch' END AS status
FROM declared d FULL OUTER JOIN actual a ON d.category = a.category""")
def r6(spark, d):
    tasks = views.tasks(spark, d)
    declared = tasks.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    ran = views.runs(spark, d).select("category", "task").distinct()
    actual = (tasks.join(ran, ["category", "task"], "left_semi")
              .groupBy("category").agg(F.count(F.lit(1)).alias("n")))
    return R.manifest_check(declared, actual)


@register("r7_score_rollup", "R", oracle=f"""
WITH {views.RUBRIC_SQL}
SELECT category, task, section,
       CAST(grouping(category, task, section) AS INTEGER) AS level,
       CAST(sum(points) AS BIGINT) AS points, CAST(sum(awarded) AS BIGINT) AS awarded
FROM rubric GROUP BY ROLLUP (category, task, section)""")
def r7(spark, d):
    return R.score_rollup(views.rubric(spark, d))


@register("r8_rubric_total_check", "R", oracle=f"""
WITH {views.RUBRIC_SQL}
SELECT category, task, CAST(sum(points) AS BIGINT) AS total
FROM rubric GROUP BY category, task HAVING sum(points) <> 20""")
def r8(spark, d):
    return R.rubric_total_check(views.rubric(spark, d), 20)


_PRICE_CASE = "CASE model " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in views.PRICES.items()) + " END"


@register("r9_token_cost", "R", oracle=f"""
WITH {views.CHATS_SQL}
SELECT model, role, count(*) AS n_messages,
       CAST(sum(CAST(ceil(length(text) / 4) AS BIGINT)) AS BIGINT) AS tokens,
       round(CAST(sum(CAST(ceil(length(text) / 4) AS BIGINT)) AS BIGINT) * ({_PRICE_CASE}) / 1e6, 6) AS cost
FROM chats GROUP BY model, role""")
def r9(spark, d):
    return R.token_cost(views.chats(spark, d), views.PRICES)


@register("r10_parse_rubric", "R", oracle=f"""
WITH {views.RUBRIC_SQL}
SELECT category, task, section,
       CAST(row_number() OVER (PARTITION BY category, task
            ORDER BY CASE WHEN section = 'User Experience' THEN 0 ELSE 1 END, ordinal, criterion, points) AS INTEGER)
         AS ordinal,
       criterion, points
FROM rubric""")
def r10(spark, d):
    return R.parse_rubric(views.rubric_readmes(spark, d)).withColumn("ordinal", F.col("ordinal").cast("int"))
