"""Evaluation queries."""

from pyspark.sql import functions as F

from fleetgauge.catalog.adapters import (
    ANSWERS,
    ATTEMPTS,
    attempts,
    problems,
    raw_answers,
    with_,
)
from fleetgauge.catalog.registry import query
from fleetgauge.functions.numbers import pass_at_k
from fleetgauge.operators import evaluation as ev
from fleetgauge.operators import id_sets
from fleetgauge.plans.evaluation_run import agent_evaluation
from fleetgauge.plans.ordered import by_rows
from fleetgauge.sources.scratch import stored

_FIRST = """first AS (
  SELECT agent_id, task_id, coalesce(ok, false) AS ok,
         CASE WHEN ok THEN completion ELSE '' END AS completion, latency_s,
         CASE WHEN ok THEN attempt END AS attempt, made AS attempts_made
  FROM (SELECT *, row_number() OVER (PARTITION BY agent_id, task_id
                 ORDER BY NOT ok, is_reflection,
                   CASE WHEN ok THEN attempt ELSE -attempt END) AS rn,
               count(*) OVER (PARTITION BY agent_id, task_id) AS made
        FROM attempts) r WHERE rn = 1)"""

_PASS_K = """CASE WHEN n - c < {k} THEN 1.0::DOUBLE WHEN c = 0 THEN 0.0::DOUBLE
  ELSE 1.0::DOUBLE - list_reduce(list_transform(range(n - c + 1, n + 1),
       lambda i: 1.0::DOUBLE - {k}.0::DOUBLE / i), lambda a, b: a * b) END"""


@query(
    "pass_at_k_by_task",
    "A14",
    sql=with_(ATTEMPTS)
    + f"""SELECT task_id, n, c, round({_PASS_K.format(k=1)}, 9) AS pass_1,
       round({_PASS_K.format(k=10)}, 9) AS pass_10
FROM (SELECT task_id, count(*) AS n, count(*) FILTER (passed) AS c FROM attempts GROUP BY 1) t""",
)
def pass_at_k_by_task(t):
    n, c = F.col("n"), F.col("c")
    return ev.task_counts(attempts(t), []).select(
        "task_id",
        "n",
        "c",
        F.round(pass_at_k(n, c, 1), 9).alias("pass_1"),
        F.round(pass_at_k(n, c, 10), 9).alias("pass_10"),
    )


@query(
    "pass_at_k_by_brand",
    "A14",
    "J5",
    sql=with_(ATTEMPTS)
    + f"""SELECT p_brand, count(*) AS tasks,
  CASE WHEN min(n) >= 1 THEN round(avg({_PASS_K.format(k=1)}), 9) END AS pass_1,
  CASE WHEN min(n) >= 10 THEN round(avg({_PASS_K.format(k=10)}), 9) END AS pass_10,
  CASE WHEN min(n) >= 100 THEN round(avg({_PASS_K.format(k=100)}), 9) END AS pass_100
FROM (SELECT p_brand, task_id, count(*) AS n, count(*) FILTER (passed) AS c
      FROM attempts JOIN part ON p_partkey = task_id GROUP BY 1, 2) t
GROUP BY p_brand""",
)
def pass_at_k_by_brand(t):
    counts = ev.task_counts(attempts(t), [])
    branded = counts.join(
        t.part.select(F.col("p_partkey").alias("task_id"), "p_brand"), "task_id", "inner"
    )
    n, c = F.col("n"), F.col("c")
    return branded.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("tasks"),
        *[
            F.when(F.min("n") >= k, F.round(F.avg(pass_at_k(n, c, k)), 9)).alias(f"pass_{k}")
            for k in (1, 10, 100)
        ],
    )


def agent_scores(t):
    """The headline result: attempts to per-agent summaries with pass@k."""
    return agent_evaluation(attempts(t), problems(t))


def composed_agent_scores(t):
    """The same rows from the separate operators."""
    tries = attempts(t)
    summary = ev.agent_summary(ev.first_success(tries, with_completion=False))
    return ev.with_scores(summary, ev.pass_at_ks(tries, problems(t)))


_AGENTS = f"""{_FIRST},
counts AS (SELECT agent_id, task_id, count(*) AS n, count(*) FILTER (passed) AS c FROM attempts
           WHERE task_id IN (SELECT p_partkey FROM part) GROUP BY 1, 2),
scores AS (SELECT agent_id,
  CASE WHEN min(n) >= 1 THEN avg({_PASS_K.format(k=1)}) END AS p1,
  CASE WHEN min(n) >= 10 THEN avg({_PASS_K.format(k=10)}) END AS p10,
  CASE WHEN min(n) >= 100 THEN avg({_PASS_K.format(k=100)}) END AS p100
  FROM counts GROUP BY 1),
agents AS (SELECT agent_id, count(*) AS total_tasks, count(*) FILTER (ok) AS successes,
  avg(latency_s) AS avg_latency_s, sum(latency_s) AS total_time_s,
  count(*) / greatest(sum(latency_s), 0.001) AS throughput_rps FROM first GROUP BY 1)"""


@query(
    "agent_scores",
    "A3",
    "A5",
    "A14",
    "F8",
    "J5",
    "J8",
    sql=with_(ATTEMPTS, _AGENTS)
    + """SELECT a.agent_id, total_tasks, successes, avg_latency_s, total_time_s, throughput_rps,
  round(coalesce(p1, 0), 9) AS pass_1, round(coalesce(p10, 0), 9) AS pass_10,
  round(coalesce(p100, 0), 9) AS pass_100
FROM agents a LEFT JOIN scores s ON s.agent_id = a.agent_id""",
)
def agent_scores_query(t):
    named = agent_scores(t)
    return named.select(
        *[c for c in named.columns if not c.startswith("pass@")],
        *[F.round(F.col(f"`pass@{k}`"), 9).alias(f"pass_{k}") for k in (1, 10, 100)],
    )


_BY_RUN = (
    _AGENTS.replace("agent_id", "run_id, agent_id")
    .replace("GROUP BY 1, 2)", "GROUP BY 1, 2, 3)")
    .replace("GROUP BY 1)", "GROUP BY 1, 2)")
)


@query(
    "agent_scores_by_run",
    "A3",
    "J8",
    sql=with_(
        ATTEMPTS.replace("attempts AS", "tries AS"),
        "attempts AS (SELECT *, attempt // 64 % 3 AS run_id FROM tries)",
        _BY_RUN,
    )
    + """SELECT a.run_id, a.agent_id, total_tasks, successes, avg_latency_s, total_time_s, throughput_rps,
  round(coalesce(p1, 0), 9) AS pass_1, round(coalesce(p10, 0), 9) AS pass_10,
  round(coalesce(p100, 0), 9) AS pass_100
FROM agents a LEFT JOIN scores s ON s.agent_id = a.agent_id AND s.run_id = a.run_id""",
)
def agent_scores_by_run(t):
    """Three runs in which the same agents appear, never mixed."""
    tries = attempts(t).withColumn("run_id", F.floor(F.col("attempt") / 64) % 3)
    both = agent_evaluation(tries, problems(t), run=["run_id"])
    return both.select(
        *[c for c in both.columns if not c.startswith("pass@")],
        *[F.round(F.col(f"`pass@{k}`"), 9).alias(f"pass_{k}") for k in (1, 10, 100)],
    )


@query(
    "overall_score",
    "A4",
    "J8",
    sql=with_(ATTEMPTS, _AGENTS)
    + """SELECT round(avg(coalesce(p1, 0)), 9) AS pass_1, count(*) AS num_agents,
  round(avg(avg_latency_s), 9) AS avg_latency_s, round(avg(throughput_rps), 9) AS avg_throughput_rps
FROM agents a LEFT JOIN scores s ON s.agent_id = a.agent_id""",
)
def overall_score(t):
    score = ev.overall_score(agent_evaluation(attempts(t), problems(t)))
    return score.select(
        F.round("`pass@1`", 9).alias("pass_1"),
        "num_agents",
        F.round("avg_latency_s", 9).alias("avg_latency_s"),
        F.round("avg_throughput_rps", 9).alias("avg_throughput_rps"),
    )


@query(
    "first_success",
    "F8",
    sql=with_(ATTEMPTS, _FIRST)
    + "SELECT agent_id, task_id, completion, latency_s, attempt, ok, attempts_made FROM first",
)
def first_success(t):
    return ev.first_success(attempts(t))


_LATENCY = """SELECT {keys} count(*) AS n, sum(latency_s) / count(*) AS avg_latency_s,
  median(latency_s) AS p50_s,
  max(latency_s) FILTER (rn = greatest(CAST(floor(0.95::DOUBLE * n_all) AS BIGINT), 1)) AS p95_s
FROM (SELECT *, row_number() OVER ({part} ORDER BY latency_s) AS rn, count(*) OVER ({part}) AS n_all
      FROM attempts) r {group}"""


@query(
    "latency_summary_by_agent",
    "A2",
    "F2",
    "L4",
    sql=with_(ATTEMPTS)
    + _LATENCY.format(keys="agent_id,", part="PARTITION BY agent_id", group="GROUP BY agent_id"),
)
def latency_summary_by_agent(t):
    return ev.latency_summary(attempts(t), ["agent_id"])


@query(
    "latency_summary_overall",
    "A2",
    "F2",
    sql=with_(ATTEMPTS) + _LATENCY.format(keys="", part="", group=""),
)
def latency_summary_overall(t):
    return ev.latency_summary(attempts(t))


@query(
    "price_percentiles",
    "A2",
    "F2",
    sql=with_("attempts AS (SELECT l_returnflag, floor(l_extendedprice) AS latency_s FROM lineitem)")
    + _LATENCY.format(
        keys="l_returnflag,", part="PARTITION BY l_returnflag", group="GROUP BY l_returnflag"
    ),
)
def price_percentiles(t):
    priced = t.lineitem.select(
        "l_returnflag", F.floor("l_extendedprice").cast("double").alias("latency_s")
    )
    return ev.latency_summary(priced, ["l_returnflag"])


@query(
    "run_metrics_summary",
    "A2",
    "A5",
    sql=with_(ATTEMPTS)
    + """SELECT s.s_suppkey AS agent_id, coalesce(n, 0) AS n, avg_latency_s, p50_s, p95_s,
  coalesce(n, 0) / greatest(floor(s_acctbal), 0.001) AS throughput_rps,
  CAST(s_nationkey AS BIGINT) AS successes, CAST(100 AS BIGINT) AS total
FROM supplier s LEFT JOIN ("""
    + _LATENCY.format(
        keys="agent_id,",
        part="PARTITION BY agent_id",
        group="GROUP BY agent_id",
    )
    + ") q ON q.agent_id = s.s_suppkey",
)
def run_metrics_summary(t):
    runs = t.supplier.select(
        F.col("s_suppkey").alias("agent_id"),
        F.col("s_nationkey").cast("bigint").alias("successes"),
        F.lit(100).cast("bigint").alias("total"),
        F.floor("s_acctbal").cast("double").alias("runtime_s"),
    )
    return ev.run_metrics_summary(attempts(t), runs, ["agent_id"])


_FLAGGED = """flagged AS (SELECT d.source, d.doc_id % 100 AS task_id,
  coalesce(l.quality = 1, false) AS valid
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def _flagged(t):
    return t.documents.join(t.labels, "doc_id", "left").select(
        "source",
        (F.col("doc_id") % 100).alias("task_id"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("valid"),
    )


@query(
    "validity_counts",
    "A11",
    "A12",
    sql=with_(_FLAGGED)
    + """SELECT source, count(*) AS samples, count(*) FILTER (NOT valid) AS syntax_errors,
  count(DISTINCT task_id) AS total_attempted,
  count(*) FILTER (NOT valid) / count(DISTINCT task_id) AS syntax_error_rate,
  count(*) FILTER (NOT valid) / count(*) AS sample_error_rate
FROM flagged GROUP BY source""",
)
def validity_counts(t):
    return ev.validity_counts(_flagged(t), ["source"])


@query(
    "flag_invalid",
    "P19",
    sql="""SELECT d.doc_id,
  CASE WHEN quality = 1 THEN 'x ' || text ELSE text END AS completion,
  CASE WHEN quality = 1 THEN NULL ELSE 'syntax_error' END AS syntax_error,
  CASE WHEN quality = 1 THEN NULL ELSE false END AS passed,
  CASE WHEN quality = 1 THEN NULL ELSE 'syntax_error' END AS result
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def flag_invalid(t):
    rows = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id",
        F.col("text").alias("completion"),
        F.coalesce(F.col("quality") == 1, F.lit(False)).alias("valid"),
    )
    return ev.flag_invalid(rows, F.col("valid"), F.concat(F.lit("x "), "completion")).drop("valid")


@query(
    "looks_like_code_rate",
    "A13",
    sql=with_(ANSWERS)
    + """SELECT source,
  count(*) FILTER (contains(answer, 'def ') OR contains(answer, 'return')) AS pass_like,
  count(*) AS total,
  count(*) FILTER (contains(answer, 'def ') OR contains(answer, 'return')) / count(*) AS rate_est
FROM answers GROUP BY source""",
)
def looks_like_code_rate(t):
    return ev.code_rate(raw_answers(t), ["source"], "answer")


@query("syntax_classes", "I9", "A11")
def syntax_classes(t):
    texts = raw_answers(t).select(
        "source", F.col("doc_id").alias("task_id"), F.col("answer").alias("completion")
    )
    return ev.error_class_counts(ev.with_syntax(texts), ["source"])


@query("prevalidated_answers", "I9", "P19")
def prevalidated_answers(t):
    texts = raw_answers(t).select(
        F.col("doc_id").alias("task_id"),
        F.concat(F.lit("x = "), (F.col("doc_id") % 7).cast("string"), F.lit("\n"), "answer").alias(
            "completion"
        ),
    )
    flagged = ev.prevalidate(texts.unionByName(
        t.part.select(
            F.col("p_partkey").alias("task_id"),
            F.concat(F.lit("    return "), F.col("p_size").cast("string")).alias("completion"),
        )
    ))
    return flagged.groupBy("result", "error_class").agg(F.count(F.lit(1)).alias("samples"))


@query(
    "task_lists",
    "A20",
    "F3",
    sql=with_(ATTEMPTS)
    + """SELECT agent_id, (pos - 1) // 50 AS chunk_no,
  string_agg(CAST(task_id AS VARCHAR), ',' ORDER BY pos) AS tasks
FROM (SELECT agent_id, task_id,
        row_number() OVER (PARTITION BY agent_id ORDER BY task_id) AS pos
      FROM (SELECT DISTINCT agent_id, task_id FROM attempts) d) n
GROUP BY 1, 2""",
)
def task_lists(t):
    items = attempts(t).select("agent_id", "task_id").distinct()
    lists = ev.task_list_chunks(items, "agent_id", ["task_id"], chunk=50)
    return lists.withColumn("tasks", F.array_join(F.col("tasks").cast("array<string>"), ","))


def _partials(t):
    rows = attempts(t).select("agent_id", "gpu_id", "task_id", "latency_s", "ok")
    return [rows.where(F.col("gpu_id") == g) for g in range(4)]


@query(
    "merged_partials",
    "U1",
    "A21",
    sql=with_(ATTEMPTS)
    + """SELECT agent_id, count(*) AS total, count(*) FILTER (ok) AS successes,
  sum(latency_s) AS latency_s FROM attempts GROUP BY agent_id""",
)
def merged_partials(t):
    merged = ev.merge_partials(_partials(t))
    return merged.groupBy("agent_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("ok").alias("successes"),
        F.sum("latency_s").alias("latency_s"),
    )


@query(
    "merged_partials_last_device",
    "F9",
    sql=with_(ATTEMPTS)
    + """SELECT agent_id, gpu_id, count(*) AS total, count(*) FILTER (ok) AS successes
FROM (SELECT *, max(gpu_id) OVER (PARTITION BY agent_id) AS last FROM attempts) m
WHERE gpu_id = last GROUP BY agent_id, gpu_id""",
)
def merged_partials_last_device(t):
    merged = ev.merge_partials(_partials(t), compat=True)
    return merged.groupBy("agent_id", "gpu_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("successes")
    )


@query(
    "multi_sample",
    "A24",
    sql=with_(ATTEMPTS)
    + """SELECT agent_id, task_id, count(*) FILTER (ok) AS completions,
  sum(latency_s) / greatest(count(*) FILTER (ok), 1) AS avg_latency_s, bool_or(ok) AS ok
FROM attempts GROUP BY 1, 2""",
)
def multi_sample(t):
    return ev.multi_sample(attempts(t))


_BATCHED = """batched AS (SELECT agent_id, start_s, end_s,
  (row_number() OVER (PARTITION BY agent_id
     ORDER BY start_s, attempt, task_id, latency_s) - 1) // 8 AS batch_no
  FROM attempts)"""


def _batched(t, size=8):
    return ev.with_batches(
        attempts(t), ["agent_id"], ["start_s", "attempt", "task_id", "latency_s"], size
    )


@query(
    "batch_latency",
    "A25",
    "F4",
    sql=with_(ATTEMPTS, _BATCHED)
    + """SELECT agent_id, batch_no, count(*) AS batch_items,
  (max(end_s) - min(start_s)) / count(*) AS item_latency_s
FROM batched GROUP BY 1, 2""",
)
def batch_latency(t):
    return ev.batch_latency(_batched(t), ["agent_id"])


@query(
    "batch_counts",
    "F4",
    sql=with_(ATTEMPTS, _BATCHED)
    + "SELECT agent_id, count(*) AS total, max(batch_no) + 1 AS num_batches FROM batched GROUP BY 1",
)
def batch_counts(t):
    return ev.batch_counts(_batched(t), ["agent_id"])


@query(
    "run_span",
    "A26",
    sql=with_(ATTEMPTS)
    + """SELECT agent_id, min(start_s) AS start_s, max(end_s) AS end_s,
  max(end_s) - min(start_s) AS runtime_s FROM attempts GROUP BY 1""",
)
def run_span(t):
    return ev.run_span(attempts(t), ["agent_id"], "start_s", "end_s")


@query(
    "peak_concurrency",
    "F10",
    sql=with_(ATTEMPTS)
    + """SELECT agent_id, CAST(max(active) AS BIGINT) AS max_concurrent, CAST(count(*) FILTER (d = 1) AS BIGINT) AS started
FROM (SELECT agent_id, d, sum(d) OVER (PARTITION BY agent_id ORDER BY t, d
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS active
      FROM (SELECT agent_id, start_s AS t, 1 AS d FROM attempts
            UNION ALL SELECT agent_id, end_s, -1 FROM attempts) e) r
GROUP BY agent_id""",
)
def peak_concurrency(t):
    return ev.peak_concurrency(attempts(t), ["agent_id"])


@query(
    "peak_concurrency_overall",
    "F10",
    sql=with_(ATTEMPTS)
    + """SELECT CAST(max(active) AS BIGINT) AS max_concurrent, CAST(count(*) FILTER (d = 1) AS BIGINT) AS started
FROM (SELECT d, sum(d) OVER (ORDER BY t, d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS active
      FROM (SELECT start_s AS t, 1 AS d FROM attempts
            UNION ALL SELECT end_s, -1 FROM attempts) e) r""",
)
def peak_concurrency_overall(t):
    return ev.peak_concurrency(attempts(t), [])


@query(
    "executor_map",
    "J11",
    "J7",
    sql=with_(ATTEMPTS)
    + """SELECT w.agent_id, w.gpu_id AS planned, p.gpu_id AS ran, count(*) AS tasks
FROM (SELECT DISTINCT agent_id, task_id, CAST((agent_id * 2000 + task_id) % 4 AS INT) AS gpu_id
      FROM attempts) w
JOIN (SELECT agent_id, task_id, min(gpu_id) AS gpu_id FROM attempts GROUP BY 1, 2) p
  ON p.agent_id = w.agent_id AND p.task_id = w.task_id
GROUP BY 1, 2, 3""",
)
def executor_map(t):
    tries = attempts(t)
    planned = tries.select("agent_id", "task_id").distinct().withColumn(
        "planned", ((F.col("agent_id") * 2000 + F.col("task_id")) % 4).cast("int")
    )
    ran = tries.groupBy("agent_id", "task_id").agg(F.min("gpu_id").alias("ran"))
    return (
        ev.executor_map(planned, ran)
        .groupBy("agent_id", "planned", "ran")
        .agg(F.count(F.lit(1)).alias("tasks"))
    )


@query(
    "attempted_problems",
    "J5",
    "U2",
    "U3",
    sql="""SELECT doc_id AS task_id, text AS prompt, lang AS entry_point
FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""",
)
def attempted_problems(t):
    known = t.documents.select(
        F.col("doc_id").alias("task_id"), F.col("text").alias("prompt"), F.col("lang").alias("entry_point")
    )
    return ev.attempted_problems(known, t.labels.select(F.col("doc_id").alias("task_id")))


@query(
    "distinct_ids",
    "U2",
    "A12",
    sql="""SELECT l_returnflag, count(DISTINCT l_partkey) AS tasks, count(DISTINCT l_suppkey) AS agents
FROM lineitem GROUP BY 1""",
)
def distinct_ids(t):
    return t.lineitem.groupBy("l_returnflag").agg(
        F.count_distinct("l_partkey").alias("tasks"), F.count_distinct("l_suppkey").alias("agents")
    )


@query(
    "known_and_attempted_ids",
    "U3",
    sql="SELECT doc_id AS task_id FROM documents INTERSECT SELECT doc_id FROM labels",
)
def known_and_attempted_ids(t):
    known = t.documents.select(F.col("doc_id").alias("task_id"))
    return known.intersect(t.labels.select(F.col("doc_id").alias("task_id")))


def _agent_results(t):
    words = F.split("p_name", " ")
    return t.part.select(
        F.col("p_partkey").alias("agent_id"),
        F.concat(words, F.array("p_brand", "p_type")).alias("outputs"),
        F.transform(
            words,
            lambda w, i: F.when((F.col("p_size") + i) % 3 == 0, F.lit("")).otherwise(
                F.concat(w, F.lit("/"), i.cast("string"))
            ),
        ).alias("task_ids"),
        F.transform(words, lambda w, i: (F.col("p_size") + i).cast("double")).alias("latencies"),
    )


def _prompt_list(t):
    return t.region.select(
        F.col("r_regionkey").alias("position"), F.col("r_name").alias("task_id")
    )


_RESULT_ROWS = """rows AS (SELECT p_partkey AS agent_id, i AS position, outputs[i + 1] AS output,
    CASE WHEN i < len(words) THEN CASE WHEN (p_size + i) % 3 = 0 THEN '' ELSE words[i + 1] || '/' || i END END AS tid,
    CASE WHEN i < len(words) THEN CAST(p_size + i AS DOUBLE) END AS latency_s
  FROM (SELECT p_partkey, p_size, words, outputs, CAST(unnest(range(len(outputs))) AS INT) AS i
        FROM (SELECT *, string_split(p_name, ' ') AS words,
                string_split(p_name, ' ') || [p_brand, p_type] AS outputs FROM part) p) u)"""


@query(
    "completion_rows",
    "P14",
    "P15",
    "S3",
    sql=with_(_RESULT_ROWS)
    + """SELECT agent_id, position,
  coalesce(nullif(tid, ''), r_name, 'HumanEval/' || position) AS task_id, output, latency_s
FROM rows LEFT JOIN region ON r_regionkey = position""",
)
def completion_rows(t):
    return ev.completion_rows(_agent_results(t), _prompt_list(t))


@query(
    "failed_agent_rows",
    "P21",
    sql="""SELECT source AS agent_id, d.doc_id AS task_id,
  CASE WHEN l.doc_id IS NULL THEN '    pass' ELSE lang END AS completion,
  CAST(quality AS DOUBLE) AS latency_s, coalesce(quality = 1, false) AS ok
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def failed_agent_rows(t):
    # Labels cover some documents only: the others are work that gave nothing.
    work = t.documents.select(F.col("source").alias("agent_id"), F.col("doc_id").alias("task_id"))
    results = t.labels.join(t.documents, "doc_id").select(
        F.col("source").alias("agent_id"),
        F.col("doc_id").alias("task_id"),
        F.col("lang").alias("completion"),
        F.col("quality").cast("double").alias("latency_s"),
        (F.col("quality") == 1).alias("ok"),
    )
    return ev.with_failed_agents(work, results)


_RUNS = """scores AS (SELECT s_suppkey AS run_id, s_nationkey / 32.0::DOUBLE AS p1, CAST(64 AS BIGINT) AS total,
    CAST(s_nationkey AS DOUBLE) AS avg_latency_s, CAST(s_nationkey * 2 AS DOUBLE) AS avg_throughput_rps
  FROM supplier),
agents AS (SELECT l_suppkey AS run_id, CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_quantity END AS avg_latency_s,
    CAST(l_linenumber - 1 AS DOUBLE) AS throughput_rps, CAST(l_linenumber AS BIGINT) AS successes,
    CAST(l_linenumber AS BIGINT) AS total_tasks
  FROM lineitem)"""


def _run_documents(t):
    scores = t.supplier.select(
        F.col("s_suppkey").alias("run_id"),
        (F.col("s_nationkey") / 32.0).alias("pass@1"),
        F.lit(64).cast("bigint").alias("total"),
        F.col("s_nationkey").cast("double").alias("avg_latency_s"),
        (F.col("s_nationkey") * 2).cast("double").alias("avg_throughput_rps"),
    )
    agents = t.lineitem.select(
        F.col("l_suppkey").alias("run_id"),
        F.when(F.col("l_returnflag") == "A", 0.0).otherwise(F.col("l_quantity")).alias("avg_latency_s"),
        (F.col("l_linenumber") - 1).cast("double").alias("throughput_rps"),
        F.col("l_linenumber").cast("bigint").alias("successes"),
        F.col("l_linenumber").cast("bigint").alias("total_tasks"),
    )
    return scores, agents


@query(
    "override_metrics",
    "J9",
    "A6",
    "A7",
    sql=with_(_RUNS)
    + """SELECT s.run_id, coalesce(lat, s.avg_latency_s, 0) AS avg_latency_s,
  coalesce(rps, s.avg_throughput_rps, 0) AS throughput_rps, coalesce(okn, p1 * total) AS successes
FROM scores s LEFT JOIN (SELECT run_id, avg(nullif(avg_latency_s, 0)) AS lat,
    avg(nullif(throughput_rps, 0)) AS rps, CAST(sum(successes) AS DOUBLE) AS okn FROM agents GROUP BY 1) a
  ON a.run_id = s.run_id""",
)
def override_metrics(t):
    return ev.override_metrics(*_run_documents(t))


@query(
    "progress",
    "A19",
    sql=with_(_RUNS)
    + """SELECT s.s_suppkey AS run_id, CAST(coalesce(done, 0) AS BIGINT) AS tasks_done,
  CAST(s_nationkey * 100 AS BIGINT) AS tasks_total,
  CASE WHEN s_nationkey > 0 THEN CAST(coalesce(done, 0) AS DOUBLE) / (s_nationkey * 100) * 100.0 ELSE 0.0 END AS progress_percent
FROM supplier s LEFT JOIN (SELECT run_id, sum(total_tasks) AS done FROM agents GROUP BY 1) a
  ON a.run_id = s.s_suppkey""",
)
def progress(t):
    runs = t.supplier.select(
        F.col("s_suppkey").alias("run_id"),
        F.col("s_nationkey").cast("bigint").alias("num_agents"),
        F.lit(100).cast("bigint").alias("num_tasks"),
    )
    return ev.progress(runs, _run_documents(t)[1])


@query(
    "distinct_ids_from_bitmaps",
    "A12",
    "U2",
    sql="""SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey) AS tasks
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""",
)
def distinct_ids_from_bitmaps(t):
    """One stored table of bitmaps answers three groupings."""
    fine = stored(id_sets.id_bitmaps(t.lineitem, ["l_returnflag", "l_linestatus"], "l_partkey"), "bitmaps")
    none = F.lit(None).cast("string")
    by_flag = id_sets.set_sizes(id_sets.merged_bitmaps(fine, ["l_returnflag"]), ["l_returnflag"], "tasks")
    overall = id_sets.set_sizes(id_sets.merged_bitmaps(fine), name="tasks")
    columns = ["l_returnflag", "l_linestatus", "tasks"]
    return (
        id_sets.set_sizes(fine, ["l_returnflag", "l_linestatus"], "tasks")
        .unionByName(by_flag.withColumn("l_linestatus", none).select(columns))
        .unionByName(overall.withColumns({"l_returnflag": none, "l_linestatus": none}).select(columns))
    )


@query(
    "common_ids_from_bitmaps",
    "U3",
    sql="""SELECT l_partkey AS task_id FROM lineitem WHERE l_returnflag = 'R'
INTERSECT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'""",
)
def common_ids_from_bitmaps(t):
    """Tasks that failed in one group and were accepted in another."""
    sides = [id_sets.id_bitmaps(t.lineitem.where(F.col("l_returnflag") == x), [], "l_partkey") for x in ("R", "A")]
    return id_sets.members(id_sets.common_bitmaps(sides), name="task_id")


@query(
    "latency_rollup",
    "A2",
    "A12",
    sql=with_(ATTEMPTS)
    + """SELECT agent_id, count(latency_s) AS n, avg(latency_s) AS avg_latency_s, true AS p50_within,
  true AS p95_within, true AS tasks_within
FROM attempts GROUP BY agent_id""",
)
def latency_rollup(t):
    """Sketches by agent and device, rolled up to agents; their errors against exact ranks and counts."""
    rows = attempts(t)
    rolled = ev.rolled_up(stored(ev.latency_sketches(rows, ["agent_id", "gpu_id"]), "latency-sketches"), ["agent_id"])
    # An agent's tasks are dealt over parts, and what is counted in each adds up.
    parts = F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))
    cut = rows.select("agent_id", "task_id", "latency_s", F.pmod(F.xxhash64("task_id"), F.lit(8)).alias("part"))
    dealt = by_rows(cut, ["agent_id", "part"], label="latencies")
    counted = dealt.join(rolled.withColumn("part", F.explode(parts)), ["agent_id", "part"]).groupBy("agent_id", "part")
    counts = [f"{q}_{side}" for q in ("p50_s", "p95_s") for side in ("below", "upto")]
    facts = ["n", "avg_latency_s", "distinct_tasks"]
    each = counted.agg(
        *[F.max(c).alias(c) for c in facts],
        *[F.count_if(F.col("latency_s") < F.col(q)).alias(f"{q}_below") for q in ("p50_s", "p95_s")],
        *[F.count_if(F.col("latency_s") <= F.col(q)).alias(f"{q}_upto") for q in ("p50_s", "p95_s")],
        F.count_distinct("task_id").alias("tasks"),
    )
    ranks = each.groupBy("agent_id").agg(
        *[F.max(c).alias(c) for c in facts], *[F.sum(c).alias(c) for c in (*counts, "tasks")]
    )

    def within(q, share):
        # The quantile's own ranks run from the values below it to those up to it.
        slack = 0.01 * F.col("n") + 1
        at = share * F.col("n")
        return (F.col(f"{q}_below") <= at + slack) & (F.col(f"{q}_upto") >= at - slack)

    return ranks.select(
        "agent_id",
        "n",
        "avg_latency_s",
        within("p50_s", 0.5).alias("p50_within"),
        within("p95_s", 0.95).alias("p95_within"),
        (F.abs(F.col("distinct_tasks") - F.col("tasks")) <= 0.04 * F.col("tasks") + 1).alias("tasks_within"),
    )
