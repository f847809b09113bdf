"""Histories, caches and limits over conversations and events."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from docmill.operators import metrics as X, ranking as K
from docmill.plans.registry import query
from docmill.streaming import caches as C, stateful as S
from docmill.tables import table


@query("last_n_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 3")
def last_n(spark, sf_dir):
    return K.last_n(table(spark, sf_dir, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role")


@query("last_assistant", "SELECT conv_id, CASE WHEN length(arg_max(text, turn)) > 200 THEN left(arg_max(text, turn), 200) || '...' ELSE arg_max(text, turn) END AS response FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def last_assistant(spark, sf_dir):
    from docmill.functions.text import truncated

    said = K.latest(table(spark, sf_dir, "conversations").filter("role = 'assistant'"), "conv_id", "turn", "text")
    return said.select("conv_id", truncated(F.col("text"), 200).alias("response"))


@query("turn_number", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS number FROM conversations")
def turn_number(spark, sf_dir):
    return K.numbered(table(spark, sf_dir, "conversations"), "conv_id", [F.col("turn")]).select("conv_id", "turn", "number")


@query("turn_messages", "SELECT conv_id, turn, unnest([0, 1])::INT AS part, unnest(['user', 'assistant']) AS role, unnest([role, text]) AS content FROM conversations")
def turn_messages(spark, sf_dir):
    return S.messages(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "role", "text").select("conv_id", "turn", "part", F.col("role").alias("role"), "content")


@query(
    "message_counter_trigger",
    "SELECT conv_id, turn, rn::INT AS turn_count, (CASE WHEN (rn - 1) % 3 = 2 THEN 0 ELSE ((rn - 1) % 3 + 1) * 2 END)::INT AS messages_since_summary, (rn - 1) % 3 = 2 AS summarize FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations)",
)
def counters(spark, sf_dir):
    out = S.counters(table(spark, sf_dir, "conversations"), "conv_id", "turn", every=6)
    return out.select("conv_id", "turn", "turn_count", F.col("messages_since_summary").cast("int"), "summarize")


@query(
    "rate_limit_fixed_window",
    """WITH RECURSIVE e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    w AS (SELECT user_id, event_id, ts, rn, ts AS start, 1 AS n FROM e WHERE rn = 1 UNION ALL
    SELECT e.user_id, e.event_id, e.ts, e.rn, CASE WHEN epoch(e.ts) - epoch(w.start) >= 86400 THEN e.ts ELSE w.start END, CASE WHEN epoch(e.ts) - epoch(w.start) >= 86400 THEN 1 ELSE w.n + 1 END FROM w JOIN e ON e.user_id = w.user_id AND e.rn = w.rn + 1)
    SELECT event_id, user_id, n::BIGINT AS n, n <= 3 AS allowed FROM w""",
)
def rate_limit(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return S.rate_limited(events, "user_id", "ts", "event_id", limit=3, seconds=86_400).select("event_id", "user_id", "n", "allowed")


@query("ttl_cache_hits", "SELECT event_id, coalesce(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id)) < 3600, false) AS hit FROM events")
def ttl_hits(spark, sf_dir):
    return S.ttl_hits(table(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", "event_id", 3600).select("event_id", "hit")


@query(
    "semantic_cache_hits",
    """WITH c AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rn FROM embeddings WHERE vec_id % 2 = 0) WHERE rn <= 50),
    s AS (SELECT p.vec_id AS probe_id, c.vec_id AS cache_id, round(list_inner_product(p.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS similarity FROM embeddings p JOIN c USING (label) WHERE p.vec_id % 2 = 1)
    SELECT probe_id, arg_max(cache_id, (similarity, -cache_id)) AS cache_id, max(similarity) AS similarity FROM s WHERE similarity >= 0.5 GROUP BY probe_id""",
)
def semantic_hits(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.col("embedding").alias("v"))
    probes = v.filter("vec_id % 2 = 1").withColumnRenamed("vec_id", "probe_id")
    cached = v.filter("vec_id % 2 = 0").withColumn("seq", F.col("vec_id")).withColumnRenamed("vec_id", "cache_id")
    return S.semantic_hits(probes, cached, "label", "probe_id", "cache_id", "seq", threshold=0.5, keep=50)


@query("event_tumbling_counts", "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def tumbling(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return rows.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", "total")


@query("metrics_by_label", "SELECT event_type, count(*) AS n, round(avg(value), 3) AS mean, round(max(value), 3) AS most FROM events GROUP BY event_type")
def metrics(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 3).alias("mean"), F.round(F.max("value"), 3).alias("most"))


@query("audit_days", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def audit_days(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query(
    "cache_reads",
    """WITH e AS (SELECT *, CASE event_type WHEN 'purchase' THEN 'set' WHEN 'signup' THEN 'set' WHEN 'error' THEN 'clear' ELSE 'get' END AS op FROM events),
    l AS (SELECT *, last_value(CASE WHEN op <> 'get' THEN struct_pack(op := op, v := event_id, at := ts) END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM e)
    SELECT event_id, CASE WHEN s.op = 'set' AND epoch_us(ts) - epoch_us(s.at) < 172800000000 THEN s.v::VARCHAR END AS found FROM l WHERE op = 'get'""",
)
def cache_reads(spark, sf_dir):
    """A cache of two days by user: purchases and signups set it, errors clear it, all other events read it."""
    kind = F.when(F.col("event_type").isin("purchase", "signup"), C.SET).when(F.col("event_type") == "error", C.CLEAR).otherwise(C.GET)
    asked = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", kind.alias("op"), F.col("event_id").cast("string").alias("value"))
    return C.reads(asked, ["user_id"], "ts", "event_id", "op", "value", 172_800).select("event_id", "found")


@query(
    "nearest_cache_reads",
    """WITH n AS (SELECT label, vec_id, embedding::DOUBLE[] AS v, vec_id % 2 = 0 AS is_set, count(*) FILTER (vec_id % 2 = 0) OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings),
    s AS (SELECT g.vec_id AS seq, c.vec_id AS found, c.n, round(list_inner_product(g.v, c.v), 6) AS similarity FROM n g JOIN n c ON g.label = c.label AND c.is_set AND NOT g.is_set AND c.n <= g.n AND c.n > g.n - 20)
    SELECT seq, arg_max(found, (similarity, -n)) AS found, max(similarity) AS similarity FROM s WHERE similarity >= 0.3 GROUP BY seq""",
)
def nearest_cache_reads(spark, sf_dir):
    """Odd vectors ask their label's cache of the last 20 even ones."""
    asked = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("seq"), F.when(F.col("vec_id") % 2 == 0, C.SET).otherwise(C.GET).alias("op"), F.col("embedding").cast("array<double>").alias("v"))
    return C.nearest_reads(asked, "label", "seq", "op", "v", 0.3, 20)


@query(
    "latency_quantiles",
    """WITH b AS (SELECT event_type, CASE WHEN value <= 1e-9 THEN -2147483648 ELSE ceil(ln(value) / ln(1.01 / 0.99))::BIGINT END AS b, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER (PARTITION BY event_type ORDER BY b) AS up_to, sum(n) OVER (PARTITION BY event_type) AS total FROM b),
    q AS (SELECT event_type, share, min(b) AS b, max(total)::BIGINT AS n FROM c, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) s(share) WHERE up_to >= ceil(share * total - 1e-9) GROUP BY ALL)
    SELECT event_type, share, round(CASE WHEN b = -2147483648 THEN 0.0 ELSE 2 * pow(1.01 / 0.99, b) / (1.01 / 0.99 + 1) END, 6) AS value, n FROM q""",
)
def latency_quantiles(spark, sf_dir):
    """Sketches by day and type, merged over all days."""
    rows = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    sketches, _ = X.sketch(rows, ["day", "event_type"], "value")
    return X.quantiles(sketches, ["event_type"], (0.5, 0.9, 0.99)).withColumn("value", F.round("value", 6))


@query(
    "latency_quantile_errors",
    """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
    SELECT event_type, share, value AS exact, true AS within FROM r, (VALUES (0.5::DOUBLE), (0.9::DOUBLE), (0.99::DOUBLE)) s(share) WHERE i = greatest(ceil(share * n - 1e-9), 1)""",
)
def latency_quantile_errors(spark, sf_dir):
    """The exact quantiles, and whether the merged sketches' are within a hundredth of them."""
    events = table(spark, sf_dir, "events")
    sketches, _ = X.sketch(events.withColumn("day", F.to_date("ts")), ["day", "event_type"], "value")
    told = X.quantiles(sketches, ["event_type"], (0.5, 0.9, 0.99))
    counted = events.filter("value is not null").groupBy("event_type", "value").agg(F.count("*").alias("k"))
    up_to = F.sum("k").over(Window.partitionBy("event_type").orderBy("value"))
    ranked = counted.select("event_type", F.col("value").alias("exact"), (up_to - F.col("k")).alias("before"), up_to.alias("up_to"))
    wanted = F.greatest(F.ceil(F.col("share") * F.col("n") - 1e-9), F.lit(1))
    met = told.join(ranked, "event_type").filter((F.col("before") < wanted) & (F.col("up_to") >= wanted))
    return met.select("event_type", "share", "exact", (F.abs(F.col("value") - F.col("exact")) <= X.ERROR * F.col("exact") + 1e-9).alias("within"))


@query(
    "latency_histogram",
    f"""SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n, round(sum(value), 2) AS sum FROM events, (VALUES {', '.join(f"('{b}'::DOUBLE)" for b in (*X.LATENCY_BOUNDS, 'inf'))}) b(le) WHERE value IS NOT NULL GROUP BY event_type, le""",
)
def latency_histogram(spark, sf_dir):
    return X.histogram(table(spark, sf_dir, "events"), ["event_type"], "value").withColumn("sum", F.round("sum", 2))


@query("distinct_users_bound", "SELECT event_type, count(DISTINCT user_id) AS users, true AS within FROM events GROUP BY event_type")
def distinct_users(spark, sf_dir):
    """Exact counts of users, and whether the days' merged sketches are within a twentieth of them."""
    events = table(spark, sf_dir, "events")
    _, seen = X.sketch(events.withColumn("day", F.to_date("ts")), ["day", "event_type"], "value", "user_id")
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    return exact.join(X.distinct(seen, ["event_type"]), "event_type").select("event_type", "users", (F.abs(F.col("n") - F.col("users")) <= 0.05 * F.col("users")).alias("within"))
