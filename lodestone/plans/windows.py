"""Window queries: latches, islands, trailing counts, streaks, caps, boundaries, normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.arrays import sums_before
from lodestone.operators import dedup, islands, temporal
from lodestone.operators.ordering import positions

from .registry import Tables, query


@query(
    """
    WITH r AS (SELECT user_id, event_id, ts, avg(value) OVER w AS rolling_mean, count(value) OVER w AS n FROM events
               WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
    SELECT user_id, event_id, round(rolling_mean, 6) AS rolling_mean,
           max((n = 20 AND rolling_mean > 30)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) = 1 AS tripped FROM r"""
)
def rolling_mean_latch(t: Tables) -> DataFrame:
    rows = islands.rolling_latch(t.events, ["user_id"], ["ts", "event_id"], "value", 20, 30.0)
    return rows.select("user_id", "event_id", F.round("rolling_mean", 6).alias("rolling_mean"), "tripped")


@query(
    """
    WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM c)
    SELECT user_id, island::BIGINT AS island, any_value(event_type) AS state, min(ts) AS since, max(ts) AS until, count(*) AS n FROM i GROUP BY user_id, island"""
)
def idle_islands(t: Tables) -> DataFrame:
    rows = islands.islands(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type"))
    return rows.groupBy("user_id", "island").agg(F.first("event_type").alias("state"), F.min("ts").alias("since"), F.max("ts").alias("until"), F.count(F.lit(1)).alias("n"))


@query(
    """
    SELECT user_id, event_id, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)::BIGINT AS recent FROM events"""
)
def trailing_failures(t: Tables) -> DataFrame:
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return islands.trailing(t.events, ["user_id"], seconds, 86_400, F.col("event_type") == "error").select("user_id", "event_id", "recent")


@query(
    """
    WITH m AS (SELECT *, sum((event_type <> 'view')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events),
    s AS (SELECT user_id, event_id, sum((event_type = 'view')::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM m)
    SELECT *, CASE WHEN streak >= 3 THEN 'dead' WHEN streak >= 2 THEN 'degraded' ELSE 'ok' END AS health FROM s"""
)
def streak_health(t: Tables) -> DataFrame:
    rows = islands.streak(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type") == "view").select("user_id", "event_id", "streak")
    return rows.withColumn("health", F.when(F.col("streak") >= 3, "dead").when(F.col("streak") >= 2, "degraded").otherwise("ok"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id")
def latest_state(t: Tables) -> DataFrame:
    return temporal.latest(t.events.select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def keep_last_per_label(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_type", "event_id", "value")
    return dedup.keep_one(rows, ["user_id", "event_type"], [-F.col("event_id")]).select("user_id", "event_type", "event_id", "value")


@query(
    """
    WITH q AS (SELECT conv_id, turn, role, sha1(lower(text)) AS h FROM conversations) SELECT h AS question_hash, min(struct_pack(conv_id, turn)).conv_id AS conv_id,
    min(struct_pack(conv_id, turn)).turn AS turn FROM q WHERE role = 'user' GROUP BY h"""
)
def keep_first_question(t: Tables) -> DataFrame:
    asked = t.conversations.where("role = 'user'").select(F.sha1(F.lower("text").cast("binary")).alias("question_hash"), "conv_id", "turn")
    return dedup.keep_one(asked, ["question_hash"], [F.col("conv_id"), F.col("turn")])


@query(
    """
    WITH c AS (SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) <= 3)
    SELECT doc_id, source FROM c ORDER BY n_chars DESC, doc_id LIMIT 10"""
)
def per_source_cap(t: Tables) -> DataFrame:
    """The ten longest documents, with three of a source at most."""
    few = islands.capped(t.documents.select("doc_id", "source", "n_chars"), ["source"], [F.desc("n_chars"), F.col("doc_id")], 3)
    return few.orderBy(F.desc("n_chars"), "doc_id").limit(10).select("doc_id", "source")


@query(
    """
    WITH r AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS old_rank FROM documents),
    s AS (SELECT *, CASE WHEN lang = 'en' THEN floor(old_rank / 3.5) WHEN lang = 'fr' THEN floor(old_rank / 1.8) ELSE old_rank END AS shifted FROM r)
    SELECT doc_id, old_rank, row_number() OVER (PARTITION BY source ORDER BY shifted, old_rank) AS new_rank FROM s"""
)
def rank_shift(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "source", "lang", (-F.col("n_chars")).alias("_less"))
    ranked = positions(docs, "source", ["_less", "doc_id"], "old_rank")
    shifted = F.when(F.col("lang") == "en", F.floor(F.col("old_rank") / 3.5)).when(F.col("lang") == "fr", F.floor(F.col("old_rank") / 1.8)).otherwise(F.col("old_rank"))
    again = positions(ranked.select("doc_id", "source", "old_rank", shifted.alias("shifted")), "source", ["shifted", "old_rank"], "new_rank")
    return again.select("doc_id", "old_rank", "new_rank")


@query(
    """
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents),
    o AS (SELECT doc_id, line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM l)
    SELECT o.doc_id, line_no::BIGINT AS line_no, char_start, coalesce(lead(char_start) OVER (PARTITION BY o.doc_id ORDER BY line_no), length(text)) AS char_end FROM o JOIN documents d ON d.doc_id = o.doc_id"""
)
def line_boundaries(t: Tables) -> DataFrame:
    # Offsets are sums inside a document's array of line lengths; nothing is shuffled.
    sizes = F.transform(F.split("text", "\n"), lambda x: F.length(x))
    starts = lambda s: sums_before(F.transform(s, lambda n: n + 1))
    lines = T.let(sizes, lambda s: F.zip_with(starts(s), s, lambda at, n: F.struct(at.alias("char_start"), n.alias("size"))))
    rows = t.documents.select("doc_id", F.length("text").alias("all"), F.posexplode(lines).alias("at", "line"))
    end = F.least(F.col("line.char_start") + F.col("line.size") + 1, F.col("all").cast("long"))
    return rows.select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), "line.char_start", end.alias("char_end"))


@query(
    """
    SELECT doc_id, source, CASE WHEN max(n_chars) OVER w = min(n_chars) OVER w THEN 1.0 ELSE (n_chars - min(n_chars) OVER w) / (max(n_chars) OVER w - min(n_chars) OVER w) END AS scaled
    FROM documents WINDOW w AS (PARTITION BY source)"""
)
def min_max_within_source(t: Tables) -> DataFrame:
    # Extremes are aggregated and joined back, so a source with a third of all rows is not one window.
    ends = t.documents.groupBy("source").agg(F.min("n_chars").alias("low"), F.max("n_chars").alias("high"))
    scaled = F.when(F.col("high") == F.col("low"), 1.0).otherwise((F.col("n_chars") - F.col("low")) / (F.col("high") - F.col("low")))
    return t.documents.select("doc_id", "source", "n_chars").join(ends, "source").select("doc_id", "source", scaled.alias("scaled"))


@query(
    """
    SELECT conv_id, turn, role, turn - lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS gap, length(text) - lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS growth FROM conversations"""
)
def conversation_turn_gaps(t: Tables) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    size = F.length("text")
    return t.conversations.select("conv_id", "turn", "role", (F.col("turn") - F.lag("turn").over(w)).alias("gap"), (size - F.lag(size).over(w)).cast("long").alias("growth"))


@query(
    """
    WITH g AS (SELECT user_id, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS waited_us, row_number() OVER w AS done, epoch_us(ts) - epoch_us(first_value(ts) OVER w) AS spent, count(*) OVER (PARTITION BY user_id) AS total
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT user_id, event_id, waited_us, done, CASE WHEN spent > 0 THEN round(done / (spent / 3600000000.0), 6) END AS per_hour,
           CASE WHEN spent > 0 THEN round((total - done) / (done / (spent / 3600000000.0)), 6) END AS hours_left FROM g"""
)
def progress_rate(t: Tables) -> DataFrame:
    """Of each event of a user: the wait before it, how many are done, their rate and the time left at that rate."""
    total = t.events.groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("began"))
    rows = islands.progress(t.events.select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], F.unix_micros(F.col("ts").cast("timestamp"))).join(total, "user_id")
    hours = (F.col("at_us") - F.col("began")) / 3_600_000_000.0
    rate = F.when(hours > 0, F.col("done") / hours)
    return rows.select("user_id", "event_id", "waited_us", "done", F.round(rate, 6).alias("per_hour"), F.round((F.col("total") - F.col("done")) / rate, 6).alias("hours_left"))


@query(
    """
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket_start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value, max(value) AS max_value FROM events GROUP BY ALL"""
)
def hourly_telemetry(t: Tables) -> DataFrame:
    hours = t.events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("max_value"))
    return hours.select(F.col("w.start").alias("bucket_start"), "event_type", "n", "mean_value", "max_value")


@query(
    """
    WITH s AS (SELECT user_id, array_agg(DISTINCT event_type ORDER BY event_type) FILTER (ts < TIMESTAMP '2024-01-15') AS a, array_agg(DISTINCT event_type ORDER BY event_type) FILTER (ts >= TIMESTAMP '2024-01-15') AS b FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN greatest(len(coalesce(a, [])), len(coalesce(b, []))) = 0 THEN 0.0
           ELSE 1 - len(list_intersect(coalesce(a, []), coalesce(b, []))) / greatest(len(coalesce(a, [])), len(coalesce(b, []))) END AS divergence FROM s"""
)
def overlap_divergence(t: Tables) -> DataFrame:
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    sets = t.events.groupBy("user_id").agg(F.collect_set(F.when(early, F.col("event_type"))).alias("a"), F.collect_set(F.when(~early, F.col("event_type"))).alias("b"))
    return sets.select("user_id", T.overlap_divergence(F.col("a"), F.col("b")).alias("divergence"))


@query(
    """
    WITH g AS (SELECT user_id, event_id, ts, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) SELECT user_id, event_id FROM g WHERE gap IS NULL OR gap >= INTERVAL 6 HOUR"""
)
def throttled_heartbeats(t: Tables) -> DataFrame:
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return islands.spaced(t.events.select("user_id", "event_id", "ts"), ["user_id"], ["ts", "event_id"], micros, 21_600_000_000).select("user_id", "event_id")


@query(
    """
    WITH c AS (SELECT *, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS ch FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    i AS (SELECT *, sum(ch) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM c)
    SELECT user_id, min(ts) + INTERVAL 1 HOUR AS action_at, count(*) AS n FROM i WHERE event_type = 'view' GROUP BY user_id, island HAVING max(ts) - min(ts) >= INTERVAL 1 HOUR"""
)
def idle_actions(t: Tables) -> DataFrame:
    """When an action falls due: an hour into every idle stretch of an hour or more."""
    rows = islands.islands(t.events, ["user_id"], ["ts", "event_id"], F.col("event_type")).where("event_type = 'view'")
    spans = rows.groupBy("user_id", "island").agg(F.min("ts").alias("since"), F.max("ts").alias("until"), F.count(F.lit(1)).alias("n"))
    due = F.expr("since + interval 1 hour")
    return spans.where(F.col("until") >= due).select("user_id", due.alias("action_at"), "n")


@query(
    """
    SELECT event_type, event_id, count(*) OVER w AS n, round(avg(value) OVER w, 6) AS mean_value FROM events WINDOW w AS (PARTITION BY event_type ORDER BY floor(epoch(ts))::BIGINT RANGE BETWEEN 59 PRECEDING AND CURRENT ROW)"""
)
def trailing_requests(t: Tables) -> DataFrame:
    """Of each request: how many of its kind came in the last 60 seconds and their mean latency."""
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    rows = islands.trailing_stats(t.events.select("event_type", "event_id", "ts", "value"), ["event_type"], seconds, 60, F.col("value"))
    return rows.select("event_type", "event_id", F.col("recent").alias("n"), F.round("recent_mean", 6).alias("mean_value"))
