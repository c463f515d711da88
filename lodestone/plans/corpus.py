"""Corpus queries: chunkers, page texts, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import chunking, islands, packing
from lodestone.sources import readers
from lodestone.streaming import monitors

from .registry import Tables, query


def _stepped_sql(stop: str, overlap: int, floor: str) -> str:
    """Windows as a recursion: ``stop`` gives a window's end of text t, length n and start a."""
    return f"""
        WITH RECURSIVE d AS (SELECT doc_id, text AS t, length(text) AS n FROM documents WHERE trim(text, ' ' || chr(9) || chr(10) || chr(12) || chr(13)) <> ''),
        s(doc_id, a, b) AS (
            SELECT doc_id, a, {stop} FROM (SELECT *, 0::BIGINT AS a FROM d)
            UNION ALL SELECT doc_id, a, {stop} FROM (SELECT d.*, greatest(s.b - {overlap}, s.a + 1) AS a FROM s JOIN d ON d.doc_id = s.doc_id WHERE s.b < d.n)),
        p AS (SELECT s.*, n, substr(t, a + 1, b - a) AS piece FROM s JOIN d ON d.doc_id = s.doc_id)
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1)::BIGINT AS chunk_no, a AS char_start, b AS char_end, sha256(piece) AS chunk_sha
        FROM p WHERE length(trim(piece, ' ' || chr(9) || chr(10) || chr(12) || chr(13))) >= {floor}"""


def _windows(t: Tables, method: str) -> DataFrame:
    places = [F.col(c).cast("long").alias(c) for c in ("chunk_no", "char_start", "char_end")]
    return chunking.chunk(t.documents, "doc_id", "text", method).select("doc_id", *places, F.sha2(F.col("text").cast("binary"), 256).alias("chunk_sha"))


_NEXT = "substr(t, a + 1801, 600)"
_LAST = "instr(reverse(substr(t, a + 251, 250)), '{}')"
_SEPARATORS = " ".join(f"WHEN {_LAST.format(s)} > 0 THEN a + 501 - {_LAST.format(s)}" for s in (" .", " !", " ?", "\n"))


@query(
    _stepped_sql(
        f"CASE WHEN a + 1800 >= n THEN n WHEN instr({_NEXT}, chr(10) || chr(10)) > 0 THEN a + 1799 + instr({_NEXT}, chr(10) || chr(10))"
        f" ELSE a + 1800 + length(regexp_extract({_NEXT}, '^(?s:.*)[.?!][ \\t\\n\\r\\f]+')) END",
        270, "60",
    )
)
def chunk_char_window(t: Tables) -> DataFrame:
    return _windows(t, "char_windows")


@query(
    _stepped_sql(
        "CASE WHEN a + 500 >= n THEN n WHEN instr(reverse(substr(t, a + 1, 500)), ' .') BETWEEN 1 AND 248 THEN a + 500 - instr(reverse(substr(t, a + 1, 500)), ' .') ELSE a + 500 END",
        50, "CASE WHEN n > 500 THEN 50 ELSE 1 END",
    )
)
def chunk_half_window(t: Tables) -> DataFrame:
    return _windows(t, "half_windows")


@query(_stepped_sql(f"CASE WHEN a + 500 >= n THEN n {_SEPARATORS} ELSE a + 500 END", 50, "60"))
def chunk_separators(t: Tables) -> DataFrame:
    return _windows(t, "separator_windows")


@query()
def chunk_words(t: Tables) -> DataFrame:
    return chunking.chunk(t.documents, "doc_id", "text", "packed").select("doc_id", "chunk_no", "char_start", "char_end", F.length("text").alias("chars"))


@query()
def chunk_sections(t: Tables) -> DataFrame:
    return chunking.chunk(t.documents, "doc_id", "text", "sections", texts=False).select("doc_id", "chunk_no", "char_start", "char_end", "section")


@query()
def chunk_two_pass(t: Tables) -> DataFrame:
    return chunking.chunk(t.documents, "doc_id", "text", "two_pass", texts=False).select("doc_id", "chunk_no", "char_start", "char_end", "kind")


@query()
def chunk_hierarchy(t: Tables) -> DataFrame:
    return chunking.chunk(t.documents, "doc_id", "text", "hierarchy", texts=False).select("doc_id", "chunk_no", "char_start", "char_end", "section")


_HEADS = "The |Est |Und |Las |In |An "


@query(
    r"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '(?m)^([ \t]*(?:HEADS))', chr(1) || '\1', 'g'), chr(1)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps FROM documents),
    f(doc_id, i, buf, done) AS (SELECT doc_id, 0::BIGINT, '', NULL::VARCHAR FROM d
        UNION ALL SELECT f.doc_id, i + 1, CASE WHEN i = len(ps) THEN '' WHEN length(buf) + length(ps[i + 1]) + 2 <= 1400 AND buf <> '' THEN buf || chr(10) || chr(10) || ps[i + 1] ELSE ps[i + 1] END,
                         CASE WHEN buf <> '' AND (i = len(ps) OR length(buf) + length(ps[i + 1]) + 2 > 1400) THEN buf END FROM f JOIN d ON d.doc_id = f.doc_id WHERE i <= len(ps)),
    c AS (SELECT doc_id, i, done FROM f WHERE done IS NOT NULL), l AS (SELECT doc_id, i, string_split_regex(done, '\n\n+') AS qs FROM c WHERE length(done) > 2200),
    g(doc_id, i, j, buf, done) AS (SELECT doc_id, i, 0::BIGINT, '', NULL::VARCHAR[] FROM l
        UNION ALL SELECT g.doc_id, g.i, j + 1,
            CASE WHEN j = len(qs) THEN '' WHEN length(buf) + length(qs[j + 1]) + 2 <= 1400 THEN CASE WHEN buf = '' THEN qs[j + 1] ELSE regexp_replace(buf || chr(10) || chr(10) || qs[j + 1], '^\s+|\s+$', '', 'g') END
                 ELSE substr(qs[j + 1], greatest(ceil(length(qs[j + 1]) / 2200)::BIGINT - 1, 0) * 2200 + 1, 2200) END,
            CASE WHEN j = len(qs) OR length(buf) + length(qs[j + 1]) + 2 > 1400 THEN list_concat(CASE WHEN buf <> '' THEN [buf] ELSE [] END,
                 CASE WHEN j < len(qs) THEN list_transform(range(0, greatest(ceil(length(qs[j + 1]) / 2200)::BIGINT - 1, 0)), lambda k: substr(qs[j + 1], k * 2200 + 1, 2200)) ELSE [] END) END
            FROM g JOIN l ON l.doc_id = g.doc_id AND l.i = g.i WHERE j <= len(qs)),
    o AS (SELECT doc_id, i, 0::BIGINT AS j, 0::BIGINT AS k, done AS chunk FROM c WHERE length(done) <= 2200 UNION ALL SELECT doc_id, i, j, unnest(range(0, len(done))), unnest(done) FROM g WHERE len(done) > 0)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, j, k) - 1 AS chunk_no, length(chunk) AS chars, sha256(chunk) AS chunk_sha FROM o WHERE length(chunk) >= 120""".replace("HEADS", _HEADS)
)
def packed_sections(t: Tables) -> DataFrame:
    """Documents cut at lines that begin a section, packed to 1,400 characters and cut at 2,200."""
    chunks = packing.section_chunks(F.col("text"), _HEADS)
    rows = t.documents.where("text is not null").select("doc_id", F.posexplode(chunks).alias("chunk_no", "chunk"))
    return rows.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.length("chunk").cast("long").alias("chars"), F.sha2(F.col("chunk").cast("binary"), 256).alias("chunk_sha"))


_CHAPTER, _SECTION, _ANCHOR = "^The ([a-z]+)", "^(?:In|Est|Und|Las) ([a-z]+)", "([a-z]+)[?!]"


@query(
    r"""
    WITH RECURSIVE d AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') AS ps FROM documents),
    p AS (SELECT doc_id, i, p, len(ps) AS m, CASE WHEN regexp_matches(p, 'CHAPTER') THEN regexp_extract(p, 'CHAPTER', 1) END AS c, CASE WHEN regexp_matches(p, 'SECTION') THEN regexp_extract(p, 'SECTION', 1) END AS s,
          CASE WHEN regexp_matches(p, 'ANCHOR') THEN regexp_extract(p, 'ANCHOR', 1) END AS x, len(regexp_extract_all(p, '\S+')) AS w FROM (SELECT doc_id, ps, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM d)),
    f(doc_id, i, buf, n, chapter, section, anchor, outs) AS (
        SELECT doc_id, 0::BIGINT, '', 0::BIGINT, '', '', '', NULL::STRUCT(t VARCHAR, c VARCHAR, s VARCHAR, x VARCHAR)[] FROM d
        UNION ALL SELECT doc_id, i, CASE WHEN nn >= 180 THEN array_to_string(list_slice(regexp_extract_all(buf, '\S+'), -30, -1), ' ') ELSE buf END, CASE WHEN nn >= 180 THEN least(len(regexp_extract_all(buf, '\S+')), 30) ELSE nn END, chapter, section, anchor,
            list_concat(early, CASE WHEN nn >= 180 OR (i = m AND nn > 20) THEN [{'t': buf, 'c': chapter, 's': section, 'x': anchor}] ELSE [] END, CASE WHEN nn >= 180 AND i = m AND least(len(regexp_extract_all(buf, '\S+')), 30) > 20 THEN [{'t': array_to_string(list_slice(regexp_extract_all(buf, '\S+'), -30, -1), ' '), 'c': chapter, 's': section, 'x': anchor}] ELSE [] END)
        FROM (SELECT f.doc_id, p.i, p.m, CASE WHEN turn THEN array_to_string(list_slice(ws, -30, -1), ' ') || CASE WHEN len(ws) > 0 THEN ' ' ELSE '' END || p.p WHEN f.n > 0 THEN f.buf || ' ' || p.p ELSE p.p END AS buf, CASE WHEN turn THEN least(len(ws), 30) ELSE f.n END + p.w AS nn,
                     coalesce(p.c, f.chapter) AS chapter, coalesce(p.s, f.section) AS section, coalesce(p.x, f.anchor) AS anchor, CASE WHEN turn THEN [{'t': f.buf, 'c': f.chapter, 's': f.section, 'x': f.anchor}] ELSE [] END AS early
              FROM (SELECT f.*, regexp_extract_all(buf, '\S+') AS ws FROM f) f JOIN (SELECT *, c IS NOT NULL OR s IS NOT NULL AS head FROM p) p ON p.doc_id = f.doc_id AND p.i = f.i + 1, LATERAL (SELECT p.head AND f.n > 60 AS turn))),
    o AS (SELECT doc_id, i, unnest(range(0, len(outs))) AS k, unnest(outs) AS r FROM f WHERE len(outs) > 0)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1 AS chunk_no, r.c AS chapter, r.s AS section, r.x AS anchor, sha256(r.t) AS chunk_sha FROM o""".replace("CHAPTER", _CHAPTER).replace("SECTION", _SECTION).replace("ANCHOR", _ANCHOR)
)
def heading_state_chunks(t: Tables) -> DataFrame:
    """Chunks of some 180 words with the chapter, section and anchor that are current at their end."""
    paragraphs = F.filter(F.transform(F.split("text", "\n"), packing.stripped), lambda p: p != "")
    chunks = packing.hierarchy_chunks(paragraphs, _CHAPTER, _SECTION, _ANCHOR)
    rows = t.documents.where("text is not null").select("doc_id", F.posexplode(chunks).alias("chunk_no", "c"))
    return rows.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "c.chapter", "c.section", "c.anchor", F.sha2(F.col("c.text").cast("binary"), 256).alias("chunk_sha"))


@query()
def html_text(t: Tables) -> DataFrame:
    return readers.html_text(t.pages, "page_id", "html").select("page_id", F.length("text").alias("chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS bucket_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_telemetry(t: Tables) -> DataFrame:
    rows = monitors.run_once(monitors.telemetry(monitors.event_stream(t.spark, t.sf_dir)), "update")
    # Each window's last update counts.
    last = rows.groupBy("bucket_start", "event_type").agg(F.max_by(F.struct("n", "total"), "_batch").alias("r"))
    return last.select(F.col("bucket_start").cast("timestamp_ntz").alias("bucket_start"), "event_type", "r.n", F.round("r.total", 4).alias("total"))


@query(
    """
    WITH r AS (SELECT user_id, ts, event_id, avg(value) OVER w AS m, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
    SELECT user_id, count(*) AS seen, round(arg_max(m, (ts, event_id)), 6) AS rolling_mean, bool_or(n = 20 AND m > 30) AS tripped FROM r GROUP BY user_id"""
)
def stream_latch(t: Tables) -> DataFrame:
    rows = monitors.run_once(monitors.latched(monitors.controlled(monitors.event_stream(t.spark, t.sf_dir))), "update")
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("seen", "rolling_mean", "tripped"), "seen").alias("r"))
    return last.select("user_id", "r.seen", F.round("r.rolling_mean", 6).alias("rolling_mean"), "r.tripped")


_CONTROLS = """
    WITH e AS (SELECT *, epoch_us(ts) AS us, CASE WHEN event_type = 'error' AND value > 120 THEN 'kill' WHEN event_type = 'signup' AND value > 60 THEN 'resume' END AS control FROM events),
    p AS (SELECT *, count(*) FILTER (control = 'resume') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS epoch FROM e),
    v AS (SELECT event_id, avg(value) OVER w AS m, count(*) OVER w AS n FROM p WHERE control IS NULL WINDOW w AS (PARTITION BY user_id, epoch ORDER BY ts, event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    r AS (SELECT p.*, m, min(CASE WHEN n = 20 AND m > 60 THEN us END) OVER w AS first, max(CASE WHEN control = 'kill' THEN us END) OVER w AS killed, last_value(m IGNORE NULLS) OVER w AS mean,
          count(*) FILTER (control IS NULL) OVER (PARTITION BY user_id ORDER BY ts, p.event_id ROWS UNBOUNDED PRECEDING) AS seen
          FROM p LEFT JOIN v ON v.event_id = p.event_id WINDOW w AS (PARTITION BY user_id, epoch ORDER BY ts, p.event_id ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT user_id, event_id, ts, seen, round(mean, 6) AS rolling_mean, coalesce(killed, first) IS NOT NULL AS tripped, CASE WHEN killed IS NOT NULL THEN 'manual' WHEN first IS NOT NULL THEN 'mean' END AS reason, coalesce(killed, first) AS since_us FROM r)"""


def _controls(rows: DataFrame) -> DataFrame:
    """Large errors kill, large sign-ups resume; all other events are values."""
    return monitors.controlled(rows, (F.col("event_type") == "error") & (F.col("value") > 120), (F.col("event_type") == "signup") & (F.col("value") > 60))


@query(_CONTROLS + " SELECT user_id, event_id, rolling_mean, tripped, reason, since_us FROM s")
def latch_with_controls(t: Tables) -> DataFrame:
    rows = islands.controlled_latch(_controls(t.events), ["user_id"], ["ts", "event_id"], "value", "control", F.unix_micros(F.col("ts").cast("timestamp")), 20, 60.0)
    return rows.select("user_id", "event_id", F.round("rolling_mean", 6).alias("rolling_mean"), "tripped", "reason", "since_us")


@query(_CONTROLS + " SELECT user_id, max(seen) AS seen, arg_max(struct_pack(x := rolling_mean), (ts, event_id)).x AS rolling_mean, arg_max(tripped, (ts, event_id)) AS tripped, arg_max(struct_pack(x := reason), (ts, event_id)).x AS reason, arg_max(struct_pack(x := since_us), (ts, event_id)).x AS since_us FROM s GROUP BY user_id")
def stream_latch_controls(t: Tables) -> DataFrame:
    """The switch of each user after a stream of values, kills and resumes."""
    rows = monitors.run_once(monitors.latched(_controls(monitors.event_stream(t.spark, t.sf_dir)), 20, 60.0), "update")
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("seen", "rolling_mean", "tripped", "reason", "since_us"), "_batch").alias("r"))
    return last.select("user_id", "r.seen", F.round("r.rolling_mean", 6).alias("rolling_mean"), "r.tripped", "r.reason", "r.since_us")


_IDLE_SQL = """
    WITH t AS (SELECT user_id, event_id, ts, floor(epoch_us(ts) / 1000)::BIGINT AS ms FROM events),
    e AS (SELECT user_id, ms, lead(ms) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next, max(ms) OVER () - 3600000 AS upto FROM t)
    SELECT user_id, ms AS idle_since_ms, ms + 21600000 AS action_at_ms FROM e WHERE ms + 21600000 <= coalesce(next, upto)"""


@query(_IDLE_SQL)
def idle_timeouts(t: Tables) -> DataFrame:
    """Actions after six silent hours of a user, as far as the events show them (an hour back from the last). Moments are whole milliseconds, those begun: what timers and watermarks count."""
    millis = F.unix_millis(F.col("ts").cast("timestamp"))
    upto = t.events.agg((F.max(millis) - 3_600_000).alias("upto"))
    rows = t.events.select("user_id", "ts", "event_id").join(F.broadcast(upto))  # one row
    return islands.silences(rows, ["user_id"], ["ts", "event_id"], millis, 21_600_000, F.col("upto")).select("user_id", "idle_since_ms", "action_at_ms")


@query(_IDLE_SQL)
def stream_idle_timers(t: Tables) -> DataFrame:
    """The same from a stream with a timer a user."""
    return monitors.run_once(monitors.idle_actions(monitors.event_stream(t.spark, t.sf_dir), 360), "append").select("user_id", "idle_since_ms", "action_at_ms")


@query("SELECT user_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def stream_latest_state(t: Tables) -> DataFrame:
    newest = -1

    def sink(batch: DataFrame, number: int, path: str) -> None:
        nonlocal newest
        monitors.merge_latest(batch.select("user_id", "ts", "event_type", "value", "event_id"), path, ["user_id"], ["ts", "event_id"], number)
        newest = number

    path = monitors.run(monitors.event_stream(t.spark, t.sf_dir), "append", sink)
    return t.spark.read.parquet(f"{path}/{newest}").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
