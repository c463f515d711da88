"""Phrases from a table, found in texts by token n-grams: thousands of phrases in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import durable, map_arrow

from .phrase_scan import PhraseTable, scanner

TOKEN = "[a-z0-9\\u00df-\\u00ff]+"
#: So many phrases go into the plan as a set of hashes; more are joined.
PHRASES_IN_PLAN, LONGEST = 10_000, 12
#: So many pairs of a topic and a phrase go to the tasks as a trie; more are joined.
PHRASES_IN_TASK = 200_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters (to U+00FF) and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def places(count: Column, n: int) -> Column:
    """0, 1, ... for each n-gram of ``count`` tokens; none if there are fewer."""
    return F.when(count >= n, F.sequence(F.lit(0), count - n)).otherwise(F.array().cast("array<int>"))


def gram_hits(texts: DataFrame, own: list[str], token_column: str, grams: DataFrame, n: int, most: int = PHRASES_IN_PLAN) -> DataFrame:
    """own columns, ``at`` and ``gram``: n-grams (tokens joined by a blank) of each text that are in ``grams`` (gram, distinct).

    Hashes of slices are tested against those of the asked grams inside the array, if
    these were counted and are ``most`` at the highest; only what passes becomes a row,
    and is then compared as a string.
    """
    count = F.size(token_column)
    piece = lambda i: F.slice(F.col(token_column), i + 1, F.lit(n))
    hashes = [r.h for r in grams.select(F.xxhash64(F.split("gram", " ")).alias("h")).limit(most + 1).collect()]
    if not hashes:
        return texts.select(*own, F.lit(0).alias("at"), F.lit("").alias("gram")).where(F.lit(False))
    at = places(count, n)
    if len(hashes) <= most:
        at = F.filter(at, lambda i: F.xxhash64(piece(i)).isin(*hashes))
    rows = texts.select(*own, token_column, F.explode(at).alias("at")).select(*own, "at", F.array_join(piece(F.col("at")), " ").alias("gram"))
    return rows.join(F.broadcast(grams) if len(hashes) <= most else grams, "gram", "left_semi").select(*own, "at", "gram")


def phrase_table(phrases: DataFrame) -> DataFrame:
    """topic, gram, place: phrases as tokens joined by a blank, each once a topic, at its first place."""
    return phrases.select("topic", "place", F.array_join(tokens(F.col("phrase")), " ").alias("gram")).where("gram <> ''").groupBy("topic", "gram").agg(F.min("place").alias("place"))


def _too_long(n: int) -> None:
    if n > LONGEST:
        raise ValueError(f"a phrase has {n} tokens; at most {LONGEST} are looked up")


def phrase_hits(docs: DataFrame, id_column: str, text: str, phrases: DataFrame) -> DataFrame:
    """id, topic, phrase, at, n, place: every occurrence of a phrase of ``phrases`` (topic, phrase, place) as whole tokens.

    Phrases are compared by their tokens; those of more than LONGEST tokens, or of none,
    are an error or are left out. Lengths that occur are a few numbers.
    """
    table = phrase_table(phrases).withColumn("n", F.size(F.split("gram", " ")))
    lengths = sorted(r.n for r in table.select("n").distinct().collect())
    _too_long(lengths[-1] if lengths else 0)
    texts = docs.select(F.col(id_column).alias("_id"), tokens(F.col(text)).alias("_tokens"))
    found = None
    for n in lengths:
        hits = gram_hits(texts, ["_id"], "_tokens", table.where(F.col("n") == n).select("gram").distinct(), n)
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = texts.select("_id", F.lit(0).alias("at"), F.lit("").alias("gram")).where(F.lit(False))
    rows = found.join(table, "gram")
    return rows.select(F.col("_id").alias(id_column), "topic", F.col("gram").alias("phrase"), "at", "n", "place")


def apart(hits: Column) -> Column:
    """Of an array of hits (at, place, n, phrase) those that a scan from the left takes: none overlaps one taken before; of hits at one place the first listed."""
    empty = F.struct(F.lit(-1).alias("end"), F.array().cast("array<string>").alias("taken"))

    def step(acc: Column, h: Column) -> Column:
        free = h["at"] >= acc["end"]
        return F.struct(F.when(free, h["at"] + h["n"]).otherwise(acc["end"]).alias("end"), F.when(free & ~F.array_contains(acc["taken"], h["phrase"]), F.concat(acc["taken"], F.array(h["phrase"]))).otherwise(acc["taken"]).alias("taken"))

    return F.aggregate(F.array_sort(hits), empty, step, lambda acc: acc["taken"])


def _scanned(docs: DataFrame, id_column: str, text: str, phrases: DataFrame, category: str | None, best: bool) -> tuple[DataFrame | None, DataFrame | None]:
    """What tasks find in whole documents without a shuffle, and the documents that are left for a join.

    The table is counted first. Rows that share an id are one document to :func:`topics`
    and are left, as are all if the table is too large for a task.
    """
    few = phrase_table(phrases).where("topic IS NOT NULL").limit(PHRASES_IN_TASK + 1).collect()
    if not few or len(few) > PHRASES_IN_TASK:
        return None, docs
    _too_long(max(r.gram.count(" ") + 1 for r in few))
    held = docs.sparkSession.sparkContext.broadcast(PhraseTable.of([(r.topic, r.gram, r.place) for r in few]))
    repeated = durable(docs.groupBy(F.col(id_column).alias("_again")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_again"))
    once, left = docs, None
    if repeated.limit(1).count():
        same = F.col(id_column).eqNullSafe(F.col("_again"))
        once, left = docs.join(repeated, same, "left_anti"), docs.join(repeated, same, "left_semi")
    given = F.lit(None).cast("string") if category is None else F.col(category).cast("string")
    rows = once.select(F.col(id_column).alias("_id"), F.array_join(tokens(F.col(text)), " ").alias("_words"), given.alias("_given"))
    columns = "primary_topic string, n_topics long, scores long" if best else "topic string, score long"
    found = map_arrow(rows, scanner(held, category is not None, best), f"_id {rows.schema['_id'].dataType.simpleString()}, {columns}")
    return found.withColumnRenamed("_id", id_column), left


def topics(docs: DataFrame, id_column: str, text: str, phrases: DataFrame, category: str | None = None) -> DataFrame:
    """id, topic, score: for each document the topics with a phrase in it, and how many distinct phrases.

    Occurrences of one topic do not overlap (:func:`apart`). With a ``category`` column
    only topics "category:..." count in documents that have one. Documents without a
    topic, null and empty texts give no row. A counted table goes to the tasks, which
    read each document once and pass on its scores alone, not its hits.
    """
    found, left = _scanned(docs, id_column, text, phrases, category, False)
    if left is None:
        return found
    rest = _joined_topics(left, id_column, text, phrases, category)
    return rest if found is None else found.unionByName(rest)


def _joined_topics(docs: DataFrame, id_column: str, text: str, phrases: DataFrame, category: str | None) -> DataFrame:
    """:func:`topics` by joins, for tables of any size."""
    hits = phrase_hits(docs, id_column, text, phrases)
    if category is not None:
        given = docs.select(F.col(id_column), F.col(category).cast("string").alias("_given"))
        hits = hits.join(given, id_column).where(F.col("_given").isNull() | (F.substring_index("topic", ":", 1) == F.col("_given"))).drop("_given")
    # A row a document and topic; its hits are as many as the text has places.
    per = hits.groupBy(id_column, "topic").agg(F.collect_list(F.struct("at", "place", "n", "phrase")).alias("hits"))
    return per.select(id_column, "topic", F.size(apart(F.col("hits"))).cast("long").alias("score"))


def primary(scored: DataFrame, id_column: str) -> DataFrame:
    """id, primary_topic, n_topics: the topic of the best score (ties: the shorter name, then the name) of each document."""
    best = F.min_by("topic", F.struct(-F.col("score"), F.length("topic"), "topic"))
    return scored.groupBy(id_column).agg(best.alias("primary_topic"), F.count(F.lit(1)).alias("n_topics"))


def summaries(docs: DataFrame, id_column: str, text: str, phrases: DataFrame) -> DataFrame:
    """id, primary_topic, n_topics, scores: :func:`primary` of :func:`topics` and the sum of scores, one row a document with a topic."""
    found, left = _scanned(docs, id_column, text, phrases, None, True)
    if left is None:
        return found
    scored = _joined_topics(left, id_column, text, phrases, None)
    rest = primary(scored, id_column).join(scored.groupBy(F.col(id_column).alias("_same")).agg(F.sum("score").alias("scores")), F.col(id_column).eqNullSafe(F.col("_same"))).drop("_same")
    return rest if found is None else found.unionByName(rest)
