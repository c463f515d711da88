"""Structured lookup: questions to rows of the temporal reference tables.

Each question becomes a row of extracted features (serial number, notification, list
keyword, code, date); the first rule that applies decides its route, and each route
is one equi-join with the table it asks, so a batch of questions costs a few joins.
Not routed (null route) differs from routed without rows (``n_rows`` 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import query_date
from lodestone.operators.retrieval import measured
from lodestone.session import durable

SHOWN = 50
# The words and forms that questions are recognised by.
_CODE_WORD = r"(?i)\b(?:hsn|sac|chapter\s+heading)\s*(\d{2,8})\b"
_RATE_WORDS = r"(?i)\b(?:rate|duty|bcd|igst|cgst|sgst|gst|comp(?:ensation)?\s*cess)\s+(?:on|of|for)\b"
_NOTIFICATION = r"(?i)\b(?:notification|notif\.?|nt\.?)?\s*\b(\d{1,3})\s*/\s*(\d{4})\b\s*-?\s*(CT\(R\)|IT\(R\)|UT\(R\)|Cus|ADD)?"
_SERIAL = r"(?i)\bS\.?\s*No\.?\s*(\d+)"
_LIST_WORDS = {
    "RCM": r"(?i)\b(?:rcm|reverse\s+charge)\b", "INVERTED_DUTY": r"(?i)\binverted\s+duty\b",
    "NIL": r"(?i)\bnil[\s-]*rated\b", "EXEMPT": r"(?i)\bexempt(?:ed|ion)?\b|\bnegative\s+list\b",
}


def _found(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def code(text: Column) -> Column:
    """A code behind its keyword, else a bare one of 4, 6 or 8 digits next to a rate phrase that is no year."""
    bare = _found(text, r"\b(\d{4,8})\b", 1)
    usable = text.rlike(_RATE_WORDS) & F.length(bare).isin(4, 6, 8) & ~bare.rlike("^(?:19|20)")
    return F.coalesce(_found(text, _CODE_WORD, 1), F.when(usable, bare))


def notification(text: Column) -> Column:
    """Canonical id: number padded to two digits, year, series as stored (guessed from the words if not given)."""
    low = F.lower(text)
    given = _found(text, _NOTIFICATION, 3)
    series = (
        F.when(F.lower(given) == "cus", "Cus").when(given.isNotNull(), F.upper(given))
        .when(low.rlike("customs|\\bcus\\b|\\bbcd\\b"), "Cus").when(low.rlike("igst|integrated"), "IT(R)").when(low.contains("ut(r)"), "UT(R)").otherwise("CT(R)")
    )
    number = F.lpad(_found(text, _NOTIFICATION, 1), 2, "0")
    asked = text.rlike(r"(?i)\bnotif|\bnt\b|\d\s*/\s*\d{4}\s*-?\s*(?:CT|IT|UT|Cus|ADD)|\bS\.?\s*No")
    longer = F.when(F.length(_found(text, _NOTIFICATION, 1)) > 2, _found(text, _NOTIFICATION, 1)).otherwise(number)
    return F.when(asked & number.isNotNull(), F.concat(longer, F.lit("/"), _found(text, _NOTIFICATION, 2), F.lit("-"), series))


def features(questions: DataFrame, text: str) -> DataFrame:
    q = F.col(text)
    kind = F.coalesce(*[F.when(q.rlike(p), F.lit(k)) for k, p in _LIST_WORDS.items()])
    rows = questions.withColumns({
        "code": code(q), "notif_id": notification(q), "serial": _found(q, _SERIAL, 1).cast("int"), "list_type": kind,
        "as_of": query_date(q), "rate_phrase": q.rlike(_RATE_WORDS), "customs": F.lower(q).rlike("customs|\\bbcd\\b"),
    })
    route = (
        F.when(F.col("serial").isNotNull() & F.col("notif_id").isNotNull(), "serial").when(F.col("list_type").isNotNull(), "list")
        .when(F.col("code").isNotNull() & F.col("rate_phrase"), "rate").when(F.col("notif_id").isNotNull(), "notification")
    )
    return rows.withColumn("route", route)


def _holds(day: Column) -> Column:
    """Half-open interval at the asked day; without a day only open rows."""
    end = F.col("effective_to")
    return F.when(day.isNull(), end.isNull()).otherwise((F.col("effective_from") <= day) & (end.isNull() | (end > day)))


def answer(questions: DataFrame, id_column: str, text: str, tables: dict[str, DataFrame]) -> DataFrame:
    """id, route, n_rows (all of them), rows (JSON, the first SHOWN in order): what each question's route finds in rates, lists, exemptions and notifications.

    Questions of equal features find the same rows: each distinct set of features is
    looked up once, and questions take their answer by it.
    """
    each = features(questions, text).select(id_column, "route", F.col("code").alias("q_code"), F.col("notif_id").alias("q_notif"), "serial", F.col("list_type").alias("q_list"), F.col("as_of").cast("date").alias("day"), "customs")
    kinds = [c for c in each.columns if c != id_column]
    # As JSON a set of features is one value to group and join by, nulls left out.
    each = durable(each.select(id_column, *kinds, F.to_json(F.struct(*kinds)).alias("_asked")))
    asked = durable(each.select("_asked", *kinds).distinct())
    rates, lists, exempt, notes = (tables[k] for k in ("rates", "lists", "exemptions", "notifications"))

    def rows(of: DataFrame, source: str, order: Column) -> DataFrame:
        columns = [c for c in of.columns if c not in asked.columns]
        return of.select("_asked", F.lit(source).alias("source"), order.cast("string").alias("at"), F.to_json(F.struct(*columns)).alias("row"))

    by_serial = asked.where("route = 'serial'")
    found = [
        rows(by_serial.join(exempt, (F.col("q_notif") == F.col("notif_id")) & (F.col("serial") == F.col("sno"))), "exemptions", F.col("sno")),
        rows(by_serial.join(lists, (F.col("q_notif") == F.col("notif_id")) & (F.col("serial") == F.col("sno"))), "lists", F.col("sno")),
        rows(asked.where("route = 'list'").join(lists, (F.col("q_list") == F.col("list_type")) & (F.col("q_code").isNull() | (F.col("q_code") == F.col("code")))).where(_holds(F.lit(None).cast("date"))), "lists", F.lpad(F.col("sno").cast("string"), 9, "0")),
        rows(asked.where("route = 'rate'").join(rates, F.col("q_code") == F.col("code")).where(_holds(F.col("day"))), "rates", F.col("levy_type")),
        rows(asked.where("route = 'rate' and customs").join(exempt, F.col("q_code") == F.col("code")).where(_holds(F.col("day"))), "exemptions", F.col("sno")),
        rows(asked.where("route = 'notification'").join(notes, F.col("q_notif") == F.col("notif_id")), "notifications", F.col("notif_id")),
    ]
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    counts = every.groupBy("_asked").agg(F.count(F.lit(1)).alias("n"))
    first = Window.partitionBy("_asked").orderBy("source", "at", "row")
    few = every.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= SHOWN)
    per = few.groupBy("_asked").agg(F.array_sort(F.collect_list(F.struct("source", "at", "row"))).alias("rows"))  # SHOWN at most
    shown = F.transform(F.coalesce("rows", F.array().cast(per.schema["rows"].dataType)), lambda r: r["row"])
    found = asked.select("_asked").join(counts, "_asked", "left").join(per, "_asked", "left").select("_asked", F.coalesce("n", F.lit(0)).alias("n"), shown.alias("rows"))
    routed = F.col("route").isNotNull()
    return each.select(id_column, "route", "_asked").join(measured(found), "_asked").select(id_column, "route", F.when(routed, F.col("n")).alias("n_rows"), F.when(routed, F.col("rows")).alias("rows"))
