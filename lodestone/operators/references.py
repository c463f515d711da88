"""References to provisions: parsed forms, alias classes of names, and matching by parent codes as equi-joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import durable

from .components import components
from .phrases import phrase_hits
from .retrieval import measured

_NOTICE, _RULE, _SECTION = r"(\d{1,3})\s*/\s*(\d{2,4})", r"(?i)\brule\s+(\d+[a-z]*(?:\s*\([^)]+\))*)", r"(?i)(?:\bsection|\bsec\.?|^)\s*(\d{1,3}[a-z]?(?:\s*\([^)]+\))*)"


def _plain(code: Column) -> Column:
    return F.nullif(F.lower(F.regexp_replace(code, r"\s+", "")), F.lit(""))


def parsed(text: Column) -> Column:
    """kind (notification, rule, section or other) and code of a reference, the first form that fits in that order; codes in lower case without blanks."""
    number, year = F.regexp_extract(text, _NOTICE, 1), F.regexp_extract(text, _NOTICE, 2)
    notice = F.when(number != "", F.concat_ws("/", number, year))
    rule, section = _plain(F.regexp_extract(text, _RULE, 1)), _plain(F.regexp_extract(text, _SECTION, 1))
    kind = F.when(notice.isNotNull(), "notification").when(rule.isNotNull(), "rule").when(section.isNotNull(), "section").otherwise("other")
    return F.struct(kind.alias("kind"), F.coalesce(notice, rule, section).alias("code"))


def ancestors(code: Column) -> Column:
    """A code and its parents, the outermost first: "16(2)(b)" gives 16, 16(2) and 16(2)(b)."""
    parts = F.regexp_extract_all(code, F.lit(r"^[^(]+|\([^)]*\)"), F.lit(0))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), ""))


def alias_classes(pairs: DataFrame) -> DataFrame:
    """name, class: names that a chain of ``pairs`` (name, alias) connects are one class, called by its least name (lower case)."""
    edges = pairs.select(F.lower("name").alias("a"), F.lower("alias").alias("b"))
    return components(edges).select(F.col("node").alias("name"), F.col("label").alias("class"))


def named_classes(rows: DataFrame, id_column: str, text: str, classes: DataFrame) -> DataFrame:
    """id, class: the classes whose names a text holds as whole tokens, each once."""
    table = classes.select(F.col("class").alias("topic"), F.col("name").alias("phrase"), F.lit(0).alias("place"))
    return phrase_hits(rows, id_column, text, table).select(id_column, F.col("topic").alias("class")).distinct()


def _code_pairs(g: DataFrame, h: DataFrame, item: str, strict: bool) -> DataFrame:
    """Pairs of rows of ``g`` (item, kind, gold_ref, code, up and more) and ``h`` (item, kind, ref, code, up and more) with matching codes; one may come more than once."""
    more = [[c for c in rows.columns if c not in (item, "kind", "code", "up")] for rows in (g, h)]
    if strict:
        keys = [item, "kind", "code"]
        down = g.select(*keys, *more[0]).join(h.select(item, "kind", *more[1], F.explode("up").alias("code")), keys)
        up = g.select(item, "kind", *more[0], F.explode("up").alias("code")).join(h.select(*keys, *more[1]), keys)
        return down.drop("kind", "code").unionByName(up.drop("kind", "code"))
    # The keys of a code: its first part, and its first two; a code of one part meets the first parts of all, deeper ones meet on two.
    deep = F.size("up") > 1
    key = lambda side, level, when: (g, h)[side].where(when).select(item, "kind", *more[side], F.get("up", F.lit(level)).alias("key"))
    join = lambda a, b: a.join(b, [item, "kind", "key"]).drop("kind", "key")
    flat = join(key(0, 0, ~deep), key(1, 0, F.lit(True)))
    outer = join(key(0, 0, deep), key(1, 0, ~deep))
    inner = join(key(0, 1, deep), key(1, 1, deep))
    return flat.unionByName(outer).unionByName(inner)


def code_matches(gold: DataFrame, hits: DataFrame, item: str, strict: bool = False) -> DataFrame:
    """Pairs of ``gold`` and ``hits`` (both: item, kind, code, ref) with matching codes, as (item, gold_ref, ref).

    Strict: equal codes, or one a parent of the other. Else codes that agree in the parts
    that both have of the first two (16(2)(b) and 16(2)(c), not 16(3)). "1" is no parent of
    "12". Every form of agreement is an equality of two codes, so sides meet in an
    equi-join on item, kind and code.
    """
    own = lambda rows, name: rows.where(F.col("code").isNotNull()).select(item, "kind", F.col("ref").alias(name), "code", ancestors(F.col("code")).alias("up"))
    return _code_pairs(own(gold, "gold_ref"), own(hits, "ref"), item, strict).select(item, "gold_ref", "ref").distinct()


def read_texts(texts: DataFrame, text: str, classes: DataFrame) -> DataFrame:
    """text, kind, code, up (the code and its parents), classes of each distinct text that names a provision.

    Written once, step by step: in one expression each use of a form would search the text
    anew, and the condition on codes would be tried on all rows before they are made distinct.
    """
    texts = durable(texts.select(text).distinct())
    forms = texts.select(text, parsed(F.col(text)).alias("p"))
    forms = durable(forms.where(F.col("p.code").isNotNull()).select(text, "p.kind", "p.code"))
    there = named_classes(forms, text, text, classes).groupBy(text).agg(F.collect_set("class").alias("classes"))
    found = forms.select(text, "kind", "code", ancestors(F.col("code")).alias("up")).join(there, text, "left")
    return durable(found.withColumn("classes", F.coalesce("classes", F.array().cast("array<string>"))))


def reference_matches(gold: DataFrame, hits: DataFrame, item: str, text: str, classes: DataFrame, strict: bool = False) -> DataFrame:
    """item, gold_ref, ref: hits that name the provision of a gold reference of their item, under a name of the same class if the gold text has one.

    ``gold`` and ``hits`` have item, ref (distinct) and a text; ``classes`` is
    :func:`alias_classes`. Texts repeat, so each distinct one is read once, and rows take
    along what was read; sides then meet in equi-joins on item, kind and code alone.
    """
    rows = [side.select(item, "ref", text).where(F.col(text).isNotNull()) for side in (gold, hits)]
    known = read_texts(rows[0].select(text).unionByName(rows[1].select(text)), text, classes)
    g, h = (side.join(measured(known), text).drop(text) for side in rows)
    g, h = g.withColumnsRenamed({"ref": "gold_ref", "classes": "wanted"}), h.withColumnRenamed("classes", "there")
    pairs = _code_pairs(durable(g), durable(h), item, strict)
    return pairs.where((F.size("wanted") == 0) | F.arrays_overlap("wanted", "there")).select(item, "gold_ref", "ref").distinct()
