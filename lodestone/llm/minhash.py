"""MinHash near-dedup: one-permutation hashing, optimal densification, banded buckets, star-shaped candidates.

Documents with equal shingle sets collapse to one class first, so copies cost nothing
further on. Each bucket links its members to one hub only, so it makes one pair a
member, however full it is; pairs are confirmed on full shingle sets. What a star can
miss is two members of a bucket that are close to each other and not to the hub: the
members of buckets that the confirmed links leave in more than one component are
joined exactly, on their rarest shingles (prefix filter with size and place bounds),
so no bucket is capped and no link between its members is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.components import components
from lodestone.operators.ordering import running_totals

from .common import WORD, durable, keep_marked, map_arrow, row_marks
from .textarrays import Texts, U64, byte_prefix, mix64, slices, word_prefix

SHINGLE, BINS, ROWS = 5, 128, 4
NUMERATOR, DENOMINATOR = 75, 100
MEMBERS_A_TASK, TOKENS_AT_ONCE, TEXT_AT_ONCE = 256, 500_000, 1 << 18
#: Set sizes of one band differ by this factor at most.
BAND = 1.05


def shingle_sets(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct word shingles of each document, ascending, one document after another; and their bounds.

    Words are lower-cased (A-Z only). A document of one to four words has its whole
    sequence as one shingle; one without words has none.
    """
    low = texts.lowered()
    starts, ends, docs = low.words()
    n = len(starts)
    prefix = word_prefix(byte_prefix(low.data).of(starts, ends))
    per = np.bincount(docs, minlength=texts.n)
    first = np.cumsum(per) - per
    i = np.arange(max(0, n - SHINGLE + 1))
    i = i[docs[i] == docs[i + SHINGLE - 1]]
    short = np.flatnonzero((per > 0) & (per < SHINGLE))
    codes = np.concatenate((prefix.of(i, i + SHINGLE), prefix.of(first[short], first[short] + per[short])))
    owner = np.concatenate((docs[i], short))
    order = np.lexsort((codes, owner))
    codes, owner = codes[order], owner[order]
    new = np.ones(len(codes), dtype=bool)
    new[1:] = (codes[1:] != codes[:-1]) | (owner[1:] != owner[:-1])
    codes, owner = codes[new], owner[new]
    return codes, np.searchsorted(owner, np.arange(texts.n + 1))


def signatures(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One-permutation signatures: the smallest hash of each bin, empty bins filled by optimal densification.

    The bin is drawn from one hash of the shingle and the value from another. An empty
    bin borrows from a bin drawn by a hash of its own number and the attempt, so two
    sets that agree borrow alike. Rows of empty sets hold no meaning.
    """
    n = len(bounds) - 1
    value = mix64(codes ^ U64(0x5851F42D4C957F2D))
    owner = np.repeat(np.arange(n), np.diff(bounds))
    table = np.full(n * BINS, U64(2**64 - 1))
    np.minimum.at(table, owner * BINS + (codes >> U64(57)).astype(np.int64), value)
    table = table.reshape(n, BINS)
    filled = table != U64(2**64 - 1)
    row, col = np.nonzero(~filled & (np.diff(bounds) > 0)[:, None])
    attempt = 0
    while len(row):
        attempt += 1
        source = (mix64(col.astype(U64) * U64(1_000_003) + U64(attempt)) % U64(BINS)).astype(np.int64)
        found = filled[row, source]
        table[row[found], col[found]] = table[row[found], source[found]]
        row, col = row[~found], col[~found]
    return table


def band_keys(table: np.ndarray) -> np.ndarray:
    """A key for each band of ROWS bins; the band's number is part of it."""
    bands = table.reshape(len(table), BINS // ROWS, ROWS)
    key = np.broadcast_to(np.arange(BINS // ROWS, dtype=U64) + U64(11), bands.shape[:2]).copy()
    for r in range(ROWS):
        key = mix64(key * U64(0x9E3779B97F4A7C15) ^ bands[:, :, r])
    return key


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in slices(batch.column("text"), TEXT_AT_ONCE):
            codes, bounds = shingle_sets(texts)
            keys = band_keys(signatures(codes, bounds)).view(np.int64)
            filled = np.diff(bounds) > 0
            sums = np.concatenate((np.zeros(1, dtype=U64), np.cumsum(codes, dtype=U64)))
            mixed = np.concatenate((np.zeros(1, dtype=U64), np.cumsum(mix64(codes ^ U64(0xA5A5A5A5A5A5A5A5)), dtype=U64)))
            lists = pa.ListArray.from_arrays(pa.array((np.concatenate(([0], np.cumsum(filled))) * keys.shape[1]).astype(np.int32)), pa.array(keys[filled].ravel()))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(texts.first, texts.n), pa.array(np.diff(bounds)),
                    pa.array((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)), pa.array((mixed[bounds[1:]] - mixed[bounds[:-1]]).view(np.int64)), lists,
                    batch.column("_mark_a").slice(texts.first, texts.n), batch.column("_mark_b").slice(texts.first, texts.n),
                ],
                ["doc_id", "n_shingles", "key_a", "key_b", "bands", "_mark_a", "_mark_b"],
            )


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in slices(batch.column("text"), TEXT_AT_ONCE):
            codes, bounds = shingle_sets(texts)
            sets = pa.Array.from_buffers(pa.binary(), texts.n, [None, pa.py_buffer((bounds * 8).astype(np.int32)), pa.py_buffer(codes)])
            yield pa.RecordBatch.from_arrays([batch.column("node").slice(texts.first, texts.n), sets], ["node", "codes"])


def _close(a: np.ndarray, b: np.ndarray) -> bool:
    if DENOMINATOR * min(len(a), len(b)) < NUMERATOR * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (len(a) + len(b) - both)


def _against_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by hub and part, the hub's own set first; each member is compared as it passes."""
    at, hub_codes = None, None
    for batch in batches:
        hub, part, role, node = (batch.column(k).to_pylist() for k in ("hub", "part", "role", "node"))
        codes, found = batch.column("codes"), []
        for i in range(batch.num_rows):
            own = np.frombuffer(codes[i].as_buffer(), dtype=U64)
            if (hub[i], part[i]) != at:
                at, hub_codes = (hub[i], part[i]), None
            if role[i] == 0:
                hub_codes = own.copy()
            elif hub_codes is not None and _close(own, hub_codes):
                found.append((node[i], hub[i]))
        if found:
            a, b = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (node, hub) that are close on full sets, as edges (a, b).

    Sets are dealt by hub; a hub with many members is dealt in parts, each with a copy
    of the hub's set, so that no task gets all of them.
    """
    members = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("members"))
    parts = F.ceil(F.col("members") / MEMBERS_A_TASK).cast("int")
    dealt = pairs.join(members, "hub").select("node", "hub", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), F.lit(1).alias("role"))
    heads = members.select(F.col("hub").alias("node"), "hub", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("role"))
    rows = dealt.unionByName(heads).join(sets, "node")
    rows = rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "role")
    return map_arrow(rows.select("hub", "part", "role", "node", "codes"), _against_hub, "a long, b long")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of each set, some hundred thousand at once."""
    for batch in batches:
        node, label, column = np.asarray(batch.column("node")), np.asarray(batch.column("label")), batch.column("codes")
        bounds = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 8
        codes = np.frombuffer(column.buffers()[2], dtype=np.int64) if len(column) else np.zeros(0, dtype=np.int64)
        i = 0
        while i < len(column):
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + TOKENS_AT_ONCE, side="right")) - 1)
            n = np.diff(bounds[i : j + 1])
            columns = [np.repeat(node[i:j], n), np.repeat(label[i:j], n), np.repeat(n, n).astype(np.int32), codes[bounds[i] : bounds[j]]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["node", "label", "n", "code"])
            i = j


def rest_pairs(multi: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (node, hub) that may still join components: members of buckets with several components, by shared rare shingles.

    Shingles are ordered by frequency among these members. A close pair shares one in
    the first quarter of both, at places that leave enough to share. Each place is held
    against the sizes that a partner can have, a band of sizes at a time, before anything
    meets: a shingle that stands too far back for partners of a band is not sent to it,
    so the common text of a family of letters pairs none of them. Sides meet on shingle
    and both bands; exact sizes, places and components are compared inside the join.
    """
    member = multi.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = member.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x != y").select("key")
    nodes = member.join(mixed, "key", "left_semi").select("node", "label").distinct()
    own = nodes.join(sets, "node").dropDuplicates(["node"])
    tokens = durable(map_arrow(own, _tokens, "node long, label long, n int, code long"))
    spread = tokens.groupBy("code").agg(F.count(F.lit(1)).alias("f"), F.min("label").alias("x"), F.max("label").alias("y"))
    common = spread.where("f > 1").select("code", "f", (F.col("x") != F.col("y")).alias("mixed"))
    ranked = tokens.join(common, "code", "left").select("node", "label", "n", "code", F.coalesce("f", F.lit(1)).alias("f"), F.coalesce("mixed", F.lit(False)).alias("mixed"))
    by_node = Window.partitionBy("node").orderBy("f", "code")
    placed = ranked.withColumn("place", F.row_number().over(by_node) - 1)
    short = F.col("n") - F.ceil(F.col("n") * NUMERATOR / DENOMINATOR) + 1
    prefix = placed.where(F.col("mixed") & (F.col("place") < short)).select("node", "label", "n", "code", "place")
    band = lambda n: F.floor(F.log(n) / F.log(F.lit(BAND))).cast("int")
    least, most = F.ceil(F.col("n") * NUMERATOR / DENOMINATOR), F.floor(F.col("n") * DENOMINATOR / NUMERATOR)
    sent = prefix.select("*", band(F.col("n")).alias("own"), F.explode(F.sequence(band(least), band(most))).alias("other"))
    smallest = F.greatest(least, F.floor(F.pow(F.lit(BAND), F.col("other"))) - 1)  # no partner of the band is smaller
    sent = sent.where((F.col("n") - F.col("place")) * (NUMERATOR + DENOMINATOR) >= (F.col("n") + smallest) * NUMERATOR)
    left, right = sent.where("own <= other").alias("l"), sent.where("own >= other").alias("r")
    total = F.col("l.n") + F.col("r.n")
    left_over = F.least(F.col("l.n") - F.col("l.place"), F.col("r.n") - F.col("r.place"))
    may = (
        (F.col("l.code") == F.col("r.code")) & (F.col("l.own") == F.col("r.other")) & (F.col("l.other") == F.col("r.own"))
        & ((F.col("l.own") < F.col("r.own")) | (F.col("l.node") < F.col("r.node"))) & (F.col("l.label") != F.col("r.label"))
        & (F.least("l.n", "r.n") * DENOMINATOR >= F.greatest("l.n", "r.n") * NUMERATOR)
        & (left_over * (NUMERATOR + DENOMINATOR) >= total * NUMERATOR)
    )
    return left.join(right, may).select(F.greatest("l.node", "r.node").alias("node"), F.least("l.node", "r.node").alias("hub")).distinct()


def _near(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, the number of its component (null in none) and the marks of each row.

    A node is a class of rows with one shingle set; its number stands for the class's
    first row, which is known by its marks, since a doc_id may name several texts.
    """
    marks = ["_mark_a", "_mark_b"]
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *row_marks(docs))
    signed = durable(map_arrow(plain, _signed, "doc_id long, n_shingles long, key_a long, key_b long, bands array<long>, _mark_a long, _mark_b long"))
    usable = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    same = ["n_shingles", "key_a", "key_b"]
    heads = usable.groupBy(*same).agg(F.min(F.struct("doc_id", *marks)).alias("_h"))
    heads = heads.select(*same, F.col("_h.doc_id").alias("first_id"), "_h._mark_a", "_h._mark_b", F.lit(1).alias("_one"))
    # Numbers follow the ids, so a bucket's hub is its first document: copies mostly come after what they are copied from.
    classes = durable(running_totals(heads, ["first_id", *marks], {"node": "_one"}).drop("_one"))
    # Bands and texts are those of the class's first row: a join on marks, not an aggregate that carries arrays.
    banded = usable.join(classes.select("node", *marks), marks).select("node", F.explode("bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub != top").select("key", "hub")
    multi = durable(banded.join(hubs, "key").distinct())
    wanted = classes.join(multi.select("node").distinct(), "node").select("node", *marks)
    sets = durable(map_arrow(plain.join(wanted, marks).select("node", "text"), _set_rows, "node long, codes binary"))
    links = durable(confirm(multi.where("node != hub").select("node", "hub").distinct(), sets))
    labels = components(links)
    more = confirm(rest_pairs(multi, labels, sets), sets)
    labels = components(links.unionByName(more))
    linked = labels.join(classes.select("node", "first_id"), "node")
    least = linked.groupBy("label").agg(F.min("first_id").alias("component"))
    of_node = linked.join(least, "label").select("node", "component", "label")
    of_class = classes.join(of_node, "node", "left").select(*same, F.coalesce("component", "first_id").alias("component"), F.coalesce("label", "node").alias("_group"))
    joined = signed.alias("s").join(of_class.alias("c"), [F.col(f"s.{c}") == F.col(f"c.{c}") for c in same], "left")
    component = F.when(F.col("doc_id").isNotNull() & (F.col("s.n_shingles") > 0), F.col("c.component")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", F.col("s.n_shingles").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "c._group", *marks)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Null texts and texts without words have no shingles and link with nothing. A null
    doc_id links with nothing and stays. Rows that repeat a doc_id are documents of
    their own, each linked by its own text. Other columns are ignored; an empty table
    gives an empty result.
    """
    return _near(docs).select("doc_id", "n_shingles", "component_id", "kept")


def keep_representatives(docs: DataFrame) -> DataFrame:
    """The documents with one of each group of near duplicates, all columns unchanged.

    It is the one whose doc_id names the group; of several rows of the group with that
    doc_id one stays. Rows without words or without a doc_id are in no group and all stay.
    An empty table gives an empty result.
    """
    alone = F.col("doc_id").isNull() | ~F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    near = _near(docs.where(~alone)).where("kept")
    return docs.where(alone).unionByName(keep_marked(docs.where(~alone), near, "_group"))
