"""Embedding near-dedup with randomised-rotation binary codes and stored correction factors.

A unit vector is turned by a random rotation; the signs are its code and its inner
product with the code's unit vector is the stored correction factor. Of another vector
the turned components are rounded to a few bits, whose planes meet the code by AND and
popcount; that product over the factor estimates the cosine without bias. How far the
estimate can be off is known: the part of a vector beside its code meets the other in
one unknown cosine, which is at most one (and in many dimensions, with confidence, at
most DEVIATIONS over the root of the dimensions), and the rounding error is stored. A
pair whose bound is under the threshold is settled; only the others are computed
exactly, in double precision on the original vectors.

Equal vectors are one class, so copies cost nothing further on. Heavy groups of near
copies are found on a bounded sample; a group lies within half the threshold's angle of
its pivot, so all of its members are linked without comparing any two. Against other
vectors the angle to the pivot settles most groups as a whole (triangle inequality).
The rest meets by label, whole, in blocks, whatever the label's size: no link is lost,
a task holds two blocks, and the cost is quadratic in the classes of a label. Only a
caller that asks for it (``by_keys``) has labels of more than WHOLE_LABEL classes meet by
sign keys of several random projections, whose number follows the label's size, so that a
pair just at the threshold is missed with a probability of MISSED at most and closer
pairs much more rarely.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import acos, ceil, cos, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.components import components
from lodestone.operators.ordering import running_totals

from .common import durable, map_arrow

LEAST, PLANES, DEVIATIONS = 0.93, 6, 8.0
BLOCK, ROWS_AT_ONCE, WHOLE_LABEL, KEY_BUCKET, MISSED = 2_048, 256, 1 << 16, 4_096, 1e-3
SAMPLE_ROWS, PIVOTS, HEAVY = 4_096, 256, 8
#: Angles that differ by less are not told apart by triangle inequalities.
MARGIN = 1e-6


def rotation(width: int, seed: int = 11) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))[0]


def units(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths; scaled by the largest component first, so that squares neither vanish nor overflow."""
    x = x / abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@dataclass
class Codes:
    """Codes (words a vector), correction factors, planes of the rounded components, what they are rounded by, and the length of the rounding error."""

    code: np.ndarray
    factor: np.ndarray
    planes: np.ndarray
    low: np.ndarray
    step: np.ndarray
    slack: np.ndarray
    width: int

    @staticmethod
    def of(unit: np.ndarray, turn: np.ndarray) -> Codes:
        z = unit @ turn
        width = z.shape[1]
        code = _words(z > 0)
        factor = abs(z).sum(1) / sqrt(width)
        low = z.min(1)
        step = np.maximum((z.max(1) - low) / ((1 << PLANES) - 1), 1e-12)
        level = np.rint((z - low[:, None]) / step[:, None]).astype(np.int64)
        rounded = low[:, None] + level * step[:, None]
        planes = np.stack([_words((level >> b) & 1 == 1) for b in range(PLANES)], 1)
        return Codes(code, factor, planes, low, step, np.sqrt(((z - rounded) ** 2).sum(1)), width)

    def pick(self, rows) -> Codes:
        return Codes(*(getattr(self, f)[rows] for f in ("code", "factor", "planes", "low", "step", "slack")), self.width)

    def products(self, other: Codes) -> np.ndarray:
        """Inner products of this side's code vectors with the other side's rounded vectors, from AND and popcount."""
        ones = np.bitwise_count(self.code).sum(1, dtype=np.int64)
        both = np.zeros((len(self.code), len(other.code)), dtype=np.int64)
        level_sum = np.zeros(len(other.code), dtype=np.int64)
        for b in range(PLANES):
            level_sum += np.bitwise_count(other.planes[:, b]).sum(1, dtype=np.int64) << b
            for w in range(self.code.shape[1]):
                both += np.bitwise_count(self.code[:, w, None] & other.planes[None, :, b, w]).astype(np.int64) << b
        # Signs are 2 * bit - 1: sums over set bits twice, less the sums over all.
        dot = other.step * (2 * both - level_sum) + other.low * (2 * ones[:, None] - self.width)
        return dot / sqrt(self.width)

    def estimates(self, other: Codes) -> np.ndarray:
        """Unbiased estimates of the cosines."""
        return self.products(other) / self.factor[:, None]

    def may_reach(self, other: Codes, least: float) -> np.ndarray:
        """Pairs whose cosine can be ``least`` or more: the product is at least ``least`` times the factor, less what the part beside the code can take away."""
        beside = np.sqrt(np.maximum(0, 1 - self.factor**2)) * sqrt(max(0, 1 - least * least)) * min(1.0, DEVIATIONS / sqrt(max(1, self.width - 1)))
        bound = self.factor * least - beside
        return self.products(other) >= bound[:, None] - other.slack - 1e-9


def _words(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows with rows, in double precision, on the original vectors."""
    x, y = x / abs(x).max(1, keepdims=True), y / abs(y).max(1, keepdims=True)
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def close_pairs(x: np.ndarray, cx: Codes, y: np.ndarray, cy: Codes, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``x`` and ``y`` whose cosine is ``least`` or more: codes first, exact cosines of what their bounds leave open."""
    a, b = np.nonzero(cx.may_reach(cy, least))
    keep = np.zeros(len(a), dtype=bool)
    for i in range(0, len(a), 1 << 16):
        keep[i : i + (1 << 16)] = cosines(x[a[i : i + (1 << 16)]], y[b[i : i + (1 << 16)]]) >= least
    return a[keep], b[keep]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its component) for the pairs of nodes: no more than nodes."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = new[new]
        if (new == label).all():
            moved = np.flatnonzero(label != np.arange(len(nodes)))
            return nodes[moved], nodes[label[moved]]
        label = new


def key_plan(rows: int, least: float) -> tuple[int, int]:
    """Bits a key and keys a vector for a label of so many classes: no bits, one key up to WHOLE_LABEL."""
    if rows <= WHOLE_LABEL:
        return 0, 1
    bits = ceil(log2(rows / KEY_BUCKET))
    agree = (1 - acos(least) / pi) ** bits
    return bits, ceil(log(MISSED) / log(1 - agree))


def sign_keys(unit: np.ndarray, bits: int, keys: int) -> np.ndarray:
    """A key (``bits`` signs of random projections) for each of ``keys`` tables."""
    if not bits:
        return np.zeros((len(unit), 1), dtype=np.int64)
    sides = np.random.default_rng(bits * 1_000 + keys).normal(size=(unit.shape[1], keys * bits))
    signs = (unit @ sides > 0).reshape(len(unit), keys, bits)
    return (signs * (1 << np.arange(bits))).sum(2)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _by_width(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        width = np.asarray(batch.column("width"))
        for w in np.unique(width):
            yield batch.filter(pa.array(width == w))


def usable(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, width, vector (doubles) and its two hashes of rows that can link: an id, a label, a vector that is not zero, all components finite."""
    label = F.col("label").cast("string")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("vector").isNotNull()).where(
        F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vector", lambda x: x != 0)
    )
    hashes = [F.xxhash64(F.lit(k), "vector").alias(n) for k, n in ((1, "hash_a"), (2, "hash_b"))]
    return rows.select("vec_id", "label", F.size("vector").alias("width"), "vector", *hashes)


SAME = ["label", "width", "hash_a", "hash_b"]


@dataclass
class Pivot:
    """A heavy group: vectors of one label and width within the half angle of ``unit``."""

    number: int
    label: str
    width: int
    unit: np.ndarray
    weight: int = 0
    members: int = 0
    least_node: int = 0
    radius: float = 0.0


def pivots(sample: pa.Table, half: float) -> list[Pivot]:
    """Pivots of groups with HEAVY vectors of the sample within ``half`` of them, the largest first; what one covers counts for no other."""
    found: list[Pivot] = []
    labels, widths = np.array(sample.column("label").to_pylist(), dtype=object), np.asarray(sample.column("width"))
    for key in sorted(set(zip(labels.tolist(), widths.tolist(), strict=True))):
        rows = np.flatnonzero((labels == key[0]) & (widths == key[1]))
        unit = units(_matrix(sample.column("vector").combine_chunks().take(pa.array(rows))))
        near = unit @ unit.T >= cos(half)
        open_ = np.ones(len(rows), dtype=bool)
        while True:
            n = near[:, open_].sum(1) * open_
            best = int(n.argmax())
            if n[best] < HEAVY:
                break
            found.append(Pivot(0, key[0], key[1], unit[best], int(n[best])))
            open_ &= ~near[best]
    found.sort(key=lambda p: -p.weight)
    return [Pivot(k, p.label, p.width, p.unit) for k, p in enumerate(found[:PIVOTS])]


def _angles(unit: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ pivot, -1, 1))


def assign(classes: DataFrame, groups: list[Pivot], half: float) -> DataFrame:
    """Adds ``cell`` (number of the nearest pivot within ``half``, -1 for none) and ``away`` (the angle to it)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_width(batches):
            labels, unit = np.array(batch.column("label").to_pylist(), dtype=object), units(_matrix(batch.column("vector")))
            cell, away = np.full(len(unit), -1, dtype=np.int32), np.full(len(unit), half - MARGIN)
            for p in groups:
                if p.width == unit.shape[1]:
                    rows = np.flatnonzero(labels == p.label)
                    angle = _angles(unit[rows], p.unit)
                    nearer = rows[angle < away[rows]]
                    away[nearer] = angle[angle < away[rows]]
                    cell[nearer] = p.number
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away)], [*batch.schema.names, "cell", "away"])

    return map_arrow(classes, apply, "node long, label string, width int, weight long, vector array<double>, cell int, away double")


def _settle(groups: list[Pivot], wide: float):
    """Of each class: links with groups that its angle to the pivot settles as a whole, and the groups that it leaves open.

    A pair of groups is looked at from the lower number only, so each pair of vectors is settled once.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _by_width(batches):
            labels, unit = np.array(batch.column("label").to_pylist(), dtype=object), units(_matrix(batch.column("vector")))
            cell, node = np.asarray(batch.column("cell")), np.asarray(batch.column("node"))
            out: list[list[np.ndarray]] = [[], [], []]
            for p in groups:
                if p.width != unit.shape[1] or not p.members:
                    continue
                rows = np.flatnonzero((labels == p.label) & ((cell < 0) | (cell < p.number)))
                angle = _angles(unit[rows], p.unit)
                whole = angle + p.radius <= wide - MARGIN
                open_ = ~whole & (angle - p.radius <= wide + MARGIN)
                for kind, some in ((True, rows[whole]), (False, rows[open_])):
                    out[0].append(node[some])
                    out[1].append(np.full(len(some), p.number, dtype=np.int32))
                    out[2].append(np.full(len(some), kind))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["node", "cell", "whole"])

    return apply


_MEETING = "meet string, role int, node long, weight long, code binary, factor double, planes binary, low double, step double, slack double, keys binary, width int, vector array<double>"


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes, factors and rounded planes of every vector, and the keys of its label's plan."""
    for batch in _by_width(batches):
        unit = units(_matrix(batch.column("vector")))
        c = Codes.of(unit, rotation(unit.shape[1]))
        bits, tables = np.asarray(batch.column("bits")), np.asarray(batch.column("tables"))
        keys: list = [None] * len(unit)
        for plan in set(zip(bits.tolist(), tables.tolist(), strict=True)):
            rows = np.flatnonzero((bits == plan[0]) & (tables == plan[1]))
            for r, own in zip(rows.tolist(), sign_keys(unit[rows], *plan).astype(np.int64), strict=True):
                keys[r] = own.tolist()
        as_bytes = lambda a: pa.array([r.tobytes() for r in a], pa.binary())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("node"), batch.column("label"), batch.column("width"), batch.column("weight"), batch.column("cell"), batch.column("vector"),
                as_bytes(c.code), pa.array(c.factor), as_bytes(c.planes), pa.array(c.low), pa.array(c.step), pa.array(c.slack), pa.array(keys, pa.list_(pa.int64())),
            ],
            ["node", "label", "width", "weight", "cell", "vector", "code", "factor", "planes", "low", "step", "slack", "keys"],
        )


class _Side:
    """Vectors of one side of a meeting."""

    def __init__(self, batches: list[pa.RecordBatch]):
        table = pa.Table.from_batches(batches).combine_chunks()
        column = lambda n: np.asarray(table.column(n))
        raw = lambda n: np.frombuffer(b"".join(table.column(n).to_pylist()), dtype=np.uint64).reshape(table.num_rows, -1)
        self.node, self.weight = column("node"), column("weight")
        self.x = _matrix(table.column("vector").combine_chunks())
        words = -(-self.x.shape[1] // 64)
        self.codes = Codes(raw("code"), column("factor"), raw("planes").reshape(table.num_rows, PLANES, words), column("low"), column("step"), column("slack"), self.x.shape[1])
        self.keys = np.asarray(table.column("keys").combine_chunks().flatten()).reshape(table.num_rows, -1)


def _compare(least: float):
    """Links of a meeting: of the vectors of role 0 among themselves if they are alone, else of those of role 1 with them. ``table`` is the key by which they met."""

    def links(a: _Side, rows: np.ndarray, b: _Side, table: int, own: bool) -> tuple[np.ndarray, np.ndarray]:
        i, j = close_pairs(a.x[rows], a.codes.pick(rows), b.x, b.codes, least)
        i = rows[i]
        if own:
            i, j = i[i < j], j[i < j]
        if table > 0 and len(i):  # pairs that met by an earlier key have been counted there
            new = ~(a.keys[i, :table] == b.keys[j, :table]).any(1)
            i, j = i[new], j[new]
        return i, j

    def met(a: _Side, b: _Side, table: int, own: bool) -> Iterator[pa.RecordBatch]:
        count_a, count_b = np.zeros(len(a.node), dtype=np.int64), np.zeros(len(b.node), dtype=np.int64)
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        for s in range(0, len(a.node), ROWS_AT_ONCE):
            i, j = links(a, np.arange(s, min(len(a.node), s + ROWS_AT_ONCE)), b, table, own)
            if len(i):
                np.add.at(count_a, i, b.weight[j])
                np.add.at(count_b, j, a.weight[i])
                edges.append(forest(a.node[i], b.node[j]))
        if edges:
            x, y = forest(*(np.concatenate(c) for c in zip(*edges, strict=True)))
            nodes, counts = np.concatenate((a.node, b.node)), np.concatenate((count_a, count_b))
            some = counts > 0
            none = np.zeros(0, dtype=np.int64)
            for columns in ((nodes[some], counts[some], np.full(int(some.sum()), -1)), (x, np.zeros(len(x), dtype=np.int64), y) if len(x) else (none, none, none)):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["node", "links", "to"])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, first, side, alone = None, [], None, True
        number = lambda key: int(key.rsplit("|", 1)[1])
        for batch in batches:
            meet, role = batch.column("meet").to_pylist(), batch.column("role").to_pylist()
            i = 0
            while i < len(meet):
                j = i
                while j < len(meet) and meet[j] == meet[i] and role[j] == role[i]:
                    j += 1
                if meet[i] != at:
                    if first and alone:
                        side = _Side(first)
                        yield from met(side, side, number(at), True)
                    at, first, side, alone = meet[i], [], None, True
                if role[i] == 0:
                    first.append(batch.slice(i, j - i))
                else:
                    alone = False
                    if first:
                        side = side or _Side(first)
                        yield from met(_Side([batch.slice(i, j - i)]), side, number(at), False)
                i = j
        if first and alone:
            side = _Side(first)
            yield from met(side, side, number(at), True)

    return apply


_SENT = ["node", "weight", "code", "factor", "planes", "low", "step", "slack", "keys", "vector"]


def _meetings_of_labels(coded: DataFrame) -> DataFrame:
    """Vectors outside the heavy groups by (label, width, key, table), dealt in blocks; each pair of blocks is a meeting."""
    keyed = coded.where("cell < 0").select("*", F.posexplode("keys").alias("table", "key"))
    bucket = F.concat_ws("|", F.hex(F.col("label")), "width", "key", "table")
    keyed = keyed.select(bucket.alias("bucket"), "table", *_SENT)
    sizes = keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    rows = keyed.join(sizes, "bucket").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("block", "other"), F.greatest("block", "other")
    return rows.select(F.concat_ws("|", F.lit("k"), low, high, "bucket").alias("meet"), (F.col("block") > F.col("other")).cast("int").alias("role"), *_SENT)


def _meetings_of_groups(coded: DataFrame, open_: DataFrame, groups: list[Pivot]) -> DataFrame:
    """Classes with the groups that their angle leaves open: the group's members in blocks, the askers in parts."""
    sizes = open_.groupBy("cell").agg(F.count(F.lit(1)).alias("askers"))
    known = coded.sparkSession.createDataFrame([(p.number, p.members) for p in groups], "cell int, members long")
    plan = sizes.join(F.broadcast(known), "cell").select("cell", F.ceil(F.col("members") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("askers") / (BLOCK * 16)).cast("int").alias("parts"))
    plan = F.broadcast(plan)  # a row a heavy group, PIVOTS at most
    dealt = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = coded.join(plan, "cell").select("cell", dealt("blocks").alias("block"), every("parts").alias("part"), F.lit(0).alias("role"), *_SENT)
    askers = open_.join(coded.drop("cell"), "node").join(plan, "cell").select("cell", every("blocks").alias("block"), dealt("parts").alias("part"), F.lit(1).alias("role"), *_SENT)
    both = members.unionByName(askers)
    return both.select(F.concat_ws("|", F.lit("g"), "cell", "block", "part", F.lit(0)).alias("meet"), "role", *_SENT)


def linked(classes: DataFrame, least: float = LEAST, by_keys: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of classes (node, label, width, weight, vector): node and links (rows of other classes linked with it; some nodes several times, to be added), and edges (a, b)."""
    wide = acos(least)
    half = wide / 2
    sample = classes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE_ROWS).select("label", "width", "vector").toArrow()
    groups = pivots(sample, half - MARGIN)
    placed = durable(assign(classes, groups, half))
    for r in placed.where("cell >= 0").groupBy("cell").agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("m"), F.min("node").alias("n"), F.max("away").alias("r")).collect():
        p = groups[r.cell]
        p.weight, p.members, p.least_node, p.radius = r.w, r.m, r.n, r.r
    plans = {}
    sizes = placed.where("cell < 0").groupBy("label", "width").agg(F.count(F.lit(1)).alias("rows"))
    for r in sizes.select(F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / KEY_BUCKET))).alias("b")).distinct().collect() if by_keys else ():
        plans[int(r.b)] = key_plan(KEY_BUCKET << int(r.b), least)
    step = F.greatest(F.lit(0), F.ceil(F.log2(F.col("rows") / KEY_BUCKET))).cast("int")
    of = lambda k: F.get(F.array(*[F.lit(plans.get(b, (0, 1))[k]) for b in range(max(plans, default=0) + 1)]), step)
    sized = placed.join(sizes, ["label", "width"], "left").select(placed["*"], F.coalesce(of(0), F.lit(0)).alias("bits"), F.coalesce(of(1), F.lit(1)).alias("tables"))
    sized = sized.select("node", "label", "width", "weight", "vector", "cell", *[F.when(F.col("cell") < 0, F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in (("bits", 0), ("tables", 1))])
    coded = durable(map_arrow(sized, _coded, "node long, label string, width int, weight long, cell int, vector array<double>, code binary, factor double, planes binary, low double, step double, slack double, keys array<long>"))
    meetings = _meetings_of_labels(coded)
    counts, edges = [], []
    if groups:
        table = coded.sparkSession.createDataFrame([(p.number, p.weight, p.least_node) for p in groups], "cell int, group_weight long, least_node long")
        settled = durable(map_arrow(placed.select("node", "label", "width", "vector", "cell"), _settle(groups, wide), "node long, cell int, whole boolean"))
        whole = settled.where("whole").join(F.broadcast(table), "cell")
        own = placed.where("cell >= 0").join(F.broadcast(table), "cell")
        counts += [whole.select("node", F.col("group_weight").alias("links")), own.select("node", (F.col("group_weight") - F.col("weight")).alias("links"))]
        edges += [whole.select(F.col("node").alias("a"), F.col("least_node").alias("b")), own.where("node != least_node").select(F.col("node").alias("a"), F.col("least_node").alias("b"))]
        # What is linked with a whole group counts for each of its members.
        back = whole.select("node", "cell").join(placed.select("node", "weight"), "node").groupBy("cell").agg(F.sum("weight").alias("links"))
        counts.append(placed.select("node", "cell").join(F.broadcast(back), "cell").select("node", "links"))
        meetings = meetings.unionByName(_meetings_of_groups(coded, settled.where("not whole").select("node", "cell"), groups))
    dealt = meetings.repartition("meet").sortWithinPartitions("meet", "role")
    found = durable(map_arrow(dealt, _compare(least), "node long, links long, `to` long"))
    counts.append(found.where("links > 0").select("node", "links"))
    edges.append(found.where("`to` >= 0").select(F.col("node").alias("a"), F.col("to").alias("b")))
    union = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union(dfs[1:]))
    return union(counts), union(edges)


def near_duplicates(vectors: DataFrame, least: float = LEAST, vector: str = "embedding", by_keys: bool = False) -> DataFrame:
    """One row a vector: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and their cosine is ``least`` or more. Null
    labels, null or zero vectors, vectors with null or non-finite components and rows
    without a vec_id link with nothing and stay; vectors of different lengths do not link.
    Rows that repeat, or share a vec_id, are vectors of their own: a repeated row is
    linked with its copies. Equal ids in a component are all kept. An empty table gives
    an empty result; other columns are ignored. With ``by_keys`` large labels may miss
    links (see the head of this module); without, results do not depend on any size.
    """
    rows = durable(usable(vectors, vector))
    per = rows.groupBy(*SAME).agg(F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("weight"))
    numbered = durable(running_totals(per.withColumn("_one", F.lit(1)), ["first_id", "label", "hash_a", "hash_b"], {"node": "_one"}).drop("_one"))
    one = rows.dropDuplicates(SAME).select(*SAME, "vector")
    classes = durable(numbered.join(one, SAME).select("node", "label", "width", "weight", "vector"))
    counts, edges = linked(classes, least, by_keys)
    labels = components(edges)
    least_id = labels.join(numbered.select("node", "first_id"), "node")
    names = least_id.groupBy("label").agg(F.min("first_id").alias("component"))
    of_node = least_id.select("node", "label").join(names, "label").select("node", "component")
    links = counts.groupBy("node").agg(F.sum("links").alias("links"))
    per_class = numbered.join(links, "node", "left").join(of_node, "node", "left").select(*SAME, (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "first_id").alias("component_id"))
    taking = rows.select("vec_id", *SAME).join(per_class, SAME).select("vec_id", "n_links", "component_id")
    ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rest = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    alone = rest.where(~F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ok, F.lit(False)))
    both = taking.unionByName(alone.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return both.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
