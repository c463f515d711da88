"""Arrays as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import let

#: Elements that are summed in one run; the runs' totals are summed the same way.
RUN = 256


def _run(values: Column) -> Column:
    """at (the sum) and out (the sums before each element) of one run."""
    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(values, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))


def sums_before(values: Column) -> Column:
    """Of an array of whole numbers the sum of those before each one. Runs of RUN elements keep the work near linear, as appending copies."""

    def of(x: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(x) / RUN).cast("int") - 1, F.lit(0))), lambda b: F.slice(x, b * RUN + 1, F.lit(RUN)))
        return let(F.transform(runs, _run), lambda r: let(_run(F.transform(r, lambda s: s["at"])), lambda starts: F.flatten(F.zip_with(r, starts["out"], lambda s, begin: F.transform(s["out"], lambda o: o + begin)))))

    return let(F.transform(values, lambda v: v.cast("long")), of)
