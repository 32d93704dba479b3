"""A random order of numbered rows without a sort: a keyed bijection of 0..n-1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
# A place outside 0..n-1 is mapped again. The square has at most sqrt(n) of them, so small n need at most that many
# walks, and for large n this many in a row do not happen (below 2**-90 from n = 4096 on).
MAX_WALKS = 24


def _draw(key: Column, turn: Column, value: Column, size: Column) -> Column:
    text = F.concat_ws(":", key, turn.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long") % size


def permuted(pos: Column, total: Column, key: Column) -> Column:
    """The place of row ``pos`` of ``total`` rows in the order named by ``key``.

    The rows are laid out as a square of ``a`` by ``b`` places. A round moves one coordinate by a hash of the other, which
    can be undone, so all rounds together are a bijection of the square; walking on from places beyond the last row
    leaves a bijection of the rows. It is a projection: a new order moves no row.
    """
    a = F.greatest(F.ceil(F.sqrt(total.cast("double"))).cast("long"), F.lit(1))
    b = F.greatest(F.ceil(total.cast("decimal(20,0)") / a.cast("decimal(20,0)")).cast("long"), F.lit(1))
    div = lambda x, y: F.call_function("div", x, y)

    def once(x: Column) -> Column:
        start = F.struct(div(x, b).alias("l"), (x % b).alias("r"))

        def turn(s: Column, i: Column) -> Column:
            left = F.struct(((s["l"] + _draw(key, i, s["r"], a)) % a).alias("l"), s["r"].alias("r"))
            right = F.struct(s["l"].alias("l"), ((s["r"] + _draw(key, i, s["l"], b)) % b).alias("r"))
            return F.when(i % 2 == 0, left).otherwise(right)

        end = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)
        return F.aggregate(F.array(end), F.lit(0).cast("long"), lambda _, s: s["l"] * b + s["r"])

    walks = F.sequence(F.lit(1), F.least(a, F.lit(MAX_WALKS)).cast("int"))
    place = F.aggregate(walks, once(pos), lambda x, _: F.when(x >= total, once(x)).otherwise(x))
    return F.when(place < total, place).otherwise(F.raise_error(F.lit("walk too long")).cast("long"))
