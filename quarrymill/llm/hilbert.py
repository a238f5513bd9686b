"""Sharding along a Hilbert curve over several metadata dimensions.

Each dimension is quantised at its own quantiles, the quantised coordinates give an index on a
Hilbert curve, rows are sorted by it, and the sorted rows are cut into runs of equal row
counts.  Files written from the runs then have narrow ranges in every dimension at once, so
that filters on any of them skip files.

Only DataFrame functions are used.  Edge cases: a null in a dimension takes coordinate 0; a
null text has size 8 and the checksum of the empty text; repeated rows get a slot each, ties
are broken by text checksum and ``doc_id``; an empty table gives no rows; other columns are
not read.  Strings are compared whole, so values that begin alike stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import checkpointed, packed

#: Bits for each dimension, the shards cut, and leading bits of the index that name a stretch.
BITS, SHARDS, STRETCH_BITS = 5, 24, 16


def hilbert_index(coordinates: Column, dims: int, bits: int) -> Column:
    """Index on the Hilbert curve of an array of ``dims`` integers below 2**bits.

    The transform to transposed form by Skilling (2004), as folds over (bit, axis) steps.
    """
    steps = F.array(*[F.struct(F.lit((1 << q) - 1).alias("low"), F.lit(i).alias("axis")) for q in range(bits - 1, 0, -1) for i in range(dims)])

    def undo(x: Column, step: Column) -> Column:
        first, own, low = F.get(x, F.lit(0)), F.get(x, step["axis"]), step["low"]
        swap = first.bitwiseXOR(own).bitwiseAND(low)
        is_set = own.bitwiseAND(low + 1) != 0
        return F.transform(
            x,
            lambda v, k: F.when(is_set, F.when(k == 0, v.bitwiseXOR(low)).otherwise(v)).otherwise(
                F.when((k == 0) | (k == step["axis"]), v.bitwiseXOR(swap)).otherwise(v)
            ),
        )

    grayed = F.aggregate(
        F.aggregate(steps, coordinates, undo) if bits > 1 else coordinates,
        F.array().cast("array<int>"),
        lambda acc, v: F.array_append(acc, v.bitwiseXOR(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)))),
    )

    def packed(x: Column) -> Column:
        last = F.get(x, F.lit(dims - 1))
        flip = F.lit(0)
        for q in range(bits - 1, 0, -1):
            flip = flip.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << q)) != 0, F.lit((1 << q) - 1)).otherwise(F.lit(0)))
        fixed = F.transform(x, lambda v: v.bitwiseXOR(flip))
        return F.aggregate(
            F.array(*[F.struct(F.lit(q).alias("bit"), F.lit(i).alias("axis")) for q in range(bits - 1, -1, -1) for i in range(dims)]),
            F.struct(F.lit(0).cast("long").alias("index"), fixed.alias("x")),
            lambda acc, s: F.struct(
                (acc["index"] * 2 + F.when(F.get(acc["x"], s["axis"]).bitwiseAND(F.element_at(F.array(*[F.lit(1 << q) for q in range(bits)]), s["bit"] + 1)) != 0, F.lit(1)).otherwise(F.lit(0))).alias("index"),
                acc["x"].alias("x"),
            ),
            lambda acc: acc["index"],
        )

    # a one-element fold binds the grayed coordinates, so that they are made once
    return F.get(F.transform(F.array(grayed), packed), F.lit(0))


def quantised(value: Column, cuts: list) -> Column:
    """Number of cut points at or below the value: its coordinate (0 for null).

    A value that many rows have is a cut several times, so a few frequent values still spread
    over the whole range, and the first steps of the curve tell them apart.
    """
    if not cuts:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= value)), F.lit(0))


def _string_cuts(rows: DataFrame, name: str, bits: int) -> list[str]:
    """The strings at which each of 2**bits equal shares of the rows ends but the last, whole values compared.

    Distinct values are range-sorted with their counts; the driver sees one sum for each
    partition and at most 2**bits - 1 values.
    """
    counts = rows.filter(F.col(name).isNotNull()).groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
    ranked = checkpointed(counts.repartitionByRange("value").withColumn("part", F.spark_partition_id()))
    sums, before, total = {r["part"]: r["n"] for r in ranked.groupBy("part").agg(F.sum("n").alias("n")).collect()}, [], 0
    for k in range(max(sums, default=-1) + 1):
        before.append(total)
        total += sums.get(k, 0)
    start = F.get(F.array(*[F.lit(x).cast("long") for x in before or [0]]), F.col("part"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    below = start + inside
    shares = lambda upto: F.least(F.lit((1 << bits) - 1), F.floor(upto * (1 << bits) / F.lit(max(total, 1)))).cast("int")
    found = ranked.select("value", (shares(below + F.col("n")) - shares(below)).alias("times")).filter("times > 0").collect()
    return sorted((r["value"] for r in found for _ in range(r["times"])), key=lambda v: v.encode())


def cut_points(rows: DataFrame, dims: list[str], bits: int) -> list[list]:
    """For each dimension 2**bits - 1 quantiles, repeats among them: approximate ones of numbers, exact ones of strings."""
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    text = [d for d in dims if rows.schema[d].dataType.simpleString() == "string"]
    numbers = [d for d in dims if d not in text]
    found = rows.agg(*[F.percentile_approx(F.col(d).cast("double"), shares, 10_000).alias(d) for d in numbers]).first() if numbers else {}
    return [_string_cuts(rows, d, bits) if d in text else sorted(found[d] or []) for d in dims]


def in_runs(rank: Column, total: int, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a 0-based rank when ``total`` rows are cut into runs at most one apart."""
    each, more = divmod(total, shards)
    edge = more * (each + 1)
    small = F.lit(max(each, 1)).cast("long")
    shard = F.when(rank < edge, F.floor(rank / (each + 1))).otherwise(F.lit(more) + F.floor((rank - edge) / small))
    slot = F.when(rank < edge, F.pmod(rank, F.lit(each + 1).cast("long"))).otherwise(F.pmod(rank - edge, small))
    return shard.cast("int"), slot.cast("long")


def sharded(rows: DataFrame, dims: dict[str, Column], tie: list[str], shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """All columns of ``rows`` as the struct ``row``, with ``hilbert``, ``shard`` and ``slot``.

    ``dims`` names expressions, numbers or strings; rows of one index are ordered by the columns
    ``tie``.  A row's place is that of its stretch of the curve, from the stretches' counts (at
    most 2**STRETCH_BITS rows, whatever the input), plus its place among the stretch's rows.  As
    dimensions are cut at their own quantiles, a frequent value of one is spread by the others.
    All columns of ``rows`` are checkpointed and dealt out by stretch, so pass keys and sizes
    rather than texts.
    """
    names = [f"dim{k}" for k in range(len(dims))]
    numbers = {"double", "string"}
    measured = packed(rows, **dict(zip(names, dims.values(), strict=True)))
    measured = checkpointed(
        measured.select("row", *[F.col(n) if measured.schema[n].dataType.simpleString() in numbers else F.col(n).cast("double").alias(n) for n in names])
    )
    cuts = cut_points(measured, names, bits)
    coordinates = F.array(*[quantised(F.col(n), c) for n, c in zip(names, cuts, strict=True)])
    indexed = measured.select("row", hilbert_index(coordinates, len(names), bits).alias("hilbert"))
    indexed = checkpointed(indexed.withColumn("stretch", F.shiftright("hilbert", max(0, len(names) * bits - STRETCH_BITS))))
    counts = indexed.groupBy("stretch").agg(F.count("*").alias("n"))
    along = Window.orderBy("stretch")
    before = F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    placed = counts.select("stretch", before.alias("before"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    inside = F.row_number().over(Window.partitionBy("stretch").orderBy("hilbert", *[f"row.{t}" for t in tie])) - 1
    ranked = indexed.withColumn("at", inside).join(F.broadcast(placed), "stretch")
    shard, slot = in_runs(F.col("before") + F.col("at"), total, shards)
    return ranked.select("row", "hilbert", shard.alias("shard"), slot.alias("slot"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Documents by source, language, length and id, cut into ``shards`` runs (law ``rows``); texts are read once."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        "doc_id", "source", "lang", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    )
    dims = {"source": F.col("source"), "lang": F.col("lang"), "size": F.col("size"), "doc_id": F.col("doc_id")}
    return sharded(slim, dims, ["text_crc32", "doc_id"], shards).select(
        "row.doc_id", "row.size", "row.text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )
