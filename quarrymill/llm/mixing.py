"""Mixing sources to target weights by iterative proportional fitting.

Token counts form a table over source, language and topic.  Raking scales its cells until every
marginal has its target share; documents are then kept with probabilities proportional to the
ratio of a cell's raked and present tokens, capped at 1 and calibrated so that the expected
number of kept tokens is the budget.

A small table of cells is raked on the driver, a larger one by Spark jobs: both by the same
sweeps, targets and stopping rule.  Targets that no weights can reach (cells that are missing)
leave an error in the marginals, which is returned and warned about.

Edge cases: nulls in a dimension are a value of their own; documents without words count no
tokens and are kept with their cell's probability (1 if their whole cell has no tokens); equal
``doc_id``s share one decision; an empty table gives no rows; extra columns, whatever their
names, come back untouched in ``row``.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrymill.llm.common import checkpointed, packed, uniform

#: The dimensions raked, the exponent that tempers observed shares into targets, the share of
#: all tokens to keep, and the seed of the sample.
DIMS, TEMPER, BUDGET, SEED = ("source", "lang", "topic"), 0.7, 0.8, 17
#: Fixed value: ASCII white space.
BLANK = " \t\n\x0b\f\r"
#: Cells that are raked on the driver (a few MB), sweeps at most, the error of all marginals at
#: which they stop, and the error above which targets count as missed.
MAX_CELLS, SWEEPS, TOLERANCE, MISSED = 200_000, 100, 1e-10, 1e-6


@dataclass
class Raking:
    """Keep probabilities by cell, whether the cells are few, the sweeps made and the largest error left in a marginal."""

    cells: DataFrame
    small: bool
    sweeps: int = 0
    error: float = 0.0


def token_count(text: Column) -> Column:
    """Number of words between runs of ASCII white space."""
    inner = F.trim(F.coalesce(text, F.lit("")), F.lit(BLANK))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, f"[{BLANK}]+"))).cast("long")


def tempered(shares: dict, temper: float) -> dict:
    """Observed shares raised to a power and scaled to 1: large values shrink, small ones grow."""
    raised = {k: v**temper for k, v in shares.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def full_target(observed: dict, given: dict | None, temper: float) -> dict:
    """Target shares of one dimension: those given, scaled to leave values not named their share."""
    if given is None:
        return tempered(observed, temper)
    rest = sum(v for k, v in observed.items() if k not in given)
    named = sum(v for k, v in given.items() if observed.get(k))
    return {k: (given[k] * (1 - rest) / named if k in given else v) for k, v in observed.items() if v > 0}


def rake(tokens: np.ndarray, codes: Sequence[np.ndarray], targets: Sequence[np.ndarray], sweeps: int = SWEEPS) -> tuple[np.ndarray, int, float]:
    """Shares of cells whose marginals have the target shares, as near ``tokens`` as can be; sweeps and error."""
    w, made, worst = tokens / tokens.sum(), 0, np.inf
    while made < sweeps and worst >= TOLERANCE:
        worst, made = 0.0, made + 1
        for code, target in zip(codes, targets, strict=True):
            now = np.bincount(code, w, len(target))
            worst = max(worst, float(np.abs(now - target).max()))
            w = w * np.divide(target, now, out=np.zeros_like(target), where=now > 0)[code]
    return w / w.sum(), made, worst


def calibrated(tokens: np.ndarray, ratio: np.ndarray, budget: float) -> float:
    """The factor c with sum(tokens * min(1, c * ratio)) equal to the budget."""
    order = np.argsort(-ratio)
    t, r = tokens[order], ratio[order]
    full = np.concatenate([[0.0], np.cumsum(t)])  # tokens of the cells kept whole
    rest = np.concatenate([np.cumsum((t * r)[::-1])[::-1], [0.0]])
    for k in range(len(t)):
        c = (budget - full[k]) / rest[k] if rest[k] > 0 else 0.0
        if c * r[k] <= 1:
            return max(c, 0.0)
    return 1 / r[r > 0].min()


def _raked_here(cells: DataFrame, dims: list[str], targets: dict, temper: float, budget: float, sweeps: int) -> Raking:
    rows = [r for r in cells.collect() if r["tokens"] > 0]
    spark = cells.sparkSession
    schema = T.StructType([*[cells.schema[d] for d in dims], T.StructField("probability", T.DoubleType())])
    if not rows:
        return Raking(spark.createDataFrame([], schema), True)
    tokens, codes, goals = np.array([r["tokens"] for r in rows], float), [], []
    for d in dims:
        values = list(dict.fromkeys(r[d] for r in rows))
        at = {v: k for k, v in enumerate(values)}
        code = np.array([at[r[d]] for r in rows])
        shares = np.bincount(code, tokens / tokens.sum(), len(values))
        goal = full_target(dict(zip(values, shares, strict=True)), targets.get(d), temper)
        codes.append(code)
        goals.append(np.array([goal[v] for v in values]))
    raked, made_sweeps, error = rake(tokens, codes, goals, sweeps)
    ratio = raked / (tokens / tokens.sum())
    p = np.minimum(1.0, calibrated(tokens, ratio, budget * tokens.sum()) * ratio)
    made = spark.createDataFrame([(*(r[d] for d in dims), float(x)) for r, x in zip(rows, p, strict=True)], schema)
    return Raking(made, True, made_sweeps, error)


def _goals(shares: DataFrame, name: str, given: dict | None, temper: float) -> DataFrame:
    """The target share (``goal``) of each value of a dimension, from its observed ``share``."""
    if given is None:
        raised = shares.withColumn("raised", F.pow("share", F.lit(temper)))
        return raised.withColumn("goal", F.col("raised") / raised.agg(F.sum("raised")).first()[0]).select(name, "goal")
    kind = T.StructType([T.StructField("value", shares.schema[name].dataType), T.StructField("wish", T.DoubleType())])
    wishes = shares.sparkSession.createDataFrame([(k, float(v)) for k, v in given.items()], kind)
    both = shares.join(F.broadcast(wishes), F.col(name).eqNullSafe(F.col("value")), "left")
    rest, named = both.agg(F.sum(F.when(F.col("wish").isNull(), F.col("share"))), F.sum("wish")).first()
    scale = (1 - (rest or 0.0)) / named if named else 0.0
    return both.select(name, F.coalesce(F.col("wish") * scale, F.col("share")).alias("goal"))


def _raked_by_spark(cells: DataFrame, dims: list[str], targets: dict, temper: float, budget: float, sweeps: int) -> Raking:
    """The same for tables of any size: a sweep is one aggregate and join for each dimension.

    The calibrating factor is found by bisection on sums.
    """
    names = [f"d{k}" for k in range(len(dims))]
    now = cells.filter("tokens > 0").select(*[F.col(d).alias(n) for d, n in zip(dims, names, strict=True)], "tokens")
    total = now.agg(F.sum("tokens")).first()[0]
    if not total:
        return Raking(cells.select(*dims, F.lit(1.0).alias("probability")).limit(0), False)
    now = checkpointed(now.withColumn("w", F.col("tokens") / F.lit(float(total))))
    goals = {n: checkpointed(_goals(now.groupBy(n).agg(F.sum("w").alias("share")), n, targets.get(d), temper)) for d, n in zip(dims, names, strict=True)}
    made, worst = 0, np.inf
    while made < sweeps and worst >= TOLERANCE:
        made, error = made + 1, F.lit(0.0)
        for n in names:
            sums = now.groupBy(F.col(n).alias("value")).agg(F.sum("w").alias("sum")).join(goals[n].withColumnRenamed(n, "of"), F.col("value").eqNullSafe(F.col("of"))).drop("of")
            scaled = F.when(F.col("sum") > 0, F.col("w") * F.col("goal") / F.col("sum")).otherwise(0.0)
            now = now.join(sums, F.col(n).eqNullSafe(F.col("value"))).withColumn("w", scaled).withColumn(f"e_{n}", F.abs(F.col("goal") - F.col("sum"))).drop("value", "goal", "sum")
            error = F.greatest(error, F.col(f"e_{n}"))
        now = checkpointed(now.withColumn("error", error).select(*names, "tokens", "w", "error"))
        worst = now.agg(F.max("error")).first()[0]
        now = now.drop("error")
    whole = now.agg(F.sum("w")).first()[0]
    ratio = F.col("w") / F.lit(whole) * F.lit(float(total)) / F.col("tokens")
    low, high = 0.0, 1 / now.filter("w > 0").agg(F.min(ratio)).first()[0]
    for _ in range(50):
        mid = (low + high) / 2
        kept = now.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), ratio * mid))).first()[0]
        low, high = (mid, high) if kept < budget * total else (low, mid)
    found = now.select(*[F.col(n).alias(d) for n, d in zip(names, dims, strict=True)], F.least(F.lit(1.0), ratio * high).alias("probability"))
    return Raking(found, False, made, worst)


def probabilities(
    counted: DataFrame, dims: Sequence[str] = DIMS, targets: dict[str, dict] | None = None, temper: float = TEMPER, budget: float = BUDGET, max_cells: int = MAX_CELLS,
    sweeps: int = SWEEPS,
) -> Raking:
    """Keep probabilities for the cells of ``counted`` (the dims and ``tokens``).

    ``targets`` may give, for some dimensions, shares by value; the others are tempered.
    """
    cells = checkpointed(counted.groupBy(*dims).agg(F.sum("tokens").alias("tokens")))
    raked = _raked_here if cells.limit(max_cells + 1).count() <= max_cells else _raked_by_spark
    made = raked(cells, list(dims), targets or {}, temper, budget, sweeps)
    if made.error > MISSED:
        warnings.warn(f"marginals miss their targets by up to {made.error:.3g} after {made.sweeps} sweeps", stacklevel=2)
    return made


def mixed(docs: DataFrame, tokens: Column, dims: Sequence[str] | dict[str, Column] = DIMS, seed: int = SEED, **options) -> DataFrame:
    """All columns of ``docs`` as the struct ``row``, with its ``tokens``, the dims, ``probability``, ``weight`` (its inverse) and ``kept``.

    ``dims`` are columns of ``docs`` or named expressions.  The cell table joins by broadcast
    where its number of cells was checked, else by shuffle.
    """
    dims = dims if isinstance(dims, dict) else {d: F.col(d) for d in dims}
    counted = packed(docs, id=F.col("doc_id"), tokens=tokens, cell=F.struct(*[c.alias(d) for d, c in dims.items()]))
    raking = probabilities(counted.select("cell.*", "tokens"), list(dims), **options)
    found = raking.cells.select(F.struct(*dims).alias("raked"), "probability")
    same = [F.col(f"cell.{d}").eqNullSafe(F.col(f"raked.{d}")) for d in dims]
    joined = counted.join(F.broadcast(found) if raking.small else found, same, "left").withColumn("probability", F.coalesce("probability", F.lit(1.0)))
    return joined.select(
        "row", "cell.*", "tokens", "probability", F.when(F.col("probability") > 0, 1 / F.col("probability")).alias("weight"), (uniform(seed, F.col("id")) < F.col("probability")).alias("kept")
    )


def with_topics(docs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """The columns of ``docs`` as the struct ``row``, and ``topic``: the label of the vector that bears the document's id (null for none)."""
    labels = embeddings.filter("vec_id is not null").groupBy(F.col("vec_id").alias("id")).agg(F.min("label").alias("topic"))
    return packed(docs, doc_id=F.col("doc_id")).join(labels, F.col("doc_id") == F.col("id"), "left").select("row", "doc_id", "topic")


def sampled(docs: DataFrame, embeddings: DataFrame, **options) -> DataFrame:
    """The documents kept, with the columns of ``docs`` alone, raked over source, language and topic."""
    dims = {"source": F.col("row.source"), "lang": F.col("row.lang"), "topic": F.col("topic")}
    return mixed(with_topics(docs, embeddings), token_count(F.col("row.text")), dims, **options).filter("kept").select("row.row.*")
