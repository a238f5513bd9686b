"""N-gram Jaccard join by chosen paths (Christiani and Pagh, 2017; Christiani, Pagh and Sivertsen, 2018).

Sets are the five-word shingles of texts, embedded as min-hash sketches.  Each of several runs
splits the sets recursively: a bucket draws sketch coordinates, 1 / threshold in expectation,
and deals its members out by their value there.  Buckets of very many members are split over the
cluster, a level at a time; a bucket that fits a task is split to the end there, which gives the
same buckets in one round of jobs.  Buckets that got small, and buckets that hold one dense group
so that splitting does not help, are compared by brute force, large ones in pairs of bounded
blocks.  A pair of similarity at least the threshold stays together along an expected path or
more, so every run finds it with a chance that falls slowly with the number of splits.  Every run
has coordinates of its own, and there are as many runs as keep the chance to miss a pair at the
threshold after the deepest split within the target recall.

Buckets are compared in two passes.  The first has sketches only and leaves out pairs that agree
in fewer coordinates than a pair at the threshold does by five standard errors; the second gets
the texts of what is left, in groups of candidates, and compares whole sets exactly.

A pair is compared in one bucket only, the least one that both sets are in; buckets with the
same members are compared once.  Pairs are counted and reduced to a spanning forest where they
are found, so groups of copies never become lists of pairs.

Equal texts are one node with a multiplicity; nodes are told apart by a 128-bit hash of the
text, so ids that repeat with other texts do no harm.  Edge cases: null texts count as empty;
texts without words have no shingles and link with their equals alone; a text of fewer than five
words is one shingle; repeated rows, and rows with a null id, are documents of their own; the
least id of a component counts no nulls (null if there is no other); an empty table gives no
rows; extra columns are not read.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.group import GroupedData

from quarrymill.llm.common import checkpointed, hash128, mapped, packed
from quarrymill.llm.linking import SCHEMA, forest, reported, summed
from quarrymill.llm.shingles import COORDINATES, mixed, shingle_sets, sketches

#: Least similarity, least share of pairs at it that are found, members of a bucket that is not
#: split, sets in a block of a larger one about, share of a bucket that stays together in a
#: dense one, and levels at most (buckets still large then are compared in blocks).
THRESHOLD, RECALL, SMALL, BLOCK, DENSE, LEVELS = 0.8, 0.999, 128, 512, 0.6, 6
#: Members of a bucket, at most, that one task splits to the end (each is about 100 bytes there).
WHOLE = 8192
#: Standard errors below the expected agreement of a pair at the threshold that a candidate may
#: lie, coordinates compared at once, bytes of text compared by a task at once about, and rows of
#: a table that is broadcast.
ERRORS, AGREED, PART_BYTES, BROADCAST_ROWS = 5.0, 4_000_000, 8_000_000, 500_000
#: Rows of buckets that a task is given at once about.
BUNDLE_ROWS = 2000
#: Low bits of a path that hold its run.
_RUN = np.uint64((1 << 10) - 1)


def survival(splits: int, threshold: float = THRESHOLD) -> float:
    """Chance that one run keeps a pair of similarity ``threshold`` together through ``splits`` splits."""
    more, alive = min(1.0, 1 / threshold - 1), 1.0
    for _ in range(splits):
        lost = 1 - threshold * alive
        alive = 1 - (1 - more) * lost - more * lost**2
    return alive


def needed_runs(splits: int, recall: float = RECALL, threshold: float = THRESHOLD) -> int:
    """Independent runs after which a pair at the threshold was missed with 1 - ``recall`` at most."""
    miss = 1 - survival(splits, threshold)
    return 1 if miss <= 1 - recall else math.ceil(math.log(1 - recall) / math.log(miss))


def children(path: np.ndarray, sketch: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child paths: one coordinate drawn by the path, and a second with the rest of 1 / threshold.

    ``sketch`` has the coordinates of each path's run; children keep the run in their low bits.
    """
    rows, paths = [], []
    draw = mixed(path ^ np.uint64(0xA0761D6478BD642F))
    more = draw >> np.uint64(44) < np.uint64(int(min(1.0, 1 / threshold - 1) * 2**20))
    for k, there in ((0, np.ones(len(path), bool)), (1, more)):
        row = np.flatnonzero(there)
        at = ((draw[row] >> np.uint64(21 * k)) % np.uint64(COORDINATES) + np.uint64(k * 7)) % np.uint64(COORDINATES)
        value = sketch[row, at.astype(np.int64)]
        rows.append(row)
        child = mixed(mixed(path[row] + np.uint64(k + 1)) ^ (value.astype(np.uint64) + (at << np.uint64(32))))
        paths.append(child & ~_RUN | path[row] & _RUN)
    return np.concatenate(rows), np.concatenate(paths)


def _sketched(docs: DataFrame, runs: int) -> DataFrame:
    """doc_id, text hash, size, whether there are words, and the sketch for all runs as bytes.

    ``brief`` keeps one byte of each coordinate, which is enough to tell how many agree.
    """

    def made(part: pd.DataFrame) -> pd.DataFrame:
        sketch, some = sketches(part.text.tolist(), runs * COORDINATES)
        brief = sketch.astype(np.uint8)
        return part.drop(columns="text").assign(some=some, sketch=[x.tobytes() for x in sketch], brief=[x.tobytes() for x in brief])

    return mapped(docs, made, "doc_id long, h1 long, h2 long, size long, some boolean, sketch binary, brief binary")


def _matrix(column: pd.Series, kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(len(column), -1)


def _rooted(nodes: DataFrame, runs: int, threshold: float) -> DataFrame:
    """The first level of every run: (path, node, the coordinates of the path's run)."""

    def run(batches):
        for batch in batches:
            if len(batch):
                sketch, node = _matrix(batch.sketch).reshape(len(batch), runs, COORDINATES), batch.node.to_numpy()
                for k in range(runs):
                    root = mixed(np.uint64([k + 1]))[0] & ~_RUN | np.uint64(k)
                    row, path = children(np.full(len(node), root), sketch[:, k], threshold)
                    yield pd.DataFrame({"path": path.view(np.int64), "node": node[row], "own": [x.tobytes() for x in sketch[row, k]]})

    return nodes.select("node", "sketch").mapInPandas(run, "path long, node long, own binary")


def _split(rows: DataFrame, threshold: float) -> DataFrame:
    """Rows of (path, node, own) dealt to child paths, with the parent path."""

    def run(batches):
        for batch in batches:
            if len(batch):
                row, path = children(batch.path.to_numpy().view(np.uint64), _matrix(batch.own), threshold)
                yield pd.DataFrame({"parent": batch.path.to_numpy()[row], "path": path.view(np.int64), "node": batch.node.to_numpy()[row], "own": batch.own.to_numpy()[row]})

    return rows.mapInPandas(run, "parent long, path long, node long, own binary")


def _small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """A checkpointed table of paths, to be broadcast if its rows, counted unless given, are few."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def _leaves(rows: pd.DataFrame, small: int, levels: int, threshold: float) -> pd.DataFrame:
    """What whole buckets (path, level, node, own) end in when split as far as needed: the members (path, node)."""
    own, at = _matrix(rows.own), np.arange(len(rows))
    path, level = rows.path.to_numpy(np.int64).view(np.uint64), rows.level.to_numpy(np.int64)
    paths, members = [path[:0]], [at[:0]]
    while len(at):
        _, bucket, n = np.unique(path, return_inverse=True, return_counts=True)
        row, child = children(path, own[at], threshold)
        _, first, kid, kids = np.unique(child, return_index=True, return_inverse=True, return_counts=True)
        most = np.zeros(len(n), np.int64)
        np.maximum.at(most, bucket[row[first]], kids)
        dense = (most >= DENSE * n)[bucket]
        paths.append(path[dense])
        members.append(at[dense])
        live = ~dense[row] & (kids[kid] > 1)
        more = live & (kids[kid] > small) & (level[row] + 1 < levels)
        paths.append(child[live & ~more])
        members.append(at[row[live & ~more]])
        path, level, at = child[more], level[row[more]] + 1, at[row[more]]
    return pd.DataFrame({"path": np.concatenate(paths).view(np.int64), "node": rows.node.to_numpy(np.int64)[np.concatenate(members)]})


def buckets(nodes: DataFrame, runs: int, small: int = SMALL, levels: int = LEVELS, threshold: float = THRESHOLD, whole: int = WHOLE) -> tuple[DataFrame, DataFrame]:
    """The members of the buckets to compare (path, n, node), and the buckets (path, n, whether split in a task); of buckets with the same members one."""

    def sized(rows: DataFrame) -> DataFrame:
        return rows.groupBy("path").agg(
            F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit("again"), "node")).alias("y")
        )

    def joined(tables: list[DataFrame]) -> DataFrame:
        return functools.reduce(DataFrame.union, tables)

    now = _rooted(nodes, runs, threshold)
    everywhere, done, fitting, dealt = [], [], [], 0
    for level in range(levels + 1):
        sizes = checkpointed(sized(now).filter("n > 1"))
        everywhere.append(now.select("path", "node"))
        if level == levels:
            done.append(sizes)
            break
        fits, large = F.col("n").between(small + 1, whole), F.col("n") > max(small, whole)
        done.append(sizes.filter(F.col("n") <= small))
        found = sizes.agg(F.count_if(fits).alias("fits"), F.coalesce(F.sum(F.when(fits, F.col("n"))), F.lit(0)).alias("rows"), F.count_if(large).alias("large")).first()
        if found["fits"]:
            fitting.append(now.join(_small(sizes.filter(fits).select("path"), found["fits"]), "path").select("path", F.lit(level).alias("level"), "node", "own"))
            dealt += found["rows"]
        if not found["large"]:
            break
        split = checkpointed(_split(now.join(_small(sizes.filter(large).select("path"), found["large"]), "path"), threshold))
        most = split.groupBy("parent", "path").agg(F.count("*").alias("kept")).groupBy("parent").agg(F.max("kept").alias("kept"))
        judged = checkpointed(sizes.filter(large).join(most.withColumnRenamed("parent", "path"), "path"))
        dense = judged.filter(F.col("kept") >= DENSE * F.col("n"))
        done.append(dense.select(*sizes.columns))
        now = split.join(_small(dense.select(F.col("path").alias("parent"))), "parent", "left_anti").drop("parent")
    every, members = joined(done).withColumn("deep", F.lit(False)), joined(everywhere).withColumn("deep", F.lit(False))
    if fitting:
        bundles = _bundled(joined(fitting), ["path"], 1 + dealt // BUNDLE_ROWS)
        deep = checkpointed(bundles.applyInPandas(lambda part: _leaves(part, small, levels, threshold), "path long, node long"))
        every = every.union(sized(deep).withColumn("deep", F.lit(True)))
        members = members.union(deep.withColumn("deep", F.lit(True)))
    # a dense bucket that a task got stands in ``everywhere`` too, under the same path
    chosen = checkpointed(every.groupBy("n", "x", "y").agg(F.min(F.struct("path", "deep")).alias("least")).select("least.*", "n"))
    return members.join(_small(chosen), ["path", "deep"]).select("path", "n", "node"), chosen


def _groups(part: pd.DataFrame, keys: list[str]):
    """Places of the rows of each value of ``keys``, whose columns are numbers."""
    columns = np.stack([part[k].to_numpy(np.int64) for k in keys])
    order = np.lexsort(columns[::-1])
    columns = columns[:, order]
    starts = np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(0)) + 1
    return np.split(order, starts) if len(order) else []


def _met(leaves: np.ndarray, leaf: int) -> np.ndarray:
    """Which rows share a bucket that is less than ``leaf``: they are compared there."""
    lesser = [np.asarray(x, np.int64) for x in leaves]
    flat = np.concatenate(lesser)
    where, good = np.repeat(np.arange(len(lesser)), [len(x) for x in lesser]), flat < leaf
    names, column, times = np.unique(flat[good], return_inverse=True, return_counts=True)
    if not len(names) or times.max() < 2:
        return np.zeros((len(lesser), len(lesser)), bool)
    place = np.cumsum(times > 1) - 1
    incidence = np.zeros((len(lesser), place[-1] + 1), np.float32)
    again = times[column] > 1
    incidence[where[good][again], place[column[again]]] = 1
    return incidence @ incidence.T > 0


def _to_meet(wanted: np.ndarray, leaves: np.ndarray, block: np.ndarray, leaf: int, across_blocks: bool) -> np.ndarray:
    """Of the wanted pairs those that meet in this bucket: in other blocks, and in no lesser bucket."""
    wanted = wanted & ~_met(leaves, leaf)
    return wanted & (block[:, None] != block[None, :]) if across_blocks else wanted


CANDIDATES = (
    "leaf long, low int, high int, part int, label int, chunk int, across boolean, "
    "node long, doc_id long, h1 long, h2 long, weight long, size long, block int, leaves array<long>"
)
NAMES = [x.split()[0] for x in CANDIDATES.split(", ")]


def _parted(groups: list[np.ndarray], size: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray, bool]]:
    """Groups of rows put into parts of bounded bytes, as (part, rows, chunks, across).

    Small groups share a part; a large one is cut into chunks, with one part for each chunk and
    one for each two (``across``).
    """
    out, part, filled = [], 0, 0
    for group in groups:
        total = size[group].sum()
        if filled and filled + total > PART_BYTES:
            part, filled = part + 1, 0
        if total <= PART_BYTES:
            out.append((part, group, np.zeros(len(group), np.int64), False))
            filled += total
            continue
        part, filled = part + (filled > 0), 0
        chunks = np.unique((np.cumsum(size[group]) - size[group]) // (PART_BYTES // 2), return_inverse=True)[1]
        for i in range(chunks.max() + 1):
            for j in range(i, chunks.max() + 1):
                at = (chunks == i) | (chunks == j)
                out.append((part, group[at], chunks[at], i != j))
                part += 1
    return out


def _candidates(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Rows of buckets, or of two blocks of one, that have a candidate there, with the parts to compare."""
    brief = _matrix(rows.brief, np.uint8)
    least = brief.shape[1] * threshold - ERRORS * math.sqrt(brief.shape[1] * threshold * (1 - threshold))
    leaf, low, high, block, size = (rows[c].to_numpy(np.int64) for c in ("leaf", "low", "high", "block", "size"))
    leaves, out = rows.leaves.to_numpy(), []
    for at in _groups(rows, ["leaf", "low", "high"]):
        own, strip = brief[at], max(1, AGREED // (len(at) * brief.shape[1]))
        wanted = np.triu(np.concatenate([np.count_nonzero(own[k : k + strip, None] == own[None], axis=2) >= least for k in range(0, len(at), strip)]), 1)
        live = np.flatnonzero(wanted.any(0) | wanted.any(1))
        if not len(live):
            continue
        at = at[live]
        a, b = np.nonzero(_to_meet(wanted[np.ix_(live, live)], leaves[at], block[at], leaf[at[0]], low[at[0]] != high[at[0]]))
        if not len(a):
            continue
        label, met = forest(a, b, len(at)), np.unique(np.concatenate([a, b]))
        order = met[np.argsort(label[met], kind="stable")]
        groups = np.split(order, np.flatnonzero(np.diff(label[order])) + 1)
        for part, group, chunk, across in _parted(groups, size[at]):
            out.append((at[group], np.full(len(group), part), label[group], chunk, np.full(len(group), across)))
    if not out:
        return pd.DataFrame(columns=NAMES, dtype=object)
    row, part, label, chunk, across = (np.concatenate(x) for x in zip(*out, strict=True))
    return rows.iloc[row].assign(part=part, label=label, chunk=chunk, across=across)[NAMES]


def _pairs(sets: list[np.ndarray], wanted: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The wanted pairs (a boolean matrix, upper half) that are similar enough.

    Shared elements are counted by products of incidence matrices, in pieces of columns, over
    the rows that any wanted pair needs.
    """
    size = np.array([len(s) for s in sets])
    low, high = np.minimum.outer(size, size), np.maximum.outer(size, size)
    wanted &= low >= threshold * high - 1e-9
    if wanted.sum() <= 2 * len(sets):  # few pairs: one by one
        a, b = np.nonzero(wanted)
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)])
        close = (1 + threshold) * both >= threshold * (size[a] + size[b]) - 1e-6
        return a[close], b[close]
    wanted = wanted | wanted.T
    out = []
    live = np.flatnonzero(wanted.any(1))
    if not len(live):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(live)), size[live])
    _, element, times = np.unique(np.concatenate([sets[k] for k in live]), return_inverse=True, return_counts=True)
    shared = times[element] > 1
    row, element = row[shared], np.unique(element[shared], return_inverse=True)[1]
    order = np.argsort(element, kind="stable")
    row, element = row[order], element[order]
    wanted = wanted[np.ix_(live, live)]
    rows = np.arange(len(live))
    while wanted.any():
        # first the rows that most of what is left needs, against all; they are done then
        need = wanted.sum(1)
        some = np.flatnonzero(need >= max(1, need.max() // 4))
        common = np.zeros((len(some), len(rows)), np.float32)
        width = 4096
        for lo in range(0, int(element.max(initial=-1)) + 1, width):
            a, b = np.searchsorted(element, [lo, lo + width])
            part = np.zeros((len(rows), width), np.float32)
            part[row[a:b], element[a:b] - lo] = 1
            common += part[some] @ part.T
        both = size[live][some][:, None] + size[live][None, :]
        close = wanted[some] & ((1 + threshold) * common >= threshold * both - 1e-6)
        close[:, some] = np.triu(close[:, some], 1)  # of two rows done now, each pair once
        i, j = np.nonzero(close)
        out.append((np.minimum(live[some[i]], live[j]), np.maximum(live[some[i]], live[j])))
        wanted[some] = False
        wanted[:, some] = False
    a, b = (np.concatenate(x) for x in zip(*out, strict=True))
    return a, b


def _compared(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The links of parts of buckets, found by comparing whole sets within each group of candidates."""
    rows = rows.drop_duplicates(["leaf", "low", "high", "part", "node"])
    leaf, low, high, block, chunk, label = (rows[c].to_numpy(np.int64) for c in ("leaf", "low", "high", "block", "chunk", "label"))
    leaves, across, texts = rows.leaves.to_numpy(), rows.across.to_numpy(bool), rows.text.to_numpy()
    ids, place = np.unique(rows.node.to_numpy(np.int64), return_inverse=True)
    counts, weight = np.zeros(len(ids), np.int64), rows.weight.to_numpy(np.int64)
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in _groups(rows, ["leaf", "low", "high", "part"]):
        sets, one = shingle_sets(texts[at].tolist()), at[0]
        for of in _groups(pd.DataFrame({"label": label[at]}), ["label"]):
            own = at[of]
            wanted = _to_meet(np.triu(np.ones((len(own), len(own)), bool), 1), leaves[own], block[own], leaf[one], low[one] != high[one])
            if across[one]:
                wanted &= chunk[own][:, None] != chunk[own][None, :]
            a, b = _pairs([sets[k] for k in of], wanted, threshold)
            links = np.bincount(a, weight[own[b]], len(own)) + np.bincount(b, weight[own[a]], len(own))
            np.add.at(counts, place[own], links.astype(np.int64))
            root = forest(a, b, len(own))  # the group's pairs are let go; its forest stays
            joined = np.flatnonzero(root != np.arange(len(own)))
            first.append(place[own[joined]])
            second.append(place[own[root[joined]]])
    return reported(ids, counts, np.concatenate(first), np.concatenate(second))


def _bundled(df: DataFrame, keys: list[str], bundles: int) -> GroupedData:
    """``df`` grouped into about ``bundles`` groups that keep the rows of equal ``keys`` together."""
    return df.groupBy(F.pmod(F.xxhash64(*keys), F.lit(bundles)).alias("bundle"))


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def linked(docs: DataFrame, threshold: float = THRESHOLD, small: int = SMALL, block: int = BLOCK, levels: int = LEVELS, recall: float = RECALL, whole: int = WHOLE) -> DataFrame:
    """One row for each distinct text: h1, h2, low (its least id), weight (its rows), n_links,
    component (a number) and component_id (the least id in it)."""
    runs = needed_runs(levels + 1, recall, threshold)
    h1, h2 = hash128(_text())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), h1.alias("h1"), h2.alias("h2"), F.octet_length(_text()).cast("long").alias("size"), "text")
    grouped = _sketched(rows, runs).groupBy("h1", "h2").agg(
        F.min("doc_id").alias("low"), F.count("*").alias("weight"), F.first("size").alias("size"), F.first("some").alias("some"), F.first("sketch").alias("sketch"), F.first("brief").alias("brief")
    )
    # numbers are given once, in what the checkpoint holds
    nodes = checkpointed(grouped.withColumn("node", F.monotonically_increasing_id()))
    members, chosen = buckets(nodes.filter("some"), runs, small, levels, threshold, whole)
    blocks = 1 + F.floor(F.col("n") / block)
    meetings = chosen.agg(F.coalesce(F.sum(F.col("n") * blocks), F.lit(0))).first()[0]
    leaves = members.groupBy("node").agg(F.collect_list(F.struct("path", "n")).alias("leaves"))
    dealt = (
        nodes.drop("sketch").join(leaves, "node")
        .withColumns({"leaf": F.explode("leaves"), "place": F.xxhash64(F.lit("block"), "h1", "h2")})
        .withColumn("n", F.col("leaf.n")).withColumn("blocks", blocks.cast("int"))
        .withColumn("block", F.pmod("place", F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            F.col("leaf.path").alias("leaf"), F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
            "node", F.col("low").alias("doc_id"), "h1", "h2", "weight", "size", "block", F.transform("leaves", lambda x: x["path"]).alias("leaves"), "brief",
        )
    )
    bundles = _bundled(dealt, ["leaf", "low", "high"], 1 + meetings // BUNDLE_ROWS)
    live = checkpointed(bundles.applyInPandas(lambda part: _candidates(part, threshold), CANDIDATES))
    total = live.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    # one row of each text, the one with its least id
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    texts = rows.select(F.col("doc_id").alias("_id"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "text")
    filled = live.join(texts, same).drop("_id", "_h1", "_h2", "doc_id", "h1", "h2", "size")
    bundles = _bundled(filled, ["leaf", "low", "high", "part"], 1 + total // (PART_BYTES // 2))
    counts, components = summed(bundles.applyInPandas(lambda part: _compared(part, threshold), SCHEMA))
    found = nodes.select("h1", "h2", "node", "low", "weight").join(counts, "node", "left").join(components, "node", "left")
    found = checkpointed(
        found.select("h1", "h2", "low", "weight", (F.coalesce("n_links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    )
    return found.join(found.groupBy("component").agg(F.min("low").alias("component_id")), "component")


def jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """One row for each document: doc_id, n_links, component_id (least id reached) and kept.

    A document's links are the other documents of similarity at least ``threshold``, copies
    among them; ``kept`` marks the documents whose id is their component's.
    """
    h1, h2 = hash128(_text())
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), h1.alias("h1"), h2.alias("h2")).join(linked(docs, **options), ["h1", "h2"])
    return known.select("doc_id", "n_links", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_unique(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with all its columns, less near copies: one row of each component stays.

    It is a row of the component's least id (nulls last); of several texts with that id the one
    with the least hash stays, and of repeats of that row one.
    """
    h1, h2 = hash128(_text())
    keyed = packed(docs, id=F.col("doc_id").cast("long"), h1=h1, h2=h2)
    first = linked(docs, **options).groupBy("component").agg(F.min(F.struct(F.col("low").isNull().alias("last"), "low", "h1", "h2")).alias("first")).select("first.*")
    rows = keyed.groupBy("id", "h1", "h2").agg(F.count("*").alias("rows")).filter("rows > 1").withColumnRenamed("id", "low")
    same = F.col("first.low").eqNullSafe(F.col("again.low")) & (F.col("first.h1") == F.col("again.h1")) & (F.col("first.h2") == F.col("again.h2"))
    first = first.alias("first").join(rows.alias("again"), same, "left").select(
        F.col("first.low").alias("_low"), F.col("first.h1").alias("_h1"), F.col("first.h2").alias("_h2"), F.col("rows").isNotNull().alias("repeated")
    )
    kept = keyed.join(first, F.col("id").eqNullSafe(F.col("_low")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")))
    once = kept.filter("repeated").dropDuplicates(["_h1", "_h2"])
    return kept.filter("not repeated").select("row.*").union(once.select("row.*"))


#: The same in DuckDB, over the view ``documents``.
ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\t\n\v\f\r ]+'), lambda w: w <> '') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN hash(w) ELSE hash(w[i:i + 4]) END AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1)::BIGINT + 1)) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 9 * c >= 4 * (x.n + y.n)
  UNION SELECT a.doc_id, b.doc_id FROM documents a JOIN documents b ON coalesce(a.text, '') = coalesce(b.text, '') AND a.doc_id <> b.doc_id
), reached(node, low) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.low FROM reached r JOIN links l ON l.a = r.node
), component AS (SELECT node AS doc_id, min(low) AS component_id FROM reached GROUP BY node),
counts AS (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_links, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN component USING (doc_id) LEFT JOIN counts USING (doc_id)
"""
