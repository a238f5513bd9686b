"""Conversation prefixes in a z-fast trie.

A conversation is a sequence of turns (role, text).  Every prefix has a digest of 128 bits, the
exclusive or of hashes of its turns with their depths, so prefixes are compared by digest alone and
no text is moved after its turn is hashed.  The trie is a table of compacted nodes; each is found by
the digest of its handle, the prefix whose length is the two-fattest number of its edge.  A fat
binary search walks a conversation down in logarithmically many joins on handles, one join on the
first digest of the child gives its exit node, and the comparison with that edge its exit depth.

Conversations are inserted in batches.  In each batch all pending conversations are located, edges
are split at all exit depths, and the conversations that leave by the same turn are a branch.  A
branch of few is inserted whole by one task, by the same search over the nodes that it has made; of
a branch of many, one drawn at random becomes the new leaf, and the others wait for the next batch,
of which there are about logarithmically many.
Equal sequences are one from the start.  Sequences of more than ``BLOCK`` turns are cut into blocks
that are located each for itself below the digest of what precedes them, so one conversation may
hold any share of all turns.  Sums over subtrees come from doubling steps up the compacted tree.

Edge cases: rows with a null ``conv_id`` are left out; remainders of negative ids are negative, as in SQL; null turns come first and equal ones are
ordered by the hash of role and text; null roles and texts are empty; repeated rows are turns of
their own; a conversation without turns left belongs to the root alone; an empty table has no nodes, not
even a root; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import checkpointed, globally_ranked

#: Most turns of a sequence that is inserted as one.
BLOCK = 256
#: Most turns that are borrowed from another conversation, less one.
HEADS = 6
#: Most pending sequences of a branch that one task inserts one by one.
MOST_LOCAL = 512
#: Conversation ids of a piece of a node's list.
_PIECE = 1024

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def two_fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that the highest power of two divides."""
    k = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, k), k)


# --- sequences ----------------------------------------------------------------------------------


def turns_of(messages: DataFrame) -> DataFrame:
    """Turns (c, pos, turn_key, chars) with their 0-based place in the conversation, and ``first``, its first rank."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("turn_key")
    rows = messages.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), "turn", key, F.length(text).cast("long").alias("chars"))
    return globally_ranked(rows, "c", "turn", "turn_key")[0]


def rebuilt(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations behind the first turns of their hundred's first: (c, depth, turn_key, chars), and all (c, length)."""
    ranked = turns_of(messages)
    convs = checkpointed(
        ranked.groupBy("c").agg(F.min("rank").alias("first"), F.count("*").alias("own"))
        .withColumns({"h": F.crc32(F.col("c").cast("string")) % HEADS, "base": F.col("c") - F.col("c") % 100})
    )
    based = convs.select(F.col("c").alias("base"), F.col("own").alias("there"), F.col("first").alias("base_first"))
    convs = convs.join(based, "base", "left").withColumn("m", F.least("h", F.coalesce("there", F.lit(0))))
    own = ranked.join(convs.select("c", "first", "h", "m"), "c").withColumn("pos", F.col("rank") - F.col("first")).filter("pos >= h")
    own = own.select("c", (F.col("m") + F.col("pos") - F.col("h") + 1).alias("depth"), "turn_key", "chars")
    starts = convs.select(F.col("c").alias("base"), "first")
    heads = ranked.withColumnRenamed("c", "base").join(starts, "base").withColumn("pos", F.col("rank") - F.col("first")).filter(F.col("pos") < HEADS - 1)
    heads = heads.select("base", "pos", "turn_key", "chars").join(convs.filter("m > 0").select("c", "base", "h"), "base").filter("pos < h")
    lengths = convs.select("c", (F.col("m") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("length"))
    return own.unionByName(heads.select("c", (F.col("pos") + 1).alias("depth"), "turn_key", "chars")), lengths


def sequences(turns: DataFrame) -> DataFrame:
    """Blocks of sequences (c, start, root, path, chars): ``path`` has the digest of each prefix, ``root`` that of what precedes."""
    hashes = {"x": F.xxhash64("depth", "turn_key"), "y": F.xxhash64(F.lit("second seed"), "depth", "turn_key")}
    block = F.call_function("div", F.col("depth") - 1, F.lit(BLOCK).cast("long"))
    running = Window.partitionBy("c", "block").orderBy("depth")
    steps = turns.withColumns(hashes).withColumn("block", block).withColumns({k: F.bit_xor(k).over(running) for k in "xy"})
    blocks = steps.groupBy("c", "block").agg(F.array_sort(F.collect_list(F.struct("depth", "x", "y", "chars"))).alias("steps"))
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.element_at("steps", -1)
    roots = {k: F.coalesce(F.bit_xor(last[k]).over(before), F.lit(0).cast("long")) for k in "xy"}
    rooted = blocks.select("c", (F.col("block") * BLOCK).alias("start"), "steps", F.struct(*[v.alias(k) for k, v in roots.items()]).alias("root"))
    path = F.transform("steps", lambda s: F.struct(s["x"].bitwiseXOR(F.col("root.x")).alias("x"), s["y"].bitwiseXOR(F.col("root.y")).alias("y")))
    return rooted.select("c", "start", "root", path.alias("path"), F.transform("steps", lambda s: s["chars"]).alias("chars"))


# --- the trie -----------------------------------------------------------------------------------

_PENDING = ["id", "start", "root", "path", "chars", "depth"]


def _node(start: Column, low: Column, high: Column, root: Column, path: Column, chars: Column) -> Column:
    """The node for the depths in (low, high] of a sequence, counted from its start."""
    at = two_fattest(low, high)
    return F.struct(
        start.alias("start"), low.alias("low"), high.alias("high"), root.alias("root"),
        F.get(path, high - low - 1).alias("id"), F.get(path, at - low - 1).alias("handle"), F.get(path, F.lit(0)).alias("name"),
        path.alias("edge"), chars.alias("chars"),
    )


def _located(pending: DataFrame, nodes: DataFrame, bits: int) -> DataFrame:
    """Pending sequences with their exit node ``at`` (null: none goes on) and exit ``depth``.

    The search begins at the depth where the last one ended, which is a node by now; ``bits`` is
    the most steps that any of them needs.
    """
    rest_of = [c for c in _PENDING if c != "depth"]
    handles = nodes.select(F.col("handle").alias("probe"), F.col("id").alias("extent"), F.col("low").alias("node_low"), F.col("high").alias("node_high"))
    over = F.struct(F.xxhash64("id.x").alias("x"), F.xxhash64("id.y").alias("y"))  # no digest of a node, and spread evenly
    state = pending.select(*rest_of, F.col("depth").alias("a"), F.size("path").alias("b"))
    for _ in range(bits):
        fat = two_fattest(F.col("a"), F.col("b"))
        found = state.withColumn("fat", fat).withColumn("probe", F.when(F.col("a") < F.col("b"), F.get("path", F.col("fat") - 1)).otherwise(over)).join(handles, "probe", "left")
        hit, whole = F.col("extent").isNotNull(), F.coalesce(F.get("path", F.col("node_high") - 1) == F.col("extent"), F.lit(False))
        low = F.when(hit & whole, F.col("node_high")).when(hit, F.col("node_low")).otherwise(F.col("a"))
        # a handle that was met on an edge that goes elsewhere: its parent is the last whole node
        high = F.when(hit & ~whole, F.col("node_low")).when(hit | (F.col("a") >= F.col("b")), F.col("b")).otherwise(F.col("fat") - 1)
        state = found.select(*rest_of, low.alias("a"), high.alias("b"))
    children = nodes.select(F.col("name").alias("next"), F.col("id").alias("at"), "edge", F.col("high").alias("node_high"))
    going = state.withColumn("next", F.coalesce(F.get("path", F.col("a")), over)).join(children, "next", "left")
    rest = F.slice("path", F.col("a") + 1, F.least(F.size("path"), F.coalesce("node_high", F.lit(0))) - F.col("a"))
    alike = F.size(F.filter(F.zip_with(rest, F.slice("edge", F.lit(1), F.size(rest)), lambda p, q: p == q), lambda same: same))
    deep = F.col("a") + F.when(F.col("at").isNotNull(), alike).otherwise(0)
    return going.select(*rest_of, deep.alias("depth"), "at", F.coalesce("node_high", F.lit(0)).alias("high"))


def inserted(paths: list[list[str]], low: int) -> list[tuple[int, int, int]]:
    """Nodes (a sequence that passes through, low, high) of sequences that are alike up to ``low`` and one turn on."""
    nodes, handles, names = [], {}, {}

    def fattest(a: int, b: int) -> int:
        k = (a ^ b).bit_length() - 1
        return b >> k << k

    def put(k: int, path: list[str], a: int, b: int) -> None:
        nodes[k : k + 1] = [(path, a, b)]
        handles[path[fattest(a, b) - 1]] = names[path[a]] = k

    for path in paths:
        a, b = low, len(path)
        while a < b:
            f = fattest(a, b)
            k = handles.get(path[f - 1])
            if k is None:
                b = f - 1
                continue
            other, start, end = nodes[k]
            if end <= len(path) and path[end - 1] == other[end - 1]:
                a = end
            else:
                a = b = start
        if a == len(path):
            continue
        k, deep = names.get(path[a]), a
        if k is not None:
            other, start, end = nodes[k]
            while deep < min(len(path), end) and path[deep] == other[deep]:
                deep += 1
            if deep < end:  # the edge is split where the sequence ends or leaves
                del handles[other[fattest(start, end) - 1]]
                put(k, other, start, deep)
                put(len(nodes), other, deep, end)
        if deep < len(path):
            put(len(nodes), path, deep, len(path))
    at = {id(path): k for k, path in enumerate(paths)}
    return [(at[id(path)], a, b) for path, a, b in nodes]


def _edges(paths: pd.Series, low: pd.Series) -> pd.Series:
    made = [inserted([list(p) for p in group], int(a)) for group, a in zip(paths, low, strict=True)]
    return pd.Series([[{"k": k, "low": a, "high": b} for k, a, b in edges] for edges in made])


def _leaf(low: Column, high: Column) -> Column:
    """The node of a sequence's depths in (low, high]."""
    parent = F.when(low > 0, F.get("path", low - 1)).otherwise(F.col("root"))
    return _node(F.col("start"), low, high, parent, F.slice("path", low + 1, high - low), F.slice("chars", low + 1, high - low))


def z_fast_trie(blocks: DataFrame) -> DataFrame | None:
    """Compacted nodes of the trie of distinct sequences; each end of a sequence is the end of a node's edge."""
    last = F.element_at("path", -1)
    alike = blocks.groupBy(last.alias("id")).agg(F.first(F.struct("start", "root", "path", "chars")).alias("s"))
    pending, nodes, here = checkpointed(alike.select("id", "s.*", F.lit(0).alias("depth"))), None, F.col("depth")
    need = F.max(F.length(F.bin(here.bitwiseXOR(F.size("path")))))
    bits = pending.agg(need).first()[0]
    edges_of = F.pandas_udf(_edges, "array<struct<k:int,low:int,high:int>>")
    while bits:
        none = F.lit(None).cast("struct<x:bigint,y:bigint>")
        located = pending.select(*_PENDING, none.alias("at"), F.lit(0).alias("high")) if nodes is None else checkpointed(_located(pending, nodes, bits))
        open_ = located.filter(here < F.size("path")).withColumn("branch", F.get("path", here))
        # drawn by a hash: whole rows stay where they are until one of each branch is known
        branches = open_.groupBy("branch").agg(F.min(F.struct(F.xxhash64("id.x", "id.y").alias("lot"), "id")).alias("first"), F.count("*").alias("n"))
        marked = checkpointed(open_.join(branches.select("branch", F.col("first.id").alias("drawn"), "n"), "branch"))
        few, drawn = F.col("n") <= MOST_LOCAL, F.col("drawn") == F.col("id")
        members = marked.filter(few).groupBy("branch", "depth").agg(F.collect_list(F.struct("start", "root", "path", "chars")).alias("members"))
        named = F.transform("members", lambda m: F.transform(m["path"], lambda p: F.concat_ws(":", p["x"], p["y"])))
        edges = members.select("members", F.explode(edges_of(named, "depth")).alias("e")).select(F.get("members", F.col("e.k")).alias("m"), "e.low", "e.high").select("m.*", "low", "high")
        grown = edges.select(_leaf(F.col("low"), F.col("high")).alias("n")).unionByName(marked.filter(~few & drawn).select(_leaf(here, F.size("path")).alias("n"))).select("n.*")
        if nodes is not None:
            cuts = located.filter((here > 0) & (here < F.col("high"))).groupBy(F.col("at").alias("id")).agg(F.collect_set("depth").alias("cuts"))
            bounds = F.array_sort(F.concat(F.array("low"), F.coalesce("cuts", F.array().cast("array<int>")), F.array("high")))
            bounded = nodes.join(cuts, "id", "left").withColumn("bounds", F.array_distinct(bounds))
            cut = bounded.withColumn("k", F.explode(F.sequence(F.lit(0), F.size("bounds") - 2)))
            low, high = F.get("bounds", F.col("k")), F.get("bounds", F.col("k") + 1)
            above = F.when(F.col("k") > 0, F.get("edge", low - F.col("low") - 1)).otherwise(F.col("root"))
            part = [F.slice(c, low - F.col("low") + 1, high - low) for c in ("edge", "chars")]
            grown = grown.unionByName(cut.select(_node(F.col("start"), low, high, above, *part).alias("n")).select("n.*"))
        nodes = checkpointed(grown)
        pending = marked.filter(~few & ~drawn).select(*_PENDING)
        bits = pending.agg(need).first()[0]
    return nodes


# --- sums over subtrees -------------------------------------------------------------------------


def subtree_sums(nodes: DataFrame) -> DataFrame:
    """For nodes (id, up, chars, ends, least, n_children), ``up`` null at the root: sums over all that hang below, themselves included.

    ``convs``, ``least`` and ``leaves`` add up ends, least ids and leaves; ``length`` the chars of
    nodes; ``held`` the chars on the way from the node to each end.  Step k adds what lies 2^k nodes below.
    """
    state = checkpointed(
        nodes.select(
            "id", "up", "chars", "n_children", F.col("ends").alias("convs"), "least", (F.col("n_children") == 0).cast("long").alias("leaves"), F.col("chars").alias("length"),
            (F.col("chars") * F.col("ends")).alias("held"), F.col("chars").alias("way"),
        )
    )
    while not state.filter("up IS NOT NULL").isEmpty():
        sent = state.filter("up IS NOT NULL").groupBy(F.col("up").alias("id")).agg(
            F.sum("convs").alias("d_convs"), F.min("least").alias("d_least"), F.sum("leaves").alias("d_leaves"), F.sum("length").alias("d_length"),
            F.sum(F.col("held") + F.col("convs") * (F.col("way") - F.col("chars"))).alias("d_held"),
        )
        zero = F.lit(0).cast("long")
        grown = state.join(sent, "id", "left").select(
            "id", "up", "chars", "way", "n_children",
            *[(F.col(c) + F.coalesce(f"d_{c}", zero)).alias(c) for c in ("convs", "leaves", "length")],
            F.least("least", "d_least").alias("least"),
            (F.col("held") + F.coalesce("d_held", zero) + F.col("chars") * F.coalesce("d_convs", zero)).alias("held"),
        )
        above = state.filter("up IS NOT NULL").select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("way").alias("more"))
        rises = F.col("up").isNotNull()
        risen = grown.filter(rises).join(above, "up", "left").withColumn("up", F.col("further")).withColumn("way", F.col("way") + F.coalesce("more", zero)).drop("further", "more")
        state = checkpointed(risen.unionByName(grown.filter(~rises)))
    return state.select("id", "convs", "least", "leaves", "n_children", "length", "held")


def _ends_digests(ends: DataFrame) -> DataFrame:
    """(id, sha256) over the conversation ids that end at each node, in numerical order.

    Ids are joined in pieces of bounded size; a digest takes the pieces of its node one by one.
    """
    ranked, _ = globally_ranked(ends.select("id.x", "id.y", "c"), "x", "y", "c")
    piece = F.call_function("div", F.col("rank"), F.lit(_PIECE).cast("long"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",")
    pieces = ranked.groupBy("x", "y", piece.alias("piece")).agg(text.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            done = []
            for x, y, ids in zip(batch["x"].to_pylist(), batch["y"].to_pylist(), batch["ids"].to_pylist(), strict=True):
                if (x, y) == now:
                    digest.update(b"," + ids.encode())
                    continue
                if now:
                    done.append((*now, digest.hexdigest()))
                now, digest = (x, y), hashlib.sha256(ids.encode())
            if done:
                yield made(done)
        if now:
            yield made([(*now, digest.hexdigest())])

    def made(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["x", "y", "sha"])

    hashed = pieces.repartition("x", "y").sortWithinPartitions("x", "y", "piece").select("x", "y", "ids").mapInArrow(run, "x long, y long, sha string")
    return hashed.select(F.struct("x", "y").alias("id"), "sha")


def prefix_nodes(messages: DataFrame) -> DataFrame:
    """All nodes of the trie of rebuilt conversations, one for each distinct prefix."""
    turns, lengths = rebuilt(messages)
    blocks = checkpointed(sequences(turns))
    zero = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    lengths = lengths.select("c", F.call_function("div", F.col("length") - 1, F.lit(BLOCK).cast("long")).alias("block"), "length")
    final = blocks.select("c", F.call_function("div", F.col("start"), F.lit(BLOCK).cast("long")).alias("block"), F.element_at("path", -1).alias("id"))
    ended = lengths.filter("length > 0").join(final, ["c", "block"]).select("c", "id").unionByName(lengths.filter("length = 0").select("c", zero.alias("id")))
    ends = checkpointed(ended)
    nodes, nothing = z_fast_trie(blocks), F.lit(None)
    size = F.aggregate("chars", F.lit(0).cast("long"), lambda a, b: a + b)
    facts = ["id", nothing.cast("struct<x:bigint,y:bigint>").alias("up"), F.lit(0).cast("long").alias("chars")]
    known = ends.select(*facts, F.lit(1).alias("ends"), F.col("c").alias("least"), F.lit(0).alias("child"))
    known = known.unionByName(ends.limit(1).select(zero.alias("id"), *facts[1:], F.lit(0).alias("ends"), nothing.cast("long").alias("least"), F.lit(0).alias("child")))
    if nodes is not None:
        known = known.unionByName(nodes.select("id", F.col("root").alias("up"), size.alias("chars"), F.lit(0).alias("ends"), nothing.cast("long").alias("least"), F.lit(0).alias("child")))
        known = known.unionByName(nodes.select(F.col("root").alias("id"), *facts[1:], F.lit(0).alias("ends"), nothing.cast("long").alias("least"), F.lit(1).alias("child")))
    known = known.groupBy("id").agg(
        F.max("up").alias("up"), F.max("chars").alias("chars"), F.sum("ends").alias("ends"), F.min("least").alias("least"), F.sum("child").alias("n_children")
    )
    sums = subtree_sums(known).join(_ends_digests(ends), "id", "left").withColumn("sha", F.coalesce("sha", F.lit(EMPTY_SHA256)))
    sums = checkpointed(sums)
    value = ["convs", "least", "leaves", "n_children", "sha", (F.col("held") - F.col("length")).alias("saved")]
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = sums.filter(F.col("id") == zero).select(
        F.col("least").alias("conv_id"), F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("convs").alias("n_convs"),
        "n_children", F.col("leaves").alias("n_leaves"), (F.col("held") - F.col("length")).alias("saved_tokens"), F.col("sha").alias("ends_sha256"),
    )
    if nodes is None:
        return top.select(*columns)
    above = sums.select(F.col("id").alias("root"), F.col("least").alias("parent_least"))
    edges = nodes.join(sums.select("id", *value), "id").join(above, "root").withColumn("k", F.explode(F.sequence(F.lit(0), F.size("edge") - 1)))
    ending, passed = F.col("k") == F.size("edge") - 1, F.aggregate(F.slice("chars", F.lit(1), F.col("k")), F.lit(0).cast("long"), lambda a, b: a + b)
    expanded = edges.select(
        F.col("least").alias("conv_id"), (F.col("start") + F.col("low") + F.col("k") + 1).alias("depth"),
        F.when(F.col("k") == 0, F.col("parent_least")).otherwise(F.col("least")).alias("parent_conv_id"), F.col("convs").alias("n_convs"),
        F.when(ending, F.col("n_children")).otherwise(F.lit(1)).alias("n_children"), F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("convs") - 1) * passed).alias("saved_tokens"), F.when(ending, F.col("sha")).otherwise(F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )
    return expanded.unionByName(top).select(*columns)


ORACLE = """WITH said AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
keyed AS (SELECT c, turn, md5(length(role) || ':' || role || text) AS turn_key, length(text) AS chars FROM said),
t AS (SELECT c, turn_key, chars, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, turn_key) - 1 AS pos FROM keyed),
bits AS (
  SELECT c, count(*) AS own, [4294967295::BIGINT] || flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::BIGINT, 0, 0, 0, 0, 0, 0, 0])) AS b FROM t GROUP BY c
),
convs AS (SELECT c, own, c - c % 100 AS base, xor(list_reduce(b, lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) % 6 AS h FROM bits),
led AS (SELECT v.*, least(v.h, coalesce(b.own, 0)) AS m FROM convs v LEFT JOIN convs b ON b.c = v.base),
rebuilt AS (
  SELECT c, m + pos - h + 1 AS depth, turn_key, chars FROM t JOIN led USING (c) WHERE pos >= h
  UNION ALL SELECT led.c, pos + 1, turn_key, chars FROM led JOIN t ON t.c = led.base WHERE pos < h
),
lists AS (SELECT c, list(turn_key ORDER BY depth) AS l, list(chars ORDER BY depth) AS s FROM rebuilt GROUP BY c),
prefixes AS (
  SELECT c, d AS depth, md5(array_to_string(l[:d], ',')) AS key, CASE WHEN d = 1 THEN '' ELSE md5(array_to_string(l[:d - 1], ',')) END AS parent, s[d] AS chars, d = len(l) AS ending
  FROM (SELECT *, unnest(range(1, len(l) + 1)) AS d FROM lists)
  UNION ALL SELECT led.c, 0, '', NULL, 0, l IS NULL FROM led LEFT JOIN lists USING (c)
),
nodes AS (
  SELECT key, any_value(parent) AS parent, any_value(depth) AS depth, any_value(chars) AS chars, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ending), '')) AS ends_sha256
  FROM prefixes GROUP BY key
),
children AS (SELECT parent AS key, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
full_nodes AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (key)),
below AS (
  SELECT p.key, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.chars) AS saved
  FROM full_nodes f JOIN prefixes p ON p.c = f.conv_id AND p.depth <= f.depth GROUP BY p.key
)
SELECT f.conv_id, f.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved::BIGINT AS saved_tokens, f.ends_sha256
FROM full_nodes f JOIN below USING (key) LEFT JOIN nodes u ON u.key = f.parent"""
