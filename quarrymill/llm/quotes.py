"""Quotation linking in conversations.

Quote markers at line starts give every line a level.  A run of neighbouring lines of one level
above 0 is a quoted passage; its normalised text is hashed and joined to the earliest message of
the conversation that holds the passage as text of its own.  Messages come back without quotes,
with the message they reply to and their place in reply order.

Only DataFrame functions are used.  Edge cases: null or empty texts have an empty body and no
quotes; a message without ``conv_id`` or ``turn`` loses its quotes but links to nothing;
repeated rows each stay; a passage that no earlier message holds stays unlinked; extra columns
are not read.  A passage is matched as a whole run first; else it belongs to the earlier message
that holds most of its lines, if those are at least half of its lines that are not blank (a line
counts for the first message that holds it; of equal shares the earlier message wins).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import checkpointed, globally_ranked

#: Fixed value: quote markers at the start of a line, at most three blanks before each.
MARKERS = r"^(?:[ \t]{0,3}>)+"
#: Least share of a passage's lines that the message it is linked to must hold.
LINE_SHARE = 0.5


def line_level(line: Column) -> Column:
    marks = F.regexp_extract(line, MARKERS, 0)
    return F.length(marks) - F.length(F.replace(marks, F.lit(">"), F.lit("")))


def line_content(line: Column) -> Column:
    return F.regexp_replace(line, MARKERS + r"[ \t]?", "")


def passage_key(text: Column) -> Column:
    """Hash of a passage in lower case with runs of white space as one blank; null if blank."""
    plain = F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))
    return F.when(plain != "", F.md5(plain))


def parsed(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) with ``runs`` (array of level and text, in order) and ``body``.

    Messages without a marked line are one run of their own text and are not taken apart.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.when(text.rlike("(?m)" + MARKERS), F.split(text, "\n"))
    split = messages.select("conv_id", "turn", "role", text.alias("text"), lines.alias("_lines"))
    levelled = split.withColumns({"_levels": F.transform("_lines", line_level), "_contents": F.transform("_lines", line_content)})
    starts = F.filter(
        F.sequence(F.lit(0), F.size("_levels") - 1),
        lambda k: (k == 0) | (F.get("_levels", k) != F.coalesce(F.get("_levels", k - 1), F.lit(-1))),
    )
    taken = F.transform(
        F.sequence(F.lit(0), F.size("_starts") - 1),
        lambda k: F.struct(
            F.get("_levels", F.get("_starts", k)).alias("level"),
            F.array_join(
                F.slice("_contents", F.get("_starts", k) + 1, F.coalesce(F.get("_starts", k + 1), F.size("_lines")) - F.get("_starts", k)), "\n"
            ).alias("text"),
        ),
    )
    runs = F.when(F.col("_lines").isNotNull(), taken).otherwise(F.array(F.struct(F.lit(0).alias("level"), F.col("text").alias("text"))))
    own = F.array_join(F.transform(F.filter("runs", lambda r: r["level"] == 0), lambda r: r["text"]), "\n")
    body = F.when(F.exists("runs", lambda r: r["level"] > 0), F.regexp_replace(own, r"^\s*\n|\s+$", "")).otherwise(F.col("text"))
    starting = F.when(F.col("_lines").isNotNull(), starts)
    return levelled.withColumn("_starts", starting).withColumn("runs", runs).withColumn("body", body).drop("_lines", "_levels", "_contents", "_starts")


def _keys(text: Column) -> Column:
    """Keys of a run and of its lines, with their order of preference."""
    lines = F.split(text, "\n")
    return F.concat(
        F.array(F.struct(F.lit(0).alias("rank"), passage_key(text).alias("key"))),
        F.transform(lines, lambda x, k: F.struct((k + 1).alias("rank"), passage_key(x).alias("key"))),
    )


def quote_links(messages: DataFrame) -> DataFrame:
    """One row for each quoted passage: conv_id, turn, message hash, place, level and ``source_turn``.

    The joined side has one row for each conversation and key (its earliest holder), made with
    partial aggregation, so frequent lines multiply nothing.
    """
    runs = parsed(messages).select("conv_id", "turn", F.md5(F.coalesce("text", F.lit(""))).alias("message"), F.posexplode("runs").alias("place", "run"))
    quoted = (
        runs.filter((F.col("run.level") > 0) & passage_key(F.col("run.text")).isNotNull())
        .select("conv_id", "turn", "message", "place", "run.level", F.explode(_keys(F.col("run.text"))).alias("k"))
        .select("conv_id", "turn", "message", "place", "level", F.col("k.rank").alias("preference"), F.col("k.key").alias("key"))
        .filter("key is not null")
    )
    holders = (
        runs.filter((F.col("run.level") == 0) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
        .select("conv_id", "turn", F.explode(F.array_distinct(F.transform(_keys(F.col("run.text")), lambda k: k["key"]))).alias("key"))
        .filter("key is not null")
        .groupBy("conv_id", "key")
        .agg(F.min("turn").alias("source_turn"))
    )
    found = quoted.join(holders, ["conv_id", "key"], "left").withColumn("source_turn", F.when(F.col("source_turn") < F.col("turn"), F.col("source_turn")))
    passage = ["conv_id", "turn", "message", "place", "level"]
    votes = found.groupBy(*passage, "source_turn").agg(F.count_if(F.col("preference") == 0).alias("whole"), F.count_if(F.col("preference") > 0).alias("lines"))
    linked = F.col("source_turn").isNotNull()
    best = votes.groupBy(*passage).agg(
        F.min(F.when(linked & (F.col("whole") > 0), F.col("source_turn"))).alias("whole"),
        F.min(F.when(linked & (F.col("lines") > 0), F.struct((-F.col("lines")).alias("n"), "source_turn"))).alias("most"),
        F.sum("lines").alias("lines"),
    )
    by_lines = F.when(-F.col("most.n") >= LINE_SHARE * F.col("lines"), F.col("most.source_turn"))
    return best.select(*passage, F.coalesce("whole", by_lines).alias("source_turn"))


def _threads(replies: DataFrame) -> DataFrame:
    """Root and depth of each replying turn, by doubling pointers; rounds grow with log2(depth)."""
    now = checkpointed(replies.select("conv_id", "turn", F.col("reply_to").alias("root"), F.lit(1).alias("depth")))
    while True:
        up = now.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("_root"), F.col("depth").alias("_depth"))
        joined = now.join(up, ["conv_id", "root"], "left")
        if joined.filter("_root is not null").isEmpty():
            return now
        now = checkpointed(
            joined.select("conv_id", "turn", F.coalesce("_root", "root").alias("root"), (F.col("depth") + F.coalesce("_depth", F.lit(0))).alias("depth"))
        )


def reply_ordered(messages: DataFrame) -> DataFrame:
    """Conversations without quotes, in reply order.

    Returns a row for each message: conv_id, turn, role, body, n_quotes, n_linked, reply_to (the
    turn that its outermost linked quote comes from, null for none), thread_root, depth, and
    position: place in the conversation when threads follow each other by their first turn and
    messages in a thread by turn, so that a reply follows what it answers.
    """
    links = quote_links(messages)
    per = links.groupBy("conv_id", "turn", "message").agg(
        F.count("*").alias("n_quotes"),
        F.count("source_turn").alias("n_linked"),
        F.min(F.when(F.col("source_turn").isNotNull(), F.struct("level", "place", "source_turn")))["source_turn"].alias("reply_to"),
    )
    per = checkpointed(per)
    replies = per.filter("reply_to is not null").groupBy("conv_id", "turn").agg(F.min("reply_to").alias("reply_to"))
    threads = _threads(replies)
    bodies = parsed(messages).select("conv_id", "turn", "role", "body", F.md5(F.coalesce("text", F.lit(""))).alias("message"))
    own = per.withColumnsRenamed({"conv_id": "_conv", "turn": "_turn", "message": "_message"})
    whole = (
        bodies.join(own, F.col("conv_id").eqNullSafe(F.col("_conv")) & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("message") == F.col("_message")), "left")
        .join(threads, ["conv_id", "turn"], "left")
        .select(
            "conv_id", "turn", "role", "body", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
            "reply_to", F.coalesce("root", "turn").alias("thread_root"), F.coalesce("depth", F.lit(0)).alias("depth"), "message",
        )
    )
    ranked, _ = globally_ranked(whole, "conv_id", "thread_root", "turn", "message", rank="_rank")
    first = ranked.groupBy("conv_id").agg(F.min("_rank").alias("_first")).withColumnRenamed("conv_id", "_conv")
    return ranked.join(first, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id", "turn", "role", "reply_to", "thread_root", "depth", (F.col("_rank") - F.col("_first")).alias("position"), "n_quotes", "n_linked", "body"
    )


#: The same in DuckDB, over the view ``conversations``.
ORACLE = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, md5(coalesce(text, '')) AS message, row_number() OVER () AS rid FROM conversations),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM m),
marked AS (SELECT *, regexp_extract(line, '^(?:[ \t]{0,3}>)+') AS marks, regexp_replace(line, '^(?:[ \t]{0,3}>)+[ \t]?', '') AS content FROM lines),
levelled AS (SELECT *, len(marks) - len(replace(marks, '>', '')) AS level FROM marked),
steps AS (SELECT *, (lag(level) OVER (PARTITION BY rid ORDER BY pos) IS DISTINCT FROM level)::INT AS step FROM levelled),
placed AS (SELECT *, sum(step) OVER (PARTITION BY rid ORDER BY pos) AS place FROM steps),
runs AS (SELECT rid, place, any_value(level) AS level, string_agg(content, chr(10) ORDER BY pos) AS run, list(content ORDER BY pos) AS contents FROM placed GROUP BY 1, 2),
keys AS (SELECT rid, place, level, run, unnest(list_concat([run], contents)) AS k, unnest(range(len(contents) + 1)) AS preference FROM runs),
plain AS (SELECT keys.*, conv_id, turn, lower(trim(regexp_replace(k, '\s+', ' ', 'g'))) AS key FROM keys JOIN m USING (rid)),
holders AS (SELECT conv_id, key, min(turn) AS source_turn FROM plain WHERE level = 0 AND key <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY 1, 2),
links AS (
  SELECT rid, place, level, coalesce(min(source_turn) FILTER (WHERE whole > 0), CASE WHEN 2 * max(n) FILTER (WHERE source_turn IS NOT NULL) >= sum(n)
           THEN arg_min(source_turn, -n * 1000000 + source_turn) FILTER (WHERE source_turn IS NOT NULL AND n > 0) END) AS source_turn
  FROM (
    SELECT p.rid, place, level, CASE WHEN source_turn < turn THEN source_turn END AS source_turn,
           count(*) FILTER (WHERE preference = 0) AS whole, count(*) FILTER (WHERE preference > 0) AS n
    FROM plain p LEFT JOIN holders h ON h.conv_id = p.conv_id AND h.key = p.key
    WHERE level > 0 AND p.key <> '' AND trim(regexp_replace(run, '\s+', ' ', 'g')) <> '' GROUP BY 1, 2, 3, 4
  ) GROUP BY 1, 2, 3
), per AS (
  SELECT rid, count(*) AS n_quotes, count(source_turn) AS n_linked, arg_min(source_turn, level * 1000000 + place) FILTER (WHERE source_turn IS NOT NULL) AS reply_to FROM links GROUP BY 1
), replies AS (SELECT conv_id, turn, min(reply_to) AS up FROM per JOIN m USING (rid) WHERE reply_to IS NOT NULL GROUP BY 1, 2),
climb(conv_id, turn, root, depth) AS (
  SELECT conv_id, turn, up, 1 FROM replies
  UNION ALL SELECT c.conv_id, c.turn, r.up, c.depth + 1 FROM climb c JOIN replies r ON r.conv_id = c.conv_id AND r.turn = c.root
), threads AS (SELECT conv_id, turn, arg_max(root, depth) AS root, max(depth) AS depth FROM climb GROUP BY 1, 2),
bodies AS (
  SELECT rid, CASE WHEN max(level) > 0 THEN regexp_replace(coalesce(string_agg(run, chr(10) ORDER BY place) FILTER (WHERE level = 0), ''), '^\s*\n|\s+$', '', 'g') END AS body FROM runs GROUP BY 1
)
SELECT m.conv_id, m.turn, role, reply_to, coalesce(root, m.turn) AS thread_root, coalesce(depth, 0)::INT AS depth,
       row_number() OVER (PARTITION BY m.conv_id ORDER BY coalesce(root, m.turn) NULLS FIRST, m.turn NULLS FIRST, message) - 1 AS position,
       coalesce(n_quotes, 0) AS n_quotes, coalesce(n_linked, 0) AS n_linked, coalesce(body, m.text) AS body
FROM m LEFT JOIN per USING (rid) LEFT JOIN threads t ON t.conv_id = m.conv_id AND t.turn = m.turn LEFT JOIN bodies USING (rid)
"""
