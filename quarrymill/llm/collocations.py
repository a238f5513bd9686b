"""Phrase collocations from count streams in prefix and suffix order.

Words and phrases of up to three words are counted: a task counts a block of words in memory and
Spark sums the blocks' counts.  Pairs of frequent words, and triples of frequent pairs, are counted by
a key of 64 bits first, so that only phrases that can be frequent are counted by their words.  The
counts that stay are one stream.  In prefix order an n-gram follows
the shorter ones that begin it, in suffix order those that end it, so one pass over each order
merges the counts in lockstep: left and right parts of every cut, and the greatest count of the
longer phrases that go on with it.  No count is looked up in a table.

Words lose A-Z to lower case and break at blanks and tabs; phrases stay within pieces between
``. , ; : ! ?`` and line ends.  Each language is a corpus of its own.

Edge cases: null and empty texts have no words; a null language is ``und``; repeated rows count
each; doc_id plays no part; very long texts are taken apart in pieces, very long words stay whole;
an empty table gives no rows; other columns are not read.  Equal scores are ordered by count and then phrase.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.llm.common import checkpointed
from quarrymill.llm.streams import frequent_bits, in_order, key_counts, lockstep, phrase_counts, word_counts, word_key

#: Least count of a phrase.
LEAST = 10
#: Percentage of a phrase's occurrences from which on a longer phrase replaces it.
SHARE = 50
#: Phrases reported for each language.
TOP = 2000
#: Score of a phrase whose parts always stand together.
SCALE = 1_000_000


def count_stream(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """n-grams of one to three words with at least ``least`` occurrences (lang, w1, w2, w3, order, n), and all words of each language (lang, total)."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    spread = docs.sparkSession.sparkContext.broadcast

    def summed(counts: DataFrame, *keys: str) -> DataFrame:
        enough = F.col("n") >= least
        return checkpointed(counts.groupBy(*keys).agg(F.sum("n").alias("n")).filter(enough | F.col("gram").isNull() if "gram" in keys else enough))

    words = summed(word_counts(texts), "lang", "gram")
    totals, words = words.filter("gram IS NULL").select("lang", F.col("n").alias("total")), words.filter("gram IS NOT NULL")
    tables = [spread(frequent_bits(words, word_key("lang", "gram"), words.count()))]
    for order in (2, 3):
        keys = summed(key_counts(texts, tables[-1], order), "key")
        tables.append(spread(frequent_bits(keys, F.col("key"), keys.count())))
    phrases = summed(phrase_counts(texts, *tables[1:]), "lang", "gram")
    stream = words.unionByName(phrases).withColumn("w", F.split("gram", " "))
    return stream.select("lang", *[F.get("w", F.lit(k)).alias(f"w{k + 1}") for k in range(3)], F.size("w").alias("order"), "n"), totals


def scored(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, int]:
    """Candidates (lang, phrase, order, a, l, r, score, longer), all words of each language, and the number of n-grams merged.

    ``longer`` is the greatest count of a candidate that holds the phrase with one word more; no
    phrase that holds it with further words is more frequent.
    """
    stream, totals = count_stream(docs, least)
    forward, rows = lockstep(in_order(stream, ["w1", "w2", "w3"]), ("first", "first_two", "goes_on"))
    last = F.when(F.col("order") == 3, F.struct(F.col("w3").alias("z"), F.col("w2").alias("y"), F.col("w1").alias("x")))
    last = last.when(F.col("order") == 2, F.struct(F.col("w2").alias("z"), F.col("w1").alias("y"), F.lit(None).cast("string").alias("x")))
    last = last.otherwise(F.struct(F.col("w1").alias("z"), F.lit(None).cast("string").alias("y"), F.lit(None).cast("string").alias("x")))
    turned = forward.withColumn("_back", last).select("*", "_back.*").drop("_back", "w1", "w2", "w3")
    both, _ = lockstep(in_order(turned, ["z", "y", "x"]), ("last", "last_two", "begins"))

    exact = "cast((cast({0} as decimal(7,0)) * (cast(n as decimal(16,0)) * cast(n as decimal(16,0)))) div (cast({1} as decimal(16,0)) * cast({2} as decimal(16,0))) as long)"

    def cut_at(left: str, right: str, k: int):
        return F.struct(F.expr(exact.format(SCALE, left, right)).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))

    two = cut_at("first", "last", 1)
    three = F.least(cut_at("first", "last_two", 1), cut_at("first_two", "last", 2))
    phrase = F.when(F.col("order") == 2, F.concat_ws(" ", "y", "z")).otherwise(F.concat_ws(" ", "x", "y", "z"))
    out = both.filter(F.col("order") > 1).withColumn("best", F.when(F.col("order") == 2, two).otherwise(three))
    longer = F.when(F.col("order") == 2, F.greatest("goes_on", "begins")).otherwise(F.lit(0))
    return out.select("lang", phrase.alias("phrase"), "order", F.col("n").alias("a"), "best.l", "best.r", "best.score", longer.alias("longer")), totals, rows


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """The first ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A language's candidates are ranked in shares first; what the shares keep is as much as a share.
    """
    found, totals, rows = scored(docs, least)
    kept = found.filter(F.lit(100) * F.col("longer") < F.lit(share) * F.col("a"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(1 + math.isqrt(rows // top)))
    first = kept.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


_WORDS = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE = f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_WORDS}, '[.,;:!?\\n\\x0B\\x0C\\r]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS w FROM pieces),
placed AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded)),
one AS (SELECT lang, x AS g, count(*) AS f FROM placed GROUP BY ALL),
two AS (SELECT lang, x, y, x || ' ' || y AS g, count(*) AS f FROM placed WHERE y IS NOT NULL GROUP BY ALL),
three AS (SELECT lang, x, y, z, x || ' ' || y || ' ' || z AS g, count(*) AS f FROM placed WHERE z IS NOT NULL GROUP BY ALL HAVING f >= {LEAST}),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM one GROUP BY lang),
parts AS (
  SELECT t.lang, t.g, t.f AS a, 1 AS k, l.f AS l, r.f AS r FROM two t JOIN one l ON l.lang = t.lang AND l.g = t.x JOIN one r ON r.lang = t.lang AND r.g = t.y WHERE t.f >= {LEAST}
  UNION ALL SELECT t.lang, t.g, t.f, 1, l.f, r.f FROM three t JOIN one l ON l.lang = t.lang AND l.g = t.x JOIN two r ON r.lang = t.lang AND r.g = t.y || ' ' || t.z
  UNION ALL SELECT t.lang, t.g, t.f, 2, l.f, r.f FROM three t JOIN two l ON l.lang = t.lang AND l.g = t.x || ' ' || t.y JOIN one r ON r.lang = t.lang AND r.g = t.z
),
cuts AS (SELECT *, ({SCALE}::HUGEINT * a * a // (l::HUGEINT * r))::BIGINT AS score FROM parts),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
within AS (SELECT lang, g, max(f) AS longer FROM (SELECT lang, x || ' ' || y AS g, f FROM three UNION ALL SELECT lang, y || ' ' || z, f FROM three) GROUP BY ALL),
kept AS (SELECT b.*, b.g AS phrase FROM best b LEFT JOIN within w ON w.lang = b.lang AND w.g = b.g WHERE 100 * coalesce(longer, 0) < {SHARE} * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}"""
