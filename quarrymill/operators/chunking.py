"""Sections to chunks: blocks, greedy packing with overlap, rebalancing, ids and links."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrymill.functions.text import TOKEN, bound, columns, matches, stripped, token_count, uuid5

#: A fenced block, or what lies between fenced blocks.
FENCE_OR_TEXT = r"(?s)```.*?```|(?:(?!```.*?```).)+"
TEXT_LANGUAGES = ("markdown", "html", "pdf", "text")
GLUE = "\n\n"


@dataclass(frozen=True)
class ChunkSizes:
    """Token bounds; zero or nothing means the default."""

    least: int = 500
    most: int = 1200
    overlap: int = 125

    @classmethod
    def of(cls, least: int | None = None, most: int | None = None, overlap: int | None = None) -> ChunkSizes:
        return cls(least or cls.least, most or cls.most, overlap or cls.overlap)


def blocks(text: Column) -> Column:
    """Fenced blocks whole, other text at blank lines; an empty text is one block."""
    parts = F.when(F.contains(text, F.lit("```")), matches(text, FENCE_OR_TEXT)).otherwise(F.array(text))
    cut = F.flatten(
        F.transform(parts, lambda p: F.when(F.startswith(stripped(p), F.lit("```")), F.array(stripped(p))).otherwise(F.transform(F.split(p, r"\n\s*\n"), stripped)))
    )
    kept = F.filter(cut, lambda b: b != "")
    return bound(kept, lambda k: F.when(F.size(k) > 0, k).otherwise(F.array(text)))


def packed(parts: Column, sizes: ChunkSizes) -> Column:
    """Blocks greedily joined to texts of at most ``most`` tokens; a larger block stays whole.

    Tokens do not reach over blocks, so each block is counted once and the fold is over numbers:
    a chunk is a run of blocks, and the next one begins at the last blocks of it that reach
    ``overlap`` tokens, at least one.  Texts are cut out at the end.
    """

    def runs(counts: Column) -> Column:
        span = lambda a, b: F.struct(a.alias("start"), b.alias("stop"))
        state = F.struct(F.lit(0).alias("at"), F.lit(0).alias("start"), F.lit(0).alias("tokens"), F.array().cast("array<struct<start:int,stop:int>>").alias("done"))

        def back(acc: Column) -> Column:
            """(blocks, tokens) from the end of the present chunk that the next one begins with."""
            kept = F.struct(F.lit(0).alias("blocks"), F.lit(0).alias("tokens"))
            return F.aggregate(
                F.reverse(F.slice(counts, acc["start"] + 1, acc["at"] - acc["start"])),
                kept,
                lambda k, n: F.when((k["blocks"] > 0) & (k["tokens"] >= sizes.overlap), k).otherwise(
                    F.struct((k["blocks"] + 1).alias("blocks"), (k["tokens"] + F.greatest(F.lit(1), n)).alias("tokens"))
                ),
            )

        def add(acc: Column, n: Column) -> Column:
            full = (acc["at"] > acc["start"]) & (acc["tokens"] + n > sizes.most)
            longer = F.struct((acc["at"] + 1).alias("at"), acc["start"].alias("start"), (acc["tokens"] + n).alias("tokens"), acc["done"].alias("done"))
            cut = bound(
                back(acc),
                lambda k: F.struct(
                    (acc["at"] + 1).alias("at"),
                    (acc["at"] - k["blocks"]).alias("start"),
                    (F.aggregate(F.slice(counts, acc["at"] - k["blocks"] + 1, k["blocks"]), F.lit(0), lambda s, x: s + x) + n).alias("tokens"),
                    F.array_append(acc["done"], span(acc["start"], acc["at"])).alias("done"),
                ),
            )
            return F.when(full, cut).otherwise(longer)

        return F.aggregate(counts, state, add, lambda acc: F.array_append(acc["done"], span(acc["start"], acc["at"])))

    def texts(parts: Column) -> Column:
        found = bound(F.transform(parts, lambda b: F.regexp_count(b, F.lit(TOKEN))), runs)
        return F.transform(found, lambda r: stripped(F.array_join(F.slice(parts, r["start"] + 1, r["stop"] - r["start"]), GLUE)))

    return bound(parts, texts)


def rebalanced(texts: Column, sizes: ChunkSizes) -> Column:
    """Small texts put before the next large one, the last small ones after the last; with indices.

    Elements are (text, index): a text that was not merged keeps its index before rebalancing.
    """
    state = F.struct(F.array().cast("array<struct<text:string,index:int>>").alias("out"), F.lit("").alias("held"), F.lit(0).alias("at"))

    def add(acc: Column, sized: Column) -> Column:
        text = sized["text"]
        keep = sized["enough"] | (F.size(acc["out"]) == 0)
        merged = F.when(acc["held"] != "", stripped(F.concat(acc["held"], F.lit(GLUE), text))).otherwise(text)
        index = F.when(acc["held"] != "", F.size(acc["out"])).otherwise(acc["at"])
        return F.struct(
            F.when(keep, F.array_append(acc["out"], F.struct(merged.alias("text"), index.alias("index")))).otherwise(acc["out"]).alias("out"),
            F.when(keep, F.lit("")).otherwise(stripped(F.concat(acc["held"], F.lit(GLUE), text))).alias("held"),
            (acc["at"] + 1).alias("at"),
        )

    def close(acc: Column) -> Column:
        last = F.element_at(acc["out"], -1)
        joined = F.struct(stripped(F.concat(last["text"], F.lit(GLUE), acc["held"])).alias("text"), (F.size(acc["out"]) - 1).alias("index"))
        return F.when(acc["held"] != "", F.array_append(F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1), joined)).otherwise(acc["out"])

    def all_of(found: Column) -> Column:
        one = F.transform(found, lambda t, k: F.struct(t.alias("text"), k.alias("index")))
        sized = F.transform(found, lambda t: F.struct(t.alias("text"), (token_count(t) >= sizes.least).alias("enough")))
        return F.when(F.size(found) < 2, one).otherwise(F.aggregate(sized, state, add, close))

    return bound(texts, all_of)


def chunk_type(kind: Column, language: Column, text: Column) -> Column:
    textual = language.isNull() | language.isin(*TEXT_LANGUAGES)
    return (
        F.when(kind.isin("architecture", "config"), kind)
        .when(F.startswith(text, F.lit("```")) | ~textual, "code")
        .when(language.isin("markdown", "html", "pdf"), language)
        .otherwise("mixed")
    )


def chunk_id(path: Column, digest: Column, title: Column, index: Column, text: Column) -> Column:
    name = F.concat_ws(":", path, digest, F.coalesce(title, F.lit("None")), index.cast("string"), F.substring(text, 1, 128))
    return uuid5(name)


def chunks(sections: DataFrame, sizes: ChunkSizes | None = None, key: str | Sequence[str] = "path") -> DataFrame:
    """Chunks of sections: adds chunk_idx, text, id, chunk_type, token_count, prev and next ids.

    ``sections`` has path, language, source_hash, section_idx, title, kind, content, hierarchy.
    Links follow the order in the document, which ``key`` names (repository and path where several
    repositories are there); equal ids are kept, as links may name them.
    """
    sizes = sizes or ChunkSizes()
    made = sections.withColumn("_texts", packed(blocks(F.col("content")), sizes)).withColumn("_chunks", rebalanced(F.col("_texts"), sizes))
    rows = made.select(*sections.columns, F.posexplode("_chunks").alias("chunk_idx", "c")).withColumns({"text": F.col("c.text"), "index": F.col("c.index")}).drop("c")
    order = Window.partitionBy(*columns(key)).orderBy("section_idx", "chunk_idx")
    named = rows.withColumns(
        {
            "id": chunk_id(F.col("path"), F.col("source_hash"), F.col("title"), F.col("index"), F.col("text")),
            "chunk_type": chunk_type(F.col("kind"), F.col("language"), F.col("text")),
            "token_count": token_count(F.col("text")),
            "section": F.coalesce("title", F.try_element_at("hierarchy", F.lit(-1))),
            "section_hierarchy": F.when(F.size("hierarchy") > 0, F.col("hierarchy")).when(F.col("title").isNotNull(), F.array("title")).otherwise(F.array().cast("array<string>")),
        }
    )
    return named.withColumns({"prev_chunk_id": F.lag("id").over(order), "next_chunk_id": F.lead("id").over(order)})


def last_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key, the last by ``order``."""
    values = F.struct(*rows.columns)
    return rows.groupBy(key).agg(F.max_by(values, F.struct(*order)).alias("r")).select("r.*")
