"""Byte-level BPE by tree concatenation: encode parts, then repair around each join.

A text is cut into a binary tree of parts.  The parts are encoded on their own; joining two
neighbours re-encodes a window around the join, grown until its first token equals the left
side's token there and its last token the right side's.  A sequence of byte-pair tokens is the
encoding of its text exactly if every two neighbours are, so the joined sequence then is what
encoding the whole text gives.  Parts of long texts are encoded by different tasks.

Edge cases: a null text counts as empty and gives no ids; equal texts of any number share one
encoding when they are long; the special strings of the tokenizer file become their own ids,
as the tokenizers library has it; texts of any length are encoded whole; repeated rows each
stay; an empty table gives no rows; extra columns, whatever their names, come back in ``row``.
"""

from __future__ import annotations

import functools
import json
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import slices

#: The pre-token pattern and the printable bytes of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]

#: Characters in a part that is encoded at once, tokens on each side of a join at first, and
#: characters above which a text's parts are dealt out to different tasks.
LEAF_CHARS, WINDOW, SPREAD_CHARS = 8192, 16, 32768


@functools.cache
def load(path: str):
    """The encoding in a tokenizers file, once for each Python worker.

    The file's vocabulary is used as merge ranks; that is right only where ids follow the
    order of the merges, which is checked.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    vocab, merges = data["model"]["vocab"], data["model"]["merges"]
    rest = iter(range(256, 512))
    of_char = {chr(b) if b in PRINTABLE else chr(next(rest)): b for b in range(256)}
    pairs = [m if isinstance(m, str) else " ".join(m) for m in merges]
    if any(vocab[m.replace(" ", "")] != 256 + k for k, m in enumerate(pairs)):
        raise ValueError(f"ids of {path} do not follow the order of its merges")
    special = {t["content"]: t["id"] for t in data["added_tokens"]}
    ranks = {bytes(of_char[c] for c in token): k for token, k in vocab.items() if token not in special}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode_part(enc, text: str) -> np.ndarray:
    return enc.encode_to_numpy(text, allowed_special="all").astype(np.int32) if text else np.zeros(0, np.int32)


def _cut(text: str, lo: int, hi: int, special: list[str]) -> int:
    """A place near the middle of text[lo:hi] to cut at.

    Best is the start of white space after something else, where every pre-token ends; without
    one nearby the exact middle is taken, moved before a special string that covers it.
    """
    mid, reach = (lo + hi) // 2, (hi - lo) // 4
    for at in (text.rfind(" ", mid - reach, mid), text.find(" ", mid, mid + reach)):
        if at > lo and not text[at - 1].isspace():
            return at
    for s in special:
        at = text.find(s, max(lo, mid - len(s) + 1), mid + len(s) - 1)
        if lo < at < mid < at + len(s):
            return at
    return mid


def cut(text: str, leaf: int, special: list[str]) -> list[str]:
    """The parts of a text in order, none longer than ``leaf``; their number is a power of two."""
    spans = [(0, len(text))]
    while max(hi - lo for lo, hi in spans) > leaf:
        nxt = []
        for lo, hi in spans:
            at = _cut(text, lo, hi, special) if hi - lo > 1 else hi
            nxt += [(lo, at), (at, hi)]
        spans = nxt
    return [text[lo:hi] for lo, hi in spans]


def join(enc, a: np.ndarray, b: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The ids of the concatenation of two encoded texts."""
    if not len(a) or not len(b):
        return a if len(a) else b
    while True:
        left, right = a[max(0, len(a) - window) :], b[:window]
        try:
            text = enc.decode_bytes([*left.tolist(), *right.tolist()]).decode("utf-8")
        except UnicodeDecodeError:  # the window starts or ends inside a character
            text = None
        if text is not None:
            again = encode_part(enc, text)
            if (len(left) == len(a) or again[0] == left[0]) and (len(right) == len(b) or again[-1] == right[-1]):
                return np.concatenate([a[: len(a) - len(left)], again, b[len(right) :]])
        window *= 2


def join_all(enc, parts: list[np.ndarray]) -> np.ndarray:
    """Joins neighbours level by level, as the tree was cut."""
    while len(parts) > 1:
        parts = [join(enc, parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def encode_text(enc, text: str | None, leaf: int = LEAF_CHARS) -> np.ndarray:
    if not text:
        return np.zeros(0, np.int32)
    return join_all(enc, [encode_part(enc, p) for p in cut(text, leaf, list(enc._special_tokens))])


def _ids_column(lists: list[np.ndarray]) -> pa.Array:
    ends = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists) if lists else [], pa.int32()))


def encode(docs: DataFrame, path: str, text: str = "text", leaf: int = LEAF_CHARS, spread: int = SPREAD_CHARS) -> DataFrame:
    """The other columns of ``docs`` as the struct ``row``, and the ``ids`` (array of int) of its column ``text``.

    Texts up to ``spread`` characters are encoded where they lie.  Longer ones are encoded once
    for each distinct text: their parts are dealt out over tasks and joined by text hash.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    kept = docs.select(F.struct(*others or [F.lit(None).cast("string").alias("none")]).alias("row"), F.col(text).alias("text"))
    schema = kept.select("row", F.lit(None).cast("array<int>").alias("ids")).schema

    def local(batches):
        enc = load(path)
        for batch in slices(batches):
            made = _ids_column([encode_text(enc, t, leaf) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("row"), made], names=["row", "ids"])

    is_long = F.coalesce(F.length("text") > spread, F.lit(False))
    near = kept.filter(~is_long).mapInArrow(local, schema)

    def parts_of(batches):
        special = list(load(path)._special_tokens)
        for batch in slices(batches):
            for key, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts = cut(t, leaf, special)
                yield pa.RecordBatch.from_pydict({"key": [key] * len(parts), "part": pa.array(range(len(parts)), pa.int32()), "text": parts})

    def encode_parts(batches):
        enc = load(path)
        for batch in slices(batches):
            made = _ids_column([encode_part(enc, t) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("part"), made], names=["key", "part", "ids"])

    def joined(key, rows):
        parts = rows.sort_values("part").ids
        return pd.DataFrame({"key": [key[0]], "ids": [join_all(load(path), [np.asarray(p, np.int32) for p in parts])]})

    long = kept.filter(is_long).withColumn("key", F.sha2("text", 256))
    distinct = long.select("key", "text").dropDuplicates(["key"])
    parts = distinct.mapInArrow(parts_of, "key string, part int, text string").repartition("key", "part")
    whole = parts.mapInArrow(encode_parts, "key string, part int, ids array<int>").groupBy("key").applyInPandas(joined, "key string, ids array<int>")
    return near.unionByName(long.select("row", "key").join(whole, "key").select("row", "ids"))


def decode(encoded: DataFrame, path: str, ids: str = "ids", keep_ids: bool = False) -> DataFrame:
    """The other columns of ``encoded`` as the struct ``row``, and the text ``decoded`` from its column ``ids`` (and ``ids`` too if asked for).

    Bytes that are not UTF-8 become replacement characters; null ids give an empty text.
    """

    def run(batches):
        enc = load(path)
        for batch in slices(batches):
            column = batch.column("ids")
            values, ends = column.values.to_numpy(), column.offsets.to_numpy()
            made = [enc.decode_bytes(values[a:b].tolist()).decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
            columns = {"row": batch.column("row"), "decoded": pa.array(made, pa.string())} | ({"ids": column} if keep_ids else {})
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    others = [F.col(f"`{c}`") for c in encoded.columns if c != ids]
    whole = encoded.select(F.struct(*others or [F.lit(None).cast("string").alias("none")]).alias("row"), F.coalesce(ids, F.array().cast("array<int>")).alias("ids"))
    return whole.mapInArrow(run, whole.select("row", F.lit("").alias("decoded"), *(["ids"] if keep_ids else [])).schema)


def digested(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """For each document: number of tokens, SHA-256 of its ids and of its decoded text, and the ids if asked for."""
    encoded = encode(docs.select("doc_id", "text"), path).select(
        F.col("row.doc_id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), "ids"
    )
    out = decode(encoded, path, keep_ids=keep_ids)
    return out.select("row.*", F.sha2("decoded", 256).alias("decoded_sha256"), *(["ids"] if keep_ids else []))


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """For each document: doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    return digested(docs, path)
