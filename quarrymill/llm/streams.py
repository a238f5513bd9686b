"""Count streams of n-grams: block-combined counting, and lockstep merging of sorted orders.

Tables of bits only spare work: a key that is set without need costs a count that is thrown away.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrymill.llm.common import checkpointed

#: Tokens that a task counts in memory at a time.
BLOCK_TOKENS = 2_000_000
#: Places of a block that are looked at together, as each costs several words of memory.
_STEP = 2**17
#: Bytes of a text that are taken apart at a time.
PIECE_BYTES = 1_000_000
#: Bits of the table that stands for the frequent n-grams of one order; what does not fit well is
#: counted without need, never lost.
MOST_BITS = 2**27
#: Bits of a key of several words, which are shuffled; where two meet, both are counted by their words.
KEY_BITS = 48
_KEY = np.uint64(2**KEY_BITS - 1)
_SECOND = KEY_BITS - MOST_BITS.bit_length() + 1
#: Rows of an Arrow batch that goes back to Spark.
_ROWS = 50_000
#: A-Z in lower case, ends of pieces as one mark, tabs as blanks.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
#: The end of a piece among the words; no UTF-8 text holds this byte.
_END = b"\xff"


# --- frequent n-grams as bits -------------------------------------------------------------------


def word_key(lang: str, word: str) -> Column:
    """The key of a language's word in tables of bits; workers compute the same."""
    x = F.xxhash64(lang)
    return F.shiftleft(x, 13).bitwiseOR(F.shiftrightunsigned(x, 51)).bitwiseXOR(F.xxhash64(word))


def frequent_bits(frequent: DataFrame, key: Column, rows: int) -> np.ndarray:
    """A table of bits, two for each key of ``frequent``; at most ``MOST_BITS`` of them.

    Bits are set and joined by Spark; the driver gets words of 64 bits.
    """
    bits = 2**16
    while bits < min(16 * rows, MOST_BITS):
        bits *= 2
    at = F.explode(F.array(key.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(key, _SECOND).bitwiseAND(F.lit(bits - 1))))
    cells = frequent.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[cells["cell"].to_numpy()] = cells["bits"].to_numpy().view(np.uint64)
    return out


def _is_set(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    mask, found = np.uint64(table.size * 64 - 1), np.ones(key.size, bool)
    for at in (key & mask, (key >> np.uint64(_SECOND)) & mask):
        found &= (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def _rotated(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


# --- counting -----------------------------------------------------------------------------------


class _Ids(dict):
    """Numbers of the words of one language, given as they are first seen."""

    def __init__(self, block: _Block, lang: str):
        super().__init__({_END: 0})
        self.block, self.lang = block, lang

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self.block.words)
        self.block.words.append(word)
        self.block.langs.append(self.lang)
        return k


class _Block:
    """Words of neighbouring texts; an n-gram is counted once the two words after its first are known."""

    def __init__(self) -> None:
        self.words, self.langs, self.ids, self.parts, self.size = [b""], [""], {}, [], 0

    def add(self, lang: str, words: list[bytes]) -> None:
        ids = self.ids.get(lang) or self.ids.setdefault(lang, _Ids(self, lang))
        self.parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def rest(self) -> _Block:
        """A new block that begins with the last two words, whose n-grams are still open."""
        out = _Block()
        for k in self._whole()[-2:].tolist():
            out.add(self.langs[k], [self.words[k] or _END])
        return out

    def _keys(self) -> tuple[np.ndarray, np.ndarray]:
        """For each word the hashes of itself and of its language."""
        import xxhash

        hashed = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in self.words), np.uint64, len(self.words))
        langs = {lang: xxhash.xxh64_intdigest(lang.encode(), 42) for lang in {"", *self.ids}}
        return hashed, _rotated(np.fromiter(map(langs.__getitem__, self.langs), np.uint64, len(self.langs)), 13)

    def single(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the distinct words, and their counts."""
        counts = np.bincount(self._whole()[:-2], minlength=1)
        counts[0] = 0
        distinct = np.flatnonzero(counts)
        return distinct, counts[distinct]

    def _whole(self) -> np.ndarray:
        """The numbers of all words, kept in one piece from now on."""
        if len(self.parts) > 1:
            self.parts = [np.concatenate(self.parts)]
        return self.parts[0]

    def _places(self, found: Callable[[int, int], np.ndarray], size: int) -> np.ndarray:
        """The places below ``size`` that ``found`` says of a stretch, a stretch at a time."""
        return np.concatenate([np.zeros(0, np.int32), *((np.flatnonzero(found(at, min(at + _STEP, size))) + at).astype(np.int32) for at in range(0, size, _STEP))])

    def _gathered(self, made: Callable[[np.ndarray], np.ndarray], places: np.ndarray, kind: type) -> np.ndarray:
        """``made`` of the places, a stretch of them at a time."""
        out = np.empty(places.size, kind)
        for at in range(0, places.size, _STEP):
            out[at : at + _STEP] = made(places[at : at + _STEP])
        return out

    def _known(self, x: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, Callable[[np.ndarray], np.ndarray]]:
        """Whether each pair of neighbours is set in a table of pairs, and the keys of the runs of three at given places."""
        hashed, langs = self._keys()
        own = langs ^ hashed
        known = np.empty(x.size - 1, bool)
        for at in range(0, known.size, _STEP):
            first, second = x[at : at + _STEP][: known.size - at], x[at + 1 : at + 1 + _STEP]
            known[at : at + _STEP] = _is_set(table, (own[first] ^ _rotated(hashed[second], 29)) & _KEY) & (first > 0) & (second > 0)
        return known, lambda places: (own[x[places]] ^ _rotated(hashed[x[places + 1]], 29) ^ _rotated(hashed[x[places + 2]], 47)) & _KEY

    def pairs(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of distinct neighbours that are both set in a table of words."""
        x, (hashed, langs) = self._whole(), self._keys()
        own = langs ^ hashed
        known = _is_set(table, own)
        known[0] = False
        starts = self._places(lambda a, z: known[x[a:z]] & known[x[a + 1 : z + 1]], max(x.size - 2, 0))
        return _counted(self._gathered(lambda at: (own[x[at]] ^ _rotated(hashed[x[at + 1]], 29)) & _KEY, starts, np.uint64))

    def triples(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of distinct runs of three words whose pairs are both set in a table of pairs."""
        known, key = self._known(self._whole(), table)
        starts = self._places(lambda a, z: known[a:z] & known[a + 1 : z + 1], known.size - 1)
        return _counted(self._gathered(key, starts, np.uint64))

    def phrases(self, pairs: np.ndarray, triples: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Numbers of the words, 0 for none, and counts of distinct phrases of 2 and 3 words that are set in the tables."""
        x = self._whole()
        known, key = self._known(x, pairs)
        starts = self._places(lambda a, z: known[a:z], known.size - 1)
        neighbours = lambda at: (x[at].astype(np.int64) << 32) | x[at + 1]
        packed, counts = _counted(self._gathered(neighbours, starts, np.int64))
        more = starts[self._gathered(lambda at: known[at + 1] & _is_set(triples, key(at)), starts, bool)]
        del starts, known
        longer, inner = _counted(self._gathered(lambda at: (np.searchsorted(packed, neighbours(at)) << 32) | x[at + 2], more, np.int64))
        packed = np.concatenate([packed, packed[longer >> 32]])
        third = np.concatenate([np.zeros(len(counts), np.int64), longer & 0xFFFFFFFF])
        return [packed >> 32, packed & 0xFFFFFFFF, third], np.concatenate([counts, inner])


def _counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and their counts; the values are sorted in place."""
    values.sort()
    heads = np.empty(values.size, bool)
    heads[:1] = True
    np.not_equal(values[1:], values[:-1], out=heads[1:])
    starts = np.flatnonzero(heads)
    return values[starts], np.diff(starts, append=values.size)


def _slices(text: bytes) -> Iterator[bytes]:
    """The text in pieces of bounded size that end between words."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        end = max(text.rfind(b" ", at, at + PIECE_BYTES), text.rfind(b"\n", at, at + PIECE_BYTES))
        if end < at:  # a word longer than a piece
            ends = [k for k in (text.find(b" ", at), text.find(b"\n", at)) if k >= 0]
            end = min(ends, default=len(text) - 1)
        yield text[at : end + 1]
        at = end + 1
    yield text[at:]


def _words(text: bytes) -> Iterator[list[bytes]]:
    for piece in _slices(text.translate(_PLAIN)):
        yield piece.replace(b"\n", b" \xff ").split()
    yield [_END, _END]


def _blocks(made: Callable[[_Block], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``made`` of all blocks of the texts (lang, text) of a partition."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for part in parts:
            for lang, text in zip(part["lang"].to_pylist(), part["text"].cast(pa.binary()), strict=True):
                for words in _words(text.as_py()):
                    if block.size >= BLOCK_TOKENS:
                        yield from made(block)
                        block = block.rest()
                    block.add(lang, words)
        if block.size:
            yield from made(block)

    return run


def _named(block: _Block, grams: list[np.ndarray], counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Batches of n-grams (lang, gram, n): their words, none for number 0, with blanks between."""
    words = pa.array([None, *block.words[1:]], pa.binary()).cast(pa.string(), safe=False)
    langs = pa.array(block.langs)
    for at in range(0, len(counts), _ROWS):
        taken = [pa.array(g[at : at + _ROWS]) for g in grams]
        gram = pc.binary_join_element_wise(*[words.take(g) for g in taken], " ", null_handling="skip")
        yield pa.RecordBatch.from_arrays([langs.take(taken[0]), gram, pa.array(counts[at : at + _ROWS], pa.int64())], names=["lang", "gram", "n"])


GRAM = "lang string, gram string, n long"


def word_counts(texts: DataFrame) -> DataFrame:
    """Words of ``texts`` (lang, text) with their counts in blocks: lang, gram, n; a null word counts all of a language."""

    def made(block: _Block) -> Iterator[pa.RecordBatch]:
        distinct, counts = block.single()
        yield from _named(block, [distinct], counts)
        of, sums = np.array([block.langs[k] for k in distinct], object), {}
        for lang, n in zip(of, counts.tolist(), strict=True):
            sums[lang] = sums.get(lang, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.nulls(len(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["lang", "gram", "n"])

    return texts.mapInArrow(_blocks(made), GRAM)


def key_counts(texts: DataFrame, table, order: int) -> DataFrame:
    """Keys of runs of ``order`` words (2 or 3) whose parts are in the broadcast ``table``, with their counts in blocks: key, n."""

    def made(block: _Block) -> Iterator[pa.RecordBatch]:
        keys, counts = (block.pairs if order == 2 else block.triples)(table.value)
        for at in range(0, len(counts), _ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + _ROWS].view(np.int64)), pa.array(counts[at : at + _ROWS], pa.int64())], names=["key", "n"])

    return texts.mapInArrow(_blocks(made), "key long, n long")


def phrase_counts(texts: DataFrame, pairs, triples) -> DataFrame:
    """Phrases of 2 and 3 words that are in the broadcast tables, with their counts in blocks: lang, gram, n."""
    return texts.mapInArrow(_blocks(lambda block: _named(block, *block.phrases(pairs.value, triples.value))), GRAM)


# --- sorted streams -----------------------------------------------------------------------------


def in_order(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The stream sorted by language and keys, shorter n-grams before those that they begin.

    Written once, as range bounds come from a sample; a frequent word's n-grams are spread over
    partitions by their later words.
    """
    return checkpointed(stream.repartitionByRange("lang", *keys).sortWithinPartitions("lang", *keys))


def _filled(n: np.ndarray, heads: np.ndarray, before: int) -> np.ndarray:
    """For each row the count of the last head up to it."""
    at = np.maximum.accumulate(np.where(heads, np.arange(n.size), -1))
    return np.where(at >= 0, n[at], before)


def _open_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a partition: its rows, its last heads, and the greatest count before its first head."""
    rows, last, lead, headed = 0, {1: None, 2: None}, 0, False
    for batch in batches:
        order, n = batch["order"].to_numpy(), batch["n"].to_numpy()
        heads = np.flatnonzero(order < 3)
        if not headed:
            lead = max(lead, int(n[: heads[0] if heads.size else n.size].max(initial=0)))
        rows, headed = rows + n.size, headed or heads.size > 0
        for k in (1, 2):
            if (order == k).any():
                last[k] = int(n[np.flatnonzero(order == k)[-1]])
    yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "rows": [rows], "first": [last[1]], "second": [last[2]], "lead": [lead], "headed": [bool(headed)]})


def lockstep(ordered: DataFrame, names: tuple[str, str, str]) -> tuple[DataFrame, int]:
    """One pass over a stream in order; also the number of its rows.

    Every row gets, under the first two names, the counts of its first word (or last, in suffix
    order) and of its first two; every n-gram of two words gets, under the third, the greatest
    count of those of three that it begins.  A task keeps one open row.  Where partitions meet,
    counts are carried over from one row for each partition, the only thing the driver sees.
    """
    ends = ordered.select("order", "n").mapInArrow(_open_ends, "part long, rows long, first long, second long, lead long, headed boolean").collect()
    ends, carry, first, second = sorted(ends, key=lambda r: r["part"]), {}, 0, 0
    for r in ends:
        carry[r["part"]] = [first, second, 0]
        first, second = first if r["first"] is None else r["first"], second if r["second"] is None else r["second"]
    after = 0
    for r in reversed(ends):
        carry[r["part"]][2] = after
        after = r["lead"] if r["headed"] else max(after, r["lead"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before1, before2, after = carry[TaskContext.get().partitionId()]
        held, longest = None, 0

        def made(batch: pa.RecordBatch, *columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, pa.int64()) for x in columns]], names=[*batch.schema.names, *names])

        for batch in batches:
            if not batch.num_rows:
                continue
            order, n = batch["order"].to_numpy(), batch["n"].to_numpy()
            one, two = _filled(n, order == 1, before1), _filled(n, order == 2, before2)
            before1, before2 = int(one[-1]), int(two[-1])
            heads, threes = np.flatnonzero(order < 3), np.where(order == 3, n, 0)
            longest = max(longest, int(threes[: heads[0] if heads.size else n.size].max(initial=0)))
            most, kept = np.zeros(n.size, np.int64), np.ones(n.size, bool)
            if heads.size:
                if held is not None:
                    yield made(*held, [longest])
                    held = None
                most[heads] = np.maximum.reduceat(threes, heads)
                at, longest = heads[-1], int(most[heads[-1]])
                if order[at] == 2:  # its longer n-grams may go on
                    held, kept[at] = (batch.slice(at, 1), [one[at]], [two[at]]), False
            yield made(batch.filter(pa.array(kept)), one[kept], two[kept], most[kept])
        if held is not None:
            yield made(*held, [max(longest, after)])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    return ordered.mapInArrow(run, f"{schema}, {', '.join(f'{x} long' for x in names)}"), sum(r["rows"] for r in ends)
