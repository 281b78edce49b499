"""Collocations from weighted acyclic automata.

A count transducer is a tree-shaped automaton: arcs carry words in byte order, every state the number of times that the phrase leading
to it occurs. It is cut to pieces by ranges of prefixes: first words that begin alike share a piece; a common first word has pieces of its
own, one for each first byte of the second, or two in much text. A piece is the words, depths and weights of its states, each before those below it.
Pieces of all shards with the same range have the same key, and with more text ranges get narrower.

1. Words. Shards of text count their words; sums over shards give the frequent ones and all occurrences per language.
2. Pairs. Every shard sorts its pairs of frequent words and builds its automaton from them, one state for each new arc. Pieces are
   dealt by ranges of prefixes, and a range unites the pieces of all shards, summing weights; phrases below the least count go.
3. Longer phrases. The same with the sorted phrases of three to five words all of whose pairs are frequent, below prefixes of two words.
4. Parts. What candidates need to know of their parts is another automaton; its pieces meet the count pieces of the same prefix and both
   are walked together.

A phrase is frequent only if all its parts are. Which words and pairs are frequent is told to shards by bitmaps of fixed size; a hash that
collides there lets a rare phrase into a shard's automaton, and the union takes it out again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from isoloom.shared import discard, materialise

LONGEST, LEAST, BEST = 5, 100, 2000
SHARD_BYTES = 4 << 20
_BITS, _PAGE = 27, 15
KEY = ["lang", "prefix", "letter"]
#: words: those of all states, each with a blank after it; depth and weight: a byte and eight bytes a state.
PIECES = "lang string, prefix string, letter int, words string, depth binary, weight binary"
_SCHEMA = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("letter", pa.int32()), ("words", pa.string()), ("depth", pa.binary()), ("weight", pa.binary())])
#: A word is common if it is more than one in so many of its language; so there are no more of them.
COMMON = 1000
_STATES = 1 << 18  # states of pieces united at a time, or those of one key
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if chr(c) in ".,;:!?\n\v\f\r" else 32 if c == 9 else c for c in range(256))


def shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[str, bytes]]:
    """(lang, text) of about ``size`` bytes: A-Z in lower case, pieces end with a line feed, words with a blank.

    Texts of one language are put together, long ones cut where a piece ends; only a piece longer than ``size`` makes a longer text.
    """
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def cut(lang: str) -> Iterator[tuple[str, bytes]]:
        data, at = b"\n".join(held.pop(lang)), 0
        sizes.pop(lang)
        while at < len(data):
            end = len(data) if len(data) - at <= size + size // 4 else data.rfind(b"\n", at, at + size)
            if end < 0:
                end = data.find(b"\n", at + size)
                end = len(data) if end < 0 else end
            yield lang, data[at:end]
            pa.default_memory_pool().release_unused()
            at = end + 1

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
            held.setdefault(lang, []).append((text or b"").translate(_TABLE))
            sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1]) + 1
            if sizes[lang] >= size:
                yield from cut(lang)
            elif sum(sizes.values()) >= 4 * size:
                yield from cut(max(sizes, key=sizes.get))
    for lang in [*held]:
        yield from cut(lang)


def _split(data: np.ndarray, gap: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The runs of bytes between gaps as dictionary-coded text, and where they start."""
    starts, ends = np.flatnonzero(~gap & np.r_[True, gap[:-1]]), np.flatnonzero(~gap & np.r_[gap[1:], True]) + 1
    offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[~gap].tobytes())]).dictionary_encode(), starts


def _ordered(coded: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(vocabulary in byte order, number of every word there from 1 on)."""
    order = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(1, len(order) + 1)
    return coded.dictionary.take(pa.array(order)).cast(pa.string()), rank[coded.indices.to_numpy(zero_copy_only=False)]


def words(text: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(vocabulary in byte order, number of every word there from 1 on, whether a piece begins with it)."""
    data = np.frombuffer(text, np.uint8)
    line = data == 10
    every, starts = _split(data, line | (data == 32))
    lines = np.searchsorted(np.flatnonzero(line), starts)
    return *_ordered(every), np.r_[True, lines[1:] != lines[:-1]][: len(starts)]


def distinct(paths: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of a matrix of word numbers in order, and how often each is there, or the sums of ``counts``."""
    if not len(paths):
        return paths, np.zeros(0, np.int64)
    bits = [max(1, int(paths[:, c].max()).bit_length()) for c in range(paths.shape[1])]
    keys: list[np.ndarray] = []  # several columns side by side in 62 bits
    used = 63
    for c, b in enumerate(bits):
        if used + b > 62:
            keys.append(np.zeros(len(paths), np.int64))
            used = 0
        keys[-1] = keys[-1] << b | paths[:, c]
        used += b
    if len(keys) == 1 and counts is None:
        key = np.sort(keys[0])
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        key, out = key[first], np.empty((len(first), len(bits)), np.int64)
        for c in range(len(bits) - 1, -1, -1):
            out[:, c] = key & (1 << bits[c]) - 1
            key = key >> bits[c]
        return out, np.diff(np.r_[first, len(paths)])
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])
    differs = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    first = np.flatnonzero(np.r_[True, differs])
    return paths[order[first]], np.add.reduceat(np.ones(len(paths), np.int64) if counts is None else counts[order], first)


def _preorder(paths: np.ndarray, emit: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row, depth = np.nonzero(emit)
    return row, depth, weight[row, depth]


def states(paths: np.ndarray, counts: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, depth, weight) of the states of the automaton of sorted distinct paths, in which 0 ends a path.

    A path adds a state for each word from the first on in which it differs from the path before it; the weight of a state is the
    sum of the counts of the paths through it, or 0 for phrases of up to ``base`` words, which are counted elsewhere.
    """
    differs = np.ones(paths.shape, bool)
    differs[1:] = np.logical_or.accumulate(paths[1:] != paths[:-1], axis=1)
    weight = np.zeros(paths.shape, np.int64)
    for d in range(base, paths.shape[1]):
        at = np.flatnonzero(differs[:, d])
        weight[at, d] = np.add.reduceat(counts, at)
    return _preorder(paths, differs & (paths > 0), weight)


def first_bytes(vocabulary: pa.Array, n: int = 1) -> np.ndarray:
    """The first ``n`` bytes of every word as a number, by the word's own; words aren't empty, short ones end with zeros."""
    if not len(vocabulary):
        return np.zeros(1, np.int32)
    offsets = np.frombuffer(vocabulary.buffers()[1], np.int32)[vocabulary.offset : vocabulary.offset + len(vocabulary) + 1]
    data, out = np.frombuffer(vocabulary.buffers()[2], np.uint8), np.zeros(len(vocabulary), np.int32)
    for k in range(n):
        inside = offsets[:-1] + k < offsets[1:]
        out = (out << 8) + np.where(inside, data[np.where(inside, offsets[:-1] + k, 0)], 0)
    return np.r_[0, out].astype(np.int32)


def _packed(keys: list[pa.Array], cuts: np.ndarray, word: pa.Array, depth: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
    """Pieces of states that begin at ``cuts``."""
    none, blank = pa.scalar("", pa.large_string()), pa.scalar(" ", pa.large_string())
    word = pc.binary_join_element_wise(word.cast(pa.large_string()), none, blank)
    at = np.frombuffer(word.buffers()[1], np.int64)[word.offset : word.offset + len(word) + 1] if len(word) else np.zeros(1, np.int64)
    ends = np.r_[cuts, len(word)]
    text = pa.Array.from_buffers(pa.large_string(), len(cuts), [None, pa.py_buffer(at[ends].tobytes()), word.buffers()[2]]).cast(pa.string())
    fixed = lambda x, size: pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer((ends * size).astype(np.int32).tobytes()), pa.py_buffer(x.tobytes())])
    return pa.RecordBatch.from_arrays([*keys, text, fixed(depth.astype(np.int8), 1), fixed(weight.astype("<i8"), 8)], schema=_SCHEMA)


def pieces(lang: str, vocabulary: pa.Array, paths: np.ndarray, counts: np.ndarray, base: int, width: int, common: pa.Array | None = None, letters: int = 1) -> pa.RecordBatch:
    """The pieces of the automaton of sorted distinct paths; ranges are the first ``width`` characters of the first word, or a ``common`` one
    and the first ``letters`` bytes of the second."""
    row, depth, weight = states(paths, counts, base)
    often = np.zeros(len(vocabulary) + 1, bool)
    often[1:] = pc.is_in(vocabulary, common if common is not None else pa.array([], pa.string())).to_numpy(zero_copy_only=False)
    ranges = pc.if_else(pa.array(often[1:]), vocabulary, pc.utf8_slice_codeunits(vocabulary, 0, width)).dictionary_encode()
    of = np.r_[-1, ranges.indices.to_numpy(zero_copy_only=False)]
    first = paths[row, 0]
    letter = np.where(often[first], first_bytes(vocabulary, letters)[paths[row, 1]], -1)
    # A state of one word leads to those of its path, so the letter of its row is that of the piece that begins there; where a
    # common first word goes on to another letter, its state is said again.
    again = np.flatnonzero((depth == 1) & np.r_[False, (letter[1:] != letter[:-1]) & (depth[:-1] >= 1)])
    row, depth, weight, letter, first = (np.insert(x, again, y) for x, y in ((row, row[again]), (depth, 0), (weight, 0), (letter, letter[again]), (first, first[again])))
    cuts = np.flatnonzero(np.r_[True, (of[first][1:] != of[first][:-1]) | (letter[1:] != letter[:-1])])
    take = lambda codes: vocabulary.take(pa.array(codes - 1))
    keys = [pa.array([lang] * len(cuts), pa.string()), ranges.dictionary.take(pa.array(of[first[cuts]])), pa.array(letter[cuts].astype(np.int32))]
    return _packed(keys, cuts, take(paths[row, depth]), depth + 1, weight)


def _hashes(lang: str, vocabulary: pa.Array) -> np.ndarray:
    """What Spark's xxhash64 gives for (lang, word), by number of the word."""
    seed = xxhash.xxh64_intdigest(lang, 42)
    return np.array([0, *(xxhash.xxh64_intdigest(w, seed) for w in vocabulary.to_pylist())], np.uint64)


def _is_set(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h & np.uint64((1 << _BITS) - 1)).astype(np.int64)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def bitmap_of(hashes: DataFrame) -> np.ndarray:
    """Bitmap of the low bits of ``hashes(h)``: 16 MB, however many there are."""
    at = hashes.select(F.col("h").bitwiseAND((1 << _BITS) - 1).alias("at")).distinct()
    rows = at.groupBy(F.shiftright("at", _PAGE).alias("page")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND((1 << _PAGE) - 1)).alias("bits"))
    out = np.zeros(1 << _BITS - 3, np.uint8)
    size = 1 << _PAGE - 3
    for page, bits in rows.collect():
        out[page * size : (page + 1) * size] = np.frombuffer(bits, np.uint8)
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame, least: int, size: int = SHARD_BYTES) -> DataFrame:
    """(lang, word, n) of words that occur at least ``least`` times; the empty word counts all occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in shards(batches, size):
            vocabulary, said, _ = words(text)
            counts = np.bincount(said, minlength=len(vocabulary) + 1)[1:]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(counts) + 1), pa.string()), pa.array(["", *vocabulary.to_pylist()], pa.string()), pa.array(np.r_[len(said), counts], pa.int64())], names=["lang", "word", "n"])

    every = _texts(docs).mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    return every.where((F.col("n") >= least) | (F.col("word") == ""))


def shard_automata(docs: DataFrame, frequent: np.ndarray, base: int, longest: int, width: int, common: dict[str, list[str]], size: int = SHARD_BYTES, letters: int = 1) -> DataFrame:
    """Pieces of the automata of all shards. ``base`` 1: pairs of words of the bitmap ``frequent``. ``base`` 2: phrases of three and more
    words whose pairs are all in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in shards(batches, size):
            vocabulary, said, opens = words(text)
            if not len(said):
                continue
            h = _hashes(lang, vocabulary)
            said = np.r_[said, np.zeros(longest, np.int64)]  # a number beyond the end is 0
            joined = np.r_[~opens[1:], False]  # the next word is of the same piece
            here = h[said]
            if base == 1:
                good = _is_set(frequent, h)
                joined &= good[said[: len(opens)]] & good[said[1 : len(opens) + 1]]
            else:
                joined &= _is_set(frequent, here[: len(opens)] ^ here[1 : len(opens) + 1] << np.uint64(1))
            joined = np.r_[joined, np.zeros(longest, bool)]
            at = np.flatnonzero(joined if base == 1 else joined & np.r_[joined[1:], False])
            columns, on = [said[at]], np.ones(len(at), bool)
            for d in range(1, 2 if base == 1 else longest):
                on = on & joined[at + d - 1]
                columns.append(np.where(on, said[np.minimum(at + d, len(said) - 1)], 0))
            if len(at):
                yield pieces(lang, vocabulary, *distinct(np.column_stack(columns)), base, width, pa.array(common.get(lang, []), pa.string()), letters)

    return _texts(docs).mapInArrow(run, PIECES)


def unfold(batch: pa.RecordBatch | pa.Table, base: int, longest: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(vocabulary, row, paths, weight) of the states of more than ``base`` words of a batch of pieces: the words on the way to each."""
    text, depth, weight = (b"".join(batch.column(c).cast(pa.binary()).to_pylist()) for c in (3, 4, 5))
    row = np.repeat(np.arange(batch.num_rows), pc.binary_length(batch.column(4)).to_numpy())
    data = np.frombuffer(text, np.uint8)
    vocabulary, code = _ordered(_split(data, data == 32)[0])
    depth, weight = np.frombuffer(depth, np.int8), np.frombuffer(weight, "<i8")
    own = depth > base
    paths, place = np.zeros((int(own.sum()), longest), np.int32), np.arange(len(code), dtype=np.int32)
    for d in range(longest):
        last = np.maximum.accumulate(np.where(depth == d + 1, place, np.int32(-1)))[own]  # the state of this depth that a state lies below
        paths[:, d] = np.where(depth[own] > d, code[last], 0)
    return vocabulary, row[own], paths, weight[own]


def _united(base: int, longest: int, least: int, most: int = 4 * _STATES):
    """Unions of runs of pieces with equal keys, without states below ``least``. Pieces of one key are united whenever they have ``most``
    states, so that no more are held than twice the different ones, however many shards there are."""

    def changes(table: pa.Table) -> np.ndarray:
        """Whether a row's key isn't that of the row before."""
        n = table.num_rows
        return np.r_[True, np.logical_or.reduce([pc.not_equal(x.slice(1), x.slice(0, n - 1)).to_numpy() for x in table.select(KEY).combine_chunks().columns])]

    def of(table: pa.Table, least: int = least) -> pa.RecordBatch | None:
        number = (np.cumsum(changes(table)) - 1).astype(np.int32)
        vocabulary, row, paths, weight = unfold(table, base, longest)
        full, sums = distinct(np.column_stack([number[row], paths]), weight)
        full, sums = full[sums >= least], sums[sums >= least]
        if not len(full):
            return None
        # Every phrase has its own state, after those of its first words where these are new.
        differs = np.ones(full.shape, bool)
        differs[1:] = np.logical_or.accumulate(full[1:] != full[:-1], axis=1)
        own = (np.arange(len(full)), (full[:, 1:] > 0).sum(axis=1) - 1)
        emit, weights = np.zeros((len(full), longest), bool), np.zeros((len(full), longest), np.int64)
        emit[:, :base] = differs[:, 1 : base + 1]
        emit[own], weights[own] = True, sums
        row, depth, weight = _preorder(full[:, 1:], emit, weights)
        cuts = np.flatnonzero(np.r_[True, full[row[1:], 0] != full[row[:-1], 0]])
        keys = table.select(KEY).take(pa.array(np.searchsorted(number, full[row[cuts], 0]))).combine_chunks()
        return _packed([c.chunk(0) for c in keys.columns], cuts, vocabulary.take(pa.array(full[row, depth + 1] - 1)), depth + 1, weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        size, full = 0, most  # states of the last key, and how many are too many
        for b in batches:
            if not b.num_rows:
                continue
            sizes = np.cumsum(pc.binary_length(b.column(4)).to_numpy())
            cuts = np.unique(np.r_[np.searchsorted(sizes, np.arange(0, sizes[-1], _STATES)), b.num_rows])
            for lo, hi in zip(np.r_[0, cuts[:-1]].tolist(), cuts.tolist(), strict=True):
                if hi == lo:
                    continue
                new = pa.Table.from_batches([b.slice(lo, hi - lo)]).cast(_SCHEMA)
                held = new if held is None else pa.concat_tables([held, new])
                last = int(np.flatnonzero(changes(held))[-1])  # pieces of the last key may go on
                if last:
                    if (done := of(held.slice(0, last))) is not None:
                        yield done
                    held, size, full = held.slice(last), 0, most
                    new = held
                size += pc.sum(pc.binary_length(new["depth"])).as_py()
                if size >= full and (done := of(held, 1)) is not None:
                    held = pa.Table.from_batches([done])
                    size = pc.sum(pc.binary_length(held["depth"])).as_py()
                    full = max(most, 2 * size)
        if held is not None and (done := of(held)) is not None:
            yield done

    return run


def union(automata: DataFrame, base: int, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """The pieces of the union of all shards' automata, weights summed by ranges of prefixes, without phrases below ``least``."""
    return automata.repartitionByRange(*KEY).sortWithinPartitions(*KEY).mapInArrow(_united(base, longest, least), PIECES)


def phrases(automata: DataFrame, base: int, longest: int = LONGEST) -> DataFrame:
    """(lang, phrase, n_words, a): every state of the pieces as a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vocabulary, row, paths, weight = unfold(b, base, longest)
            parts = [pc.if_else(pa.array(paths[:, d] > 0), vocabulary.take(pa.array(np.maximum(paths[:, d], 1) - 1)), None) for d in range(longest)] if len(row) else [pa.array([], pa.string())]
            phrase = pc.binary_join_element_wise(*parts, " ", null_handling="skip")
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), phrase, pa.array((paths > 0).sum(axis=1).astype(np.int32)), pa.array(weight)], names=["lang", "phrase", "n_words", "a"])

    return automata.mapInArrow(run, "lang string, phrase string, n_words int, a long")


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The phrases that a piece and the parts asked of it both lead to, with their weights."""
    for b in batches:
        out: list[tuple[str, str, int]] = []
        for lang, text, depth, weight, parts in zip(*(c.to_pylist() for c in b.columns), strict=True):
            asked, way = set(parts), []
            for d, w, n in zip(depth, text.split(" "), np.frombuffer(weight, "<i8").tolist(), strict=False):
                del way[d - 1 :]
                way.append(w)
                if n and (part := " ".join(way)) in asked:
                    out.append((lang, part, n))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["lang", "part", "f"])


def compose(parts: DataFrame, automata: DataFrame, width: int, common: DataFrame, letters: int = 1) -> DataFrame:
    """(lang, part, f) of the ``parts(lang, part)`` of several words: pieces of both sides with the same key are walked together.

    Parts are distinct, so what is asked of a piece is no more than the phrases it has. ``common(lang, word)`` are the first words whose
    pieces are cut by the next word's first ``letters`` bytes.
    """
    asked = parts.select("lang", "part", F.substring_index("part", " ", 1).alias("word"))
    asked = asked.join(common.select("lang", "word", F.lit(True).alias("often")), ["lang", "word"], "left")
    letter = F.when(F.col("often"), F.conv(F.rpad(F.hex(F.split_part("part", F.lit(" "), F.lit(2))), 2 * letters, "0"), 16, 10).cast("int")).otherwise(-1)
    prefix = F.when(F.col("often"), F.col("word")).otherwise(F.substring("word", 1, width))
    asked = asked.groupBy("lang", prefix.alias("prefix"), letter.alias("letter")).agg(F.collect_set("part").alias("parts"))
    return automata.join(asked, KEY).select("lang", "words", "depth", "weight", "parts").mapInArrow(_walked, "lang string, part string, f long")


def range_width(n_words: int) -> int:
    """How many characters of a first word make a range: 3, from 2**29 words on 4, and one more for every 4 times as many."""
    return 3 + (n_words >> 28).bit_length() // 2


def range_letters(n_words: int) -> int:
    """How many bytes of the word after a common first word make a range."""
    return 1 if n_words < 1 << 29 else 2


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, best: int = BEST, size: int = SHARD_BYTES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``best`` phrases of 2 to ``longest`` words of every lang.

    Texts of ``docs(lang, text)`` are cut to pieces at ``.,;:!?`` and line ends and these to words at blanks and tabs, A-Z in lower case; a
    null lang is ``und``, a null or empty text has no words. Phrases within pieces that occur at least ``least`` times are candidates;
    the cut into two parts with the lowest floor(1000 a n / (l r)) is theirs, the first among equals. A candidate inside a longer one that
    occurs as often goes. Ranked by score, count and phrase. All rows count, repeated ones too; an empty table gives no rows; other columns
    aren't read. ``size`` is that of shards and changes no result.
    """
    said = materialise(word_counts(docs, least, size), "words")
    frequent, total = said.where("word <> ''"), said.where("word = ''").select("lang", F.col("n").alias("total"))
    common = frequent.join(total, "lang").where(F.col("n") * COMMON > F.col("total")).select("lang", "word")
    often: dict[str, list[str]] = {}
    for lang, w in common.collect():
        often.setdefault(lang, []).append(w)
    n_words = total.agg(F.sum("total")).first()[0] or 0
    width, letters = range_width(n_words), range_letters(n_words)
    pairs = materialise(shard_automata(docs, bitmap_of(frequent.select(F.xxhash64("lang", "word").alias("h"))), 1, longest, width, often, size, letters), "automata")
    of_pairs = materialise(union(pairs, 1, 2, least), "automaton")
    two = phrases(of_pairs, 1, 2)
    word = lambda k: F.xxhash64("lang", F.split_part("phrase", F.lit(" "), F.lit(k)))
    known = bitmap_of(two.select(word(1).bitwiseXOR(F.shiftleft(word(2), 1)).alias("h")))
    more = materialise(shard_automata(docs, known, 2, longest, width, often, size, letters), "automata")
    of_more = materialise(union(more, 2, longest, least), "automaton")
    for gone in (pairs, more):
        discard(gone)
    found = materialise(two.union(phrases(of_more, 2, longest)), "candidates")

    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1))).select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k) as left"), F.expr("substring_index(phrase, ' ', k - n_words) as right"))
    parts = cuts.select("lang", F.explode(F.array("left", "right")).alias("part")).distinct()
    parts = materialise(parts.withColumn("words", F.size(F.split("part", " "))), "parts")
    known = frequent.select("lang", F.col("word").alias("part"), F.col("n").alias("f"))
    known = known.union(compose(parts.where("words = 2"), of_pairs, width, common, letters)).union(compose(parts.where("words > 2"), of_more, width, common, letters))
    known = materialise(known, "parts")
    side = lambda name, f: known.select("lang", F.col("part").alias(name), F.col("f").alias(f))
    wide = lambda c: F.col(c).cast("decimal(38,0)")  # noqa: E731  products may pass 64 bits
    scored = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(total, "lang")
    scored = scored.withColumn("over", wide("a") * wide("total") * 1000).withColumn("under", wide("l") * wide("r")).withColumn("score", F.expr("over div under"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", F.col("total").alias("n"))).alias("x")).select("lang", "phrase", "x.*")

    inside = found.where("n_words > 2").withColumn("w", F.split("phrase", " "))
    inside = inside.withColumn("m", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("m") + 1)))
    longer = inside.select("lang", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where("longer is null or longer < a")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    some = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(W.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= best)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
