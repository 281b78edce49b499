"""Exact token counts at every prefix of a text, for byte-level BPE vocabularies.

The pre-tokeniser cuts a text into pieces that never share a token, so the count at a piece boundary is
    count[k] = count[k - 1] + tokens(piece k).
Inside a piece the count at every byte follows the same way over vocabulary tokens: BPE of a prefix is
BPE of the prefix without its last token, plus that token, and the last token is the only one that stays
apart from its predecessor when both are encoded together:
    count[i] = count[i - len(t)] + 1.
Counts are stored at every code point, so how many tokens a prefix has and where a budget ends are looked
up without encoding the text again. A cut changes how the text before it is split in three places, which
are counted on their own: white space before a word, contractions, and added tokens that are cut.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1024
_BEGUN = (20, 14, 9, 5)  # bytes of a piece after which its counts so far are remembered
#: Fixed value: the split pattern of the byte-level pre-tokeniser.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Counts(dict):
    """Piece -> its prefix counts as the bytes of an array, filled when first asked for."""

    def __init__(self, points, short: int):
        super().__init__()
        self.points, self.short = points, short

    def __missing__(self, piece: str) -> bytes:
        found = array("i", self.points(piece)).tobytes()
        if len(piece) <= self.short:
            self[piece] = found
        return found


class PrefixCounter:
    """Token counts of the vocabulary in ``path``, a .json file of byte-level BPE.

    ``cached`` bounds the pieces, of at most ``short`` characters, whose counts are remembered; the memory is
    started afresh beyond it.
    """

    def __init__(self, path: str, cached: int = 1 << 19, short: int = 64):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec["pre_tokenizer"] or {}
        if spec["model"]["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError(f"{path} isn't plain byte-level BPE")
        model = spec["model"]
        if before.get("use_regex") is False or model.get("ignore_merges") or model.get("dropout") or model.get("byte_fallback") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError(f"{path} splits or merges in a way that isn't counted here")
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(a >= b for a, b in zip(made, made[1:], strict=False)):
            raise ValueError(f"{path} has merges that aren't in the order of their tokens' ids")
        added = spec.get("added_tokens", [])
        if any(t.get(flag) for t in added for flag in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens that change the text around them")
        alphabet = _byte_alphabet()
        names = {t["content"] for t in added}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in names}
        self.ranks, self.token, self.none = ranks, {i: token for token, i in ranks.items()}, max(ranks.values()) + 1
        self.reach: dict[bytes, int] = {}  # last four bytes -> the longest token that ends with them
        for token in ranks:
            if len(token) > 3:
                self.reach[token[-4:]] = max(self.reach.get(token[-4:], 4), len(token))
        self.encode = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.pieces = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(sorted(map(regex.escape, names), key=len, reverse=True))) if names else None
        self.spaces = regex.compile(r"\s{2,}(?=\S)").finditer
        self.cached, self.counts, self.apart, self.begun = cached, _Counts(self.points, short), {}, {}

    def _parts(self, text: str) -> Iterator[tuple[str, bool]]:
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            if m.start() > at:
                yield text[at : m.start()], False
            yield m.group(), True
            at = m.end()
        if at < len(text):
            yield text[at:], False

    def boundaries(self, text: str) -> np.ndarray:
        """Token count of text[:n] for every n from 0 to len(text)."""
        if len(self.counts) > self.cached:
            self.counts.clear()
        out, at, total = np.zeros(len(text) + 1, np.int32), 0, 0
        ends: list[int] = []  # of the pieces between the last added token and the next
        for part, special in self._parts(text):
            if special:
                # A cut added token is plain text, which may join the pieces before it.
                k, words = len(ends), 0
                while k and words < 2:
                    k -= 1
                    words += not text[ends[k - 1] if k else begin : ends[k]].isspace()
                safe = (ends[k - 1] if k else begin) if ends else at
                for n in range(at + 1, at + len(part)):
                    out[n] = base[k] + self._plain(text[safe:n]) if ends else total + self._plain(part[: n - at])
                at, total, ends = at + len(part), total + 1, []
                out[at] = total
                continue
            pieces = self.pieces(part)
            own = np.frombuffer(b"".join(map(self.counts.__getitem__, pieces)), np.int32)
            lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
            stop = np.cumsum(lengths)
            base = np.cumsum(np.r_[total, own[stop - 1]])
            out[at + 1 : at + len(part) + 1] = own + np.repeat(base[:-1], lengths)
            # Before a word the last white space stands apart; a prefix that ends there has it with the rest.
            for m in self.spaces(part):
                out[at + m.end()] = base[np.searchsorted(stop, m.start(), "right")] + self._last(m.group())
            begin, ends = at, (at + stop).tolist() if self.special else []
            at, total = at + len(part), int(base[-1])
        return out

    def _last(self, piece: str) -> int:
        return int(np.frombuffer(self.counts[piece], np.int32)[-1])

    def _plain(self, text: str) -> int:
        return sum(1 if special else sum(map(self._last, self.pieces(part))) for part, special in self._parts(text))

    def points(self, piece: str) -> list[int]:
        """Token count of piece[:n] for every n from 1, whose pieces are the prefix itself but in contractions."""
        counts = self.inside(piece.encode("utf-8", "replace"))
        if not piece.isascii():
            counts = [counts[n] for n in accumulate((len(c.encode("utf-8", "replace")) for c in piece), initial=0)]
        for n in (2, 3)[: len(piece) - 1] if piece[0] == "'" else ():
            if len(cut := self.pieces(piece[:n])) > 1:
                counts[n] = sum(self.inside(p.encode("utf-8", "replace"))[-1] for p in cut)
        return counts[1:]

    def inside(self, piece: bytes) -> list[int]:
        """Token count of piece[:i] for every byte i, by the recurrence over last tokens.

        Counts of a prefix don't depend on what follows it, so pieces that begin alike go on from where they part.
        """
        if len(self.apart) > self.cached:
            self.apart.clear()
        if len(self.begun) > self.cached:
            self.begun.clear()
        rank, apart, reach = self.ranks.get, self.apart.get, self.reach.get
        counts, last = [0], [self.none]
        for k in _BEGUN:
            if len(piece) > k and (known := self.begun.get(piece[:k])):
                counts, last = known[0].copy(), known[1].copy()
                break
        for i in range(len(counts), len(piece) + 1):
            far = reach(piece[i - 4 : i], 3) if i > 3 else 3
            for j in range(i - far if i > far else 0, i):
                token = rank(piece[j:i])
                if token is None:
                    continue
                pair = last[j] << 32 | token
                alone = apart(pair)
                if alone is None:
                    alone = self.apart[pair] = self._stay_apart(last[j], token)
                if alone:
                    counts.append(counts[j] + 1)
                    last.append(token)
                    break
            if i in _BEGUN and i < len(piece):
                self.begun[piece[:i]] = counts.copy(), last.copy()
        return counts

    def _stay_apart(self, a: int, b: int) -> bool:
        both = [b] if a == self.none else [a, b]
        return self.encode(b"".join(map(self.token.__getitem__, both))) == both

    def count_prefix(self, text: str, n: int, stored: np.ndarray | None = None) -> int:
        """Tokens of text[:n], looked up in stored counts."""
        return int((self.boundaries(text) if stored is None else stored)[n])

    def truncate(self, text: str, budget: int, stored: np.ndarray | None = None) -> int:
        """Length of the longest prefix of at most ``budget`` tokens, wherever it ends."""
        within = np.flatnonzero((self.boundaries(text) if stored is None else stored) <= budget)
        return int(within[-1]) if len(within) else 0


@lru_cache(maxsize=1)
def counter_of(path: str) -> PrefixCounter:
    """The counter of a vocabulary, one in each worker: what it remembers of pieces serves all tasks that run there."""
    return PrefixCounter(path)


def prefix_counts(docs: DataFrame, path: str, points: int = 1 << 20) -> DataFrame:
    """(doc_id, n_bytes, counts) for every row: ``counts[n]``, from 0, is the token count of the first n code points.

    ``path`` must be readable by every executor. Null texts count as empty: no bytes, no tokens. Texts of
    any length are encoded whole; repeated rows and null ids are returned as they are. Rows are handed on
    when they have ``points`` counts together. An empty table gives no rows; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for b in batches:
            first, n_bytes, counts, held = 0, [], [], 0
            for k, x in enumerate(b.column(1), 1):
                text = x.as_py() or ""
                n_bytes.append(len(text.encode("utf-8", "replace")))
                counts.append(counter.boundaries(text))
                held += len(counts[-1])
                if held >= points or k == len(b):
                    ends = pa.array(np.cumsum([0, *map(len, counts)]), pa.int32())
                    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(counts)))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, k - first), pa.array(n_bytes, pa.int64()), lists], names=["doc_id", "n_bytes", "counts"])
                    first, n_bytes, counts, held = k, [], [], 0

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, counts array<int>")


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, prefixes: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row, from its prefix counts; with ``prefixes`` also these. Rows are those of
    :func:`prefix_counts`, none of an empty table."""
    n = F.element_at("counts", -1).cast("long")
    rows = prefix_counts(docs, path).select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"), "counts")
    return rows if prefixes else rows.drop("counts")


def prefixes_within(rows: DataFrame, budget: int) -> DataFrame:
    """(doc_id, n_points, n_tokens): the longest prefix of at most ``budget`` tokens of every row of :func:`prefix_counts`, in
    code points, and its count, both looked up in the stored counts. A budget below 0 is met by the empty prefix only. Repeated rows and null
    ids are kept; an empty text has the empty prefix, an empty table no rows."""
    numbered = F.transform("counts", lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    best = F.array_max(F.filter(numbered, lambda x: (x["c"] <= budget) | (x["i"] == 0)))
    return rows.select("doc_id", best.alias("best")).select("doc_id", F.col("best.i").alias("n_points"), F.col("best.c").alias("n_tokens"))
