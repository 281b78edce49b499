"""Column functions on sequences, record names and alignment strings. All stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Amino acids of the standard code, codons in the order T, C, A, G of each base.
BASES = "TCAG"
AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
ALPHABET = "ATGCUSWRYKMBVHDN"
#: Lower ends of the support bins.
BINS = (1, 2, 5, 10, 20, 40, 80, 160, 320, 640)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns that are evaluated once a row, however often and where they are used.

    The optimizer merges projections and so repeats an expression wherever its column is used, in a lambda for each
    element; a generator of one row isn't merged.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def rev_comp(c: Column) -> Column:
    """Reverse complement in upper case, U read as T; see :func:`is_nucleotides` for rows it is defined on."""
    return F.reverse(F.translate(F.upper(c), "ACGTU", "TGCAA"))


def is_nucleotides(c: Column) -> Column:
    return F.upper(c).rlike("^[ACGTU]*$")


def u_to_t(c: Column) -> Column:
    return F.translate(c, "U", "T")


def limit_alphabet(c: Column, symbols: str = ALPHABET) -> Column:
    """Every character outside ``symbols`` becomes the first of them."""
    return F.regexp_replace(c, f"[^{symbols}]", symbols[0])


def sums_before(values: Column, chunk: int = 64) -> Column:
    """For every element of an array of numbers the sum of those before it, as longs.

    Arrays are appended to chunk by chunk, so that a long one isn't copied for each of its elements.
    """
    number = F.ceil(F.size(values) / chunk).cast("int")
    chunks = F.transform(F.sequence(F.lit(1), F.greatest(number, F.lit(1))), lambda k: F.slice(values, ((k - 1) * chunk + 1).cast("int"), F.lit(chunk)))
    start = lambda at: F.struct(at.alias("at"), F.array().cast("array<bigint>").alias("all"))
    grown = lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["all"], F.array(acc["at"])).alias("all"))
    whole = lambda acc, c: F.aggregate(c, start(acc["at"]), grown, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["all"], r["all"]).alias("all")))
    return F.aggregate(chunks, start(F.lit(0).cast("long")), whole, lambda r: r["all"])


def find_all(c: Column, motif: str) -> Column:
    """0-based starts of ``motif``, overlaps included; none of an empty one.

    The text is split before every occurrence; starts are running sums of the lengths of the pieces, so the
    whole text is walked once however many occurrences there are.
    """
    if not motif:
        return F.when(c.isNotNull(), F.array().cast("array<bigint>"))
    pieces = F.split(c, "(?=" + re.escape(motif) + ")")
    starts = sums_before(F.transform(pieces, F.length))
    return F.when(c.startswith(motif), starts).otherwise(F.slice(starts, F.lit(2), F.greatest(F.size(starts) - 1, F.lit(0))))


def translate_frame(c: Column, frame: int = 0) -> Column:
    """Amino acids of the whole codons from ``frame`` on; * is a stop."""
    codons = F.regexp_extract_all(F.substring(c, frame + 1, 2**31 - 1), F.lit(".{3}"), F.lit(0))
    table = F.create_map(*[F.lit(x) for i, a in enumerate(AMINO) for x in (BASES[i // 16] + BASES[i // 4 % 4] + BASES[i % 4], a)])
    return F.array_join(F.transform(codons, lambda k: table[k]), "")


def longest_orf(c: Column) -> Column:
    """Longest translation from an M to the first stop in its frame; without a stop there is none.

    A struct (protein, offset): among equally long ones the first in the sequence; empty with offset -1 if
    there is none. ``c`` holds upper-case ACGT. Each frame is translated once; what stands between a stop or the beginning and the
    last stop is searched for readings, which the text after the last stop can't hold. A longest reading is nowhere a part of
    another one, so the first place of its text is its own. To be used with :func:`once`, or the optimizer evaluates all of this once per field.
    """

    def longest(t: Column, frame: Column) -> Column:
        closed = F.left(t, F.length(t) - F.length(F.substring_index(t, "*", -1)))
        best = lambda found: F.get(found, F.array_position(F.transform(found, F.length), F.array_max(F.transform(found, F.length))).cast("int") - 1)
        orf = F.get(F.transform(F.array(F.regexp_extract_all(closed, F.lit("M[^*]*[*]"), F.lit(0))), best), F.lit(0))
        told = lambda x: F.struct((F.length(x) - 1).alias("n"), (-((F.instr(closed, x) - 1) * 3 + frame)).alias("first"), F.left(x, F.length(x) - 1).alias("orf"))
        return F.get(F.transform(F.array(orf), told), F.lit(0))

    frames = F.array(*(translate_frame(c, f) for f in range(3)))
    best = F.array_max(F.filter(F.transform(frames, longest), lambda x: x["n"].isNotNull()))
    top = lambda x: F.struct(F.coalesce(x["orf"], F.lit("")).alias("protein"), F.coalesce(-x["first"], F.lit(-1)).alias("offset"))
    return F.get(F.transform(F.array(best), top), F.lit(0))


def parse_attributes(c: Column) -> Column:
    """``key "value"; key "value";`` -> map; the first blank-separated part of a value, without quotes.

    Of a key that is there several times the last value counts.
    """
    pairs = F.filter(F.transform(F.split(c, ";"), lambda p: F.trim(p)), lambda p: p != "")
    entries = F.transform(pairs, lambda p: F.split(p, " "))
    value = lambda e: F.replace(F.coalesce(F.get(e, F.lit(1)), F.lit("")), F.lit('"'), F.lit(""))
    set_ = lambda m, e: F.map_concat(F.map_filter(m, lambda k, _: k != e[0]), F.create_map(e[0], value(e)))
    return F.when(c.isNotNull(), F.aggregate(entries, F.create_map().cast("map<string,string>"), set_))


def support_of(c: Column) -> Column:
    """The support that a record name carries after its last ``_``."""
    return F.element_at(F.split(c, "_"), -1).try_cast("long")


def parse_intron_name(c: Column) -> Column:
    """``name_support::chr:start-end(strand)`` -> struct (name, support, chr, start, end, strand)."""
    part = lambda k: F.regexp_extract(c, r"^(.*)::([^:]*):([0-9]+)-([0-9]+)\(([+.-])\)$", k)
    return F.struct(part(1).alias("name"), support_of(part(1)).alias("support"), part(2).alias("chr"), part(3).try_cast("long").alias("start"), part(4).try_cast("long").alias("end"), part(5).alias("strand"))


def tracking_txid(c: Column) -> Column:
    """``qN:gene|tx|...`` -> the text after the first colon up to the first bar."""
    return F.split_part(F.split_part(c, F.lit(":"), F.lit(2)), F.lit("|"), F.lit(1))


def wrap_sequence(c: Column, width: int = 75) -> Column:
    return F.rtrim(F.regexp_replace(c, f"(.{{{width}}})", "$1\n"), F.lit("\n"))


def phred_encode(c: Column) -> Column:
    """Array of qualities -> text."""
    return F.array_join(F.transform(c, lambda q: F.char(q + 33)), "")


def cigar_ops(c: Column) -> Column:
    """``5=1X`` -> array of struct (n, op)."""
    ops = F.regexp_extract_all(c, F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))
    return F.transform(ops, lambda o: F.struct(F.regexp_extract(o, "[0-9]+", 0).cast("int").alias("n"), F.right(o, F.lit(1)).alias("op")))


def support_bin(c: Column, bins: tuple[int, ...] = BINS) -> Column:
    """Label ``lo-hi`` of the bin, ``640+`` for the last; null below the first."""
    out = F.lit(None).cast("string")
    for lo, hi in zip(bins, (*bins[1:], None), strict=True):
        out = F.when(c >= lo, F.lit(f"{lo}-{hi - 1}" if hi else f"{lo}+")).otherwise(out)
    return out
