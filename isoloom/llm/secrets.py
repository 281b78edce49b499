"""Secret scans: a keyword automaton finds where to look, anchored patterns decide, checksums confirm.

One Aho-Corasick pass over a lower-cased text yields the keyword hits; each pattern is tried only at the
hits of its own keywords. Long hexadecimal runs have no keyword and are found by their one pattern.
Kinds whose tokens carry a checksum (CRC32, Base58Check, Bech32) or a header are reported only if it is right. Every
character is read a bounded number of times, whatever the text: where a pattern fails after a run of characters, hits
of its keywords inside that run fail too and aren't tried.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans that start together are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "private_key", "xprv", "age", "nsec", "slack", "stripe", "google")
BASE = KINDS[:3]
#: Digits of base 62, base 58 and Bech32, and the generator of the Bech32 checksum.
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
_BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
_BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
_LONGEST_HEADER = 8192  # characters; a longer first part is no token header


def _crc_token(text: str) -> bool:
    """The last six characters are the CRC32 of those between prefix and them, in base 62."""
    body = text.partition("_")[2]
    crc, tail = zlib.crc32(body[:-6].encode()), ""
    while crc:
        crc, k = divmod(crc, 62)
        tail = _BASE62[k] + tail
    return tail.rjust(6, "0") == body[-6:]


def _base58_check(text: str) -> bool:
    """The last four bytes are the first of the double SHA-256 of the others."""
    n = 0
    for c in text:
        n = n * 58 + _BASE58.index(c)
    raw = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def _bech32(text: str) -> bool:
    """The checksum over the part before the last 1 and the digits after it is 1."""
    prefix, _, digits = text.lower().rpartition("1")
    check = 1
    for v in [*(ord(c) >> 5 for c in prefix), 0, *(ord(c) & 31 for c in prefix), *map(_BECH32.index, digits)]:
        top, check = check >> 25, (check & 0x1FFFFFF) << 5 ^ v
        for k, g in enumerate(_BECH32_GENERATOR):
            check ^= g if top >> k & 1 else 0
    return check == 1


def _jwt(text: str) -> bool:
    head = text.partition(".")[0]
    if len(head) > _LONGEST_HEADER:
        return False
    try:
        said = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, RecursionError):
        return False
    return isinstance(said, dict) and "alg" in said


def _always(text: str) -> bool:
    return True


#: kind -> keywords (lower case), anchored pattern, test of the matched text.
RULES: dict[str, tuple[tuple[str, ...], re.Pattern, Callable[[str], bool]]] = {
    "assign": (
        ("password", "passwd", "secret", "token", "apikey", "api_key"),
        re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
        _always,  # the length of its group is tested where it is matched
    ),
    "access": (("akia",), re.compile(r"AKIA[A-Z0-9]+"), lambda t: len(t) >= 16),
    "github": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), _crc_token),
    "npm": (("npm_",), re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"), _crc_token),
    "jwt": (("eyj",), re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), _jwt),
    "private_key": (
        ("-----begin",),
        re.compile(r"-----BEGIN (?:[A-Z0-9]{1,16} ){0,4}PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z0-9]{1,16} ){0,4}PRIVATE KEY-----"),
        _always,
    ),
    "xprv": (("xprv",), re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])"), _base58_check),
    "age": (("age-secret-key-1",), re.compile(r"AGE-SECRET-KEY-1[02-9AC-HJ-NP-Z]{58}(?![A-Z0-9])"), _bech32),
    "nsec": (("nsec1",), re.compile(r"nsec1[02-9ac-hj-np-z]{58}(?![a-z0-9])"), _bech32),
    "slack": (("xoxb-", "xoxa-", "xoxp-", "xoxr-", "xoxs-"), re.compile(r"xox[abprs]-[0-9]{8,16}-[0-9A-Za-z-]{16,256}"), _always),
    "stripe": (("sk_live_", "rk_live_"), re.compile(r"[sr]k_live_[0-9A-Za-z]{24,256}(?![0-9A-Za-z])"), _always),
    "google": (("aiza",), re.compile(r"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"), _always),
}
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run is one match, so a shorter run is no match
#: kind -> the run with which its pattern begins, where that has no bound; the rest of the match doesn't depend on where
#: in the run it began, so if one hit in a run fails, all later ones in it do.
_RUNS = {"jwt": re.compile(r"[A-Za-z0-9_-]+")}


class Scanner:
    def __init__(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for kind, (keywords, _, _) in RULES.items():
            for word in keywords:
                self.automaton.add_word(word, (kind, len(word)))
        self.automaton.make_automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start and then kind."""
        found = [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
        low = text.lower()
        if len(low) != len(text):  # some characters lower to two; none of them is in a keyword
            low = "".join(c.lower() if c < "\x80" else c for c in text)
        ended = dict.fromkeys(RULES, 0)  # hits before it are used up, or known to fail
        hits = sorted((at - n + 1, kind) for at, (kind, n) in self.automaton.iter(low))
        for start, kind in hits:
            if start < ended[kind]:
                continue
            _, pattern, test = RULES[kind]
            m = pattern.match(text, start)
            if m is None:
                if kind in _RUNS:
                    ended[kind] = _RUNS[kind].match(text, start).end()
                continue
            ended[kind] = m.end()  # a match that fails its test has still used up its text
            if len(m.group(1)) >= 8 if kind == "assign" else test(m.group()):
                found.append((kind, start, m.end()))
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans as an array of (kind, start, end), whole texts.

    Null and empty texts have no spans; texts of any length are read whole, in time that grows with their length;
    repeated rows and null ids are returned as they are; an empty table gives no rows. Other columns, whatever their
    names, are neither read nor returned.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in scanner.spans(t.as_py() or "")] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(span))], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>"
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret replaced by ``[kind]``; overlapping spans are replaced as one.

    Texts without secrets, null and empty ones included, stay as they are, and ``n_chars`` follows the text. Every
    row stays, repeated ones and those without a doc_id too, with all its columns, whatever their names; an empty table stays empty. Texts of any
    length are read whole.
    """
    names = docs.columns

    def clean(scanner: Scanner, text: str | None) -> str | None:
        out, at = [], 0
        for kind, start, end in scanner.spans(text) if text else ():
            if start >= at:
                out += [text[at:start], f"[{kind}]"]
            at = max(at, end)
        return "".join(out) + text[at:] if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for b in batches:
            k = names.index("text")
            yield b.set_column(k, "text", pa.array([clean(scanner, t.as_py()) for t in b.column(k)], pa.string()))

    done = docs.withColumn("text", F.col("text").cast("string"))
    done = done.mapInArrow(run, done.schema)
    return done.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in names else done


def digests(found: DataFrame) -> DataFrame:
    """The rows of :func:`scan` as counts and joined texts."""
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )

