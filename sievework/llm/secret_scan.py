"""Secrets in texts: spans by pattern, and spans confirmed by structure.

The three patterns are reported as they match. Beyond them, long runs of base64 or hex letters are
decoded and reported only if what comes out has the structure of a private key (every nested length of
the ASN.1 or OpenSSH encoding adds up) or of a signed token (header and claims are JSON, the header
names an algorithm). Offsets are code points, ends are exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.llm.common import slices, texts

BASE_KINDS = ("assign", "access", "hex")
#: Kinds that need a decoded structure, in reporting order after the base kinds.
CONFIRMED_KINDS = ("pem", "key", "openssh", "hexkey", "jwt")
SPAN_TYPE = "array<struct<kind:string,start:int,end:int>>"

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{32,}")
#: Everything else that is decoded lies in such a run.
_LONG = re.compile("[A-Za-z0-9+/_.=-]{32,}")
_BASE64 = re.compile("[A-Za-z0-9+/_-]{40,}={0,2}")
_TOKEN = re.compile(r"[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{2,}\.[A-Za-z0-9_-]*")
_HEXKEY = re.compile("[0-9A-Fa-f]{64,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:[^-]|-(?!----))*+)-----END \1-----")
#: Line breaks as JSON and source strings write them, and the joints of a string written in parts.
_BREAK = re.compile(r"""\\+(?:[nrt]|\r?\n)""")
_JOINT = re.compile(r"""["'`]\s*[+.,]?\s*["'`]""")
#: Cipher and initial vector of an encrypted key of the old form.
_DEK = re.compile(r"(?i)DEK-Info:\s*[A-Z0-9-]+,\s*([0-9A-F]{16}|[0-9A-F]{32})\s*")
_PLACE = {k: i for i, k in enumerate(BASE_KINDS + CONFIRMED_KINDS)}

Span = tuple[int, int, str]


def unbase64(text: str) -> bytes | None:
    """Decoded bytes of standard or URL-safe base64, padded or not; None if it is neither."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(blob: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of consecutive definite-length items that fill ``blob`` exactly, else None."""
    found, at = [], 0
    while at < len(blob):
        if at + 2 > len(blob):
            return None
        tag, length = blob[at], blob[at + 1]
        at += 2
        if length & 0x80:
            n = length & 0x7F
            if not 1 <= n <= 4 or at + n > len(blob):
                return None
            length = int.from_bytes(blob[at : at + n], "big")
            at += n
        if at + length > len(blob):
            return None
        found.append((tag, blob[at : at + length]))
        at += length
    return found


def is_private_key(blob: bytes) -> bool:
    """A DER private key: PKCS#1, DSA, SEC1, PKCS#8 or encrypted PKCS#8."""
    if len(blob) < 16 or blob[0] != 0x30:
        return False
    outer = der_items(blob)
    if not outer or len(outer) != 1:
        return False
    inner = der_items(outer[0][1])
    if not inner or len(inner) < 2:
        return False
    tags = [tag for tag, _ in inner]
    first, second = inner[0][1], inner[1][1]

    def algorithm(content: bytes) -> bool:
        parts = der_items(content)
        return bool(parts) and parts[0][0] == 0x06 and len(parts[0][1]) >= 3

    if tags[0] == 0x02:
        if set(tags) == {0x02} and first == b"\0" and len(inner) in (6, 9):
            return all(content for _, content in inner)
        if tags[1] == 0x04 and first == b"\1":
            return 16 <= len(second) <= 72
        if len(inner) >= 3 and tags[1:3] == [0x30, 0x04] and first in (b"\0", b"\1"):
            return algorithm(second) and bool(inner[2][1])
        return False
    return tags == [0x30, 0x04] and algorithm(first) and len(second) >= 16


def is_openssh_key(blob: bytes) -> bool:
    """The OpenSSH private key format: every length-prefixed part lies inside and the last one ends it."""
    magic = b"openssh-key-v1\0"
    if not blob.startswith(magic):
        return False
    at = len(magic)

    def part() -> bool:
        nonlocal at
        if at + 4 > len(blob):
            return False
        at += 4 + int.from_bytes(blob[at : at + 4], "big")
        return at <= len(blob)

    if not (part() and part() and part()) or at + 4 > len(blob):
        return False
    keys = int.from_bytes(blob[at : at + 4], "big")
    at += 4
    return 1 <= keys <= 64 and all(part() for _ in range(keys + 1)) and at == len(blob)


def is_pem_key(body: str) -> bool:
    """What stands between the marks of a PEM key: header lines of RFC 1421, if any, then the key in base64.

    Line breaks may be escaped. An encrypted key has no structure, so its length must be whole cipher blocks.
    """
    body = _JOINT.sub("\n", _BREAK.sub("\n", body)).replace("\\/", "/").replace("\\u003d", "=")
    lines = [line.strip().strip("\"'`+") if '"' in line or "'" in line or "`" in line else line for line in body.splitlines()]
    # No base64 letter is a colon.
    blob = unbase64("".join("".join(line.split()) for line in lines if ":" not in line))
    if not blob:
        return False
    for line in lines:
        if found := _DEK.fullmatch(line.strip()):
            return len(blob) >= 16 and len(blob) % (len(found[1]) // 2) == 0
    return is_private_key(blob) or is_openssh_key(blob)


def is_signed_token(text: str) -> bool:
    """header.claims.signature with JSON objects for the first two and an algorithm in the header."""
    header, claims, signature = text.split(".")
    try:
        head = json.loads(unbase64(header) or b"")
        body = json.loads(unbase64(claims) or b"")
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(body, dict) or not isinstance(head.get("alg"), str):
        return False
    return head["alg"] == "none" or bool(signature and unbase64(signature))


def _confirmed(text: str, run: re.Match[str]) -> Iterator[Span]:
    at, word = run.start(), run[0]
    if "." in word:
        for m in _TOKEN.finditer(word):
            if is_signed_token(m[0]):
                yield at + m.start(), at + m.end(), "jwt"
    for m in _BASE64.finditer(word):
        blob = unbase64(m[0])
        if blob and is_private_key(blob):
            yield at + m.start(), at + m.end(), "key"
        elif blob and is_openssh_key(blob):
            yield at + m.start(), at + m.end(), "openssh"
    for m in _HEXKEY.finditer(word):
        if len(m[0]) % 2 == 0 and is_private_key(bytes.fromhex(m[0])):
            yield at + m.start(), at + m.end(), "hexkey"


def spans(text: str) -> list[Span]:
    """(start, end, kind) by start, then kind in reporting order."""
    found: list[Span] = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    for run in _LONG.finditer(text):
        found += [(run.start() + m.start(), run.start() + m.end(), "hex") for m in _HEX.finditer(run[0])]
        found += _confirmed(text, run)
    if "-----BEGIN " in text:
        for m in _PEM.finditer(text):
            if is_pem_key(m[2]):
                found.append((*m.span(), "pem"))
    return sorted(found, key=lambda s: (s[0], _PLACE[s[2]], s[1]))


def redact(text: str, mark: str = "[secret]") -> str:
    """The text with every found span replaced; overlapping spans become one mark."""
    out, at = [], 0
    for start, end, _ in spans(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``spans`` (kind, start, end) for every row.

    Null and empty texts have no spans, a null id stays null, repeated rows each get a row, an empty table
    gives an empty one; other columns are not read. No shuffle; whole texts are scanned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in slices(batches):
            found = [
                [{"kind": k, "start": a, "end": b} for a, b, k in spans(t)] for t in texts(batch, "text")
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(kind))], ["doc_id", "spans"]
            )

    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return read.mapInArrow(run, f"doc_id long, spans {SPAN_TYPE}")


def redact_column(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, secrets in the text replaced; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index(text_col)
            clean = [t and redact(t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, text_col, pa.array(clean, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def listed(found: str | Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    some = F.col(found) if isinstance(found, str) else found
    if kinds is not None:
        some = F.filter(some, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(found: str, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
