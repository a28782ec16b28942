"""Secret scan with structural confirmation.

Three base patterns find assigned values, access key ids and long hex runs. Beside
them the method decodes base64 and hex candidates and reports one only when its
bytes parse: PEM blocks and bare DER keys by nested lengths that add up exactly,
SSH keys by their length-prefixed fields, signed tokens by a JSON header that
names an algorithm. PEM blocks may be encoded once more; public keys are no secrets. Bodies may be wrapped over lines, with real or escaped line
breaks, and hex may start with 0x. Every base span stays; confirmed spans are added.

Defined cases: a null text counts as empty and gives no spans; texts are scanned
whole; spans are code points, end exclusive, ordered by start, then kind in the
order of ``KINDS``, then end; repeated rows are scanned each; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Order of kinds at equal starts; the first three are the base patterns.
KINDS = ["assign", "access", "hex", "pem", "der", "ssh", "token"]
_KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PEM_BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]{1,40})-----")
#: Line breaks, also those that a quoted string writes as two characters.
_BREAKS = re.compile(r"(?:\\[rn]|[\r\n])+")
_PEM_HEADER = re.compile(r"[A-Za-z][A-Za-z0-9-]*: ")
_BASE64 = re.compile(r"[A-Za-z0-9+/]*={0,2}")
_ENCODED = re.compile(r"[A-Za-z0-9+/_-]{32,}={0,2}")
_ANY_HEX = re.compile(r"(?:0[xX])?([0-9A-Fa-f]{48,})")
#: Blanks with a line break between two lines of one wrapped value, and a last line.
_WRAP = re.compile(r"[ \t]{0,64}\r?\n[ \t]{0,64}")
_LAST_LINE = re.compile(r"([A-Za-z0-9+/]+={0,2})(?![A-Za-z0-9+/=_-])")
#: Characters of a signed token. A JSON object's first bytes in base64 are ``ey`` or ``ew``.
_TOKEN_RUN = re.compile(r"[A-Za-z0-9_.-]+")
_TOKEN_START = re.compile(r"e[yw]")
_MAX_NESTING = 16
#: Integers of the shortest private key that is a list of integers.
_PRIVATE_INTEGERS = 6
#: Fixed value: what a private SSH container starts with.
_SSH_PRIVATE = b"openssh-key-v1\0"


def decoded(text: str) -> bytes | None:
    """Bytes of standard or URL-safe base64, with or without padding."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _der_items(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """Tag and content of each element, if the lengths fill ``data`` exactly at every level."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data) or depth > _MAX_NESTING:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > len(data) or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return None
        if at + size > len(data):
            return None
        body = data[at : at + size]
        if tag & 0x20 and _der_items(body, depth + 1) is None:
            return None
        items.append((tag, body))
        at += size
    return items


def is_der_key(data: bytes) -> bool:
    """A sequence, filling the data, that holds a private key: a version, an algorithm and an octet string; an encrypted
    octet string after its algorithm; a version with an octet string; or a version 0 with the integers of a private key.
    Public keys are no secrets: a bit string after an algorithm, or few integers.
    """
    if len(data) < 24 or data[0] != 0x30:
        return False
    outer = _der_items(data)
    if outer is None or len(outer) != 1:
        return False
    inside = _der_items(outer[0][1]) or []
    tags = [t for t, _ in inside]
    if tags == [0x30, 0x04]:  # encrypted: the algorithm is named by an object identifier
        return inside[0][1][:1] == b"\x06"
    if tags[:3] == [0x02, 0x30, 0x04] or tags[:2] == [0x02, 0x04]:
        return True
    return len(tags) >= _PRIVATE_INTEGERS and set(tags[:_PRIVATE_INTEGERS]) == {0x02} and inside[0][1] in (b"\0", b"\1") and max(len(b) for _, b in inside) >= 16


def is_ssh_key(data: bytes) -> bool:
    """The private container: length-prefixed names of cipher and key derivation with its options, then keys."""
    if not data.startswith(_SSH_PRIVATE):
        return False
    fields, left = _fields(data[len(_SSH_PRIVATE) :], 3)
    return len(fields) == 3 and len(left) > 4


def _fields(data: bytes, most: int) -> tuple[list[bytes], bytes]:
    out: list[bytes] = []
    while data and len(out) < most:
        size = int.from_bytes(data[:4], "big")
        if len(data) < 4 or size > len(data) - 4:
            return [], data
        out.append(data[4 : 4 + size])
        data = data[4 + size :]
    return out, data


def _object(part: str) -> dict | None:
    """The JSON object that a part of a token decodes to."""
    try:
        value = json.loads(decoded(part) or b"")
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def token_spans(text: str) -> list[tuple[int, int]]:
    """Signed and encrypted tokens: a header that is a JSON object naming an algorithm, then claims that are one and a signature, or encrypted parts.

    A header starts where its part of a dotted run starts, or at the first ``ey`` or ``ew``
    there of each of the four ways base64 can lie, so each part is decoded five times at most.
    """
    found = []
    for run in _TOKEN_RUN.finditer(text):
        if "." not in run[0]:
            continue
        parts = run[0].split(".")
        k, at = 0, run.start()
        while k + 2 < len(parts):
            part, taken = parts[k], 1
            if len(part) >= 16 and len(parts[k + 1]) >= 2:
                for start in _header_starts(part):
                    head = _object(part[start:])
                    if head is None or not isinstance(head.get("alg"), str):
                        continue
                    if "enc" in head or _object(parts[k + 1]) is not None:
                        taken = 5 if "enc" in head and len(parts) >= k + 5 else 3
                        found.append((at + start, at + sum(map(len, parts[k : k + taken])) + taken - 1))
                        break
            at += sum(map(len, parts[k : k + taken])) + taken
            k += taken
    return found


def _header_starts(part: str) -> list[int]:
    starts: dict[int, int] = {}
    for m in _TOKEN_START.finditer(part):
        starts.setdefault(m.start() % 4, m.start())
        if len(starts) == 4:
            break
    return sorted(starts.values())


def pem_spans(text: str) -> list[tuple[int, int]]:
    """PEM blocks whose body parses as a key, or whose headers name a cipher for whole blocks of it. Header lines and escaped line breaks are allowed."""
    found = []
    for m in _PEM_BEGIN.finditer(text):
        end = text.find("-----", m.end())
        last = f"-----END {m[1]}-----"
        if end < 0 or not text.startswith(last, end):
            continue
        lines = [line.strip() for line in _BREAKS.split(text[m.end() : end])]
        head = [line for line in lines if _PEM_HEADER.match(line)]
        body = "".join("".join(line.split()) for line in lines if not _PEM_HEADER.match(line))
        data = decoded(body) if _BASE64.fullmatch(body) else None
        if data and (is_der_key(data) or is_ssh_key(data) or (any(h.startswith("DEK-Info: ") for h in head) and len(data) % 8 == 0)):
            found.append((m.start(), end + len(last)))
    return found


def _key_kind(run: str) -> int | None:
    """4 for a DER key, 5 for an SSH key, 3 for a whole PEM block, in base64 or hex."""
    m = _ANY_HEX.fullmatch(run)
    for data in (decoded(run), bytes.fromhex(m[1]) if m and len(m[1]) % 2 == 0 else None):
        if data and is_der_key(data):
            return 4
        if data and is_ssh_key(data):
            return 5
        if data and data.lstrip()[:11] == b"-----BEGIN " and pem_spans(data.decode("latin-1")):
            return 3
    return None


def encoded_spans(text: str) -> list[tuple[int, int, int]]:
    """Keys in base64 or hex, on one line or wrapped over lines of equal length with a shorter last one."""
    found, wrapped = [], None
    for m in [*_ENCODED.finditer(text), None]:
        if wrapped and m and m.end() - m.start() <= wrapped[2] and (w := _WRAP.match(text, wrapped[1])) and w.end() == m.start():
            wrapped = (wrapped[0], m.end(), wrapped[2]) if m.end() - m.start() == wrapped[2] else _closed(text, wrapped, m.end(), found)
            continue
        if wrapped:
            tail = (w := _WRAP.match(text, wrapped[1])) and _LAST_LINE.match(text, w.end())
            _closed(text, wrapped, tail.end() if tail and len(tail[1]) <= wrapped[2] else wrapped[1], found)
        wrapped = None
        if m and (kind := _key_kind(m[0])) is not None:
            found.append((m.start(), kind, m.end()))
        elif m and not m[0].endswith("="):
            wrapped = (m.start(), m.end(), m.end() - m.start())
    return found


def _closed(text: str, wrapped: tuple[int, int, int], end: int, found: list[tuple[int, int, int]]) -> None:
    """Report a wrapped value that ends at ``end``, if it is a key."""
    if end > wrapped[0] + wrapped[2] and (kind := _key_kind("".join(text[wrapped[0] : end].split()))) is not None:
        found.append((wrapped[0], kind, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns."""
    found: list[tuple[int, int, int]] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates whose decoded structure parses. Every step is linear in the text."""
    found = [(a, 3, b) for a, b in pem_spans(text)] if "-----BEGIN " in text else []
    blocks = [(a, b) for a, _, b in found]
    # What a block reports as a whole is not reported again as its lines.
    starts = [a for a, _ in blocks]
    found += [e for e in encoded_spans(text) if not (k := bisect_right(starts, e[0])) or blocks[k - 1][1] <= e[0]]
    if "." in text and ("ey" in text or "ew" in text):
        found += [(a, 6, b) for a, b in token_spans(text)]
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string"
_ARROW = pa.schema([("doc_id", pa.int64())] + [(n, pa.int64()) for n in ("n_assign", "n_access", "n_hex")] + [("base_spans", pa.string()), ("spans", pa.string())])


def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to the spans of each document."""
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py() or ""
            base = base_spans(text)
            kinds = [k for _, k, _ in base]
            every = base + confirmed_spans(text)
            rows.append((doc_id.as_py(), kinds.count(0), kinds.count(1), kinds.count(2), joined(base), joined(every)))
        columns = list(zip(*rows)) or [()] * len(_ARROW)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def find_secrets(docs: DataFrame) -> DataFrame:
    """Counts and spans of each document; one narrow pass, no shuffle."""
    return docs.select("doc_id", "text").mapInArrow(scan, SCHEMA)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.selectExpr("doc_id", "n_assign", "n_access", "n_hex", "lower(sha2(base_spans, 256)) AS base_sha256", "spans")


def secret_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base patterns of each document, by the operator."""
    return op7_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


SECRET_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
  m AS (SELECT doc_id, regexp_extract_all(text, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1) AS assigned,
        regexp_extract_all(text, 'AKIA[A-Z0-9]+') AS access, regexp_extract_all(text, '[0-9a-f]+') AS hex FROM t)
SELECT doc_id, len(list_filter(assigned, lambda x: length(x) >= 6)) AS n_assign,
       len(list_filter(access, lambda x: length(x) >= 20)) AS n_access, len(list_filter(hex, lambda x: length(x) >= 24)) AS n_hex FROM m
"""
