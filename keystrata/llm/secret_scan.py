"""Secret scans with structural confirmation.

Patterns give the base findings. Beyond them, base64 and hex runs (of either case), and the parts of base64 runs that may be
a key after a name or path, are decoded and reported only if what comes out is a key by
its structure: DER whose nested lengths add up exactly and whose fields are a private key's, an OpenSSH private key container, or a signed token whose header
is JSON naming an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.shared import map_arrow
from keystrata.llm.textbytes import Texts, byte_set, chunks

#: Fixed values of the contract, and the order in which kinds sort; the method's kinds follow.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "pem", "jwt", "der", "hexder")
_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX = byte_set((ord("0"), ord("9")), (ord("a"), ord("f")))
_ANY_HEX = _HEX | byte_set((ord("A"), ord("F")))
_BASE64 = byte_set((ord("0"), ord("9")), (ord("A"), ord("Z")), (ord("a"), ord("z")), *[(ord(c), ord(c)) for c in "+/-_="])
#: Newlines in a PEM body may be escaped, as in JSON strings.
_ESCAPED = re.compile(rb"\\+[nrt]")
_PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----\s*+((?:[A-Za-z0-9-]++:[^\r\n]*+\r?\n)*+)((?:[A-Za-z0-9+/=\s]++|\\++[nrt])++)-----END \1-----")
#: Header of a body that is encrypted as a whole, so that only its length, in cipher blocks, can be confirmed.
_SEALED, CIPHER_BLOCK = re.compile(rb"^DEK-Info: *[A-Z0-9-]+,[0-9A-Fa-f]+\r?$", re.MULTILINE), 8
_JWT = re.compile(rb"(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
#: Shorter runs hold no key.
MIN_BASE64, MIN_DER = 40, 16
#: Primitive DER values: universal ones up to BMPString, and a public key in a tagged bit string.
_PRIMITIVE = frozenset(range(0x01, 0x1F)) - {0x08, 0x0B, 0x10, 0x11} | {0x81}
#: The next line of a base64 run that is wrapped without armour.
_WRAPPED = re.compile(rb"\r?\n([A-Za-z0-9+/]++={0,2}+)")
#: Where a key may begin within a base64 run: at its start, or after a byte that may belong to what stands before the key
#: (a name, a path, the mark of an added line). DER begins with a SEQUENCE, the other kind with its magic.
_KEY_START = re.compile(rb"(?:(?<=[=/_+-])|\A)(?:M[A-I]|b3BlbnNzaC1rZXktdjEA)")
_BREAKS = b"/_+-"
#: A DER key that goes on in further lines begins here; what stands before it must not be base64 of its own.
_WRAPPED_START = re.compile(rb"(?:(?<==)|\A)M[A-I][A-Za-z0-9+/]{38,}\Z")


def decoded(run: bytes) -> bytes | None:
    """Standard or URL-safe base64, padded or not; None if it isn't."""
    body = run.rstrip(b"=").translate(bytes.maketrans(b"-_", b"+/"))
    if b"=" in body or len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + b"=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def _length(data: bytes, at: int) -> tuple[int, int] | None:
    """A DER length: (value, where the content begins)."""
    if at >= len(data):
        return None
    first = data[at]
    if first < 0x80:
        return first, at + 1
    n = first & 0x7F
    if not 1 <= n <= 4 or at + 1 + n > len(data):
        return None
    value = int.from_bytes(data[at + 1 : at + 1 + n], "big")
    return (value, at + 1 + n) if value >= 0x80 and data[at + 1] else None


def der_parts(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, from, to) of the values that fill data[at:end]; None if their lengths don't add up."""
    out = []
    while at < end:
        got = _length(data, at + 1)
        if got is None or sum(got) > end:
            return None
        out.append((data[at], got[1], sum(got)))
        at = sum(got)
    return out


def _nests(data: bytes, at: int, end: int, depth: int) -> bool:
    """Whether values fill data[at:end] and constructed ones are filled in turn, with no unknown tag."""
    parts = der_parts(data, at, end)
    if parts is None or depth < 0:
        return False
    return all(_nests(data, a, b, depth - 1) if tag in (0x30, 0x31) or tag & 0xE0 == 0xA0 else tag in _PRIMITIVE for tag, a, b in parts)


def _is_algorithm(data: bytes, part: tuple[int, int, int]) -> bool:
    inner = der_parts(data, *part[1:]) if part[0] == 0x30 else None
    return bool(inner) and inner[0][0] == 0x06


def is_der_key(data: bytes, most_depth: int = 8) -> bool:
    """A SEQUENCE that fills the data, nested lengths that add up all the way down, and the fields of a private key.

    That is: version 0 or 1, an algorithm (not in a bare elliptic curve key), an octet string, and nothing but tagged parts; version 0 and
    the 8 integers of an RSA key or the 5 of a DSA key, or version 1, 8 integers and a sequence of further primes;
    or, encrypted, an algorithm and an octet string. Public keys, certificates and signatures are none of these.
    """
    if len(data) < MIN_DER or data[0] != 0x30 or not _nests(data, 0, len(data), most_depth):
        return False
    outer = der_parts(data, 0, len(data))
    parts = der_parts(data, *outer[0][1:]) if len(outer) == 1 else None
    if not parts:
        return False
    tags = [t for t, _, _ in parts]
    if tags == [0x30, 0x04]:
        return _is_algorithm(data, parts[0])
    version = data[parts[0][1] : parts[0][2]] if tags[0] == 0x02 else None
    if version not in (b"\0", b"\1"):
        return False
    if set(tags) == {0x02}:
        return version == b"\0" and len(tags) in (6, 9)
    if tags[:9] == [0x02] * 9:
        return version == b"\1" and tags[9:] == [0x30]
    rest = parts[2:] if len(parts) > 1 and _is_algorithm(data, parts[1]) else parts[1:]
    return bool(rest) and rest[0][0] == 0x04 and rest[0][1] < rest[0][2] and all(t & 0xC0 == 0x80 for t, _, _ in rest[1:])


def is_key(data: bytes) -> bool:
    if data.startswith(b"openssh-key-v1\0"):
        at = 15
        for _ in range(3):  # cipher, key derivation, its options: strings with 4-byte lengths
            at += 4 + int.from_bytes(data[at : at + 4], "big")
        return at + 4 <= len(data)
    return is_der_key(data)


def base64_keys(run: bytes) -> list[tuple[int, int]]:
    """(start, end) of the keys in a base64 run: '=' ends a part unless it's padding, and a key may have a prefix or, if it's DER, a suffix."""
    out: list[tuple[int, int]] = []
    at, body = 0, -1
    while m := _KEY_START.search(run, at):
        start, at = m.start(), m.start() + 1
        if body < start:
            body = run.find(b"=", start)
            body = len(run) if body < 0 else body
        end = body
        if run[start : start + 1] == b"M":  # its length is told by its first bytes
            got = _length(decoded(run[start : min(start + 8, body)]) or b"", 1)
            if got is None:
                continue
            end = start + ((got[0] + got[1]) * 4 + 2) // 3
            if end > body or (end < body and run[end] not in _BREAKS):
                continue
        while end >= body and end < len(run) and run[end : end + 1] == b"=":
            end += 1
        if end - start >= MIN_BASE64 and (data := decoded(run[start:end])) and is_key(data):
            out.append((start, end))
            at = end
    return out


def is_pem_key(headers: bytes, body: bytes) -> bool:
    data = decoded(b"".join(_ESCAPED.sub(b"", body).split()))
    if data and _SEALED.search(headers):
        return len(data) >= MIN_DER and len(data) % CIPHER_BLOCK == 0
    return bool(data) and is_key(data)


def wrapped_key(text: bytes, start: int, end: int) -> int | None:
    """Where a DER key ends that begins with the run text[start:end] and is wrapped over further lines; None if there is none."""
    got = _length(decoded(text[start : start + 8]) or b"", 1)
    most = ((sum(got) * 4 + 2) // 3 + 3) // 4 * 4 if got else 0  # characters, padding included
    lines, held = [text[start:end]], end - start
    while held < most and (m := _WRAPPED.match(text, end)):
        if len(m[1]) > len(lines[0]):
            return None  # only the last line may differ in length, and it's shorter
        lines.append(m[1])
        held, end = held + len(m[1]), m.end()
        if len(m[1]) < len(lines[0]):
            break
    data = decoded(b"".join(lines)) if len(lines) > 1 and held <= most else None
    return end if data and is_key(data) else None


def is_signed_token(header: bytes) -> bool:
    raw = decoded(header)
    try:
        found = json.loads(raw or b"")
    except (ValueError, RecursionError):
        return False
    return isinstance(found, dict) and isinstance(found.get("alg"), str)


def _long_runs(texts: Texts, member: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(text, start, end) of maximal runs of at least ``least`` bytes; starts and ends within the chunk's buffer."""
    inside = np.zeros(len(texts.data) + len(texts) + 1, dtype=bool)  # a gap after each text keeps runs apart
    gap = np.repeat(np.arange(len(texts)), np.diff(texts.offsets))
    inside[np.arange(len(texts.data)) + gap] = member[texts.data]
    edges = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    a, b = edges[::2], edges[1::2]
    long = b - a >= least
    a, b = a[long], b[long]
    # undo the gaps: a run in text i was moved by i
    bounds = texts.offsets[:-1] + np.arange(len(texts))
    i = np.searchsorted(bounds, a, side="right") - 1
    return list(zip(i.tolist(), (a - i).tolist(), (b - i).tolist(), strict=True))


def findings(texts: Texts) -> list[list[tuple[int, int, str]]]:
    """Of each text: (start, end, kind) in bytes of the chunk's buffer, unsorted."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in range(len(texts))]
    lower = _long_runs(texts, _HEX, MIN_HEX)
    for i, a, b in lower:
        out[i].append((a, b, "hex"))
    for i, a, b in sorted({*lower, *_long_runs(texts, _ANY_HEX, MIN_HEX)}):
        run = texts.data[a:b].tobytes()
        if len(run) % 2 == 0 and run.startswith(b"30") and is_key(bytes.fromhex(run.decode())):
            out[i].append((a, b, "hexder"))
    wrapped: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for i, a, b in _long_runs(texts, _BASE64, MIN_BASE64):
        run = texts.data[a:b].tobytes()
        out[i] += [(a + start, a + end, "der") for start, end in base64_keys(run)]
        if texts.data[b : b + 1].tobytes() in (b"\r", b"\n") and (m := _WRAPPED_START.search(run)):
            wrapped[i].append((a + m.start(), b))
    for i in range(len(texts)):
        text, at = texts.bytes_of(i), int(texts.offsets[i])
        pems = [(at + m.start(), at + m.end()) for m in _PEM.finditer(text) if is_pem_key(m[2], m[3])] if b"PRIVATE KEY-----" in text else []
        out[i] += [(a, b, "pem") for a, b in pems]
        reach = 0
        for a, b in wrapped[i]:  # within armour it's reported already
            if a >= reach and not any(x <= a < y for x, y in pems) and (end := wrapped_key(text, a - at, b - at)):
                reach = at + end
                out[i].append((a, reach, "der"))
        low = text.lower()
        if any(n in low for n in _NAMES):
            out[i] += [(at + m.start(), at + m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN]
        if b"AKIA" in text:
            out[i] += [(at + m.start(), at + m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
        if b"eyJ" in text:
            out[i] += [(at + m.start(), at + m.end(), "jwt") for m in _JWT.finditer(text) if is_signed_token(m[1]) and decoded(m[2]) is not None]
    return out


_OUT = "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string"


def _scan(batches):
    rank = {k: n for n, k in enumerate(KINDS)}
    for chunk in chunks(batches):
        texts = Texts(chunk.column(1))
        points = np.zeros(len(texts.data) + 1, dtype=np.int64)  # code points before each byte
        np.cumsum((texts.data & 0xC0) != 0x80, out=points[1:])
        rows = []
        for i, found in enumerate(findings(texts)):
            base = points[texts.offsets[i]]
            spans = [(int(points[a] - base), int(points[b] - base), k) for a, b, k in sorted(found, key=lambda x: (x[0], rank[x[2]]))]
            told = [f"{k}:{a}:{b}" for a, b, k in spans]
            n = [sum(k == x for _, _, k in spans) for x in KINDS[:3]]
            rows.append((*n, ",".join(t for t, (_, _, k) in zip(told, spans, strict=True) if rank[k] < 3), ",".join(told)))
        columns = list(zip(*rows, strict=True))
        arrays = [chunk.column(0).cast(pa.int64()), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"])


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: numbers of base findings, their spans, and all spans, as kind:start:end in code points.

    Spans sort by start, then by kind. Null and empty texts have none (empty strings). Rows are judged on their
    own: repeated rows give repeated results, a null doc_id stays null, other columns are ignored.
    """
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _scan, _OUT)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, from ``scan_secrets``."""
    return scan_secrets(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def query(spark, sf_dir: str) -> DataFrame:
    return digest(spark.read.parquet(f"{sf_dir}/documents.parquet"))
