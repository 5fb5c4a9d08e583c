"""Secret scans: candidates by pattern, and decoded ones reported only when their structure holds."""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.llm.base import map_arrow, pick

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40})PRIVATE KEY-----((?:[^-]|-(?!----)){16,}?)-----END \1PRIVATE KEY-----")
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
BLOB = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{32,}={0,2}")
#: a further line of a blob that is broken over lines
WRAPPED = re.compile(r"\r?\n[ \t]*([A-Za-z0-9+/_-]+={0,2})(?![A-Za-z0-9+/_=-])")
#: a header line of an old key file, and what of it tells how the key is encrypted
HEADER = re.compile(r"(?m)^[ \t]*[A-Za-z-]+: [^\n]*$")
SEALED = re.compile(r"DEK-Info: [A-Z0-9-]+,([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})\s")
HEX_BLOB = re.compile(r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{2}){24,}(?![0-9A-Za-z])")
#: in the order in which spans at the same place are listed
KINDS = ("assign", "access", "hex", "pem", "jwt", "key64", "keyhex")
SSH_MAGIC = b"openssh-key-v1\0"
# Object identifiers of key kinds, and of ways to encrypt a key (by how they begin), as DER has them.
RSA, RSA_PSS = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a864886f70d01010a")
EC, DSA = bytes.fromhex("2a8648ce3d0201"), bytes.fromhex("2a8648ce380401")
CURVES = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}  # x25519, x448, ed25519, ed448: bytes of a key
SEALS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
# Bytes of a token's signature by algorithm.
SIGNATURES = {"HS256": (32,), "HS384": (48,), "HS512": (64,), "ES256": (64,), "ES384": (96,), "ES512": (132,), "EDDSA": (64, 114)}
WORDS = ("passw", "secret", "token", "api")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Leftmost non-overlapping matches of each kind that are long enough: ``(start, end, kind)`` in code points."""
    out = []
    small = text.lower()
    if any(w in small for w in WORDS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return out


def hex_spans(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 16]


def der(data: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> list[tuple[int, bytes | list]] | None:
    """The elements of a DER encoding, constructed ones parsed too; None unless every length fits its parent exactly."""
    end, out = len(data) if end is None else end, []
    while at < end:
        if end - at < 2 or depth > 16:
            return None
        tag, size, at = data[at], data[at + 1], at + 2
        if size >= 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end or data[at] == 0:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
            if size < 0x80:
                return None
        if at + size > end:
            return None
        if tag & 0x20:
            inner = der(data, at, at + size, depth + 1)
            if inner is None:
                return None
            out.append((tag, inner))
        else:
            out.append((tag, data[at : at + size]))
        at += size
    return out


def _is_rsa(parts: list) -> bool:
    """Version, modulus, two exponents, two primes, two exponents, a coefficient."""
    return len(parts) >= 9 and all(t == 2 and v for t, v in parts[:9]) and parts[0][1] in (b"\0", b"\1") and len(parts[1][1]) >= 32


def _is_ec(parts: list) -> bool:
    """Version, scalar, and perhaps a curve and a point."""
    return [t for t, _ in parts[:2]] == [2, 4] and parts[0][1] == b"\1" and 20 <= len(parts[1][1]) <= 66 and all(t in (0xA0, 0xA1) for t, _ in parts[2:])


def _holds(kind: bytes, raw: bytes) -> bool:
    """Whether a key's octets are a key of that kind."""
    inner = der(raw)
    if not inner or len(inner) != 1:
        return False
    tag, value = inner[0]
    if kind in (RSA, RSA_PSS):
        return tag == 0x30 and _is_rsa(value)
    if kind == EC:
        return tag == 0x30 and _is_ec(value)
    if kind == DSA:
        return tag == 2 and len(value) >= 16
    return tag == 4 and len(value) == CURVES.get(kind)


def fields(data: bytes, at: int = 0, most: int | None = None) -> tuple[list[bytes], int] | None:
    """Up to ``most`` strings with 4-byte lengths from ``at`` on, and where they end; None if one doesn't fit."""
    out: list[bytes] = []
    while at < len(data) and (most is None or len(out) < most):
        end = at + 4 + int.from_bytes(data[at : at + 4], "big")
        if at + 4 > len(data) or end > len(data):
            return None
        out.append(data[at + 4 : end])
        at = end
    return out, at


def is_ssh_container(data: bytes) -> bool:
    """Cipher, derivation and options, how many keys, each one's public form, and the private part, which ends the data."""
    got = fields(data, len(SSH_MAGIC), 3)
    if not got or len(got[0]) < 3:
        return False
    (cipher, kdf, options), at = got
    n = int.from_bytes(data[at : at + 4], "big")
    got = fields(data, at + 4) if 1 <= n <= 16 else None
    if not got or len(got[0]) != n + 1:
        return False
    *public, private = got[0]
    if not all((inner := fields(key)) and len(inner[0]) >= 2 and inner[0][0].isascii() and inner[0][0] for key in public):
        return False
    if cipher != b"none":
        salt = fields(options, 0, 1)  # a salt, then the rounds as a number
        return len(private) >= 16 and len(private) % 8 == 0 and kdf != b"none" and salt is not None and salt[1] + 4 == len(options)
    if kdf != b"none" or options or len(private) < 8 or private[:4] != private[4:8]:
        return False
    body = private[8:]
    for pad in range(256):  # 1, 2, 3 ... up to a whole block
        if pad and (len(body) < pad or body[-pad:] != bytes(range(1, pad + 1))):
            if pad > 16:
                return False
            continue
        inner = fields(body[: len(body) - pad])
        if inner and len(inner[0]) >= 3 * n and any(x == fields(public[0])[0][0] for x in inner[0]):
            return True
        if pad > 16:
            return False
    return False


def is_private_key(data: bytes) -> bool:
    """A private key's encoding: PKCS#1, PKCS#8 (plain or encrypted), SEC1 or the OpenSSH container, all nested lengths right."""
    if data.startswith(SSH_MAGIC):
        return is_ssh_container(data)
    if data[:1] != b"\x30":
        return False
    top = der(data)
    if not top or len(top) != 1:
        return False
    parts = top[0][1]
    tags = [t for t, _ in parts]
    if _is_rsa(parts):
        return True
    if tags[:3] == [2, 0x30, 4] and parts[0][1] in (b"\0", b"\1"):  # version, algorithm, key
        return bool(parts[1][1]) and parts[1][1][0][0] == 6 and _holds(parts[1][1][0][1], parts[2][1])
    if _is_ec(parts):
        return len(parts) > 2
    sealed = tags == [0x30, 4] and bool(parts[0][1]) and parts[0][1][0][0] == 6 and parts[0][1][0][1].startswith(SEALS)
    return sealed and len(parts[1][1]) % 8 == 0 and len(parts[1][1]) >= 40


def is_key_file(body: str) -> bool:
    """What stands between the marks of a key file: base64 with line ends, also escaped ones, and header lines."""
    body = body.replace("\\r", "").replace("\\n", "\n").replace("\\", "")
    sealed = SEALED.search(body)
    raw = decoded("".join(HEADER.sub("", body).split()))
    if not raw:
        return False
    return len(raw) >= 32 and len(raw) % (len(sealed[1]) // 2) == 0 if sealed else is_private_key(raw)


def whole_length(head: str) -> int | None:
    """Characters of base64 that the encoding takes which begins so, by its outermost length."""
    raw = decoded(head[:16]) or b""
    if len(raw) < 6 or raw[0] != 0x30:
        return None
    n = raw[1] & 0x7F if raw[1] & 0x80 else 0
    if n > 4:
        return None
    size = 2 + n + (int.from_bytes(raw[2 : 2 + n], "big") if n else raw[1])
    return -(-size * 4 // 3)


def joined(text: str, match: re.Match) -> tuple[str, int]:
    """A blob with the lines it goes on in, where its own length says that it does, and where it ends."""
    blob, end, head = match[0], match.end(), match[0][:16]
    ssh = blob.startswith("b3BlbnNz")
    need = None if ssh else whole_length(head)
    while (ssh or (need is not None and len(blob.rstrip("=")) < need)) and not blob.endswith("=") and (more := WRAPPED.match(text, end)):
        if len(more[1]) > len(match[0]):
            break
        blob, end = blob + more[1], more.end()
        if ssh and len(more[1]) < len(match[0]):
            break
    return blob, end


def decoded(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def is_signed_token(text: str) -> bool:
    """A header with an algorithm, a body that is an object, and a signature of that algorithm's length (none for none)."""
    head, body, signature = text.split(".")
    try:
        header, claims = (json.loads(decoded(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    if not (isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict)):
        return False
    raw, algorithm = decoded(signature) if signature else b"", header["alg"].upper()
    if raw is None:
        return False
    if algorithm == "NONE":
        return not raw
    if algorithm in SIGNATURES:
        return len(raw) in SIGNATURES[algorithm]
    return len(raw) >= (128 if algorithm[:2] in ("RS", "PS") else 16)


def found_spans(text: str) -> list[tuple[int, int, str]]:
    """What the patterns of encoded keys and tokens find and their decoded structure confirms."""
    out = []
    if "PRIVATE KEY-----" in text:
        out += [(m.start(), m.end(), "pem") for m in PEM.finditer(text) if is_key_file(m[2])]
    if "eyJ" in text:
        out += [(m.start(), m.end(), "jwt") for m in TOKEN.finditer(text) if is_signed_token(m[0])]
    done = 0
    for m in BLOB.finditer(text):
        if m.start() >= done and (m[0][0] == "M" or m[0].startswith("b3BlbnNz")):
            blob, end = joined(text, m)
            raw = decoded(blob)
            if raw and is_private_key(raw) and not any(kind == "pem" and a <= m.start() < b for a, b, kind in out):
                out.append((m.start(), end, "key64"))
                done = end
    for m in HEX_BLOB.finditer(text):
        raw = bytes.fromhex(m[0])
        if is_private_key(raw):
            out.append((m.start(), m.end(), "keyhex"))
    return out


def listed(spans: list[tuple[int, int, str]]) -> str:
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in order)


def runs(data: np.ndarray, offsets: np.ndarray, allowed: np.ndarray, least: int) -> np.ndarray:
    """Which of the texts that lie end to end in ``data`` have a run of ``least`` allowed bytes; a run over a border counts for both."""
    breaks = np.concatenate([[-1], np.flatnonzero(~allowed[data]), [len(data)]])
    at = np.flatnonzero(np.diff(breaks) > least)
    hit = np.zeros(len(offsets) - 1, bool)
    for a, b in zip(breaks[at] + 1, breaks[at + 1], strict=True):
        first, last = np.searchsorted(offsets, [a, b - 1], side="right") - 1
        hit[first : last + 1] = True
    return hit


def _set(*characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in "".join(characters)]] = True
    return out


_DIGITS, _LOWER = "0123456789", "abcdefghijklmnopqrstuvwxyz"
_HEX, _BLOB = _set(_DIGITS, "abcdef"), _set(_DIGITS, _LOWER, _LOWER.upper(), "+/_-=")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` for each row of ``docs(doc_id, text)``; no shuffle.

    Spans are ``kind:start:end`` in code points, by start, then kind. Kinds beyond the three of the base are reported only
    where the decoded bytes parse as a private key (nested lengths must all fit) or a signed token. A null or empty text
    has no spans. Repeated rows are scanned each; texts are scanned whole, however long. An empty table gives none; other
    columns, also with clashing names, are left. Of spans that begin together the order of ``KINDS`` holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            packed = pa.array(texts, pa.large_string())
            offsets = np.frombuffer(packed.buffers()[1], np.int64)[: len(texts) + 1] if texts else np.zeros(1, np.int64)
            data = np.frombuffer(packed.buffers()[2], np.uint8)[: offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
            with_hex, with_blob = runs(data, offsets, _HEX, 15), runs(data, offsets, _BLOB, 31)
            out: list[list] = [[], [], [], [], []]
            for text, has_hex, has_blob in zip(texts, with_hex.tolist(), with_blob.tolist(), strict=True):
                base = base_spans(text)
                if has_hex:
                    base += hex_spans(text)
                more = found_spans(text) if has_blob or "eyJ" in text or "PRIVATE KEY-----" in text else []
                kinds = [kind for _, _, kind in base]
                for column, value in zip(out, (kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + more)), strict=True):
                    column.append(value)
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.record_batch([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_arrow(pick(docs, "doc_id", "text"), run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
