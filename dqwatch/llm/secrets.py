"""Secret scan with structural confirmation.

Base patterns give the kinds ``assign``, ``access`` and ``hex``. Beside them, runs that look like base64 or
hexadecimal are decoded and reported only if their structure holds: DER private keys whose nested lengths fill
their parents exactly, OpenSSH private keys whose length-prefixed fields do, PEM blocks with such a body, and signed
tokens whose header is JSON with an algorithm. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession

from dqwatch.llm.common import map_columns, read

#: Order of kinds where two spans start at one place.
KINDS = ("assign", "access", "hex", "pem", "der", "openssh", "jwt")

_NAMES = r"(?:password|passwd|secret|token|api_?key)"
_ASSIGN = re.compile(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in _NAMES) + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs, as [0-9a-f]+ finds them
_ANY_HEX = re.compile(r"[0-9A-Fa-f]{48,}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
_TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]*\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
#: Runs of base64 over several lines; a line end may be escaped, as in JSON or an environment file.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:(?:\r\n?|\n|(?:\\+r)?\\+n)[\x20\t]*[A-Za-z0-9+/_-]++)++={0,2}")
_LINE = re.compile(r"(?:^|[\r\n]|\\+n)[\x20\t]*([A-Za-z0-9+/_-]+)")
_PEM = re.compile(r"-----BEGIN ([A-Z ]*PRIVATE KEY)-----((?:(?!-----BEGIN ).)*?)-----END \1-----", re.S)
_PEM_LINES = re.compile(r"(?:[\r\n]|\\+[rn])+")
#: Headers of a body that is encrypted with a passphrase; they may stand in one line with the body.
_PEM_SEALED = re.compile(r"(?:Proc-Type|DEK-Info):[\x20\t]*[A-Za-z0-9,-]+")
#: Object identifiers of key algorithms in DER (RSA, RSA-PSS, EC, DSA, DH, X25519, X448, Ed25519, Ed448).
_KEY_OIDS = {
    bytes.fromhex(x)
    for x in (
        "2a864886f70d010101",
        "2a864886f70d01010a",
        "2a8648ce3d0201",
        "2a8648ce380401",
        "2a864886f70d010301",
        "2b656e",
        "2b656f",
        "2b6570",
        "2b6571",
    )
}
#: Password-based encryption (PBES2 and the older PKCS#5 and PKCS#12 families).
_PBE_PREFIXES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
_OPENSSH = b"openssh-key-v1\0"


def _children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the DER elements that fill data[start:end] exactly, else None."""
    out = []
    while start < end:
        if end - start < 2:
            return None
        tag, size, body = data[start], data[start + 1], start + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or body + n > end or data[body] == 0:
                return None
            size, body = int.from_bytes(data[body : body + n], "big"), body + n
            if size < 0x80:
                return None
        if body + size > end:
            return None
        out.append((tag, body, body + size))
        start = body + size
    return out


def is_der_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8 (plain or encrypted), SEC 1 or DSA private key that fills ``data``."""
    if len(data) < 16 or data[0] != 0x30:
        return False
    top = _children(data, 0, len(data))
    if not top or len(top) != 1:
        return False
    parts = _children(data, *top[0][1:])
    if not parts:
        return False
    tags = [p[0] for p in parts]
    value = lambda p: data[p[1] : p[2]]
    if tags[:2] == [0x02, 0x04] and value(parts[0]) == b"\x01":  # SEC 1: version, key, [0] curve, [1] point
        return len(value(parts[1])) >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    if tags[0] == 0x02 and all(t == 0x02 for t in tags) and value(parts[0]) in (b"\0", b"\x01"):
        return len(parts) == 9 or len(parts) == 6  # RSA: n e d p q dp dq u; DSA: p q g y x
    if tags[:3] == [0x02, 0x30, 0x04] and value(parts[0]) in (b"\0", b"\x01"):  # PKCS#8
        inner = _children(data, *parts[1][1:])
        return bool(inner) and inner[0][0] == 0x06 and value(inner[0]) in _KEY_OIDS and bool(value(parts[2]))
    if tags == [0x30, 0x04]:  # encrypted PKCS#8
        inner = _children(data, *parts[0][1:])
        return bool(inner) and inner[0][0] == 0x06 and value(inner[0]).startswith(_PBE_PREFIXES)
    return False


def is_openssh_key(data: bytes) -> bool:
    """Magic, cipher, key derivation and its options, key count, public keys, private block: all lengths hold."""
    size = _openssh_size(data)
    return size is not None and len(data) - size in range(0, 64)


def _openssh_size(data: bytes) -> int | None:
    """Bytes from the magic to the end of the private block (a tag may follow); None if a length doesn't hold."""
    if not data.startswith(_OPENSSH):
        return None
    at, fields = len(_OPENSSH), []

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    for _ in range(3):
        fields.append(field())
    if None in fields or not fields[0] or at + 4 > len(data):
        return None
    count = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not 1 <= count <= 16:
        return None
    rest = [field() for _ in range(count + 1)]
    return at if None not in rest and rest[-1] else None


def _der_size(data: bytes) -> int | None:
    """Bytes of the DER sequence that starts ``data``, by its head."""
    if len(data) < 6 or data[0] != 0x30:
        return None
    n = data[1] & 0x7F
    if not data[1] & 0x80:
        return 2 + n
    return 2 + n + int.from_bytes(data[2 : 2 + n], "big") if 1 <= n <= 4 else None


def _decoded(run: str) -> bytes | None:
    body = run.rstrip("=")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _key_kind(data: bytes | None) -> str | None:
    if data:
        if is_der_key(data):
            return "der"
        if is_openssh_key(data):
            return "openssh"
    return None


def is_signed_token(token: str) -> bool:
    """Three base64url parts: a JSON header with ``alg``, a payload, and a signature unless ``alg`` is none."""
    head, payload, signature = token.split(".")
    header, body, sealed = _decoded(head), _decoded(payload), _decoded(signature) if signature else b""
    if not header or not body or sealed is None:
        return False
    try:
        fields = json.loads(header)
    except (ValueError, RecursionError):
        return False
    alg = fields.get("alg") if isinstance(fields, dict) else None
    return isinstance(alg, str) and bool(alg) and (bool(sealed) or alg.lower() == "none")


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then by kind as listed in ``KINDS``, then by end; null is empty.

    Base kinds first; equal runs count at every place where they stand, and a span of one kind may hold another's.
    """
    text = text or ""
    found: list[tuple[str, int, int]] = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    found += _structural(text)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _starts(run: str, before: str) -> set[int]:
    """Where a key may start in a run of base64: at its start, behind a path or name, or behind an escaped line end."""
    return {0, *(x.end() for x in re.finditer(r"[/_-]", run)), *([1] if before == "\\" and run[:1] in ("n", "r", "t") else [])}


def _wrapped_keys(text: str, block: re.Match) -> list[tuple[str, int, int]]:
    """Keys over two or more lines of ``block``; each ends at the line end where its own lengths say so."""
    lines = [(block.start() + x.start(1), x[1]) for x in _LINE.finditer(block[0])]
    whole = "".join(x for _, x in lines)
    ends, total = [], 0
    for _, line in lines:
        total += len(line)
        ends.append(total)
    out: list[tuple[str, int, int]] = []
    over = begin = 0
    for i, (place, line) in enumerate(lines):
        for at in sorted(_starts(line, text[place - 1 : place] if i == 0 else "")):
            start = begin + at
            if start < over or whole[start : start + 1] not in ("M", "b"):
                continue
            if whole[start] == "M":
                size = _der_size(_decoded(whole[start : start + 12]) or b"")
            else:
                known = whole.startswith("b3BlbnNzaC1rZXktdjE", start)
                size = _openssh_size(_decoded(whole[start : start + (len(whole) - start) // 4 * 4]) or b"") if known else None
            chars = -(-size * 4 // 3) if size else 0
            # a tag behind an OpenSSH key's private block may fill its last line or take another
            for j in range(i + 1, len(lines)) if chars else ():
                if ends[j] < start + chars:
                    continue
                if kind := _key_kind(_decoded(whole[start : ends[j]])):
                    last = lines[j][0] + len(lines[j][1])
                    pad = block.end() - last if j == len(lines) - 1 else 0
                    out.append((kind, place + at, last + pad))
                    over = ends[j]
                if over > start or ends[j] > start + chars + 96:
                    break
        begin = ends[i]
    return out


def _structural(text: str) -> list[tuple[str, int, int]]:
    found: list[tuple[str, int, int]] = []
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            plain, sealed = _PEM_SEALED.subn("\n", m[2].replace("\\/", "/"))
            lines = _PEM_LINES.split(plain)
            bare = [x for x in lines if ":" not in x]  # without headers such as Comment
            body = _decoded("".join("".join(bare).split()))
            sealed = (sealed or len(bare) != len(lines)) and body is not None and len(body) >= 32
            if _key_kind(body) or sealed:
                found.append(("pem", *m.span()))
    pems = found.copy()
    if "eyJ" in text:
        found += [("jwt", *m.span()) for m in _TOKEN.finditer(text) if is_signed_token(m[0])]
    for m in _BASE64.finditer(text):
        # a key starts with a DER sequence ("M") or with the OpenSSH magic ("b3BlbnNz"), maybe behind a path or name
        for at in sorted(_starts(m[0], text[m.start() - 1 : m.start()])):
            run = m[0][at:]
            if run[0:1] in ("M", "b") and (kind := _key_kind(_decoded(run))):
                found.append((kind, m.start() + at, m.end()))
                break
    for m in _WRAPPED.finditer(text):
        if not any(a <= m.start() and m.end() <= b for _, a, b in pems):
            found += _wrapped_keys(text, m)
    for m in _ANY_HEX.finditer(text):
        if len(m[0]) % 2 == 0 and m[0][:2] in ("30", "6f", "6F") and (kind := _key_kind(bytes.fromhex(m[0]))):
            found.append((kind, *m.span()))
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Spans of every row of (doc_id, text), repeated rows and null ids included; rows without secrets have empty ``spans``."""

    def scan(ids: list, texts: list) -> tuple[list, ...]:
        out: tuple[list, ...] = (ids, [], [], [], [], [], [])
        for text in texts:
            spans = find_secrets(text)
            base = [s for s in spans if s[0] in KINDS[:3]]
            for column, kind in zip(out[1:4], KINDS, strict=False):
                column.append(sum(s[0] == kind for s in base))
            out[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out[5].append(joined(spans))
            out[6].append(len(spans) - len(base))
        return out

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_structural long"
    return map_columns(docs.select("doc_id", "text"), schema, scan)


def redact(text: str | None) -> str | None:
    """``text`` with every secret replaced by ``[kind]``; overlapping spans become one, named by the first."""
    if text is None:
        return None
    out, at, end = [], 0, 0
    for kind, a, b in find_secrets(text):
        if a >= end:
            out += [text[at:a], f"[{kind}]"]
        end = at = max(end, b)
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, with secrets replaced in ``text`` and ``n_chars`` counted anew if it is there."""
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def replace(*columns: list) -> list[list]:
        out = list(columns)
        out[at] = [redact(t) for t in columns[at]]
        if size is not None:
            out[size] = [n if new == old else len(new) for n, old, new in zip(columns[size], columns[at], out[at], strict=True)]
        return out

    return map_columns(docs, docs.schema, replace)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every whole text of ``documents``."""
    return scan_secrets(read(spark, sf_dir, "documents", "doc_id", "text"))
