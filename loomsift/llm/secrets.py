"""Secret scan with structural confirmation.

Plain patterns find assignments, access keys and hex runs.  Beyond them a run of base64
or hex, a PEM block or a dotted token is reported only when it decodes and parses: the
nested lengths of a key's encoding must fill the bytes exactly, and a signed token's
header must be JSON that names an algorithm.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import struct
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from loomsift.llm.common import arrow_rows, doc_texts, documents, give_back

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # maximal runs either way
ASSIGN_HINTS = ("passw", "secret", "token", "api")
MIN_VALUE, MIN_ACCESS = 12, 18
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "key", "token")

# "0" opens a DER sequence, "openssh-key-v1" an OpenSSH key; both fix the first base64 characters.
# A run may follow any sign (KEY=, a path, a diff's + or -) and an escaped line end; a key ends where its lengths say.
KEY_START = re.compile(r"[Mb](?:(?<![A-Za-z0-9].)|(?<=\\[nrt].))(?:(?<=M)[A-P]|(?<=b)3BlbnNzaC1rZXktdjE)[A-Za-z0-9+/_-]{18}")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]*")
HEX_KEY = re.compile(r"[36](?<![0-9A-Fa-f].)(?:(?<=3)0|(?<=6)[fF]70656[eE]7373682[dD]6[bB]65792[dD]763100)[0-9A-Fa-f]{32,}")
TOKEN_RUN = re.compile(r"(?:(?<![A-Za-z0-9_-])|(?<=\\[nrt]))[_-]*(e[wy][A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]*){2,4})")
LEAST_KEY = 38
PEM_OPEN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
OPENSSH = b"openssh-key-v1\0"


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value: int  # where the secret itself begins


def _der(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """Tag, first and last offset of the value that starts here; None if its length does not fit."""
    if at + 2 > end:
        return None
    tag, size = data[at], data[at + 1]
    at += 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > end:
            return None
        size = int.from_bytes(data[at:at + n], "big")
        at += n
    return (tag, at, at + size) if at + size <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    out = []
    while at < end:
        item = _der(data, at, end)
        if item is None:
            return None
        out.append(item)
        at = item[2]
    return out


def private_key(data: bytes) -> str | None:
    """The encoding of a private key these bytes are, exactly: rsa, dsa, ec, pkcs8, encrypted or openssh."""
    if data.startswith(OPENSSH):
        return "openssh" if _openssh(data) == len(data) else None
    top = _der(data, 0, len(data))
    if top is None or top[0] != 0x30 or top[2] != len(data):
        return None
    parts = _children(data, top[1], top[2])
    if not parts:
        return None
    tags = [t for t, _, _ in parts]
    first = data[parts[0][1]:parts[0][2]]
    if tags[0] == 0x02 and first == b"\0":
        if tags == [0x02] * 9:
            return "rsa"
        if tags == [0x02] * 6:
            return "dsa"
        if tags[1:3] == [0x30, 0x04]:
            algorithm = _children(data, *parts[1][1:])
            return "pkcs8" if algorithm and algorithm[0][0] == 0x06 else None
    if tags[0] == 0x02 and first == b"\1" and len(tags) > 1 and tags[1] == 0x04:
        return "ec" if 16 <= parts[1][2] - parts[1][1] <= 72 else None
    if tags == [0x30, 0x04]:
        algorithm = _children(data, *parts[0][1:])
        return "encrypted" if algorithm and algorithm[0][0] == 0x06 else None
    return None


def _openssh(data: bytes) -> int | None:
    """Length of the OpenSSH key these bytes begin with."""
    at = len(OPENSSH)

    def field() -> bytes | None:
        nonlocal at
        if at + 4 > len(data):
            return None
        size = struct.unpack_from(">I", data, at)[0]
        at += 4 + size
        return data[at - size:at] if at <= len(data) else None

    if any(field() is None for _ in range(3)) or at + 4 > len(data):
        return None
    count = struct.unpack_from(">I", data, at)[0]
    at += 4
    if not 1 <= count <= 64 or any(field() is None for _ in range(count)):
        return None
    return at if field() is not None else None


def decoded(run: str) -> bytes | None:
    """Bytes of a base64 or base64url run with or without its padding."""
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None


def signed_token(run: str) -> bool:
    """A dotted token whose header is JSON with an algorithm; a signed one has a JSON payload."""
    parts = run.split(".")
    head = decoded(parts[0])
    if head is None:
        return False
    try:
        header = json.loads(head)
        if not isinstance(header, dict) or not isinstance(header.get("alg"), str):
            return False
        if len(parts) == 5:
            return isinstance(header.get("enc"), str)
        body = decoded(parts[1])
        return len(parts) == 3 and body is not None and isinstance(json.loads(body), dict)
    except (ValueError, RecursionError):
        return False


def _key_end(text: str, start: int) -> int | None:
    """End of the base64 private key that starts here: its own lengths tell where it ends."""
    if text[start] == "b":
        run = BASE64.match(text, start)[0]
        data = decoded(run[:len(run) - (len(run) % 4 == 1)])
        size = _openssh(data) if data.startswith(OPENSSH) else None
    else:
        head = decoded(text[start:start + 8])
        n = head[1] & 0x7F if head[1] >= 0x80 else 0
        size = 2 + n + (int.from_bytes(head[2:2 + n], "big") if n else head[1]) if n <= 4 else None
    if size is None:
        return None
    end = start - (-4 * size // 3)
    if end - start < LEAST_KEY or end > len(text) or text[end:end + 1].isascii() and text[end:end + 1].isalnum():
        return None
    if BASE64.match(text, start, end).end() < end:
        return None
    data = decoded(text[start:end])
    if not data or not private_key(data):
        return None
    return end + len(text[end:end + 2]) - len(text[end:end + 2].lstrip("="))


def key_spans(text: str) -> list[Span]:
    """Private keys in base64 or in hex of either case."""
    out, at = [], 0
    while m := KEY_START.search(text, at):
        end = _key_end(text, m.start())
        if end:
            out.append(Span("key", m.start(), end, m.start()))
        at = end or m.start() + 1
    runs = {m.span() for m in HEX_KEY.finditer(text)} | {m.span() for m in HEX.finditer(text) if m[0].startswith(("30", "6f70656e"))}
    for start, end in sorted(runs):
        if (end - start) % 2 == 0 and end - start >= 64 and private_key(bytes.fromhex(text[start:end])):
            out.append(Span("key", start, end, start))
    return out


def token_spans(text: str) -> list[Span]:
    """Signed tokens, whatever dots or dotted names follow them."""
    out, at = [], 0
    while m := TOKEN_RUN.search(text, at):
        parts = m[1].split(".")
        run = next((r for n in (5, 3) if n <= len(parts) and signed_token(r := ".".join(parts[:n]))), None)
        at = m.start(1) + (len(run) if run else 2)
        if run:
            out.append(Span("token", m.start(1), at, m.start(1)))
    return out


def base_spans(text: str) -> list[Span]:
    out = []
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        out += [Span("assign", *m.span(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_VALUE]
    if "AKIA" in text:
        out += [Span("access", *m.span(), m.start()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [Span("hex", *m.span(), m.start()) for m in HEX.finditer(text)]
    return out


def confirmed_spans(text: str) -> list[Span]:
    """Spans that decode and parse as a private key or a signed token."""
    out = []
    if "-----BEGIN " in text:
        opens = list(PEM_OPEN.finditer(text))
        for m, end in zip(opens, [*(m.start() for m in opens[1:]), len(text)], strict=True):
            close = text.find(f"-----END {m[1]}-----", m.end(), end)
            if close < 0:
                continue
            body = re.sub(r"^[A-Za-z-]+:.*$", "", text[m.end():close], flags=re.M)
            data = decoded(re.sub(r"\s+|\\n", "", body))
            if data and (private_key(data) or "Proc-Type:" in text[m.end():close] and len(data) % 8 == 0):
                out.append(Span("pem", m.start(), close + len(f"-----END {m[1]}-----"), m.start()))
    out += key_spans(text)
    if "." in text:
        out += token_spans(text)
    return out


def secret_spans(text: str) -> list[Span]:
    """All spans of a text by start, then kind in the order of ``KINDS``."""
    return sorted(base_spans(text) + confirmed_spans(text), key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def masked(text: str, spans: list[Span], mask: str = "[secret]") -> str:
    """The text with every secret (of an assignment only the value) replaced."""
    out, at = [], 0
    for start, end in sorted((s.value, s.end) for s in spans):
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], mask]
        at = end
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per document the counts of base kinds, the digest of the base spans, all spans, and the number of confirmed ones.

    Offsets are code points.  A null text is empty; null doc_ids and repeated rows keep
    their rows; no row is dropped.
    """
    names = ["n_assign", "n_access", "n_hex"]

    def rows(batch):
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            spans = secret_spans(text)
            base = [s for s in spans if s.kind in BASE_KINDS]
            counts = [sum(s.kind == k for s in base) for k in BASE_KINDS]
            yield (doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base))

    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names), ("base_sha256", pa.string()),
                        ("spans", pa.string()), ("n_confirmed", pa.int64())])
    return doc_texts(docs).mapInArrow(arrow_rows(rows, schema), (
        "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """All rows and columns, with secrets in ``text`` masked and ``n_chars`` (where present) set anew on changed rows."""
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def mask(batches):
        give_back()
        for batch in batches:
            texts = batch.column(at).to_pylist()
            new = [None if t is None else masked(t, secret_spans(t)) for t in texts]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            if count is not None:
                old = columns[count].to_pylist()
                columns[count] = pa.array([o if a == b else len(b) for o, a, b in zip(old, texts, new, strict=True)],
                                          batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(mask, docs.schema)


def op2_secret_scans(spark, sf_dir: str) -> DataFrame:
    return find_secrets(documents(spark, sf_dir))
