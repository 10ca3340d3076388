"""Secret scan: base spans against a plain scan, decoded keys and tokens in place."""

import base64
import hashlib
import json
import random
import re
import struct

import pytest

from loomsift.llm.common import documents
from loomsift.llm.secrets import find_secrets, mask_secrets, masked, private_key, secret_spans
from loomsift.llm.suite import queries


def brute(text):
    text = text or ""
    spans = []
    for k, (kind, pattern, ok) in enumerate([
            ("assign", r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 12),
            ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 18), ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 16)]):
        spans += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if ok(m)]
    return sorted(spans)


def row(doc_id, text):
    spans = brute(text)
    digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()
    return (doc_id, *(sum(s[1] == k for s in spans) for k in range(3)), digest)


def base(df):
    return sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in df.collect()), key=repr)


def test_op2_whole_table(spark, sf):
    assert base(queries()["op2_secret_scans"](spark, sf)) == sorted((row(r.doc_id, r.text) for r in documents(spark, sf).collect()), key=repr)


def test_op2_odd(spark, odd_docs, no_docs, wide):
    assert base(find_secrets(wide(odd_docs))) == sorted((row(r.doc_id, r.text) for r in odd_docs.collect()), key=repr)
    assert find_secrets(no_docs).collect() == []


@pytest.mark.parametrize("seed", range(40))
def test_base_spans(seed):
    rng = random.Random(seed)
    bits = ["password", "ToKen", "api_key", "apikey", "seCRet", "paſſword", "AKIA", "AKIAABCDEFGHIJKLMN", "=", ":", " ", '"', "'", "deadbeef", "0123456789abcdef",
            "abc.def", "Z", "é", "\n", "=="]
    text = "".join(rng.choice(bits) for _ in range(40))
    want = [f"{k}:{a}:{b}" for a, _, k, b in brute(text)]
    assert [f"{s.kind}:{s.start}:{s.end}" for s in secret_spans(text) if s.kind in ("assign", "access", "hex")] == want


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x81, n]) if n < 256 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + size + body


def number(n, size):
    return der(2, b"\x01" + bytes((n * 7 + i) % 256 for i in range(size - 1)))


RSA = der(0x30, der(2, b"\0") + number(1, 128) + der(2, b"\1\0\1") + b"".join(number(i, 64) for i in range(6)))
EC = der(0x30, der(2, b"\1") + der(4, bytes(range(32))) + der(0xA0, der(6, b"\x2a\x86\x48\xce\x3d\x03\x01\x07")))
PKCS8 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2b\x65\x70")) + der(4, der(4, bytes(32))))
PUBLIC = der(0x30, der(0x30, der(6, b"\x2b\x65\x70")) + der(3, bytes(33)))


def field(b):
    return struct.pack(">I", len(b)) + b


SSH = b"openssh-key-v1\0" + field(b"none") + field(b"none") + field(b"") + struct.pack(">I", 1) + field(b"k" * 51) + field(b"p" * 136)


@pytest.mark.parametrize("data,kind", [(RSA, "rsa"), (EC, "ec"), (PKCS8, "pkcs8"), (SSH, "openssh"), (PUBLIC, None), (RSA[:-1], None), (RSA + b"x", None),
                                       (SSH[:-1], None), (b"", None), (b"0\x80", None), (der(0x30, b"\2\x05abc"), None)])
def test_private_key(data, kind):
    assert private_key(data) == kind


def url(b):
    return base64.urlsafe_b64encode(b).decode().rstrip("=")


def test_confirmed_spans():
    rsa = base64.b64encode(RSA).decode()
    lines = "\n".join(rsa[i:i + 64] for i in range(0, len(rsa), 64))
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{lines}\n-----END RSA PRIVATE KEY-----"
    fake = "-----BEGIN RSA PRIVATE KEY-----\nnot a key\n-----END RSA PRIVATE KEY-----"
    token = ".".join([url(json.dumps({"alg": "HS256"}).encode()), url(b'{"sub":1}'), "c2ln"])
    no_alg = ".".join([url(json.dumps({"typ": "HS256"}).encode()), url(b'{"sub":1}'), "c2ln"])
    found = {}
    text = "é "
    for name, part in {"pem": pem, "fake": fake, "token": token, "no_alg": no_alg, "key": base64.b64encode(PKCS8).decode(), "hex": EC.hex(),
                       "ssh": url(SSH), "cut": base64.b64encode(RSA).decode()[:-8]}.items():
        found[name] = (len(text), len(text) + len(part))
        text += part + " , "
    spans = {(s.kind, s.start, s.end) for s in secret_spans(text)} - {(s.kind, s.start, s.end) for s in secret_spans(text) if s.kind in ("assign", "access", "hex")}
    assert spans == {("pem", *found["pem"]), ("token", *found["token"]), ("key", *found["key"]), ("key", *found["hex"]), ("key", *found["ssh"])}
    hidden = masked(text, secret_spans(text))
    assert token not in hidden and pem not in hidden and no_alg in hidden and fake in hidden


KEY64, KEYSSH = base64.b64encode(PKCS8).decode(), base64.b64encode(SSH).decode()
TOKEN = ".".join([url(json.dumps({"alg": "HS256"}).encode()), url(b'{"sub":1}'), "c2ln"])
SEALED = ".".join([url(json.dumps({"alg": "dir", "enc": "A128GCM"}).encode()), "", "aXY", "Y2lwaGVy", "dGFn"])


@pytest.mark.parametrize("before,secret,after,kind", [
    ("The token is ", TOKEN, ".", "token"), ("", TOKEN, "... and so on", "token"), ("x ", TOKEN, ".example.org.", "token"), ("see.", TOKEN, ".", "token"),
    ("-", TOKEN, "\n", "token"), ("a\\n", TOKEN, "\\n", "token"), ("eyAAAAAAAAAA.", TOKEN, " ", "token"), ("It is ", SEALED, ".", "token"),
    ("RSA_KEY=", KEY64, "", "key"), ("RSA_KEY=", base64.b64encode(RSA).decode(), "\n", "key"), ("PRIVATE_KEY=", KEYSSH, ".", "key"), ("keys/", KEY64, "/a", "key"),
    ("+", KEY64, "-", "key"), ("a/MAAA/", KEY64, "", "key"), ("a\\n", KEY64, "\\n", "key"), ("b64_", KEYSSH, "", "key"),
    ("KEY=", EC.hex().upper(), "", "key"), ("KEY=0x", EC.hex()[:40].upper() + EC.hex()[40:], ".", "key"), ("", SSH.hex(), "", "key"), ("", SSH.hex().upper(), " ", "key")])
def test_candidates(before, secret, after, kind):
    text = f"é {before}{secret}{after}"
    at = 2 + len(before)
    spans = secret_spans(text)
    assert [s for s in spans if s.kind in ("pem", "key", "token")] == [(kind, at, at + len(secret), at)]
    assert secret not in masked(text, spans)


@pytest.mark.parametrize("text", ["KEY=" + KEY64[:-4], "KEY=" + KEY64 + "A", "KEY=" + base64.b64encode(PUBLIC).decode(), TOKEN.split(".")[0] + "." + TOKEN.split(".")[2] + ".",
                                  EC.hex().upper()[:-2], EC.hex().upper() + "A", SSH.hex()[:-2]])
def test_no_candidates(text):
    assert [s for s in secret_spans(text) if s.kind in ("pem", "key", "token")] == []


def test_mask(spark, wide):
    docs = spark.createDataFrame([(1, 'x password = "abcdefghijkl" y', 30), (2, "clean", 99), (3, None, None)], "doc_id long, text string, n_chars long")
    rows = {r.doc_id: r for r in mask_secrets(wide(docs)).collect()}
    assert rows[1].text == 'x password = "[secret]" y' and rows[1].n_chars == len(rows[1].text)
    assert rows[2].text == "clean" and rows[2].n_chars == 99 and rows[3].text is None and rows[3].n_chars is None
    assert masked("aabbcc", []) == "aabbcc"


def test_long_runs_are_linear():
    text = "M" + "A" * 400_000 + " " + "password" * 50_000 + " " + "-----BEGIN PRIVATE KEY-----" * 3000 + "ey" * 200_000
    assert secret_spans(text) == []
