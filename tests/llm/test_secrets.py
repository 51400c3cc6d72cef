"""Secret spans against the patterns as stated, and structures made by hand."""

from __future__ import annotations

import base64
import hashlib
import json
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from odd_texts import ODD_TEXTS

from sievework.llm import queries, secret_scan

SF = "/root/testdata/sf0.01"


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    length = bytes([n]) if n < 128 else (s := n.to_bytes((n.bit_length() + 7) // 8, "big")) and bytes([0x80 | len(s)]) + s
    return bytes([tag]) + length + body


INTEGER = der(0x02, b"\x01" * 40)
PKCS1 = der(0x30, der(0x02, b"\0"), *[INTEGER] * 8)
SEC1 = der(0x30, der(0x02, b"\1"), der(0x04, b"k" * 32))
ALGORITHM = der(0x30, der(0x06, b"\x2a\x86\x48\x86"), b"\x05\x00")
PKCS8 = der(0x30, der(0x02, b"\0"), ALGORITHM, der(0x04, SEC1))
ENCRYPTED = der(0x30, ALGORITHM, der(0x04, b"e" * 64))


def part(b):
    return len(b).to_bytes(4, "big") + b


OPENSSH = b"openssh-key-v1\0" + part(b"none") * 2 + part(b"") + (1).to_bytes(4, "big") + part(b"p" * 51) + part(b"s" * 160)


def url64(x):
    return base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()


JWT = f"{url64({'alg': 'HS256', 'typ': 'JWT'})}.{url64({'sub': '1'})}.c2lnbmF0dXJlMTIz"


def base_spans(text):
    found = [
        (m.start(), k, m.end())
        for k, (p, flags, keep) in enumerate(
            [
                (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 8),
                (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 16),
                (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 32),
            ]
        )
        for m in re.finditer(p, text, flags)
        if keep(m)
    ]
    return [f"{secret_scan.BASE_KINDS[k]}:{a}:{b}" for a, k, b in sorted(found)]


def listed(text, kinds=None):
    return [f"{k}:{a}:{b}" for a, b, k in secret_scan.spans(text) if kinds is None or k in kinds]


PIECES = st.sampled_from(["token", "PassWord", "api_key", "=", ": ", '"', "abcd1234", "0123456789abcdef" * 2, "AKIA", "AKIAABCD", "EFGH1234", " ", "é", ".", "ſecret", "K"])


@given(st.lists(PIECES, max_size=20).map("".join))
def test_base_spans_like_the_patterns(text):
    assert listed(text, secret_scan.BASE_KINDS) == base_spans(text)


@pytest.mark.parametrize("blob", [PKCS1, SEC1, PKCS8, ENCRYPTED])
def test_key_encodings(blob):
    assert secret_scan.is_private_key(blob)
    assert not secret_scan.is_private_key(blob + b"\0")
    assert not secret_scan.is_private_key(blob[:-1])
    text = f"é key {base64.b64encode(blob).decode()} end"
    assert [s for s in listed(text) if s.startswith("key")] == [f"key:6:{len(text) - 4}"]
    low = f"x {blob.hex()} y"
    assert f"hexkey:2:{2 + 2 * len(blob)}" in listed(low)


def test_openssh_pem_and_token():
    assert secret_scan.is_openssh_key(OPENSSH) and not secret_scan.is_openssh_key(OPENSSH[:-1])
    text = "see " + base64.b64encode(OPENSSH).decode()
    assert listed(text) == [f"openssh:4:{len(text)}"]
    body = base64.encodebytes(PKCS8).decode()
    pem = f"-----BEGIN PRIVATE KEY-----\n{body}-----END PRIVATE KEY-----"
    assert f"pem:2:{2 + len(pem)}" in listed("a " + pem + " b")
    assert "pem" not in str(listed(pem.replace(body, base64.encodebytes(b"x" * 60).decode())))
    assert f"jwt:7:{7 + len(JWT)}" in listed("bearer " + JWT + ", ok")
    assert "jwt" not in str(listed("bearer " + JWT.replace("eyJ", "eyK") + " and long.enough.words" * 3))


def pem(body, name="RSA PRIVATE KEY"):
    return f"-----BEGIN {name}-----\n{body}-----END {name}-----"


def test_pem_keys_in_strings_and_with_headers():
    plain = pem(base64.encodebytes(PKCS8).decode(), "PRIVATE KEY")
    for broken in ("\\n", "\\r\\n", "\\\\n", "\\\n", '\\n" +\n  "', "\r\n"):
        text = plain.replace("\n", broken)
        assert f"pem:17:{17 + len(text)}" in listed('{"private_key": "' + text + '\\n"}'), broken
    assert "PRIVATE" not in secret_scan.redact('{"private_key": ' + json.dumps(plain).replace("/", "\\/") + "}")
    headers = "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0123456789ABCDEF0123456789ABCDEF\n\n"
    whole = pem(headers + base64.encodebytes(bytes(range(160))).decode())
    for text in (whole, whole.replace("\n", "\\n")):
        assert f"pem:2:{2 + len(text)}" in listed("a " + text + " b")
    old = whole.replace("AES-128-CBC,0123456789ABCDEF", "DES-EDE3-CBC,")
    assert "pem" in str(listed(old))
    for wrong in (pem(headers + base64.encodebytes(bytes(range(155))).decode()), whole.replace("DEK-Info", "Other"), whole.replace("ABCDEF\n", "ABCDE\n"), pem(headers)):
        assert "pem" not in str(listed(wrong))
    assert listed("-----BEGIN PRIVATE KEY-----" * 20_000) == []


def test_lookalikes_stay():
    noise = base64.b64encode(hashlib.sha512(b"x").digest()).decode()
    assert listed(f"hash {noise} of a file") == []
    assert listed("a" * 100_000 + "Z" * 100_000) == [f"hex:0:100000"]


def test_redaction():
    assert secret_scan.redact("a password=abcdefgh1 b") == "a [secret] b"
    assert secret_scan.redact(f"token = {'ab' * 20} z") == "[secret] z"
    assert secret_scan.redact("nothing here") == "nothing here"


def test_odd_rows(odd_docs, no_docs):
    found = secret_scan.find_secrets(odd_docs).collect()
    want = sorted(str((i, [(s[2], s[0], s[1]) for s in secret_scan.spans(t or "")])) for i, t in ODD_TEXTS)
    assert sorted(str((r.doc_id, [tuple(s) for s in r.spans])) for r in found) == want
    assert secret_scan.find_secrets(no_docs).count() == 0
    kept = secret_scan.redact_column(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(ODD_TEXTS)


def test_query_over_the_whole_table(spark):
    docs = {r.doc_id: r.text for r in queries.table(spark, SF, "documents").collect()}
    found = queries.op6_secrets(spark, SF).collect()
    assert len(found) == len(docs)
    for r in found:
        base = base_spans(docs[r.doc_id])
        kinds = [s.split(":")[0] for s in base]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(map(kinds.count, secret_scan.BASE_KINDS))
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert r.spans == ",".join(listed(docs[r.doc_id]))
    assert sum(r.n_hex + r.n_access + r.n_assign for r in found) > 5
