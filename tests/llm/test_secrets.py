"""Secret scan: patterns as given, structures built by hand, random candidates refused."""

import base64
import hashlib
import json
import random
import re

import pytest
from helpers import clashing, documents, odd_rows

from revolva.llm import queries, secrets

# The patterns in their plain form.
PLAIN = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def plain(text):
    found = [(m.start(), k, kind, m.end()) for k, (kind, (p, ok)) in enumerate(PLAIN.items()) for m in p.finditer(text or "") if ok(m)]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


def der(tag, *parts):
    body = b"".join(parts)
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([128 + (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8)
    return bytes([tag]) + size + body


def integer(n):
    return der(2, n.to_bytes(n.bit_length() // 8 + 1))


random.seed(6)
RSA = der(0x30, integer(0), *(integer(random.getrandbits(b)) for b in (512, 17, 510, 256, 256, 250, 250, 250)))
PKCS8 = der(0x30, integer(0), der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01"), der(5)), der(4, RSA))
EC = der(0x30, integer(1), der(4, random.randbytes(32)), der(0xA0, der(6, b"\x2a\x86\x48\xce\x3d\x03\x01\x07")))
FIELD = lambda b: len(b).to_bytes(4) + b
SSH = b"openssh-key-v1\0" + FIELD(b"none") + FIELD(b"none") + FIELD(b"") + (1).to_bytes(4) + FIELD(b"public") + FIELD(b"private" * 8)


def url(data):
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


JWT = ".".join([url(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()), url(b'{"sub":"1"}'), url(random.randbytes(32))])


@pytest.mark.parametrize("data", [RSA, PKCS8, EC, SSH])
def test_keys_are_confirmed_in_every_encoding(data):
    one = base64.b64encode(data).decode()
    lines = "\n".join(one[i : i + 64] for i in range(0, len(one), 64))
    pem = f"-----BEGIN PRIVATE KEY-----\n{lines}\n-----END PRIVATE KEY-----"
    for text in (one, url(data), data.hex(), data.hex().upper(), pem):
        assert ("key", 3, 3 + len(text)) in secrets.confirmed_spans(f"é, {text} .")
    for damaged in (data[:-1], data + b"\0", data[:5] + b"\xff" + data[6:]):
        if damaged != data:
            assert not secrets.is_key(damaged)


def test_random_candidates_are_refused():
    random.seed(7)
    for _ in range(300):
        raw = random.randbytes(random.randint(32, 90))
        for text in (base64.b64encode(raw).decode(), raw.hex(), url(raw) + "." + url(raw) + "." + url(raw)):
            assert secrets.confirmed_spans(text) == []


def test_signed_tokens():
    assert secrets.confirmed_spans("a " + JWT) == [("jwt", 2, 2 + len(JWT))]
    head, body, tail = JWT.split(".")
    for bad in (f"{head}.{body}.", f"{head}.{head[:9]}.{tail}", f"eyJhbGciOjF9.{body}.{tail}", f"eyJ{body}.{body}.{tail}"):
        assert secrets.confirmed_spans(bad) == []
    unsigned = url(b'{"alg":"none"}') + "." + body + "."
    assert secrets.confirmed_spans(unsigned) == [("jwt", 0, len(unsigned))]


def test_base_spans_are_those_of_the_plain_patterns(spark, medium_dir):
    random.seed(9)
    parts = ["password", "Token", "SECRET", "api_key", "apikey", "tokeſn", "=", ":", " ", "'", '"', "abc123", "AKIA", "AKIA" + "Z9" * 9, "0f" * 12, "ab", "é", "-", "x" * 7]
    for _ in range(4000):
        text = "".join(random.choices(parts, k=random.randint(1, 12)))
        assert secrets.ordered(secrets.base_spans(text), secrets.KINDS) == plain(text), text
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{medium_dir}/documents.parquet").collect()}
    rows = queries.op10_secret_scan(spark, medium_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        spans = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in base) for kind in PLAIN)
        assert set(spans.split(",")) <= set(r.spans.split(","))


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "eyJ" * 60_000, "-----BEGIN PRIVATE KEY-----" * 5_000, "0a" * 100_000 + "g", "token=" * 40_000):
        secrets.masked(text)


def test_odd_rows_and_masking(spark):
    df = clashing(documents(spark, odd_rows() + [(50, f"a {JWT} b password=hunter22 c"), (51, "password: hunter22token=abcdefg")]))
    found = secrets.found_secrets(df)
    assert found.count() == df.count() and secrets.found_secrets(df.where("false")).count() == 0
    clean = {r.doc_id: r for r in secrets.stage(df).collect()}
    assert secrets.stage(df).columns == df.columns
    assert clean[50].text == "a [SECRET] b [SECRET] c" and clean[50].n_chars == len(clean[50].text)
    assert clean[1].text is None and clean[2].text == "" and clean[6].text == "é"
    assert "hunter22" not in clean[51].text


ENCRYPTED = der(
    0x30,
    der(0x30, der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x05\x0d"), der(0x30, der(0x30, der(6, b"\x2a\x03"), der(4, b"saltsalt")))),
    der(4, bytes(range(160))),
)


def lines(data, end="\n", width=64):
    one = base64.b64encode(data).decode()
    return end.join(one[i : i + width] for i in range(0, len(one), width))


def whole(kind, text, before="é: ", after=" ."):
    assert secrets.confirmed_spans(before + text + after) == [(kind, len(before), len(before) + len(text))], text
    assert secrets.masked(text) == "[SECRET]"


@pytest.mark.parametrize("data", [RSA, PKCS8, EC, SSH, ENCRYPTED])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\n    ", "\\n", "\\r\\n", "\\\\n", '\\n" +\n  "', '",\n "', "\n# "])
def test_keys_over_lines_and_escaped(data, end):
    mark = "-----{} PRIVATE KEY-----"
    whole("key", mark.format("BEGIN") + end + lines(data, end) + end + mark.format("END"))
    whole("key", lines(data, end), after=end + "-----")
    whole("key", lines(data, end, 76), before='{"k": "\\n', after='"}')
    whole("key", lines(data, end, 20), before="key_", after=end + "and a word")


def test_keys_with_headers():
    mark = "-----{} RSA PRIVATE KEY-----"
    for end in ("\n", "\\n"):
        block = lambda head, data: end.join([mark.format("BEGIN"), *head, "", lines(data, end), mark.format("END")])
        whole("key", block(["Comment: mine"], RSA))
        sealed = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC," + "0F" * 16]
        random.seed(4)
        whole("key", block(sealed, random.randbytes(320)))
        assert secrets.confirmed_spans(block(sealed, random.randbytes(321))) == []
        assert secrets.confirmed_spans(block(["Comment: mine"], random.randbytes(320))) == []


def test_encrypted_keys_but_no_digests():
    assert secrets.is_key(ENCRYPTED) and not secrets.is_key(ENCRYPTED[:-1])
    assert not secrets.is_key(der(0x30, der(0x30, der(6, b"\x60\x86\x48\x01\x65\x03\x04\x02\x01"), der(5)), der(4, bytes(32))))


def test_tokens_of_any_header_after_any_sign():
    _, body, tail = JWT.split(".")
    for header in (b'{"alg":"HS256"}', b' {"alg":"HS256"}', b'{ "alg":"HS256"}', b'{\n"alg":"HS256"}', b'\r\n{"alg":"HS256"}', b'\t{"alg":"HS256"}'):
        for before in ("", "a.", "..", "-", "_", "v1.x.", "key-", "a_b-", "\\n", "\\u0022", "%20", "é "):
            whole("jwt", f"{url(header)}.{body}.{tail}", before)


def test_wide_candidates_take_linear_time():
    random.seed(5)
    head = "MIL/" + url(random.randbytes(30))
    good = JWT.split(".")
    for text in ("MIL/\n" * 40_000, (head + "\n") * 5_000, "-eyJ" * 50_000 + "." + ".".join(good[1:]), (good[0] + ".") * 4_000, "b3BlbnNzaC1rZXktdjEA\\n" * 8_000, "\\" * 200_000, "a\n" * 100_000, '"' * 200_000, "+ " * 100_000):
        secrets.masked(text)
