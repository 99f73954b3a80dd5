"""Secret scan with structural confirmation of encoded candidates.

Three kinds are found by their pattern alone: assign, access and hex. Two more are reported
only when decoding confirms them:

jwt  three parts joined by dots, the first two base64url of JSON objects, the header with
     an algorithm (a signed token has a signature, the algorithm "none" may lack one)
key  base64 or hex of a private key: a DER sequence whose nested lengths fill it exactly and
     which starts with the version of a private key or is an encrypted one (algorithm with
     parameters, octets), or the OpenSSH container with all its nested lengths; a PEM block
     that says how it is encrypted needs whole cipher blocks instead

Candidates are wide: any dotted parts, base64 over several lines, with line ends as they are
or escaped (backslash and n), quoted or indented, and PEM blocks with header lines. Where
base64 ends is told by the lengths inside. Random base64 or hex is no finding beyond the
patterns.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revolva.llm.session import prepare

# Patterns and order of the base kinds.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "jwt", "key"]

_URL = r"[A-Za-z0-9_-]"
_DOTTED = re.compile(rf"(?<!{_URL}){_URL}++(?:\.{_URL}*+)+")
#: The shortest header with an algorithm.
_HEADER = len("eyJhbGciOiIifQ")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]++")
#: The first two signs of a DER sequence, or an OpenSSH container, not within a word; an escape is no word.
_START = re.compile(r"(?:(?<![A-Za-z0-9])|(?<=\\[a-z])|(?<=%[0-9A-Fa-f]{2})|(?<=\\u[0-9A-Fa-f]{4}))(?:M[A-I]|b3BlbnNzaC1rZXktdjEA)")
_ESCAPE = re.compile(r"u[0-9A-Fa-f]{4}|[a-z]")
#: Between two lines of base64: a line end, real or escaped, with quotes, signs that join strings, indents and marks of comments.
_EDGE = r"""[ \t"'`,]|\\(?=\s)|\+(?=[\s"'`])"""
_BREAK = re.compile(rf"""(?:{_EDGE})*+(?:\\+[nr]|[\r\n])(?:\\+[nrt]|[\s.>#*|]|//\s|{_EDGE})*+|\\+(?=/)""")
_LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")
_PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----")
_LINE_END = re.compile(r"\\+[nr]|[\r\n]")
_LINE_MARK = re.compile(r"[\s>#*|]*(?://\s)?")
_QUOTE = re.compile(r"""\\*["'`]""")
_BLANK = re.compile(r"[ \t\r\n]*")
_PADDING = re.compile("={0,2}")
_JSON = json.JSONDecoder()
_CIPHER = re.compile(r"DEK-Info:\s*[A-Za-z0-9-]+,\s*([0-9A-Fa-f]+)")

Span = tuple[str, int, int]


def decoded(text: str) -> bytes | None:
    """Bytes of base64 in either alphabet, padded or not."""
    plain = text.replace("-", "+").replace("_", "/").rstrip("=")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except binascii.Error:
        return None


def der_items(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the values that fill data[at:end] exactly; None if lengths do not fit."""
    items = []
    while at < end:
        if end - at < 2 or data[at] & 31 == 31:
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length == 128:
            return None
        if length > 128:
            size = length - 128
            if size > 4 or at + size > end or data[at] == 0:
                return None
            length, at = int.from_bytes(data[at : at + size]), at + size
            if length < 128:
                return None
        if at + length > end:
            return None
        items.append((tag, at, at + length))
        at += length
    return items


def _nested(data: bytes, items) -> bool:
    """Whether constructed values are filled exactly, to any depth."""
    open_ = list(items)
    while open_:
        tag, at, end = open_.pop()
        if tag & 32:
            inner = der_items(data, at, end)
            if inner is None:
                return False
            open_ += inner
    return True


def is_der_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8 (plain or encrypted) or SEC 1 private key by its structure."""
    outer = der_items(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    items = der_items(data, *outer[0][1:])
    if not items or len(items) < 2 or not _nested(data, items):
        return False
    tag, at, end = items[0]
    if len(items) == 2:  # a digest has the same form, but no parameters
        inner = der_items(data, at, end) if tag == 0x30 else None
        octets = items[1][2] - items[1][1]
        return bool(inner) and [t for t, _, _ in inner] == [6, 0x30] and items[1][0] == 4 and octets > 0
    if tag != 2 or end - at != 1 or data[at] > 1:
        return False
    second, third = items[1][0], items[2][0]
    rsa = len(items) >= 9 and all(t == 2 for t, _, _ in items[:9])
    wrapped = second == 0x30 and third == 4
    curve = second == 4 and third in (0xA0, 0xA1)
    dsa = len(items) == 6 and all(t == 2 for t, _, _ in items)
    return rsa or wrapped or curve or dsa


def openssh_size(read: Callable[[int, int], bytes]) -> int | None:
    """Size of an OpenSSH container by its nested lengths; ``read`` gives bytes from and to."""
    magic = b"openssh-key-v1\0"
    if read(0, len(magic)) != magic:
        return None
    at, fields, keys = len(magic), 0, None
    while keys is None or fields < 4 + keys:
        number = read(at, at + 4)
        if len(number) < 4:
            return None
        at += 4
        if keys is None and fields == 3:
            keys = int.from_bytes(number)
            if not 1 <= keys <= 64:
                return None
            continue
        at += int.from_bytes(number)
        fields += 1
    return at


def is_openssh_key(data: bytes) -> bool:
    """The OpenSSH container: names, options, public keys and private part by nested lengths."""
    return openssh_size(lambda a, b: data[a:b]) == len(data)


def is_key(data: bytes | None) -> bool:
    return bool(data) and (is_der_key(data) or is_openssh_key(data))


def is_signed_token(text: str) -> bool:
    head, body, signature = text.split(".")
    try:
        header, payload = (json.loads(decoded(part) or b"") for part in (head, body))
    except (ValueError, RecursionError):
        return False
    if not isinstance(header, dict) or not isinstance(payload, dict) or not isinstance(header.get("alg"), str):
        return False
    return header["alg"].lower() == "none" or bool(signature) and decoded(signature) is not None


def _is_object(part: str) -> bool:
    try:
        return isinstance(json.loads(decoded(part) or b""), dict)
    except (ValueError, RecursionError):
        return False


def _later_starts(part: str, escaped: bool) -> Iterator[int]:
    """Places within ``part`` after an escape, - or _ from which it is base64url of one JSON object."""
    shifts = [(decoded(part[k:]) or b"").decode("latin-1") for k in range(4)]
    first = _ESCAPE.match(part) if escaped else None
    for at in ([first.end()] if first else []) + [m.end() for m in re.finditer("[-_]", part)]:
        plain = shifts[at % 4]
        begin = _BLANK.match(plain, at // 4 * 3).end()
        if plain[begin : begin + 1] == "{":
            try:
                _, end = _JSON.raw_decode(plain, begin)
            except (ValueError, RecursionError):
                continue
            if _BLANK.match(plain, end).end() == len(plain):
                yield at


def token_spans(text: str) -> Iterator[Span]:
    """Signed tokens among any three parts that follow each other, joined by dots."""
    for run in _DOTTED.finditer(text):
        parts, at, free = run[0].split("."), run.start(), 0
        for i, (head, body, tail) in enumerate(zip(parts, parts[1:], parts[2:])):
            end = at + len(head) + len(body) + len(tail) + 2
            if len(head) >= _HEADER and body and at >= free and _is_object(body):
                before = text[at - 1 : at] if i == 0 else ""
                for start in chain([0], _later_starts(head, before == "\\"), [2] if before == "%" else []):
                    if is_signed_token(f"{head[start:]}.{body}.{tail}"):
                        yield "jwt", at + start, end
                        free = end
                        break
            at += len(head) + 1


def is_pem_key(body: str) -> bool:
    """Whether the lines between the marks of a PEM block, as they are or escaped, hold a private key."""
    lines, headers = [], []
    for line in _LINE_END.split(body):
        if ":" in line:
            headers.append(line)
            continue
        pieces = _QUOTE.split(line)
        if len(pieces) > 1:  # what joins strings stands between them
            pieces = [p for p in pieces if _BASE64.match(p.strip()) and p.strip().strip("+")]
        for piece in pieces:
            lines.append("".join(piece[_LINE_MARK.match(piece).end() :].replace("\\t", "").replace("\\", "").split()))
    data = decoded("".join(lines))
    cipher = _CIPHER.search("\n".join(headers))
    if data and cipher and "ENCRYPTED" in "".join(headers):
        return len(cipher[1]) in (16, 32) and len(data) % (len(cipher[1]) // 2) == 0
    return is_key(data)


def wrapped_keys(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of private keys in base64 on one line or on many, ended by their own lengths."""
    stop, plain, lines = 0, "", ([], [])
    for m in _START.finditer(text):
        if m.start() >= stop:  # all lines that follow each other, without what is between them
            at, size, parts, lines = m.start(), 0, [], ([], [])
            while line := _BASE64.match(text, at):
                lines[0].append(at)
                lines[1].append(size)
                parts.append(line[0])
                size, stop = size + len(line[0]), line.end()
                gap = _BREAK.match(text, stop)
                if not gap:
                    break
                at = gap.end()
            plain = "".join(parts)
        k = bisect_right(lines[0], m.start()) - 1
        first = lines[1][k] + m.start() - lines[0][k]

        def read(a: int, b: int) -> bytes:
            begin = first + a // 3 * 4
            return (decoded(plain[begin : begin + (b // 3 + 1) * 4 - a // 3 * 4]) or b"")[a % 3 : a % 3 + b - a]

        head = read(0, 6)
        if head[:1] == b"0" and len(head) == 6:
            more = head[1] - 128 if head[1] > 128 else 0
            total = 2 + more + (int.from_bytes(head[2 : 2 + more]) if more else head[1]) if more <= 4 else 0
        else:
            total = openssh_size(read) or 0
        last = first + total // 3 * 4 + (0, 2, 3)[total % 3]
        if total < 16 or last > len(plain):
            continue
        k = bisect_right(lines[1], last - 1) - 1
        end = lines[0][k] + last - lines[1][k]
        if not _BASE64.match(text, end) and is_key(decoded(plain[first:last])):
            yield m.start(), _PADDING.match(text, end).end()


def base_spans(text: str) -> list[Span]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def confirmed_spans(text: str) -> list[Span]:
    found = list(token_spans(text))
    blocks = []
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            following = text.find("-----BEGIN ", m.end())
            end = _PEM_END.search(text, m.end(), len(text) if following < 0 else following)
            if end and is_pem_key(text[m.end() : end.start()]):
                blocks.append((m.start(), end.end()))
    found += [("key", a, b) for a, b in blocks]
    keys = list(wrapped_keys(text))
    keys += [m.span() for m in _LONG_HEX.finditer(text) if is_key(bytes.fromhex(m[0]))]
    found += [("key", a, b) for a, b in keys if not any(c <= a < d for c, d in blocks)]
    return list(dict.fromkeys(found))


def ordered(spans: list[Span], kinds: list[str]) -> list[Span]:
    rank = {k: i for i, k in enumerate(kinds)}
    return sorted(spans, key=lambda s: (s[1], rank[s[0]], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(batches):
    for batch in batches:
        counts: dict[str, list[int]] = {k: [] for k in KINDS[:3]}
        digests, every = [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = ordered(base_spans(text), KINDS)
            for kind, values in counts.items():
                values.append(sum(k == kind for k, _, _ in base))
            digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
            every.append(joined(ordered(base + confirmed_spans(text), KINDS)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(v, pa.int64()) for v in counts.values()), pa.array(digests, pa.string()), pa.array(every, pa.string())],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def found_secrets(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans), spans (all).

    Spans are kind:start:end in code points, by start, then kind. Whole texts are scanned; a
    null or empty text has none. A null doc_id stays null, a repeated row is a row again, an
    empty table gives no rows. Other columns are ignored.
    """
    prepare(documents.sparkSession)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked(text: str, mask: str = "[SECRET]") -> str:
    """The text with every span replaced; spans that overlap or touch are one."""
    out, at, held = [], 0, None
    for _, a, b in sorted(base_spans(text) + confirmed_spans(text), key=lambda s: s[1:]):
        if held and a <= held[1]:
            held = held[0], max(held[1], b)
            continue
        if held:
            out += [text[at : held[0]], mask]
            at = held[1]
        held = a, b
    if held:
        out += [text[at : held[0]], mask]
        at = held[1]
    return "".join(out) + text[at:]


def _mask(batches, place: int, size: int):
    for batch in batches:
        texts, sizes = batch.column(place).to_pylist(), batch.column(size).to_pylist() if size >= 0 else None
        for i, text in enumerate(texts):
            if text and (new := masked(text)) != text:
                texts[i] = new
                if sizes:
                    sizes[i] = len(new)
        columns = list(batch.columns)
        columns[place] = pa.array(texts, batch.schema.field(place).type)
        if sizes:
            columns[size] = pa.array(sizes, batch.schema.field(size).type)
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def stage(documents: DataFrame) -> DataFrame:
    """``documents`` with secrets masked in the text, and n_chars of such texts counted anew."""
    prepare(documents.sparkSession)
    names = documents.columns
    size = names.index("n_chars") if "n_chars" in names else -1
    return documents.mapInArrow(partial(_mask, place=names.index("text"), size=size), documents.schema)
