"""Secrets: keywords by Aho-Corasick, then anchored patterns, then checksums.

One automaton reads the whole text once.  Patterns are tried only where a
keyword begins, so a text without keywords costs one pass.  Runs of hex digits
have no keyword of their own: all hex digits are folded to one letter, and the
keyword is that letter sixteen times.

Kinds ``assign``, ``access`` and ``hex`` are shapes.  The others carry a check
that must hold: tokens that end in the CRC-32 of their body in base 62, and
private key blocks whose decoded length is the one their own header declares: one
DER sequence, an OPENSSH key with its inner lengths and check integers, or, where
header lines say so, whole blocks of a cipher.

A null or empty text has no spans.  Offsets count code points, the end is
exclusive.  Equal rows give equal results; the length of a text has no limit.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import zlib
from collections.abc import Callable

import ahocorasick
from pyspark.sql import DataFrame

from songsift.llm.batches import per_text

# Fixed values of the base kinds.
MIN_VALUE, MIN_ACCESS, MIN_HEX = 12, 18, 16
ASSIGN = re.compile(
    rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE,
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
# Tokens of 30 letters and digits and a checksum of six.
CHECKED = re.compile(rb"(?:ghp|gho|ghu|ghs|ghr|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
# Header lines, of which a long one may go on in indented lines, end with an empty line.
PEM = re.compile(
    rb"-----BEGIN ([A-Z ]*PRIVATE KEY)-----"
    rb"(?:[\x20\t]*\r?\n(?P<head>(?:[A-Za-z0-9-]+:[^\r\n]*\r?\n(?:[\x20\t]+[^\x20\t\r\n][^\r\n]*\r?\n)*)+)[\x20\t]*\r?\n)?"
    rb"(?P<body>[A-Za-z0-9+/=\s]+)-----END \1-----"
)
# The start value of an encrypted block, as long as a block of its cipher.
DEK_INFO = re.compile(rb"^DEK-Info:[^,\r\n]+,\s*((?:[0-9A-Fa-f]{16}){1,2})\s*$", re.MULTILINE)
OPENSSH = b"openssh-key-v1\0"
KEYWORDS = {
    "assign": ["password", "passwd", "secret", "token", "apikey", "api_key"],
    "access": ["akia"],
    "checked": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"],
    "pem": ["-----begin "],
}
KINDS = ["assign", "access", "hex", "checked", "pem"]
BASE = KINDS[:3]

_HEX = bytes(104 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_RUN = b"h" * MIN_HEX
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum(body: bytes) -> bytes:
    """The CRC-32 of a token's body, as six digits in base 62."""
    value, digits = zlib.crc32(body), ""
    while value:
        value, digit = divmod(value, 62)
        digits = _DIGITS[digit] + digits
    return digits.rjust(6, "0").encode()


def whole_openssh(data: bytes) -> bool:
    """Whether the declared lengths fill an OPENSSH key, and the check integers of one in the clear are equal."""
    at = len(OPENSSH)

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at : at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size : at]

    cipher, kdf, options = field(), field(), field()
    number = int.from_bytes(data[at : at + 4], "big")
    at += 4
    if not cipher or not kdf or options is None or not number:
        return False
    for _ in range(number):
        if not field():
            return False
    private = field()
    if not private or len(private) < 8:
        return False
    # Some ciphers put a tag behind the private part.
    if cipher != b"none":
        return len(data) - at in (0, 16)
    return at == len(data) and private[:4] == private[4:8]


def whole_key(body: bytes, head: bytes | None = None) -> bool:
    """Whether a key block decodes to one DER sequence of the length it declares, or to a whole OPENSSH key.

    One whose header lines say that it is encrypted must consist of whole cipher blocks.
    """
    try:
        der = base64.b64decode(b"".join(body.split()), validate=True)
    except binascii.Error:
        return False
    if der.startswith(OPENSSH):
        return whole_openssh(der)
    start = DEK_INFO.search(head or b"")
    if start:
        return len(der) > 0 and len(der) % (len(start[1]) // 2) == 0
    if len(der) < 2 or der[0] != 0x30:
        return False
    size, start = der[1], 2
    if size & 0x80:
        start += size & 0x7F
        size = int.from_bytes(der[2:start], "big")
    return start + size == len(der)


def _accept(kind: str, match: re.Match) -> bool:
    if kind == "assign":
        return len(match[2]) >= MIN_VALUE
    if kind == "access":
        return len(match[0]) >= MIN_ACCESS
    if kind == "checked":
        return checksum(match[1]) == match[2]
    return whole_key(match["body"], match["head"])


_PATTERNS = {"assign": ASSIGN, "access": ACCESS, "checked": CHECKED, "pem": PEM}


def keyword_automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            automaton.add_word(word, (kind, len(word)))
    automaton.make_automaton()
    return automaton


def find_spans(text: bytes, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) in bytes, by start and then in the order of the kinds."""
    spans = []
    taken = dict.fromkeys(KINDS, 0)
    # ASCII letters only are folded, and a byte stays a character: offsets hold.
    hits = [(end + 1 - size, kind) for end, (kind, size) in automaton.iter(text.lower().decode("latin-1"))]
    for start, kind in sorted(hits):
        if start < taken[kind]:
            continue
        match = _PATTERNS[kind].match(text, start)
        if match:
            taken[kind] = match.end()
            if _accept(kind, match):
                spans.append((start, match.end(), kind))
    folded = text.translate(_HEX)
    start = folded.find(_RUN)
    while start >= 0:
        end = folded.find(b" ", start)
        end = len(text) if end < 0 else end
        spans.append((start, end, "hex"))
        start = folded.find(_RUN, end)
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def in_code_points(text: bytes, spans: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    if text.isascii():
        return spans
    at, points, place = 0, 0, {}
    for offset in sorted({x for s in spans for x in s[:2]}):
        points += len(text[at:offset].decode("utf-8", "replace"))
        at = offset
        place[offset] = points
    return [(place[a], place[b], kind) for a, b, kind in spans]


def as_text(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def _scanner() -> Callable[[list[bytes]], list]:
    automaton = keyword_automaton()

    def scan(texts: list[bytes]) -> list:
        rows = []
        for text in texts:
            spans = in_code_points(text, find_spans(text, automaton))
            base = [s for s in spans if s[2] in BASE]
            counts = [sum(s[2] == kind for s in base) for kind in BASE]
            rows.append((*counts, hashlib.sha256(as_text(base).encode()).hexdigest(), as_text(spans)))
        return [list(c) for c in zip(*rows)]

    return scan


def scan_secrets(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Counts of the base kinds, a digest of their spans, and all spans as text."""
    fields = "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return per_text(df, _scanner, fields, keep, text)


def _redactor(mark: str) -> Callable[[], Callable[[list[bytes]], list]]:
    def work():
        automaton = keyword_automaton()

        def redact(texts: list[bytes]) -> list:
            out, count = [], []
            for text in texts:
                parts, at, n = [], 0, 0
                for start, end, kind in find_spans(text, automaton):
                    if end <= at:
                        continue
                    if start >= at:
                        parts += [text[at:start], f"{mark}{kind}]".encode()]
                        n += 1
                    at = end
                out.append(b"".join([*parts, text[at:]]).decode("utf-8", "replace"))
                count.append(n)
            return [out, count]

        return redact

    return work


def redact_secrets(df: DataFrame, keep: list[str], text: str = "text", mark: str = "[") -> DataFrame:
    """``redacted``: the text with each secret replaced by its kind in brackets, and ``n_redacted``.

    Overlapping spans become one mark.  Everything else stays as it was.
    """
    return per_text(df, _redactor(mark), "redacted string, n_redacted bigint", keep, text)
