"""Secrets by fixed base patterns, and by structure: what looks like an encoded key or a signed token is decoded and parsed.

Candidates are stretches of base64 (also url-safe, also wrapped over lines) and of hexadecimal digits whose first bytes can open a
key, and three dotted parts whose first can be a JSON object. A candidate is only reported if its structure holds:

- ``key``: DER. Every nested length fits its parent exactly; the members are those of a private key (PKCS#1, PKCS#8, SEC 1, DSA or
  an encrypted PKCS#8), the inner key of a PKCS#8 is parsed again, and an RSA key's modulus is the product of its primes.
- ``sshkey``: the OpenSSH container. Its magic, its length-prefixed fields, the equal check numbers of an unencrypted key.
- ``token``: a signed token. Header and payload are JSON objects, the header names a signing algorithm and the signature has its size.

The length that a structure declares says how much text it takes, so line wraps and text that follows need no guess.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.arrow import map_rows

Span = tuple[int, int, str]
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "key", "sshkey", "token")

# -- base patterns -------------------------------------------------------------------------------------------------------------
# letters of the names in either case, ASCII only (fixed patterns)
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) by start and then kind as listed; leftmost without overlaps in each kind, short ones dropped.

    ``access`` and ``hex`` match whole runs of their characters, so asking for the least length at once drops the same ones.
    """
    out: list[Span] = []
    low = text.lower()
    if any(name in low for name in NAMES):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# -- nested lengths ------------------------------------------------------------------------------------------------------------
SEQUENCE, INTEGER, OCTETS, OID = 0x30, 0x02, 0x04, 0x06
Node = tuple[int, bytes]


def der_header(data: bytes, at: int = 0) -> tuple[int, int, int] | None:
    """Tag, place of the content and its length, in the shortest form of the length; None if that can't be read."""
    if at + 2 > len(data):
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if tag & 0x1F == 0x1F or size == 0x80:
        return None
    if size > 0x80:
        n = size - 0x80
        if n > 4 or at + n > len(data) or not data[at]:
            return None
        size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if size < 0x80:
            return None
    return tag, at, size


def der_members(data: bytes) -> list[Node] | None:
    """The members of a constructed value; None unless their lengths add up to it exactly."""
    out, at = [], 0
    while at < len(data):
        head = der_header(data, at)
        if head is None or head[1] + head[2] > len(data):
            return None
        tag, start, size = head
        out.append((tag, data[start : start + size]))
        at = start + size
    return out


def _nested(node: Node) -> bool:
    """All constructed members, at every depth, have lengths that add up."""
    todo = [node]
    while todo:
        tag, data = todo.pop()
        if tag & 0x20:
            members = der_members(data)
            if members is None:
                return False
            todo += members
    return True


def _number(node: Node) -> int | None:
    return int.from_bytes(node[1], "big", signed=True) if node[0] == INTEGER and node[1] else None


# object identifiers in DER (fixed values)
RSA = bytes.fromhex("2a864886f70d010101")
DSA = bytes.fromhex("2a8648ce380401")
EC = bytes.fromhex("2a8648ce3d0201")
RAW_KEYS = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _rsa(members: list[Node]) -> bool:
    numbers = [_number(m) for m in members[:9]]
    if len(numbers) < 9 or any(x is None or x < 0 for x in numbers) or numbers[0] not in (0, 1):
        return False
    _, n, e, d, p, q, dp, dq, _ = numbers
    if min(p, q) < 3 or e < 2 or (n != p * q if numbers[0] == 0 else n % (p * q)):
        return False
    return dp == d % (p - 1) and dq == d % (q - 1) and e * dp % (p - 1) == 1 and e * dq % (q - 1) == 1


def _dsa(members: list[Node]) -> bool:
    numbers = [_number(m) for m in members]
    if len(numbers) != 6 or any(x is None or x < 0 for x in numbers) or numbers[0]:
        return False
    _, p, q, g, y, x = numbers
    return p > 2 and q > 1 and (p - 1) % q == 0 and 0 < x < q and pow(g, x, p) == y


def _ec(members: list[Node]) -> bool:
    if len(members) < 2 or _number(members[0]) != 1 or members[1][0] != OCTETS or not 16 <= len(members[1][1]) <= 72:
        return False
    return all(tag in (0xA0, 0xA1) for tag, _ in members[2:])


def _sequence(data: bytes) -> list[Node] | None:
    """The members if ``data`` is one whole SEQUENCE."""
    head = der_header(data)
    return der_members(data[head[1] :]) if head and head[0] == SEQUENCE and head[1] + head[2] == len(data) else None


def _pkcs8(members: list[Node]) -> bool:
    if len(members) < 3 or _number(members[0]) not in (0, 1) or members[1][0] != SEQUENCE or members[2][0] != OCTETS:
        return False
    algorithm, inner = der_members(members[1][1]), members[2][1]
    if not algorithm or algorithm[0][0] != OID:
        return False
    name = algorithm[0][1]
    if name in RAW_KEYS:
        return inner == bytes([OCTETS, RAW_KEYS[name]]) + inner[2:] and len(inner) == RAW_KEYS[name] + 2
    if name == RSA or name == EC:
        parts = _sequence(inner)
        return parts is not None and (_rsa if name == RSA else _ec)(parts)
    if name == DSA:
        head = der_header(inner)
        return head is not None and head[0] == INTEGER and head[1] + head[2] == len(inner)
    return False


def _encrypted(members: list[Node]) -> bool:
    if len(members) != 2 or members[0][0] != SEQUENCE or members[1][0] != OCTETS or not members[1][1]:
        return False
    algorithm = der_members(members[0][1])
    return bool(algorithm) and algorithm[0][0] == OID and algorithm[0][1].startswith(PASSWORD_BASED)


def private_der(data: bytes) -> bool:
    """``data`` is one whole private key in DER."""
    members = _sequence(data)
    if not members or not all(map(_nested, members)):
        return False
    return _pkcs8(members) or _rsa(members) or _ec(members) or _dsa(members) or _encrypted(members)


MAGIC = b"openssh-key-v1\0"


class _Fields:
    """Length-prefixed fields read one after the other; ``ValueError`` where one doesn't fit."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def number(self) -> int:
        if self.at + 4 > len(self.data):
            raise ValueError
        self.at += 4
        return int.from_bytes(self.data[self.at - 4 : self.at], "big")

    def field(self) -> bytes:
        n = self.number()
        if self.at + n > len(self.data):
            raise ValueError
        self.at += n
        return self.data[self.at - n : self.at]


def ssh_size(data: bytes) -> int | None:
    """The bytes that an OpenSSH private key at the start of ``data`` takes; None if there is none."""
    if not data.startswith(MAGIC):
        return None
    try:
        x = _Fields(data, len(MAGIC))
        cipher, kdf, _, keys = x.field(), x.field(), x.field(), x.number()
        if not cipher or not kdf or not 1 <= keys <= 16:
            return None
        for _ in range(keys):
            if not _Fields(x.field()).field():  # a public key opens with its type's name
                return None
        secret = x.field()
        if not secret or len(secret) % 8:
            return None
        if cipher == b"none":
            y = _Fields(secret)
            if y.number() != y.number() or not y.field():
                return None
        return x.at
    except ValueError:
        return None


# -- candidates ----------------------------------------------------------------------------------------------------------------
#: No private key is longer than this many bytes (an RSA key of 16,384 bits takes about 9,300).
LONGEST = 1 << 16
BASE64 = r"A-Za-z0-9+/_-"
# an escaped line end counts as a line end, as keys in JSON and in environment files have them
WRAP = r"(?:\s|\\r|\\n)"
OPENING = re.compile(rf"(?:(?<![{BASE64}])|(?<=\\n)|(?<=\\r)|(?<=-----))(?:M[A-P]|b3BlbnNzaC1rZXktdjE|LS0tLS1CRUdJTi)[{BASE64}]")
PIECE = re.compile(rf"[{BASE64}]+")
GAP = re.compile(rf"{WRAP}+")
PAD = re.compile("={0,2}")
ARMOUR = "LS0tLS1CRUdJTi"  # "-----BEGIN " in base64 (fixed value)
HEX_OPENING = re.compile(r"(?<![0-9A-Fa-f])(?:30|6[fF]70656[eE]7373682[dD]6[bB]65792[dD]763100)[0-9A-Fa-f]{60,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])(e[w-z][A-Za-z0-9_-]*+)\.([A-Za-z0-9_-]++)\.([A-Za-z0-9_-]++)(?!=|\.[A-Za-z0-9_-])")


def _gathered(text: str, at: int, need: int) -> tuple[str, list[tuple[int, int]]]:
    """Up to ``need`` base64 characters from ``at``, over line wraps, and where each piece of them starts and how long it is."""
    out, where, size = [], [], 0
    while size < need:
        m = PIECE.match(text, at, at + need - size)
        if not m:
            break
        out.append(m.group())
        where.append((m.start(), len(m.group())))
        size += len(m.group())
        gap = GAP.match(text, m.end())
        if not gap:
            break
        at = gap.end()
    return "".join(out), where


def _plain64(chars: str) -> bytes:
    chars = chars.replace("-", "+").replace("_", "/")
    return base64.b64decode(chars + "=" * (-len(chars) % 4)) if len(chars) % 4 != 1 else b""


def _declared(data: bytes, whole: int) -> int | None:
    """How many bytes a key that opens with ``data`` takes; ``whole`` are those that there can be."""
    if data.startswith(MAGIC):
        return min(whole, LONGEST)
    head = der_header(data)
    if head is None or head[0] != SEQUENCE or not 16 <= head[2] or head[1] + head[2] > LONGEST:
        return None
    inner = der_header(data, head[1])
    return head[1] + head[2] if inner and inner[0] in (INTEGER, SEQUENCE) else None


def _kind(data: bytes) -> tuple[str, int] | None:
    size = ssh_size(data)
    if size is not None:
        return "sshkey", size
    # a short piece of a key has no whole structure
    return ("key", len(data)) if private_der(data) else None


def _armoured(text: str, at: int) -> tuple[str, int] | None:
    """Kind and end of an armoured key that was encoded a second time, in one piece."""
    run = PIECE.match(text, at, at + 2 * LONGEST)
    inner = next(base64_keys(_plain64(run.group()).decode("latin-1")), None)
    return inner and (inner[2], run.end())


def _bare(text: str, at: int) -> tuple[str, int] | None:
    """Kind and end, before the padding, of a key that starts at ``at``."""
    head, _ = _gathered(text, at, 32)
    size = _declared(_plain64(head[: len(head) // 4 * 4]), LONGEST)
    if size is None:
        return None
    chars, where = _gathered(text, at, -(-4 * size // 3))
    found = _kind(_plain64(chars[: len(chars) - (len(chars) % 4 == 1)])[:size])
    if found is None:
        return None
    left = -(-4 * found[1] // 3)
    for start, n in where:
        if left <= n:
            return found[0], start + left
        left -= n
    return None


def base64_keys(text: str) -> Iterator[Span]:
    done = 0
    for m in OPENING.finditer(text):
        if m.start() < done:
            continue
        found = (_armoured if text.startswith(ARMOUR, m.start()) else _bare)(text, m.start())
        if found is None:
            continue
        end = PAD.match(text, found[1]).end()
        if end == found[1] and PIECE.match(text, end):  # the run goes on beyond the structure
            continue
        yield m.start(), end, found[0]
        done = end


def hex_keys(text: str) -> Iterator[Span]:
    for m in HEX_OPENING.finditer(text):
        digits = m.group()
        data = bytes.fromhex(digits[: min(len(digits), 2 * LONGEST) // 2 * 2])
        size = _declared(data, len(data))
        if size is None or size > len(data):
            continue
        found = _kind(data[:size])
        if found and 2 * found[1] == len(digits):
            yield m.start(), m.end(), found[0]


# signature bytes of each algorithm; RSA signatures have the size of the modulus (fixed values)
SIGNATURES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES256K": 64, "ES384": 96, "ES512": 132}
RSA_SIGNED = ("RS256", "RS384", "RS512", "PS256", "PS384", "PS512")


def _json(part: str) -> dict | None:
    try:
        value = json.loads(_plain64(part))
    except (ValueError, RecursionError):  # not UTF-8, not base64, not JSON
        return None
    return value if isinstance(value, dict) else None


def signed(header: str, payload: str, signature: str) -> bool:
    """The three parts are a signed token."""
    if len(signature) % 4 == 1 or len(header) > LONGEST:
        return False
    head = _json(header)
    algorithm = head.get("alg") if head else None
    if not isinstance(algorithm, str):
        return False
    n = len(signature) * 3 // 4
    fits = n == SIGNATURES[algorithm] if algorithm in SIGNATURES else n >= 128 and n % 64 == 0 if algorithm in RSA_SIGNED else algorithm == "EdDSA" and n in (64, 114)
    return fits and (_json(payload) is not None or head.get("b64") is False)


def tokens(text: str) -> Iterator[Span]:
    for m in TOKEN.finditer(text):
        if signed(*m.groups()):
            yield m.start(), m.end(), "token"


def structural_spans(text: str) -> list[Span]:
    """(start, end, kind) of confirmed keys and tokens; a key that is written in hexadecimal can't be one in base64 too."""
    return [*base64_keys(text), *hex_keys(text), *tokens(text)]


# -- over documents ------------------------------------------------------------------------------------------------------------
def told(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row: a map without a shuffle.

    ``spans`` lists ``kind:start:end`` of base and structural finds by start, then kind as in ``KINDS``; places are code points, the
    end is exclusive. ``base_sha256`` is the hash of the same list of the base finds. Null and empty texts have none; repeated rows come
    out once each, null ids too; other columns are not read.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def row(_: object, text: str | None) -> tuple:
        base = base_spans(text or "")
        kinds = [kind for _, _, kind in base]
        digest = hashlib.sha256(told(base).encode()).hexdigest()
        return (*(kinds.count(k) for k in BASE), digest, told(ordered(base + structural_spans(text or ""))))

    return map_rows(source, row, [*((f"n_{k}", "long") for k in BASE), ("base_sha256", "string"), ("spans", "string")])
