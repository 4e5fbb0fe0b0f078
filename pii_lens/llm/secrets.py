"""Secret scans with structural confirmation.

Base spans are those of three fixed patterns. The method adds spans of kinds that are reported only when their inner
structure is confirmed: a base64 or hex candidate is decoded, and what it holds must parse as the nested lengths of a
private key in DER, as the fields of a private SSH key, or as the header, claims and signature of a token. Public keys
and certificates are no secrets. In base64 a key may stand after ``/``, ``-``, ``_`` or ``+``, as in a path.

Nulls: a null text is an empty text. Repeated rows give a row each; extra columns are not read. Spans are code points,
end exclusive. A text may be of any length: it is scanned whole, in time linear in its length.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

from .common import arrow_rows, prepare

#: Kinds in the order in which they are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "jwt", "pem", "der", "ssh")

# The three base patterns and the least length of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

HEX_KEY = re.compile(r"[0-9A-Fa-f]{60,}")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{40,}={0,2}")
#: Where in a run of base64 a key may begin: a DER sequence or the open SSH container, at the start or after a sign that paths use too.
KEY_START = re.compile(r"(?:^|(?<=[+/_-]))(?=M[A-P][A-Za-z0-9+/_-]|b3BlbnNzaC1rZXktdjE)")
JWT = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----((?:\s|\\+[nr])*(?:[A-Za-z-]+: [^\r\n\\]*(?:\s|\\+[nr])+)*)((?:[A-Za-z0-9+/=\s]|\\+[nr])*)-----END \1-----")
ESCAPED_BREAK = re.compile(r"\\+[nr]")

# Signature algorithms of tokens.
ALGORITHMS = frozenset("none HS256 HS384 HS512 RS256 RS384 RS512 ES256 ES256K ES384 ES512 PS256 PS384 PS512 EdDSA Ed25519 Ed448".split())
OPEN_SSH = b"openssh-key-v1\0"
INTEGER, BITS, OCTETS, OID, SEQUENCE = 0x02, 0x03, 0x04, 0x06, 0x30


def _decoded(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


# --- nested lengths ---------------------------------------------------------------------------------------------------


def _element(raw: bytes, at: int) -> tuple[int, int, int] | None:
    """Tag, beginning and end of content of the DER element there; lengths are in their shortest form and within the bytes."""
    if at + 2 > len(raw):
        return None
    tag, n, at = raw[at], raw[at + 1], at + 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > len(raw) or raw[at] == 0:
            return None
        n, at = int.from_bytes(raw[at : at + k], "big"), at + k
        if n < 0x80:
            return None
    return (tag, at, at + n) if at + n <= len(raw) else None


def _members(raw: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill a stretch, what they contain being filled in the same way, however deep."""
    found, todo = None, [(start, end)]
    while todo:
        at, upto = todo.pop()
        here = []
        while at < upto:
            if (e := _element(raw, at)) is None or e[2] > upto:
                return None
            if e[0] & 0x20:
                todo.append(e[1:])
            elif e[0] in (INTEGER, OID) and e[1] == e[2]:
                return None
            here.append(e)
            at = e[2]
        found = here if found is None else found
    return found


def is_der_key(raw: bytes) -> bool:
    """One SEQUENCE that fills the bytes and has the members of a private key: PKCS#1, DSA, SEC 1, PKCS#8 or encrypted PKCS#8.

    Public keys and certificates, which are sequences too, are none.
    """
    if (whole := _element(raw, 0)) is None or whole[0] != SEQUENCE or whole[2] != len(raw) or (parts := _members(raw, whole[1], whole[2])) is None:
        return False
    tags = [t for t, *_ in parts]
    size = lambda i: parts[i][2] - parts[i][1]
    number = lambda i: int.from_bytes(raw[parts[i][1] : parts[i][2]], "big")

    def named(i: int) -> bool:
        """Whether the member is an algorithm: a sequence that begins with an object identifier."""
        inner = _element(raw, parts[i][1])
        return tags[i] == SEQUENCE and inner is not None and inner[0] == OID

    if tags[:1] == [INTEGER] and size(0) == 1:
        version = number(0)
        if tags[:9] == [INTEGER] * 9:  # modulus, exponents, primes, and what follows from them
            return version in (0, 1) and tags[9:] == [SEQUENCE] * version and size(1) >= 32
        if tags == [INTEGER] * 6:
            return version == 0 and size(1) >= 32 and size(5) >= 8
        if len(tags) >= 3 and named(1):
            return version in (0, 1) and tags[2] == OCTETS and size(2) >= 16 and all(t in (0xA0, 0x81, 0xA1) for t in tags[3:])
        if tags[1:2] == [OCTETS]:
            return version == 1 and size(1) >= 16 and tags[2:] in ([], [0xA0], [0xA1], [0xA0, 0xA1])
        return False
    return len(tags) == 2 and named(0) and tags[1] == OCTETS and size(1) >= 32


def _fields(raw: bytes, at: int, n: int) -> tuple[list[bytes], int] | None:
    """``n`` fields after their lengths in four bytes, and where they end."""
    out = []
    for _ in range(n):
        size = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 + size > len(raw):
            return None
        out.append(raw[at + 4 : at + 4 + size])
        at += 4 + size
    return out, at


def ssh_key_end(raw: bytes) -> int | None:
    """Where the open container of private SSH keys ends that the bytes begin with: cipher, derivation, its options, as
    many public keys as it says, and the private part, which begins with one number twice unless it is encrypted."""
    if not raw.startswith(OPEN_SSH) or (got := _fields(raw, len(OPEN_SSH), 3)) is None or got[1] + 4 > len(raw):
        return None
    (cipher, kdf, _), at = got
    keys = int.from_bytes(raw[at : at + 4], "big")
    if not 1 <= keys <= len(raw) // 8 or (got := _fields(raw, at + 4, keys + 1)) is None:
        return None
    *public, secret = got[0]
    for key in public:
        name = _fields(key, 0, 2)
        if name is None or not re.fullmatch(rb"[a-z0-9@.-]+", name[0][0]):
            return None
    plain = cipher == b"none"
    if plain != (kdf == b"none") or len(secret) % 8 or len(secret) < 16 or plain and secret[:4] != secret[4:8]:
        return None
    return got[1]


def key_at(raw: bytes) -> tuple[str, int] | None:
    """Kind and size of the private key that the bytes begin with."""
    if (end := ssh_key_end(raw)) is not None:
        return "ssh", end
    whole = _element(raw, 0)
    return ("der", whole[2]) if whole is not None and is_der_key(raw[: whole[2]]) else None


def is_signed_token(header: str, claims: str, signature: str) -> bool:
    """A header that names a signature algorithm, an object of claims, and a signature, which only unsigned tokens lack."""
    try:
        head, claim = (json.loads(raw) if (raw := _decoded(x)) else None for x in (header, claims))
    except (ValueError, RecursionError):
        return False
    if not isinstance(head, dict) or not isinstance(claim, dict) or not isinstance(head.get("alg"), str) or head["alg"] not in ALGORITHMS:
        return False
    return (head["alg"] == "none") == (not signature) and _decoded(signature) is not None


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then by kind as listed."""
    text = text or ""
    out: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += (("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGN)
    if "AKIA" in text:
        out += (("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS)
    out += _confirmed(text)
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _confirmed(text: str) -> Iterator[tuple[str, int, int]]:
    if "eyJ" in text:
        for m in JWT.finditer(text):
            if is_signed_token(m[1], m[2], m[3]):
                yield "jwt", *m.span()
    blocks = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            raw = _decoded("".join(ESCAPED_BREAK.sub("", m[3]).split()))
            # Of an encrypted block only its header and the size of whole cipher blocks can be told.
            sealed = "DEK-Info: " in m[2] and raw and len(raw) % 8 == 0
            if raw and (sealed or (key := key_at(raw)) and key[1] == len(raw)):
                blocks.append(m.span())
                yield "pem", *m.span()
    # What follows are runs of 32 characters or more.
    if max(map(len, text.split()), default=0) < 32:
        return
    for m in HEX.finditer(text):
        yield "hex", *m.span()
    for m in HEX_KEY.finditer(text):
        if len(m[0]) % 2 == 0 and (key := key_at(bytes.fromhex(m[0]))) and 2 * key[1] == len(m[0]):
            yield key[0], *m.span()
    upto = 0
    for m in BASE64.finditer(text):
        for start in KEY_START.finditer(m[0]):
            at = m.start() + start.start()
            if at >= upto and not any(a <= at < b for a, b in blocks) and (found := _base64_key(m[0], start.start())):
                upto = m.start() + found[1]
                yield found[0], at, upto


def _base64_key(run: str, at: int) -> tuple[str, int] | None:
    """Kind of the private key that is encoded in a run of base64 from there on, and where in the run it ends."""
    body = run.rstrip("=")
    rest = len(body) - at
    head = _decoded(body[at : at + 60 - (rest < 60) * (rest % 4 == 1)])
    if not head or not head.startswith(OPEN_SSH[:14]) and (head[0] != SEQUENCE or _shape(head) is None or _shape(head) > rest * 3 // 4):
        return None
    raw = _decoded(body[at : len(body) - (rest % 4 == 1)])
    key = key_at(raw) if raw else None
    if key is None:
        return None
    end = at + -(-key[1] * 4 // 3)
    if end < len(body):  # what follows must not be more of the same run, but padding's place or a sign
        return (key[0], end) if body[end] in "+/_-" else None
    return key[0], len(run)


def _shape(head: bytes) -> int | None:
    """The size of the sequence that the bytes begin with, if its first member is one that private keys begin with."""
    n, at = head[1], 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or len(head) < 3 + k:
            return None
        n, at = int.from_bytes(head[2 : 2 + k], "big"), 2 + k
    return at + n if head[at] in (INTEGER, SEQUENCE) else None


def _joined(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def _scan(ids, texts):
    cols = [ids, [], [], [], [], []]
    for text in texts:
        found = spans(text)
        base = [s for s in found if s[0] in KINDS[:3]]
        for col, kind in zip(cols[1:4], KINDS[:3]):
            col.append(sum(s[0] == kind for s in base))
        cols[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
        cols[5].append(_joined(found))
    return cols


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of ``docs``."""
    prepare(docs.sparkSession)
    return arrow_rows(docs.select("doc_id", "text"), _scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def masked_text(text: str | None) -> str | None:
    """The text with each secret, overlapping ones as one, replaced by a mark that names its first kind."""
    if not text or not (found := spans(text)):
        return text
    out, at = [], 0
    for kind, a, b in found:
        if a >= at:
            out += (text[at:a], f"[{kind}]")
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with the secrets of ``text`` masked and ``n_chars``, if there is one, counted anew."""
    prepare(docs.sparkSession)
    masked = F.pandas_udf(lambda s: s.map(masked_text, na_action="ignore"), "string")
    out = docs.withColumn("text", masked("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
