"""Secret scan: Aho-Corasick keywords find places, anchored patterns read them, embedded checksums confirm."""
from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from takt.llm.common import add_columns, free_name

KINDS = ("assign", "access", "hex", "github", "npm", "xprv")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LEAST = 24
# token formats that carry their own checksum
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
XPRV = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
KEYWORDS = {
    **dict.fromkeys(("password", "passwd", "secret", "token", "apikey", "api_key"), "assign"), "akia": "access",
    **dict.fromkeys(("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "github"), "npm_": "npm", "xprv": "xprv",
}
HEX_MARKS = bytes(1 if chr(i) in "0123456789abcdef" else 0 for i in range(256))
RUN = b"\x01" * HEX_LEAST

FIELDS = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
Span = tuple[str, int, int]


def crc_confirms(match: re.Match) -> bool:
    """The last six base-62 digits are the CRC-32 of the thirty characters before them."""
    number = 0
    for ch in match[2]:
        number = number * 62 + BASE62.index(ch)
    return number == zlib.crc32(match[1].encode())


def base58_confirms(match: re.Match) -> bool:
    """The last four bytes are the start of the double SHA-256 of the bytes before them."""
    number = 0
    for ch in match[0]:
        number = number * 58 + BASE58.index(ch)
    if number >> 8 * 82:
        return False
    data = number.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


# kind -> (pattern that must match at a keyword, what a match needs to count)
RULES: dict[str, tuple[re.Pattern, Callable[[re.Match], bool]]] = {
    "assign": (ASSIGN, lambda m: len(m[2]) >= 6), "access": (ACCESS, lambda m: len(m[0]) >= 20),
    "github": (GITHUB, crc_confirms), "npm": (NPM, crc_confirms), "xprv": (XPRV, base58_confirms),
}


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def find(text: str | None) -> list[Span]:
    """All (kind, start, end) of one whole text, by start, then kind as in KINDS; code points, end exclusive.

    Per kind, matches are leftmost and don't overlap; one that fails its length or checksum still takes its
    characters, as in a plain left-to-right search.
    """
    if not text:
        return []
    data = text.encode()
    lower = data.lower().decode()  # bytes.lower turns A-Z only, so places stay the same
    starts: dict[str, set[int]] = {}
    for end, (kind, length) in automaton().iter(lower):
        starts.setdefault(kind, set()).add(end - length + 1)
    spans: list[Span] = []
    for kind, places in starts.items():
        pattern, counts = RULES[kind]
        free = 0
        for start in sorted(places):
            if start >= free and (m := pattern.match(text, start)):
                free = m.end()
                if counts(m):
                    spans.append((kind, start, free))
    # hexadecimal runs have no keyword: the same kind of search over a text of character classes
    if RUN in data.translate(HEX_MARKS):
        spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(text: str | None) -> tuple:
    """The fields of FIELDS."""
    spans = find(text)
    base = [s for s in spans if s[0] in ("assign", "access", "hex")]
    count = [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")]
    return *count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)


def masked(text: str | None) -> str | None:
    """The text with every found span replaced by its kind in brackets; overlapping spans become one."""
    spans = find(text)
    if not spans:
        return text
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_assign, n_access, n_hex, base_sha256 and spans appended.

    spans has every span as kind:start:end; base_sha256 is the digest of the base kinds' list. NULL and empty
    texts: no span. Rows are scanned by themselves: repeated rows give repeated results, an empty table none.
    Input columns with one of these names give way.
    """
    names = {f.split()[0] for f in FIELDS.split(", ")} - {text.lower()}
    return add_columns(docs.drop(*[c for c in docs.columns if c.lower() in names]), text, lambda: digest, FIELDS)


def mask_secrets(docs: DataFrame, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """docs with secrets masked in the text and, where there is such a column, its length brought up to date.

    All rows stay. Texts without a secret, NULL and empty texts, are left as they are, with their length.
    """
    new = free_name(docs, "__masked")
    out = add_columns(docs, text, lambda: lambda t: (masked(t),), f"{new} string")
    changed = ~F.col(new).eqNullSafe(F.col(text))

    def value(c: str):
        if c == text:
            return F.col(new).alias(c)
        if c == chars:
            return F.when(changed, F.length(new).cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c)
        return F.col(f"`{c}`")
    return out.select(*[value(c) for c in docs.columns])
