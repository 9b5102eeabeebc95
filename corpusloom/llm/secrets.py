"""Secret scans: a keyword automaton, anchored expressions near its hits, checksum validation.

An Aho-Corasick automaton finds every keyword in the text, lower-cased in ASCII only so that
positions stay. A regular expression is tried only at the place of a hit, never over the whole
text; runs of hexadecimal digits have no keyword and are the one kind found by a plain scan.
Kinds that carry a checksum (or an encoded header) count only if it holds.

Expressions take what they repeat without giving back, and a place from which nothing later can match is not tried again, so a
scan takes time in proportion to the text, whatever it holds.

Defined results: a null or empty text has no spans; a very long one is scanned whole. Repeated rows are scanned one by one. An empty table
gives an empty one. :func:`secret_spans` reads no columns but ``doc_id`` and ``text``; :func:`redact` keeps all columns, a null or empty text as it is.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import map_rows

BASE_KINDS = ("assign", "access", "hex")
#: Kinds in the order that breaks ties of equal starts.
KINDS = (*BASE_KINDS, "github", "npm", "grafana", "wif", "jwt", "pem")
ORDER = {kind: i for i, kind in enumerate(KINDS)}
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

ASSIGN_RE = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS_RE = re.compile(r"AKIA[A-Z0-9]+")
HEX_RE = re.compile(r"[0-9a-f]{%d,}" % MIN_HEX)
GITHUB_RE = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM_RE = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
GRAFANA_RE = re.compile(r"glsa_([A-Za-z0-9]{32})_([0-9a-f]{8})(?![A-Za-z0-9])")
JWT_RE = re.compile(r"(eyJ[A-Za-z0-9_-]{10,}+)\.(eyJ[A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]{10,}+)")
JWT_RUN_RE = re.compile(r"[A-Za-z0-9_-]*+")
PEM_RE = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s]++)-----END \1-----")
WIF_RE = re.compile(r"(?<![1-9A-HJ-NP-Za-km-z])[5KL][1-9A-HJ-NP-Za-km-z]{50,51}(?![1-9A-HJ-NP-Za-km-z])")

DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
DIGITS58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

#: Keyword (lower case) -> kind tried at its place, and how many characters before it the match starts.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access",
    "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm", "glsa_": "grafana", "eyj": "jwt", "-----begin": "pem", "wif": "wif", "privkey": "wif",
}
#: How far behind its keyword a key in wallet import format may start.
WIF_REACH = 40

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_spans long"


def crc62(body: str) -> str:
    """CRC-32 of ``body`` as six base-62 digits."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = DIGITS62[digit] + out
    return out


def good_wif(key: str) -> bool:
    """Base-58 key whose last four bytes are the double SHA-256 of the rest."""
    value = 0
    for c in key:
        value = value * 58 + DIGITS58.index(c)
    raw = value.to_bytes((value.bit_length() + 7) // 8, "big")
    return len(raw) in (37, 38) and raw[0] == 0x80 and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


def good_jwt(header: str) -> bool:
    """The header decodes to a JSON object that names an algorithm."""
    try:
        got = json.loads(base64.urlsafe_b64decode(header + "=" * (-len(header) % 4)))
    except (ValueError, binascii.Error, RecursionError):
        return False
    return isinstance(got, dict) and "alg" in got


def good_pem(body: str) -> bool:
    """The body decodes to DER whose outer length covers exactly what is there (or to an OpenSSH key)."""
    try:
        raw = base64.b64decode(re.sub(r"\s+", "", body), validate=True)
    except (ValueError, binascii.Error):
        return False
    if raw[:14] == b"openssh-key-v1":
        return True
    if len(raw) < 4 or raw[0] != 0x30:
        return False
    if raw[1] < 0x80:
        return raw[1] + 2 == len(raw)
    wide = raw[1] & 0x7F
    return int.from_bytes(raw[2 : 2 + wide], "big") + 2 + wide == len(raw)


def make_automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


#: Keyword kinds whose expression is anchored at the hit, with the test of a match.
ANCHORED = {
    "assign": (ASSIGN_RE, lambda m: len(m[2]) >= MIN_ASSIGN),
    "access": (ACCESS_RE, lambda m: len(m[0]) >= MIN_ACCESS),
    "github": (GITHUB_RE, lambda m: crc62(m[1]) == m[2]),
    "npm": (NPM_RE, lambda m: crc62(m[1]) == m[2]),
    "grafana": (GRAFANA_RE, lambda m: f"{zlib.crc32(('glsa_' + m[1]).encode()):08x}" == m[2] or f"{zlib.crc32(m[1].encode()):08x}" == m[2]),
    "jwt": (JWT_RE, lambda m: good_jwt(m[1])),
    "pem": (PEM_RE, lambda m: good_pem(m[2])),
}


def scan(raw: bytes, automaton: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of a text in code points, ordered by start, then by kind as listed."""
    text = raw.decode("utf-8", "surrogatepass")
    lower = raw.lower().decode("utf-8", "surrogatepass")  # bytes.lower() changes A to Z only
    spans, near = [], []
    reached = dict.fromkeys(KINDS, 0)
    for last, (kind, width) in automaton.iter(lower):
        at = last + 1 - width
        if kind == "wif":
            # Starts that are near enough to a hit: ranges that touch are searched as one.
            if near and last + 1 <= near[-1][1] + 1:
                near[-1][1] = last + 1 + WIF_REACH
            else:
                near.append([last + 1, last + 1 + WIF_REACH])
            continue
        if at < reached[kind]:
            continue
        pattern, holds = ANCHORED[kind]
        if m := pattern.match(text, at):
            reached[kind] = m.end()
            if holds(m):
                spans.append((at, m.end(), kind))
        elif kind == "jwt" and text.startswith("eyJ", at):
            # What follows the run of characters is the same for every later hit in it, and the run only shorter.
            reached[kind] = JWT_RUN_RE.match(text, at).end()
    for first, final in near:
        spans += [(m.start(), m.end(), "wif") for m in WIF_RE.finditer(text, first, final + 52) if m.start() <= final and good_wif(m[0])]
    spans += [(m.start(), m.end(), "hex") for m in HEX_RE.finditer(text)]
    return sorted(spans, key=lambda s: (s[0], ORDER[s[2]]))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def make_scanner():
    automaton = make_automaton()

    def work(rows: list) -> list:
        out = []
        for doc_id, text in rows:
            spans = scan(text or b"", automaton)
            base = [s for s in spans if s[2] in BASE_KINDS]
            counts = [sum(s[2] == kind for s in base) for kind in BASE_KINDS]
            out.append((doc_id, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(spans), len(spans)))
        return out

    return work


def secret_spans(documents: DataFrame) -> DataFrame:
    """One row of SCHEMA for each document."""
    return map_rows(documents.select(F.col("doc_id").cast("long"), F.col("text")), make_scanner, SCHEMA)


def redact(documents: DataFrame, mark: str = "[REDACTED]") -> DataFrame:
    """``documents`` with every span replaced by ``mark``; overlapping spans become one. ``n_chars`` follows."""
    columns = documents.columns
    strings = [kind == "string" for _, kind in documents.dtypes]

    def make():
        automaton = make_automaton()
        at = columns.index("text")
        size = columns.index("n_chars") if "n_chars" in columns else None

        def work(rows: list) -> list:
            out = []
            for row in rows:
                row = [v.decode("utf-8", "surrogatepass") if v is not None and strings[i] and i != at else v for i, v in enumerate(row)]
                raw = row[at]
                if raw is not None:
                    text = raw.decode("utf-8", "surrogatepass")
                    if spans := scan(raw, automaton):
                        parts, done, covered = [], 0, -1
                        for start, end, _ in spans:
                            if start >= covered:
                                parts += [text[done:start], mark]
                            covered = max(covered, end)
                            done = covered
                        text = "".join([*parts, text[done:]])
                        if size is not None:
                            row[size] = len(text)
                    row[at] = text
                out.append(tuple(row))
            return out

        return work

    return map_rows(documents, make, ", ".join(f"`{c}` {t}" for c, t in documents.dtypes))
