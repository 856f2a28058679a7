"""Secret scan: Aho-Corasick keywords first, anchored expressions at the hits, checksums last.

One automaton pass over each text finds where a secret could begin. The expressions are then matched at those places
only. Runs of hexadecimal digits have no keyword; a run of 24 covers three neighbouring positions of a stride of 8, so
only places with two such positions in a row are extended. Token kinds that carry their own checksum are accepted only if it holds:

* ``github``: ``ghp_ gho_ ghu_ ghs_ ghr_`` and 36 base-62 characters, the last six the CRC-32 of the thirty before;
* ``npm``: ``npm_`` in the same layout;
* ``xprv``: an extended private key in Base58Check, checked by its double SHA-256.

Null and empty texts have no spans. Ranges are code points, end exclusive. Rows are independent, so repeated rows give
repeated results; other columns of the table are not read. Work per row grows with its text; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from landpulse.llm.tables import documents, query

# The expressions that define the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
XPRV = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")

KINDS = ["assign", "access", "hex", "github", "npm", "xprv"]
BASE_KINDS = 3
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "xprv": "xprv",
}
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX, STRIDE = 6, 20, 24, 8
HEX_BYTES = np.isin(np.arange(256), [ord(c) for c in "0123456789abcdef"])

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def crc_base62(body: str) -> bool:
    """Whether the last six characters are the CRC-32 of the others, in base 62 with leading zeros."""
    value, digits = zlib.crc32(body[:-6].encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits == body[-6:]


def base58_check(text: str) -> bool:
    value = 0
    for c in text:
        value = value * 58 + BASE58.index(c)
    raw = value.to_bytes(82, "big") if value < 1 << 656 else b""
    return bool(raw) and hashlib.sha256(hashlib.sha256(raw[:-4]).digest()).digest()[:4] == raw[-4:]


RULES = {
    "assign": (ASSIGN, lambda m: len(m.group(2)) >= LEAST_VALUE),
    "access": (ACCESS, lambda m: m.end() - m.start() >= LEAST_ACCESS),
    "github": (GITHUB, lambda m: crc_base62(m.group(1))),
    "npm": (NPM, lambda m: crc_base62(m.group(1))),
    "xprv": (XPRV, lambda m: base58_check(m.group(0))),
}


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def hex_spans(text: str, raw: bytes) -> list[tuple[int, int]]:
    """Maximal runs of lower-case hexadecimal digits of the least length."""
    # code points, so positions agree with the other kinds
    codes = np.frombuffer(raw, np.uint8) if len(raw) == len(text) else np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 255)
    hit = HEX_BYTES[codes[::STRIDE]]
    out, end = [], -1
    for k in np.flatnonzero(hit[:-1] & hit[1:]).tolist():
        at = k * STRIDE
        if at < end:
            continue
        while at > 0 and HEX_BYTES[codes[at - 1]]:
            at -= 1
        end = HEX.match(text, at).end()
        if end - at >= LEAST_HEX:
            out.append((at, end))
    return out


def spans(text: str | None, keywords) -> list[tuple[int, int, int]]:
    """All (start, kind number, end) of one text, leftmost and not overlapping within a kind."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    folded = raw.lower() if len(raw) == len(text) else None  # ASCII letters only, so lengths stay
    low = folded.decode() if folded is not None else raw.lower().decode("utf-8", "surrogatepass")
    out, after = [], dict.fromkeys(RULES, 0)
    for at, kind in sorted((end + 1 - size, kind) for end, (size, kind) in keywords.iter(low)):
        if at < after[kind]:
            continue
        expression, holds = RULES[kind]
        if match := expression.match(text, at):
            after[kind] = match.end()
            if holds(match):
                out.append((at, KINDS.index(kind), match.end()))
    out += [(a, KINDS.index("hex"), b) for a, b in hex_spans(text, raw)]
    return sorted(out)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def find_secrets(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per secret: (ident, kind, start, end, secret)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches:
            rows = [(i, KINDS[k], a, b, t[a:b]) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                    for a, k, b in spans(t, keywords)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), kind) for c, kind in zip(zip(*rows) if rows else [()] * 5, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()))],
                ["id", "kind", "start", "end", "secret"])

    return docs.selectExpr(f"cast(`{ident}` as bigint) id", f"`{text}` t").mapInArrow(scan, "id long, kind string, start long, end long, secret string").withColumnRenamed("id", ident)


def scan_documents(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of the base kinds, digest of their spans, and all spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                found = spans(t, keywords)
                base = [x for x in found if x[1] < BASE_KINDS]
                count = [sum(x[1] == k for x in base) for k in range(BASE_KINDS)]
                out.append((*count, hashlib.sha256(joined(base).encode()).hexdigest(), joined(found)))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:3]], pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.selectExpr(f"cast(`{ident}` as bigint) doc_id", f"`{text}` t").mapInArrow(scan, SCHEMA)


@query("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan_documents(documents(spark, folder))
