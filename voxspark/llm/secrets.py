"""Secret scan: Aho-Corasick keywords, anchored expressions at their hits, embedded checksums.

Kinds and their positions in `spans` (code points, end exclusive), in this order at equal starts:
assign, access, hex (the base), then github and npm: tokens whose last six characters are the base-62
CRC-32 of the thirty before them.
"""

from __future__ import annotations

import re
import string
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import strings, table, with_columns

ASSIGN_KEYS = ("password", "passwd", "secret", "token", "api_key", "apikey")
TOKEN_KEYS = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
_DIGITS = string.digits + string.ascii_uppercase + string.ascii_lowercase
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def checksum(body: str) -> str:
    """Six base-62 digits of the CRC-32."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = _DIGITS[d] + out
    return out.rjust(6, "0")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for k in ASSIGN_KEYS:
        a.add_word(k, ("assign", len(k)))
    a.add_word("akia", ("access", 4))
    for k, kind in TOKEN_KEYS.items():
        a.add_word(k, (kind, len(k)))
    a.make_automaton()
    return a


def scan(text: str, automaton: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """All spans of one text, by start, then kind as listed.

    The keywords are looked up in the text with A-Z lowered (same positions), and an expression is tried only where
    one begins. A hit inside an earlier match of its kind is passed by, as a scan from the left would. Long
    runs of hexadecimal digits have no keyword and are found by one run expression.
    """
    folded = text.lower()
    if len(folded) != len(text):
        folded = text.translate(_LOWER)
    found, over = [], dict.fromkeys(KINDS, 0)
    hits = sorted((end - n + 1, kind) for end, (kind, n) in automaton.iter(folded))
    for start, kind in hits:
        if start < over[kind]:
            continue
        if kind == "assign":
            if m := _ASSIGN.match(text, start):
                over[kind] = m.end()
                if m.end(2) - m.start(2) >= 12:
                    found.append((start, 0, m.end()))
        elif kind == "access":
            if m := _ACCESS.match(text, start):
                over[kind] = m.end()
                if m.end() - start >= 18:
                    found.append((start, 1, m.end()))
        elif m := _TOKEN.match(text, start):
            over[kind] = m.end()
            if checksum(text[start + 4 : m.end() - 6]) == text[m.end() - 6 : m.end()]:
                found.append((start, KINDS.index(kind), m.end()))
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


FIELDS = [T.StructField("secrets", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]


def find_secrets(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `secrets`, the spans found in each whole text; an empty list for a null or empty text.

    Map only: rows are independent, repeated rows are scanned alike, and a text of any length
    is one row. An input column of that name is replaced.
    """
    kept, schema = with_columns(docs, FIELDS)
    at = len(kept)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for b in batches:
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in scan(t, automaton)] for t in strings(b.column(at))]
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(spans, kind)], [*kept, "secrets"])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).alias("_scanned")).mapInArrow(run, schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = "array_join(transform({}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"
    base = f"filter(secrets, s -> s.kind in {BASE!r})"
    count = lambda k: F.expr(f"cast(size(filter(secrets, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}")
    return rows.select("doc_id", *map(count, BASE), F.expr(f"sha2({joined.format(base)}, 256)").alias("base_sha256"), F.expr(joined.format("secrets")).alias("spans"))
