"""Secrets in texts: fixed patterns, and strings that neither code nor context explains.

A candidate is a long run of token characters in a sensitive context. Its novelty is what it adds to
the zstandard frame of the code around it, by a compressor that is primed with a dictionary of common
identifiers: names, paths and placeholders are mostly matches to what the compressor has seen, while a
random key has to be spelled out. Candidates whose added bytes are most of their length are reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN, ACCESS, HEX, NOVEL = "assign", "access", "hex", "novel"
ASSIGNED = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS_ID = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX_RUN = re.compile(r"[0-9a-f]{24,}")
#: No text without one of these has an assignment.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")

RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
SENSITIVE = re.compile(
    r"pass|pwd|secret|token|key|auth|bearer|credential|private|signature|session|cookie|login|salt|cert|jwt",
    re.IGNORECASE | re.ASCII,
)

#: What names, paths and placeholders are made of; the compressor knows it before it sees a text.
IDENTIFIERS = """
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000000000000000 11111111 1234567890
aaaaaaaaaaaaaaaaaaaa xxxxxxxxxxxxxxxxxxxx XXXXXXXXXXXXXXXXXXXX 0123456789abcdef deadbeef ffffffffffffffff
example sample placeholder changeme your_api_key_here YOUR_SECRET_KEY replace_with insert_your test demo dummy
import export from return function class public private protected static const void string boolean number
http https www com org net html index content application json text javascript charset utf-8 base64 data image
user users username name email address account customer client server service services provider config
configuration settings options default value values type types object array list map item items element
request response session cookie header headers authorization bearer authentication authorize login logout
password passwd secret secrets token tokens access_token refresh_token api_key apiKey API_KEY client_secret
client_id private_key public_key certificate credential credentials signature encryption encrypted
database connection connect host hostname port url uri path directory file filename folder storage bucket
create update delete remove insert select get set put post read write load save open close start stop
manager handler controller factory builder listener adapter component container context environment
development production staging version release build system process thread queue message event error
exception warning message debug info log logger test tests spec mock fixture utils helper helpers common
"""


def compressor() -> zstandard.ZstdCompressor:
    words = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(
        level=9, dict_data=words, write_content_size=False, write_checksum=False, write_dict_id=False
    )


def novelty(zstd: zstandard.ZstdCompressor, before: str, string: str, after: str) -> float:
    """Bytes that ``string`` adds to the frame of its surroundings, for each of its own bytes."""
    whole = len(zstd.compress((before + string + after).encode()))
    return (whole - len(zstd.compress((before + after).encode()))) / len(string.encode())


def patterned(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, kind by kind."""
    spans = []
    lowered = text.lower()
    if any(word in lowered for word in ASSIGN_WORDS):
        spans += [(ASSIGN, m.start(), m.end()) for m in ASSIGNED.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(ACCESS, m.start(), m.end()) for m in ACCESS_ID.finditer(text)]
    return spans + [(HEX, m.start(), m.end()) for m in HEX_RUN.finditer(text)]


def candidates(text: str, spans: list[tuple[str, int, int]], reach: int) -> Iterator[tuple[int, int]]:
    """Runs with letters and digits that overlap no span and follow a sensitive word on their line."""
    taken, at = sorted((start, stop) for _, start, stop in spans), 0
    for m in RUN.finditer(text):
        start, stop = m.span()
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if any(s < stop and start < e for s, e in taken[at : at + 3]):
            continue
        run = m[0]
        if run.isalpha() or not any(c.isdigit() for c in run) or not any(c.isalpha() for c in run):
            continue
        line = text[max(0, start - reach) : start].rpartition("\n")[2]
        if SENSITIVE.search(line):
            yield start, stop


def spans_of(
    zstd: zstandard.ZstdCompressor, text: str, least: float, reach: int, around: int
) -> list[tuple[str, int, int, float | None]]:
    """All spans by start, then by kind, with the novelty of those that were measured."""
    fixed = patterned(text)
    found: list[tuple[str, int, int, float | None]] = [(*span, None) for span in fixed]
    for start, stop in candidates(text, fixed, reach):
        new = novelty(zstd, text[max(0, start - around) : start], text[start:stop], text[stop : stop + around])
        if new >= least:
            found.append((NOVEL, start, stop, new))
    order = (ASSIGN, ACCESS, HEX, NOVEL)
    return sorted(found, key=lambda s: (s[1], order.index(s[0])))


def scan(
    docs: DataFrame, least: float = 0.78, reach: int = 64, around: int = 128,
    doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Secrets of every row: ``doc_id, n_assign, n_access, n_hex, spans``.

    ``spans`` are ``kind, start, stop, novelty`` in code points, by start and then kind. Kinds
    ``assign``, ``access`` and ``hex`` follow their patterns; ``novel`` are runs of 16 or more token
    characters, letters and digits among them, outside of other spans, after a sensitive word among
    the ``reach`` code points before them on their line, that add ``least`` or more of their length to
    the compressed ``around`` code points on both sides. A null or empty text has no spans. Each row
    gives one row, whatever it repeats; null ids stay null; other columns are left out. Texts are read
    whole, and work grows with their length.
    """
    id_type = docs.schema[doc_id].dataType.simpleString()
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("novelty", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = compressor()
        for batch in batches:
            found = [spans_of(zstd, t.as_py() or "", least, reach, around) for t in batch.column(1)]
            counts = [
                pa.array([sum(s[0] == kind for s in spans) for spans in found], pa.int64())
                for kind in (ASSIGN, ACCESS, HEX)
            ]
            rows = [[dict(zip(("kind", "start", "stop", "novelty"), s, strict=True)) for s in spans] for spans in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *counts, pa.array(rows, pa.list_(span))],
                ["doc_id", "n_assign", "n_access", "n_hex", "spans"],
            )

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {id_type}, n_assign long, n_access long, n_hex long, "
        "spans array<struct<kind:string,start:long,stop:long,novelty:double>>",
    )
