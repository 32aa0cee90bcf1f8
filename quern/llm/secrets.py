"""Secret scan: known patterns, and a token-efficiency test for random strings.

A string in which a vocabulary learnt from ordinary text finds few long tokens is random: it
has few characters to a token. The test is made on runs of 20 or more characters of the
base64 and URL-safe alphabets, after known digests (hex of a digest's length, UUIDs) and
identifiers (numbers, repeats of few characters, letters of a single case, words joined by
``_``, ``-`` or ``/``) are excluded. What the patterns found stays, excluded or not.

Nulls, ties, empties: a null text is an empty one and has no spans; repeated rows and null
doc_ids are separate documents; of spans that start together the kinds' order decides; an empty
table gives no rows; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

KINDS = ("assign", "access", "hex", "random")
# The patterns of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: One of these is in each text that ASSIGN matches in, once in lower case.
HINTS = ("passw", "secret", "token", "apikey", "api_key")

RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
DIGEST = re.compile(r"(?i:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12})")
PLAIN = re.compile(r"[0-9+/_-]+|[A-Z]?[a-z]+|[A-Z]+")
JOINT = re.compile(r"[_/+-]+")
PART = re.compile(r"[A-Za-z]?[a-z]*[0-9]{0,4}|[A-Z]*[0-9]{0,4}")

#: Characters to a token below which a run is random: with digits in it, and without.
WITH_DIGITS, LETTERS = 2.0, 1.6


@functools.lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str):
    """A tiktoken encoding of the ranks in a file, kept in each Python worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def is_identifier(run: str) -> bool:
    parts = JOINT.split(run)
    return bool(PLAIN.fullmatch(run)) or len(parts) > 1 and all(map(PART.fullmatch, parts))


def is_random(run: str, encode) -> bool:
    """encode gives a string's tokens; long runs are encoded in pieces, which adds a few tokens at most."""
    if DIGEST.fullmatch(run) or is_identifier(run) or len(set(run)) < 8:
        return False
    tokens = sum(len(encode(run[i : i + 256])) for i in range(0, len(run), 256))
    return len(run) < (WITH_DIGITS if any(c.isdigit() for c in run) else LETTERS) * tokens


def scan(text: str, encode) -> list[tuple[str, int, int]]:
    """kind, start and end (code points) of each span, by start, then kind; encode gives a string's tokens."""
    spans = []
    low = text.lower()
    if any(x in low for x in HINTS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    runs = list(RUN.finditer(text))
    for r in runs:  # a match of 20 or more characters lies within a run
        spans += [("access", *m.span()) for m in ACCESS.finditer(text, *r.span()) if len(m[0]) >= 20]
        spans += [("hex", *m.span()) for m in HEX.finditer(text, *r.span()) if len(m[0]) >= 24]
    base = [x[1:] for x in spans]
    for r in runs:
        lo, hi = r.span()
        if not any(a < hi and lo < b for a, b in base) and is_random(r[0], encode):
            spans.append(("random", lo, hi))
    return sorted(spans, key=lambda x: (x[1], KINDS.index(x[0])))


def secret_spans(docs: DataFrame, vocabulary_path: str, pattern: str) -> DataFrame:
    """doc_id, spans (array of kind, start, end) of each document."""
    schema = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(vocabulary_path, pattern).encode_ordinary
        for b in batches:
            found = [[{"kind": k, "start": lo, "end": hi} for k, lo, hi in scan(t, encode)] for t in texts_of(b)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, schema)], ["doc_id", "spans"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind: string, start: int, `end`: int>>")


def joined(spans) -> F.Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
