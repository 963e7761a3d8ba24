"""Secret scans: fixed patterns, and values in a credential context that are hard to guess.

The fixed patterns find assignments, access keys and long hex strings.  The
method adds kind ``guess``: a value that follows a wider set of credential
names and whose guessing cost (:mod:`.guess_cost`) is at least ``HARD``
powers of ten, so placeholders and common passwords are passed over and
values of any characters are found.  A value wholly inside a span of the fixed
patterns is not reported again; one that reaches beyond is.

Positions are code points, the end exclusive; spans stand in the order of
their start, then of ``KINDS``.  Scanning is one pass over the texts, with no
shuffle; texts are read whole.

Defined cases: null and empty texts have no spans; repeated rows are all
returned; texts and values of any length are read whole; no rows give no rows;
only the two named columns are read, so others cannot clash.  An unquoted
value that is one word of letters, in lower case or capitalised, is taken as
prose and not priced.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, col, table
from .guess_cost import log10_guesses

KINDS = ("assign", "access", "hex", "guess")
HARD = 8.0

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_CONTEXT = re.compile(
    r"""(?<![^\W_])(?:pass(?:word|wd|phrase|code)?|pwd|pin|secret|token|api[_-]?key|(?:access|private|secret)[_-]?key"""
    r"""|client[_-]?secret|credentials?|auth|bearer|contraseña|mot\x20de\x20passe|passwort|kennwort)"""
    r"""["']?\x20{0,3}(?::=|=>|[:=])\x20{0,3}(["']?)([^\s"'<>]{6,})""", re.I)
_CONTEXT_HINTS = ("pass", "pwd", "pin", "secret", "token", "key", "credential", "auth", "bearer", "contrase", "kennwort")


@lru_cache(10_000)
def _cost(value: str) -> float:
    return log10_guesses(value)


def _plain_word(value: str) -> bool:
    return value.isalpha() and (value.islower() or value[1:].islower())


def find_secrets(text: str | None) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, log10 of the guesses for kind guess) of every span of a text."""
    if not text:
        return []
    found: list[tuple[str, int, int, float | None]] = []
    lower = text.lower()
    if any(h in lower for h in _ASSIGN_HINTS):
        found += [("assign", m.start(), m.end(), None) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), None) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end(), None) for m in _HEX.finditer(text)]
    if any(h in lower for h in _CONTEXT_HINTS):
        base = sorted((start, end) for _, start, end, _ in found)
        for m in _CONTEXT.finditer(text):
            value = m[2].rstrip(".,;:!?)]}")
            start, end = m.start(2), m.start(2) + len(value)
            if len(value) < 6 or not m[1] and _plain_word(value):
                continue
            if any(a <= start and end <= b for a, b in base):
                continue
            if (cost := _cost(value)) >= HARD:
                found.append(("guess", start, end, cost))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("log10_guesses", pa.float64())])


def _scan(batches):
    for batch in batches:
        spans = [[dict(zip(("kind", "start", "end", "log10_guesses"), s)) for s in find_secrets(t)]
                 for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array of (kind, start, end, log10_guesses)) for every row of ``docs``."""
    bound_batches(docs.sparkSession)
    texts = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(
        _scan, f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint,log10_guesses:double>>")


def op1_secret_scan(spark, sf_dir: str) -> DataFrame:
    spans = scan(table(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(found):
        return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"] != "guess")
    return spans.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                        count("guess"), F.round(F.array_max(F.transform("spans", lambda s: s["log10_guesses"])), 2)
                        .alias("log10_guesses"))
