"""Secret scans: single-pattern findings plus credentials linked from parts that lie close together."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from shoplens.llm.common import ship, with_defaults

KINDS = ("assign", "access", "hex", "ident", "weak_secret", "endpoint")
_RANK = {k: i for i, k in enumerate(KINDS)}
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# A greedy run of 16 or more is the same as a greedy run kept when it has 16 or more.
_HEX = re.compile(r"[0-9a-f]{16,}")
# Parts that say nothing alone: user and account identifiers, random-looking words, hosts and URLs.
_IDENT = re.compile(
    r"""\b(?:user(?:name)?|login|account|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._+-]{3,})""",
    re.IGNORECASE | re.ASCII,
)
_WEAK = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9a-z+/_-]*[A-Z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])", re.ASCII)
_ENDPOINT = re.compile(r"\b(?:(?:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s\"'<>]{4,}|(?:host|server|endpoint)\x20*[:=]\x20*[A-Za-z0-9.-]{4,}(?::\d+)?)", re.ASCII | re.IGNORECASE)
_HINTS = re.compile(r"://|[0-9]|[=:]")


def _base(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 12]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], _RANK[x[2]], x[1]))


def _near(spans: list[tuple[int, int]], starts: list[int], widest: int, lo: int, hi: int) -> bool:
    """Does a span touch [lo, hi)? An interval join's probe: spans sorted by start, none wider than ``widest``."""
    i = bisect.bisect_left(starts, lo - widest)
    while i < len(starts) and starts[i] < hi:
        if spans[i][1] > lo:
            return True
        i += 1
    return False


def _scopes(text: str) -> list[int]:
    return [m.end() for m in re.finditer(r"\n[ \t]*\n", text)]


def find(text: str, reach: int = 200) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans) of one text, sorted; positions are code points, ends exclusive.

    A weak part (``ident``, ``weak_secret``, ``endpoint``) counts only where a part of a complementary kind lies
    within ``reach`` characters in the same scope (a paragraph): a secret with an identifier or an endpoint, and
    an identifier or endpoint with a secret. Base spans are parts as well. A weak part that overlaps a base span is
    that span's own text and is not repeated.
    """
    base = _base(text)
    if not _HINTS.search(text):
        return base, base
    ident = [(m.start(), m.end()) for m in _IDENT.finditer(text)]
    weak = [(m.start(), m.end()) for m in _WEAK.finditer(text)]
    ends = [(m.start(), m.end()) for m in _ENDPOINT.finditer(text)]
    if not (ident or weak or ends):
        return base, base
    taken = sorted((s, e) for s, e, _ in base)
    taken_at, taken_wide = [s for s, _ in taken], max((e - s for s, e in taken), default=0)
    fresh = lambda spans: [x for x in spans if not _near(taken, taken_at, taken_wide, *x)]
    ident, weak, ends = fresh(ident), fresh(weak), fresh(ends)
    strong = [(s, e) for s, e, k in base if k in ("assign", "hex")]
    keys = [(s, e) for s, e, k in base if k == "access"]
    breaks = _scopes(text)

    def linked(spans, partners):
        partners = sorted(partners)
        at, wide = [s for s, _ in partners], max((e - s for s, e in partners), default=0)
        out = []
        for s, e in spans:
            i = bisect.bisect_right(breaks, s)
            lo = breaks[i - 1] if i else 0
            hi = breaks[bisect.bisect_left(breaks, e)] if bisect.bisect_left(breaks, e) < len(breaks) else len(text)
            if _near(partners, at, wide, max(lo, s - reach), min(hi, e + reach)):
                out.append((s, e))
        return out

    added = [(*x, "weak_secret") for x in linked(weak, ident + ends + keys)]
    added += [(*x, "ident") for x in linked(ident, weak + strong)]
    added += [(*x, "endpoint") for x in linked(ends, weak + strong)]
    return base, sorted(base + added, key=lambda x: (x[0], _RANK[x[2]], x[1]))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[secret]") -> str:
    """The text with each run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for s, e, _ in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, reach: int = 200, redacted: bool = False) -> DataFrame:
    """``docs`` plus ``base`` and ``spans``, arrays of (start, end, kind) over the whole text, and, if asked, ``clean``.

    One pass without a shuffle: each row is judged alone, so copies and hot sources cost nothing extra. A null text
    counts as empty and gives empty arrays (``clean`` stays null). Other columns pass through; input columns named as
    the results are replaced. Long texts are scanned whole; matches are found by iterators. Repeated rows each keep their result.
    """
    ship(docs.sparkSession)
    docs = docs.drop("base", "spans", "clean")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    extra = "base array<struct<start:long,end:long,kind:string>>, spans array<struct<start:long,end:long,kind:string>>"
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from shoplens.llm import secrets

        for batch in batches:
            base, spans, clean = [], [], []
            for value in batch.column(columns.index("text")):
                text = value.as_py()
                b, a = secrets.find(text or "", reach)
                base.append([{"start": s, "end": e, "kind": k} for s, e, k in b])
                spans.append([{"start": s, "end": e, "kind": k} for s, e, k in a])
                if redacted:
                    clean.append(None if text is None else secrets.redact(text, a))
            arrays = [*batch.columns, pa.array(base, span), pa.array(spans, span)]
            names = [*columns, "base", "spans"]
            if redacted:
                arrays.append(pa.array(clean, pa.string()))
                names.append("clean")
            yield pa.RecordBatch.from_arrays(arrays, names)

    if "text" not in columns:
        raise ValueError("scan needs a text column")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, {extra}" + (", clean string" if redacted else ""))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts per base kind, the hash of the base spans and all spans as text, per row."""
    from pyspark.sql import functions as F

    def text(column):
        return F.array_join(F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"),
    )


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    docs = with_defaults(spark.read.parquet(f"{sf_dir}/documents.parquet"), doc_id="long", text="string")
    return digest(scan(docs))
