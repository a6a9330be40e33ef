"""Secret scan: three fixed kinds, and sliding-window entropy over candidate strings."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from math import log2
from typing import NamedTuple

from pyspark.sql import DataFrame

from flowsentry.llm import common

#: Fixed patterns of the three base kinds; a match counts if it (for assign: its second group) is long enough.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("passw", "secret", "token", "api")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16


class CharClass(NamedTuple):
    """Strings of one alphabet, and the entropy in bits a window of them needs to look random."""

    kind: str
    run: re.Pattern
    window: int
    threshold: float
    needs: tuple[re.Pattern, ...]


_DIGIT, _LOWER, _UPPER = re.compile("[0-9]"), re.compile("[a-z]"), re.compile("[A-Z]")
#: Letters and digits in seven runs by turns, capitals (with fewer digits among them) in five; words with numbers have fewer.
_AMONG_LOWER = re.compile("([a-z]+[0-9]+){3}[a-z]|([0-9]+[a-z]+){3}[0-9]")
_AMONG_UPPER = re.compile("([A-Z]+[0-9]+){2}[A-Z]|([0-9]+[A-Z]+){2}[0-9]")

CLASSES = (
    CharClass("entropy_hex", re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{24,}(?![0-9A-Za-z])"), 24, 3.0, (_DIGIT, re.compile("[a-fA-F]"))),
    CharClass("entropy_lower", re.compile(r"(?<![A-Za-z0-9])[a-z0-9]{24,}(?![A-Za-z0-9])"), 20, 3.5, (_AMONG_LOWER,)),
    CharClass("entropy_upper", re.compile(r"(?<![A-Za-z0-9])[A-Z0-9]{24,}(?![A-Za-z0-9])"), 20, 3.4, (_AMONG_UPPER,)),
    CharClass("entropy_base64", re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"), 20, 3.6, (_DIGIT, _LOWER, _UPPER)),
)

#: Strings that look random but are none: identifiers, placeholders, alphabets, links, paths and data digests.
ALLOWED = (
    r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
    r"(?i:[a-z_-]*(example|sample|placeholder|changeme|your[_-]|dummy|x{4,})[a-z_-]*[0-9]{0,4})",
    r"(?i:(0123456789|123456789|12345678|abcdefghijklmnopqrstuvwxyz|abcdefgh|abcdef)+[0-9a-h]{0,8})",
    r"(?P<same>.)(?P=same)*",
    r"[A-Za-z]+([-_/][A-Za-z]+)*[0-9]{0,4}",
    r"[0-9]+([-_/][0-9]+)*",
    r"/?([a-z]+|[0-9]+)([/_-]([a-z]+|[0-9]+)){2,}/?",
)
#: A candidate right behind one of these is part of a link, a file checksum or inline data.
ALLOWED_BEFORE = re.compile(r"(?i)(://[^\s\"'<>]*|\b(sha\d*|md5|checksum|commit|integrity)[-:=\s]{1,2})$")


class Span(NamedTuple):
    start: int
    kind: str
    end: int


def base_spans(text: str) -> list[Span]:
    """Matches of the three fixed kinds, leftmost and non-overlapping within a kind, by start and kind."""
    spans = []
    lowered = text.lower()
    if any(k in lowered for k in KEYWORDS):
        spans += [Span(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [Span(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    spans += [Span(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return spans


def random_windows(s: str, window: int, threshold: float) -> Iterator[tuple[int, int]]:
    """Maximal unions of windows whose Shannon entropy is at least ``threshold`` bits.

    The entropy is log2(W) - sum(n log2 n) / W; the sum is kept up to date from the two counts a step changes.
    """
    table = [0.0] + [n * log2(n) for n in range(1, window + 2)]
    most = (log2(window) - threshold) * window + 1e-9
    counts: dict[str, int] = {}
    total, begin, end = 0.0, -1, -1
    for i, c in enumerate(s):
        n = counts.get(c, 0)
        total += table[n + 1] - table[n]
        counts[c] = n + 1
        if i >= window:
            old = s[i - window]
            n = counts[old]
            total += table[n - 1] - table[n]
            counts[old] = n - 1
        if i >= window - 1 and total <= most:
            at = i - window + 1
            if begin >= 0 and at <= end:
                end = i + 1
            else:
                if begin >= 0:
                    yield begin, end
                begin, end = at, i + 1
    if begin >= 0:
        yield begin, end


def entropy_spans(text: str, classes: tuple[CharClass, ...], allowed: re.Pattern) -> list[Span]:
    spans = []
    for c in classes:
        for m in c.run.finditer(text):
            s = m[0]
            if not all(p.search(s) for p in c.needs) or allowed.fullmatch(s):
                continue
            if ALLOWED_BEFORE.search(text, max(0, m.start() - 200), m.start()):
                continue
            for a, b in random_windows(s, c.window, c.threshold):
                if all(p.search(s, a, b) for p in c.needs):
                    spans.append(Span(m.start() + a, c.kind, m.start() + b))
    return spans


def scan(text: str, classes: tuple[CharClass, ...] = CLASSES, allowed: re.Pattern | None = None) -> list[Span]:
    """All spans by start, then kind as listed. An entropy span that another span covers is left out."""
    base = base_spans(text)
    found = base + entropy_spans(text, classes, allowed or _compile(ALLOWED))
    order = {k: i for i, k in enumerate(("assign", "access", "hex", *(c.kind for c in classes)))}
    found.sort(key=lambda s: (s.start, order[s.kind], s.end))
    kept, reach = [], -1
    for s in found:
        if order[s.kind] < 3 or s.end > reach:
            kept.append(s)
            reach = max(reach, s.end)
    return kept


def _compile(allowed: tuple[str, ...]) -> re.Pattern:
    return re.compile("|".join(f"(?:{a})" for a in allowed))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def find_secrets(docs: DataFrame, allow: tuple[str, ...] = ALLOWED, classes: tuple[CharClass, ...] = CLASSES) -> DataFrame:
    """Per row of ``docs``: counts by kind, a digest of the base spans, and all spans (code points, end exclusive).

    ``allow`` holds full-match patterns that silence entropy candidates; base spans are never silenced. A null text is
    empty; repeated rows and null ids are answered row by row; an empty table gives no rows; other columns are ignored.
    """
    patterns = _compile(allow)

    def rows(batches):
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                spans = scan(text or "", classes, patterns)
                base = [s for s in spans if s.kind in ("assign", "access", "hex")]
                kinds = [s.kind for s in spans]
                yield (
                    doc_id,
                    *(kinds.count(k) for k in ("assign", "access", "hex")),
                    hashlib.sha256(joined(base).encode()).hexdigest(),
                    joined(spans),
                    len(spans) - len(base),
                )

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long"
    return common.map_rows(docs.select("doc_id", "text"), rows, schema)


def redact(docs: DataFrame, mask: str = "[SECRET]", allow: tuple[str, ...] = ALLOWED) -> DataFrame:
    """``docs`` with every found span replaced by ``mask`` (overlapping spans as one) and ``n_chars`` brought up to date.

    All rows and columns stay; texts without a finding, null among them, are unchanged.
    """
    patterns = _compile(allow)

    def clean(text):
        spans = scan(text, CLASSES, patterns)
        if not spans:
            return text
        out, at = [], 0
        for s in spans:
            if s.start >= at:
                out += [text[at : s.start], mask]
            at = max(at, s.end)
        return "".join([*out, text[at:]])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = [t if t is None else clean(t) for t in batch.column(at).to_pylist()]
            batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
            if (at := batch.schema.get_field_index("n_chars")) >= 0:
                old = batch.column(at).to_pylist()
                sizes = [n if t is None else len(t) for t, n in zip(texts, old)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(sizes, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)
