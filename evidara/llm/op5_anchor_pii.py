"""Personal data by anchor expansion.

An Aho-Corasick automaton runs once over each whole text and stops at anchors: at-signs, plus signs, digits, ``://``
and cues such as ``iban`` or ``(at)``.  A small deterministic parser expands each anchor to its span and validates it.
The base kinds are exactly the leftmost, non-overlapping matches of the four base patterns, failing ones dropped:

* email: the run of local characters before an at-sign, then two or more labels joined by dots;
* ip: four dotted numbers, in fours from the left of a longer dotted row, each at most 255;
* card: the whole row of digits with single blanks or hyphens between, 14 to 19 digits, Luhn;
* phone: a plus, a digit, then to the last digit of the row of phone characters, 10 to 15 digits.

Added beyond the base where nothing of the base is touched: ``email`` written with (at) or [at], ``phone`` without a plus
after ``tel:`` or ``phone:``, ``account`` (an IBAN with a right checksum after ``iban``, a social security number
after ``ssn``) and ``url`` (an address with a password in it).

Nulls and edges: a NULL or empty text has no spans; positions are code points; NULL doc_ids and repeated rows are
judged like any row; an empty table gives an empty result.  Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from evidara.llm.common import in_pieces, table, texts

KINDS = ("email", "ip", "card", "phone", "account", "url")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
_DIALLED = re.compile(r"[\x20().0-9-]+")
_SPELLED = re.compile(r"[A-Za-z0-9-]+(?:(?:\.|[\x20]?[(\[]dot[)\]][\x20]?)[A-Za-z0-9-]+)+")
_IBAN = re.compile(r"[\x20:]*([A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30})")
_SSN = re.compile(r"[\x20:#]*([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
_TELEPHONE = re.compile(r"[\x20]*([0-9(][\x20().0-9-]+[0-9])")
_LOGIN = re.compile(r"[^\s/@:]+:[^\s/@]+@[A-Za-z0-9.-]+[^\s]*")
CUES = ("iban", "IBAN", "ssn", "SSN", "tel:", "Tel:", "phone:", "Phone:", "(at)", "[at]", "://")


def anchors() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for x in (*"@+0123456789", *CUES):
        found.add_word(x, x)
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def iban_holds(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def find(text: str, automaton: ahocorasick.Automaton) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans and added spans as (start, end, kind)."""
    base, cues = [], []
    email_end = dotted_end = digits_end = 0
    for last, anchor in automaton.iter(text):
        if "0" <= anchor <= "9":
            if last >= dotted_end:
                m = _DOTTED.match(text, last)
                dotted_end = m.end()
                parts = m[0].split(".")
                at = last
                for k in range(0, len(parts) - 3, 4):
                    four = ".".join(parts[k : k + 4])
                    if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in parts[k : k + 4]):
                        base.append((at, at + len(four), "ip"))
                    at += len(four) + 1
            if last >= digits_end:
                m = _DIGITS.match(text, last)
                digits_end = m.end()
                if digits_end - last >= 14:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        base.append((last, digits_end, "card"))
        elif anchor == "@":
            start = last
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                email_end = m.end()
                base.append((start, email_end, "email"))
        elif anchor == "+":
            if text[last + 1 : last + 2] in _DIGIT and (m := _DIALLED.match(text, last + 2)):
                end = m.end()
                while end > last + 3 and text[end - 1] not in _DIGIT:
                    end -= 1
                if end > last + 3 and 10 <= sum(c in _DIGIT for c in text[last:end]) <= 15:
                    base.append((last, end, "phone"))
        else:
            cues.append((last + 1, anchor))
    added: list[tuple[int, int, str]] = []
    starts, ends = _merged(base) if cues else ([], [])
    for end, cue in cues:
        span = _from_cue(text, end, cue)
        if span:
            i = bisect.bisect_left(starts, span[1])  # taken stretches don't overlap, so the one before decides
            if not i or ends[i - 1] <= span[0]:
                added.append(span)
                starts.insert(i, span[0])
                ends.insert(i, span[1])
    return base, added


def _merged(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that the spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b, _ in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


_DIGIT = frozenset("0123456789")


def _from_cue(text: str, end: int, cue: str) -> tuple[int, int, str] | None:
    name = cue.lower()
    if name == "iban":
        m = _IBAN.match(text, end)
        return (m.start(1), m.end(1), "account") if m and iban_holds(m[1]) else None
    if name == "ssn":
        m = _SSN.match(text, end)
        return (m.start(1), m.end(1), "account") if m and m[1][:3] not in ("000", "666") and m[1][0] != "9" else None
    if name in ("tel:", "phone:"):
        m = _TELEPHONE.match(text, end)
        return (m.start(1), m.end(1), "phone") if m and 10 <= sum(c in _DIGIT for c in m[1]) <= 15 else None
    if name == "://":
        start = end - 3
        while start and text[start - 1].isascii() and text[start - 1].isalnum():
            start -= 1
        m = _LOGIN.match(text, end)
        return (start, m.end(), "url") if m and start < end - 3 else None
    gap = 1 if text[end - 5 : end - 4] == " " else 0
    start = end - 4 - gap
    while start and text[start - 1] in _LOCAL:
        start -= 1
    m = _SPELLED.match(text, end + (text[end : end + 1] == " "))
    return (start, m.end(), "email") if m and start < end - 4 - gap else None


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"


def personal_data(docs: DataFrame, redact: bool = True) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, all spans, and the text with each span as [KIND]."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in in_pieces(batches):
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                base, added = find(text or "", automaton)
                counts = [sum(s[2] == k for s in base) for k in KINDS[:4]]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                rows.append((doc_id, *counts, digest, written(base + added), hidden(text, base + added) if redact else None))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            types = [pa.int64()] * 5 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return texts(docs).mapInArrow(search, SCHEMA)


def without_personal_data(docs: DataFrame) -> DataFrame:
    """All rows and columns, each span of the text replaced and n_chars, if there, counted anew."""

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = anchors()
        for batch in in_pieces(batches):
            hid = [t if t is None else hidden(t, [s for part in find(t, automaton) for s in part]) for t in batch["text"].to_pylist()]
            new = {"text": hid, "n_chars": [t if t is None else len(t) for t in hid]}
            columns = [pa.array(new[f.name], f.type) if f.name in new else batch[f.name] for f in batch.schema]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(redact, docs.schema)


def hidden(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with overlapping spans merged and each replaced by its first kind in brackets."""
    if not spans:
        return text
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]))):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def op5_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"), redact=False).drop("redacted")


SQL = None
