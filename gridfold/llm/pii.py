"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust a score.

The score starts from the kind's own, rises with a context word of the kind nearby, and falls with a word that speaks
against it, such as "example" or "version". The base kinds (email, ip, card, phone) are reported whenever their
pattern and check hold; the score says how sure that is. The kinds that the method adds (iban,
card_group, national_id) are reported only at a score of at least LEAST_SCORE.
"""

from __future__ import annotations

import re
import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridfold.llm.common import replace_columns

KINDS = ("email", "ip", "card", "phone", "iban", "card_group", "national_id")
BASE = KINDS[:4]
LEAST_SCORE = 0.6
#: Code points before and after a span in which context words count.
NEARBY = 60
#: Score by pattern and check alone, and words that raise it by CONTEXT. Fixed values.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "card_group": 0.7, "national_id": 0.4}
CONTEXT = 0.25
CONTEXT_WORDS = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "card_group": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "national_id": ("ssn", "social security", "national id", "sozialversicherung"),
}
#: Words that lower the score by CONTEXT. Fixed values.
DOUBT_WORDS = ("example", "sample", "dummy", "placeholder", "version", "isbn", "issn", "part number", "serial")
#: Lengths of IBANs by country. Fixed values.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28,
    "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24, "SI": 19, "SK": 24,
}

_LOCAL = string.ascii_letters + string.digits + "._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its start fails from within as well, so the runs are taken whole.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(IBAN_LENGTHS) + r")[0-9]{2}(?= ?[A-Z0-9])")
_GROUPS = re.compile(r"(?<![0-9])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])")
_NATIONAL = re.compile(r"(?<![0-9A-Za-z-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9A-Za-z-])")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, less 9 where over 9; the sum ends in 0."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The first four characters moved to the end, letters as 10 to 35; the remainder by 97 is 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches found from each @ outwards: the run of local characters before it, and the domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        local = text[free:at]
        kept = len(local) - len(local.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if kept else None
        if domain:
            yield at - kept, domain.end()
        free = domain.end() if domain else at + 1
        at = text.find("@", free)


def base_spans(text: str) -> Iterator[tuple[str, int, int]]:
    if "@" in text:
        for start, end in emails(text):
            yield "email", start, end
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()


def _letter_or_digit(c: str) -> bool:
    return c.isascii() and c.isalnum()


def _iban_end(text: str, start: int) -> int | None:
    """End of a confirmed IBAN that starts here: its country's length in capitals and digits, with single spaces between, up to a word's end."""
    length = IBAN_LENGTHS[text[start : start + 2]]
    taken, end = "", start
    while len(taken) < length:
        c = text[end : end + 1]
        if c == " " and text[end - 1] != " ":
            end += 1
            continue
        if not _letter_or_digit(c) or c.islower():
            return None
        taken, end = taken + c, end + 1
    return end if not _letter_or_digit(text[end : end + 1]) and mod97(taken) else None


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """Each country code starts a candidate of that country's length; the search goes on from the end of a confirmed one."""
    m = _IBAN.search(text)
    while m:
        end = _iban_end(text, m.start())
        if end:
            yield m.start(), end
        m = _IBAN.search(text, end or m.start() + 1)


def added_spans(text: str, base: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    if not _DIGIT.search(text):
        return
    for start, end in ibans(text):
        yield "iban", start, end
    cards = [(a, b) for kind, a, b in base if kind == "card"]
    for m in _GROUPS.finditer(text):
        if luhn(_digits(m[0])) and not any(a < m.end() and m.start() < b for a, b in cards):
            yield "card_group", m.start(), m.end()
    for m in _NATIONAL.finditer(text):
        yield "national_id", m.start(), m.end()


def _any_of(words: tuple[str, ...]) -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(map(re.escape, words)) + ")")


_CONTEXT, _DOUBT = {kind: _any_of(words) for kind, words in CONTEXT_WORDS.items()}, _any_of(DOUBT_WORDS)


def score(text: str, kind: str, start: int, end: int) -> float:
    """From 0 to 1. The words beside a span are read within NEARBY code points; the span's own text doesn't count."""
    near = (text[max(0, start - NEARBY) : start] + " \n " + text[end : end + NEARBY]).lower()
    made = SCORES[kind] + CONTEXT * bool(_CONTEXT[kind].search(near)) - CONTEXT * bool(_DOUBT.search(near))
    return round(min(1.0, max(0.0, made)), 2)


def spans_of(text: str) -> list[dict]:
    """All spans of a text, by kind as in KINDS, then start; offsets in code points, end exclusive."""
    base = list(base_spans(text))
    scored = [(*s, score(text, *s)) for s in (*base, *added_spans(text, base))]
    kept = [s for s in scored if s[0] in BASE or s[3] >= LEAST_SCORE]
    kept.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
    return [dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in kept]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def find(df: DataFrame, text_col: str = "text", spans_col: str = "spans", of: Callable[[str], list[dict]] = spans_of) -> DataFrame:
    """`df` with `spans_col`, an array of (kind, start, end, score) of each whole text.

    A null or empty text has no spans. Each row is scanned by itself, so repeated rows and nulls in
    other columns change nothing. An input column named `spans_col` is replaced; others pass through.
    """
    df = df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() != spans_col.lower()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col))
            found = pa.array([of(x.as_py() or "") for x in texts], _ARROW)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, spans_col])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(spans_col, SPANS)]))


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """`df` with each span of `text_col` replaced by its kind in brackets; of overlapping spans, the one that starts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index(text_col)
            yield batch.set_column(k, batch.schema.field(k), pa.array([None if x.as_py() is None else _redacted(x.as_py()) for x in batch.column(k)], batch.schema.field(k).type))

    return df.mapInArrow(run, df.schema)


def _redacted(text: str) -> str:
    parts, done = [], 0
    for s in sorted(spans_of(text), key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= done:
            parts += [text[done : s["start"]], f"[{s['kind'].upper()}]"]
            done = s["end"]
    return "".join([*parts, text[done:]])


def spans_text(spans: Column) -> Column:
    """kind:start:end of the spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(spans_col: str, kind: str) -> Column:
    return F.size(F.filter(spans_col, lambda s: s["kind"] == kind)).cast("long")


def with_digests(found: DataFrame, spans_col: str = "spans") -> DataFrame:
    """The number of spans of each kind and of all, base_sha256, the spans as a string, and their scores in the same order."""
    base = F.filter(spans_col, lambda s: s["kind"].isin(*BASE))
    counts = {f"n_{kind}": _count(spans_col, kind) for kind in KINDS}
    scores = F.array_join(F.transform(spans_col, lambda s: F.format_string("%.2f", s["score"])), ",")
    return replace_columns(found, counts | {"base_sha256": F.sha2(spans_text(base), 256), "n_spans": F.size(spans_col).cast("long"), "scores": scores, spans_col: spans_text(F.col(spans_col))})
