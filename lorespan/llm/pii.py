"""Personal data by anchor expansion.

One Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, schemes and words
that announce an identifier. At each anchor a small parser expands over the characters its
kind allows, bounds the candidate and validates it. ``email``, ``ip``, ``card`` and ``phone``
are the base kinds; ``url``, ``iban`` and ``account`` come from schemes and cues.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorespan.llm.common import ROW_BATCH_BYTES, bounded_batches, forget, map_texts, table

# Kinds in the order in which they are listed, schemes, cues.
KINDS = ("email", "ip", "card", "phone", "url", "iban", "account")
BASE = KINDS[:4]
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:")
CUES = ("iban", "account", "acct", "ssn", "passport", "routing", "tax id", "customer id", "konto", "cuenta", "compte")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DOTTED_RUN = re.compile(r"[0-9.]+")
_DIGIT_RUN = re.compile(r"[0-9 -]+")
_URL = re.compile(r"[^\s<>\"'|]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
_IDENTIFIER = re.compile(r"[ \t]*(?i:number|no\.?|nr\.?|id)?[ \t]*[:#=]?[ \t]*([A-Z0-9][A-Z0-9-]{5,33})(?![A-Za-z0-9])")
_WORD = re.compile(r"[A-Za-z0-9]")
_LEAD = re.compile(r"[ \t:#=]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def iban_valid(text: str) -> bool:
    """Length and the check digits modulo 97."""
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


class Finder:
    """Finds spans (start, end, kind) of one text at a time; start and end in code points."""

    def __init__(self):
        import ahocorasick

        anchors = ahocorasick.Automaton()
        for c in "@+0123456789":
            anchors.add_word(c, (c, 1))
        for s in SCHEMES:
            anchors.add_word(s, ("scheme", len(s)))
        for c in CUES:
            anchors.add_word(c, ("cue", len(c)))
        anchors.make_automaton()
        self.anchors = anchors

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        """Base spans as the base expressions match, leftmost and without overlap in each kind; then those of the method."""
        found: list[tuple[int, int, str]] = []
        email_end = ip_end = card_end = url_end = cue_end = 0
        lowered = text.lower() if not text.isascii() else None
        if lowered is None:
            scanned = text.lower()
        else:  # lower-casing may change lengths: only A to Z, then
            scanned = lowered if len(lowered) == len(text) else re.sub("[A-Z]", lambda m: m[0].lower(), text)
        for last, (what, size) in self.anchors.iter(scanned):
            at = last + 1 - size
            if what == "@":
                start = at
                while start > email_end and text[start - 1] in _LOCAL:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    email_end = m.end()
                    found.append((start, email_end, "email"))
            elif what == "+":
                if m := _PHONE.match(text, at):
                    if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                        found.append((at, m.end(), "phone"))
            elif what == "scheme":
                if at >= url_end and (m := _URL.match(text, at + size)):
                    url_end = m.end() - (len(m[0]) - len(m[0].rstrip(".,;:!?)]}")))
                    if url_end > at + size:
                        found.append((at, url_end, "url"))
            elif what == "cue":
                bounded = not (at and _WORD.match(text, at - 1)) and not _WORD.match(text, last + 1)
                if at < cue_end or not bounded:
                    continue
                lead = _LEAD.match(text, last + 1).end()
                if (m := _IBAN.match(text, lead)) and (end := _iban_end(m[0])):
                    cue_end = lead + end
                    found.append((lead, cue_end, "iban"))
                elif (m := _IDENTIFIER.match(text, last + 1)) and sum(c.isdigit() for c in m[1]) >= 5:
                    cue_end = m.end(1)
                    found.append((m.start(1), cue_end, "account"))
            else:  # a digit opens the run of characters an address or a card can have; each run is parsed once
                if at >= ip_end:
                    run = _DOTTED_RUN.match(text, at)
                    ip_end = run.end()
                    if run[0].count(".") >= 3:
                        for m in _IP.finditer(text, at, ip_end):
                            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                                found.append((m.start(), m.end(), "ip"))
                if at >= card_end:
                    card_end = _DIGIT_RUN.match(text, at).end()
                    if card_end - at >= 12:
                        for m in _CARD.finditer(text, at, card_end):
                            digits = m[0].replace(" ", "").replace("-", "")
                            if 12 <= len(digits) <= 19 and luhn(digits):
                                found.append((m.start(), m.end(), "card"))
        order = {k: i for i, k in enumerate(KINDS)}
        found.sort(key=lambda s: (s[0], order[s[2]], s[1]))
        return found


def _iban_end(text: str) -> int:
    """End of the longest valid number at the start of a candidate, or 0."""
    for end in range(len(text), 14, -1):
        if text[end - 1] != " " and iban_valid(text[:end]):
            return end
    return 0


def joined(spans: list[tuple[int, int, str]], kinds: tuple[str, ...] = KINDS) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans if k in kinds)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Text with each span, or each run of overlapping spans, replaced by the kind of its first one in brackets."""
    out, at = [], 0

    merged: list[list] = []
    for a, b, k in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    for a, b, k in merged:
        out += [text[at:a], f"[{k.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


_finder: list[Finder] = []


def _shared() -> Finder:
    if not _finder:
        _finder.append(Finder())
    return _finder[0]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of personal data in every whole text.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_other and redacted (the text
    with every span replaced), one row per row of ``docs``. Null and empty texts have no spans (the
    hash is that of the empty string, ``redacted`` is empty). Spans of one start stand in the order of KINDS.
    """

    def compute(texts: list[str]) -> list:
        finder, rows = _shared(), []
        for text in texts:
            spans = finder.spans(text)
            base = [s for s in spans if s[2] in BASE]
            rows.append(([sum(s[2] == k for s in base) for k in BASE], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(base), redact(text, spans)))
        return [*([r[0][i] for r in rows] for i in range(4)), *([r[i] for r in rows] for i in (1, 2, 3, 4))]

    fields = [*((f"n_{k}", "long") for k in BASE), ("base_sha256", "string"), ("spans", "string"), ("n_other", "long"), ("redacted", "string")]
    return map_texts(docs, compute, fields, id_col, text_col)


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced in its text and ``length_col`` (if it has one) set to the new length.

    All other columns stay as they are. A null text stays null; texts without spans are unchanged.
    """
    from pyspark.sql.functions import pandas_udf

    bounded_batches(docs.sparkSession, ROW_BATCH_BYTES)

    @pandas_udf("string")
    def clean(texts):
        forget()
        finder = _shared()
        return texts.map(lambda t: None if t is None else redact(t, finder.spans(t)))

    out = docs.withColumn(text_col, clean(F.col(text_col).cast("string")))
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents")).drop("redacted")
