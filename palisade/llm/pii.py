"""Personal data: patterns propose spans, check digits confirm them, nearby words move the score.

Kinds: email, ip, card (Luhn), phone, iban (mod 97) and ssn (three digit groups whose values can occur). Every proposal
starts from the prior of its kind; a passed check digit adds to it, a word of the kind's list within ``near`` code
points before it adds again, a word of the counter list takes away. The four base kinds are always reported; other
kinds are reported when their score reaches ``least``.

Matches are leftmost and do not overlap within a kind; a match that fails its check is dropped and not retried. Scans
are linear in the text: a pattern starts only at the character it cannot do without. NULL texts count as empty and
give zero counts and empty strings; repeated rows are judged alike; an empty table gives an empty table; columns other
than the two named ones are left out.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from palisade.llm.common import query, table

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.4, "ssn": 0.4}
CHECKED, NEARBY, COUNTER = 0.4, 0.2, 0.3
CONTEXT = {
    "email": ("mail", "contact", "write to"), "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "credit", "payment"), "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto"), "ssn": ("ssn", "social security", "taxpayer"),
}
COUNTER_WORDS = ("example", "sample", "version", "order no", "isbn", "part number")
NEAR, LEAST = 40, 0.6


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def mod97(text: str) -> bool:
    compact = text.replace(" ", "")
    moved = compact[4:] + compact[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str):
    """Spans of the email pattern: from each @ leftwards over the local part, then forwards over the domain."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end(), False
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def proposals(text: str):
    """(kind, start, end, checked) of everything that passes its own check."""
    if "@" in text:
        for start, end, checked in emails(text):
            yield "email", start, end, checked
    if not DIGIT.search(text):
        return
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                yield "ip", *m.span(), False
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", *m.span(), True
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", *m.span(), False
    for m in IBAN.finditer(text):
        if mod97(m[0]):
            yield "iban", *m.span(), True
    for m in SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "ssn", *m.span(), False


def scored(text: str, near: int = NEAR, least: float = LEAST):
    """(kind, start, end, score) by start, then kind; kinds beyond the base ones need the least score."""
    found = []
    for kind, start, end, checked in proposals(text):
        before = text[max(0, start - near):start].lower()
        score = PRIOR[kind] + CHECKED * checked + NEARBY * any(w in before for w in CONTEXT[kind])
        score -= COUNTER * any(w in before for w in COUNTER_WORDS)
        score = round(min(1.0, max(0.0, score)), 3)
        if kind in BASE or score >= least:
            found.append((kind, start, end, score))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", near: int = NEAR, least: float = LEAST) -> DataFrame:
    """doc_id and ``found``: array of (kind, start, end, score), code points, end exclusive."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scan(batches):
        for batch in batches:
            spans = [
                [dict(zip(("kind", "start", "end", "score"), s)) for s in scored(t, near, least)]
                for t in batch.column(1).to_pylist()
            ]
            yield pa.record_batch([batch.column(0), pa.array(spans, kind)], names=["doc_id", "found"])

    return rows.mapInArrow(scan, "doc_id long, found array<struct<kind: string, start: long, end: long, score: double>>")


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op8_pii")
def op8(spark, sf_dir):
    """Personal data of every document: counts and digest of the base kinds, and all spans."""
    found = personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *(count(k) for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
