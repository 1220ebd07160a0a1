"""Personal data by anchor expansion: an Aho-Corasick automaton finds cues, local parsers expand and validate spans.

Base kinds: email, ip, card, phone. Added kinds: account (an identifier after a cue such as "iban" or "passport") and
userinfo (name and password before the host of a URL)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import compact, lean, ship

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "userinfo")

#: Cues of an identifier that follows; matched in any case, as whole words.
CUES = ("iban", "account no", "account number", "passport", "ssn", "social security number", "tax id")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IDENTIFIER = re.compile(r"[ \t]{0,3}(?:(?:is|no\.?|number)[ \t]{1,3})?[:#=]?[ \t]{0,3}([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){5,40})")
_USERINFO = re.compile(r"[A-Za-z0-9._%+-]+:[^\s/@:]+(?=@[A-Za-z0-9])")


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for d in "0123456789":
        found.add_word(d, ("digit", 1))
    found.add_word("@", ("at", 1))
    found.add_word("+", ("plus", 1))
    found.add_word("://", ("scheme", 3))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(form, ("cue", len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _iban(text: str) -> bool:
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", text):
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def _account(text: str, start: int, cue_end: int) -> tuple[int, int] | None:
    """The identifier after a cue: a valid IBAN, or letters and digits with at least six digits."""
    if (start and text[start - 1].isalnum()) or (cue_end < len(text) and text[cue_end].isalnum()):
        return None
    m = _IDENTIFIER.match(text, cue_end)
    if not m:
        return None
    lo, parts = m.start(1), re.split(r"[ -]", m[1])
    if text[start:cue_end].lower() == "iban":
        for k in range(len(parts), 0, -1):
            if _iban("".join(parts[:k])):
                return lo, lo + sum(map(len, parts[:k])) + k - 1
        return None
    k = 0
    while k < len(parts) and any(c.isdigit() for c in parts[k]):
        k += 1
    if sum(c.isdigit() for c in "".join(parts[:k])) < 6:
        return None
    return lo, lo + sum(map(len, parts[:k])) + k - 1


def find_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans in code points by kind, each kind leftmost and without overlaps."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE, *ADDED)}
    email = ip = card = phone = account = 0
    for last, (what, length) in automaton().iter(text):
        at = last - length + 1
        if what == "digit":
            if at >= ip:
                ip = _DOTTED.match(text, at).end()
                runs, places = text[at:ip].split("."), [at]
                for r in runs:
                    places.append(places[-1] + len(r) + 1)
                for k in range(0, len(runs) - 3, 4):
                    if all(len(r.lstrip("0")) <= 3 and int(r.lstrip("0") or 0) <= 255 for r in runs[k : k + 4]):
                        found["ip"].append((places[k], places[k + 4] - 1))
            if at >= card:
                m = _DIGITS.match(text, at)
                card = m.end() if m else at + 1
                if m:
                    digits = m[0].replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
        elif what == "at":
            lo = at
            while lo > email and text[lo - 1] in _LOCAL:
                lo -= 1
            if lo < at and (m := _DOMAIN.match(text, at + 1)):
                email = m.end()
                found["email"].append((lo, email))
        elif what == "plus":
            if at >= phone and (m := _PHONE.match(text, at)):
                phone = m.end()
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found["phone"].append(m.span())
        elif what == "scheme":
            if m := _USERINFO.match(text, last + 1):
                found["userinfo"].append(m.span())
        elif at >= account and (span := _account(text, at, last + 1)):
            account = span[1]
            found["account"].append(span)
    return found


def described(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in found[k])


def redact(text: str, found: dict[str, list[tuple[int, int]]]) -> str:
    """text with each run of overlapping spans replaced by the kind of its first one, as [EMAIL]."""
    spans = sorted((a, -b, k) for k, s in found.items() for a, b in s)
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, -b)
    return "".join([*out, text[at:]])


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base kinds, base_sha256, spans, and the redacted text, for each row of docs (doc_id, text).

    A null text is empty and stays null when redacted; a null doc_id stays null; other columns are ignored; repeated rows are
    reported each; an empty table gives an empty one."""
    ship(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            rows = []
            for text in (x.as_py() for x in batch.column(1)):
                found = find_spans(text or "")
                base = described(found, BASE)
                rows.append((*(len(found[k]) for k in BASE), hashlib.sha256(base.encode()).hexdigest(), described(found, (*BASE, *ADDED)), redact(text, found) if text else text))
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[*"doc_id n_email n_ip n_card n_phone base_sha256 spans redacted".split()])

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"
    return compact(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(scan, schema)


def redacted_documents(docs: DataFrame) -> DataFrame:
    """docs, all its columns, with its text redacted, and n_chars, where there is such a column, its new length.

    A null text stays null, an empty one empty; repeated rows are redacted each; an empty table stays empty."""
    ship(docs.sparkSession)

    @F.arrow_udf("string")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lean()
        for some in texts:
            yield pa.array([redact(t, find_spans(t)) if t else t for t in (x.as_py() for x in some)], pa.string())

    out = compact(docs).withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out
