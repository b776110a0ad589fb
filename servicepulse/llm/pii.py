"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of a text: at-signs, plus signs,
digits, address schemes and words that announce an identifier.  From each
anchor a deterministic local parser walks to the boundaries of what it may be
and validates it.  Every parser reads each character a bounded number of times.

Kinds, in output order.  The first four have fixed shapes (leftmost,
non-overlapping per kind; a match that fails its check is dropped):

* ``email``  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ``ip``     four digit groups joined by dots, each at most 255
* ``card``   digits with single spaces or hyphens between, 16 to 19, Luhn
* ``phone``  ``\\+[0-9][\\x20().0-9-]+[0-9]`` with 8 to 15 digits

The method adds two: ``link``, a web address that carries user information
before its host (scheme anchor), and ``account``, an identifier that follows a
cue such as ``iban``, ``account`` or ``token`` and a separator.
"""

from __future__ import annotations

import hashlib
import re
import string

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from servicepulse.llm.common import map_arrow, map_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "link", "account")

_DIGITS = frozenset("0123456789")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_LABEL = frozenset(string.ascii_letters + string.digits + "-")
_PHONE = frozenset(" ().-0123456789")
_WORD = frozenset(string.ascii_letters + string.digits + "_")
#: What may stand between a cue and its identifier.
_AFTER_CUE = re.compile(r"[ \t]{0,2}(?:(?:no|nr|number|id)\b\.?)?[ \t]{0,2}[:=#][ \t]{0,2}[\"']?", re.IGNORECASE)
_IDENTIFIER = re.compile(r"[A-Za-z0-9](?:[ -]?[A-Za-z0-9_])*", re.ASCII)
_COMPACT = re.compile(r"[A-Za-z0-9_-]+", re.ASCII)
_LINK = re.compile(r"[^\s/@\"'<>]+@[A-Za-z0-9.-]+(?::[0-9]+)?", re.ASCII)
CUES = ("account", "acct", "iban", "konto", "compte", "cuenta", "passport", "ssn", "token", "api_key", "apikey", "password", "secret")
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
_IBAN = frozenset(("iban",))


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    for d in "0123456789":
        a.add_word(d, ("digit", 1))
    for s in SCHEMES:
        a.add_word(s, ("link", len(s)))
    for c in CUES:
        for form in {c, c.upper(), c.capitalize()}:
            a.add_word(form, (c, len(form)))
    a.make_automaton()
    return a


def email_at(t: str, at: int, floor: int) -> tuple[int, int] | None:
    """The address around the at-sign at ``at`` that starts no earlier than ``floor``."""
    a = at
    while a > floor and t[a - 1] in _LOCAL:
        a -= 1
    n, end, dotted = len(t), at + 1, False
    while end < n and t[end] in _LABEL:
        end += 1
    if a == at or end == at + 1:
        return None
    while end + 1 < n and t[end] == "." and t[end + 1] in _LABEL:
        dotted, end = True, end + 2
        while end < n and t[end] in _LABEL:
            end += 1
    return (a, end) if dotted else None


def digit_run(t: str, a: int) -> int:
    n, end = len(t), a + 1
    while end < n and t[end] in _DIGITS:
        end += 1
    return end


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def ip_at(t: str, a: int) -> tuple[int, bool] | None:
    """From the digit at ``a``: end of the dotted groups and whether they are an address; None if fewer than four."""
    parts, at = [], a
    while True:
        end = digit_run(t, at)
        parts.append(t[at:end])
        if len(parts) == 4:
            return end, all(map(_small, parts))
        if not (end + 1 < len(t) and t[end] == "." and t[end + 1] in _DIGITS):
            return None
        at = end + 1


def card_at(t: str, a: int) -> tuple[int, str]:
    """From the digit at ``a``: end of the digits with single separators, and the digits."""
    n, end, digits = len(t), a + 1, [t[a]]
    while end < n:
        if t[end] in _DIGITS:
            end += 1
        elif t[end] in " -" and end + 1 < n and t[end + 1] in _DIGITS:
            end += 2
        else:
            break
        digits.append(t[end - 1])
    return end, "".join(digits)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def phone_at(t: str, a: int) -> tuple[int, bool] | None:
    """From the plus sign at ``a``: end of the number and whether its digits are 8 to 15; None if it is none."""
    n = len(t)
    if not (a + 1 < n and t[a + 1] in _DIGITS):
        return None
    end = a + 2
    while end < n and t[end] in _PHONE:
        end += 1
    while end > a + 3 and t[end - 1] not in _DIGITS:
        end -= 1
    if end <= a + 3 or t[end - 1] not in _DIGITS:
        return None
    return end, 8 <= sum(c in _DIGITS for c in t[a:end]) <= 15


def iban_ok(s: str) -> bool:
    """Length and remainder 1 modulo 97 of an account number (ISO 13616)."""
    if not (15 <= len(s) <= 34 and s[:2].isalpha() and s[2:4].isdigit()):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def account_after(t: str, a: int, end: int, cue: str) -> tuple[int, int] | None:
    """The identifier that follows the cue at ``a:end``, at a word boundary and after a separator."""
    if (a and t[a - 1] in _WORD) or (end < len(t) and t[end] in _WORD):
        return None
    sep = _AFTER_CUE.match(t, end)
    if not sep:
        return None
    if cue in _IBAN:
        m = _IDENTIFIER.match(t, sep.end(), sep.end() + 48)
        # The longest beginning, group by group, that is an account number.
        cut = m.end() if m else 0
        while m and cut > m.start():
            if iban_ok(re.sub(r"[ -]", "", t[m.start() : cut]).upper()):
                return m.start(), cut
            cut = max(t.rfind(" ", m.start(), cut), t.rfind("-", m.start(), cut))
        return None
    m = _COMPACT.match(t, sep.end())
    if not m or m.end() - m.start() < 6 or not any(c in _DIGITS for c in m[0]):
        return None
    return m.start(), m.end()


def find(t: str, anchors: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """All spans of a text (code points, end exclusive) by kind, in order of their start."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    email = phone = ip = card = account = link = 0  # where the next match of the kind may begin
    for last, (kind, size) in anchors.iter(t):
        a, end = last - size + 1, last + 1
        if kind == "digit":
            if a >= card:
                card, digits = card_at(t, a)
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out["card"].append((a, card))
            if a >= ip:
                m = ip_at(t, a)
                ip = m[0] if m else digit_run(t, a)
                if m and m[1]:
                    out["ip"].append((a, m[0]))
        elif kind == "email":
            m = email_at(t, a, email)
            if m:
                out["email"].append(m)
                email = m[1]
        elif kind == "phone":
            m = phone_at(t, a) if a >= phone else None
            if m:
                phone = m[0]
                if m[1]:
                    out["phone"].append((a, m[0]))
        elif kind == "link":
            m = _LINK.match(t, end) if a >= link else None
            if m:
                link = m.end()
                out["link"].append((a, link))
        else:
            m = account_after(t, a, end, kind) if a >= account else None
            if m:
                account = m[1]
                out["account"].append(m)
    return out


def joined(spans: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in kinds for a, b in spans[k])


def masked(t: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for a, b, k in sorted((a, -b, k) for k in KINDS for a, b in spans[k]):
        b = -b
        if a >= at:
            out += [t[at:a], f"<{k}>"]
        at = max(at, b)
    return "".join([*out, t[at:]]) if out else t


def scan(docs: DataFrame, mask: bool = False) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_link, n_account, base_sha256, spans for every row of ``docs``.

    Whole texts are read; null counts as empty, which has no spans.  A null
    doc_id stays null and repeated rows are each returned; other columns are
    ignored.  With ``mask`` a column ``masked`` holds the text with the spans
    replaced (null for a null text).
    """

    def run(cols, anchors):
        texts = cols["text"].to_pylist()
        found = [find(t or "", anchors) for t in texts]
        out = {f"n_{k}": pa.array([len(f[k]) for f in found], pa.int64()) for k in KINDS}
        out["doc_id"] = cols["doc_id"]
        out["base_sha256"] = [hashlib.sha256(joined(f, BASE).encode()).hexdigest() for f in found]
        out["spans"] = [joined(f, KINDS) for f in found]
        out["masked"] = [t and masked(t, f) for t, f in zip(texts, found)] if mask else None
        return out

    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string" + ", masked string" * mask
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(src, run, schema, automaton)


def mask_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data in ``text`` replaced; all other columns and rows as they are."""
    schema = docs.schema
    at = schema.names.index("text")

    def run(batches):
        anchors = automaton()
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                b = whole.slice(i, 1000)
                text = pa.array([t and masked(t, find(t, anchors)) for t in b.column(at).to_pylist()], b.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([text if j == at else c for j, c in enumerate(b.columns)], schema=b.schema)

    return map_arrow(docs, run, schema)
