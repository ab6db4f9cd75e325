"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, scheme marks
and identifier cues. Around each anchor a deterministic local parser expands the
boundaries and validates what it finds. For the four base kinds the parsers yield the
leftmost non-overlapping matches of these patterns:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)   parts at most 255
    card   [0-9]([\\x20-]?[0-9])+                     13 to 19 digits, Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9]               9 to 15 digits

and drop those that fail validation. Further kinds: ``url`` (a scheme with user
information before the host), ``account`` (a cue word, then an identifier of 6 to 34
letters and digits with at least 6 digits; after "iban" its check digits must hold)
and ``secret`` (a cue word, an equals sign or colon, then at least 20 key characters
with both letters and digits).

Defined cases: a null or empty text has no spans; repeated rows get equal results;
null ids stay null; further columns pass through ``redact`` and are ignored by ``find``.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lumidisc.llm.common import ids_and_texts, in_batches, session

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret")
SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint"

# Cue words.
ACCOUNT_CUES = ("iban", "account number", "account no", "acct", "ssn", "social security number", "passport number", "customer id")
SECRET_CUES = ("token", "secret", "password", "api_key", "apikey", "access_key")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_RUN = re.compile(r"[0-9]+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*\Z")
_USER_URL = re.compile(r"://[^\s/@?#]+@[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"'<>]*)?")
_ACCOUNT = re.compile(r"[\s:#.=]{1,4}([A-Za-z0-9](?:[ -]?[A-Za-z0-9]){5,33})(?![A-Za-z0-9])")
_SECRET = re.compile(r"\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_+/.-]{20,}=*)")
#: A-Z in lower case: cues are found in any case, and places stay.
_FOLD = {c: c + 32 for c in range(65, 91)}
# The characters beyond ASCII whose lower case is two characters or ASCII.
_ODD = re.compile("[\u0130\u212a]")
_NOT_DIGIT = re.compile(r"[^0-9]")


@lru_cache(1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for kind, cues in (("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for cue in cues:
            a.add_word(cue, (kind, len(cue)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def iban(text: str) -> bool:
    compact = re.sub(r"[ -]", "", text).upper()
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", compact)) and int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def folded(text: str) -> str:
    """With A-Z in lower case; other characters may change too, but never to ASCII, and places stay."""
    return text.translate(_FOLD) if _ODD.search(text) else text.lower()


def find_spans(text: str) -> list[tuple[int, int, int]]:
    """(index in KINDS, start, end) by kind, then start; code points, end exclusive."""
    found: list[tuple[int, int, int]] = []
    email_end = ip_end = card_end = phone_end = run_end = url_end = account_end = secret_end = 0
    for last, (kind, width) in automaton().iter(folded(text)):
        if kind == "digit":
            if last < run_end:
                continue
            run_end = _RUN.match(text, last).end()
            if last >= ip_end and (m := _IP.match(text, last)):
                ip_end = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                    found.append((1, last, ip_end))
            if last >= card_end and (m := _CHAIN.match(text, last)):
                card_end = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found.append((2, last, card_end))
        elif kind == "at":
            start = last
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                email_end = m.end()
                found.append((0, start, email_end))
        elif kind == "plus":
            if last >= phone_end and (m := _PHONE.match(text, last)):
                phone_end = m.end()
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    found.append((3, last, phone_end))
        elif kind == "scheme":
            start = last - 2
            if start >= url_end and (head := _SCHEME.search(text, max(url_end, start - 32), start)) and (m := _USER_URL.match(text, start)):
                url_end = m.end()
                found.append((4, head.start(), url_end))
        elif last - width >= 0 and text[last - width].isalnum():
            continue  # a cue inside a word
        elif kind == "account":
            if (m := _ACCOUNT.match(text, last + 1)) and m.start(1) >= account_end:
                value = m[1]
                if "iban" in text[last - width + 1 : last + 1].lower():
                    while value and not iban(value):
                        value = value.rpartition(" ")[0]
                else:
                    value = value if sum(c.isdigit() for c in value.split(" ")[0]) >= 6 else ""
                    value = value.split(" ")[0]
                if value:
                    account_end = m.start(1) + len(value)
                    found.append((5, m.start(1), account_end))
        elif (m := _SECRET.match(text, last + 1)) and m.start(1) >= secret_end and re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1]):
            secret_end = m.end(1)
            found.append((6, m.start(1), secret_end))
    found.sort()
    return found


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{a}:{b}" for kind, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans, for every document."""

    def work(batch: pa.RecordBatch) -> dict:
        counts = np.zeros((batch.num_rows, len(KINDS)), np.int64)
        digests, spans = [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            found = find_spans(text) if text else []
            for kind, _, _ in found:
                counts[i, kind] += 1
            digests.append(hashlib.sha256(joined([s for s in found if s[0] < len(BASE)]).encode()).hexdigest())
            spans.append(joined(found))
        return {"doc_id": batch.column("doc_id"), **{f"n_{kind}": counts[:, i] for i, kind in enumerate(BASE)}, "base_sha256": digests, "spans": spans, "n_added": counts[:, len(BASE) :].sum(1)}

    return in_batches(ids_and_texts(docs), work, SCHEMA)


def redacted(text: str) -> str:
    """The text with each span, or run of spans that overlap, replaced by the kind of the first in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(find_spans(text), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[kind].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame) -> DataFrame:
    """All columns, with spans in ``text`` replaced; n_chars, if there, follows the new text."""
    session(docs)

    @F.arrow_udf(StringType())
    def clean(column: pa.Array) -> pa.Array:
        return pa.array([redacted(t) if t else t for t in column.to_pylist()], pa.string())

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
