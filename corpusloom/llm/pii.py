"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text in one pass: at-signs,
plus signs, schemes, digits and the cue words of identifiers.  From each anchor
a small deterministic parser expands to the left and right, fixes the boundary
and validates what it found.  No pattern is tried where no anchor stands.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: In the order of the listing; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "account", "address")
#: Cue words of identifiers and secrets (fixed values, matched in any case).
CUES = (
    "account", "acct", "api_key", "apikey", "bearer", "iban", "konto", "license_key", "passport",
    "passwd", "password", "passwort", "secret", "sort code", "ssn", "swift", "tax id", "token",
)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_NUMBER = re.compile(r"[0-9](?:[ -]?[0-9])+")
_QUAD = re.compile(r"[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_DIGITS = re.compile(r"[0-9]+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Words between a cue and its value, in any case; only the lower-case ones may touch the digits ("NO93" begins an IBAN).
_FILLER = r"(?:(?i:no\.|(?:no|number|is|id)(?![A-Za-z0-9]))|(?:no|number|is|id)(?=[0-9]))"
_VALUE = re.compile(rf"(?:[ \t]*+(?:[:=#][ \t]*+)?{_FILLER})*[ \t]*+(?:[:=#][ \t]*+)?[\"']?([A-Za-z0-9][A-Za-z0-9_./+-]*[A-Za-z0-9])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
_URL = re.compile(r"://(?:[^\s\"'<>/@]+@)?[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s\"'<>]*)?")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")

SPANS = "array<struct<kind:string,start:long,end:long>>"


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for anchor in ("@", "+", "://", *"0123456789"):
        found.add_word(anchor, ("0" if anchor.isdigit() else anchor, len(anchor)))
    for cue in CUES:
        found.add_word(cue, ("cue", len(cue)))
    found.make_automaton()
    return found


def _folded(text: str) -> str:
    """``text`` in lower case, character by character, so that places stay the same."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x) == 1 else c for c in text for x in (c.lower(),))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _iban_ok(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


class PiiFinder:
    """Finds the spans of one text after another; ends are exclusive, in code points."""

    def __init__(self):
        self.anchors = _automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        found: dict[str, list[tuple[str, int, int]]] = {k: [] for k in KINDS}
        # where the next match of each kind may begin
        email = number = quad = phone = account = address = 0
        for last, (anchor, size) in self.anchors.iter(_folded(text)):
            at = last - size + 1
            if anchor == "0":
                if at >= number:
                    match = _NUMBER.match(text, at)
                    number = match.end() if match else at + 1
                    if match and 13 <= len(digits := re.sub("[ -]", "", match[0])) <= 19 and luhn(digits):
                        found["card"].append(("card", at, number))
                if at >= quad:
                    match = _QUAD.match(text, at)
                    quad = match.end() if match else _DIGITS.match(text, at).end()
                    if match and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in match[0].split(".")):
                        found["ip"].append(("ip", at, quad))
            elif anchor == "@":
                start = at
                while start > email and text[start - 1] in _LOCAL:
                    start -= 1
                match = _DOMAIN.match(text, at + 1) if start < at else None
                if match:
                    email = match.end()
                    found["email"].append(("email", start, email))
            elif anchor == "+":
                match = _PHONE.match(text, at) if at >= phone else None
                if match:
                    phone = match.end()
                    if 9 <= sum(c.isdigit() for c in match[0]) <= 15:
                        found["phone"].append(("phone", at, phone))
            elif anchor == "://":
                start = at
                while start > address and text[start - 1] in _SCHEME:
                    start -= 1
                while start < at and not (text[start].isascii() and text[start].isalpha()):
                    start += 1
                match = _URL.match(text, at) if start < at else None
                if match:
                    address = at + len(match[0].rstrip(".,;:!?)"))
                    found["address"].append(("address", start, address))
            elif at >= account and not (at and text[at - 1].isalnum()) and not text[last + 1 : last + 2].isalpha():
                span = self._account(text, last + 1)
                if span:
                    account = span[1]
                    found["account"].append(("account", *span))
        return [s for kind in KINDS for s in found[kind]]

    @staticmethod
    def _account(text: str, at: int) -> tuple[int, int] | None:
        """The identifier after a cue: an IBAN that checks, or a value with at least four digits."""
        match = _VALUE.match(text, at)
        if not match:
            return None
        iban = _IBAN.match(text, match.start(1))
        if iban and _iban_ok(iban[0]):
            return iban.span()
        value = match[1]
        return match.span(1) if len(value) >= 6 and sum(c.isdigit() for c in value) >= 4 else None


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``spans``, an array of ``(kind, start, end)``, for every row.

    Spans are in the order of ``KINDS``, then by start.  Null and empty texts have
    an empty array; null ids and repeated rows stay; an empty table gives an empty
    result; further columns are ignored.
    """

    def run(batches):
        finder = PiiFinder()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in finder.spans(t or "")] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["id", "spans"])

    picked = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, f"id long, spans {SPANS}").withColumnRenamed("id", id_col)


def count_of(spans, kind: str):
    """How many spans are of this kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def listing(spans, kinds: tuple[str, ...] = KINDS):
    """``kind:start:end`` of the spans of these kinds, comma-joined."""
    kept = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact_text(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Write ``[KIND]`` for every span; of spans that overlap the first, longest counts."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
            at = end
        elif end > at:
            at = end
    return "".join([*out, text[at:]])


def redact_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every span in ``text_col`` written as ``[KIND]``; a null text stays null.

    All rows, and all other columns, are as they were.
    """

    def run(batches):
        finder = PiiFinder()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [t if t is None else redact_text(t, finder.spans(t)) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, text_col, pa.array(texts, pa.string()))

    return df.mapInArrow(run, df.schema)
