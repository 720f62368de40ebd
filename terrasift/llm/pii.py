"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, a plus
before a digit, two digits with or without a separator, URL schemes and identifier
cues. A deterministic parser expands each anchor to the whole item and validates it.

Base kinds follow patterns whose matches are leftmost and do not overlap within a
kind: email, ip (four parts of at most 255), card (16 to 19 digits, Luhn), phone
(8 to 15 digits). Matches that fail their test are dropped without another try.
Further kinds are added and never replace a base span: url, iban (mod 97), ssn and
account, the last three only after a cue word.

Spans are code points, end exclusive. Null and empty texts have no spans. The work is
row-local: no shuffle, and a text costs time in proportion to its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "ssn", "account")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_URL = re.compile(r"[A-Za-z]+://[A-Za-z0-9.-]+(?::[0-9]+)?(?:[/?#][^\s<>\"'`]*)?")
_AFTER_CUE = r"(?:[ ]?(?:no|nr|number|num|code))?[.:#= ]{0,3}"
_IBAN = re.compile(_AFTER_CUE + r"([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])", re.ASCII)
_SSN = re.compile(_AFTER_CUE + r"([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
_ACCOUNT = re.compile(_AFTER_CUE + r"([0-9][0-9-]{4,18}[0-9])(?![0-9])", re.IGNORECASE)
#: Schemes and cue words, matched in lower, upper and title case.
_SCHEMES = ("http://", "https://", "ftp://")
_CUES = {"iban": "iban", "ssn": "ssn", "social security": "ssn", "account": "account", "acct": "account"}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) << (i & 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _byte_part(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _automaton():
    import ahocorasick

    auto, digits = ahocorasick.Automaton(), "0123456789"
    # several anchors never share a string, so each carries one (kind, length)
    auto.add_word("@", ("email", 1))
    for a in digits:
        auto.add_word("+" + a, ("phone", 2))
        for b in digits:
            auto.add_word(f"{a}.{b}", ("ip", 3))
            for sep in ("", " ", "-"):
                auto.add_word(a + sep + b, ("card", 2 + len(sep)))
    for s in _SCHEMES:
        for form in {s, s.upper(), s.capitalize()}:
            auto.add_word(form, ("url", len(form)))
    for cue, kind in _CUES.items():
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            auto.add_word(form, (kind, len(form)))
    auto.make_automaton()
    return auto


class PiiFinder:
    def __init__(self):
        self.auto = _automaton()

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end), by kind as listed, then start."""
        found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
        over = dict.fromkeys(KINDS, 0)  # where the last match of a kind, kept or dropped, ends
        for last, (kind, width) in self.auto.iter(text):
            start = last + 1 - width
            if start >= over[kind]:
                getattr(self, "_" + kind)(text, start, last + 1, found[kind], over)
        return [(k, a, b) for k in KINDS for a, b in found[k]]

    def _email(self, text, at, end, out, over):
        m = _DOMAIN.match(text, end)
        if not m:
            return
        start = at
        while start > over["email"] and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            out.append((start, m.end()))
            over["email"] = m.end()

    def _ip(self, text, start, end, out, over):
        while start > over["ip"] and "0" <= text[start - 1] <= "9":
            start -= 1
        m = _DOTTED.match(text, start)
        parts = m.group().split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            if all(map(_byte_part, four)):
                a = start + sum(map(len, parts[:i])) + i
                out.append((a, a + sum(map(len, four)) + 3))
        over["ip"] = m.end()

    def _card(self, text, start, end, out, over):
        m = _CARD.match(text, start)
        digits = _digits(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
        over["card"] = m.end()

    def _phone(self, text, start, end, out, over):
        m = _PHONE.match(text, start)
        if m:
            if 8 <= len(_digits(m.group())) <= 15:
                out.append(m.span())
            over["phone"] = m.end()

    def _url(self, text, start, end, out, over):
        m = _URL.match(text, start)
        if m and not (start and text[start - 1].isalnum()):
            stop = start + len(m.group().rstrip(".,;:!?)]}"))
            if stop > end:
                out.append((start, stop))
                over["url"] = stop

    def _iban(self, text, start, end, out, over):
        m = _IBAN.match(text, end)
        item = m[1] if m else ""
        while item:  # the last group may be the next word: shorter ends until one is valid
            size = len(item.replace(" ", ""))
            if size < 15:
                break
            if size <= 34 and _mod97(item):
                out.append((m.start(1), m.start(1) + len(item)))
                over["iban"] = m.start(1) + len(item)
                break
            item = item.rpartition(" ")[0]

    def _ssn(self, text, start, end, out, over):
        m = _SSN.match(text, end)
        if m and m[1][:3] not in ("000", "666") and m[1][0] != "9" and m[1][4:6] != "00" and m[1][7:] != "0000":
            out.append(m.span(1))
            over["ssn"] = m.end(1)

    def _account(self, text, start, end, out, over):
        m = _ACCOUNT.match(text, end)
        if m and len(_digits(m[1])) >= 6:
            out.append(m.span(1))
            over["account"] = m.end(1)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with each run of overlapping spans replaced by the kind of its first span in capitals."""
    out, pos, runs = [], 0, []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if runs and a < runs[-1][2]:
            runs[-1][2] = max(b, runs[-1][2])
        else:
            runs.append([kind, a, b])
    for kind, a, b in runs:
        out += [text[pos:a], f"[{kind.upper()}]"]
        pos = b
    return "".join([*out, text[pos:]])


_FINDER: list[PiiFinder] = []


def _finder() -> PiiFinder:
    if not _FINDER:
        _FINDER.append(PiiFinder())
    return _FINDER[0]


SPAN = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def find_pii(docs: DataFrame, text: str = "text", spans: str = "pii", redact: str | None = None) -> DataFrame:
    """Adds ``spans`` (array of kind, start, end) and, where named, the redacted text in column ``redact``.

    ``redact`` may be the text column itself; a null text stays null there. Other columns
    pass through; columns of the two names are replaced.
    """
    keep = [c for c in docs.columns if c not in (spans, redact)]
    fields = [docs.schema[c] for c in keep] + [T.StructField(spans, SPAN)] + ([T.StructField(redact, T.StringType())] if redact else [])
    kind_t = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _finder()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            found = [finder.spans(t) if t else [] for t in texts]
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            arrays.append(pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in f] for f in found], kind_t))
            if redact:
                arrays.append(pa.array([redacted(t, f) if f else t for t, f in zip(texts, found, strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in fields])

    return docs.mapInArrow(run, T.StructType(fields))


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, and all spans as text."""
    out = find_pii(docs.select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("pii", lambda s: s["kind"].isin(*BASE_KINDS))
    return out.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("pii")).alias("spans"))
