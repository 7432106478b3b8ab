"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs before a
digit, digits beside digits or dots, URL schemes and words that announce an
account number. A small parser for each kind expands from the anchor to the
value's boundaries and validates it; what lies between anchors isn't parsed.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from tickweave.runtime import ship_package, table

DIGITS = frozenset("0123456789")
ALNUM = DIGITS | frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
URL_END = frozenset(" \t\n\v\f\r<>\"'`|{}")

#: Kinds in the order in which spans with the same start are listed.
KINDS = ("email", "ip", "card", "phone", "url", "account")
SCHEMES = ("http://", "https://", "ftp://", "HTTP://", "HTTPS://", "FTP://")
#: Words that announce an identifier, in lower case, capitalised and upper case.
CUES = ("account", "acct", "iban", "passport", "ssn", "customer id", "member id")


@lru_cache(maxsize=1)
def _anchors():
    import ahocorasick

    out = ahocorasick.Automaton()
    words = {"@": "email"} | {s: "url" for s in SCHEMES}
    for d in "0123456789":
        words[f"+{d}"] = "phone"
        for e in "0123456789":
            words[f"{d}.{e}"] = "ip"
            for gap in ("", " ", "-"):
                words[f"{d}{gap}{e}"] = "card"
    for cue in CUES:
        for word in (cue, cue.capitalize(), cue.upper()):
            words[word] = "account"
    for word, kind in words.items():
        out.add_word(word, (kind, len(word)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _run(text: str, at: int, allowed: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in allowed:
        at += 1
    return at


def _back(text: str, at: int, least: int, allowed: frozenset) -> int:
    while at > least and text[at - 1] in allowed:
        at -= 1
    return at


def _email(text: str, at: int, free: int) -> tuple[int, int] | None:
    start = _back(text, at, free, LOCAL)
    if start == at:
        return None
    stop = _run(text, at + 1, LABEL)
    if stop == at + 1:
        return None
    end = None
    while stop < len(text) and text[stop] == "." and (to := _run(text, stop + 1, LABEL)) > stop + 1:
        end = stop = to
    return None if end is None else (start, end)


def _digit_chain(text: str, at: int, free: int, joints: str) -> tuple[list[tuple[int, int]], int]:
    """Runs of digits joined by single ``joints``, around the digit at ``at``."""
    start = at
    while start > free and (text[start - 1] in DIGITS or text[start - 1] in joints and start - 1 > free and text[start - 2] in DIGITS):
        start -= 1
    runs = []
    while True:
        stop = _run(text, start, DIGITS)
        runs.append((start, stop))
        if stop + 1 < len(text) and text[stop] in joints and text[stop + 1] in DIGITS:
            start = stop + 1
        else:
            return runs, stop


def _octet(digits: str) -> bool:
    value = digits.lstrip("0")
    return len(value) < 4 and int(value or "0") <= 255


def _ips(text: str, at: int, free: int) -> tuple[list[tuple[int, int]], int]:
    runs, stop = _digit_chain(text, at, free, ".")
    found = []
    for i in range(0, len(runs) - 3, 4):
        four = runs[i : i + 4]
        if all(_octet(text[a:b]) for a, b in four):
            found.append((four[0][0], four[3][1]))
    return found, stop


def _card(text: str, at: int, free: int) -> tuple[tuple[int, int] | None, int]:
    runs, stop = _digit_chain(text, at, free, " -")
    digits = sum(b - a for a, b in runs)
    if 14 <= digits <= 19 and luhn("".join(text[a:b] for a, b in runs)):
        return (runs[0][0], stop), stop
    return None, stop


def _phone(text: str, at: int) -> tuple[bool, int] | None:
    """Whether the match that starts at a plus sign is valid, and its end; None without a match."""
    end = _run(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3:
        return None
    return 10 <= sum(c in DIGITS for c in text[at:end]) <= 15, end


def _url(text: str, at: int, scheme: int) -> tuple[int, int] | None:
    end = at + scheme
    while end < len(text) and text[end] not in URL_END:
        end += 1
    while end > at + scheme and text[end - 1] in ".,;:!?)]*#$%&":
        end -= 1
    return (at, end) if end > at + scheme and text[at + scheme] in ALNUM else None


def _account(text: str, at: int, size: int) -> tuple[int, int] | None:
    """Up to twelve characters after a cue, an identifier of 6 to 34 letters and digits with at least four digits."""
    if at and text[at - 1].isalnum():
        return None
    start = _run(text, at + size, frozenset(" :#=.\"'nNoO"))
    if start == at + size or start > at + size + 12:
        return None
    end = _run(text, start, ALNUM | frozenset("-"))
    value = text[start:end].strip("-")
    letters = [c for c in value if c in ALNUM]
    if 6 <= len(letters) <= 34 and sum(c in DIGITS for c in letters) >= 4:
        return start, start + len(value)
    return None


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a whole text, in code points, sorted by start and kind; a null text has none."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    free = dict.fromkeys(KINDS, 0)  # up to where the text is used up, by kind
    for last, (kind, size) in _anchors().iter(text):
        at = last - size + 1
        if kind == "ip" or kind == "card":
            if last < free[kind]:
                continue
            if kind == "ip":
                spans, free["ip"] = _ips(text, last, free["ip"])
                found += [("ip", *s) for s in spans]
            else:
                span, free["card"] = _card(text, last, free["card"])
                found += [("card", *span)] if span else []
        elif at < free[kind]:
            continue
        elif kind == "email":
            if span := _email(text, at, free["email"]):
                found.append(("email", *span))
                free["email"] = span[1]
        elif kind == "phone":
            if match := _phone(text, at):
                free["phone"] = match[1]
                if match[0]:
                    found.append(("phone", at, match[1]))
        elif span := (_url(text, at, size) if kind == "url" else _account(text, at, size)):
            found.append((kind, *span))
            free[kind] = span[1]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


SPAN = StructType().add("kind", StringType()).add("start", LongType()).add("end", LongType())
_ARROW_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find_spans(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (default: all) as a struct ``row``, and ``spans`` (array of kind, start, end).

    Nulls and empty texts have no spans; whole texts of any length are read;
    repeated rows get equal results; empty tables give no rows. Overlapping spans
    of different kinds are all returned. Nothing is shuffled.
    """
    ship_package(docs.sparkSession)
    row = F.struct(*[docs[f"`{c}`"] for c in (docs.columns if carry is None else carry)])
    rows = docs.select(row.alias("row"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in find(x.as_py())] for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(spans, pa.list_(_ARROW_SPAN))], ["row", "spans"])

    return rows.mapInArrow(run, StructType().add("row", rows.schema["row"].dataType).add("spans", ArrayType(SPAN)))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans of every document."""
    found = find_spans(table(spark, sf_dir, "documents"), carry=["doc_id"])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:4]))
    return found.select("row.doc_id", *[number(k) for k in KINDS[:4]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
