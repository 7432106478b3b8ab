import random
import re

from tickweave.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        doubled = [sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))]
        return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def plain(text):
    found = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m[0])]
    return sorted(found, key=lambda s: (s[1], list(PATTERNS).index(s[0])))


def base(text):
    return [s for s in pii.find(text) if s[0] in PATTERNS]


def test_base_kinds_equal_the_patterns():
    r = random.Random(4)
    for _ in range(30_000):
        letters = r.choice(["0123 -", "ab.@-", "12.", "+1 (2).-x", "a1@.+ -é", "0 1-2.3+4@x😀"])
        text = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
        assert base(text) == plain(text), repr(text)


def test_values():
    text = "mail a.b+c@x-y.co.uk, host 10.0.0.255 not 1.2.3.256, card 4111 1111-1111 1111, call +1 (555) 123-4567. See https://x.org/a?b=c. IBAN: GB82WEST12345698765432"
    kinds = [(k, text[a:b]) for k, a, b in pii.find(text)]
    assert kinds == [("email", "a.b+c@x-y.co.uk"), ("ip", "10.0.0.255"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (555) 123-4567"), ("url", "https://x.org/a?b=c"), ("account", "GB82WEST12345698765432")]


def test_long_runs():
    for text in ("1" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "a" * 200_000 + "@b.c"):
        assert base(text) == plain(text)


def test_repeated_rows_have_equal_spans(odd):
    rows = pii.find_spans(odd).collect()
    twice = [r["spans"] for r in rows if r["row"]["doc_id"] == 3]
    assert len(rows) == odd.count() and len(twice) == 2 and twice[0] == twice[1]


def test_odd_rows(odd, none):
    rows = {r["row"]["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_spans(odd).collect()}
    assert rows[0] == rows[1] == [] and rows[6] == [("ip", 2, 9), ("email", 10, 16)]
    assert pii.find_spans(none).collect() == []
