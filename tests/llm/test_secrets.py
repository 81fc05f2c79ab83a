import random
import re

import pytest
import small

from creditloom.llm import automata, secret_scan
from creditloom.llm.secret_scan import RULES, Scanner

SCANNER = Scanner()
WORDS = "password passwd secret token api_?key".split()
ASSIGN = re.compile(
    "(?:" + "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in WORDS) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)


def brute(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    for rule, (pattern, least) in enumerate(
        [("AKIA[A-Z0-9]+", 16), ("[0-9a-f]+", 32), ("gh[opsu]_[A-Za-z0-9]+", 40), ("xox[abprs]-[A-Za-z0-9-]+", 15)], 1
    ):
        found += [(m.start(), rule, m.end()) for m in re.finditer(pattern, text) if len(m[0]) >= least]
    return [(RULES[r].kind, s, e) for s, r, e in sorted(found)]


def test_scanner_equals_regular_expressions():
    generator = random.Random(3)
    parts = ["password", "PassWd", "secret", "token", "api_key", "ApiKey", '"', "'", " ", "  ", ":", "=", "abcd", "abcdefgh", "0123456789abcdef",
             "AKIA", "ABCDEFGHIJKL", "Z9", "é", "😀", "-", "_", ".", "ghp_", "x" * 36, "xoxb-", "a1" * 8, "\n", "K", "ſecret"]
    hits = 0
    for _ in range(20_000):
        text = "".join(generator.choice(parts) for _ in range(generator.randint(0, 14)))
        want = brute(text)
        hits += bool(want)
        assert SCANNER.spans(text.encode()) == want, text
    assert hits > 1000


def test_a_match_that_is_too_short_uses_its_text_up():
    assert SCANNER.spans(b"secret: token: abcdefgh") == []
    assert SCANNER.spans(b"secret=token : password=abcdefgh") == [("assign", 15, 32)]


def test_automata_are_minimal():
    table = automata.forward([automata.parse("(ab|cb)+")])
    assert len(table.moves) // table.width == 3
    with pytest.raises(ValueError):
        Scanner([secret_scan.Rule("fixed", "abc")])


def test_rows_and_masks(spark):
    secret = "é token = 'abcdefgh12' AKIA" + "Q" * 16 + " end"
    rows = [*small.AWKWARD, (30, secret), (30, secret)]
    found = [(r["doc_id"], [tuple(s) for s in r["spans"]]) for r in secret_scan.scan(small.docs(spark, rows)).collect()]
    assert sorted(found, key=small.key) == sorted(((i, brute(t or "")) for i, t in rows), key=small.key)
    masked = secret_scan.redact(small.docs(spark, rows))
    assert masked.columns == small.docs(spark, []).columns and masked.count() == len(rows)
    changed = masked.filter("doc_id = 30").first()
    assert changed["text"] == "é [secret]' [secret] end" and changed["n_chars"] == len(changed["text"])
    assert masked.filter("doc_id = 1 and text is null").count() == 1
    assert secret_scan.scan(small.docs(spark, [])).count() == 0 and secret_scan.redact(small.docs(spark, [])).count() == 0
