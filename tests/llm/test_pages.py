import html
import random
import re
import time

import pytest

from creditloom.llm import language

HIDDEN = re.compile(r"<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", re.S | re.I)
DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b", re.I)
PARTS = ["<script", "<SCRIPT>", "</script>", "</Script  >", "<style a=1>", "</style>", "<!--", "-->", "<!-->", "<", ">", "<b>", "x", "y z", " ", "\n", "&amp;",
         "<html", "<html lang=en>", " lang='de'", "lang", "=", "fr", "<html>", "<scripts>", "</", "--"]


def test_scan_equals_patterns():
    generator = random.Random(1)
    for _ in range(20_000):
        page = "".join(generator.choice(PARTS) for _ in range(generator.randint(0, 14)))
        assert language.visible(page) == html.unescape(HIDDEN.sub(" ", page))
        found = DECLARED.search(page)
        assert language.declared_language(page) == (found[1].lower() if found else None)


@pytest.mark.parametrize("broken", ["<script>x", "<!-- a", "<html a ", "<b", "</script <script ", "<style <!-- <"])
def test_broken_pages_of_a_million_characters(broken):
    page = broken * (1_000_000 // len(broken))
    began = time.perf_counter()
    language.visible(page)
    language.declared_language(page)
    assert time.perf_counter() - began < 5
