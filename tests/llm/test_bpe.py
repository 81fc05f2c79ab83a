import hashlib
import random
import struct

import pytest
import small

from creditloom.llm import bpe
from creditloom.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
PATH = tokenizer_path()


@pytest.fixture(scope="module")
def automaton():
    with open(PATH, encoding="utf-8") as file:
        return bpe.Automaton(file.read())


def test_equals_the_library(automaton):
    library = tokenizers.Tokenizer.from_file(PATH)
    generator = random.Random(1)
    parts = [*"abcABC'strvemld 0129²½ \t\n\x0b\x1c\x1f\x85\xa0.,!?#éÉñÑßİıſKΣσςΆͅ中文字مرحبا😀👍🏽नमस्तेกา٣Ⅷ〇​ ﬁǅ", "<|endoftext|>",
             "<|startoftext|>", "</w>", "aaaa", "hello", "the", "'S", "'LL", "Ünïcode"]
    texts = ["".join(generator.choice(parts) for _ in range(generator.randint(0, 60))) for _ in range(3000)]
    texts += ["".join(chr(generator.choice([generator.randint(0, 0x24F), generator.randint(0, 0xD7FF), generator.randint(0xE000, 0x10FFFF)])) for _ in range(40)) for _ in range(3000)]
    texts += ["a" * n for n in range(60)] + ["ab" * n for n in range(60)] + ["!" * n for n in range(40)] + [t or "" for _, t in small.AWKWARD]
    for text in texts:
        want = library.encode(text, add_special_tokens=False).ids
        assert automaton.encode(text) == want, text
        assert automaton.decode(want) == library.decode(want, skip_special_tokens=False)


def test_gadgets_read_only_what_merges_give():
    """A toy vocabulary: every token sequence the automaton reads is what merging its text in order gives."""
    import itertools
    import json

    chars = bpe._byte_characters()
    letters = [c + e for e in ("", "</w>") for c in chars]
    merges = [["a", "b"], ["a", "a"], ["ab", "b"], ["aa", "b</w>"], ["b", "ab"]]
    vocab = {t: i for i, t in enumerate(letters + ["".join(m) for m in merges])}
    spec = {"model": {"vocab": vocab, "merges": merges, "end_of_word_suffix": "</w>"}, "added_tokens": []}
    machine = bpe.Automaton(json.dumps(spec))
    for size in range(1, 9):
        for word in itertools.product("ab", repeat=size):
            tokens = [*word[:-1], word[-1] + "</w>"]
            for a, b in merges:
                i = 0
                while i < len(tokens) - 1:
                    if tokens[i] == a and tokens[i + 1] == b:
                        tokens[i : i + 2] = [a + b]
                    i += 1
            assert [machine.label[i] for i in machine.encode_word("".join(word).encode())] == tokens


def test_rows(spark, automaton):
    found = bpe.encode(small.docs(spark), PATH).collect()
    want = [(i, automaton.encode(t or "")) for i, t in small.AWKWARD]
    got = [(r["doc_id"], list(struct.unpack(f"<{len(r['ids']) // 4}I", r["ids"]))) for r in found]
    assert sorted(got, key=small.key) == sorted(want, key=small.key)
    assert {hashlib.sha256(r["decoded"].encode()).hexdigest() for r in found} == {
        hashlib.sha256(automaton.decode(ids).encode()).hexdigest() for _, ids in want
    }
    assert bpe.encode(small.docs(spark, []), PATH).count() == 0


def test_memory_is_bounded_and_does_not_change_results(automaton, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    monkeypatch.setattr(bpe, "PATIENCE", 5)
    monkeypatch.setattr(bpe, "GENERATION_BYTES", 5000)
    library = tokenizers.Tokenizer.from_file(PATH)
    automaton.forget()
    coder = bpe.Coder(automaton)
    for k in range(5):
        text = " ".join(f"word{n} {n} repeated" for n in range(k, 100 + k))
        ids, decoded = coder.code(text)
        want = library.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want and decoded == library.decode(want, skip_special_tokens=False)
        assert len(coder.ids) <= 25 and len(coder.ids.old) <= 25 and len(automaton.open) <= 20
    assert coder.code("") == (b"", "")
    automaton.forget()
