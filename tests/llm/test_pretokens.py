"""Pre-tokens that packing finds by itself are the tokenizer's, and are remembered once."""

import random
from array import array

from rillstone.llm import packing

PATH = packing.default_tokenizer()


def plain(text):
    return array("I", packing.tokenizer(PATH).encode(text, add_special_tokens=False).ids).tobytes()


def test_ids_are_the_tokenizers():
    rng = random.Random(1)
    narrow = [chr(i) for i in range(256)]
    pool = narrow + list("'''''srvemltd<|>") + list("aäß ") * 20 + ["İ", "Σ", "中", " ", "ﬁ", "é"]
    texts = ["".join(rng.choice(pool if n % 4 else narrow) for _ in range(rng.randint(0, 30))) for n in range(5000)]
    texts += [made for c in narrow for made in (c, f"a{c}b", f"{c}{c}", f"'{c}'s{c}")]
    texts += ["", "it's 'TIS ''s 'S'T can't.'ll", "x<|endoftext|>y <|startoftext|>", "ÀÉÎ½12²ªº µ"]
    for some in (texts, texts[::-1]):
        assert [t for t, own in zip(some, packing.document_ids(some, PATH), strict=True) if own != plain(t)] == []
    assert list(packing.document_ids([], PATH)) == []


def test_a_word_is_remembered_once_whatever_signs_and_capitals_it_has(monkeypatch):
    monkeypatch.setattr(packing, "_cores", {})
    monkeypatch.setattr(packing, "_words", {})
    texts = ["Nting. nting, (NTING) nting", "Größe; größe 12"]
    assert list(packing.document_ids(texts, PATH)) == [plain(t) for t in texts]
    assert sorted(w.decode("latin-1") for w in packing._cores[PATH]) == ["(", ")", ",", ".", "1", "2", ";", "größe", "nting"]
    assert not packing._words[PATH]
