import random

import public_tokenizers as P
from tokenizers import Tokenizer

from tallyline.llm import token_files


def _encoder(monkeypatch, words: int | None = None):
    if words:
        monkeypatch.setattr(token_files, "WORDS", words)
    return token_files.WordEncoder(open(P.path("word_bpe_49k.json"), encoding="utf-8").read())


def test_letters_are_merged_and_remembered_once(monkeypatch):
    encode, merged = _encoder(monkeypatch), []
    whole = encode.merge
    encode.merge = lambda piece: merged.append(piece) or whole(piece)
    encode("tally tally")
    assert sum(len(known) for known in vars(encode).values() if isinstance(known, dict)) == 1  # not as a word and as a piece
    encode("Tally tally, TALLY. tally")
    assert merged.count("tally") == 1


def test_ids_are_the_librarys_however_little_is_remembered(monkeypatch):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    rng = random.Random(5)
    texts = ["".join(rng.choices("aAbBé.,;!  \n\t1ßΣİ$<>", k=80)) for _ in range(300)] + ["", " ", "a" * 41 + ".", "A" * 90 + ", b", "e\u0301!! Ab.", "ΣΑΣ ς É,é."]
    for words in (None, 3):
        encode = _encoder(monkeypatch, words)
        for text in texts:
            want = library.encode(text, add_special_tokens=False).ids
            assert list(memoryview(encode(text)).cast("I")) == want, text
