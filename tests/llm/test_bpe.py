import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken

from stratakv.llm import bpe

from .conftest import EDGES, prose

PATH = P.path("byte_bpe_50k.tiktoken")


def reference():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_text_as_the_library_encodes_it(make_docs):
    rng = random.Random(1)
    wild = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x7FF), rng.randrange(0x4E00, 0x4FFF), 0x1F389, 9, 10])) for _ in range(rng.randrange(80))) for _ in range(150)]
    rows = EDGES + [(1000 + k, t) for k, t in enumerate(wild + [prose(rng, "fr"), "a" * 3000, "abc" * 2000, " " * 500 + "x", "<|endoftext|>", "don't we'll 12345 ###"])]
    own = reference()
    want = []
    for doc_id, text in rows:
        ids = np.array(own.encode_ordinary(text or ""), dtype="<u4").tobytes()
        want.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    got = bpe.bpe_round_trip(make_docs(rows), PATH, P.PATTERN).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert bpe.bpe_round_trip(make_docs([]), PATH, P.PATTERN).collect() == []


def test_the_store_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEEP", 50)
    own, lib, rng = bpe.Codec(PATH, P.PATTERN), reference(), random.Random(2)
    for _ in range(5):
        text = " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40))
        assert own.encode([text])[0] == np.array(lib.encode_ordinary(text), dtype="<u4").tobytes()
        assert len(own.kept) <= 50
    assert own.decode(own.encode(["a ü 🎉"])[0]) == "a ü 🎉".encode()


def test_a_pre_token_of_more_than_a_megabyte():
    own, lib = bpe.Codec(PATH, P.PATTERN), reference()
    # letters whose bytes merge with nothing, so that the few merges are at the end
    apart = next(c for c in map(chr, range(0x1400, 0x9FFF)) if c.isalpha() and len(lib.encode_ordinary(c * 4)) == 12)
    text = apart * 360_000 + "the" + apart + "and"
    assert len(text.encode()) > 1 << 20 and own.pattern.findall(text) == [text]
    ids = own.encode([text])[0]
    assert ids == np.array(lib.encode_ordinary(text), dtype="<u4").tobytes()
    assert own.decode(ids) == text.encode()
