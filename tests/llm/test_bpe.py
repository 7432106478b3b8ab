import base64
import random

import public_tokenizers as P
import pytest
import tiktoken

from tickweave.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_equal_the_librarys(library):
    own, r = bpe.codec(PATH, P.PATTERN), random.Random(5)
    letters = [chr(c) for c in [*range(256), 0x1C, 0x85, 0xA0, 0x301, 0x660, 0xBD, 0x2003, 0x3000, 0x4E2D, 0x1F600]]
    tokens = list(own.rank)
    for n in range(4000):
        if n % 3 == 0:
            text = "".join(r.choice(letters) for _ in range(r.randint(0, 30)))
        elif n % 3 == 1:
            text = b"".join(r.choice(tokens) for _ in range(r.randint(1, 8))).decode("utf8", "ignore")
        else:
            text = "".join(r.choice("aeiou nrst'") for _ in range(r.randint(0, 60)))
        ids = own.encode(text)
        assert ids == library.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["ab" * 30_000, " x" * 600_000, "a" * 1_100_000 + " b", "\n" * 5_000, "word  two   spaces " * 70_000])
def test_long_texts(library, text):
    own = bpe.codec(PATH, P.PATTERN)
    assert own.encode(text) == library.encode_ordinary(text)


def test_compatible_neighbours_are_what_merges_give():
    own = bpe.codec(PATH, P.PATTERN)
    for text in (b"hello", b"unbelievable", b"tionstions", "éàü".encode(), bytes(range(200, 256))):
        assert own.encode_piece(text) == ([own.rank[text]] if text in own.rank else own.merges(text))


def test_frame(odd, none, library):
    rows = bpe.encode_decode(odd, PATH, P.PATTERN).collect()
    texts = [r["text"] or "" for r in odd.collect()]
    assert sorted(map(str, ([*r["ids"]] for r in rows))) == sorted(str(library.encode_ordinary(t)) for t in texts)
    assert sorted(bytes(r["decoded"]) for r in rows) == sorted(t.encode() for t in texts)
    assert bpe.encode_decode(none, PATH, P.PATTERN).collect() == []
    empty = [r for r in bpe.digests(bpe.encode_decode(odd, PATH, P.PATTERN)).collect() if r["n_tokens"] == 0]
    assert len(empty) == 2 and len({(r["ids_sha256"], r["decoded_sha256"]) for r in empty}) == 1
