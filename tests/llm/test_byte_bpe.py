import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tourweave.llm import byte_bpe as m

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = m.parse_ranks(open(PATH, "rb").read())
    return m.ByteBPE(ranks, public_tokenizers.PATTERN, entries=500), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def naive(piece: bytes, ranks) -> list[int]:
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        i = min(found)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_random_texts_as_the_library(both):
    ours, theirs = both
    rng = random.Random(1)
    alphabet = " \n\t\r\x0b\x1c\x85\xa0'strem vdlTS1²½éß̈漢🙂א.,!-_‍　K"
    for _ in range(6000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        ids = ours.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode_ordinary(text), repr(text)
        assert ours.decode(ids) == text.encode()


def test_long_pieces_by_the_definition(both):
    ranks, rng = both[0].ranks, random.Random(2)
    for n in (1, 2, 15, 16, 17, 40, 257, 700):
        piece = bytes(rng.choice(b"abcetnor \xc3\xa9") for _ in range(n))
        assert m.merge_piece(piece, ranks) == naive(piece, ranks)


def test_very_long_piece(both):
    text = "ab" * 30_000 + "漢" * 5_000
    assert np.frombuffer(both[0].encode(text), "<u4").tolist() == both[1].encode_ordinary(text)


def test_other_patterns_are_not_cut_at_spaces():
    assert m.pattern_allows_space_cut(public_tokenizers.PATTERN)
    assert not m.pattern_allows_space_cut(r"\w+ \w+|\s+")


def test_odd_rows(spark, odd_docs, no_docs, both):
    coded = m.encode(odd_docs, PATH, public_tokenizers.PATTERN)
    texts = sorted((r["text"] or "" for r in odd_docs.collect()))
    rows = coded.collect()
    assert sorted(bytes(r["decoded"]).decode() for r in rows) == texts
    assert sorted(np.frombuffer(r["ids"], "<u4").tolist() for r in rows) == sorted(both[1].encode_ordinary(t) for t in texts)
    back = m.decode(coded.select("doc_id", "ids"), PATH).collect()
    assert sorted(bytes(r["decoded"]).decode() for r in back) == texts
    assert m.encode(no_docs, PATH, public_tokenizers.PATTERN).count() == 0
    carried = m.encode_columns(odd_docs, PATH, public_tokenizers.PATTERN, ("doc_id", "lang"))
    assert carried.columns == ["doc_id", "lang", "n_tokens", "ids"]
    assert sorted(r["ids"] for r in carried.collect()) == sorted(both[1].encode_ordinary(t) for t in texts)
