import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyline.llm import bpe, queries, tokens
from tallyline.llm.merges import queued, scanned

ODD = "aé ß՘\U000323b0 1२ \n\t  '’s're<|endoftext|>\x1c\x85​　日本語😀ñ$%"


@pytest.fixture(scope="module")
def counts():
    return queries.count_table()


@pytest.fixture(scope="module")
def ranks():
    return queries.rank_table()


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks.rank, special_tokens={})


def strings(n):
    rng = random.Random(5)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 25))) for _ in range(n)] + ["a" * 300, "\n" * 200, "<|endoftext|>" * 3, "ab" * 500]


def test_counts_are_the_librarys(counts):
    told = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    for s in strings(800):
        assert counts.count(s) == len(told.encode(s, add_special_tokens=False).ids), repr(s)


def test_every_proved_string_is_one_token(counts):
    told = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    some = sorted(counts.whole)[::50]
    assert len(counts.whole) > 40_000 and all(len(told.encode(s, add_special_tokens=False).ids) == 1 for s in some)


def test_ids_are_the_librarys_and_decode_to_the_bytes(ranks, library):
    for s in strings(800):
        ids = np.frombuffer(ranks.encode(s), "<i4").tolist()
        assert ids == library.encode_ordinary(s) and ranks.decode(ids) == s.encode(), repr(s)


def test_two_tokens_stay_as_the_merges_say(ranks):
    rng, ids = random.Random(3), sorted(ranks.reached.values())
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(3000)]
    pairs += [tuple(ranks.by_merges(ranks.bytes_of[i])[:1] * 2) for i in ids[:200]]
    for x, y in pairs:
        assert ranks.stays(x, y) == (ranks.by_merges(ranks.bytes_of[x] + ranks.bytes_of[y]) == [x, y])


def test_appends_and_edits_equal_a_new_encoding(ranks, library):
    rng = random.Random(9)
    for s in strings(300):
        i = rng.randint(0, len(s))
        j = rng.randint(i, len(s))
        put = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 5)))
        text = bpe.EncodedText(ranks, s)
        text.edit(i, j, put)
        text.append(put)
        assert text.ids() == library.encode_ordinary(s[:i] + put + s[j:] + put)
        piece = bpe.PrefixTable(ranks, s.encode())
        piece.append(b"tail")
        piece.edit(i, j, b"ab")
        assert piece.tokens() == ranks.by_merges(s.encode()[:i] + b"ab" + (s.encode() + b"tail")[j:])


def test_an_edit_of_a_long_piece_stops_where_it_agrees_again(ranks):
    piece = bpe.PrefixTable(ranks, b"theandthe" * 500)
    assert piece.edit(10, 12, b"x") < 200


def test_both_ways_of_merging_agree(ranks):
    rng = random.Random(1)
    for _ in range(300):
        data = bytes(rng.choice(b"thean ") for _ in range(rng.randint(0, 90)))
        parts = [data[i : i + 1] for i in range(len(data))]
        assert scanned(parts, ranks.rank.get) == queued(parts, ranks.rank.get)


def test_documents_of_any_kind(docs, no_docs, rows, counts, ranks, library):
    out = tokens.token_counts(docs.withColumn("n_tokens", F.lit("clash")), counts)
    got = sorted(((r.n_bytes, r.n_tokens, r.over_limit) for r in out.collect()), key=repr)
    want = sorted(((len((r[1] or "").encode()), n := counts.count(r[1] or ""), n > 512) for r in rows), key=repr)
    assert got == want and out.columns == [*docs.columns, "n_tokens", "n_bytes", "over_limit"]
    coded = queries.digests(bpe.decode(bpe.encode(docs, ranks), ranks)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    ids = [library.encode_ordinary(r[1] or "") for r in rows]
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in coded) == sorted((len(i), sha(",".join(map(str, i)).encode()), sha((r[1] or "").encode())) for i, r in zip(ids, rows))
    assert tokens.token_counts(no_docs, counts).count() == 0 and bpe.encode(no_docs, ranks).count() == 0
