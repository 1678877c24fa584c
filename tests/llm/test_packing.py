import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from scriptorium.llm import packing

CONTENT = open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8").read()
TOKENIZER = Tokenizer.from_str(CONTENT)
TOKENS = packing.Tokens(CONTENT, public_tokenizers.PATTERN, "<u2")


@pytest.mark.parametrize("n,bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_steps_to_neighbours(n, bits):
    points = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n)
    places = packing.hilbert(points, bits)
    assert sorted(places) == list(range(len(points)))
    along = points[np.argsort(places)]
    assert (np.abs(np.diff(along, axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text("ab \n\t'sé$1<|>\u3000\u0663", max_size=80))
def test_fast_ids_equal_those_of_the_library(text):
    assert TOKENS.fast is not None
    assert np.frombuffer(TOKENS.of(text), "<u2").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_other_files_are_not_taken_for_plain_ones():
    assert packing.ranks_of(CONTENT.replace('"Ġt":', '"Ġtx":')) is None


def check(pieces, docs, most):
    """Whatever the packing, pieces must cover every document and fill every sequence."""
    ids = defaultdict(list)
    for i, t in docs:
        ids[i].append(TOKENIZER.encode(t or "", add_special_tokens=False).ids + [0])
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append((p.start, p.length, p.ids_crc32, p.doc_tokens))
        by_sequence[p.sequence_id].append((p.offset, p.length))
    for i, own in ids.items():
        assert sum(p[1] for p in by_doc[i]) == sum(map(len, own))
        if len(own) == 1:
            at = 0
            for start, length, crc, total in sorted(by_doc[i]):
                assert (start, total) == (at, len(own[0])) and length > 0
                assert crc == zlib.crc32(np.array(own[0][start : start + length], "<u4").tobytes())
                at += length
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= most and (at == most or at & (at - 1) == 0)


def test_pack(spark):
    texts = [None, "", "hello  world\n", "x" * 30_000, "Schöne Grüße 😀 " * 300, "<|endoftext|> a", "a"] + [f"copy of a text {i % 3}" * 40 for i in range(60)]
    docs = list(enumerate(texts)) + [(None, "no key"), (3, "again"), (3, "again")]
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, place int")
    pieces = packing.pack(df, CONTENT, public_tokenizers.PATTERN, most=256).collect()
    check(pieces, docs, 256)


def test_neighbours_resemble_each_other():
    rng = np.random.default_rng(3)
    kinds = [rng.integers(0, 50_000, 200) for _ in range(2)]
    docs = [rng.choice(kinds[i % 2], 300) for i in range(200)]
    order = np.argsort(packing.Projector().places(docs), kind="stable") % 2
    assert (np.diff(order) != 0).mean() < 0.25  # by chance a half


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), CONTENT, public_tokenizers.PATTERN).count() == 0
