import hashlib
import struct

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from scriptorium.llm import bpe

RANKS = bpe.read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), encoding="ascii").read())
OTHER = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.Codec(bpe.model_bytes(RANKS), [t for t, _ in sorted(RANKS.items(), key=lambda x: x[1])], public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text("ab \n\t'sé$1<|>", max_size=60))
def test_codec_equals_other_library(text):
    ids = CODEC.encode(text)
    assert list(memoryview(ids).cast("I")) == OTHER.encode_ordinary(text)
    assert CODEC.decode(ids) == text.encode()


def test_documents(spark):
    texts = [None, "", "the the\n\n  quick", "x" * 70_000, "<|endoftext|>", "the the\n\n  quick"]
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(texts):
        ids = OTHER.encode_ordinary(t or "")
        raw = struct.pack(f"<{len(ids)}I", *ids)
        assert (rows[i].n_tokens, rows[i].ids, rows[i].decoded) == (len(ids), raw, (t or "").encode())
        assert rows[i].ids_sha256 == hashlib.sha256(raw).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN).count() == 0
