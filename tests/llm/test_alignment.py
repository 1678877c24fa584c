import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
import tokenizers

from scriptorium.llm import alignment, bpe, queries

FIRST = queries.byte_bpe_json()
SECOND = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
A, B = tokenizers.Tokenizer.from_str(FIRST), sentencepiece.SentencePieceProcessor(model_proto=SECOND)
A.encode_special_tokens = True
BYTE = {c: i for i, c in enumerate(bpe.byte_chars())}


def spans(text):
    """Ends and ids of both tokenizers over the whole text; None where it isn't given back."""
    wanted = (" " + text).encode()
    a = [(i, bytes(map(BYTE.__getitem__, A.id_to_token(i)))) for i in A.encode(" " + text, add_special_tokens=False).ids]
    b = [(i, bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode()) for i in B.encode(text)]
    if b"".join(x for _, x in a) != wanted or b"".join(x for _, x in b) != wanted:
        return None
    out = []
    for side in (a, b):
        end, found = 0, []
        for i, x in side:
            found.append((end, end + len(x), i))
            end += len(x)
        out.append(found)
    return out


def plain(texts):
    found, links = [spans(t) if t else None for t in texts], []
    for x in found:
        own = []
        if x:
            j = 0
            for s, e, i in x[0]:  # every pair of overlapping tokens
                while x[1][j][1] <= s:
                    j += 1
                k = j
                while k < len(x[1]) and x[1][k][0] < e:
                    own.append((i, x[1][k][2]))
                    k += 1
        links.append(own)
    counts = Counter(p for own in links for p in own)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for x, own in zip(found, links, strict=True):
        if not x:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        common = sorted({e for _, e, _ in x[0]} & {e for _, e, _ in x[1]})
        groups, start = [], 0
        for end in common:
            groups.append("|".join(",".join(str(i) for s, e, i in side if start <= s and e <= end) for side in x) if len(common) < 400 else None)
            start = end
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if None not in groups else None
        out.append((len(x[0]), len(x[1]), len(common), len(own), sum(counts[p] == best[p[1]] for p in own), sum(counts[p] for p in own), digest))
    return out, counts


def check(spark, texts, parts=2):
    docs = spark.createDataFrame([(i, t, "kept", 3) for i, t in enumerate(texts)], "doc_id long, text string, units string, n long").repartition(parts)
    rows, pairs = alignment.align(docs, FIRST, SECOND)
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in rows.collect()}
    want, counts = plain(texts)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i][:6] == w[:6], (texts[i][:80] if texts[i] else texts[i], got[i], w)
        assert w[6] is None or got[i][6] == w[6]
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    assert {(r.a, r.b): (r.n, r.best) for r in pairs.collect()} == {p: (n, n == best[p[1]]) for p, n in counts.items()}


TEXTS = [None, "", " ", "  ", "a", " a", "a ", "the the\n\n  quick", "x▁y", "▁", "a ▁ b", "<|endoftext|> it's <s> </s> <0x41>", "naïve café 日本語のテキスト 🙂🙂 👩‍👩‍👧", "tab\t and\x85next  nbsp 　 wide", "\n \n", "a \n b  c\r\n d", "\x1c x \x00 y", "1234567 89,000.5", "the the\n\n  quick"]


def test_odd_texts(spark):
    check(spark, TEXTS)


def test_long_texts(spark):
    check(spark, ["x" * 40_000, "ab" * 30_000, " " * 5000, "日本" * 4000, "word " * 20_000, "é" * 3000 + "▁"])


def test_small_chunks(spark, monkeypatch):
    draw = random.Random(2)
    texts = ["".join(draw.choice(["the", "of", "Straße", " ", " ", "  ", "\n", "x1", "'s", "!", "漢", "▁" if i % 9 == 0 else "ü"]) for _ in range(60)) for i in range(80)]
    check(spark, texts, parts=1)
    chunk = alignment.Chunk(alignment.Encoders(FIRST, SECOND))
    for i, t in enumerate(texts):
        chunk.add(i, t)
    alignment.UNITS = len(chunk.known) // 5  # tasks are forked from this process or start with what the module has; one chunk and several agree
    try:
        check(spark, texts, parts=1)
    finally:
        alignment.UNITS = 200_000


def test_units_join_to_the_text():
    draw = random.Random(4)
    for _ in range(3000):
        text = "".join(draw.choice(" \n\ta é") for _ in range(draw.randrange(1, 12)))
        units = alignment.units_of(text)
        assert "".join(" " + x for x in units) == " " + text
        assert all(x and (i == 0 or not units[i - 1][-1].isspace()) for i, x in enumerate(units)) or units == [text]
        ids = [i for x in units for i in A.encode(" " + x, add_special_tokens=False).ids]
        assert ids == A.encode(" " + text, add_special_tokens=False).ids
        assert [i for x in units for i in B.encode(x)] == B.encode(text)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        alignment.Encoders(FIRST.replace('"add_prefix_space":false', '"add_prefix_space":true').replace('"add_prefix_space": false', '"add_prefix_space": true'), SECOND)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    rows, pairs = alignment.align(docs, FIRST, SECOND)
    assert rows.count() == 0 and pairs.count() == 0


def test_query_equals_plain(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want, _ = plain([d.text for d in docs])
    got = {r.doc_id: r for r in queries.op11_alignment(spark, sf).collect()}
    for d, w in zip(docs, want, strict=True):
        r = got[d.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == w[:6]
        assert w[6] is None or r.groups_sha256 == w[6]
