import difflib
import random
import time

import pytest

from scriptorium.operators import changes


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "aabbcdefgh", "abcdefghijklmnopqrstuvwxyz"])
def test_matches_are_those_of_difflib(letters):
    draw = random.Random(letters)
    for _ in range(400):
        a, b = ([draw.choice(letters) for _ in range(draw.randrange(0, 40))] for _ in range(2))
        if draw.random() < 0.5:
            b = [x for x in a if draw.random() < 0.8]
            b[3:3] = [draw.choice(letters) for _ in range(draw.randrange(0, 4))]
        want = difflib.SequenceMatcher(None, a, b, autojunk=False)
        got = changes.Matcher(a, b)
        assert got.get_matching_blocks() == want.get_matching_blocks()
        assert got.get_opcodes() == want.get_opcodes()


def test_many_blank_lines_take_no_square_of_time():
    before = "".join(f"line {i}.  \t\n\n\n" for i in range(12_000))
    after = "".join(f"line {i}.\n\n" for i in range(12_000))
    started = time.monotonic()
    assert len(changes.differences(before, after)) == 12_000
    assert time.monotonic() - started < 30


def test_whole_texts_go_to_python_in_small_batches(spark):
    from scriptorium.plans import catalogue
    from scriptorium.sources import shared

    for name in ("deep_normalize", "recursive_chunks", "change_log", "nfc_normalize"):
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == str(shared.BATCH_ROWS), name
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
