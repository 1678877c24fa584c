import time
import uuid

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text
from scriptorium.operators import cleaning, dictionary

CASES = [
    (text.light, "пере-\nнос a \t\r\nb\r\r\r\rc - d", "перенос a\nb\n\nc - d"),
    (text.decode_uni, "/uni041Fривет /uniZZ x/uni0041", "Привет /uniZZ xA"),
    (lambda c: text.entities(c, ["amp", "copy", "quot"]), "&amp;copy; &copy; &quot; &amp</b> &lt; &am", "&copy; © \" &amp</b> &lt; &am"),
    (text.html_unescape, "a &amp; b &mdash; &#1046;", "a & b — Ж"),
    (text.drop_noise_lines, "<!-- x -->\nкеep\n<b\n---\n```\n12\n1234\nabc\nда\n\n@f.md (2-11)\nending", "кеep\n1234\nда\n\nending"),
    (text.join_single_letters, "П оследующие В огромном D UNGEONS О БОГАХ A cat I T", "Последующие В огромном DUNGEONS ОБОГАХ A cat I T"),
    (text.join_lines, "пер-\nенос a\nb\n- item\n| x |\ny\n# h\nz\n\nq", "перенос a b\n- item\n| x |\ny\n# h z\n\nq"),
    (text.join_lines, "a\nb\nc", "a b\nc"),
    (text.dashes_and_spaces, "сло - во\n- item. - x  y , z\n\n! img", "сло-во-item. — x y, z! img"),
    (text.fix_homoglyphs, "Cлово Kot сOм-Tom ok", "Слово Kot сОм-Том ok"),
    (text.fix_short_latin, "Kak идут сегодня дела NA he TOM\nKak words here", "Как идут сегодня дела NA не ТОМ\nKak words here"),
    (text.fix_digits, "б0льше пре3ид зада4 2к6 20кг", "больше презид задай 2к6 20кг"),
    (text.fix_digits, "3аметка. 6ыло в4 СЛ0ВО\n| б0 | 3а |\n```\nб0льше\n```\nб0льше", "Заметка. Было в4 СЛОВО\n| б0 | 3а |\n```\nб0льше\n```\nбольше"),
    (text.fix_digits, "аб-вг-д3é слово _а0 аб--б0 éа3б б0_ в3- — к0т. 0рк é-а3 слово и3", "аб-вг-д3é слово _а0 аб--бо éа3б б0_ вз- — кот. Орк é-аз слово из"),
    (text.drop_f_before_vowel, "fа Fизика дfа find", "а изика дfа find"),
    (text.dedupe_words, "персонажи Персонажи персонажи да да", "персонажи да да"),
    (text.final_spacing, "  a\t b \n\n\n\n c  ", "a b\n\n c\n"),
    (text.compose, "é", "é"),
    (text.slug, "  Player's Handbook! Глава 1 ", "player_s_handbook_1"),
    (lambda c: text.truncate(c, 5), "abcd efgh", "abcd…"),
    (lambda c: text.truncate(c, 0), "abcd efgh", "abcd efgh"),
    (text.preview, None, ""),
    (lambda c: text.line_preview(c, 3), "a\nbcd", "a b…"),
    (lambda c: text.line_preview(c, 9, True), "ab", "ab…"),
    (lambda c: F.array_join(text.tokens(c), "|"), "Да, нет_1! É", "да|нет_1|é"),
    (lambda c: text.book_code(c), "/x/Players Handbook.pdf", "PHB"),
    (lambda c: text.book_code(c), "dmg-2014.pdf", "DMG"),
    (lambda c: text.book_code(c), "monsters.v2.pdf", "MONSTERS.V2"),
    (lambda c: text.answer_found(c).cast("string"), " К сожалению, в доступных правилах нет информации.", "false"),
    (lambda c: text.answer_found(c).cast("string"), "Да [1]", "true"),
    (lambda c: text.judge_verdict(c)["score"].cast("string"), 'so {"score": 0.5,\n "reasoning": "x"} end', "0.5"),
    (lambda c: text.judge_verdict(c)["score"].cast("string"), "none", "0.0"),
    (text.restore_drop_caps, "ерсонаж", "ерсонаж"),
]


@pytest.mark.parametrize("number", range(len(CASES)))
def test_cases(spark, number):
    function, given, want = CASES[number]
    df = spark.createDataFrame([(given,)], "t string")
    assert df.select(function(F.col("t"))).first()[0] == want


def test_point_ids(spark):
    given = ["7", " 007 ", "-3", "текст", "x y", "6BA7B811-9DAD-11D1-80B4-00C04FD430C8", None]
    rows = spark.createDataFrame([(x,) for x in given], "t string").select(text.point_id(F.col("t"))).collect()
    url = lambda x: str(uuid.uuid5(uuid.NAMESPACE_URL, x))
    assert [r[0] for r in rows] == ["7", "7", url("-3"), url("текст"), url("x y"), "6ba7b811-9dad-11d1-80b4-00c04fd430c8", None]
    for bad, kind in ((" ", "string"), (-3, "bigint"), (1.5, "double"), (True, "boolean")):
        with pytest.raises(Exception, match="point id"):
            spark.createDataFrame([(bad,)], f"x {kind}").select(text.point_id(F.col("x"))).collect()


def test_dictionary(spark):
    words = spark.createDataFrame([("Персонаж",), ("слово",), ("кот",), ("сова",)], "word string")
    docs = spark.createDataFrame([(1, "ерсонаж идёт\n# Слово слово\n  - ОВА\nЛово\nxyz", "k"), (2, "KOT и CAT на столе сидит, C, KOTOM", "k"), (3, None, "k"), (None, "ерсонаж", "k")], "id long, text string, known string")
    asked = dictionary.with_known(docs, words, "id", text.asked_of_drop_caps(F.col("text")), "found")
    got = {r.id: r[1] for r in asked.select("id", text.restore_drop_caps(F.col("text"), F.col("found"))).collect()}
    assert got == {1: "персонаж идёт\n# Слово слово\n  - СОВА\nСлово\nxyz", 2: docs.where("id = 2").first().text, 3: None, None: "ерсонаж"}
    cleaned = {r.id: r for r in cleaning.deep(docs, "id", words=words).collect()}
    assert cleaned[2].text == "КОТ и CAT на столе сидит, С, KOTOM\n" and cleaned[2].known == "k" and cleaned[3].text is None
    assert cleaned[1].text.startswith("персонаж идёт")


def test_deep_keeps_invariants(spark):
    df = spark.createDataFrame([("# Глава\r\n\r\nTекст с б0льшим pазрывом стро-\nки  и и слово слово\n\n\n\n- a\n12\n",), (" ",)], "t string")
    for _, step in text.deep_steps():
        df = df.withColumn("t", step(F.col("t")))
    rows = [r.t for r in df.collect()]
    assert all(r.endswith("\n") and "\n\n\n" not in r for r in rows)
    assert "большим разрывом" in rows[0] and "строки" in rows[0] and "слово слово" not in rows[0]


def test_titles(spark):
    df = spark.createDataFrame([("B", "", ["x", "", None], "i"), (None, None, None, None), ("", "", [], "i")], "b string, c string, p array<string>, i string")
    got = [r[0] for r in df.select(text.source_title(F.col("b"), F.col("c"), F.col("p"), F.col("i"))).collect()]
    assert got == ["B • x • id=i", "fragment", "id=i"]
    langs = spark.createDataFrame([(["ru", " EN", "ru", ""],), ([],), (None,)], "l array<string>").select(text.ocr_languages(F.col("l"))).collect()
    assert [r[0] for r in langs] == [["rus", "eng"], ["eng"], ["rus", "eng"]]


def test_letters_are_counted_once_for_a_line(spark):
    from scriptorium.plans import catalogue

    plan = catalogue.line_kinds(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(line") == 2 and "[^" not in plan  # a class a count, runs of letters at once


def test_line_kinds_equals_sql_on_odd_texts(spark, tmp_path):
    from scriptorium.plans import catalogue
    from tests import oracle

    odd = ["", "\n", "\n\n", None, "a|b|\rc|d| nu", "one\r\ntwo\r\n", "и\x0bлат in\x85|x| |", "i\x1cu\x1du\x1e", "x|y|z\n", "а\n\n", "i|\u2028|\u2029nun", " |a|b"]
    spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert oracle.compare(spark, catalogue.line_kinds, catalogue.ORACLES["line_kinds"], str(tmp_path)) == len(odd) - 1


def test_words_are_not_case_folded_without_a_dictionary(spark):
    from scriptorium.operators import suspicion

    plan = suspicion.suspicious(spark.createDataFrame([(1, "слово")], "k int, text string"), "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(" not in plan and "upper(" not in plan


def test_a_long_run_at_the_end_of_a_line_is_looked_through_once(spark):
    given = "слово 3 é" + "а" * 100_000 + "é"
    started = time.monotonic()
    assert spark.createDataFrame([(given,)], "t string").select(text.fix_digits(F.col("t"))).first()[0] == given
    assert time.monotonic() - started < 20


def test_long_fences_and_repeats_need_no_stack(spark):
    long = {text.fix_digits: ("слово б0льше\n```\n" + "б0 a\n" * 20_000 + "```\nб0льше", "слово больше\n```\n" + "б0 a\n" * 20_000 + "```\nбольше"), text.dedupe_words: ("слово Слово " * 20_000, "слово ")}
    for step, (given, want) in long.items():
        assert spark.createDataFrame([(given,)], "t string").select(step(F.col("t"))).first()[0] == want
