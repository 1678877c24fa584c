"""Text clean-up as column expressions: light and deep normalisation of converted pages.

Everything here is row-local and stays in the JVM, except the two functions that say so (HTML entities, canonical composition). Patterns spell out letter classes, because ``\\w`` and ``\\s`` differ between regular expression dialects. A null
text stays null.
"""

from __future__ import annotations

import html
import html.entities
import unicodedata
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters, look-alikes and word lists that the results depend on.
CYR = "А-Яа-яЁё"
LETTER = "A-Za-z" + CYR
WORD = r"\p{L}\p{N}_"
LOOKALIKE_LATIN = "AaBCcEeHKkMmOoPpTtXxYyh"
LOOKALIKE_CYRILLIC = "АаВСсЕеНКкМмОоРрТтХхУун"
ONE_LETTER_WORDS_CYR = "ВКСЯОИАУЭЕЮЫ"
ONE_LETTER_WORDS_LAT = "AI"
SHORT_LATIN_WORDS = ["KAK", "NA", "HE", "HA", "TOM", "ACT", "KTOMY", "KTOMU", "C"]
RUSSIAN_ALPHABET = "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"
LATIN_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_BLANK = r"[\s\x1c-\x1f]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def strip(c: Column) -> Column:
    """White space of either end removed, Unicode's included."""
    return F.regexp_replace(c, rf"(?U)^{_BLANK}+|{_BLANK}+\z", "")


def split_lines(c: Column) -> Column:
    """Lines without their ends; an end at the end of the text opens no line."""
    return F.split(F.regexp_replace(c, rf"(?:{LINE_END})\z", ""), LINE_END, -1)


def pieces(c: Column, inner: str, outer: str) -> Column:
    """A text cut, without loss, into runs that match ``inner`` and what lies between, which ``outer`` must match."""
    return F.regexp_extract_all(c, F.lit(f"(?s)({inner}|{outer})"), F.lit(1))


def each(c: Column, inner: str, outer: str, change: Callable[[Column], Column]) -> Column:
    return F.array_join(F.transform(pieces(c, inner, outer), change), "")


def unify_newlines(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def light(c: Column) -> Column:
    """Line ends unified, words broken at line ends joined, blanks at line ends removed, at most one blank line in a row."""
    c = F.regexp_replace(unify_newlines(c), rf"(?<=[{WORD}])-\n(?=[{WORD}])", "")
    return F.regexp_replace(F.regexp_replace(c, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")


@F.pandas_udf(StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    """All HTML entities (an Arrow function: there is no built-in)."""
    return texts.map(html.unescape, na_action="ignore")


def entities(c: Column, names: Iterable[str]) -> Column:
    """The named HTML entities, where a semicolon ends them; each once, so ``&amp;copy;`` becomes ``&copy;``."""
    for name in sorted(names, key=lambda x: x == "amp"):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(html.entities.html5[f"{name};"]))
    return c


@F.pandas_udf(StringType())
def compose(texts: pd.Series) -> pd.Series:
    """Unicode canonical composition (an Arrow function: there is no built-in)."""
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def decode_uni(c: Column) -> Column:
    """``/uniXXXX`` written out as the character it names."""
    code = r"/uni[0-9A-Fa-f]{4}"
    named = lambda x: F.decode(F.unhex(F.substring(x, 5, 4)), "UTF-16BE")
    return each(c, code, rf".+?(?={code}|\z)", lambda x: F.when(x.rlike(rf"^{code}\z"), named(x)).otherwise(x))


def is_noise(s: Column) -> Column:
    """Whether a stripped line is a conversion artefact: a comment, an open tag, one to three signs or letters, a source mark. Its first sign and its length settle most."""
    comment = s.rlike(r"(?d)^<!--.*-->\z")
    tag = ~s.contains(">")
    signs = ~s.rlike(f"[{LETTER}]") & s.rlike(r"^(?:[^\p{L}\p{N}]|\p{Nd}){1,3}\z")
    source = s.rlike(r"(?U)^@[A-Za-z0-9_.-]+\s*\(\d+(?:-\d+)?\)\z")
    letters = s.rlike(rf"(?iu)^(?!(?:да|нет|yes|no)\z)[{LETTER}]{{1,3}}\z")
    return (s != "") & ((s.startswith("<") & (comment | tag)) | ((F.length(s) <= 3) & (signs | letters)) | (s.startswith("@") & source))


def drop_noise_lines(c: Column) -> Column:
    # the stripped line is bound to a name of its own: a lambda would compute it at every mention
    bound = F.transform(split_lines(c), lambda x: F.struct(x.alias("line"), strip(x).alias("stripped")))
    return F.array_join(F.transform(F.filter(bound, lambda z: ~is_noise(z["stripped"])), lambda z: z["line"]), "\n")


def join_single_letters(c: Column) -> Column:
    """A capital cut off from its word is put back, unless it is a word itself and the rest isn't all capitals."""
    for valid, upper, any_ in ((ONE_LETTER_WORDS_CYR, "А-ЯЁ", CYR), (ONE_LETTER_WORDS_LAT, "A-Z", "A-Za-z")):
        c = F.regexp_replace(c, rf"(?U)\b(?:([{valid}])\s+([{upper}]{{2,}})|([{upper}&&[^{valid}]])\s+([{any_}]{{2,}}))\b", "$1$2$3$4")
    return c


def join_lines(c: Column) -> Column:
    """Words hyphenated at line ends are joined; a single line end becomes a blank unless a table, list or heading is next to it."""
    c = F.regexp_replace(c, rf"(?U)([{LETTER}])-\s*\n\s*([{LETTER}])", "$1$2")
    parts = F.regexp_extract_all(c, F.lit(r"(?s)([^\n]\n[^\n]|[^\n]+?(?=[^\n]\n[^\n]|\n|\z)|\n|[^\n]+)"), F.lit(1))
    crossing = lambda x: (F.length(x) == 3) & (F.substring(x, 2, 1) == "\n")
    structural = lambda x: (F.substring(x, 1, 1) == "|") | F.substring(x, 3, 1).isin(*"|#-*+•")
    return F.array_join(F.transform(parts, lambda x: F.when(crossing(x) & ~structural(x), F.regexp_replace(x, rf"(?U)\n{_BLANK}?", " ")).otherwise(x)), "")


def dashes_and_spaces(c: Column) -> Column:
    """Blanks around hyphens inside words go, a hyphen between blanks becomes a dash, blanks before punctuation go, runs of blanks shrink."""
    c = F.regexp_replace(c, rf"(?U)(?<=[{WORD}])\s*-\s*(?=[{WORD}])", "-")
    c = F.regexp_replace(c, r"(?mdU)(?<!^)\s-\s(?!-)", " — ")
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+([,.;:!?])", "$1"), r"[ \t]{2,}", " ")


def to_cyrillic(c: Column) -> Column:
    """Latin look-alikes as the Cyrillic letters they look like."""
    return F.translate(c, LOOKALIKE_LATIN, LOOKALIKE_CYRILLIC)


def fix_homoglyphs(c: Column) -> Column:
    """Look-alikes within runs of letters and hyphens that hold a Cyrillic letter; most texts hold none and are left as they are."""
    runs = each(c, rf"[{LETTER}\-]+", rf"[^{LETTER}\-]+", lambda x: F.when(x.rlike(f"[{CYR}]"), to_cyrillic(x)).otherwise(x))
    return F.when(c.rlike(f"[{CYR}]") & c.rlike("[A-Za-z]"), runs).otherwise(c)


def n_cyrillic(c: Column) -> Column:
    # runs of the letters go at once: a replacement costs many times what looking at a letter does, and one range is faster than two
    return F.length(c) - F.length(F.regexp_replace(c, "[А-яЁё]++", ""))


def n_latin(c: Column) -> Column:
    return F.length(c) - F.length(F.regexp_replace(c, "[A-Za-z]++", ""))


def russian_dominant(line: Column) -> Column:
    return line.rlike(f"[{CYR}]") & (n_cyrillic(line) >= n_latin(line))


def has_letter_case(c: Column, case: str) -> Column:
    """Whether a word has cased letters and all of them are of ``case`` (upper or lower)."""
    same = F.upper(c) if case == "upper" else F.lower(c)
    return (c == same) & (F.upper(c) != F.lower(c))


def apply_case(template: Column, word: Column) -> Column:
    """A word in the capitals of a template: all, none, or its first."""
    first = F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 2**30))
    head = F.substring(template, 1, 1)
    return F.when(has_letter_case(template, "upper"), F.upper(word)).when(has_letter_case(template, "lower"), F.lower(word)).when(has_letter_case(head, "upper"), first).otherwise(word)


_LOOKALIKES = f"^[{LOOKALIKE_LATIN}]{{1,5}}\\z"


def _as_cyrillic(token: Column) -> Column:
    return F.lower(to_cyrillic(token))


def asked_of_short_latin(c: Column) -> Column:
    """The words that short Latin tokens of two letters or more may stand for, to be looked up in a dictionary."""
    tokens = F.filter(F.regexp_extract_all(c, F.lit(f"[{WORD}]+"), F.lit(0)), lambda x: x.rlike(_LOOKALIKES) & (F.length(x) > 1))
    return F.transform(tokens, _as_cyrillic)


def _where_cyrillic(c: Column, fixed: Column) -> Column:
    """``fixed`` where a text has a Cyrillic letter at all; others, which are most, only get their lines joined again."""
    return F.when(c.rlike(f"[{CYR}]"), fixed).otherwise(F.array_join(split_lines(c), "\n"))


def fix_short_latin(c: Column, known: Column | None = None) -> Column:
    """Short Latin words of look-alikes in mostly Russian lines, where they are Russian words.

    ``known`` holds the words that a dictionary has; a single letter, and any word without a dictionary, goes by a short list.
    """
    listed = lambda x: F.upper(x).isin(SHORT_LATIN_WORDS)
    word = listed if known is None else lambda x: F.when(F.length(x) > 1, F.array_contains(known, _as_cyrillic(x))).otherwise(listed(x))
    # only what may be such a word is cut out of a line, and most lines hold none
    token = rf"(?=[{LOOKALIKE_LATIN}])(?<![{WORD}])[{LOOKALIKE_LATIN}]{{1,5}}+(?![{WORD}])"
    line = lambda s: each(s, token, rf".+?(?={token}|\z)", lambda x: F.when(x.rlike(_LOOKALIKES) & word(x), apply_case(x, _as_cyrillic(x))).otherwise(x))
    lines = F.array_join(F.transform(split_lines(c), lambda s: F.when(s.rlike(token) & russian_dominant(s), line(s)).otherwise(s)), "\n")
    return _where_cyrillic(c, lines)


def is_dice(token: Column) -> Column:
    return token.rlike(r"(?iu)^(?:\p{Nd}+[кk]|[кk]|\p{Nd}+d)\p{Nd}+(?:\+\p{Nd}+)?\z")


def _digits_to_letters(token: Column, upper: bool) -> Column:
    """Digits read for letters inside a token: 3, 6, 0 beside a Cyrillic letter and no digit, a last 4 after one."""
    small, large = "збой", "ЗБОЙ"
    for digit, letter in zip("3604", large if upper else small, strict=True):
        if digit == "4":
            enough = n_cyrillic(token) >= 2
            token = F.when(enough, F.regexp_replace(token, rf"(?<=[{CYR}])4\z", letter)).otherwise(token)
        else:
            token = F.regexp_replace(token, rf"(?<!\p{{Nd}}){digit}(?!\p{{Nd}})(?:(?<=[{CYR}]{digit})|(?=[{CYR}]))", letter)
    return token


def _with_token(x: Column) -> Column:
    """A piece beside the token at its end, which is looked for from there."""
    token = F.regexp_extract(x, rf"(?s)^(?:.*[^0-9{LETTER}\-])?([0-9{LETTER}\-]*)\z", 1)
    return F.struct(x.alias("piece"), token.alias("token"))


def _fix_token(z: Column, i: Column) -> Column:
    """A token at the end of what stands before it, with the digits in it read as letters."""
    x, token = z["piece"], z["token"]
    before = F.rtrim(F.substr(x, F.lit(1), F.length(x) - F.length(token)))
    opens = ((before == "") & (i == 0)) | before.rlike(r'[.?!:;—("«]\z')
    large, small = _digits_to_letters(token, True), _digits_to_letters(token, False)
    fixed = F.when(has_letter_case(token, "upper"), large).when(opens, F.concat(F.substring(large, 1, 1), F.substring(small, 2, 2**30))).otherwise(small)
    mixed = token.rlike(r"\p{Nd}") & token.rlike(f"[{CYR}]") & ~is_dice(token)
    kept = F.substr(x, F.lit(1), F.length(x) - F.length(token))
    return F.when(mixed, F.concat(kept, each(fixed, rf"[{LETTER}\-]+", rf"[^{LETTER}\-]+", to_cyrillic))).otherwise(x)


def fix_digits(c: Column) -> Column:
    """Digits read for letters, in mostly Russian lines outside fences and tables."""
    # tokens without a digit are as they were, so they are no pieces of their own
    token = rf"(?=[0-9{LETTER}])(?<![{WORD}])(?=[{LETTER}\-]*[0-9])[0-9{LETTER}](?:[0-9{LETTER}\-]*[0-9{LETTER}])?(?![{WORD}])"
    # a group that is repeated without going back (*+, ++) needs no stack; otherwise a long fence ends the executor
    fence = r"(?m:^)```[^\n]*+(?:\n(?!```)[^\n]*+)*+(?:\n```[^\n]*)?"
    skipped = lambda s: ~s.rlike("[3604]") | (F.regexp_count(s, F.lit(r"\|")) >= 2) | ~russian_dominant(s)
    line = lambda s: F.when(skipped(s), s).otherwise(F.array_join(F.transform(F.transform(pieces(s, rf".*?{token}", ".+"), _with_token), _fix_token), ""))
    lines = lambda x: F.array_join(F.transform(F.split(x, "\n", -1), line), "\n")
    block = lambda x: F.when(x.startswith("```"), x).otherwise(lines(x))
    text = F.array_join(split_lines(c), "\n")
    return _where_cyrillic(c, F.when(c.contains("```"), each(text, fence, rf".+?(?={fence}|\z)", block)).otherwise(lines(text)))


def drop_f_before_vowel(c: Column) -> Column:
    return F.regexp_replace(c, r"(?iuU)\bf(?=[аеиоуыэюя])", "")


def dedupe_words(c: Column) -> Column:
    """A word of four letters or more that is repeated at once stays once."""
    return F.regexp_replace(c, r"(?iuU)\b(\w{4,})\b(?:[ \t]+\1\b)++", "$1")


#: What may stand before a line's first word, and the word.
_FIRST_WORD = rf"(?U)^([#>\-*\s]{{0,5}})([{LETTER}]{{2,}}+)(?![{WORD}])"


def _first_word(line: Column) -> Column:
    return F.regexp_extract(line, _FIRST_WORD, 2)


def _with_letters(word: Column) -> Column:
    """A lower-case word behind each letter of its alphabet, in order."""
    letters = lambda alphabet: F.array(*[F.lit(x.lower()) for x in alphabet])
    return F.transform(F.when(word.rlike(f"[{CYR}]"), letters(RUSSIAN_ALPHABET)).otherwise(letters(LATIN_ALPHABET)), lambda x: F.concat(x, word))


def asked_of_drop_caps(c: Column) -> Column:
    """The lines' first words, and what they may have been with one more letter, to be looked up in a dictionary."""
    first = F.array_distinct(F.filter(F.transform(split_lines(c), lambda x: F.lower(_first_word(x))), lambda w: w != ""))
    return F.concat(first, F.flatten(F.transform(first, _with_letters)))


def restore_drop_caps(c: Column, known: Column | None = None) -> Column:
    """Missing first letters of lines: a first word that isn't ``known`` gets the first letter that makes it so; without a dictionary, no change."""
    if known is None:
        return c

    def line(x: Column) -> Column:
        word = _first_word(x)
        low = F.lower(word)
        made = F.get(F.filter(_with_letters(low), lambda w: F.array_contains(known, w)), F.lit(0))
        head = F.regexp_extract(x, _FIRST_WORD, 1)
        whole = F.concat(head, apply_case(word, made), F.substr(x, F.length(head) + F.length(word) + 1))
        return F.when((word == "") | F.array_contains(known, low) | made.isNull(), x).otherwise(whole)

    return F.array_join(F.transform(F.split(c, "\n", -1), line), "\n")


def final_spacing(c: Column) -> Column:
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"[ \t]+\n", "\n")
    return F.concat(strip(F.regexp_replace(c, r"\n{3,}", "\n\n")), F.lit("\n"))


#: Steps of the deep clean-up that ask a dictionary: what they ask, and what they do with what is known.
ASKING = {"drop_caps": (asked_of_drop_caps, restore_drop_caps), "short_latin": (asked_of_short_latin, fix_short_latin)}


def deep_steps() -> list[tuple[str, Callable[[Column], Column]]]:
    """The deep clean-up in order, by name, as it is without a dictionary."""
    return [
        ("newlines", unify_newlines),
        ("html", html_unescape),
        ("uni", decode_uni),
        ("light", light),
        ("noise", drop_noise_lines),
        ("letters", join_single_letters),
        ("lines", join_lines),
        ("dashes", dashes_and_spaces),
        ("drop_caps", restore_drop_caps),
        ("homoglyphs", fix_homoglyphs),
        ("short_latin", fix_short_latin),
        ("digits", fix_digits),
        ("f_prefix", drop_f_before_vowel),
        ("repeats", dedupe_words),
        ("compose", compose),
        ("spacing", final_spacing),
    ]


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(c)), r"[^a-z0-9]+", "_"), r"^_+|_+\z", "")


def truncate(c: Column, most: int) -> Column:
    """A text cut to ``most`` characters, with an ellipsis; 0 or less cuts nothing."""
    if most <= 0:
        return c
    cut = F.regexp_replace(F.substring(c, 1, most), rf"(?U){_BLANK}+\z", "")
    return F.when(F.length(c) > most, F.concat(cut, F.lit("…"))).otherwise(c)


def preview(c: Column, most: int = 320) -> Column:
    return truncate(strip(F.coalesce(c, F.lit(""))), most)


def line_preview(c: Column, most: int = 140, always: bool = False) -> Column:
    """One line of a text; with ``always`` every text that isn't empty ends in an ellipsis."""
    flat = F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" "))
    cut = F.substring(flat, 1, most)
    return F.when((F.length(flat) > most) | (F.lit(always) & (flat != "")), F.concat(cut, F.lit("…"))).otherwise(cut)


def tokens(c: Column) -> Column:
    """Lower-case words of a text, as evaluation compares them."""
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), rf"[^{WORD}]+"), lambda x: x != "")


def count_tokens(c: Column) -> Column:
    """The default offline token count: words and single signs. It differs from model tokenizers, which are injected."""
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(rf"[{WORD}]+|[^\s{WORD}]"))


def point_id(c: Column) -> Column:
    """Store identifiers: whole numbers and UUIDs as they are written canonically, other texts as version 5 UUIDs; null for null.

    Blank texts, negative whole numbers and values that are neither texts nor whole numbers raise.
    """
    s = strip(c.cast("string"))
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(s, "UTF-8")))
    variant = F.substring(F.lit("89ab"), 1 + F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4, F.lit(1))
    parts = [F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12)]
    bare = F.lower(F.regexp_replace(F.regexp_replace(s, r"(?i)^urn:uuid:", ""), r"[{}\-]", ""))
    canonical = F.regexp_replace(bare, r"^(.{8})(.{4})(.{4})(.{4})(.{12})\z", "$1-$2-$3-$4-$5")
    number = F.regexp_replace(s, r"^0+(?=[0-9])", "")
    kind = F.typeof(c)
    wrong = F.raise_error(F.concat(F.lit("a point id must be a text or a whole number, not "), kind)).cast("string")
    negative = F.raise_error(F.concat(F.lit("a point id must not be negative: "), s)).cast("string")
    texts = F.when(bare.rlike(r"^[0-9a-f]{32}\z"), canonical).when(s != "", F.concat_ws("-", *parts)).otherwise(F.raise_error(F.lit("a point id is blank")).cast("string"))
    whole = kind.isin("tinyint", "smallint", "int", "bigint")
    return F.when(s.isNull(), F.lit(None)).when(~whole & (kind != "string"), wrong).when(whole & s.startswith("-"), negative).when(s.rlike(r"^[0-9]+\z"), number).otherwise(texts)


def book_code(name: Column) -> Column:
    """A book's code by its file name: handbook names first, then master names, else the stem in capitals."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)\z", 1), r"(?<=.)\.[^.]*\z", "")
    low = F.lower(stem)
    return F.when(low.rlike("player|handbook"), "PHB").when(low.rlike("dungeon|master|dmg"), "DMG").otherwise(F.upper(stem))


def ocr_languages(codes: Column) -> Column:
    """Recognition languages: each once, trimmed and in small letters, ISO 639-2 for en and ru; English if none, Russian and English for null."""
    three = lambda x: F.when(x == "en", "eng").when(x == "ru", "rus").otherwise(x)
    given = F.transform(F.filter(F.array_distinct(codes), lambda x: x.isNotNull() & (x != "")), lambda x: three(F.lower(strip(x))))
    default = F.array(F.lit("rus"), F.lit("eng"))
    return F.when(codes.isNull(), default).when(F.size(given) == 0, F.array(F.lit("eng"))).otherwise(given)


# Beginnings of answers that say that nothing was found.
NOT_FOUND = ("к сожалению, в доступных правилах нет информации", "не удалось найти релевантные фрагменты")
NOTHING_FOUND_ANSWER = "Не удалось найти релевантные фрагменты."
MISSING_TEXT = "⚠️ Текст отсутствует в payload (переиндексируйте с полем text)."


def answer_found(c: Column) -> Column:
    s = F.lower(strip(F.coalesce(c, F.lit(""))))
    return (s != "") & ~s.startswith(NOT_FOUND[0]) & ~s.startswith(NOT_FOUND[1])


def _title(parts: list[Column], joint: str) -> Column:
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), joint)


def source_title(book: Column, chapter: Column, path: Column, chunk_id: Column, joint: str = " • ", inner: str = " › ", with_id: bool = True, fallback: str = "fragment") -> Column:
    """Where a chunk comes from; its id, or ``fallback``, if nothing else is known."""
    inside = F.array_join(F.filter(F.coalesce(path, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")), inner)
    named = F.when(chunk_id != "", F.concat(F.lit("id="), chunk_id))
    title = _title([book, chapter, inside, *([named] if with_id else [])], joint)
    return F.when(title != "", title).otherwise(F.coalesce(F.nullif(chunk_id, F.lit("")), F.lit(fallback)))


def context_block(rank: Column, title: Column, text: Column, most: int = 1500) -> Column:
    body = strip(F.coalesce(text, F.lit("")))
    body = truncate(F.when(body == "", F.lit(MISSING_TEXT)).otherwise(body), most)
    return F.concat(F.lit("["), rank.cast("string"), F.lit("] "), title, F.lit("\n"), body)


def user_prompt(question: Column, context: Column) -> Column:
    """The question with its context, in the form that answers expect."""
    # The wording of the prompt.
    head = (
        "Ответь на вопрос, используя только приведённые ниже выдержки из правил.\n"
        "Если ответа нет, скажи об этом напрямую.\n"
        "Каждое утверждение подтверждай ссылкой на источник вида [номер], где номер — блок из раздела «Контекст».\n\n"
        "Контекст:\n"
    )
    tail = "\n\nФормат ответа: связный текст на языке вопроса с пометками [номер]. После ответа можешь кратко перечислить использованные источники."
    return F.concat(F.lit(head), context, F.lit("\n\nВопрос: "), question, F.lit(tail))


def judge_verdict(c: Column) -> Column:
    """``score, reasoning`` from a judge's reply: its outermost JSON object; a reply without one scores 0."""
    found = F.from_json(F.regexp_extract(c, r"(?s)\{.*\}", 0), "score double, reasoning string")
    bad = F.struct(F.lit(0.0).alias("score"), F.concat(F.lit("unparsed: "), F.coalesce(c, F.lit(""))).alias("reasoning"))
    return F.when(found["score"].isNull() & found["reasoning"].isNull(), bad).otherwise(F.struct(F.coalesce(found["score"], F.lit(0.0)).alias("score"), F.coalesce(found["reasoning"], F.lit("")).alias("reasoning")))
