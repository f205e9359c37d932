"""Quality rules against a plain version."""

import re
from collections import Counter

import pytest

from pagemill.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"
NAV = "Home | News | Sport | Contact | About"
PROSE = "This is a sentence that ends as it should, with a mark."
TEXTS = [
    None, "", " \n\t ", "one two", PROSE, f"{PROSE}\n{NAV}", f"{NAV}\n{NAV}\n{PROSE}", "\n".join([PROSE] * 3),
    "a b c d e f g h i j k l m n", "x " * 40, "a b c d e q a b c d e r s t u v w x y z", "é è\x0bü\x0c\rß " * 3 + "\n\n" + PROSE,
    "\n".join(f"Line {i} says a thing of its own, number {i * 7}." for i in range(40)) + "\nAll rights reserved.",
    "word*** two%%% three&&& four$$$ five### " * 5, "LOUD!! VERY!! LOUD!! WORDS!! HERE!! ARE!! NOT!! A!! SENTENCE!! AT!! ALL!!",
    PROSE + "\nmenu entry\n" + PROSE[::-1] + ".", "1 2 3 4 5 1 2 3 4 5 1 2 3 4 5 6 7 8 9 10 11",
]


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen, twice = set(), 0
    for x in lines:
        twice += x in seen
        seen.add(x)
    base = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), twice, len(covered), base


def test_base(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), SCHEMA)
    got = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain(text), text


def test_lines(spark):
    more = "Another line of prose, which has nothing to fear from any rule."
    cases = [(1, f"{PROSE}\n{more}\nA | B | C | D"), (2, NAV + "\n" + NAV.lower() + "\n" + PROSE), (3, f"{PROSE}\n{more}\nAll rights reserved."), (4, PROSE + " " + more)]
    docs = spark.createDataFrame(cases, SCHEMA)
    got = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4)] == [True, False, True, True]
    assert [got[i].n_failed_lines for i in (1, 2, 3, 4)] == [1, 2, 1, 0]
    texts = {r.doc_id: r.text for r in quality.cleaned(docs).collect()}
    assert texts == {1: f"{PROSE}\n{more}", 3: f"{PROSE}\n{more}", 4: PROSE + " " + more}


@pytest.mark.parametrize("line", [
    "https://example.org/a/very/long/path see www.example.net/and/another/one too", "12.03.2019 | 14:55 | +49 30 1234567 | 0815", "Tous droits réservés par la maison, bien entendu.",
    "Es gelten die Nutzungsbedingungen dieser Seite, wie immer.", "© 2020 Some Company and others, in this town.", "==== ---- ~~~~ ++++ ==== ----",
])
def test_boilerplate_of_any_language(spark, line):
    """Lines that fail by their make-up or by a phrase; the rest of the document stays."""
    docs = spark.createDataFrame([(1, f"{PROSE}\n{line}\n{PROSE[::-1]}."), (2, f"{PROSE}\nVoir la page 12 du livre, ou http://a.b dit la même chose.")], SCHEMA)
    got = {r.doc_id: r for r in quality.verdicts(docs).collect()}
    assert (got[1].n_failed_lines, got[2].n_failed_lines) == (1, 0)


def test_short_lines_led_or_ended_by_white_space(spark):
    """A line of four words fails whatever white space is around it, and one of five stays."""
    around = ["{}", "{}\r", "\t{}", " \t{}\x0b\r", "  {} \x0c"]
    cases = [(10 * n + i, f"{PROSE}\n{a.format(' '.join('abcde'[:n]))}\n{PROSE}") for n in (4, 5) for i, a in enumerate(around)]
    got = {r.doc_id: r.n_failed_lines for r in quality.verdicts(spark.createDataFrame(cases, SCHEMA)).collect()}
    assert got == {10 * n + i: int(n == 4) for n in (4, 5) for i in range(len(around))}


def test_columns_and_rows(spark):
    docs = spark.createDataFrame([(1, PROSE, "x", 9, 1.0), (1, PROSE, "x", 9, 1.0), (None, None, None, None, None)], "doc_id long, text string, q string, _part int, n_chars double")
    assert sorted(quality.measured(docs).columns) == sorted([*docs.columns, "q_"])
    assert quality.cleaned(docs).columns == docs.columns
    assert [r.n_chars for r in quality.cleaned(docs).collect()] == [float(len(PROSE))] * 2
    assert quality.verdicts(docs).count() == 3
    assert quality.verdicts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_names_with_dots(spark):
    docs = spark.createDataFrame([(1, PROSE, 1, 2, 3)], "doc_id long, text string, `a.b` int, `c d` int, `q``x` int")
    out = quality.cleaned(docs)
    assert out.columns == docs.columns and out.collect() == docs.collect()
    empty = quality.cleaned(docs.limit(0))
    assert empty.columns == docs.columns and empty.count() == 0


def test_one_very_long_line(spark):
    """Lines of a megabyte without spaces or with one mark only: time stays about linear."""
    docs = spark.createDataFrame([(1, "x" * 1_000_000), (2, "|" + " word" * 200_000 + "."), (3, "a@" * 500_000), (4, "." * 1_000_000)], SCHEMA)
    got = {r.doc_id: r.kept for r in quality.verdicts(docs).collect()}
    assert got == dict.fromkeys((1, 2, 3, 4), False)


@pytest.mark.parametrize("n", [200_000])
def test_very_long(spark, n):
    text = " ".join(str(i % 1000) for i in range(n))
    r = quality.verdicts(spark.createDataFrame([(1, text)], SCHEMA)).first()
    assert r.n_words == n and r.n_repeat_words == n and r.base_failed
