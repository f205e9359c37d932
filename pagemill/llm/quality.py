"""Line-first quality rules.

Each line is judged by itself: punctuation, navigation and boilerplate rules,
the latter by phrases and, in any language, by links and letters' share.
Failing lines are removed, and a document that loses too large a share of its
text is rejected. Only DataFrame functions: each document is worked on inside
its own row, nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import SPACE, WORD, free_name, named, text_of, word_count, words_of

#: Separators as found between the entries of a menu.
NAVIGATION = r"([|»›•·].*){3}|(\s>\s.*){2}"
#: Runs of marks in place of punctuation: words hung with symbols, or shouting.
PUNCTUATION = r"([#*$%&]{2}.*){3}|([!?]{2}.*){3}"
#: A line's end: a mark that ends a sentence, and closing quotes or brackets.
ENDED = r"[.!?…:;,][\"'”’»)\]]*[\x20\x09-\x0D]*$"
#: Legal and site text that says nothing about the page, in the languages that pages are mostly written in. All phrases begin at one word border.
BOILERPLATE = (
    r"(?i)\b(?:(?:all rights reserved|tous droits réservés|alle rechte vorbehalten|todos los derechos reservados|tutti i diritti riservati"
    r"|licen[cs]ed under|sous licence|lizenziert unter|bajo la licencia"
    r"|terms of (?:use|service)|conditions générales|nutzungsbedingungen|allgemeine geschäftsbedingungen|términos de uso"
    r"|privacy policy|politique de confidentialité|datenschutzerklärung|política de privacidad"
    r"|cookie (?:policy|settings|preferences)|(?:enable|requires|activer|aktivieren|activar) javascript"
    r"|lorem ipsum|subscribe to our|click here|powered by|spdx-license-identifier)\b|copyright (?:©|\(c\)|\d{4}))|[©®]\s*\d{4}"
)
#: A link.
LINK = r"(https?://|www\.)[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Rules:
    """Limits of the rules."""

    least_words: int = 10
    most_repeated: int = 20  # percent of words in repeated windows
    window: int = 5
    short_line: int = 4  # an unended line of up to so many words fails
    most_lost: float = 0.3  # share of the non-space characters


def _repeated_words(words: Column, window: int) -> Column:
    """How many words lie in windows of so many words that are found twice or more.

    Window hashes are sorted together with their places, places with an equal
    neighbour are put in order, and each adds up to `window` words, fewer if the
    next place is nearer. Texts without equal windows, nearly all, end at a
    comparison of two sizes.
    """
    n = F.size(words) - window + 1
    places = F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1)
    hashes = F.transform(places, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(window)]))

    def counted(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = F.filter(
                s,
                lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
            )
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        def covered(p: Column) -> Column:
            each = F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window))))
            return F.aggregate(each, F.lit(0), lambda a, x: a + x)

        return _let(pairs, lambda s: _let(repeated(s), covered))

    value = _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), counted(h)).otherwise(0))
    return F.when(n > 1, value).otherwise(0).cast("long")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once: a one-element array is bound by a lambda."""
    return F.transform(F.array(value), body)[0]


def _black(x: Column) -> Column:
    """Characters other than white space."""
    return F.char_length(F.regexp_replace(x, f"{SPACE}+", ""))


def failed(x: Column, rules: Rules) -> Column:
    """Does a line with words fail? By navigation, punctuation or boilerplate patterns; as a short line without an end; by
    links that make up over half of it, or letters that make up less than a third: evidence in any language."""
    unended = ~F.rlike(x, F.lit(ENDED)) & (word_count(x) <= rules.short_line)
    pattern = F.rlike(x, F.lit(NAVIGATION)) | F.rlike(x, F.lit(PUNCTUATION)) | F.rlike(x, F.lit(BOILERPLATE))
    letters = F.char_length(F.regexp_replace(x, r"[^\p{L}\p{M}]+", ""))
    linked = F.rlike(x, F.lit(LINK)) & (2 * _black(F.regexp_replace(x, LINK, "")) < _black(x))
    return pattern | unended | (3 * letters < _black(x)) | linked


def measured(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:  # noqa: B008
    """docs with one more struct column q of measures and verdicts.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    n_lines, n_failed_lines, lost (share of non-space characters in failed
    lines), cleaned (text without the failed lines), kept. A null text counts as
    an empty one and fails. Every row gets its own verdict; repeated rows get
    equal ones. The columns of docs stay as they are, whatever their names. A
    very long text is one row's work, in time about linear in its length.
    """
    raw = text_of(text)

    def judged(w: Column, ls: Column) -> Column:
        """ls are all lines, blank ones too; each line's patterns are tried once."""
        black = F.filter(ls, lambda x: F.rlike(x, F.lit(WORD)))
        flags = F.transform(ls, lambda x: F.rlike(x, F.lit(WORD)) & failed(x, rules))
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.char_length(F.regexp_replace(raw, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            _let(black, lambda b: F.struct(F.size(b).alias("n"), (F.size(b) - F.size(F.array_distinct(b))).cast("long").alias("twice"))).alias("lines"),
            _repeated_words(w, rules.window).alias("n_repeat_words"), flags.alias("failed"),
        )

    part = free_name(docs, "_part")
    split = F.split(raw, "\n")
    # a generator of one row: what reads the measures, filters above all, can't be merged with it and compute them again
    once = F.explode(F.array(_let(F.struct(words_of(raw).alias("w"), split.alias("l")), lambda v: judged(v["w"], v["l"]))))
    out = docs.select("*", once.alias(part))
    p = F.col(part)
    n_failed = F.size(F.filter(p["failed"], lambda f: f))
    bad = (p["n_words"] < rules.least_words) | (100 * p["n_repeat_words"] > rules.most_repeated * p["n_words"])
    gone = F.aggregate(F.filter(split, lambda x, i: F.get(p["failed"], i)), F.lit(0), lambda a, x: a + _black(x))
    lost = F.when(n_failed > 0, gone / p["word_chars"]).otherwise(F.lit(0.0))
    left = F.filter(split, lambda x, i: ~F.get(p["failed"], i))
    rest = F.when(n_failed > 0, F.array_join(left, "\n")).otherwise(F.col(text))
    return out.withColumn(
        free_name(docs, "q"),
        F.struct(
            *[p[c].alias(c) for c in ("n_words", "word_chars", "n_symbols")], p["lines"]["twice"].alias("n_dup_lines"), p["n_repeat_words"].alias("n_repeat_words"),
            p["lines"]["n"].alias("n_lines"), n_failed.alias("n_failed_lines"), bad.alias("base_failed"), lost.alias("lost"),
            (~bad & (lost <= rules.most_lost)).alias("kept"), rest.alias("cleaned"),
        ),
    ).drop(part)


def verdicts(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """One row for each document: doc_id, measures and verdict, without its text."""
    q = measured(docs.select("doc_id", "text"), rules)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines", "lost"]
    return q.select("doc_id", *[F.col("q")[c].alias(c) for c in names])


def cleaned(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:  # noqa: B008
    """The documents kept, their failed lines removed and n_chars, where there is such a column, counted anew.

    A row stays or goes by its own text: null, empty and blank texts go, equal
    rows stay or go together, very long texts are judged whole. Columns of any
    name come out as they went in. An empty table stays empty.
    """
    q = free_name(docs, "q")
    out = measured(docs, rules).where(F.col(q)["kept"]).withColumn("text", F.col(q)["cleaned"])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*named(docs))
