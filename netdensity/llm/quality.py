"""Quality rules, lines first: clean each line, then judge what is left.

A line with a word fails if it is
* symbols: over 8 % of its characters other than white space are one of ``#*$%&|<>``,
* shouting: two words or more, and no lower-case letter although there are letters,
* navigation: fewer than five words and no closing punctuation,
* boilerplate: it holds one of the fixed phrases.
Failing lines are removed. A document is rejected if it fails the base rules (too
few words, or mostly repeated three-word windows) or if over 30 % of its
characters stood in removed lines.

Everything here is DataFrame expressions over one row at a time: no shuffle, and
no state beyond a document. Repeated windows are found by sorting the document's
window hashes, so the work grows as n log n with its length.

Defined results: a null text counts as empty; a document without words has counts of 0 and fails
the base rules; repeated rows are judged alike; a very long text is judged whole; an empty table
gives no rows; other columns, whatever their names, pass, but for __q, which is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netdensity.llm.common import BLANKS, WORD, free, let, without, words_of

SYMBOLS = "#*$%&|<>"
MAX_SYMBOLS = 0.08
SHORT_LINE = 5
MAX_LOST = 0.3
MIN_WORDS = 50
CLOSING = "[.!?:;…\"'”’»)\\]]$"
#: Phrases of pages' furniture, in lower case.
PHRASES = ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "lorem ipsum", "click here", "sign in", "subscribe to")


def bad_line(line: Column) -> Column:
    """Whether a line that has a word fails a rule."""

    def judge(t: Column) -> Column:
        solid = F.char_length(without(t, BLANKS))
        symbols = F.char_length(t) - F.char_length(without(t, SYMBOLS))
        n = F.regexp_count(t, F.lit(WORD))
        low = F.lower(t)
        phrase = F.lit(False)
        for p in PHRASES:
            phrase = phrase | F.contains(low, F.lit(p))
        shouting = (n >= 2) & (t == F.upper(t)) & (t != low)
        navigation = (n < SHORT_LINE) & ~F.rlike(t, F.lit(CLOSING))
        return (symbols > MAX_SYMBOLS * solid) | shouting | navigation | phrase

    return let(F.btrim(line, F.lit(BLANKS)), judge)


def repeated_words(words: Column) -> Column:
    """How many of the words lie in a three-word window that the array holds twice or more."""

    def covered(starts: Column) -> Column:
        n = F.size(starts)
        return F.aggregate(
            F.sequence(F.lit(1), n), F.lit(0),
            lambda a, k: a + F.when(k == n, 3).otherwise(F.least(F.lit(3), F.get(starts, k) - F.get(starts, k - 1))),
        )

    def sorted_starts(pairs: Column) -> Column:
        n = F.size(pairs)
        twice = F.filter(pairs, lambda p, i: F.coalesce(F.get(pairs, i - 1)["h"] == p["h"], F.lit(False)) | F.coalesce((i + 1 < n) & (F.get(pairs, i + 1)["h"] == p["h"]), F.lit(False)))
        return F.sort_array(F.transform(twice, lambda p: p["i"]))

    def by_hash(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(let(pairs, sorted_starts), covered))

    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(windows, by_hash)).cast("long")


def judge(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with __q: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_chars, kept, clean."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.transform(F.split(t, "\n", -1), lambda x: F.struct(x.alias("t"), (F.btrim(x, F.lit(BLANKS)) != "").alias("full")))

    def of_lines(ls: Column) -> Column:
        full = F.transform(F.filter(ls, lambda x: x["full"]), lambda x: x["t"])
        marked = F.transform(ls, lambda x: F.struct(x["t"].alias("t"), F.when(x["full"], bad_line(x["t"])).otherwise(F.lit(False)).alias("bad")))
        return F.struct(
            let(full, lambda f: F.size(f) - F.size(F.array_distinct(f))).cast("long").alias("n_dup_lines"),
            let(marked, lambda m: F.struct(
                F.aggregate(m, F.lit(0), lambda a, x: a + F.when(x["bad"], F.char_length(without(x["t"], BLANKS))).otherwise(0)).cast("long").alias("lost"),
                F.array_join(F.transform(F.filter(m, lambda x: ~x["bad"]), lambda x: x["t"]), "\n").alias("clean"),
            )).alias("c"),
        )

    (own,) = free(docs, "m")
    measured = docs.withColumn(
        own,
        F.struct(
            let(words_of(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
            F.char_length(without(t, BLANKS)).cast("long").alias("word_chars"),
            (F.char_length(t) - F.char_length(without(t, SYMBOLS))).cast("long").alias("n_symbols"),
            let(lines, of_lines).alias("l"),
        ),
    )
    m = F.col(own)
    n, rep = m["w"]["n_words"], m["w"]["n_repeat_words"]
    failed = (n < MIN_WORDS) | (100 * rep > 50 * n)
    lost = m["l"]["c"]["lost"]
    return measured.withColumn(
        "__q",
        F.struct(
            n.alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["l"]["n_dup_lines"].alias("n_dup_lines"), rep.alias("n_repeat_words"),
            failed.alias("base_failed"), lost.alias("lost_chars"), (~failed & (lost <= MAX_LOST * m["word_chars"])).alias("kept"), m["l"]["c"]["clean"].alias("clean"),
        ),
    ).drop(own)
