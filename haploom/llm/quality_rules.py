"""Quality rules: line-first cleaning, with DataFrame functions only.

Every line of a text is judged on its own (punctuation, navigation, symbols,
repetition, boilerplate); failing lines are removed, and a document that loses
too large a share of its words is rejected. Nothing is shuffled: all work is
inside a row, on arrays.

Defined cases: a null text counts as empty; an empty text has no words, so its
base check fails and it is not kept; texts may be of any length; null and
repeated ids are judged row by row; an empty table gives no rows; extra
columns are carried through by ``clean`` unless they bear the name of a column
it adds, which it then replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, UPPER, let, word_count, words_of

SYMBOLS = "#*$%&|<>"
#: What stands between the entries of a navigation bar.
BARS = "|•»"
#: Phrases of web page furniture in English, German, French and Spanish, matched in lines whose ASCII letters are lower-cased.
BOILERPLATE = [
    "all rights reserved", "accept cookies", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "enable javascript", "javascript is disabled", "lorem ipsum", "sign up for our newsletter", "click here to", "share this post",
    "alle rechte vorbehalten", "cookies akzeptieren", "nutzungsbedingungen", "newsletter abonnieren",
    "tous droits réservés", "accepter les cookies", "politique de confidentialité", "mentions légales",
    "todos los derechos reservados", "aceptar cookies", "política de privacidad", "términos de uso",
]
#: What stands in a web address.
LINK = "://"
#: What a sentence may end with.
ENDS = ".!?:;…\"'”’»)]"
MIN_WORDS, REPEAT_PERCENT = 50, 50
MAX_LOST_PERCENT = 30


def repeated_words(words: Column) -> Column:
    """Number of words inside 3-word windows that occur twice or more, first occurrences included.

    Windows are compared by a 64-bit hash: (hash, position) pairs are sorted,
    equal neighbours mark both their windows, and the marked positions' union
    of three words each is summed. All steps are linear or n log n in a row.
    """

    def windows(w: Column) -> Column:
        n = F.size(w)
        return F.when(n < 3, F.array().cast("array<struct<h:bigint,p:int>>")).otherwise(
            F.transform(F.slice(w, 1, F.greatest(n - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.cast("int").alias("p")))
        )

    def covered(s: Column) -> Column:
        marked = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return let(
            F.sort_array(F.transform(marked, lambda x: x["p"])),
            lambda p: F.aggregate(p, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"), x.alias("last")), lambda acc: acc["n"]),
        )

    def exact(w: Column) -> Column:
        return let(windows(w), lambda g: F.when(F.size(F.array_distinct(F.transform(g, lambda x: x["h"]))) == F.size(g), F.lit(0).cast("long")).otherwise(let(F.sort_array(g), covered)))

    return let(words, exact)


def _ratio_over(part: Column, whole: Column, percent: int) -> Column:
    return part * 100 > whole * percent


def bad_line(line: Column, marks: Column, repeats: Column, furniture: Column, links: Column) -> Column:
    """Whether a line with words fails a rule: symbols, navigation, shouting, few kinds of words, boilerplate, links for every other word, or a bare fragment.

    The last four columns tell of the whole text whether it has any mark,
    ten words in repeated windows, a phrase of page furniture or a link at all; the
    rules that need one are skipped, in every line, where there is none. The
    repetition rule is so defined; for the others that changes no verdict.
    """
    n = F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+"))

    def count(chars: str) -> Column:
        return F.length(line) - F.length(F.translate(line, chars, ""))

    marked = let(n, lambda k: _ratio_over(count(SYMBOLS), k, 40) | _ratio_over(count(BARS), k, 30) & (count(BARS) >= 2) | _ratio_over(count("!"), k, 60))
    few_kinds = let(words_of(line), lambda w: (F.size(w) >= 12) & (F.size(F.array_distinct(w)) * 4 <= F.size(w)))
    fragment = ~F.contains(F.lit(ENDS), F.substring(F.rtrim(line), -1, 1)) & (n <= 2)
    linked = (F.length(line) - F.length(F.replace(line, F.lit(LINK), F.lit("")))) * 2 >= n * len(LINK)
    return fragment | (links & F.contains(line, F.lit(LINK)) & linked) | (marks & marked) | (repeats & few_kinds) | (furniture & let(F.translate(line, UPPER, LOWER), _furniture))


def _furniture(low: Column) -> Column:
    found = F.lit(False)
    for phrase in BOILERPLATE:
        found = found | F.contains(low, F.lit(phrase))
    return found


def _has_word(line: Column) -> Column:
    return F.length(F.translate(line, BLANKS, "")) > 0


def clean(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept_words, kept, clean_text.

    ``clean_text`` holds the lines that pass (and lines without words), joined
    as they were. ``kept`` is false if the base check fails or if more than
    ``MAX_LOST_PERCENT`` percent of the words stood in removed lines.
    """
    t = F.coalesce(F.col(text), F.lit(""))

    def facts(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))

    def lines(f: Column) -> Column:
        flags = F.struct(
            (F.length(F.translate(t, SYMBOLS + BARS + "!", "")) < F.length(t)).alias("marks"),
            (f["n_repeat_words"] >= 10).alias("repeats"),
            let(F.translate(t, UPPER, LOWER), _furniture).alias("furniture"),
            F.contains(t, F.lit(LINK)).alias("links"),
            F.split(t, "\n").alias("lines"),
        )
        return let(flags, lambda g: verdict(f, g, F.filter(g["lines"], lambda x: ~_has_word(x) | ~bad_line(x, g["marks"], g["repeats"], g["furniture"], g["links"]))))

    def verdict(f: Column, g: Column, good: Column) -> Column:
        return let(
            good,
            lambda x: F.struct(
                f["n_words"].alias("n_words"),
                f["n_repeat_words"].alias("n_repeat_words"),
                let(F.filter(g["lines"], _has_word), lambda y: (F.size(y) - F.size(F.array_distinct(y))).cast("long")).alias("n_dup_lines"),
                F.when(F.size(x) < F.size(g["lines"]), F.concat_ws("\n", x)).alias("cleaned"),
            ),
        )

    # one value that is evaluated once; separate columns would be inlined into every line's check
    f = let(let(words_of(F.col(text)), facts), lines)
    own = "_f"
    while own in docs.columns:
        own += "_"
    out = docs.withColumn(own, f)
    cleaned = F.col(f"{own}.cleaned")
    out = out.withColumns(
        {
            "n_words": F.col(f"{own}.n_words"),
            "word_chars": F.length(F.translate(t, BLANKS, "")).cast("long"),
            "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": F.col(f"{own}.n_dup_lines"),
            "n_repeat_words": F.col(f"{own}.n_repeat_words"),
            "base_failed": (F.col(f"{own}.n_words") < MIN_WORDS) | (F.col(f"{own}.n_repeat_words") * 100 > F.col(f"{own}.n_words") * REPEAT_PERCENT),
            "kept_words": F.when(cleaned.isNull(), F.col(f"{own}.n_words")).otherwise(word_count(cleaned)),
            "clean_text": F.coalesce(cleaned, t),
        }
    )
    return out.withColumn("kept", ~F.col("base_failed") & ((F.col("n_words") - F.col("kept_words")) * 100 <= F.col("n_words") * MAX_LOST_PERCENT)).drop(own)
