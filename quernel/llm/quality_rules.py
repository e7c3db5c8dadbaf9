"""Quality rules, line first: rules judge every line, failing lines go, and documents that lose too much text are rejected.

A line (of those with a word) fails when it has no letter, when marks that
prose seldom uses make up a mark in four words, when capitals are most of its
letters, when it is a few words without an end mark (headings and menu entries of
any language), when it is a menu entry or a short boilerplate phrase, or when it
equals an earlier line. A document is rejected when the base rules fail (too few words,
or too many inside repeated windows of eight words), or when the lines left hold
less than half of its word characters.

Everything is a column expression of one row: no shuffle, no Python. Windows are
compared by a 64-bit hash; only texts in which one occurs twice are sorted.

Defined cases: a null text counts as empty, and an empty text has no words and
fails; a text shorter than a window repeats nothing; rows that are alike get
alike verdicts; other columns are carried along by `keep`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, text_or_empty, words_of

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30
#: Share of a document's word characters that clean lines must hold.
MIN_LEFT = 0.5
MARKS_A_WORD = 0.25
CAPITALS = 0.6
MIN_LETTERS = 10
BOILERPLATE_WORDS = 12
#: Words up to which a line needs an end mark.
SHORT_LINE = 5
END_MARK = r"[.!?…:;。！？][\"'”’»)\]]*[\x20\x09-\x0D]*$"
#: Phrases and menu entries, matched in any case.
BOILERPLATE = (
    "all rights reserved|terms of (use|service)|privacy policy|cookie policy|accept (all )?cookies|this (web)?site uses cookies|click here|"
    "sign up for|subscribe to|follow us|share this|powered by|skip to (main )?content|back to top|enable javascript|"
    "tous droits réservés|mentions légales|politique de confidentialité|accepter les cookies|cliquez ici|abonnez-vous|suivez-nous|"
    "alle rechte vorbehalten|nutzungsbedingungen|datenschutzerklärung|cookies akzeptieren|hier klicken|newsletter abonnieren|folgen sie uns|"
    "todos los derechos reservados|aviso legal|política de privacidad|aceptar (las )?cookies|haga clic aquí|suscríbete|síguenos"
)
MENU = "home|menu|search|log ?in|log ?out|sign ?in|sign ?up|register|contact( us)?|about( us)?|next|previous|share|print|help|faq|sitemap|top|more|read more"

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def _line_fails(line: Column) -> Column:
    n_words = F.length(F.regexp_replace(line, f"[^\\x20\\x09-\\x0D]+{SPACE_CLASS}*", "x"))
    letters = F.length(F.regexp_replace(line, r"\P{L}+", ""))
    capitals = F.length(F.regexp_replace(line, r"\P{Lu}+", ""))
    marks = F.length(F.regexp_replace(line, r"[^#*$%&|<>!]+", ""))
    return (
        (letters == 0)
        | (marks > MARKS_A_WORD * n_words)
        | ((n_words <= SHORT_LINE) & ~line.rlike(END_MARK))
        | ((letters >= MIN_LETTERS) & (capitals > CAPITALS * letters))
        | line.rlike(f"(?i)^{SPACE_CLASS}*({MENU}){SPACE_CLASS}*$")
        | ((n_words <= BOILERPLATE_WORDS) & line.rlike(f"(?i){BOILERPLATE}"))
    )


def _word_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"{SPACE_CLASS}+", ""))


def measured(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df as one struct column ``row``, with METRICS and ``clean_text``, the lines that pass."""
    t = df.select(F.struct("*").alias("row"), text_or_empty(text_col).alias("t"))
    t = t.withColumn("w", F.transform(words_of(F.col("t")), lambda w: F.xxhash64(w))).withColumn("lines", F.filter(F.split("t", "\n", -1), lambda line: line.rlike(f"[^\\x20\\x09-\\x0D]")))
    t = t.withColumn("n_words", F.size("w").cast("long"))
    t = t.withColumn("h", F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("w", i, WINDOW)))))
    twice = F.size(F.array_distinct("h")) < F.size("h")
    t = t.withColumn("by_hash", F.when(twice, F.sort_array(F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, k: (F.get("by_hash", k - 1)["h"] == x["h"]) | (F.get("by_hash", k + 1)["h"] == x["h"])
    t = t.withColumn("at", F.sort_array(F.transform(F.filter("by_hash", lambda x, k: F.coalesce(same(x, k), F.get("by_hash", k - 1)["h"] == x["h"], F.get("by_hash", k + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])))
    covered = F.aggregate(F.transform("at", lambda x, k: F.coalesce(F.least(F.lit(WINDOW), x - F.get("at", k - 1)), F.lit(WINDOW)).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    t = t.withColumn("first_lines", F.array_distinct("lines")).withColumn("left", F.filter("first_lines", lambda line: ~_line_fails(line)))
    t = t.select(
        "row",
        "n_words",
        _word_chars(F.col("t")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size("first_lines")).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.array_join("left", "\n").alias("clean_text"),
    )
    t = t.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")))
    return t.withColumn("kept", ~F.col("base_failed") & (_word_chars(F.col("clean_text")) >= MIN_LEFT * F.col("word_chars")))


def decide(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    return measured(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("row.doc_id", *METRICS)


def _kept(df: DataFrame, text_col: str) -> DataFrame:
    """row and clean_text of the rows that are kept. The verdict goes through a generator, as the optimizer would else copy its whole expression into the filter."""
    t = measured(df, text_col).select("row", F.explode(F.array(F.struct("kept", "clean_text"))).alias("found"))
    return t.where("found.kept").select("row", F.col("found.clean_text").alias("clean_text"))


def keep(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df that are kept, with their own columns and whole texts."""
    return _kept(df, text_col).select("row.*")


def clean(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that are kept, their text without the lines that fail."""
    return _kept(df, text_col).withColumn("row", F.col("row").withField(text_col, F.col("clean_text"))).select("row.*")
