"""Line-first quality rules.

Each line is judged by itself; the lines that fail are removed, and a document
is rejected when it loses too large a share of its text. A line with a word
fails when it is

* navigation: at least two bars or bullets, and one for every five words
  (``»`` is a bullet unless the line has ``«``, its other quotation mark);
* symbol noise: runs of two or more ``#*$%&`` on 30 % of its words;
* shouting: runs of two or more ``!`` on 30 % of its words;
* boilerplate: up to twelve words, of which phrases of :data:`BOILERPLATE`, or
  of :data:`CALLS` at the line's start, are more than two in five;
* unpunctuated: forty words or more without one of :data:`SENTENCE_MARKS`.

The rules look only at strong evidence, so that prose with an unusual line is
left alone. Repetition is measured on the whole document (``base_failed``).

Everything is DataFrame code over arrays of one row; there is no shuffle.

Edge cases: null text has no words and fails ``n_words < 50``; an empty table
gives an empty result; repeated rows give repeated results; other columns are
ignored by :func:`quality_report` and kept by :func:`clean_documents`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limber.llm.common import SPACE, text_of, words

#: Phrases of page furniture in the corpus's languages, looked for in lower case as whole words.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "accept all cookies", "cookie policy", "cookie settings", "enable javascript", "lorem ipsum", "our newsletter",
    "privacy policy", "skip to content", "skip to main content", "subscribe to", "terms and conditions", "terms of service", "terms of use",
    "alle rechte vorbehalten", "cookies akzeptieren", "cookie-einstellungen", "datenschutzerklärung", "javascript aktivieren", "nutzungsbedingungen", "zum inhalt springen",
    "tous droits réservés", "accepter les cookies", "activer javascript", "aller au contenu", "conditions d'utilisation", "mentions légales", "politique de confidentialité",
    "todos los derechos reservados", "aceptar cookies", "aceptar las cookies", "aviso legal", "ir al contenido", "política de cookies", "política de privacidad", "términos y condiciones",
)
#: Calls that are as good in a sentence, and count at a line's start alone.
CALLS = (
    "click here", "read more", "share this", "sign up", "log in",
    "hier klicken", "mehr lesen", "weiterlesen", "jetzt anmelden",
    "cliquez ici", "lire la suite", "en savoir plus", "inscrivez-vous",
    "haga clic aquí", "leer más", "seguir leyendo", "suscríbete",
)
_PHRASE = "|".join(BOILERPLATE)
#: Group 1 is the phrase.
FURNITURE = rf"(?:^|[^\p{{L}}\p{{N}}])({_PHRASE})(?:$|[^\p{{L}}\p{{N}}])"
CALL = rf"^[^\p{{L}}\p{{N}}]*({'|'.join(CALLS)})(?:$|[^\p{{L}}\p{{N}}])"
#: Marks that end or divide sentences, in the scripts that have some.
SENTENCE_MARKS = "[.!?:;…。．｡！？：；।॥؟؛۔։።፧។၊။]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A document is rejected when the failing lines hold more than this share of its word characters.
MAX_LOST_PERCENT = 50


#: What a line without has neither bars, noise nor shouts; most lines need no closer look.
SUSPICIOUS = "[|•»]|[#*$%&]{2}|!{2}"


def words_in(line: Column) -> Column:
    return F.regexp_count(line, F.lit(SPACE.replace("[", "[^", 1) + "+"))


def line_fails(line: Column, n: Column | None = None) -> Column:
    """Whether a line (of ``n`` words) is to be removed; lines without a word never are."""
    n = words_in(line) if n is None else n
    bars = F.regexp_count(line, F.lit("[|•]")) + F.when(F.contains(line, F.lit("«")), 0).otherwise(F.regexp_count(line, F.lit("»")))
    noise = F.regexp_count(line, F.lit("[#*$%&]{2,}"))
    shouts = F.regexp_count(line, F.lit("!{2,}"))
    low = F.lower(line)
    found = F.concat(F.regexp_extract_all(low, F.lit(FURNITURE), 1), F.regexp_extract_all(low, F.lit(CALL), 1))
    furniture = low.rlike(f"{FURNITURE}|{CALL}") & (5 * F.regexp_count(F.array_join(found, " "), F.lit("[^ ]+")) > 2 * n)
    marked = ((bars >= 2) & (bars * 5 >= n)) | ((noise >= 1) & (noise * 10 >= n * 3)) | ((shouts >= 1) & (shouts * 10 >= n * 3))
    return (line.rlike(SUSPICIOUS) & marked) | ((n >= 1) & (n <= 12) & furniture) | ((n >= 40) & ~line.rlike(SENTENCE_MARKS))


def _repeat_words(sorted_windows: Column) -> Column:
    """Words covered by windows that occur twice, from the windows sorted by (key, position)."""
    s = sorted_windows
    twice = F.filter(s, lambda x, i: (F.get(s, i - 1)["k"] == x["k"]) | (F.get(s, i + 1)["k"] == x["k"]))
    starts = F.sort_array(F.transform(twice, lambda x: x["p"]))
    zero = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
    return F.aggregate(starts, zero, step, lambda a: a["n"])


def _measured(df: DataFrame, keep: list[Column], text_col: str) -> DataFrame:
    """``keep`` with the measures of each text. Each select feeds columns used more than once, so none is computed twice."""
    chars = lambda t: F.length(F.regexp_replace(t, SPACE + "+", "")).cast("long")
    split = df.select(*keep, text_of(text_col).alias("t")).select("*", words(F.col("t")).alias("w"), F.transform(F.split("t", "\n"), lambda x: F.struct(x.alias("x"), words_in(x).alias("n"))).alias("lines"))
    n = F.size("w")
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    w = F.col("w")
    windows = F.transform(starts, lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("k"), i.alias("p")))
    lines = lambda test: F.transform(F.filter("lines", test), lambda y: y["x"])  # noqa: E731  words are counted once a line
    counted = split.select(
        *split.columns[: len(keep)],
        "t",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.sort_array(windows).alias("windows"),
        lines(lambda y: y["n"] > 0).alias("worded"),
        lines(lambda y: ~line_fails(y["x"], y["n"])).alias("good"),
    )
    return counted.select(
        *split.columns[: len(keep)],
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("worded") - F.size(F.array_distinct("worded"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("windows")).alias("n_repeat_words"),
        F.array_join("good", "\n").alias("clean_text"),
        chars(F.array_join("good", "")).alias("clean_chars"),
    )


def _base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _kept(max_lost_percent: int) -> Column:
    lost = F.col("word_chars") - F.col("clean_chars")
    return ~_base_failed() & (100 * lost <= max_lost_percent * F.col("word_chars"))


def quality_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """One row per input row: the id, the measures, clean_chars, base_failed and kept."""
    m = _measured(df, [F.col(id_col)], text_col)
    return m.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "clean_chars",
        _base_failed().alias("base_failed"), _kept(max_lost_percent).alias("kept"),
    )


def clean_documents(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars", max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """The rows that are kept, their failing lines removed, with the columns of ``df``; ``chars_col`` is set to the new length."""
    m = _measured(df, [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("doc")], text_col)
    # A plain filter would be pushed below the measures, which would then be computed for each word.
    judged = m.select("doc", "clean_text", _kept(max_lost_percent).alias("kept"))
    one = F.explode_outer(F.filter(F.array(F.struct("doc", "clean_text", "kept")), lambda x: x["kept"])).alias("x")
    left = judged.select(one).where("x is not null").select("x.doc", "x.clean_text")
    new = {text_col: F.col("clean_text"), chars_col: F.length("clean_text").cast("long")}
    return left.select(*[new.get(c, F.col("doc")[c]).alias(c) for c in df.columns])
