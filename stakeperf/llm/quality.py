"""Quality rules over documents, line by line first.

1. Base figures of the whole text: words, characters, symbols, repeated lines,
   words inside repeated three-word windows.
2. Line-first cleaning: every line with a word is judged on its own.
   - punctuation: no sentence ends in it, or marks of ``#*$%&|<>`` or shouted
     ``!`` and ``?`` come as often as words;
   - navigation: items between separators, or nothing but a menu entry;
   - boilerplate: licences, rights, cookies, policies and the like.
   Failing lines go.
3. A document is rejected if it fails a base rule, or if the failing lines hold
   more than ``max_loss`` percent of its words.

Everything is built from DataFrame functions and stays inside one row: no
shuffle, no Python.  Repeated windows of a row are found by sorting its windows
(words joined by one space, which no word holds), so the work is n log n in the
words of a text and equal windows are equal strings, not equal hashes.

Defined results: null text has no words and no lines, so it fails the base rule
and ``clean`` leaves it null; text without words likewise; rows that repeat an
id are judged one by one; an empty table gives no rows; ``clean`` carries other
columns along, and the names of its own columns get underscores in front where
the table has them already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stakeperf.llm.common import fresh

MIN_WORDS, MAX_REPEATED, MAX_LOSS = 50, 50, 40
SYMBOLS = "#*$%&|<>"
#: Every separator of words but the space.
_BLANKS = "\t\n\x0b\x0c\r"

#: What navigation and boilerplate lines say.
SEPARATORS = "|»›•·"
MENU = ("home", "menu", "login", "log in", "sign in", "sign up", "next", "previous", "back to top", "read more", "skip to content", "share", "search", "contact", "about us")
BOILERPLATE = ("all rights reserved", "licensed under", "released under the", "privacy policy", "terms of service", "terms of use", "cookie policy", "accept cookies", "copyright ©", "(c) copyright", "enable javascript", "subscribe to our", "lorem ipsum")


def _spaced(text: Column) -> Column:
    """``text`` with a space for every separator of words."""
    for c in _BLANKS:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _count(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{characters}]"))


def _words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))


def _stock(low: Column, phrases: tuple[str, ...] = BOILERPLATE) -> Column:
    found = F.lit(False)
    for phrase in phrases:
        found = found | F.contains(low, F.lit(phrase))
    return found


def line_fails(line: Column, low: Column, marks: Column, stock: Column) -> Column:
    """Whether a line with words (``low``: in lower case, trimmed) fails the
    punctuation, navigation or boilerplate rule.  ``marks`` and ``stock`` say whether
    the whole text has any marks or stock phrases; most have none, and none of their
    lines is searched.  Both columns are named twice: what is named once, Catalyst
    would move into the lambda and evaluate for every line."""
    no_sentence = ~F.regexp_like(line, F.lit(r"[.!?…][\"'”’»)\]]*([\x20\x09-\x0D]|$)"))
    words = _words_in(line)
    noisy = (_count(line, SYMBOLS) >= words) | (_count(line, "!?") >= 2) & (2 * _count(line, "!?") > words)
    menu = low.isin(*MENU) | (marks & (_count(line, SEPARATORS) >= 2))
    return no_sentence | menu | (marks & noisy) | (stock & _stock(low, BOILERPLATE[:4])) | (stock & _stock(low, BOILERPLATE[4:]))


def _repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds the number of words inside three-word windows that occur twice or more.

    A window is first a number: the upper bits of its hash, its place in the lower
    bits.  Sorted, windows of equal hash are neighbours; these few candidates are
    then sorted as strings, which settles which of them are equal."""
    packed, low, same, named, hits = (fresh([*df.columns, out], x) for x in ("packed", "low", "same", "named", "hits"))
    w, n = F.col(words), F.size(words) - 2
    many = n > 1
    df = df.withColumn(low, F.ceil(F.log2(F.size(words) + 2)).cast("int"))
    place = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col(low)) - 1
    number = lambda x, i: F.call_function("shiftleft", F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)), F.col(low)).bitwiseOR(i.cast("bigint"))
    df = df.withColumn(packed, F.when(many, F.sort_array(F.transform(F.slice(w, 1, n), number))))
    p = F.col(packed)
    differ = lambda a, b: F.call_function("shiftright", a.bitwiseXOR(b), F.col(low))
    close = F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: F.when(differ(a, b) == 0, F.array(a, b)))
    places = F.transform(F.flatten(F.filter(close, lambda x: x.isNotNull())), lambda x: x.bitwiseAND(place).cast("int"))
    df = df.withColumn(same, F.when(many, F.array_distinct(places)))
    # "first second third place", the place in ten digits
    text = lambda i: F.concat(F.get(w, i), F.lit(" "), F.get(w, i + 1), F.lit(" "), F.get(w, i + 2), F.lit(" "), F.lpad(i.cast("string"), 10, "0"))
    df = df.withColumn(named, F.when(F.size(same) > 0, F.sort_array(F.transform(same, text))))
    s = F.col(named)
    window = lambda x: F.substring(x, F.lit(1), F.length(x) - 11)
    at = lambda x: F.substring(x, -10, 10).cast("int")
    equal = F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.when(window(a) == window(b), F.array(at(a), at(b))))
    df = df.withColumn(hits, F.sort_array(F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull())))))
    h = F.col(hits)
    covered = F.transform(h, lambda x, i: F.least(F.coalesce(F.get(h, i + 1) - x, F.lit(3)), F.lit(3)))
    return df.withColumn(out, F.coalesce(F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x), F.lit(0))).drop(packed, low, same, named, hits)


def _judged(docs: DataFrame, max_loss: int) -> tuple[DataFrame, dict[str, str]]:
    """The rows with their figures, and the names of the added columns."""
    own = ("low", "marks", "stock", "lines", "words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines_removed", "n_words_removed", "kept")
    name = {k: fresh(docs.columns, k) for k in own}
    col = lambda k: F.col(name[k])
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.withColumn(name["low"], F.lower(text))
    low = F.split(name["low"], "\n")
    df = docs.withColumn(name["marks"], F.regexp_like(text, F.lit(f"[{SYMBOLS}{SEPARATORS}!?]"))).withColumn(name["stock"], _stock(col("low")))
    blanks = F.lit(" " + _BLANKS)
    judged = lambda x, y: F.struct(x.alias("line"), (F.btrim(y, blanks) != "").alias("full"), ((F.btrim(y, blanks) != "") & line_fails(x, F.btrim(y, blanks), col("marks"), col("stock"))).alias("fails"))
    df = df.withColumn(name["lines"], F.zip_with(F.split(text, "\n"), low, judged))
    df = df.withColumn(name["words"], F.array_remove(F.split(_spaced(text), " "), ""))
    df = df.withColumn(name["n_words"], F.size(name["words"]).cast("bigint"))
    df = df.withColumn(name["word_chars"], F.length(F.replace(_spaced(text), F.lit(" "), F.lit(""))).cast("bigint"))
    df = df.withColumn(name["n_symbols"], _count(text, SYMBOLS).cast("bigint"))
    full = F.transform(F.filter(col("lines"), lambda x: x.full), lambda x: x.line)
    df = df.withColumn(name["n_dup_lines"], (F.size(full) - F.size(F.array_distinct(full))).cast("bigint"))
    df = _repeated_words(df, name["words"], name["n_repeat_words"])
    df = df.withColumn(name["base_failed"], (col("n_words") < MIN_WORDS) | (100 * col("n_repeat_words") > MAX_REPEATED * col("n_words")))
    bad = F.filter(col("lines"), lambda x: x.fails)
    df = df.withColumn(name["n_lines_removed"], F.size(bad).cast("bigint"))
    df = df.withColumn(name["n_words_removed"], F.aggregate(bad, F.lit(0).cast("bigint"), lambda s, x: s + _words_in(x.line)))
    df = df.withColumn(name["kept"], ~col("base_failed") & (100 * col("n_words_removed") <= max_loss * col("n_words")))
    return df, name


def judge(docs: DataFrame, max_loss: int = MAX_LOSS) -> DataFrame:
    """One row per document: base figures, lines and words removed, and the verdict."""
    df, name = _judged(docs.select("doc_id", "text"), max_loss)
    return df.select("doc_id", *[name[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines_removed", "n_words_removed", "kept")])


def clean(docs: DataFrame, max_loss: int = MAX_LOSS) -> DataFrame:
    """The documents that stay, whole rows, their failing lines removed from ``text``
    (and ``n_chars`` renewed where there is such a column)."""
    df, name = _judged(docs, max_loss)
    good = F.transform(F.filter(F.col(name["lines"]), lambda x: ~x.fails), lambda x: x.line)
    text = F.when(F.col(name["n_lines_removed"]) > 0, F.array_join(good, "\n")).otherwise(F.col("text"))
    out = df.where(F.col(name["kept"])).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
