"""Normalising and segmenting text with column expressions.

Regular expressions carry (?U) where blanks, digits or word characters beyond ASCII matter. Repeated groups are possessive
(++, *+), which Java matches in a loop and not by recursion, and what starts with blanks is tried from the first of them
alone, so very long words and runs of blanks take linear time and no stack.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from idiolect.functions.lexicons import ABBREVIATIONS

WORD = r"[0-9A-Za-z]++(?:['\-][0-9A-Za-z]++)*+"
BREAK, GUARD = "\x01", "\x02"
BULLET = r"(?:[-*•‣◦]|\d+[.)])"
ABBREVIATED = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)


def one_of(x: Column, words: Iterable[str]) -> Column:
    """x is one of the words. isin() makes a call to the JVM for each of them; hundreds are sent as one here, where there
    is a JVM to call."""
    words = list(words)
    if not hasattr(x, "_jc") or not words or any("," in w or w != w.strip() for w in words):
        return x.isin(*words)
    jvm = SparkContext._active_spark_context._jvm
    return Column(x._jc.isInCollection(jvm.org.apache.spark.util.Utils.stringToSeq(",".join(words))))


def strip(x: Column) -> Column:
    ends = F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1)))  # most texts have nothing to strip, and are not searched
    return F.when(ends.rlike(r"(?U)\s"), F.regexp_replace(x, r"(?U)^\s+|(?<!\s)\s+$", "")).otherwise(x)


def beyond_ascii(text: Column) -> Column:
    return F.octet_length(text) > F.length(text)


def plain_marks(text: Column) -> Column:
    """Straight quotes, plain spaces, no BOM, LF line ends. Dashes stay; null counts as empty. A text is searched for the marks
    only if it is not all ASCII, and for both line ends only if it has one of them."""
    t = F.coalesce(text, F.lit(""))
    plain = t
    for mark, of in {"’": "'", "‘": "'", "“": '"', "”": '"', "\u00a0": " ", "\ufeff": ""}.items():  # a search for bytes; translate() looks every character up
        plain = F.replace(plain, F.lit(mark), F.lit(of))
    lines = lambda x: F.when(F.contains(t, F.lit("\r")), F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))).otherwise(x)
    return F.when(beyond_ascii(t), lines(plain)).otherwise(lines(t))


#: Texts of other characters alone are in NFC: up to U+02FF all are, and so are punctuation, currencies, arrows and boxes.
NOT_COMPOSED = r"[^\u0000-\u02ff\u2002-\u205f\u20a0-\u20bf\u2190-\u2329\u232b-\u2adb]"


def composed(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with text_col in NFC, by the ICU library that Spark's collations use, as Spark has no function for it. Only texts
    with a character that may not be in NFC are given to it."""
    t = F.col(text_col)
    nfc = F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), t, F.lit(False))
    return df.withColumn(text_col, F.when(beyond_ascii(t) & t.rlike(r"[\u0300-\x{10ffff}]") & t.rlike(NOT_COMPOSED), nfc).otherwise(t))


def normalised(df: DataFrame, text_col: str = "text", to: str = "norm") -> DataFrame:
    """df and its normalised text."""
    return composed(df, text_col).withColumn(to, plain_marks(F.col(text_col)))


def tokens(norm: Column) -> Column:
    return F.transform(F.regexp_extract_all(norm, F.lit(WORD), F.lit(0)), F.lower)


def token_count(norm: Column) -> Column:
    return F.regexp_count(norm, F.lit(WORD))


def non_blank(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def paragraphs(norm: Column) -> Column:
    return non_blank(F.split(strip(norm), r"\n[ \t]*\n", -1))


def segments(norm: Column) -> Column:
    """Paragraphs and list items, with BREAK between them."""
    t = F.regexp_replace(strip(F.translate(norm, BREAK + GUARD, "  ")), r"(?U)(?<!\s)\s*\n[ \t]*\n\s*", BREAK)
    return F.regexp_replace(t, rf"(?U)(?<!\s)\s*\n(?=[^\S\n]*{BULLET}[^\S\n]+)", BREAK)


#: The last word before a full stop that ends no sentence; what follows the look ahead is tried only at words with a full stop.
_SHORT = rf"(?Ui)((?<![A-Za-z.])\.*(?=[a-z]{{1,{max(len(x) for a in ABBREVIATIONS for x in a.split('.'))}}}\.)(?:{ABBREVIATED}|[a-z])\.+)([\"')\]]*\s+)"


def sentences(norm: Column) -> Column:
    """A sentence ends at . ! or ? with closing quotes or brackets and a blank after it, unless its last word is an
    abbreviation or a single letter; paragraphs and list items end it too."""
    t = F.regexp_replace(segments(norm), _SHORT, f"$1{GUARD}$2")
    t = F.regexp_replace(t, r"(?U)([.!?])[\"')\]]*\s+", f"$1{BREAK}")
    return non_blank(F.split(F.translate(t, GUARD, ""), BREAK, -1))


def marked(norm: Column) -> Column:
    """The stripped text with a BREAK after each of its sentences and nothing taken out: what sentences() leaves out at an
    end, closing quotes and blanks, comes after the BREAK."""
    t = strip(F.replace(F.replace(norm, F.lit(BREAK), F.lit(" ")), F.lit(GUARD), F.lit(" ")))
    parts = F.regexp_replace(t, r"(?U)(?<!\s)\s*\n[ \t]*\n\s*", f"{BREAK}$0")
    parts = F.regexp_replace(parts, rf"(?U)(?<!\s)\s*\n(?=[^\S\n]*{BULLET}[^\S\n]+)", f"{BREAK}$0")
    t = F.when(F.contains(t, F.lit("\n")), parts).otherwise(t)
    t = F.regexp_replace(t, _SHORT, f"$1{GUARD}$2")
    t = F.regexp_replace(t, r"(?U)([.!?])([\"')\]]*\s+)", f"$1{BREAK}$2")
    return F.replace(t, F.lit(GUARD), F.lit(""))


def lines(norm: Column) -> Column:
    return F.filter(F.split(norm, "\n", -1), lambda x: strip(x) != "")


def is_bullet(line: Column) -> Column:
    return line.rlike(rf"(?U)^\s*{BULLET}\s+")


def is_heading(line: Column) -> Column:
    return line.rlike(r"(?U)^\s*#{1,6}\s+\S")


def context_label(label: Column) -> Column:
    """Trimmed, lower case, blanks as hyphens; null or blank is no label."""
    x = F.regexp_replace(strip(F.lower(label)), r"(?U)\s+", "-")
    return F.when(x != "", x)


def blank_words(text: Column) -> Column:
    """Words between blanks, for messages alone."""
    t = strip(text)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"(?U)\s+", -1)))


def literal_count(text: Column, literal: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(literal), F.lit("")))) / len(literal)).cast("long")


def phrase_pattern(phrase: str) -> str:
    escaped = "".join(c if c.isalnum() or c == "'" else r"\s+" if c == " " else "\\" + c for c in phrase)
    return rf"(?U)\b{escaped}\b"


def phrase_table(phrases: tuple[str, ...]) -> Column:
    """The phrases as one array literal (term, rarest word, pattern): plans stay small however many there are."""
    rows = [{"term": p, "word": max(p.split(), key=len), "pattern": phrase_pattern(p)} for p in phrases]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<term:string,word:string,pattern:string>>")  # folded to a literal


def phrases_found(lower: Column, phrases: tuple[str, ...]) -> Column:
    """array of (term, n) of the phrases that occur; patterns run only where their longest word is."""
    near = F.filter(phrase_table(phrases), lambda p: F.contains(lower, p["word"]))
    counted = F.transform(near, lambda p: F.struct(p["term"].alias("term"), F.regexp_count(lower, p["pattern"]).cast("long").alias("n")))
    return F.filter(counted, lambda p: p["n"] > 0)


def sample_argument(value: Column) -> Column:
    """FILE[:CONTEXT]: struct of path and label; a tail with a path separator is part of the path."""
    tail = F.regexp_extract(value, r"^(.+):([^/:\\]+)$", 2)
    head = F.regexp_extract(value, r"^(.+):([^/:\\]+)$", 1)
    return F.struct(F.when(tail == "", value).otherwise(head).alias("path"), F.when(tail != "", context_label(tail)).alias("label"))


def english_list(items: Column) -> Column:
    """a, b and c."""
    n = F.size(items)
    return F.when(n == 0, "").when(n == 1, F.element_at(items, 1)).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(1))), ", "), F.lit(" and "), F.element_at(items, -1)))


def capitalised(x: Column) -> Column:
    return F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))
