"""Cleaning and character functions as Column expressions.

Lengths and positions count code points; strings compare by their UTF-8 bytes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java and RE2 character classes (without brackets).
CJK = r"\x{4e00}-\x{9fff}"
LETTERS = r"\p{L}"
#: Marks that no candidate phrase holds.
PUNCTUATION = " \n\r\t-,.?!*　，。、；：？！…“”「」—－（）《》．／＼"
CHUNK_BREAKS = {"default": "[ \\r\\n]", "space": " ", "wide": "[ \\r\\n\\t]"}


def has_class(text: Column, char_class: str = CJK) -> Column:
    return text.rlike(f"[{char_class}]")


def squeeze_others(text: Column, char_class: str = CJK) -> Column:
    """Each run of characters outside the class becomes one space."""
    return F.regexp_replace(text, f"[^{char_class}]+", " ")


def drop_others(text: Column, char_class: str = CJK) -> Column:
    return F.regexp_replace(text, f"[^{char_class}]+", "")


def drop_controls(text: Column) -> Column:
    """Without control and space-separator characters."""
    return F.regexp_replace(text, r"[\p{Cc}\p{Zs}]+", "")


def preprocess(text: Column, method: str = "space", char_class: str = CJK) -> Column:
    """Method none, space or remove; others raise ValueError."""
    ways = {"none": lambda: text, "space": lambda: squeeze_others(text, char_class), "remove": lambda: drop_others(text, char_class)}
    if method not in ways:
        raise ValueError(f"preprocess method {method!r}")
    return ways[method]()


def clean(text: Column, method: str = "space", controls: bool = True, char_class: str = CJK) -> Column:
    out = preprocess(text, method, char_class)
    return drop_controls(out) if controls else out


def class_length(text: Column, char_class: str = CJK) -> Column:
    """How many characters of the class a text has."""
    return F.length(drop_others(text, char_class)).cast("long")


def chunks(text: Column, breaks: str = "default", keep_empty: bool = False) -> Column:
    """A text cut at blanks and line ends ("default"), blanks only ("space") or tabs too ("wide")."""
    parts = F.split(text, CHUNK_BREAKS[breaks])
    return parts if keep_empty else F.array_remove(parts, "")


def chars(text: Column) -> Column:
    """Code points as an array, [] for an empty text."""
    return F.array_remove(F.split(text, ""), "")


def has_punctuation(word: Column) -> Column:
    marks = "".join("\\" + c if c in "-\\" else c for c in PUNCTUATION)
    return word.rlike(f"[{marks}]")


def has_line_break(word: Column) -> Column:
    return word.rlike("[\\r\\n]")


# Web pages
def drop_scripts(html: Column) -> Column:
    closed = F.replace(html, F.lit("</flowprogressivescript>"), F.lit("</script>"))
    return F.regexp_replace(closed, "(?s)<script.*?</script>", "")


def mark_paragraphs(html: Column, mark: str = "\u0001") -> Column:
    return F.regexp_replace(html, "(</p>|<br|</li>|</div>|</dt>|</dd>)", f"{mark}$1")


def collapse_blanks(text: Column) -> Column:
    return F.regexp_replace(text, "[ \\n\\r]+", " ")


def drop_citations(text: Column) -> Column:
    return F.regexp_replace(text, r"\[[\p{L}\p{Nd}](?U:\s)*\p{Nd}*\]", "")


def drop_empty_lines(text: Column) -> Column:
    trimmed = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.regexp_replace(F.array_join(trimmed, "\n"), "\n{2,}", "\n")


def page_url(title: Column, prefix: str = "https://zh.wikipedia.org/zh-tw/") -> Column:
    return F.concat(F.lit(prefix), F.url_encode(F.replace(title, F.lit(" "), F.lit("_"))))


def index_title(line: Column) -> Column:
    """Title of an ``offset:pageid:title`` line; a line with fewer than two colons is kept whole."""
    pattern = "(?s)^[^:]*:[^:]*:(.*)$"
    return F.when(line.rlike(pattern), F.regexp_extract(line, pattern, 1)).otherwise(line)


def retry_action(status: Column) -> Column:
    """What a crawler does with an HTTP status: done, drop (404) or retry."""
    return F.when(status.between(200, 299), "done").when(status == 404, "drop").otherwise("retry")


# Encodings, slices
def transcode(data: Column, source: str, target: str) -> Column:
    """Bytes of one charset as bytes of another (ASCII, ISO-8859-1, UTF-8, UTF-16, UTF-16LE, UTF-16BE, UTF-32)."""
    return F.encode(F.decode(data, source), target)


def transcode_any(data: Column, source: str, target: str) -> Column:
    """As transcode, for every charset that Python knows; bytes that do not fit become the replacement character."""

    @F.pandas_udf("binary")
    def convert(values: pd.Series) -> pd.Series:
        return values.map(lambda b: None if b is None else bytes(b).decode(source, "replace").encode(target, "replace"))

    return convert(data)


def truncate_bytes(text: Column, n: int) -> Column:
    """The longest head of whole characters that takes at most n bytes of UTF-8."""
    return F.regexp_replace(F.make_valid_utf8(F.substring(text.cast("binary"), 1, n).cast("string")), "\uFFFD+$", "") if n else F.lit("")


def common_prefix_length(a: Column, b: Column, whole_is_zero: bool = False) -> Column:
    """Characters that two texts share at their head; ``whole_is_zero`` gives 0 where one is the head of the other."""
    same = F.zip_with(chars(a), chars(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    n = F.array_position(same, False) - 1
    short = F.least(F.length(a), F.length(b)).cast("long")
    n = F.when(n < 0, short).otherwise(n)
    return F.when(n == short, F.lit(0).cast("long")).otherwise(n) if whole_is_zero else n


def char_index(texts, text_col: str):
    """(ch, idx): the distinct characters of all texts in order, numbered from 0."""
    from pyspark.sql import Window

    distinct = texts.select(F.explode(chars(F.col(text_col))).alias("ch")).distinct()
    return distinct.select("ch", (F.row_number().over(Window.orderBy("ch")) - 1).cast("int").alias("idx"))


def not_shorter_than(text: Column, n: int) -> Column:
    """Whether a text takes n bytes of UTF-8 or more."""
    return F.octet_length(text) >= n


def move_right(text: Column) -> Column:
    """Without the first character."""
    return F.substring(text, 2, 2147483647)


def move_left(text: Column) -> Column:
    """Without the last character."""
    return F.left(text, F.greatest(F.length(text) - 1, F.lit(0)))


def byte_position(text: Column, part: Column) -> Column:
    """The byte, from 0, at which ``part`` first occurs; null where it does not."""
    at = F.call_function("instr", text, part)
    return F.when(at > 0, F.octet_length(F.left(text, at - 1)))


def reverse_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1: the order of two texts read from their ends."""
    x, y = F.reverse(a), F.reverse(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def stamp(moment: Column) -> Column:
    """A moment as in file names: date, time with dashes, seven digits of the second."""
    return F.date_format(moment, "yyyy-MM-dd HH-mm-ss.SSSSSSS")


# Multisets: maps from an element to how often it is there
def multiset_add(bag: Column, item: Column, times: int = 1) -> Column:
    grown = F.transform_values(bag, lambda k, v: v + F.when(k == item, times).otherwise(0))
    return F.when(F.map_contains_key(bag, item), grown).otherwise(F.map_concat(bag, F.create_map(item, F.lit(times).cast("long"))))


def multiset_remove(bag: Column, item: Column, times: int = 1) -> Column:
    """Elements that reach 0 go; one that is not there changes nothing."""
    return F.map_filter(F.transform_values(bag, lambda k, v: v - F.when(k == item, times).otherwise(0)), lambda k, v: v > 0)
