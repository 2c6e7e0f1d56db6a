"""Page text extraction: a walk over the open tags with acceptance rules.

The walk keeps a stack of open tags with how many of them each rule rejects, so a text run is judged in constant time.
An end tag closes up to the nearest open tag of its name; one without such is counted and ignored.
"""

from __future__ import annotations

import html as entities
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X

MARK = "\u0001"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


@dataclass(frozen=True)
class Profile:
    """Which text counts. ``wiki`` keeps void tags open and knows no self-closing; ``generic`` closes both."""

    root: tuple[str, str | None] = ("div", "mw-parser-output")
    classes: frozenset[str] = frozenset({"plainlinks", "citation", "wikicite"})
    by_tag: dict[str, frozenset[str]] = field(default_factory=lambda: {
        "div": frozenset({"notice", "toc", "rellink", "relarticle", "mainarticle"}), "ol": frozenset({"references"}),
        "ul": frozenset({"gallery", "mw-gallery-traditional"}), "table": frozenset({"vertical-navbox", "navbox", "plainlinks"}),
    })
    tags: frozenset[str] = frozenset({"h1", "h2", "h3", "h4", "h5", "h6", "title", "style", "table"})
    cut_ids: frozenset[str] = frozenset()
    generic: bool = False


#: Section ids that end a page.
CUT_IDS = frozenset({
    "参考资料和註釋", "參考資料及註釋", "註記和參考資料",
    "参考文獻", "参考文献", "參考文献", "參考文獻",
    "参考资料", "参考資料", "參考資料",
    "参考书目", "参考网址", "参考註釋", "参考注释",
    "參考來源", "参考来源",
    "資料來源",
    "參考", "参考",
    "参见", "參見", "参看",
    "外部連結", "外部链接",
    "扩展阅读", "延伸阅读",
    "註釋", "注釋", "注释",
    "脚注", "腳註", "注腳", "註腳",
    "註記", "註解",
    "文獻", "備註",
    "Notes",
})
WIKI = Profile(cut_ids=CUT_IDS)
GENERIC = Profile(root=("article", None), generic=True, cut_ids=CUT_IDS, tags=frozenset({"title", "style", "table", "h1", "h2", "h3", "h4", "h5", "h6"}))


def attributes(text: str) -> tuple[str, dict[str, frozenset[str]], bool]:
    """Tag name, attributes as sets of blank-separated values, and whether it closes itself."""
    name, i, out, closed = "", 0, {}, False
    while i < len(text) and not text[i].isspace():
        i += 1
    name = text[:i]
    while i < len(text):
        while i < len(text) and text[i].isspace():
            i += 1
        start = i
        while i < len(text) and not text[i].isspace() and text[i] != "=":
            i += 1
        key = text[start:i]
        if i < len(text) and text[i] == "=":
            i += 1
            if i < len(text) and text[i] in "\"'":
                end = text.find(text[i], i + 1)
                end = len(text) if end < 0 else end
                value, i = text[i + 1 : end], end + 1
            else:
                start = i
                while i < len(text) and not text[i].isspace():
                    i += 1
                value = text[start:i]
            out[key] = frozenset(value.split())
        elif key == "/":
            closed = True
        elif key:
            out[key.rstrip("/")] = frozenset()
            closed = closed or key.endswith("/")
    return name, out, closed


def _tag_end(page: str, at: int) -> int:
    """The place of the > that ends a tag, quotes respected; -1 where none does."""
    quote = ""
    for i in range(at, len(page)):
        c = page[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'" and page[i - 1] == "=":
            quote = c
        elif c == ">":
            return i
    return -1


def _formula_end(page: str, at: int) -> int:
    """Behind the brace that balances the one at ``at``; a backslash hides the next character."""
    depth, i = 0, at
    while i < len(page):
        if page[i] == "\\":
            i += 1
        elif page[i] == "{":
            depth += 1
        elif page[i] == "}":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return len(page)


def walk(page: str, p: Profile) -> tuple[str, bool, int]:
    """(text, cut off, end tags without a start) of one page."""
    out: list[str] = []
    stack: list[tuple[str, int, int]] = []  # name, roots and rejections up to here
    extra, i, n = 0, 0, len(page)
    while i < n:
        lt = page.find("<", i)
        stop = n if lt < 0 else lt
        if stop > i:
            if stack and stack[-1][1] and not stack[-1][2]:
                run, at = page[i:stop], 0
                while (f := run.find("{\\displaystyle", at)) >= 0:
                    out.append(run[at:f])
                    at = _formula_end(run, f)
                out.append(run[at:])
            i = stop
        if lt < 0:
            break
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            i = n if end < 0 else end + 3
            continue
        end = _tag_end(page, i + 1)
        if end < 0:
            break
        inner, i = page[i + 1 : end], end + 1
        if inner.startswith("/"):
            name = inner[1:].strip()
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), -1)
            if at < 0:
                extra += 1
            else:
                del stack[at:]
            continue
        name, attrs, closed = attributes(inner)
        if name == "span" and stack and stack[-1][1] and attrs.get("id", frozenset()) & p.cut_ids:
            return "".join(out), True, extra
        if p.generic and (closed or name.lower() in VOID or name.startswith("!")):
            continue
        classes = attrs.get("class", frozenset())
        root = name == p.root[0] and (p.root[1] is None or p.root[1] in classes)
        bad = bool(classes & p.classes) or name in p.tags or bool(classes & p.by_tag.get(name, frozenset()))
        roots, rejects = stack[-1][1:] if stack else (0, 0)
        stack.append((name, roots + root, rejects + bad))
    return "".join(out), False, extra


def extract(html: Column, profile: Profile = WIKI) -> Column:
    """struct(text, cut_off, extra_end_tags, error): scripts out, tags walked, entities, blanks, citations and lines tidied.

    Null pages give a null text. A page that breaks the walk keeps what was found and names the error.
    """
    prepared = F.replace(X.mark_paragraphs(X.drop_scripts(html), MARK), F.lit("<"), F.lit(" <"))

    @F.pandas_udf("text string, cut_off boolean, extra_end_tags int, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            rows = []
            for page in pages:
                if page is None:
                    rows.append((None, None, None, None))
                    continue
                try:
                    text, cut, extra = walk(page, profile)
                    rows.append((entities.unescape(text), cut, extra, None))
                except Exception as e:  # a dead letter, not a lost page
                    rows.append(("", False, 0, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["text", "cut_off", "extra_end_tags", "error"])

    return run(prepared)


def tidy(text: Column) -> Column:
    lines = F.replace(X.drop_citations(X.collapse_blanks(text)), F.lit(MARK), F.lit("\n"))
    return X.drop_empty_lines(lines)


def extract_pages(pages: DataFrame, html_col: str = "html", profile: Profile = WIKI) -> DataFrame:
    """``pages`` and the columns text, cut_off, extra_end_tags, extract_error."""
    told = pages.withColumn("_x", extract(F.col(html_col), profile))
    return told.select(*pages.columns, tidy(F.col("_x.text")).alias("text"), F.col("_x.cut_off").alias("cut_off"), F.col("_x.extra_end_tags").alias("extra_end_tags"), F.col("_x.error").alias("extract_error"))


def select_elements(html: Column, tag: str, css_class: str | None = None) -> Column:
    """Inner texts of the outermost elements of a name (and class)."""

    @F.pandas_udf("array<string>")
    def run(pages: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [x[a:b] for _, a, b, _ in _elements(x, tag, css_class)] for x in pages], dtype=object)

    return run(html)


def remove_elements(html: Column, tag: str, css_class: str | None = None, keep_content: bool = False) -> Column:
    """The page without the outermost elements of a name (and class), or without their tags alone."""

    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        out = []
        for x in pages:
            if x is not None:
                parts, at = [], 0
                for start, a, b, end in _elements(x, tag, css_class):
                    parts += [x[at:start], x[a:b] if keep_content else ""]
                    at = end
                x = "".join(parts) + x[at:]
            out.append(x)
        return pd.Series(out, dtype=object)

    return run(html)


def _elements(page: str, tag: str, css_class: str | None) -> Iterator[tuple[int, int, int, int]]:
    depth, start, inside, i = 0, 0, 0, 0
    while (i := page.find("<", i)) >= 0:
        end = _tag_end(page, i + 1)
        if end < 0:
            return
        inner = page[i + 1 : end]
        if inner.startswith("/"):
            if depth and inner[1:].strip() == tag:
                depth -= 1
                if not depth:
                    yield start, inside, i, end + 1
        else:
            name, attrs, closed = attributes(inner)
            if name == tag and not closed and (depth or css_class is None or css_class in attrs.get("class", frozenset())):
                if not depth:
                    start, inside = i, end + 1
                depth += 1
        i = end + 1
