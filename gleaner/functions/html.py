"""HTML to text (B7) and main-content extraction.

Built-in regex expressions serve the pages whose markup they read exactly: balanced,
un-nested elements, plain comments, and the few entities that the native cleaner
decodes. All other pages (unclosed or nested elements, elements chosen by ``role`` or
``class``, other entities, ``>`` in attributes) take an Arrow-batched walk of a real
element tree built with the standard-library ``html.parser``; pages of the first kind
are handed to it as nulls. Both give the same text where both apply.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.columns import (HTML_ENTITIES, col_, first_element_html, has_element, remove_elements,
                                       strip_tags)

# The extraction ladder.
REMOVED_TAGS = ["script", "style", "nav", "footer", "header", "aside"]
SEMANTIC_TAGS = ["article", "main"]
ROLE_MAIN = ("role", "main")
CONTENT_CLASSES = ["content", "post-content", "entry-content", "article-content", "main-content"]
VOID_TAGS = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta",
             "param", "source", "track", "wbr"}


_KNOWN = "|".join(entity[1:] for entity, _ in HTML_ENTITIES)
_OPEN_QUOTE = r"""<[a-zA-Z/][^>"']*(?:"[^"<>]*"[^>"']*|'[^'<>]*'[^>"']*)*["'][^"'<>]*>"""


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def _native_main(html: Column) -> Column:
    return _bound(remove_elements(html, REMOVED_TAGS), _main_of)


def _main_of(cleaned: Column) -> Column:
    out = None
    for tag in SEMANTIC_TAGS:
        branch = (has_element(cleaned, tag), strip_tags(first_element_html(cleaned, tag)))
        out = F.when(*branch) if out is None else out.when(*branch)
    out = out.when(has_element(cleaned, "body"), strip_tags(first_element_html(cleaned, "body")))
    return out.otherwise(strip_tags(cleaned))


def _count(html: Column, pattern: str) -> Column:
    return F.regexp_count(html, F.lit(pattern))


def odd_markup(html: str | Column) -> Column:
    """True when regexes may read the markup or its entities wrongly."""
    h = col_(html)
    return (h.rlike(rf"&(?!(?:{_KNOWN}))[#a-zA-Z]")
            | (_count(h, "<!--") != _count(h, r"<!--[^<]*?-->"))
            | _bound(remove_elements(h, ["script", "style"]), lambda shown: (
                shown.rlike(r"(?i)</?(?:script|style)\b") | shown.rlike(r"<[^a-zA-Z/!]") | shown.rlike(r"<[^>]*$")
                | shown.rlike(_OPEN_QUOTE))))


def needs_tree(html: str | Column) -> Column:
    """True when the regex path cannot decide the main content: odd markup, a removed
    element that is nested or unclosed, a chosen element that is not there exactly once
    and closed, or a role or class attribute that the ladder could select."""
    h = col_(html)
    removed = "|".join(REMOVED_TAGS)

    def unsure(cleaned: Column) -> Column:
        def once(tag: str) -> Column:
            return (_count(cleaned, rf"(?i)<{tag}\b") == 1) & (_count(cleaned, rf"(?i)</{tag}\s*>") == 1)

        selectable = h.rlike(r"(?i)<[a-z][^>]*\s(role|class)\s*=")
        body = F.when(has_element(cleaned, "body"), once("body")).otherwise(F.lit(True))
        chosen = F.when(has_element(cleaned, "article"), once("article")).when(has_element(cleaned, "main"), once("main"))
        return cleaned.rlike(rf"(?i)</?(?:{removed})\b") | ~chosen.otherwise(body & ~selectable)

    return F.coalesce(_bound(remove_elements(h, REMOVED_TAGS), unsure) | odd_markup(h), F.lit(False))


# ------------------------------------------------------------------ tree path

class _Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag, attrs):
        self.tag, self.attrs, self.children = tag, attrs, []


class _TreeBuilder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("#root", {})
        self.stack = [self.root]
        self._skip = 0

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: (v or "") for k, v in attrs})
        self.stack[-1].children.append(node)
        if tag not in VOID_TAGS:
            self.stack.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        self.stack[-1].children.append(data)


def _text_of(node, skip: set[str] = frozenset()) -> str:
    """Text below a node in document order, an explicit stack for any depth."""
    parts: list[str] = []
    stack = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        elif x.tag not in skip:
            stack.extend(reversed(x.children))
    return re.sub(r"\s+", " ", " ".join(p.strip() for p in parts if p.strip())).strip()


def _first(node, pred, skip: set[str]):
    """First element in document order that the predicate accepts, outside skipped ones."""
    stack = [c for c in reversed(node.children) if not isinstance(c, str)]
    while stack:
        x = stack.pop()
        if x.tag in skip:
            continue
        if pred(x):
            return x
        stack.extend(c for c in reversed(x.children) if not isinstance(c, str))
    return None


def _tree(html: str) -> _Node:
    b = _TreeBuilder()
    b.feed(html)
    b.close()
    return b.root


def extract_main_text_py(html: str | None) -> str | None:
    """Reference ladder on an element tree: article, main, [role=main], the content
    classes in order, body, then the whole document."""
    if html is None:
        return None
    root, skip = _tree(html), set(REMOVED_TAGS)
    preds = [lambda n, t=t: n.tag == t for t in SEMANTIC_TAGS]
    preds.append(lambda n: n.attrs.get(ROLE_MAIN[0]) == ROLE_MAIN[1])
    preds += [lambda n, c=c: c in n.attrs.get("class", "").split() for c in CONTENT_CLASSES]
    preds.append(lambda n: n.tag == "body")
    for pred in preds:
        hit = _first(root, pred, skip)
        if hit is not None:
            return _text_of(hit, skip)
    return _text_of(root, skip)


def plain_text_py(html: str | None) -> str | None:
    return None if html is None else _text_of(_tree(html), {"script", "style"})


def _tree_column(html: Column, fn) -> Column:
    @F.pandas_udf("string")
    def walk(pages: pd.Series) -> pd.Series:
        return pages.map(fn, na_action="ignore").astype(object)

    return walk(html)


def plain_text(html: str | Column) -> Column:
    """Tags dropped (one space each), script/style/comments removed, entities
    decoded, whitespace collapsed."""
    h = col_(html)
    # the tree gives a text for every page it is handed, so its nulls mark the other pages
    # and the test for odd markup stands in the plan once
    return F.coalesce(_tree_column(F.when(odd_markup(h), h), plain_text_py), strip_tags(h))


def extract_main_content(df: DataFrame, html_col: str = "html", out_col: str = "main_text") -> DataFrame:
    """B8 over a DataFrame: native expressions for most rows, the tree walk for the rows
    that ``needs_tree`` selects; one scan, no shuffle."""
    h = F.col(html_col)
    tree = _tree_column(F.when(needs_tree(h), h), extract_main_text_py)
    return df.withColumn(out_col, F.coalesce(tree, _native_main(h)))
