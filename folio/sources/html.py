"""HTML parsing in Arrow batches: the one place where Catalyst has no function for the job."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element that a new one of the same group closes.
IMPLIED = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())


@dataclass
class Node:
    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(x for x in reversed(node.children) if isinstance(x, Node))

    def text(self) -> str:
        """Text pieces without script and style, stripped, joined by spaces."""
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                if x.strip():
                    out.append(x.strip())
            elif x.tag not in ("script", "style"):
                stack.extend(reversed(x.children))
        return " ".join(out)

    def matches(self, selector: str) -> bool:
        """``tag``, ``.class``, ``[name=value]`` and their combinations, e.g. ``h1.title[role=x]``."""
        for kind, name, value in re.findall(r"(^|[.\[])([\w-]+)(?:=['\"]?([^\]'\"]*)['\"]?\])?", selector):
            if kind == "" and self.tag != name:
                return False
            if kind == "." and name not in self.attrs.get("class", "").split():
                return False
            if kind == "[" and self.attrs.get(name) != value:
                return False
        return True

    def find(self, selector: str) -> Node | None:
        """First descendant for a path of simple selectors separated by spaces."""
        return next(self.find_all(selector), None)

    def find_all(self, selector: str) -> Iterator[Node]:
        first, *rest = selector.split(" ")
        for node in self.walk():
            if node is not self and node.matches(first):
                if rest:
                    yield from node.find_all(" ".join(rest))
                else:
                    yield node


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        closes = IMPLIED.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
        if closes and self.open[-1].tag in closes:
            self.open.pop()
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        if any(n.tag == tag for n in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data):
        self.open[-1].children.append(data)


def parse(page: str) -> Node:
    tree = _Tree()
    tree.feed(page)
    tree.close()
    return tree.root


def tidy(text: str) -> str:
    return " ".join(entities.unescape(text).replace("\xa0", " ").replace("​", "").split())


@dataclass(frozen=True)
class Selectors:
    """Where an article template keeps its parts; the defaults are those of the crawled site."""

    title: str = "h1.detail-title [data-role=title]"
    summary: str = ".detail-sapo"
    body: str = ".detail-content[data-role=content]"
    base: str = "https://example.com"
    item: str = "div.box-category-item"
    item_title: str = "a.box-category-link-title"
    item_category: str = "a.box-category-category"
    item_image: str = "a.box-category-link-with-avatar img"


#: The template of the ``pages`` table.
PLAIN = Selectors(title="h1", summary="[data-role=summary]", body="article")


def paragraphs(body: Node) -> list[str]:
    """Direct children of the body: text of paragraphs, headings and other blocks, one for each item
    of a list, ``[Ảnh]`` and the caption of a figure; loose text, scripts and styles are skipped."""
    out = []
    for child in body.children:
        if isinstance(child, str) or child.tag in ("script", "style"):
            continue
        if child.tag in ("ul", "ol"):
            found = [x.text() for x in child.children if isinstance(x, Node) and x.tag == "li"]
        elif child.tag == "figure":
            caption = child.find("figcaption")
            found = [f"[Ảnh] {caption.text()}" if caption and caption.text() else ""]
        else:
            found = [child.text()]
        out += [t for t in map(tidy, found) if t]
    return out


_ARTICLE = [("title", pa.string()), ("summary", pa.string()), ("author", pa.string()), ("category", pa.string()), ("published", pa.string()), ("canonical_url", pa.string()), ("paragraphs", pa.list_(pa.string())), ("error", pa.string())]
_ENTRY = [("page", pa.int32()), ("position", pa.int32()), ("title", pa.string()), ("url", pa.string()), ("canonical_url", pa.string()), ("category_name", pa.string()), ("category_url", pa.string()), ("image_url", pa.string()), ("data_id", pa.string())]


def _article(page: str, url: str, where: Selectors) -> dict:
    root = parse(page)
    title, body, summary = root.find(where.title), root.find(where.body), root.find(where.summary)
    if title is None or body is None:
        return {"error": "no title or body"}
    meta = {n.attrs.get("name") or n.attrs.get("property"): n.attrs.get("content") for n in root.find_all("meta")}
    canonical = next((n.attrs.get("href") for n in root.find_all("link") if n.attrs.get("rel") == "canonical"), None)
    optional = lambda x: tidy(x) if x else None
    return {
        "title": tidy(title.text()), "summary": tidy(summary.text()) if summary else None, "author": optional(meta.get("article:author")), "category": optional(meta.get("article:section")),
        "published": meta.get("article:published_time"), "canonical_url": canonical or url, "paragraphs": paragraphs(body),
    }


def parse_articles(pages: DataFrame, where: Selectors = Selectors(), key: str = "page_id", keep_html: bool = False) -> DataFrame:
    """(key, url, title, summary, author, category, published_at, canonical_url, paragraphs, error) of ``pages`` (key, url, html).
    A page without title or body is a row with ``error``, not a failure; a bad time is null.
    With ``keep_html`` the page itself is the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_article(h or "", u or "", where) for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = [batch.column(0), batch.column(1), *(pa.array([x.get(n) for x in found], t) for n, t in _ARTICLE)]
            names = [key, "url", *(n for n, _ in _ARTICLE)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column(2)], names=[*names, "html"]) if keep_html else pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"{key} {pages.schema[key].dataType.simpleString()}, url string, " + ", ".join(f"{n} {'array<string>' if n == 'paragraphs' else 'string'}" for n, _ in _ARTICLE) + (", html string" if keep_html else "")
    found = pages.select(key, "url", "html").mapInArrow(run, schema)
    return found.withColumn("published_at", F.try_to_timestamp(F.regexp_replace("published", "Z$", "+00:00"))).drop("published")


def parse_timeline(pages: DataFrame, where: Selectors = Selectors()) -> DataFrame:
    """Timeline entries of ``pages`` (page, html); ``position`` counts all items of a page from 1, also those without a link."""

    def entries(page: int, text: str) -> Iterator[dict]:
        for position, item in enumerate(parse(text).find_all(where.item), 1):
            link = item.find(where.item_title)
            href = link.attrs.get("href") if link else None
            if not href:
                continue
            category, image = item.find(where.item_category), item.find(where.item_image)
            category_href = category.attrs.get("href", "") if category else ""
            yield {
                "page": page, "position": position, "title": link.attrs.get("title") or link.text(), "url": urljoin(where.base, href),
                "canonical_url": urljoin(where.base, link.attrs.get("data-io-canonical-url") or href), "category_name": category.text() if category else "",
                "category_url": urljoin(where.base, category_href) if category_href else "", "image_url": image.attrs.get("src") if image else None, "data_id": item.attrs.get("data-id"),
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [e for p, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for e in entries(p, h or "")]
            yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in found], t) for n, t in _ENTRY], names=[n for n, _ in _ENTRY])

    schema = ", ".join(f"{n} {'int' if t == pa.int32() else 'string'}" for n, t in _ENTRY)
    return pages.select(F.col("page").cast("int").alias("page"), "html").mapInArrow(run, schema)


def fetch(urls: DataFrame, get=None, tries: int = 3, backoff_s: float = 2.0, timeout_s: float = 15.0) -> DataFrame:
    """(page, url, html, error): a bounded fetch stage. ``get(url, timeout)`` returns the text; each failed try waits longer."""

    def default_get(url: str, timeout: float) -> str:
        from urllib.request import urlopen

        with urlopen(url, timeout=timeout) as answer:
            return answer.read().decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import time

        for batch in batches:
            texts, errors = [], []
            for url in batch.column(1).to_pylist():
                text = error = None
                for attempt in range(1, tries + 1):
                    try:
                        text, error = (get or default_get)(url, timeout_s), None
                        break
                    except Exception as e:  # any transport error becomes a row
                        error = str(e)
                        if attempt < tries:
                            time.sleep(backoff_s * attempt)
                texts.append(text)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["page", "url", "html", "error"])

    return urls.select("page", "url").mapInArrow(run, "page int, url string, html string, error string")
