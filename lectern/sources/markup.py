"""XHTML to Markdown-like text, and EPUB containers to chapters."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exact
from ..functions import patterns as P

_LEVELS = {f"h{n}": n for n in range(1, 7)}
_BLOCKS = {*P.BLOCK_TAGS, *_LEVELS}


class MarkdownText(HTMLParser):
    """Collects text with blank lines around blocks, `#` marks for headings, and the offset of each anchor.

    A space is written only once text follows it on the same line, so none stands at a line's ends.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text = ""
        self.anchors: dict[str, int] = {}
        self._hidden = 0
        self._heading = False
        self._space = False

    def _block(self) -> None:
        self._space = False
        if self.text:
            self.text += "\n\n"

    def handle_starttag(self, tag, attrs) -> None:
        if tag in P.IGNORED_TAGS:
            self._hidden += 1
        if self._hidden:
            return
        if tag in _BLOCKS:
            self._block()
        elif tag == "br":
            self._space = self._heading
            self.text += "" if self._heading else "\n"
        named = dict(attrs)
        for anchor in filter(None, (named.get("id"), named.get("name"))):
            self.anchors.setdefault(anchor, len(self.text))
        if tag in _LEVELS:
            self._heading, self._space = True, False
            self.text += "#" * _LEVELS[tag] + " "

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag) -> None:
        if tag in P.IGNORED_TAGS:
            self._hidden = max(0, self._hidden - 1)
        elif not self._hidden and tag in _BLOCKS:
            self._heading = self._heading and tag not in _LEVELS
            self._block()

    def handle_data(self, data) -> None:
        if self._hidden:
            return
        words = " ".join(data.split())
        if not words:
            self._space = True
            return
        if (self._space or data[0].isspace()) and self.text and self.text[-1] != "\n":
            self.text += " "
        self.text += words
        self._space = data[-1].isspace()


def markdown_of(page: str) -> tuple[str, dict[str, int]]:
    parser = MarkdownText()
    parser.feed(page)
    parser.close()
    return parser.text, parser.anchors


def to_markdown(pages: DataFrame, html: str = "html", name: str = "markdown") -> DataFrame:
    """pages with their text; null html gives an empty one."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: re.sub(r"\n{3,}", "\n\n", markdown_of(t or "")[0]).strip())

    return pages.withColumn(name, run(html))


# EPUB


def _tag(element) -> str:
    return element.tag.rpartition("}")[2] if isinstance(element.tag, str) else ""


def _all(root, tag: str) -> Iterator:
    return (e for e in root.iter() if _tag(e) == tag)


def resolve(base: str, relative: str) -> str:
    """An href seen from the file that names it; its fragment stays, percent signs too."""
    return posixpath.normpath(posixpath.join(posixpath.dirname(base), relative))


class Epub:
    def __init__(self, data: bytes):
        if not zipfile.is_zipfile(io.BytesIO(data)):
            raise ValueError("not a readable EPUB: a ZIP container is expected")
        self.files = zipfile.ZipFile(io.BytesIO(data))
        container = self.member("META-INF/container.xml")
        if container is None:
            raise ValueError("the EPUB has no META-INF/container.xml")
        paths = [e.get("full-path") for e in _all(ElementTree.fromstring(container), "rootfile")]
        self.path = next(filter(None, paths), None)
        if self.path is None:
            raise ValueError("the container names no package document")
        self._package()

    def member(self, name: str) -> bytes | None:
        try:
            return self.files.read(name)
        except KeyError:
            return None

    def _package(self) -> None:
        root = ElementTree.fromstring(self.files.read(self.path))
        title = next((e.text for e in _all(root, "title") if e.text), "")
        self.title = " ".join(title.split())
        self.manifest = {
            e.get("id"): (resolve(self.path, e.get("href")), e.get("media-type", ""), e.get("properties", "").split())
            for e in _all(root, "item")
            if e.get("id") and e.get("href")
        }
        self.spine = [e.get("idref") for e in _all(root, "itemref") if e.get("idref") and e.get("linear", "yes") != "no"]
        toc = next((e.get("toc") for e in _all(root, "spine")), None)
        by_type = (href for href, kind, _ in self.manifest.values() if kind == P.NCX_TYPE)
        self.ncx = self.manifest[toc][0] if toc in self.manifest else next(by_type, None)
        self.nav = next((href for href, _, properties in self.manifest.values() if "nav" in properties), None)

    def entries(self) -> list[tuple[str, str]]:
        """(title, href) of the top level of the navigation document, or else of the NCX."""
        for at, read in ((self.nav, self._nav_entries), (self.ncx, self._ncx_entries)):
            data = self.member(at) if at else None
            found = [(" ".join(label.split()), resolve(at, href)) for label, href in read(ElementTree.fromstring(data)) if label.strip() and href] if data else []
            if found:
                return found
        return []

    @staticmethod
    def _nav_entries(root) -> Iterator[tuple[str, str]]:
        navs = list(_all(root, "nav"))
        contents = [n for n in navs if any(k.endswith("type") and v == "toc" for k, v in n.attrib.items())]
        lists = [e for nav in (contents or navs)[:1] for e in nav if _tag(e) == "ol"]
        for item in lists[0] if lists else ():
            link = next(_all(item, "a"), None) if _tag(item) == "li" else None
            if link is not None:
                yield "".join(link.itertext()), link.get("href", "")

    @staticmethod
    def _ncx_entries(root) -> Iterator[tuple[str, str]]:
        for point in next(_all(root, "navMap"), ()):
            if _tag(point) == "navPoint":
                label, content = next(_all(point, "text"), None), next(_all(point, "content"), None)
                yield "" if label is None else "".join(label.itertext()), "" if content is None else content.get("src", "")

    def documents(self) -> list[tuple[str, str, dict[str, int]]]:
        """(href, text, anchors) in reading order."""
        items = (self.manifest[i] for i in self.spine if i in self.manifest)
        read = ((href, self.member(href)) for href, kind, _ in items if kind in P.SPINE_TYPES)
        return [(href, *markdown_of(data.decode("utf-8", "replace"))) for href, data in read if data is not None]

    def chapters(self) -> list[tuple[str, str]]:
        documents = self.documents()
        if not documents:
            raise ValueError("the EPUB contains no readable spine documents")
        place = {href: n for n, (href, _, _) in enumerate(documents)}
        marks = []
        for title, href in self.entries():
            path, _, fragment = href.partition("#")
            if path in place:
                marks.append((place[path], documents[place[path]][2].get(fragment, 0), title))
        marks.sort(key=lambda m: m[:2])
        return self._marked(documents, marks) if marks else self._by_document(documents)

    @staticmethod
    def _marked(documents: list, marks: list[tuple[int, int, str]]) -> list[tuple[str, str]]:
        """From each mark to the next; text before the first belongs to none."""
        out = []
        for (d, at, title), (e, to, _) in zip(marks, [*marks[1:], (len(documents) - 1, None, "")], strict=True):
            if exact.is_skipped_section(title):
                continue
            parts = [documents[n][1][at if n == d else 0 : to if n == e else None] for n in range(d, e + 1)]
            text = exact.clean_segment(exact.drop_licence(re.sub(r"\n{3,}", "\n\n", "\n\n".join(parts))))
            if exact.has_narratable_body(text):
                opens = text.casefold().startswith(title.casefold()) and text[0] != "#"
                out.append((title, "# " + text if opens else text))
        return out

    @staticmethod
    def _by_document(documents: list) -> list[tuple[str, str]]:
        out = []
        for n, (_, text, _) in enumerate(documents, 1):
            if body := exact.clean_segment(exact.drop_licence(text)):
                first = next(filter(None, map(str.strip, text.splitlines())), "")
                title = first.lstrip("#").strip() if first.startswith("#") else ""
                out.append((title or f"Section {n}", body))
        return [("Audiobook", out[0][1])] if len(out) == 1 else out


CHAPTERS = "path string, chapter_index int, title string, source_text string, error string"


def epub_chapters(files: DataFrame) -> DataFrame:
    """A row for each chapter of EPUB files (path, content); a file that cannot be read has one with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for at, data in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(at, n, title, text, None) for n, (title, text) in enumerate(Epub(bytes(data)).chapters())]
                except (ValueError, KeyError, ElementTree.ParseError, zipfile.BadZipFile) as e:
                    rows.append((at, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in CHAPTERS.split(", ")]).astype({"chapter_index": "Int32"})

    return files.select("path", "content").mapInPandas(run, CHAPTERS)


def read_epubs(spark: SparkSession, path: str) -> DataFrame:
    """The chapters of the EPUB files below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[eE][pP][uU][bB]").load(path)
    return epub_chapters(files)
