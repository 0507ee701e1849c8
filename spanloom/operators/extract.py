"""Layout-aware text of HTML and XML documents, with the spans of their elements.

A small machine over parser events decides on white space: nothing, a space, one line feed or two are due before the next
piece of text. Each document is read once; functions run over Arrow batches.
"""

from __future__ import annotations

import re
import xml.parsers.expat
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import GREEK, GREEK_NAMES

#: Elements after which a line feed is due, and two.
HTML_ONE = set("dd dt li tr legend option caption fieldset optgroup textarea figcaption".split())
HTML_TWO = set("p h1 h2 h3 h4 h5 h6 dl hr ol ul dir div pre form head menu aside table title center figure footer header hgroup select address article section textarea frameset blockquote".split())
DROPPED = {"script", "style", "command"}
RENAMED = {"b": "strong", "i": "em", "tt": "code", "kbd": "code", "samp": "code", "s": "del", "strike": "del", "listing": "pre", "plaintext": "pre", "embed": "object", "option": "li", **dict.fromkeys(("dir", "menu", "select", "datalist"), "ul")}
ELSEVIER_ONE = set(
    "rdf:li ce:label cals:row sb:author ce:author ce:keyword ce:caption sb:comment ce:doctopic sb:subtitle ce:def- "
    "term ce:note-para sb:maintitle ce:list-item ce:salutation ce:simple-para ce:affiliation ce:index-entry ce:bib- "
    "reference ce:collaboration ce:correspondence ce:glossary-entry ce:def-description sb:translated-title "
    "ce:refers-to-document ce:further-reading-sec ".split()
)
ELSEVIER_TWO = set(
    "rdf:RDF ce:para ja:head ce:note ja:tail ce:list ja:body ce:table sb:title dc:title ce:title ce:intro ce:index "
    "ce:figure dc:format ce:dochead ce:lengend ja:article ce:section ce:caption dc:creator sb:authors ce:editors "
    "ce:textbox ce:display cals:tbody ce:subtitle ce:footnote cals:tgroup ce:keywords ce:sections ce:abstract "
    "ce:def-list ce:glossary ce:index-sec ce:presented sb:reference ce:alt-title ce:other-ref ja:item-info "
    "dc:publisher ce:doctopics ce:copyright ce:biography ce:dedication ce:appendices ce:enunciation ce:e-component "
    "ce:abstract-sec ce:glossary-sec ce:textbox-head ce:alt-subtitle ce:nomenclature ce:textbox-tail ce:author- "
    "group ce:exam-answers prism:copyright ce:textbox-body ce:bibliography ce:section-title ce:miscellaneous "
    "ce:copyright-line ce:table-footnote ce:exam-questions ce:acknowledgment ce:document-thread ce:displayed-quote "
    "ce:further-reading ce:bibliography-sec ce:article-footnote prism:publicationName prism:aggregationType "
    "dp:document-properties ".split()
)
PMC_ONE = set(
    "fn tr kwd aff isbn issn speech subject product country def-head subtitle pub-date def-item term-head alt-title "
    "addr-line publisher article-id journal-id conference verse-line disp-quote custom-meta trans-title institution "
    "series-text disp-formula compound-kwd series-title article-title journal-title trans-subtitle related-object "
    "related-article journal-subtitle article-categories abbrev-journal-title unstructured-kwd-group ".split()
)
PMC_TWO = set(
    "p sec ref fig ack bio app back list body table title notes front array graphic caption address history "
    "response fn-group abstract def-list ref-list glossary sig-block kwd-group fig-group app-group statement table- "
    "wrap subj-group boxed-text sub-article award-group title-group verse-group permissions article-meta journal- "
    "meta nlm-citation floats-group author-notes contrib-group funding-group trans-abstract chem-struct-wrap table- "
    "wrap-group custom-meta-group table-wrap-footer disp-formula-group journal-title-group supplementary-material ".split()
)
BREAKS = {"html": {"br"}, "elsevier": {"ce:br", "ce:vsp"}, "pmc": {"break", "hr"}}
SETS = {"html": (HTML_ONE, HTML_TWO), "elsevier": (ELSEVIER_ONE, ELSEVIER_TWO), "pmc": (PMC_ONE, PMC_TWO)}
SPACE = re.compile("[ \n\t\f\r ]+")
GREEK_BY_NAME = {v: k for k, v in {**GREEK, **{k.upper(): v.capitalize() for k, v in GREEK.items()}}.items()}
NONE, SPACED, LINE, TWO_LINES = range(4)
DUE = ("", " ", "\n", "\n\n")


class Layout:
    """Collects text and element spans (begin, end, name, attributes) from the events of a parser."""

    def __init__(self, kind: str):
        self.one, self.two = SETS[kind]
        self.breaks, self.kind = BREAKS[kind], kind
        self.out: list[str] = []
        self.size, self.state, self.content, self.silent = 0, NONE, False, 0
        self.open: list[list] = []
        self.spans: list[tuple[int, int, str, list[tuple[str, str]]]] = []

    def space(self) -> None:
        if self.state == NONE:
            self.state = SPACED

    def line(self) -> None:
        if self.state != TWO_LINES:
            self.state = LINE

    def put(self, s: str) -> None:
        self.out.append(s)
        self.size += len(s)

    def text(self, data: str) -> None:
        if self.silent:
            return
        runs = SPACE.split(data)
        for i, run in enumerate(runs):
            if i:
                self.space()
            if run:
                if self.content:
                    self.put(DUE[self.state])
                    self.content = self.state < LINE
                for frame in self.open:
                    if frame[0] is None:
                        frame[0] = self.size
                self.put(run)
                self.content, self.state = True, NONE

    def start(self, tag: str, attrs: list[tuple[str, str]]) -> None:
        if tag in self.breaks:
            if not self.silent:
                self.put("\n")
            return
        greek = False
        if not self.silent and self.kind == "html":
            own = dict(attrs)
            for name in ("title", "label", "alt"):
                value = own.get(name)
                if value:
                    if tag == "img" and name == "alt" and value in GREEK_BY_NAME:
                        greek = True
                        self.text(GREEK_BY_NAME[value])
                    else:
                        self.space()
                        self.text(value)
        elif tag == "ce:glyph":
            self.text(dict(attrs).get("name", ""))
        self.open.append([None, tag, attrs, greek])
        self.silent += (tag in DROPPED or tag == "title") if self.kind == "html" else 0
        if tag in self.one or tag in self.two:
            self.line()
        elif not greek:
            self.space()

    def end(self, tag: str) -> None:
        if tag in self.breaks or not any(f[1] == tag for f in self.open):
            return
        while True:
            begin, name, attrs, greek = self.open.pop()
            if self.kind == "html":
                self.silent -= name in DROPPED or name == "title"
            self.spans.append((self.size if begin is None else begin, self.size, name, attrs))
            if name in self.two:
                self.state = TWO_LINES
            elif name in self.one:
                self.line()
            elif not greek:
                self.space()
            if name == tag:
                return

    def close(self) -> tuple[str, list]:
        while self.open:
            self.end(self.open[-1][1])
        return "".join(self.out), sorted(self.spans, key=lambda s: (s[0], -s[1]))


class _Html(HTMLParser):
    VOID = {"area", "base", "col", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr", "embed"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.layout = Layout("html")

    def handle_starttag(self, tag, attrs):
        self.layout.start(tag, [(k, v or "") for k, v in attrs])
        if tag in self.VOID:
            self.layout.end(tag)

    def handle_endtag(self, tag):
        self.layout.end(tag)

    def handle_data(self, data):
        self.layout.text(data)


def _expat(raw: str, start, end, data) -> None:
    p = xml.parsers.expat.ParserCreate()
    p.buffer_text = True
    p.StartElementHandler = lambda tag, attrs: start(tag, list(attrs.items()))
    p.EndElementHandler, p.CharacterDataHandler = end, data
    p.Parse(raw, True)  # external entities are never fetched


def extract_html(raw: str) -> tuple[str, list]:
    p = _Html()
    p.feed(raw)
    p.close()
    return p.layout.close()


def extract_layout_xml(raw: str, kind: str) -> tuple[str, list]:
    layout = Layout(kind)
    _expat(raw, layout.start, layout.end, layout.text)
    return layout.close()


def extract_xml(raw: str) -> tuple[str, list]:
    """One piece of text a line, after a tab for each level."""
    out, spans, stack = [], [], []
    size = 0

    def start(tag, attrs):
        stack.append((size, tag, attrs))

    def end(tag):
        b, name, attrs = stack.pop()
        spans.append((min(b, size), size, name, attrs))

    def data(s):
        nonlocal size
        s = SPACE.sub(" ", s).strip()
        if s:
            line = "\t" * (len(stack) - 1) + s + "\n"
            out.append(line)
            size += len(line)

    _expat(raw, start, end, data)
    return "".join(out), sorted(spans, key=lambda s: (s[0], -s[1]))


def extract_clean(raw: str) -> tuple[str, list]:
    """Text without tags; of what has a body, only that."""
    body = re.search(r"<body\b[^>]*>", raw, re.I)
    if body:
        end = raw.lower().rfind("</body")
        raw = raw[body.end() : end if end >= body.end() else len(raw)]
    return SPACE.sub(" ", re.sub(r"<[^>]*>", " ", raw)).strip(), []


EXTRACTORS = {"html": extract_html, "xml": extract_xml, "elsevier": lambda r: extract_layout_xml(r, "elsevier"), "pmc": lambda r: extract_layout_xml(r, "pmc"), "clean": extract_clean}


def kind_of(uri: Column, raw: Column, mime: Column | None = None) -> Column:
    """The extractor: by MIME type if there is one, else by the name's ending, else by how the text begins."""
    mime = F.lit(None).cast("string") if mime is None else F.lower(mime)
    head, name = F.lower(F.trim(F.substring(raw, 1, 2000))), F.lower(uri)
    pmc, els = head.contains("journalpublishing") | head.contains("nlm//dtd"), head.contains("elsevier") | head.contains("ce:para")
    as_xml = F.when(pmc, "pmc").when(els, "elsevier").otherwise("xml")
    return F.when(mime.contains("html"), "html").when(mime.contains("xml"), as_xml).when(mime.isNotNull(), "clean").when(name.rlike(r"\.x?html?$"), "html").when(name.rlike(r"\.(n?xml|nlm)$"), as_xml).when(head.startswith("<!doctype html") | head.startswith("<html"), "html").when(head.startswith("<?xml"), as_xml).otherwise("clean")


def extract(raw: DataFrame, key: str = "doc_id", content: str = "raw", kind: Column | None = None, greek_to_latin: bool = False, namespace: str = "", most_chars: int | None = None) -> DataFrame:
    """(key, text, structure) of each row; structure has (begin, end, namespace, identifier, properties). Null content has null text; XML that can't be parsed is taken as plain.

    Texts are whole. With most_chars, plain ones end there, and "cut" says which.
    """
    names = {**GREEK_NAMES} if greek_to_latin else {}
    ns = namespace if not namespace or namespace[-1] in "#/=" else namespace + "#"
    prop = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    span = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("namespace", pa.string()), ("identifier", pa.string()), ("properties", prop)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows, cut = [], [], []
            for own, how in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if own is None:
                    texts.append(None)
                    rows.append(None)
                    cut.append(None)
                    continue
                for letter, name in names.items():
                    own = own.replace(letter, name)
                try:
                    text, spans = EXTRACTORS[how or "clean"](own)
                except xml.parsers.expat.ExpatError:
                    text, spans, how = *extract_clean(own), "clean"
                cut.append(bool(most_chars) and (how or "clean") == "clean" and len(text) > most_chars)
                texts.append(text[:most_chars] if cut[-1] else text)
                rows.append([{"begin": b, "end": e, "namespace": ns, "identifier": RENAMED.get(t, t), "properties": [{"name": k, "value": v} for k, v in a]} for b, e, t, a in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(rows, pa.list_(span)), *([pa.array(cut, pa.bool_())] if most_chars else [])], [key, "text", "structure", *(["cut"] if most_chars else [])])

    kind = F.lit("html") if kind is None else kind
    return raw.select(key, F.col(content).cast("string").alias("raw"), kind.alias("kind")).mapInArrow(run, f"{key} {raw.schema[key].dataType.simpleString()}, text string, structure array<struct<begin: int, end: int, namespace: string, identifier: string, properties: array<struct<name: string, value: string>>>>" + (", cut boolean" if most_chars else ""))


def structure(extracted: DataFrame, key: str = "doc_id") -> DataFrame:
    return extracted.select(key, F.explode("structure").alias("s")).select(key, "s.*")


def metadata(rows: DataFrame, column: str, key: str = "doc_id") -> DataFrame:
    """(key, namespace, identifier) of each entry of a map of metadata."""
    return rows.select(key, F.explode(column).alias("namespace", "identifier"))
