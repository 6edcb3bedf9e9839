"""Feed documents as XML: RSS and Atom items by namespace and place, and what is wrong with documents that can't be read.

Spark's own XML reader names fields by prefix, which a document may choose freely, takes UTF-8 text only and loses text beside
nested elements. So a document, which is small, is parsed by one task with the XML parser of the standard library; documents are
rows, and a broken one is an error of its source alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ATOM = "{http://www.w3.org/2005/Atom}"
#: Where each field is looked for, in this order: direct children, with no namespace or Atom's.
TITLE = ("title", ATOM + "title")
ADDRESS = ("link", "guid")
SUMMARY = ("description", "summary", ATOM + "summary", ATOM + "content")
PUBLISHED = ("pubDate", "published", "updated", ATOM + "published", ATOM + "updated")
FIELDS = ("title", "url", "summary", "published")
OUT = "n int, title string, url string, summary string, published string, error string"


def _text(element: ElementTree.Element, names: tuple[str, ...]) -> str | None:
    """The text, nested elements' too, of the first child of the first name that has any."""
    for name in names:
        child = element.find(name)
        if child is not None and (said := "".join(child.itertext()).strip()):
            return said
    return None


def items(body: bytes) -> list[tuple[str | None, ...]]:
    """(title, url, summary, published) of a document's items; those without title or address are left out."""
    try:
        source: str | bytes = body.decode()
    except UnicodeDecodeError:
        source = body  # its declaration says how it is encoded
    root = ElementTree.fromstring(source)
    out = []
    for e in root.findall("./channel/item") or root.iter(f"{ATOM}entry"):
        link = e.find(f"{ATOM}link")
        href = link.get("href", "").strip() if link is not None else ""
        title, url = _text(e, TITLE), href or _text(e, ADDRESS)
        if title and url:
            out.append((title, url, _text(e, SUMMARY), _text(e, PUBLISHED)))
    return out


def parsed(feeds: DataFrame, body: str = "body") -> DataFrame:
    """The documents' other columns with n (an item's place), title, url, summary and published as they are written, and error.

    A document that isn't XML gives one row with its error and without an item; one without items gives none.
    """
    rows = feeds.select(F.col(body).cast("binary").alias(body), *[c for c in feeds.columns if c != body])
    names = [c.split()[0] for c in OUT.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, raw in enumerate(batch.column(0).to_pylist()):
                try:
                    found = [(n, *item, None) for n, item in enumerate(items(raw or b""))]
                except (ElementTree.ParseError, LookupError, ValueError) as e:  # no XML, or an encoding that isn't known
                    found = [(None, *[None] * len(FIELDS), f"{type(e).__name__}: {e}")]
                if found:
                    own = [batch.column(c).take(pa.array([k] * len(found))) for c in range(1, batch.num_columns)]
                    told = [pa.array([f[c] for f in found], pa.int32() if c == 0 else pa.string()) for c in range(len(names))]
                    yield pa.RecordBatch.from_arrays([*own, *told], [*batch.schema.names[1:], *names])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(work, f"{kept}, {OUT}" if kept else OUT)
