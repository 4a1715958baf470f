"""Interleaved document sequences.

HTML is parsed to an ordered list of text and media references, with a media element's caption beside it. References are
digests (src="sha256:..."), which a join resolves to payloads of a media store; positions and captions stay with them.

A media store is a Parquet table (digest, media) of PNG images, 64 RGB pixels wide. A payload is a text's UTF-8 bytes and
blanks up to a positive multiple of 192, one row of pixels each 192 bytes. A store may hold a payload more than once.

Null texts count as empty: a payload of 192 blanks. Pages that no document has the number of are left out of the report. Null HTML gives no rows, as does HTML without text or media. Repeated
rows are kept. References that the store lacks keep their row with a null payload. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import as_large, slices, small_batches, stored, utf8

ROW = 192
PARTS = "array<struct<kind: string, text: string, ref: string, caption: string>>"
FACTS = "struct<n_bytes: bigint, payload_bytes: bigint, payload_sha256: string, tail_crc32: bigint, media_bytes: bigint, media_sha256: string, feature: string>"
_MEDIA, _HIDDEN = {"img", "audio", "video", "source"}, {"script", "style", "template", "noscript"}


class _Parts(HTMLParser):
    """Collects text and media in document order; a figcaption goes to the figure's media, else alt does."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.words, self.hidden, self.caption, self.figure = [], [], 0, None, None

    def flush(self):
        text = re.sub(r"\s+", " ", "".join(self.words)).strip()
        self.words = []
        if text:
            self.parts.append({"kind": "text", "text": text, "ref": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        elif tag == "figure":
            self.flush()
            self.figure = len(self.parts)
        elif tag == "figcaption":
            self.flush()
            self.caption = []
        elif tag in _MEDIA and (src := dict(attrs).get("src")):
            self.flush()
            self.parts.append({"kind": "media", "text": None, "ref": src, "caption": dict(attrs).get("alt")})
        elif tag in ("p", "br", "div", "li", "h1", "h2", "h3", "tr", "article"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = re.sub(r"\s+", " ", "".join(self.caption)).strip()
            self.caption = None
            for part in self.parts[self.figure or 0 :]:
                if part["kind"] == "media":
                    part["caption"] = text
        elif tag == "figure":
            self.flush()
            self.figure = None
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "tr", "article"):
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            (self.words if self.caption is None else self.caption).append(data)


def parts_of(html: str | None) -> list[dict]:
    parser = _Parts()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.parts


def parsed(html: Column) -> Column:
    """Array of (kind, text, ref, caption) in document order."""

    @F.arrow_udf(PARTS)
    def parse(pages: pa.Array) -> pa.Array:
        fields = [(c, pa.string()) for c in ("kind", "text", "ref", "caption")]
        return pa.array([parts_of(p) for p in pages.to_pylist()], pa.list_(pa.struct(fields)))

    return parse(html)


def png(payload: bytes) -> bytes:
    """An RGB image, 64 pixels wide, of a payload whose length is a multiple of 192."""
    rows = len(payload) // ROW
    lines = np.zeros((rows, ROW + 1), np.uint8)
    lines[:, 1:] = np.frombuffer(payload, np.uint8).reshape(rows, ROW)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", ROW // 3, rows, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 2)) + chunk(b"IEND", b"")


def samples(image: bytes) -> np.ndarray:
    """Rows of 8-bit samples of an image that png() made."""
    at, data = 8, []
    while at < len(image):
        (size,), kind = struct.unpack(">I", image[at : at + 4]), image[at + 4 : at + 8]
        if kind == b"IDAT":
            data.append(image[at + 8 : at + 8 + size])
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, ROW + 1)[:, 1:]


def feature(pixels: np.ndarray) -> str:
    """Sums of the three channels, and a histogram of eight levels."""
    sums = pixels.reshape(-1, 3).sum(axis=0, dtype=np.int64)
    levels = np.bincount(pixels.ravel() >> 5, minlength=8)
    return f"rgb={','.join(map(str, sums))};levels={','.join(map(str, levels))}"


def as_media(text: Column) -> Column:
    """struct<digest, n, media> of a text's payload; the digest is the text's own sha256."""

    @F.arrow_udf("struct<digest: string, n: bigint, media: binary>")
    def stored_form(texts: pa.Array) -> pa.Array:
        digests, sizes, media = [], [], []
        for some in slices(as_large(texts), 4 << 20):
            raw, bounds = utf8(some)
            for a, b in zip(bounds, bounds[1:], strict=False):
                own = raw[a:b].tobytes()
                digests.append(hashlib.sha256(own).hexdigest())
                sizes.append(len(own))
                media.append(png(own + b" " * (-len(own) % ROW if own else ROW)))
        return pa.StructArray.from_arrays([pa.array(digests, pa.string()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["digest", "n", "media"])

    return stored_form(text)


def facts(n: Column, media: Column) -> Column:
    """What is found in a stored image: sizes, checksums and the feature of its samples."""

    @F.arrow_udf(FACTS)
    def read(sizes: pa.Array, images: pa.Array) -> pa.Array:
        rows = []
        for size, image in zip(sizes.to_pylist(), images, strict=True):
            image = image.as_py()
            pixels = samples(image)
            payload = pixels.tobytes()
            rows.append((size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), feature(pixels)))
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = zip(*rows, strict=True) if rows else [[] for _ in names]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return read(n, media)


def media_store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The payloads of docs, written as a table (digest, n, media) and read again."""
    small_batches(docs.sparkSession)
    return stored(docs.select(as_media(F.col(text_col)).alias("m")).select("m.*"), "media")


def sequences(pages: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """A row for each part of each page: id, parts (their number), pos, kind, text, ref, caption and the digest that ref names."""
    rows = pages.select(F.col(id_col).alias("id"), parsed(F.col(html_col)).alias("all")).select("id", F.size("all").alias("parts"), F.posexplode("all").alias("pos", "part")).select("id", "parts", "pos", "part.*")
    return rows.withColumn("digest", F.when(F.col("ref").startswith("sha256:"), F.substring("ref", 8, 64)))


def resolved(pages: DataFrame, media: DataFrame, id_col: str, html_col: str = "html") -> DataFrame:
    """The rows of sequences() with media, what the store knows of the digest.

    media has a row for each digest (digest and any columns), small ones such as facts(); pages with a common digest are
    dealt out by the join, since payloads themselves stay where they are.
    """
    rows = sequences(pages, id_col, html_col)
    known = _known(media)
    plain = rows.where("digest is null").withColumn("media", F.lit(None).cast(known.schema["media"].dataType))
    found = rows.where("digest is not null").join(known, "digest", "left").select(plain.columns)
    return found.unionByName(plain).drop("digest")


def _known(media: DataFrame) -> DataFrame:
    return media.select("digest", F.struct(*[c for c in media.columns if c != "digest"]).alias("media"))


def with_figures(docs: DataFrame, pages: DataFrame | None) -> DataFrame:
    """(doc_id, html): each document as a page, whose first part is a figure that holds the document's text as its payload and
    its id as the caption, and whose last one names the same payload again; between them stands the page of the same number, if
    there is one. Of several pages of a number the least HTML is taken."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    own = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    figure = F.concat(F.lit('<figure><img src="sha256:'), digest, F.lit('"><figcaption>'), own, F.lit("</figcaption></figure>"))
    again = F.concat(F.lit('<p>again: <img alt="again" src="sha256:'), digest, F.lit('"></p>'))
    rows = docs.select("doc_id", figure.alias("figure"), again.alias("again"))
    if pages is None:
        return rows.select("doc_id", F.concat("figure", "again").alias("html"))
    one = pages.groupBy(F.col("page_id").alias("doc_id")).agg(F.min("html").alias("html"))
    return rows.join(one, "doc_id", "left").select("doc_id", F.concat("figure", F.coalesce("html", F.lit("")), "again").alias("html"))


def media_report(docs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Each document's text as a payload, stored as an image; the pages that show it parsed, its digest resolved, and what was
    found in the stored image, with the caption and the number of parts of the sequence."""
    store = media_store(docs)
    known = store.select("digest", facts(F.col("n"), F.col("media")).alias("f")).select("digest", "f.*")
    names = [c for c in known.columns if c != "digest"]
    known = stored(known.groupBy("digest").agg(*(F.first(c).alias(c) for c in names)), "facts")  # a join of its own, which can split a hot digest
    shown = sequences(with_figures(docs, pages), "doc_id").where("pos = 0 and digest is not null").select("id", "parts", "caption", "digest")
    rows = shown.join(_known(known), "digest", "left")
    return rows.select(F.col("id").alias("doc_id"), *(F.col(f"media.{c}") for c in names), "caption", "parts")
