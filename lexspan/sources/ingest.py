"""Documents of several formats turned to text: detection, a registry of converters, and the converters."""

from __future__ import annotations

import base64
import email
import email.policy
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspan.functions.text import dehyphenate

#: Formats by file extension.
EXTENSIONS = {"txt": "plain_text", "md": "markdown", "html": "html", "htm": "html", "pdf": "pdf", "docx": "word", "doc": "word", "rtf": "rtf", "eml": "email", "msg": "email"}


def detect_format(filename: Column, content: Column) -> Column:
    """By extension, else by how the content begins, else plain text."""
    ext = F.lower(F.regexp_extract(F.coalesce(filename, F.lit("")), r"\.([^.]*)$", 1))
    by_name = F.coalesce(*[F.when(ext == k, v) for k, v in EXTENSIONS.items()])
    head = F.regexp_replace(F.coalesce(content, F.lit("")), r"(?U)^\s+", "")
    looks = (
        F.when(head.startswith("JVBER"), "pdf")
        .when(head.startswith("UEsDB"), "word")
        .when(head.startswith("{\\rtf"), "rtf")
        .when(head.rlike(r"(?i)\A(?:From|Subject|Date|To|Message-ID):\s"), "email")
        .when(head.startswith("<!") | F.startswith(F.lower(F.left(head, F.lit(5))), F.lit("<html")), "html")
        .when(head.startswith("# ") | F.contains(head, F.lit("\n## ")), "markdown")
        .otherwise("plain_text")
    )
    return F.coalesce(by_name, looks)


def markdown_text(c: Column) -> Column:
    """Markdown without its marks; images before links, as a link's mark is within an image's."""
    for pattern, by in (
        (r"(?s)```[^\n]*\n(.*?)```", "$1"),
        (r"`([^`]+)`", "$1"),
        (r"!\[([^\]]*)\]\([^)]*\)", "$1"),
        (r"\[([^\]]+)\]\([^)]*\)", "$1"),
        (r"(?m)^#{1,6}\s+", ""),
        (r"\*\*\*?([^*]+)\*\*\*?", "$1"),
        (r"(?<![A-Za-z0-9_])[*_]([^*_\n]+)[*_](?![A-Za-z0-9_])", "$1"),
        (r"(?m)^\s*(?:[-*_]\s*){3,}$", ""),
        (r"(?m)^\s*(?:[-*+]|[0-9]+\.)\s+", ""),
    ):
        c = F.regexp_replace(c, pattern, by)
    return c


def html_text(c: Column) -> Column:
    """Markup dropped with scripts, styles and heads; the common entities resolved; white space runs to a space."""
    c = F.regexp_replace(c, r"(?is)<(script|style|head)\b[^>]*>.*?</(?:script|style|head)\s*>", " ")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.btrim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


class _Elements(HTMLParser):
    """Blocks with the headings that they stand under."""

    BLOCKS = ("p", "li", "td", "th", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6")
    HIDDEN = ("script", "style", "head")

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, list[str], int | None]] = []
        self._path: list[str] = []
        self._open, self._text, self._hidden = "", "", 0

    def handle_starttag(self, tag, attrs):
        if tag in self.HIDDEN:
            self._hidden += 1
        elif tag in self.BLOCKS:
            self._close()
            self._open = tag

    def handle_endtag(self, tag):
        if tag in self.HIDDEN:
            self._hidden = max(self._hidden - 1, 0)
        elif tag in self.BLOCKS and tag == self._open:
            self._close()

    def handle_data(self, data):
        if not self._hidden and self._open:
            self._text += data

    def _close(self) -> None:
        text, tag = " ".join(self._text.split()), self._open
        self._open, self._text = "", ""
        if not text:
            return
        level = int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else None
        if level is not None:
            self._path = [*self._path[: level - 1], text]
        kind = "heading" if level is not None else "list_item" if tag == "li" else "table_cell" if tag in ("td", "th") else "paragraph"
        self.found.append((text, kind, list(self._path), level))

    def close(self):
        super().close()
        self._close()


def html_elements(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, ord, text, element_type, section_path, level) of pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, x in zip(pdf[key], pdf[html], strict=True):
                p = _Elements()
                p.feed(x or "")
                p.close()
                rows += [(k, i, *e) for i, e in enumerate(p.found)]
            yield pd.DataFrame(rows, columns=[key, "ord", "text", "element_type", "section_path", "level"]).astype({"level": "Int32"})

    return df.select(key, html).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, ord int, text string, element_type string, section_path array<string>, level int")


def unwrapped(raw: str, looks: Callable[[str], bool]) -> str:
    """The text, or what it is in base 64 if only that looks like its format."""
    if looks(raw):
        return raw
    try:
        inner = decoded(base64.b64decode("".join(raw.split()), validate=True))
    except ValueError:
        return raw
    return inner if looks(inner) else raw


def decoded(data: bytes, charset: str | None = None) -> str:
    """Bytes in the charset that they name, else in UTF-8, else in that of Western Windows."""
    for c in (charset, "utf-8"):
        try:
            if c:
                return data.decode(c)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("cp1252", "replace")


_HEADER = re.compile(r"\s*[A-Za-z][A-Za-z0-9-]*:[ \t]")


def eml_text(raw: str) -> str:
    """Four headers and the body, plain before HTML; the message itself may be in base 64, and so may its body."""
    raw = unwrapped(raw, lambda x: bool(_HEADER.match(x)))
    m = email.message_from_bytes(raw.lstrip().encode("utf-8", "surrogateescape"), policy=email.policy.default)
    head = [f"{h}: {m[h]}" for h in ("From", "To", "Date", "Subject") if m[h]]
    body = m.get_body(preferencelist=("plain", "html"))
    text = decoded(body.get_payload(decode=True) or b"", body.get_content_charset()) if body else ""
    if body is not None and body.get_content_type() == "text/html":
        text = " ".join(re.sub(r"(?s)<[^>]*>", " ", text).split())
    return "\n".join(head) + "\n\n" + text.strip()


def docx_text(data: bytes) -> str:
    """Paragraphs of a Word document, apart by blank lines."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    parts = ["".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p")]
    return "\n\n".join(p for p in parts if p.strip())


def rtf_text(raw: str) -> str:
    """Rich text without groups that hold no text, and with its escapes resolved; it may be in base 64."""
    raw = unwrapped(raw, lambda x: x.lstrip().startswith("{\\rtf"))
    if not raw.lstrip().startswith("{\\rtf"):
        raise ValueError("no rich text")
    raw = re.sub(r"\{\\(?:\*|fonttbl|colortbl|stylesheet|info|pict)[^{}]*(?:\{[^{}]*\}[^{}]*)*\}", "", raw)
    raw = re.sub(r"\\'([0-9a-fA-F]{2})", lambda m: bytes.fromhex(m[1]).decode("cp1252", "replace"), raw)
    raw = re.sub(r"\\u(-?[0-9]+) ?\??", lambda m: chr(int(m[1]) % 65536), raw)
    raw = re.sub(r"\\(?:par|line)\b ?", "\n", raw)
    raw = re.sub(r"\\[a-z]+-?[0-9]* ?", "", raw)
    return re.sub(r"[{}]", "", raw).strip()


#: Converters by format: expressions, and functions of one text, which may raise. A PDF's needs a parser, which ``register`` takes.
CONVERTERS: dict[str, Callable[[Column], Column]] = {"plain_text": lambda c: c, "markdown": markdown_text, "html": html_text}
BY_PYTHON: dict[str, Callable[[str], str]] = {"email": eml_text, "rtf": rtf_text, "word": lambda x: docx_text(base64.b64decode("".join(x.split())))}


def register(name: str, convert: Callable[[Column], Column]) -> None:
    BY_PYTHON.pop(name, None)
    CONVERTERS[name] = convert


def register_python(name: str, convert: Callable[[str], str]) -> None:
    """A converter of one text at a time; what it raises is that file's error."""
    CONVERTERS.pop(name, None)
    BY_PYTHON[name] = convert


def ingest(df: DataFrame) -> DataFrame:
    """(doc_id, format, full_text, error) from (doc_id, filename, content): each format's rows through its converter.

    A file that its converter can't read, or whose format has none, has a null text and an error that says why; the others aren't touched by it. Null contents stay null.
    """
    found = df.withColumn("format", detect_format(F.col("filename"), F.col("content")))
    functions = dict(BY_PYTHON)

    def each(formats: pd.Series, contents: pd.Series) -> pd.DataFrame:
        texts, errors = [], []
        for f, x in zip(formats, contents, strict=True):
            text = error = None
            if x is not None:
                try:
                    text = functions[f](x)
                except Exception as e:  # noqa: BLE001  whatever a broken file makes a parser raise
                    error = f"{type(e).__name__}: {e}"[:200]
            texts.append(text)
            errors.append(error)
        return pd.DataFrame({"text": texts, "error": errors}, dtype=object)

    own = F.col("format").isin(*functions)
    out = F.lit(None).cast("string")
    for name, convert in CONVERTERS.items():
        out = F.when(F.col("format") == name, convert(F.when(F.col("format") == name, F.col("content")))).otherwise(out)
    none = ~own & ~F.col("format").isin(*CONVERTERS) & F.col("content").isNotNull()
    read = F.pandas_udf(each, "text string, error string")(F.col("format"), F.when(own, F.col("content")))
    met = found.withColumn("read", read).withColumn("plain", out)
    return met.select("doc_id", "format", F.coalesce("read.text", "plain").alias("full_text"), F.when(none, F.concat(F.lit("no converter for "), "format")).otherwise(F.col("read.error")).alias("error"))


def pdf_pages(df: DataFrame) -> DataFrame:
    """Pages (doc_id, page, text) that a parser gave, cleaned."""
    return df.withColumn("text", dehyphenate(F.col("text")))


def job_files(spark: SparkSession, path: str) -> DataFrame:
    """Jobs kept as one JSON file each."""
    return spark.read.json(path, multiLine=True)
