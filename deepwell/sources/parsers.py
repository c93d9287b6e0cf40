"""Files and markup to plain text. Parsing runs over Arrow batches of (path, bytes)."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from pathlib import PurePosixPath

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import IngestionError, MissingDependencyError

CODE = frozenset(".py .js .ts .tsx .jsx .java .go .rs .c .h .cpp .hpp .cs .rb .php .swift .kt .scala .sh .sql .yaml .yml .toml .ini".split())


@dataclass
class Parsed:
    text: str
    title: str | None = None
    format: str = "text"
    metadata: dict = field(default_factory=dict)


class _Html(HTMLParser):
    silent = frozenset({"script", "style", "noscript", "template"})
    breaks = frozenset({"p", "div", "br", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6"})

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.titles: list[str] = []
        self.depth = 0
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.silent:
            self.depth += 1
        elif tag == "title":
            self.in_title = True
        elif tag in self.breaks:
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in self.silent:
            self.depth = max(0, self.depth - 1)
        elif tag == "title":
            self.in_title = False

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.titles.append(data)
        elif not self.depth:
            self.out.append(data)


def parse_html(raw: str) -> Parsed:
    p = _Html()
    p.feed(raw)
    p.close()
    lines = (line.strip() for line in "".join(p.out).splitlines())
    return Parsed("\n".join(line for line in lines if line), "".join(p.titles).strip() or None, "html")


def parse_markdown(raw: str) -> Parsed:
    title = next((line.lstrip("#").strip() for line in raw.splitlines() if line.startswith("#")), None)
    return Parsed(raw, title or None, "markdown")


def parse_json(raw: str) -> Parsed:
    try:
        return Parsed(json.dumps(json.loads(raw), indent=2, ensure_ascii=False), None, "json")
    except ValueError as e:
        raise IngestionError(f"not JSON: {e}") from None


def parse_jsonl(raw: str) -> Parsed:
    out = []
    for n, line in enumerate(raw.splitlines(), 1):
        if line.strip():
            try:
                x = json.loads(line)
            except ValueError as e:
                raise IngestionError(f"line {n} is not JSON: {e}") from None
            out.append(str(x["text"]) if isinstance(x, dict) and "text" in x else json.dumps(x, ensure_ascii=False))
    return Parsed("\n\n".join(out), None, "jsonl")


def parse_csv(raw: str) -> Parsed:
    rows = csv.reader(io.StringIO(raw))
    head = next(rows, [])
    out = ["; ".join(f"{h}: {v}" for h, v in zip(head, row, strict=False) if v.strip()) for row in rows]
    return Parsed("\n\n".join(line for line in out if line), None, "csv", {"columns": head})


def _optional(module: str, package: str) -> None:
    raise MissingDependencyError(f"reading this format needs {package} (module {module}), which isn't installed")


def parse_pdf(data: bytes) -> Parsed:
    try:
        import pypdf
    except ImportError:
        _optional("pypdf", "pypdf")
    reader = pypdf.PdfReader(io.BytesIO(data))
    pages = [f"[page {n}]\n{t}" for n, page in enumerate(reader.pages, 1) if (t := (page.extract_text() or "").strip())]
    return Parsed("\n\n".join(pages), (reader.metadata or {}).get("/Title"), "pdf")


def parse_docx(data: bytes) -> Parsed:
    try:
        import docx
    except ImportError:
        _optional("docx", "python-docx")
    return Parsed("\n\n".join(p.text for p in docx.Document(io.BytesIO(data)).paragraphs if p.text.strip()), None, "docx")


_TEXT: dict[str, Callable[[str], Parsed]] = {".md": parse_markdown, ".markdown": parse_markdown, ".html": parse_html, ".htm": parse_html, ".json": parse_json, ".jsonl": parse_jsonl, ".ndjson": parse_jsonl, ".csv": parse_csv, ".txt": Parsed, ".text": Parsed}
_BYTES: dict[str, Callable[[bytes], Parsed]] = {".pdf": parse_pdf, ".docx": parse_docx}
_own: dict[str, Callable[[str, bytes], Parsed]] = {}


def register_parser(extension: str, parse: Callable[[str, bytes], Parsed]) -> None:
    """``parse(path, bytes)`` for files of an extension; it travels to the workers with the job."""
    _own[extension.lower() if extension.startswith(".") else f".{extension.lower()}"] = parse


def supported_extensions() -> list[str]:
    return sorted({*_TEXT, *_BYTES, *CODE, *_own})


def parse_bytes(path: str, data: bytes, own: dict[str, Callable[[str, bytes], Parsed]] | None = None) -> Parsed:
    """By extension; an unknown one is text. Bytes that aren't UTF-8 become replacement characters. The title falls back to the file's stem."""
    name = PurePosixPath(path)
    suffix = name.suffix.lower()
    custom = (_own if own is None else own).get(suffix)
    if custom:
        out = custom(path, data)
    elif suffix in _BYTES:
        out = _BYTES[suffix](data)
    else:
        text = data.decode("utf-8", "replace")
        out = Parsed(text, None, "code", {"language": suffix[1:]}) if suffix in CODE else _TEXT.get(suffix, Parsed)(text)
    if out.title is None:
        out.title = name.stem
    return out


def parsed(files: DataFrame) -> DataFrame:
    """(path, content BINARY) -> (path, content_hash, text, title, format, metadata MAP, error); a file that fails has an error and no text."""
    own = dict(_own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    p = parse_bytes(path, data or b"", own)
                    rows.append((p.text, p.title, p.format, [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in p.metadata.items()], None))
                except Exception as e:  # one bad file is a row, not a failed job
                    rows.append((None, None, None, [], f"{type(e).__name__}: {e}"))
            kinds = [pa.string(), pa.string(), pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["path", "content_hash", "text", "title", "format", "metadata", "error"])

    return files.select("path", "content", F.sha2("content", 256)).mapInArrow(run, "path string, content_hash string, text string, title string, format string, metadata map<string,string>, error string")


def html_text(html: Column) -> Column:
    """struct(title, text)."""

    @F.pandas_udf("title string, text string")
    def convert(pages: pd.Series) -> pd.DataFrame:
        out = [parse_html(p) if p is not None else None for p in pages]
        return pd.DataFrame({"title": [p and p.title for p in out], "text": [p.text if p else None for p in out]})

    return convert(html)


def csv_rows(df: DataFrame) -> Column:
    """A row as "name: value; name: value", without blank values."""
    parts = [F.when(F.trim(F.col(f"`{c}`").cast("string")) != "", F.concat(F.lit(f"{c}: "), F.col(f"`{c}`").cast("string"))) for c in df.columns]
    return F.concat_ws("; ", *parts)
