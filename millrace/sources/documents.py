"""Documents from files: Word files natively, other kinds by a parser that is given."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import file_kind
from millrace.plans.session import ship

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = "path string, source string, file_path string, page int, text string, error string"


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_W}t"))


def word_text(content: bytes) -> str:
    """Paragraphs that aren't blank, then the rows of all tables, cells joined by `` | ``; blocks set off by blank lines."""
    with zipfile.ZipFile(io.BytesIO(content)) as file:
        body = ElementTree.fromstring(file.read("word/document.xml")).find(f"{_W}body")
    if body is None:
        return ""
    blocks = [t for p in body.findall(f"{_W}p") if (t := _text(p)).strip()]
    for table in body.findall(f"{_W}tbl"):
        rows = (" | ".join("\n".join(_text(p) for p in cell.findall(f"{_W}p")).strip() for cell in row.findall(f"{_W}tc")) for row in table.findall(f"{_W}tr"))
        blocks += [r for r in rows if r.strip()]
    return "\n\n".join(blocks)


def _parse(parsers: dict[str, Callable[[bytes], str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, kind, content in zip(batch["path"], batch["kind"], batch["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    if kind not in parsers:
                        raise ValueError(f"no parser for {name}")
                    text, error = parsers[kind](content), None
                except Exception as e:  # one broken file mustn't end the job
                    text, error = None, f"{type(e).__name__}: {e}"
                if error or (text and text.strip()):
                    rows.append((path, name, path, 0, text, error))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return run


def read_documents(spark: SparkSession, folder: str, parsers: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """All documents below ``folder``: one row for each file that has text, an error for each that can't be read.

    ``parsers`` turns the bytes of a kind (``pdf``, ``docx``) to text; Word files have one built in.
    """
    ship(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{pdf,docx,doc,PDF,DOCX,DOC}").load(folder)
    return files.select("path", file_kind(F.col("path")).alias("kind"), "content").mapInPandas(_parse({"docx": word_text} | (parsers or {})), SCHEMA)


def file_name(name: str | None) -> str:
    """The name under which an upload is stored: its last part, or ``document``."""
    return (name or "").replace("\\", "/").rsplit("/", 1)[-1].strip() or "document"


def store_upload(spark: SparkSession, folder: str, name: str | None, content: bytes) -> str:
    """Write an upload's bytes under its own name into a folder of any file system that Spark knows; returns the path."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder, file_name(name))
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path.toString()
