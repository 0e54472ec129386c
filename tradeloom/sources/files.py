"""Tables, text and office files as grids, and grids as key:value rows."""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import payloads


def grid_to_rows(grid: list[list[str | None]]) -> list[str]:
    """`header:value` rows of a sheet with merged and stacked headers.

    Header rows are those at the top before the first row in which at least half of the filled cells have a digit;
    the first row alone if there is no such row. A gap in a header row takes the text to its left; the headers of
    a column are joined by ` > ` without repeats. Empty cells and empty rows are left out.
    """
    width = max((len(r) for r in grid), default=0)
    rows = [[(str(c).strip() if c is not None else "") for c in r] + [""] * (width - len(r)) for r in grid]
    rows = [r for r in rows if any(r)]
    if not rows:
        return []
    data = next((i for i, r in enumerate(rows) if i and 2 * sum(any(ch.isdigit() for ch in c) for c in r if c) >= sum(bool(c) for c in r)), 1)
    heads = []
    for r in rows[:data]:
        last, filled = "", []
        for c in r:
            last = c or last
            filled.append(last)
        heads.append(filled if data > 1 else r)
    names = [" > ".join(dict.fromkeys(h[c] for h in heads if h[c])) or f"col{c + 1}" for c in range(width)]
    return [", ".join(f"{names[c]}:{v}" for c, v in enumerate(r) if v) for r in rows[data:]]


def xlsx_grid(data: bytes) -> list[list[str]]:
    """The first sheet of a workbook; cells without a reference follow each other."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheet = sorted(n for n in names if re.match(r"xl/worksheets/[^/]+\.xml$", n))[0]
        out = []
        for row in ElementTree.fromstring(z.read(sheet)).iter(f"{{{ns['m']}}}row"):
            cells: list[str] = []
            for c in row:
                at = len(cells)
                if ref := re.match(r"[A-Z]+", c.get("r") or ""):
                    at = 0
                    for ch in ref[0]:
                        at = at * 26 + ord(ch) - 64
                    at -= 1
                value = c.find("m:v", ns)
                text = "".join(t.text or "" for t in c.iter(f"{{{ns['m']}}}t")) if c.get("t") == "inlineStr" else (value.text if value is not None else "")
                if c.get("t") == "s" and text:
                    text = shared[int(text)]
                cells += [""] * (at + 1 - len(cells))
                cells[at] = text or ""
            out.append(cells)
    return out


def zipped_text(data: bytes, part: str) -> str:
    """The paragraphs of an office document's XML part, one a line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        name = next(n for n in z.namelist() if re.search(part, n))
        lines = []
        for p in ElementTree.fromstring(z.read(name)).iter():
            if p.tag.rsplit("}", 1)[-1] == "p":
                lines.append("".join(t.text or "" for t in p.iter() if t.tag.rsplit("}", 1)[-1] == "t"))
    return "\n".join(x for x in lines if x)


def file_text(path: str, data: bytes) -> str:
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("xlsx", "xlsm"):
        return "\n".join(grid_to_rows(xlsx_grid(data)))
    if kind == "docx":
        return zipped_text(data, r"^word/document\.xml$")
    if kind == "hwpx":
        return zipped_text(data, r"Contents/section0\.xml$")
    if kind in ("hwp", "doc", "docs", "xls", "xlsb"):
        return zipped_text(data, r"(word/document|Contents/section0)\.xml$") if data[:2] == b"PK" and kind != "xlsb" else printable(data)
    text = decode(data)
    if kind == "csv":
        return "\n".join(grid_to_rows(pd.read_csv(io.StringIO(text), header=None, dtype=str, keep_default_na=False).values.tolist()))
    return text


def printable(data: bytes, least: int = 4) -> str:
    """The runs of letters in a binary document, one a line: as UTF-16 and as ASCII, each text once."""
    wide = re.findall(r"[\w\s.,:;()/%%-]{%d,}" % least, data.decode("utf-16-le", "ignore"))
    plain = [m.decode() for m in re.findall(rb"[\x20-\x7e]{%d,}" % least, data)]
    known = [" ".join(t.split()) for t in [*(w for w in wide if re.search(r"[A-Za-z0-9\uac00-\ud7a3]", w)), *plain]]
    return "\n".join(dict.fromkeys(t for t in known if len(t) >= least))


def decode(data: bytes) -> str:
    """UTF-8, or else EUC-KR."""
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return data.decode("euc-kr", "replace")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of all files under a path, by their kind; a broken file has null text."""

    @F.pandas_udf("string")
    def text_of(paths: pd.Series, contents: pd.Series) -> pd.Series:
        def one(p, c):
            try:
                return file_text(p, c)
            except Exception:  # a file of any kind of damage
                return None

        return pd.Series([one(p, c) for p, c in zip(paths, contents)])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", text_of("path", "content").alias("text"))


def read_images(spark: SparkSession, path: str, vision, keys: dict[str, str]) -> DataFrame:
    """(path, data): what vision(image bytes) reads in the bands of every image, merged into one JSON payload.

    vision gives a list of payloads, one a band, and is any callable that can be sent to the workers; keys names the key of each
    list of records (see payloads.merged_bands). An image that it can't read has null.
    """

    @F.pandas_udf("string")
    def read(contents: pd.Series) -> pd.Series:
        def one(content):
            try:
                return json.dumps(payloads.merged_bands(vision(content), keys), sort_keys=True, ensure_ascii=False)
            except Exception:  # noqa: BLE001  an image of any kind of damage
                return None

        return contents.map(one)

    images = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return images.select("path", read("content").alias("data"))


def as_markup(text):
    """Each line of a text as a div, so that it takes the way of a page."""
    safe = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.array_join(F.transform(F.split(safe, "\n"), lambda x: F.concat(F.lit("<div>"), x, F.lit("</div>"))), "\n")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)
