"""Scans of raw documents and their layout blocks.

A block table has file_id, pos (order in the file), block_type (title, text, table, figure), level, section_path, text and page.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from html.parser import HTMLParser
from pathlib import PurePosixPath

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpuspark.functions.expr import strip
from corpuspark.operators.blocks import BATCH_BYTES, ROWS, over

#: Line ends, and formats by MIME type and by extension.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085  ]"
MIME = {
    "application/pdf": "pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx",
    "text/html": "html",
    "application/xhtml+xml": "html",
    "text/markdown": "text",
    "text/plain": "text",
}
EXTENSION = {".pdf": "pdf", ".docx": "docx", ".pptx": "pptx", ".xlsx": "xlsx", ".html": "html", ".htm": "html", ".md": "text", ".markdown": "text", ".txt": "text"}
TABLE_ROWS = 50


#: Levels of folders that are dealt out to tasks; what lies deeper is listed by the task that has the folder above it.
LEVELS = 3
LISTED = "root int, at string, size long"


def _opened(uri: str) -> tuple[pafs.FileSystem, str] | None:
    """The file system of a URI and the path in it, if Arrow opens it."""
    try:
        fs, at = pafs.FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError):
        return None
    return fs, at.rstrip("/")


def _hidden(name: str, folder: bool = False) -> bool:
    """What Spark's readers pass over."""
    if folder and name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or name.endswith("._COPYING_") or (name.startswith("_") and "=" not in name)


def _listing(uris: list[str], deep: bool):
    """A run over ``LISTED``: files stay; folders, which have no size, become what is in them, and ``deep`` all that is below them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = {}
        for batch in batches:
            todo, done = list(zip(*batch.to_pydict().values(), strict=True)), []
            while todo:
                root, at, size = todo.pop()
                if size is not None:
                    done.append((root, at, size))
                else:
                    fs, base = opened[root] = opened.get(root) or _opened(uris[root])
                    for x in fs.get_file_info(pafs.FileSelector(f"{base}{at}" or "/")):
                        folder = x.type == pafs.FileType.Directory
                        if (folder or x.is_file) and not _hidden(x.base_name, folder):
                            (todo if folder and deep else done).append((root, f"{at}/{x.base_name}", None if folder else x.size))
                if len(done) >= ROWS or (done and not todo):
                    roots, ats, sizes = zip(*done, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(roots, pa.int32()), pa.array(ats, pa.string()), pa.array(sizes, pa.int64())], ["root", "at", "size"])
                    done = []

    return run


def _contents(uris: list[str], shown: list[str]):
    """A run over files of ``LISTED`` that reads them, a few MB at a time."""

    def rows(paths, sizes, contents):
        return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(sizes, pa.int64()), pa.array(contents, pa.binary())], ["path", "length", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = {}
        paths, sizes, contents = [], [], []
        for batch in batches:
            for root, at, size in zip(*batch.to_pydict().values(), strict=True):
                if paths and (len(paths) == ROWS or sum(sizes) + size > BATCH_BYTES):
                    yield rows(paths, sizes, contents)
                    paths, sizes, contents = [], [], []
                fs, base = opened[root] = opened.get(root) or _opened(uris[root])
                with fs.open_input_stream(f"{base}{at}", compression=None) as file:
                    contents.append(file.read())
                paths.append(f"{shown[root]}{at}")
                sizes.append(size)
        if paths:
            yield rows(paths, sizes, contents)

    return run


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, length, content) of each file that isn't empty, as ``binaryFile`` has them, but listed and read by tasks: Spark's reader keeps an
    entry for each file on the driver, here it holds only what ``path`` itself names. Spark's reader does what Arrow doesn't open."""
    jvm, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    at = jvm.Path(path)
    named = {x.getPath().toString(): x for x in at.getFileSystem(conf).globStatus(at) or ()}
    tops, start = {}, []
    for x in named.values():
        folder, name = x.isDirectory(), x.getPath().getName()
        top = x.getPath() if folder else x.getPath().getParent()
        root = tops.setdefault((top.toUri().toString(), top.toString().rstrip("/")), len(tops))
        if folder or not _hidden(name):
            start.append((root, "" if folder else f"/{name}", None if folder else x.getLen()))
    nested = any(str(up) in named for x in named for up in PurePosixPath(x).parents)
    if not named or nested or not all(_opened(uri) for uri, _ in tops):  # it also says what is missing
        return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")
    uris, shown = map(list, zip(*tops, strict=True))
    files = spark.createDataFrame(start, LISTED)
    for _ in range(LEVELS):
        files = over(files, _listing(uris, False), LISTED).repartition(2 * spark.sparkContext.defaultParallelism, "root", "at")
    fits = F.regexp_extract("at", "([^/]*)$", 1).rlike(rf"(?s)\A(?:{jvm.GlobPattern(pattern).compiled().pattern()})\z")
    files = over(files, _listing(uris, True), LISTED).where(F.col("size") > 0).where(fits)
    dealt = files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "root", "at")
    return over(dealt, _contents(uris, shown), "path string, length long, content binary")


def read_corpus(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row for each file below ``path``: name, size, bytes and the text they hold as UTF-8."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return _files(spark, path, pattern).select("path", name.alias("name"), F.col("length").alias("size_bytes"), "content", F.decode("content", "UTF-8").alias("text"))


FOLDERS = 256


def write_corpus(files: DataFrame, path: str) -> None:
    """Files (name, content) below ``path``, each written whole before it gets its name, so that a repeated task writes the same files. They are
    dealt out to ``FOLDERS`` folders by name, which tasks list; names must differ. Folders must be such as Arrow opens by their URI."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(path)
        made = set()
        for batch in batches:
            for folder, name, content in zip(*batch.to_pydict().values(), strict=True):
                at = f"{root}/{folder}"
                if folder not in made:
                    fs.create_dir(at, recursive=True)
                    made.add(folder)
                draft = f"{at}/{name}.{uuid.uuid4().hex}.draft"
                with fs.open_output_stream(draft, buffer_size=0) as out:
                    out.write(content.encode())
                fs.move(draft, f"{at}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    folder = F.pmod(F.xxhash64("name"), F.lit(FOLDERS)).alias("folder")
    over(files.select(folder, "name", "content"), run, "n long").agg(F.sum("n")).collect()


def scan_index(index: DataFrame, *fields: str) -> DataFrame:
    return index.select(*fields) if fields else index


def _lookup(values: dict[str, str], key: Column) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    return F.try_element_at(pairs, key)


def classify_format(mime: Column, name: Column) -> Column:
    """By MIME type, else by extension, else text; without regard to case."""
    extension = F.regexp_extract(F.lower(F.coalesce(name, F.lit(""))), r"[^/.](\.[^./]*)$", 1)
    return F.coalesce(_lookup(MIME, F.lower(mime)), _lookup(EXTENSION, extension), F.lit("text"))


def parse_markdown(docs: DataFrame) -> DataFrame:
    """Blocks of (file_id, text): each line that starts with # is a title, runs of other lines are a body; a text without blocks is one."""
    line = docs.select("file_id", F.posexplode(F.split("text", LINE_END)).alias("n", "line"))
    trimmed = strip(F.col("line"))
    marked = line.select("file_id", "n", "line", trimmed.alias("s"), trimmed.startswith("#").alias("title"))
    order = Window.partitionBy("file_id").orderBy("n")
    named = F.when(F.col("title"), F.nullif(strip(F.regexp_replace("s", "^#+", "")), F.lit("")))
    # A title line is a segment of its own; what follows it up to the next title is another.
    segment = 2 * F.sum(F.col("title").cast("int")).over(order) - F.col("title").cast("int")
    lines = marked.select("file_id", "n", "line", "s", "title", F.last(named, True).over(order).alias("section_path"), segment.alias("segment"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "line"))), lambda x: x.line), "\n")
    blocks = lines.groupBy("file_id", "segment").agg(
        F.first("title").alias("title"), F.min_by("section_path", "n").alias("section_path"), F.first("s").alias("s"), strip(body).alias("body"), F.min("n").alias("n")
    )
    text = F.when(F.col("title"), F.col("s")).otherwise(F.col("body"))
    kept = blocks.select(
        "file_id",
        F.when(F.col("title"), "title").otherwise("text").alias("block_type"),
        F.when(F.col("title"), F.length(F.regexp_extract("s", "^#+", 0))).alias("level"),
        "section_path",
        text.alias("text"),
        "n",
        (text != "").alias("full"),
    )
    # A file without any full block keeps a single empty one.
    first = F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("full"), "n"))
    ranked = kept.withColumn("first", first).where(F.col("full") | (F.col("first") == 1))
    return ranked.select(
        "file_id", (F.row_number().over(Window.partitionBy("file_id").orderBy("n")) - 1).alias("pos"), "block_type", "level", "section_path", "text", F.lit(1).alias("page")
    )


class _Blocks(HTMLParser):
    """Collects the text of headings, paragraphs, list items and tables in the order in which they start; nested ones each."""

    KINDS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "table")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[dict] = []
        self.hidden = 0
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in self.KINDS:
            if tag != "table":  # these end an open paragraph, and an item the item before it, within the same list or cell
                self._close_within(("p", "li") if tag == "li" else ("p",))
            block = {"tag": tag, "words": [], "rows": []}
            self.found.append(block)
            self.open.append(block)
        elif tag in ("ul", "ol"):
            self._close_within(("p",))
            self.open.append({"tag": tag, "words": []})  # holds no text of its own: items outside it stay open
        elif tag == "tr":
            for b in self._tables():
                b["rows"].append([])
        elif tag in ("td", "th"):
            self.cell = []
            for b in self._tables():
                b["rows"] = b["rows"] or [[]]
                b["rows"][-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag in ("td", "th"):
            self.cell = None
        elif tag in (*self.KINDS, "ul", "ol"):
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i]["tag"] == tag:
                    del self.open[i:]  # and what is still open in it
                    break

    def handle_data(self, data):
        if self.hidden or not data.strip():
            return
        for b in self.open:
            b["words"].append(data.strip())
        if self.cell is not None:
            self.cell.append(data.strip())

    def _close_within(self, tags):
        """Close open blocks of these kinds and what they hold, back to the list or table around them."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i]["tag"] in ("ul", "ol", "table"):
                break
            if self.open[i]["tag"] in tags:
                del self.open[i:]

    def _tables(self):
        return [b for b in self.open if b["tag"] == "table"]


def _html_blocks(html: str) -> list[dict]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    stack: list[str] = []
    out = []
    for b in parser.found:
        if b["tag"] == "table":
            rows = ["\t".join(" ".join(c) for c in row) for row in b["rows"] if any(row)]
            for a in range(0, len(rows), TABLE_ROWS):
                out.append({"block_type": "table", "level": None, "section_path": " / ".join(stack) or None, "text": "\n".join(rows[a : a + TABLE_ROWS])})
        elif text := " ".join(b["words"]):
            level = int(b["tag"][1]) if b["tag"][0] == "h" else None
            if level:
                stack = [*stack[: level - 1], text]
            out.append({"block_type": "title" if level else "text", "level": level, "section_path": " / ".join(stack) or None, "text": text})
    return [b | {"pos": k} for k, b in enumerate(out)]


def parse_html(pages: DataFrame, id_column: str = "page_id") -> DataFrame:
    """Blocks of each page's ``html``; headings keep a stack of the sections around them. One pass, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [b | {"file_id": i} for i, html in zip(batch[id_column], batch.html, strict=True) for b in _html_blocks(html)]
            yield pd.DataFrame(rows, columns=["file_id", "pos", "block_type", "level", "section_path", "text"]).astype({"level": "Int32"})

    return pages.select(id_column, "html").mapInPandas(run, "file_id long, pos int, block_type string, level int, section_path string, text string")


def batch_table_rows(cells: DataFrame, rows_per_block: int = TABLE_ROWS) -> DataFrame:
    """Table blocks of (file_id, row, cells): ``rows_per_block`` rows each, cells joined by tabs."""
    line = F.struct("row", F.array_join("cells", "\t").alias("line"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x.line), "\n")
    blocks = cells.groupBy("file_id", F.floor(F.col("row") / rows_per_block).alias("pos")).agg(text.alias("text"))
    return blocks.where(strip(F.col("text")) != "").select("file_id", "pos", F.lit("table").alias("block_type"), "text")


def split_blocks(blocks: DataFrame, delimiters: str) -> DataFrame:
    """Cut prose blocks at any of the delimiter characters; tables and figures stay whole, empty pieces go."""
    if not delimiters:
        return blocks
    pattern = "[" + "".join("\\" + c if c in r"\]^-[&" else c for c in delimiters) + "]"
    pieces = F.when(F.col("block_type").isin("table", "figure"), F.array("text")).otherwise(F.split("text", pattern))
    cut = blocks.select(*(c for c in blocks.columns if c not in ("text", "pos")), F.col("pos").alias("block"), F.posexplode(pieces).alias("piece", "raw"))
    text = F.when(F.col("block_type").isin("table", "figure"), F.col("raw")).otherwise(strip(F.col("raw")))
    order = Window.partitionBy("file_id").orderBy("block", "piece")
    return cut.withColumn("text", text).where(strip(F.col("text")) != "").withColumn("pos", F.row_number().over(order) - 1).drop("block", "piece", "raw")
