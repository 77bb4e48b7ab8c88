"""JSON documents of any size: one document written by many tasks, read by many tasks.

**Writing.** Tasks write their rows as lines through Spark's own commit; a line after the
first of a task begins with a comma. The driver then adds a header, a comma between parts and
a footer as small files, and publishes the folder by a rename: the files in the order of
their names are one document. Nothing but names goes through the driver.

**Reading.** A file is read as text that ends at closing braces, so Spark splits it anywhere.
Where a split begins is unknown, but what it does is not: a first pass finds, for a beginning
inside and outside of a string, how far each split moves the depth and which sections it
opens. Sums over the splits, one short row each, give the true beginnings, and a second pass
cuts the objects out. An object that reaches over splits is put together from its pieces;
what is left around the objects, header and footer, must be valid JSON by itself, with one
or two zeros in place of the objects of a split.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names of the folders that hold a document in parts; hidden until it is whole.
DOCUMENT, STAGING = "document-", "_document-"
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|["{}\[\]]', re.S)
_REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
#: Escaped signs; outside of strings there are none, so quotes count alike wherever a text begins.
_QUOTE = re.compile(r"\\.", re.S)
ITEM, HEAD, MORE, AROUND, END = range(5)
_SUMMARY = "document string, file string, block long, file_size long, n long, bytes long, blank boolean, quotes int, outside struct<depth: int, closed: int, sections: map<int, string>>, inside struct<depth: int, closed: int, sections: map<int, string>>"
_PIECES = "document string, file string, block long, seq long, kind int, text string"


# Writing


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _put(spark: SparkSession, path: str, text: str) -> None:
    system, at = _files(spark, path)
    out = system.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_document(rows: DataFrame, path: str, header: Callable[[int], str], footer: str, mode: str = "overwrite", pretty: bool = True) -> None:
    """One document: ``header(number of rows)``, the rows' one text column between commas, ``footer``.

    With ``append`` it stands beside earlier documents of the folder, with ``overwrite`` these
    go once it is there. A writer that fails leaves what was there as it was.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unknown mode {mode!r}")
    rows = rows.toDF("value")
    spark, name = rows.sparkSession, uuid.uuid4().hex
    system, home = _files(spark, path)
    is_file = system.exists(home) and system.getFileStatus(home).isFile()
    if is_file and mode == "append":
        raise ValueError(f"{path} is a file; documents can be added to folders only")
    staging = f"{path}.{STAGING}{name}" if is_file else f"{path}/{STAGING}{name}"
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    written = F.count("*").alias("n")
    seen = _Seen(rows.select(F.concat(F.when(first, "").otherwise(","), "value").alias("value")), written)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    try:
        seen.rows.write.option("lineSep", "\n" if pretty else " ").text(staging)
        parts = {s.getPath().getName(): s.getLen() for s in system.listStatus(hadoop(staging)) if s.getPath().getName().startswith("part-")}
        # part-(task)-...-c(file of the task): only a task's first file begins without a comma.
        place = lambda part: tuple(map(int, re.match(r"part-(\d+)-.*-c(\d+)", part).groups()))
        for n, part in enumerate(sorted((part for part, length in parts.items() if length), key=place)):
            if n and place(part)[1] == 0:
                _put(spark, f"{staging}/{n:08d}-a", ",")
            if not system.rename(hadoop(f"{staging}/{part}"), hadoop(f"{staging}/{n:08d}-b")):
                raise OSError(f"could not rename {staging}/{part}")
        _put(spark, f"{staging}/!", header(seen.count()))
        _put(spark, f"{staging}/~", footer)
        for part in ("_SUCCESS", *(part for part, length in parts.items() if not length)):
            system.delete(hadoop(f"{staging}/{part}"), False)
        if is_file:
            system.delete(home, False)
            system.mkdirs(home)
        earlier = [s.getPath() for s in system.listStatus(home)] if mode == "overwrite" else []
        if not system.rename(hadoop(staging), hadoop(f"{path}/{DOCUMENT}{name}")):
            raise OSError(f"could not publish {path}/{DOCUMENT}{name}")
    except BaseException:
        system.delete(hadoop(staging), True)
        raise
    for old in earlier:
        if old.getName() != f"{STAGING}{name}":
            system.delete(old, True)


class _Seen:
    """Rows that are counted as they are written."""

    def __init__(self, rows: DataFrame, n):
        from pyspark.sql import Observation

        self.observed = Observation()
        self.rows = rows.observe(self.observed, n)

    def count(self) -> int:
        return self.observed.get["n"]


def merge_document(spark: SparkSession, path: str, target: str) -> None:
    """Copy the one document of a folder into one file, part by part, for readers that need a file.

    This streams through the driver in small pieces; a file has one writer by nature.
    """
    system, home = _files(spark, path)
    jvm = spark.sparkContext._jvm
    found = [s.getPath() for s in system.listStatus(home) if s.getPath().getName().startswith(DOCUMENT)]
    if len(found) != 1:
        raise ValueError(f"{path} holds {len(found)} documents")
    to, at = _files(spark, target)
    out = to.create(at, True)
    try:
        for part in sorted((s.getPath() for s in system.listStatus(found[0])), key=lambda p: p.getName()):
            stream = system.open(part)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            finally:
                stream.close()
    finally:
        out.close()


# Reading


class Scanner:
    """Follows strings, depth and sections (key and kind of what is open at depth 2) over fragments."""

    def __init__(self, in_string: bool = False, depth: int = 0):
        self.in_string, self.depth, self.last = in_string, depth, None
        self.sections: dict[int, str] = {}

    def tokens(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(begin, end, bracket) of the brackets outside strings; the depth is as before an opening and after a closing one."""
        at = 0
        if self.in_string:
            rest = _REST_OF_STRING.match(text)
            if not rest:
                return
            at, self.in_string, self.last = rest.end(), False, None
        for m in _TOKEN.finditer(text, at):
            found = m[0]
            if found[0] == '"':
                if len(found) == 1:
                    self.in_string = True
                    return
                self.last = found
            elif found in "{[":
                self.sections[self.depth] = f"{self.last}{found}"
                yield m.start(), m.end(), found
                self.depth += 1
            else:
                self.depth -= 1
                yield m.start(), m.end(), found

    def run(self, text: str) -> int:
        """Follow a fragment and its closing brace; how much that brace alone moved the depth."""
        for _ in self.tokens(text):
            pass
        if self.in_string:
            return 0
        self.depth -= 1
        return -1


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """(document, file, block, file_size, bytes, value) of the text between closing braces."""
    read = spark.read.option("lineSep", "}").option("recursiveFileLookup", True).text(path)
    file = F.col("_metadata.file_path")
    folder = F.regexp_extract(file, f"^(.*/{DOCUMENT}[0-9a-f]+)/[^/]*$", 1)
    begin, size = F.col("_metadata.file_block_start"), F.col("_metadata.file_size")
    return read.select(F.coalesce(F.nullif(folder, F.lit("")), file).alias("document"), file.alias("file"), begin.alias("block"), size.alias("file_size"), F.octet_length("value").cast("long").alias("bytes"), F.col("value").cast("binary").alias("value"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[str]]]:
    """Each split's columns but the text, and its fragments; the latter are to be used up before the next one."""
    rows = ((dict(zip(batch.schema.names[:-1], cells[:-1])), cells[-1]) for batch in batches for cells in zip(*(c.to_pylist() for c in batch.columns)))
    held = next(rows, None)
    while held is not None:
        first = held[0]

        def own() -> Iterator[tuple[int, str]]:
            nonlocal held
            while held is not None and (held[0]["file"], held[0]["block"]) == (first["file"], first["block"]):
                now, held = held, next(rows, None)
                yield now[0]["bytes"], now[1].decode("utf-8", "replace")

        yield first, own()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for first, fragments in _blocks(batches):
        # Depths are counted from the split's beginning; only sections at or below the next depth can matter.
        ways = [Scanner(False), Scanner(True)]
        n = size = quotes = 0
        blank = False
        closed = [0, 0]
        for length, text in fragments:
            blank = not text.strip()
            n, size, quotes = n + 1, size + length, quotes + _QUOTE.sub("", text).count('"')
            closed = [way.run(text) for way in ways]
            for way in ways:
                if len(way.sections) > 64:
                    way.sections = {d: s for d, s in way.sections.items() if d <= 1}
        sides = [[{"depth": way.depth, "closed": c, "sections": [(d, s) for d, s in way.sections.items() if d <= 1]}] for way, c in zip(ways, closed)]
        kind = pa.struct([("depth", pa.int32()), ("closed", pa.int32()), ("sections", pa.map_(pa.int32(), pa.string()))])
        yield pa.RecordBatch.from_arrays(
            [pa.array([first["document"]]), pa.array([first["file"]]), pa.array([first["block"]], pa.int64()), pa.array([first["file_size"]], pa.int64()), pa.array([n], pa.int64()), pa.array([size], pa.int64()), pa.array([blank]), pa.array([quotes % 2], pa.int32()), *[pa.array(side, kind) for side in sides]],
            [part.split()[0] for part in ("document", "file", "block", "file_size", "n", "bytes", "blank", "quotes", "outside", "inside")],
        )


def _beginnings(fragments: DataFrame) -> DataFrame:
    """(file, block, in_string, depth, section, open_end) of each split; open_end: its last fragment has no closing brace."""
    found = fragments.mapInArrow(_summaries, _SUMMARY)
    order = Window.partitionBy("document").orderBy("file", "block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    of_file = Window.partitionBy("file")
    # The last split with a fragment: those behind it are filled by the fragment that begins there.
    at_end = F.lead("block").over(of_file.orderBy("block")).isNull()
    # Fragments and braces make up the file, or one brace too many; not so if it is compressed.
    total = F.sum(F.col("bytes") + F.col("n")).over(of_file)
    open_end = at_end & F.when(total.isin(F.col("file_size"), F.col("file_size") + 1), total > F.col("file_size")).otherwise(F.col("blank"))
    known = found.withColumn("open_end", open_end).withColumn("in_string", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    way = F.when(F.col("in_string"), F.col("inside")).otherwise(F.col("outside"))
    moved = known.withColumn("way", way).withColumn("moved", F.col("way.depth") - F.when(F.col("open_end"), F.col("way.closed")).otherwise(0))
    deep = moved.withColumn("depth", F.coalesce(F.sum("moved").over(before), F.lit(0)).cast("int"))
    opened = F.try_element_at("way.sections", 1 - F.col("depth"))
    return deep.withColumn("section", F.last(opened, ignorenulls=True).over(before)).withColumn("last", F.row_number().over(Window.partitionBy("document").orderBy(F.desc("file"), F.desc("block"))) == 1).select(F.col("file").alias("__file"), F.col("block").alias("__block"), "in_string", "depth", "section", "open_end", "last")


def _cutter(key: str) -> Callable:
    wanted = f'"{key}"['

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, fragments in _blocks(batches):
            rows: list[tuple[int, str]] = []
            scanner = Scanner(first["in_string"], first["depth"])
            section = first["section"]
            run = 0  # objects of the array so far, side by side in this split
            item: list[str] | None = [] if scanner.depth > 2 and section == wanted else None
            began_before, around, seq = item is not None, [], 0
            held = next(fragments, None)
            while held is not None:
                text, held = held[1], next(fragments, None)
                text += "" if held is None and first["open_end"] else "}"
                at = 0
                for begin, end, bracket in scanner.tokens(text):
                    if bracket in "{[":
                        if scanner.depth == 1:
                            section, run = scanner.sections[1], 0
                        elif scanner.depth == 2 and section == wanted and bracket == "{" and item is None:
                            gap = text[at:begin]
                            if not run:
                                around.append(gap + "0")
                            elif gap.strip() != ",":
                                around.append(gap + "!")  # no valid JSON
                            elif run == 1:
                                around.append(",0")
                            item, at, run = [], begin, run + 1
                    elif scanner.depth == 2 and item is not None:
                        item.append(text[at:end])
                        rows.append((MORE if began_before else ITEM, "".join(item)))
                        item, began_before, at, run = None, False, end, max(run, 1)
                    elif scanner.depth == 1:
                        section = None
                (around if item is None else item).append(text[at:])
                if len(rows) >= 1000:
                    yield batch_of(first, rows, seq)
                    seq, rows = seq + len(rows), []
            if item is not None:
                rows.append((MORE if began_before else HEAD, "".join(item)))
            rows.append((AROUND, "".join(around)))
            if first["last"]:
                rows.append((END, "" if scanner.depth == 0 and not scanner.in_string else "!"))
            yield batch_of(first, rows, seq)

    def batch_of(first: dict, rows: list[tuple[int, str]], seq: int) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([first["document"]] * n), pa.array([first["file"]] * n), pa.array([first["block"]] * n, pa.int64()), pa.array(range(seq, seq + n), pa.int64()), pa.array([k for k, _ in rows], pa.int32()), pa.array([t for _, t in rows], pa.string())], ["document", "file", "block", "seq", "kind", "text"])

    return cut


def pieces(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(document, file, block, seq, kind, text) of all documents under a path.

    Splits' beginnings are broadcast: one short row for each split of the input (128 MB by
    default), about 10 MB for 10 TB; a join by exchange would tear the fragments' order.
    """
    fragments = _fragments(spark, path)
    starts = F.broadcast(_beginnings(fragments))
    on = (F.col("file") == F.col("__file")) & (F.col("block") == F.col("__block"))
    return fragments.join(starts, on).select("document", "file", "block", "bytes", "in_string", "depth", "section", "open_end", "last", "value").mapInArrow(_cutter(key), _PIECES)


def _joined(parts: DataFrame, *keys: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("file", "block", "seq", "text")))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("text"))


def items(found: DataFrame) -> DataFrame:
    """(document, text) of the objects in the array; such that reach over splits are put together."""
    heads = Window.partitionBy("document").orderBy("file", "block", "seq")
    torn = found.where(F.col("kind").isin(HEAD, MORE)).withColumn("n", F.sum((F.col("kind") == HEAD).cast("int")).over(heads))
    return found.where(F.col("kind") == ITEM).select("document", "text").union(_joined(torn, "document", "n").select("document", "text"))


def surroundings(found: DataFrame) -> DataFrame:
    """(document, text): each document with zeros for the objects of the array; not valid JSON if it is damaged anywhere outside of them."""
    return _joined(found.where(F.col("kind").isin(AROUND, END)), "document")


def damaged(found: DataFrame) -> DataFrame:
    """(document) of those that are no valid JSON, whether in an object or around the objects."""
    # The parser stops after a value: set between brackets, whatever follows one is an error.
    wrapped = [F.try_parse_json(F.concat(F.lit(a), "text", F.lit(b))) for a, b in (("[", "]"), ('{"d":', "}"))]
    return surroundings(found).union(items(found)).where(wrapped[0].isNull() | wrapped[1].isNull()).select("document").distinct()
