"""Analyzer exports as a Spark data source: spark.read.format("brindle_export"), and readStream.

One input partition is one file, or a slice of a large one, or several small ones where there
are many, so that tasks stay worth their start; rows are numbered within their
file. What a file holds is found per file: its delimiter, its header, and the kind
of its rows. Delimited files are read line by line. JSON files are read whole and
give a row for each element, which is text still; what it means is worked out by
column expressions in `exports`.
"""

from __future__ import annotations

import csv
import fnmatch
import io
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from brindle.functions.vocab import DOT_EDGE, GRAPH_COLUMNS, METRIC_COLUMNS, SMELL_COLUMNS
from brindle.sources.slicing import Rows, Slice, of_option

FORMAT = "brindle_export"
SCHEMA = "kind string, source_file string, row_no long, fields map<string,string>, by_key map<string,string>, record string"
_TYPES = {"kind": pa.string(), "source_file": pa.string(), "row_no": pa.int64(), "fields": pa.map_(pa.string(), pa.string()), "by_key": pa.map_(pa.string(), pa.string()), "record": pa.string()}
#: Characters of a file by which its delimiter is found, and rows that go to Spark at once.
SNIFFED, BATCH_ROWS = 4096, 5000
#: Tasks that have a file or slice each, at most; beyond that several go to one, up to so many bytes, of which each costs some more for its opening.
ALONE, TASK_BYTES, OPENING = 500, 8 << 20, 64 << 10


def header_key(name: str) -> str:
    return name.lower().replace(" ", "").replace("_", "").replace("-", "")


def suffix_of(path: str) -> str:
    return path.rsplit(".", 1)[-1].lower()


def sniff_delimiter(head: str) -> str:
    """The delimiter that the lines of a file's beginning agree on; a comma where they don't."""
    try:
        return csv.Sniffer().sniff(head[:SNIFFED], delimiters=",;\t").delimiter
    except csv.Error:
        return ","


def file_system(path: str):
    """The store of a path or URI, and the path in it."""
    from pyarrow import fs

    path = re.sub(r"^file:/+", "/", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed_files(path: str) -> list[tuple[int, str, int]]:
    """(modified, path, bytes) of the file, of the files in the folder, or of those that the pattern fits; hidden ones left out. In order of path."""
    from pyarrow import fs

    wild = re.search(r"[*?\[]", path)
    base = path[: path.rindex("/", 0, wild.start())] if wild else path
    scheme = re.match(r"^(?!file:)[a-z0-9]+://[^/]*", path)
    store, inner = file_system(base)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.File:
        found = [info]
    elif info.type == fs.FileType.Directory:
        depth = path[len(base) :].count("/") if wild else 1
        found = store.get_file_info(fs.FileSelector(inner, recursive=depth > 1))
    else:
        found = []
    pattern = inner + path[len(base) :] if wild else None
    out = []
    for x in found:
        # as in a shell, a star doesn't reach over a slash
        fits = pattern is None or (x.path.count("/") == pattern.count("/") and all(fnmatch.fnmatchcase(a, b) for a, b in zip(x.path.split("/"), pattern.split("/"), strict=True)))
        if x.type == fs.FileType.File and fits and x.base_name[0] not in "._":
            out.append((x.mtime_ns or 0, (scheme[0] + "/" + x.path.split("/", 1)[-1] if scheme and not x.path.startswith("/") else (scheme[0] if scheme else "") + x.path), x.size or 0))
    return sorted(out, key=lambda x: x[1])


def read_text(path: str) -> str:
    store, inner = file_system(path)
    with store.open_input_stream(inner) as stream:
        return stream.read().decode("utf-8-sig", errors="replace")


def read_head(path: str) -> str:
    """A file's first `SNIFFED` characters."""
    store, inner = file_system(path)
    with store.open_input_stream(inner) as stream, io.TextIOWrapper(stream, "utf-8-sig", errors="replace", newline="") as text:
        return text.read(SNIFFED)


def kind_of(first: dict[str, str], tool_kind: str) -> str:
    """What the rows of a delimited file are, from its first row: metrics, edges, else smells."""
    if tool_kind != "any":
        return tool_kind
    given = lambda names: any(first.get(header_key(n)) for n in names)
    if not given(SMELL_COLUMNS["type"]) and given(SMELL_COLUMNS["metric_component"]) and given(METRIC_COLUMNS):
        return "metric"
    return "edge" if given(SMELL_COLUMNS["edge_from"]) and given(SMELL_COLUMNS["edge_to"]) else "smell"


def delimited_rows(part: Slice, tool_kind: str, wanted: str | None) -> Iterator[tuple]:
    """(kind, row_no, fields, by_key, None) of a slice of a delimited file; nothing if the file's rows aren't of the wanted kind. Short rows have empty fields, empty lines are passed over."""
    delimiter = sniff_delimiter(read_head(part.path))
    head = iter(Rows(part.path, delimiter))
    names = [n.strip() for n in next(head, [])]
    keys = {n: header_key(n) for n in names}

    def read(line: list[str]) -> tuple[dict[str, str], dict[str, str]]:
        values = [v.strip() for v in line[: len(names)]] + [""] * (len(names) - len(line))
        fields = {k: v for k, v in zip(names, values, strict=True) if v}
        by_key: dict[str, str] = {}
        for k, v in fields.items():
            by_key.setdefault(keys[k], v)
        return fields, by_key

    first = next((line for line in head if line), None)
    kind = kind_of(read(first)[1], tool_kind) if first else None
    head.close()
    if first is None or wanted not in (None, kind):
        return
    lines = iter(Rows(part.path, delimiter, part.start, part.stop, part.within))
    if part.start == 0 or part.within:  # the header, or a row that began before
        next(lines, None)
    n = part.rows
    for line in lines:
        if line:
            n += 1
            yield kind, n, *read(line), None


def json_rows(text: str, graph: bool) -> Iterator[tuple]:
    """A row for each element of a JSON export: smells in a list or under "smells", edges under "edges", and of a graph also an adjacency map."""
    data = json.loads(text)
    row = lambda kind, n, record: (kind, n, None, None, json.dumps(record, ensure_ascii=False))
    many = lambda x: x if isinstance(x, list) else []
    if graph and isinstance(data, dict) and "edges" not in data:
        pairs = ((a, b) for a, targets in data.items() for b in (targets if isinstance(targets, list) else [targets]))
        for n, (a, b) in enumerate(pairs, 1):
            yield row("edge", n, {"from": a, "to": b})
        return
    if not graph:
        for n, x in enumerate(data if isinstance(data, list) else many(data.get("smells")) if isinstance(data, dict) else [], 1):
            yield row("smell", n, x)
    for n, x in enumerate(many(data.get("edges")) if isinstance(data, dict) else [], 1):
        yield row("edge", n, x)


def dot_rows(text: str) -> Iterator[tuple]:
    for n, (a, b) in enumerate(re.findall(DOT_EDGE, text), 1):
        yield "edge", n, None, None, json.dumps({"from": a, "to": b}, ensure_ascii=False)


def is_delimited(path: str, form: str | None) -> bool:
    return (form or suffix_of(path)) not in ("json", "dot", "gv")


def file_rows(part: Slice, form: str | None, tool_kind: str, graph: bool, wanted: str | None) -> Iterator[tuple]:
    if is_delimited(part.path, form):
        found = delimited_rows(part, tool_kind, wanted)
    else:
        text = read_text(part.path)
        found = json_rows(text, graph) if (form or suffix_of(part.path)) == "json" else dot_rows(text)
    name = part.path.rsplit("/", 1)[-1]
    return ((kind, name, n, fields, by_key, record) for kind, n, fields, by_key, record in found if wanted in (None, kind))


def batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    waiting: list[tuple] = []

    def packed() -> pa.RecordBatch:
        columns = list(zip(*waiting, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([list(v.items()) if isinstance(v, dict) else v for v in c], t) for c, t in zip(columns, _TYPES.values(), strict=True)], names=list(_TYPES))

    for row in rows:
        waiting.append(row)
        if len(waiting) == BATCH_ROWS:
            yield packed()
            waiting.clear()
    if waiting:
        yield packed()


def packed(things: list[tuple[object, int]]) -> list[list]:
    """Things (thing, bytes) in lists that a task reads each, in order: alone where they are few, else up to `TASK_BYTES` together."""
    if len(things) <= ALONE:
        return [[x] for x, _ in things]
    out, size = [], TASK_BYTES
    for x, n in things:
        if size + n + OPENING > TASK_BYTES:
            out.append([])
            size = 0
        out[-1].append(x)
        size += n + OPENING
    return out


@dataclass
class Parts(InputPartition):
    slices: tuple[Slice, ...]


class _Reading:
    """Options: path; form (csv, json or dot; else by each file's suffix), tool_kind (any, or what all delimited rows are), graph (whether JSON may be an adjacency map), kind (the rows wanted), filesPerPartition (else as `packed` deals them), slices (of large files, as `slicing` cuts them)."""

    def __init__(self, options):
        self.path = options["path"]
        self.form, self.tool_kind, self.wanted = options.get("form") or None, options.get("tool_kind", "any"), options.get("kind") or None
        self.graph, self.per = options.get("graph", "false").lower() == "true", max(0, int(options.get("filesPerPartition", "0")))
        self.slices = of_option(options.get("slices"))

    def dealt(self, files: list[tuple[str, int]]) -> list[Parts]:
        """Files (path, bytes) as partitions."""
        cut = {path: list(own) for path, own in groupby(self.slices, key=lambda x: x.path)}
        whole = [(Slice(p, 0, None), n) for p, n in files if p not in cut]
        if self.per:
            parts = [Parts(tuple(s for s, _ in whole[k : k + self.per])) for k in range(0, len(whole), self.per)]
        else:
            parts = [Parts(tuple(x)) for x in packed(whole)]
        return parts + [Parts(tuple(x)) for x in packed([(x, x.stop - x.start) for p, _ in files for x in cut.get(p, ())])]

    def read(self, partition: Parts) -> Iterator[pa.RecordBatch]:
        for part in partition.slices:
            yield from batches(file_rows(part, self.form, self.tool_kind, self.graph, self.wanted))


class ExportReader(_Reading, DataSourceReader):
    def partitions(self):
        found = [(p, n) for _, p, n in listed_files(self.path)]
        if not found:
            raise FileNotFoundError(self.path)
        return self.dealt(found)


class ExportStream(_Reading, DataSourceStreamReader):
    """Files in the order in which they were last written; an offset is the last file read. A file that arrives with an older time than that isn't seen, as it is for a file that changes: move finished files in."""

    def initialOffset(self) -> dict:
        return {"modified": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(listed_files(self.path), default=(-1, "", 0))
        return {"modified": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict):
        first, last = (start["modified"], start["path"]), (end["modified"], end["path"])
        return self.dealt([(p, n) for m, p, n in sorted(listed_files(self.path)) if first < (m, p) <= last])


class ExportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return ExportReader(self.options)

    def streamReader(self, schema):
        return ExportStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(ExportSource)
