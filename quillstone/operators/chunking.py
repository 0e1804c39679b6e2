"""Structure-aware chunking of Markdown."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from ..ship import ship

SCHEMA = "chunk_id string, source string, ordinal int, heading_path string, headings array<string>, page int, text string, token_count int"

_TYPES = {"chunk_id": pa.string(), "source": pa.string(), "ordinal": pa.int32(), "heading_path": pa.string(), "headings": pa.list_(pa.string()), "page": pa.int32(), "text": pa.string(), "token_count": pa.int32()}
#: Characters of chunks that a task holds before it hands them on.
HELD = 1 << 20

# What opens a heading, a page, a fence and display math.
_HEADING = re.compile(r"^(#{1,6})\s+(.*\S)\s*$")
_PAGE = re.compile(r"^\s*<!--\s*page:\s*(\d+)\s*-->\s*$", re.IGNORECASE)
_FENCE = re.compile(r"^\s*(```|~~~)")
_MATH = re.compile(r"\\begin\{(equation\*?|align\*?|gather\*?|multline\*?|eqnarray\*?|cases|array|matrix|bmatrix|pmatrix)\}")

_CHUNK = [
    StructField("ordinal", IntegerType()), StructField("heading_path", StringType()), StructField("headings", ArrayType(StringType())),
    StructField("page", IntegerType()), StructField("text", StringType()), StructField("token_count", IntegerType()),
]


class Block(NamedTuple):
    kind: str
    text: str
    page: int | None
    level: int = 0


def tokens(text: str) -> int:
    return max(1, round(len(text) / 4))


def _closer(line: str) -> tuple[str, Callable[[str], bool] | None] | None:
    """The kind of protected block that a line opens and the test for its last line; None as test: it ends where it began."""
    if fence := _FENCE.match(line):
        return "code", lambda x, mark=fence[1]: x.lstrip().startswith(mark)
    bare = line.strip()
    if bare.startswith("$$"):
        return "math", None if bare.count("$$") > 1 else lambda x: "$$" in x
    if bare.startswith("\\["):
        return "math", lambda x: "\\]" in x
    if env := _MATH.search(line):
        return "math", lambda x, end=f"\\end{{{env[1]}}}": end in x
    return None


def blocks(text: str) -> Iterator[Block]:
    """Headings, protected blocks, and everything between two of those as one text block.  An unclosed block goes on to the end."""
    page: int | None = None
    kind, held, done = "text", [], None

    def end() -> Iterator[Block]:
        if kind != "text":
            yield Block(kind, "\n".join(held), page)
        elif any(x.strip() for x in held):
            yield Block("text", "\n".join(held).strip("\n"), page)

    for line in text.splitlines():
        if kind != "text":
            held.append(line)
            if done(line):
                yield from end()
                kind, held = "text", []
            continue
        marker, heading = _PAGE.match(line), _HEADING.match(line)
        opened = None if marker or heading else _closer(line)
        if not (marker or heading or opened):
            held.append(line)
            continue
        yield from end()
        held = []
        if marker:
            page = int(marker[1])
        elif heading:
            yield Block("heading", line.strip(), page, len(heading[1]))
        elif opened[1] is None:
            yield Block(opened[0], line, page)
        else:
            (kind, done), held = opened, [line]
    yield from end()


def _tail(done: list[Block], budget: int) -> list[Block]:
    """What the next chunk repeats: blocks from the end up to ``budget`` tokens, the last at least, none that is protected."""
    keep: list[Block] = []
    used = 0
    for b in reversed(done):
        size = tokens(b.text)
        if b.kind in ("code", "math") or keep and (used >= budget or used + size > budget):
            break
        keep.append(b)
        used += size
    return keep[::-1]


def chunks(text: str, target: int = 650, overlap: float = 0.1) -> Iterator[tuple]:
    """(ordinal, heading_path, headings, page, text, token_count) of each chunk; a block is never split."""
    stack: list[str] = []
    held: list[Block] = []
    n = 0

    def emit() -> Iterator[tuple]:
        whole = "\n\n".join(b.text for b in held).strip()
        if whole:
            yield n, " > ".join(stack), list(stack), next((b.page for b in held if b.page is not None), None), whole, tokens(whole)

    for b in blocks(text):
        heading = b.kind == "heading"
        size = sum(tokens(x.text) for x in held)
        if held and (heading or size + tokens(b.text) > target):
            for row in emit():
                yield row
                n += 1
            held = [] if heading else _tail(held, int(target * overlap))
        if heading:
            # The path's depth counts, not the heading's level: a skipped level leaves no gap.
            stack = [*stack[: b.level - 1], b.text.lstrip("#").strip()]
        held.append(b)
    yield from emit()


def chunk(docs: DataFrame, source: str = "source", text: str = "text", target: int = 650, overlap: float = 0.1) -> DataFrame:
    """A row per chunk; a narrow map without a shuffle.  Null texts have no chunks."""
    ship(docs.sparkSession)

    return docs.selectExpr(f"CAST(`{source}` AS STRING) AS s", f"`{text}` AS t").mapInArrow(lambda batches: _cut(batches, target, overlap), SCHEMA)


def _cut(batches: Iterable[pa.RecordBatch], target: int, overlap: float) -> Iterator[pa.RecordBatch]:
    """The chunks of batches (source, text), handed on as soon as there are ``HELD`` characters of them; one text is in Python at a time."""
    rows: list[tuple] = []
    size = 0

    def made() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), _TYPES.values(), strict=True)], list(_TYPES))

    for batch in batches:
        for at in range(batch.num_rows):
            s, t = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
            for c in chunks(t or "", target, overlap):
                rows.append((f"{s}#{c[0]}", s, *c))
                size += len(c[4])
                if size >= HELD:
                    yield made()
                    rows, size = [], 0
    if rows:
        yield made()


class ChunkTable:
    """``chunks(source => ..., text => ...[, target => 650, overlap => 0.1])`` as a table function of SQL."""

    @staticmethod
    def analyze(source: AnalyzeArgument, text: AnalyzeArgument, target: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        for name, given in (("target", target), ("overlap", overlap)):
            if given is not None and not given.isConstantExpression:
                raise ValueError(f"{name} must be a constant")
        if target is not None and target.value is not None and int(target.value) < 1:
            raise ValueError("target must be 1 or more")
        kind = StructType([StructField("chunk_id", StringType()), StructField("source", source.dataType), *_CHUNK])
        return AnalyzeResult(schema=kind)

    def eval(self, source, text: str | None, target: int | None = None, overlap: float | None = None) -> Iterator[tuple]:
        for c in chunks(text or "", 650 if target is None else int(target), 0.1 if overlap is None else float(overlap)):
            yield (f"{source}#{c[0]}", source, *c)


def register(spark: SparkSession, name: str = "chunks") -> None:
    """Offer ``ChunkTable`` to SQL: ``SELECT c.* FROM documents, LATERAL chunks(doc_id, text) AS c``."""
    ship(spark)
    spark.udtf.register(name, F.udtf(ChunkTable))
