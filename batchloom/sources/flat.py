"""Flat-file sources with explicit schemas, and what becomes of malformed records."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

_CORRUPT = "_corrupt"


@dataclass(frozen=True)
class Dialect:
    """How delimited text is written. Defaults: comma, double quotes doubled, no header, ragged records malformed, 1 MiB a record.

    Without ``quoted_line_ends`` a line whose quotes are not closed is
    malformed, which saves a pass over the files.
    """

    delimiter: str = ","
    quote: str = '"'
    escape: str | None = None
    double_quote: bool = True
    header: bool = False
    flexible: bool = False
    terminator: str | None = None
    max_record_bytes: int = 1 << 20
    quoted_line_ends: bool = True

    def __post_init__(self):
        if len(self.delimiter) != 1 or self.delimiter in (self.quote, "\n", "\r"):
            raise ValueError("the delimiter is one character, no quote and no line end")
        if self.max_record_bytes < 1:
            raise ValueError("a record may have at least one byte")

    def options(self) -> dict[str, str]:
        out = {"sep": self.delimiter, "quote": self.quote, "header": str(self.header).lower(), "multiLine": "true", "mode": "PERMISSIVE", "enforceSchema": "true", "emptyValue": "", "nullValue": "\0"}
        out["escape"] = '"' if self.escape is None and self.double_quote else self.escape or "\0"
        if self.terminator:
            out["lineSep"] = self.terminator
        return out


@dataclass(frozen=True)
class Field:
    """A fixed-width field: bytes, and a name for access by name."""

    width: int
    name: str | None = None


@dataclass(frozen=True)
class Layout:
    fields: tuple[Field, ...] = field(default_factory=tuple)

    def __post_init__(self):
        if not self.fields:
            raise ValueError("a layout has at least one field")
        if any(f.width < 1 for f in self.fields):
            raise ValueError("a field has at least one byte")

    @property
    def width(self) -> int:
        return sum(f.width for f in self.fields)

    def names(self) -> list[str]:
        return [f.name or f"f{i}" for i, f in enumerate(self.fields)]

    def columns(self, line: Column) -> list[Column]:
        """Each field's bytes, undecoded."""
        out, at = [], 1
        for f in self.fields:
            out.append(F.substring(line, at, f.width))
            at += f.width
        return out


def _lines(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """``file, block, mid, value`` of each line, files split as any other; ``mid`` rises within a block."""
    read = spark.read.option("lineSep", separator).text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"), "value")


def _before(in_file: bool) -> WindowSpec:
    """The blocks before one, of its file or of all."""
    ordered = Window.partitionBy("file").orderBy("block") if in_file else Window.orderBy("file", "block")
    return ordered.rowsBetween(Window.unboundedPreceding, -1)


def _placed(lines: DataFrame, odd: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """``lines`` with ``pos``, their place in file order, and ``start``; and the table of blocks that they are placed by.

    A line starts a record unless an odd number of the lines before it in its
    file are ``odd``, that is leave a quote open. There is one row for each
    block of a file, which one pass over the lines counts.
    """
    odd = F.lit(0) if odd is None else odd.cast("int")
    lines = lines.withColumn("odd", odd)
    blocks = lines.groupBy("file", "block").agg(F.min("mid").alias("first"), F.count("*").alias("n"), F.sum("odd").alias("odds"))
    total = lambda name, over: F.coalesce(F.sum(name).over(over), F.lit(0))
    blocks = blocks.select("file", "block", "first", "odds", total("n", _before(False)).alias("offset"), total("odds", _before(True)).alias("odds_before"))
    # Kept, under a name of its own: what is kept of an earlier read of the same files says nothing about this one.
    blocks = blocks.withColumn("read", F.lit(uuid.uuid4().hex)).persist()
    placed = lines.join(F.broadcast(blocks.drop("odds", "read")), ["file", "block"]).withColumn("pos", F.col("mid") - F.col("first") + F.col("offset"))
    return placed.withColumn("first_of_file", (F.col("block") == 0) & (F.col("mid") == F.col("first"))), blocks


def _records(placed: DataFrame, blocks: DataFrame, limit: int) -> DataFrame:
    """``pos, value, size, first_of_file`` of records that may hold line ends within quotes; ``value`` is null beyond ``limit`` bytes."""
    whole = placed.select("pos", "value", F.octet_length("value").alias("size"), "first_of_file")
    if not blocks.filter("odds > 0").limit(1).count():
        return whole
    so_far = Window.partitionBy("file", "block").orderBy("mid")
    open_ = (F.coalesce(F.sum("odd").over(so_far.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("odds_before")) % 2 == 1
    marked = placed.withColumn("start", ~open_)
    begun = marked.filter("start").groupBy("file", "block").agg(F.max("pos").alias("last_start"))
    carried = blocks.select("file", "block").join(begun, ["file", "block"], "left").withColumn("carried", F.max("last_start").over(_before(True))).drop("last_start")
    marked = marked.join(F.broadcast(carried), ["file", "block"])
    record = F.coalesce(F.max(F.when(F.col("start"), F.col("pos"))).over(so_far.rowsBetween(Window.unboundedPreceding, 0)), F.col("carried"))
    marked = marked.withColumn("record", record)
    single = marked.filter("start and odd = 0").select("pos", "value", F.octet_length("value").alias("size"), "first_of_file")
    parts = marked.filter("not start or odd = 1").select("record", "pos", "value", "first_of_file")
    sizes = parts.groupBy("record").agg((F.sum(F.octet_length("value")) + F.count("*") - 1).alias("size"), F.max("first_of_file").alias("first_of_file"))
    kept = parts.join(sizes.filter(F.col("size") <= limit).select("record"), "record", "left_semi").groupBy("record").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), "\n").alias("value"))
    joined = sizes.join(kept, "record", "left").select(F.col("record").alias("pos"), "value", "size", "first_of_file")
    return single.unionByName(joined)


def _quotes(dialect: Dialect) -> Column:
    """Whether a line has an odd number of quotes that no escape precedes."""
    line = F.col("value")
    if dialect.escape and dialect.escape != dialect.quote:
        line = F.regexp_replace(line, f"\\Q{dialect.escape}\\E.", "")
    return F.length(F.regexp_replace(line, f"[^\\Q{dialect.quote}\\E]", "")) % 2 == 1


def delimited(spark: SparkSession, path: str, names: list[str], dialect: Dialect = Dialect(), start: int = 0, position: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records as string columns, and malformed ones as ``record``.

    A record is malformed if it has too few or too many fields, is no UTF-8, or
    has more bytes as written than the dialect allows; of one whose quoted line
    ends take it beyond that bound no more than its size is kept, and
    ``record`` is null. Ragged records are malformed also where a header gives
    the names. Empty lines are no records; nothing is inferred.

    With ``position`` both have ``pos``, which rises in file order (files by
    path) and is the same however the files are split; a reader that begins
    again at ``start`` goes on with the record there.
    """
    lines = _lines(spark, path, dialect.terminator or "\n")
    if dialect.quoted_line_ends or dialect.header or position or start:
        placed, blocks = _placed(lines, _quotes(dialect) if dialect.quoted_line_ends else None)
        found = _records(placed, blocks, dialect.max_record_bytes)
    else:
        found = lines.select(F.lit(0).cast("long").alias("pos"), "value", F.octet_length("value").alias("size"), F.lit(False).alias("first_of_file"))
    if dialect.header:
        found = found.filter("not first_of_file")
    value = F.col("value") if dialect.terminator else F.regexp_replace("value", "\r$", "")
    found = found.filter((F.col("pos") >= start) & ((F.col("size") > 0) & (value != "") | F.col("value").isNull())).withColumn("valid", F.is_valid_utf8("value")).withColumn("value", value)
    options = {k: v for k, v in dialect.options().items() if k not in ("header", "multiLine", "enforceSchema", "lineSep")}
    schema = ", ".join(f"`{n}` string" for n in [*names, _CORRUPT])
    read = found.withColumn("_row", F.from_csv("value", schema, options | {"columnNameOfCorruptRecord": _CORRUPT}))
    torn = F.lit(False) if dialect.quoted_line_ends else _quotes(dialect)
    bad = F.col("value").isNull() | (F.octet_length("value") > dialect.max_record_bytes) | ~F.col("valid") | torn | F.col(f"_row.{_CORRUPT}").isNotNull()
    pos = ["pos"] if position else []
    return read.filter(~bad).select(*pos, *[F.col(f"_row.`{n}`").alias(n) for n in names]), read.filter(bad).select(*pos, F.col("value").alias("record"))


def delimited_flexible(spark: SparkSession, path: str, dialect: Dialect = Dialect(flexible=True)) -> DataFrame:
    """``line, fields``: every record with as many fields as it has. Records are lines here, quotes are honoured within them."""
    d, q = f"\\Q{dialect.delimiter}\\E", f"\\Q{dialect.quote}\\E"
    # A delimiter and the field after it, quoted or not; nothing is tried twice, so a line takes time in its length.
    field_ = f"{d}((?:{q}[^{q}]*+(?:{q}{q}[^{q}]*+)*+{q})?+[^{d}]*+)"
    raw = F.regexp_extract_all(F.concat(F.lit(dialect.delimiter), F.regexp_replace("value", "\r$", "")), F.lit(field_), F.lit(1))
    quoted = lambda x: x.startswith(dialect.quote) & x.endswith(dialect.quote) & (F.length(x) > 1)
    bare = lambda x: F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit(dialect.quote * 2), F.lit(dialect.quote))
    plain = F.transform(raw, lambda x: F.when(quoted(x), bare(x)).otherwise(x))
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("line"), plain.alias("fields"))


def fixed_width(spark: SparkSession, path: str, layout: Layout, start: int = 0, position: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records as string columns, and malformed lines as bytes in ``record``.

    Lines end at ``\\n`` only; one ``\\r`` before it is dropped. A line must have
    exactly the layout's bytes, so an empty one is malformed, and no field may
    cut a character. ``start`` and ``position`` are as in :func:`delimited`.
    """
    lines = _lines(spark, path)
    if position or start:
        lines = _placed(lines)[0].filter(F.col("pos") >= start)
    pos = ["pos"] if position else []
    raw = lines.select(*pos, F.col("value").cast("binary").alias("b"))
    line = F.when(F.substring("b", -1, 1) == F.lit(b"\r"), F.expr("substring(b, 1, octet_length(b) - 1)")).otherwise(F.col("b"))
    raw = raw.select(*pos, line.alias("b"))
    fields = layout.columns(F.col("b"))
    ok = F.octet_length("b") == layout.width
    for f in fields:
        ok = ok & F.is_valid_utf8(f.cast("string"))
    good = raw.filter(ok).select(*pos, *[f.cast("string").alias(n) for f, n in zip(fields, layout.names())])
    return good, raw.filter(~ok).select(*pos, F.col("b").alias("record"))


def composite(*sources: DataFrame, pos: str = "pos") -> DataFrame:
    """Sources one after the other: ordered by ``source_ordinal``, then ``pos``."""
    out = None
    for k, df in enumerate(sources):
        one = df.withColumn("source_ordinal", F.lit(k).cast("long"))
        out = one if out is None else out.unionByName(one)
    return out


def items(spark: SparkSession, values: list, kind: str = "string") -> DataFrame:
    """An ordered in-memory source."""
    return spark.createDataFrame(list(enumerate(values)), f"pos long, value {kind}")


def resumed_range(spark: SparkSession, start: int, end: int, committed: int) -> DataFrame:
    """A range that goes on after the ``committed`` items of an earlier attempt."""
    return spark.range(start + committed, end).select(F.col("id").alias("n"))
