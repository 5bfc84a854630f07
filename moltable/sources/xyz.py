"""XYZ files: a reader of frames with located errors, and a writer."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import batched

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import dims
from ..storage import stored
from . import chains

DDL = "path string, frame_id long, comment string, site_id long, element int, x double, y double, z double, error_kind string, error_line long, error_column long"
_Z = {dims.symbol(z): z for z in range(1, 256)}
U32 = 2**32 - 1


class XyzError(ValueError):
    def __init__(self, kind: str, line: int, column: int | None = None):
        super().__init__(f"{kind} at line {line}")
        self.kind, self.line, self.column = kind, line, column


def _fields(line: str) -> list[tuple[str, int]]:
    """Fields between white space with their 1-based byte columns."""
    out, at = [], 0
    for f in line.split():
        at = line.index(f, at)
        out.append((f, len(line[:at].encode("utf-8")) + 1))
        at += len(f)
    return out


def _plain_atom(line: str) -> tuple[int, float, float, float] | None:
    """What `_atom` gives for a line without faults, None for others: columns are counted for these alone."""
    fields = line.split()
    if len(fields) != 4 or "_" in line:
        return None
    z = _Z.get(fields[0][:1].upper() + fields[0][1:].lower())
    try:
        x, y, w = float(fields[1]), float(fields[2]), float(fields[3])
    except ValueError:
        return None
    return (z, x, y, w) if z is not None and math.isfinite(x) and math.isfinite(y) and math.isfinite(w) else None


def _atom(line: str, number: int) -> tuple[int, float, float, float]:
    plain = _plain_atom(line)
    if plain is not None:
        return plain
    fields = _fields(line)
    if len(fields) != 4:
        raise XyzError("FieldCount", number)
    name, column = fields[0]
    z = _Z.get(name[:1].upper() + name[1:].lower())
    if z is None:
        raise XyzError("ElementSymbol", number, column)
    out = []
    for text, column in fields[1:]:
        try:
            v = float(text) if "_" not in text else math.nan
        except ValueError:
            v = math.nan
        if not math.isfinite(v):
            raise XyzError("Coordinate", number, column)
        out.append(v)
    return (z, *out)


def frames(text: str) -> Iterator[tuple[str, list[tuple[int, float, float, float]]]]:
    """(comment, atoms) of each frame; an XyzError ends the file.  Blank lines are skipped before a count only."""
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    if lines and not lines[-1]:
        lines.pop()
    i = 0
    while True:
        while i < len(lines) and not lines[i].strip():
            i += 1
        if i == len(lines):
            return
        count = lines[i].strip()
        if not count.isascii() or not count.removeprefix("+").isdigit() or int(count) > 2**64 - 1:
            raise XyzError("AtomCount", i + 1)
        if int(count) > U32:
            raise XyzError("AtomCountRange", i + 1)
        n = int(count)
        if i + 1 >= len(lines):
            raise XyzError("UnexpectedEof", len(lines) + 1)
        comment = lines[i + 1]
        if i + 2 + n > len(lines):
            for k in range(i + 2, len(lines)):
                _atom(lines[k], k + 1)
            raise XyzError("UnexpectedEof", len(lines) + 1)
        yield comment, [_atom(lines[k], k + 1) for k in range(i + 2, i + 2 + n)]
        i += 2 + n


def _rows(path: str, text: str, only_first: bool) -> Iterator[tuple]:
    frame = 0
    try:
        for comment, atoms in frames(text):
            for k, (z, x, y, w) in enumerate(atoms, 1):
                yield path, frame, comment, k, z, x, y, w, None, None, None
            if not atoms:
                yield path, frame, comment, None, None, None, None, None, None, None, None
            frame += 1
            if only_first:
                return
        if not frame and only_first:
            raise XyzError("UnexpectedEof", text.count("\n") + (not text.endswith("\n") and text != "") + 1)
    except XyzError as e:
        yield path, frame, None, None, None, None, None, None, e.kind, e.line, e.column


def parse(files: DataFrame, first_frame: bool = False) -> DataFrame:
    """Sites of texts (path, value): columns DDL.  A text is one unit of work (`read` splits files); frames without
    atoms give a row without a site, a failed frame a row with the error and nothing after it."""

    def run(batches):
        for batch in batches:
            # rows of many texts go out together: a batch for each small text would cost more than its lines
            every = (row for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for row in _rows(path, text or "", first_frame))
            for rows in batched(every, 20_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[t]) for n, t in (f.strip().split() for f in DDL.split(","))])
    return files.select("path", "value").mapInArrow(run, DDL)


# An atom line of plain fields; all others are looked at one by one.
_PLAIN = r"^[ \t]*([A-Za-z]{1,3})" + r"[ \t]+([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)" * 3 + r"[ \t]*\z"
_ATOM = T.StructType([T.StructField("element", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in "xyz"), T.StructField("kind", T.StringType()), T.StructField("col", T.LongType())])


@F.pandas_udf(_ATOM)
def _slow_atom(text: pd.Series) -> pd.DataFrame:
    """Atom lines by the full grammar; null lines are skipped."""
    out = []
    for t in text:
        try:
            out.append((None,) * 6 if t is None else (*_atom(t, 0), None, None))
        except XyzError as e:
            out.append((None, None, None, None, e.kind, e.column))
    return pd.DataFrame(out, columns=["element", "x", "y", "z", "kind", "col"]).astype({"element": "Int32", "col": "Int64", "x": "Float64", "y": "Float64", "z": "Float64", "kind": object})


def _count(text):
    """The number that a line holds, as decimal(20,0): null where it holds none or one of more than 20 digits."""
    digits = F.ltrim(F.regexp_extract(text, r"(?U)^\s*\+?([0-9]+)\s*\z", 1), F.lit("0"))
    held = text.rlike(r"(?U)^\s*\+?[0-9]+\s*\z") & (F.length(digits) <= 20)
    return F.when(held, F.concat(F.lit("0"), digits).cast("decimal(21,0)")).try_cast("decimal(20,0)")


def _frames(lines: DataFrame, segment: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(records, ends, candidates) of numbered lines; candidates (path, line, n decimal) are lines that hold a count."""
    open_ = lines.select("path", "line", F.col("text").rlike(r"(?U)^\s*\z").alias("blank"), _count(F.col("text")).alias("n")).where("blank or n is not null")
    open_ = stored(open_, "counts")
    step = F.when(F.col("blank"), F.lit(1).cast("long")).otherwise(F.col("n").cast("long") + 2)
    nodes = open_.where(F.col("blank") | (F.col("n") <= U32)).select("path", "line", (F.col("line") + step).alias("to"), (~F.col("blank")).alias("opens"))
    return (*chains.records(nodes, segment), open_)


def read(spark: SparkSession, path: str, first_frame: bool = False, segment: int = chains.SEGMENT) -> DataFrame:
    """Sites of XYZ files, columns DDL, rows and errors as `parse` gives them; a file is read by as many tasks as it has blocks.

    Frames are found by `chains.records`.  Each line then meets its frame in a window over its segment of lines, and plain
    atom lines are read as Columns.  What stands behind a file's first error is dropped.
    """
    lines = chains.numbered(spark, path)
    total = lines.groupBy("path").agg(F.max("line").alias("total"))
    found, ends, counts = _frames(lines, segment)
    if first_frame:
        found = found.where("record = 0")
        files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"))
        total = files.join(total, "path", "left").select("path", F.coalesce("total", F.lit(0)).alias("total"))
    total = stored(total, "total")
    own = found.join(total, "path").select("path", F.col("record").alias("frame_id"), F.col("line").alias("head"), (F.col("to") - F.col("line") - 2).alias("n"), F.least(F.col("to") - 1, F.col("total")).alias("last"))
    piece = own.withColumn("segment", F.explode(F.sequence(F.expr(f"head div {segment}"), F.expr(f"last div {segment}"))))
    # a frame that goes on in later segments takes its comment there
    far = piece.where(F.expr(f"segment > (head + 1) div {segment}"))
    note = lines.select("path", (F.col("line") - 1).alias("head"), F.col("text").alias("comment"))
    far = far.join(note, ["path", "head"]).select("path", "segment", "frame_id", "comment")
    piece = piece.join(far, ["path", "segment", "frame_id"], "left")
    frame = F.struct("frame_id", "head", "n", "comment")
    starts = piece.select("path", "segment", F.greatest("head", F.col("segment") * segment).alias("line"), F.lit(0).alias("turn"), frame.alias("frame"), F.lit(None).cast("string").alias("text"))
    both = starts.unionByName(lines.select("path", F.expr(f"line div {segment}").alias("segment"), "line", F.lit(1).alias("turn"), F.lit(None).cast(starts.schema["frame"].dataType).alias("frame"), "text"))
    w = Window.partitionBy("path", "segment").orderBy("line", "turn").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("frame", F.last("frame", ignorenulls=True).over(w))
    both = both.withColumn("k", F.col("line") - F.col("frame.head") - 1)
    heading = F.last(F.when((F.col("turn") == 1) & (F.col("k") == 0), F.struct("text")), ignorenulls=True).over(w)
    both = both.withColumn("own", heading).where("turn = 1 and k >= 0 and k <= frame.n and (k > 0 or frame.n = 0)")
    comment = F.when(F.col("own").isNotNull() & F.expr(f"(frame.head + 1) div {segment} = segment"), F.col("own.text")).otherwise(F.col("frame.comment"))
    part = lambda i: F.regexp_extract("text", _PLAIN, i)
    atom = both.select("path", "frame.frame_id", comment.alias("comment"), "line", "k", F.when(F.col("k") > 0, F.col("text")).alias("text"))
    atom = atom.withColumn("symbol", F.initcap(part(1))).withColumn("at", F.when(F.col("symbol") != "", F.array(*(part(i).cast("double") for i in (2, 3, 4)))))
    dim = F.broadcast(dims.elements(spark).select(F.col("element").cast("int").alias("quick"), "symbol"))
    atom = atom.join(dim, "symbol", "left")
    plain = F.col("quick").isNotNull() & F.forall("at", lambda v: F.abs(v) < float("inf"))
    atom = atom.withColumn("slow", _slow_atom(F.when(F.coalesce(plain, F.lit(False)), F.lit(None)).otherwise(F.col("text"))))
    pick = lambda fast, slow: F.when(F.coalesce(plain, F.lit(False)), fast).otherwise(F.col(f"slow.{slow}"))
    site = stored(atom.select("path", "frame_id", "comment", "line", F.when(F.col("k") > 0, F.col("k")).alias("site_id"), pick(F.col("quick"), "element").alias("element"), *(pick(F.col("at")[i], c).alias(c) for i, c in enumerate("xyz")), F.col("slow.kind").alias("error_kind"), F.col("slow.col").alias("error_column")), "sites")

    wrong = site.where("error_kind is not null").select("path", "frame_id", F.col("line").alias("error_line"), "error_kind", "error_column")
    end = total.join(ends, "path", "left").select("path", "total", F.coalesce("stop", F.lit(1)).alias("stop"), F.coalesce("records", F.lit(0)).alias("frame_id"))
    if first_frame:
        # only what lies in the first frame, or stands for it, counts
        end = end.join(own.select("path", (F.col("head") + F.col("n") + 2).alias("to")), "path", "left")
        end = end.select("path", "total", F.coalesce("to", "stop").alias("stop"), F.when(F.col("to").isNull(), F.lit(0)).otherwise(1).alias("frame_id"), F.col("to").isNull().alias("open"))
    else:
        end = end.withColumn("open", F.lit(False))
    held = counts.where("n is not null").select("path", F.col("line").alias("stop"), "n")
    end = end.join(held, ["path", "stop"], "left")
    short = (F.col("stop") > F.col("total") + 1) | (F.col("open") & (F.col("stop") > F.col("total")))
    limit = F.lit("18446744073709551615").cast("decimal(20,0)")
    bad = (F.col("stop") <= F.col("total")) if not first_frame else (F.col("open") & (F.col("stop") <= F.col("total")))
    kind = F.when(short, "UnexpectedEof").when(bad, F.when((F.col("n") > U32) & (F.col("n") <= limit), "AtomCountRange").otherwise("AtomCount"))
    # a file cut short ends inside its last frame, which its count has opened already
    which = F.when(short & ~F.col("open"), F.col("frame_id") - 1).otherwise(F.col("frame_id"))
    wrong = wrong.unionByName(end.select("path", which.alias("frame_id"), F.when(short, F.col("total") + 1).otherwise(F.col("stop")).alias("error_line"), kind.alias("error_kind"), F.lit(None).cast("long").alias("error_column")).where("error_kind is not null"))
    wrong = stored(wrong.groupBy("path").agg(F.min_by(F.struct("frame_id", "error_kind", "error_column", "error_line"), "error_line").alias("e")).select("path", "e.*"), "errors")
    names = [f.strip().split() for f in DDL.split(",")]
    good = site.drop("error_kind", "error_column").join(wrong.select("path", F.col("frame_id").alias("failed")), "path", "left").where("failed is null or frame_id < failed")
    fit = lambda d: d.select(*((F.col(c) if c in d.columns else F.lit(None)).cast(t).alias(c) for c, t in names))
    return fit(good).unionByName(fit(wrong))


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same rows of files as they arrive in a folder; no state is kept."""
    text = spark.readStream.format("text").option("wholetext", "true").schema("value string").load(path)
    return parse(text.select(F.col("_metadata.file_path").alias("path"), "value"))


def number(c):
    """A double in plain digits, all of those of its own text: no exponent, no trailing .0."""
    text = c.cast("double").cast("string")
    # without an exponent the text is plain but for its .0; the digits are taken apart for the others alone
    short = F.when(text.endswith(".0"), F.substring(text, F.lit(1), F.length(text) - 2)).otherwise(text)
    part = lambda n: F.regexp_extract(text, r"^(-?)([0-9]+)\.([0-9]*?)0*(?:E(-?[0-9]+))?$", n)
    digits = F.regexp_replace(F.concat(part(2), part(3)), "^0+(?=.)", "")
    # how many of the digits stand before the point; zeros in front of them do not count
    point = F.length(part(2)) + F.coalesce(F.nullif(part(4), F.lit("")).cast("int"), F.lit(0)) - (F.length(part(2)) + F.length(part(3)) - F.length(digits))
    ahead = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    behind = F.rpad(digits, F.greatest(point, F.length(digits)), "0")
    plain = F.when(digits == "0", "0").when(point <= 0, ahead).when(point >= F.length(digits), behind).otherwise(F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits))))
    return F.when(~text.contains("E"), short).when(text.rlike("^-?[0-9]"), F.concat(part(1), plain)).otherwise(text)


def lines(sites: DataFrame, comment=None) -> DataFrame:
    """(mol_id, value): the XYZ frame of each molecule; null where the comment holds a line break."""
    dim = F.broadcast(dims.elements(sites.sparkSession).select(F.col("element").cast("int").alias("element"), "symbol"))
    atom = F.concat_ws(" ", "symbol", number(F.col("x")), number(F.col("y")), number(F.col("z")))
    mol = sites.join(dim, "element").groupBy("mol_id").agg(F.array_sort(F.collect_list(F.struct("site_id", atom.alias("t")))).alias("rows"))
    note = F.concat(F.lit("mol "), F.col("mol_id").cast("string")) if comment is None else comment
    body = F.concat_ws("\n", F.size("rows").cast("string"), note, F.array_join(F.transform("rows", lambda r: r["t"]), "\n"))
    return mol.select("mol_id", F.when(~note.rlike("[\r\n]"), F.when(F.size("rows") > 0, body)).alias("value"))


def write(sites: DataFrame, path: str, comment=None) -> None:
    lines(sites, comment).select("value").write.text(path)
