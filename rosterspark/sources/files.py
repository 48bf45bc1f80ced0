"""File sources and sinks.

CSV contacts are read as lines, so a file is split over many tasks even where
cells hold line breaks.  A line maps the state before it (outside or inside a
quoted cell) to the state after it; such functions compose, so each split works
out its own and a table with one row per split gives the state at which each
begins.  Files without an open quote skip that: each line is a record.  Cells
are cut from the record's text, so files may have any number of columns, and
each file's own header says which place holds which column (by place, so case
variants such as ``email``/``EMAIL`` stay distinct).  Line numbers are dense
and 1-based in file order without a global window: per input split (file,
block) record counts are prefix-summed in a table with one row per split and
added to the record's index inside its split.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import constants as K
from ..functions.expr import js_trim, mask_email, mask_phone
from ..session import materialize, ship_package
from .contacts import CONTACT_COLUMNS, alias_plan

EMPTY_ROW = "Empty row"
CHECKPOINT_BUCKETS = 64


# --- S3 header check --------------------------------------------------------------


@dataclass
class HeaderCheck:
    is_valid: bool
    errors: list = field(default_factory=list)
    warnings: list = field(default_factory=list)
    mapping: dict = field(default_factory=dict)


def check_headers(columns, required=("email",)) -> HeaderCheck:
    """Lower-cased, trimmed headers against the alias lists; unknown -> warning; required miss -> error."""
    normalized = [c.lower().strip() for c in columns]
    res = HeaderCheck(True)
    for req in required:
        options = K.HEADER_ALIASES.get(req, [req.lower()])
        hit = next((o for o in options if o in normalized), None)
        if hit is None:
            res.is_valid = False
            res.errors.append(f"Required header '{req}' not found. Expected one of: {', '.join(options)}")
        else:
            res.mapping[req] = columns[normalized.index(hit)]
    expected = {a for al in K.HEADER_ALIASES.values() for a in al}
    for h in normalized:
        if h not in expected:
            res.warnings.append(f"Unexpected header '{h}' will be ignored")
    return res


def header_check_frame(spark: SparkSession, check: HeaderCheck) -> DataFrame:
    """S3 result as a small DataFrame of ``(kind, message)`` rows."""
    rows = [("error", e) for e in check.errors] + [("warning", w) for w in check.warnings]
    return spark.createDataFrame(rows, "kind string, message string")


def _hadoop_files(spark: SparkSession, path: str):
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    statuses = fs.globStatus(hpath)
    out = []
    for st in statuses or []:
        if st.isDirectory():
            for child in fs.listStatus(st.getPath()):
                name = child.getPath().getName()
                if child.isFile() and not name.startswith(("_", ".")):
                    out.append(child)
        else:
            out.append(st)
    return fs, sorted(out, key=lambda s: s.getPath().toString())


def spark_charset(encoding: str) -> str:
    """Node-style names (``utf8``, ``latin1``) to the charset names Spark accepts."""
    e = encoding.lower().replace("_", "-")
    return {"utf8": "utf-8", "latin1": "iso-8859-1", "ascii": "us-ascii", "utf16le": "utf-16le", "ucs2": "utf-16le"}.get(e, e)


# --- S1/S2/S4/S5 reading ----------------------------------------------------------


def _placed(raw: DataFrame, columns) -> DataFrame:
    """``columns`` with the input split of each row (file, block start) and an id that runs on within the split."""
    return raw.select(
        *columns,
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_mono"),
    )


def _offsets(splits: DataFrame) -> DataFrame:
    """``splits`` (one row per input split: _file, _block, _first, _n) with ``_off``, the rows of the splits before."""
    # one row per input split: a single-task window here is bounded by the split count
    w = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")


def with_line_number(raw: DataFrame, name: str = "line_number") -> DataFrame:
    """Dense 1-based ordinal in (file path, block start, row-in-split) order.

    Pass 1 counts rows per input split (one row per split); a window over that
    small table gives each split its offset; pass 2 adds the row's index inside
    its split (``monotonically_increasing_id`` is consecutive within a task).
    Both passes read the same splits in the same order, so ids agree.
    """
    d = _placed(raw, ["*"])
    splits = d.groupBy("_file", "_block").agg(F.min("_mono").alias("_first"), F.count(F.lit(1)).alias("_n"))
    out = d.join(_offsets(splits), ["_file", "_block"], "inner")
    out = out.withColumn(name, (F.col("_off") + F.col("_mono") - F.col("_first") + 1).cast("bigint"))
    return out.drop("_file", "_block", "_mono", "_first", "_off")


def split_empty_rows(df: DataFrame, value_cols) -> tuple:
    """``(rows, quarantine)``; a row with no non-blank cell is quarantined as ``Empty row``."""
    blank = F.forall(F.array(*[F.col(f"`{c}`") for c in value_cols]), lambda x: x.isNull() | (js_trim(x) == F.lit("")))
    rows = df.filter(~blank)
    quarantine = df.filter(blank).select("line_number", F.lit(EMPTY_ROW).alias("error"))
    return rows, quarantine


_QUOTED = '"[^"]*+(?:""[^"]*+)*+"[^,]*+'
_OPEN = '"[^"]*+(?:""[^"]*+)*+$'
#: A line that begins outside a quoted cell and ends inside one.
_OPENS = f'^(?:(?:{_QUOTED}|[^",][^,]*+|),)*+{_OPEN}'
#: A line that begins inside a quoted cell and ends inside one.
_STAYS = f'^[^"]*+(?:""[^"]*+)*+(?:$|"[^,]*+,(?:(?:{_QUOTED}|[^",][^,]*+|),)*+{_OPEN})'
_CELL = f',({_QUOTED}|[^,]*+)'


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """(line, _file, _block): lines without their ends (LF or CRLF) and the input split that each is from."""
    charset = spark_charset(encoding)
    raw = spark.read.option("lineSep", "\n").option("encoding", charset).text(path)
    value = F.col("value") if charset == "utf-8" else F.decode(F.col("value").cast("binary"), charset)
    return raw.select(F.regexp_replace(value, "\r$", "").alias("line"), F.col("_metadata.file_path").alias("_file"),
                      F.col("_metadata.file_block_start").alias("_block"))


def _cells(record: Column) -> Column:
    """The cells of a record: a quoted one without its quotes, an empty one NULL, quoted empty ''."""
    def plain(x):
        quoted = x.startswith(F.lit('"')) & x.endswith(F.lit('"')) & (F.length(x) > 1)
        return F.when(quoted, F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))).when(x != "", x)

    return F.transform(F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(_CELL), F.lit(1)), plain)


def _joined_records(lines: DataFrame) -> DataFrame:
    """(_file, _no, record) of files with line breaks in quoted cells; ``_no`` counts records from 0.

    ``opens`` and ``stays`` say where a line leads from outside and from inside
    a quoted cell.  Where both are equal the line fixes the state; where they
    are opposite it turns it round.  So the state before a line is what the last
    fixing line left, turned round once for each turning line since; the same
    holds for whole splits, whose functions go through a table of one row each.
    """
    has_quote = F.instr("line", '"') > 0
    d = lines.withColumns({"opens": has_quote & F.col("line").rlike(_OPENS), "stays": ~has_quote | F.col("line").rlike(_STAYS),
                           "_mono": F.monotonically_increasing_id()})
    d = d.withColumns({"fixed": F.when(F.col("opens") == F.col("stays"), F.col("opens")), "turns": (F.col("opens") & ~F.col("stays")).cast("int")})

    def state_before(frame, keys, order, start):
        """Whether a quoted cell is open before each row, by the rows before it among ``keys``."""
        w = Window.partitionBy(*keys).orderBy(order)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        before = w.rowsBetween(Window.unboundedPreceding, -1)
        f = frame.withColumn("_t", F.sum("turns").over(upto))
        last = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "_t")), ignorenulls=True).over(before)
        f = f.withColumns({"_last": last, "_tp": F.coalesce(F.sum("turns").over(before), F.lit(0))})
        since = F.col("_tp") - F.coalesce(F.col("_last._t"), F.lit(0))
        return f.withColumns({"_since": since, "_known": F.col("_last.fixed")}) if start is None else f.withColumn(
            "_inside", F.coalesce(F.col("_last.fixed"), start) != (since % 2 == 1))

    split = ["_file", "_block"]
    d = state_before(d, split, "_mono", None)
    known, odd = F.col("_known"), F.col("_since") % 2 == 1

    def after(start):
        inside = F.coalesce(known, F.lit(start)) != odd
        return F.when(inside, F.col("stays")).otherwise(F.col("opens"))

    whole = d.groupBy(*split).agg(F.max_by(after(False), "_mono").alias("opens"), F.max_by(after(True), "_mono").alias("stays"))
    whole = whole.withColumns({"fixed": F.when(F.col("opens") == F.col("stays"), F.col("opens")),
                               "turns": (F.col("opens") & ~F.col("stays")).cast("int")})
    starts = state_before(whole, ["_file"], "_block", F.lit(False)).select(*split, F.col("_inside").alias("_start"))
    d = d.join(starts, split).withColumn("_inside", F.coalesce(known, F.col("_start")) != odd)
    d = d.withColumn("_begins", (~F.col("_inside") & (F.col("line") != "")).cast("long"))
    counts = d.groupBy(*split).agg(F.sum("_begins").alias("_n"))
    w = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*split, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    own = Window.partitionBy(*split).orderBy("_mono").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.join(counts, split).withColumn("_no", F.col("_off") + F.sum("_begins").over(own) - 1)
    parts = d.filter(F.col("_inside") | (F.col("_begins") == 1)).groupBy("_file", "_no").agg(
        F.sort_array(F.collect_list(F.struct("_block", "_mono", "line"))).alias("_parts"))
    return parts.select("_file", "_no", F.array_join(F.transform("_parts", lambda x: x.line), "\n").alias("record"))


def _records(spark: SparkSession, path: str, encoding: str, multiline: bool) -> tuple:
    """``(records, units)``: all records, blank lines left out, and a small table of where each run of them is counted.

    A unit is an input split, or a whole file that has line breaks in cells:
    ``_file, _block, _first, _n, _head`` (the file's first record in block 0).
    """
    lines = _lines(spark, path, encoding)
    solid = lines.filter(F.col("line") != "").withColumn("_mono", F.monotonically_increasing_id())
    opens = (F.instr("line", '"') > 0) & F.col("line").rlike(_OPENS)
    units = materialize(solid.groupBy("_file", "_block").agg(
        F.min("_mono").alias("_first"), F.count(F.lit(1)).alias("_n"), F.min_by("line", "_mono").alias("_head"),
        F.max(opens if multiline else F.lit(False)).alias("_open")), "csv-splits")
    records = solid.withColumnRenamed("line", "record")
    broken = units.filter("_open").select("_file").distinct()
    if not broken.isEmpty():
        joined = materialize(_joined_records(lines.join(broken, "_file", "left_semi")), "csv-records")
        ends = joined.groupBy("_file").agg(F.lit(0).cast("long").alias("_block"), F.lit(0).cast("long").alias("_first"),
                                           F.count(F.lit(1)).alias("_n"), F.min_by("record", "_no").alias("_head"))
        units = units.drop("_open").join(broken, "_file", "left_anti").unionByName(ends)
        records = records.join(broken, "_file", "left_anti").unionByName(
            joined.select("record", "_file", F.lit(0).cast("long").alias("_block"), F.col("_no").alias("_mono")))
    return records, units.drop("_open")


LAYOUT = ("_head string, _names array<string>, errors array<string>, warnings array<string>, mapping map<string,string>, "
          + ", ".join(f"_{c} int" for c in CONTACT_COLUMNS))


def _layouts(units: DataFrame, required, mode: str) -> DataFrame:
    """``LAYOUT``: for each distinct first record its column names, their check and the places of the contact columns."""
    ship_package(units.sparkSession)
    heads = units.filter("_block = 0").select("_head").distinct().withColumn("_cells", _cells(F.col("_head")))

    def run(batches):
        for pdf in batches:
            out = []
            for head, cells in zip(pdf["_head"], pdf["_cells"]):
                header = ["" if c is None else c for c in cells]
                header[0] = header[0].lstrip("\ufeff").strip('"') if header[0].startswith("\ufeff") else header[0]
                check, plan = check_headers(header, required), alias_plan(header, mode)
                out.append([head, header, check.errors, check.warnings, check.mapping,
                            *(header.index(plan[c]) if c in plan else None for c in CONTACT_COLUMNS)])
            frame = pd.DataFrame(out, columns=["_head", "_names", "errors", "warnings", "mapping", *(f"_{c}" for c in CONTACT_COLUMNS)])
            yield frame.astype({f"_{c}": "Int32" for c in CONTACT_COLUMNS})

    return heads.mapInPandas(run, LAYOUT)


def read_header(spark: SparkSession, path: str, encoding: str = "utf8") -> list:
    """Column names of the first input file (path order); only they reach the driver."""
    _records_, units = _records(spark, path, encoding, True)
    layouts = _layouts(units, (), "exact")
    first = units.filter("_block = 0").orderBy("_file").limit(1).join(layouts, "_head").select("_names").first()
    if first is None:
        raise FileNotFoundError(f"Cannot access file: {path}")
    return list(first[0])


def header_checks(spark: SparkSession, path: str, required=("email",), encoding: str = "utf8") -> DataFrame:
    """S3: ``(file, kind, message)``, a row for each error and warning about the header of each input file."""
    _records_, units = _records(spark, path, encoding, True)

    def of_kind(column, kind):
        return F.transform(column, lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("message")))

    messages = F.concat(of_kind("errors", "error"), of_kind("warnings", "warning"))
    found = units.filter("_block = 0").join(_layouts(units, required, "exact"), "_head")
    return found.select(F.col("_file").alias("file"), F.explode(messages).alias("m")).select("file", "m.kind", "m.message")


def read_contacts(
    spark: SparkSession,
    path: str,
    required=("email",),
    max_rows: int | None = None,
    encoding: str = "utf8",
    multiline: bool = True,
    mode: str = "exact",
    keep_original: bool = False,
):
    """Read headed CSV contacts.  Returns ``(contacts, quarantine, check)``.

    Every file is read by its own header, so files may order, name and count
    their columns differently; ``check`` is that of the first file in path
    order.  Raises ``ValueError`` when a required header is missing in any file.
    ``max_rows`` (S2) keeps the first n data rows, empty rows included, as a
    filter on the dense line number (None or 0: all).  Line breaks in quoted
    cells are read as such (CRLF as LF); ``multiline=False`` takes every line
    for a record.  Blank lines are left out, so line numbers count data rows.
    A quote that is never closed makes the rest of its file one record.
    """
    records, units = _records(spark, path, encoding, multiline)
    layouts = materialize(_layouts(units, required, mode), "csv-headers")
    heads = units.filter("_block = 0").select("_file", "_head").join(layouts, "_head")
    worst_first = heads.orderBy((F.size("errors") == 0), "_file").limit(1).collect()
    if not worst_first:
        raise FileNotFoundError(f"Cannot access file: {path}")
    r = worst_first[0]
    if r["errors"]:
        raise ValueError(f"Invalid CSV headers: {', '.join(r['errors'])} ({r['_file']})")
    check = HeaderCheck(True, list(r["errors"]), list(r["warnings"]), dict(r["mapping"]))
    is_head = F.col("_block") == 0
    counted = units.select("_file", "_block", "_first", (F.col("_n") - is_head.cast("long")).alias("_n"))
    offsets = _offsets(counted).join(heads.drop("_head", "errors", "warnings", "mapping"), "_file")
    numbered = (
        records.join(offsets, ["_file", "_block"], "inner")
        .filter(~(is_head & (F.col("_mono") == F.col("_first"))))
        .withColumn("line_number", (F.col("_off") + F.col("_mono") - F.col("_first") + 1 - is_head.cast("long")).cast("bigint"))
    )
    if max_rows:
        numbered = numbered.filter(F.col("line_number") <= F.lit(int(max_rows)))
    numbered = numbered.withColumn("_cells", _cells(F.col("record")))
    blank = F.forall("_cells", lambda x: x.isNull() | (js_trim(x) == F.lit("")))
    quarantine = numbered.filter(blank).select("line_number", F.lit(EMPTY_ROW).alias("error"))
    kept = numbered.filter(~blank)
    out = [F.col("line_number")]
    if keep_original:
        out.append(F.map_from_arrays("_names", F.transform("_names", lambda _, i: F.get("_cells", i))).alias("original"))
    contacts = kept.select(*out, *[F.get("_cells", F.col(f"_{c}")).alias(c) for c in CONTACT_COLUMNS])
    return contacts, quarantine, check


def read_stats(contacts: DataFrame, quarantine: DataFrame, headers=None) -> DataFrame:
    """Total, valid and invalid row counts (one row)."""
    v = contacts.agg(F.count(F.lit(1)).cast("bigint").alias("valid_rows"))
    q = quarantine.agg(F.count(F.lit(1)).cast("bigint").alias("invalid_rows"))
    both = v.unionByName(q, allowMissingColumns=True).agg(
        F.max("valid_rows").alias("valid_rows"), F.max("invalid_rows").alias("invalid_rows")
    )
    out = both.select((F.col("valid_rows") + F.col("invalid_rows")).alias("total_rows"), "valid_rows", "invalid_rows")
    if headers is not None:
        out = out.withColumn("headers", F.lit(",".join(headers)))
    return out


# --- S7 chunked reading lives in streaming.sources -----------------------------------


# --- S8/S9/S10 writing, counting, profiling -----------------------------------------


def write_contacts(df: DataFrame, path: str, columns=None, append: bool = False) -> None:
    """Headed CSV, quoting only when needed (``"`` doubled); values written verbatim."""
    if df.isEmpty():
        raise ValueError("No records to write")
    cols = list(columns) if columns else [c for c in df.columns]
    (
        df.select(*[F.col(f"`{c}`").cast("string") for c in cols])
        .write.mode("append" if append else "overwrite")
        .option("header", True)  # the reader drops the first record of every file
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def count_rows(spark: SparkSession, path: str, encoding: str = "utf8", multiline: bool = True) -> int:
    """Data rows in the file(s), headers excluded, read as ``read_contacts`` does."""
    _records_, units = _records(spark, path, encoding, multiline)
    return units.agg(F.coalesce(F.sum(F.col("_n") - (F.col("_block") == 0).cast("long")), F.lit(0))).first()[0]


def human_size(size) -> "F.Column":
    """``B`` / ``KB`` / ``MB`` / ``GB`` with one decimal (bytes without decimal)."""
    s = F.col(size) if isinstance(size, str) else size

    def one(div, unit):
        return F.concat(F.format_number(s / F.lit(float(div)), 1), F.lit(f" {unit}"))

    return (
        F.when(s < 1024, F.concat(s.cast("string"), F.lit(" B")))
        .when(s < 1024 ** 2, one(1024, "KB"))
        .when(s < 1024 ** 3, one(1024 ** 2, "MB"))
        .otherwise(one(1024 ** 3, "GB"))
    )


def profile_inputs(spark: SparkSession, path: str) -> DataFrame:
    """Per input file: size, human size, modification time (metadata columns, no parsing)."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return files.select(
        F.col("path").alias("file_path"),
        F.col("length").alias("size"),
        human_size("length").alias("size_formatted"),
        F.col("modificationTime").alias("modified"),
        F.lit(True).alias("readable"),
    )


# --- S11/S12/S13 exports -------------------------------------------------------------


def _q(c):
    return F.concat(F.lit('"'), F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), '"', '""'), F.lit('"'))


def _write_lines(lines: DataFrame, path: str, header: str | None) -> None:
    """Write ordered text lines (``_k`` is the sort key); the header goes first."""
    out = lines
    if header is not None:
        spark = lines.sparkSession
        h = spark.createDataFrame([(header,)], "line string").select(
            F.struct(F.lit(0).alias("a"), F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("c"))
            .alias("_k"), "line")
        out = h.unionByName(lines)
    out.orderBy("_k").select("line").write.mode("overwrite").text(path)


def export_validation_report(validated: DataFrame, path: str, fmt: str = "csv", summary: DataFrame | None = None):
    """Csv ``Type,Row,Field,Value,Message`` (errors first, then warnings); json; text."""
    from ..operators.rules import explode_findings

    f = explode_findings(validated)
    is_err = F.col("severity") == "error"
    key = F.struct(F.when(is_err, F.lit(1)).otherwise(F.lit(2)).alias("a"), F.col("line_number").alias("b"),
                   F.col("finding_no").alias("c"))
    fmt = fmt.lower()
    if fmt == "csv":
        line = F.concat_ws(",", F.when(is_err, F.lit("Error")).otherwise(F.lit("Warning")),
                           F.col("line_number").cast("string"), F.coalesce("field", F.lit("")),
                           _q(F.col("value")), _q(F.col("message")))
        _write_lines(f.select(key.alias("_k"), line.alias("line")), path, "Type,Row,Field,Value,Message")
    elif fmt == "json":
        safe = validated.select(
            "line_number", "is_valid", mask_email("email").alias("email"), "first_name", "last_name",
            mask_phone("phone_number").alias("phone_number"),
            F.transform(F.filter("findings", lambda x: x["severity"] == "error"), lambda x: x["message"]).alias("errors"),
            F.transform(F.filter("findings", lambda x: x["severity"] == "warning"), lambda x: x["message"])
            .alias("warnings"),
        )
        safe.write.mode("overwrite").json(path)
        if summary is not None:
            summary.write.mode("overwrite").json(path + "_summary")
    else:
        from ..operators.ordered import ordinal

        numbered = ordinal(f, "severity", ["line_number", "finding_no"], F.floor(F.col("line_number") / F.lit(1 << 18)), "_i")
        body = numbered.select(
            key.alias("_k"),
            F.concat(F.col("_i").cast("string"), F.lit(". Row "), F.col("line_number").cast("string"), F.lit(": "),
                     F.col("message")).alias("line"),
        )
        _write_lines(body, path, "VALIDATION REPORT")


def export_delivery_report(results: DataFrame, path: str, fmt: str = "csv", dry_run: bool = False):
    """Csv ``Type,Row,Email,Status,Message``: Success/Imported, Error/Failed (dry run: Error/Invalid)."""
    ok = F.col("success")
    typ = F.when(ok, F.lit("Success")).otherwise(F.lit("Error"))
    status = F.when(ok, F.lit("Imported")).otherwise(F.lit("Invalid" if dry_run else "Failed"))
    if fmt.lower() == "csv":
        line = F.concat_ws(",", typ, F.coalesce(F.col("line_number").cast("string"), F.lit("")),
                           _q(F.col("contact_id")), status, _q(F.col("message")))
        key = F.struct(F.lit(1).alias("a"), F.coalesce(F.col("line_number"), F.lit(0)).cast("bigint").alias("b"),
                       F.lit(0).cast("bigint").alias("c"))
        _write_lines(results.select(key.alias("_k"), line.alias("line")), path, "Type,Row,Email,Status,Message")
    else:
        results.write.mode("overwrite").json(path)


def export_sessions(exported: DataFrame, path: str, fmt: str = "csv"):
    """The ``sessions_export`` projection as CSV (11 columns) or JSON."""
    if fmt.lower() == "csv":
        (exported.withColumn("Started", F.date_format("Started", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
         .write.mode("overwrite").option("header", True).option("escape", '"').csv(path))
    else:
        exported.write.mode("overwrite").json(path)


# --- S14 session files, S15 checkpoints -------------------------------------------

SESSION_FILE_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("csvFile", T.StringType()),
        T.StructField("startTime", T.StringType()),
        T.StructField("endTime", T.StringType()),
        T.StructField("lastActivity", T.StringType()),
        T.StructField("options", T.StructType([T.StructField("batchSize", T.LongType()),
                                               T.StructField("rateLimit", T.LongType())])),
        T.StructField("summary", T.StructType([T.StructField(n, T.LongType())
                                               for n in ("total", "processed", "successful", "failed")])),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)


def read_sessions(spark: SparkSession, directory: str):
    """Every ``*.json`` session file; unreadable ones go to the second frame."""
    raw = (
        spark.read.schema(SESSION_FILE_SCHEMA)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .option("pathGlobFilter", "*.json")
        .json(directory)
        .withColumn("_file", F.col("_metadata.file_path"))
    )
    bad = raw.filter(F.col("_corrupt_record").isNotNull() | F.col("id").isNull()).select(
        "_file", F.lit("Unreadable session file").alias("warning"))
    good = raw.filter(F.col("_corrupt_record").isNull() & F.col("id").isNotNull()).select(
        F.col("id").alias("session_id"),
        "status",
        F.coalesce("type", F.lit("import")).alias("type"),
        F.col("csvFile").alias("csv_file"),
        F.to_timestamp("startTime").alias("start_time"),
        F.to_timestamp("endTime").alias("end_time"),
        F.to_timestamp("lastActivity").alias("last_activity"),
        F.col("summary.total").alias("total"),
        F.col("summary.processed").alias("processed"),
        F.col("summary.successful").alias("successful"),
        F.col("summary.failed").alias("failed"),
    )
    return good, bad


def write_session_file(path: str, session: dict) -> None:
    """Helper for tests and tools: one session document per file."""
    with open(path, "w", encoding="utf8") as fh:
        json.dump(session, fh)


def _bucket(session_id):
    return F.pmod(F.xxhash64(session_id.cast("string")), F.lit(CHECKPOINT_BUCKETS)).cast("int")


def append_checkpoint(state: DataFrame, path: str, mode: str = "append") -> None:
    """One immutable row per save, in a bounded number of buckets by session."""
    state.withColumn("bucket", _bucket(F.col("session_id"))).write.mode(mode).partitionBy("bucket").parquet(path)


def read_checkpoints(spark: SparkSession, path: str, session_id=None) -> DataFrame:
    """The saves, or those of one session (only its bucket is read)."""
    df = spark.read.parquet(path)
    if session_id is not None:
        df = df.filter((F.col("bucket") == _bucket(F.lit(session_id))) & (F.col("session_id") == session_id))
    return df.drop("bucket")


def delete_checkpoints(spark: SparkSession, path: str, doomed: DataFrame, new_path: str) -> DataFrame:
    """S15 delete: rewrite without the doomed keys (anti join) to ``new_path``; returns the new table."""
    left = read_checkpoints(spark, path).join(doomed.select("session_id", "checkpoint_id"), ["session_id", "checkpoint_id"], "left_anti")
    append_checkpoint(left, new_path, "overwrite")
    return read_checkpoints(spark, new_path)
