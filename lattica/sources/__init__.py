"""Reading and writing: Parquet tables, keyed JSON tables, captions, transcripts and file lists."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task, where windows and joins sort them: what a task holds stays the same for larger tables.
TASK_ROWS = 150_000


def parts_for(rows: DataFrame, most: int = TASK_ROWS, weight: Column | None = None) -> int:
    """Parts of which each has about ``most`` rows (or as much of ``weight``), at least as many as the session works on at once."""
    total = rows.agg(F.sum(F.lit(1) if weight is None else weight)).first()[0] or 0
    return max(-(-int(total) // most), rows.sparkSession.sparkContext.defaultParallelism)


def dealt(rows: DataFrame, key: str, most: int = TASK_ROWS, weight: Column | None = None) -> DataFrame:
    """The rows by key in ``parts_for`` parts, however large the table; windows and groups by the key need no further shuffle."""
    return rows.repartition(parts_for(rows, most, weight), key)


class SourceError(ValueError):
    """A refused input: a stable ``code`` and a message."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(f"{code}: {message}")
        self.code = code


#: Limits of a JSON document: nesting, values in all, and bytes of a text.
MOST_DEPTH, MOST_NODES, MOST_TEXT = 64, 1_000_000, 1 << 20


def json_fault(text: str, depth: int = MOST_DEPTH, nodes: int = MOST_NODES, size: int = MOST_TEXT) -> str | None:
    """Why a document is refused: MALFORMED, DUPLICATE_NAME, DEPTH, NODES or TEXT; None if it isn't."""

    def unique(pairs: list) -> dict:
        if len({k for k, _ in pairs}) != len(pairs):
            raise SourceError("DUPLICATE_NAME", "a name repeats")
        return dict(pairs)

    try:
        front, n = [json.loads(text, object_pairs_hook=unique)], 0
    except SourceError as e:
        return e.code
    except RecursionError:
        return "DEPTH"
    except ValueError:
        return "MALFORMED"
    for _ in range(depth):
        n += len(front)
        if n > nodes:
            return "NODES"
        if any(isinstance(x, str) and len(x.encode()) > size for x in front):
            return "TEXT"
        front = [v for x in front if isinstance(x, (dict, list)) for v in (x.values() if isinstance(x, dict) else x)]
        if not front:
            return None
    return "DEPTH"


def json_faults(files: DataFrame) -> DataFrame:
    """(path, fault) of the refused documents among ``files`` (path, value); checked in Arrow batches, a document at a time."""

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rb in batches:
            found = [(p, f) for p, v in zip(rb.column("path").to_pylist(), rb.column("value").to_pylist()) if (f := json_fault(v or ""))]
            yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in found], pa.string()), "fault": pa.array([f for _, f in found], pa.string())})

    return files.select("path", "value").mapInArrow(checked, "path string, fault string")


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def _refuse_faults(spark: SparkSession, path: str) -> None:
    """Raises SourceError for the first document, by path, that is refused."""
    if bad := json_faults(_documents(spark, path)).orderBy("path").first():
        raise SourceError(bad["fault"], f"in {bad['path']}")


def read_keyed_json(spark: SparkSession, path: str, schema: T.StructType, key: list[str]) -> DataFrame:
    """Rows of JSON documents of the form {"rows": [...]} in a declared schema, with ``_ord``; a repeated key is refused.

    Duplicate names inside one object are refused too (Spark would keep the last
    in silence), and documents that aren't JSON or are beyond the limits.
    """
    _refuse_faults(spark, path)
    rows = spark.read.schema(T.StructType([T.StructField("rows", T.ArrayType(schema))])).option("multiLine", True).option("mode", "FAILFAST").json(path)
    out = rows.select(F.posexplode("rows").alias("_ord", "row")).select("row.*", "_ord")
    if not out.groupBy(*key).count().filter("count > 1").isEmpty():
        raise SourceError("DUPLICATE_KEY", f"a key of {key} repeats in {path}")
    return out


def schema_difference(declared: T.DataType, actual: T.DataType, path: str = "$") -> str | None:
    """The first place, in declared order, where two schemas differ in names, types or nesting; None if they don't."""
    if isinstance(declared, T.StructType) and isinstance(actual, T.StructType):
        have = {f.name: f.dataType for f in actual}
        for f in declared:
            if f.name not in have:
                return f"{path}.{f.name}"
            if found := schema_difference(f.dataType, have[f.name], f"{path}.{f.name}"):
                return found
        more = [f.name for f in actual if f.name not in declared.names]
        return f"{path}.{more[0]}" if more else None
    if isinstance(declared, T.ArrayType) and isinstance(actual, T.ArrayType):
        return schema_difference(declared.elementType, actual.elementType, f"{path}[]")
    if isinstance(declared, T.MapType) and isinstance(actual, T.MapType):
        return schema_difference(declared.keyType, actual.keyType, f"{path}{{key}}") or schema_difference(declared.valueType, actual.valueType, f"{path}{{}}")
    return None if declared == actual else path


#: A transcript's words; times are fractions of a second, as texts.
WORD = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "start", "end", "text", "join", "speaker")])


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord and the fields of ``WORD``) of transcript documents {"words": [...]}, each checked as JSON first."""
    _refuse_faults(spark, path)
    rows = spark.read.schema(T.StructType([T.StructField("words", T.ArrayType(WORD))])).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.posexplode("words").alias("ord", "w")).select("path", "ord", "w.*")


def seconds(fraction: Column) -> Column:
    """A fraction n/d or n of a second as a double."""
    part = F.split(fraction, "/")
    return part[0].cast("double") / F.coalesce(F.get(part, 1), F.lit("1")).cast("double")


def transcript_faults(words: DataFrame) -> DataFrame:
    """(path, ord, fault): ids that repeat (ID), joins that are neither none nor space or join the first word (JOIN), times that
    don't go forward inside a word or from word to word (TIME)."""
    order = Window.partitionBy("path").orderBy("ord")
    times = F.count(F.lit(1)).over(Window.partitionBy("path", "id"))
    s, e = seconds(F.col("start")), seconds(F.col("end"))
    rows = words.withColumns({"_n": times, "_e": F.lag(e).over(order)})
    faults = F.array_compact(F.array(F.when(F.col("_n") > 1, "ID"), F.when(~F.col("join").isin("none", "space") | F.col("join").isNull() | ((F.col("ord") == 0) & (F.col("join") != "none")), "JOIN"), F.when((e <= s) | s.isNull() | e.isNull() | (s < F.col("_e")), "TIME")))
    return rows.select("path", "ord", F.explode(faults).alias("fault"))


_TEXTS = lambda *names: [T.StructField(n, T.StringType()) for n in names]
#: An entry of a catalog.
ENTRY = T.StructType([*_TEXTS("id", "label", "kind", "description"), T.StructField("tags", T.ArrayType(T.StringType())), *_TEXTS("downloadUrl", "sha256"), T.StructField("bytes", T.LongType()), T.StructField("provenance", T.StructType(_TEXTS("creator", "license", "licenseUrl", "sourceUrl", "attribution")))])


def sorted_fields(col: Column, kind: T.DataType) -> Column:
    """The same value with the fields of its structs in order of name, at every depth."""
    if isinstance(kind, T.StructType):
        return F.when(col.isNotNull(), F.struct(*[sorted_fields(col[n], kind[n].dataType).alias(n) for n in sorted(kind.names)]))
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: sorted_fields(x, kind.elementType))
    return col


def canonical_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row's columns as JSON with names in order and without nulls."""
    kind = T.StructType([df.schema[c] for c in columns or df.columns])
    return F.to_json(F.struct(*[sorted_fields(F.col(f"`{n}`"), kind[n].dataType).alias(n) for n in sorted(kind.names)]))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """Entries of catalog documents {"entries": [...]} with their digest; repeated ids and tags are refused."""
    _refuse_faults(spark, path)
    rows = spark.read.schema(T.StructType([T.StructField("entries", T.ArrayType(ENTRY))])).option("multiLine", True).option("mode", "FAILFAST").json(path)
    out = rows.select(F.explode("entries").alias("e")).select("e.*")
    if not out.groupBy("id").count().filter("count > 1").isEmpty() or not out.filter(F.size(F.array_distinct("tags")) < F.size("tags")).isEmpty():
        raise SourceError("DUPLICATE", f"an id or a tag of an entry repeats in {path}")
    return out.withColumn("digest", F.sha2(canonical_json(out), 256))


def write_report(df: DataFrame, path: str) -> None:
    """Rows as lines of canonical JSON, published at once: written beside ``path``, then renamed; an older report gives way."""
    spark, fresh = df.sparkSession, f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.select(canonical_json(df).alias("value")).write.option("lineSep", "\n").text(fresh)
    jvm = spark._jvm.org.apache.hadoop.fs
    files = jvm.Path(fresh).getFileSystem(spark._jsc.hadoopConfiguration())
    files.delete(jvm.Path(path), True)
    if not files.rename(jvm.Path(fresh), jvm.Path(path)):
        raise SourceError("PUBLISH", f"{fresh} can't be renamed to {path}")


def verified_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below a folder with length and SHA-256, ordered by path where they are shown."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", F.col("length").alias("n_bytes"), F.sha2("content", 256).alias("sha256"))


def file_faults(files: DataFrame, declared: DataFrame) -> DataFrame:
    """(path, fault) of files (path, n_bytes, sha256) against declared ones: MISSING, UNDECLARED, LENGTH or DIGEST."""
    both = declared.select("path", F.col("n_bytes").alias("_n"), F.col("sha256").alias("_d"), F.lit(True).alias("_declared")).join(files.withColumn("_there", F.lit(True)), "path", "full_outer")
    fault = F.when(F.col("_there").isNull(), "MISSING").when(F.col("_declared").isNull(), "UNDECLARED").when(~F.col("_n").eqNullSafe(F.col("n_bytes")), "LENGTH").when(~F.col("_d").eqNullSafe(F.col("sha256")), "DIGEST")
    return both.select("path", fault.alias("fault")).filter("fault is not null")


#: hh:mm:ss.mmm or mm:ss.mmm, comma or point
_TIME = r"(?:(\d+):)?(\d{2}):(\d{2})[.,](\d{3})"


def _millis(text, pattern: str, first: int):
    part = lambda i: F.regexp_extract(text, pattern, first + i)
    hours = F.when(part(0) == "", 0).otherwise(part(0).cast("long"))
    return ((hours * 60 + part(1).cast("long")) * 60 + part(2).cast("long")) * 1000 + part(3).cast("long")


def parse_captions(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Cues of WebVTT or SRT texts: id, cue number, start and end in ms, lines, and whether it begins before the last ended."""
    line = rf"{_TIME} --> {_TIME}"
    blocks = texts.select(id_col, F.posexplode(F.split(F.regexp_replace(F.col(text_col), "\r\n?", "\n"), r"\n\n+")).alias("at", "block")).filter(F.col("block").rlike(line))
    cues = blocks.select(id_col, "at", _millis(F.col("block"), line, 1).alias("start_ms"), _millis(F.col("block"), line, 5).alias("end_ms"), F.split(F.regexp_extract("block", rf"(?s){line}[^\n]*\n(.*?)\n*$", 9), "\n").alias("lines"))
    order = Window.partitionBy(id_col).orderBy("at")
    return cues.select(id_col, F.row_number().over(order).alias("cue"), "start_ms", "end_ms", "lines", F.coalesce(F.col("start_ms") < F.lag("end_ms").over(order), F.lit(False)).alias("overlaps"))


def vtt_time(ms):
    """Whole milliseconds as hh:mm:ss.mmm."""
    pad = lambda x, n: F.lpad(F.floor(x).cast("string"), n, "0")
    return F.concat(pad(ms / 3600000, 2), F.lit(":"), pad(ms / 60000 % 60, 2), F.lit(":"), pad(ms / 1000 % 60, 2), F.lit("."), pad(ms % 1000, 3))


def cue_faults(cues: DataFrame, id_col: str) -> DataFrame:
    """(id, cue, fault) of cues in order: no positive length (TIME), begun before the last one's end (OVERLAP), no text (TEXT)."""
    before = F.lag("end_ms").over(Window.partitionBy(id_col).orderBy("cue"))
    faults = F.array_compact(F.array(F.when(F.col("end_ms") <= F.col("start_ms"), "TIME"), F.when(F.col("start_ms") < before, "OVERLAP"), F.when(F.size(F.filter("lines", lambda x: F.trim(x) != "")) < 1, "TEXT")))
    return cues.withColumn("_f", faults).select(id_col, "cue", F.explode("_f").alias("fault"))


def caption_texts(cues: DataFrame, id_col: str) -> DataFrame:
    """(id, text): cues as WebVTT; a track is one text, so its cues are gathered, as they were when it was parsed."""
    block = F.concat(vtt_time(F.col("start_ms")), F.lit(" --> "), vtt_time(F.col("end_ms")), F.lit("\n"), F.array_join("lines", "\n"))
    per = cues.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("cue", block.alias("b")))).alias("all"))
    return per.select(id_col, F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("all", lambda x: x["b"]), "\n\n"), F.lit("\n")).alias("text"))


# --- queries


def _turn_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as cues of 1.5 to 2.4 seconds every two."""
    c = read(spark, sf_dir, "conversations").filter("length(trim(text)) > 0").select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("cue"), F.regexp_replace("text", "\n+", "\n").alias("text"))
    start = (F.col("cue") * 2000).cast("long")
    return c.select("conv_id", "cue", start.alias("start_ms"), (start + 1500 + F.col("cue") * 300 % 1200).alias("end_ms"), F.split(F.trim(F.col("text")), "\n").alias("lines"))


def caption_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues written as WebVTT texts and parsed again."""
    cues = parse_captions(caption_texts(_turn_cues(spark, sf_dir), "conv_id"), "conv_id", "text")
    return cues.select("conv_id", "cue", "start_ms", "end_ms", F.array_join("lines", "|").alias("lines"), "overlaps")


def caption_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cue_faults(_turn_cues(spark, sf_dir), "conv_id")


QUERIES = {f.__name__: f for f in (caption_parse, caption_order)}

_C = """c AS (SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS cue, trim(regexp_replace(text, '\n+', chr(10), 'g')) AS text FROM conversations WHERE length(trim(text)) > 0),
t AS (SELECT *, CAST(cue * 2000 AS BIGINT) AS s, CAST(cue * 2000 + 1500 + cue * 300 % 1200 AS BIGINT) AS e FROM c)"""
ORACLES = {
    "caption_parse": f"WITH {_C} SELECT conv_id, cue, s AS start_ms, e AS end_ms, replace(text, chr(10), '|') AS lines, coalesce(s < lag(e) OVER (PARTITION BY conv_id ORDER BY cue), false) AS overlaps FROM t",
    "caption_order": f"WITH {_C}, l AS (SELECT *, lag(e) OVER (PARTITION BY conv_id ORDER BY cue) AS b FROM t) SELECT conv_id, cue, 'OVERLAP' AS fault FROM l WHERE s < b",
}
