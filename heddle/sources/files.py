"""File sources and sinks: compile databases, directory scans, sessions, cards, pages, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators.governance import PUBLIC_SOURCE, message_fault

# Extensions and their languages; compiler flags that are dropped, alone or with their value; folders not scanned.
SOURCES = {"c": ("c", "m"), "cpp": ("cc", "cpp", "cxx", "c++")}
HEADERS = ("h", "hh", "hpp", "hxx", "inc")
ALONE, WITH_VALUE = ("-c",), ("-o", "-MF", "-MT", "-MQ")
IGNORED = ("build", ".git", "test", "tests")
LONGEST_SPAN, LONGEST_READ = 160, 300

SESSION = "schema_version int, id string, source_type string, source_ref string, license string, repository string, revision string, messages array<struct<role: string, knowledge_role: string, content: string>>"
CARD = "title string, symptom string, root_cause string, fix_steps string, verification string, related_symbols array<string>, confidence double, evidence_tags array<string>"


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def language_of(path: Column | str) -> Column:
    """The language of a source file by its extension, `header` for headers, null where unknown."""
    ext = extension(path)
    out = F.when(ext.isin(*HEADERS), "header")
    for name, exts in SOURCES.items():
        out = out.when(ext.isin(*exts), name)
    return out


def basename(path: Column | str) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def clean_args(args: Column | str, source: Column | str) -> Column:
    """Compiler arguments without the compiler, outputs, dependency options and the source itself (by its file name); the order stays."""
    args = F.col(args) if isinstance(args, str) else args
    source = F.col(source) if isinstance(source, str) else source
    # A flag's value is dropped with it; of several such flags in a row, every second one is a value.
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("skip"))

    def step(acc: Column, a: Column) -> Column:
        value = ~acc["skip"] & a.isin(*WITH_VALUE)
        drop = acc["skip"] | value | a.isin(*ALONE) | a.startswith("-M") | (basename(a) == basename(source))
        return F.struct(F.when(drop, acc["kept"]).otherwise(F.array_append(acc["kept"], a)).alias("kept"), value.alias("skip"))

    return F.aggregate(F.slice(args, 2, F.greatest(F.size(args) - 1, F.lit(0))), start, step)["kept"]


def compile_db(spark: SparkSession, path: str) -> DataFrame:
    """file (absolute), directory, args, language: the units of a JSON array of compile commands."""
    raw = spark.read.schema("directory string, file string, command string, arguments array<string>").json(path, multiLine=True)
    args = F.when(F.size("arguments") > 0, F.col("arguments")).otherwise(F.split(F.trim("command"), r"\s+"))
    file = F.when(F.col("file").startswith("/"), F.col("file")).otherwise(F.concat_ws("/", F.regexp_replace("directory", "/+$", ""), "file"))
    rows = raw.withColumn("file", file)
    return rows.select("file", "directory", clean_args(args, "file").alias("args"), language_of("file").alias("language"))


def scan(spark: SparkSession, root: str, ignored: tuple[str, ...] = IGNORED) -> DataFrame:
    """path, length, language of source files under `root` (no headers); contents are not read, folders are judged below `root`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    inside = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    keep = F.lit(True)
    for name in ignored:
        keep = keep & ~F.concat(F.lit("/"), inside).contains(f"/{name}/")
    return files.where(keep).withColumn("language", language_of("path")).where(F.col("language").isin(*SOURCES))


def load(spark: SparkSession, root: str, database: str | None = None) -> DataFrame:
    """file, directory, args, language, degraded: the compile database where it has units, else a scan of `root` without arguments."""
    if database is not None:
        units = compile_db(spark, database)
        if not units.isEmpty():
            return units.withColumn("degraded", F.lit(False))
    found = scan(spark, root)
    return found.select(F.col("path").alias("file"), F.lit(root).alias("directory"), F.array().cast("array<string>").alias("args"), "language", F.lit(True).alias("degraded"))


def read_span(text: Column | str, first: Column | int, last: Column | int, most: int = LONGEST_SPAN) -> Column:
    """Lines `first` to `last` (from 1, inclusive) of a text, cut `most` lines behind the first."""
    first, last = (F.lit(x) if isinstance(x, int) else x for x in (first, last))
    n = F.least(last, first + most) - first + 1
    return F.array_join(F.slice(F.split(text, "\n"), first, F.greatest(n, F.lit(0))), "\n")


def code_range(rows: DataFrame, text: str, first: str, last: str, most: int = LONGEST_READ) -> DataFrame:
    """`rows` with status, body and next_line: a range outside the text is an error, a long one is read in parts."""
    lines = F.size(F.split(text, "\n"))
    status = F.when(F.col(text).isNull(), "missing").when((F.col(first) < 1) | (F.col(last) < F.col(first)) | (F.col(last) > lines), "out_of_range").when(F.col(last) - F.col(first) + 1 > most, "partial").otherwise("ok")
    judged = rows.withColumn("status", status)
    good = F.col("status").isin("ok", "partial")
    stop = F.least(F.col(last), F.col(first) + most - 1)
    return judged.select("*", F.when(good, read_span(text, F.col(first), stop, most)).alias("body"), F.when(F.col("status") == "partial", stop + 1).alias("next_line"))


def sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined with `reason`) sessions of JSON files; contents of accepted ones are trimmed."""
    raw = spark.read.schema(SESSION).json(path, multiLine=True)
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    reason = F.when(F.coalesce(F.col("schema_version"), F.lit(0)) != 1, "schema_version")
    for c in ("id", "source_ref", "license", "repository", "revision"):
        reason = reason.when(blank(c), f"no_{c}")
    reason = reason.when(F.coalesce(F.size("messages"), F.lit(0)) < 1, "no_messages").when(F.coalesce(F.col("source_type"), F.lit("")) != PUBLIC_SOURCE, "source_type")
    faults = F.array_compact(F.transform("messages", lambda m: message_fault(m["role"], m["content"], m["knowledge_role"])))
    judged = raw.withColumn("reason", F.coalesce(reason, F.get(faults, F.lit(0))))
    trimmed = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), m["knowledge_role"].alias("knowledge_role"), F.trim(m["content"]).alias("content")))
    return judged.where("reason is null").drop("reason").withColumn("messages", trimmed), judged.where("reason is not null")


def cards(spark: SparkSession, path: str) -> DataFrame:
    """Cards of JSON lines with `status` (imported, skipped or failed); a bad line spoils no other."""
    raw = spark.read.schema(CARD + ", _bad string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    status = F.when(F.col("_bad").isNotNull(), "failed").when(F.coalesce(F.col("title"), F.lit("")) == "", "skipped").otherwise("imported")
    return raw.withColumn("status", status).drop("_bad")


def markdown_cards(spark: SparkSession, path: str) -> DataFrame:
    """path, meta (map), body, intact: Markdown with a JSON front matter that holds the body's SHA-256."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    front = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n", 1)
    body = F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", "")
    rows = raw.select("path", F.from_json(front, "map<string,string>").alias("meta"), body.alias("body"))
    return rows.withColumn("intact", F.coalesce(F.col("meta")["sha256"] == F.sha2(F.col("body").cast("binary"), 256), F.lit(False)))


def write_snapshot(tables: dict[str, DataFrame], root: str, version: str) -> DataFrame:
    """Writes the tables of a version, then its manifest (table, rows, checksum); readers need the manifest."""
    spark = next(iter(tables.values())).sparkSession
    parts = []
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{version}/{name}")
        back = spark.read.parquet(f"{root}/{version}/{name}")
        parts.append(checksum(back).select(F.lit(name).alias("table"), "rows", "checksum"))
    manifest = parts[0]
    for p in parts[1:]:
        manifest = manifest.unionByName(p)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{root}/{version}/_manifest")
    return spark.read.parquet(f"{root}/{version}/_manifest")


def checksum(df: DataFrame) -> DataFrame:
    """rows, checksum of a table, whatever its order."""
    h = F.xxhash64(*[F.to_json(F.struct(c)) for c in sorted(df.columns)])
    total = F.sum(F.pmod(h, F.lit(1 << 40)).cast("decimal(20,0)")) % F.lit(1 << 62).cast("decimal(20,0)")  # equal rows cancel in the other part, not here
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.bit_xor(h).bitwiseXOR(total.cast("bigint")), F.lit(0)).alias("checksum"))


def read_snapshot(spark: SparkSession, root: str, version: str, name: str, verify: bool = False) -> DataFrame:
    """A table of a version; with `verify` its rows and checksum are compared with the manifest first."""
    df = spark.read.parquet(f"{root}/{version}/{name}")
    if verify:
        held = spark.read.parquet(f"{root}/{version}/_manifest").where(F.col("table") == name).select("rows", "checksum").first()
        if held is None or tuple(held) != tuple(checksum(df).first()):
            raise ValueError(f"snapshot {version}/{name} differs from its manifest")
    return df


def pointers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the pointers whose writing ended, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_active")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(path)] if fs.exists(path) else []
    exists = lambda n: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/_active/{n}/_SUCCESS"))
    return sorted(int(n[2:]) for n in names if n.startswith("n=") and exists(n))


def set_pointer(spark: SparkSession, root: str, version: str | None, previous: str | None) -> None:
    """A further pointer beside the earlier ones: readers take the last complete one, so there is one at any time."""
    number = max(pointers(spark, root), default=-1) + 1
    spark.createDataFrame([(version, previous)], "version string, previous string").coalesce(1).write.json(f"{root}/_active/n={number:08d}")


def active(spark: SparkSession, root: str) -> tuple[str | None, str | None]:
    """(active version, the one before it), nulls where none was activated."""
    known = pointers(spark, root)
    if not known:
        return None, None
    row = spark.read.schema("version string, previous string").json(f"{root}/_active/n={known[-1]:08d}").first()
    return row["version"], row["previous"]


def activate(spark: SparkSession, root: str, version: str) -> None:
    """Make a version the one that readers get, after every table was compared with its manifest."""
    for r in spark.read.parquet(f"{root}/{version}/_manifest").collect():  # one row a table
        read_snapshot(spark, root, version, r["table"], verify=True)
    set_pointer(spark, root, version, active(spark, root)[0])


def rollback(spark: SparkSession, root: str) -> str:
    """Back to the version before the active one."""
    now, before = active(spark, root)
    if before is None:
        raise ValueError("there is no earlier version")
    set_pointer(spark, root, before, now)
    return before


def pinned(spark: SparkSession, root: str, version: str | None = None):
    """A reader of tables of one version, by default the active one: later activations don't change what it reads."""
    version = version or active(spark, root)[0]
    if version is None:
        raise ValueError("no version is active")
    return lambda name: read_snapshot(spark, root, version, name)
