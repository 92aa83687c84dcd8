"""File trees, text lines and file names as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cratewright.functions import keys, paths

AUDIO = (".mp3", ".flac", ".wav", ".aiff", ".aif", ".m4a", ".ogg", ".opus", ".wma")


def listing(spark: SparkSession, root: str, extensions: tuple[str, ...] = AUDIO, excluded: tuple[str, ...] = (), content: bool = False) -> DataFrame:
    """(path, size_bytes, ext, mtime) of all files below ``root``, with sha256 and md5 if their content is read.

    Hidden folders and excluded ones are left out.  Without content only the
    listing is read, as columns are pruned.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.col("path"), "^file:/*", "/")
    df = raw.select(path.alias("path"), F.col("length").alias("size_bytes"), paths.extension(path).alias("ext"), F.col("modificationTime").alias("mtime"), *([F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5")] if content else []))
    df = df.where(~F.substr(F.col("path"), F.lit(len(root.rstrip("/")) + 1)).rlike(r"/\."))
    if extensions:
        df = df.where(F.col("ext").isin(*extensions))
    return df.where(~paths.under_any(F.col("path"), list(excluded))) if excluded else df


def size_class(size: Column) -> Column:
    """Files by size: up to 50, 100, 200, 500 MiB, or more."""
    mb = size / (1 << 20)
    return F.when(mb <= 50, "0-50").when(mb <= 100, "50-100").when(mb <= 200, "100-200").when(mb <= 500, "200-500").otherwise("500+")


def newest(files: DataFrame) -> DataFrame:
    return files.agg(F.max_by("path", F.struct("mtime", "path")).alias("path"))


def candidates(names: Column) -> Column:
    """The (artist, title) pairs a file stem may stand for: both sides of a dash, in both orders, else the title alone."""
    m = r"^(.+?)\s*[-–—]\s*(.+)$"
    a, b = F.trim(F.regexp_extract(names, m, 1)), F.trim(F.regexp_extract(names, m, 2))
    pair = lambda x, y: F.struct(x.alias("artist"), y.alias("title"))
    return F.when(names.rlike(m), F.array(pair(a, b), pair(b, a))).otherwise(F.array(pair(F.lit(""), F.trim(names))))


def file_index(files: DataFrame, wanted: DataFrame, key: str = "key") -> DataFrame:
    """(key, path): the first file by path whose name gives a wanted song key."""
    rows = files.select("path", F.explode(candidates(paths.stem(F.col("path")))).alias("c")).select("path", keys.cut_key(F.col("c.artist"), F.col("c.title")).alias(key))
    return rows.join(wanted.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.min("path").alias("path"))


def attribute_lines(spark: SparkSession, path: str, attribute: str) -> DataFrame:
    """(value, line) of one attribute in the raw lines of an XML file."""
    return spark.read.text(path).select(F.regexp_extract("value", rf'\b{attribute}="([^"]*)"', 1).alias("value"), F.col("value").alias("line")).where("value <> ''")


def patch_attribute(line: Column, attribute: str, value: Column) -> Column:
    before = F.regexp_extract(line, rf'^(.*?\b{attribute}=")[^"]*".*$', 1)
    after = F.regexp_extract(line, rf'^.*?\b{attribute}="[^"]*(".*)$', 1)
    return F.when(before != "", F.concat(before, value, after)).otherwise(line)


def below(folders: DataFrame, root: str) -> DataFrame:
    """(id, depth) of all folders below one, by breadth-first search over (id, parent); each once, cycles end."""
    from cratewright.session import cut

    seen = folders.sparkSession.createDataFrame([(root, 0)], "id string, depth int")
    front, depth = seen, 0
    while True:
        depth += 1
        front = cut(folders.join(front.select(F.col("id").alias("parent")), "parent").select("id").distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))
