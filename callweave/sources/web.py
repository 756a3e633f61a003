"""Sources and sinks of a crawled corpus: sitemaps, robots rules, categories, cache names, manifests, audio."""

from __future__ import annotations

import io
import time
import urllib.robotparser
import wave
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """url of each <loc> of sitemap files."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string").load(path).select(F.trim("loc").alias("url"))


def url_path(url: Column) -> Column:
    """The path without the slashes at its start; of any text, however malformed. A last segment's `;parameters` are no
    part of it."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(path, ";[^/]*$", ""), "^/+", "")


def categorise(url: Column, sections: Sequence[tuple[str, str]], noise: str | None = None) -> Column:
    """Category of the first section whose prefix the path has, then `noise` for the noise prefix, else null."""
    p = url_path(url)
    out = F.lit(None).cast("string")
    if noise:
        out = F.when(p.startswith(noise), "noise").otherwise(out)
    for prefix, category in reversed(sections):
        out = F.when(p.startswith(prefix), category).otherwise(out)
    return out


def select_urls(urls: DataFrame, url: str, sections: Sequence[tuple[str, str]], noise: str | None, sample: int) -> DataFrame:
    """All pages of the sections, and the first `sample` noise pages by url."""
    c = urls.withColumn("category", categorise(F.col(url), sections, noise))
    return c.filter("category <> 'noise'").unionByName(c.filter("category = 'noise'").orderBy(url).limit(sample))


class Robots:
    """Policy of a robots.txt answer: 200 is parsed, 401 and 403 deny all, other errors allow all, no answer denies all."""

    def __init__(self, status: int | None, body: str = ""):
        self.rules = urllib.robotparser.RobotFileParser()
        self.rules.parse(body.splitlines() if status == 200 else [])
        self.rules.disallow_all = status is None or status in (401, 403)
        self.rules.allow_all = status is not None and status >= 400 and status not in (401, 403)

    def allowed(self, url: Column, agent: str) -> Column:
        rules = self.rules

        @F.pandas_udf("boolean")
        def can(s):  # noqa: ANN001, ANN202
            return s.map(lambda u: rules.can_fetch(agent, u or ""))

        return can(url)


def audit_robots(urls: DataFrame, url: str, rules: Robots, agent: str) -> tuple[DataFrame, DataFrame]:
    """(allowed, blocked) rows of urls; the rules are asked once a row."""
    asked = urls.withColumn("__ok", rules.allowed(F.col(url), agent))
    return asked.filter("__ok").drop("__ok"), asked.filter("NOT __ok").drop("__ok")


def cache_name(url: Column) -> Column:
    """`path__digest.html`: slashes of the path as underscores, 70 characters at most, `index` for none."""
    slug = F.substring(F.translate(F.regexp_replace(url_path(url), "/+$", ""), "/", "_"), 1, 70)
    return F.concat(F.when(slug == "", "index").otherwise(slug), F.lit("__"), F.substring(F.sha2(url, 256), 1, 16), F.lit(".html"))


def fetch_status(code: Column, body: Column, least: int = 2000) -> Column:
    """ok, too_small, http_error or network_error."""
    return F.when(code.isNull(), "network_error").when(code != 200, "http_error").when(F.length(F.coalesce(body, F.lit(""))) < least, "too_small").otherwise("ok")


#: Answers that no further try would change. Fixed values.
PERMANENT = (404, 410)


def fetch(urls: DataFrame, cached: DataFrame, get: Callable[[str], tuple[int, str]], retries: int = 2, wait_s: float = 1.5) -> DataFrame:
    """url, cache_file, status, http_status, size, error, html of each url. One whose cache_file is among `cached`
    (cache_file, html) is not asked for again. `get` gives (status code, body) or raises; tasks try it 1 + retries times,
    waiting longer each time, but once for a permanent answer."""
    named = urls.select("url", cache_name(F.col("url")).alias("cache_file")).distinct()
    have = named.join(cached.filter(F.length("html") > 0).select("cache_file", "html"), "cache_file")
    shape = "url string, cache_file string, status string, http_status int, size int, error string, html string"

    def ask(url: str) -> tuple[str, int | None, int, str, str | None]:
        code, error = None, ""
        for attempt in range(1, retries + 2):
            try:
                code, body = get(url)
                if code == 200:
                    return ("ok" if len(body) >= 2000 else "too_small", code, len(body), "", body if len(body) >= 2000 else None)
                error = f"HTTP {code}"
            except Exception as e:  # whatever a client raises is a failed try
                code, error = None, f"{type(e).__name__}: {e}"
            if code in PERMANENT:
                break
            if attempt <= retries:
                time.sleep(wait_s * attempt)
        return "http_error" if error.startswith("HTTP") else "network_error", None, 0, error, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [ask(u) for u in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(x, t) for x, t in zip(zip(*got, strict=True) if got else [[]] * 5, (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)]], names=[c.split()[0] for c in shape.split(", ")])

    fresh = named.join(have.select("cache_file"), "cache_file", "left_anti").select("url", "cache_file").mapInArrow(run, shape)
    known = have.select("url", "cache_file", F.lit("cached").alias("status"), F.lit(200).alias("http_status"), F.length("html").cast("int").alias("size"), F.lit("").alias("error"), "html")
    return known.unionByName(fresh)


def usable_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path).filter(F.col("status").isin("ok", "cached"))


def html_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("cache_file"), F.col("value").alias("html"))


def missing_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    return manifest.join(files, "cache_file", "left_anti")


def write_partitioned(df: DataFrame, path: str, by: str = "source_key") -> None:
    """One folder a corpus; writing one corpus again leaves the others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_records(records: DataFrame, report: DataFrame, path: str, by: str = "source_key") -> None:
    """Clean records and their cleaning report (rows of steps), side by side, a folder a corpus each."""
    write_partitioned(records, f"{path}/records", by)
    report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).json(f"{path}/report")


def upsert(new: DataFrame, path: str, key: str, at: str | None = None) -> DataFrame:
    """The table at path with the rows of new in place of those of the same key (the latest by `at` if new repeats one),
    written beside the old version, of which the newest number counts; a failed write leaves the old one in force."""
    spark = new.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    versions = sorted(int(f.getPath().getName()[1:]) for f in fs.listStatus(fs_path) if f.getPath().getName()[1:].isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f.getPath(), "_SUCCESS"))) if fs.exists(fs_path) else []
    w = Window.partitionBy(key).orderBy(*([F.desc(at)] if at else [F.lit(1)]))
    latest = new.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")
    old = spark.read.parquet(f"{path}/v{versions[-1]}").join(latest.select(key), key, "left_anti") if versions else latest.limit(0)
    out = f"{path}/v{versions[-1] + 1 if versions else 0}"
    latest.unionByName(old.select(*latest.columns)).write.mode("overwrite").parquet(out)
    for v in versions[:-1]:  # the version before stays for readers that have begun
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/v{v}"), True)
    return spark.read.parquet(out)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_escalations(rows: DataFrame, path: str, post: Callable[[str], None] | None = None, mode: str = "append") -> None:
    """Escalations as JSON in path, always; `post` gets each one's JSON as well, and what it raises is written beside it
    (webhook_delivered, webhook_error), so that no caller is lost with a failed request."""
    body = F.to_json(F.struct(*rows.columns))
    shape = rows.schema.simpleString()
    if post is None:
        rows.withColumn("webhook_delivered", F.lit(False)).withColumn("webhook_error", F.lit("")).write.mode(mode).json(path)
        return

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            errors = []
            for x in b.column(0).to_pylist():
                try:
                    post(x)
                    errors.append("")
                except Exception as e:
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([not e for e in errors]), pa.array(errors, pa.string())], names=["body", "ok", "error"])

    sent = rows.select(body.alias("body")).mapInArrow(run, "body string, ok boolean, error string")
    sent.select(F.from_json("body", shape).alias("r"), F.col("ok").alias("webhook_delivered"), F.col("error").alias("webhook_error")).select("r.*", "webhook_delivered", "webhook_error").write.mode(mode).json(path)


def frames(files: DataFrame, rate: int = 16_000, frame_s: float = 0.1) -> DataFrame:
    """call, speaker, frame, rms, samples of WAV files (path, content): the left channel is the agent, the right the
    caller, one channel is unattributed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with wave.open(io.BytesIO(content.as_py())) as w:
                    x = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
                    step = int(w.getframerate() * frame_s)
                names = ["agent", "caller"] if x.shape[1] == 2 else ["unattributed"]
                for k, who in enumerate(names):
                    parts = [x[i : i + step, k] for i in range(0, len(x), step)]
                    yield pa.RecordBatch.from_arrays([pa.array([path.rsplit("/", 1)[-1]] * len(parts)), pa.array([who] * len(parts)), pa.array(np.arange(len(parts)), pa.int32()), pa.array([float(np.sqrt(np.mean(p.astype(np.float32) ** 2))) for p in parts]), pa.array([p.tolist() for p in parts], pa.list_(pa.int16()))], names=["call", "speaker", "frame", "rms", "samples"])

    return files.select("path", "content").mapInArrow(run, "call string, speaker string, frame int, rms double, samples array<short>")
