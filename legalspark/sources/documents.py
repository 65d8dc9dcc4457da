"""Reading documents and links, landing downloads, writing results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..schema import LINKS, RAW_UNIT

LEAST_PAGE = 1000
CSV_SOURCE = "candidate_csv"


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, source_file, html, celex) of a folder of HTML files; the file's name without its ending is the id."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("html"))
    return rows.select(stem(F.col("source_file")).alias("doc_id"), "source_file", "html", F.lit(None).cast("string").alias("celex"))


def stem(path):
    return F.regexp_replace(F.regexp_replace(path, "^.*/", ""), r"(?<=.)\.[^.]*$", "")


def inline_html(rows: DataFrame, html_col: str = "html", id_col: str = "doc_id") -> DataFrame:
    """Documents from a column; source_file and celex are taken over if there, else blank and null."""
    have = set(rows.columns)
    return rows.select(
        F.col(id_col).cast("string").alias("doc_id"), (F.col("source_file") if "source_file" in have else F.lit("")).alias("source_file"), F.col(html_col).alias("html"),
        (F.col("celex") if "celex" in have else F.lit(None).cast("string")).alias("celex"),
    )


def links_json(spark: SparkSession, path: str) -> DataFrame:
    """Links, one JSON object a line; blank lines are skipped, a broken one is an error."""
    return spark.read.schema(LINKS).option("mode", "FAILFAST").json(path)


def links_csv(spark: SparkSession, path: str) -> DataFrame:
    """Links of a CSV file with a header, in the shape of the JSON ones; values are trimmed."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    trimmed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    return rows.select(*(trimmed(F.col(c)).alias(n) for c, n in (("url", "url"), ("celex", "celex"), ("title", "title"), ("category", "category_hint"))), F.lit(CSV_SOURCE).alias("source"))


def convert_links(spark: SparkSession, csv: str, json: str) -> int:
    """Writes the links of a CSV file as JSON lines; gives their number."""
    rows = links_csv(spark, csv)
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(json)
    return spark.read.schema(LINKS).json(json).count()


def sliced(rows: DataFrame, order: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Rows offset .. offset + limit in the order of a column."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    out = rows.orderBy(order).offset(offset)
    return out if limit is None else out.limit(limit)


DOWNLOAD = T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("status", T.StringType()), T.StructField("error", T.StringType()), T.StructField("final_url", T.StringType()), T.StructField("bytes_written", T.LongType()), T.StructField("method", T.StringType()), T.StructField("html", T.StringType())])
Fetch = Callable[[str], tuple[str, str]]


class HttpError(Exception):
    """A page that the server refused, with its status code."""

    def __init__(self, code: int):
        super().__init__(f"HTTP {code}")
        self.code = code


def http_fetch(url: str, timeout: float = 60) -> tuple[str, str]:
    """(html, final url) by the standard library."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers={"User-Agent": "Mozilla/5.0"}), timeout=timeout) as r:  # noqa: S310 - the caller's links
            return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace"), r.geturl()
    except HTTPError as e:
        raise HttpError(e.code) from e


def browser_fetch(url: str, timeout: float = 60, selector_timeout: float = 30) -> tuple[str, str]:
    """(html, final url) of the page as a browser renders it; needs playwright, else ImportError."""
    from playwright.sync_api import sync_playwright

    with sync_playwright() as p:
        browser = p.chromium.launch(headless=True)
        try:
            page = browser.new_page()
            page.goto(url, wait_until="domcontentloaded", timeout=1000 * timeout)
            page.wait_for_selector("body", timeout=1000 * selector_timeout)
            return page.content(), page.url
        finally:
            browser.close()


#: Tried in this order by default.
METHODS: tuple[tuple[str, Fetch], ...] = (("browser", browser_fetch), ("http", http_fetch))


def fetched(url: str, methods: tuple[tuple[str, Fetch], ...]) -> dict[str, object]:
    """A ``download`` struct: the first method that gives a page, or the last one's failure. Raises nothing."""
    row: dict[str, object] = {}
    for method, fetch in methods:
        row = dict.fromkeys(DOWNLOAD.names) | {"ok": False, "method": method}
        try:
            html, final = fetch(url)
        except ImportError as e:
            row |= {"status": f"{method}_missing", "error": str(e)}
        except HttpError as e:
            row |= {"status": f"http_{e.code}", "error": str(e)}
        except Exception as e:  # noqa: BLE001 - any failure of one page is that page's status
            row |= {"status": "navigation_error", "error": str(e)}
        else:
            if len(html or "") >= LEAST_PAGE:
                return row | {"ok": True, "status": "ok", "final_url": final, "bytes_written": len(html), "html": html}
            row |= {"status": "content_too_short", "final_url": final}
    return row


def landed(links: DataFrame, fetch: Fetch | None = None, already: DataFrame | None = None, lang: str = "EN", method: str = "fetch", methods: tuple[tuple[str, Fetch], ...] | None = None) -> DataFrame:
    """Links with a ``download`` struct; fetch(url) -> (html, final url) is called on the executors.

    ``methods`` (name, fetch) are tried in order until one gives a page; ``fetch`` alone is one of them. Pages in
    ``already`` (key, html) of more than LEAST_PAGE characters are not fetched again but taken as they are, with the
    status already_downloaded. A page that is too short has the status content_too_short, an exception that of its
    kind. Nothing fails as a whole.
    """
    tried = methods or ((method, fetch),) if fetch is not None else methods or METHODS
    keyed = links.withColumns({"key": X.file_key(F.col("celex"), F.col("url")), "fetch_url": X.language_url(F.col("url"), lang)})
    schema = T.StructType([*keyed.schema.fields, T.StructField("download", DOWNLOAD)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        for b in batches:
            out = [fetched(url, tried) for url in b.column("fetch_url").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, to_arrow_type(DOWNLOAD))], names=[*b.schema.names, "download"])

    if already is None:
        return keyed.mapInArrow(run, schema)
    known = already.where(F.length("html") > LEAST_PAGE).groupBy("key").agg(F.first("html").alias("__html"))
    kept = F.struct(F.lit(True).alias("ok"), F.lit("already_downloaded").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("final_url"), F.length("__html").cast("bigint").alias("bytes_written"), F.lit("cache").alias("method"), F.col("__html").alias("html"))
    cached = keyed.join(known, "key").select(*keyed.columns, kept.alias("download"))
    return cached.unionByName(keyed.join(known, "key", "left_anti").select(*keyed.columns).mapInArrow(run, schema))


def relative_to(path, root: str):
    """A path under a root folder as seen from it; others as they are."""
    top = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(top)), F.substring(path, F.lit(len(top) + 1), F.length(path))).otherwise(path)


def payload_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, source_file, payload) of JSON files; the file's name without its ending is the id."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("payload"))
    return rows.select(stem(F.col("source_file")).alias("doc_id"), "source_file", "payload")


def checked_payloads(rows: DataFrame) -> DataFrame:
    """(doc_id, payload, fault): null, or why it is no payload: its root must be an object, its ``units`` a list."""
    whole = F.try_parse_json("payload")
    root, units = F.schema_of_variant(whole), F.schema_of_variant(F.try_variant_get(whole, "$.units", "variant"))
    fault = (
        F.when(whole.isNull(), F.lit("not JSON"))
        .when(~F.coalesce(root.startswith("OBJECT"), F.lit(False)), F.lit("expected object root with key 'units'"))
        .when(~F.coalesce(units.startswith("ARRAY"), F.lit(False)), F.lit("key 'units' must be a list"))
    )
    return rows.select("doc_id", "payload", fault.alias("fault"))


def units_of_payloads(rows: DataFrame) -> DataFrame:
    """(doc_id, pos, unit columns) of the sound payloads (doc_id, payload, fault)."""
    fields = T.StructType([f for f in RAW_UNIT.fields if f.name not in ("pos", "subparagraph_above")])
    kind = T.StructType([T.StructField("units", T.ArrayType(fields))])
    each = rows.where("fault is null").select("doc_id", F.posexplode(F.from_json("payload", kind)["units"]).alias("pos", "u"))
    return each.select("doc_id", "pos", "u.*")


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines in which every field is present, null or not."""
    rows.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_results(results: DataFrame, folder: str, tag: str | None = None) -> None:
    """Successes and failures as two folders; with a tag also a copy under it, unfit characters replaced by _."""
    rows = results.withColumn("outcome", F.when(F.col("passed"), F.lit("success")).otherwise(F.lit("failures")))
    places = [folder] if tag is None else [folder, f"{folder}/snapshots/{''.join(c if c.isalnum() or c in '-_' else '_' for c in tag.strip())}"]
    for place in places:
        rows.write.mode("overwrite").partitionBy("outcome").option("ignoreNullFields", "false").json(place + "/results")
