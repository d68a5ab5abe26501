"""URL filter: allow and block rules, and for the rest a logistic regression on hashed character n-grams.

The regression is trained on the driver from a small labelled table of URLs (a parameter, a few hundred
rows at most make sense) and applied by Arrow batches; its weights are a table of fixed size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.llm import ship
from tallyboard.llm.words import chunks, mix, ranges

#: (verdict, rule): host, then path. A rule holds for the host and its subdomains and for paths that
#: start with its path; the longest that holds decides.
RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)

#: (url, 1 for block): what the regression learns from when no other table is given.
LABELLED = tuple(
    [
        (f"{scheme}://{host}{path}", 1)
        for scheme, host, path in (
            ("http", "www.casino-royal.example.net", "/play/slots"),
            ("https", "best-casino.example.com", "/bonus?ref=12"),
            ("http", "win-big-casino.example.org", "/en/123"),
            ("http", "casino-win-now.example.net", "/fr/99.html"),
            ("http", "cheap-meds.example.com", "/pills/order"),
            ("https", "pills-online.example.net", "/buy-viagra"),
            ("http", "m.cheap-pills-shop.example.net", "/en/44"),
            ("http", "discount-pills.example.org", "/cheap"),
            ("http", "adult-cams.example.com", "/xxx/live"),
            ("https", "hot-adult-videos.example.net", "/porn/1"),
            ("http", "xxx-adult-x.example.net", "/de/7"),
            ("http", "blog.adult-dating.example.com", "/sex"),
            ("http", "free-betting.example.net", "/bets/today"),
            ("https", "sport-bets.example.com", "/odds?aff=3"),
            ("http", "free-bets-now.example.org", "/en/8/"),
            ("http", "spam-links.example.com", "/farm/links"),
            ("http", "link-spam-farm.example.net", "/es/71"),
            ("https", "seo-spam.example.org", "/backlinks"),
            ("http", "click-ads.example.net", "/track?id=9"),
            ("http", "ads-tracker.example.com", "/pixel.gif"),
            ("https", "www.adserver-track.example.net", "/banner"),
            ("http", "quick-loans.example.com", "/payday"),
            ("http", "warez-crack.example.net", "/keygen.exe"),
            ("http", "free-download-crack.example.com", "/serial"),
        )
    ]
    + [
        (f"{scheme}://{host}{path}", 0)
        for scheme, host, path in (
            ("https", "www.library.example.org", "/catalogue/book/17"),
            ("https", "university.example.com", "/research/papers.html"),
            ("http", "news.example.net", "/en/2024/article"),
            ("https", "docs.python.example.org", "/3/tutorial/"),
            ("https", "en.wiki.example.org", "/wiki/Mathematics"),
            ("http", "blog.garden.example.com", "/en/12345"),
            ("http", "www.museum.example.net", "/fr/48801.html"),
            ("https", "recipes.example.com", "/de/soup?page=2"),
            ("https", "m.travel.example.net", "/es/31001/"),
            ("http", "history.example.org", "/en/4490?utm_source=feed"),
            ("https", "science.example.com", "/fr/1204#top"),
            ("http", "school.example.net", "/de/29942"),
            ("https", "the-weather.example.net", "/en/18815.html"),
            ("http", "blog.nation.example.com", "/en/490/"),
            ("https", "ththere.example.net", "/es/3333"),
            ("http", "www.thesis.example.org", "/en/25616?page=2&ref=x"),
            ("https", "station.example.net", "/en/26236"),
            ("http", "m.there.example.com", "/fr/502#top"),
            ("https", "music.example.net", "/de/24149"),
            ("http", "local-news.example.com", "/en/7867"),
            ("https", "health.example.org", "/advice/sleep"),
            ("http", "forum.linux.example.net", "/thread/819"),
            ("https", "code.example.com", "/project/readme.md"),
            ("http", "poetry.example.org", "/en/1/"),
        )
    ]
)

_BUCKETS = 1 << 16
_SIZES = (3, 4, 5)


def host_of(url: Column) -> Column:
    """From after the first `://` to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host to `?`, `#` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def matching_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that holds, else null."""
    found = F.lit(None)
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        holds = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        found = F.when(holds, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def ngram_buckets(column: pa.Array, seed: int):
    """(row, bucket) of every n-gram of bytes of each text between marks of its start and end."""
    marked = pc.binary_join_element_wise("\x02", pc.fill_null(column, ""), "\x03", "")
    rows, buckets = [], []
    for lo, _, data, offsets in chunks(marked):
        wide = data.astype(np.uint64) + np.uint64(seed << 8)
        lengths = np.diff(offsets)
        for size in _SIZES:
            if len(wide) < size:
                continue
            h = np.full(len(wide) - size + 1, size, dtype=np.uint64)
            for j in range(size):
                h = h * np.uint64(0x100000001B3) + wide[j : j + len(h)]
            n = np.maximum(lengths - size + 1, 0)
            owner = np.repeat(np.arange(len(n)), n)
            rows.append(owner + lo)
            buckets.append((mix(h[offsets[:-1][owner] + ranges(n)]) & np.uint64(_BUCKETS - 1)).astype(np.int64))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(buckets)


def _features(hosts: pa.Array, paths: pa.Array):
    h, p = ngram_buckets(hosts, 1), ngram_buckets(paths, 2)
    return np.concatenate([h[0], p[0]]), np.concatenate([h[1], p[1]])


def _margins(weights: np.ndarray, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
    """Log odds of block; the last weight is the constant's. N-grams weigh 1 / sqrt(their number)."""
    rows, buckets = _features(hosts, paths)
    n = len(hosts)
    total = np.bincount(rows, weights[buckets], n)
    return total / np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1)) + weights[-1]


def train(hosts: list[str], paths: list[str], labels: list[int], steps: int = 400, rate: float = 1.0, decay: float = 1e-3):
    """Weights of a logistic regression, by full-batch gradient descent with L2 decay."""
    weights = np.zeros(_BUCKETS + 1)
    if not hosts:
        return weights
    hosts, paths, y = pa.array(hosts, pa.string()), pa.array(paths, pa.string()), np.array(labels, dtype=float)
    rows, buckets = _features(hosts, paths)
    share = 1 / np.sqrt(np.maximum(np.bincount(rows, minlength=len(y)), 1))
    for _ in range(steps):
        error = 1 / (1 + np.exp(-_margins(weights, hosts, paths))) - y
        weights[:-1] -= rate * (np.bincount(buckets, (error * share)[rows], _BUCKETS) / len(y) + decay * weights[:-1])
        weights[-1] -= rate * error.mean()
    return weights


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = RULES,
    labelled: DataFrame | None = None,
    url: str = "url",
    key: str = "page_id",
) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score of every row.

    `labelled` has url and label (1 is block; rows with a null in either don't count) and is collected
    for training: it is a small table made by hand, `LABELLED` by default. The regression decides
    where no rule holds, block at a score of 0.5 or more. A null url or one without `://` has an empty
    host and path and is judged by the regression. Other columns are not read.
    """
    spark = pages.sparkSession
    ship(spark)
    if labelled is None:
        labelled = spark.createDataFrame(list(LABELLED), "url string, label int")
    taught = labelled.where("url IS NOT NULL AND label IS NOT NULL").select(
        host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("int")
    )
    taught = taught.collect()  # a small table by contract
    weights = spark.sparkContext.broadcast(
        train([r.host for r in taught], [r.path for r in taught], [r.label for r in taught]).astype(np.float32)
    )

    def score(batches):
        for batch in batches:
            margin = _margins(weights.value, batch.column(1), batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(1 / (1 + np.exp(-margin)))], ["key", "host", "path", "block_score"]
            )

    kind = pages.schema[key].dataType.simpleString()
    urls = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"))
    scored = urls.select("key", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).mapInArrow(
        score, f"key {kind}, host string, path string, block_score double"
    )
    ruled = scored.withColumn("ruled", matching_rule(F.col("host"), F.col("path"), rules))
    learned = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return ruled.select(
        F.col("key").alias(key),
        "host",
        "path",
        F.col("ruled.rule").alias("rule"),
        F.coalesce(F.col("ruled.verdict"), learned).alias("verdict"),
        "block_score",
    )
