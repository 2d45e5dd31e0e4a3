"""URL filter: host and path rules over a logistic regression on hashed character n-grams.

Host, path and rule are SQL functions. The score is computed a batch of rows at a time: the n-grams of all its hosts and
paths are hashed as arrays, and their weights summed by row. The regression is trained on the driver from a small
labelled URL table (its size is bounded by ``MOST_LABELLED``); the weights, one float per hash slot, are broadcast, and
pages are judged without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shingles import mix

#: (host, path, verdict); fixed by the contract.
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: Kinds of sites that a crawl drops and keeps, and the folders they have, from which the labelled table is made.
BLOCKED = (
    "casino poker slots roulette jackpot betting bets bingo lottery gamble viagra pills pharmacy-rx cheap-meds diet-pill miracle-cure xxx porn webcam-girls escort adult hookup sexy"
    " payday-loan quick-cash forex-signals get-rich win-money free-prize replica-watches fake-bags cracked-apps warez keygen torrent-free spam-farm link-farm seo-links backlinks"
    " ads-track clickserve popunder adserver pixel-track affiliate-deals coupon-spam doorway cheap-tickets-now hot-singles"
).split()
KEPT = (
    "library museum university college school academy council parliament ministry hospital clinic weather-office news-daily gazette tribune review journal science astronomy biology chemistry"
    " physics mathematics history archive encyclopedia dictionary linguistics gardening recipes cooking hiking cycling chess-club orchestra theatre gallery architecture engineering"
    " software-docs open-data statistics railway transport geology botany wildlife"
).split()
BLOCKED_FOLDERS = "bonus/signup track/click buy-now play/free win/prize cheap/order go/redirect offer/limited cam/live deal/today".split()
KEPT_FOLDERS = "articles/report docs/guide about/contact research/paper events/calendar collections/item courses/intro advice/health minutes/meeting tables/annual".split()
#: Host forms, endings and plain folders, alike for both kinds so that they tell nothing.
HOSTS = ("{0}.{1}", "www.{0}.{1}", "m.{0}.{1}", "the-{0}.{1}", "{0}-online.{1}", "blog.{0}.{1}")
ENDINGS = ("com", "net", "org", "info", "de", "fr", "es", "co.uk")
PLAIN = ("en/{0}", "de/{0}.html", "fr/{0}", "es/{0}", "index.html", "", "page/{0}")
MOST_LABELLED = 20_000
SLOTS_BITS, SIZES = 15, (3, 4, 5)
SLOTS = 1 << SLOTS_BITS
_BASE = np.uint64(0x9E3779B97F4A7C15)


def labelled_urls() -> list[tuple[str, int]]:
    """The labelled table, 1 to block: every kind of site in five host forms, by turns under a folder of its kind and a plain
    one. Invented by this rule, and not after any table's hosts; 230 rows or so of each label."""
    rows = []
    for label, words, folders in ((1, BLOCKED, BLOCKED_FOLDERS), (0, KEPT, KEPT_FOLDERS)):
        for i, word in enumerate(words):
            for j in range(5):
                host = HOSTS[(i + j) % len(HOSTS)].format(word, ENDINGS[(3 * i + j) % len(ENDINGS)])
                folder = folders[(i + 3 * j) % len(folders)] if (i + j) % 2 else PLAIN[(i + 2 * j) % len(PLAIN)].format(17 * i + 101 * j)
                rows.append((f"http://{host}/{folder}", label))
    return rows


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    raw = F.regexp_extract(rest(url), r"^[^/?#]*+", 0)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(rest(url), r"^[^/?#]*+([^?#]*+)", 1)


def rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def slots(hosts: list[bytes], paths: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the distinct hash slots of the n-grams of each ``^host$`` and ``^path$``, which are marked apart."""
    found = []
    for mark, parts in ((1, hosts), (2, paths)):
        texts = [b"^" + p + b"$" for p in parts]
        data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
        size = np.array([len(t) for t in texts], np.int64)
        end = np.cumsum(size)
        row = np.repeat(np.arange(len(texts)), size)
        left = end[row] - np.arange(len(data))
        for n in SIZES:
            h = np.full(max(0, len(data) - n + 1), mark * 8 + n, np.uint64)
            for k in range(n):
                h = h * _BASE + data[k : k + len(h)] + np.uint64(1)
            inside = left[: len(h)] >= n
            found.append(row[: len(h)][inside] * SLOTS + (mix(h[inside]) >> np.uint64(64 - SLOTS_BITS)).astype(np.int64))
    both = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return both // SLOTS, both % SLOTS


def odds(weights: np.ndarray, hosts: list[bytes], paths: list[bytes]) -> np.ndarray:
    """The log-odds that each URL is to be blocked: the weights' sum over the root of the number of n-grams."""
    row, slot = slots(hosts, paths)
    n = np.bincount(row, minlength=len(hosts))
    return np.bincount(row, weights[slot], len(hosts)) / np.sqrt(np.maximum(1, n)) + weights[-1]


def train(hosts: list[bytes], paths: list[bytes], labels: Iterable[int], steps: int = 300, rate: float = 1.0, ridge: float = 1e-3) -> np.ndarray:
    """The weights of a logistic regression by gradient descent; the last one is the intercept. Deterministic."""
    if len(hosts) > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled URLs")
    weights, y = np.zeros(SLOTS + 1), np.array(list(labels), float)
    if not len(y):
        return weights
    row, slot = slots(hosts, paths)
    scale = 1 / np.sqrt(np.maximum(1, np.bincount(row, minlength=len(y))))[row]
    for _ in range(steps):
        z = np.bincount(row, weights[slot] * scale, len(y)) + weights[-1]
        error = 1 / (1 + np.exp(-z)) - y
        weights[:-1] -= rate * (np.bincount(slot, error[row] * scale, SLOTS) / len(y) * 10 + ridge * weights[:-1])
        weights[-1] -= rate * error.mean()
    return weights


def trained(spark, labelled: Iterable[tuple[str, int]]) -> np.ndarray:
    """The weights from a small table of (url, label), which is bounded."""
    rows = list(labelled)
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"more than {MOST_LABELLED} labelled URLs")
    df = spark.createDataFrame(rows, "url string, label int").select(url_host(F.col("url")).alias("h"), url_path(F.col("url")).alias("p"), "label")
    got = df.orderBy("h", "p", "label").collect()
    return train([r.h.encode() for r in got], [r.p.encode() for r in got], [r.label for r in got])


def judge(pages: DataFrame, rules=RULES, labelled: Iterable[tuple[str, int]] | None = None, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page id, host, path, rule, verdict, log_odds for every row.

    The longest rule whose host is the url's host, or a parent of it, and whose path starts the url's path decides (of
    equally long ones the first in order); else the sign of the regression's log-odds, 0 allowing. A null url, or one
    without ``://``, has an empty host and path, no rule, and the verdict of an empty url. Repeated rows get the same
    verdict; a url of any length is scored whole; other columns are not read; an empty table gives an empty result."""
    weights = pages.sparkSession.sparkContext.broadcast(trained(pages.sparkSession, labelled_urls() if labelled is None else labelled))
    url = F.coalesce(F.col(url_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), url_host(url).alias("host"), url_path(url).alias("path"))
    found = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, verdict in reversed(sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))):
        hit = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        found = F.when(hit, host + path).otherwise(found[0]), F.when(hit, verdict).otherwise(found[1])
    rows = rows.withColumns({"rule": found[0], "ruled": found[1]})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = odds(weights.value, *([x.encode() for x in batch.column(c).to_pylist()] for c in ("host", "path")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(z, pa.float64())], [*batch.schema.names, "log_odds"])

    kind = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(run, f"id {kind}, host string, path string, rule string, ruled string, log_odds double")
    verdict = F.coalesce("ruled", F.when(F.col("log_odds") > 0, "block").otherwise("allow"))
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "log_odds")
