"""URL allow and block rules by a sort-merge range join.

Reversed hosts ("org.example.www.") turn "this host and its subdomains" into a prefix, that is an
interval of sorted keys, and the intervals of all rules are nested or disjoint. So urls and rules
are sorted together and one sweep keeps a stack of the rule hosts that contain the current key;
a url looks its path up in the stack's few entries. Key ranges come from a bounded row
sample that includes the path and the row's own hash, so a host with a third of all rows, or one
url repeated, is spread over many ranges; a rule is copied into each range that its interval meets.

A rule (host, path, verdict) fits a url if the url's host is the rule's or ends in "." + it and the
url's path starts with the rule's path. The longest rule text wins, then the longer host; of equal
rules (same host and path) "block" wins. A rule with an empty host fits every url.

Defined cases: a null url or one without "://" has empty host and path and no rule but an
empty-host one; rules with a null host are ignored, a null rule path counts as empty; repeated
rows give repeated results; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sampled keys for each key range, and the most ranges: their product bounds what the driver sees.
SAMPLE_PER_RANGE, MOST_RANGES = 32, 4096
#: Characters of a path that take part in a row's place, and of a sampled place that become a bound (host names are shorter).
PATH_SHOWN, BOUND = 64, 384


def url_host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def reversed_host(host: Column) -> Column:
    """"www.example.org" as "org.example.www."; the empty host as the empty key."""
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


OUT = "page_id long, host string, path string, rule string, verdict string"


def _sweep(default: str):
    """Streams rows sorted by (range, place, kind); state is the stack of one range."""

    def best(stack: list, path: str) -> tuple:
        found = (-1, -1, None, default)
        for _, host, paths, lengths in stack:
            for n in lengths:
                if n > len(path):
                    break
                verdict = paths.get(path[:n])
                if verdict is not None:
                    found = max(found, (len(host) + n, len(host), host + path[:n], verdict), key=lambda x: x[:2])
        return found[2], found[3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, stack, memo_at, memo = None, [], None, None
        for batch in batches:
            ids, hosts, outs, rules, verdicts = [], [], [], [], []
            for pid, kind, key, page, host, path, verdict in zip(
                *(batch.column(c).to_pylist() for c in ("pid", "kind", "key", "page_id", "host", "path", "verdict")),
                strict=True,
            ):
                if pid != now:
                    now, stack, memo_at = pid, [], None
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                    memo_at = None
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, {}, []))
                    paths = stack[-1][2]
                    if paths.get(path) != "block":
                        paths[path] = verdict
                    stack[-1][3][:] = sorted({len(p) for p in paths}) if len(path) not in stack[-1][3] else stack[-1][3]
                    memo_at = None
                    continue
                if memo_at != (key, path):
                    memo_at, memo = (key, path), best(stack, path)
                ids.append(page)
                hosts.append(host)
                outs.append(path)
                rules.append(memo[0])
                verdicts.append(memo[1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(hosts, pa.string()),
                    pa.array(outs, pa.string()),
                    pa.array(rules, pa.string()),
                    pa.array(verdicts, pa.string()),
                ],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    return run


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", *, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page with the rule that decides and its verdict, or `default` without one.

    rules: host, path, verdict ("allow" or "block"). Neither side is broadcast.
    """
    spark = pages.sparkSession
    host, path = url_host_path(F.col(url))
    parsed = pages.select(F.col(page_id).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    mix = F.lpad(F.hex(F.xxhash64("page_id", "host", "path")), 16, "0")
    parsed = parsed.select("*", reversed_host(F.col("host")).alias("key")).select(
        "*", F.concat_ws(" ", "key", F.substring("path", 1, PATH_SHOWN), mix).alias("place")
    )

    ranges = min(MOST_RANGES, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    share = max(1, parsed.count() // (SAMPLE_PER_RANGE * ranges))  # about SAMPLE_PER_RANGE * ranges keys come back
    sample = sorted(r[0] for r in parsed.select(F.substring("place", 1, BOUND)).sample(1.0 / share, seed=7).collect())
    bounds = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.append_column("pid", pa.array([bisect_right(bounds, p) for p in b.column("place").to_pylist()], pa.int32()))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for h, p, key, verdict in zip(*(b.column(c).to_pylist() for c in ("host", "path", "key", "verdict")), strict=True):
                last = bisect_right(bounds, key, key=lambda x, n=len(key): x[:n])
                out += [(h, p, key, key, verdict, pid) for pid in range(bisect_right(bounds, key), last + 1)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.string()] * 5 + [pa.int32()], strict=True)],
                ["host", "path", "key", "place", "verdict", "pid"],
            )

    urls = parsed.mapInArrow(locate, "page_id long, host string, path string, key string, place string, pid int").select(
        "pid",
        F.lit(1).alias("kind"),
        "key",
        "place",
        "page_id",
        "host",
        "path",
        F.lit(None).cast("string").alias("verdict"),
    )
    ruled = rules.where(F.col("host").isNotNull()).select(
        F.translate("host", UPPER, LOWER).alias("host"),
        F.coalesce(F.col("path"), F.lit("")).alias("path"),
        F.col("verdict"),
    )
    ruled = ruled.select("host", "path", reversed_host(F.col("host")).alias("key"), "verdict").mapInArrow(
        spread, "host string, path string, key string, place string, verdict string, pid int"
    )
    ruled = ruled.select(
        "pid",
        F.lit(0).alias("kind"),
        "key",
        "place",
        F.lit(None).cast("long").alias("page_id"),
        "host",
        "path",
        "verdict",
    )
    return urls.unionByName(ruled).repartition(ranges, "pid").sortWithinPartitions("pid", "place", "kind").mapInArrow(_sweep(default), OUT)


#: The rules that the query's contract fixes: host, path, verdict.
CONTRACT_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(CONTRACT_RULES, "host string, path string, verdict string")
    return filter_urls(read_table(spark, sf_dir, "pages"), rules)


URL_FILTER_SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), h AS (
  SELECT page_id, r, regexp_extract(r, '\A[^/?#]*') AS raw FROM rest
), u AS (
  SELECT row_number() OVER () AS n, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(r, length(raw) + 1), '\A[^?#]*') AS path FROM h
), rules(rhost, rpath, v) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), best AS (
  SELECT n, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(v, length(rhost || rpath)) AS v
  FROM u JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY n
)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN best USING (n)
"""
