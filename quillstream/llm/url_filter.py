"""URL rules by a sorted digest array.

Rules are full strings host + path prefix. Their 64-bit xxhash keys are sorted into one array which every Python
worker maps from a file; a batch of urls is expanded to the keys (suffix of the host on label borders, prefix of the
path of a length that some rule has), probed by vectorised binary search, and every hit is confirmed against the
stored full string. The longest fitting rule wins. Above ``broadcast_bytes`` of rules the same probes are joined
with the rule table instead, so nothing of unknown size is sent to every executor.

Null urls and urls without ``://`` have empty host and path, which no rule fits. Equal rules given twice: a block
beats an allow. Empty tables give empty results; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_az, setup

#: The rules of op7 as (verdict, host + path prefix).
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
_open: dict[bytes, tuple] = {}


class DigestArray:
    """Sorted keys, string offsets and strings in one flat file layout: n, keys, verdicts, offsets, bytes."""

    def __init__(self, rules: list[tuple[str, str]]):
        best: dict[str, str] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            rule = host.lower() + slash + path
            if best.get(rule) != "block":
                best[rule] = verdict
        found = sorted((xxhash.xxh64_intdigest(r.encode()), r.encode(), v) for r, v in best.items())
        text = [r for _, r, _ in found]
        self.blob = b"".join(
            [
                np.array([len(found)], np.int64).tobytes(),
                np.array([h for h, _, _ in found], np.uint64).tobytes(),
                np.array([v == "block" for _, _, v in found], np.int64).tobytes(),
                np.concatenate([[0], np.cumsum([len(t) for t in text])]).astype(np.int64).tobytes(),
                b"".join(text),
            ]
        )
        self.lengths = sorted({len(r.partition("/")[2]) + 1 if "/" in r else 0 for r in best})
        self.longest = max((len(r.partition("/")[0]) for r in best), default=0)


def mapped(blob: bytes) -> tuple:
    """keys, verdicts, offsets, bytes over a memory-mapped file that has no name any more."""
    key = xxhash.xxh3_128_digest(blob)
    if key not in _open:
        fd, name = tempfile.mkstemp()
        with os.fdopen(fd, "wb") as f:
            f.write(blob)
        whole = np.memmap(name, np.uint8, "r")
        os.unlink(name)
        n = int(whole[:8].view(np.int64)[0])
        at = 8 + 8 * n
        _open.clear()
        _open[key] = (whole[8:at].view(np.uint64), whole[at : at + 8 * n].view(np.int64), whole[at + 8 * n : at + 16 * n + 8].view(np.int64), whole[at + 16 * n + 8 :])
    return _open[key]


def probes(host: str, path: str, lengths: list[int], longest: int) -> list[bytes]:
    """Every host suffix on a label border, no longer than a rule's host, with every path prefix that a rule may have,
    the longest first."""
    out = []
    at = 0 if len(host) <= longest else host.find(".", len(host) - longest - 1) + 1 or len(host)
    while at < len(host):
        out += [host[at:] + path[:n] for n in lengths if n <= len(path)]
        at = host.find(".", at) + 1 or len(host)
    return sorted((x.encode() for x in out), key=len, reverse=True)


def _judge(blob: bytes, lengths: list[int], longest: int, default: str):
    def run(batches):
        keys, blocks, offs, text = mapped(blob)
        for b in batches:
            hosts, paths = b.column("host").to_pylist(), b.column("path").to_pylist()
            asked, of = [], []
            for i, (h, p) in enumerate(zip(hosts, paths)):
                x = probes(h, p, lengths, longest)
                asked += x
                of += [i] * len(x)
            rule, verdict = [None] * len(hosts), [default] * len(hosts)
            if asked and len(keys):
                got = np.fromiter(map(xxhash.xxh64_intdigest, asked), np.uint64, len(asked))
                at = np.searchsorted(keys, got)
                for j in np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == got).tolist():
                    i, k = of[j], int(at[j])
                    while k < len(keys) and keys[k] == got[j]:  # equal keys of different strings stand together
                        if rule[i] is None and text[offs[k] : offs[k + 1]].tobytes() == asked[j]:
                            rule[i], verdict[i] = asked[j].decode(), "block" if blocks[k] else "allow"
                        k += 1
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("host"), b.column("path"), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return run


def split_url(url):
    """(host, path) columns of a url column."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)\A.*?://", "")).otherwise("")
    host = F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(lower_az(host), F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame, default: str = "allow", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """page_id, host, path, rule, verdict of each page. rules: a list, or a table (verdict, rule) of any size."""
    setup(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), *split_url(F.col("url").cast("string")))
    if isinstance(rules, DataFrame):
        total = rules.agg(F.sum(F.octet_length("rule") + 64)).first()[0] or 0
        if total > broadcast_bytes:
            return _joined(rows, rules, default)
        rules = [(r.verdict, r.rule) for r in rules.select("verdict", "rule").where("rule is not null").collect()]
    index = DigestArray(rules)
    if len(index.blob) > broadcast_bytes:
        return _joined(rows, pages.sparkSession.createDataFrame(rules, "verdict string, rule string"), default)
    return rows.mapInArrow(_judge(index.blob, index.lengths, index.longest, default), "page_id long, host string, path string, rule string, verdict string")


def _joined(rows: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same probes against a rule table of any size: distinct probes meet distinct rules by key, then by string."""
    host = lower_az(F.substring_index("rule", "/", 1))
    known = rules.where("rule is not null").select(F.concat(host, F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)")).alias("rule"), "verdict")
    known = known.groupBy("rule").agg(F.max("verdict").alias("verdict")).withColumn("key", F.xxhash64("rule"))
    shape = known.select(F.expr("length(rule) - length(substring_index(rule, '/', 1))").alias("n"), F.expr("length(substring_index(rule, '/', 1))").alias("h"))
    lengths, longest = shape.groupBy("n").agg(F.max("h").alias("h")).agg(F.collect_set("n"), F.max("h")).first()
    sites = rows.select("host", "path").distinct().where("host <> ''")
    # The label borders in the part of the host that a rule's host could cover, and the suffix at each.
    tail = F.expr(f"right(host, {(longest or 0) + 1})")
    spots = F.filter(F.sequence(F.lit(1), F.length(tail)), lambda i: (F.substring(tail, i, F.lit(1)) == ".") | ((i == 1) & (F.length("host") <= (longest or 0))))
    ends = F.transform(spots, lambda i: F.when((i == 1) & (F.substring(tail, i, F.lit(1)) != "."), F.col("host")).otherwise(F.substring(tail, i + 1, F.length(tail))))
    asked = sites.withColumn("end", F.explode(ends)).where("end <> ''").withColumn("n", F.explode(F.array([F.lit(x) for x in sorted(lengths)])) if lengths else F.lit(0))
    asked = asked.where("n <= length(path)").withColumn("probe", F.expr("concat(end, substring(path, 1, n))")).withColumn("key", F.xxhash64("probe"))
    hit = asked.join(known, "key").where("probe = rule").groupBy("host", "path").agg(F.max(F.struct(F.octet_length("rule"), "rule", "verdict")).alias("r"))
    return rows.join(hit, ["host", "path"], "left").select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce(F.col("r.verdict"), F.lit(default)).alias("verdict"))


SQL = """
WITH r(verdict, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT s.page_id, any_value(s.host) AS host, any_value(s.path) AS path,
  arg_max(r.host || r.path, length(r.host || r.path)) AS rule, coalesce(arg_max(r.verdict, length(r.host || r.path)), 'allow') AS verdict
FROM s LEFT JOIN r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path)
GROUP BY s.page_id
"""


def op7_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)
