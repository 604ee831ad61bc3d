"""URL filters over a memory-mapped sorted array of 64-bit digests."""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: The rules of the registered query: host suffix with path prefix, and verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Upper bound on the bytes of a rule file, since each executor holds a copy.
MAX_RULE_BYTES = 1 << 30
_VERDICTS = ("block", "allow")
#: Rule files that went out already, by application.
_SENT: set[tuple[str, str]] = set()


def host_of(url: Column) -> Column:
    """After the first :// up to a slash, question mark, hash or the end; A-Z lower-cased."""
    return ascii_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """After the host, up to a question mark, hash or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


class DigestArray:
    """Rules sorted by the 64-bit xxhash of host suffix and path prefix, in one flat file that is opened in constant time.

    File: a head of counts; digests, string offsets and verdicts of the rules, then their strings; digests of the distinct host suffixes
    and the lengths of the path prefixes that each has. A probe is a binary search for the digest; a hit counts only if the stored
    string is the probed one.
    """

    HEAD = 5  # rules, bytes of strings, hosts, lengths, labels of the longest host

    def __init__(self, path: str):
        self.n, size, hosts, lengths, self.most_labels = (int(x) for x in np.memmap(path, np.uint64, "r", 0, self.HEAD))
        at = 8 * self.HEAD

        def mapped(kind: type, n: int) -> np.ndarray:
            nonlocal at
            start, at = at, at + n * np.dtype(kind).itemsize
            return np.memmap(path, kind, "r", start, n) if n else np.empty(0, kind)

        self.digests, self.offsets = mapped(np.uint64, self.n), mapped(np.uint64, self.n + 1)
        self.hosts, self.ends, self.lengths = mapped(np.uint64, hosts), mapped(np.uint64, hosts + 1), mapped(np.uint64, lengths)
        self.verdicts, self.text = mapped(np.uint8, self.n), mapped(np.uint8, size)

    @classmethod
    def write(cls, rules: Iterable[tuple[str, str]], path: str) -> None:
        """Of rules with the same key, the last one counts."""
        found = {k: v for k, v in dict(rules).items() if "/" in k}
        rows = sorted((xxhash.xxh64_intdigest(k.encode()), k.encode(), _VERDICTS.index(v)) for k, v in found.items())
        size = sum(len(k) for _, k, _ in rows)
        by_host: dict[str, set[int]] = {}
        for k in found:
            host = k.partition("/")[0]
            by_host.setdefault(host, set()).add(len(k) - len(host))
        hosts = sorted((xxhash.xxh64_intdigest(h.encode()), sorted(n)) for h, n in by_host.items())
        lengths = [n for _, ns in hosts for n in ns]
        if size + 17 * len(rows) + 16 * len(hosts) + 8 * len(lengths) > MAX_RULE_BYTES:
            raise ValueError(f"the rules exceed {MAX_RULE_BYTES} bytes")
        flat = lambda values: np.array(values, np.uint64).tobytes()
        with open(path, "wb") as f:
            f.write(flat([len(rows), size, len(hosts), len(lengths), max((h.count(".") + 1 for h in by_host), default=0)]))
            f.write(flat([d for d, _, _ in rows]) + flat(np.cumsum([0, *(len(k) for _, k, _ in rows)])))
            f.write(flat([d for d, _ in hosts]) + flat(np.cumsum([0, *(len(n) for _, n in hosts)])) + flat(lengths))
            f.write(np.array([v for _, _, v in rows], np.uint8).tobytes())
            f.write(b"".join(k for _, k, _ in rows))

    def key(self, i: int) -> str:
        return bytes(self.text[int(self.offsets[i]) : int(self.offsets[i + 1])]).decode()

    def probe(self, keys: list[str]) -> np.ndarray:
        """Index of each key's rule, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.digests) or not keys:
            return out
        digests = np.array([xxhash.xxh64_intdigest(k.encode()) for k in keys], np.uint64)
        lo, hi = (np.searchsorted(self.digests, digests, side) for side in ("left", "right"))
        for i in np.flatnonzero(hi > lo):
            out[i] = next((j for j in range(lo[i], hi[i]) if self.key(j) == keys[i]), -1)
        return out

    def suffixes(self, hosts: list[str]) -> dict[str, list[tuple[str, list[int]]]]:
        """Of each distinct host, the suffixes that rules have and their path lengths. Each suffix is probed once."""
        ends: dict[str, list[str]] = {}
        for host in set(hosts):
            labels = host.rsplit(".", self.most_labels)[-self.most_labels :] if host and self.most_labels else []
            ends[host] = [".".join(labels[-k:]) for k in range(1, len(labels) + 1)]
        asked = sorted({s for of in ends.values() for s in of})
        digests = np.array([xxhash.xxh64_intdigest(s.encode()) for s in asked], np.uint64)
        lo, hi = (np.searchsorted(self.hosts, digests, side) for side in ("left", "right"))
        known = {asked[i]: self.lengths[int(self.ends[lo[i]]) : int(self.ends[hi[i]])].tolist() for i in np.flatnonzero(hi > lo)}
        return {host: [(s, known[s]) for s in of if s in known] for host, of in ends.items()}

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str | None]]:
        """The longest rule that fits each host and path, and its verdict."""
        places = self.suffixes(hosts)
        keys, owner = [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            for suffix, lengths in places[host]:
                for n in lengths:
                    if len(path) >= n:
                        keys.append(suffix + path[:n])
                        owner.append(i)
        best: dict[int, tuple[int, int]] = {}
        for i, rule in zip(owner, self.probe(keys), strict=True):
            if rule >= 0:
                size = int(self.offsets[rule + 1] - self.offsets[rule])
                best[i] = max(best.get(i, (0, -1)), (size, int(rule)))
        return [(self.key(best[i][1]), _VERDICTS[int(self.verdicts[best[i][1]])]) if i in best else (None, None) for i in range(len(hosts))]


def url_filter(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, *, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to pages.

    The rule file goes to every executor once (addFile) and is memory-mapped by its tasks; a rule fits its
    host and all subdomains if the path starts with the rule's, the longest wins. Without a fitting rule the url is
    in no list, and the verdict is default. Decided cases: a null url, or one without ://, has an empty host and path and
    gets the default; repeated urls are judged alike; columns named host, path, rule or verdict are replaced.
    """
    spark = pages.sparkSession
    rules = list(rules)
    name = "keyloom-urls-" + hashlib.sha256(repr(rules).encode()).hexdigest()[:20]
    if (spark.sparkContext.applicationId, name) not in _SENT:
        # A folder of its own: no file that lies there already is taken for the rules.
        local = os.path.join(tempfile.mkdtemp(prefix="keyloom-"), name)
        DigestArray.write(rules, local)
        spark.sparkContext.addFile(local)
        _SENT.add((spark.sparkContext.applicationId, name))

    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    schema = pages.select(*kept).withColumns({"host": F.lit(""), "path": F.lit(""), "rule": F.lit(None).cast("string"), "verdict": F.lit("")}).schema

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(SparkFiles.get(name))
        for batch in batches:
            found = array.judge(batch.column("host").to_pylist(), batch.column("path").to_pylist())
            columns = {c: batch.column(c) for c in [*kept, "host", "path"]}
            columns["rule"] = pa.array([r for r, _ in found], pa.string())
            columns["verdict"] = pa.array([v or default for _, v in found], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    parts = pages.select(*kept).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    return parts.mapInArrow(judged, schema)


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return url_filter(pages).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""
