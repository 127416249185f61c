"""URL rules by a sorted digest array.

A rule is a host (it fits that host and all its subdomains) and a path prefix; the
longest fitting rule decides. Rules are kept as a sorted array of 64-bit xxhash digests
of ``host + path`` beside the rule strings. A task memory-maps the array, builds the
candidate strings of each url (host suffixes at label borders x path prefixes, both only
of lengths that some rule has), probes all of a batch with one vectorised binary search
and confirms every hit with the stored string, so that digest collisions cannot decide.

Size: rules are cut into index files of at most ``rules_per_file`` rules. A file is sent
to executors by ``SparkContext.addFile`` from the shared folder (a replacement executor
fetches it again); urls are probed file by file and the longest rule of all files is kept,
so no list is too long and no file grows with the data.
"""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equityspark.llm import common

ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return common.ascii_lower(F.coalesce(F.regexp_extract(url, ADDRESS, 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, ADDRESS, 2), F.lit(""))


def _digest(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))


def build_index(rules: list[tuple[str, str, str]]) -> bytes:
    """Index file of (host, path, verdict) rules: header, sorted digests, string offsets, strings.

    Of rules with the same host and path, block wins.
    """
    kept: dict[tuple[str, str], str] = {}
    for host, path, verdict in rules:
        key = (host.lower() if host.isascii() else host, path)
        kept[key] = "block" if "block" in (verdict, kept.get(key)) else verdict
    items = sorted((_digest(h + "\0" + p), h, p, v) for (h, p), v in kept.items())
    keys = np.array([i[0] for i in items], np.uint64)
    body = [json.dumps([h, p, v]).encode() for _, h, p, v in items]
    offs = np.concatenate([[0], np.cumsum([len(b) for b in body])]).astype(np.uint64) if body else np.zeros(1, np.uint64)
    lengths = sorted({(len(h), len(p)) for _, h, p, _ in items})
    head = json.dumps({"n": len(items), "lengths": lengths}).encode()
    head += b" " * (-len(head) % 8)
    return np.array([len(head)], np.uint64).tobytes() + head + keys.tobytes() + offs.tobytes() + b"".join(body)


class Index:
    """A memory-mapped index file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        size = int(raw[:8].view(np.uint64)[0])
        head = json.loads(bytes(raw[8: 8 + size]))
        n, at = head["n"], 8 + size
        self.keys = raw[at: at + 8 * n].view(np.uint64)
        self.offs = raw[at + 8 * n: at + 8 * n + 8 * (n + 1)].view(np.uint64)
        self.body = raw[at + 16 * n + 8:]
        self.path_lengths: dict[int, list[int]] = {}
        for h, p in head["lengths"]:
            self.path_lengths.setdefault(h, []).append(p)

    def candidates(self, host: str, path: str):
        """(host suffix, path prefix) pairs of lengths that some rule has."""
        at = 0
        while True:
            for p in self.path_lengths.get(len(host) - at, ()):
                if p <= len(path):
                    yield host[at:], path[:p]
            at = host.find(".", at) + 1
            if at == 0:
                return

    def probe(self, hosts: list[str], paths: list[str]) -> list[tuple[str, str, str] | None]:
        """Longest fitting rule of each url, or None."""
        owner, pairs = [], []
        for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
            for pair in self.candidates(h, p):
                owner.append(i)
                pairs.append(pair)
        best: list[tuple[str, str, str] | None] = [None] * len(hosts)
        if not pairs or not len(self.keys):
            return best
        want = np.fromiter((_digest(h + "\0" + p) for h, p in pairs), np.uint64, len(pairs))
        at = np.searchsorted(self.keys, want, side="left")
        open_ = np.flatnonzero(at < len(self.keys))
        while len(open_):
            open_ = open_[self.keys[at[open_]] == want[open_]]
            for c in open_:
                k = int(at[c])
                rule = tuple(json.loads(bytes(self.body[int(self.offs[k]): int(self.offs[k + 1])])))
                if rule[:2] == pairs[c]:
                    old = best[owner[c]]
                    if old is None or _order(rule) > _order(old):
                        best[owner[c]] = rule
            at[open_] += 1  # the next entry may have the same digest
            open_ = open_[at[open_] < len(self.keys)]
        return best


def _order(rule: tuple[str, str, str]) -> tuple[int, int]:
    return len(rule[0]) + len(rule[1]), len(rule[0])


def _publish(spark: SparkSession, rules: list[tuple[str, str, str]]) -> str:
    """Write one index file to the shared folder and hand it to the executors; returns its name."""
    name = f"urlrules-{uuid.uuid4().hex}.bin"
    path = f"{common.checkpoint_dir(spark)}/{name}"
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where)
    try:
        out.write(build_index(rules))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return name


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = "allow", rules_per_file: int = 1_000_000) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``urls``.

    ``rule`` is ``host + path`` of the longest fitting rule (ties: the longer host), or null;
    ``verdict`` is the rule's, or ``default`` when no rule fits: an url that is not in the
    digest array is not listed. A null url or one without ``://`` has empty host and path.
    Repeated rows are judged alike, other columns are kept; columns named like the four
    added ones are replaced.
    """
    added = ["host", "path", "rule", "verdict"]
    df = urls.drop(*[c for c in added if c != url]).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rest = df.columns
    df = df.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default), "_long": F.lit(-1), "_host": F.lit(-1)})
    schema = df.schema
    for a in range(0, len(rules), rules_per_file):
        name = _publish(urls.sparkSession, rules[a: a + rules_per_file])

        def probe(batches, name=name):
            index = Index(SparkFiles.get(name))
            for b in batches:
                found = index.probe(b.column("host").to_pylist(), b.column("path").to_pylist())
                cols = {n: b.column(n) for n in b.schema.names}
                old = list(zip(*(cols[n].to_pylist() for n in ("rule", "verdict", "_long", "_host")), strict=True))
                new = [o if f is None or _order(f) <= (o[2], o[3]) else (f[0] + f[1], f[2], *_order(f)) for o, f in zip(old, found, strict=True)]
                for i, n in enumerate(("rule", "verdict", "_long", "_host")):
                    cols[n] = pa.array([x[i] for x in new], b.schema.field(n).type)
                yield pa.RecordBatch.from_arrays([cols[n] for n in b.schema.names], schema=b.schema)

        df = df.mapInArrow(probe, schema)
    return df.select(*rest, "rule", "verdict")
