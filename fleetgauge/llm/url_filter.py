"""Exact URL allow and block lists by a cascade of Bloom filters, in DataFrame operations only.

The listed keys go into level 1. Those keys of the corpus that level 1 wrongly accepts go into level 2, the
listed keys that level 2 wrongly accepts into level 3, and so on until a level accepts nothing wrong. A key of
the corpus is listed exactly when the first level that rejects it is an even one (or, if none rejects it, the
number of levels is odd). As the levels were built from every key the corpus can ask for, the answer is exact,
and asking it needs no join: the levels are small constants, sized by the list, not by the corpus.

A key is a host or parent domain with a path prefix whose length is that of some listed path. All rules of a
verdict form one cascade, and the longest key wins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.shared import configure, written

WORD = 64


@dataclass(frozen=True)
class Rule:
    verdict: str  # "allow" or "block"
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    """A Bloom filter: bit ``i`` is bit ``i % 64`` of word ``i // 64``."""

    seed: int
    hashes: int
    words: tuple[int, ...]

    def positions(self, key: Column) -> list[Column]:
        bits = len(self.words) * WORD
        return [F.pmod(F.xxhash64(key, F.lit(self.seed * 100 + i)), F.lit(bits)) for i in range(self.hashes)]

    def accepts(self, key: Column) -> Column:
        words = F.lit(list(self.words)).cast("array<bigint>")
        found = F.lit(True)
        for bit in self.positions(key):
            word = F.get(words, F.floor(bit / WORD).cast("int"))
            mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(bit, F.lit(WORD)).cast("int"))
            found = found & (word.bitwiseAND(mask) != 0)
        return found


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a url column; both empty without ``://``."""
    rest = F.expr(f"substring({url}, nullif(instr({url}, '://'), 0) + 3)")
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def asked_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every key a url can match, longest host first, then longest path; a text of host, space, path."""
    labels = F.split(host, r"\.")
    count = F.size(labels)
    hosts = F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(labels, i, count), "."))
    keys = F.transform(
        hosts,
        lambda h: F.array(
            *[
                F.when(F.length(path) >= n, F.concat(h, F.lit(" "), F.substring(path, 1, n)))
                for n in sorted(lengths, reverse=True)
            ]
        ),
    )
    return F.array_compact(F.flatten(keys))


def build_cascade(keys: DataFrame, salt: int = 0) -> list[Level]:
    """Levels over ``keys(key, listed)``: every key that will ever be asked, and whether it is listed.

    Only counts and the bits of a level reach the driver. Level 1 is sized to leave about as many wrong keys
    as there are listed ones, later levels halve the rest, so all levels together take a few bits for each listed
    key and doubling of the corpus.
    """
    counts = keys.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    inside, outside = counts[0], counts[1]
    levels: list[Level] = []
    inner, outer = keys.filter("listed"), keys.filter("NOT listed")
    while inside:
        rate = min(0.5, inside * math.sqrt(0.5) / max(outside, 1)) if not levels else 0.5
        bits = max(1, math.ceil(inside * -math.log(rate) / math.log(2) ** 2 / WORD))
        hashes = max(1, round(bits * WORD / inside * math.log(2)))
        shape = Level(salt + len(levels), min(hashes, 16), (0,) * bits)
        rows = (
            inner.select(F.explode(F.array(*shape.positions(F.col("key")))).alias("bit"))
            .selectExpr("int(bit DIV 64) AS word", "shiftleft(1L, int(bit % 64)) AS mask")
            .groupBy("word")
            .agg(F.bit_or("mask").alias("mask"))
            .collect()
        )
        words = [0] * bits
        for row in rows:
            words[row["word"]] = row["mask"]
        level = Level(shape.seed, shape.hashes, tuple(words))
        levels.append(level)
        wrong = outer.filter(level.accepts(F.col("key")))
        inner, outer = wrong, inner
        inside, outside = wrong.count(), inside
    return levels


def is_listed(key: Column, levels: list[Level]) -> Column:
    """Whether a key of the corpus is listed: the first level to reject it decides."""
    verdict = F.lit(len(levels) % 2 == 1)
    for number, level in reversed(list(enumerate(levels))):
        verdict = F.when(~level.accepts(key), F.lit(number % 2 == 1)).otherwise(verdict)
    return verdict


def filter_urls(pages: DataFrame, rules: list[Rule], unlisted: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages(page_id, url)``.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins. Without a
    fitting rule, ``rule`` is null and the verdict is ``unlisted``. Null urls and urls without ``://`` have an empty
    host and path. Repeated rows are judged each; other columns are ignored; no pages give no rows.
    """
    configure(pages.sparkSession)
    host, path = host_and_path()
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    lengths = sorted({len(r.path) for r in rules})
    if not rules:
        return parts.select("*", F.lit(None).cast("string").alias("rule"), F.lit(unlisted).alias("verdict"))
    asked = parts.select("page_id", "host", "path", asked_keys(F.col("host"), F.col("path"), lengths).alias("keys"))

    universe = asked.select(F.explode("keys").alias("key")).distinct()
    universe = written(universe, "url-keys")
    cascades = {}
    for number, verdict in enumerate(sorted({r.verdict for r in rules})):
        listed = [f"{r.host} {r.path}" for r in rules if r.verdict == verdict]
        own = pages.sparkSession.createDataFrame([(k, True) for k in listed], "key string, listed boolean")
        keys = universe.select("key", F.lit(False).alias("listed")).union(own)
        keys = keys.groupBy("key").agg(F.bool_or("listed").alias("listed"))
        cascades[verdict] = build_cascade(written(keys, "url-listed"), salt=number * 1000)

    # the keys of one url come longest host first: the first listed one is the longest rule
    listed_keys = F.filter(
        F.transform("keys", lambda k: F.struct(k.alias("key"), _judge(k, cascades).alias("verdict"))),
        lambda x: x["verdict"].isNotNull(),
    )
    found = asked.select("page_id", "host", "path", F.get(listed_keys, 0).alias("hit"))
    return found.select(
        "page_id",
        "host",
        "path",
        F.replace(F.col("hit.key"), F.lit(" "), F.lit("")).alias("rule"),
        F.coalesce(F.col("hit.verdict"), F.lit(unlisted)).alias("verdict"),
    )


def _judge(key: Column, cascades: dict[str, list[Level]]) -> Column:
    verdict = F.lit(None).cast("string")
    for name, levels in cascades.items():
        verdict = F.when(is_listed(key, levels), F.lit(name)).otherwise(verdict)
    return verdict
