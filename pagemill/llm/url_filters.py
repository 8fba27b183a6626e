"""URL filters: rules by host and path, and for the rest a Bloom filter cascade of listed hosts.

The cascade is built over the complete universe of keys that the corpus holds, its hosts
and their parent domains. Level 1 encodes the listed keys, level 2 those of the others
that pass level 1, level 3 the listed ones that pass level 2, and so on until none pass
by mistake. Every key of the universe then gets its exact answer from some 64-bit
words, without a join. Built-in functions only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import stored

LONGEST_NAME = 253  # of a domain name in DNS
PROBES, BITS, PART_WORDS = 5, 12, 1 << 14
MAX_BYTES = 16 << 20


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between the first :// and the next / ? # or the end, A-Z lower-cased, and from there up to ? # or the end."""
    place = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(place > 0, F.substr(url, place + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def domains(host: Column) -> Column:
    """A host and its parent domains, as far as they are no longer than a domain name can be; none for an empty host."""
    labels = F.split(F.right(host, F.lit(LONGEST_NAME + 1)), r"\.")
    # Of a longer host the first piece is cut somewhere within a label.
    first = F.when(F.length(host) > LONGEST_NAME, 2).otherwise(1)
    names = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    return F.filter(F.slice(names, first, F.size(labels)), lambda x: x != "")


def placed(key: Column, level: int, n_words: int) -> tuple[Column, Column]:
    """(word, mask) of a key in a level: the word that holds it and the bits it sets there."""
    h = F.xxhash64(key, F.lit(level))
    mask = F.lit(0).cast("long")
    for i in range(PROBES):
        bit = F.shiftright(h, 6 * i).bitwiseAND(63).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return F.pmod(F.shiftrightunsigned(h, 6 * PROBES), F.lit(n_words)), mask


def passes(key: Column, level: int, n_words: int, words: Column) -> Column:
    """Whether the level's words, in parts of PART_WORDS, hold all bits of a key."""
    word, mask = placed(key, level, n_words)
    held = F.get(F.get(words, F.floor(word / PART_WORDS).cast("int")), F.pmod(word, F.lit(PART_WORDS)).cast("int"))
    return held.bitwiseAND(mask) == mask


def level_words(keys: DataFrame, level: int, n_words: int) -> DataFrame:
    """The one row words array<array<long>> of a level that encodes keys(key); a task holds a part, and in the end a level."""
    word, mask = placed(F.col("key"), level, n_words)
    every = keys.sparkSession.range(n_words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("mask"))
    words = keys.select(word.alias("word"), mask.alias("mask")).unionAll(every).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    part = F.floor(F.col("word") / PART_WORDS).alias("part")
    parts = words.groupBy(part).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).getField("bits").alias("words"))
    return parts.agg(F.array_sort(F.collect_list(F.struct("part", "words"))).getField("words").alias("words"))


@dataclass
class Cascade:
    """Levels as (number of words, table with the one row words)."""

    levels: list[tuple[int, DataFrame]]

    def attach(self, rows: DataFrame, name: str) -> DataFrame:
        """rows with the levels' words as column name, an array with an entry per level, from scalar subqueries."""
        words = [table.scalar() for _, table in self.levels]
        return rows.withColumn(name, F.array(*words) if words else F.expr("cast(array() AS array<array<array<bigint>>>)"))

    def holds(self, key: Column, words: Column) -> Column:
        """Whether a key of the universe is listed; words is the attached column."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            passed = passes(key, i, self.levels[i - 1][0], F.get(words, F.lit(i - 1)))
            out = F.when(~passed, F.lit(i % 2 == 0)).otherwise(out)
        return out


def bits_per_key(members: int, others: int) -> int:
    """Bits of level 1: more where few listed keys meet many others, so that few of those pass."""
    return min(48, BITS + 2 * int(math.log2(1 + others / members)))


def build(universe: DataFrame, max_bytes: int = MAX_BYTES) -> Cascade | None:
    """Cascade over universe(key, listed), keys distinct; None if all its words would take more than max_bytes.

    A level is sized by the count of what it encodes, and its size is checked before it is built.
    """
    universe = stored(universe, "universe")
    tested, members = universe.where("NOT listed").select("key"), universe.where("listed").select("key")
    levels: list[tuple[int, DataFrame]] = []
    n_tested, n = tested.count(), members.count()
    total = 0
    while n:
        bits = BITS if levels else bits_per_key(n, n_tested)
        n_words = n * bits // 64 + 1
        total += 8 * n_words
        if total > max_bytes:
            return None
        words = stored(level_words(members, len(levels) + 1, n_words), f"level{len(levels) + 1}")
        levels.append((n_words, words))
        passed = tested.withColumn("words", words.scalar()).where(passes(F.col("key"), len(levels), n_words, F.col("words")))
        tested, members = members, stored(passed.select("key"), f"passed{len(levels)}")
        n = members.count()
    return Cascade(levels)


def corpus_keys(hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """(key, listed) for every distinct domain of hosts(host): one aggregation, hosts combined before they are cut."""
    held = hosts.distinct().select(F.explode(domains(F.col("host"))).alias("key"))
    named = listed.select(F.col("key").cast("string")).where("key IS NOT NULL")
    both = held.select("key", F.lit(True).alias("held"), F.lit(False).alias("listed"))
    both = both.unionAll(named.select("key", F.lit(False), F.lit(True)))
    return both.groupBy("key").agg(F.max("held").alias("held"), F.max("listed").alias("listed")).where("held").drop("held")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule (verdict, host, path) that fits, of equal ones that with the longer host; else null."""

    def fits(rule: tuple[str, str, str]) -> Column:
        _, name, start = rule
        return ((host == name) | F.endswith(host, F.lit(f".{name}"))) & F.startswith(path, F.lit(start))

    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    made = [F.when(fits(r), F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))) for r in order]
    return F.coalesce(*made) if made else F.lit(None).cast("struct<rule:string,verdict:string>")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], listed: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """pages(page_id, url) judged: page_id, host, path, rule, verdict, listed.

    rules are (allow or block, host, path): a rule fits its host and all subdomains where
    the path starts with the rule's; the longest wins. Where none fits, the verdict is block
    if the cascade holds the host or a parent domain of it, else allow; listed(key) has
    those domains in lower case. Null urls and those without :// have an empty host and
    path, fit no rule and are allowed. Domains beyond 253 characters are no names and
    cannot be listed, their shorter parents can. Repeated rows and null ids are judged each;
    repeated and null entries of listed do no harm. Other columns are left out. Empty tables give
    empty ones. Words of more than max_bytes are not sent to all tasks: hosts are then
    joined, distinct and salted, with the same result.
    """
    host, path = host_and_path(F.col("url").cast("string"))
    urls = pages.select(F.col("page_id").cast("long"), host.alias("host"), path.alias("path"))
    hosts = urls.select("host").where("host <> ''")
    keys = corpus_keys(hosts, listed)
    made = build(keys, max_bytes)
    if made:
        marked = made.attach(urls, "words")
        words = F.col("words")
        marked = marked.withColumn("listed", F.exists(domains(F.col("host")), lambda k: made.holds(k, words))).drop("words")
    else:
        salts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        held = hosts.distinct().select("host", F.explode(domains(F.col("host"))).alias("key"))
        found = held.join(keys.where("listed").select("key"), "key").select("host", F.lit(True).alias("found")).distinct()
        found = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        salted = urls.withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), F.lit(salts)).cast("int"))
        marked = salted.join(found, ["host", "salt"], "left").withColumn("listed", F.coalesce("found", F.lit(False)))
    rule = rule_of(F.col("host"), F.col("path"), rules)
    otherwise = F.when(F.col("listed"), "block").otherwise("allow")
    return marked.select(
        "page_id", "host", "path", rule["rule"].alias("rule"), F.coalesce(rule["verdict"], otherwise).alias("verdict"), "listed"
    )
