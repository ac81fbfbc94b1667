"""URL verdicts: prefix rules first, then exact membership in a block list by a Bloom filter cascade.

Level 1 is a Bloom filter of the listed keys; the keys of the corpus that it lets through wrongly are
encoded in level 2, the listed keys that level 2 lets through in level 3, and so on until a level lets
nothing through. The corpus's own keys are the universe, so membership is exact for every row, and a
row is judged by hashing its key: no join. The levels are a few bits per listed key (about
1.44 * log2(universe / listed) + 3), the only thing that travels.

Defined results: a null url, or one without ``://``, has empty host and path, and is allowed; an empty
host is never listed; repeated urls get the same verdict; an empty table gives an empty table; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewspark.llm.common import stored

# Fixed values: (rule, host, path, verdict).
PATH_RULES = (
    ("net/", "net", "/", "block"),
    ("example.net/en/", "example.net", "/en/", "allow"),
    ("example.com/de/", "example.com", "/de/", "block"),
    ("org/fr/", "org", "/fr/", "allow"),
)
#: Words in a host that put it on the block list of the registered query.
LISTED_WORDS = ("pills", "casino", "bets", "adult", "spam", "ads-track")
MAX_LEVELS = 64


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) after the first ``://`` and the path up to ``?``, ``#`` or the end; both empty without it."""
    parts = r"(?s)\A.*?://([^/?#]*)([^?#]*)"
    host = F.translate(F.regexp_extract(url, parts, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, parts, 2), F.lit(""))


def matched_rule(host: Column, path: Column, rules=PATH_RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(name).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def level_size(inserted: int, others: int, level: int) -> tuple[int, int]:
    """(64-bit words, hashes): level 1 lets through about as many others as are listed; deeper levels every second key."""
    rate = 0.5 if level > 1 else min(0.5, max(inserted, 1) / max(others, 1) / math.sqrt(2))
    bits = max(64, math.ceil(1.4427 * math.log2(1 / rate) * max(inserted, 1)))
    return math.ceil(bits / 64), max(1, round(math.log2(1 / rate)))


def positions(key: Column, words: int, hashes: int, level: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(F.lit(level * 101 + i), key), F.lit(words * 64)) for i in range(hashes)])


def build_level(keys: DataFrame, words: int, hashes: int, level: int) -> list[int]:
    """Bits of one level, OR-ed per 64-bit word before and after the shuffle."""
    bits = keys.select(F.explode(positions(F.col("key"), words, hashes, level)).alias("p")).select(
        F.floor(F.col("p") / 64).alias("word"), F.expr("shiftleft(1L, CAST(p % 64 AS INT))").alias("bit"))
    found = {r["word"]: r["bits"] for r in bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()}
    return [found.get(i, 0) for i in range(words)]


def passes(key: Column, level: tuple[list[int], int, int]) -> Column:
    """Whether one level holds ``key``: all its bits are set."""
    bits, hashes, number = level
    table = F.lit(bits).cast("array<long>")
    return F.forall(positions(key, len(bits), hashes, number), lambda p: F.getbit(F.get(table, F.floor(p / 64).cast("int")), (p % 64).cast("int")) == 1)


def cascade(universe: DataFrame, listed: Column) -> list[tuple[list[int], int, int]]:
    """Levels (bits, hashes, number) for the distinct non-null ``key`` of ``universe``; ``listed`` is a boolean over them.

    Each level reads only the keys that are still undecided. The driver holds the bits of the levels,
    whose number is bounded by the listed keys, and no key.
    """
    state = stored(universe.select("key", listed.alias("listed")), "cascade-keys")
    levels: list[tuple[list[int], int, int]] = []
    turn = True
    while True:
        counts = {r["listed"]: r["n"] for r in state.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}
        inserted, others = counts.get(turn, 0), counts.get(not turn, 0)
        if not inserted:
            return levels
        if len(levels) >= MAX_LEVELS:
            raise RuntimeError("the cascade does not settle: two keys share all their hashes")
        number = len(levels) + 1
        words, hashes = level_size(inserted, others, number)
        levels.append((build_level(state.where(F.col("listed") == F.lit(turn)), words, hashes, number), hashes, number))
        wrong = state.where((F.col("listed") == F.lit(turn)) | passes(F.col("key"), levels[-1]))
        state = stored(wrong, "cascade-keys")
        turn = not turn


def member(key: Column, levels) -> Column:
    """Exact membership for keys of the universe: the first level that does not hold the key decides."""
    out = F.lit(len(levels) % 2 == 1)
    for depth in range(len(levels) - 1, -1, -1):
        out = F.when(~passes(key, levels[depth]), F.lit(depth % 2 == 1)).otherwise(out)
    return out if levels else F.lit(False)


def judge(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules=PATH_RULES, listed=None) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed). ``listed`` maps a host column to a boolean: the block list."""
    listed = listed or (lambda host: host.rlike("|".join(LISTED_WORDS)))
    host, path = host_and_path(pages[url].cast("string"))
    rows = pages.select(pages[page_id].alias("page_id"), host.alias("host"), path.alias("path"))
    universe = rows.where("host <> ''").select(F.col("host").alias("key")).distinct()
    levels = cascade(universe, F.coalesce(listed(F.col("key")), F.lit(False)))
    judged = rows.withColumn("hit", matched_rule(F.col("host"), F.col("path"), rules)).withColumn(
        "listed", (F.col("host") != "") & member(F.col("host"), levels))
    return judged.select("page_id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"), "listed")
