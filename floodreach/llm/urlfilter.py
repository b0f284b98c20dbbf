"""URL filters: longest-prefix rules, and exact list membership by a Bloom filter cascade. DataFrame functions only.

Level 1 of the cascade encodes the listed keys of the corpus, level 2 the keys it wrongly accepts, level 3 the listed keys that
level 2 wrongly accepts, and so on until no key is wrong. A key's membership is then known from the first level that
rejects it: exactly, for every key of the universe, without joining the corpus to the list.

Scale: keys are aggregated once to the distinct universe; pages are scanned once and never shuffled. A level is a table of
64-bit words made by bitwise aggregation, sorted into one array that the pages' scan reads as a scalar subquery. All levels
together may hold ``max_words`` words (8 bytes each). The words of a longer cascade stay rows of a table: each distinct key asks
for the few words it needs by equality joins, level by level while it is accepted, and one more join brings the answers to the
pages. No row carries a level.

Defined cases: a null url, or one without ``://``, has an empty host and path, fits no rule, and the empty key is never listed;
of rules of equal length the one greatest in order
of host and path counts; repeated pages are judged each on its own; an empty list blocks nothing; other columns are not read."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

# The rules of the contract, host without subdomains, path prefix, verdict
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
BITS_PER_KEY, HASHES, MAX_WORDS = 10, 4, 1 << 17
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host, and path without query and fragment; both empty where there is no ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, pattern, 1), _UPPER, _LOWER), F.regexp_extract(text, pattern, 2)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct of the longest rule that fits, and its verdict; null where none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        out = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _spots(key: Column, level: int, words: int) -> list[Column]:
    """The bits of a key on one level, as positions in ``words`` 64-bit words."""
    n = F.lit(words * 64)
    a, b = (F.pmod(F.xxhash64(key, F.lit(2 * level + i)), n) for i in (0, 1))
    return [F.pmod(a + i * b, n) for i in range(HASHES)]


def _accepts(key: Column, level: int, words: int, bits: Column) -> Column:
    out = F.lit(True)
    for p in _spots(key, level, words):
        word = F.element_at(bits, (F.shiftright(p, 6) + 1).cast("int"))
        out = out & (F.call_function("shiftrightunsigned", word, (p % 64).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1)
    return out


def _level(keys: DataFrame, level: int, words: int) -> DataFrame:
    """The filter over the keys: w, v of every word that has a bit set."""
    spots = keys.select(F.explode(F.array(*_spots(F.col("key"), level, words))).alias("p"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("p") % 64).cast("int"))
    return spots.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(bit).alias("v"))


def _packed(filled: DataFrame, words: int) -> DataFrame:
    """One row: all ``words`` words as an array, in order. Words without a bit come from a range, so that a sort lays them out."""
    every = filled.unionByName(filled.sparkSession.range(words).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("v")))
    whole = every.groupBy("w").agg(F.bit_or("v").alias("v"))
    return whole.agg(F.sort_array(F.collect_list(F.struct("w", "v"))).alias("a")).select(F.col("a.v").alias("bits"))


def _size(n: int) -> int:
    return max(1, -(-n * BITS_PER_KEY // 64))


class Cascade:
    """Exact membership of the keys of a universe in a list.

    ``universe`` has distinct, non-null ``key``s and a boolean ``listed``. Building takes one small job per level; levels
    shrink by the false positive rate, about a hundredfold every one."""

    def __init__(self, universe: DataFrame, max_words: int = MAX_WORDS):
        universe = materialize(universe.select("key", "listed"), "universe")
        left = universe.agg(F.coalesce(F.count_if("listed"), F.lit(0))).first()[0]
        self.packed = 2 * _size(left) <= max_words
        self.levels: list[tuple[int, DataFrame]] = []
        mine, other = universe.filter("listed"), universe.filter(~F.col("listed"))
        while left:
            words = _size(left)
            filled = materialize(_level(mine, len(self.levels), words), "words")
            self.levels.append((words, materialize(_packed(filled, words), "level") if self.packed else filled))
            wrong = materialize(self._accepted(other, len(self.levels) - 1).select("key"), "wrong")
            mine, other, left = wrong, mine, wrong.count()

    def _test(self, key: Column, level: int) -> Column:
        words, table = self.levels[level]
        return F.coalesce(_accepts(key, level, words, table.scalar()), F.lit(False))

    def _accepted(self, keys: DataFrame, level: int) -> DataFrame:
        """Those of distinct keys that a level accepts."""
        if self.packed:
            return keys.filter(self._test(F.col("key"), level))
        words, table = self.levels[level]
        spots = keys.select("key", F.explode(F.array(*_spots(F.col("key"), level, words))).alias("p"))
        met = spots.join(table, F.shiftright("p", 6) == F.col("w"))
        is_set = F.call_function("shiftrightunsigned", F.col("v"), (F.col("p") % 64).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1
        return met.filter(is_set).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == HASHES).select("key")

    def decide(self, df: DataFrame, key: Column, name: str) -> DataFrame:
        """``df`` with a boolean column: whether the key is listed. Only keys of the universe may be asked for; a null key is not listed."""
        if not self.levels:
            return df.withColumn(name, F.lit(False))
        if self.packed:
            verdict = F.lit(len(self.levels) % 2 == 1)  # accepted by all levels: in the set of the last one
            for i in range(len(self.levels) - 1, -1, -1):
                verdict = F.when(~self._test(key, i), F.lit(i % 2 == 1)).otherwise(verdict)
            return df.withColumn(name, verdict)
        asked = materialize(df.select(key.alias("key")).filter("key is not null").distinct(), "asked")
        through, depth = asked, []  # a key's depth is the number of levels that accept it; an odd depth is a listed key
        for i in range(len(self.levels)):
            through = materialize(self._accepted(through, i), "accepted")
            depth.append(through)
        listed = depth[0].withColumn("n", F.lit(1))
        for through in depth[1:]:
            listed = listed.unionByName(through.withColumn("n", F.lit(1)))
        listed = listed.groupBy("key").agg(F.sum("n").alias("n")).filter("n % 2 = 1").select(F.col("key").alias("_listed_key"))
        joined = df.join(materialize(listed, "listed"), key == F.col("_listed_key"), "left")
        return joined.withColumn(name, F.col("_listed_key").isNotNull()).drop("_listed_key")


def judge(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]] = RULES, max_words: int = MAX_WORDS) -> DataFrame:
    """page_id, host, path, rule, verdict. ``listed`` has a column ``host``: hosts to block where no rule decides."""
    host, path = host_and_path(F.col("url"))
    seen = pages.select(host.alias("key")).filter("key <> ''").select("key", F.lit(True).alias("seen"), F.lit(False).alias("named"))
    named = listed.select(F.col("host").cast("string").alias("key")).filter("key <> ''").select("key", F.lit(False).alias("seen"), F.lit(True).alias("named"))
    universe = seen.unionByName(named).groupBy("key").agg(F.bool_or("seen").alias("seen"), F.bool_or("named").alias("listed")).filter("seen")
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    out = Cascade(universe, max_words).decide(parts, F.col("host"), "listed")
    fit = fitting_rule(F.col("host"), F.col("path"), rules)
    other = F.when((F.col("host") != "") & F.col("listed"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", fit["rule"].alias("rule"), F.coalesce(fit["verdict"], other).alias("verdict"))
