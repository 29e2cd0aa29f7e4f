"""URL rules by exact membership in Bloom filter cascades.

The rules of one verdict are the listed keys of a cascade. Its first level
encodes them, the second the keys of the corpus that pass the first by mistake,
the third the listed keys that pass the second by mistake, and so on until a
level errs no more. Over the corpus's own keys the answer is then exact, and a
row is judged by a few bit tests instead of a join. Column functions only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tallywise.llm.common import save

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
VERDICTS = ("allow", "block")
SLICE_KEYS = 500_000  # listed keys that one filter encodes; longer lists are cut by hash, with one pass for each slice
BITMAP = 8 * 4096  # bits that bitmap_construct_agg packs into one value

Level = tuple[bytes, int, int]  # the bits, how many, and how many hash functions


def parse_url(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host and path; a url that is null or has no ``://`` has two empty ones."""
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return pages.select(F.col(f"`{id_col}`").alias("page_id"), rest.alias("rest")).select(
        "page_id", F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))


def rule_keys(rules: DataFrame) -> DataFrame:
    """host, path, verdict and key (host and path in one); nulls count as empty."""
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    path = F.coalesce("path", F.lit(""))
    return rules.select(host.alias("host"), path.alias("path"), "verdict", F.concat(host, path).alias("key")).distinct()


def label_count(host: str | Column) -> Column:
    return F.size(F.split(host, r"\."))


def candidates(shapes: list[tuple[int, int]]) -> Column:
    """All (host, path, key) that a rule fitting the row could have, given the (labels, path length) that rules have."""
    parts = F.split("host", r"\.")
    given = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).alias("m")) for n, m in shapes])
    fits = F.filter(given, lambda s: (s["n"] <= F.size(parts)) & (s["m"] <= F.length("path")))

    def cut(s: Column) -> Column:
        host = F.array_join(F.slice(parts, F.size(parts) - s["n"] + 1, s["n"]), ".")
        path = F.substring(F.col("path"), F.lit(1), s["m"])
        return F.struct(F.concat(host, path).alias("key"), F.length(host).alias("host_length"),
                        (F.length(host) + s["m"]).alias("length"))

    return F.transform(fits, cut)


def bit_of(key: str | Column, level: int, k: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), k), F.lit(bits))


def encode(spark: SparkSession, keys: DataFrame, level: int, count: int, rate: float) -> Level:
    """A Bloom filter of ``count`` keys; ``rate`` of all others pass it by mistake."""
    size = math.ceil(count * -math.log(rate) / math.log(2) ** 2 / BITMAP) or 1
    hashes = max(1, round(-math.log2(rate)))
    spots = (keys.select("key", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))).alias("k"))
             .select(bit_of("key", level, F.col("k"), size * BITMAP).alias("bit")))
    part = F.floor(F.col("bit") / BITMAP)
    maps = spots.groupBy(part.alias("id")).agg(F.bitmap_construct_agg(F.col("bit") % BITMAP).alias("bits"))
    none = F.unhex(F.repeat(F.lit("00"), BITMAP // 8))
    # one row: a slice bounds the number of keys, and with it that of the maps
    row = (spark.range(size).join(maps, "id", "left").select("id", F.coalesce("bits", none).alias("bits"))
           .agg(F.array_sort(F.collect_list(F.struct("id", F.hex("bits").alias("bits")))).alias("maps"))
           .select(F.unhex(F.array_join("maps.bits", "")).alias("bits"))).first()
    return bytes(row.bits), size * BITMAP, hashes


def passes(key: Column, level: int, filter_: Level) -> Column:
    """Whether every bit of the key is set."""
    packed, bits, hashes = filter_
    held = F.lit(packed)

    def is_set(k: Column) -> Column:
        bit = bit_of(key, level, k, bits)
        byte = F.substring(held, (F.floor(bit / 8) + 1).cast("int"), F.lit(1))
        return F.getbit(F.ascii(F.decode(byte, "ISO-8859-1")).cast("long"), (bit % 8).cast("int")) == 1

    return F.forall(F.sequence(F.lit(0), F.lit(hashes - 1)), is_set)


def is_listed(key: Column, cascade: list[Level]) -> Column:
    """Exact for every key of the corpus: in the first level, and not in the second unless in the third, and so on."""
    answer = F.lit(True)
    for level in range(len(cascade), 0, -1):
        answer = passes(key, level, cascade[level - 1]) & (answer if level == len(cascade) else ~answer)
    return answer if cascade else F.lit(False)


def deeper_levels(spark: SparkSession, first: Level, listed: DataFrame, wrong: DataFrame) -> list[Level]:
    """The cascade below ``first``; ``wrong`` are the corpus's keys that pass it and aren't listed."""
    cascade, inside, outside = [first], wrong, listed
    count = inside.count()
    while count:
        cascade.append(encode(spark, inside, len(cascade) + 1, count, 0.5))
        inside, outside = save(spark, outside.where(passes(F.col("key"), len(cascade), cascade[-1])), "bloom-errors"), inside
        count = inside.count()
    return cascade


def judge_urls(spark: SparkSession, pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id",
               url_col: str = "url", slice_keys: int = SLICE_KEYS) -> DataFrame:
    """One row per input row: page_id, host, path, rule and verdict.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host
    and all subdomains, if the path of the url starts with the rule's. The
    longest fitting rule decides, of two equally long ones that with the longer
    host, of two with equal host and path the one that blocks. A url that no
    rule fits has a null rule and the verdict ``default``. A-Z in hosts are
    lower-cased. A null url or one without ``://`` has an empty host and path,
    which only a rule with both empty would fit; nulls in rules count as empty,
    and any other verdict is an error. Repeated rows are judged each; empty
    tables give an empty result or the default; other columns are ignored.

    The keys of the corpus are what its urls offer for the shapes that rules
    have (number of host labels, length of path): the whole universe of the
    cascades. Only keys that pass the first level by mistake leave a task.
    """
    rules = save(spark, rule_keys(rules), "rules")
    if not rules.where(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False))).isEmpty():
        raise ValueError("a rule's verdict is allow or block")
    # at most labels of a host x distinct lengths of a path
    shapes = [tuple(r) for r in rules.select(label_count("host"), F.length("path")).distinct().collect()]
    rows = parse_url(pages, id_col, url_col)
    if not shapes:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    universe = max(1, pages.count() * len(shapes))
    rows = rows.withColumn("found", F.array().cast("array<struct<length:int,host_length:int,verdict:string,key:string>>"))
    slices = max(1, math.ceil(rules.count() / slice_keys))
    for i in range(slices):
        def here(key: Column) -> Column:
            return F.pmod(F.xxhash64(key), F.lit(slices)) == i

        listed, firsts = {}, {}
        for verdict in VERDICTS:
            keys = rules.where((F.col("verdict") == verdict) & here(F.col("key"))).select("key")
            if count := keys.count():
                listed[verdict] = keys
                firsts[verdict] = encode(spark, keys, 1, count, min(0.5, count / universe / math.sqrt(2)))
        if not firsts:
            continue

        def passed(key: Column) -> Column:
            hit = F.lit(False)
            for f in firsts.values():
                hit = hit | passes(key, 1, f)
            return here(key) & hit

        offered = F.filter(candidates(shapes), lambda c: passed(c["key"]))
        seen = save(spark, rows.select(F.explode(offered).alias("c")).select("c.key").distinct(), "bloom-passed")
        cascades = {}
        for verdict, first in firsts.items():
            wrong = save(spark, seen.where(passes(F.col("key"), 1, first)).join(listed[verdict], "key", "left_anti"), "bloom-errors")
            cascades[verdict] = deeper_levels(spark, first, listed[verdict], wrong)

        def judged(verdict: str) -> Column:
            held = F.filter(candidates(shapes), lambda c: here(c["key"]) & is_listed(c["key"], cascades[verdict]))
            return F.transform(held, lambda c: F.struct(c["length"].alias("length"), c["host_length"].alias("host_length"),
                                                        F.lit(verdict).alias("verdict"), c["key"].alias("key")))

        rows = rows.withColumn("found", F.concat("found", *[judged(v) for v in cascades]))
        if i + 1 < slices:
            rows = save(spark, rows, "judged")  # so that a task holds the filters of one slice only
    best = F.array_max("found")
    return rows.select("page_id", "host", "path", best["key"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))
