"""Mine the regular expressions that describe a site's URLs.

One scan turns URLs into a state of whole numbers: per site, bucket, node length and
character place the count, the smallest and the largest character and the classes of
characters seen there. Such rows merge by sum, min, max and bitwise or, so a site that
holds a third of all URLs is reduced map-side, batches merge without reading old URLs,
and what a site has does not grow with its URLs. Common prefixes and suffixes, and the
classes of what varies between them, are read off the state, all of a site in one place.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemine.functions import urls as U
from pagemine.functions.skew import join_per_key

BUCKET = ["site", "n_nodes", "n_kinds"]

# Characters added to a class besides the six URL specials and
# the word characters, in the order in which they are written.
OTHER_MARKS = ["-", "%", "#", "~", "!", "$", "'", "(", ")", "*", ",", ":", ";", "@",
               "[", "]", "{", "}", "|", "\\", "^", '"', "<", ">", "`", " "]
CLASS_MARKS = U.URL_SPECIALS + OTHER_MARKS
CLASS_ESCAPED = {"-", "[", "]", "\\", "^"}
WIDE_BIT = len(CLASS_MARKS)
LETTER_BIT = WIDE_BIT + 1
NON_ASCII = r"\x{80}-\x{10FFFF}"


def escape_regex(text: Column) -> Column:
    """Escape regular-expression metacharacters."""
    return F.regexp_replace(text, r"[\]\[\\.*+?^${}()|]", r"\\$0")


def shared_prefix_length(low: Column, high: Column) -> Column:
    """Length of the common prefix of two strings.

    With the smallest and the largest string of a group this is the common
    prefix of the whole group.
    """
    longest = F.least(F.length(low), F.length(high))
    return F.array_max(
        F.filter(
            F.sequence(F.lit(0), longest),
            lambda n: F.substring(low, F.lit(1), n) == F.substring(high, F.lit(1), n),
        )
    )


def common_prefix(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Longest common prefix of `text` per group, from the group's min and max."""
    found = df.groupBy(*keys).agg(F.min(text).alias("low"), F.max(text).alias("high"))
    length = shared_prefix_length(F.col("low"), F.col("high"))
    return found.select(*keys, F.substring("low", F.lit(1), length).alias("prefix"))


def common_suffix(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Longest common suffix of `text` per group: the prefix of the reversed strings."""
    found = common_prefix(df.withColumn(text, F.reverse(text)), keys, text)
    return found.select(*keys, F.reverse("prefix").alias("suffix"))


def url_shapes(urls: DataFrame, url: str = "url") -> DataFrame:
    """(site, url) → the parts the miner works on. A root URL counts as one empty node."""
    nodes = U.url_nodes(F.col(url))
    return (
        urls.select("site", F.col(url).alias("url"), nodes.alias("nodes"))
        .withColumn("nodes", F.when(F.size("nodes") == 0, F.array(F.lit(""))).otherwise(F.col("nodes")))
        .withColumn("short_url", F.array_join("nodes", "/"))
        .withColumn("n_nodes", F.size("nodes"))
        .withColumn("n_kinds", U.special_kinds(F.col("short_url")))
        .withColumn("short_len", F.length("short_url"))
    )


def length_bounds(lengths: DataFrame) -> DataFrame:
    """Per site the open interval of short-URL lengths that are not outliers.

    `lengths` holds (site, short_len, n). Kept are lengths closer to the mean than
    two population deviations; when all lengths are equal the deviation is zero and
    every URL is kept.
    """
    n, length = F.col("n"), F.col("short_len").cast("bigint")
    stats = lengths.groupBy("site").agg(
        F.sum(n).alias("n"),
        F.sum(n * length).alias("s1"),
        F.sum(n * length * length).alias("s2"),
        F.min("short_len").alias("lo_len"),
        F.max("short_len").alias("hi_len"),
    )
    mean = F.col("s1") / F.col("n")
    reach = 2 * F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0)))
    same = F.col("lo_len") == F.col("hi_len")
    return stats.select(
        "site",
        F.when(same, F.lit(-1.0)).otherwise(mean - reach).alias("len_above"),
        F.when(same, F.lit(float("inf"))).otherwise(mean + reach).alias("len_below"),
    )


def _within_bounds() -> Column:
    return (F.col("short_len") > F.col("len_above")) & (F.col("short_len") < F.col("len_below"))


def filter_url_outliers(urls: DataFrame) -> DataFrame:
    """Keep the URLs of each site whose short-URL length is no outlier."""
    shapes = url_shapes(urls)
    bounds = length_bounds(shapes.groupBy("site", "short_len").agg(F.count("*").alias("n")))
    return join_per_key(shapes, bounds, ["site"], F.col("url")).where(_within_bounds()).select("site", "url", "short_url")


def url_buckets(urls: DataFrame) -> DataFrame:
    """Short URLs counted per (site, node count, special kinds)."""
    return url_shapes(urls).groupBy(*BUCKET).agg(F.count("*").alias("support"))


#: What tells the rows of a state apart; `at` is a place in the node, the node's length standing for its end.
STATE_KEY = [*BUCKET, "short_len", "pos", "node_len", "at"]
STATE = "site string, n_nodes int, n_kinds int, short_len int, pos int, node_len int, at int, n long, low int, high int, mask long"
_MARKS = "".join(CLASS_MARKS)


def _character(c: Column) -> Column:
    """Code point and class bit of one character: one bit per mark, one for non-ASCII characters, one for letters."""
    code = F.ascii(c)
    mark = F.instr(F.lit(_MARKS), c)
    bit = (
        F.when(mark > 0, mark - 1)
        .when(code >= 128, WIDE_BIT)
        .when(code.between(65, 90) | code.between(97, 122), LETTER_BIT)
    )
    return F.struct(code.alias("code"), F.coalesce(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit), F.lit(0)).cast("bigint").alias("bit"))


def _places(node: Column, pos: Column) -> Column:
    """The characters of a node with their places, and its end."""
    size = F.length(node).cast("int")

    def place(c: Column, at: Column) -> Column:
        found = _character(c)
        return F.struct(pos.alias("pos"), size.alias("node_len"), at.alias("at"), found["code"].alias("code"), found["bit"].alias("bit"))

    end = F.struct(pos.alias("pos"), size.alias("node_len"), size.alias("at"), F.lit(0).alias("code"), F.lit(0).cast("bigint").alias("bit"))
    return F.concat(F.when(size > 0, F.transform(F.split(node, ""), place)).otherwise(F.array().cast(_PLACES)), F.array(end))


_PLACES = "array<struct<pos:int,node_len:int,at:int,code:int,bit:bigint>>"


def mining_state(urls: DataFrame) -> DataFrame:
    """(site, url) → the state of their sites (STATE), from one scan."""
    shapes = url_shapes(urls).select(*BUCKET, "short_len", "nodes")
    rows = shapes.select(*BUCKET, "short_len", F.inline(F.flatten(F.transform("nodes", _places))))
    return rows.groupBy(*STATE_KEY).agg(
        F.count("*").alias("n"), F.min("code").alias("low"), F.max("code").alias("high"), F.bit_or("bit").alias("mask")
    )


def merge_states(*states: DataFrame) -> DataFrame:
    """States of disjoint sets of URLs as the state of all of them."""
    return reduce(DataFrame.unionByName, states).groupBy(*STATE_KEY).agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or("mask").alias("mask")
    )


def _kept_lengths(state: DataFrame) -> DataFrame:
    """The rows of URLs whose length is no outlier at their site (`length_bounds`)."""
    site = W.partitionBy("site")
    url = (F.col("pos") == 0) & (F.col("at") == F.col("node_len"))
    n, length = F.when(url, F.col("n")), F.col("short_len").cast("bigint")
    held = state.withColumns({
        "_n": F.sum(n).over(site), "_s1": F.sum(n * length).over(site), "_s2": F.sum(n * length * length).over(site),
        "_lo": F.min("short_len").over(site), "_hi": F.max("short_len").over(site),
    })
    mean = F.col("_s1") / F.col("_n")
    reach = 2 * F.sqrt(F.greatest(F.col("_s2") / F.col("_n") - mean * mean, F.lit(0.0)))
    inside = (F.col("short_len") > mean - reach) & (F.col("short_len") < mean + reach)
    return held.where((F.col("_lo") == F.col("_hi")) | inside).drop("_n", "_s1", "_s2", "_lo", "_hi")


def _spelt(place: str, code: str, wanted: Column, descending: bool) -> Column:
    """The characters of the wanted rows as a string, in the order of their places."""
    codes = F.sort_array(F.collect_set(F.when(wanted, F.struct(F.col(place).alias("place"), F.col(code).alias("code")))), not descending)
    one = lambda c: F.decode(F.unhex(F.lpad(F.hex(c["code"]), 8, "0")), "UTF-32")
    return F.array_join(F.transform(codes, one), "")


def bucket_frames(state: DataFrame, drop_outliers: bool = True) -> DataFrame:
    """Per bucket position: support, what is fixed before and after, and the classes of what varies between.

    All windows are inside a site, whose state is small however many URLs it has.
    """
    state = state.repartition("site")
    kept = _kept_lengths(state) if drop_outliers else state
    node = [*BUCKET, "pos"]
    places = kept.groupBy(*node, "node_len", "at").agg(
        F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.bit_or("mask").alias("mask")
    )
    is_end = F.col("at") == F.col("node_len")
    whole = W.partitionBy(*node)
    places = places.withColumn("back", F.col("node_len") - 1 - F.col("at")).withColumns({
        "support": F.sum(F.when(is_end, F.col("n"))).over(whole),
        "min_len": F.min("node_len").over(whole),
        "max_len": F.max("node_len").over(whole),
    })

    def common(place: str) -> dict[str, Column]:
        """Whether all nodes have the same character at a place, and which."""
        here = W.partitionBy(*node, place)
        inner = F.when(~is_end, F.col("n"))
        low, high = (f(F.when(~is_end, F.col(c))).over(here) for f, c in ((F.min, "low"), (F.max, "high")))
        return {f"{place}_code": low, f"{place}_same": ~is_end & (low == high) & (F.sum(inner).over(here) == F.col("support"))}

    places = places.withColumns({**common("at"), **common("back")})
    places = places.withColumns({
        "head_len": F.min(F.when(~F.col("at_same"), F.col("at"))).over(whole),
        "tail_len": F.coalesce(F.min(F.when(~is_end & ~F.col("back_same"), F.col("back"))).over(whole), F.col("min_len")),
    })
    # a tail longer than the shortest node allows: places beyond it lack nodes and are never common
    fixed = (F.col("head_len") == F.col("max_len")) & (F.col("min_len") == F.col("max_len"))
    places = places.withColumn("fixed", fixed).withColumn(
        "tail_len",
        F.when(F.col("fixed") | (F.col("head_len") + F.col("tail_len") > F.col("min_len")), 0).otherwise(F.col("tail_len")),
    )
    varies = ~is_end & (F.col("at") >= F.col("head_len")) & (F.col("back") >= F.col("tail_len"))
    return places.groupBy(*node).agg(
        F.max("support").alias("support"),
        F.max("fixed").alias("fixed"),
        F.max(F.col("min_len") - F.col("head_len") - F.col("tail_len")).alias("shortest_middle"),
        F.coalesce(F.bit_or(F.when(varies, F.col("mask"))), F.lit(0)).cast("bigint").alias("mask"),
        _spelt("at", "at_code", ~is_end & (F.col("at") < F.col("head_len")), False).alias("prefix"),
        _spelt("back", "back_code", ~is_end & (F.col("back") < F.col("tail_len")), True).alias("suffix"),
    )


def _assemble_regex(mask: Column, last: Column) -> Column:
    def has(bit):
        return mask.bitwiseAND(F.lit(1 << bit).cast("bigint")) != 0

    marks = [
        F.when(has(bit), F.lit("\\" + mark if mark in CLASS_ESCAPED else mark)).otherwise("")
        for bit, mark in enumerate(CLASS_MARKS)
    ]
    marks.append(F.when(has(WIDE_BIT), F.lit(NON_ASCII)).otherwise(""))
    marks = F.concat(*marks)
    wordy = has(LETTER_BIT)
    core = F.when(wordy, F.lit(r"\w")).otherwise(F.lit(r"\d"))
    many = F.when(F.col("shortest_middle") == 0, "*").otherwise("+")
    body = F.when(marks == "", F.concat(core, many)).otherwise(F.concat(F.lit("["), marks, core, F.lit("]"), many))
    # Word characters next to a \w class are covered by it; those at the end of the
    # last node need not be spelled out, since rules are searched, not anchored.
    trimmed = F.regexp_replace(F.col("suffix"), r"^\w+", "")
    trimmed = F.when(last, F.regexp_replace(trimmed, r"\w+$", "")).otherwise(trimmed)
    suffix = F.when(wordy, trimmed).otherwise(F.col("suffix"))
    varied = F.concat(escape_regex(F.col("prefix")), body, escape_regex(suffix))
    fixed, prefix = F.col("fixed"), F.col("prefix")
    return F.when(fixed & (prefix == ""), F.lit(".*")).when(fixed, escape_regex(prefix)).otherwise(varied)


def node_regexes(urls: DataFrame, drop_outliers: bool = True) -> DataFrame:
    """One regular expression per bucket position."""
    return state_regexes(mining_state(urls), drop_outliers)


def state_regexes(state: DataFrame, drop_outliers: bool = True) -> DataFrame:
    last = F.col("pos") == F.col("n_nodes") - 1
    frames = bucket_frames(state, drop_outliers)
    return frames.withColumn("regex", _assemble_regex(F.col("mask"), last)).select(*BUCKET, "pos", "regex", "prefix", "suffix", "support")


def mine_url_rules(urls: DataFrame, prefix: str | Column = ".*", nums: int = 5, drop_outliers: bool = True) -> DataFrame:
    """(site, url) → the best `nums` URL rules of every site, ranked by support."""
    return state_rules(mining_state(urls), prefix, nums, drop_outliers)


def state_rules(state: DataFrame, prefix: str | Column = ".*", nums: int = 5, drop_outliers: bool = True) -> DataFrame:
    """The best `nums` URL rules of every site of a state."""
    start = F.lit(prefix) if isinstance(prefix, str) else prefix
    rules = (
        state_regexes(state, drop_outliers)
        .groupBy(*BUCKET)
        .agg(
            F.array_sort(F.collect_list(F.struct("pos", "regex"))).alias("parts"),
            F.max("support").alias("support"),
        )
        .withColumn("regex", F.concat(start, F.lit("/"), F.array_join(F.col("parts.regex"), "/")))
    )
    best = W.partitionBy("site").orderBy(F.desc("support"), "n_nodes", "n_kinds", "regex")
    return (
        rules.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= nums)
        .select("site", "regex", "n_nodes", "n_kinds", "support", "rank")
    )


def best_site_rule(sites: DataFrame, rules: DataFrame) -> DataFrame:
    """The top rule of every site, an empty string where a site has none."""
    top = rules.where("rank = 1").select("site", F.col("regex").alias("article_regex"))
    return sites.select("site").distinct().join(top, "site", "left").fillna("", ["article_regex"])


def filter_by_rule(records: DataFrame, rules: DataFrame) -> DataFrame:
    """Records whose URL contains a match of the best rule of their site."""
    top = rules.where("rank = 1").select("site", F.col("regex").alias("article_regex"))
    joined = join_per_key(records, top, ["site"], F.col("url"))
    return joined.where(F.regexp_like("url", F.col("article_regex")))
