"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents get a fixed pseudo-random place within their source and are dealt by
it to blocks of about BLOCK words.  A source's target says how many of its
blocks the mix draws: whole passes over all blocks, then the first blocks of
one more pass; of the last block only as many documents as the target still
asks for.  The draws of all sources are split among output shards of equal
size: a tree halves the shards, and at each node the draws of each source that
go left are multivariate hypergeometric, as if all draws were shuffled as a
whole.  A shard's draws are a range of the permuted draws of each source, so
shards are disjoint.  Only numbers of blocks pass through the tree; texts are
shuffled once, when the mix is written.

All of it is built-in functions: no Python runs on executors, and no window or
array holds more than a block's documents, `ranks.WIDTH` places or GROUP sources.

Defined cases: null texts and texts without words have size 0 and are taken 0
words; null is a source of its own, last in order; sources without words have
target 0; rows of equal key and text are taken alike; an empty table gives an
empty mix.  Columns other than key, text and source never matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlake.llm.tables import bounded, same, saved
from matchlake.operators.ranks import ranked, running

#: Weights of the sources in their order, again and again.
WEIGHTS = (5, 2, 1)
#: A source is repeated so often at most.
MOST = 3
#: Words of a block on average, and draws of a shard.
BLOCK, SHARD = 1 << 16, 16
#: Sources that one row of the tree splits; more are split as groups first.
GROUP_BITS = 8
#: Draws of a source at most: products with STEP stay below 2**63.
_STEP, _LIMIT = 1_000_000_007, 1_000_000_000
_WORDS = r"[^\x20\x09-\x0D]+"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _columns(key: Column, text: Column, seed: int) -> list[Column]:
    """size, the number of words, and place in [0, 1), which seed, key and text decide."""
    whole = F.coalesce(text, F.lit(""))
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.md5(whole.cast("binary"))).cast("binary"))
    place = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)
    return [F.regexp_count(whole, F.lit(_WORDS)).cast("long").alias("size"), place.alias("place")]


def sized(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    """(key, source, size, place) of each document."""
    return docs.select(F.col(key).alias("key"), F.col(source).alias("source"), *_columns(F.col(key), F.col(text), seed))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """Per source of sized rows: rank, source_size, target, blocks, passes (whole ones) and rest (words of the last pass).

    The size of all sources is shared by weight; what a source can't take, being
    above `most` times its size, is shared among the others until none is above.
    """
    sums = ranked(rows.groupBy("source").agg(F.sum("size").alias("source_size")), F.col("source").asc_nulls_last(), name="rank")
    listed = saved(sums.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")))
    first = listed.agg(F.sum("source_size"), F.sum("weight")).first()
    total = first[0] or 0
    left, shares = total, first[1] or 1
    top = F.col("source_size") * most

    def fair() -> Column:
        return F.lit(float(left)) * F.col("weight") / F.lit(float(shares))

    while True:
        row = listed.agg(F.sum(F.when(top < fair(), top).otherwise(0)), F.sum(F.when(top < fair(), 0).otherwise(F.col("weight")))).first()
        now = (total - (row[0] or 0), row[1] or 1)
        if now == (left, shares):
            break
        left, shares = now
    target = F.when(top < fair(), top.cast("double")).otherwise(fair())
    words = F.col("source_size").cast("double")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / words)).otherwise(0).cast("long")
    out = listed.withColumn("target", target).withColumn("blocks", F.ceil(words / block).cast("long")).withColumn("passes", passes)
    return out.withColumn("rest", F.col("target") - F.col("passes") * words)


def _dealt(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """sized rows with their source's goals and their block."""
    goals = bounded(goals.withColumnRenamed("source", "_source"))
    return rows.join(goals, same((F.col("source"), F.col("_source")))).drop("_source").withColumn("block", F.floor(F.col("place") * F.col("blocks")).cast("long"))


def quotas(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """goals with quota (draws of blocks), the block that the last pass cuts, and which of its documents stay: places up to `until`, and those in `extra`.

    Documents of that block are taken in the order of their places until one
    doesn't fit; of the others always the largest that still fits, and at last
    one more if the target is nearer with it.
    """
    dealt = _dealt(rows, goals).where("size > 0")
    sums = saved(dealt.groupBy("rank", "block").agg(F.sum("size").alias("words")))
    found = running(sums, ["rank"], "block", "words").join(bounded(goals.select("rank", "rest")), "rank")
    cut = found.where("before < rest and rest <= before + words").select("rank", F.col("block").alias("cut"), (F.col("rest") - F.col("before")).alias("room"))
    cut = saved(cut)
    inside = dealt.join(bounded(cut.withColumnRenamed("cut", "block")), ["rank", "block"]).groupBy("rank", "room", "place").agg(F.sum("size").alias("words"))
    inside = inside.withColumn("upto", F.sum("words").over(Window.partitionBy("rank").orderBy("place")))
    fits = F.col("upto") <= F.col("room")
    others = F.sort_array(F.collect_list(F.when(~fits, F.struct((-F.col("words")).alias("less"), "place"))))
    picked = inside.groupBy("rank", "room").agg(F.max(F.when(fits, F.col("place"))).alias("until"), F.max(F.when(fits, F.col("upto")).otherwise(0)).alias("got"), others.alias("others"))
    start = F.struct((F.col("room") - F.col("got")).alias("free"), F.array().cast("array<double>").alias("extra"))

    def fill(s: Column, x: Column) -> Column:
        more = F.struct((s["free"] + x["less"]).alias("free"), F.concat(s["extra"], F.array(x["place"])).alias("extra"))
        return F.when(-x["less"] <= s["free"], more).otherwise(s)

    def last(s: Column) -> Column:
        """The smallest of those left, if it is less than twice the words still asked for."""
        left = F.filter("others", lambda x: ~F.array_contains(s["extra"], x["place"]) & (-x["less"] < 2 * s["free"]))
        return F.concat(s["extra"], F.coalesce(F.array(F.array_min(F.transform(left, lambda x: F.struct((-x["less"]).alias("words"), x["place"])))["place"]), F.array().cast("array<double>")))

    picked = picked.select("rank", "until", F.aggregate("others", start, fill).alias("filled"), "others")
    picked = picked.select("rank", "until", last(F.col("filled")).alias("extra"))
    out = goals.join(cut.select("rank", "cut"), "rank", "left").join(picked, "rank", "left")
    return out.withColumn("quota", F.col("passes") * F.col("blocks") + F.coalesce(F.col("cut") + 1, F.lit(0)))


def hypergeometric(population: Column, marked: Column, drawn: Column, chance: Column) -> Column:
    """How many of `drawn` items are marked: the inverse of the distribution at `chance`, walked from its mode outwards.

    Outcomes so far from the mode that all of them together have a probability
    under 2**-53, the least step of chance, are not walked.
    """
    rest = population - marked
    low, high = F.greatest(F.lit(0), drawn - rest), F.least(marked, drawn)
    mode = F.least(high, F.greatest(low, F.floor((drawn + 1) * (marked + 1) / (population + 2)).cast("long")))
    reach = F.ceil(F.sqrt(F.least(drawn, population - drawn, marked, rest)) * 4.4).cast("long") + 2
    numbers = F.struct(population.alias("n"), marked.alias("k"), drawn.alias("d"), mode.alias("mode"), (F.least(high, mode + reach) - mode).alias("up"), (mode - F.greatest(low, mode - reach)).alias("down"), chance.alias("u"))

    def walk(x: Column) -> Column:
        def to(i: Column) -> Column:
            return F.when(i <= x["up"], x["mode"] + i).otherwise(x["mode"] + x["up"] - i)

        def weight(before: Column, i: Column) -> Column:
            """The i-th outcome's probability, as a multiple of the mode's."""
            a, b = to(i) - 1, to(i) + 1
            rise = (x["k"] - a).cast("double") * (x["d"] - a) / ((a + 1).cast("double") * (x["n"] - x["k"] - x["d"] + a + 1))
            fall = b.cast("double") * (x["n"] - x["k"] - x["d"] + b) / ((x["k"] - b + 1).cast("double") * (x["d"] - b + 1))
            return F.when(i == 0, F.lit(1.0)).when(i <= x["up"], before * rise).when(i == x["up"] + 1, fall).otherwise(before * fall)

        steps = F.sequence(F.lit(0).cast("long"), x["up"] + x["down"])
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("z"))
        mass = F.aggregate(steps, start, lambda s, i: _let(weight(s["w"], i), lambda w: F.struct(w.alias("w"), (s["z"] + w).alias("z"))))["z"]

        def seek(s: Column, i: Column) -> Column:
            def step(w: Column) -> Column:
                return F.struct(w.alias("w"), (s["r"] - w).alias("r"), F.when(s["r"] < w, to(i)).alias("at"))

            return F.when(s["at"].isNotNull(), s).otherwise(_let(weight(s["w"], i), step))

        begin = F.struct(F.lit(1.0).alias("w"), (x["u"] * mass).alias("r"), F.lit(None).cast("long").alias("at"))
        return F.coalesce(F.aggregate(steps, begin, seek)["at"], x["mode"])

    return _let(numbers, walk)


def _chance(*of: Column) -> Column:
    """A fixed pseudo-random number in [0, 1) of 53 bits."""
    return F.shiftrightunsigned(F.xxhash64(*of), 11).cast("double") / float(1 << 53)


def _members_left(members: Column, drawn: Column, *of: Column) -> Column:
    """members (name, quota) in turn: how many of the `drawn` each of them gets, as an array of (name, n)."""
    all_of = F.aggregate(members, F.lit(0).cast("long"), lambda s, m: s + m["quota"])
    empty = F.array().cast("array<struct<name:bigint,n:bigint>>")
    start = F.struct(all_of.alias("all"), drawn.alias("drawn"), empty.alias("out"))

    def one(s: Column, m: Column) -> Column:
        k = hypergeometric(s["all"], m["quota"], s["drawn"], _chance(*of, m["name"]))
        return _let(k, lambda n: F.struct((s["all"] - m["quota"]).alias("all"), (s["drawn"] - n).alias("drawn"), F.concat(s["out"], F.array(F.struct(m["name"].alias("name"), n.alias("n")))).alias("out")))

    return F.aggregate(members, start, one)["out"]


def split(quota: DataFrame, shards: int, draws: int, sources: int, seed: int) -> DataFrame:
    """(shard, rank, n): the draws (rank, quota) of all sources dealt to shards of equal size, halving the shards level by level."""
    nodes = quota.where("quota > 0").select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), F.col("rank"), F.col("quota"))
    depth = max(1, -(-max(1, sources - 1).bit_length() // GROUP_BITS))
    bound = lambda shard: F.floor(shard.cast("decimal(38,0)") * draws / shards).cast("long")
    middle = F.floor((F.col("lo") + F.col("hi")) / 2)
    for level in range(max(0, (shards - 1).bit_length())):
        wide = nodes.where("hi - lo > 1")
        left = None
        for j in range(depth - 1, -1, -1):
            own, above = (F.shiftright(F.col("rank"), GROUP_BITS * i) for i in (j, j + 1))
            members = wide.groupBy("lo", "hi", above.alias("above"), own.alias("name")).agg(F.sum("quota").alias("quota")) if j else wide.select("lo", "hi", above.alias("above"), own.alias("name"), "quota")
            packed = members.groupBy("lo", "hi", "above").agg(F.sort_array(F.collect_list(F.struct("name", "quota"))).alias("members"))
            packed = packed.join(left, ["lo", "hi", "above"]) if left is not None else packed.withColumn("drawn", bound(middle) - bound(F.col("lo")))
            taken = packed.select("lo", "hi", "members", F.explode(_members_left(F.col("members"), F.col("drawn"), F.lit(seed), F.lit(level), F.lit(j), F.col("lo"), F.col("above"))).alias("x"))
            left = taken.select("lo", "hi", F.col("x.name").alias("above"), F.col("x.n").alias("drawn"), F.element_at(F.filter("members", lambda m: m["name"] == F.col("x.name")), 1)["quota"].alias("quota"))
            if j:
                left = left.drop("quota")
        sides = F.array(F.struct(F.col("lo").alias("lo"), middle.alias("hi"), F.col("drawn").alias("quota")), F.struct(middle.alias("lo"), F.col("hi").alias("hi"), (F.col("quota") - F.col("drawn")).alias("quota")))
        halves = left.select(F.col("above").alias("rank"), F.explode(sides).alias("s")).select("s.lo", "s.hi", "rank", "s.quota").where("quota > 0")
        nodes = saved(halves.unionByName(nodes.where("hi - lo = 1")))
    return nodes.select(F.col("lo").alias("shard"), "rank", F.col("quota").alias("n"))


def draws(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, shard: int = SHARD, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, goals, drawn): sized documents, the sources' goals with quotas, and the blocks (rank, block, pass, partial) that each shard draws."""
    rows = saved(sized(docs, key, text, source, seed))
    goals = saved(quotas(rows, targets(rows, weights, most, block)))
    row = goals.agg(F.sum("quota"), F.max("quota"), F.count("*")).first()
    total = row[0] or 0
    if (row[1] or 0) > _LIMIT:
        raise ValueError(f"a source has over {_LIMIT} draws: take larger blocks")
    shares = saved(split(goals.select("rank", "quota"), max(1, -(-total // shard)), total, row[2], seed))
    shares = running(shares, ["rank"], "shard", "n", "first").join(bounded(goals.select("rank", "quota", "blocks", "passes", "cut")), "rank")
    at = shares.select("*", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("at"))
    number = F.pmod(F.pmod(F.col("at") * _STEP, F.col("quota")) + F.pmod(F.xxhash64(F.lit(seed), "rank"), F.col("quota")), F.col("quota"))
    at = at.withColumn("number", number).withColumn("block", F.col("number") % F.col("blocks")).withColumn("pass", F.floor(F.col("number") / F.col("blocks")))
    return rows, goals, at.select("shard", "rank", "block", "pass", ((F.col("pass") == F.col("passes")) & F.col("block").eqNullSafe(F.col("cut"))).alias("partial"))


def _stays() -> Column:
    return F.coalesce(F.col("place") <= F.col("until"), F.lit(False)) | F.coalesce(F.array_contains("extra", F.col("place")), F.lit(False))


def amounts(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """Per document: key, size, source_size, target (its source's) and taken, the words that all shards draw of it."""
    rows, goals, drawn = draws(docs, key, text, source, **how)
    dealt = _dealt(rows, goals)
    times = drawn.groupBy("rank", "block").agg(F.sum(F.when(F.col("partial"), 0).otherwise(1)).alias("whole"), F.max("partial").alias("partial"))
    full = dealt.where("size > 0").join(times, ["rank", "block"], "left")
    copies = F.coalesce("whole", F.lit(0)) + F.when(F.coalesce("partial", F.lit(False)) & _stays(), 1).otherwise(0)
    out = full.withColumn("taken", F.col("size") * copies).unionByName(dealt.where("size = 0").withColumn("taken", F.lit(0).cast("long")), allowMissingColumns=True)
    return out.select(F.col("key").alias(key), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", shard_name: str = "shard", **how) -> DataFrame:
    """The mix itself: all columns of docs, once for each time that a document is drawn, and its shard; shards lie in partitions of their own, in shuffled order.

    docs must not have a column called shard_name.
    """
    if shard_name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"documents have a column {shard_name}")
    _, goals, drawn = draws(docs, key, text, source, **how)
    seed = how.get("seed", 1)
    placed = docs.select(F.struct(*docs.columns).alias("doc"), F.col(source).alias("source"), *_columns(F.col(key), F.col(text), seed))
    picked = _dealt(placed.where("size > 0"), goals).join(drawn, ["rank", "block"]).where(~F.col("partial") | _stays())
    mixed_up = F.xxhash64(F.lit(seed), "place", "pass", "shard")
    out = picked.repartition("shard").sortWithinPartitions("shard", mixed_up)
    return out.select("doc.*", F.col("shard").alias(shard_name))
