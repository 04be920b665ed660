"""The prefix trie of conversations: which turns they share from their start on, and how many words a cache of shared prefixes saves.

A node is a distinct sequence of first turns, told by a 128-bit digest chained over the turns, and it belongs to its smallest member. A conversation that
owns a prefix owns all longer ones too, so what it owns is a chain, and the first depth of it is found by binary search: in each round all conversations
look up one prefix, in a batched join against the least member of each digest. The node above a chain's first belongs to another chain; chains form a tree,
and their sums go up it by doubling: after k rounds each chain has those of all chains less than 2^k below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, freeing, written

ROOT = bytes(16)
FORM = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def numbered(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, digest, words): each turn's place in its conversation from 0, by `turn` (null first), equal ones by their digest.

    Null roles and texts are empty; rows with a null key belong to no conversation and are left out; repeated rows are turns of their own. Of texts, how long
    they ever are, only digest and number of words go on. A hot conversation is sorted in one task, which spills.
    """
    said = [F.coalesce(df[c].cast("string"), F.lit("")) for c in (role, text)]
    digest = F.unhex(F.md5(F.concat(F.octet_length(said[0]).cast("string"), F.lit(":"), *said)))
    rows = df.select(df[key].cast("long").alias("conv"), df[turn].alias("turn"), digest.alias("digest"), F.regexp_count(said[1], F.lit("[^\\x20\\x09-\\x0D]+")).cast("long").alias("words"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "digest")) - 1
    return rows.where("conv is not null").withColumn("place", place).drop("turn")


def regrown(turns: DataFrame, convs: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Each conversation c of `convs` with its first h turns taken from conversation c - c % every, and its own from the h-th on; h is crc32(c) % most."""
    have = convs.select("conv", (F.crc32(F.col("conv").cast("string")) % most).alias("h"), (F.col("conv") - F.col("conv") % every).alias("base"))
    heads = turns.where((F.col("conv") % every == 0) & (F.col("place") < most - 1)).withColumnRenamed("conv", "base")
    taken = have.join(heads, "base").where("place < h").select("conv", "place", "digest", "words")
    own = turns.where(F.col("place") >= F.crc32(F.col("conv").cast("string")) % most)
    return taken.unionByName(own.select("conv", "place", "digest", "words"))


@freeing
def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order as prefixes: the depth and the digest of all turns up to each, and the digest of those before."""
    conv, depth, last = None, 0, ROOT
    for b in batches:
        depths, prefixes, before = [], [], []
        for c, digest in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if c != conv:
                conv, depth, last = c, 0, ROOT
            before.append(last)
            depth, last = depth + 1, hashlib.blake2b(last + digest, digest_size=16).digest()
            depths.append(depth)
            prefixes.append(last)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(depths, pa.int32()), pa.array(prefixes, pa.binary()), pa.array(before, pa.binary()), b.column(2)], ["conv", "depth", "prefix", "before", "words"])


@freeing
def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations in the order of the prefix that they end in, and among themselves: the digest of their numbers, comma-joined, for each prefix."""
    now, digest = None, hashlib.sha256()
    for b in batches:
        done: list[tuple[bytes, str]] = []
        for prefix, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if prefix != now:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = prefix, hashlib.sha256(b"%d" % conv)
            else:
                digest.update(b",%d" % conv)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.binary()), pa.array([s for _, s in done], pa.string())], ["prefix", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["prefix", "ends_sha256"])


def first_owned(prefixes: DataFrame, least: DataFrame) -> DataFrame:
    """(conv, first): the least depth at which a conversation is the smallest member of its prefix; none for those that own nothing.

    Binary search in rounds: `prefixes` that can still be the first one are kept, half of them after each round.
    """
    open_ = prefixes.select("conv", "depth", "prefix", F.lit(1).alias("lo"), (F.col("length") + 1).alias("hi"))
    rounds: list[DataFrame] = []
    old: list[DataFrame] = []
    while True:
        asked = open_.where(F.col("depth") == F.floor((F.col("lo") + F.col("hi")) / 2)).select("conv", "depth", "prefix")
        looked = written(asked.join(least.select("prefix", "owner"), "prefix").select("conv", F.col("depth").alias("mid"), (F.col("owner") == F.col("conv")).alias("owned")), "looked")
        rounds.append(looked)
        if looked.isEmpty():
            break
        narrower = open_.join(looked, "conv").select("conv", "depth", "prefix", F.when(F.col("owned"), F.col("lo")).otherwise(F.col("mid") + 1).alias("lo"), F.when(F.col("owned"), F.col("mid")).otherwise(F.col("hi")).alias("hi"))
        open_ = written(narrower.where("lo <= depth and depth < hi"), "open")
        forget(*old)
        old = [open_]
    return reduce(DataFrame.unionByName, rounds).where("owned").groupBy("conv").agg(F.min("mid").alias("first"))


def summed_up(chains: DataFrame) -> DataFrame:
    """(conv, saved, leaves) of each chain with all chains below it, from (conv, parent, saved, leaves): a round doubles how far down the sums reach."""
    now = written(chains.select("conv", F.col("parent").alias("above"), "saved", "leaves"), "sums")
    while not now.where("above is not null").isEmpty():
        below = now.where("above is not null").groupBy(F.col("above").alias("conv")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        further = now.select(F.col("conv").alias("above"), F.col("above").alias("next"))
        sums = now.join(below, "conv", "left").join(further, "above", "left")
        new = written(sums.select("conv", F.col("next").alias("above"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves")), "sums")
        forget(now)
        now = new
    return now.drop("above")


def prefix_trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations `convs` (conv), whose turns are (conv, place, digest, words); columns are those of FORM.

    conv_id is the smallest member, parent_conv_id that of the node above (null for the root), n_convs counts members, n_children the nodes below,
    n_leaves the childless nodes in its subtree, saved_tokens adds up (members - 1) times the words of each node's last turn over the subtree, and
    ends_sha256 digests the numbers of the members that end here. A conversation without turns is a member of the root. Without conversations there is no
    node. Prefixes are told apart by 128-bit digests. Turns that very many conversations begin with are counted before they are shuffled; a conversation
    is chained by one task, and so are the numbers of those that end in one node, both as streams.
    """
    spark = turns.sparkSession
    size, root = convs.agg(F.count("*"), F.min("conv")).first()
    if not size:
        return spark.createDataFrame([], FORM)
    rows = turns.repartition("conv").sortWithinPartitions("conv", "place").select("conv", "digest", "words")
    chained = written(rows.mapInArrow(_chained, "conv long, depth int, prefix binary, before binary, words long"), "chained")
    lengths = chained.groupBy("conv").agg(F.max("depth").alias("length"))
    prefixes = written(chained.join(lengths, "conv"), "prefixes")
    forget(chained)
    least = written(prefixes.groupBy("prefix").agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.max("depth").alias("depth"), F.max("words").alias("words")), "least")

    tops = first_owned(prefixes, least).withColumnRenamed("first", "depth").join(prefixes.select("conv", "depth", "before", "length"), ["conv", "depth"])
    above = least.select(F.col("prefix").alias("before"), F.col("owner").alias("over"))
    tops = tops.join(above, "before", "left").select("conv", F.col("depth").alias("first"), "length", F.coalesce("over", F.lit(root)).alias("parent"))
    # the smallest conversation owns the root as well
    others = tops.where(F.col("conv") != root)
    own = lengths_of(prefixes, root).select(F.lit(root).alias("conv"), F.lit(0).alias("first"), F.coalesce("length", F.lit(0)).alias("length"), F.lit(None).cast("long").alias("parent"))
    chains = written(others.unionByName(own), "chains")

    top = spark.range(1).select(F.lit(ROOT).alias("prefix"), F.lit(root).alias("owner"), F.lit(size).cast("long").alias("n_convs"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("words"))
    nodes = least.unionByName(top).withColumn("saved", (F.col("n_convs") - 1) * F.col("words"))
    hung = chains.where("parent is not null").select(F.col("parent").alias("owner"), (F.col("first") - 1).alias("depth"), F.col("conv"))
    tips = chains.select(F.col("conv").alias("owner"), F.col("length").alias("depth")).join(hung.select("owner", "depth").distinct(), ["owner", "depth"], "left_anti").select(F.col("owner").alias("conv"), F.lit(1).cast("long").alias("tip"))
    alone = nodes.groupBy(F.col("owner").alias("conv")).agg(F.sum("saved").alias("saved"))
    sums = summed_up(chains.join(alone, "conv").join(tips, "conv", "left").select("conv", "parent", "saved", F.coalesce("tip", F.lit(0).cast("long")).alias("leaves")))

    hung = hung.join(sums, "conv").groupBy("owner", "depth").agg(F.count("*").alias("kids"), F.sum("saved").alias("below"), F.sum("leaves").alias("tips"))
    all_ = nodes.join(chains.withColumnRenamed("conv", "owner"), "owner").join(hung, ["owner", "depth"], "left").fillna(0, ["kids", "below", "tips"])
    last = F.col("depth") == F.col("length")
    down = Window.partitionBy("owner").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    all_ = all_.withColumns({
        "n_children": F.col("kids") + F.when(last, 0).otherwise(1),
        "n_leaves": F.sum(F.col("tips") + F.when(last & (F.col("kids") == 0), 1).otherwise(0)).over(down),
        "saved_tokens": F.sum(F.col("saved") + F.col("below")).over(down),
        "parent_conv_id": F.when(F.col("depth") == F.col("first"), F.col("parent")).otherwise(F.col("owner")),
    })
    ends = prefixes.where("depth = length").select("prefix", "conv")
    ends = ends.unionByName(convs.select("conv").join(prefixes.select("conv").where("depth = 1"), "conv", "left_anti").select(F.lit(ROOT).alias("prefix"), "conv"))
    ends = ends.repartition("prefix").sortWithinPartitions("prefix", "conv").mapInArrow(_joined, "prefix binary, ends_sha256 string")
    out = all_.join(ends, "prefix", "left")
    return out.select(F.col("owner").alias("conv_id"), F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def lengths_of(prefixes: DataFrame, conv: int) -> DataFrame:
    """One row: how many turns a conversation has; null for none."""
    return prefixes.where(F.col("conv") == conv).agg(F.max("depth").alias("length"))


def conversation_trie(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """`prefix_trie` of the conversations of a table of turns, each rebuilt by `regrown`; what nulls, ties and repeats give is said there and in `numbered`.
    Other columns aren't read."""
    turns = written(numbered(df, key, turn, role, text), "turns")
    convs = written(turns.select("conv").distinct(), "convs")
    return prefix_trie(regrown(turns, convs), convs)
