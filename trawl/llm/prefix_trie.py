"""The prefix trie of conversations by partition refinement.

All conversations start in one class. A round splits every active class by the next turns: a member's prefixes are
told apart by a hash chained turn after turn, and members are counted for each prefix. A class left with one member retires;
the rest of that conversation is a unary chain, which is written from its length alone, without its turns. Rounds take 1, 2,
4, ... up to STRIDE turns at once, so that long shared beginnings take few jobs. Members never meet in one task: counting
combines on the map side, whatever the size of a class. In the end the rounds are folded back in reverse, each block of levels
in one aggregation, which gives sums over subtrees.

Texts are hashed where they are read (128 bits of SHA-256) and never moved.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trawl.functions.ranks import numbered
from trawl.llm.shared import let, scratch, shared_folder, stored
from trawl.llm.simhash import to_rows

STRIDE = 16
#: A conversation takes its first turns from the one of its family with the least id: as many as CRC-32 of its id modulo LEAD says.
FAMILY, LEAD = 5, 9
#: Rows of a unary chain, and ids of an end, that are made at once.
CHAIN, IDS = 4096, 1000


def _short(value: Column) -> Column:
    return F.unhex(F.substring(F.sha2(value, 256), 1, 32))


def sequences(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows (conv_id, place, hash, n_bytes): every turn's place from 1, by turn (null first), then role, then hash."""
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = rows.filter("conv_id is not null").select("conv_id", "turn", "role", _short(whole).alias("hash"), F.octet_length("text").cast("long").alias("n_bytes"))
    return numbered(rows, ["turn", "role", "hash"], "place", ("conv_id",)).select("conv_id", "place", "hash", "n_bytes")


def lengths(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, length) of conversations that have turns."""
    return turns.groupBy("conv_id").agg(F.max("place").alias("length"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, lengths) of the conversations that begin with their family's turns.

    Conversation c takes the first h turns of conversation c - c % FAMILY, h = CRC-32 of c in decimals modulo LEAD, and goes
    on with its own turns after its first h.
    """
    own = stored(lengths(turns)).withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % LEAD)).withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY)
    heads = own.select(F.col("conv_id").alias("family"), F.col("length").alias("given"))
    plan = own.join(heads, "family", "left").withColumn("lead", F.least("h", F.coalesce("given", F.lit(0))))
    plan = stored(plan.select("conv_id", "family", "h", "lead", F.col("length").alias("n"), (F.col("lead") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("length")))
    tails = to_rows(turns, plan.select("conv_id", "h", "lead", "n"), "conv_id", "n").filter(F.col("place") > F.col("h"))
    tails = tails.select("conv_id", (F.col("place") - F.col("h") + F.col("lead")).alias("place"), "hash", "n_bytes")
    first = turns.filter(F.col("place") < LEAD).withColumnRenamed("conv_id", "family").join(plan.select("conv_id", "family", "lead"), "family").filter(F.col("place") <= F.col("lead"))
    return tails.unionByName(first.select("conv_id", "place", "hash", "n_bytes")), plan.select("conv_id", "length")


def _prefixes(turns: Column, start: Column) -> Column:
    """For turns in order, an array of (depth, node, path, n_bytes): the prefix that ends with each, and the prefixes from this round's start up to it."""
    kind = "array<struct<depth:bigint,node:binary,path:array<binary>,n_bytes:bigint>>"

    def add(done: Column, turn: Column) -> Column:
        path = F.coalesce(F.try_element_at(done, F.lit(-1))["path"], F.array(start))
        node = _short(F.concat(F.element_at(path, -1), turn["hash"]))
        one = let(node, lambda n: F.struct(turn["place"].alias("depth"), n.alias("node"), F.concat(path, F.array(n)).alias("path"), turn["n_bytes"].alias("n_bytes")))
        return F.concat(done, F.array(one)).cast(kind)

    return F.aggregate(turns, F.array().cast(kind), add)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """At most IDS ids of one node as one text, from rows sorted by node and id."""
    for batch in batches:
        nodes, ids = batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()
        found, start = [], 0
        for k in range(1, len(ids) + 1):
            if k == len(ids) or nodes[k] != nodes[start] or k - start == IDS:
                found.append((nodes[start], ids[start], ",".join(map(str, ids[start:k]))))
                start = k
        if found:
            node, first, text = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(first, pa.int64()), pa.array(text, pa.string())], ["node", "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, from its pieces in order."""
    now, digest = None, None
    tell = lambda found: pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.binary(), pa.string()))], ["node", "ends_sha256"])
    for batch in batches:
        found = []
        for node, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if node == now:
                digest.update(b",")
            else:
                if digest is not None:
                    found.append((now, digest.hexdigest()))
                now, digest = node, hashlib.sha256()
            digest.update(ids.encode())
        if found:
            yield tell(found)
    if digest is not None:
        yield tell([(now, digest.hexdigest())])


def digests(ends: DataFrame) -> DataFrame:
    """Rows (node, ends_sha256) of the ids that end at each node (node, conv_id), in numerical order and joined by commas.

    A hash has to see its ids one after another; they come as texts that other tasks have joined, and are not held.
    """
    pieces = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_pieces, "node binary, first long, ids string")
    return pieces.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digests, "node binary, ends_sha256 string")


def _union(frames: list[DataFrame]) -> DataFrame:
    found = frames[0]
    for frame in frames[1:]:
        found = found.unionByName(frame)
    return found


KIND = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def trie(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row for each node of the prefix trie of ``turns`` (conv_id, place from 1, hash, n_bytes).

    ``sizes`` (conv_id, length) names every conversation, turnless ones too. Columns: conv_id, the smallest member; depth;
    parent_conv_id; n_convs; n_children; n_leaves and saved_tokens, summed over the subtree; ends_sha256, SHA-256 of the ids
    of the members that end here (numerical order, commas). No conversation, no node.
    """
    spark = turns.sparkSession
    folder = shared_folder(spark)
    root, long = F.unhex(F.lit("00")), lambda n: F.lit(n).cast("long")
    with scratch(spark):
        turns = stored(turns)
        active = stored(sizes.select("conv_id", "length", root.alias("node")))
        n, first, n_ended = active.agg(F.count("*"), F.min("conv_id"), F.count_if(F.col("length") == 0)).first()
        rounds: list[DataFrame] = []
        ends = [active.filter("length = 0").select("node", "conv_id")]
        depth, stride = 0, 1
        while not (active := active.filter(F.col("length") > depth)).isEmpty():
            window = turns.filter((F.col("place") > depth) & (F.col("place") <= depth + stride)).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "hash", "n_bytes"))).alias("turns"))
            level = active.join(window, "conv_id").select("conv_id", "length", F.explode(_prefixes(F.col("turns"), F.col("node"))).alias("p")).select("conv_id", "length", "p.*")
            level = stored(level)
            ended = F.count_if(F.col("length") == F.col("depth"))
            groups = stored(level.groupBy("depth", "node", "path", "n_bytes").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.max("length").alias("length"), ended.alias("n_ended")))
            rounds.append(groups)
            single = groups.filter("n = 1").select("conv_id").distinct()
            left = stored(level.filter((F.col("depth") == F.col("length")) | (F.col("depth") == depth + stride)).select("conv_id", "length", "depth", "node").join(single, "conv_id", "left_anti"))
            ends.append(left.filter("length = depth").select("node", "conv_id"))
            active = left.filter(F.col("depth") == depth + stride).select("conv_id", "length", "node")
            depth, stride = depth + stride, min(2 * stride, STRIDE)
        if not n:
            return stored(spark.createDataFrame([], KIND), folder)
        parent = F.element_at("path", -2).alias("parent")
        # The node where each lonely conversation leaves its class; in one round all its prefixes from there on are alone.
        alone = [g.filter("n = 1").groupBy("conv_id", "length").agg(F.array_min(F.collect_list(F.struct("depth", "path"))).alias("p")).select("conv_id", "length", "p.*") for g in rounds]
        alone = [stored(a) for a in alone]
        shared = [g.filter("n > 1") for g in rounds]
        totals: list[DataFrame] = []
        carried: DataFrame | None = None
        for k in reversed(range(len(rounds))):
            given = shared[k].select("path", F.when(F.col("n_ended") == F.col("n"), 1).otherwise(0).alias("leaves"), ((F.col("n") - 1) * F.col("n_bytes")).alias("saved"))
            given = given.unionByName(alone[k].select(F.slice("path", F.lit(1), F.size("path") - 1).alias("path"), F.lit(1).alias("leaves"), F.lit(0).alias("saved")))
            if carried is not None:
                given = given.unionByName(shared[k].select("node", "path").join(carried, "node").select("path", "leaves", "saved"))
            sums = given.select(F.posexplode("path").alias("place", "node"), "leaves", "saved").groupBy("place", "node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
            sums = stored(sums)
            totals.append(sums.filter("place > 0").select("node", "leaves", "saved"))
            carried = sums.filter("place = 0").select("node", "leaves", "saved")
        whole = spark.range(1).select(root.alias("node"), long(0).alias("depth"), long(first).alias("conv_id"), long(n).alias("n_convs"))
        own = [whole, *[g.select("node", "depth", "conv_id", F.col("n").alias("n_convs")) for g in shared]]
        parents = _union([a.select(parent) for a in alone] + [g.select(parent) for g in shared] or [whole.filter("false").select(F.col("node").alias("parent"))])
        parts = [o.select("*", *[long(0).alias(c) for c in ("n_children", "leaves", "saved")]) for o in own]
        none = [F.lit(None).cast("long").alias(c) for c in ("depth", "conv_id", "n_convs")]
        parts.append(parents.select(F.col("parent").alias("node"), *none, long(1).alias("n_children"), long(0).alias("leaves"), long(0).alias("saved")))
        if carried is not None:
            parts += [t.select("node", *none, long(0).alias("n_children"), "leaves", "saved") for t in [*totals, carried]]
        if n_ended == n:
            parts.append(whole.select("node", *none, long(0).alias("n_children"), long(1).alias("leaves"), long(0).alias("saved")))
        core = _union(parts).groupBy("node").agg(*[F.max(c).alias(c) for c in ("depth", "conv_id", "n_convs")], F.sum("n_children").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
        core = stored(core)
        empty = F.sha2(F.lit(""), 256)
        above = core.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
        below = [g.select("node", "conv_id", "depth", long(0).alias("length"), parent) for g in shared] + [a.select(F.lit(None).cast("binary").alias("node"), "conv_id", "depth", "length", parent) for a in alone]
        below = stored(to_rows(_union(below), above, "parent", "n")) if below else whole.filter("false").select("node", "conv_id", "depth", long(0).alias("length"), long(0).alias("parent_conv_id"))
        told = below.filter("node is not null").select("node", "parent_conv_id").unionByName(whole.select("node", F.lit(None).cast("long").alias("parent_conv_id")))
        rows = core.join(told, "node").join(digests(stored(_union(ends))), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))
        starts = below.filter("node is null").select("conv_id", "length", "parent_conv_id", F.col("depth").alias("top"), F.explode(F.sequence(F.col("depth"), F.col("length"), long(CHAIN))).alias("start"))
        chain = starts.repartition("conv_id", "start").withColumn("depth", F.explode(F.sequence(F.col("start"), F.least(F.col("start") + CHAIN - 1, F.col("length")))))
        last = F.col("depth") == F.col("length")
        chain = chain.select("conv_id", "depth", F.when(F.col("depth") == F.col("top"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"), long(1).alias("n_convs"), F.when(last, long(0)).otherwise(long(1)).alias("n_children"), long(1).alias("n_leaves"), long(0).alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(empty).alias("ends_sha256"))
        return stored(rows.select(chain.columns).unionByName(chain), folder)


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuild: bool = True) -> DataFrame:
    """The prefix trie of ``conversations``, rebuilt (see ``rebuilt``) or as they are; columns as ``trie`` says.

    Turns count in the order of ``sequences``; null roles and texts count as empty, rows without an id belong to no
    conversation, repeated rows are turns of their own, texts are read whole. Other columns, whatever their names, are left out.
    """
    turns = sequences(conversations, conv_id, turn, role, text)
    if not rebuild:
        turns = stored(turns)
        return trie(turns, lengths(turns))
    return trie(*rebuilt(stored(turns)))


def with_texts(nodes: DataFrame, conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Nodes of a trie of conversations as they are, with ``last_role`` and ``last_text`` (null at the root)."""
    own = conversations.filter(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("last_role"), F.coalesce(F.col(text), F.lit("")).alias("last_text"))
    hashed = own.withColumn("hash", _short(F.concat(F.octet_length("last_role").cast("string"), F.lit(":"), F.col("last_role"), F.col("last_text"))))
    placed = numbered(hashed, ["turn", "last_role", "hash"], "depth", ("conv_id",)).select("conv_id", "depth", "last_role", "last_text")
    return nodes.join(placed, ["conv_id", "depth"], "left")
