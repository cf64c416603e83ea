"""Prefix trie of rebuilt conversations by composable fingerprints.

A conversation is rebuilt from the first turns of its base, the head, and its own turns after as many, the suffix. The
fingerprint of a sequence is an element of a monoid: its length, and lanes of sum(hash of turn i * B^i) modulo a prime.
The product of (n, x) and (m, y) is (n + m, x + B^n y). Products of heads and of suffixes are taken where the turns are
stored, and a rebuilt prefix is their product: no rebuilt text is ever put together. Each prefix keeps a reference
(conversation, place) to its last turn. Prefixes of equal fingerprint are one node if their parents are and the turns
referred to are equal; if any are not, all fingerprints get further lanes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col
from ..session import cut_lineage
from .common import WORD, running, written

#: Conversations of one base, and the bound of the turns that are taken from it.
FAMILY, HEADS = 20, 4
#: Lanes are sums modulo this prime.
PRIME = (1 << 31) - 1
LANES = 3
#: A node with over a 10,000th of all rows is joined by broadcast; there are fewer than so many.
HOT = 10_000
#: Ids that travel in one piece towards a digest.
PIECE = 16_384


def _power(base: int, exponent: Column, prime: int) -> Column:
    """``base`` to a power below 2^40, modulo ``prime``."""
    out = F.lit(1).cast("long")
    for bit in range(40):
        out = out * F.when(exponent.bitwiseAND(F.lit(1 << bit)) != 0, F.lit(base)).otherwise(F.lit(1)) % F.lit(prime)
        base = base * base % prime
    return out


def _base(lane: int, prime: int) -> int:
    return int.from_bytes(hashlib.sha256(b"lane %d" % lane).digest()[:8], "little") % (prime - 2) + 2


def _turns(convs: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv_id, place, role, text, words): the stored turns, placed from 0 in each conversation."""
    said = convs.where(col(conv).isNotNull()).select(
        col(conv).cast("long").alias("conv_id"), col(turn).alias("turn"), F.coalesce(col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(col(text), F.lit("")).alias("text"), F.lit(1).cast("long").alias("one"))
    placed = running(said, ["conv_id"], ["turn", "role", "text"], {"place": "one"})
    return written(placed.select("conv_id", "place", "role", "text", F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")), "turns")


def _members(turns: DataFrame, lanes: int, prime: int) -> DataFrame:
    """(conv_id, depth, node, parent, words, ref_conv, ref_place, last): every prefix of one turn or more of every
    rebuilt conversation, and a row of depth 0 for each conversation."""
    bases = [_base(k, prime) for k in range(lanes)]
    hashed = turns.select("conv_id", "place", "words", *[
        F.pmod(F.xxhash64(F.lit(k), "role", "text"), F.lit(prime)).alias(f"t{k}") for k in range(lanes)])
    convs = hashed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).select(
        "conv_id", "n", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"))

    def name(depth: Column, parts: list[Column]) -> Column:
        return F.concat_ws(":", depth.cast("string"), *[F.hex(p) for p in parts])

    # products of the heads of the bases: at most HEADS - 1 turns each
    first = hashed.where((F.col("place") < HEADS - 1) & (F.col("conv_id") % FAMILY == 0))
    held = first.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "words", *[f"t{k}" for k in range(lanes)]))).alias("held"))
    products = []
    for d in range(HEADS):
        sums = [sum((F.coalesce(F.get("held", F.lit(i))[f"t{k}"], F.lit(0)) * F.lit(pow(bases[k], i, prime)) % F.lit(prime) for i in range(d)),
                    F.lit(0).cast("long")) % F.lit(prime) for k in range(lanes)]
        products.append(F.array(*sums))
    heads = held.select(F.col("conv_id").alias("base_id"), F.array(*products).alias("products"), F.size("held").alias("size"),
                        F.transform("held", lambda t: t["words"]).alias("head_words"))
    empty = F.array(*[F.lit(0).cast("long")] * lanes)
    built = convs.join(heads, F.col("base") == F.col("base_id"), "left").select(
        "conv_id", "n", "h", "base", F.least(F.col("h"), F.coalesce("size", F.lit(0))).cast("long").alias("taken"), "products", "head_words")
    built = cut_lineage(built.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))

    # prefixes inside the head, the root among them
    inside = built.withColumn("depth", F.explode(F.sequence(F.lit(0).cast("long"), "taken")))

    def lane(product: Column) -> list[Column]:
        return [product[k] for k in range(lanes)]

    def product_at(depth: Column) -> Column:
        return F.when(depth > 0, F.col("products")[depth.cast("int")]).otherwise(empty)

    up = F.greatest(F.col("depth") - 1, F.lit(0))
    in_head = inside.select(
        "conv_id", "depth", name(F.col("depth"), lane(product_at(F.col("depth")))).alias("node"),
        F.when(F.col("depth") > 0, name(up, lane(product_at(up)))).alias("parent"),
        F.when(F.col("depth") > 0, F.col("head_words")[up.cast("int")]).otherwise(F.lit(0)).alias("words"),
        F.when(F.col("depth") > 0, F.col("base")).alias("ref_conv"), F.when(F.col("depth") > 0, up).alias("ref_place"),
        (F.col("depth") == F.col("length")).alias("last"))

    # products of the suffixes, put behind those of the heads
    own = hashed.join(built.select("conv_id", "h").withColumnRenamed("conv_id", "of"), F.col("conv_id") == F.col("of")).where("place >= h")
    own = own.select("conv_id", "place", "words", *[
        (F.col(f"t{k}") * _power(bases[k], F.col("place") - F.col("h"), prime) % F.lit(prime)).alias(f"v{k}") for k in range(lanes)])
    summed = running(own, ["conv_id"], ["place"], {f"s{k}": f"v{k}" for k in range(lanes)})
    joined = summed.join(built.select(F.col("conv_id").alias("of"), "h", "taken", "length", F.when(F.col("taken") > 0, F.col("products")[
        F.col("taken").cast("int")]).otherwise(empty).alias("head")), F.col("conv_id") == F.col("of"))
    shift = [_power(bases[k], F.col("taken"), prime) for k in range(lanes)]

    def behind(suffix: list[Column]) -> list[Column]:
        return [(F.col("head")[k] + shift[k] * (suffix[k] % F.lit(prime)) % F.lit(prime)) % F.lit(prime) for k in range(lanes)]

    depth = F.col("taken") + F.col("place") - F.col("h") + 1
    in_suffix = joined.select(
        "conv_id", depth.alias("depth"), name(depth, behind([F.col(f"s{k}") + F.col(f"v{k}") for k in range(lanes)])).alias("node"),
        name(depth - 1, behind([F.col(f"s{k}") for k in range(lanes)])).alias("parent"), "words",
        F.col("conv_id").alias("ref_conv"), F.col("place").alias("ref_place"), (depth == F.col("length")).alias("last"))
    return in_head.unionByName(in_suffix)


def _clashes(members: DataFrame, turns: DataFrame) -> bool:
    """Whether some node has members with different parents, or whose references lead to different turns."""
    refs = members.where("depth > 0").select("node", "parent", "ref_conv", "ref_place").distinct()
    said = refs.join(turns.select(F.col("conv_id").alias("ref_conv"), F.col("place").alias("ref_place"), "role", "text"), ["ref_conv", "ref_place"])
    turn = F.struct("parent", "role", "text")
    return not said.groupBy("node").agg(F.min(turn).alias("least"), F.max(turn).alias("most")).where("least <> most").isEmpty()


def _met(rows: DataFrame, table: DataFrame, on: str, weight: str, total: int) -> DataFrame:
    """Join on ``on``; entries of ``table`` that stand for over a HOT-th of ``total`` rows are broadcast, fewer than HOT."""
    heavy = F.col(weight) > total // HOT
    few = table.where(heavy).drop(weight)
    rest = rows.join(F.broadcast(few.select(on)), on, "left_anti").join(table.where(~heavy).drop(weight), on)
    return rows.join(F.broadcast(few), on).unionByName(rest)


def _digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of rows (node, conv_id): the digest of the ids of a node in ascending order.

    Sorted ids are put into pieces of bounded size everywhere at once; only these pass through a digest in turn.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node]), pa.array([ids[0]], pa.int64()), pa.array([",".join(map(str, ids))])],
                                              names=["node", "first", "ids"])

        for batch in batches:
            for n, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (n != node or len(ids) == PIECE):
                    yield row()
                    ids = []
                node = n
                ids.append(c)
        if ids:
            yield row()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

        for batch in batches:
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if n != node:
                    if state is not None:
                        yield row()
                    node, state = n, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if state is not None:
            yield row()

    cut = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(pieces, "node string, first long, ids string")
    return cut.repartition("node").sortWithinPartitions("node", "first").mapInArrow(digests, "node string, ends_sha256 string")


def conversation_trie(convs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                      lanes: int = LANES, prime: int = PRIME) -> DataFrame:
    """Per node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns of a conversation stand by ``turn``, null first; equal turns by role, then text. Null role or text is empty.
    Rows without a conversation id are in no conversation; the remainder of a negative id is that of SQL. No rows give
    an empty result.

    For sums over subtrees every node goes to the member with the smallest hash. The nodes of a member are the lower
    end of its own path, a chain, and a path meets few chains (about the logarithm of the conversations). A chain adds
    its sum to the nodes of the other chains on its path; running sums up each chain give the subtrees. Nothing walks the
    trie level by level, however long a conversation is.
    """
    turns = _turns(convs, conv, turn, role, text)
    while True:
        members = cut_lineage(_members(turns, lanes, prime))
        if not _clashes(members, turns):
            break
        lanes += 1
    by_hash = F.min(F.struct(F.xxhash64("conv_id").alias("hash"), F.col("conv_id").alias("id")))
    nodes = cut_lineage(members.groupBy("node").agg(
        F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"),
        by_hash["id"].alias("leader"), F.first("words").alias("words")))
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(nodes.join(children, "node", "left").withColumns({
        "n_children": F.coalesce("n_children", F.lit(0)), "saved": (F.col("n_convs") - 1) * F.col("words")}).withColumn(
        "leaf", (F.col("n_children") == 0).cast("long")))
    total, n_nodes = members.count(), nodes.count()

    chains = nodes.groupBy("leader").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
    paths = members.select("conv_id", "depth", "node").join(chains.select(F.col("leader").alias("conv_id")), "conv_id", "left_semi")
    led = _met(paths, nodes.select("node", "leader", "n_convs"), "node", "n_convs", total)
    above = led.where("leader <> conv_id").groupBy("conv_id", "leader").agg(F.max("depth").alias("depth"))
    added = above.join(chains.select(F.col("leader").alias("conv_id"), "leaf", "saved"), "conv_id").select("leader", "depth", "leaf", "saved")
    parts = nodes.select("leader", "depth", "leaf", "saved").unionByName(added).groupBy("leader", "depth").agg(
        F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved")).withColumn("up", -F.col("depth"))
    below = running(cut_lineage(parts), ["leader"], ["up"], {"leaves_below": "leaf", "saved_below": "saved"}).select(
        "leader", "depth", (F.col("leaf") + F.col("leaves_below")).alias("n_leaves"), (F.col("saved") + F.col("saved_below")).alias("saved_tokens"))

    named = nodes.select("node", "depth", "parent", "conv_id", "n_convs", "n_children", "leader").join(below, ["leader", "depth"])
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    up = _met(named.where("depth > 0").withColumnRenamed("n_children", "own"), parents, "parent", "n_children", n_nodes).withColumnRenamed("own", "n_children")
    root = named.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    whole = up.unionByName(root).join(_digests(members.where("last").select("node", "conv_id")), "node", "left")
    return whole.select("conv_id", "depth", "parent_conv_id", *[F.col(c).cast("long").alias(c) for c in (
        "n_convs", "n_children", "n_leaves", "saved_tokens")], F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
