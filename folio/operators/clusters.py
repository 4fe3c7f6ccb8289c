"""People across documents: names that are nearly equal, joined without blocks, and the clusters they form.

``similar_keys`` finds every pair of different keys whose edit distance is at most (1 - accept) of the longer one. Keys meet on signatures that two
keys within the distance d must share, so a frequent surname or first name brings nobody together by itself:

* d = 1: what is left after deleting one character, with its place for keys of one length, against the whole shorter key otherwise. Only keys that are one edit apart meet.
* d = 2: what is left after deleting up to two characters anywhere (symmetric deletion). Keys that meet are at most four edits apart.
* d >= 3, keys of 30 characters and more at the usual 0.9: the shorter key is cut into d + 1 pieces, one of which is in the longer one, moved by at most d. Places
  are compared by stretches of 2d + 1, so a key has a few signatures for each of its characters.

Signatures carry the number of a key and a hash, never the key; pairs that meet are compared once each, no further than the edits allowed.
``people_clusters`` needs no pairs of keys one edit apart: they are joined by stars, as many links as deletions.

``components`` joins links to clusters by turns: each node goes to the smallest one that its smallest neighbour knows (by random numbers), and links are folded to
links between those, so that each turn has a part of the nodes and links of the one before. Every turn is written, so its plan doesn't grow.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import delete, written
from .linking import name_key

#: Edits up to which whole deletions are listed; names of that many have under 30 characters at 0.9.
DELETED = 2


def _allowed(n: int, accept: float) -> int:
    """Most edits between two keys of which the longer one has ``n`` characters."""
    return int((1 - accept) * n + 1e-9)


def _edits(n: Column, accept: float) -> Column:
    """``_allowed`` of a column of lengths."""
    return F.floor(F.lit(1 - accept) * n + 1e-9).cast("int")


def _deletions(key: str, k: int) -> set[str]:
    """What is left after deleting exactly ``k`` characters, two at most."""
    if k == 0:
        return {key}
    if k == 1:
        return set(_without_one(key))
    return {key[:i] + key[i + 1 : j] + key[j + 1 :] for j in range(len(key)) for i in range(j)}


def _without_one(key: str) -> list[str]:
    return [key[:i] + key[i + 1 :] for i in range(len(key))]


def _pieces(n: int, d: int) -> list[tuple[int, int]]:
    """Start and length of d + 1 nearly equal pieces of n characters."""
    edges = [n * i // (d + 1) for i in range(d + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _cuts(d: int) -> int:
    """Edits that a scheme of pieces is made for: ``d``, beyond 31 rounded up, so that keys of nearly equal length share it."""
    step = 1 << max(0, d.bit_length() - 5)
    return -(-d // step) * step


def _signatures(key: str, accept: float, least: int = 1) -> Iterator[tuple[bool | None, str]]:
    """(as the longer one, None as either, signature) for ``least`` edits and more. The longer of two keys tells how many edits are allowed; the shorter one lists its signatures for each number that a longer one may allow."""
    n, d = len(key), _allowed(len(key), accept)
    if d < least:
        pass
    elif d == 1:
        for i, s in enumerate(_without_one(key)):
            yield True, f"1={i}:{s}"
        for s in set(_without_one(key)):
            yield True, f"1-:{s}"
    elif d == DELETED:
        for s in _deletions(key, d):
            yield None, f"{d}:{s}"
    else:
        cuts, found = _cuts(d), set()
        width = 2 * cuts + 1
        for size in range((n - d) // (cuts + 1), -(-n // (cuts + 1)) + 1):
            for at in range(n - size + 1):
                found.update((size, place, key[at : at + size]) for place in {(at - d) // width, (at + d) // width})
        for size, place, s in found:
            yield True, f"{cuts}/{size}/{place}:{s}"
    longer, numbers, fewer = n, set(), []
    while longer - (most := _allowed(longer, accept)) <= n:
        if most >= least:
            numbers.add(most if most <= DELETED else _cuts(most))
            # A key two or one characters shorter than one that loses two itself loses none or one.
            fewer += [DELETED - (longer - n)] if most == DELETED and longer > n else []
        longer += 1
    for d in numbers - {0}:
        if d == 1:
            yield False, f"1-:{key}"
            for i, s in enumerate(_without_one(key)):
                yield False, f"1={i}:{s}"
        elif d == DELETED:
            for k in fewer:
                for s in _deletions(key, k):
                    yield False, f"{d}:{s}"
        else:
            for size, place, s in {(size, start // (2 * d + 1), key[start : start + size]) for start, size in _pieces(n, d)}:
                yield False, f"{d}/{size}/{place}:{s}"


def _numbered(keys: DataFrame) -> DataFrame:
    """(id, name_key) of the different keys, written. Ids are in no order of the keys, so the smallest neighbour of a key is any of them."""
    known = keys.where("name_key is not null").select("name_key").distinct()
    return written(known.select(F.xxhash64(F.monotonically_increasing_id()).alias("id"), "name_key"), "keys")


def _near(keys: DataFrame, accept: float, least: int = 1) -> DataFrame:
    """(x, y, a, b, score): pairs of ids and keys of ``keys`` (id, name_key) with a similarity of ``accept`` or more where the longer one allows ``least`` edits or more; written."""

    def rows(batch: pa.RecordBatch, at: list[int], longer: list[bool | None], signs: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in ("id", "n")), pa.array(longer, pa.bool_()), pa.array(signs, pa.string())], names=["id", "n", "longer", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, longer, signs = [], [], []
            for k, key in enumerate(batch.column("name_key").to_pylist()):
                for side, s in _signatures(key, accept, least):
                    at.append(k), longer.append(side), signs.append(s)
                    if len(at) >= 1 << 16:
                        yield rows(batch, at, longer, signs)
                        at, longer, signs = [], [], []
            yield rows(batch, at, longer, signs)

    spark = keys.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = F.length("name_key")
    # Keys too short for any edit have no signatures; the others are dealt out, as few rows of theirs become many.
    some = keys.where(_edits(n / accept + 1, accept) >= least).select("id", "name_key", n.alias("n")).repartition(parts, "id")
    # Equal hashes only bring keys together, which are compared below. Most signatures are found once, so only the few others are written.
    every = some.mapInArrow(run, "id long, n int, longer boolean, s string").withColumn("s", F.xxhash64("s"))
    signed = written(every.withColumn("met", F.count("*").over(W.partitionBy("s"))).where("met > 1").drop("met"), "signatures")
    x = signed.where("longer is null or longer").select(F.col("id").alias("x"), F.col("n").alias("nx"), "s")
    y = signed.where("longer is null or not longer").select(F.col("id").alias("y"), F.col("n").alias("ny"), "s")
    order = (F.col("ny") < F.col("nx")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    met = x.join(y, "s").where(order & (F.col("nx") - F.col("ny") <= _edits(F.col("nx"), accept))).select("x", "y", "nx", "ny").distinct()
    texts = lambda k, t: keys.select(F.col("id").alias(k), F.col("name_key").alias(t))
    # A key that holds the other one costs the difference of their lengths; beyond the edits that are allowed the distance is given up.
    away = F.when(F.contains("tx", "ty"), F.col("nx") - F.col("ny")).otherwise(F.call_function("levenshtein", "tx", "ty", _edits(F.col("nx"), accept)))
    pairs = met.join(texts("x", "tx"), "x").join(texts("y", "ty"), "y").withColumn("away", away).where("away >= 0").withColumn("score", 1 - F.col("away") / F.greatest("nx", "ny", F.lit(1)))
    found = written(pairs.where(F.col("score") >= accept - 1e-9).select("x", "y", F.least("tx", "ty").alias("a"), F.greatest("tx", "ty").alias("b"), "score"), "similar")
    delete(signed)
    return found


def _one_edit(keys: DataFrame, accept: float) -> DataFrame:
    """(a, b): links between ids of ``keys`` (id, name_key) that join all keys one edit apart whose longer one allows one: a star for each text that deleting a character leaves.

    The stars are as many as the deletions, however many keys are alike. Their middle is the key that equals the text, else the first of the keys that lost a character at the same place."""
    n = F.length("name_key")
    cut = keys.where(_edits(n, accept) == 1).select("id", "name_key", F.explode(F.sequence(F.lit(1), n)).alias("i"))
    cut = cut.select("id", "i", F.concat(F.substring("name_key", F.lit(1), F.col("i") - 1), F.substring("name_key", F.col("i") + 1, F.length("name_key"))).alias("left"))
    whole = keys.where(_edits(n + 1, accept) == 1).select("id", F.lit(0).alias("i"), F.col("name_key").alias("left"))
    # Both windows read one exchange and one order.
    met = cut.unionByName(whole).repartition("left").sortWithinPartitions("left", "i", "id")
    equal = F.first(F.when(F.col("i") == 0, F.col("id"))).over(W.partitionBy("left").orderBy("i").rowsBetween(W.unboundedPreceding, 0))
    first = F.first("id").over(W.partitionBy("left", "i").orderBy("id").rowsBetween(W.unboundedPreceding, 0))
    return met.select(F.col("id").alias("a"), F.coalesce(equal, first).alias("b")).where("a <> b")


def similar_keys(keys: DataFrame, accept: float = 0.9) -> DataFrame:
    """(a, b, score), a < b: all pairs of different ``name_key`` with a similarity (1 - edits / longer length) of ``accept`` or more. Null keys have no links; repeated keys count once."""
    if not 0.6 <= accept <= 1:
        raise ValueError("accept lies between 0.6 and 1")
    known = _numbered(keys)
    found = _near(known, accept)
    delete(known)
    return found.select("a", "b", "score")


def _contracted(links: DataFrame) -> DataFrame | None:
    """(id, root) of every id of ``links`` (a, b), ids in random order; equal roots are one component. None without links.

    In each turn a node goes to the smallest node that its smallest neighbour knows, and links between nodes are folded to links between those they went to, so
    that only a part of the nodes and links reach the next turn; a chain of ids in random order shrinks by more than half."""
    turns = []
    edges = written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("b")), "near")
        hop = near.select(F.col("a").alias("b"), F.col("b").alias("root"))
        went = written(near.join(hop, "b").select(F.col("a").alias("id"), "root"), "went")
        turns.append(went)
        to = lambda c: went.select(F.col("id").alias(c), F.col("root").alias(f"r{c}"))
        folded = edges.join(to("a"), "a").join(to("b"), "b").where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        folded = written(folded, "edges")
        delete(edges, near)
        edges = folded
    delete(edges)
    found = None
    for went in reversed(turns):
        # A node that met no more links is its own root.
        found = went if found is None else went.join(found.select(F.col("id").alias("root"), F.col("root").alias("last")), "root", "left").select("id", F.coalesce("last", "root").alias("root"))
    return found


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); a component is named by its smallest node. Rows with a null and links of a node to itself name nobody."""
    pairs = written(links.where("a <> b").select("a", "b"), "links")
    nodes = _numbered(pairs.select(F.explode(F.array("a", "b")).alias("name_key")))
    to = lambda c: nodes.select(F.col("id").alias(f"i{c}"), F.col("name_key").alias(c))
    found = _contracted(pairs.join(to("a"), "a").join(to("b"), "b").select(F.col("ia").alias("a"), F.col("ib").alias("b")))
    delete(pairs)
    if found is None:
        return nodes.select(F.col("name_key").alias("node"), F.col("name_key").alias("component"))
    named = nodes.join(found, "id")
    return named.join(named.groupBy("root").agg(F.min("name_key").alias("component")), "root").select(F.col("name_key").alias("node"), "component")


def people_clusters(mentions: DataFrame, accept: float = 0.9) -> DataFrame:
    """(name_key, cluster, display_name, n_keys, n_mentions, n_documents) for every key of ``mentions`` (name_key, name, doc_id): the cluster is the smallest key that similar ones
    lead to, its display name the most frequent spelling in it (of equal ones the first), the counts are those of the cluster. Without a column name_key, ``linking.name_key`` makes the key of each different name."""
    if not 0.6 <= accept <= 1:
        raise ValueError("accept lies between 0.6 and 1")
    on = "name_key" if "name_key" in mentions.columns else "name"
    known = written(mentions.where(F.col(on).isNotNull()).select(*dict.fromkeys((on, "name", "doc_id"))), "mentions")
    counted = known.groupBy(*dict.fromkeys((on, "name"))).agg(F.count("*").alias("n"))
    names = written(counted if on == "name_key" else counted.withColumn("name_key", name_key(F.col("name"))), "names")
    keys = _numbered(names)
    near = _near(keys, accept, least=2)
    roots = _contracted(_one_edit(keys, accept).unionByName(near.select(F.col("x").alias("a"), F.col("y").alias("b"))))
    delete(near)
    rooted = keys.withColumnRenamed("id", "root") if roots is None else keys.join(roots, "id", "left").select("name_key", F.coalesce("root", "id").alias("root"))
    members = written(rooted, "members")
    clusters = members.groupBy("root").agg(F.min("name_key").alias("cluster"), F.count("*").alias("n_keys"))
    placed = names.join(members, "name_key")
    spelled = placed.groupBy("root", "name").agg(F.sum("n").alias("n"))
    display = spelled.groupBy("root").agg(F.min(F.struct(-F.col("n"), F.col("name").alias("display_name"))).alias("d"), F.sum("n").alias("n_mentions")).select("root", "d.display_name", "n_mentions")
    counts = known.join(members if on == "name_key" else placed.select("name", "root"), on).select("root", "doc_id").distinct().groupBy("root").agg(F.count("doc_id").alias("n_documents"))
    return members.join(clusters, "root").join(display, "root").join(counts, "root").select("name_key", "cluster", "display_name", "n_keys", "n_mentions", "n_documents")
