"""Near-duplicate groups: b-bit MinHash signatures and a multi-index Hamming join.

A signature has ``POSITIONS`` minima of 32 bits each; its distance to another is the number of positions that
differ. At the similarity threshold of 0.75 the distance is binomial with mean 8, and exceeds ``RADIUS`` = 20 with
probability 1e-6. Signatures are split into ``CHUNKS`` chunks. Two signatures within the radius differ, by pigeonhole,
in at most ``RADIUS // CHUNKS`` = 2 positions of some chunk; every choice of positions in error is enumerated and the
others form a key. So all pairs within the radius share a key (up to distance 23), and the rest is exact:

1. Equal sets are one class. Classes that share a key are compared with the smallest of them: near pairs (within the
   radius), which join classes to families.
2. Where one key still holds several families, all their classes are compared by signature, block by block inside
   tasks; one near pair for a class and another family is handed on. Families are now the components of the whole
   graph of near pairs.
3. The near pairs of step 1 are confirmed on the full sets and joined to components.
4. In families of several components, what is outside the largest is compared with all: by signature, then on the full
   sets, block by block inside tasks; one confirmed link for two components of a block is handed on.

So a group of near copies costs a few pairs per copy, not all pairs, and no link between components is left out.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windvane.llm.common import content_key, saved, text_column, text_rows, texts_of
from windvane.llm.components import components
from windvane.llm.shingles import shingle_sets, similarity_counts
from windvane.llm.words import U64, mix

POSITIONS = 32
CHUNKS = 8
RADIUS = 20
BLOCK = 1024
BLOCK_BYTES = 64 << 20
PERCENT = 75
_SIZE = POSITIONS // CHUNKS
_KEPT = list(combinations(range(_SIZE), _SIZE - RADIUS // CHUNKS))
_MULTIPLY = mix(np.arange(1, POSITIONS + 1, dtype=U64)) | U64(1)
_ADD = mix(np.arange(1001, 1001 + POSITIONS, dtype=U64))


def _signatures(sets: list[np.ndarray]) -> np.ndarray:
    """b-bit minima of non-empty sets, one row per set."""
    out = np.empty((len(sets), POSITIONS), np.uint32)
    if sets:
        values = np.concatenate(sets)
        at = np.cumsum([0] + [len(s) for s in sets[:-1]])
        for i in range(POSITIONS):
            out[:, i] = mix(np.minimum.reduceat(values * _MULTIPLY[i] + _ADD[i], at)) >> U64(32)
    return out


def _sign(batches):
    from hashlib import md5

    def flush(pending, held):
        signed = iter(_signatures([s for s in pending if len(s)]))
        for s in pending:
            held["n_shingles"].append(len(s))
            held["digest"].append(md5(s.tobytes()).digest() if len(s) else None)
            held["signature"].append(next(signed).tobytes() if len(s) else None)
        pending.clear()

    for batch in batches:
        held = {"n_shingles": [], "digest": [], "signature": []}
        pending, total = [], 0
        for s in shingle_sets(text_column(batch)):
            pending.append(s)
            total += len(s)
            if total > 1 << 16:
                flush(pending, held)
                total = 0
        flush(pending, held)
        names = ["doc_id", "mark", "size", "leaf"]
        yield pa.RecordBatch.from_arrays(
            [*[batch.column(batch.schema.get_field_index(n)) for n in names], pa.array(held["n_shingles"], pa.int64()), pa.array(held["digest"], pa.binary()), pa.array(held["signature"], pa.binary())],
            names=[*names, *held],
        )


def _keys(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        held = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(-1, CHUNKS, _SIZE).astype(U64)
        keys = np.empty((len(held), CHUNKS, len(_KEPT)), U64)
        for number, kept in enumerate(_KEPT):
            key = np.zeros((len(held), CHUNKS), U64)
            for i in kept:
                key = mix(key * U64(0x9FB21C651E98DF25) + held[:, :, i] + U64(1))
            keys[:, :, number] = mix(key + (np.arange(CHUNKS, dtype=U64) * U64(len(_KEPT)) + U64(number)) * U64(0xD6E8FEB86659FD93))
        times = CHUNKS * len(_KEPT)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), times)), pa.array(np.repeat(batch.column(1).to_numpy(), times))],
            names=["key", "cid", "comp"],
        )


def _confirm(percent: int):
    """Of pairs with both texts, those whose full sets are similar enough."""

    def confirm(batches):
        for batch in batches:
            sides = [shingle_sets(text_column(batch, n)) for n in ("text_a", "text_b")]
            linked = []
            for a, b in zip(*sides):
                common, union = similarity_counts(a, b)
                linked.append(union > 0 and 100 * common >= percent * union)
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)).filter(keep) for n in ("a", "b")], names=["a", "b"])

    return confirm


def _near(batches):
    """Of pairs with both signatures, those within the radius."""
    for batch in batches:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, POSITIONS) for i in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((a != b).sum(axis=1) <= RADIUS))


def _blocks(batches, key: str):
    """Rows sorted by key and block, as one table per block."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
        if not table.num_rows:
            continue
        ids = [table.column(n).to_numpy() for n in (key, "i", "j")]
        cuts = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in ids])) + 1
        at = 0
        for cut in cuts.tolist():
            yield table.slice(at, cut - at)
            at = cut
        rest = table.slice(at)
    if rest is not None and rest.num_rows:
        yield rest


def _sides(block):
    """Members and outsiders of a block: row numbers; ids, components and signatures of all rows."""
    side, cid, comp = (block.column(n).to_numpy() for n in ("side", "cid", "comp"))
    signature = np.frombuffer(b"".join(block.column("signature").to_pylist()), np.uint32).reshape(-1, POSITIONS)
    return np.flatnonzero(side == 0), np.flatnonzero(side == 1), cid, comp, signature


def _near_across(member, other, comp, signature):
    """Row pairs (member, outsider) of different components within the radius, in parts."""
    for at in range(0, len(other), 64):
        part = other[at : at + 64]
        near = comp[member][:, None] != comp[part][None, :]
        x, y = np.nonzero(near)
        for cut in range(0, len(x), 1 << 15):
            p, q = member[x[cut : cut + (1 << 15)]], part[y[cut : cut + (1 << 15)]]
            ok = (signature[p] != signature[q]).sum(axis=1) <= RADIUS
            yield p[ok], q[ok]


def _pairs(found) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([max(p) for p in found], pa.int64()), pa.array([min(p) for p in found], pa.int64())], names=["a", "b"])


def _cross(batches):
    """Near pairs across families, from blocks of members and outsiders of a key: one for an outsider and another family."""
    for block in _blocks(batches, "key"):
        member, other, cid, comp, signature = _sides(block)
        found = {}
        for p, q in _near_across(member, other, comp, signature):
            for x, y in zip(p.tolist(), q.tolist()):
                found.setdefault((y, comp[x]), (int(cid[x]), int(cid[y])))
        if found:
            yield _pairs(found.values())


def _across(percent: int):
    """Confirmed links across components, from blocks of members and outsiders of a family: enough to join all that are linked."""

    def links(batches):
        for block in _blocks(batches, "family"):
            member, other, cid, comp, signature = _sides(block)
            sets = list(shingle_sets(text_column(block)))
            root = {}

            def find(x):
                while x in root:
                    x = root[x]
                return x

            found = []
            for p, q in _near_across(member, other, comp, signature):
                for x, y in zip(p.tolist(), q.tolist()):
                    a, b, least, most = find(comp[x]), find(comp[y]), *sorted((len(sets[x]), len(sets[y])))
                    if a != b and 100 * least >= percent * most:
                        common, union = similarity_counts(sets[x], sets[y])
                        if 100 * common >= percent * union:
                            root[a] = b
                            found.append((int(cid[x]), int(cid[y])))
            if found:
                yield _pairs(found)

    return links


def _dealt(members: DataFrame, key: str) -> DataFrame:
    """Members (with ni and nj, numbers of blocks) against the outsiders of a key or family, in blocks of bounded size.

    Every row meets every outsider in one block. Rows of the largest component are not compared with each other, so
    they are repeated only as often as the outsiders fill blocks.
    """
    own = [c for c in members.columns if c not in ("major", "ni", "nj")]
    inside = members.selectExpr(*own, "0 AS side", "pmod(cid, ni) AS i", "explode(sequence(0L, nj - 1)) AS j")
    outside = members.filter("comp <> major").selectExpr(*own, "1 AS side", "explode(sequence(0L, ni - 1)) AS i", "pmod(cid, nj) AS j")
    return inside.unionByName(outside).repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")


def _within(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    signed = classes.select("cid", "signature")
    both = pairs.join(signed.withColumnsRenamed({"cid": "a", "signature": "sa"}), "a").join(signed.withColumnsRenamed({"cid": "b", "signature": "sb"}), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(_near, "a long, b long")


def near_groups(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, mark, size (of its text), n_shingles, component_id, kept, comp.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; sets are five-word shingles (the whole sequence if shorter).

    * Texts that are NULL or without words have an empty set, link with nothing and are kept.
    * ``component_id`` is the smallest id reachable (NULL only if the whole component has no id); kept says that the
      row has that id. ``comp`` names the component itself, also where ids are missing or shared (NULL for an empty set).
    * Repeated rows are in one component; rows that repeat id and text have the same result.
    * An empty table gives an empty result. Other columns are not read.
    """
    docs = text_rows(documents, id_column, text_column)
    signed = docs.select("doc_id", "text", *content_key(), F.spark_partition_id().alias("leaf")).mapInArrow(
        _sign, "doc_id long, mark long, size int, leaf int, n_shingles long, digest binary, signature binary"
    )
    signed = saved(signed.withColumn("row", F.monotonically_increasing_id()), "signatures")
    filled = signed.filter(F.col("digest").isNotNull())
    classes = filled.groupBy("digest").agg(
        F.min("row").alias("row"), F.min_by("doc_id", "row").alias("doc_id"), F.min_by("mark", "row").alias("mark"), F.min_by("size", "row").alias("size"),
        F.first("signature").alias("signature"), F.min("doc_id").alias("least_id"),
    )
    # xxhash64 of one long is a bijection, so this is a unique id in random order.
    classes = saved(classes.withColumn("cid", F.xxhash64("row")).drop("row"), "classes")

    keyed = classes.select("cid", F.col("cid").alias("comp"), "signature").mapInArrow(_keys, "key long, cid long, comp long").select("key", "cid")
    leaders = keyed.groupBy("key").agg(F.min("cid").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = keyed.join(leaders, "key").filter("cid <> b").select(F.col("cid").alias("a"), "b").distinct()
    stars = saved(_within(stars, classes), "stars")
    near = components(stars)

    labelled = classes.join(near.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    labelled = saved(labelled.select("cid", "comp", "signature"), "labelled")
    keyed = labelled.mapInArrow(_keys, "key long, cid long, comp long")
    parts = keyed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max_by("comp", "n").alias("major"), F.sum("n").alias("total"), F.max("n").alias("top")).filter("k > 1 AND total > 2")
    blocks = mixed.select("key", "major", F.ceil(F.col("total") / BLOCK).alias("ni"), F.ceil((F.col("total") - F.col("top")) / BLOCK).alias("nj"))
    members = keyed.join(blocks, "key").join(labelled.select("cid", "signature"), "cid")
    across = _dealt(members, "key").mapInArrow(_cross, "a long, b long").distinct()
    families = components(near.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(across))
    families = families.withColumnsRenamed({"node": "cid", "comp": "family"})

    needed = saved(classes.select("cid", "doc_id", "mark", "size").join(families, "cid"), "needed")
    texts = texts_of(docs, needed, "cid", "family").select("cid", "family", "text").dropDuplicates(["cid"])
    texts = saved(texts, "texts")
    sides = [texts.select(F.col("cid").alias(n), F.col("text").alias(f"text_{n}")) for n in ("a", "b")]
    links = saved(stars.join(sides[0], "a").join(sides[1], "b").mapInArrow(_confirm(percent), "a long, b long"), "links")
    found = components(links)

    joined = texts.join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    parts = joined.groupBy("family", "comp").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    sizes = [F.count(F.lit(1)).alias("k"), F.max_by("comp", "n").alias("major"), F.sum("n").alias("total"), F.max("n").alias("top"), F.sum("bytes").alias("bytes")]
    # Also families of two classes: step 2 may have found their pair, which is not among the stars then.
    mixed = parts.groupBy("family").agg(*sizes).filter("k > 1")
    by_bytes = F.ceil(F.col("bytes") / BLOCK_BYTES)
    blocks = mixed.select(
        "family", "major", F.greatest(F.ceil(F.col("total") / BLOCK), by_bytes).alias("ni"), F.greatest(F.ceil((F.col("total") - F.col("top")) / BLOCK), by_bytes).alias("nj")
    )
    members = joined.join(blocks, "family").join(classes.select("cid", "signature"), "cid")
    more = _dealt(members, "family").mapInArrow(_across(percent), "a long, b long")
    found = components(found.select(F.col("node").alias("a"), F.col("comp").alias("b")).unionByName(more))

    named = classes.select("cid", "digest", "least_id").join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    named = saved(named, "components")
    least = named.groupBy("comp").agg(F.min("least_id").alias("component_id"))
    of_class = named.join(least, "comp").select("digest", "component_id", "comp")
    # In two steps, so that a class with very many rows is spread over the leaves that hold it.
    held = filled.select("digest", "leaf").distinct().join(of_class, "digest")
    joined = signed.join(held, ["digest", "leaf"], "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "mark", "size", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "comp")
