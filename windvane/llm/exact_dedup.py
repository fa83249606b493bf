"""Exact dedup by a tree merge of sorted digest runs.

Every partition turns its rows into a sorted run: one record per digest with the row to keep and the number of rows.
The partitions are the nodes of a hypercube over ``RADIX`` directions per level. In each round a node cuts its run by
the next digits of the digest and hands every piece to the node of that digit, where up to ``RADIX`` pieces are merged
and equal digests become one record. After the last round every node holds one digest range, merged; no node ever
holds more than its share, and no digest meets more than ``RADIX`` records at once, however many copies there are.

Records merge only if SHA-256, an independent 64-bit hash and the length of the normalised text agree.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windvane.llm.common import SPACES, saved, text_rows

RADIX = 8
ROWS_PER_NODE = 250_000
PIECE = 200_000  # records in one shuffled row, at most

# Digest in four words, second hash, length; then the order of rows to keep; then the rows counted.
_RECORD = np.dtype([(f"d{i}", "<u8") for i in range(4)] + [("check", "<i8"), ("size", "<i8"), ("order", "<i8"), ("no_id", "<i8"), ("doc_id", "<i8"), ("row", "<i8"), ("n", "<i8")])
_KEY = ["d0", "d1", "d2", "d3", "check", "size"]
_SORT = ["row", "doc_id", "no_id", "order", *reversed(_KEY)]


def _merged(runs: list[np.ndarray]) -> np.ndarray:
    """Sorted runs as one sorted run; of equal texts the first row in keeping order stays, and counts add up."""
    run = np.concatenate(runs)
    if len(run) == 0:
        return run
    run = run[np.lexsort([run[c] for c in _SORT])]
    first = np.ones(len(run), bool)
    first[1:] = np.logical_or.reduce([run[c][1:] != run[c][:-1] for c in _KEY])
    at = np.flatnonzero(first)
    kept = run[at].copy()
    kept["n"] = np.add.reduceat(run["n"], at)
    return kept


def _pieces(run: np.ndarray, node: int, level: int, levels: int):
    """The run cut for the next round: (target node, bytes). Digits are taken from the digest's first bits, so ranges stay ranges."""
    if len(run) == 0:
        return
    bits = RADIX.bit_length() - 1
    digit = (run["d0"] >> np.uint64(64 - bits * (level + 1))).astype(np.int64) & (RADIX - 1)
    weight = RADIX ** (levels - 1 - level)
    base = node - (node // weight % RADIX) * weight
    for value in range(RADIX):
        part = run[digit == value]
        for at in range(0, len(part), PIECE):
            yield base + value * weight, part[at : at + PIECE].tobytes()


def _emit(items) -> "object":
    import pyarrow as pa

    items = list(items)
    return pa.table({"node": pa.array([n for n, _ in items], pa.int64()), "run": pa.array([b for _, b in items], pa.binary())})


def _leaf_runs(levels: int):
    def leaf(batches):
        runs, node = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.zeros(batch.num_rows, _RECORD)
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            digest = np.frombuffer(b"".join(column["digest"].to_pylist()), ">u8").reshape(-1, 4)
            for i in range(4):
                rows[f"d{i}"] = digest[:, i]
            rows["check"], rows["size"] = column["check"].to_numpy(), column["size"].to_numpy()
            rows["order"] = -column["n_chars"].to_numpy()
            rows["no_id"] = column["doc_id"].is_null().to_numpy(zero_copy_only=False)
            rows["doc_id"] = column["doc_id"].fill_null(0).to_numpy()
            rows["row"], rows["n"] = column["row"].to_numpy(), 1
            leaf_of = column["leaf"].to_numpy()
            if node is None:
                node = int(leaf_of[0])
            runs.append(rows)
            if sum(map(len, runs)) > 4 * PIECE:  # a large leaf: hand over what there is
                yield from _emit(_pieces(_merged(runs), node % RADIX**levels, 0, levels)).to_batches()
                runs = []
        if runs:
            yield from _emit(_pieces(_merged(runs), node % RADIX**levels, 0, levels)).to_batches()

    return leaf


def _round(level: int, levels: int):
    def merge(key, table):
        run = _merged([np.frombuffer(b, _RECORD) for b in table.column("run").to_pylist()])
        return _emit(_pieces(run, key[0].as_py(), level, levels))

    return merge


def _last_round(key, table):
    import pyarrow as pa

    run = _merged([np.frombuffer(b, _RECORD) for b in table.column("run").to_pylist()])
    digest = np.stack([run[f"d{i}"] for i in range(4)], axis=1).astype(">u8").tobytes()
    return pa.table({
        "digest": pa.array([digest[i : i + 32] for i in range(0, len(digest), 32)], pa.binary()),
        "check": run["check"], "size": run["size"],
        "keep_id": pa.array(run["doc_id"], mask=run["no_id"].astype(bool)), "keep_row": run["row"], "group_size": run["n"],
    })


def exact_groups(documents: DataFrame, id_column: str = "doc_id", text_column: str = "text", chars: str = SPACES) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the text without ``chars``).

    * NULL text counts as empty; empty texts are equal to each other.
    * Kept is the row with the most code points in its original text, then the smallest id (NULL ids last).
    * Rows that repeat id and text: exactly one of them is kept. An empty table gives an empty result.
    * Columns other than id and text are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.translate(text, chars, "")
    rows = text_rows(documents, id_column, text_column).select(
        "doc_id", F.length(text).cast("long").alias("n_chars"), bare.alias("bare"), F.monotonically_increasing_id().alias("row"),
        F.spark_partition_id().cast("long").alias("leaf"),
    )
    rows = rows.select(
        "doc_id", "n_chars", "row", "leaf", F.unhex(F.sha2("bare", 256)).alias("digest"), F.xxhash64("bare").alias("check"),
        F.octet_length("bare").cast("long").alias("size"),
    )
    rows = saved(rows, "digests")
    shape = rows.agg(F.count(F.lit(1)), F.max("leaf")).first()
    nodes = max((shape[1] or 0) + 1, math.ceil(shape[0] / ROWS_PER_NODE), 2)
    levels = max(1, math.ceil(math.log(nodes, RADIX)))
    runs = rows.mapInArrow(_leaf_runs(levels), "node long, run binary")
    for level in range(1, levels):
        runs = runs.groupBy("node").applyInArrow(_round(level, levels), "node long, run binary")
    merged = runs.groupBy("node").applyInArrow(
        _last_round, "digest binary, check long, size long, keep_id long, keep_row long, group_size long"
    )
    # Back to the rows in two steps, so that a digest of very many rows is spread over the leaves that hold it.
    key = ["digest", "check", "size"]
    held = rows.select(*key, "leaf").distinct().join(saved(merged, "groups"), key)
    found = rows.join(held, [*key, "leaf"])
    return found.select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )
