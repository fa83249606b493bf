"""Order-preserving chunks: exact ranks, prefix sums, row lags and order statistics without one-task windows.

A window over a whole turbine history (or over a whole table) puts that history into one
task. A history of more than ``rows_per_chunk`` rows is cut along its own sort order into
chunks of at most that many rows, whichever way the rows are distributed:

1. histories are counted, and a hash picks about ``SAMPLES`` rows per chunk of the long ones;
   their order values (of any sortable type, ties broken by all order columns) are splitters;
2. rows between neighbouring splitters, a cell, are counted with map-side combine;
3. a cell that is too full is sampled again, sixteen times as densely, until its rows cannot
   be told apart;
4. consecutive cells are packed into chunks.

Everything is a Spark table: nothing of the layout visits the driver but its depth. Splitters
form a search tree: a node holds at most ``FANOUT`` - 1 of them in a sorted array, rows walk
down level by level, joining (history, node) and binary-searching the array. A level is
broadcast when its checked size allows, else shuffled by node. Wide rows move only once, to
the task that owns their chunk.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from windvane.session import materialize, measured, small_result, small_side

ROWS_PER_CHUNK = 1_000_000
SAMPLES = 16
FANOUT = 64
# Order statistics: cells per long history, at least, and rows of a history that may be sorted as one record.
SELECT_CELLS, GATHER_ROWS = 64, 1 << 16

CHUNK, BEFORE = "_chunk", "_before"
_AT, _NODE = "_at", "_node"


def _place(order: list[str]) -> Column:
    """A struct that sorts like the order columns, NULLs last."""
    return F.struct(*[c for i, name in enumerate(order) for c in (F.col(f"`{name}`").isNull().alias(f"n{i}"), F.col(f"`{name}`").alias(f"v{i}"))])


def _same(keys: list[str], *more: tuple[str, str]) -> Column:
    """Row and lookup (key columns named ``_r_``) belong together."""
    pairs = [(f"`{k}`", f"`_r_{k}`") for k in keys]
    return F.expr(" AND ".join([f"{a} <=> {b}" for a, b in pairs] + [f"{a} = {b}" for a, b in more]) or "true")


def _renamed(keys: list[str]) -> list[Column]:
    return [F.col(f"`{k}`").alias(f"_r_{k}") for k in keys]


def _ordering(order: list[str]) -> list[Column]:
    return [F.col(f"`{name}`").asc_nulls_last() for name in order]


class SplitterTree:
    """Sorted splitters per history, as one small table per level.

    ``table`` has the keys, ``_j`` (1, 2, ... in order, ``last`` at most) and ``_low``; a NULL ``_low`` precedes everything.
    """

    def __init__(self, table: DataFrame, keys: list[str], last: int):
        self.keys = keys
        block = 1
        while block * FANOUT <= last:
            block *= FANOUT
        self.levels: list[DataFrame] = []
        while last and block:
            own = table.filter((F.col("_j") % block == 0) & (F.col("_j") % (block * FANOUT) != 0))
            node = F.expr(f"_j div {block * FANOUT}").cast("long").alias("_r_node")
            nodes = own.groupBy(*_renamed(keys), node).agg(F.sort_array(F.collect_list(F.struct("_j", "_low"))).alias("_list"))
            self.levels.append(small_result(nodes.select(*[f"_r_{k}" for k in keys], "_r_node", F.col("_list._low").alias("_seps"))))
            block //= FANOUT

    def locate(self, df: DataFrame, name: str) -> DataFrame:
        """Add the number of splitters at or before each row's ``_at``."""
        columns = [f"`{c}`" for c in df.columns]
        # Always 0, and not to be folded into a condition without keys.
        out = df.withColumn(_NODE, F.pmod(F.xxhash64(_AT), F.lit(1)))
        steps, half = [], FANOUT // 2
        while half:
            steps.append(half)
            half //= 2
        found = (
            f"aggregate(array({', '.join(map(str, steps))}), 0, (p, s) -> CASE WHEN p + s <= size(_seps)"
            f" AND coalesce(_seps[p + s - 1] <= {_AT}, true) THEN p + s ELSE p END)"
        )
        for level in self.levels:
            met = out.join(level, _same(self.keys, (_NODE, "_r_node")), "left")
            out = met.selectExpr(*columns, f"{_NODE} * {FANOUT} + CASE WHEN _seps IS NULL THEN 0 ELSE {found} END AS {_NODE}")
        return out.selectExpr(*columns, f"int({_NODE}) AS `{name}`")


@dataclass
class _Cells:
    """Counted cells of some histories: keys, ``_cell``, ``_low`` (NULL for the first), ``_rows``, ``_start`` and sums."""

    tree: SplitterTree
    rows: DataFrame
    table: DataFrame

    @classmethod
    def count(cls, rows: DataFrame, keys: list[str], sums: list[str], full: int) -> "_Cells":
        """Cells of ``rows``, which have ``_at``, ``_hash`` and ``_every``: one in so many rows becomes a splitter."""
        picked = rows.filter(F.pmod("_hash", "_every") == 0).select(*keys, F.col(_AT).alias("_low")).distinct()
        in_order = Window.partitionBy(*keys).orderBy("_low")
        denser, last = 1, False
        while True:
            table, most = measured(picked.withColumn("_j", F.row_number().over(in_order)), last=F.max("_j"))
            tree = SplitterTree(table, keys, most["last"] or 0)
            located = tree.locate(rows, "_cell")
            measures = [F.count(F.lit(1)).alias("_rows"), F.min("_hash").alias("_h0"), F.max("_hash").alias("_h1"), F.min("_every").alias("_every")]
            measures += [F.sum(f"`{name}`").alias(f"_sum{i}") for i, name in enumerate(sums)]
            crowded = (F.col("_rows") > full) & (F.col("_h0") < F.col("_h1"))
            cells, most = measured(located.groupBy(*keys, "_cell").agg(*measures), every=F.max(F.when(crowded, F.col("_every"))))
            if most["every"] is None or last:
                break
            denser *= SAMPLES
            last = most["every"] <= denser
            named = small_side(cells.filter(crowded).select(*_renamed(keys), F.col("_cell").alias("_r_cell")))
            again = located.join(named, _same(keys, ("_cell", "_r_cell"))).filter(F.pmod("_hash", F.greatest(F.lit(1), F.expr(f"_every div {denser}"))) == 0)
            picked = table.select(*keys, "_low").unionByName(again.select(*keys, F.col(_AT).alias("_low"))).distinct()
        upto = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        low = table.select(*_renamed(keys), F.col("_j").alias("_r_cell"), "_low")
        counted = cells.join(low, _same(keys, ("_cell", "_r_cell")), "left").select(
            *keys, "_cell", "_low", "_rows", (F.sum("_rows").over(upto) - F.col("_rows")).alias("_start"),
            *[(F.sum(f"_sum{i}").over(upto) - F.col(f"_sum{i}")).cast("double").alias(f"_sum{i}") for i in range(len(sums))],
        )
        return cls(tree, rows, counted)


def _slim(df: DataFrame, keys: list[str], order: list[str], *more: str) -> DataFrame:
    narrow = df.select(*dict.fromkeys([*keys, *more]), _place(order).alias(_AT))
    return narrow.withColumn("_hash", F.xxhash64(_AT))


def _of_histories(slim: DataFrame, histories: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the given histories, with their ``_every``."""
    if not keys:  # one history: whole table
        return slim.withColumn("_every", F.lit(histories.first()["_every"]))
    return slim.join(small_side(histories.select(*_renamed(keys), "_every")), _same(keys)).drop(*[f"_r_{k}" for k in keys])


@dataclass
class OrderedChunks:
    """Chunk layout of a table for histories ``keys`` sorted by ``order``.

    ``chunks`` (None if no history is long) has the keys, ``_chunk``, ``_low`` (its first order value), ``_reach``
    (where the rows begin that its lags reach back to), ``_start`` and the sums before it.
    """

    keys: list[str]
    order: list[str]
    total: int = 0
    halo: int = 0
    sums: list[str] = field(default_factory=list)
    chunks: DataFrame | None = None
    last: int = 0  # highest chunk number

    @classmethod
    def plan(
        cls,
        df: DataFrame,
        keys: list[str],
        order: list[str],
        *,
        halo: int = 0,
        sums: list[str] | None = None,
        rows_per_chunk: int = ROWS_PER_CHUNK,
    ) -> "OrderedChunks":
        keys, order, sums = list(keys), list(order), list(sums or [])
        slim = _slim(df, keys, order, *sums)
        long = F.col("_rows") > rows_per_chunk
        sizes, found = measured(slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), total=F.sum("_rows"), long=F.count_if(long))
        layout = cls(keys, order, found["total"] or 0, halo, sums)
        if found["long"]:
            every = max(1, rows_per_chunk // SAMPLES)
            rows = _of_histories(slim, sizes.filter(long).withColumn("_every", F.lit(every)), keys)
            # Cells of at most half the limit, packed by the half in which they start, never exceed it.
            half = max(1, rows_per_chunk // 2)
            layout.chunks, most = measured(layout._packed(_Cells.count(rows, keys, sums, half).table, half), last=F.max(CHUNK))
            layout.last = most["last"]
        return layout

    def _packed(self, cells: DataFrame, half: int) -> DataFrame:
        by_cell = Window.partitionBy(*self.keys).orderBy("_cell")
        earlier = Window.partitionBy(*self.keys).orderBy("_start").rangeBetween(Window.unboundedPreceding, -self.halo)
        pack = F.floor(F.col("_start") / half)
        marked = cells.withColumns({"_reach": F.last("_low").over(earlier), "_first": F.coalesce(pack != F.lag(pack).over(by_cell), F.lit(True))})
        chunks = marked.filter("_first").withColumn(CHUNK, F.row_number().over(by_cell) - 1)
        return chunks.select(*self.keys, CHUNK, "_low", "_reach", "_start", *[f"_sum{i}" for i in range(len(self.sums))])

    @property
    def trivial(self) -> bool:
        return self.chunks is None

    def _tree(self, low: str) -> SplitterTree:
        return SplitterTree(self.chunks.filter(F.col(CHUNK) > 0).select(*self.keys, F.col(CHUNK).alias("_j"), F.col(low).alias("_low")), self.keys, self.last)

    def located(self, df: DataFrame) -> DataFrame:
        """Add ``_chunk`` of every row (0 in short histories)."""
        if self.trivial:
            return df.selectExpr("*", f"0 AS {CHUNK}")
        return self._tree("_low").locate(df.withColumn(_AT, _place(self.order)), CHUNK).drop(_AT)

    def assign(self, df: DataFrame) -> DataFrame:
        """Add ``_chunk`` and what precedes it in its history.

        ``_before`` counts preceding rows; ``_before_<name>`` sums ``sums``.
        """
        names = [f"_before_{s}" for s in self.sums]
        if self.trivial:
            return df.selectExpr("*", f"0 AS {CHUNK}", f"0L AS {BEFORE}", *[f"0D AS {n}" for n in names])
        sums = [F.col(f"_sum{i}").alias(f"_r_{n}") for i, n in enumerate(names)]
        table = self.chunks.select(*_renamed(self.keys), F.col(CHUNK).alias("_r_chunk"), F.col("_start").alias("_r_start"), *sums)
        met = self.located(df).join(small_side(table), _same(self.keys, (CHUNK, "_r_chunk")), "left")
        return met.selectExpr(
            *[f"`{c}`" for c in df.columns], CHUNK, f"coalesce(_r_start, 0L) AS {BEFORE}", *[f"coalesce(`_r_{n}`, 0D) AS `{n}`" for n in names]
        )

    def window(self):
        return Window.partitionBy(*self.keys, CHUNK).orderBy(*_ordering(self.order))


def rows_at(
    df: DataFrame, keys: list[str], order: list[str], sizes: DataFrame, positions: DataFrame, rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """Order-column values of the rows at some 0-based positions of each history, in all histories at once.

    ``sizes`` has the keys and ``_rows``, ``positions`` the keys and ``_position``; both are small, one row or a few per
    history. A history above ``GATHER_ROWS`` rows is divided into cells, a small share of it and at most
    ``rows_per_chunk`` rows, and only the cells that hold a wanted position are sorted. Returns keys, ``_position`` and the order columns.
    """
    slim = _slim(df, keys, order)
    long = sizes.filter(F.col("_rows") > GATHER_ROWS)
    short = sizes.filter(F.col("_rows") <= GATHER_ROWS)
    named = [F.col(f"_r_{k}").alias(k) for k in keys]
    parts = []
    if short.head(1):
        # Histories of a bounded size, gathered and sorted each in one record.
        own = slim if not keys else slim.join(small_side(short.select(*_renamed(keys))), _same(keys), "left_semi")
        lists = own.groupBy(*_renamed(keys)).agg(F.sort_array(F.collect_list(_AT)).alias("_list"))
        asked = positions.withColumnsRenamed({k: f"_p_{k}" for k in keys})
        met = F.expr(" AND ".join(f"`_r_{k}` <=> `_p_{k}`" for k in keys)) if keys else F.col("_position") < F.size("_list")
        parts.append(lists.join(small_side(asked), met).select(*named, "_position", F.col("_list")[F.col("_position").cast("int")].alias(_AT)))
    if long.head(1):
        parts.append(_rows_in_cells(slim, keys, long, positions, rows_per_chunk))
    found = reduce(DataFrame.unionByName, parts) if parts else positions.filter("false").join(slim.select(_AT).limit(0))
    return found.select(*keys, "_position", *[F.col(f"{_AT}.v{i}").alias(name) for i, name in enumerate(order)])


def _rows_in_cells(slim: DataFrame, keys: list[str], sizes: DataFrame, positions: DataFrame, rows_per_chunk: int) -> DataFrame:
    """Keys, ``_position`` and ``_at`` of the rows at positions of long histories."""
    every = F.greatest(F.lit(1), F.least(F.expr(f"_rows div {SELECT_CELLS}"), F.lit(rows_per_chunk // SAMPLES))).cast("long")
    cells = _Cells.count(_of_histories(slim, sizes.withColumn("_every", every), keys), keys, [], rows_per_chunk)
    inside = F.expr("_position >= _start AND _position < _start + _rows")
    if keys:
        met = cells.table.join(small_side(positions.select(*_renamed(keys), "_position")), _same(keys) & inside)
    else:  # one history: its positions are a few numbers
        asked = F.array(*[F.lit(r["_position"]).cast("long") for r in positions.collect()])
        met = cells.table.withColumn("_position", F.explode(asked)).filter(inside)
    held = small_result(met.select(
        *[f"_r_{k}" for k in keys], F.col("_cell").alias("_r_cell"), "_position", (F.col("_position") - F.col("_start")).alias("_nth")
    ))
    within = cells.tree.locate(cells.rows, "_cell").join(held, _same(keys, ("_cell", "_r_cell")), "left_semi")
    # Rows that repeat an order value are one from here on.
    values = within.groupBy(*keys, "_cell", _AT).agg(F.count(F.lit(1)).alias("_times"))
    upto = Window.partitionBy(*keys, "_cell").orderBy(_AT).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = values.withColumn("_upto", F.sum("_times").over(upto))
    covers = F.expr("_nth < _upto AND _nth >= _upto - _times")
    return ranked.join(held, _same(keys, ("_cell", "_r_cell")) & covers).select(*keys, "_position", _AT)


def with_rank(
    df: DataFrame, keys: list[str], order: list[str], name: str = "rank", **options
) -> DataFrame:
    """Exact 1-based row number per history, computed chunk by chunk."""
    layout = OrderedChunks.plan(df, keys, order, **options)
    ranked = layout.assign(df).withColumn(name, F.col(BEFORE) + F.row_number().over(layout.window()))
    return ranked.select(*df.columns, name)


def with_halo(layout: OrderedChunks, df: DataFrame) -> DataFrame:
    """Give every chunk the rows before it that its lags and rolling frames reach back to.

    Adds ``_chunk`` and ``_is_halo``; drop the halo rows after the windows are computed.
    """
    if layout.trivial:
        return df.selectExpr("*", f"0 AS {CHUNK}", "false AS _is_halo")
    columns = [f"`{c}`" for c in df.columns]
    placed = layout._tree("_low").locate(df.withColumn(_AT, _place(layout.order)), CHUNK)
    reaching = layout._tree("_reach").locate(placed, "_last")
    spread = reaching.selectExpr(*columns, f"posexplode(sequence({CHUNK}, greatest({CHUNK}, _last))) AS (_copy, _owner)")
    return spread.selectExpr(*columns, f"_owner AS {CHUNK}", "_copy > 0 AS _is_halo")
