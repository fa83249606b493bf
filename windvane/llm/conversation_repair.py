"""Repair of conversations by weighted CYK parsing.

The roles of a sound conversation read ``(s?(ua)+)?``. In Chomsky normal form the repair grammar has a nonterminal for
every two places (p, q) of that pattern, the rules (p, q) -> (p, r) (r, q), and a row's edits as terminals: keep, give
another role, delete. Rows may be inserted anywhere; the closure of insertions stands on both sides of every terminal.
A span's cell holds, for every nonterminal, the least (cost, audit) of its derivations. Audits of one cell that cost
the same never begin one another (the longer one would have paid for more insertions), so the least cells compose.

Spans are combined bottom-up by length. A derivation from p to q stands at some place r after every row, so any split of
a span finds its least cell; one split a span is enough, and a conversation of n rows takes n - 1 combinations.

Rows become one symbol each and are range-sorted, so that a conversation of any size spreads over tasks; every task
parses the spans that it holds, and the few spans of a conversation are combined in a second step. Texts are hashed or
repaired in a last pass, which streams the rows beside their conversation's audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from windvane.llm.common import saved

# Costs of the edits, and the roles that edits may give.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
ROLES = ("user", "assistant")
# Places in the pattern: nothing yet, after a system row, after a user row, after an assistant row.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
PAIRS = [(p, q) for p in range(4) for q in range(4) if p == q or q >= 2 or (p, q) == (0, 1)]
RULES = [(PAIRS.index((p, q)), PAIRS.index((p, r)), PAIRS.index((r, q))) for p, r in PAIRS for s, q in PAIRS if r == s]
LEAVES = 64  # parts of a text's earlier rows, for the search of repeated ones
FORCED = "-"  # symbol of a row that has to go; others are s, u, a, x, upper-case if truncated

Cell = tuple


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    best: list = [None] * len(PAIRS)
    for pq, pr, rq in RULES:
        a, b = left[pr], right[rq]
        if a is None or b is None:
            continue
        cost, now = a[0] + b[0], best[pq]
        if now is None or cost < now[0] or (cost == now[0] and a[1] + b[1] < now[1]):
            best[pq] = (cost, a[1] + b[1])
    return tuple(best)


def _cell(derivations) -> Cell:
    """Least (cost, audit) of every nonterminal among (p, q, cost, audit)."""
    return tuple(min((d[2:] for d in derivations if d[:2] == pair), default=None) for pair in PAIRS)


def _closure() -> Cell:
    """No row: any number of insertions."""
    once = [(p, p, 0, "") for p in range(4)] + [(p, q, INSERT, "I") for (p, role), q in STEPS.items() if role in "ua"]
    cell = _cell(once)
    for _ in range(2):
        cell = combined(cell, cell)
    return cell


EMPTY = _closure()


@lru_cache(maxsize=None)
def terminal(symbol: str) -> Cell:
    """The cell of one row."""
    edits = [(p, p, DELETE, "D") for p in range(4)]
    if symbol != FORCED:
        extra = TRUNCATED if symbol.isupper() else 0
        edits += [(p, q, KEEP + extra, "K") for (p, role), q in STEPS.items() if role == symbol.lower()]
        edits += [(p, q, REROLE + extra, "R") for (p, role), q in STEPS.items() if role in "ua"]
    return combined(combined(EMPTY, _cell(edits)), EMPTY)


@lru_cache(maxsize=1 << 15)
def _short(symbols: str) -> Cell:
    if len(symbols) == 1:
        return terminal(symbols)
    half = len(symbols) // 2
    return combined(_short(symbols[:half]), _short(symbols[half:]))


def parsed(spans: list[Cell]) -> Cell:
    """The cell of a row of neighbouring spans, combined by doubling length."""
    while len(spans) > 1:
        spans = [combined(*spans[i : i + 2]) if i + 1 < len(spans) else spans[i] for i in range(0, len(spans), 2)]
    return spans[0] if spans else EMPTY


def cell_of(symbols: str) -> Cell:
    return parsed([_short(symbols[i : i + 8]) for i in range(0, len(symbols), 8)])


def repair_of(cell: Cell) -> tuple[int, str]:
    """Least (cost, audit) of a whole conversation."""
    return min(cell[PAIRS.index((0, q))] for q in ENDS)


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage to every row: conv_id, turn, role, text and copies (0 if the row is dropped, 2 if repeated)."""
    conv, turn = (F.col(c).cast("long") for c in ("conv_id", "turn"))
    name = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit(" ")) for c in (conv, turn)])
    kind = F.pmod(F.crc32(name), F.lit(20))
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        conv.alias("conv_id"), turn.alias("turn"), F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _order(*first: str) -> list:
    return [F.col(c).asc_nulls_first() for c in (*first, "turn", "role", "key")]


def _key() -> F.Column:
    return F.unhex(F.sha2("text", 256)).alias("key")


def _narrow(rows: DataFrame) -> DataFrame:
    """Distinct rows (conv_id, turn, role, key) with their copies n, their faults, and whether an earlier turn says the same."""
    bare = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    there = F.col("copies") > 0
    faults = rows.select(
        "conv_id", F.when(there, F.col("turn")).alias("turn"), F.when(there, F.col("role")).alias("role"), F.when(there, _key()).alias("key"), "copies",
        (bare == "").alias("blank"), (~bare.rlike("[.!?]$")).alias("cut"),
    )
    same = ["conv_id", "role", "key"]
    rows = faults.groupBy("conv_id", "turn", "role", "key").agg(F.sum("copies").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    rows = saved(rows.withColumn("leaf", F.pmod(F.xxhash64("turn"), F.lit(LEAVES)).cast("int")), "turns")
    at = F.struct(F.col("turn").isNotNull(), "turn")
    parts = rows.filter("n > 0").groupBy(*same, "leaf").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("k"))
    # At most LEAVES rows of a text, however often it is said.
    over = F.expr("sum(k) OVER (PARTITION BY conv_id, role, key)"), F.expr("min(first) OVER (PARTITION BY conv_id, role, key)")
    said = parts.select(*[F.col(c).alias(f"_{c}") for c in (*same, "leaf")], over[0].alias("k"), over[1].alias("first")).filter("k > 1")
    met = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in (*same, "leaf")]
    found = rows.join(said, met, "left").withColumn("again", F.col("first").isNotNull() & ~F.col("first").eqNullSafe(at))
    return found.select("conv_id", "turn", "role", "key", "n", "blank", "cut", "again")


class _Span:
    """What is known of consecutive rows of one conversation."""

    def __init__(self, conv):
        self.conv, self.symbols = conv, []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None
        self.first = self.last = ""

    def add(self, turn, role, n, blank, cut, again) -> None:
        initial = role[:1]
        self.illegal += n - 1 + (bool(self.symbols) and self.last + initial not in ("su", "ua", "au"))
        if not self.symbols:
            self.first = initial
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.high = turn
            self.low = turn if self.low is None else self.low
        fresh = 0 if blank or again else 1
        self.blank += n if blank else 0
        self.duplicate += 0 if blank else n - fresh
        self.truncated += fresh * cut
        symbol = initial if initial and initial in "sua" else "x"
        self.symbols.append((symbol.upper() if cut else symbol) * fresh + FORCED * (n - fresh))

    def record(self, part: int, inner: bool) -> tuple:
        cell = cell_of("".join(self.symbols))
        known = [c or (None, None) for c in cell]
        return (self.conv, part, inner, self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.low, self.high, bool(self.symbols), self.first, self.last, [c[0] for c in known], [c[1] for c in known])


_SPAN = (
    "conv_id long, part int, inner boolean, blank long, duplicate long, truncated long, illegal long, turns long, "
    "low long, high long, filled boolean, first string, last string, costs array<long>, audits array<string>"
)
_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int32()), ("inner", pa.bool_())] + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")]
    + [("filled", pa.bool_()), ("first", pa.string()), ("last", pa.string()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of sorted rows; the first and the last one of a task may go on in another."""
    part, span, done = TaskContext.get().partitionId(), None, []
    started = False  # whether a span has ended here before

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), _ARROW.types)], schema=_ARROW)

    for rows in batches:
        for conv, turn, role, n, blank, cut, again in zip(*(rows.column(rows.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "turn", "role", "n", "blank", "cut", "again"))):
            if span is None or conv != span.conv:
                if span is not None:
                    done.append(span.record(part, started))
                    started = True
                span = _Span(conv)
            if n:
                span.add(turn, role, n, blank, cut, again)
        if len(done) >= 1000:
            yield batch()
            done = []
    if span is not None:
        done.append(span.record(part, False))
        yield batch()


_REPAIR = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_NAMES = [field.split()[0] for field in _REPAIR.split(", ")]


def _repair(spans: list[dict]) -> tuple:
    """One conversation from its spans in order."""
    cells = [tuple(None if c is None else (int(c), a) for c, a in zip(s["costs"], s["audits"])) for s in spans]
    cost, audit = repair_of(parsed(cells))
    filled = [s for s in spans if s["filled"]]
    counts = {c: sum(s[c] for s in filled) for c in ("blank", "duplicate", "truncated", "illegal", "turns")}
    counts["illegal"] += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(filled, filled[1:]))
    timed = [s for s in filled if s["low"] is not None]
    counts["turns"] -= sum(a["high"] == b["low"] for a, b in zip(timed, timed[1:]))
    gaps = timed[-1]["high"] - timed[0]["low"] + 1 - counts["turns"] if timed else 0
    return (spans[0]["conv_id"], gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], cost, audit)


def _each(batches):
    for batch in batches:
        out = [_repair([s]) for s in batch.to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string() if c == "audit" else pa.int64()) for i, c in enumerate(_NAMES)], names=_NAMES)


def _meeting(key, table):
    row = _repair(sorted(table.to_pylist(), key=lambda s: s["part"]))
    return pa.table({c: pa.array([row[i]], pa.string() if c == "audit" else pa.int64()) for i, c in enumerate(_NAMES)})


def repairs(rows: DataFrame) -> DataFrame:
    """Faults, cost and audit of every conversation of ``rows`` (conv_id, turn, role, text, copies)."""
    placed = _narrow(rows).repartitionByRange(*_order("conv_id")).sortWithinPartitions(*_order("conv_id"))
    spans = saved(placed.mapInArrow(_spans, _SPAN), "spans")
    # At most two spans of a task may belong to a conversation that other tasks hold too.
    met = spans.filter("NOT inner").groupBy("conv_id").applyInArrow(_meeting, _REPAIR)
    return spans.filter("inner").mapInArrow(_each, _REPAIR).unionByName(met)


class _Repairing:
    """Follows a conversation's audit: gives the repaired rows (edit, role, text) as rows come in."""

    def __init__(self, audit: str):
        self.audit, self.at = audit, 0
        self.place = -((len(audit) - audit.count("D")) % 2)  # a system row comes first if the number of rows is odd

    def _next(self) -> str:
        role = ROLES[self.place % 2]
        self.place += 1
        return role

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield "I", self._next(), ""

    def row(self, role: str, text: str) -> Iterator[tuple]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit != "D":
            given = self._next()
            yield edit, role if edit == "K" else given, text


def _events(batches) -> Iterator[tuple]:
    """Per conversation the row of its repair, then the repaired rows: (repair or None, row or None)."""
    repairing = None
    for batch in batches:
        columns = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names)}
        for i, text in enumerate(columns["text"]):
            if columns["copies"][i] is None:
                if repairing:
                    for row in repairing.inserted():
                        yield None, row
                repairing = _Repairing(columns["audit"][i])
                yield {c: columns[c][i] for c in _NAMES}, None
            else:
                for _ in range(columns["copies"][i]):
                    for row in repairing.row(columns["role"][i], text):
                        yield None, row
    if repairing:
        for row in repairing.inserted():
            yield None, row


def _streamed(rows: DataFrame) -> DataFrame:
    """Every conversation's repair, followed by its rows in order; a conversation is in one task, as a stream."""
    texts = rows.filter("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", "role", _key(), "text", "copies")
    found = repairs(rows).withColumn("kind", F.lit(0))
    both = found.unionByName(texts, allowMissingColumns=True)
    placed = both.repartition("conv_id").sortWithinPartitions(*_order("conv_id", "kind"))
    return placed.select(*_NAMES, "role", "text", "copies")


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, place (from 0), role, text, edit (K, R or I)."""

    def give(batches):
        conv, place, out = None, 0, []
        types = {"conv_id": pa.int64(), "place": pa.int64(), "role": pa.string(), "text": pa.string(), "edit": pa.string()}

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types.values())], names=list(types))

        for repair, row in _events(batches):
            if repair is not None:
                conv, place = repair["conv_id"], 0
                continue
            out.append((conv, place, row[1], row[2], row[0]))
            place += 1
            if len(out) >= 1000:
                yield batch()
                out = []
        if out:
            yield batch()

    return _streamed(rows).mapInArrow(give, "conv_id long, place long, role string, text string, edit string")


def repair_digests(rows: DataFrame) -> DataFrame:
    """Faults, cost and audit of every conversation, and the SHA-256 of its repaired rows ``role:text``, joined by newlines.

    ``rows`` are conv_id, turn, role, text and copies; a row with no copies only names its conversation.

    * Rows of a conversation are taken by turn (NULLs first), then role, then the SHA-256 of the text; rows that repeat all three are neighbours.
    * A role counts by its first character; one that is not s, u or a (an empty role too) can't be kept.
    * A NULL conv_id is a conversation of its own. A conversation without rows has zeros, an empty audit and the hash of
      the empty string. An empty table gives an empty result. Other columns are not read.
    * A conversation of any number of rows is parsed in parts; only its audit (a byte a row) and the running hash are in
      one task, and SHA-256 makes that last pass sequential by definition.
    """

    def give(batches):
        done, digest, empty, last = [], None, True, None
        types = [pa.string() if c == "audit" else pa.int64() for c in _NAMES] + [pa.string()]

        def batch():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=[*_NAMES, "repaired_sha256"])

        for repair, row in _events(batches):
            if repair is not None:
                if last is not None:
                    done.append((*last.values(), digest.hexdigest()))
                last, digest, empty = repair, hashlib.sha256(), True
                if len(done) >= 1000:
                    yield batch()
                    done = []
                continue
            digest.update(f"{'' if empty else chr(10)}{row[1]}:{row[2]}".encode())
            empty = False
        if last is not None:
            done.append((*last.values(), digest.hexdigest()))
            yield batch()

    return _streamed(rows).mapInArrow(give, f"{_REPAIR}, repaired_sha256 string")
