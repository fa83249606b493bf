"""Perplexity scores from a hierarchical Pitman-Yor language model.

Every context, the word before (or the begin of a text), has a restaurant that seats the words which follow it in the
training texts. All contexts share one parent, the word restaurant, whose base is a spelling model: a hierarchy of
restaurants over symbol contexts of ``ORDER`` symbols down to none, where contexts share the restaurant of their
shorter context as parent. A table opened in a restaurant is a customer of its parent, so frequent words do not
outweigh the spelling of rare ones, and a word that follows many words outweighs one that follows a single word often.
Seatings are sampled by Gibbs sweeps, blocked by dish: all customers of a dish leave a restaurant and are seated again
one after another, given all other tables; large blocks of customers, whose chance of a new table hardly changes, are
drawn together. Tables and predictive probabilities are averaged over draws and over independent chains.

Whether a text ends is drawn before each word, without context. As in the base score, all words that training lacks are
one type: its base is what the spelling model leaves to spellings that were not seen.

Words and pairs of words grow with the corpus. Blocks of texts send their distinct words and pairs, packed, to a part
by the word, a bucket of a table; a part prices what it got and answers every block in the order of its question. A
context's tables are added up in the part of the context as a word. A context is known by 48 bits of the word's hash.
The spelling model has at most 64 ** (ORDER + 1) cells, so chains run whole in a task and their averaged probabilities
may be broadcast.
"""

from __future__ import annotations

import gc
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from windvane.llm.common import saved, shared_folder, text_column, text_rows
from windvane.llm.language_id import held_out
from windvane.llm.words import raw_bytes, word_spans

ORDER = 3
SYMBOLS = 64
CHAINS = 2
SWEEPS, BURN_IN = 8, 4
DRAWS = 3  # of the context seating and of the word seating that prices words
BLOCK_BYTES = 15 << 20
PART_BYTES, LEAST_PARTS = 8 << 20, 16  # of text for every part
PARTS_A_BUCKET = 4  # a task takes the parts of its bucket one after another and writes one file for all
GROUP_BYTES = 8 << 20  # of the table of questions in Parquet
WORDS_AT_ONCE = 1 << 16
KEYS_AT_ONCE = 1 << 20
CONTEXT_DISCOUNT, CONTEXT_STRENGTH = 0.7, 1.0
WORD_DISCOUNT, WORD_STRENGTH = 0.7, 10.0
SYMBOL_DISCOUNT, SYMBOL_STRENGTH = 0.5, 1.0
END_SHARE = 0.01  # of the tokens, before any are seen
FOLDS, HELD_OUT = 5, 1
# Bytes with a symbol of their own; symbol 0 is a word's begin and end.
_OWN = b"abcdefghijklmnopqrstuvwxyz0123456789.,;:!?'\"-|*&$%#("


def _symbols() -> tuple[np.ndarray, np.ndarray]:
    """Symbol of every byte, and how many bytes share it: other ASCII 53, byte C3 54, other first bytes 55, the rest by three bits."""
    symbol = np.full(256, 53, np.int64)
    symbol[192:] = 55
    symbol[0xC3] = 54
    symbol[128:192] = 56 + np.arange(64) % 8
    symbol[np.frombuffer(_OWN, np.uint8)] = np.arange(1, len(_OWN) + 1)
    return symbol, np.bincount(symbol, minlength=SYMBOLS)[symbol].astype(float)


def seat(customers: np.ndarray, base: np.ndarray, others: np.ndarray, discount: float, strength: float, draw) -> np.ndarray:
    """Tables after seating all customers of every dish: base is the parent's probability of the dish, others the restaurant's other tables."""
    tables = np.ones(len(customers))
    at, active = 1, np.flatnonzero(customers > 1)
    while len(active):
        step = 1 if at < 64 else at // 16
        many = np.minimum(customers[active] - at, step)
        t = tables[active]
        fresh = (strength + discount * (others[active] + t)) * base[active]
        chance = fresh / (fresh + at + (many - 1) / 2 - discount * t)
        tables[active] += draw.random(len(active)) < chance if step == 1 else draw.binomial(many.astype(np.int64), np.minimum(chance, 1.0))
        at += step
        active = active[customers[active] > at]
    return np.minimum(tables, customers)


class _Chain:
    """One chain of the spelling model: customers and tables of every (context, symbol) cell on every level."""

    def __init__(self, cells: np.ndarray, counts: np.ndarray, seed: int):
        self.draw = np.random.default_rng(seed)
        self.cells, self.counts = [None] * (ORDER + 1), [None] * (ORDER + 1)
        self.cells[ORDER], self.counts[ORDER] = cells, counts.astype(float)
        self.tables = [None] * (ORDER + 1)
        for level in range(ORDER, -1, -1):
            self.tables[level] = np.ones(len(self.cells[level]))
            if level:
                # The parent of a context lacks its first symbol.
                parent = self.cells[level] % SYMBOLS ** level
                self.cells[level - 1], back = np.unique(parent, return_inverse=True)
                setattr(self, f"up{level}", back)
                self.counts[level - 1] = np.bincount(back, self.tables[level])

    def probabilities(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For every level: its contexts, and their predictive distributions over symbols."""
        out, above, of = [], np.full((1, SYMBOLS), 1 / SYMBOLS), np.zeros(1, np.int64)
        for level in range(ORDER + 1):
            context, symbol = np.divmod(self.cells[level], SYMBOLS)
            known, row = np.unique(context, return_inverse=True)
            parent = above[np.searchsorted(of, known % SYMBOLS ** max(level - 1, 0))] if level else above
            total, tables = np.bincount(row, self.counts[level]), np.bincount(row, self.tables[level])
            own = np.zeros((len(known), SYMBOLS))
            own[row, symbol] = self.counts[level] - SYMBOL_DISCOUNT * self.tables[level]
            above = (own + (SYMBOL_STRENGTH + SYMBOL_DISCOUNT * tables)[:, None] * parent) / (SYMBOL_STRENGTH + total)[:, None]
            of = known
            out.append((known, above))
        return out

    def sweep(self) -> None:
        """Seat all levels again, from the longest contexts to the root, given the parents' present probabilities."""
        levels = self.probabilities()
        for level in range(ORDER, -1, -1):
            context, symbol = np.divmod(self.cells[level], SYMBOLS)
            if level:
                known, table = levels[level - 1]
                base = table[np.searchsorted(known, context % SYMBOLS ** (level - 1)), symbol]
            else:
                base = np.full(len(symbol), 1 / SYMBOLS)
            _, row = np.unique(context, return_inverse=True)
            others = np.bincount(row, self.tables[level])[row] - self.tables[level]
            self.tables[level] = seat(self.counts[level], base, others, SYMBOL_DISCOUNT, SYMBOL_STRENGTH, self.draw)
            if level:
                self.counts[level - 1] = np.bincount(getattr(self, f"up{level}"), self.tables[level])


class Spelling:
    """Averaged predictive distributions: a row of every known context, found through one table per level."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        self.rows, self.logs = [], []
        for level, (known, table) in enumerate(levels):
            rows = np.full(SYMBOLS**level, -1, np.int32)
            rows[known] = np.arange(len(known))
            self.rows.append(rows)
            self.logs.append(np.log10(table).astype(np.float32))

    @classmethod
    def uniform(cls) -> Spelling:
        return cls([(np.zeros(1, np.int64), np.full((1, SYMBOLS), 1 / SYMBOLS))])

    @classmethod
    def fit(cls, spark: SparkSession, cells: np.ndarray, customers: np.ndarray) -> Spelling:
        """From cells in order (context and symbol as one number) with customers; chains are tasks."""
        if not len(cells):
            return cls.uniform()
        data = spark.sparkContext.broadcast((cells, customers))

        def run(batches):
            for batch in batches:
                for seed in batch.column(0).to_pylist():
                    chain, total = _Chain(*data.value, seed=1000 + seed), None
                    for sweep in range(SWEEPS):
                        chain.sweep()
                        if sweep >= BURN_IN:
                            own = chain.probabilities()
                            total = [t for _, t in own] if total is None else [a + t for a, (_, t) in zip(total, own)]
                    for level, ((known, _), table) in enumerate(zip(own, total)):
                        rows = [r.tobytes() for r in (table / (SWEEPS - BURN_IN)).astype(np.float32)]
                        yield pa.RecordBatch.from_arrays([pa.array([level] * len(known), pa.int32()), pa.array(known, pa.int64()), pa.array(rows, pa.binary())], names=["level", "context", "p"])

        drawn = spark.range(0, CHAINS, 1, CHAINS).mapInArrow(run, "level int, context long, p binary").toPandas()
        levels = []
        for level in range(ORDER + 1):
            own = drawn[drawn["level"] == level]
            known, row = np.unique(own["context"].to_numpy(np.int64), return_inverse=True)
            table = np.zeros((len(known), SYMBOLS))
            np.add.at(table, row, np.frombuffer(b"".join(own["p"]), np.float32).reshape(-1, SYMBOLS))
            levels.append((known, table / CHAINS))
        return cls(levels)

    def log10(self, column: pa.Array) -> np.ndarray:
        """Log probability of every word (a binary column)."""
        codes, context, word, weight = _spelled(column)
        out, open_ = np.empty(len(codes)), np.ones(len(codes), bool)
        for level in range(len(self.rows) - 1, -1, -1):
            row = self.rows[level][context % SYMBOLS**level]
            use = open_ & (row >= 0)
            out[use] = self.logs[level][row[use], codes[use]]
            open_ &= ~use
        return np.bincount(word, out - weight, minlength=len(column))


def _spelled(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All symbols of all words, each word with its end: symbol, context of ORDER symbols as a number, word, log10 of bytes sharing it."""
    symbol, shared = _symbols()
    data, offsets = raw_bytes(column)
    sizes = np.diff(offsets) + 1
    ends = np.cumsum(sizes) - 1
    codes, weight = np.zeros(int(sizes.sum()), np.int64), np.zeros(int(sizes.sum()))
    letter = np.ones(len(codes), bool)
    letter[ends] = False
    codes[letter], weight[letter] = symbol[data], np.log10(shared[data])
    word = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(codes)) - (ends - sizes + 1)[word]
    context = np.zeros(len(codes), np.int64)
    for back in range(1, ORDER + 1):
        before = np.zeros(len(codes), np.int64)
        before[back:] = codes[:-back]
        context += np.where(place >= back, before, 0) * SYMBOLS ** (back - 1)
    return codes, context, word, weight


def pack(*columns: np.ndarray) -> bytes:
    """Arrays as one compressed value: first all lowest bytes of an array, then all second ones, so that small numbers cost little."""
    raw = [np.array([len(c) for c in columns], np.int64).tobytes()]
    raw += [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    raw = b"".join(raw)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = pa.Codec("zstd").decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), asbytes=True)
    at, out = 8 * len(kinds), []
    for size, kind in zip(np.frombuffer(raw, np.int64, len(kinds)).tolist(), map(np.dtype, kinds)):
        out.append(np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size).T.copy().view(kind).reshape(size))
        at += size * kind.itemsize
    return out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the number of every key among them: ``np.unique`` in less memory."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    at = np.empty(len(keys), np.int32)
    at[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    return keys[first], at


class _Pairs:
    """Distinct pairs of a block by word, then word before, from the numbers of all its words in order and the words per text."""

    def __init__(self, at: np.ndarray, sizes: np.ndarray, words: int):
        keys = np.zeros(len(at), np.int64)
        keys[1:] = at[:-1]
        keys[(np.cumsum(sizes) - sizes)[sizes > 0]] = 0
        keys += at.astype(np.int64) * words
        pairs, self.at = _distinct(keys)
        self.word, self.before = (x.astype(np.int32) for x in np.divmod(pairs, words))


def _numbered(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of distinct words in order (0, the begin of a text, is first), the number of every word, words per text, where words start and end."""
    none = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)]
    found = [(n, h, s.astype(np.int32), e.astype(np.int32)) for _, _, n, h, s, e in word_spans(column)]
    sizes, hashes, start, end = (np.concatenate(x) for x in zip(none, *found))
    del found
    words, at = _distinct(np.append(np.zeros(1, np.uint64), hashes))
    return words, at[1:], sizes, start, end


def _blocks(batches):
    """Blocks of consecutive rows of one batch, about BLOCK_BYTES of text: number, texts, and rows. Every scan of a table numbers them alike."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        sizes = np.diff(raw_bytes(text_column(batch))[1])
        cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // BLOCK_BYTES, prepend=-1))
        for first, last in zip(cuts, [*cuts[1:], len(sizes)]):
            part = batch.slice(first, last - first)
            yield block, text_column(part), part
            block += 1


def _held(part: pa.RecordBatch) -> np.ndarray:
    return part.column(part.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False)


def _part(context: np.ndarray, parts: int) -> np.ndarray:
    """Part of every context (the upper 48 bits of a word's hash): parts are ranges."""
    return (context * np.uint64(parts) >> np.uint64(48)).astype(np.int64)


_ASKED = (np.uint64, np.int32, np.int32, np.uint8, np.int32, np.uint64, np.int32)


def _asked(parts: int):
    """What every block has: for each part its words (hashes as differences, training counts, spelled) and pairs (number per word, contexts, training counts)."""
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32

    def run(batches):
        for block, texts, rows in _blocks(batches):
            data = raw_bytes(texts)[0]
            words, at, sizes, begin, end = _numbered(texts)
            start, size = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)
            start[at], size[at] = begin, end - begin
            del begin, end
            own, learned = _Pairs(at, sizes, len(words)), np.repeat(~_held(rows), sizes)
            n = np.bincount(at[learned], minlength=len(words)).astype(np.int32)
            m = np.bincount(own.at[learned], minlength=len(own.word)).astype(np.int32)
            contexts, followed = words[own.before] >> np.uint64(16), np.bincount(own.word, minlength=len(words)).astype(np.int32)
            cuts = np.searchsorted(_part(words >> np.uint64(16), parts), np.arange(parts + 1))
            pair_cuts = np.searchsorted(own.word, cuts)
            del own, learned, at
            for part in np.flatnonzero(np.diff(cuts)):
                w, p = slice(cuts[part], cuts[part + 1]), slice(pair_cuts[part], pair_cuts[part + 1])
                ends = np.cumsum(size[w], dtype=np.int64)
                spelled = lower[data[np.repeat(start[w] - ends + size[w], size[w]) + np.arange(ends[-1])]]
                blob = pack(np.diff(words[w], prepend=np.zeros(1, np.uint64)), n[w], size[w], spelled, followed[w], contexts[p], m[p])
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([block], pa.int64()), pa.array([blob], pa.binary())], names=["part", "block", "blob"])

    return run


_TEXTS = (np.uint64, np.int64, np.uint8, np.uint8, np.int32, np.int32)


def _texts(batches):
    """Every block as one row: the sum of its words' hashes; ids, which of them are NULL, held out, words per text; the number of every word."""
    for block, texts, rows in _blocks(batches):
        words, at, sizes, _, _ = _numbered(texts)
        ids = rows.column(rows.schema.get_field_index("doc_id"))
        null = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
        blob = pack(words.sum(keepdims=True), ids.fill_null(0).to_numpy(), null, _held(rows).astype(np.uint8), sizes.astype(np.int32), at)
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([blob], pa.binary())], names=["block", "blob"])


class _Sums:
    """Distinct keys in order with the sums of their values, which come some at a time: memory follows the distinct keys."""

    def __init__(self, kind: type):
        self.keys, self.values = np.zeros(0, kind), np.zeros(0, np.int64)
        self._more, self._size = [], 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        self._more.append((keys, values))
        self._size += len(keys)
        if self._size > max(len(self.keys), KEYS_AT_ONCE):
            self.sums()

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        if self._size:
            keys, values = (np.concatenate([own, *more]) for own, more in zip((self.keys, self.values), zip(*self._more)))
            self._more, self._size = [], 0
            order = np.argsort(keys)
            keys = keys[order]
            first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            self.keys, self.values = keys[first], np.add.reduceat(values[order], first)
        return self.keys, self.values


class _Merged:
    """Words and pairs of a part with their training counts in all blocks, and where each block's own are among them.

    A very frequent word has a pair with nearly every word of every block: pairs are unpacked and added by runs of blocks.
    """

    def __init__(self, table: pa.Table):
        table = table.sort_by("block")
        self.blocks, self._blobs = table.column("block").to_pylist(), table.column("blob")
        found, run, self._runs, contexts, pairs = [], [], [], _Sums(np.uint64), _Sums(np.int64)
        for i, blob in enumerate(self._blobs):
            differences, *words, context, m = unpack(blob.as_py(), *_ASKED)
            found.append((np.cumsum(differences, dtype=np.uint64), *words))
            run.append((context, m))
            if i + 1 == len(self.blocks) or sum(len(c) for c, _ in run) > KEYS_AT_ONCE:
                self._runs.append((i + 1 - len(run), i + 1))
                named = self._keep(self._runs[-1], run)
                contexts.add(named, np.zeros(len(named), np.int64))
                run = []
        self.word_edges = np.cumsum([0, *(len(x[0]) for x in found)])
        hashes, n, self._size, self._spelled, self._followed = (np.concatenate(x) for x in zip(*found))
        del found
        self.words, self.word_at = _distinct(hashes)
        self.count = np.bincount(self.word_at, n, minlength=len(self.words)).astype(np.int64)
        self.contexts = contexts.sums()[0]
        for blocks in self._runs:
            pairs.add(*self._pairs(blocks))
        self._keys, self.pair_count = pairs.sums()
        self.word, self.context = (x.astype(np.int32) for x in np.divmod(self._keys, max(len(self.contexts), 1)))

    def _keep(self, blocks: tuple[int, int], found: list[tuple]) -> np.ndarray:
        """Contexts and training counts of a run's pairs, the last run's only; returns the distinct contexts."""
        context, m = (np.concatenate(x) for x in zip(*found))
        self._kept = (blocks, *_distinct(context), m)
        return self._kept[1]

    def _pairs(self, blocks: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a run of blocks, each as one number, in their order, and their training counts there."""
        if self._kept[0] != blocks:
            self._keep(blocks, [unpack(self._blobs[i].as_py(), *_ASKED)[5:] for i in range(*blocks)])
        _, named, at, m = self._kept
        words = slice(self.word_edges[blocks[0]], self.word_edges[blocks[1]])
        first = np.repeat(self.word_at[words].astype(np.int64) * max(len(self.contexts), 1), self._followed[words])
        return first + np.searchsorted(self.contexts, named)[at], m

    def pair_at(self):
        """For every block, where its pairs are among those of the part."""
        for blocks in self._runs:
            at = np.searchsorted(self._keys, self._pairs(blocks)[0]).astype(np.int32)
            sizes = [int(self._followed[self.word_edges[i] : self.word_edges[i + 1]].sum()) for i in range(*blocks)]
            yield from np.split(at, np.cumsum(sizes)[:-1])

    def spelled(self) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and bytes of the words, lower-cased."""
        some = np.zeros(len(self.words), np.int64)
        some[self.word_at] = np.arange(len(self.word_at))
        size, ends = self._size[some], np.cumsum(self._size, dtype=np.int64)
        offsets = np.cumsum(size, dtype=np.int64) - size
        return size, self._spelled[np.repeat((ends - self._size)[some] - offsets, size) + np.arange(int(size.sum()))]

    def to_contexts(self, part: int, parts: int, *values: np.ndarray) -> dict:
        """One row for every part that holds contexts of this part's pairs: contexts as differences, and their values."""
        cuts = np.searchsorted(_part(self.contexts, parts), np.arange(parts + 1))
        to = np.flatnonzero(np.diff(cuts))
        blobs = [pack(np.diff(self.contexts[a:b], prepend=np.zeros(1, np.uint64)), *(v[a:b] for v in values)) for a, b in zip(cuts[to], cuts[to + 1])]
        return {"part": to, "of": np.full(len(to), part), "blob": blobs}


# What parts send each other: kind, the part it is for, the part it is of, up to three sums, packed arrays.
_MESSAGE = "kind int, part int, of int, x double, y double, z double, blob binary"
WORDS, CONTEXTS, PAIRS = 0, 1, 2


def _messages(kind: int, part, blob, of=None, sums=(0, 0, 0)) -> pa.Table:
    columns = [[kind] * len(blob), part, part if of is None else of, *([v] * len(blob) for v in sums), blob]
    types = [pa.int32()] * 3 + [pa.float64()] * 3 + [pa.binary()]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=["kind", "part", "of", "x", "y", "z", "blob"])


def _of_kind(table: pa.Table, kind: int) -> list[bytes]:
    """Packed arrays of all messages of a kind, by the part they are of."""
    found = table.filter(pa.array(table.column("kind").to_numpy() == kind)).sort_by("of")
    return found.column("blob").to_pylist()


_WORDS = (np.int64, np.int32, np.uint8)


def _first_seating(parts: int):
    """One table for every pair. Words with customers and spelled, with the sums of training tokens and words; contexts with the tables they have here."""

    def run(table: pa.Table) -> pa.Table:
        part, own = table.column("part")[0].as_py(), _Merged(table)
        seen = own.pair_count > 0
        n = np.bincount(own.word[seen], minlength=len(own.words)).astype(np.int64)
        tables = np.bincount(own.context[seen], minlength=len(own.contexts)).astype(np.int32)
        words = _messages(WORDS, [part], [pack(n, *own.spelled())], sums=(own.count.sum(), (own.count > 0).sum(), 0))
        return pa.concat_tables([words, _messages(CONTEXTS, **own.to_contexts(part, parts, tables))])

    return run


def _added(blobs: list[bytes], *kinds: type) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Contexts of every message, the distinct ones, and the sums of their values."""
    rows = [unpack(b, np.uint64, *kinds) for b in blobs]
    each = [np.cumsum(r[0], dtype=np.uint64) for r in rows]
    distinct, at = np.unique(np.concatenate([np.zeros(0, np.uint64), *each]), return_inverse=True)
    return each, distinct, [np.bincount(at, np.concatenate([np.zeros(0), *(r[i] for r in rows)]), minlength=len(distinct)) for i in range(1, len(kinds) + 1)]


def _all_tables(table: pa.Table) -> pa.Table:
    """For contexts of this part: the tables of their restaurants, sent back in the order in which each part named them."""
    each, distinct, (tables,) = _added(table.column("blob").to_pylist(), np.int32)
    back = [pack(tables[np.searchsorted(distinct, x)].astype(np.int32)) for x in each]
    return _messages(CONTEXTS, table.column("of").to_pylist(), back, of=table.column("part").to_pylist())


_SEATED = (np.int64, np.float32, np.int32)


def _prices(own: _Merged, sent: pa.Table, free: float, new: float, total: float) -> np.ndarray:
    """Probabilities of the part's words in the word restaurant."""
    n, base, tables = unpack(_of_kind(sent, WORDS)[0], *_SEATED)
    if len(n) != len(own.words):
        raise ValueError("the documents changed between two scans: pass a stored table")
    return np.where(n > 0, np.maximum((n - WORD_DISCOUNT * tables / DRAWS + free * base.astype(float)) / total, 1e-300), new)


def _context_seating(parts: int, scale: tuple[float, float, float]):
    """Tables of all pairs by draws from the price of the word and all other tables of the context, averaged.

    Out come words with their tables as customers, contexts with the tables and customers they have here, and for every pair what its
    customers leave after the discount.
    """

    def run(key, asked: pa.Table, sent: pa.Table) -> pa.Table:
        part, own = key[0].as_py(), _Merged(asked)
        draw = np.random.default_rng([131, part])
        price = _prices(own, sent, *scale)
        of_context = np.concatenate([np.zeros(0), *(unpack(b, np.int32)[0] for b in _of_kind(sent, CONTEXTS))])
        tables = np.minimum(own.pair_count, 1) * DRAWS
        many = np.flatnonzero(own.pair_count > 1)
        others, base = of_context[own.context[many]] - 1, price[own.word[many]]
        tables[many] = sum(seat(own.pair_count[many], base, others, CONTEXT_DISCOUNT, CONTEXT_STRENGTH, draw).astype(np.int64) for _ in range(DRAWS))
        n = np.rint(np.bincount(own.word, tables, minlength=len(own.words)) / DRAWS).astype(np.int64)
        here = [np.bincount(own.context, x, minlength=len(own.contexts)).astype(np.int64) for x in (tables, own.pair_count)]
        left = (own.pair_count - CONTEXT_DISCOUNT / DRAWS * tables).astype(np.float32)
        return pa.concat_tables([
            _messages(WORDS, [part], [pack(n, *own.spelled())]),
            _messages(CONTEXTS, **own.to_contexts(part, parts, *here)),
            _messages(PAIRS, [part], [pack(left)]),
        ])

    return run


_ANSWER = (np.uint64, np.int64, np.float32, np.int64, np.int64, np.float32)


def _answered(scale: tuple[float, float, float]):
    """To every block, in its order: the sum of hashes; count and price of words, tables (over all draws) of their restaurants, by how much the count exceeds their customers; what pairs add to the price."""

    def run(key, asked: pa.Table, sent: pa.Table) -> pa.Table:
        own = _Merged(asked)
        price = _prices(own, sent, *scale).astype(np.float32)
        _, distinct, (tables, customers) = _added(_of_kind(sent, CONTEXTS), np.int64, np.int64)
        (left,) = unpack(_of_kind(sent, PAIRS)[0], np.float32)
        context = own.words >> np.uint64(16)
        opened, last = np.zeros(len(context), np.int64), own.count.copy()
        if len(distinct):
            at = np.minimum(np.searchsorted(distinct, context), len(distinct) - 1)
            known = np.flatnonzero(distinct[at] == context)
            opened[known] = tables[at[known]]
            last[known] -= customers[at[known]].astype(np.int64)
        out = []
        for i, p in enumerate(own.pair_at()):
            w = own.word_at[own.word_edges[i] : own.word_edges[i + 1]]
            out.append(pack(own.words[w].sum(keepdims=True), own.count[w], price[w], opened[w], last[w], left[p]))
        return pa.table({"block": pa.array(own.blocks, pa.int64()), "part": pa.array([key[0].as_py()] * len(out), pa.int32()), "blob": pa.array(out, pa.binary())})

    return run


def _customers(batches):
    """Words of every part with their customers, some at once: part, customers, words."""
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n, size, data = unpack(blob, *_WORDS)
            offsets = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            words = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
            yield part, [(n[i : i + WORDS_AT_ONCE].astype(float), words.slice(i, WORDS_AT_ONCE)) for i in range(0, len(n), WORDS_AT_ONCE)]


def _seated(model, others: float):
    """Cells of the spelling model whose customers are the tables of all words, by one draw."""

    def run(batches):
        for part, each in _customers(batches):
            draw = np.random.default_rng([17, part])
            for counts, words in each:
                words, counts = words.filter(pa.array(counts > 0)), counts[counts > 0]
                base = 10 ** (model.value if model else Spelling.uniform()).log10(words)
                tables = seat(counts, base, np.maximum(others - 1, 0) * np.ones(len(counts)), WORD_DISCOUNT, WORD_STRENGTH, draw)
                codes, context, word, _ = _spelled(words)
                cell, back = np.unique(context * SYMBOLS + codes, return_inverse=True)
                n = np.bincount(back, tables[word], minlength=len(cell)).astype(np.int64)
                # The tables themselves add up in a cell of their own.
                yield pa.RecordBatch.from_arrays([pa.array(np.append(cell, -1)), pa.array(np.append(n, int(tables.sum())))], names=["cell", "n"])

    return run


def _last_seating(model, others: float):
    """Words with customers, base probability and tables (added up over draws), and the sums of these."""

    def run(batches):
        for part, each in _customers(batches):
            draw = np.random.default_rng([71, part])
            found = []
            for counts, words in each:
                base = (10 ** model.value.log10(words)).astype(np.float32)
                seen = counts > 0
                tables = np.zeros(len(counts), np.int32)
                for _ in range(DRAWS):
                    tables[seen] += seat(counts[seen], base[seen].astype(float), np.maximum(others - 1, 0) * np.ones(int(seen.sum())), WORD_DISCOUNT, WORD_STRENGTH, draw).astype(np.int32)
                found.append((counts.astype(np.int64), base, tables))
            n, base, tables = (np.concatenate(x) for x in zip(*found))
            yield from _messages(WORDS, [part], [pack(n, base, tables)], sums=(n.sum(), base[n > 0].sum(dtype=float), tables.sum() / DRAWS)).to_batches()

    return run


def _word_prices(words: DataFrame, model, tables: float) -> tuple:
    """A round of spelling model and word seating over words with their customers: the model, its tables, the words seated, and what prices follow from besides."""
    spark, words = words.sparkSession, words.select("part", "blob")
    found = words.mapInArrow(_seated(model, tables), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas().sort_values("cell")
    cells, customers = found["cell"].to_numpy(np.int64), found["n"].to_numpy(np.int64)
    tables = float(customers[cells < 0].sum())
    model = spark.sparkContext.broadcast(Spelling.fit(spark, cells[cells >= 0], customers[cells >= 0]))
    seated = saved(words.mapInArrow(_last_seating(model, tables), _MESSAGE), "seated")
    # The tables of this very seating: what they discount from all words is what the base shares out, so it sums to 1.
    customers, spelled, opened = seated.agg(*[F.coalesce(F.sum(c), F.lit(0.0)) for c in "xyz"]).first()
    free, total = WORD_STRENGTH + WORD_DISCOUNT * opened, WORD_STRENGTH + customers
    return model, tables, seated, (free, free * max(1 - spelled, 1e-12) / total, total)


def _scores(train_tokens: int, distinct: int, end_count: int, end: float):
    """end: the probability that a text ends before a word."""

    def base(counts):
        return np.log10((counts + 0.5) / (train_tokens + 0.5 * (distinct + 1)))

    def score(key, docs, answers):
        mark, ids, null, held, sizes, at = unpack(docs.column("blob")[0].as_py(), *_TEXTS)
        blobs = answers.sort_by("part").column("blob").to_pylist()
        marks, counts, price, opened, last, left = (np.concatenate(x) for x in zip(*(unpack(b, *_ANSWER) for b in blobs)))
        own, n = _Pairs(at, sizes, len(counts)), len(ids)
        if docs.num_rows != 1 or marks.sum() != mark[0] or len(left) != len(own.word):
            raise ValueError("the documents changed between two scans: pass a stored table")
        free, whole = CONTEXT_STRENGTH + CONTEXT_DISCOUNT / DRAWS * opened, CONTEXT_STRENGTH + counts - last
        logs = np.log10((1 - end) * (left + free[own.before] * price[own.word]) / whole[own.before])
        out = {"n_tokens": sizes + 1, "n_known": np.full(n, int(end_count > 0)), "base_score": np.full(n, float(base(end_count))), "score": np.full(n, float(np.log10(end)))}
        owner = np.repeat(np.arange(n), sizes)
        for name, values in (("n_known", (counts > 0)[at]), ("base_score", base(counts)[at]), ("score", logs[own.at])):
            out[name] += np.bincount(owner, values, minlength=n).astype(out[name].dtype)
        return pa.table({"doc_id": pa.array(ids, mask=null > 0), "held_out": held > 0, **out, "n_tokens": out["n_tokens"].astype(np.int64)})

    return score


def _bucketed(df: DataFrame, parts: int) -> DataFrame:
    """``df`` written once by part and read back so that grouping by part needs no shuffle."""
    spark, name = df.sparkSession, f"asked_{uuid.uuid4().hex}"
    buckets = max(LEAST_PARTS, -(-parts // PARTS_A_BUCKET))
    writer = df.repartition(buckets, "part").write.bucketBy(buckets, "part").option("parquet.block.size", GROUP_BYTES)
    writer.option("path", shared_folder(spark, "asked")).saveAsTable(name)
    stored = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only the name: the files go when the session ends
    return stored


def _removed(df: DataFrame) -> None:
    """Delete the files of a saved table that is no longer read."""
    jvm, files = df.sparkSession._jvm, df.inputFiles()
    if files:
        folder = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def _collect_shuffles(spark) -> None:
    """Spark removes the files of a shuffle when its plan is collected as garbage; until then they stay beside the table written from them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def perplexity_scores(documents: DataFrame) -> DataFrame:
    """Score every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (both log10).

    Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end. Learned from are the texts not held out.

    * NULL and empty texts are one end. Repeated rows count and are scored each on their own; NULL ids are allowed.
    * Without training texts the counts are 0 and the model is its base. An empty table gives an empty result.
    * Texts are scanned twice and have to be the same both times (a stored table); a difference raises an error.
    * Only id and text are read.
    """
    spark = documents.sparkSession
    learned = F.when(~held_out("doc_id", FOLDS, HELD_OUT), 1)
    ends, size = documents.agg(F.count(learned), F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).cast("long")).first()
    parts = max(LEAST_PARTS, -(-size // PART_BYTES))
    docs = text_rows(documents).withColumn("held_out", held_out("doc_id", FOLDS, HELD_OUT))
    asked = _bucketed(docs.mapInArrow(_asked(parts), "part int, block long, blob binary"), parts)
    _collect_shuffles(spark)
    first = saved(asked.groupBy("part").applyInArrow(_first_seating(parts), _MESSAGE), "first")
    words = first.filter(F.col("kind") == WORDS)
    shape = words.agg(F.coalesce(F.sum("x"), F.lit(0)).cast("long"), F.coalesce(F.sum("y"), F.lit(0)).cast("long")).first()
    train_tokens, distinct = shape[0] + ends, shape[1] + (ends > 0)

    model, tables, seated, scale = _word_prices(words, None, float(shape[1]))
    restaurants = first.filter(F.col("kind") == CONTEXTS).groupBy("part").applyInArrow(_all_tables, _MESSAGE)
    second = saved(asked.groupBy("part").cogroup(seated.unionByName(restaurants).groupBy("part")).applyInArrow(_context_seating(parts, scale), _MESSAGE), "second")
    _, _, seated, scale = _word_prices(second.filter(F.col("kind") == WORDS), model, tables)
    _removed(first)
    sent = seated.unionByName(second.filter(F.col("kind") != WORDS))
    answers = asked.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(_answered(scale), "block long, part int, blob binary")
    _collect_shuffles(spark)
    end = (ends + WORD_STRENGTH * END_SHARE) / (train_tokens + WORD_STRENGTH)
    texts = docs.mapInArrow(_texts, "block long, blob binary")
    scored = texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        _scores(train_tokens, distinct, ends, end), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
