"""Conversation repair against searches over all edits and all splits of spans, and on awkward tables."""

import hashlib
import heapq
import random
import zlib

import pytest

from windvane.llm import conversation_repair as repair

STEPS = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def cheapest(rows):
    """Least (cost, audit, repaired rows) by a shortest-path search; rows are (role, text, fault)."""
    queue = [(0, "", 0, "", ())]
    seen = set()
    while True:
        cost, audit, at, place, out = heapq.heappop(queue)
        if at == len(rows) and place in ("", "a"):
            return cost, audit, list(out)
        if (at, place) in seen:
            continue
        seen.add((at, place))
        for role in ("user", "assistant"):
            to = STEPS.get((place, role[0]))
            if to:
                heapq.heappush(queue, (cost + 3, audit + "I", at, to, (*out, (role, ""))))
        if at == len(rows):
            continue
        role, text, fault = rows[at]
        heapq.heappush(queue, (cost + 4, audit + "D", at + 1, place, out))
        if fault in ("", "truncated"):
            extra = 3 if fault else 0
            to = STEPS.get((place, role[:1]))
            if to:
                heapq.heappush(queue, (cost + extra, audit + "K", at + 1, to, (*out, (role, text))))
            for new in ("user", "assistant"):
                to = STEPS.get((place, new[0]))
                if to:
                    heapq.heappush(queue, (cost + 3 + extra, audit + "R", at + 1, to, (*out, (new, text))))


def expected(table):
    """The contract, one conversation after another; table rows are (conv_id, turn, role, text)."""
    blank_of = lambda x: " " if x is None else x
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            kind = zlib.crc32(f"{blank_of(conv)}:{blank_of(turn)}".encode()) % 20
            role, text = blank_of(role), blank_of(text)
            if kind == 1:
                text = ""
            if kind == 2:
                text = "".join(c for c in text if c not in ".!?")
            rows += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).digest()))
        seen, faults, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in rows:
            bare = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append((role, text, fault))
            if fault:
                counts[fault] += 1
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, mended = cheapest(faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in mended).encode()).hexdigest()
        out[conv] = (gaps, *counts.values(), illegal, cost, audit, digest)
    return out


def table(seed):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "", None, "tool", "umpire"]
    texts = ["Yes.", "No!", "", None, " \t\n", "half a sentence", "Why?  \n", "long " * 5000 + "end.", "Ünï.", "line\ntwo."]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 14)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(roles[: rng.choice([2, 9])]), rng.choice(texts)))
    return rows + rows[:40]  # repeated rows too


SCHEMA = "conv_id long, turn long, role string, text string, first string, copies string, part string, key string, kind string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", None, "z", "w") for r in rows], SCHEMA)


def digests(spark, rows):
    found = repair.repair_digests(repair.damaged(frame(spark, rows))).collect()
    assert len({r["conv_id"] for r in found}) == len(found)
    return {r["conv_id"]: tuple(r)[1:] for r in found}


@pytest.mark.parametrize("partitions", ["8", "41"])
def test_equals_search_over_all_edits(spark, partitions):
    rows = table(3)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", partitions == "8")
    try:
        assert digests(spark, rows) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_conversation_over_all_tasks(spark):
    """A third of all rows is one conversation, and half of it says the same."""
    rng = random.Random(8)
    rows = [(7, t, ("user", "assistant")[t % 2], "Same." if rng.random() < 0.5 else f"Line {t}{rng.choice('.!? ')}") for t in range(3000)]
    rows += [(c, t, ("user", "assistant")[t % 2], f"Text {t}.") for c in range(100, 1100) for t in range(4)]
    rows += [(7, 5, "user", "Again and again.")] * 500
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        assert digests(spark, rows) == expected(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_split_a_span_finds_the_least_of_all_splits():
    rng = random.Random(2)
    for n in range(1, 10):
        for _ in range(25):
            symbols = "".join(rng.choice("suauauxSUAX-") for _ in range(n))
            cells = {(i, i + 1): repair.terminal(symbols[i]) for i in range(n)}
            for length in range(2, n + 1):
                for i in range(n - length + 1):
                    splits = [repair.combined(cells[i, k], cells[k, i + length]) for k in range(i + 1, i + length)]
                    cells[i, i + length] = tuple(min((x for x in pair if x), default=None) for pair in zip(*splits))
            assert repair.cell_of(symbols) == cells[0, n]


def test_repaired_rows_are_what_the_digest_covers(spark):
    rows = repair.damaged(frame(spark, table(5)))
    whole = {}
    for r in sorted(repair.repaired_rows(rows).collect(), key=lambda r: r["place"]):
        whole.setdefault(r["conv_id"], []).append(r)
    found = {r["conv_id"]: r for r in repair.repair_digests(rows).collect()}
    for conv, r in found.items():
        mended = whole.get(conv, [])
        assert [x["place"] for x in mended] == list(range(len(mended)))
        assert "".join(x["edit"] for x in mended) == r["audit"].replace("D", "")
        assert hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in mended).encode()).hexdigest() == r["repaired_sha256"]


def test_empty_table(spark):
    assert digests(spark, []) == {}
