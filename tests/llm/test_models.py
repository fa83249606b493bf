"""Scores against counts by hand, and classifiers on separable texts."""

import math
import random
import tracemalloc
import zlib
from collections import Counter
from types import SimpleNamespace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from windvane.llm import lm_score, quality, toxicity

TEXTS = {i: ("bad stupid words " if i % 4 == 0 else "kind plain words ") * 6 + f"filler{i % 7} end" for i in range(160)}


def _tables(spark):
    docs = spark.createDataFrame([*TEXTS.items(), (500, None), (501, ""), (None, "Kind words")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0), int(i % 4 == 0)) for i in TEXTS] + [(None, 1, 1), (500, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def _remainder(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


def test_base_score_and_counts(spark):
    docs, _ = _tables(spark)
    words = {r["doc_id"]: [*(r["text"] or "").lower().split(), None] for r in docs.collect()}
    counts = Counter(w for i, ws in words.items() if _remainder(i, 5) != 1 for w in ws)
    total, kinds = sum(counts.values()), len(counts)
    rows = lm_score.perplexity_scores(docs).collect()
    assert len(rows) == len(words)
    for r in rows:
        own = words[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(w in counts for w in own), total)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own), rel_tol=1e-9)
        assert r["score"] < 0 and r["held_out"] == (_remainder(r["doc_id"], 5) == 1)


def test_classifiers(spark):
    docs, labels = _tables(spark)
    for function in (quality.quality_scores, toxicity.toxicity_scores):
        rows = [r for r in function(docs, labels).collect()]
        assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
        held = [r for r in rows if r["held_out"] and r["doc_id"] in TEXTS]
        high = [r["score"] for r in held if r["doc_id"] % 4 == 0]
        low = [r["score"] for r in held if r["doc_id"] % 4]
        assert min(high) > max(low)
        assert function(docs.limit(0), labels.limit(0)).count() == 0


def _sample(spark, rows):
    sample = spark.createDataFrame(rows, "text string, label int, part int")
    pairs = toxicity.counted(sample)
    return toxicity.Sample(pairs, toxicity.packed_words(pairs))


def test_toxicity_keeps_rare_ngrams(spark):
    """Every word and bigram of the sample has an entry, also those seen once."""
    sample = _sample(spark, [("vile brute once", 1, 0), ("calm kind words", 0, 1)])
    model = sample.model(2)
    # Per stream six words, the start mark (shared by both), and six bigrams.
    assert (len(model.words), len(model.pairs)) == (13, 12)
    held = spark.createDataFrame([(1, "brute once"), (2, "kind words"), (3, "")], "doc_id long, text string")
    shared = spark.sparkContext.broadcast(sample)
    ratio = {r["doc_id"]: r["x0"] for r in toxicity._featured(held, "doc_id long", shared, 2).collect()}
    assert ratio[1] > 0 > ratio[2] and ratio[3] == 0


def test_kneser_ney_against_counts_by_hand(spark):
    """Probabilities of both classes from dictionaries; the models of the halves too."""
    rows = [("so bad so bad you fool", 1, 0), ("you fool, so it goes", 1, 1), ("it is so kind of you", 0, 0), ("so kind you fool nobody", 0, 1), ("kind kind words", 0, 0)]
    sample = _sample(spark, rows)
    asked = "so bad of you fool unseen words kind"
    for which, halves in enumerate(toxicity.MODELS):
        pairs = ({}, {})
        for text, label, part in rows:
            if part in halves:
                for stream in (lambda w: ("w", w), lambda w: ("s", w[:5])):
                    own = [stream(w) for w in "".join(c if c.isalnum() else " " for c in text).split()]
                    for u, w in zip(["start", *own], own):
                        pairs[label][u, w] = pairs[label].get((u, w), 0) + 1
        union = set(pairs[0]) | set(pairs[1])
        words = {w for _, w in union}
        ends = lambda of, w: sum(x == w for _, x in of)
        logs = []
        for c in (0, 1):
            part = len(pairs[c]) / len(union)
            mass = len(pairs[c]) + toxicity.SHARED * len(words) * part
            kinds = len({w for _, w in pairs[c]})

            def single(w):
                own = ends(pairs[c], w)
                return (max(own - 0.75, 0) + ends(union, w) * 0.75 * kinds / len(union) + toxicity.SHARED * part) / mass

            def after(u, w):
                m = [sum(n for (x, _), n in pairs[k].items() if x == u) for k in (0, 1)]
                total = m[c] + sum(m) * toxicity.SHARED * part + toxicity.STRENGTH * part
                back = sum(x == u for x, _ in pairs[c]) * 0.75 + toxicity.STRENGTH * part
                own, both = pairs[c].get((u, w), 0), sum(p.get((u, w), 0) for p in pairs)
                return (max(own - 0.75, 0) + toxicity.SHARED * part * both + back * single(w)) / total

            for u in ("start", ("w", "so"), ("s", "kind")):
                seen = sum(after(u, w) for w in words)
                assert math.isclose(seen + (1 - sum(map(single, words))) * (after(u, None) / single(None)), 1.0, rel_tol=1e-9)
            logs.append([math.log(after(u, w)) for stream in (lambda w: ("w", w), lambda w: ("s", w[:5])) for own in [[stream(w) for w in asked.split()]] for u, w in zip(["start", *own], own)])
        wanted = (sum(logs[1]) - sum(logs[0])) / len(asked.split())
        held = spark.createDataFrame([(1, asked)], "doc_id long, text string")
        got = toxicity._featured(held, "doc_id long", spark.sparkContext.broadcast(sample), which).first()["x0"]
        assert math.isclose(got, wanted, rel_tol=1e-4), which


def test_toxicity_with_one_class_and_repeated_texts(spark):
    docs = spark.createDataFrame([(i, "some words " * (40_000 if i == 3 else 1)) for i in (1, 2, 3, 3, None)] + [(9, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "doc_id long, toxic int")
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert len(rows) == 6 and all(r["score"] < 1e-9 and r["predicted"] == 0 for r in rows)
    both = toxicity.toxicity_scores(docs, labels.unionByName(spark.createDataFrame([(7, 1)], "doc_id long, toxic int"))).collect()
    assert len(both) == 6


def test_language_model_sums_to_one(spark):
    """All known words, the end, and the one type of unseen words have probability 1 together."""
    held = [i for i in range(100_000, 103_000) if _remainder(i, 5) == 1]
    known = sorted({w for i, t in TEXTS.items() if _remainder(i, 5) != 1 for w in t.split()})
    asked = dict(zip(held, ["", "neverseen", *known]))
    docs = spark.createDataFrame([*TEXTS.items(), *asked.items()], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in lm_score.perplexity_scores(docs).collect()}
    end = next(score[i] for i, w in asked.items() if not w)
    total = 10**end + sum(10 ** (score[i] - end) for i, w in asked.items() if w)
    assert math.isclose(total, 1.0, rel_tol=1e-5)


def test_language_model_reads_the_word_before(spark):
    """The words of the training texts in another order score lower, and what follows a word sums to one with the end."""
    held = [i for i in range(100_000, 103_000) if _remainder(i, 5) == 1]
    known = sorted({w for i, t in TEXTS.items() if _remainder(i, 5) != 1 for w in t.split()})
    asked = dict(zip(held, ["", "stupid", "bad stupid words bad", "bad words stupid bad", "stupid neverseen", *(f"stupid {w}" for w in known)]))
    docs = spark.createDataFrame([*TEXTS.items(), *asked.items()], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in lm_score.perplexity_scores(docs).collect()}
    score = {w: rows[i]["score"] for i, w in asked.items()}
    before, other = (next(rows[i] for i, w in asked.items() if w == t) for t in ("bad stupid words bad", "bad words stupid bad"))
    assert before["score"] > other["score"] + 1 and math.isclose(before["base_score"], other["base_score"])
    total = 10 ** score[""] + sum(10 ** (score[f"stupid {w}"] - score["stupid"]) for w in ["neverseen", *known])
    assert math.isclose(total, 1.0, rel_tol=1e-5)


def test_language_model_blocks_of_a_batch(monkeypatch):
    """Blocks number the rows of a scan in order, whole and alike in every scan, without a column handed from task to task."""
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 10)
    monkeypatch.setattr(lm_score, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 3)))
    texts = [["aaaa", None, "bbbb", "cccc", ""], [], ["d" * 35, "e", "f"]]
    batches = [pa.RecordBatch.from_pydict({"doc_id": list(range(len(t))), "text": pa.array(t, pa.string())}) for t in texts]
    found = [(block - (3 << 32), column.to_pylist(), rows.column(0).to_pylist()) for block, column, rows in lm_score._blocks(batches)]
    assert found == [(0, ["aaaa", "", "bbbb", "cccc"], [0, 1, 2, 3]), (1, [""], [4]), (2, ["d" * 35], [0]), (3, ["e", "f"], [1, 2])]


def test_language_model_takes_texts_to_python_once_a_scan(spark):
    """Two Python nodes above one another hold the texts of a task twice; spelling cells are not written to files."""
    docs, _ = _tables(spark)
    stored = []
    plan = lm_score.perplexity_scores(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1, plan
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lm_score, "saved", lambda df, name, save=lm_score.saved: stored.append(name) or save(df, name))
        lm_score.perplexity_scores(docs)
    assert stored == ["first", "seated", "second", "seated"]


def test_language_model_writes_fewer_files_than_parts(spark):
    """A bucket holds several parts, each whole in one file, and grouping by part still needs no shuffle."""
    parts = 10 * lm_score.LEAST_PARTS
    table = lm_score._bucketed(spark.range(4 * parts).select((F.col("id") % parts).cast("int").alias("part"), "id"), parts)
    rows = table.select("part", F.input_file_name().alias("file")).distinct().collect()
    assert len(rows) == parts and len({r["file"] for r in rows}) <= parts // lm_score.PARTS_A_BUCKET
    grouped = table.groupBy("part").count()
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString() and {r["count"] for r in grouped.collect()} == {4}


def _asked_of(monkeypatch, texts, held):
    monkeypatch.setattr(lm_score, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batches = [pa.RecordBatch.from_pydict({"text": t, "held_out": h}) for t, h in zip(texts, held)]
    return pa.Table.from_batches(lm_score._asked(1)(iter(batches)))


def test_language_model_adds_pairs_by_runs_of_blocks(monkeypatch):
    """Counts of a part against a dictionary, however few pairs are unpacked at once, and every block's own pairs among them."""
    draw = random.Random(5)
    texts = [[" ".join(draw.choices("abcdefgh", k=draw.randint(0, 9))) for _ in range(6)] for _ in range(7)]
    held = [[draw.random() < 0.3 for _ in t] for t in texts]
    asked, counts = _asked_of(monkeypatch, texts, held), Counter()
    for text, out in ((t, o) for b, h in zip(texts, held) for t, o in zip(b, h)):
        for pair in zip(["", *text.split()], text.split()):
            counts[pair] += not out
    for at_once in (1, 20, 1 << 20):
        monkeypatch.setattr(lm_score, "KEYS_AT_ONCE", at_once)
        own = lm_score._Merged(asked)
        size, data = own.spelled()
        named = [w.decode() for w in (data.tobytes()[e - n : e] for n, e in zip(size, size.cumsum()))]
        before = {int(h) >> 16: w for h, w in zip(own.words, named)}
        pairs = [(before[int(own.contexts[c])], named[w]) for w, c in zip(own.word, own.context)]
        assert dict(zip(pairs, own.pair_count.tolist())) == dict(counts)
        for block, at in zip(texts, own.pair_at(), strict=True):
            assert {pairs[i] for i in at} == {p for t in block for p in zip(["", *t.split()], t.split())}


def test_language_model_memory_follows_distinct_pairs(monkeypatch):
    """Pairs that come in every block, as those of a frequent word do, are held once."""
    draw, words = random.Random(7), [f"w{i}" for i in range(200)]
    asked = _asked_of(monkeypatch, [[" ".join(draw.choices(words, k=30_000))]], [[False]])
    monkeypatch.setattr(lm_score, "KEYS_AT_ONCE", 1 << 10, raising=False)

    def peak(blocks):
        table = pa.concat_tables([asked.set_column(1, "block", pa.array([i])) for i in range(blocks)])
        tracemalloc.start()
        lm_score._Merged(table)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(60) < 2 * peak(6)


def test_toxicity_of_texts_learned_from(spark):
    """A word says the same in a text that was learned from, whose bigrams were seen once, as in a new one."""
    sample = _sample(spark, [(f"left{i} brute right{i}", 1, i % 2) for i in range(20)] + [(f"left{i} kind right{i}", 0, i % 2) for i in range(20, 60)])
    asked = spark.createDataFrame([(1, "left3 brute right3"), (2, "new brute words"), (3, "left33 kind right33")], "doc_id long, text string")
    top = {r["doc_id"]: r["x2"] for r in toxicity._featured(asked, "doc_id long", spark.sparkContext.broadcast(sample), 2).collect()}
    assert top[1] > 0.9 * top[2] > 0 and top[3] < 0.5 * top[1]
