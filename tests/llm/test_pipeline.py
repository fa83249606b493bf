"""The pipeline against a brute-force version, and its stages on awkward tables."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from windvane.llm import decontaminate, exact_dedup, language_id, line_dedup, lm_score, minhash_dedup, mixing, quality, toxicity, warc

SPACE = " \t\n\x0b\x0c\r"
SYLLABLES = {"en": ["the", "ing", "er", "and", "th", "ough"], "fr": ["eau", "que", "oi", "les", "ez", "ille"], None: ["ing", "the", "and"]}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(2, 4))) for _ in range(n))


def corpus():
    """Documents of two languages with near copies, shared lines, leaks and rows without a letter; and benchmark items."""
    rng = random.Random(5)
    items = [(i, sentence(rng, "en", 30)) for i in range(6)] + [(None, None), (9, "too short")]
    shared = sentence(rng, "en", 9)
    docs = []
    for i in range(90):
        lang = "en" if i % 3 else "fr"
        docs.append([i, sentence(rng, lang, 40), lang, ("a", "b", "c", None)[i % 4]])
    for i in range(60, 75):  # near copies, some of them chains
        own = docs[i - 60 + (i % 3) * 7][1].split(" ")
        own[rng.randrange(40)] = "changed"
        docs[i][1] = " ".join(own)
    for i in (20, 33, 50):
        docs[i][1] += f"\n  {shared.upper()}\t\nlast line {i} of it"
    for i in (10, 40):
        passage = words(items[i % 6][1])[5:25]
        passage[7] = "other"
        docs[i][1] += " " + " ".join(passage)
    docs += [[100, None, "en", "a"], [101, "", "en", "a"], [102, "12 34 ... 56", None, "b"], [103, "plain the and thing words anding", None, None]]
    return [tuple(d) for d in docs], items


def without_repeated_lines(docs):
    def key(line):
        return line.strip(SPACE).translate({c: c + 32 for c in range(65, 91)})

    holders = {}
    for i, text in docs.items():
        for line in text.split("\n"):
            holders.setdefault(key(line), set()).add(i)
    keep = lambda i, line: len(key(line)) < 10 or i == min(holders[key(line)])
    return {i: "\n".join(line for line in text.split("\n") if keep(i, line)) for i, text in docs.items()}


def shingles(text):
    own = words(text)
    return {tuple(own[k : k + 5]) for k in range(max(1, len(own) - 4))} if own else set()


def components(docs):
    sets = {i: shingles(t) for i, t in docs.items()}
    least = {i: i for i in docs}
    changed = True
    while changed:
        changed = False
        for a in docs:
            for b in docs:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) and least[a] != least[b]:
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    return least


def leaks(text, items, window=13):
    own = words(text)
    for _, item in items:
        item = words(item)
        size = min(window, len(item))
        if size < 5:
            continue
        for i in range(len(own) - size + 1):
            for j in range(len(item) - size + 1):
                if 100 * sum(x == y for x, y in zip(own[i : i + size], item[j : j + size])) >= 75 * size:
                    return True
    return False


def targets(sizes):
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    open_, out, left = set(sizes), {}, sum(sizes.values())
    while open_:
        share = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not full:
            return out | share
        out |= {s: 3.0 * sizes[s] for s in full}
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


SCHEMA = "doc_id long, text string, lang string, source string"


def test_pipeline_equals_brute_force(spark, tmp_path):
    docs, items = corpus()
    spark.createDataFrame(docs, SCHEMA).withColumn("n_chars", F.length("text").cast("long")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = {i: text for i, text, _, _ in docs if text and re.search("[a-z]", text)}
    kept = without_repeated_lines(kept)
    near = components(kept)
    assert sum(i != k for i, k in near.items()) >= 10
    kept = {i: text for i, text in kept.items() if near[i] == i}
    clean = {i: text for i, text in kept.items() if not leaks(text, items)}
    assert set(kept) - set(clean) == {10, 40}
    source = {i: s for i, _, _, s in docs}
    sizes = {i: len(words(t)) for i, t in clean.items()}
    of_source = Counter()
    for i, n in sizes.items():
        of_source[source[i]] += n
    wanted = targets(of_source)
    rows = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(rows) == set(clean)
    taken = Counter()
    for i, r in rows.items():
        assert (r["size"], r["source_size"]) == (sizes[i], of_source[source[i]]) and abs(r["target"] - wanted[source[i]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source[i]] += r["taken"]
    assert all(abs(taken[s] - wanted[s]) <= 1 for s in wanted)


# Names that operators use inside.
CLASHING = [
    "mark", "size", "_id", "_mark", "_size", "row", "leaf", "digest", "signature", "cid", "comp", "key", "place", "pos", "line", "batch", "label",
    "part", "lang_pred", "held_out", "score", "item", "item_id", "seed", "base", "weight", "target", "taken", "kept", "n_dropped", "kept_text", "count", "drops",
]


@pytest.fixture(scope="module")
def awkward(spark):
    """NULLs in every column, repeated rows, ties, empty and long texts, columns with clashing names."""
    same = "one text of more than ten words which is there again and again"
    rows = [(1, same, "en", "a"), (1, same, "en", "a"), (2, same, None, None), (None, same, "en", None), (None, None, None, None), (3, "", "en", "b"),
            (4, "word " * 60_000, "en", "a"), (4, "another text under the same number as the one before", "en", "a"), (5, "\n\n \n", "en", "a")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.lit(None).cast("long"))
    return df.withColumns({c: F.when(F.col("doc_id") == 1, F.lit(c)) for c in CLASHING})


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("bench")
    item = "one text of more than ten words which is there only once but in a benchmark"
    spark.createDataFrame([(1, item), (1, item), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_stages_on_awkward_tables(spark, awkward, folder):
    counts = {}
    for name, function in corpus_pipeline.STAGES[:-1]:
        out = function(spark, awkward, folder)
        assert out.columns == awkward.columns, name
        rows = out.collect()
        counts[name] = len(rows)
        assert all(r[c] in (None, c) for r in rows for c in CLASHING), name
        assert function(spark, awkward.limit(0), folder).count() == 0
    # Without a letter: three rows. Copies of one text: the row of the smallest id stays, once. Leaks: all four copies.
    assert counts == {"language_id": 6, "line_dedup": 9, "minhash_dedup": 6, "decontaminate": 5}
    mixed = corpus_pipeline.mix_sources(spark, awkward, folder)
    assert mixed.columns == ["doc_id", "size", "source_size", "target", "taken"] and mixed.count() == 9
    assert corpus_pipeline.mix_sources(spark, awkward.limit(0), folder).count() == 0


def test_operators_on_awkward_tables(spark, awkward):
    labels = awkward.selectExpr("doc_id", "int(doc_id % 2) AS quality", "int(doc_id % 2) AS toxic", "mark", "score")
    pages = awkward.selectExpr("doc_id AS page_id", "'http://a.b/' || doc_id AS url", "text AS html", *CLASHING[:12])
    calls = {
        "exact": lambda d: exact_dedup.exact_groups(d), "language": lambda d: language_id.language_predictions(d), "mix": lambda d: mixing.mixed_documents(d),
        "near": lambda d: minhash_dedup.near_groups(d), "lines": lambda d: line_dedup.line_digests(d), "lm": lambda d: lm_score.perplexity_scores(d),
        "quality": lambda d: quality.quality_scores(d, labels), "toxic": lambda d: toxicity.toxicity_scores(d, labels),
    }
    for name, call in calls.items():
        assert call(awkward).count() == 9, name
        assert call(awkward.limit(0)).count() == 0, name
    assert warc.archived(pages).count() == 9 and warc.archived(pages.limit(0)).count() == 0
    assert decontaminate.contaminated(awkward, awkward.drop("item_id").withColumnRenamed("doc_id", "item_id").limit(0)).count() == 0


def test_near_groups_equal_brute_force(spark):
    """Random families of texts around the threshold, chains included."""
    rng = random.Random(11)
    docs, vocabulary = {}, [f"w{i}" for i in range(400)]
    for family in range(12):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(4, 70))]
        for _ in range(rng.randint(1, 9)):
            docs[len(docs)] = " ".join(text)
            text = list(text)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
    expected = components(docs)
    rows = minhash_dedup.near_groups(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == expected
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {i: len(shingles(t)) for i, t in docs.items()}


def test_near_pair_whose_keys_have_other_leaders(spark):
    """Two near copies; each key they share is led by a third text that holds just the two passages behind it."""
    import numpy as np
    import pyarrow as pa

    from windvane.llm.minhash_dedup import _ADD, _KEPT, _MULTIPLY, _SIZE, CHUNKS, POSITIONS
    from windvane.llm.shingles import shingle_sets

    def minima(text):
        own = text.split(" ")
        passages = [" ".join(own[k : k + 5]) for k in range(len(own) - 4)]
        values = np.concatenate(list(shingle_sets(pa.array(passages))))
        return [passages[int(np.argmin(values * _MULTIPLY[i] + _ADD[i]))] for i in range(POSITIONS)]

    a = [f"v{i}" for i in range(240)]
    b = [*a]
    for k in (40, 120, 200):
        b[k] = "other"
    a, b = " ".join(a), " ".join(b)
    of_a, of_b = minima(a), minima(b)
    same = {i for i in range(POSITIONS) if of_a[i] == of_b[i]}
    keys = [[chunk * _SIZE + i for i in kept] for chunk in range(CHUNKS) for kept in _KEPT]
    leaders = []
    for i, j in (key for key in keys if set(key) <= same):
        tried = (f"{of_a[i]} x{n} {of_a[j]}" for n in range(100))
        leaders.append(next(t for t in tried if all(x == y for x, y in zip(*([minima(s)[k] for k in (i, j)] for s in (t, a))))))
    rows = len(leaders) + 2
    last = [r["id"] for r in spark.range(rows).orderBy(F.xxhash64("id").desc()).limit(2).collect()]
    texts = iter(leaders)
    docs = [(i, {last[0]: a, last[1]: b}.get(i) or next(texts)) for i in range(rows)]
    expected = components(dict(docs))
    assert expected[last[0]] == expected[last[1]] == min(last)
    found = minhash_dedup.near_groups(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == expected


PASSAGE = "a passage of some twenty words that two documents share but for one of them at its very end where they do differ"


def near_copies(spark, ids):
    texts = [f"{PASSAGE} {PASSAGE} so {word}" for word in ("one", "two", "three", "four")]
    rows = [(i, t, "en", "a") for i, t in zip(ids, texts)]
    return spark.createDataFrame([*rows, (50, "something else that has nothing to do with any of the others here", "en", "a")], SCHEMA).withColumn("n_chars", F.lit(1).cast("long"))


@pytest.mark.parametrize("ids", [(None, None, None, None), (7, 7, 7, 7), (3, None, 2, 2), (1, 2, 3, 4)])
def test_one_near_copy_stays_whatever_the_ids(spark, folder, ids):
    docs = near_copies(spark, ids)
    kept = corpus_pipeline.drop_near_copies(spark, docs, folder).collect()
    assert len(kept) == 2 and sum(r["doc_id"] == 50 for r in kept) == 1
    known = [i for i in ids if i is not None]
    assert (min(known) if known else None) in [r["doc_id"] for r in kept]
    again = corpus_pipeline.drop_near_copies(spark, docs.repartition(3), folder).collect()
    assert {(r["doc_id"], r["text"]) for r in again} == {(r["doc_id"], r["text"]) for r in kept}


def test_language_stage_keeps_all_if_nothing_is_learned(spark, folder):
    rows = [(i, f"text number {i}", None, "a") for i in range(20)] + [(30, "12 ...", None, "a"), (31, None, None, "a")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.lit(1).cast("long"))
    out = corpus_pipeline.identify_language(spark, docs, folder)
    assert {r["doc_id"] for r in out.collect()} == set(range(20)) and out.filter("lang IS NOT NULL").count() == 0


def test_short_items_with_every_allowed_substitution(spark):
    """Items of 5 to 13 words: all choices of substituted words that leave 75 % are found, one more is not."""
    from itertools import combinations

    items, docs, wanted = [], [], set()
    for n in range(5, 14):
        words_ = [f"item{n}word{k}" for k in range(n)]
        items.append((n, " ".join(words_)))
        allowed = n - -(-75 * n // 100)
        for k in (allowed, allowed + 1):
            for places in combinations(range(n), k):
                doc = len(docs)
                docs.append((doc, " ".join(["before", *[f"x{i}" if i in places else w for i, w in enumerate(words_)], "after"])))
                if k == allowed:
                    wanted.add((doc, n))
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == wanted
