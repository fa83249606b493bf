"""Spelling variants against comparisons of all words, and on awkward tables."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from windvane.llm import spelling_variants as variants

SCHEMA = "doc_id long, text string, word string, n string, size string, form string, root string"


def expected(docs):
    total = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            total[word] += 1
    words = {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w, n in words.items():
        around = sorted((-words[x], x) for x in words if near(w, x))
        form[w] = around[0][1] if around and -around[0][0] >= 2 * n else None
        out[w] = [form[w], n, len(around), words.get(form[w])]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w].insert(1, root)
    return {w: tuple(x) for w, x in out.items()}


def found(spark, docs):
    frame = spark.createDataFrame([(*d, "x", None, "y", "z", "w") for d in docs], SCHEMA)
    rows = variants.variant_forms(frame).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: tuple(r)[1:] for r in rows}


def corpus():
    rng = random.Random(4)
    stems = ["colour", "Organise", "weather", "Étudiant", "étudiant", "naïveté", "aaaaa", "committee", "straße", "×÷×÷×", "piñatas"]
    docs = []
    for i in range(300):
        out = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(stems)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abxeéÿ") + w[at:], w[:at] + rng.choice("oruüÀ") + w[at + 1 :]])
            out.append(w)
        docs.append((rng.choice([i, i, i, 5, None]), rng.choice([" ", ",", "1", "\n"]).join(out)))
    docs += [(900, None), (901, ""), (902, "abcd " * 10), (903, "weather " * 30_000), (None, "weathers weathers weathers")]
    # Three words of equal frequency beside a rarer one, and a chain of forms.
    for word, n in {"tieda": 5, "tiedb": 5, "tiedc": 5, "tiedz": 2, "chainaaaa": 3, "chainaaab": 7, "chainaabb": 15, "chainabbb": 40, "chainbbbb": 100}.items():
        docs += [(2000 + len(word), word + ".")] * n
    return docs + docs[:20]


@pytest.mark.parametrize("bits", ["full", "few"])
def test_equals_comparison_of_all_words(spark, monkeypatch, bits):
    if bits == "few":  # filters that let nearly everything pass: the join is exact all the same
        monkeypatch.setattr(variants, "MAX_BLOCKS", 4)
    docs = corpus()
    want = expected(docs)
    assert found(spark, docs) == want
    assert max(x[3] for x in want.values()) >= 3 and sum(x[0] is not None for x in want.values()) > 20
    assert any(w != x[0] and x[0] and x[1] != x[0] for w, x in want.items())


def test_edits_hash_like_the_words_they_give():
    words = ["colour", "straße", "aabbcc"]
    alphabet = np.array(sorted({ord(c) for w in words for c in w} | {ord("z")}), np.uint32)
    every = {6: np.full(1, 2**64 - 1, np.uint64), 5: np.full(1, 2**64 - 1, np.uint64)}
    edits = list(variants._edits(words, 6, alphabet, every.get))
    shorter = {(r, w) for r, w in edits if len(w) == 5}
    assert shorter == {(r, w[:i] + w[i + 1 :]) for r, w in enumerate(words) for i in range(6)}
    assert len(edits) == len(set(edits))
    for length in (5, 6):
        of = [w for _, w in edits if len(w) == length]
        bloom = np.zeros(64 * len(of), np.uint64)
        block, bits = variants._places(variants.hashes_of(of, length), len(bloom))
        np.bitwise_or.at(bloom, block.astype(int), bits)
        again = {w for _, w in variants._edits(words, 6, alphabet, {length: bloom}.get)}
        assert set(of) <= again


def test_empty_table_and_texts_without_words(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, None), (2, ""), (3, "one two six"), (4, "ÖÖ")]) == {}
