"""Small cases with defined results: NULLs, empty and repeated rows, clashing columns, empty tables; brute force where SQL can't."""

import hashlib

import pytest

import corpus_pipeline
from windvane.llm import decontaminate, exact_dedup, language_id, line_dedup, minhash_dedup, mixing, warc

TEXTS = [
    (1, "the same text of ten words for all to see now"), (2, "The same text of ten words for all to see now"), (2, "The same text of ten words for all to see now"),
    (3, None), (4, ""), (None, "  \t "), (5, "the same text of ten\nwords for all to see now"), (6, "x" * 300_000 + " end"), (7, "un deux trois"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, key string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, ("en", "fr", None)[k % 3], ("a", None, "b")[k % 3], None, k, "k") for k, (i, t) in enumerate(TEXTS)], SCHEMA)


def test_exact_groups(docs):
    rows = exact_dedup.exact_groups(docs).collect()
    bare = [(t or "").translate({c: None for c in (32, *range(9, 14))}) for _, t in TEXTS]
    assert sorted(r["text_sha256"] for r in rows) == sorted(hashlib.sha256(b.encode()).hexdigest() for b in bare)
    assert sum(r["kept"] for r in rows) == len(set(bare))
    assert {r["keep_id"] for r in rows if r["doc_id"] == 4} == {None} and {r["group_size"] for r in rows if r["doc_id"] == 2} == {2}


def test_line_dedup(docs):
    rows = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs).collect()}
    assert len(rows) == 8 and rows[2]["n_dropped"] == 1 and rows[2]["kept_text"] == ""
    assert rows[1]["n_dropped"] == 0 and rows[3]["n_lines"] == 1 and rows[5]["n_lines"] == 2


def test_near_groups(docs):
    rows = minhash_dedup.near_groups(docs).collect()
    assert len(rows) == len(TEXTS)
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["component_id"] == 1 and by[5]["component_id"] == 1 and by[4]["component_id"] == 4 and by[4]["n_shingles"] == 0 and by[7]["n_shingles"] == 1


def test_language_and_mix(docs):
    rows = language_id.language_predictions(docs).collect()
    assert len(rows) == len(TEXTS) and {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, None)} == {"und"}
    rows = mixing.mixed_documents(docs).collect()
    assert len(rows) == len(TEXTS) and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - sum(r["size"] for r in rows)) <= 3


def test_decontaminate(spark, docs):
    words = [f"w{i}" for i in range(20)]
    changed = [*words]
    changed[4] = changed[11] = "other"
    leak = spark.createDataFrame([(50, "before " + " ".join(changed) + " after"), (51, " ".join(words[:6])), (None, None)], "doc_id long, text string")
    items = spark.createDataFrame([(9, " ".join(words).upper()), (8, "w1 w2"), (7, None)], "item_id long, text string")
    rows = decontaminate.contaminated(leak, items).collect()
    assert [(r["doc_id"], r["item_id"], r["doc_start"], r["n_equal"]) for r in rows] == [(50, 9, 1, 18)]
    assert decontaminate.contaminated(docs, items.limit(0)).count() == 0


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "http://b.a.com/x y", "é<p>"), (2, "https://a.com/", "é<p>"), (3, None, None), (None, "http://c.org", "z")], "page_id long, url string, html string")
    folder = warc.write_archives(pages)
    index = warc.CaptureIndex.build(warc.read_archives(spark, folder))
    hit = index.lookup("https://a.com/")[0]
    assert hit["record_type"] == "response" and warc.read_range(spark, hit["path"], hit["offset"], hit["length"])["payload"].decode() == "é<p>"
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in index.captures().collect()}
    assert kinds == {1: ("revisit", 2, 5), 2: ("response", None, 5), 3: ("response", None, 0), None: ("response", None, 1)}


def test_empty_tables(docs):
    none = docs.limit(0)
    for function in (exact_dedup.exact_groups, line_dedup.line_digests, minhash_dedup.near_groups, language_id.language_predictions, mixing.mixed_documents):
        assert function(none).count() == 0


def test_stage_columns(spark, docs):
    for name, function in corpus_pipeline.STAGES[:3]:
        assert function(spark, docs, "").columns == docs.columns, name
