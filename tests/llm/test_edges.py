"""Every operator and stage on nulls, empty and long texts, repeated rows, clashing names, empty tables."""

import public_tokenizers
import pytest

import corpus_pipeline
from cytoweave.llm import decontaminate, html_text, language, license_scan, lines, packing, quality, simhash, substrings, token_files
from cytoweave.session import scratch_path

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")



def values(frame, column, doc_id):
    return [r[column] for r in frame.collect() if r["doc_id"] == doc_id]


@pytest.fixture
def benchmark(spark):
    rows = [(0, "says nothing new"), (1, None), (2, ""), (None, "twice the same row"), (3, "one plain text of some words that says nothing new and a second line follows"), (3, "absent words only")]
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_language(edges, empty):
    model = language.fit(edges)
    found = language.predict(edges, model)
    assert found.count() == edges.count()
    for doc_id in (2, 3, 7):
        assert values(found, "language", doc_id)[0]["lang_pred"] == "und"
    assert values(found, "language", 1)[0]["lang_pred"] == "en"
    assert language.predict(empty, language.fit(empty)).count() == 0
    assert values(language.predict(edges, language.fit(empty)), "language", 1)[0]["lang_pred"] == "und"


def test_lines(edges, empty):
    found = lines.deduplicate(edges)
    assert found.count() == edges.count() and sorted(found.columns) == sorted(edges.columns)
    assert values(found, "dropped_lines", 1) == [[]] and values(found, "dropped_lines", 8) == [[0, 1]]
    assert values(found, "text", 8) == [""] and values(found, "text", 2) == [None]
    assert values(found, "dropped_lines", 4) == [[], []]  # one document, given twice
    assert lines.deduplicate(empty).count() == 0


def test_simhash(edges, empty):
    found = simhash.groups(edges)
    assert found.count() == edges.count()
    assert values(found, "component_id", 8) == [1] and values(found, "component_id", 4) == [4, 4]
    assert {values(found, "component_id", d)[0] for d in (2, 3, 7)} == {2}  # no words: fingerprint zero, linked
    assert values(found, "fingerprint", 2) == [0]
    assert values(found, "component_id", None) == [None]
    assert simhash.groups(empty).count() == 0


def test_decontaminate(edges, empty, benchmark):
    found = decontaminate.mark(edges, benchmark)
    assert found.count() == edges.count()
    one = values(found, "hits", 1)[0]
    assert (one["n_words"], one["starts"], one["ends"], one["items"]) == (17, [0], [15], ["0", "3"])
    assert values(found, "hits", 4)[0]["items"] == [""]  # a null item id counts as the empty text
    assert values(found, "hits", 2)[0]["n_words"] == 0
    assert decontaminate.mark(empty, benchmark).count() == 0
    assert decontaminate.mark(edges, benchmark.limit(0)).where("size(hits.starts) > 0").count() == 0


def test_blocks_of_the_benchmark_change_nothing(edges, benchmark):
    whole = decontaminate.mark(edges.select("doc_id", "text"), benchmark)
    cut = decontaminate.mark(edges.select("doc_id", "text"), benchmark, block_words=8)
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))


def test_packing(edges, empty):
    packed = packing.pack(packing.pieces(edges, TOKENIZER))
    rows = packed.collect()
    assert {r["length"] for r in rows if r["doc_id"] in (2, 3, 7)} == {1}
    assert len([r for r in rows if r["doc_id"] == 5]) > 10 and max(r["length"] for r in rows) == 2048
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for items in held.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    whole = {r["sequence_id"]: len(r["ids"]) for r in packing.sequences(packed).collect()}
    assert whole == {s: sum(n for _, n in items) for s, items in held.items()}
    assert packing.pack(packing.pieces(empty, TOKENIZER)).count() == 0


def test_token_files(spark, edges, empty):
    path = scratch_path(spark, "tokens")
    token_files.write(edges, TOKENIZER, path)
    rows = sorted(token_files.read(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 4, 5, 6, 7, 8]
    at = 0
    for r in rows:
        assert r["start"] == at and len(r["ids"]) == r["n_tokens"] and r["ids"][-1] == 1
        at += r["n_tokens"]
    assert [r["doc_id"] for r in token_files.lookup(spark, path, [6, 99]).collect()] == [6]
    path = scratch_path(spark, "tokens")
    token_files.write(empty, TOKENIZER, path)
    assert token_files.read(spark, path).count() == 0


def test_token_files_are_pruned(spark, edges):
    path = scratch_path(spark, "tokens")
    token_files.write(edges, TOKENIZER, path)
    plan = token_files.lookup(spark, path, [6])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id, [6])" in plan or "EqualTo(doc_id,6)" in plan


def test_quality(edges, empty):
    found = quality.signals(edges)
    assert found.count() == edges.count()
    assert values(found, "signals", 2)[0]["n_words"] == 0 and values(found, "signals", 5)[0]["n_words"] == 60_000
    weights = quality.fit(found.select(quality.votes("signals").alias("votes")))
    assert 0 < weights.good < 1
    assert quality.fit(quality.signals(empty).select(quality.votes("signals").alias("votes"))).good == 0.5


def test_license(edges, empty):
    found = license_scan.scan(edges)
    assert found.count() == edges.count()
    assert values(found, "licenses", 2)[0]["n_words"] == 0
    assert license_scan.scan(empty).count() == 0


def test_substrings(edges, empty):
    found = substrings.deduplicate(edges, length=32, anchor=16)
    assert found.count() == edges.count()
    assert values(found, "deduplicated", 2)[0]["n_bytes"] == 0
    assert values(found, "deduplicated", 1)[0]["kept"] == values(found, "deduplicated", 8)[0]["kept"] == b""
    assert substrings.deduplicate(empty).count() == 0


def test_pages(spark):
    rows = [(1, None, None), (2, "http://a.b/x", ""), (3, "http://a.b/y", "<p>Some &amp; text"), (3, "http://a.b/y", "<p>Some &amp; text"), (None, "not a url", "<nav>x</nav>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'x' as text", "1 as _host", "2 as _rule", "3 as region")
    found = {(r["page_id"], r["html"]): r["text"] for r in html_text.extract(pages).collect()}
    assert found[1, None] == found[2, ""] == found[None, "<nav>x</nav>"] == ""
    assert found[3, "<p>Some &amp; text"] == "Some & text"
    assert html_text.extract(pages.limit(0)).count() == 0


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns(spark, small, edges, empty, stage):
    _, fn = corpus_pipeline.STAGES[stage]
    assert fn(spark, edges, small).columns == edges.columns
    assert fn(spark, empty, small).count() == 0


def test_stages_decide(spark, small, edges):
    ids = lambda frame: sorted((r["doc_id"] for r in frame.collect()), key=lambda x: (x is None, x))
    assert not {2, 3, 7} & set(ids(corpus_pipeline.known_language(spark, edges, small)))
    assert ids(corpus_pipeline.distinct_lines(spark, edges, small)) == [1, 2, 3, 4, 4, 5, 6, 7, None]
    assert ids(corpus_pipeline.one_of_near_duplicates(spark, edges, small)) == [1, 2, 4, 4, 5, 6, None]


def test_pipeline_drops_what_only_fingerprints_link(spark, small):
    phrase = "the very same words again " * 60
    tails = ["alpha beta gamma delta epsilon zeta eta theta", "one two three four five six seven eight"]
    rows = [(i, phrase + t) for i, t in enumerate(tails)] + [(2, "something else altogether, told at some length")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.one_of_near_duplicates(spark, docs, small).collect()) == [0, 2]
