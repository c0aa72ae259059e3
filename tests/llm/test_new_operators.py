"""Fill-in-middle, source audit and near-duplicate vectors: brute force, round trips, edge cases."""

import hashlib
from collections import Counter, defaultdict
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cytoweave.llm import fill_middle, near_vectors, perfect_hash, source_audit
from cytoweave.llm import queries as Q

sha = lambda text: hashlib.sha256((text or "").encode()).hexdigest()


def test_op11_restores_every_text(spark, small, texts):
    found = {r["doc_id"]: r for r in Q.QUERIES["op11_fill_middle"](spark, small).collect()}
    assert len(found) == len(texts) and {r["form"] for r in found.values()} == {"plain", "psm", "spm"}
    for doc_id, text in texts:
        got = found[doc_id]
        form, a, b = fill_middle.plan(doc_id, text)
        whole = "".join(s + c for s, c in fill_middle.parts(text, form, a, b))
        assert (got["n"], got["form"], got["output_sha256"], got["restored_sha256"]) == (len(text), form, sha(whole), sha(text))
        assert (got["prefix_chars"], got["middle_chars"]) == ((None, None) if form == "plain" else (a, b - a))


def test_fill_middle_edges(spark, edges, empty):
    found = fill_middle.transform(edges, chunk=7, partitions=3)
    assert found.columns == [c for c in edges.columns if c != "text"] + ["fim"]
    rows = found.collect()
    texts = [(r["doc_id"], r["text"] or "") for r in edges.collect()]
    assert sorted((str(r["doc_id"]), r["fim"]["restored_sha256"]) for r in rows) == sorted((str(d), sha(t)) for d, t in texts)
    for r in rows:
        assert sha(r["fim"]["output"]) == r["fim"]["output_sha256"] and r["key"] == "x"
    assert {r["fim"]["form"] for r in rows if r["doc_id"] in (2, 3)} == {"plain"}
    assert fill_middle.transform(empty).count() == 0


def test_fill_middle_rows_that_share_an_id(spark):
    rows = [(1, "one text"), (1, "another text"), (1, "one text"), (None, "a"), (None, "b"), (7, "holds <S> itself")] + [(9, "many copies of one row")] * 500
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = fill_middle.transform(docs, chunk=3, partitions=5).collect()
    assert Counter((r["doc_id"], r["fim"]["restored_sha256"]) for r in found) == Counter((d, sha(t)) for d, t in rows)
    assert [r["fim"]["form"] for r in found if r["doc_id"] == 7] == ["plain"]


@settings(max_examples=60, deadline=None)
@given(st.text("<>PSM abé\U0001f642"), st.integers(0, 1000), st.integers(1, 5))
def test_outputs_parse_back(text, doc_id, chunk):
    """Texts full of halves of sentinels: what the parser finds is what was put in, whatever the pieces are."""
    form, a, b = fill_middle.plan(doc_id, text, plain_share=0, spm_share=50)
    output = "".join(s + c for s, c in fill_middle.parts(text, form, a, b)).encode()
    parser, found = fill_middle.Parser(form), []
    for i in range(0, len(output), chunk):
        found += parser.feed(output[i : i + chunk])
    found += parser.close()
    assert b"".join(data for _, data in sorted(found)).decode() == text


def audit_by_hand(rows, least, smoothing=5, top=50):
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", term.findall((text or "").translate(lower))) for lang, source, text in rows]
    df, counts, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, words in docs:
        df[lang].update(set(words))
        counts[lang, source].update(words)
        counts[lang, None].update(words)
        sources[lang].add(source)
    out = set()
    for lang, names in sources.items():
        kept = sorted(w for w, n in df[lang].items() if n >= least)

        def shares(source):
            n = [counts[lang, source][w] for w in kept]
            return [1 + 10**9 * (c + smoothing) // (sum(n) + smoothing * len(kept)) for c in n]

        q = shares(None)
        for s in names:
            p = shares(s)
            pairs = sorted(((-sum(abs(x - y) for x, y in zip(p, shares(o))), o.encode(), o) for o in names if o != s))
            terms = sorted((y - x, w.encode(), w) for w, x, y in zip(kept, p, q) if x > y and counts[lang, s][w])[:top]
            out |= {(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(pairs, 1)}
            out |= {(lang, s, "term", w, -v, i) for i, (v, _, w) in enumerate(terms, 1)}
    return out


def hand_rows(seed=3):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)] + ["été", "straße", "中文", "Ab", "ab"]
    rows = [(lang, f"s{rng.integers(7)}", " ".join(rng.choice(vocabulary, size=rng.integers(1, 120)))) for lang in ("en", "de", None) for _ in range(40)]
    return rows + [("en", "only_empty", ""), ("en", None, None), (None, None, "a b c"), ("xx", "lone", "nothing kept here"), ("xx", "other", "")] + [("en", "s1", "one hot row wab wac")] * 60


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_source_audit_by_hand(spark, monkeypatch, block_bytes):
    """Shards of few keys, blocks of few shards, tiles of two sources, counters that are let go of: nothing changes."""
    monkeypatch.setattr(source_audit, "KEYS_PER_SHARD", 40)
    monkeypatch.setattr(source_audit, "SOURCES_PER_TILE", 2)
    rows = hand_rows()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").selectExpr("*", "1 as term", "2 as shard", "3 as n").repartition(3)
    if block_bytes == 1:
        block_bytes = 3000
    found = source_audit.audit(docs, least=10, block_bytes=block_bytes)
    assert {tuple(r) for r in found.collect()} == audit_by_hand(rows, 10)


def test_source_audit_empty(spark, empty, edges):
    assert source_audit.audit(empty).count() == 0
    assert source_audit.audit(edges, least=2).where("part = 'pair'").count() == 0  # one source


def test_perfect_hashes_are_minimal_and_verified():
    keys = [f"key {i}".encode() for i in range(5000)]
    displacement, slot = perfect_hash.build(keys)
    assert sorted(slot.tolist()) == list(range(5000)) and len(displacement) == 2501
    for n in (1, 2, 3, 7):
        assert sorted(perfect_hash.build(keys[:n])[1].tolist()) == list(range(n))


def links_by_hand(rows, threshold=0.93):
    def unit(v):
        if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            return None
        return np.array(v) / np.linalg.norm(v)

    units = [unit(v) for _, v, _ in rows]
    n = len(rows)
    links = [set() for _ in rows]
    for i in range(n):
        for j in range(i):
            if rows[i][2] is not None and rows[i][2] == rows[j][2] and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        low = min(ids) if ids else None
        out.append((rows[i][0], len(links[i]), low, rows[i][0] == low))
    return sorted(out, key=repr)


def dense_rows(d=16, seed=5):
    """Two dense groups, one wide enough that not all of its members link, lone pairs at the threshold, single vectors, copies."""
    rng = np.random.default_rng(seed)
    vectors = []
    for size, noise in ((150, 0.03), (120, 0.11)):
        c = rng.standard_normal(d)
        vectors += [c / np.linalg.norm(c) + noise * rng.standard_normal(d) for _ in range(size)]
    for _ in range(60):
        a = rng.standard_normal(d)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(d)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        cos = rng.uniform(0.93, 0.96)
        vectors += [a, 3 * (cos * a + np.sqrt(1 - cos * cos) * b)]
    vectors += list(rng.standard_normal((150, d))) + [vectors[0]] * 40
    rows = [(int(i), [float(x) for x in v], int(i) % 2 if i >= 400 else 0) for i, v in enumerate(vectors)]
    odd = [(9001, None, 0), (9002, [], 0), (9003, [0.0] * d, 0), (9004, [None] + [1.0] * (d - 1), 0), (9005, [float("nan")] * d, 0), (9006, [float("inf")] + [1.0] * (d - 1), 0), (9007, rows[0][1], None), (None, rows[0][1], 0), (None, [1.0, 0.0], 7), (9008, [1.0, 0.001], 7), (5, [0.0, 1.0], 7), (5, [1.0, 1.0], 7), (9009, [1.0, 0.0, 0.0], 7)]
    return rows + odd


def test_near_vectors_by_hand(spark):
    rows = dense_rows()
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").selectExpr("*", "'x' as node", "1 as _g", "2 as grp", "3 as n_links", "4 as vec", "5 as low").repartition(5)
    want = links_by_hand(rows)
    for window, partitions in ((32, 9), (512, 2)):
        found = near_vectors.near_duplicates(frame, window=window, partitions=partitions)
        assert found.columns == ["vec_id", "embedding", "label", "node", "_g", "grp", "vec", "low", "n_links", "component_id", "kept"]
        got = sorted((tuple(r) for r in found.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)
        assert got == want, (window, partitions)


def test_near_vectors_tiles_and_packs(spark):
    """Small tiles and packs: whole tiles are settled by their summaries, open ones are compared, the counts stay."""
    rows = [r for r in dense_rows() if r[0] is not None and r[0] < 9000]
    units = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows[:270]}
    frame = spark.createDataFrame([((0, 0), (i, 0), 1 + i % 3, u.tolist()) for i, u in units.items()], "component struct<id:bigint,h:bigint>, node struct<id:bigint,h:bigint>, copies bigint, vec array<double>")
    dealt = near_vectors.deal_tiles(frame.select("node", "component"), rows_per_tile=8)
    found = near_vectors.count_links(dealt.join(frame.drop("component"), "node"), 0.93, tiles_per_pack=4)
    got = {r["node"]["id"]: r["n"] for r in found.collect()}
    assert got == {i: sum(1 + j % 3 for j, v in units.items() if u @ v >= 0.93) for i, u in units.items()}


def test_near_vectors_empty(spark):
    frame = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert near_vectors.near_duplicates(frame).count() == 0


def test_passes_follow_the_rows():
    few, many = near_vectors.passes_for(5_000, 0.93, 512, 0.999), near_vectors.passes_for(50_000_000, 0.93, 512, 0.999)
    assert 1 < few < many < 100
