"""Whole results: against brute force on what is asked for, not on how candidates are found."""

import numpy as np
import pyarrow as pa
import pytest

from cytoweave.llm import html_text, lines
from cytoweave.llm import queries as Q
from cytoweave.llm.lines import Lines, similar


def dropped(spark, rows):
    found = lines.deduplicate(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    return {r["doc_id"]: r["dropped_lines"] for r in found}


def test_op3_by_edit_similarity_alone(spark, small, texts):
    split = Lines(pa.array([t or "" for _, t in texts]))
    joined = sorted({t.decode() for t in split.texts(np.flatnonzero(split.n_words > 0))}, key=len)
    size = np.array([len(t) for t in joined])
    letters = np.array([np.bincount(np.frombuffer(t.encode("utf-32le"), np.uint32) % 64, minlength=64) for t in joined], dtype=np.int32)
    keys = [set(k.tolist()) for k in lines.meeting_keys([t.encode() for t in joined], size)]
    pairs = []
    for i, t in enumerate(joined):
        upto = int(np.searchsorted(size, len(t) / 0.8 + 1e-9, side="right"))
        # each edit changes the counts of two letters at most
        near = np.flatnonzero(np.abs(letters[i + 1 : upto] - letters[i]).sum(axis=1) <= 2 * (0.2 * size[i + 1 : upto] + 1e-9)) + i + 1
        pairs += [(i, int(j)) for j in near if similar(t, joined[j])]
    met = sum(bool(keys[i] & keys[j]) for i, j in pairs)
    worth = lines.sift([t.encode() for t in joined], 0.8)
    a, b = np.array(pairs).T
    sifted = worth(a, b, np.maximum(size[a], size[b]))
    print(f"recall {met}/{len(pairs)} of the keys, {sifted.sum()}/{len(pairs)} of the sieve")
    assert pairs and met >= 0.99 * len(pairs) and sifted.sum() >= 0.99 * len(pairs)
    near = {}
    for i, j in pairs:
        near.setdefault(i, set()).add(j)
        near.setdefault(j, set()).add(i)
    group = {}
    for i in range(len(joined)):
        todo = [i] if i not in group else []
        while todo:
            at = todo.pop()
            if at not in group:
                group[at] = i
                todo += near.get(at, ())
    number, seen, gone = {t: i for i, t in enumerate(joined)}, set(), {}
    for i, t in enumerate(split.texts(np.arange(len(split.row)))):
        if t:
            g = group[number[t.decode()]]
            if g in seen:
                gone.setdefault(texts[split.row[i]][0], []).append(int(split.line_no[i]))
            seen.add(g)
    got = {r["doc_id"]: r["dropped_lines"] for r in Q.QUERIES["op3_fuzzy_line_dedup"](spark, small).collect()}
    assert got == {d: ",".join(map(str, gone.get(d, []))) for d, _ in texts}


def test_short_and_unspaced_lines_take_part(spark):
    chinese = "本网站使用必要的技术来保存您的设置并统计访问次数请在继续之前阅读我们的说明"
    rows = [(1, f"Yes indeed\n{chinese}\n\n---"), (2, f"yes, indeed!\n{chinese[:10]}也{chinese[10:]}\n\n---"), (3, "Yes\nNo")]
    assert dropped(spark, rows) == {1: [], 2: [0, 1], 3: []}


def test_a_line_with_one_word_more_or_replaced_is_found(spark):
    words = "harbour engine yellow window market sailor thunder copper meadow lantern".split()
    other = [*words[:4], "rivers", *words[5:]]
    assert dropped(spark, [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join([*words[:6], "and", *words[6:]]))]) == {1: [], 2: [0], 3: [0]}


@pytest.mark.parametrize("tile", [4096, 3])
def test_tiles_change_nothing(spark, monkeypatch, tile):
    from cytoweave.llm import alike

    monkeypatch.setattr(lines, "links", lambda *a, **k: alike.links(*a, **k, tile=tile))
    rows = [(i, f"0 0 0 0 {10 + i}") for i in range(30)] + [(99, "something else with five words")]
    assert dropped(spark, rows) == {i: [0] if 0 < i < 99 else [] for i, _ in rows}


def test_pipeline_groups_by_shingles(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r["doc_id"]: frozenset(tuple(w[i : i + 5]) for w in [(r["text"] or "").encode().lower().split()] for i in range(max(len(w) - 4, min(len(w), 1)))) for r in docs.collect()}
    ids, holders, pairs = sorted(sets), {}, {}
    for i in ids:
        for s in sets[i]:
            holders.setdefault(s, []).append(i)
    for held in holders.values():
        for n, b in enumerate(held):
            for a in held[:n]:
                pairs[a, b] = pairs.get((a, b), 0) + 1
    pairs |= {(a, b): 0 for n, b in enumerate(ids) if not sets[b] for a in ids[:n] if not sets[a]}
    pairs = [(a, b) for (a, b), both in pairs.items() if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both) - 1e-9]
    assert sum(sets[a] != sets[b] for a, b in pairs) >= 12
    group = {i: i for i in ids}
    for _ in ids:
        before = dict(group)
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
        if group == before:
            break
    kept = corpus_pipeline.one_of_near_duplicates(spark, docs, "")
    assert sorted(r["doc_id"] for r in kept.collect()) == [i for i in ids if group[i] == i]


def page_texts(spark, pages):
    frame = spark.createDataFrame([(i, "http://a.b/x", h) for i, h in enumerate(pages)], "page_id bigint, url string, html string")
    return [r["text"] for r in sorted(html_text.extract(frame).collect(), key=lambda r: r["page_id"])]


BODY = "".join(f"<p>Sentence {{0}} of part {k} tells what has come to pass.</p>" for k in range(6))


@pytest.mark.parametrize("shape", ["<article><h1>Title {0}</h1><div>{1}</div></article>", "<div><h1>Title {0}</h1><div>{1}</div></div>", "<h1>Title {0}</h1><article><div>{1}</div></article>"])
def test_a_title_beside_the_body_stays(spark, shape):
    pages = [f"<body><nav>Home</nav>{shape.format(i, BODY.format(i))}<div>About us</div></body>" for i in range(5)]
    for i, text in enumerate(page_texts(spark, pages)):
        assert text.split("\n") == [f"Title {i}", *(f"Sentence {i} of part {k} tells what has come to pass." for k in range(6))]


@pytest.mark.parametrize("frame", ['<body class="has-sidebar">{}</body>', '<body><div id="page" class="with-nav">{}</div></body>', '<body><article class="post comments-open">{}</article></body>', '<body><div class="share-enabled"><article>{}</article></div></body>'])
def test_names_do_not_mark_the_frame(spark, frame):
    other = '<div class="sidebar">Other {0}</div><div class="comments">' + "<p>Reader {0} says a little.</p>" * 2 + "</div>"
    pages = [frame.format(f"<nav>Home</nav><h1>Title {i}</h1>{BODY.format(i)}{other.format(i)}") for i in range(4)]
    for i, text in enumerate(page_texts(spark, pages)):
        assert text.split("\n") == [f"Title {i}", *(f"Sentence {i} of part {k} tells what has come to pass." for k in range(6))]


def test_long_comments_stay_marked():
    page = "<body><article><p>Short text.</p></article><div class=comments>" + "<p>Many words of readers about it.</p>" * 9 + "</div></body>"
    assert html_text.main_text(page, None) == "Short text."
    assert html_text.main_text("<body><div class=share><p>All there is.</p></div></body>", None) == "All there is."


@pytest.mark.parametrize("tile", [4096, 3, 1])
def test_buckets_hold_every_pair_of_a_key(spark, tile):
    from cytoweave.llm import alike

    draw = np.random.default_rng(tile)
    things = [(h, int(draw.integers(1, 40)), sorted({int(k) for k in draw.integers(0, 12, 3)})) for h in range(60)]
    df = spark.createDataFrame(things * 2, "hash bigint, size int, keys array<bigint>")
    dealt = {}
    for r in alike.units(alike.buckets(df, 0.8, tile)).collect():
        dealt.setdefault((r["no"], r["key"], r["low"], r["high"]), []).append(r)
    assert all(len(rows) <= 2 * tile for rows in dealt.values())
    met = {tuple(sorted((x["hash"], y["hash"]))) for rows in dealt.values() for x in rows for y in rows if x["low"] == x["high"] or x["own"] != y["own"]}
    for a, size_a, keys_a in things:
        for b, size_b, keys_b in things:
            if a < b and set(keys_a) & set(keys_b) and abs(size_a - size_b) <= 0.2 * max(size_a, size_b) + 1e-9:
                assert (a, b) in met


def test_pair_counts_bound_the_edit_distance():
    draw = np.random.default_rng(7)
    texts = ["", "a", "a" * 700]
    for _ in range(60):
        text = list("".join(draw.choice(list("abc é中"), int(draw.integers(1, 300)))))
        texts.append("".join(text))
        for _ in range(int(draw.integers(1, 12))):
            at = int(draw.integers(0, len(text) + 1))
            text[at : at + int(draw.integers(0, 2))] = ["", "x", "中"][int(draw.integers(0, 3))]
        texts.append("".join(text))
    counts = lines.pair_counts([t.encode() for t in texts]).astype(int)
    for i in range(len(texts)):
        for j in range(max(0, i - 3), i):
            assert np.abs(counts[i] - counts[j]).sum() <= 4 * lines.edit_distance(texts[i], texts[j])
