"""The numbered queries: thin digests of the operators' real outputs."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, scratch_path
from . import decontaminate, fill_middle, html_text, language, license_scan, lines, near_vectors, packing, quality, simhash, source_audit, substrings, token_files
from .common import held_out, read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = "word_bpe_49k.json"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def tokenizer_path() -> str:
    return public_tokenizers.path(TOKENIZER)


@F.arrow_udf(T.LongType())
def ids_crc32(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    for lists in batches:
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4")
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        yield pa.array([zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], pa.int64())


OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS k FROM d, unnest(range(0, n - 199)) AS r(i)),
hit AS (SELECT doc_id, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
cut AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS c FROM hit),
num AS (SELECT doc_id, i, sum(c) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM cut),
span AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM num GROUP BY doc_id, g),
gap AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM span
        UNION ALL SELECT doc_id, max(b), NULL FROM span GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, n) - a)), '' ORDER BY a) AS t FROM gap JOIN d USING (doc_id) GROUP BY doc_id),
per AS (SELECT doc_id, sum(b - a)::BIGINT AS r, count(*) AS s FROM span GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(r, 0) AS n_removed, coalesce(s, 0) AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN kept USING (doc_id)"""
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP10_SQL = f"""
WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, w[i + 1 : i + 13] AS k, len(w[i + 1 : i + 13]) AS m FROM b, unnest(range(0, greatest(len(w) - 12, least(len(w), 1)))) AS r(i)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, i, m, w[i + 1 : i + m] AS k FROM d, (SELECT DISTINCT m FROM bw) AS s(m), unnest(range(0, len(w) - m + 1)) AS r(i)),
hit AS (SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.k = bw.k),
word AS (SELECT DISTINCT doc_id, i + j AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit), unnest(range(0, m)) AS r(j)),
per AS (SELECT doc_id, count(*) AS n FROM word GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS t FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(per.n, 0) AS n_hit, coalesce(ids.n, 0) AS n_items, sha256(coalesce(t, '')) AS items_sha256,
       coalesce(per.n, 0) > 0 AND 20 * coalesce(per.n, 0) >= len(w) AS contaminated
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN ids USING (doc_id)"""

OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || doc_id) AS x FROM documents),
h AS (SELECT *, ('0x' || substr(x, 1, 8))::BIGINT % (n + 1) AS h1, ('0x' || substr(x, 9, 8))::BIGINT % (n + 1) AS h2,
      ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
p AS (SELECT *, least(h1, h2) AS a, greatest(h1, h2) AS b, CASE
        WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
        WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
c AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c"""
OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term FROM (SELECT DISTINCT r, lang, term FROM t) GROUP BY 1, 2 HAVING count(*) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY 1, 2, 3),
cell AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM d) g JOIN k ON k.lang = g.lang
         LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
whole AS (SELECT lang, term, sum(n) AS n FROM cell GROUP BY 1, 2),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER g + 5 * count(*) OVER g) AS p FROM cell WINDOW g AS (PARTITION BY lang, source)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER l + 5 * count(*) OVER l) AS q FROM whole WINDOW l AS (PARTITION BY lang)),
s AS (SELECT DISTINCT lang, source FROM d),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0)::BIGINT AS value
          FROM s a JOIN s b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY 1, 2, 3),
terms AS (SELECT lang, source, term AS item, (p - q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
every AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM every) WHERE part = 'pair' OR rank <= 50"""
OP13_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
near AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT n.a, l.b FROM near n JOIN l ON l.a = n.b),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM near GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM low LEFT JOIN n USING (vec_id)"""


@query("op2_token_files")
def op2_token_files(spark, sf_dir):
    path = scratch_path(spark, "tokens")
    token_files.write(read_table(spark, sf_dir, "documents"), tokenizer_path(), path)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", ids_crc32("ids").alias("ids_crc32"))


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark, sf_dir):
    cut = packing.pieces(read_table(spark, sf_dir, "documents"), tokenizer_path())
    digest = cut.select("doc_id", "piece", "start", "length", "part", "rank", ids_crc32("ids").alias("ids_crc32"))
    return packing.pack(digest).drop("part", "rank")


@query("op8_language_id")
def op8_language_id(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id"))
    model = language.fit(docs.where(~F.col("held_out")))
    found = language.predict(docs.select("doc_id", "held_out", "text"), model)
    return found.select("doc_id", "held_out", "language.lang_pred", "language.score")


@query("op10_decontaminate", OP10_SQL)
def op10_decontaminate(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark(docs, read_table(spark, sf_dir, "benchmark"))
    hits = F.col("hits")
    return marked.select(
        "doc_id",
        hits["n_words"].alias("n_words"),
        decontaminate.hit_words(hits).alias("n_hit"),
        F.size(hits["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(hits["items"], ","), 256).alias("items_sha256"),
        decontaminate.contaminated(hits).alias("contaminated"),
    )


@query("op6_simhash_groups")
def op6_simhash_groups(spark, sf_dir):
    found = simhash.groups(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


@query("op9_license_scan")
def op9_license_scan(spark, sf_dir):
    found = license_scan.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    all_ = F.col("licenses")
    first = all_["phrases"]["first_word"]
    names = F.array_sort(F.array_distinct(F.concat(all_["phrases"]["label"], all_["notices"]["label"])))
    best = F.array_max(F.concat(F.transform(all_["phrases"], lambda _: F.lit(1.0)), all_["notices"]["similarity"]))
    return found.select(
        "doc_id",
        all_["n_words"].alias("n_words"),
        F.size(first).cast("bigint").alias("n_base"),
        F.array_min(first).alias("first_word"),
        F.array_max(first).alias("last_word"),
        license_scan.labels(all_, "phrases").alias("base_labels"),
        F.array_join(names, ",").alias("labels"),
        F.coalesce(best, F.lit(0.0)).alias("score"),
    )


@query("op4_quality_votes")
def op4_quality_votes(spark, sf_dir):
    found = quality.signals(read_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "signals", quality.votes("signals").alias("votes"))
    # read once: later steps need these few numbers only
    found = cut_lineage(found)
    weights = quality.fit(found.select("votes"))
    s = F.col("signals")
    failed = (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])
    good = weights.posterior(F.col("votes"))
    base = [s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return found.select("doc_id", *base, failed.alias("base_failed"), (~failed & (good >= 0.5)).alias("kept"), good.alias("quality"))


@query("op3_fuzzy_line_dedup")
def op3_fuzzy_line_dedup(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = lines.deduplicate(docs)
    n_kept = F.when(F.col("text").isNull(), 0).otherwise(F.length("text"))
    return found.select(
        "doc_id",
        F.size("dropped_lines").cast("bigint").alias("n_dropped"),
        F.array_join("dropped_lines", ",").alias("dropped_lines"),
        n_kept.cast("bigint").alias("n_chars"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


@query("op1_substring_dedup", OP1_SQL)
def op1_substring_dedup(spark, sf_dir):
    found = substrings.deduplicate(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    r = F.col("deduplicated")
    return found.select(
        "doc_id",
        r["n_bytes"].alias("n_bytes"),
        (r["n_bytes"] - F.length(r["kept"])).cast("bigint").alias("n_removed"),
        F.size(r["spans"]).cast("bigint").alias("n_spans"),
        F.sha2(r["kept"], 256).alias("kept_sha256"),
    )


@query("op5_html_text")
def op5_html_text(spark, sf_dir):
    found = html_text.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op11_fill_middle", OP11_SQL)
def op11_fill_middle(spark, sf_dir):
    found = fill_middle.transform(read_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_output=False)
    return found.select("doc_id", *[f"fim.{c}" for c in ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")])


@query("op12_source_audit", OP12_SQL)
def op12_source_audit(spark, sf_dir):
    return source_audit.audit(read_table(spark, sf_dir, "documents"))


@query("op13_near_vectors", OP13_SQL)
def op13_near_vectors(spark, sf_dir):
    return near_vectors.near_duplicates(read_table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")
