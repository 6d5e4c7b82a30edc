"""The operators as queries over the driver's tables, each with the columns asked for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import ann, decontam, divergence, langid, packing, phrases, pieces, pii, quality, sharding, simhash, tokens, warc
from .samples import remainder

KEPT_SCORE = 0.3
WORDS_49K = "word_bpe_49k.json"
PIECES_32K = "piece_bpe_32k.model"


def vocabulary() -> str:
    return tokens.vocabulary_text(public_tokenizers.path(WORDS_49K))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokens.write_tokens(read_table(spark, sf_dir, "documents"), vocabulary(), end_id=2)
    return tokens.read_tokens(manifest, with_ids=False)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = langid.with_language(docs, langid.train(docs), keep=["doc_id"])
    return found.select("doc_id", (remainder("doc_id") == 0).alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    found = decontam.find(docs, items).withColumn("n_hit", decontam.hit_words())
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.with_components(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard(read_table(spark, sf_dir, "documents"), shards=24)
    return placed.select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.with_score(docs, model, keep=["doc_id"])
    predicted = (F.col("score") >= KEPT_SCORE).cast("int").alias("predicted")
    return scored.select("doc_id", (remainder("doc_id") == 0).alias("held_out"), "score", predicted)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ann.build(read_table(spark, sf_dir, "embeddings"))
    asked = index.rows.where(F.col("vec_id") % 20 == 0).dropDuplicates(["vec_id"]).select("vec_id", "vec")
    return ann.search(index, asked, k=20)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = pii.with_spans(docs, pii.train(docs), keep=["doc_id"])

    def joined(spans):
        parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
        return F.array_join(parts, ",")

    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, lambda s: s == F.lit(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read_table(spark, sf_dir, "documents"), vocabulary(), 4096, end_id=1)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    archive = warc.write_archive(pages)
    records = warc.read_records(warc.lookup(archive, pages))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(read_table(spark, sf_dir, "documents"), least=100, top=2000)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents"), top_terms=200, least_docs=3)


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.model_bytes(public_tokenizers.path(PIECES_32K))
    coded = pieces.encode(read_table(spark, sf_dir, "documents"), model, keep=["doc_id"])
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256")
    rows = coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest, "ids")
    back = pieces.decode(rows, model, keep=["doc_id", "n_tokens", "ids_sha256"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_language": op2_language,
    "op3_decontamination": op3_decontamination,
    "op4_simhash": op4_simhash,
    "op5_sharding": op5_sharding,
    "op6_quality": op6_quality,
    "op7_neighbours": op7_neighbours,
    "op8_personal_data": op8_personal_data,
    "op9_packing": op9_packing,
    "op10_warc": op10_warc,
    "op11_collocations": op11_collocations,
    "op12_divergence": op12_divergence,
    "op13_pieces": op13_pieces,
}

def _sql_lower(column: str) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"translate(coalesce({column}, ''), '{upper}', '{lower}')"


def _sql_words(column: str) -> str:
    return rf"regexp_extract_all({_sql_lower(column)}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _sql_share(n: str, total: str) -> str:
    return f"CAST(1 + (1000000000::HUGEINT * ({n} + 1)) // ({total}) AS HUGEINT)"


# Operators without fitted models, tokenizers or keyed hashes.
ORACLE: dict[str, str] = {
    "op3_decontamination": f"""
WITH w AS (SELECT doc_id, {_sql_words('text')} AS ws FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_sql_words('text')} AS ws FROM benchmark),
sized AS (SELECT *, least(10, len(ws)) AS n FROM items WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(ws[i:i + n - 1], ' ') AS t
  FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM sized)),
grams AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS t
  FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS i FROM w JOIN (SELECT DISTINCT n FROM windows) ON len(ws) >= n)),
hits AS (SELECT doc_id, n, i, item FROM grams JOIN windows USING (n, t)),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS these FROM hits GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(these), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(these, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS last FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, 1 + 5 * (i // 4), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to, true AS intact FROM d""",
    "op11_collocations": rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_extract_all({_sql_lower('text')}, '[^.,;:!?\x0A-\x0D]+')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM d),
totals AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
grams AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, len(ws) - m + 2)) AS i
  FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m) WHERE len(ws) >= m)),
f AS (SELECT lang, m, phrase, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= 100),
parted AS (SELECT lang, m, phrase, n, string_split(phrase, ' ') AS ws FROM f),
longer AS (SELECT lang, array_to_string(ws[b:e], ' ') AS phrase, max(n) AS longer
  FROM (SELECT *, unnest([1, 2]) AS b, b + m - 2 AS e FROM parted WHERE m > 2) GROUP BY ALL),
kept AS (SELECT p.* FROM parted p LEFT JOIN longer USING (lang, phrase) WHERE m > 1 AND coalesce(100 * longer < 100 * n, true)),
cuts AS (SELECT *, array_to_string(ws[:k], ' ') AS x, array_to_string(ws[k + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
scored AS (SELECT c.lang, c.phrase, c.n AS a, k, lf.n AS l, rt.n AS r, t.n, (1000::HUGEINT * c.n * t.n) // (lf.n::HUGEINT * rt.n) AS score
  FROM cuts c JOIN f lf ON lf.lang = c.lang AND lf.phrase = x JOIN f rt ON rt.lang = c.lang AND rt.phrase = y JOIN totals t ON t.lang = c.lang),
worst AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS cut FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM worst WHERE cut = 1)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000""",
    "op12_divergence": rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS id,
  regexp_extract_all({_sql_lower('text')}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
t AS (SELECT lang, source, id, unnest(ts) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY ALL HAVING count(DISTINCT id) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(total) AS lang_n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0) AS group_n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n, {_sql_share('coalesce(n, 0)', 'group_n + v')} AS p, {_sql_share('total', 'lang_n + v')} AS q
  FROM g JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
found AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS r FROM found)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= 200""",
}
