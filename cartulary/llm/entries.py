"""Registered queries of the operators, one each, over whole tables, and the SQL that DuckDB checks them with."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.llm import codes, jaccard, langid, licenses, mixing, ogg, packing, pii, ppm, search, syncmers, urls, warc
from cartulary.llm.common import documents, remainder


def tokenizer_file(name: str) -> str:
    """Path of a public vocabulary: CARTULARY_TOKENIZERS, else the installed public_tokenizers."""
    folder = os.environ.get("CARTULARY_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


#: Splits text before the merges of the byte-level vocabulary; fixed with it.
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def pack(docs: DataFrame) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.tiktoken"), BYTE_PATTERN, added=packing.added_tokens(tokenizer_file("byte_bpe_50k.json")))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op2_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scores = ppm.score(docs, "crc32(CAST(CAST(doc_id AS string) AS binary)) % 7 <> 2")
    return scores.withColumn("held_out", F.coalesce(remainder("doc_id", 7) == 2, F.lit(False)))


def op3_entropy_balanced_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir), ["doc_id"])


def op4_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.features(ogg.stored(documents(spark, sf_dir), ["doc_id"]), ["doc_id", "n_bytes"])


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op6_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = warc.write(warc.roles(pages), warc.archive_folder(spark))
    return warc.read(spark, manifest, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(documents(spark, sf_dir), k=3, num=9, den=10)


def op8_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = syncmers.edited(documents(spark, sf_dir))
    near = syncmers.likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited")
    far = syncmers.likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", near, far)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.detect(documents(spark, sf_dir), ["doc_id"])
    counts = [pii.count(k).alias(f"n_{k}") for k in pii.BASE]
    return rows.select("doc_id", *counts, F.sha2(pii.digest(pii.BASE), 256).alias("base_sha256"), pii.digest(tuple(pii.PATTERNS)).alias("spans"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fitted = langid.learn(docs.where(remainder("doc_id", 5) != 0), tokenizer_file("piece_bpe_32k.model"))
    rows = docs.withColumn("held_out", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)))
    return langid.predict(rows, fitted, ["doc_id", "held_out"])


def op11_block_max_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compressed(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: The rules on pages, and words that a listed host has between dots or hyphens.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
HOST_WORDS = ["adult", "bets", "casino", "gambling", "porn", "spam"]


def op13_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return urls.judged(pages, rules, urls.hosts_with_words(pages, HOST_WORDS), ["page_id"])


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: A-Z, which contracts fold.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def codes_sql() -> str:
    """op12 as SQL: a table of assignments (d) and one of entries (b) for each round."""
    near = "d{r} AS MATERIALIZED (SELECT vec_id, p, min(far * 16 + e) AS best FROM (SELECT x.vec_id, x.p, e, sum((x.v - b{r}.v) * (x.v - b{r}.v)) AS far FROM x JOIN b{r} USING (p, j) GROUP BY ALL) GROUP BY ALL)"
    mean = """b{s} AS MATERIALIZED (SELECT p, e, j, coalesce((s - ((s % n) + n) % n) // n, b{r}.v) AS v FROM b{r} LEFT JOIN
        (SELECT p, best % 16 AS e, j, sum(v) AS s, count(*) AS n FROM x JOIN d{r} USING (vec_id, p) GROUP BY ALL) USING (p, e, j))"""
    steps = ", ".join(near.format(r=r) + (", " + mean.format(r=r, s=r + 1) if r < codes.ROUNDS else "") for r in range(codes.ROUNDS + 1))
    return f"""
        WITH kept AS (SELECT vec_id, label, embedding AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        x AS MATERIALIZED (SELECT vec_id, (i - 1) // (len(v) // 8) AS p, (i - 1) % (len(v) // 8) AS j, CAST(floor(4096 * CAST(v[i] AS DOUBLE)) AS BIGINT) AS v FROM (SELECT vec_id, v, unnest(range(1, len(v) + 1)) AS i FROM kept)),
        b0 AS MATERIALIZED (SELECT p, e, j, v FROM x JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 16) USING (vec_id)), {steps},
        coded AS (SELECT vec_id, string_agg(format('{{:02x}}', CAST(best % 16 AS BIGINT)), '' ORDER BY p) AS code, CAST(sum(best // 16) AS BIGINT) AS error FROM d{codes.ROUNDS} GROUP BY 1)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
               (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, j)) FROM b{codes.ROUNDS}) AS codebooks_sha256
        FROM coded JOIN kept USING (vec_id)"""


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_ppm_scores, op3_entropy_balanced_mix, op4_ogg_media, op5_license_scan, op6_warc_round_trip, op7_jaccard_components, op8_syncmer_fingerprints, op9_personal_data, op10_language_id, op11_block_max_search, op12_vector_codes, op13_url_verdicts, pipeline)}

ORACLES = {
    "op6_warc_round_trip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
        m AS (SELECT payload_digest AS g, max(page_id) AS first FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM d LEFT JOIN m ON g = payload_digest AND payload_bytes >= 1000""",
    "op11_block_max_search": rf"""
        WITH doc AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{search.TERM}') AS terms FROM documents WHERE text IS NOT NULL),
        size AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n FROM doc WHERE len(terms) > 0),
        whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM size),
        asked AS MATERIALIZED (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{UPPER.lower()}'), '{search.TERM}')) AS term FROM benchmark),
        tf AS MATERIALIZED (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM doc) SEMI JOIN asked USING (term) GROUP BY ALL),
        weight AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole GROUP BY 1),
        value AS (SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // whole.terms))) AS v FROM tf JOIN size USING (r) JOIN weight USING (term), whole),
        total AS (SELECT item_id, r, doc_id, CAST(sum(v) AS BIGINT) AS score FROM asked JOIN value USING (term) GROUP BY ALL HAVING sum(v) > 0)
        SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM total) WHERE rank <= {search.TOP}""",
    "op12_vector_codes": codes_sql(),
    "op13_url_verdicts": f"""
        WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
        p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{UPPER.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
        rules(verdict, h, s) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
        fit AS (SELECT page_id, arg_max(struct_pack(rule := h || s, verdict := verdict), length(h || s)) AS best FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY 1)
        SELECT page_id, host, path, best.rule AS rule,
               coalesce(best.verdict, CASE WHEN list_has_any(regexp_split_to_array(host, '[.-]'), {HOST_WORDS}) THEN 'block' ELSE 'allow' END) AS verdict
        FROM p LEFT JOIN fit USING (page_id)""",
}
