"""The operators as queries over the driver's tables, with production parameters, and their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowlens.llm import (
    byte_bpe, exact_dedup, lexical_search, minhash, ngram_join, packing, page_diff, quality, secrets, spelling,
    suffix_dedup, warc, winnowing,
)
from flowlens.llm.common import table


def op1_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.extract(table(spark, sf_dir, "pages"))


def op2_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.report(winnowing.fingerprints(table(spark, sf_dir, "documents")))


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(table(spark, sf_dir, "documents")))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op5_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op6_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import PATTERN

    shared = byte_bpe.codec(spark, tokenizer_file("byte_bpe_50k.tiktoken"), PATTERN)
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), shared), shared)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_ALL = (
    op1_page_diff, op2_winnowing, op3_secret_ownership, op4_ngram_join, op5_warc_salvage, op6_cuckoo_dedup,
    op7_byte_bpe, op8_suffix_dedup, op9_quality_trees, op10_certified_packing, op11_spelling_variants,
    op12_ranked_search, op13_minhash_dedup, pipeline,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {run.__name__: run for run in _ALL}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The remainders of the 16 four-bit numbers in the check sum CRC-32.
CRC_OF_FOUR_BITS = (
    0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C,
    0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C,
)


def components_sql(shingle: int, columns: str) -> str:
    """Documents whose sets of ``shingle`` words have a Jaccard similarity of 0.8, and what they reach."""
    return rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
 sets AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(words) < {shingle} THEN [array_to_string(words, ' ')]
   ELSE list_distinct(list_transform(range(1, len(words) - {shingle - 2}), lambda i: array_to_string(words[i:i + {shingle - 1}], ' '))) END AS sh
  FROM w),
 held AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS s FROM sets),
 shared AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c
  FROM held a JOIN held b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL),
 links AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (na + nb - c)),
 near AS (SELECT a AS doc_id, b AS other FROM links UNION ALL SELECT b, a FROM links),
 reached AS (SELECT doc_id, doc_id AS other FROM sets
  UNION SELECT reached.doc_id, near.other FROM reached JOIN near ON reached.other = near.doc_id),
 found AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT sets.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, component_id{columns} FROM sets JOIN found USING (doc_id)"""


ORACLES: dict[str, str] = {
    "op4_ngram_join": components_sql(5, ""),
    "op11_spelling_variants": rf"""
WITH RECURSIVE texts AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run
  FROM documents),
 runs AS (SELECT doc_id, run, count(*) AS n, hex(encode(doc_id || ':' || run)) AS digits FROM texts WHERE length(run) >= 7 GROUP BY doc_id, run),
 hashed AS (SELECT run, n, xor(4294967295, list_reduce(
   list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length(digits) + 1),
     lambda i: CAST(instr('0123456789ABCDEF', digits[i + 2 * (i % 2) - 1]) - 1 AS BIGINT))),
   lambda c, x: xor(c >> 4, {list(CRC_OF_FOUR_BITS)}[1 + (xor(c, x) & 15)]))) AS h
  FROM runs),
 damaged AS (SELECT n, CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
 words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
 places AS (SELECT word, n, unnest(range(0, length(word))) AS i FROM words),
 holes AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM places),
 shorter AS (SELECT DISTINCT h.word, h.n, w.word AS other, w.n AS n_other FROM holes h JOIN words w ON h.rest = w.word),
 near AS (SELECT a.word, b.word AS other, b.n AS n_other FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT word, other, n_other FROM shorter UNION ALL SELECT other, word, n FROM shorter),
 placed AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY n_other DESC, encode(other)) AS k,
   count(*) OVER (PARTITION BY word) AS n_near FROM near),
 forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN n_other >= 10 * w.n THEN other END AS form,
   CASE WHEN n_other >= 10 * w.n THEN n_other END AS form_n FROM words w LEFT JOIN placed p ON w.word = p.word AND p.k = 1),
 chain AS (SELECT word, word AS last FROM forms UNION ALL SELECT chain.word, form FROM chain JOIN forms ON last = forms.word WHERE form IS NOT NULL),
 ends AS (SELECT chain.word, last AS root FROM chain JOIN forms ON last = forms.word WHERE form IS NULL)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n FROM forms JOIN ends USING (word)""",
    "op12_ranked_search": rf"""
WITH pattern AS (SELECT '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' AS p),
 held AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), p)) AS term FROM documents, pattern),
 asked AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), p)) AS term FROM benchmark, pattern),
 tfs AS (SELECT doc_id, term, count(*) AS tf FROM held GROUP BY doc_id, term),
 sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY doc_id),
 whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
 norms AS (SELECT doc_id, 100 - 50 + (50 * n * docs) // terms AS m FROM sizes, whole),
 weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tfs, whole GROUP BY term, docs),
 scored AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN norms USING (doc_id) GROUP BY item_id, doc_id),
 placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scored WHERE score > 0)
SELECT item_id, CAST(r AS INTEGER) AS "rank", doc_id, score FROM placed WHERE r <= 50""",
    "op13_minhash_dedup": components_sql(2, ", doc_id = component_id AS kept"),
    "op5_warc_salvage": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
 d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
 f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS smallest FROM d)
SELECT page_id, payload_bytes, payload_digest,
 CASE WHEN payload_bytes >= 100 AND page_id <> smallest THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 100 AND page_id <> smallest THEN smallest END AS refers_to
FROM f""",
    "op6_cuckoo_dedup": """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
 g AS (SELECT *, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
}
