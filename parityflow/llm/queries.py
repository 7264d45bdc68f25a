"""The registered queries of this subpackage and the SQL that some of them are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parityflow.llm import bpe, crosstoken, edits, jaccard, language, linededup, mixing, neardup, passages, pii, topk, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def sample_edits(docs: DataFrame) -> DataFrame:
    """Three edits of every document: a cut in the middle, an insertion at two thirds, the source at the end."""
    n = F.length("text")
    third, at = F.floor(n / 3).cast("long"), F.floor(n * 2 / 3).cast("long")
    kind = "struct<seq:int,start:bigint,finish:bigint,new:string>"
    each = F.array(
        F.struct(F.lit(1), third, third + 20, F.lit("")).cast(kind),
        F.struct(F.lit(2), at, at, F.concat(F.lit(" note "), F.col("doc_id").cast("string"), F.lit("'s"))).cast(kind),
        F.struct(F.lit(3), F.lit(None), F.lit(None), F.coalesce(F.col("source"), F.lit(""))).cast(kind),
    )
    return docs.select("doc_id", F.inline(each))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after its edits."""
    docs = _table(spark, sf_dir, "documents")
    vocabulary = bpe.read_vocabulary(vocabulary_path())
    lexicon = bpe.build_lexicon(docs.select("text"), vocabulary)
    counted = edits.count_edited(docs.select("doc_id", "text"), sample_edits(docs.select("doc_id", "text", "source")), vocabulary, lexicon)
    return counted.select("doc_id", "n_tokens", "n_tokens_after", "chars_encoded", "chars_reencoded")


def op7_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of all documents that an earlier document holds too."""
    return passages.repeated_passages(_table(spark, sf_dir, "documents"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best candidates of every query vector (ids divisible by 100)."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0))


OP2_SQL = """
WITH v AS (SELECT vec_id, [floor(1024 * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
      FROM v q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op3_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of one label with a cosine of 0.98 or more."""
    return neardup.link_embeddings(_table(spark, sf_dir, "embeddings"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that no earlier document holds."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = """
WITH rows_ AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM rows_),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key),
m AS (SELECT k.doc_id, k.pos, k.line, coalesce(o.first < k.doc_id, false) AS gone FROM k LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    units = mixing.decide(_table(spark, sf_dir, "documents"))
    rows = units.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("n_rows").cast("int"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


_OP5_PASS = """
u{n} AS (SELECT source, sum(copies * size) AS used FROM d{n} GROUP BY source),
g{n} AS (SELECT d.*, target - used AS gap FROM d{n} d JOIN u{n} u ON d.source IS NOT DISTINCT FROM u.source),
c{n} AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY rank, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto
         FROM g{n} WHERE rank IS NOT NULL AND size > 0 {fits}),
d{m} AS (SELECT g.doc_id, g.source, g.size, g.source_size, g.target, g.copies + (t.doc_id IS NOT NULL)::INT AS copies,
         CASE WHEN t.doc_id IS NULL THEN g.rank END AS rank
         FROM g{n} g LEFT JOIN (SELECT doc_id FROM c{n} WHERE upto <= gap) t ON g.doc_id = t.doc_id)"""

OP5_SQL = (
    r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
a AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS most FROM a),
o AS (SELECT *, row_number() OVER b AS turn,
      ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
      FROM w WINDOW b AS (ORDER BY most / weight, source NULLS LAST)),
t AS (SELECT source, source_size, least(most, coalesce((SELECT level FROM o WHERE level * weight <= most ORDER BY turn LIMIT 1) * weight, most)) AS target FROM o),
e AS (SELECT s.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
      (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
d0 AS (SELECT doc_id, source, size, source_size, target, floor(rate)::BIGINT AS copies,
       CASE WHEN rate > floor(rate) THEN u / (1 - u) * ((1 - (rate - floor(rate))) / (rate - floor(rate))) END AS rank FROM e),"""
    + ",".join(_OP5_PASS.format(n=n, m=n + 1, fits="AND size <= gap" if n else "") for n in range(1 + mixing.TOP_UPS))
    + f"\nSELECT doc_id, size, source_size, target, copies * size AS taken FROM d{1 + mixing.TOP_UPS}"
)


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text they decode to."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    vocabulary = bpe.read_vocabulary(vocabulary_path())
    out = bpe.round_trip(docs, vocabulary, bpe.build_lexicon(docs, vocabulary))
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned outside the held-out fold."""
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", language.held_out())
    model = language.fit(docs.filter(~F.col("held_out") & F.col("doc_id").isNotNull()))
    return language.identify(docs.select("doc_id", "text", "held_out"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in every document."""
    found = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("pii", lambda s: s["kind"].isin(*pii.BASE_KINDS))
    counts = [pii.count_of(F.col("pii"), k).alias(f"n_{k}") for k in pii.BASE_KINDS]
    scores = F.array_join(F.transform("pii", lambda s: F.format_number(s["score"], 2)), ",")
    digest = F.sha2(pii.span_text(base).cast("binary"), 256)
    return found.select("doc_id", *counts, digest.alias("base_sha256"), pii.span_text(F.col("pii")).alias("spans"), scores.alias("scores"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents whose five-word shingles have a Jaccard similarity of 0.75 or more."""
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x20\x09-\x0D]+') AS ws FROM documents),
t AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM t a JOIN t b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.doc_id WHERE r.c < e.y),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM m LEFT JOIN n USING (doc_id)
"""


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over every document, and how often the linked ids occur in the corpus."""
    import public_tokenizers

    pieces = crosstoken.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    return crosstoken.linked_counts(_table(spark, sf_dir, "documents"), bpe.read_vocabulary(vocabulary_path()), pieces)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every vector."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


def op13_warc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through WARC files: what the archives say of each."""
    read = warc.archive_pages(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    ids = {c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("long") for c in ("record_id", "refers_to")}
    digest = F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1))
    return read.select(
        ids["record_id"].alias("page_id"), F.col("payload_length").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", ids["refers_to"].alias("refers_to")
    )


OP13_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND payload_bytes >= 100
"""


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op7_repeated_passages": op7_repeated_passages,
    "op10_jaccard_join": op10_jaccard_join,
    "op2_topk": op2_topk,
    "op3_embedding_neardup": op3_embedding_neardup,
    "op4_line_dedup": op4_line_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_bpe_round_trip": op6_bpe_round_trip,
    "op8_language_id": op8_language_id,
    "op9_pii": op9_pii,
    "op11_token_alignment": op11_token_alignment,
    "op12_whitening": op12_whitening,
    "op13_warc_pages": op13_warc_pages,
}
ORACLES = {"op13_warc_pages": OP13_SQL, "op2_topk": OP2_SQL, "op10_jaccard_join": OP10_SQL, "op4_line_dedup": OP4_SQL, "op5_source_mixing": OP5_SQL}
