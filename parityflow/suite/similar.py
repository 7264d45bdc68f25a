"""Registered similarity and text queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parityflow.functions.text import COMPLEX_WORDS, INJECTION_PATTERNS
from parityflow.functions.vectors import cosine_similarity
from parityflow.operators import scans
from parityflow.operators import similarity as V
from parityflow.suite import pairs as P
from parityflow.suite.schemas import CATALOG_SQL, catalogs

QUERIES, ORACLES = {}, {}


def registered(sql=None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return wrap


def vectors(spark, sf_dir):
    """All embeddings, and after them a NULL, an empty, a zero and a shortened vector for every hundred."""
    key, v = F.col("vec_id"), F.col("embedding")
    odd = (
        F.when(key % 100 == 50, F.lit(None).cast("array<float>"))
        .when(key % 100 == 51, F.array().cast("array<float>"))
        .when(key % 100 == 52, F.transform(v, lambda x: F.lit(0.0).cast("float")))
        .when(key % 100 == 53, F.slice(v, 1, 63))
    )
    given = P.load(spark, sf_dir, "embeddings")
    extra = given.filter((key % 100).between(50, 53)).withColumns({"embedding": odd, "vec_id": -1 - key})
    return given.unionByName(extra)


VECTORS_SQL = """vectors AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings UNION ALL SELECT -1 - vec_id, label, CASE vec_id % 100 WHEN 50 THEN NULL WHEN 51 THEN []::DOUBLE[] WHEN 52 THEN list_transform(embedding, lambda x: 0.0)::DOUBLE[]
 WHEN 53 THEN embedding[1:63]::DOUBLE[] END AS v FROM embeddings WHERE vec_id % 100 BETWEEN 50 AND 53),
scored AS (SELECT a.vec_id AS query_id, b.vec_id AS match_id, CASE WHEN len(a.v) <> len(b.v) OR len(a.v) = 0 OR list_dot_product(a.v, a.v) = 0 OR list_dot_product(b.v, b.v) = 0 THEN 0.0
 ELSE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) END AS score
 FROM vectors a, vectors b WHERE a.v IS NOT NULL AND b.v IS NOT NULL)"""


@registered(f"WITH {VECTORS_SQL} SELECT match_id, round(score, 5) AS score FROM scored WHERE query_id = 0")
def cosine_scores(spark, sf_dir):
    """Similarity of every vector with the first one."""
    vs = vectors(spark, sf_dir)
    first = vs.filter("vec_id = 0").first()["embedding"]  # one vector
    wanted = F.array(*[F.lit(float(x)) for x in first])
    score = cosine_similarity(F.col("embedding"), wanted)
    return vs.filter("embedding IS NOT NULL").select(F.col("vec_id").alias("match_id"), F.round(score, 5).alias("score"))


@registered(f"WITH {VECTORS_SQL} SELECT match_id AS vec_id, round(score, 5) AS score FROM scored WHERE query_id = 3 ORDER BY scored.score DESC, match_id LIMIT 5")
def cosine_topk(spark, sf_dir):
    vs = vectors(spark, sf_dir)
    query = vs.filter("vec_id = 3").first()["embedding"]  # one vector
    return V.similar_to(vs, query).select("vec_id", F.round("score", 5).alias("score"))


_RANKED = """r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id) AS rank FROM scored)
SELECT query_id, match_id, round(score, 5) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 5"""


@registered(f"WITH {VECTORS_SQL}, {_RANKED} ")
def batch_topk(spark, sf_dir):
    """The five best matches of every vector."""
    vs = vectors(spark, sf_dir)
    return V.batch_top_k(vs, vs).withColumn("score", F.round("score", 5))


@registered(f"""WITH {VECTORS_SQL}, named AS (SELECT 'v' || query_id AS query_id, 'v' || match_id AS match_id, score FROM scored),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id) AS rank FROM named)
SELECT query_id, match_id, round(score, 5) AS score, rank::INTEGER AS rank FROM r WHERE rank <= 5""")
def batch_topk_text_ids(spark, sf_dir):
    """The same with ids of text."""
    vs = vectors(spark, sf_dir).withColumn("vec_id", F.concat(F.lit("v"), F.col("vec_id").cast("string")))
    return V.batch_top_k(vs, vs).withColumn("score", F.round("score", 5))


CHUNKS_SQL = """chunks AS (SELECT doc_id AS id, 'c' || (doc_id % 4) AS connection_id, text AS content FROM documents)"""


def _chunks(spark, sf_dir):
    return P.load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.concat(F.lit("c"), F.pmod("doc_id", F.lit(4))).alias("connection_id"), F.col("text").alias("content")
    )


@registered(f"WITH {CHUNKS_SQL} SELECT id, connection_id, CASE WHEN id % 3 = 0 THEN 'new: ' || content ELSE content END AS content FROM chunks")
def chunk_replace(spark, sf_dir):
    """Half of the index is new, a third of it is saved again."""
    chunks = _chunks(spark, sf_dir)
    fresh = chunks.filter((F.col("id") % 3 == 0) | (F.col("id") % 2 == 1)).withColumn(
        "content", F.when(F.col("id") % 3 == 0, F.concat(F.lit("new: "), "content")).otherwise(F.col("content"))
    )
    return V.save_chunks(chunks.filter("id % 2 = 0"), fresh)


@registered(f"WITH {CHUNKS_SQL} SELECT * FROM chunks WHERE connection_id <> 'c2'")
def chunk_clear(spark, sf_dir):
    return V.clear_connection(_chunks(spark, sf_dir), "c2")


@registered("""SELECT conv_id AS entity, (turn // 8)::BIGINT AS chunk_no, 'Conversation ' || conv_id || chr(10) || string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS content
FROM conversations GROUP BY conv_id, turn // 8""")
def entity_documents(spark, sf_dir):
    """The turns of a conversation as one text, eight turns to a chunk."""
    conv = P.load(spark, sf_dir, "conversations").withColumn("line", F.concat(F.col("role"), F.lit(": "), F.col("text")))
    heads = conv.select(F.col("conv_id").alias("entity")).distinct().withColumn("head", F.concat(F.lit("Conversation "), F.col("entity").cast("string")))
    return V.entity_documents(conv, "conv_id", "turn", "line", heads, lines_per_chunk=8)


@registered(f"""WITH {CATALOG_SQL}, lines AS (
  SELECT table_name, 0 AS sec, k AS pos, 'column ' || name || ' ' || data_type || CASE WHEN max_length IS NOT NULL THEN '(' || max_length || ')' ELSE '' END
    || CASE WHEN is_nullable THEN ', optional' ELSE '' END || CASE WHEN k < 60 THEN ', key' ELSE '' END AS line FROM sc
  UNION ALL SELECT table_name, 1, k, CASE WHEN is_unique THEN 'unique index ' ELSE 'index ' END || name || ' on ' || cols FROM si
  UNION ALL SELECT table_name, 2, k, kind || ' ' || name || ' on c' || k FROM sk),
placed AS (SELECT *, (row_number() OVER (PARTITION BY table_name ORDER BY sec, pos, line) - 1) // 25 AS chunk FROM lines),
n AS (SELECT table_name, count(*) AS row_count FROM sc WHERE k % 60 <> 59 GROUP BY 1),
t AS (SELECT DISTINCT table_name FROM sc),
names AS (SELECT table_name, count(*) OVER () AS n, ('0x' || substr(md5(table_name), 1, 8))::BIGINT % ceil(count(*) OVER () / 25)::BIGINT AS chunk FROM t)
SELECT 'c1/public/' || table_name || '#' || chunk AS id, 'c1' AS connection_id, 'table' AS chunk_type, 'public.' || table_name || ' @ shop' AS label,
 'public.' || table_name || ', rows: ' || coalesce(max(row_count)::VARCHAR, '?') || chr(10) || string_agg(line, chr(10) ORDER BY sec, pos, line) AS content
FROM placed LEFT JOIN n USING (table_name) GROUP BY table_name, chunk
UNION ALL SELECT 'c1/#' || chunk, 'c1', 'tables', 'shop, PostgreSql', 'shop, PostgreSql, tables: ' || max(n) || chr(10) || string_agg(table_name, chr(10) ORDER BY table_name)
FROM names GROUP BY chunk""")
def schema_chunks(spark, sf_dir):
    """Tables as texts of at most 25 lines, and the names of all tables."""
    src, _ = catalogs(spark, sf_dir)
    cols = src.columns.withColumn("ordinal_position", F.col("k")).withColumn("is_primary_key", F.col("k") < 60)
    counts = cols.filter("k % 60 <> 59").groupBy("table_name").agg(F.count(F.lit(1)).alias("row_count"))
    place = lambda df: df.withColumn("ordinal_position", F.col("k"))
    chunks = V.schema_chunks(cols, place(src.indexes), place(src.constraints), counts, "c1", "shop", lines_per_chunk=25)
    return chunks.unionByName(V.summary_chunks(cols, "c1", "shop", "PostgreSql", names_per_chunk=25))


# -- text checks ------------------------------------------------------------------------------------
_ODD = {
    0: "plain ../ path", 1: "tab\tand\nnewline are fine", 2: "bell \x07 here", 3: "x' OR 1=1", 4: "Union Select a", 5: "call XP_CMDSHELL now",
    6: "a /* b", 7: "..\\ up", 8: "c1 \x85 control", 9: "Robert'; DROP TABLE x;--",
}


def odd_texts(spark, sf_dir):
    """Every document, and for a third of them a further row with a suspicious text."""
    docs = P.load(spark, sf_dir, "documents").select("doc_id", "text")
    pick = F.get(F.array(*[F.lit(t) for t in _ODD.values()]), F.pmod("doc_id", F.lit(len(_ODD))).cast("int"))
    return docs.unionByName(docs.filter(P.every("doc_id", 3)).select((-1 - F.col("doc_id")).alias("doc_id"), pick.alias("text")))


def _sql_text(t):
    return "'" + t.replace("'", "''").replace("\x07", "' || chr(7) || '").replace("\x85", "' || chr(133) || '") + "'"


ODD_SQL = "odd AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - doc_id, CASE doc_id % 10 " + " ".join(
    f"WHEN {i} THEN {_sql_text(t)}" for i, t in _ODD.items()
) + " END FROM documents WHERE doc_id % 3 = 0)"
_HITS = " ".join(
    "WHEN contains(upper(text), upper('{0}')) THEN 'sql:{0}'".format(p.replace("'", "''")) for p in INJECTION_PATTERNS
)
_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]"


@registered(f"""WITH {ODD_SQL} SELECT doc_id, CASE WHEN strlen(text) > 5000 THEN 'bytes:' || strlen(text)
 WHEN regexp_matches(text, '{_CONTROL}') THEN 'control' WHEN contains(text, '../') OR contains(text, '..\\') THEN 'path'
 {_HITS} END AS reason FROM odd""")
def suspicious_text(spark, sf_dir):
    return scans.scan_text(odd_texts(spark, sf_dir), ["text"], 5000).select("doc_id", "reason")


@registered(f"WITH {ODD_SQL} SELECT doc_id, regexp_replace(text, '{_CONTROL}', '', 'g') AS text FROM odd")
def strip_controls(spark, sf_dir):
    return scans.strip_control_characters(odd_texts(spark, sf_dir), ["text"])


_NAMES = ("select", "_ok", "9lives", "has space", "", "a" * 129, "ünder", "Fine_1", "Drop")
_NAME_CASES = ("reserved", None, "start", "character", "empty", "bytes:129", "start", None, "reserved")


@registered("SELECT p_partkey, CASE p_partkey % 9 " + " ".join(
    f"WHEN {i} THEN " + (f"'{p}'" if p else "NULL") for i, p in enumerate(_NAME_CASES)
) + " END AS problem FROM part UNION ALL SELECT -1 - p_partkey, CASE WHEN p_name LIKE '% %' THEN 'character' END FROM part")
def identifier_check(spark, sf_dir):
    part = P.load(spark, sf_dir, "part")
    pick = F.get(F.array(*[F.lit(n) for n in _NAMES]), F.pmod("p_partkey", F.lit(len(_NAMES))).cast("int"))
    names = part.select("p_partkey", pick.alias("name")).unionByName(part.select((-1 - F.col("p_partkey")).alias("p_partkey"), F.col("p_name").alias("name")))
    return scans.validate_identifiers(names, "name").select("p_partkey", "problem")


_QUESTIONS = {
    0: "How many rows?", 1: "Explain this", 2: "select a from t join u", 3: "One. Two! ", 4: "One. Two! Three?", 5: "see ```code``` here",
    6: "from here to there from", 7: "what is a TRADE-OFF", 8: "  rows in orders  ", 9: "a windowed view",
}
_COMPLEX_HITS = " OR ".join(f"contains(lower(t), '{w}')" for w in COMPLEX_WORDS)


@registered(f"""WITH q AS (SELECT conv_id, turn, text AS raw FROM conversations UNION ALL SELECT -1 - conv_id, turn, CASE (conv_id + turn) // 2 % 10 {' '.join(f"WHEN {i} THEN '{t}'" for i, t in _QUESTIONS.items())} END FROM conversations WHERE (conv_id + turn) % 2 = 0),
x AS (SELECT conv_id, turn, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS t FROM q)
SELECT conv_id, turn, CASE WHEN length(t) > 200 OR len(list_filter(regexp_split_to_array(t, '[.!?]+'), lambda s: trim(s, chr(10) || chr(9) || ' ') <> '')) > 2 OR {_COMPLEX_HITS}
 OR regexp_matches(t, '\\b(JOIN|SUBQUER|UNION|CTE|WITH\\s+\\w+\\s+AS|PARTITION\\s+BY|WINDOW|LATERAL|CROSS\\s+APPLY)\\b', 'i')
 OR regexp_matches(t, '```.*?```', 's') OR regexp_matches(t, '\\b(FROM|JOIN)\\b.*\\b(FROM|JOIN)\\b', 'is') THEN 'complex' ELSE 'simple' END AS complexity FROM x""")
def complexity_tag(spark, sf_dir):
    conv = P.load(spark, sf_dir, "conversations")
    n = F.col("conv_id") + F.col("turn")
    pick = F.get(F.array(*[F.lit(t) for t in _QUESTIONS.values()]), F.pmod(F.floor(n / 2), F.lit(10)).cast("int"))
    mixed = conv.unionByName(conv.filter(n % 2 == 0).withColumns({"text": pick, "conv_id": -1 - F.col("conv_id")}))
    return scans.tag_complexity(mixed, "text").select("conv_id", "turn", "complexity")
