"""One query per operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import alignment, bpe, labelled, line_dedup, manifest, merkle, near_dups, packing, quality, runtime, simhash, substrings, topk, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    runtime.prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = toxicity.score(docs, toxicity.train(docs, labels), least=0.3)
    return found.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", F.size("sentences").alias("n_offending"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    gone = line_dedup.removed_lines(docs, threshold=0.8)
    rows = docs.select("doc_id", F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long").alias("n_lines"))
    joined = rows.join(gone, rows["doc_id"] == gone["k"], "left").withColumn("removed", F.coalesce("removed", F.array().cast("array<int>")))
    return joined.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.classes(table(spark, sf_dir, "documents"), threshold=0.8, width=5)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=50)
    return found.select("doc.doc_id", "n_words", "n_removed", "kept_sha256")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM p),
m AS (SELECT h, min(doc_id) AS least FROM h GROUP BY h),
c AS (SELECT DISTINCT doc_id, i + o AS i FROM h JOIN m USING (h), range(50) t(o) WHERE doc_id > least),
k AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
s AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS kept FROM k ANTI JOIN c USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id)
"""


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024.0)


OP5_SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10
"""


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = F.sha2("edited", 256).alias("edited_sha256")
    places = F.array_join(F.transform("differing", lambda x: F.concat_ws(":", x["section"], x["paragraph"])), ",")
    return merkle.edited_by_next(table(spark, sf_dir, "documents")).select("doc_id", "n_chars", edited, "fingerprint", "edited_fingerprint", "near_edited", "near_next", places.alias("differing"))


_TREE = """list_transform(string_split({0}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
  lambda p: list_transform(regexp_extract_all(p, '{1}'), lambda x: sha256(x))))"""
_PARAGRAPH = "sha256(array_to_string({0}, ','))"
_BRANCH = f"sha256(array_to_string(list_transform(s, lambda p: {_PARAGRAPH.format('p')}), ','))"
_PRINT = f"""sha256(array_to_string(list_transform({{0}}, lambda s: {_BRANCH}), ',')) || '/' || array_to_string(list_transform({{0}},
  lambda s: left({_BRANCH}, 12) || '(' || array_to_string(list_transform(s, lambda p: left({_PARAGRAPH.format('p')}, 12) || ':' || array_to_string(list_transform(p, lambda x: left(x, 12)), ',')), ';')), '|')"""
_LEAVES = "list_distinct(list_transform(flatten(flatten({0})), lambda x: left(x, 12)))"
_LIKE = """CASE WHEN len({0}) = 0 AND len({1}) = 0 THEN 1.0 ELSE CAST(len(list_intersect({0}, {1})) AS DOUBLE)
  / (len({0}) + len({1}) - len(list_intersect({0}, {1}))) END"""
_DIFFERING = f"""array_to_string(flatten(list_transform(a, lambda s, i: CASE WHEN list_contains(sections_b, {_BRANCH}) THEN CAST([] AS VARCHAR[])
  ELSE list_filter(list_transform(s, lambda p, j: CASE WHEN list_contains(paragraphs_b, {_PARAGRAPH.format('p')}) THEN NULL ELSE (i - 1) || ':' || (j - 1) END), lambda x: x IS NOT NULL) END)), ',')"""
OP6_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id DESC NULLS LAST, t), first_value(t) OVER (ORDER BY doc_id DESC NULLS LAST, t)) AS nt, length(t) AS n_chars FROM d),
e AS (SELECT *, left(t, n_chars - n_chars // 3) || left(nt, n_chars // 3) AS et FROM n),
f AS (SELECT *, {_TREE.format('t', merkle.LEAF)} AS a, {_TREE.format('et', merkle.LEAF)} AS b, {_TREE.format('nt', merkle.LEAF)} AS c FROM e),
g AS (SELECT *, {_LEAVES.format('a')} AS la, {_LEAVES.format('b')} AS lb, {_LEAVES.format('c')} AS lc, list_transform(b, lambda s: {_BRANCH}) AS sections_b,
  flatten(list_transform(b, lambda s: list_transform(s, lambda p: {_PARAGRAPH.format('p')}))) AS paragraphs_b FROM f)
SELECT doc_id, n_chars, sha256(et) AS edited_sha256, {_PRINT.format('a')} AS fingerprint, {_PRINT.format('b')} AS edited_fingerprint,
  {_LIKE.format('la', 'lb')} AS near_edited, {_LIKE.format('la', 'lc')} AS near_next, {_DIFFERING} AS differing
FROM g
"""


def byte_bpe_json() -> str:
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return file.read()


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe_json(), public_tokenizers.PATTERN, most=1024)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), encoding="ascii") as file:
        ranks = bpe.read_ranks(file.read())
    return bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, with_ids=False)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    found = quality.grade(docs.select("doc_id", "text"), quality.train(docs, labels))
    kept = F.coalesce(F.col("tail_probability") >= 0.5, F.lit(True)).cast("int").alias("kept")
    return found.select("doc.doc_id", labelled.held_out(F.col("doc.doc_id")).alias("held_out"), "expected_grade", "tail_probability", kept)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"), runtime.new_path(spark, "archives"), least_bytes=100)


OP10_SQL = """
WITH p AS (SELECT DISTINCT page_id, encode(coalesce(html, '')) AS payload FROM pages WHERE page_id IS NOT NULL),
q AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to
FROM q
"""



def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        pieces = file.read()
    return alignment.align(table(spark, sf_dir, "documents"), byte_bpe_json(), pieces)[0]


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(table(spark, sf_dir, "documents"), distance=2, width=3)


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    leaf = lambda n_chars: manifest.digest(manifest.written(F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    # a row that isn't tampered with keeps its leaf and needs no second one
    tampered = F.when(hit & F.col("n_chars").isNotNull(), leaf(F.col("n_chars") + 1))
    found = manifest.manifest(docs, leaf(F.col("n_chars")), "doc_id", "lang", carried={"tampered": tampered})
    again = found.withColumn("folded_root", manifest.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return again.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))



_WRITTEN = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_WRITTEN.format(c) for c in ("doc_id", "source", "lang", "{0}", "text")) + ")"
_CRC32 = """xor(list_reduce(list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT),
  lambda x, c: list_reduce(range(8), lambda y, i: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END, xor(x, c)), 4294967295), 4294967295)"""
_LEVELS = """SELECT tree, 0 AS level, place, {0} AS digest, count(*) OVER (PARTITION BY tree) AS size FROM {1}
  UNION ALL SELECT tree, level + 1, place // 2, sha256(string_agg(digest, '' ORDER BY place)), any_value((size + 1) // 2) FROM {2} WHERE size > 1 GROUP BY tree, level, place // 2"""
_SIBLINGS = """SELECT p.{0}, p.level + {3} AS step, CASE WHEN s.digest IS NULL THEN '-' WHEN s.place < p.at THEN 'L' || s.digest ELSE 'R' || s.digest END AS sibling
  FROM (SELECT x.{0}, x.tree, n.level, x.place >> n.level AS at FROM {1} x JOIN (SELECT DISTINCT tree, level FROM {2} WHERE size > 1) n USING (tree)) p
  LEFT JOIN {2} s ON s.tree = p.tree AND s.level = p.level AND s.place = xor(p.at, 1)"""
OP13_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_LEAF.format('n_chars')} AS leaf, {_LEAF.format('(n_chars + 1)')} AS changed, {_CRC32.format('doc_id::VARCHAR')} % 7 = 0 AS hit, row_number() OVER () AS id FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
nodes AS ({_LEVELS.format('leaf', 'leaves', 'nodes')}),
tops AS (SELECT '' AS tree, tree AS under, digest, row_number() OVER (ORDER BY tree) - 1 AS place FROM nodes WHERE size = 1),
upper AS ({_LEVELS.format('digest', 'tops', 'upper')}),
steps AS (
  {_SIBLINGS.format('id', 'leaves', 'nodes', 0)}
  UNION ALL SELECT id, step, sibling FROM leaves l JOIN ({_SIBLINGS.format('under', 'tops', 'upper', 1000)}) u ON u.under = l.tree),
proofs AS (SELECT id, list(sibling ORDER BY step) AS proof FROM steps GROUP BY id),
found AS (
  SELECT doc_id, leaf, t.digest AS subroot, (SELECT digest FROM upper WHERE size = 1) AS root, coalesce(proof, []) AS proof, CASE WHEN hit THEN changed ELSE leaf END AS given
  FROM leaves l JOIN tops t ON t.under = l.tree LEFT JOIN proofs USING (id)),
folded AS (
  SELECT *, sha256(array_to_string(list_transform(proof, lambda x: CASE WHEN x = '-' THEN '' ELSE x[2:] END), '')) AS proof_sha256,
    list_reduce(proof, lambda own, x: sha256(CASE x[1] WHEN 'L' THEN x[2:] || own WHEN 'R' THEN own || x[2:] ELSE own END), given) AS folded_root
  FROM found)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""


QUERIES = {"op1_toxicity": op1_toxicity, "op2_line_dedup": op2_line_dedup, "op3_near_duplicates": op3_near_duplicates, "op4_substring_dedup": op4_substring_dedup, "op5_exact_topk": op5_exact_topk, "op6_merkle": op6_merkle, "op7_packing": op7_packing, "op8_byte_bpe": op8_byte_bpe, "op9_quality": op9_quality, "op10_warc": op10_warc, "op11_alignment": op11_alignment, "op12_simhash": op12_simhash, "op13_manifest": op13_manifest}
ORACLES = {"op4_substring_dedup": OP4_SQL, "op5_exact_topk": OP5_SQL, "op6_merkle": OP6_SQL, "op10_warc": OP10_SQL, "op13_manifest": OP13_SQL}
