"""One query for each training-data operator, and its SQL where SQL can say it."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, LongType, StringType, StructType

from riskframe.llm import (alignment, decontaminate, langid, linededup, neardup, pieces, pii, prefixtrie, revisits,
                           sharding, tokencounts, topk, toxicity)
from riskframe.llm.common import held_out, read_table

#: Place of the SentencePiece model; a file outside the repository.
MODEL_FILE = os.environ.get("RISKFRAME_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")

#: Folder of the tokenizer files; where it is unset, the installed ``public_tokenizers`` names it.
TOKENIZER_DIR = os.environ.get("RISKFRAME_TOKENIZERS")


def tokenizer_path(name: str) -> str:
    if TOKENIZER_DIR:
        return os.path.join(TOKENIZER_DIR, name)
    import public_tokenizers
    return str(public_tokenizers.path(name))


def piece_ids(docs: DataFrame) -> DataFrame:
    """doc_id, n_pieces, ids and whether they decode to the text."""
    encoded = pieces.encode(docs.select("doc_id", "text"), MODEL_FILE, lossless="lossless")
    return encoded.select("doc_id", F.coalesce(F.array_size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids", "lossless")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled ids of every whole text, their number, and whether they decode to the text."""
    return piece_ids(read_table(spark, sf_dir, "documents"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_matches(docs, read_table(spark, sf_dir, "benchmark"))
    schema = (StructType().add("doc_id", LongType()).add("n_words", LongType()).add("n_hit", LongType())
              .add("n_items", LongType()).add("items_sha256", StringType()).add("contaminated", BooleanType()))

    def digests(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            words, hits, items = (batch.column(c).to_pylist() for c in ("n_words", "n_hit", "items"))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(hits, pa.int64()),
                pa.array([len(i) for i in items], pa.int64()), pa.array([decontaminate.items_digest(i) for i in items]),
                pa.array([h > 0 for h in hits])], schema=arrow)

    return found.select("doc_id", "contamination.n_words", "contamination.n_hit",
                        F.array_distinct("contamination.matches.item_id").alias("items")).mapInArrow(digests, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.learn(docs, read_table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return toxicity.score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out(F.col("doc_id"))
    found = langid.identify(docs, langid.learn_dictionaries(docs, ~held), held)
    return found.withColumnRenamed("key", "doc_id")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.find(docs, pii.learn(docs))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs, counts=True).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_kept").alias("n_kept"), "text")


def capture_records(pages: DataFrame) -> DataFrame:
    """Capture records of the pages: each page is a full response at time
    1000 * page_id, and is asked for again after a while (by its URL's
    digest, up to 5,000 pages later) with its entity tag, not modified."""
    tag = F.md5(F.col("html"))
    again = F.col("page_id") * 1000 + 1 + F.conv(F.substring(F.md5("url"), 1, 8), 16, 10).cast("long") % 5_000_000
    date = lambda at: F.concat(F.lit("t"), at.cast("string"))
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 1000).alias("ts"), F.lit(200).alias("status"),
        tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"),
                     F.octet_length("html").cast("string"), F.lit("Date"), date(F.col("page_id") * 1000)).alias("headers"))
    revisit = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", again.alias("ts"), F.lit(304).alias("status"),
        tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("DATE"), date(again), F.lit("Cache-Control"), F.lit("max-age=60"),
                     F.lit("Content-Length"), F.lit("0")).alias("headers"))
    return full.unionByName(revisit)


def op8_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve_revisits(capture_records(read_table(spark, sf_dir, "pages")))
    written = F.array_join(F.transform(F.array_sort(F.map_entries("headers")),
                                       lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return found.select("record_id", "canonical", "ts", "response_id", "resolution", written.alias("headers"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), n_shards=8)


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokencounts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > 2048)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokens(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                                  tokenizer_path("piece_bpe_32k.model"))


def rebuilt_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): conversation c gets the first h = crc32(c) % 4 original
    turns of conversation c - c % 20 in the place of its own first h."""
    own = prefixtrie.conversation_turns(turns)
    heads = own.filter("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    joined = own.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % 20}).join(heads, "base", "left")
    nothing = F.slice("turns", 1, 0)
    first = F.coalesce(F.slice("head", F.lit(1), F.col("h")), nothing)
    rest = F.when(F.size("turns") > F.col("h"), F.slice("turns", F.col("h") + 1, F.size("turns"))).otherwise(nothing)
    return joined.select("conv_id", F.concat(first, rest).alias("turns"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(rebuilt_conversations(read_table(spark, sf_dir, "conversations")))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_exact_topk, op3_decontamination, op4_toxicity, op5_language,
                                   op6_pii, op7_line_dedup, op8_revisits, op9_sharding, op10_minhash,
                                   op11_token_counts, op12_token_alignment, op13_prefix_trie)}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE = {
    "op2_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
                   FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT a.vec_id AS query_id, b.vec_id,
                     CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
              FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op3_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
        i AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
        iw AS (SELECT DISTINCT item_id, least(10, len(w)) AS n,
                      array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS win
               FROM (SELECT item_id, w, unnest(range(1, CAST(len(w) - least(10, len(w)) + 2 AS BIGINT))) AS p
                     FROM i WHERE len(w) > 0)),
        lens AS (SELECT DISTINCT n FROM iw),
        dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS win
               FROM (SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS p
                     FROM d, lens WHERE len(w) >= n)),
        hit AS (SELECT dw.doc_id, dw.n, dw.p, iw.item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
        words AS (SELECT doc_id, count(DISTINCT q) AS n_hit
                  FROM (SELECT DISTINCT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
                  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_line_dedup": r"""
        WITH l AS (SELECT doc_id, no, line, trim(line, ' ' || chr(9) || chr(13)) AS t
                   FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                                unnest(range(len(string_split(text, chr(10))))) AS no FROM documents WHERE text IS NOT NULL)),
        u AS (SELECT t, length(t) AS n, min((doc_id, no)) AS place FROM l WHERE t <> '' GROUP BY t),
        p AS (SELECT place, t, n, unnest(range(CAST(n AS BIGINT))) AS k FROM u WHERE n >= 10),
        v AS (SELECT place, n, k, md5(substr(t, 1, k) || substr(t, k + 2)) AS h FROM p),
        one AS (SELECT h, k, min(place) AS least_place FROM v GROUP BY h, k),
        near AS (SELECT v.place FROM v JOIN one USING (h, k) WHERE one.least_place < v.place
                 UNION SELECT v.place FROM v JOIN u ON md5(u.t) = v.h WHERE u.n >= 10 AND u.place < v.place
                 UNION SELECT u.place FROM u JOIN v ON md5(u.t) = v.h WHERE u.n >= 10 AND v.place < u.place),
        kept AS (SELECT l.* FROM l WHERE t = '' UNION ALL
                 SELECT l.* FROM l JOIN u ON l.t = u.t AND (l.doc_id, l.no) = u.place
                 WHERE u.place NOT IN (SELECT place FROM near)),
        out AS (SELECT doc_id, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY no) AS text FROM kept GROUP BY doc_id)
        SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS BIGINT) AS n_lines,
               CAST(coalesce(n_kept, 0) AS BIGINT) AS n_kept,
               CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(out.text, '') END AS text
        FROM documents d LEFT JOIN out USING (doc_id)""",
    "op8_revisits": r"""
        WITH a AS (SELECT *, regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS u FROM pages),
        b AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(u, '^[^/?]*')), ':(80|443)$', ''), '^(www|m)\.', '') AS host,
                     regexp_replace(u, '^[^/?]*', '') AS r0 FROM a),
        c AS (SELECT *, regexp_replace(regexp_replace(r0, '([?&])(utm_[a-z]+|ref)=[^&]*', '\1', 'g'), '&&+', '&', 'g') AS r1 FROM b),
        k AS (SELECT page_id, html, url, host || regexp_replace(regexp_replace(replace(r1, '?&', '?'), '[?&]+$', ''), '/+$', '') AS canonical FROM c),
        f AS (SELECT page_id * 2 AS response_id, canonical, page_id * 1000 AS rts, md5(html) AS tag, strlen(html) AS size FROM k),
        g AS (SELECT page_id * 2 + 1 AS record_id, canonical, md5(html) AS tag,
                     page_id * 1000 + 1 + CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) % 5000000 AS ts FROM k),
        j AS (SELECT g.*, f.response_id, f.tag AS rtag, f.size FROM g ASOF LEFT JOIN f ON g.canonical = f.canonical AND g.ts > f.rts)
        SELECT record_id, canonical, ts, response_id,
               CASE WHEN response_id IS NULL THEN 'no_response' WHEN tag = rtag THEN 'resolved' ELSE 'changed' END AS resolution,
               CASE WHEN tag = rtag THEN 'cache-control=max-age=60; content-length=' || size
                    || '; content-type=text/html; date=t' || ts END AS headers
        FROM j""",
    "op13_prefix_trie": r"""
        WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
                            lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
        c AS (SELECT conv_id, xor(list_reduce(
                     list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
                     lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 4 AS h
              FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc),
        s AS (SELECT conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS m,
                     len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
              FROM conversations WHERE conv_id IS NOT NULL),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, m) AS pos FROM s),
        b AS (SELECT c.conv_id, 0 AS part, pos, m, words FROM c JOIN o ON o.conv_id = c.conv_id - c.conv_id % 20 AND pos <= h
              UNION ALL SELECT conv_id, 1, pos, m, words FROM c JOIN o USING (conv_id) WHERE pos > h),
        r AS (SELECT conv_id, m, words, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d FROM b),
        p AS (SELECT conv_id, d, words, md5(string_agg(m, '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING)) AS node FROM r
              UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
        n AS (SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM p GROUP BY node, d),
        up AS (SELECT n.node, n.d, q.node AS above FROM n JOIN p q ON q.conv_id = n.conv_id AND q.d = n.d - 1),
        kids AS (SELECT above AS node, count(*) AS n_children FROM up GROUP BY above),
        x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (node)),
        sub AS (SELECT p.node, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.words) AS saved
                FROM x JOIN p ON p.conv_id = x.conv_id AND p.d <= x.d GROUP BY p.node),
        ends AS (SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ids
                 FROM (SELECT conv_id, arg_max(node, d) AS node FROM p GROUP BY conv_id) GROUP BY node)
        SELECT x.conv_id, CAST(x.d AS BIGINT) AS depth, a.conv_id AS parent_conv_id, x.n_convs, x.n_children,
               CAST(sub.n_leaves AS BIGINT) AS n_leaves, CAST(sub.saved AS BIGINT) AS saved_tokens,
               sha256(coalesce(ids, '')) AS ends_sha256
        FROM x JOIN sub USING (node) LEFT JOIN up USING (node) LEFT JOIN x a ON a.node = up.above LEFT JOIN ends ON ends.node = x.node""",
}
