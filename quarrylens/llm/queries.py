"""The operators' queries with their production parameters, and their SQL where there is any."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversation_trie, decontam, jpeg, pii, quality, sentence_pieces, sharding, simhash, spelling, suffix_dedup, token_files, wrapper
from .common import read, shared_path

RANKS, TOKENIZER, PIECES, END_ID = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model", 2


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jpeg.from_media(jpeg.to_media(read(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "rgb_sha256")


def op6_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wrapper.extract(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_template")


def op7_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.PATTERN, END_ID, shared_path(spark, "tokens"))
    found = token_files.read_tokens(spark, files)
    return found.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.write_shards(read(spark, sf_dir, "documents"), shared_path(spark, "shards"), shards=24)
    return rows.select(
        "doc_id",
        sharding.row_bytes().alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def token_digests(ranks: dict[bytes, int]) -> Callable[[pa.Table], pa.Table]:
    """Adds n_tokens, ids_sha256 and decoded_sha256 to a table with ids."""
    pieces = bpe.piece_list(ranks)

    def digests(table: pa.Table) -> pa.Table:
        names = [str(k) for k in range(len(pieces))]
        counts, coded, plain = [], [], []
        for x in table["ids"]:  # one document's ids as Python numbers at a time
            ids = x.values.to_numpy().tolist()
            counts.append(len(ids))
            coded.append(hashlib.sha256(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
            plain.append(hashlib.sha256(bpe.decode(ids, pieces)).hexdigest())
        return table.append_column("n_tokens", pa.array(counts, pa.int64())).append_column("ids_sha256", pa.array(coded, pa.string())).append_column("decoded_sha256", pa.array(plain, pa.string()))

    return digests


DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(public_tokenizers.path(RANKS))
    digests = token_digests(ranks)
    return bpe.encode(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, then=lambda x: digests(x).drop_columns(["ids"]), schema=f"doc_id long, {DIGESTS}")


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = quality.scored(docs, quality.train(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", (~quality.learnable("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= quality.PASS, 1).otherwise(0).alias("predicted"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(read(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.digest(pii.KINDS).cast("binary"), 256).alias("base_sha256"), pii.digest((*pii.KINDS, pii.FOUND)).alias("spans"))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.nodes(read(spark, sf_dir, "conversations"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = sentence_pieces.load_pieces(public_tokenizers.path(PIECES))

    def digests(table: pa.Table) -> pa.Table:
        names, decode = [str(k) for k in range(len(pieces.surfaces))], sentence_pieces.Decoder(pieces)
        lists = [x.values.to_numpy() for x in table["ids"]]
        coded = [hashlib.sha256(" ".join(map(names.__getitem__, x.tolist())).encode()).hexdigest() for x in lists]
        plain = [hashlib.sha256(decode(x)).hexdigest() for x in lists]
        return pa.table({"doc_id": table["doc_id"], "n_tokens": pa.array(map(len, lists), pa.int64()), "ids_sha256": pa.array(coded), "decoded_sha256": pa.array(plain)})

    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return sentence_pieces.encode(rows, pieces, then=digests, schema=f"doc_id long, {DIGESTS}")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontam": op1_decontam,
    "op2_suffix": op2_suffix,
    "op3_quality": op3_quality,
    "op4_simhash": op4_simhash,
    "op5_media": op5_media,
    "op6_wrapper": op6_wrapper,
    "op7_tokens": op7_tokens,
    "op8_sharding": op8_sharding,
    "op9_bpe": op9_bpe,
    "op10_pii": op10_pii,
    "op11_trie": op11_trie,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_spelling": op13_spelling,
}
WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: The CRC-32 of a column of texts s, by the bytes of its table.
CRC_TABLE = """crc AS (SELECT list(c ORDER BY k) AS t FROM (SELECT k, list_reduce([k::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c FROM range(256) AS r(k)))"""
CRC = "xor(list_reduce([4294967295::UBIGINT] || list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::UBIGINT), lambda c, b: xor(c >> 8, t[((xor(c, b) & 255) + 1)::BIGINT])), 4294967295::UBIGINT)"

#: The other operators' results need hashes, codecs, fits or iterations that SQL lacks; tests/llm holds them against brute force.
SQL: dict[str, str] = {
    "op1_decontam": f"""
WITH d AS (SELECT doc_id, coalesce({WORDS}, []) AS w FROM documents), i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
iw AS (SELECT item_id, 10 AS m, array_to_string(w[k:k + 9], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 8)) AS k FROM i WHERE len(w) >= 10)
UNION SELECT item_id, len(w), array_to_string(w, ' ') FROM i WHERE len(w) BETWEEN 1 AND 9),
dw AS (SELECT doc_id, m, k, array_to_string(w[k:k + m - 1], ' ') AS s FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
h AS (SELECT doc_id, k, dw.m AS m, item_id FROM dw JOIN iw ON dw.m = iw.m AND dw.s = iw.s),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + m)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS x FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(x, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op2_suffix": """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM b)),
f AS (SELECT doc_id, p FROM w JOIN (SELECT s, min(doc_id) AS first FROM w GROUP BY s) USING (s) WHERE first < doc_id),
g AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS n FROM f),
r AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM (SELECT doc_id, p, sum(n) OVER (PARTITION BY doc_id ORDER BY p) AS i FROM g) GROUP BY doc_id, i),
k AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM r),
t AS (SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM k JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM b LEFT JOIN t USING (doc_id)""",
    "op11_trie": f"""
WITH {CRC_TABLE},
t AS (SELECT conv_id, length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '') AS s, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS w, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(s ORDER BY turn NULLS FIRST, sha256(s)) AS a, list(w ORDER BY turn NULLS FIRST, sha256(s)) AS ws FROM t GROUP BY conv_id),
h AS (SELECT conv_id, a, ws, ({CRC} % 4)::BIGINT AS h FROM (SELECT conv_id, a, ws, hex(encode(conv_id::VARCHAR)) AS h FROM o), crc),
b AS (SELECT h.conv_id, coalesce(b.a[1:h.h], []) || h.a[h.h + 1:] AS a, coalesce(b.ws[1:h.h], []) || h.ws[h.h + 1:] AS ws FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 20),
p AS (SELECT conv_id, d, sha256(array_to_string(list_transform(a[1:d], lambda x: sha256(x)), ',')) AS k, sha256(array_to_string(list_transform(a[1:d - 1], lambda x: sha256(x)), ',')) AS up, CASE WHEN d > 0 THEN ws[d] ELSE 0 END AS w, len(a) = d AS last FROM (SELECT conv_id, a, ws, unnest(range(0, len(a) + 1)) AS d FROM b)),
n AS (SELECT k, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) * (count(*) - 1) AS own, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256 FROM p GROUP BY k, d),
c AS (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
s AS (SELECT a.k, a.d, count(*) FILTER (e.n_children IS NULL) AS n_leaves, sum(u.own)::BIGINT AS saved_tokens FROM n u LEFT JOIN c e ON e.k = u.k AND e.d = u.d JOIN p x ON x.conv_id = u.conv_id AND x.d <= u.d JOIN n a ON a.k = x.k AND a.d = x.d GROUP BY a.k, a.d)
SELECT n.conv_id, n.d AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s ON s.k = n.k AND s.d = n.d LEFT JOIN c ON c.k = n.k AND c.d = n.d LEFT JOIN n m ON m.k = n.up AND m.d = n.d - 1""",
    "op13_spelling": f"""
WITH RECURSIVE {CRC_TABLE},
a AS (SELECT doc_id, s, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]{{6,}}')) AS s FROM documents) GROUP BY ALL),
b AS (SELECT s, n, {CRC} AS k FROM (SELECT s, n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || s)) AS h FROM a), crc),
v AS (SELECT word, sum(n)::BIGINT AS n FROM (SELECT n, CASE WHEN k % 199 = 0 THEN substr(s, 1, (k % length(s))::BIGINT) || substr(s, (k % length(s))::BIGINT + 2) ELSE s END AS word FROM b) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS cut FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)),
e AS (SELECT x.word AS word, y.word AS other FROM d x JOIN d y ON x.p = y.p AND x.cut = y.cut AND x.word <> y.word UNION SELECT d.word, v.word FROM d JOIN v ON d.cut = v.word UNION SELECT v.word, d.word FROM d JOIN v ON d.cut = v.word),
m AS (SELECT e.word, count(*) AS n_near, first(e.other ORDER BY o.n DESC, encode(e.other)) AS best, max(o.n) AS best_n FROM e JOIN v o ON o.word = e.other GROUP BY e.word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * n THEN best END AS form, CASE WHEN best_n >= 5 * n THEN best_n END AS form_n FROM v LEFT JOIN m USING (word)),
r AS (SELECT word, coalesce(form, word) AS at FROM f UNION SELECT r.word, f.form FROM r JOIN f ON f.word = r.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, r.at AS root, f.n, f.n_near, f.form_n FROM f JOIN r USING (word) JOIN f g ON g.word = r.at WHERE g.form IS NULL""",
}
