"""The queries of this folder's operators, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _total(starts: str, ends: str):
    return F.aggregate(F.zip_with(starts, ends, lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_array_dedup

    out = suffix_array_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", _total("starts", "ends").alias("n_removed"), F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    out = substring_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", _total("starts", "ends").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    out = line_dedup(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op4_warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives go to a folder of their own in the shared folder."""
    from . import tables, warc

    folder = f"{tables.shared_dir(spark)}/tideglass/warc-{uuid.uuid4().hex}"
    tables.make_folder(spark, folder)
    archives = warc.write_warc(read(spark, sf_dir, "pages"), folder)
    records = warc.read_warc(archives, folder)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def document_path():
    """Documents carry no paths: the source stands for a repository, and the digits of the id for directories in it."""
    digits = F.lpad(F.coalesce(F.col("doc_id"), F.lit(0)).cast("string"), 12, "0")
    return F.concat_ws("/", F.coalesce("source", F.lit("none")), F.substring(digits, 1, 8), F.substring(digits, 9, 2), F.concat(digits, F.lit(".txt")))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import licence_scan

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", document_path().alias("path"))
    return licence_scan(docs)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0
    model = langid.fit(docs.where(~F.coalesce(held_out, F.lit(False))))
    out = langid.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import benchmark_hits

    out = benchmark_hits(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    hit = _total("starts", "ends")
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.encode(F.array_join("items", ","), "UTF-8"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op9_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .syncmers import as_text, edited_neighbours, likeness

    out = edited_neighbours(read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), as_text(F.col("anchors")).alias("fingerprint"), as_text(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"), likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )


def op10_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    from .pieces import piece_ids

    out = piece_ids(read(spark, sf_dir, "documents"), model or piece_model())
    return out.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "UTF-8"), 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def op11_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import merkle

    docs = read(spark, sf_dir, "documents")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    changed = merkle.sha(merkle.record(tuple(merkle.lower_ascii("text") if c == "text" else c for c in merkle.FIELDS)))
    out = merkle.manifest(docs, {"changed": F.when(tampered, changed)})
    out = out.withColumn("now", F.coalesce("changed", "leaf")).withColumn("folded_root", merkle.folded("now"))
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.proof().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranking import ranked_search

    return ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def piece_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_suffix_array_dedup, op2_substring_dedup, op3_line_dedup, op4_warc_zstd, op5_minhash_near_dedup, op6_licence_scan, op7_language_id, op8_decontamination, op9_syncmer_fingerprints, op10_sentencepiece, op11_source_mixing, op12_merkle_manifest, op13_ranked_search)}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
PLAIN_WORDS = r"[^\x20\x09-\x0D]+"
BENCH_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _merkle_sql(levels: int = 7) -> str:
    """The tree level by level, for up to 8**levels documents of a language and as many languages; each level's proof steps are folded in as they come."""
    fields = lambda text: " || ".join(f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen({x}::VARCHAR) || ':' || {x} END" for x in ("doc_id", "source", "lang", "n_chars", text))
    # CRC-32 bit by bit: each byte enters before the first of its eight shifts
    byte = "CASE WHEN k % 8 = 0 THEN xor(c, ascii(i[k // 8 + 1])::BIGINT) ELSE c END"
    crc = f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * strlen(i))), lambda c, k: xor(({byte}) // 2, 3988292384 * (({byte}) % 2))))"
    step = lambda a, n: f"""{a}n AS (SELECT g, p, n, d, sub, coalesce(string_agg(d, '') OVER (PARTITION BY g, p // 8 ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(d, '') OVER (PARTITION BY g, p // 8 ORDER BY p ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {a})"""  # noqa: E731
    up = lambda a, b, g: f"{b} AS (SELECT g, p // 8 AS p, (any_value(n) + 7) // 8 AS n, sha256(string_agg(d, '' ORDER BY p)) AS d, NULL::VARCHAR AS sub FROM {a} WHERE n > 1 GROUP BY 1, 2 UNION ALL SELECT * FROM {a} WHERE n = 1)"
    climb = lambda f, a, h, g: f"{h} AS (SELECT f.* EXCLUDE (p, now, proof), CASE WHEN n > 1 THEN f.p // 8 ELSE f.p END AS p, CASE WHEN n > 1 THEN sha256(l || now || r) ELSE now END AS now, CASE WHEN n > 1 THEN proof || l || r ELSE proof END AS proof FROM {f} f JOIN {a}n a ON f.{g} = a.g AND f.p = a.p)"
    parts = [
        f"b AS (SELECT doc_id, coalesce('g' || lang, '-') AS g, sha256({fields('text')}) AS d, CASE WHEN {crc} % 3 = 0 THEN sha256({fields(f"translate(text, '{UPPER}', '{LOWER}')")}) ELSE sha256({fields('text')}) END AS now FROM (SELECT *, doc_id::VARCHAR AS i FROM documents))",
        "x AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS p, count(*) OVER (PARTITION BY g) AS n FROM b)",
        "a0 AS (SELECT g, p, n, d, NULL::VARCHAR AS sub FROM x)", "f0 AS (SELECT doc_id, g, d AS leaf, p, now, '' AS proof FROM x)",
    ]
    for k in range(levels):
        parts += [step(f"a{k}", k), up(f"a{k}", f"a{k + 1}", "g"), climb(f"f{k}", f"a{k}", f"f{k + 1}", "g")]
    parts += [f"t0 AS (SELECT '-' AS g, row_number() OVER (ORDER BY g) - 1 AS p, count(*) OVER () AS n, d, g AS sub FROM a{levels})", f"h0 AS (SELECT doc_id, '-' AS top, leaf, t0.d AS subroot, t0.p, now, proof FROM f{levels} f JOIN t0 ON f.g = t0.sub)"]
    for k in range(levels):
        parts += [step(f"t{k}", k), up(f"t{k}", f"t{k + 1}", "g"), climb(f"h{k}", f"t{k}", f"h{k + 1}", "top")]
    return f"WITH {', '.join(parts)} SELECT doc_id, leaf, subroot, t.d AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = t.d AS verified FROM h{levels}, t{levels} t"


ORACLE_SQL: dict[str, str] = {
    "op2_substring_dedup": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{PLAIN_WORDS}') AS w FROM documents),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM s) WHERE n > 1),
x AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM g)),
y AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
z AS (SELECT y.doc_id, count(*) AS n_words, count(x.p) AS n_removed, string_agg(word, ' ' ORDER BY y.p) FILTER (x.p IS NULL) AS kept FROM y LEFT JOIN x ON y.doc_id = x.doc_id AND y.p = x.p GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN z USING (doc_id)""",
    "op3_line_dedup": f"""
WITH l AS (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents)),
k AS (SELECT *, translate(trim(line, {BLANKS}), '{UPPER}', '{LOWER}') AS k FROM l),
g AS (SELECT k, max(doc_id) AS m FROM k WHERE length(k) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
f AS (SELECT k.*, g.k IS NULL OR doc_id = m AS keep FROM k LEFT JOIN g USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keep), '')) AS kept_sha256 FROM f GROUP BY 1""",
    "op4_warc_zstd": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first_id FROM p),
r AS (SELECT *, strlen(h) >= 1000 AND page_id <> first_id AS again FROM m)
SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first_id END AS refers_to FROM r""",
    "op5_minhash_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{PLAIN_WORDS}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * both_ >= 75 * (x.n + y.n - both_)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT m.doc_id, coalesce(n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)""",
    "op8_decontamination": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BENCH_WORDS}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BENCH_WORDS}') AS w FROM benchmark),
t AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT n FROM t),
s AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, z WHERE len(w) >= n)),
h AS (SELECT doc_id, i, s.n, item FROM s JOIN t USING (n, k)),
x AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY 1),
y AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)""",
    "op11_source_mixing": rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{PLAIN_WORDS}')), 0) AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY 1),
r AS (SELECT *, 2 * source_size AS top, 1.5 * sum(source_size) OVER () AS budget, sum(w) OVER () AS all_w, coalesce(sum(2 * source_size) OVER b, 0) AS top0, coalesce(sum(w) OVER b, 0) AS w0
      FROM s WINDOW b AS (ORDER BY 2 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, CASE WHEN top > (budget - top0) / (all_w - w0) * w THEN (budget - top0) / (all_w - w0) END AS level FROM r),
m AS (SELECT source, source_size, CASE WHEN level IS NULL THEN top ELSE max(level) OVER () * w END AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN round(target / source_size * 16777216)::BIGINT ELSE 0 END AS rate, ('0x' || substr(md5('11/' || coalesce('a' || source, 'b')), 1, 6))::BIGINT AS start FROM m),
n AS (SELECT d.*, p.source_size::BIGINT AS source_size, target, start, rate, row_number() OVER (PARTITION BY d.source ORDER BY size DESC, doc_id NULLS FIRST) AS i FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, size * ((start + rate * i) // 16777216 - (start + rate * (i - 1)) // 16777216) AS taken FROM n""",
    "op12_merkle_manifest": _merkle_sql(),
    "op13_ranked_search": rf"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERMS}')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERMS}')) AS term FROM benchmark),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1), z AS (SELECT count(*)::BIGINT AS all_n, sum(n)::BIGINT AS all_l FROM n),
f AS (SELECT doc_id, term, count(*) AS tf FROM d SEMI JOIN q USING (term) GROUP BY 1, 2),
w AS (SELECT term, floor(1000 * ln((2.0 * any_value(all_n)::DOUBLE + 2) / (2.0 * count(*)::DOUBLE + 1)))::BIGINT AS w FROM f, z GROUP BY 1),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * all_n) // all_l))))::BIGINT AS score FROM q JOIN f USING (term) JOIN w USING (term) JOIN n USING (doc_id), z GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10""",
}
