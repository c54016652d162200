"""Queries over the driver's tables: thin projections of the operators, and SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import embedding_dedup, exact_dedup, mixing, ngram_join, packing, periodic_runs, pii, secret_scan, substring_dedup, suffix_dedup, toxicity, vector_codes, warc
from .common import table, text_of, word_count


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select(F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    own = read.select("page_id", "record_type", "refers_to", F.col("digest").alias("payload_digest"), F.octet_length("payload").cast("long").alias("_bytes"))
    # An id may repeat with other payloads, so the length is that of the response with the same digest.
    full = own.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("_bytes").alias("_full")).distinct()
    return own.join(full, ["refers_to", "payload_digest"], "left").select(
        "page_id", F.when(F.col("record_type") == "revisit", F.col("_full")).otherwise(F.col("_bytes")).alias("payload_bytes"),
        "payload_digest", "record_type", "refers_to",
    )


def _is_kind(kind: str):
    return lambda x: x["kind"] == kind


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["kind"].isin(*pii.BASE_KINDS))
    counts = [F.size(F.filter("found", _is_kind(k))).cast("long").alias(f"n_{k}") for k in pii.BASE_KINDS]
    added = F.size("found").cast("long").alias("n_spans")
    scores = F.array_join(F.transform("found", lambda x: F.format_number(x["score"], 2)), ",").alias("scores")
    return found.select("doc_id", *counts, added, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("found")).alias("spans"), scores)


def op7_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), with_ids=False)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.label_duplicates(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    # One document in ten is read as repeats of some of its words.
    docs = docs.select("doc_id", "text", F.floor(F.col("h") / 10).alias("g"), F.when(F.col("h") % 10 == 0, word_count(text_of())).alias("n")).withColumn("n", F.when(F.col("n") > 0, F.col("n")))
    docs = docs.withColumn("a", F.col("g") % F.col("n"))
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)))
    found = periodic_runs.find_runs(docs, tandem=(F.col("a"), F.col("p")))
    most = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    found = found.select("doc_id", "runs", "collapsed", most.alias("most"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"))
    period = -F.col("most.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("most.start")).alias("start"), F.col("most.length").alias("length"), period.alias("period"),
        F.floor(1000 * F.col("most.length") / period).alias("exponent_milli"), "runs_sha256", F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    code = F.lower(F.array_join(F.transform("code", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    return rows.select("vec_id", code.alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: ~x["checked"])
    counts = [F.size(F.filter("found", _is_kind(k))).cast("long").alias(f"n_{k}") for k in secret_scan.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("found")).alias("spans"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_suffix_array_dedup, op2_embedding_near_dedup, op3_substring_dedup, op4_mix_sources, op5_warc_round_trip, op6_personal_data, op7_pack_sequences, op8_toxicity, op9_ngram_jaccard_join, op10_exact_dedup,
        op11_periodic_runs, op12_vector_codes, op13_secret_scan,
    )
}


def _codebook_rounds(rounds: int = 4) -> str:
    """DuckDB SQL of op12: books b0, b1 and so on, each from the one before."""
    near = """n{i} AS MATERIALIZED (SELECT v.row, v.part, min(struct_pack(d := v.xx - 2 * list_inner_product(v.x, b.x) + list_inner_product(b.x, b.x), e := b.entry)) AS best
              FROM s v JOIN b{i} b USING (part) GROUP BY 1, 2)"""
    book = """b{j} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{i} b LEFT JOIN (
                SELECT part, entry, list(mean ORDER BY k) AS x FROM (
                  SELECT part, entry, k, CAST(floor(sum(c) / count(*)) AS DOUBLE) AS mean
                  FROM (SELECT n.part, n.best.e AS entry, unnest(s.x) AS c, generate_subscripts(s.x, 1) AS k FROM n{i} n JOIN s USING (row, part)) GROUP BY 1, 2, 3) GROUP BY 1, 2) m USING (part, entry))"""
    return ",\n".join([f"{near.format(i=i)},\n{book.format(i=i, j=i + 1)}" for i in range(rounds)] + [near.format(i=rounds)])


ORACLES = {
    "op1_suffix_array_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
             w AS (SELECT doc_id, p, hash(substr(h, 2 * p - 1, 400)) AS k, hash(substr(h, 2 * p - 1, 400) || 'x') AS m
                   FROM (SELECT doc_id, h, unnest(generate_series(1, length(h) // 2 - 199)) AS p FROM d)),
             r AS (SELECT doc_id, p FROM w WHERE (k, m) IN (SELECT (k, m) FROM w GROUP BY k, m HAVING count(*) > 1)),
             b AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM r),
             i AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p - q > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM b),
             s AS (SELECT doc_id, g, min(p) AS a, max(p) + 199 AS z FROM i GROUP BY 1, 2),
             k AS (SELECT d.doc_id, d.h, s.a, s.z, coalesce(lag(s.z) OVER (PARTITION BY d.doc_id ORDER BY s.a), 0) AS before FROM d LEFT JOIN s ON d.doc_id = s.doc_id),
             t AS (SELECT doc_id, any_value(h) AS h, coalesce(string_agg(substr(h, 2 * before + 1, 2 * (a - 1 - before)), '' ORDER BY a), '') AS kept, coalesce(max(z), 0) AS z, coalesce(sum(z - a + 1), 0) AS gone, count(a) AS n FROM k GROUP BY 1)
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(gone AS BIGINT) AS n_removed, n AS n_spans, sha256(unhex(kept || substr(h, 2 * z + 1))) AS kept_sha256 FROM t""",
    "op2_embedding_near_dedup": """
        WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
                             WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
             l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
             r AS (SELECT vec_id AS node, vec_id AS seen FROM embeddings UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a),
             c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY 1), n AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
        SELECT node AS vec_id, coalesce(n, 0) AS n_links, component_id, node = component_id AS kept FROM c LEFT JOIN n ON node = a""",
    "op3_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
             x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i, len(w) AS n, w FROM d),
             s AS (SELECT doc_id, i, word, CASE WHEN i + 19 <= n THEN array_to_string(list_slice(w, i, i + 19), ' ') END AS k FROM x),
             f AS (SELECT *, CASE WHEN k IS NOT NULL AND row_number() OVER (PARTITION BY k ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS dup FROM s),
             g AS (SELECT *, max(dup) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
             t AS (SELECT doc_id, sum(gone) AS gone, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM g GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t ON d.doc_id = t.doc_id""",
    "op5_warc_round_trip": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
             m AS (SELECT h, min(page_id) AS first FROM p GROUP BY 1),
             j AS (SELECT p.*, first, list_transform(range(8), lambda i: CAST('0x' || substr(x, 5 * i + 1, 5) AS BIGINT)) AS parts FROM p JOIN m USING (h))
        SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(parts, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 15) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 10) % 32 + 1, 1)
                 || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (v >> 5) % 32 + 1, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', v % 32 + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM j""",
    "op9_ngram_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS t FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
             c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
             l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
             r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, l.b FROM r JOIN l ON r.seen = l.a)
        SELECT node AS doc_id, coalesce(max(n), 0) AS n_shingles, min(seen) AS component_id FROM r LEFT JOIN n ON n.doc_id = node GROUP BY 1""",
    "op10_exact_dedup": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
             g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256
        FROM d JOIN g ON d.t = g.t""",
    "op11_periodic_runs": r"""
        WITH h AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
                          xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
                                          lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS h FROM documents),
             g AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS tandem, h // 10 AS g FROM h),
             a AS (SELECT *, CASE WHEN tandem THEN g % n ELSE 0 END AS a FROM g),
             p AS (SELECT *, CASE WHEN tandem THEN 1 + (n - a) // (3 + g % 8) ELSE 1 END AS p FROM a),
             f AS (SELECT doc_id, n, CASE WHEN tandem THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % p END + 1]) ELSE w END AS w FROM p),
             x AS MATERIALIZED (SELECT doc_id, n, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM f),
             d AS (SELECT doc_id, n, unnest(range(1, n // 2 + 1)) AS p FROM f),
             -- Periods from 12 on: a run holds p words that equal the word p later, so four on a grid of step p // 4 in a row.
             q AS (SELECT doc_id, p, unnest(range(0, n - p, p // 4)) AS i FROM d WHERE p >= 12),
             e AS (SELECT q.doc_id, q.p, q.i // (q.p // 4) AS k FROM q JOIN x y ON y.doc_id = q.doc_id AND y.i = q.i JOIN x z ON z.doc_id = q.doc_id AND z.i = q.i + q.p WHERE y.word = z.word),
             c AS MATERIALIZED (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, p, k - lag(k, 3) OVER (PARTITION BY doc_id, p ORDER BY k) AS back FROM e) WHERE back = 3
                                UNION ALL SELECT doc_id, p FROM d WHERE p < 12 AND n >= 12),
             m AS (SELECT c.doc_id, c.p, y.i, y.i - row_number() OVER (PARTITION BY c.doc_id, c.p ORDER BY y.i) AS isle
                   FROM c JOIN x y ON y.doc_id = c.doc_id JOIN x z ON z.doc_id = c.doc_id AND z.i = y.i + c.p WHERE y.word = z.word),
             s AS (SELECT doc_id, p, min(i) AS start, count(*) + p AS length FROM m GROUP BY doc_id, p, isle HAVING count(*) + p >= greatest(12, 2 * p)),
             r AS MATERIALIZED (SELECT doc_id, start, length, min(p) AS period FROM s GROUP BY 1, 2, 3),
             gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM r),
             kept AS (SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS t FROM x ANTI JOIN gone ON x.doc_id = gone.doc_id AND x.i = gone.i GROUP BY 1),
             o AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t,
                          max(struct_pack(l := length, s := -start, p := -period)) AS most FROM r GROUP BY 1)
        SELECT f.doc_id, coalesce(n_runs, 0) AS n_runs, -most.s AS start, most.l AS length, -most.p AS period, CAST(1000 * most.l // -most.p AS BIGINT) AS exponent_milli,
               sha256(coalesce(o.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
        FROM f LEFT JOIN o USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op12_vector_codes": f"""
        WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, e) AS row, vec_id, label, e FROM (
                     SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(1024 * x)) AS e FROM embeddings
                     WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)),
             s AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS xx FROM (
                     SELECT row, part, list_slice(e, part * len(e) // 4 + 1, (part + 1) * len(e) // 4) AS x FROM v, (SELECT unnest(range(4)) AS part))),
             b0 AS MATERIALIZED (SELECT part, row - 1 AS entry, x FROM s WHERE row <= 256),
             {_codebook_rounds()},
             t AS (SELECT row, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM n4 GROUP BY 1),
             h AS (SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, k)) AS h FROM (SELECT part, entry, unnest(x) AS c, generate_subscripts(x, 1) AS k FROM b4))
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN t USING (row), h""",
}
