import zlib
from collections import defaultdict

import numpy as np
import pytest
import reference as R
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import embedding_dedup, mixing, packing, pii, queries, toxicity, warc
from tessera.llm.common import new_folder


def brute_vectors(rows):
    good = {i: (lab, np.array(v, float) / np.linalg.norm(v)) for i, v, lab in rows if lab is not None and v and all(x is not None and np.isfinite(x) for x in v) and np.any(v)}
    classes, n = R.Classes([i for i, _, _ in rows]), dict.fromkeys((i for i, _, _ in rows), 0)
    for a, (la, x) in good.items():
        for b, (lb, y) in good.items():
            if a < b and la == lb and len(x) == len(y) and x @ y >= 0.93:
                n[a] += 1
                n[b] += 1
                classes.join(a, b)
    return {i: (n[i], classes.find(i), classes.find(i) == i) for i in n}


def vectors_of(df, **options):
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, **options).collect()}


@pytest.mark.parametrize("block", [2000, 40])
def test_embeddings(spark, block):
    rng = np.random.default_rng(1)
    rows, i = [], 0
    for c in range(12):
        centre = rng.standard_normal(16)
        for _ in range(1 if c % 2 else 30):
            rows.append((i, [float(x) for x in np.float32(centre + rng.standard_normal(16) * (0.02 if c % 4 else 0.18))], c % 3))
            i += 1
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, rows[0][1], None), (904, rows[0][1], rows[0][2]), (905, [1.0, None], 0), (906, [1.0, 2.0], 0), (907, [1.0, 2.0], 0), (908, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("point", F.lit("x"))
    got, want = vectors_of(df, block=block), brute_vectors(rows)
    linked = sum(n for n, _, _ in want.values())
    assert sum(min(n, want[i][0]) for i, (n, _, _) in got.items()) >= 0.98 * linked
    assert all(n <= want[i][0] for i, (n, _, _) in got.items())
    assert {i: got[i] for i in range(900, 909)} == {i: want[i] for i in range(900, 909)}


def test_embeddings_of_tables(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert vectors_of(df) == brute_vectors([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def targets_by_hand(sizes):
    """Water filling by iteration."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixing(spark, documents):
    mixed = mixing.mix(documents).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in mixed:
        sizes[r._source] += r.size
        taken[r._source] += r.size * r.copies
        assert 0 <= r.copies <= 3 and r.source_size >= r.size
    want = targets_by_hand(sizes)
    assert len(mixed) == documents.count()
    for r in mixed:
        assert r.target == pytest.approx(want[r._source])
    largest = max(r.size for r in mixed)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(1, largest / 2 + 1)
    assert sorted((r._hash, r.copies) for r in mixed) == sorted((r._hash, r.copies) for r in mixing.mix(documents).collect())


def test_rates_and_copies_equal_a_plain_solver(spark):
    """The tilted rates of each source against bisection, the copies against the rounding rule row by row."""
    rng = np.random.default_rng(11)
    rows = [(i, " ".join("w" * int(n)), "abcd"[i % 4] if i % 9 else None) for i, n in enumerate(rng.integers(1, 60, 400))] + [(900, "w " * 900, "a"), (901, None, "b")]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)).collect()
    for source in {r._source for r in mixed}:
        own = [r for r in mixed if r._source == source]
        sizes, target = np.array([r.size for r in own], float), own[0].target
        mean = sizes.mean()
        rate = lambda m: np.minimum(3.0, np.exp(np.minimum(m * sizes / mean, 50)))  # noqa: E731, B023
        low, high = -60.0, 60.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if (sizes * rate(mid)).sum() <= target else (low, mid)
        full = target >= 3 * sizes.sum()
        want = np.full(len(own), 3.0) if full else rate(low)
        assert [r.rate for r in own] == pytest.approx(want, rel=1e-6)
        base = np.floor([r.rate for r in own])
        u = np.array([((r._hash % (1 << 40)) + 0.5) / (1 << 40) for r in own])
        turn = [(u[i] / (r.rate - base[i]), i) for i, r in enumerate(own) if r.rate < 3 and r.size > 0]
        extra = [own[i].copies - base[i] for _, i in sorted(turn)]
        assert extra == sorted(extra, reverse=True) and set(extra) <= {0, 1}  # a prefix in the order of turns
        taken, n = sum(r.copies * r.size for r in own), int(sum(extra))
        beside = [own[sorted(turn)[k][1]].size for k in (n - 1, n) if 0 <= k < len(turn)]
        assert full or abs(taken - target) <= max(beside) / 2 + 1e-6


def test_mixing_edges(spark, edge, edge_rows, nothing):
    rows = {r._id: r for r in mixing.mix(edge).collect()}
    assert {i: r.size for i, r in rows.items()} == {i: len(R.WORD.findall(t or "")) for i, t in edge_rows}
    assert rows[7].target == pytest.approx(targets_by_hand({r._source: r.source_size for r in rows.values()})[None])
    copies = mixing.take(edge)
    assert copies.count() == sum(r.copies for r in rows.values()) and copies.columns == edge.columns
    assert mixing.mix(nothing).count() == mixing.take(nothing).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id long, text string, source string")
    assert [(r.target, r.size) for r in mixing.mix(blank).collect()] == [(0.0, 0)] * 2


def test_warc(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    extra = spark.createDataFrame([(9001, "http://A.example:80/x#f", None), (9002, None, ""), (9003, "u", pages.first().html)], "page_id long, url string, html string")
    both = pages.select("page_id", "url", "html").unionByName(extra).withColumn("digest", F.lit(1)).withColumn("surt", F.lit(2))
    rows = {r.page_id: r for r in both.collect()}
    first = {}
    for i in sorted(rows):
        first.setdefault(rows[i].html or "", i)
    read = {r.page_id: r for r in warc.round_trip(both).collect()}
    assert read.keys() == rows.keys()
    for i, r in read.items():
        html = rows[i].html or ""
        assert r.digest == R.sha1_32(html.encode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[html] == i else ("revisit", first[html]))
        assert bytes(r.payload) == (html.encode() if r.record_type == "response" else b"")
        assert r.url == (rows[i].url or "")
    assert warc.round_trip(both.limit(0)).count() == 0


def test_warc_lookup(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = new_folder(spark, "lookup")
    records = warc.write_archive(pages, folder)
    directory = warc.write_index(records, folder, block_lines=4)
    assert directory.agg(F.sum("lines")).first()[0] == pages.count()
    wanted = pages.filter("page_id % 10 = 0").select(warc.surt(F.col("url")).alias("surt")).union(spark.createDataFrame([("nowhere",)], "surt string"))
    found = warc.lookup(spark, folder, wanted)
    assert {r.page_id for r in found.collect()} >= {r.page_id for r in pages.filter("page_id % 10 = 0").collect()}
    whole = warc.read_records(found, folder).filter("page_id = 0").first()
    assert bytes(whole.payload).decode() == pages.filter("page_id = 0").first().html


def test_surt(one):
    assert one(warc.surt(F.lit("HTTP://user@WWW.Example.com:80/a/B?q=1#x"))) == "com,example,www)/a/b?q=1"
    assert one(warc.surt(F.lit(None).cast("string"))) == ")/"


def test_personal_data(spark, documents, edge, edge_rows, nothing):
    odd = [
        "mail a@b.com_x@y.org and c@d.e.f.", "1.2.3.4.5.6.7.8 and 999.1.1.1 and 010.001.0.255", "4111 1111 1111 1111, 4111-1111-1111-1112, 4111  1111", "+49 (30) 1234-5678 +1 +12345678901234567",
        "IBAN DE89 3704 0044 0532 0130 00 here, GB82WEST12345698765432", "😀 a@b.cd 😀 +4930123456 ", "x" * 5000 + "@", "9" * 9000, "1 " * 9000, "a@" * 3000 + "b.c",
    ]
    rows = [(1000 + i, t) for i, t in enumerate(odd)] + [(i, t) for i, t in edge_rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows) | {r.doc_id + 5000: r.text for r in documents.collect()}
    both = df.unionByName(documents.select((F.col("doc_id") + 5000).alias("doc_id"), "text"))
    spans = {r.doc_id: r.found for r in pii.find_pii(both).collect()}
    for i, t in texts.items():
        assert [(x.start, x.order, x.kind, x.end) for x in spans[i] if x.kind in pii.BASE_KINDS] == R.personal(t), t[:80] if t else t
        assert all(t[x.start : x.end] == x.match for x in spans[i])
    assert [x.match for x in spans[1004] if x.kind == "iban"] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    near = pii.find_pii(spark.createDataFrame([(1, "call +4930123456789"), (2, "xxxx +4930123456789")], "doc_id long, text string")).collect()
    assert near[0].found[0].score > near[1].found[0].score
    assert pii.find_pii(nothing).count() == 0


def check_packing(rows, texts, window=2048):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))  # not the operator's own encoder
    slow.encode_special_tokens = True
    ids = [np.array([*slow.encode(t or "", add_special_tokens=False).ids, 1], np.uint32) for t in texts]
    parts, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    want = defaultdict(list)
    for key, x in zip(sorted(range(len(texts))), ids, strict=True):
        want[key] = x
    for s in seqs.values():
        s.sort(key=lambda r: r.offset)
        at = 0
        for r in s:
            assert r.offset == at
            at += r.length
        assert 0 < at <= window and at & (at - 1) == 0
    return parts, want


def test_packing(documents):
    rows = packing.pack(documents, with_ids=False).collect()
    docs = documents.orderBy("doc_id").collect()
    parts, want = check_packing(rows, [r.text for r in docs])
    for r, x in zip(docs, want.values(), strict=True):
        at = 0
        for p in sorted(parts[r.doc_id], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(x))
            assert p.ids_crc32 == zlib.crc32(x[at : at + p.length].astype("<u4").tobytes())
            at += p.length
        assert at == len(x)


def test_packing_edges(spark, edge, edge_rows, nothing):
    rows = packing.pack(edge.unionByName(edge.filter("doc_id = 4"))).collect()
    check_packing(rows, [t for _, t in edge_rows])
    assert sorted((r.length, r.ids[0]) for r in rows if r.doc_id in (1, 2)) == [(1, 1), (1, 1)]
    assert sum(r.length for r in rows if r.doc_id == 4) == 2 * next(r.doc_tokens for r in rows if r.doc_id == 4)
    assert packing.pack(nothing).count() == 0
    special = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    assert 50256 not in packing.pack(special).first().ids


def test_sum_of_squares_fills_levels():
    p = packing.SumOfSquares(8)
    full = [w for n in [5, 3, 5, 3, 4, 4] for w in p.place((0, 0, np.ones(n, np.uint32), n))]
    assert [sum(len(x[2]) for x in w) for w in full] == [8, 8, 8]
    p.place((0, 0, np.ones(7, np.uint32), 7))
    assert [sum(len(x[2]) for x in w) for w in p.finish()] == [4, 2, 1]


def test_fast_and_slow_tokenizers_agree(edge_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.make_encoder()
    for _, t in edge_rows:
        assert encode(t or "") == slow.encode(t or "", add_special_tokens=False).ids


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert len(out) == docs.count()
    held = [(out[r.doc_id], r.toxic) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(o.held_out for o, _ in held)
    assert sum(o.predicted == y for o, y in held) / len(held) > 0.96
    pos, neg = [o.score for o, y in held if y], [o.score for o, y in held if not y]
    assert np.mean([p > n for p in pos for n in neg]) > 0.97


def test_toxicity_edges(spark, edge, nothing):
    labels = spark.createDataFrame([(i, 1, int(i % 2)) for i in range(1, 20)] + [(5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(edge, labels)
    out = toxicity.score(edge, model).collect()
    assert len(out) == edge.count() and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(nothing, model).count() == 0
    empty = toxicity.fit(nothing, labels.limit(0))
    assert {round(r.score, 9) for r in toxicity.score(edge, empty).collect()} == {toxicity.PRIOR} and toxicity.PRIOR < toxicity.THRESHOLD
    assert toxicity.keep_clean(edge, labels).columns == edge.columns


def test_ftrl_learns_few_weights():
    rng = np.random.default_rng(0)
    m = toxicity.Ftrl(1001, l1=4.0)
    for _ in range(3000):
        at = rng.choice(1000, 20, replace=False)
        m.learn(np.append(at, 1000), float(7 in at or 11 in at))
    w = m.weights(slice(None))
    assert set(np.argsort(w)[-2:]) == {7, 11} and (w != 0).mean() < 0.5


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, kept, sf_dir)
        if name != "packing":
            assert kept.columns == docs.columns
        kept = kept.cache()
        sizes.append(kept.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3]
    tokens = lambda df: {r.doc_id: r.n for r in df.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}  # noqa: E731  where it is cut depends on the partitions
    assert tokens(corpus_pipeline.run(spark, sf_dir)) == tokens(kept)


def test_query_names():
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == [q for n in range(1, 14) for q in queries.QUERIES if q.startswith(f"op{n}_")]


def test_scratch_tables_go(spark):
    from tessera.llm.common import drop_scratch, written

    df = written(spark.range(3).toDF("x"), "gone")
    assert df.count() == 3
    path = df.inputFiles()[0]
    assert drop_scratch(spark) >= 1
    with pytest.raises(Exception, match="(?i)path|exist"):
        spark.read.parquet(path.rsplit("/", 1)[0]).count()


@pytest.mark.parametrize(("blank", "n"), [*((b, n) for b in (" ", "\t", "\n", " \n", "\u3000") for n in (49_999, 60_000)), (" ", 1_000_000), ("\n", 1_000_000), ("\t", 5_000_000)])
def test_long_runs_of_blanks(blank, n):
    import public_tokenizers
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    text = "x" + (blank * n)[:n] + "y z"
    assert packing.make_encoder()(text) == slow.encode(text, add_special_tokens=False).ids


def test_packing_a_million_blanks(spark):
    df = spark.createDataFrame([(1, "x" + " " * 1_000_000 + "y"), (2, "word")], "doc_id long, text string")
    total = {r.doc_id: r.n for r in packing.pack(df, with_ids=False).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert total == {1: 1_000_001 + 1, 2: 2}


def _foul(n):
    return [(i, f"w{i % 7} w{i % 11} foul vile {i}" if i % 3 == 0 else f"w{i % 7} w{i % 11} fair {i}") for i in range(n)]


def test_one_huge_text_leaves_the_sample(spark):
    """A labelled document above the bound is passed over, and the rest is learnt from."""
    rows = _foul(300)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    plain = toxicity.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string"), labels, 16_384, 1 << 20)
    first = plain.orderBy("_order").first()._id
    huge = spark.createDataFrame([(i, "fair " * 400_000 if i == first else t) for i, t in rows], "doc_id long, text string")
    sample = {r._id for r in toxicity.labelled_sample(huge, labels, 16_384, 1 << 20).select("_id").collect()}
    assert sample == {r._id for r in plain.select("_id").collect()} - {first}
    model = toxicity.fit(huge, labels, sample_bytes=1 << 20)
    hit = [r.predicted == int(r.doc_id % 3 == 0) for r in toxicity.score(huge, model).collect()]
    assert sum(hit) > 280


@pytest.mark.parametrize("labels", [[], [(i, 1) for i in range(300)], [(0, None)], [(1, 0)]])
def test_without_evidence_nothing_is_rejected(spark, labels):
    docs = spark.createDataFrame(_foul(300), "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert toxicity.keep_clean(docs, known).count() == 300
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit(docs, known)).collect()} == {0}
