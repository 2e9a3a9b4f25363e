"""Operators over the whole corpus: fingerprints, packing, files, vectors, rules and the pipeline."""

import base64
import hashlib
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sensorline import storage
from sensorline.llm import common, components, credentials, inner_product, near_copies, packing, quality, registry, simhash, token_files, tokens, url_rules, warc_bundles
from tests.conftest import SF
from tests.llm.test_text_operators import ODD, docs


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(registry.tokenizer_path())


def rows_of(spark, n=150):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(n).collect()]


# Tokens

ALPHABET = list("aAzéÉñß'’.,!?1½") + ["̱", "́", " ", "\n", "\t", "\x0b", "\x1f", "\u0085", " ", "　", "<|endoftext|>", "İ", "ı", "ẞ", "ſ", "K", "日", "\U0001f600", "‍", "﻿", "\x00"]


def test_encoder_equals_the_library(library):
    enc, draw = tokens.Encoder(registry.tokenizer_path()), np.random.default_rng(4)
    assert enc.by_word
    for _ in range(3_000):
        text = "".join(draw.choice(ALPHABET, draw.integers(0, 30)))
        assert enc.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_other_vocabularies_go_through_the_library():
    import public_tokenizers

    enc = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not enc.by_word and enc.encode("Hello there").tolist() == enc.library.encode("Hello there", add_special_tokens=False).ids


def test_memo_that_fills_up_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(tokens, "MOST_WORDS", 3)
    text = "one two three four Five five six, seven one two"
    assert tokens.Encoder(registry.tokenizer_path()).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1_001, dtype=np.uint64).astype(np.uint32)
    packed = token_files.pack(ids, bits)
    assert len(packed) == -(-1_001 * bits // 8) and token_files.unpack(packed, bits, 1_001).tolist() == ids.tolist()


@pytest.mark.parametrize("file_ids", [1 << 24, 500])
def test_token_files(spark, library, file_ids):
    rows = rows_of(spark) + ODD
    files = token_files.write_tokens(docs(spark, rows), registry.tokenizer_path(), 2, file_ids=file_ids)
    got = sorted(token_files.read_tokens(files).collect(), key=lambda r: r.start)
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 2] for k, t in rows}
    assert [r.doc_id is None or r.doc_id for r in got] == [True, *sorted(k for k, _ in rows if k is not None)]
    start = 0
    for r in got:
        assert (r.start, r["ids"], r.n_tokens) == (start, ids[r.doc_id] if r.doc_id not in (1, 2, 3, 5, 6, 7) else r["ids"], len(r["ids"]))
        assert r.ids_crc32 == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r.n_tokens
    first = files.manifest.orderBy("start").first()
    with token_files.TokenFile(first.uri) as f:
        assert f.document(0).tolist() == got[0]["ids"] and f.bits == 16


# Packing


def check_packed(got, rows, library, most):
    want = defaultdict(list)
    for k, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want[k] += [(i, i * most, len(ids[i * most : i * most + most]), zlib.crc32(np.array(ids[i * most : i * most + most], "<u4").tobytes())) for i in range(-(-len(ids) // most))]
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= most
    return len(by)


def test_packing(spark, library):
    rows = rows_of(spark) + ODD
    for most in (4096, 256):
        got = packing.pack(docs(spark, rows).repartition(5), registry.tokenizer_path(), 1, most).collect()
        n = check_packed(got, rows, library, most)
        assert n <= np.ceil(sum(r.length for r in got) / most) * 1.05 + 1
    assert packing.pack(docs(spark, rows).limit(0), registry.tokenizer_path(), 1).count() == 0


def test_sequences_hold_the_ids(spark):
    packed = packing.pack(docs(spark, [(1, "a b c"), (2, "d e")]), registry.tokenizer_path(), 1)
    assert packing.sequences(packed).first()["ids"] == b"".join(bytes(r["ids"]) for r in packed.orderBy("offset").collect())


def test_plan_uses_patterns_and_comes_near_the_bound():
    draw = np.random.default_rng(8)
    lengths = np.minimum(4096, np.exp(draw.normal(6.5, 1, 20_000)).astype(int) + 1)
    histogram = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    places = packing.plan(histogram)
    assert places["sequence"].max() + 1 <= lengths.sum() / 4096 * 1.02
    assert packing.plan({}).keys() == places.keys() and packing.plan({4096: 3, 1: 1})["sequence"].tolist()


def test_least_squares():
    draw = np.random.default_rng(6)
    a, x = draw.random((20, 8)), np.maximum(0, draw.normal(0, 1, 8))
    assert packing.nonnegative_least_squares(a, a @ x) == pytest.approx(x, abs=1e-6)
    assert (packing.nonnegative_least_squares(a, draw.normal(0, 1, 20)) >= 0).all()


# Fingerprints


def slow_fingerprint(text, words=4):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    w = [x for x in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in low).split(" ") if x]
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + words]).encode(), 42) for i in range(max(1, len(w) - words + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_equal_brute_force(spark):
    rows = rows_of(spark, 200) + ODD + [(900 + i, "same words in every copy of this text " + "tail " * (i % 3)) for i in range(40)]
    got = simhash.near_duplicates(docs(spark, rows), tile=16).collect()
    prints = [slow_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    want = sorted(((rows[i][0], f"{prints[i]:016x}", least[root[i]]) for i in range(len(rows))), key=str)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=str) == want


@pytest.mark.parametrize("tile", [64, 1_000])
def test_tiles_lose_no_link(spark, tile):
    draw = np.random.default_rng(9)
    centres = draw.integers(0, 2**64, 60, dtype=np.uint64)
    near = np.concatenate([c ^ (np.uint64(1) << draw.integers(0, 64, 20, dtype=np.uint64)) ^ (np.uint64(1) << draw.integers(0, 64, 20, dtype=np.uint64)) for c in centres])
    x = np.unique(near)
    edges = simhash.links(spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp bigint"), 4, tile)
    found = {r.node: r.root for r in components.components(edges).collect()}
    groups = defaultdict(set)
    for v in x.view(np.int64).tolist():
        groups[found.get(v, v)].add(v)
    forest = simhash.Forest(len(x))
    forest.link(*np.nonzero(np.bitwise_count(x[:, None] ^ x[None]) <= 4))
    want = defaultdict(set)
    for v, r in zip(x.view(np.int64).tolist(), forest.root.tolist(), strict=True):
        want[r].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.root for r in components.components(edges).collect()} == {0}
    assert components.components(edges.limit(0)).count() == 0


def test_one_of_each_group_stays(spark):
    frame = docs(spark, [(5, "one and the same text"), (3, "one and the same text"), (3, "one and the same text"), (9, "something else entirely here now"), (None, None)])
    got = simhash.without_near_duplicates(frame)
    assert sorted((r.doc_id for r in got.collect()), key=str) == [3, 9, None] and got.columns == frame.columns


def test_ids_that_are_null_or_shared_lose_no_component(spark):
    texts = [f"text number {i} speaks of {'abcdefgh'[i] * 9} and of nothing that {i * 7} others hold" for i in range(8)]
    frame = docs(spark, [(None, t) for t in texts[:5]] + [(None, texts[0]), (4, texts[5]), (4, texts[6]), (9, texts[6]), (None, texts[7]), (8, texts[7])])
    got = sorted(((r.doc_id, r.text) for r in simhash.without_near_duplicates(frame).collect()), key=str)
    assert got == sorted([(None, t) for t in texts[:5]] + [(4, texts[5]), (4, texts[6]), (8, texts[7])], key=str)


def test_near_copy_stage_equals_brute_force(spark):
    draw = np.random.default_rng(21)
    rows = rows_of(spark, 200) + [r for r in ODD if len(r[1] or "") < 1_000]
    for i in range(60):  # copies of similarity 0.85 down to 0.7, and texts of few words
        words = [f"w{x}" for x in draw.integers(0, 10_000, (6, 9, 60, 300)[i % 4])]
        rows.append((1_000 + 2 * i, " ".join(words)))
        for at in draw.integers(0, len(words), max(1, len(words) * (2 + i % 3) // 100)):
            words[at] = "changed"
        rows.append((1_001 + 2 * i, " ".join([*words, "end"])))
    rows += [(None, rows[205][1]), (None, "an unrelated text without any id at all"), (None, "one more of them that is of no kin")]

    def grams(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, root, links = [grams(t) for _, t in rows], list(range(len(rows))), 0
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                links += sets[i] != sets[j]
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    want = [min((rows[i][0] for i in range(len(rows)) if root[i] == r), key=lambda k: (k is None, k or 0)) for r in set(root)]
    got = corpus_pipeline.near_duplicates(spark, docs(spark, rows), SF)
    assert links > 10 and sorted((r.doc_id for r in got.collect()), key=str) == sorted(want, key=str)
    assert sorted((r.doc_id for r in near_copies.without_near_copies(docs(spark, rows), tile=16).collect()), key=str) == sorted(want, key=str)


# Vectors


def many_equal():
    """Vectors of two dimensions of meaning: 3,000 near copies of one, 800 equal ones, the rest at random."""
    draw = np.random.default_rng(31)
    x = draw.normal(0, 1, (9_000, 32))
    x[:3_000] = draw.normal(0, 1, 32) + draw.normal(0, 1e-3, (3_000, 32))
    x[3_000:3_800] = draw.normal(0, 1, 32)
    return [(int(i), [float(c) for c in np.float32(v)]) for i, v in enumerate(x)]


@pytest.mark.parametrize("source", ["sf0.001", "sf0.01", "made"])
def test_search_recall_and_order(spark, source):
    if source == "made":
        frame = spark.createDataFrame(many_equal(), "vec_id bigint, embedding array<float>").repartition(3)
    else:
        frame = spark.read.parquet(f"{os.path.dirname(SF)}/{source}/embeddings.parquet")
    index = inner_product.build_index(frame)
    got = defaultdict(list)
    for r in inner_product.search(index, index.rows.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    rows = index.rows.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.v for r in rows])
    hits = ties = 0
    for q, found in got.items():
        score = inner_product.exact(x[ids == q][0], x)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        hits += len({v for v, _ in found} & set(ids[order].tolist()))
        ties += [v for v, _ in found] == ids[order].tolist()
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        assert all(s == score[ids == v][0] for v, s in found)
    assert len(got) == (ids % 20 == 0).sum() and hits / (20 * len(got)) >= 0.9
    print(source, hits / (20 * len(got)), ties / len(got))


def test_vectors_that_take_no_part_and_ties(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (8, [])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("v", F.lit(1)).withColumn("codes", F.lit(2))
    index = inner_product.build_index(frame)
    got = inner_product.search(index, index.rows.where("vec_id % 20 = 0"), 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 20), (20, 1, 0), (20, 2, 1), (20, 3, 2)]
    empty = inner_product.build_index(frame.limit(0))
    assert inner_product.search(empty, empty.rows).count() == 0


def test_repeated_ids(spark):
    """Rows of the query's id are no candidates; all others are, row by row."""
    rows = [(20, [1.0, 0.0]), (20, [0.5, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.25, 0.0]), (2, [0.75, 0.0])]
    index = inner_product.build_index(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(4))
    got = inner_product.search(index, index.rows.where("vec_id = 20"), 5).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 0.5), (1, 0.5), (2, 0.375), (1, 0.125)]


@pytest.mark.parametrize("parts", [1, 5])
def test_many_vectors_under_query_ids(spark, parts):
    """50 vectors under each of several query ids, the best ones of all: they crowd no other candidate out, in one tile or in many."""
    draw = np.random.default_rng(21)
    x = draw.normal(0, 1, (2_000, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(q, (3 * x[q] + draw.normal(0, 0.1, 8)).astype(np.float32).tolist()) for q in range(0, 100, 20) for _ in range(50)]
    rows += [(7, x[0].tolist())] * 3 + [(0, x[7].tolist())] * 30  # repeated rows, and a vector of another id under the query's
    index = inner_product.build_index(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").repartition(parts))
    asked = [(q, min(v for i, v in rows if i == q)) for q in range(0, 100, 20)]
    got = inner_product.search(index, spark.createDataFrame(asked, "vec_id bigint, v array<double>")).orderBy("query_id", "rank").collect()
    ids, all_ = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    for q, v in asked:
        score = inner_product.exact(np.array(v), all_)
        best = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        assert [(r.vec_id, r.score) for r in got if r.query_id == q] == [(int(ids[i]), float(score[i])) for i in best]


def test_anisotropic_codes_lower_the_parallel_residual():
    draw = np.random.default_rng(12)
    x = draw.normal(0, 1, (2_000, 16)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    def parallel(eta):
        q = inner_product.Quantiser(inner_product.train(x, 1).centres.copy(), 16, eta)
        for _ in range(4):
            q.refit(x, q.encode(x))
        return float(((x - q.decode(q.encode(x))) * x).sum(1).__pow__(2).mean())

    assert parallel(8.0) < parallel(1.0)


# URLs


def test_rules_equal_brute_force(spark):
    draw = np.random.default_rng(13)
    hosts = ["net", "example.net", "a.example.net", "example.com", "b.c.example.com", "org", "x.org", "notexample.net", "", "EXAMPLE.net", "a..net"]
    paths = ["", "/", "/en/", "/en/x", "/de/", "/fr/a?b#c", "/e#/en/", "?q=/en/"]
    pages = [(i, f"{draw.choice(['http', 'https', 'x'])}://{draw.choice(hosts)}{draw.choice(paths)}") for i in range(400)] + [(400, None), (401, "no scheme"), (401, "http://example.net/en/y"), (None, "http://x.org/fr/")]
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("com", "/de/", "block"), ("example.com", "/", "allow"), ("org", "/fr/", "allow"), ("org", "/fr/a", "block"), ("net", "/e", "allow"), ("net", "/e", "block"), (None, "/", "block")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string").withColumn("key", F.lit(1)).withColumn("host", F.lit("z"))
    got = sorted(((r.page_id, r.rule, r.verdict) for r in url_rules.judge(frame, spark.createDataFrame(rules, "host string, path string, verdict string"), ranges=5).collect()), key=str)
    want = []
    for page, url in pages:
        rest = (url or "").partition("://")[2]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, path = rest[:cut].lower(), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
        fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if h and host and (host == h or host.endswith("." + h)) and path.startswith(p)]
        want.append((page, max(fit)[3], max(fit)[4]) if fit else (page, None, "allow"))
    assert got == sorted(want, key=str)


def test_ranges_are_placed_one_by_one(spark):
    """As many tasks as ranges, none with two; a very long url and repeated rows at a border change nothing."""
    pages = spark.createDataFrame([(i % 300, f"http://h{i % 300:03d}.org/fr/{'x' * (50_000 if i == 7 else 3)}") for i in range(600)] + [(1_000, "http://h150.org/fr/a")] * 90, "page_id bigint, url string")
    rules = spark.createDataFrame(registry.RULES, "host string, path string, verdict string")
    judged = url_rules.judge(pages, rules, ranges=16)
    assert judged.select(F.spark_partition_id().alias("p")).distinct().count() >= 14  # a hot key may leave a range empty
    rows = judged.collect()
    assert len(rows) == 690 and {(r.rule, r.verdict) for r in rows} == {("org/fr/", "allow")} and max(len(r.path) for r in rows) > 50_000


# WARC


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/\r\nX: y", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (2, "http://b", "<p>é</p>"), (3, None, None), (4, "u", ""), (None, "v", "<p>é</p>"), (5, "w", "x" * 700_000)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).withColumn("n", F.lit(2))
    archive = warc_bundles.write_warc(frame, frame_bytes=100)
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc_bundles.read_warc(archive).collect()), key=str)
    assert got == sorted([(1, 9, "revisit", 2), (2, 9, "response", None), (2, 9, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (None, 9, "revisit", 2), (5, 700_000, "response", None)], key=str)
    one = archive.index.where("page_id = 5").first()
    with warc_bundles.Bundle(one.uri) as bundle:
        head, payload = bundle.record(one.frame, one.offset)
    assert payload == b"x" * 700_000 and head["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
    import zstandard

    with open(one.uri.removeprefix("file://"), "rb") as f:
        plain = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert plain.startswith(b"WARC/1.1\r\n")
    assert warc_bundles.read_warc(warc_bundles.write_warc(frame.limit(0))).count() == 0


def test_records_are_named_once_and_refer_to_each_other(spark):
    pages = [(1, "http://a", "same"), (2, "http://b", "same"), (2, "http://b", "same"), (3, "http://c", "x"), (4, "http://d\n", "x"), (5, None, "y"), (5, "http://e" + "e" * 600, "y"), (6, "http://f", "alone"), (1, "http://a", "same")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    for most in (100, 0):
        archive = warc_bundles.write_warc(frame, most_broadcast=most)
        index = archive.index.collect()
        assert len({r.record_id for r in index}) == len(pages)
        names, heads = {r.record_id: r.page_id for r in index}, []
        for r in index:
            with warc_bundles.Bundle(r.uri) as bundle:
                heads.append(bundle.record(r.frame, r.offset)[0])
        refers = {h["X-Page-Id"]: h.get("WARC-Refers-To") for h in heads if h["WARC-Type"] == "revisit"}
        assert refers == {"1": None, "3": refers["3"]} and names[refers["3"][1:-1]] == 4
        got = sorted(((r.page_id, r.url, r.record_type, r.refers_to) for r in warc_bundles.read_warc(archive).collect()), key=str)
        want = {1: ("revisit", 2), 3: ("revisit", 4)}
        assert got == sorted([(p, u, *want.get(p, ("response", None))) for p, u, _ in pages], key=str)


@pytest.mark.parametrize("most", [100, 0])
def test_revisits_of_any_url(spark, most):
    """Null, empty and long urls of responses: revisits name the record and repeat the whole url."""
    urls = {10: None, 20: "", 30: "http://a/" + "u" * 503, 40: "http://b/" + "é" * 5_000, 50: "http://c/\r\nX: y"}
    pages = [(p - k, None if k == 1 else f"http://r{k}/", f"payload {p}") for p in urls for k in (1, 2)] + [(p, u, f"payload {p}") for p, u in urls.items()]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3)
    archive = warc_bundles.write_warc(frame, most_broadcast=most)
    heads = {}
    for r in archive.index.collect():
        with warc_bundles.Bundle(r.uri) as bundle:
            heads[r.page_id] = bundle.record(r.frame, r.offset)[0]
    for p, url in urls.items():
        for k in (1, 2):
            head = heads[p - k]
            assert head["WARC-Type"] == "revisit" and head["X-Refers-To-Page"] == str(p) and head["WARC-Refers-To"] == heads[p]["WARC-Record-ID"]
            assert head.get("WARC-Refers-To-Target-URI") == heads[p].get("WARC-Target-URI") and (url is None) == ("WARC-Target-URI" not in heads[p])
    got = sorted(((r.page_id, r.url, r.record_type, r.refers_to) for r in warc_bundles.read_warc(archive).collect()), key=str)
    assert got == sorted([(p, u, *(("response", None) if p in urls else ("revisit", -(-p // 10) * 10))) for p, u, _ in pages], key=str)


def test_archives_are_read_side_by_side(spark):
    """As many tasks as bundles, also where that is the number of shuffle partitions."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    frame = spark.range(40).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("p"), "id").alias("html")).repartition(n, "page_id")
    archive = warc_bundles.write_warc(frame)
    files = archive.index.select("uri").distinct().count()
    read = warc_bundles.read_warc(archive).withColumn("task", F.spark_partition_id())
    assert files == n and read.select("task").distinct().count() == n and read.count() == 40


def test_long_payloads_only(spark):
    frame = spark.createDataFrame([(1, "a", "xx"), (2, "b", "xx"), (3, "c", "long text"), (4, "d", "long text")], "page_id bigint, url string, html string")
    got = {r.page_id: r.record_type for r in warc_bundles.read_warc(warc_bundles.write_warc(frame, least_bytes=5)).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_empty_tables(spark):
    empty = docs(spark, ODD).limit(0)
    assert simhash.near_duplicates(empty).count() == 0 and near_copies.without_near_copies(empty).count() == 0
    assert token_files.read_tokens(token_files.write_tokens(empty, registry.tokenizer_path(), 2)).count() == 0
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    rules = spark.createDataFrame(registry.RULES, "host string, path string, verdict string")
    assert url_rules.judge(pages, rules).count() == 0 and warc_bundles.read_warc(warc_bundles.write_warc(pages)).count() == 0


def test_hot_keys_are_joined_apart(spark):
    left = spark.range(3_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    right = left.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    want = sorted(map(tuple, left.join(right.drop("n"), "k").select("k", "id", "m").collect()))
    for share, floor in ((1_000, 0), (2, 0), (1_000, 10_000)):
        assert sorted(map(tuple, common.split_join(left, right, "k", "n", 3_000, share, floor).select("k", "id", "m").collect())) == want


# Pipeline


def test_pipeline_stages(spark, library):
    """Each stage on what its predecessor kept, against a plain version of it."""
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    own = lambda f: sorted((r.doc_id, r.text) for r in f.select("doc_id", "text").collect())
    before, kept = frame, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = storage.staged(stage(spark, before, SF), "stage")
        assert out.columns == frame.columns
        kept[name], before = (own(before), own(out)), out

    model = quality.fit(frame, spark.read.parquet(f"{SF}/labels.parquet"))
    was, now = kept["quality classifier"]
    assert now == [(k, t) for k, t in was if slow_score(t, model) >= registry.QUALITY_THRESHOLD]
    was, now = kept["simhash near-dedup"]
    assert [k for k, _ in now] == near_copies_kept(was)
    was, now = kept["benchmark decontamination"]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = {(len(g), g) for _, t in bench for g in windows(t, 10)}
    assert now == [(k, t) for k, t in was if not any((n, g) in grams for n in {n for n, _ in grams} for g in windows(t, n, False))] and len(now) < len(was)
    was, now = kept["secret scans"]
    spans = {r.doc_id: [(s["start"], s["kind"], s["end"]) for s in r.spans] for r in credentials.find_secrets(spark.createDataFrame(was, "doc_id bigint, text string")).collect()}
    clean = []
    for k, t in was:
        out, at = "", 0
        for start, kind, end in spans[k]:
            if start >= at:
                out += t[at:start] + f"[{kind}]"
            at = max(at, end)
        clean.append((k, out + t[at:]))
    assert now == clean
    check_packed(corpus_pipeline.run(spark, SF).collect(), now, library, 4096)


def slow_score(text, model):
    """The score as a sum over a dictionary of n-grams."""
    counts = defaultdict(int)
    tokens = quality.TOKEN.findall(text or "")
    hashes = [zlib.crc32(t.encode()) for t in tokens]
    for h in [*hashes, *((a * 0x9E3779B97F4A7C15 + b + 1) % 2**64 for a, b in zip(hashes, hashes[1:], strict=False))]:
        counts[h * 0xD6E8FEB86659FD93 % 2**64 >> 64 - quality.BITS] += 1
    size = sum(np.log1p(n) ** 2 for n in counts.values()) ** 0.5
    return 1 / (1 + np.exp(-model.bias - sum(float(model.weights[i]) * np.log1p(n) / size for i, n in counts.items())))


def windows(text, size, short=True):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())
    size = min(size, len(w)) if short else size
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w and size else set()


def near_copies_kept(rows):
    sets, root = [], list(range(len(rows)))
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return sorted(min(rows[i][0] for i in range(len(rows)) if root[i] == r) for r in set(root))


def test_pipeline_gives_the_ids(spark, library):
    packed = corpus_pipeline.best_fit_packing(spark, docs(spark, [(1, "a b c"), (2, "d e")]), SF)
    got = {r.doc_id: np.frombuffer(bytes(r.ids), "<u4").tolist() for r in packed.collect()}
    assert got == {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in ((1, "a b c"), (2, "d e"))}
