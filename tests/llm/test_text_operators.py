"""Operators that judge documents one by one, against brute force, with nulls, repeats, empties and clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorline.llm import common, credentials, decontamination, license_scan, quality, registry
from tests.conftest import SF, canonical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(common.UPPER, common.LOWER)
EXTRA = ["items", "text_hash", "row", "parts", "fp", "score", "n_words", "part", "_id", "_hash", "_marks", "_chunks", "_key", "_doc", "doc", "spans", "root", "a.b"]


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def docs(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    return frame.select("*", *[F.lit(7).alias(c) for c in EXTRA])


ODD = [(1, None), (2, ""), (3, "   "), (None, "some text"), (5, "x" * 200_000), (6, "again"), (6, "again"), (7, "\u0000퟿ é́ 日本 \U0001f600 !!")]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_against_sql(spark, duck, name):
    frame = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLES[name])
    assert canonical([tuple(r) for r in frame.collect()], frame.columns) == canonical(want.fetchall(), want.columns)


# Decontamination


def brute_contamination(rows, items, window):
    out = []
    for doc_id, text in rows:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            own = words(t)
            k = min(window, len(own))
            for j in range(len(own) - k + 1 if own else 0):
                for i in range(len(w) - k + 1):
                    if w[i : i + k] == own[j : j + k]:
                        hit |= set(range(i, i + k))
                        if item is not None:
                            found.add(str(item))
        out.append((doc_id, len(w), len(hit), sorted(found)))
    return out


ITEMS = [(1, "a b c d e f"), (2, "b c d e"), (2, "z z z z"), (3, None), (4, "!!"), (5, "q"), (None, "m n o p"), (6, "a b c d e f")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 8])
def test_contamination_equals_brute_force(spark, block_bytes):
    draw = np.random.default_rng(3)
    rows = [(i, " ".join(draw.choice(list("abcdefzmnop"), draw.integers(0, 60)))) for i in range(60)]
    rows += [(100, "x A,B;c D e f g"), (101, "q"), (102, "z z z z z z z z"), (103, "a b c d e f a b c d e f"), *ODD]
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    got = decontamination.contamination(docs(spark, rows), bench, 4, block_bytes)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()), key=str) == sorted(brute_contamination(rows, ITEMS, 4), key=str)


def test_longest_match_and_removal(spark):
    bench = spark.createDataFrame([(9, "a b c d e f g h")], "item_id bigint, text string")
    frame = docs(spark, [(1, "x b c d e f y"), (2, "a b c x"), (3, None), (4, "clean words only")])
    found = decontamination.contamination(frame, bench, 3)
    best = decontamination.longest_matches(found).collect()
    assert [tuple(r) for r in best] == [("9", 5, 1, 1, 1)]
    assert [r.matches[0].asDict() for r in found.where("doc_id = 2").collect()] == [{"item_id": "9", "n_words": 3, "item_word": 0, "doc_word": 0}]
    kept = decontamination.without_contaminated(frame, bench, 3)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4] and kept.columns == frame.columns
    assert decontamination.contamination(frame, bench.limit(0), 3).where("contaminated").count() == 0
    assert decontamination.contamination(frame.limit(0), bench, 3).count() == 0


def test_longest_matches_equal_brute_force(spark):
    draw = np.random.default_rng(17)
    items = [(i, " ".join(draw.choice(list("abcd"), draw.integers(2, 14)))) for i in range(12)] + [(3, "a b a b a b a b"), (None, "d d d d")]
    rows = [(i, " ".join(draw.choice(list("abcdx"), draw.integers(0, 50)))) for i in range(40)] + [(77, "b a b a b a b x a b a b a b a b a")]
    bench = spark.createDataFrame([*items, items[0], items[0]], "item_id bigint, text string")
    want = []
    for doc, text in rows:
        w, found = words(text), {}
        for n, (item, t) in enumerate(items):
            own = words(t)
            k = min(4, len(own))
            for i in range(len(w)):
                for j in range(len(own)):
                    size = next((s for s in range(min(len(w) - i, len(own) - j), k - 1, -1) if w[i : i + s] == own[j : j + s]), 0)
                    if size:
                        found[n] = min(found.get(n, (0, 0, 0)), (-size, j, i))
        want.append((doc, sorted((-s, str(items[n][0]), j, i) for n, (s, j, i) in found.items())))
    for block_bytes in (1 << 20, 60):
        got = decontamination.contamination(docs(spark, rows), bench, 4, block_bytes).collect()
        assert sorted((r.doc_id, sorted((m.n_words, str(m.item_id), m.item_word, m.doc_word) for m in r.matches)) for r in got) == want
        kept = decontamination.without_contaminated(docs(spark, rows), bench, 4, block_bytes)
        assert sorted(r.doc_id for r in kept.collect()) == [d for d, m in want if not m] and kept.columns == docs(spark, rows).columns


def test_blocks_leave_no_copy_of_the_corpus(spark, tmp_path):
    """Ten blocks give the results of one, and the shared folder holds the blocks only."""
    from sensorline import storage

    draw = np.random.default_rng(6)
    bench = spark.createDataFrame([(i, " ".join(draw.choice(list("abcdefg"), 12))) for i in range(60)], "item_id bigint, text string")
    frame = docs(spark, [(i, "unlikely " * 2_000 + " ".join(draw.choice(list("abcdefg"), 40))) for i in range(50)])
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0]
    results = []
    for block_bytes in (size, size // 10):
        with storage.run(spark) as folder:
            got = sorted(map(str, decontamination.contamination(frame, bench, 5, block_bytes).collect()))
            results.append((got, sorted(r.doc_id for r in decontamination.without_contaminated(frame, bench, 5, block_bytes).collect())))
            import pathlib

            held = [f for f in pathlib.Path(folder.removeprefix("file://")).rglob("*") if f.is_file() and not f.name.endswith(".crc")]
            assert {f.parent.name.split("-")[0] for f in held} == {"benchmark"} and len(held) == (2 if block_bytes == size else len(held)) >= 2
    assert results[0] == results[1] and 0 < len(results[0][1]) < 50


def test_a_block_of_the_largest_size_fits_a_task():
    """A quarter of the largest block, of words that are all different (the worst for the vocabulary), in a quarter of 500 MB."""
    import tracemalloc

    rows = [(str(i), " ".join(f"{i * 1_000 + j:07d}" for j in range(1_000))) for i in range(decontamination.BLOCK_BYTES // 4 // 8_000)]
    tracemalloc.start()
    block = decontamination.make_block(rows, 10)
    assert len(block.vocabulary) > 250_000 and tracemalloc.get_traced_memory()[1] < 125 << 20
    tracemalloc.stop()


def test_suffix_array_is_sorted():
    draw = np.random.default_rng(1)
    for n in (1, 2, 50, 400):
        text = draw.integers(1, 4, n).astype(np.int32)
        want = sorted(range(n), key=lambda i: text[i:].tolist())
        assert decontamination.suffix_array(text, n).tolist() == want


# Secrets

BASE = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}
KEY = "AKIA" + "ABCD1234" * 2
SECRET = "aB3" * 14
TEXTS = [
    f"token: token: abcdefgh token==abcdefg PASSWORD = 'hunter2x' secret=abc é {KEY} {'0af' * 9}",
    f"é日 {KEY} and {SECRET}", f"{SECRET} alone", f"{KEY}\n\n{SECRET}", f"{KEY}{' word' * 200} {SECRET}",
    f"login: bob99 {SECRET} https://host.example/x?y=1", "login: bob99 alone https://host.example", "api_key=" + "a" * 40, "aPi_Key : \"x.y-z_1=\" apikey='12345'",
    f"see https://host.example/x?k={SECRET} for more",
]


def test_base_spans_equal_regular_expressions(spark):
    draw = np.random.default_rng(5)
    bits = ["token", "Secret", "=", ":", " ", "'", '"', "abcdef", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "é", "\n", "apikey", "日", "."]
    rows = [(i, "".join(draw.choice(bits, draw.integers(1, 40)))) for i in range(300)] + [(1000 + i, t) for i, t in enumerate(TEXTS)] + ODD
    got = sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in credentials.digest(credentials.find_secrets(docs(spark, rows))).collect()), key=str)
    want = []
    for doc_id, text in rows:
        spans = [(m.start(), k, m.end()) for k, (p, ok) in BASE.items() for m in p.finditer(text or "") if ok(m)]
        spans.sort(key=lambda s: (s[0], list(BASE).index(s[1])))
        joined = ",".join(f"{k}:{a}:{b}" for a, k, b in spans)
        want.append((doc_id, *(sum(s[1] == k for s in spans) for k in BASE), hashlib.sha256(joined.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_weak_parts_need_a_partner(spark):
    got = {r.doc_id: r.spans for r in credentials.digest(credentials.find_secrets(docs(spark, list(enumerate(TEXTS))))).collect()}
    assert got[1] == f"access:3:{3 + len(KEY)},opaque:28:{28 + len(SECRET)}"
    assert "opaque" not in got[2] + got[3]
    assert "opaque" in got[4]  # one scope, however far apart
    assert [s.split(":")[0] for s in got[9].split(",")] == ["endpoint", "opaque"]  # a key inside an endpoint's url
    assert "identifier" in got[5] and "opaque" in got[5] and "endpoint" in got[5]
    assert got[6] == ""


def test_redaction(spark):
    frame = docs(spark, [(1, "a token=abcdefgh b"), (2, None), (3, "clean"), (3, "clean")]).withColumn("n_chars", F.length("text").cast("bigint"))
    got = {(r.doc_id, r.text, r.n_chars) for r in credentials.redact(frame).collect()}
    assert got == {(1, "a [assign] b", 12), (2, None, None), (3, "clean", 5)} and credentials.redact(frame).count() == 4
    assert credentials.redact(frame.limit(0)).count() == 0


def test_redaction_across_chunks(spark):
    """Texts longer than a chunk, with characters beyond the basic plane and spans over its borders and over each other."""
    size = credentials.CHUNK
    wide = "\U0001f600" * (size - 4) + " password=" + "a1" * 40 + " \u00e9" * size + "secret: " + "0123456789abcdef" * (size // 8) + " end"
    texts = [(1, wide), (2, "token=abcdefgh" * 2 * size), (None, wide[7:]), (4, "x" * 2 * size + "token=abcdefgh"), (5, "\n token=abcdefgh\n" * size)]
    frame = docs(spark, texts)
    spans = {r.doc_id: r.spans for r in credentials.find_secrets(frame).collect()}
    for r in credentials.redact(frame).collect():
        text, out, at = dict(texts)[r.doc_id], "", 0
        for s in spans[r.doc_id]:
            if s["start"] >= at:
                out += text[at : s["start"]] + f"[{s['kind']}]"
            at = max(at, s["end"])
        assert r.text == out + text[at:] != text


def test_many_parts_in_one_text(spark):
    long = " ".join(f"{KEY} {SECRET} token=abcdef{i}" for i in range(3_000))
    row = credentials.find_secrets(docs(spark, [(1, long)])).select(F.size("spans").alias("n"), F.size("base").alias("b")).first()
    assert row.b == 6_000 and row.n == 9_000


# Licences


def brute_places(text):
    w, out = words(text), []
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        out += [(i, label) for i in range(len(w)) if w[i : i + len(p)] == p]
    return len(w), sorted(out)


def test_license_base_and_fuzzy(spark):
    rows = [
        (11, "Work under the Apache License, MIT-License and cc--by! cc by by"), (12, "Permision is hereby granted, free of charge, to any persn obtaining a copy"),
        (13, "GNU General\nPublic  License"), (14, "released into the publik domain é 日"), (15, "nothing here"), *ODD,
    ]
    scanned = license_scan.scan(docs(spark, rows)).collect()
    assert sorted(((r.doc_id, r.n_words, [(b.word, b.label) for b in r.base]) for r in scanned), key=str) == sorted(((d, *brute_places(t)) for d, t in rows), key=str)
    notices = {r.doc_id: [(n.label, n.edits) for n in r.notices] for r in scanned}
    assert notices[12] == [("mit", 2)] and notices[14] == [("public-domain", 1)] and notices[15] == []
    got = {r.doc_id: r for r in license_scan.summary(license_scan.scan(docs(spark, rows))).collect()}
    assert got[14].notice_spans == "public-domain:0:31:1" and got[15].notice_spans == ""
    assert license_scan.scan(docs(spark, rows).limit(0)).count() == 0
    assert (got[13].base_labels, got[13].score, got[15].labels, got[15].score, got[11].first_word, got[15].first_word) == ("gpl", 1.0, "", 0.0, 3, None)


def best_ends(notice, text):
    """For each end in text the fewest edits of a stretch that ends there (row by row over the notice)."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(notice, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return row


def test_fuzzy_equals_a_full_search():
    """Edits of every span, and no place within the edits without a span, for all notices, against edit distances."""
    draw, notices = np.random.default_rng(2), license_scan.Notices()
    found_any = 0
    for round_ in range(120):
        picked = [list(license_scan.NOTICES)[round_ % 12]] * (1 + round_ % 3)
        text = list(" ".join([*picked, "and a few other words"]))
        for _ in range(draw.integers(0, 7)):
            i = int(draw.integers(0, len(text)))
            text[i : i + 1] = draw.choice(["", "q", "zz"])
        text = "".join(text)
        found = notices.find(text)
        found_any += len(found)
        for notice, label in license_scan.NOTICES.items():
            k = len(notice) // license_scan.PER_EDIT
            ends = best_ends(notice, text)
            own = [(s, e, n) for s, e, name, n in found if name == label]
            for end in range(len(text) + 1):
                if ends[end] <= k:
                    assert any(s < end + k and e > end - len(notice) - k for s, e, _ in own), (notice, text)
            if ends and min(ends) <= k:
                assert min(n for *_, n in own) <= min(ends)
        for s, e, label, n in found:
            assert n == min(best_ends(notice, text[s:e])[-1] if license_scan.NOTICES[notice] == label else 99 for notice in license_scan.NOTICES)
    assert found_any > 100
    pair = "licensed under the mut license licensed under the mit license"
    assert notices.find(pair) == [(0, 30, "mit", 1), (31, 61, "mit", 0)]


# Quality


def test_quality_on_the_held_out_fold(spark):
    frame, labels = (spark.read.parquet(f"{SF.replace('sf0.001', 'sf0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.score(frame, quality.fit(frame, labels)).where("held_out").join(labels, "doc_id").select("score", "quality").collect()
    good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
    auc = np.mean([[(a > b) + (a == b) / 2 for b in bad] for a in good])
    assert auc > 0.9
    kept = [r.score >= registry.QUALITY_THRESHOLD for r in got]
    assert np.mean([k == bool(r.quality) for k, r in zip(kept, got, strict=True)]) > 0.9


def slow_ftrl(rows, n_good):
    """Follow-the-regularised-leader weight by weight, in dictionaries."""
    z, n, q = {}, {}, quality
    def weight(i):
        if abs(z.get(i, 0.0)) <= q.L1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * q.L1) / ((q.BETA + n[i] ** 0.5) / q.ALPHA + q.L2)

    share = [len(rows) / (2 * max(1, c)) for c in (len(rows) - n_good, n_good)]
    for _ in range(3):
        for at, value, label in rows:
            x = dict(zip([*at.tolist(), "bias"], [*value.tolist(), 1.0], strict=True))
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in x.items())))
            for i, v in x.items():
                g = share[label] * (p - label) * v
                z[i] = z.get(i, 0.0) + g - ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / q.ALPHA * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_training_equals_a_plain_loop():
    draw = np.random.default_rng(23)
    texts = [(" ".join(draw.choice(["good", "clean", "text", "of", "words"] if i % 3 else ["buy", "now", "text", "!!"], 12)), int(i % 3 > 0)) for i in range(60)]
    rows = [(*quality.features(t, 12), y) for t, y in texts]
    model = quality.train(lambda: rows, len(rows), sum(y for *_, y in rows), 12, epochs=3)
    want = slow_ftrl(rows, sum(y for *_, y in rows))
    assert model.bias == pytest.approx(want.pop("bias"), rel=1e-6)
    assert {int(i): float(model.weights[i]) for i in np.flatnonzero(model.weights)} == pytest.approx({i: w for i, w in want.items() if w}, rel=1e-5)


def test_fit_keeps_one_text_an_id_and_reads_again_what_it_cannot_hold(spark, monkeypatch):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 40)], "doc_id bigint, quality int, toxic int")
    rows = [(i, f"{'fine prose here' if i % 2 else 'zz zz buy'} {i}") for i in range(1, 40)] + [(7, "zzz never the smallest")] * 50
    held = quality.fit(docs(spark, rows), labels)
    monkeypatch.setattr(quality, "HELD_BYTES", 0)
    again = quality.fit(docs(spark, rows[:39]), labels)
    assert (held.weights == again.weights).all() and held.bias == again.bias != 0
    assert quality.score(docs(spark, rows).limit(0), held).count() == 0


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs(spark, ODD), labels)
    got = quality.score(docs(spark, ODD), model).collect()
    assert len(got) == len(ODD) and all(r.score == 0.5 for r in got)
    fold = {r.doc_id: r.held_out for r in got}
    assert fold[1] == (zlib.crc32(b"1") % 5 == 0) and fold[None] is None
    assert quality.keep_good(docs(spark, ODD), model, 0.3).count() == len(ODD)


def test_scan_for_other_notices(spark):
    """Hundreds of notices given by the caller, with edits, and a label for each."""
    ids = [f"{name}-{n}.{m}" for name in ("Apache", "GPL", "LGPL", "MPL", "BSD", "EUPL", "Artistic", "CDDL", "EPL", "OSL") for n in range(1, 7) for m in range(6)]
    notices = license_scan.spdx_notices(ids)
    assert len(notices) == len(ids) == 360 and notices["spdx license identifier gpl 2 0"] == "gpl-2.0"
    frame = spark.createDataFrame([(1, "x\n// SPDX-License-Identifier: EPL-2.0\n y"), (2, "SPDX-Licence-Identifer: OSL-3.0"), (3, "no notice"), (4, None)], "doc_id bigint, text string")
    got = {r.doc_id: {(n.label, n.edits) for n in r.notices} for r in license_scan.scan(frame, notices).collect()}
    assert ("epl-2.0", 0) in got[1] and ("osl-3.0", 2) in got[2] and not got[3] and not got[4]
    own = {license_scan.folded_notice("Internal use ONLY!"): "internal"}
    assert [[n.label for n in r.notices] for r in license_scan.scan(frame.limit(1).selectExpr("doc_id", "'for internal  use only' as text"), own).collect()] == [["internal"]]
