"""The Jaccard join, spelling variants and the filter audit against brute force, with odd rows, and on their plans."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorline.llm import filter_audit, jaccard, near_copies, registry, spelling
from sensorline.llm.common import LOWER, UPPER, table
from tests.conftest import SF

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
EXTRA = ["node", "size", "bits", "rank", "word", "n", "key", "mask", "digest", "part", "good", "step", "run", "h", "at", "a.b", "component_id"]
ODD = [(1, None), (2, ""), (3, " \t\n "), (None, "some text"), (None, None), (5, "x" * 100_000), (6, "again"), (6, "again"), (7, "Ünïcode ÄÖÜ \U0001f600 !!"), (0, "again")]


def docs(spark, rows, shape="doc_id bigint, text string"):
    frame = spark.createDataFrame(rows, shape)
    return frame.select("*", *[F.lit(7).alias(c) for c in EXTRA if c not in frame.columns])


# Jaccard join


def brute_classes(rows, words=4, least=85):
    sets = []
    for _, text in rows:
        w = SPACED.findall((text or "").translate(str.maketrans(UPPER, LOWER)))
        sets.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= least * len(a | b) and group[i] != group[j]:
            old = group[j]
            group = [group[i] if g == old else g for g in group]
    smallest = {}
    for (doc_id, _), g in zip(rows, group, strict=True):
        smallest[g] = min((x for x in (doc_id, smallest.get(g)) if x is not None), default=None)
    return sorted(((d, len(s), smallest[g]) for (d, _), s, g in zip(rows, sets, group, strict=True)), key=str)


def classes(frame, **how):
    return sorted((tuple(r) for r in jaccard.jaccard_classes(frame, **how).collect()), key=str)


def varied(seed, n, sizes=(1, 5, 12, 40, 90, 300, 700), share=0.08):
    """Texts in families whose members differ by a few words, at either side of the similarity."""
    rng, rows = random.Random(seed), []
    for doc_id in range(n):
        if rows and rng.random() < 0.7:
            text = (rng.choice(rows)[1] or "").split()
            for _ in range(rng.randrange(0, 2 + int(share * len(text)))):
                if text:
                    text[rng.randrange(len(text))] = rng.choice(("new", "Word", "é", str(rng.random())))
            text = text[rng.randrange(0, 1 + len(text) // 20) :]
        else:
            text = [f"w{rng.randrange(900)}" for _ in range(rng.choice(sizes))]
        rows.append((doc_id, " ".join(text)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("tile", [4, 4096])
def test_jaccard_against_brute_force(spark, tile):
    rows = varied(tile, 160) + ODD
    assert classes(docs(spark, rows), tile=tile) == brute_classes(rows)


def test_jaccard_edges(spark):
    assert classes(docs(spark, [])) == []
    assert classes(docs(spark, ODD)) == brute_classes(ODD)
    assert classes(docs(spark, [(9, "a b c d e")] * 3 + [(8, "A b C d e")])) == [(8, 2, 8)] + [(9, 2, 8)] * 3
    ties = [(1, " ".join(f"w{i}" for i in range(23))), (2, " ".join(f"w{i}" for i in range(20)))]  # 17 of 20 shingles: 0.85 exactly
    assert classes(docs(spark, ties)) == [(1, 20, 1), (2, 17, 1)]


def test_bitmap_bound_holds_for_every_pair():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, size=int(k)).astype(np.uint64)) for k in rng.integers(1, 3000, 40)]
    sets += [np.unique(np.concatenate([s[: int(len(s) * 0.93)], rng.integers(0, 1 << 63, size=len(s) // 20).astype(np.uint64)])) for s in sets]
    for a, b in itertools.combinations(sets, 2):
        x, y = (jaccard.bitmap(s)[:, None] for s in (a, b))
        width = min(len(x), len(y))
        apart = int(np.bitwise_count(jaccard.folded(x, width) ^ jaccard.folded(y, width)).sum())
        common = len(np.intersect1d(a, b))
        assert common <= (len(a) + len(b) - apart) // 2
        good = 100 * common >= 85 * (len(a) + len(b) - common)
        assert jaccard.linked(a, b) == good
        assert not good or apart <= jaccard.most_apart(np.int64(len(a) + len(b)))


def test_group_of_copies_makes_a_forest_only(spark):
    """Thousands of near copies: links stay below the number of texts times the pairs of tiles."""
    base = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join([*base, f"end{i}"])) for i in range(1500)]
    folder = str(jaccard.fresh_path(spark, "test-sets"))
    prints = jaccard.written(jaccard.prints(docs(spark, rows), folder), jaccard.fresh_path(spark, "test-prints"))
    edges = jaccard.links(prints, folder, tile=500)
    assert edges.count() < 1500 * 7
    assert {r[2] for r in classes(docs(spark, rows))} == {0}


# Spelling variants


def brute_words(rows, modulus=97, least_length=5, least_count=3):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = run.translate(str.maketrans(UPPER, LOWER))
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{low}".encode())
            n[low[: h % len(low)] + low[h % len(low) + 1 :] if h % modulus == 0 else low] += 1
    return {w: k for w, k in n.items() if len(w) >= least_length and k >= least_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, ratio=2, **how):
    n = brute_words(rows, **how)
    forms, out = {}, []
    close = {w: [v for v in n if v != w and near(v, w)] for w in n}
    for w in n:
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best is not None and n[best] >= ratio * n[w] else None
    for w in n:
        root = w
        while forms[root] is not None:
            root = forms[root]
        out.append((w, forms[w], root, n[w], len(close[w]), n[forms[w]] if forms[w] else None))
    return sorted(out, key=str)


def found(frame, **how):
    rows = spelling.variants(frame, **how)
    assert rows.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in rows.collect()), key=str)


def misspelt(seed, n_docs, modulus_hits=True):
    rng, out = random.Random(seed), []
    words = ["aaaaaa", "aaaaaaa", "bananas", "bananna", "letters", "LETTERS", "Überall", "überall", "straße", "ÿÿÿÿÿÿ", "abcdef", "abcdeg", "abcdfe", "hello", "hellos"]
    for doc_id in range(n_docs):
        text = []
        for _ in range(60):
            w = rng.choices(words, [2 ** (i % 6) for i in range(len(words))])[0]
            if rng.random() < 0.3:
                i, c = rng.randrange(len(w)), rng.choice("abé")
                w = rng.choice((w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]))
            text.append(w)
        out.append((doc_id, rng.choice((" ", ", ", "1", "_×", "\n")).join(text)))
    return out


@pytest.mark.parametrize("longest", [64, 6])
def test_variants_against_brute_force(spark, longest):
    rows = misspelt(longest, 40) + ODD
    assert found(docs(spark, rows), longest=longest) == brute_variants(rows)
    assert found(docs(spark, rows), modulus=3, longest=longest) == brute_variants(rows, modulus=3)


def test_variants_of_documents(spark):
    got = found(table(spark, SF, "documents"))
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    assert got == brute_variants(rows) and len(got) > 300 and any(r[1] for r in got)


def test_variants_edges(spark):
    assert found(docs(spark, [])) == found(docs(spark, [(1, None), (None, ""), (2, "1 2 3")])) == []
    long = "".join(random.Random(1).choices("abcdefgh", k=3_000))  # nine million letters of deletions if they were written out
    rows = [(i, " ".join([long] * 9 + [long[:1500] + "z" + long[1501:]] * 4 + [long[:-1]] * 2)) for i in range(4)]
    assert found(docs(spark, rows)) == brute_variants(rows)
    doubling = [(1, " ".join(w for i in range(9) for w in ["a" * (5 + i)] * (3 << i)))]  # a chain of eight forms, each twice as frequent
    got = found(docs(spark, doubling), modulus=1 << 40)
    assert got == brute_variants(doubling, modulus=1 << 40) and {r[2] for r in got} == {"a" * 13}


def test_chain_ends_with_a_hub(spark):
    up = {i: i // 2 for i in range(1, 700)} | {i: 0 for i in range(700, 2000)}
    frame = spark.createDataFrame(list(up.items()), "node bigint, up bigint")
    for hub in (5, 100_000):
        assert {(r.node, r.root) for r in spelling.chain_ends(frame, hub=hub).collect()} == {(i, 0) for i in up}


def test_keys_meet_only_for_equal_strings():
    words = ["abcabcab", "abcabcaa", "bcabcabc", "abcabcabc", "aabcabcab"]
    plain = [{(i, k) for i, k, _ in spelling.keys(w, 64)} for w in words]
    short = [{(i, k) for i, k, _ in spelling.keys(w, 3)} for w in words]
    for a, b in itertools.combinations(range(len(words)), 2):
        assert {i for i, _ in plain[a] & plain[b]} == {i for i, _ in short[a] & short[b]}


# Filter audit


def brute_audit(rows, labels):
    masks = []
    for doc_id, lang, text in rows:
        t = text or ""
        w = SPACED.findall(t)
        same = doc_id is not None and any(o is not None and o < doc_id and (x or "") == t for o, _, x in rows)
        masks.append((len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)), same))
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out = {}
    for part in {lang or "" for _, lang, _ in rows}:
        own = [(d, m) for (d, lang, _), m in zip(rows, masks, strict=True) if (lang or "") == part]
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            left = [False] * len(own)
            for step, c in enumerate(order, 1):
                f = "ABCDE".index(c)
                cell = Counter()
                for k, (d, m) in enumerate(own):
                    if m[f]:
                        cell["redundant" if left[k] else "removed"] += 1
                        cell["unique_fails"] += sum(m) == 1
                        if not left[k]:
                            cell["good_lost"] += d in good
                            cell["toxic_lost"] += d in toxic
                    left[k] = left[k] or m[f]
                    cell["kept"] += not left[k]
                shapley[c] += cell["removed"]
                out[part, "".join(order), step] = cell
        for (p, order, step), cell in out.items():
            if p == part:
                cell["shapley"] = shapley[order[step - 1]]
    return sorted((*k, *[v[m] for m in (*filter_audit.METRICS, "shapley")]) for k, v in out.items())


def test_audit_against_brute_force(spark):
    rng, rows = random.Random(3), []
    for i in range(120):
        n = rng.choice((0, 3, 199, 200, 250))
        words = [rng.choice(("w", "W", "WORD", "é", "#", "a|b", "x")) + str(rng.randrange(rng.choice((5, 400)))) for _ in range(n)]
        rows.append((i, rng.choice(("en", "de", None, "")), "\x0b ".join(words)))
    rows += [(200 + i, rng.choice(("en", "de")), rows[rng.randrange(120)][2]) for i in range(60)]
    rows += [(None, "en", rows[5][2]), (None, None, None), (0, "en", rows[0][2]), (300, "fr", None), (301, "fr", ""), (5, "de", rows[5][2])]
    labels = [(rng.randrange(260), rng.choice((0, 1, None)), rng.choice((0, 1, None))) for _ in range(200)] + [(None, 1, 1), (3, 1, 0), (3, 0, 1)]
    frame = docs(spark, rows, "doc_id bigint, lang string, text string")
    told = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").select("*", F.lit(1).alias("n"), F.lit(1).alias("mask"))
    got = filter_audit.audit(frame, told)
    assert dict(got.dtypes)["step"] == "int" and {t for c, t in got.dtypes if c not in ("part", "filter_order", "step")} == {"bigint"}
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(rows, labels)


def test_audit_edges(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert filter_audit.audit(docs(spark, [], "doc_id bigint, lang string, text string"), none).count() == 0
    rows = [(1, None, None), (2, None, "")]
    assert sorted(map(tuple, filter_audit.audit(docs(spark, rows, "doc_id bigint, lang string, text string"), none).collect())) == brute_audit(rows, [])


def test_new_queries_are_registered():
    assert {"op11_jaccard_join", "op12_spelling_variants", "op13_filter_audit"} <= set(registry.QUERIES)
    assert near_copies.WORDS == 5 and jaccard.WORDS == 4
