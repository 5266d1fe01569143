"""Operators that look across documents: line templates, mixing, substrings, near-duplicates, shards and the pipeline."""

import hashlib
import random
from collections import Counter, defaultdict
from math import exp

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rangeflow.llm import graph, mixing, registry, sharding, simhash, substrings, templates
from rangeflow.llm.common import word_spans
from tests.conftest import DATA

ODD = [(1, "a b c\nd e f g"), (2, None), (3, ""), (4, "a b c\nd e f g"), (None, "a b c\nno id here"), (5, "w " * 60_000), (6, "\n\n"), (6, "a b c\nother row"), (6, "a b c\nother row"), (7, "é日本 😀 ́ x")]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if k % 3 == 0 else f"s{k % 3}", 1, "x", 2.0) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, copy int, lines string, rate double")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(name, spark, duck, same):
    assert same(registry.QUERIES[name](spark, DATA).toPandas(), duck.execute(registry.ORACLES[name]).df())


# ---- line templates


def brute_templates(rows):
    def place(key, no):
        h = xxhash.xxh64_intdigest(key[1].encode(), 42)
        return key[0], h - (h >> 63 << 64), no

    leaves, template = defaultdict(dict), {}
    for i, t in {r for r in rows if r[1] is not None}:
        key = (-(2**63) if i is None else i, t)
        for no, line in enumerate(t.split("\n")):
            tokens = line.encode().split()
            digits = [any(c in b"0123456789" for c in w) for w in tokens]
            if tokens and not (len(tokens) < templates.SHORT and all(digits)):
                tokens = [b"<*>" if d else w for w, d in zip(tokens, digits)]
            if tokens:
                leaves[len(tokens), *tokens[: templates.DEPTH]][place(key, no), key] = tokens[templates.DEPTH :]
    for leaf, lines in leaves.items():
        left = dict(lines)
        if len({key for _, key in lines}) >= templates.MIN_DOCS:
            for k in range(templates.SPLITS):
                if left:
                    model = left[min(left)]
                    near = {x for x, tail in left.items() if sum(a == b for a, b in zip(tail, model)) >= np.ceil(len(tail) * templates.FIXED)}
                    template |= {x: (leaf, k) for x in near}
                    left = {x: tail for x, tail in left.items() if x not in near}
        template |= {x: (leaf, *tail) for x, tail in left.items()}
    docs, first = defaultdict(set), {}
    for at, key in template:
        docs[template[at, key]].add(key)
        first[template[at, key]] = min(first.get(template[at, key], at), at)
    gone = {(key, at[2]) for (at, key), t in template.items() if len(docs[t]) >= templates.MIN_DOCS and first[t] != at}
    for i, t in rows:
        key = (-(2**63) if i is None else i, t)
        kept = [line for no, line in enumerate(t.split("\n")) if (key, no) not in gone] if t is not None else []
        yield i, None if t is None else "\n".join(kept), 0 if t is None else t.count("\n") + 1 - len(kept)


def test_templates_by_brute_force(spark, odd):
    rng = random.Random(1)
    line = lambda: f"user {rng.randrange(9)} of {rng.choice('ab')} logged in" if rng.random() < 0.5 else " ".join(rng.choice("pqrs") for _ in range(rng.randrange(0, 5)))
    opening = " ".join(f"o{chr(97 + k)}" for k in range(12))
    tails = [" ".join(rng.choice("tu") for _ in range(n)) for n in (1, 1, 20, 20, 20)]

    def varied():
        tail = rng.choice(tails).split()
        for _ in range(rng.randrange(3)):
            tail[rng.randrange(len(tail))] = rng.choice(("x", "y", "7"))
        return f"{opening} {' '.join(tail)}"

    rows = [(k, "\n".join(rng.choice((line, line, varied))() for _ in range(rng.randrange(1, 6)))) for k in range(90)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    for df, given in ((made, rows), (odd, ODD)):
        got = templates.drop_templates(df)
        names = got.columns[len(df.columns) :]
        assert sorted(map(str, ((r.doc_id, r.text, r[names[1]]) for r in got.collect()))) == sorted(map(str, brute_templates(given)))
    assert got.columns == [*odd.columns, "lines_", "dropped"]
    assert templates.drop_templates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("firsts", (templates.FIRSTS, 3))
def test_the_pipeline_splits_leaves_to_the_end(spark, monkeypatch, firsts):
    import corpus_pipeline

    rng = random.Random(11)
    openings = [" ".join(f"o{x}{chr(97 + k)}" for k in range(12)) for x in "xy"]
    tails = [[rng.choice("pqrstu") for _ in range(n)] for n in (20, 20, 20, 20, 20, 20, 37, 37, 37, 8)]

    def line():
        tail = list(rng.choice(tails))
        for _ in range(rng.randrange(4)):  # up to three words part: near, and then not
            tail[rng.randrange(len(tail))] = rng.choice(("va", "vb", "vc", "p"))
        return f"{rng.choice(openings)} {' '.join(tail)}"

    rows = [(k, "\n".join(line() for _ in range(rng.randrange(1, 5)))) for k in range(150)]
    monkeypatch.setattr(templates, "FIRSTS", firsts)
    got = corpus_pipeline.dedup_lines(spark, spark.createDataFrame(rows, "doc_id long, text string"), DATA).collect()
    capped = sorted((i, t) for i, t, _ in brute_templates(rows))
    monkeypatch.setattr(templates, "SPLITS", 1000)
    want = sorted((i, t) for i, t, _ in brute_templates(rows))
    assert sorted(map(tuple, got)) == want != capped


def test_no_line_is_lost_for_its_tail(spark):
    opening = " ".join("one two three four five six seven eight nine ten eleven twelve".split())
    texts = [f"{opening} {w}" for w in ("alpha", "beta", "gamma")] + [f"{opening} {' '.join('abcdefghi')} {w}" for w in "xyz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in templates.drop_templates(df).orderBy("doc_id").collect()]
    assert got == [*texts[:4], "", ""]


def test_the_pipeline_drops_short_lines(spark):
    import corpus_pipeline

    texts = [f"own line of {w}\nLes.\nAnd ornd.\nPage {k}\n{k} {k}\n\n2026" for k, w in enumerate(("ash", "birch", "cedar"))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in corpus_pipeline.dedup_lines(spark, df, DATA).orderBy("doc_id").collect()]
    assert got == [texts[0], "own line of birch\n1 1\n", "own line of cedar\n2 2\n"]


def test_the_pipeline_keeps_own_text_after_a_shared_opening(spark):
    import corpus_pipeline

    opening = " ".join(f"shared{chr(97 + k)}" for k in range(14))
    texts = [f"{opening} {w} and more\n{opening} page {k}" for k, w in enumerate(("ash", "birch", "cedar", "elm"))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in corpus_pipeline.dedup_lines(spark, df, DATA).orderBy("doc_id").collect()]
    assert got == [texts[0], *(t.split("\n")[0] for t in texts[1:])]


# ---- mixing


def test_mixing_draws_are_poisson_quantiles(spark):
    rates = [0.0001, 0.5, 1.0, 7.3, 63.9]
    sums = {r.m: r.c for r in spark.createDataFrame([(m,) for m in rates], "m double").select("m", mixing.cumulative(F.col("m")).alias("c")).collect()}
    for m, c in sums.items():
        p, total = exp(-m), exp(-m)
        for k, got in enumerate(c):
            assert abs(got - total) < 1e-12
            p *= m / (k + 1)
            total += p
        assert c[-1] > 1 - 1e-12


def test_mixing_reaches_its_targets(spark, odd):
    docs = spark.createDataFrame([(k, f"t{k}", "big" if k % 3 else "small") for k in range(6000)], "doc_id long, text string, source string")
    n = {r.source: r["count"] for r in mixing.mix(docs, {"big": 1.0, "small": 3.0}).groupBy("source").count().collect()}
    assert abs(n["big"] - 1500) < 200 and abs(n["small"] - 4500) < 350
    few = mixing.mix(docs.limit(20), {"big": 1.0}, total=4000)  # means above the largest are drawn in parts
    assert abs(few.count() - 4000) < 350
    assert sorted(r.copy for r in few.where("doc_id = 1").collect()) == list(range(1, few.where("doc_id = 1").count() + 1))
    again = mixing.mix(docs, {"big": 1.0, "small": 3.0})
    assert sorted(map(tuple, again.select("doc_id", "copy").collect())) == sorted(map(tuple, mixing.mix(docs.repartition(9), {"big": 1.0, "small": 3.0}).select("doc_id", "copy").collect()))
    with pytest.raises(ValueError):
        mixing.mix(docs, {"big": -1.0})
    got = mixing.mix(odd)
    assert got.columns[: len(odd.columns)] == odd.columns and "copy_" in got.columns
    assert {(r.doc_id, r.text) for r in got.collect()} <= set(ODD)
    assert mixing.mix(odd.limit(0)).count() == 0


def test_mixing_by_shuffled_join(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = sorted(map(tuple, mixing.mix(docs).select("doc_id", "copy").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 1)
    assert sorted(map(tuple, mixing.mix(docs).select("doc_id", "copy").collect())) == want


def test_native_operators_have_no_python_in_their_plans(spark, odd):
    for df in (mixing.mix(odd), templates.drop_templates(odd)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


# ---- substrings


def brute_substrings(rows):
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    for (i, _), w in zip(rows, words):
        gone = set()
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = [x for k, x in enumerate(w) if k not in gone]
        yield i, len(w), len(gone), b" ".join(kept).decode()


@pytest.mark.parametrize("block", [0, 3, 1024])
def test_substrings_by_brute_force(spark, odd, block):
    rng = random.Random(block)
    passages = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(40, 140))] for _ in range(6)]

    def text():
        parts = []
        for _ in range(rng.randrange(1, 5)):
            if rng.random() < 0.6:
                p = rng.choice(passages)
                lo = rng.randrange(0, 30)
                parts += p[lo : lo + rng.randrange(45, 140)]
            else:
                parts += [f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 60))]
        return rng.choice([" ", "\n", "\t "]).join(parts)

    rows = [(k * 7 % 83, text()) for k in range(83)] + [(90, "z " * 200), (91, "z " * 120), (92, "z " * 200)]
    rows += [(93, "y " * 2500), (94, "x " + "y " * 1300), (94, "x " + "y " * 1300), (95, " ".join(f"{k % 60}" for k in range(3000))), (96, " ".join(f"{k % 60}" for k in range(7, 1500)))]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block=block)
    assert sorted(map(tuple, got.collect())) == sorted(brute_substrings(rows))
    short = [(i, (t or "")[:400] if t else t) for i, t in ODD] + [(8, "a " * 60), (9, "a " * 55), (9, "b a " * 55)]
    df = spark.createDataFrame([(*r, "x", 1) for r in short], "doc_id long, text string, print string, anchor int")
    assert sorted(map(str, map(tuple, substrings.remove_repeats(df, block=block).collect()))) == sorted(map(str, brute_substrings(short)))


def test_substrings_of_a_hot_passage(spark):
    """A passage of many documents in unlike surroundings goes through every finer block."""
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(90)]

    def text(k):
        own = [f"{k}-{j}" for j in range(rng.randrange(0, 30))]
        return " ".join(own + passage[rng.randrange(0, 20) : rng.randrange(60, 90)] + own[::-1])

    rows = [(k * 11 % 101, text(k)) for k in range(101)]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block=5)
    assert sorted(map(tuple, got.collect())) == sorted(brute_substrings(rows))


@pytest.mark.parametrize("most", (substrings.HOT, 2))
def test_few_hot_anchors_need_no_shuffle_of_the_texts(spark, monkeypatch, most):
    rng = random.Random(7)
    passages = [[f"p{k}w{rng.randrange(10**6)}" for _ in range(70)] for k in range(3)]
    rows = [(k, None if k == 5 else " ".join([*(f"d{k}w{i}" for i in range(rng.randrange(20))), *passages[k % 3], f"end{k}", *passages[rng.randrange(3)]])) for k in range(30)]
    plans, way = [], substrings._by_finer_blocks

    def seen(copies, *more):
        plans.append(copies._jdf.queryExecution().executedPlan().toString())
        return way(copies, *more)

    monkeypatch.setattr(substrings, "HOT", most)
    monkeypatch.setattr(substrings, "_by_finer_blocks", seen)
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), block=4)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_substrings(rows)))
    assert ("Exchange" in plans[0]) == (most == 2)


@pytest.mark.parametrize("shingle", substrings.SHINGLES)
def test_anchors_depend_on_the_window_alone(shingle):
    rng = random.Random(shingle)
    words = [f"w{rng.randrange(30)}" for _ in range(400)]
    data = " ".join(words).encode()
    own = substrings.anchors(data, *word_spans(data), shingle)
    assert len(own) == 351
    for at in (0, 17, 350):
        alone = " ".join(words[at : at + 50]).encode()
        assert substrings.anchors(alone, *word_spans(alone), shingle).tolist() == [own[at]]


def test_substrings_of_little(spark, odd):
    assert substrings.remove_repeats(odd).count() == len(ODD)
    assert substrings.remove_repeats(odd.limit(0)).count() == 0


# ---- near-duplicates


def brute_simhash(text, k=4):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 4:
                parent[find(a)] = find(b)
    members = defaultdict(list)
    for k, (i, _) in enumerate(prints):
        members[find(k)].append(i)
    return [(i, f"{h:016x}", min((x for x in members[find(k)] if x is not None), default=None)) for k, (i, h) in enumerate(prints)]


def test_simhash_by_brute_force(spark, odd):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    for df, given in ((spark.read.parquet(f"{DATA}/documents.parquet"), rows), (odd, ODD)):
        want = brute_classes([(i, brute_simhash(t)) for i, t in given])
        assert sorted(map(str, map(tuple, simhash.near_duplicates(df).collect()))) == sorted(map(str, want))
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_query_6(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = registry.QUERIES["op6_simhash"](spark, DATA).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted(brute_classes([(i, brute_simhash(t)) for i, t in rows]))


def test_one_of_repeated_rows_stays(spark):
    rows = [(1, "a b c d e f", {"x": 1}), (1, "a b c d e f", {"x": 1}), (1, "a b c d e f", None), (2, "a b c d e f", None), (3, "other words here", None), (None, "a b c d e f", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string,int>")
    for keep in (simhash.keep_one, simhash.keep_dissimilar):
        assert sorted((str(r.doc_id) for r in keep(df).collect())) == ["1", "3", "None"]


def test_trie_join_finds_every_class(spark):
    rng = np.random.default_rng(6)
    prints = []
    for base in rng.integers(0, 2**63, 40, dtype=np.uint64).tolist() + [0, 2**64 - 1]:
        for _ in range(rng.integers(1, 25)):
            x = base
            for bit in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                x ^= 1 << bit
            prints.append(x)
    prints = [(int(k), x) for k, x in zip(rng.permutation(10_000)[: len(prints)], prints)]
    df = spark.createDataFrame([(i, x - (x >> 63 << 64)) for i, x in prints], "doc_id long, bits long")
    got = sorted((r.doc_id, f"{r.bits & (2**64 - 1):016x}", r.component_id) for r in simhash.classes(df).collect())
    assert got == sorted(brute_classes(prints))


@pytest.mark.parametrize("k", [1, 2, 3])
def test_more_blocks_link_the_same(spark, monkeypatch, k):
    rng = np.random.default_rng(k)
    base = rng.integers(0, 2**63, 30, dtype=np.uint64).tolist()
    prints = {x ^ sum({1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 6))}) for x in base for _ in range(8)}
    df = spark.createDataFrame([(x - (x >> 63 << 64),) for x in prints], "bits long")
    monkeypatch.setattr(simhash, "block_choices", lambda budget, n, f=simhash.block_choices: f(budget, (1 << 20, 1 << 32, 1 << 50)[k - 1]))
    assert len(simhash.block_choices(4, 0)[1]) == (5, 15, 35)[k - 1]
    rooted = {r.node & (2**64 - 1): r.root for r in graph.components(simhash.link_fingerprints(df)).collect()}
    for a in prints:
        for b in prints:
            if a < b and (a ^ b).bit_count() <= 4:
                assert rooted[a] == rooted[b]


def test_wide_fingerprints_part_by_similarity():
    rng = np.random.default_rng(3)
    for _ in range(40):
        own = rng.integers(0, 2**63, 340, dtype=np.uint64)
        a, b, c = (simhash.wide_simhash(np.unique(x)) for x in (own[:306], own[34:], rng.integers(0, 2**63, 306, dtype=np.uint64)))
        assert np.bitwise_count(a ^ b).sum() <= simhash.NEAR < np.bitwise_count(a ^ c).sum()


def test_trie_join_in_small_steps(monkeypatch):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(simhash, "PAIRS", 8)
    x = int(rng.integers(0, 2**63))
    keys = np.unique(np.array([x ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))] + [x ^ 0xFFFF], dtype=np.uint64))
    parent = simhash.trie_join(keys, np.array([0, len(keys)]), 4)
    near = np.bitwise_count(keys[:, None] ^ keys[None]) <= 4
    assert all(parent[i] == parent[j] for i, j in zip(*np.nonzero(near)))


@pytest.mark.parametrize("few", [0, 30, 1 << 16])
def test_components_of_chains_and_stars(spark, few):
    rng = random.Random(8)
    links = [(k, k + 1) for k in range(100, 160)] + [(999, k) for k in range(200, 240)] + [(5, 5), (7, 8), (7, 8)] + [(10**6 - k, 10**6 - k - 1) for k in range(40)]
    rng.shuffle(links)
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long"), few).collect()}
    groups = defaultdict(set)
    for node, root in found.items():
        groups[root].add(node)
    assert sorted(map(sorted, groups.values())) == sorted([list(range(100, 161)), [*range(200, 240), 999], [7, 8], list(range(10**6 - 40, 10**6 + 1))])
    assert graph.components(spark.createDataFrame([], "a long, b long"), few).count() == 0


def test_one_of_each_class_stays(spark, odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(1, ODD[0][1]), (2, None), (5, ODD[5][1]), (6, "a b c\nother row"), (7, ODD[9][1]), (None, ODD[4][1])]))


def brute_similar(texts, k=5, least=0.8):
    """The first of each class of the distinct texts with ids, linked at a Jaccard similarity of ``least`` over ``k`` words."""

    def shingled(text):
        words = (text or "").encode().lower().split()
        return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}

    sets, root = {i: shingled(t) for i, t in texts.items()}, {i: i for i in texts}
    for a in texts:
        for b in texts:
            if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) and root[a] != root[b]:
                root = {i: min(root[a], root[b]) if r in (root[a], root[b]) else r for i, r in root.items()}
    return set(root.values())


def test_similar_documents_by_brute_force(spark, odd, monkeypatch):
    import corpus_pipeline

    rng = random.Random(11)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for k in range(40):  # copies with a few words changed, from all alike to about half
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((12, 60, 300)))]
        texts[10**6 + 2 * k] = " ".join(words)
        for at in rng.sample(range(len(words)), max(1, len(words) * (k % 10) // 100)):
            words[at] = "other"
        texts[10**6 + 2 * k + 1] = " ".join(words)
    want = brute_similar(texts)
    df = spark.createDataFrame([(i, t, "s") for i, t in texts.items()], "doc_id long, text string, source string")
    found = [r.doc_id for r in corpus_pipeline.dedup_documents(spark, df, DATA).collect()]
    assert sorted(found) == sorted(want)
    assert want != {c for _, _, c in brute_classes([(i, brute_simhash(t)) for i, t in texts.items()])}
    monkeypatch.setattr(simhash, "PIECE", 2)  # every key and class takes several pieces, which meet in the second round
    monkeypatch.setattr(simhash, "PIECE_TEXTS", 2)
    assert sorted(r.doc_id for r in simhash.keep_dissimilar(df).collect()) == sorted(want)
    kept = simhash.keep_dissimilar(odd)
    assert kept.columns == odd.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, ((r.doc_id, r.text) for r in simhash.keep_one(odd).collect())))
    assert simhash.keep_dissimilar(odd.limit(0)).count() == 0


def test_similar_sets_are_linked_exactly():
    sets = [np.arange(a, a + 80, dtype=np.uint64) for a in (0, 8, 17, 300, 308, 500)]  # 72 of 88, 71 of 89 and so on
    links = {tuple(sorted(x)) for x in simhash.similar(sets, 0.8)}
    assert links == {(0, 1), (3, 4)}
    assert {tuple(sorted(x)) for x in simhash.similar(sets[:2] + [np.arange(16, 96, dtype=np.uint64)], 0.8)} == {(0, 1), (1, 2)}


# ---- shards


def test_flow_by_brute_force():
    rng = random.Random(9)
    for _ in range(200):
        supply = [rng.randrange(5) for _ in range(3)]
        capacity = [rng.randrange(5) for _ in range(3)]
        cost = [[rng.randrange(4) for _ in range(3)] for _ in range(3)]
        if sum(supply) > sum(capacity):
            with pytest.raises(ValueError):
                sharding.min_cost_flow(supply, capacity, cost)
            continue
        flow = sharding.min_cost_flow(supply, capacity, cost)
        assert [sum(r) for r in flow] == supply and all(sum(c) <= m for c, m in zip(zip(*flow), capacity))
        best = {tuple(capacity): 0}
        for i, s in enumerate(supply):
            for _ in range(s):
                step = {}
                for left, c in best.items():
                    for j in range(3):
                        if left[j]:
                            to = tuple(x - (k == j) for k, x in enumerate(left))
                            step[to] = min(step.get(to, 10**9), c + cost[i][j])
                best = step
        assert sum(f * c for fr, cr in zip(flow, cost) for f, c in zip(fr, cr)) == min(best.values())


def test_shards(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.reshard(docs).collect()
    sizes, slots, moved = Counter(), defaultdict(set), 0
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].add(r.slot)
        moved += r.size * (r.shard != r.old_shard)
    assert sum(map(len, slots.values())) == len(got) == docs.count()
    assert all(s == set(range(len(s))) for s in slots.values()) and set(sizes) == set(range(8))
    assert max(sizes.values()) / min(sizes.values()) < 1.01
    old = Counter()
    for r in got:
        old[r.old_shard] += r.size
    least = sum(max(0, n - sum(old.values()) / 8) for n in old.values())
    assert moved < 1.05 * least
    assert sorted(r.slot for r in sharding.reshard(odd).collect()) != [] and sharding.reshard(odd).count() == len(ODD)
    assert sharding.reshard(odd.limit(0)).count() == 0


def test_a_hot_text_is_split(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text"))
    sizes = sharding.reshard(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()
    assert max(r.b for r in sizes) - min(r.b for r in sizes) < 0.02 * max(r.b for r in sizes)


def test_equal_texts_stay_together_beside_heavy_ones(spark):
    rows = [(k, f"text {k // 4} " * 20) for k in range(400)] + [(1000 + k, "heavy " * (3000 + k)) for k in range(12)]
    got = sharding.reshard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    where = defaultdict(set)
    for r in got:
        where[r.text_crc32].add(r.shard)
    assert all(len(x) == 1 for x in where.values())


def test_rows_in_no_shard_and_repeated_rows(spark):
    rows = [(None if k % 9 == 0 else k // 3, f"t{k % 50}", None if k % 5 == 0 else k % 3) for k in range(300)] + [(7, "same", 1)] * 300
    df = spark.createDataFrame(rows, "doc_id long, text string, at int")
    got = sharding.reshard(df, 4, F.col("at")).collect()
    assert sorted(map(str, (r.doc_id for r in got))) == sorted(str(r[0]) for r in rows)
    slots = defaultdict(set)
    for r in got:
        slots[r.shard].add(r.slot)
    assert sum(map(len, slots.values())) == 600 and all(s == set(range(len(s))) for s in slots.values())
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) < 1.1 * min(sizes.values())


def test_only_affected_shards_are_rewritten(spark, tmp_path, monkeypatch):
    rows = [(None if k % 10 == 1 else k // 2, f"{k:05d}" * 3, "extra") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard_ string")
    path = str(tmp_path / "shards")
    number = F.substring("text", 1, 5).cast("int")
    sharding.write_shards(df, F.when(number < 200, 0).when(number < 300, 1).otherwise(number % 2 + 2), path)  # 200, 100, 50, 50
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "shards").glob("shard=*/*.parquet")}
    before = files()
    placement = sharding.reshard_files(spark, path, 4)
    assert placement.affected() == [0, 2, 3]
    assert {p: t for p, t in files().items() if "shard=1" in str(p)} == {p: t for p, t in before.items() if "shard=1" in str(p)}
    after = spark.read.parquet(path).collect()
    assert sorted(map(str, ((r.doc_id, r.text, r.shard_) for r in after))) == sorted(map(str, rows))
    assert max(Counter(r.shard for r in after).values()) <= 110
    sharding.reshard_files(spark, path, 2)  # two shards are emptied, and their folders go
    assert {p.name for p in (tmp_path / "shards").glob("shard=*")} == {"shard=0", "shard=1"}
    assert spark.read.parquet(path).count() == 400


# ---- pipeline


def test_pipeline(spark, odd):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
        seen[name] = docs.collect()
        if name != "sentencepieces":
            assert docs.columns == columns
        docs = spark.createDataFrame(seen[name], docs.schema)
    assert len(seen["language_id"]) >= 198
    texts = {r.doc_id: r.text for r in seen["line_dedup"]}
    want = brute_similar(texts)  # the stage's rule: five words and a similarity of 0.8
    assert {r.doc_id for r in seen["simhash_near_dedup"]} == want and len(seen["simhash_near_dedup"]) == len(want)
    assert {r.doc_id for r in seen["mixing"]} <= want
    got = corpus_pipeline.run(spark, DATA).collect()
    assert sorted((r.doc_id, r.ids_sha256) for r in got) == sorted((r.doc_id, r.ids_sha256) for r in seen["sentencepieces"])
    assert all(hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() == r.ids_sha256 for r in got)


def test_pipeline_of_odd_rows(spark, odd):
    import corpus_pipeline

    for rows in (odd, odd.limit(0)):
        docs = rows.withColumn("lang", F.lit("en"))
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, DATA)
            if name != "sentencepieces":
                assert docs.columns == columns
        docs.count()
