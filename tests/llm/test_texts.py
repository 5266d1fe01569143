"""Operators that take each text by itself: fingerprints, media columns, SentencePiece, languages and quality."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rangeflow.llm import common, fingerprints, languages, media, quality, sentencepieces
from tests.conftest import DATA

ODD = [(1, "one two three"), (2, None), (3, ""), (4, "one two three"), (None, "no id"), (5, "x" * 300_000), (6, " \n\t "), (6, "same id"), (7, "é日本😀 ́"), (6, "same id")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns under names that the operators use."""
    rows = [(i, t, "l", t, 1) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fingerprint string, score int")


# ---- fingerprints


def brute_cuts(data: bytes) -> list[int]:
    """Byte by byte, as the method is defined."""
    h, start, out = 0, 0, []
    for i, b in enumerate(data):
        h = ((h << 1) + int(fingerprints.GEAR[b])) & 0xFFFFFFFF
        size, end = i + 1 - start, i + 1
        bits = fingerprints.STRICT if size < fingerprints.NORMAL else fingerprints.LOOSE
        if end < len(data) and (size >= fingerprints.MAX or size >= fingerprints.MIN and h < 1 << (32 - bits)):
            out.append(end)
            start = end
    return out + [len(data)] * (len(data) > start)


def test_chunks_by_brute_force():
    rng = random.Random(1)
    for _ in range(60):
        data = bytes(rng.choice(b"abcdefgh \n") for _ in range(rng.randrange(0, 1500)))
        assert fingerprints._cuts(data) == brute_cuts(data)


def test_chunks_resist_shifts():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghij ") for _ in range(5000))
    a, b = fingerprints.chunk_set(text), fingerprints.chunk_set("inserted" + text)
    assert fingerprints.containment(a, b) > 0.9
    assert fingerprints.containment(a, fingerprints.chunk_set(text[::-1])) < 0.1
    assert np.array_equal(fingerprints.parse(fingerprints.render(a)), a)
    empty = fingerprints.chunk_set(None)
    assert (fingerprints.containment(empty, empty), fingerprints.containment(empty, a), fingerprints.containment(a, empty)) == (1.0, 0.0, 0.0)


def brute_compare(rows):
    def place(r):
        h = 42 if r[1] is None else xxhash.xxh64_intdigest(r[1].encode(), 42)
        return -(2**63) if r[0] is None else r[0], h - (h >> 63 << 64)

    order = sorted(rows, key=place)
    for k, (i, text) in enumerate(order):
        text, other = text or "", order[(k + 1) % len(order)][1] or ""
        n = len(text) // 4
        new = text[: len(text) - n] + other[:n]
        a, b, c = map(fingerprints.chunk_set, (text, new, other))
        yield i, len(text), hashlib.sha256(new.encode()).hexdigest(), fingerprints.render(a), fingerprints.render(b), fingerprints.containment(a, b), fingerprints.containment(a, c)


def test_compare_with_next_by_brute_force(spark, odd):
    rng = random.Random(3)
    rows = [(rng.randrange(10**6), "".join(rng.choice("abcd é\n") for _ in range(rng.randrange(0, 900)))) for _ in range(400)]
    rows = list(dict(rows).items())
    got = fingerprints.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(7))
    assert sorted(map(tuple, got.collect())) == sorted(brute_compare(rows))
    some = [r for r in ODD if r != (6, "same id")] + [(6, "same id")]  # repeated rows have no order of their own
    got = fingerprints.compare_with_next(odd.dropDuplicates(["doc_id", "text"]).repartition(3))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_compare(some)))


def test_hot_and_large_ids(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcd ") for _ in range(n))
    rows = [(i, word(60)) for i in (2**63 - 1, 2**63 - 2, -(2**63), -(2**63) + 1, 2**62 + 1, 2**62 + 2, 0)]
    rows += [(77, word(90)) for _ in range(120)] + [(None, word(50)) for _ in range(60)] + [(k, word(40)) for k in range(40)]
    got = fingerprints.compare_with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, brute_compare(rows)))
    rows += [(78, "one text " * 9)] * 150  # repeated rows are split too
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()
    assert sorted(map(str, map(tuple, fingerprints.compare_with_next(df).collect()))) == sorted(map(str, brute_compare(rows)))
    points = fingerprints._cut_points(df.withColumns({"key": F.coalesce("doc_id", F.lit(fingerprints.LOW)), "print": F.xxhash64("text")}), 32)
    assert any(p[2] != fingerprints.LOW for p in points) and sum(p[0] == 77 for p in points) > 3


def test_fingerprints_of_little(spark, odd):
    assert fingerprints.compare_with_next(odd.limit(0)).count() == 0
    alone = fingerprints.compare_with_next(odd.where("doc_id = 1")).first()
    assert alone.near_next == 1.0
    assert fingerprints.fingerprint(odd).count() == len(ODD)
    assert fingerprints.compare_with_next(odd).count() == len(ODD)


# ---- media columns


def test_png_round_trip_and_damage():
    rng = np.random.default_rng(1)
    for shape in ((1, 64, 3), (5, 7, 1), (30, 64, 3), (4, 3, 4), (3, 9, 2)):
        samples = rng.integers(0, 256, shape, dtype=np.uint8)
        assert np.array_equal(media.read_png(media.write_png(samples)), samples)
    file = media.write_png(samples)
    for at in (9, 20, len(file) // 2, len(file) - 3):
        with pytest.raises(media.MediaError):
            media.read_png(file[:at] + bytes([file[at] ^ 1]) + file[at + 1 :])
    with pytest.raises(media.MediaError):
        media.read_png(file[:-5])
    with pytest.raises(media.MediaError):
        media.read_png(b"")


@pytest.mark.parametrize("kind", range(5))
def test_every_filter_is_undone(kind):
    rng = np.random.default_rng(kind)
    height, width, depth = 6, 5, 3
    raw = rng.integers(0, 256, (height, width * depth), dtype=np.int64)
    lines = []
    for y in range(height):
        line = []
        for x in range(width * depth):
            a = raw[y, x - depth] if x >= depth else 0
            b = raw[y - 1, x] if y else 0
            c = raw[y - 1, x - depth] if y and x >= depth else 0
            guess = a + b - c
            paeth = a if abs(guess - a) <= abs(guess - b) and abs(guess - a) <= abs(guess - c) else b if abs(guess - b) <= abs(guess - c) else c
            line.append((raw[y, x] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        lines.append(line)
    found = media._unfilter(np.full(height, kind, dtype=np.uint8), np.array(lines, dtype=np.uint8), depth)
    assert np.array_equal(found, raw)


def test_media_columns(spark, odd):
    got = media.read_media(media.media_columns(odd)).collect()
    assert len(got) == len(ODD)
    by_text = {}
    for r in got:
        for i, t in ODD:
            if i == r.doc_id and len((t or "").encode()) == r.n_bytes:
                payload = (t or "").encode().ljust(max(1, -(-r.n_bytes // 192)) * 192)
                assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
                by_text.setdefault(t or "", set()).add((r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by_text.values())
    assert media.read_media(media.media_columns(odd.limit(0))).count() == 0


def brute_cosines(data: bytes) -> np.ndarray:
    """By the definitions: every cell is the mean over its area, every coefficient a sum over all cells."""
    grey = [[sum(data[192 * y + 3 * x : 192 * y + 3 * x + 3]) / 3 for x in range(64)] for y in range(len(data) // 192)]
    h = len(grey)

    def parts(size, cell):
        lo, hi = cell * size / 32, (cell + 1) * size / 32
        return [(i, min(hi, i + 1) - max(lo, i)) for i in range(int(lo), min(size, int(np.ceil(hi)))) if min(hi, i + 1) > max(lo, i)]

    cells = [[sum(grey[y][x] * a * b for y, a in parts(h, v) for x, b in parts(64, u)) / (h / 32 * 2) for u in range(32)] for v in range(32)]
    cosine = lambda k, x: np.cos(np.pi * k * (2 * x + 1) / 64)
    low = [sum(cells[y][x] * cosine(j, y) * cosine(k, x) for y in range(32) for x in range(32)) for j in range(8) for k in range(8)]
    return np.array(low) - np.median(low[1:])


def test_the_hash_by_its_definition(monkeypatch):
    rng = random.Random(6)
    for n in (0, 150, 900, 12_000, 40_000):
        text = "".join(rng.choice("abc defg\né") for _ in range(n))
        size, samples = media.to_samples(text)
        want = brute_cosines(samples.tobytes())
        clear = np.abs(want) > 0.05  # nearer to the median, the rounding of single floats decides
        assert n < 900 or clear.sum() > 50
        for tall in (1024, 7):
            monkeypatch.setattr(media, "TALL", tall)
            bits = np.unpackbits(np.frombuffer(bytes.fromhex(media.cosine_hash(samples)), dtype=np.uint8))
            assert np.array_equal(bits[clear], (want > 0)[clear])


def test_a_file_never_inflates_beyond_its_head():
    import struct

    bomb = media.SIGNATURE + media._chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 1, 8, 0, 0, 0, 0)) + media._chunk(b"IDAT", zlib.compress(bytes(10**7))) + media._chunk(b"IEND", b"")
    with pytest.raises(media.MediaError):
        media.read_png(bomb)


def test_the_hash_follows_low_frequencies():
    _, x = media.to_samples("the quick brown fox " * 400)
    a = int(media.cosine_hash(x), 16)
    b = int(media.cosine_hash(np.minimum(x.astype(int) + 3, 255).astype(np.uint8)), 16)
    assert (a ^ b).bit_count() <= 4


# ---- SentencePiece


@pytest.fixture(scope="module")
def table():
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return sentencepieces.PrefixTable(f.read())


def test_encodes_as_the_library_does(table):
    rng = random.Random(4)
    alphabet = "ab the in▁ \n\té日x01.,'😀́A<s>"
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 40)))
        assert table.encode(text) == table.library.encode(text, add_eos=True), text
    for _ in range(60):
        text = " " * rng.randrange(40) + "a" * rng.randrange(40) + " " * rng.randrange(40) + "\n" * rng.randrange(3)
        assert table.encode(text) == table.library.encode(text, add_eos=True), text


def test_encodes_documents_and_back(spark, odd, table):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for df in (docs, odd):
        texts = {(r.doc_id, r.text) for r in df.collect()}
        got = sentencepieces.encode(df, path)
        want = set()
        for i, t in texts:
            ids = table.library.encode(t or "", add_eos=True)
            want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(table.library.decode(ids).encode()).hexdigest()))
        assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()} == want
        assert sentencepieces.decode(got, path).count() == df.count()
    back = {r.doc_id: r.text for r in sentencepieces.decode(sentencepieces.encode(docs, path), path).collect()}
    assert all(back[r.doc_id] == r.text for r in docs.collect())
    assert sentencepieces.encode(odd.limit(0), path).count() == 0


def test_segments_beyond_the_kept_ones(table, monkeypatch):
    monkeypatch.setattr(sentencepieces, "KEPT", 5)
    text = " ".join(f"word{k % 17}." for k in range(200))
    assert table.encode(text) == table.library.encode(text, add_eos=True)


# ---- languages


def test_other_operators_empty_what_encoding_kept(table):
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        own = sentencepieces._table(f.read())
    text = "one two three and some more words"
    ids = own.encode(text)
    assert own.kept and own.apart
    assert list(common.rows(iter(()), sentencepieces.__name__)) == [] and own.kept
    assert list(common.rows(iter(()))) == [] and not own.kept and not own.older and not own.apart
    assert own.encode(text) == ids == table.encode(text)


def test_tables_answer_as_the_network_does():
    net = languages.ByteConvolution(["a", "b"])
    windows = languages._windows("Straße über alles, déjà vu et cetera".encode() * 20)
    p, best = net.weights, []
    for w in languages.WIDTHS:
        x = p["embed"][windows]
        columns = np.concatenate([x[:, j : languages.WINDOW - w + 1 + j] for j in range(w)], axis=2)
        best.append((columns @ p[f"filter{w}"] + p[f"bias{w}"]).max(axis=1))
    want = np.maximum(np.concatenate(best, axis=1), 0) @ p["dense"] + p["offset"]
    assert np.allclose(languages.answers(net.tables(), windows), want, atol=1e-3)


def test_gradients_by_differences():
    net = languages.ByteConvolution(["a", "b", "c"])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    windows, target = languages._windows(b"some bytes to learn from, more than one window of them" * 12), None
    target = np.arange(len(windows)) % 3

    def loss():
        p, best = net.weights, []
        x = p["embed"][windows]
        for w in languages.WIDTHS:
            columns = np.concatenate([x[:, j : languages.WINDOW - w + 1 + j] for j in range(w)], axis=2)
            best.append((columns @ p[f"filter{w}"] + p[f"bias{w}"]).max(axis=1))
        logits = np.maximum(np.concatenate(best, axis=1), 0) @ p["dense"] + p["offset"]
        return (np.log(np.exp(logits).sum(axis=1)) - logits[np.arange(len(windows)), target]).mean()

    grads = net._step(windows, target)
    for name, at in (("dense", (3, 1)), ("offset", (2,)), ("filter3", (5, 2)), ("bias2", (1,)), ("embed", (ord("m"), 3))):
        net.weights[name][at] += 1e-6
        up = loss()
        net.weights[name][at] -= 2e-6
        assert abs((up - loss()) / 2e-6 - grads[name][at]) < 1e-4
        net.weights[name][at] += 1e-6


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return languages.train(docs.where(languages.fold(4) != 2), per_language=300)


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(languages.fold(4) == 2)
    both = languages.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    assert both.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_odd_languages(spark, odd, model):
    got = languages.predict(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert {r.doc_id for r in got if r.lang_pred == "und"} >= {2, 3}
    signs = spark.createDataFrame([(1, "½ ² Ⅷ ٣ 12_3 !?"), (2, "½ a"), (3, "字"), (4, "\u0301")], "doc_id long, text string")
    assert {r.doc_id for r in languages.predict(signs, model).collect() if r.lang_pred == "und"} == {1, 4}
    assert languages.predict(odd.limit(0), model).count() == 0
    none = languages.train(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in languages.predict(odd, none).collect()} == {"und"}
    kept = languages.reject_unknown(odd, model)
    assert kept.columns == odd.columns and {r.text for r in kept.collect()}.isdisjoint({None, "", " \n\t "})
    assert languages.reject_unknown(odd.limit(0), model).count() == 0


def test_languages_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(languages, "MOST_LANGUAGES", 2)
    monkeypatch.setattr(languages, "STEPS", 5)
    rows = [(k, f"some text {k}", lang) for k, lang in enumerate("aaabbbcdefg")]
    assert languages.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))["languages"] == ["a", "b"]


# ---- quality


def test_trees_by_brute_force():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((600, quality.WIDTH)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(np.float64)
    trees = quality.BoostedTrees().fit(x, y)
    got = trees.score(x)
    assert ((got > 0.5) == y).mean() > 0.97
    for i in range(0, 600, 50):
        raw = trees.base
        for t in range(len(trees.feature)):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + 1 + int(x[i, trees.feature[t, node]] > trees.threshold[t, node])
            raw += trees.value[t, node - (2**quality.DEPTH - 1)]
        assert abs(1 / (1 + np.exp(-raw)) - got[i]) < 1e-9
    assert quality.BoostedTrees().fit(x[:0], y[:0]).score(x[:3]).tolist() == [0.5] * 3
    assert quality.BoostedTrees().fit(x, np.ones(600)).score(x[:1])[0] > 0.99


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels.where(languages.fold(5) != 0))
    both = quality.score(docs, model).join(labels.where(languages.fold(5) == 0), "doc_id").toPandas()
    good, bad = both[both.quality == 1].score.to_numpy(), both[both.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.93


def test_odd_quality(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (4, None, 0), (None, 1, 0), (6, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels)
    got = quality.score(odd, model).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(odd.limit(0), model).count() == 0
    assert {r.score for r in quality.score(odd, quality.train(odd, labels.limit(0))).collect()} == {0.5}
    assert np.isfinite(quality.statistics(None)).all() and np.isfinite(quality.statistics("\x00")).all()


def test_splits_have_the_largest_gains():
    """The first level of the first tree against every split by loops."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((300, quality.WIDTH)).astype(np.float32)
    y = (x[:, 5] + 0.5 * rng.standard_normal(300) > 0.2).astype(np.float64)
    trees = quality.BoostedTrees().fit(x, y)
    p = y.mean()
    g, h = p - y, np.full(300, p * (1 - p))

    def gain(own):
        part = lambda some: g[some].sum() ** 2 / (h[some].sum() + quality.PENALTY)
        return part(own) + part(~own) - part(np.ones(300, dtype=bool)) if min(h[own].sum(), h[~own].sum()) >= 1 else 0

    best = max(gain(x[:, f] <= t) for f in range(quality.WIDTH) for t in np.unique(np.quantile(x[:, f], np.linspace(0, 1, quality.BINS + 1)[1:-1])).astype(np.float32))
    assert abs(gain(x[:, trees.feature[0, 0]] <= trees.threshold[0, 0]) - best) < 1e-6


# ---- the registered queries, against what their contracts say


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]


def run_query(name, spark):
    from rangeflow.llm import registry

    return registry.QUERIES[name](spark, DATA)


def crc_of_id(i):
    return zlib.crc32(str(i).encode())


def test_query_1(spark, documents):
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in run_query("op1_fingerprints", spark).collect()]
    assert sorted(got) == sorted(brute_compare([(i, t) for i, t, _ in documents]))


def test_query_2(spark, documents, table):
    want = set()
    for i, t, _ in documents:
        ids = table.library.encode(t or "", add_eos=True)
        want.add((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(table.library.decode(ids).encode()).hexdigest()))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run_query("op2_sentencepieces", spark).collect()} == want


def test_query_7(spark, documents):
    got = {r.doc_id: r for r in run_query("op7_media_columns", spark).collect()}
    assert len(got) == len(documents)
    for i, t, _ in documents:
        data = (t or "").encode()
        payload = data.ljust(max(1, -(-len(data) // 192)) * 192)
        file = media.write_png(np.frombuffer(payload, dtype=np.uint8).reshape(-1, 64, 3))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
    for i, t, _ in documents[:6]:
        want = brute_cosines((t or "").encode().ljust(max(1, -(-len((t or "").encode()) // 192)) * 192))
        bits = np.unpackbits(np.frombuffer(bytes.fromhex(got[i].feature), dtype=np.uint8))
        clear = np.abs(want) > 0.05
        assert np.array_equal(bits[clear], (want > 0)[clear])


def test_query_8(spark, documents):
    got = {r.doc_id: r for r in run_query("op8_languages", spark).collect()}
    known = {lang for i, _, lang in documents if crc_of_id(i) % 4 != 2 and lang}
    right = []
    for i, t, lang in documents:
        r = got[i]
        assert r.held_out == (crc_of_id(i) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (t is None or not any(map(str.isalpha, t))) and r.lang_pred in known | {"und"}
        right += [r.lang_pred == lang] if r.held_out and lang and r.lang_pred != "und" else []
    assert len(got) == len(documents) and np.mean(right) > 0.9


def test_query_9(spark, documents):
    got = run_query("op9_sharding", spark).collect()
    want = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in documents)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got) == want
    shards = {}
    for r in got:
        assert (r.law, r.grown_shard) == ("bytes", None)
        shards.setdefault(r.shard, []).append(r)
    assert set(shards) == set(range(8)) and all(sorted(r.slot for r in own) == list(range(len(own))) for own in shards.values())
    sizes = [sum(r.size for r in own) for own in shards.values()]
    assert max(sizes) - min(sizes) <= 2 * max(r.size for r in got)
    assert len({(r.text_crc32, r.size, r.shard) for r in got}) == len({(r.text_crc32, r.size) for r in got})


def test_query_10(spark, documents):
    got = {r.doc_id: r for r in run_query("op10_quality", spark).collect()}
    assert len(got) == len(documents)
    for i, _, _ in documents:
        r = got[i]
        assert r.held_out == (crc_of_id(i) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
