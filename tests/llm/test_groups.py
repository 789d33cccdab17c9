"""Components, MinHash groups, embeddings, archives and the pipeline against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from postlake.llm import embeddings, minhash, queries, warc
from postlake.llm.common import connected_components
from tests.llm.conftest import edited, prose
from tests.llm.test_text_operators import check_sequences, rows
from tests.oracle import compare, connect


class Union:
    def __init__(self, nodes):
        self.parent = {n: n for n in nodes}

    def root(self, n):
        while self.parent[n] != n:
            n = self.parent[n]
        return n

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.parent[b] = a


@pytest.mark.parametrize("kind", ["chain", "star", "random", "none", "two"])
def test_connected_components(spark, kind):
    rng = random.Random(21)
    edges = {
        "chain": [(k, k + 1) for k in range(200)], "star": [(500, k) for k in range(300)], "none": [], "two": [(1, 2), (2, 1), (3, 3)],
        "random": [(rng.randrange(400), rng.randrange(400)) for _ in range(300)],
    }[kind]
    df = spark.createDataFrame(edges, "a long, b long")
    want = Union({n for e in edges for n in e})
    for a, b in edges:
        want.join(a, b)
    got = {r["node"]: r["component"] for r in rows(connected_components(df))}
    linked = {n for a, b in edges if a != b for n in (a, b)}
    assert got == {n: want.root(n) for n in linked}


# MinHash


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def brute_groups(data, percent):
    sets = [shingle_set(t) for _, t in data]
    union = Union(range(len(data)))
    for x in range(len(data)):
        for y in range(x):
            if sets[x] and sets[y]:
                both = len(sets[x] & sets[y])
                if 100 * both >= percent * len(sets[x] | sets[y]):
                    union.join(x, y)
    members = defaultdict(list)
    for k, (i, _) in enumerate(data):
        members[union.root(k)].append(i)
    return [(i, len(sets[k]), min((x for x in members[union.root(k)] if x is not None), default=None)) for k, (i, _) in enumerate(data)]


@pytest.fixture(scope="module")
def copies(odd_rows):
    rng = random.Random(22)
    data = [(i, t) for i, t, *_ in odd_rows]
    for g in range(8):
        base = prose(rng, rng.randint(40, 200))
        data += [(1000 + 50 * g + k, edited(rng, base, rng.randint(0, 4))) for k in range(rng.randint(2, 25))]
    line = " ".join(prose(rng, 30).split())
    data += [(3000 + k, line + " " + prose(rng, 12)) for k in range(60)]
    return data


@pytest.mark.parametrize("percent", [80, 85])
def test_components_equal_all_pairs(spark, copies, percent):
    df = spark.createDataFrame([(*x, "c", 1) for x in copies], "doc_id long, text string, cls string, unit int")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows(minhash.components(df, percent)))
    want = Counter((i, n, c, None if i is None or c is None else i == c) for i, n, c in brute_groups(copies, percent))
    assert got == want


@pytest.mark.parametrize(("region", "frequent", "window"), [(8, 1 << 17, 32), (16, 64, 1)])
def test_crowded_regions_are_contracted_and_joined_by_rare_shingles(spark, monkeypatch, region, frequent, window):
    """Copies of one text with few and with many edits: one large component and many open sets around it.

    A window of one shingle lets most pairs be passed on more than once, which must not change the result.
    """
    rng = random.Random(23)
    base = prose(rng, 150)
    data = [(k, edited(rng, base, rng.randint(0, 7))) for k in range(150)]
    monkeypatch.setattr(minhash, "REGION", region)
    monkeypatch.setattr(minhash, "FREQUENT", frequent)
    monkeypatch.setattr(minhash, "WINDOW", window)
    df = spark.createDataFrame(data, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in rows(minhash.components(df, 85))}
    assert got == {i: c for i, _, c in brute_groups(data, 85)}


def test_template_pages_of_full_size_keep_their_partners(spark):
    """2,000 pages of one template with regions of the default size; every page has one partner above the threshold."""
    rng = random.Random(27)
    template = prose(rng, 255)
    data = []
    for k in range(1000):
        own = template + " " + prose(rng, 3)
        data += [(2 * k + side, own + " " + prose(rng, 31)) for side in range(2)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(8)
    got = {r["doc_id"]: r["component_id"] for r in rows(minhash.components(df, 80))}
    assert got == {i: i // 2 * 2 for i, _ in data}


def test_template_pages_keep_their_one_partner(spark, monkeypatch):
    """Pages of one template fill every region; each has one partner just above the threshold and resembles all others."""
    rng = random.Random(25)
    template = prose(rng, 255)
    data = []
    for k in range(100):
        own = template + " " + prose(rng, 3)
        for side in range(2):
            data.append((2 * k + side, own + " " + prose(rng, 31)))
    want = {i: c for i, _, c in brute_groups(data, 80)}
    assert want == {i: i // 2 * 2 for i, _ in data}
    monkeypatch.setattr(minhash, "REGION", 4)
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in rows(minhash.components(df, 80))} == want


@pytest.mark.parametrize("percent", [80, 85])
def test_trees_are_enough(percent):
    rng = np.random.default_rng(26)
    depth = minhash.DEPTH
    chances = np.prod((rng.binomial(minhash.POSITIONS, percent / 100, 20_000)[:, None] - np.arange(depth)) / (512 - np.arange(depth)), axis=1)
    assert np.mean((1 - chances) ** minhash.trees(percent)) < 3 * minhash.MISS


def test_one_of_each_group_stays(spark, copies):
    df = spark.createDataFrame([(*x, "c", 1) for x in copies], "doc_id long, text string, doc string, one int")
    out = rows(minhash.keep_first(df, 80))
    assert set(out[0]) == {"doc_id", "text", "doc", "one"}
    groups = brute_groups(copies, 80)
    want = Counter()
    seen = set()
    for (i, n, c), (_, text) in zip(groups, copies):
        if n == 0:
            want[(i, text)] += 1
        elif i == c and i not in seen:
            seen.add(i)
            want[(i, text)] += 1
    assert Counter((r["doc_id"], r["text"]) for r in out) == want


def test_no_documents(nothing):
    assert minhash.components(nothing).count() == 0 and minhash.keep_first(nothing).count() == 0


def test_signatures_estimate_similarity():
    rng = random.Random(24)
    buffer = np.empty((2048, minhash.POSITIONS), dtype=np.uint32)
    errors = []
    for _ in range(60):
        base = prose(rng, 300)
        a, b = (minhash.shingles(t.encode()) for t in (base, edited(rng, base, rng.randint(1, 30))))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        sa, sb = (np.frombuffer(minhash.signature(x, buffer), dtype=np.uint8) for x in (a, b))
        errors.append((sa == sb).mean() - true - (1 - true) / 256)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03


# embeddings


def brute_vectors(data, threshold):
    ok = []
    for _, v, label in data:
        good = label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.append(np.array(v, dtype=np.float32).astype(np.float64) if good else None)
    union, links = Union(range(len(data))), Counter()
    for x in range(len(data)):
        for y in range(x):
            a, b = ok[x], ok[y]
            if a is None or b is None or data[x][2] != data[y][2] or len(a) != len(b):
                continue
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= threshold:
                union.join(x, y)
                links[x] += 1
                links[y] += 1
    members = defaultdict(list)
    for k, d in enumerate(data):
        members[union.root(k)].append(d[0])
    return Counter((d[0], links[k], min(members[union.root(k)])) for k, d in enumerate(data))


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(25)
    data = []
    for g in range(30):
        centre = rng.normal(size=16)
        for _ in range(int(rng.integers(1, 25))):
            data.append((len(data), (centre + rng.normal(scale=rng.choice([0.1, 0.3]), size=16)).tolist(), int(g % 3)))
    data += [(len(data) + k, data[5][1], 0) for k in range(80)]
    n = len(data)
    data += [(n, None, 1), (n + 1, [], 1), (n + 2, [0.0] * 16, 1), (n + 3, [float("nan")] * 16, 1), (n + 4, [float("inf")] + [1.0] * 15, 1),
             (n + 5, [None] + [1.0] * 15, 1), (n + 6, data[0][1], None), (n + 7, [1.0, 2.0], 1), (n + 8, [2.0, 4.0], 1), (0, data[0][1], 0)]
    return data


@pytest.mark.parametrize("tile", [4096, 20])
def test_links_equal_all_pairs(spark, vectors, tile):
    df = spark.createDataFrame([(*v, 1, 2) for v in vectors], "vec_id long, embedding array<float>, label int, cls int, pair int")
    got = Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in rows(embeddings.near_duplicates(df, 0.93, tile)))
    assert got == brute_vectors(vectors, 0.93)


def test_early_stop_changes_nothing():
    rng = np.random.default_rng(26)
    a = rng.normal(size=(60, 48)) * np.linspace(3, 0.1, 48)
    a = np.concatenate([a, a + rng.normal(scale=0.05, size=a.shape)])
    unit = a / np.linalg.norm(a, axis=1)[:, None]
    turn, _ = np.linalg.qr(rng.normal(size=(48, 48)))
    for rotation in (None, turn):
        assert (embeddings.linked(unit[:70], unit[70:], 0.9, rotation) == (unit[:70] @ unit[70:].T >= 0.9)).all()


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert embeddings.near_duplicates(none).count() == 0
    bad = spark.createDataFrame([(1, None, 1), (2, [0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows(embeddings.near_duplicates(bad))} == {(1, 0, 1, True), (2, 0, 2, True)}


# archive


def test_archive_round_trip(spark, tmp_path):
    big, other = "x" * 999 + "é", "y" * 5000
    data = [(1, "http://a/1", big), (2, None, big), (3, "u\r\nEvil: 1", "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""),
            (7, "u", other), (9, "u", big), (9, "u", big), (None, "u", other), (8, "u", "z" * 999), (10, "u", "z" * 999)]
    df = spark.createDataFrame([(*d, "r", 3) for d in data], "page_id long, url string, html string, `row` string, digest int")
    warc.write_archive(df, str(tmp_path / "w"))
    out = rows(warc.read_archive(spark, str(tmp_path / "w")))
    assert len(out) == len(data)
    got = Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in out)
    want, used = Counter(), set()
    for page, _, text in data:
        payload = (text or "").encode()
        first = max((p for p, _, t in data if (t or "") == (text or "") and p is not None), default=None)
        lead = len(payload) < 1000 or (page == first and (page, text) not in used)
        used.add((page, text))
        want[(page, len(payload), hashlib.sha1(payload).hexdigest(), "response" if lead else "revisit", None if lead else first)] += 1
    assert got == want
    assert spark.read.parquet(str(tmp_path / "w/payloads")).count() == len({t or "" for *_, t in data})
    for r in out:
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n") and rest.endswith(b"\r\n\r\n")
        assert int(fields["Content-Length"]) == len(rest) - 4 and "Evil" not in fields
        assert fields["WARC-Payload-Digest"] == "sha1:" + hashlib.sha1(bytes(r["payload"])).hexdigest()
        if r["record_type"] == "response":
            assert rest[:-4].endswith(b"\r\n\r\n" + bytes(r["payload"]))


def test_damaged_payload_is_noticed(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archive(spark.createDataFrame([(1, "u", "a")], "page_id long, url string, html string"), path)
    spark.createDataFrame([("0" * 64, bytearray(b"b"))], "digest string, payload binary").write.mode("overwrite").parquet(path + "/payloads")
    with pytest.raises(Exception, match="does not match digest"):
        warc.read_payloads(spark, path).collect()


def test_empty_archive(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archive(spark, path).count() == 0


# pipeline and registered queries


def write(spark, folder, table, data, schema):
    spark.createDataFrame(data, schema).write.parquet(f"{folder}/{table}.parquet")


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(27)
    folder = str(tmp_path_factory.mktemp("corpus"))
    clean = [(k, prose(rng, rng.randint(30, 200))) for k in range(300)]
    junk = [(1000 + k, " ".join(w.upper() + "!!" for w in prose(rng, 80).split())) for k in range(120)]
    near = [(2000 + k, edited(rng, clean[k][1], 1)) for k in range(40) if len(clean[k][1].split()) > 60]
    exact = [(3000 + k, clean[50][1]) for k in range(100)]
    items = [(k, prose(rng, 40)) for k in range(10)]
    leaked = [(4000 + k, prose(rng, 50) + " " + items[k][1]) for k in range(10)]
    docs = clean + junk + near + exact + leaked + [(5000, None), (5001, "")]
    write(spark, folder, "documents", [(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    write(spark, folder, "labels", [(i, int(i < 1000), 0) for i, _ in clean[:250] + junk[:100]], "doc_id long, quality int, toxic int")
    write(spark, folder, "benchmark", items, "item_id long, text string")
    return folder, clean, junk, near, exact, leaked


def test_pipeline_stage_by_stage(spark, corpus):
    folder, clean, junk, near, exact, leaked = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "decontamination", "packing"]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = rows(docs)
        docs = stage(spark, docs, folder)
        kept[name] = rows(docs)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert {r["doc_id"] for r in kept[name]} <= {r["doc_id"] for r in before}
    good = {r["doc_id"] for r in kept["quality"]}
    assert not good & {i for i, _ in junk} and good >= {i for i, _ in clean + near + exact + leaked}
    groups = brute_groups([(r["doc_id"], r["text"]) for r in kept["quality"]], 80)
    assert {r["doc_id"] for r in kept["near_duplicates"]} == {i for i, n, c in groups if n == 0 or i == c}
    assert {r["doc_id"] for r in kept["decontamination"]} == {r["doc_id"] for r in kept["near_duplicates"]} - {i for i, _ in leaked}
    assert {r["doc_id"] for r in kept["packing"]} == {r["doc_id"] for r in kept["decontamination"]}
    check_sequences(kept["packing"])
    whole = rows(corpus_pipeline.run(spark, folder))
    key = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert Counter(tuple(r[k] for k in key) for r in whole) == Counter(tuple(r[k] for k in key) for r in kept["packing"])


def test_registered_queries_return_their_columns(spark):
    want = {
        "op1_": {"doc_id", "item_id", "coverage"}, "op2_": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
        "op3_": {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
        "op4_": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
        "op5_": {"doc_id", "held_out", "score", "predicted"}, "op6_": {"doc_id", "n_shingles", "component_id", "kept"},
        "op7_": {"doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"},
        "op8_": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
        "op9_": {"vec_id", "n_links", "component_id", "kept"}, "op10_": {"page_id", "text"},
    }
    for prefix, columns in want.items():
        own = [q for q in queries.QUERIES if q.startswith(prefix)]
        assert len(own) == 1
        df = queries.QUERIES[own[0]](spark, "/root/testdata/sf0.001")
        assert columns <= set(df.columns) and df.count() > 0, own


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    ok, note = compare(spark, connect(folder), name, queries.QUERIES[name], queries.ORACLES[name], folder)
    assert ok, note
