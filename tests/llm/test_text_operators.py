"""Sharding, packing, notices, tiling, quality, suffix tree and HTML against plain Python."""

import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlake.llm import decontaminate, html_text, licenses, packing, quality, sharding, suffix_tree
from tests.llm.conftest import prose


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# sharding


def check_shards(out, total_rows, shards=40):
    assert len(out) == total_rows
    slots = defaultdict(list)
    for r in out:
        assert 0 <= r["shard"] < shards
        slots[r["shard"]].append(r["slot"])
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))


def test_shards_hold_every_row_once(odd, odd_rows):
    out = rows(sharding.assign(odd))
    check_shards(out, len(odd_rows))
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in odd_rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want


def test_shards_are_nearly_equal_and_split_a_hot_text(spark):
    rng = random.Random(1)
    data = [(k, prose(rng, rng.randint(20, 60))) for k in range(6000)] + [(k, "hot " * 40) for k in range(6000, 9000)]
    out = rows(sharding.assign(spark.createDataFrame(data, "doc_id long, text string")))
    check_shards(out, len(data))
    sizes = Counter()
    for r in out:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 40
    assert len(sizes) == 40 and max(sizes.values()) < 1.07 * mean and min(sizes.values()) > 0.93 * mean
    hot = {r["shard"] for r in out if r["doc_id"] >= 6000}
    assert len(hot) > 5


def test_small_groups_stay_together(spark):
    rng = random.Random(2)
    texts = [prose(rng, 40) for _ in range(1500)]
    data = [(k, texts[k % 1500]) for k in range(4500)]
    out = rows(sharding.assign(spark.createDataFrame(data, "doc_id long, text string"), 10))
    groups = defaultdict(set)
    for r in out:
        groups[r["text_crc32"]].add(r["shard"])
    assert all(len(g) == 1 for g in groups.values())


def test_one_row_repeated_is_still_split(spark):
    df = spark.createDataFrame([(5, "x y z" * 20)] * 2000, "doc_id long, text string")
    out = rows(sharding.assign(df, 8))
    check_shards(out, 2000, 8)
    assert len({r["shard"] for r in out}) == 8


def test_no_rows_to_shard(nothing):
    assert sharding.assign(nothing).count() == 0


def test_written_shards_keep_all_columns(spark, odd, odd_rows, tmp_path):
    sharding.write_shards(odd, str(tmp_path / "s"), 4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert Counter((r["doc_id"], r["text"], r["row"], r["key"], r["own_shard"]) for r in back.collect()) == Counter(odd_rows)


# packing


def test_packing_round_trip(odd, odd_rows):
    from tokenizers import Tokenizer

    out = rows(packing.pack_documents(odd, with_ids=True))
    tok = Tokenizer.from_file(packing.public_files()["json_path"])
    pieces = Counter()
    for i, t, *_ in odd_rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            pieces[(i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b]))] += 1
    got = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in out)
    assert got == pieces
    check_sequences(out)


def check_sequences(out, most=1024):
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= most
    return len(by)


def test_special_token_text_gets_the_id_of_the_file(spark):
    df = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    assert 50256 in rows(packing.pack_documents(df, with_ids=True))[0]["ids"]


def test_sequences_join_their_pieces(odd):
    packed = packing.pack_documents(odd, with_ids=True)
    assert sum(len(r["ids"]) for r in rows(packing.sequences(packed))) == sum(r["length"] for r in rows(packed))


def test_plan_is_as_good_as_best_fit_over_items():
    rng = random.Random(5)
    for _ in range(40):
        lengths = [min(64, max(1, int(rng.gauss(rng.choice([5, 20, 40]), 9)))) for _ in range(rng.randint(1, 400))]
        counts = Counter(lengths)
        filled, offsets, ranks = Counter(), defaultdict(list), Counter()
        for length, a, b, per, first, offset in packing.plan(counts, 64):
            assert ranks[length] == a
            ranks[length] = b
            for r in range(b - a):
                seq = first + r // per
                offsets[seq].append((offset + r % per * length, length))
                filled[seq] += length
        assert ranks == counts and max(filled.values()) <= 64
        for own in offsets.values():
            assert [o for o, _ in sorted(own)] == [0, *itertools.accumulate(x for _, x in sorted(own))][:-1]
        free = []  # plain best fit decreasing
        for x in sorted(lengths, reverse=True):
            fit = min((f for f in free if f >= x), default=None)
            if fit is not None:
                free.remove(fit)
            free.append((64 if fit is None else fit) - x)
        assert len(filled) == len(free)


def test_no_rows_to_pack(nothing):
    assert packing.pack_documents(nothing).count() == 0


# license notices


def brute_phrases(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    return len(words), sorted(places)


def test_phrases_match_plain_search(spark, odd_rows):
    extra = ["CC-BY CC by, cc by", "The MIT\nLicense and mit-license", "Apache  License; gnu General public LICENSE", "mit licenses", "ümit license"]
    data = [(i, t) for i, t, *_ in odd_rows] + [(900 + k, t) for k, t in enumerate(extra)]
    out = {(r["doc_id"]): r for r in rows(licenses.scan(spark.createDataFrame(data, "doc_id long, text string")))}
    for i, t in data:
        if i is None or i == 9:
            continue
        n, places = brute_phrases(t)
        r = out[i]
        assert (r["n_words"], r["n_base"]) == (n, len(places))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


@pytest.mark.parametrize("text, label, edits", [
    ("This is relesed under the MTI License, ok", "mit", 3),
    ("Licenced under teh Apache Licence v2", "apache", 4),
    ("GNU Genral Public Licence", "gpl", 2),
    ("Permission is hereby grantd, free of charge, to any persn obtaining a copy", "mit", 2),
])
def test_edited_notices_are_found(spark, text, label, edits):
    r = rows(licenses.scan(spark.createDataFrame([(1, "word " * 50 + text + " word" * 50)], "doc_id long, text string")))[0]
    assert label in r["labels"].split(",") and r["n_base"] == 0 and 0 < r["score"] < 1
    span = min((s for s in r["spans"] if s["label"] == label), key=lambda s: s["edits"])
    assert span["edits"] <= edits and span["start_word"] >= 50 and span["start_byte"] >= 250


def test_seeds_find_all_bounded_edits():
    """Pigeonhole: whatever the edits, the search reports the notice."""
    search, rng = licenses.NoticeSearch(), random.Random(8)
    for at, (notice, _, k) in enumerate(licenses.NOTICES):
        for _ in range(20):
            chars = list(notice)
            for _ in range(k):
                p = rng.randrange(len(chars))
                what = rng.randrange(3)
                if what == 0:
                    chars[p] = "z"
                elif what == 1:
                    del chars[p]
                else:
                    chars.insert(p, "z")
            assert any(f[0] == at for f in search(" lead in " + "".join(chars) + " tail "))


def test_every_place_of_a_notice_is_reported(spark):
    text = "licenced under the apache licence licensed under the apache license"
    r = rows(licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")))[0]
    found = sorted((s["start_word"], s["end_word"], s["edits"]) for s in r["spans"] if s["notice"] == "licensed under the apache license")
    assert found == [(0, 5, 2), (5, 10, 0)]


def test_a_megabyte_of_notices_is_read_in_linear_time(spark):
    def seconds(places):
        df = spark.createDataFrame([(1, "mit license licensd under the apache license " * places)], "doc_id long, text string")
        started = time.time()
        r = licenses.scan(df).select("n_base", "first_word", "last_word", F.size("spans").alias("n")).first()
        assert tuple(r) == (2 * places, 0, 7 * places - 2, places)
        return time.time() - started

    seconds(10)
    assert seconds(24_000) < 12 * max(seconds(6_000), 0.5)


def test_clean_text_has_no_label(spark):
    r = rows(licenses.scan(spark.createDataFrame([(1, prose(random.Random(4), 3000))], "doc_id long, text string")))[0]
    assert r["labels"] == "" and r["score"] == 0.0


# greedy string tiling


def brute_tiles(item, doc, least):
    """Greedy string tiling by definition: mark the longest common run of unmarked words until none is long enough."""
    used_i, used_d, covered = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while i + n < len(item) and d + n < len(doc) and item[i + n] == doc[d + n] and not used_i[i + n] and not used_d[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, d)
        n, i, d = best
        if n < least:
            return covered
        covered += n
        used_i[i : i + n] = used_d[d : d + n] = [True] * n


def test_tiles_equal_the_definition():
    rng = random.Random(6)
    for _ in range(60):
        item = [rng.randrange(6) for _ in range(rng.randint(3, 14))]
        doc = [rng.randrange(6) for _ in range(rng.randint(3, 30))]
        found = decontaminate.tiles(np.array(item, dtype=np.uint64), np.array(doc, dtype=np.uint64), 3)
        for i, d, n in found:
            assert item[i : i + n] == doc[d : d + n] and n >= 3
        assert len({x for i, _, n in found for x in range(i, i + n)}) == sum(n for *_, n in found)
        assert len({x for _, d, n in found for x in range(d, d + n)}) == sum(n for *_, n in found)
        assert max((n for *_, n in found), default=0) == max(
            (n for n in range(3, 15) for i in range(len(item) - n + 1) for d in range(len(doc) - n + 1) if item[i : i + n] == doc[d : d + n]), default=0
        )


def test_tiling_covers_what_the_definition_covers():
    rng = random.Random(9)
    for _ in range(40):
        item = [rng.randrange(10_000) for _ in range(30)]
        parts = [item[0:9], item[9:18], item[18:30]]
        rng.shuffle(parts)
        doc = [rng.randrange(10_000) for _ in range(20)] + [x for p in parts for x in [*p, rng.randrange(10_000)]]
        found = decontaminate.tiles(np.array(item, dtype=np.uint64), np.array(doc, dtype=np.uint64), 3)
        assert sum(n for *_, n in found) == brute_tiles(item, doc, 3) == 30


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(10)
    items = [(k, ". ".join(prose(rng, 8).capitalize() for _ in range(5)) + ".") for k in range(12)] + [(50, None), (51, ""), (52, "only three words"), (1, None)]
    docs, want = [], set()
    for k in range(12):
        sentences = items[k][1].split(". ")
        moved = sentences[:]
        rng.shuffle(moved)
        docs += [(k, prose(rng, 100) + " " + items[k][1] + " " + prose(rng, 50)), (100 + k, prose(rng, 60) + " " + ", ".join(moved).upper()),
                 (200 + k, prose(rng, 200)), (300 + k, prose(rng, 40) + " " + sentences[0] + " " + prose(rng, 40))]
        want |= {(k, k), (100 + k, k)}
    docs += [(400, None), (401, ""), (0, docs[0][1]), (402, "here ONLY three Words, stand")]
    want |= {(402, 52)}
    return docs, items, want


def test_contaminated_documents_are_found_and_clean_ones_left(spark, leaks):
    docs, items, want = leaks
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, item_id int, coverage int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (decontaminate.BLOCK_BYTES, 500):
        out = rows(decontaminate.overlaps(d, b, block_bytes=block))
        assert {(r["doc_id"], r["item_id"]) for r in out} == want and len(out) == len(want) + 1  # the repeated row repeats
        assert all(sum(t["length"] for t in r["tiles"]) / r["item_words"] == pytest.approx(r["coverage"]) for r in out)
        kept = rows(decontaminate.clean(d, b, block_bytes=block))
        assert {r["doc_id"] for r in kept} == {i for i, _ in docs} - {i for i, _ in want}
        assert set(kept[0]) == {"doc_id", "text", "item_id", "coverage"}


def test_decontamination_of_empty_tables(spark, nothing, odd):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.overlaps(odd, none).count() == 0 and decontaminate.clean(odd, none).count() == odd.count()
    assert decontaminate.clean(nothing, none).count() == 0


# quality


def test_rules_follow_tree_paths():
    text = (
        "RandomForest\n  Tree 0 (weight 1.0):\n    If (feature 0 <= 0.5)\n     If (feature 0 <= 0.25)\n      Predict: 0.0\n"
        "     Else (feature 0 > 0.25)\n      Predict: 1.0\n    Else (feature 0 > 0.5)\n     Predict: 1.0\n  Tree 1 (weight 1.0):\n    Predict: 1.0\n"
    )
    assert set(quality.tree_rules(text)) == {((0, True, 0.5),), ((0, True, 0.25),), ((0, False, 0.25), (0, True, 0.5)), ((0, False, 0.5),)}


def test_quality_on_held_out_labels(spark):
    rng = random.Random(12)
    data, labels = [], []
    for k in range(900):
        bad = k % 3 == 0
        text = prose(rng, rng.randint(30, 150))
        data.append((k, " ".join(w.upper() + "!!" for w in text.split()) if bad else text, 9, 0.5))
        if k % 5:
            labels += [(k, int(not bad), None)]
    data += [(1001, None, 9, 0.5), (1002, "", 9, 0.5), (None, "a b c", 9, 0.5), (7, data[7][1], 9, 0.5)]
    labels += [(None, 1, 0), (5000, 1, 0), (4, None, 0), labels[3]]
    docs = spark.createDataFrame(data, "doc_id long, text string, label int, stat_digits double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = rows(quality.score(docs, lab))
    assert len(out) == len(data)
    for r in out:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 4 == 2)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    held = [r for r in out if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 900]
    assert sum(r["predicted"] == int(r["doc_id"] % 3 != 0) for r in held) >= 0.99 * len(held)
    kept = rows(quality.keep_good(docs, lab))
    assert Counter(r["doc_id"] for r in kept) == Counter(r["doc_id"] for r in out if r["predicted"])
    assert set(kept[0]) == {"doc_id", "text", "label", "stat_digits"}


def test_quality_without_labels(spark, odd, nothing):
    lab = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in rows(quality.score(odd, lab))} == {0.5}
    assert quality.score(nothing, lab).count() == 0


# suffix tree


def check_base(out, data):
    counts, tokens = Counter(), {}
    for i, t in data:
        own = (t or "").encode().lower().split() + [b" "]
        tokens[i] = own
        if zlib.crc32(b"" if i is None else str(i).encode()) % 10:
            counts.update(own)
    total = sum(counts.values())
    floor = math.log10(total + 0.1 * (len(counts) + 1))
    for r in out:
        own = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), total)
        assert r["base_score"] == pytest.approx(sum(math.log10(counts[w] + 0.1) - floor for w in own), rel=1e-9)


def test_base_scores_equal_plain_counts(spark, odd_rows):
    data = [(i, t) for i, t, *_ in odd_rows if i is not None]
    out = rows(suffix_tree.score(spark.createDataFrame([(*x, 1) for x in data], "doc_id long, text string, `row` int")))
    assert len(out) == len(data)
    check_base(out, data)


def test_rare_words_take_the_join(spark, odd_rows, monkeypatch):
    monkeypatch.setattr(suffix_tree, "FREQUENT", 0.01)
    data = [(i, t) for i, t, *_ in odd_rows if i is not None]
    check_base(rows(suffix_tree.score(spark.createDataFrame(data, "doc_id long, text string"))), data)


def test_contexts_beat_word_counts(spark):
    rng = random.Random(14)
    cycle = "red green blue white black".split()
    data = [(k, " ".join(cycle[(k + j) % 5] for j in range(rng.randint(20, 60)))) for k in range(300)]
    out = rows(suffix_tree.score(spark.createDataFrame(data, "doc_id long, text string")))
    held = [r for r in out if r["held_out"]]
    assert held and all(r["score"] > 0.4 * r["base_score"] for r in held)


def test_scores_form_a_distribution(spark):
    """Probabilities of all one-token continuations, unseen ones included, stay within one."""
    data = [(k, "a b" if k % 2 else "a c") for k in range(1, 60)] + [(1000 + k, t) for k, t in enumerate(["a b", "a c", "a", "", "b", "c"])]
    out = rows(suffix_tree.score(spark.createDataFrame(data, "doc_id long, text string")))
    p = {r["doc_id"]: 10 ** r["score"] for r in out if r["doc_id"] >= 1000}
    assert sum(p.values()) <= 1.0


def test_no_texts_to_score(nothing, spark):
    assert suffix_tree.score(nothing).count() == 0
    one = spark.createDataFrame([(None, "a b")], "doc_id long, text string")
    r = rows(suffix_tree.score(one))[0]
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["base_score"] == pytest.approx(0.0)


# visible text


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"),
    ("<p>one<p>two", "one\n\ntwo"), ("<div>a</div><div>b</div>", "a\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"), ("<ol start=3><li>x</li><li>y</li></ol>", "3. x\n4. y"),
    ("<table><tr><th>Name<th>N<tr><td>alpha<td>1<tr><td>b<td>22</table>", "Name  | N\nalpha | 1\nb     | 22"),
    ("<table><tr><td><div>lay</div><div>out</div><td>x</table>", "lay\nout\nx"),
    ("<pre>\n a  b\n  c</pre>d", " a  b\n  c\n\nd"), ("x <b>bold</b>, <i> it</i>", "x bold, it"),
    ("<p hidden>no</p><p style='display:none'>no</p><p>yes</p>", "yes"), ("<script>if (a < b) '</p>'</script>t<style>x</style>", "t"),
    ("<head><title>t</title></head><body>b</body>", "b"), ("a<!-- <p>no</p> -->b", "ab"), ("1 < 2 <3", "1 < 2 <3"),
    ("text <a href='x", "text"), ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("<p title=\"a > b\">c</p>", "c"), ("<textarea>&lt;x</textarea>", "<x"),
    ("x<noscript>n</noscript><template>t</template>y", "xy"), ("<h1>H</h1>para", "H\n\npara"),
])
def test_rendering(page, text):
    assert html_text.visible_text(page or "") == text


def test_captions_and_row_groups_may_nest_at_any_depth():
    assert html_text.visible_text("<table><caption>a" * 5000).split() == ["a"] * 5000
    assert html_text.visible_text("<table><caption>x <b>y</b>\n<p>z</caption><tr><td>1<td>2</table>t") == "x y z\n1 | 2\n\nt"
    assert html_text.visible_text("<table><colgroup>" * 2000 + "<colgroup>" * 5000 + "<tr><td>1<td>2") == "1 | 2"


def test_extract_keeps_every_row(spark):
    data = [(1, None, 5), (2, "", 5), (None, "<p>x", 5), (3, "<div>" * 5000 + "deep", 5), (3, "<div>" * 5000 + "deep", 5)]
    out = rows(html_text.extract(spark.createDataFrame(data, "page_id long, html string, text int")))
    assert sorted((str(r["page_id"]), r["text"], r["n_lines"]) for r in out) == sorted(
        [("1", "", 0), ("2", "", 0), ("None", "x", 1), ("3", "deep", 1), ("3", "deep", 1)]
    )


@pytest.mark.parametrize("part", ["<nav ", '<div class="a">', '<a "', "<p>", "</p>", "<li><ul>", "<table><tr><td>", "<table><caption>a", "<", "&", "<script>", "<b><p>"])
def test_time_grows_with_the_page(part):
    def seconds(size):
        started = time.process_time()
        html_text.visible_text(part * (size // len(part)))
        return time.process_time() - started

    seconds(20_000)
    assert seconds(400_000) < 12 * max(seconds(100_000), 0.02)


# odd column names

def test_columns_with_dots_and_ticks_come_through(spark, tmp_path):
    data = [(k, prose(random.Random(k), 40 + k), k, f"t{k}") for k in range(1, 41)]
    docs = spark.createDataFrame(data, "doc_id long, text string, `a.b` long, `c``d` string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 41)], "doc_id long, quality int")
    assert rows(quality.keep_good(docs, labels, threshold=0.0).orderBy("doc_id")) == rows(docs.orderBy("doc_id"))
    sharding.write_shards(docs, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted((r["doc_id"], r["a.b"], r["c`d"]) for r in rows(back)) == [(k, k, f"t{k}") for k in range(1, 41)]
