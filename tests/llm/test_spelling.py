"""Spelling variants against all pairs in plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from postlake.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def brute_words(data):
    counts = Counter()
    for doc_id, text in data:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            counts[word] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute(data):
    words = brute_words(data)
    # words one edit apart agree before or behind their middle, near enough to a third of the shorter one
    held = {}
    for w in words:
        for key in {w[:3], w[-3:]}:
            held.setdefault(key, set()).add(w)
    form, near = {}, {}
    for w, n in words.items():
        own = {v for key in {w[:3], w[-3:]} for v in held[key] if one_edit(w, v)}
        near[w] = len(own)
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, near[w], words[form[w]] if form[w] else None))
    return out


def as_rows(df):
    return [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]


@pytest.fixture(scope="module")
def texts():
    """Few letters and many lengths, so that words are neighbours in every way and fall on both sides of the cut points."""
    rng = random.Random(31)
    pool = ["".join(rng.choices("abé", k=rng.randint(6, 10))) for _ in range(700)]
    pool += ["a" * k for k in range(5, 75)] + ["a" * k + "b" for k in (30, 63, 64, 65, 66)] + ["b" * 64 + x for x in "abc"] + ["Éab×baÀb", "éab×baàb"]
    data = [(k, " ".join(rng.choices(pool, weights=[1 / (j + 1) for j in range(len(pool))], k=rng.randint(0, 120)))) for k in range(150)]
    data += [(5000 + k, "commonword " * 30 + "commonwrd comonword commonwords Commonword comonwrd") for k in range(4)]
    data += [(7, None), (8, ""), (None, "aaaaaaaa-aaaaaaaa"), (9, "bababab1bababab_BABABAB"), (10, "x" * 300_000), (11, "x" * 300_000), (11, "x" * 300_000)]
    return data


@pytest.mark.parametrize("ranges", [1, 4, 40])
def test_variants_equal_all_pairs(spark, texts, monkeypatch, ranges):
    monkeypatch.setattr(spelling, "RANGES", ranges)
    df = spark.createDataFrame([(*x, "w", 1) for x in texts], "doc_id long, text string, word string, number int").repartition(6)
    got = as_rows(spelling.variants(df))
    assert len(got) == len(set(got)) and set(got) == brute(texts)


def test_query_equals_brute_force(spark):
    data = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = as_rows(queries.QUERIES["op11_trie_pairs"](spark, SF))
    want = brute(data)
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_no_documents(nothing):
    assert spelling.variants(nothing).count() == 0
