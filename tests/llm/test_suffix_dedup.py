"""Repeated passages against plain Python, and induced sorting against sorted suffixes."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from postlake.llm import induced, queries, suffix_dedup
from tests.llm.conftest import prose

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("letters", [2, 3, 6, 1000])
def test_suffix_array_and_prefixes(letters):
    rng = random.Random(letters)
    for _ in range(150):
        s = [rng.randint(1, letters) for _ in range(rng.randint(0, 70))] + [0]
        text = np.array(s)
        array = induced.suffix_array(text, letters + 1)
        assert array.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        cut = sorted(rng.sample(range(len(s)), min(3, len(s))))
        starts, stops = np.array(cut), np.array([*cut[1:], len(s) - 1])
        got = induced.permuted_prefixes(text, array, starts, stops)
        stop = {p: e for b, e in zip(cut, stops.tolist()) for p in range(b, e)}
        for before, at in zip(array, array[1:]):
            if at in stop:
                k = 0
                while before in stop and at + k < stop[at] and before + k < stop[before] and s[at + k] == s[before + k]:
                    k += 1
                assert got[at] == k


def test_long_runs():
    text = np.array([5] * 5000 + [1] * 300 + [5] * 400 + [0])
    assert induced.suffix_array(text, 258).tolist() == sorted(range(len(text)), key=lambda i: text[i:].tolist())


def brute(data, window=200):
    texts = [(t or "").encode() for _, t in data]
    seen = Counter(x[k : k + window] for x in texts for k in range(len(x) - window + 1))
    out = Counter()
    for (i, _), x in zip(data, texts):
        gone = np.zeros(len(x) + 2, dtype=np.int8)
        for k in range(len(x) - window + 1):
            if seen[x[k : k + window]] > 1:
                gone[k + 1 : k + 1 + window] = 1
        runs = int((np.diff(gone) == 1).sum())
        kept = bytes(c for c, g in zip(x, gone[1:]) if not g)
        out[(i, len(x), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


def as_rows(df):
    return Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in df.collect())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(41)
    passage, other = prose(rng, 60), prose(rng, 45)
    data = [(k, prose(rng, rng.randint(0, 60)) + " " + passage + " " + prose(rng, rng.randint(0, 60))) for k in range(40)]
    data += [(100 + k, prose(rng, 20) + passage[k : k + 190 + k] + other[: 150 + 5 * k] + prose(rng, 20)) for k in range(30)]
    base = prose(rng, 400)
    for k in range(20):  # near copies
        at = rng.randrange(len(base))
        data.append((200 + k, base[:at] + "Q" * rng.randint(0, 3) + base[at + rng.randint(0, 3) :]))
    data += [(300 + k, prose(rng, 90)) for k in range(15)]
    data += [(400, "a" * 1500), (401, "b" * 199), (402, "b" * 200), (403, "c" * 201), (404, "ab" * 400), (405, "line of text\n" * 60)]
    data += [(500, None), (501, ""), (None, base), (502, base), (502, base), (503, "ß" * 150 + "é" * 120), (504, "é" * 120), (505, "\0" * 450)]
    data += [(600, "x" + prose(random.Random(1), 90_000)), (601, prose(random.Random(1), 90_000)[200_000:400_000])]  # across steps of hashing
    return data


@pytest.mark.parametrize("crowded", [1 << 21, 900])
def test_removal_equals_brute_force(spark, texts, monkeypatch, crowded):
    monkeypatch.setattr(suffix_dedup, "CROWDED", crowded)
    df = spark.createDataFrame([(*x, "t", 1) for x in texts], "doc_id long, text string, t string, h int").repartition(6)
    assert as_rows(suffix_dedup.remove_repeats(df)) == brute(texts)


def test_query_equals_brute_force(spark):
    data = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert as_rows(queries.QUERIES["op12_induced_sorting"](spark, SF)) == brute(data)


def test_no_documents(nothing):
    assert suffix_dedup.remove_repeats(nothing).count() == 0
