import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tabloom.llm import components, exact_dedup, simhash
from tests.llm.fixtures import awkward, awkward_rows, empty


def test_directory_doubles_and_splits():
    loads = np.zeros(1 << 6, dtype=np.int64)
    loads[5], loads[6], loads[40] = 60, 60, 10
    directory, depth = exact_dedup.grow_directory(loads, 100)
    assert len(directory) == 1 << depth.max()
    bits = len(directory).bit_length() - 1
    cells = directory[np.arange(64) >> (6 - bits)]
    assert cells[5] != cells[6]
    for b in np.unique(directory):
        assert loads[cells == b].sum() <= 100
    flat, _ = exact_dedup.grow_directory(loads, 1000)
    assert len(flat) == 1
    full, depth = exact_dedup.grow_directory(np.array([0, 500, 0, 0]), 100)
    assert depth.max() == 2  # one hash prefix above capacity stays whole


def _brute_groups(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    return {t: (max((i for i in ids if i is not None), default=None), len(ids)) for t, ids in groups.items()}


@pytest.mark.parametrize("capacity", [1, 200, 1 << 20])
@pytest.mark.parametrize("hash_of", [F.xxhash64, lambda t: F.length(t).cast("bigint") % 3 * (1 << 60)])
def test_exact_groups_even_when_hashes_collide(spark, capacity, hash_of):
    df = awkward(spark)
    got = exact_dedup.duplicate_groups(df, capacity=capacity, hash_of=hash_of).collect()
    want = _brute_groups(awkward_rows())
    by_id = {r[0]: r[1] or "" for r in awkward_rows() if r[0] is not None}
    assert len(got) == len(awkward_rows())
    for r in got:
        if r["doc_id"] is not None:
            assert (r["keep_id"], r["group_size"]) == want[by_id[r["doc_id"]]]
    assert sum(r["kept"] for r in got) == len(want)


def test_exact_kept_rows(spark):
    df = awkward(spark).repartition(5)
    kept = exact_dedup.kept_rows(df)
    assert kept.columns == df.columns
    assert sorted(r["text"] or "" for r in kept.collect()) == sorted(_brute_groups(awkward_rows()))
    assert exact_dedup.kept_rows(empty(spark)).count() == 0
    assert exact_dedup.duplicate_groups(empty(spark)).count() == 0


def _brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_matches_its_definition():
    for r in awkward_rows():
        assert simhash.fingerprint(None if r[1] is None else r[1].encode()) == _brute_fingerprint(r[1])
    assert simhash.fingerprint("É A b".encode()) == xxhash.xxh64_intdigest("É a b".encode(), 42)


def _brute_components(fps):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def _clustered(n, seed):
    rnd = random.Random(seed)
    centres = [rnd.getrandbits(64) for _ in range(max(1, n // 40))]
    out = set()
    while len(out) < n:
        x = rnd.choice(centres) if rnd.random() < 0.9 else rnd.getrandbits(64)
        for _ in range(rnd.randrange(7)):
            x ^= 1 << rnd.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("n", [1, 2, 31, 33, 700])
def test_gray_index_finds_all_pairs(n):
    fps = _clustered(n, n)
    got = set()
    for a, b in simhash.GrayIndex(np.array(fps, dtype=np.uint64), leaf=4, fan=3).join():
        got |= {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    assert got == {(i, j) for i in range(n) for j in range(i + 1, n) if (fps[i] ^ fps[j]).bit_count() <= 3}


def test_gray_rank_inverts_the_gray_code():
    x = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(x ^ (x >> np.uint64(1))) == x).all()


@pytest.mark.parametrize("node_rows", [16, 8192])
def test_links_and_components(spark, node_rows):
    fps = _clustered(600, 7)
    rows = [(f - (1 << 64) if f >> 63 else f, i) for i, f in enumerate(fps)]
    classes = spark.createDataFrame(rows, "fp bigint, rep bigint")
    found = components.smallest_reachable(simhash.links(classes, node_rows), "a", "b")
    got = {r["node"]: r["component"] for r in found.collect()}
    assert [got.get(i, i) for i in range(len(fps))] == _brute_components(fps)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(7, 7), (None, 3)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components.smallest_reachable(links, "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 61)}


def test_near_groups_on_awkward_rows(spark):
    got = simhash.near_groups(awkward(spark)).collect()
    rows = awkward_rows()
    assert len(got) == len(rows)
    known = [r for r in rows if r[0] is not None]
    fps = [_brute_fingerprint(r[1]) for r in known]
    root = _brute_components(fps)
    smallest = {}
    for r, c in zip(known, root):
        smallest[c] = min(smallest.get(c, r[0]), r[0])
    want = {r[0]: (f"{f:016x}", smallest[c]) for r, f, c in zip(known, fps, root)}
    for r in got:
        if r["doc_id"] is not None:
            assert (r["fingerprint"], r["component_id"]) == want[r["doc_id"]]
    assert simhash.near_groups(empty(spark)).count() == 0
    kept = simhash.kept_rows(awkward(spark))
    assert {r["doc_id"] for r in kept.collect()} == {None} | {i for i, (_, c) in want.items() if i == c}
