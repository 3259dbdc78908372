import random
from collections import Counter

from corpus import docs, empty_docs, nasty, odd_docs  # noqa: F401
import brute
import numpy as np
import pytest
from ludex.llm import simhash
from ludex.llm.common import connected_components


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_matches_brute_force(docs, nasty):
    got = simhash.simhash_groups(docs).select("doc_id", "fp", "component_id").collect()
    fps, _, comp = brute.simhash([(r[0], r[1]) for r in nasty])
    assert Counter(map(tuple, got)) == Counter((r[0], signed(f), c) for r, f, c in zip(nasty, fps, comp))


def test_spark_hash_is_the_shingle_hash(spark):
    assert spark.sql("select xxhash64('a b c') h").first().h == signed(__import__("xxhash").xxh64_intdigest(b"a b c", 42))


def test_empty_and_clashing_columns(empty_docs, odd_docs, nasty):
    assert simhash.simhash_groups(empty_docs).count() == 0
    assert simhash.keep_one_per_group(empty_docs).count() == 0
    assert simhash.simhash_groups(odd_docs).count() == len(nasty)


def test_keeps_one_row_of_each_group(odd_docs, nasty):
    kept = simhash.keep_one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns
    _, root, comp = brute.simhash([(r[0], r[1]) for r in nasty])
    rows = kept.collect()
    assert len(rows) == len(set(root))
    want = {}
    for r, (d, *_) in zip(root, nasty):
        want[r] = min(want.get(r, (True, 0)), (d is None, d or 0))
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in rows) == Counter(want.values())


@pytest.mark.parametrize("bits", [3])
def test_links_find_every_component(spark, bits):
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base) | {0}
    for b in base[:12]:
        x = b
        for _ in range(25):                            # chains and clouds
            x = (x if rng.random() < .6 else b) ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(1, 5))) & (1 << 64) - 1
            fps.add(x)
    cloud = rng.getrandbits(64)
    fps |= {cloud ^ k for k in range(200)}
    fps = sorted(fps)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = {r.v: r.root for r in connected_components(simhash.near_links(df, bits)).collect()}
    root = brute.components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= bits])
    mine = {}
    for f, r in zip(fps, root):
        mine.setdefault(r, set()).add(signed(f))
    theirs = {}
    for f in map(signed, fps):
        theirs.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100)] + [(1000, 1000 + k) for k in range(200)] + [(5000, 5000), (None, 3), (7000, 7001), (7001, 7000)]
    got = {r.v: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[k] for k in range(101)}) == 1 and len({got[1000 + k] for k in range(200)}) == 1
    assert got[7000] == got[7001] and len(set(got.values())) == 3 and 5000 not in got
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_text_fingerprint_is_chunked():
    t = " ".join(str(k % 977) for k in range(40_000))
    assert simhash.fingerprint(t) == brute.fingerprint(t)
    assert np.uint64(simhash.fingerprint(None)) == 0
