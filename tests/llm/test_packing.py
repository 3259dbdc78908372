import zlib
from collections import Counter, defaultdict

from corpus import docs, empty_docs, nasty, odd_docs  # noqa: F401
import numpy as np
import public_tokenizers
import pytest
from ludex.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return np.array(Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids + [2], "<u4")


@pytest.mark.parametrize("text", ["It's  a\ttest\n\nof <|endoftext|> 123,456 'll we're", "naïve Ångström ´x´ ŒUVRE İstanbul", "", "\n", " a b c\x1cd\x85e ",
                                  "日本語 text 🎉🎉 mixed'd", "é ̈x ﬁ", "a" * 5000])
def test_pieces_encode_like_the_whole(text):
    assert packing.WordTokenizer(PATH).encode([None, text, ""])[1].tolist() + [2] == ids_of(text).tolist()


def check(pieces, rows, size):
    """Each id in exactly one piece, sequences gapless and full but for the last."""
    want = Counter((d, len(x), zlib.crc32(x.tobytes())) for d, x in ((r[0], ids_of(r[1])) for r in rows))
    by_seq = defaultdict(list)
    for p in pieces:
        by_seq[p.sequence_id].append(p)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for k, ps in by_seq.items():
        ps.sort(key=lambda p: p.offset)
        at = 0
        for p in ps:
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == size if k < len(by_seq) - 1 else 0 < at <= size
    texts = defaultdict(set)
    for r in rows:
        texts[(r[0], len(x))].add(x.tobytes()) if (x := ids_of(r[1])) is not None else None
    parts = Counter()
    for p in pieces:
        fit = [t for t in texts[(p.doc_id, p.doc_tokens)] if zlib.crc32(t[4 * p.start:4 * (p.start + p.length)]) == p.ids_crc32]
        assert fit
        parts[(p.doc_id, p.doc_tokens)] += p.length
    total = Counter()
    for (d, n, _), k in want.items():
        total[(d, n)] += n * k
    assert parts == total


@pytest.mark.parametrize("weights,size", [(None, 256), ({"a": 5, "hot": 1}, 256), ({"a": 1, "b": 1, "hot": 30, None: 2}, 64), (None, 4096)])
def test_packs_every_id_once(odd_docs, nasty, weights, size):
    check(packing.pack(odd_docs, PATH, weights=weights, size=size).collect(), nasty, size)


def test_target_proportions_hold_in_every_window():
    totals, size = [100_003, 31_007, 4_000], 512
    plan = packing.mixture_plan(totals, None, size)
    sent = defaultdict(Counter)
    for q, t in enumerate(totals):
        js, offs, starts = packing._pieces(plan, q, 0, t, size)
        for j, n in zip(js, np.diff(np.r_[starts, t])):
            sent[int(j)][q] += int(n)
    windows = sorted(sent)
    assert windows == list(range(-(-sum(totals) // size)))
    assert all(sum(sent[j].values()) == size for j in windows[:-1])
    share = [t / sum(totals) for t in totals]
    run = np.zeros(3)
    for j in windows[:-8]:                                  # deficits stay below a token, within the quantised target
        run += [sent[j][q] for q in range(3)]
        assert np.all(np.abs(run - (j + 1) * size * np.array(share)) < 1.5 + (j + 1) * size / packing.SCALE)


@pytest.mark.parametrize("totals,weights,size", [([5], None, 4), ([1, 1, 1], [0, 0, 1], 2), ([1000, 1], [1, 1000], 7), ([3] * 50, None, 8), ([0, 9], None, 4), ([], None, 4),
                                                 ([10_000, 3, 777, 0, 1], [1, 1, 1, 1, 1], 16)])
def test_plan_covers_all_queues(totals, weights, size):
    plan = packing.mixture_plan(totals, weights, size)
    seen = Counter()
    for q, t in enumerate(totals):
        for first in range(0, t, 37):
            n = min(37, t - first)
            js, offs, starts = packing._pieces(plan, q, first, n, size)
            lens = np.diff(np.r_[starts, n])
            assert starts[0] == 0 and (lens > 0).all()
            for j, o, m in zip(js, offs, lens):
                for x in range(m):
                    seen[(int(j), int(o) + x)] += 1
    assert sorted(seen) == [(k // size, k % size) for k in range(sum(totals))] and set(seen.values()) <= {1}


def test_empty_table(empty_docs):
    assert packing.pack(empty_docs, PATH).count() == 0
