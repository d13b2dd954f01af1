import hashlib
import random

import numpy as np
import pytest

from eventscope.llm import bwt, repeats
from eventscope.llm.queries import op10_repeats


def brute(rows, length=50):
    first = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        number = -1 if doc_id is None else doc_id
        for p in range(len(data) - length + 1):
            gram = data[p : p + length]
            first[gram] = min(first.get(gram, number), number)
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, dtype=bool)
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < (-1 if doc_id is None else doc_id):
                gone[p : p + length] = True
        gone = gone[:-1]
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc_id, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(rng, n):
    def words(k):
        return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9))) for _ in range(k))

    passages = [words(30) for _ in range(6)] + ["ab" * 60, "z" * 130, "line\n" * 30]
    out = []
    for _ in range(n):
        parts = [words(rng.randrange(20)) for _ in range(rng.randrange(1, 5))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts.insert(rng.randrange(len(parts) + 1), p[a : a + rng.choice([49, 50, 51, 80, 200])])
        out.append("".join(parts))
    out += [out[0], out[1], out[1][:-1], "", "x", "y" * 49, "y" * 50, "y" * 51, "y" * 400, "é" * 60]
    return out


def page(rows):
    return bwt.Page.of([r[0] for r in rows], [r[1].encode() for r in rows])


def test_every_equal_string_has_an_anchor_in_the_same_place():
    rng = random.Random(1)
    string = "".join(rng.choice("abc") for _ in range(50))
    texts = ["".join(rng.choice("abc") for _ in range(rng.randrange(90))) for _ in range(40)]
    places = set()
    for text in texts:
        p = page([(0, text + string + text[::-1])])
        places.add(tuple(a - len(text) for a in bwt.anchors(p).place if 0 <= a - len(text) <= 26))
    assert set.intersection(*map(set, places))


def test_stretches_change_nothing(monkeypatch):
    rows = list(enumerate(corpus(random.Random(2), 30)))
    whole = bwt.anchors(page(rows))
    monkeypatch.setattr(bwt, "STRETCH", 97)
    assert (bwt.anchors(page(rows)).place == whole.place).all()
    assert (bwt.anchors(page(rows)).around == whole.around).all()


def test_merge_sorts_and_finds_common_prefixes():
    rng = np.random.default_rng(3)
    rows = rng.integers(97, 99, (300, bwt.WIDTH), dtype=np.uint8)
    rows[rng.integers(0, 300, 120)] = rows[rng.integers(0, 300, 120)]
    parts = [rows[:90], rows[90:91], rows[91:]]
    shards = [bwt.Shard.of(p) for p in parts]
    bases = [0, 90, 91]
    for c, interleave, shared in bwt.merged(shards):
        at, order = [0] * 3, []
        for s in interleave:
            order.append(bases[s] + shards[s].order[c][at[s]])
            at[s] += 1
        tails = [rows[i, c:].tobytes() for i in order]
        assert tails == sorted(tails)
        for a, b, n in zip(tails, tails[1:], shared[1:]):
            k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
            assert n == min(k, 50)


def check(spark, folder, rows):
    got = op10_repeats(spark, folder).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("page_bytes, shard", [(1 << 21, 1 << 14), (1500, 40)])
def test_query(spark, write_tables, monkeypatch, page_bytes, shard):
    monkeypatch.setattr(repeats, "PAGE_BYTES", page_bytes)
    monkeypatch.setattr(bwt, "SHARD", shard)
    rng = random.Random(4)
    rows = [(i * 3 + 1, t) for i, t in enumerate(corpus(rng, 120))]
    rng.shuffle(rows)
    rows += [(None, rows[3][1]), (500, None), rows[5], rows[5], (rows[7][0], rows[8][1])]
    rows += [(10_000 + i, "one passage that is in very many documents, word for word. " * 2 + str(i)) for i in range(150)]
    folder = write_tables(documents=(rows, "doc_id long, text string, n_bytes string, kept int"))
    check(spark, folder, rows)


def edges(rng):
    """Texts alike from the first byte on, up to the last, or in all bytes."""
    def letters(n):
        return "".join(rng.choice("abcdefgh ") for _ in range(n))

    head, tail, short, whole = letters(70), letters(70), letters(60), letters(500)
    return [head + letters(300) for _ in range(20)] + [letters(300) + tail for _ in range(20)] + [short] * 20 + [whole] * 20


def test_cut_contexts_are_folded_with_equal_bounds():
    rng = random.Random(6)
    texts = edges(rng)
    rows = list(enumerate(texts))
    for some, once in [(rows[40:60], rows[40:41]), (rows[60:], rows[60:61])]:
        p = page(some)
        found = bwt.anchors(p)
        assert bwt.fold(p, found, bwt.contexts(p, found))[2].sum() == len(bwt.anchors(page(once)).place)
    # Zero bytes of a text are not those that stand for a cut.
    p = page([(0, texts[40]), (1, "\0" * 26 + texts[40] + "\0" * 50)])
    found = bwt.anchors(p)
    first, _, own = bwt.fold(p, found, bwt.contexts(p, found))
    assert (found.low[first] == found.low).all() and (found.high[first] == found.high).all()
    assert own[found.doc == 1].all()


@pytest.mark.parametrize("page_bytes", [1 << 21, 2500])
def test_edges(spark, write_tables, monkeypatch, page_bytes):
    monkeypatch.setattr(repeats, "PAGE_BYTES", page_bytes)
    rng = random.Random(7)
    rows = list(enumerate(edges(rng)))
    rows += [(200, "\0" * 30 + rows[45][1] + "\0" * 60), (201, "x" + rows[45][1]), (202, rows[45][1][:-1]), (3, rows[45][1])]
    rng.shuffle(rows)
    check(spark, write_tables(documents=(rows, "doc_id long, text string")), rows)


def test_long_text_and_empty_table(spark, write_tables):
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefghij ") for _ in range(300_000))
    rows = [(1, long[1000:2000]), (2, long), (3, "same " * 30_000), (4, "same " * 20)]
    check(spark, write_tables(documents=(rows, "doc_id long, text string")), rows)
    assert op10_repeats(spark, write_tables(documents=([], "doc_id long, text string"))).count() == 0
