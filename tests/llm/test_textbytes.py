import random

import numpy as np
import pyarrow as pa

from chronica.llm import textbytes

TEXTS = ["One two three four five six", None, "", "one TWO three four five", "a", "a b c d", "x" * 5000, "é ü, ß-中 \U0001f600!", "one two three four five six one two three four five six"]


def by_hand(text):
    import pyarrow.compute as pc

    words, word = [], ""
    for c in pc.utf8_lower(pa.scalar(text or "")).as_py() + " ":
        if c.isascii() and not c.isalnum():
            if word:
                words.append(word)
            word = ""
        else:
            word += c
    return words


def test_words_and_shingles_of_rows():
    rng = random.Random(0)
    texts = TEXTS + [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 12))) for _ in range(200)]
    words, first = textbytes.word_hashes(pa.array(texts, pa.string()))
    hashes, owner = textbytes.shingles(words, first)
    names, seen = {}, {}
    for i, t in enumerate(texts):
        mine = by_hand(t)
        assert first[i + 1] - first[i] == len(mine)
        for w, h in zip(mine, words[first[i] : first[i + 1]].tolist()):
            assert names.setdefault(w, h) == h
        want = [tuple(mine)] if 0 < len(mine) < 5 else list(zip(*(mine[k:] for k in range(5))))
        got = hashes[owner == i].tolist()
        assert len(got) == len(want)
        for s, h in zip(want, got):
            assert seen.setdefault(s, h) == h
    assert len(set(names.values())) == len(names) and len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_the_buffer():
    data = np.frombuffer(b"abc" * 50 + b"needle" + b"z" * 900 + b"needle", np.uint8)
    h = textbytes.span_hashes(data, np.array([150, 1056]), np.array([156, 1062]))
    alone = textbytes.span_hashes(np.frombuffer(b"needle", np.uint8), np.array([0]), np.array([6]))
    assert h[0] == h[1] == alone[0]
    empty = textbytes.span_hashes(np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(empty) == 0


def test_row_hashes_tell_sequences_apart():
    words, first = textbytes.word_hashes(pa.array(["a b", "b a", "A, b.", "", None, "a", "a b c"]))
    h = textbytes.row_hashes(words, first, 1)
    assert h[0] == h[2] and h[3] == h[4] and len(set(h.tolist())) == 5
    assert (h != textbytes.row_hashes(words, first, 2)).all()


def test_spans_stop_at_rows():
    data = np.frombuffer(b"aab" + b"baa" + b"" + b"c", np.uint8)
    offsets = np.array([0, 3, 6, 6, 7])
    starts, ends, first = textbytes.spans(data != ord("a"), offsets)
    assert list(zip(starts, ends)) == [(2, 3), (3, 4), (6, 7)] and first.tolist() == [0, 1, 2, 2, 3]


def test_sliced_and_null_columns():
    column = pa.array(["zz", "ab", None, "c"])[1:]
    data, offsets = textbytes.utf8(column)
    assert bytes(data) == b"abc" and offsets.tolist() == [0, 2, 2, 3]
