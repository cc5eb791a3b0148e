import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from ferrule.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(pieces, texts, window):
    """Every id once, gapless sequences, right checksums."""
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    expected = Counter()
    for i, t in texts:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        for start in range(0, len(ids), window):
            part = ids[start : start + window]
            expected[(i, start, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces) == expected
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return sequences


def test_round_trip_and_padding(spark, docs, rows):
    got = packing.pack(spark, docs, PATH).collect()
    sequences = check(got, [(r[0], r[1]) for r in rows], 2048)
    used = sum(p.length for p in got)
    assert len(sequences) <= -(-used // 2048) + 1


def test_small_window(spark, docs, rows):
    got = packing.pack(spark, docs.where("doc_id <> 200 or doc_id is null"), PATH, window=64).collect()
    check(got, [(r[0], r[1]) for r in rows if r[0] != 200], 64)


def test_empty(spark, no_docs):
    assert packing.pack(spark, no_docs, PATH).count() == 0


def test_words_alone_give_the_same_ids():
    tokenizer = tokenizers.Tokenizer.from_file(PATH)
    for text in ("don't I'LL  x\u00a0y\u2003z", "a<|endoftext|>b", "e\u0301 \u0301x ǅ İ ẞ", "ΣΑΣ ΣΑΣ.", "1234 a1b2 😀😀\u200d!"):
        assert np.frombuffer(packing.token_ids(text.encode(), PATH), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=30))
def test_plan_places_every_rank_once(counts):
    seen = {k: [0] * n for k, n in counts.items()}
    rooms = Counter()
    for length, low, high, sequence, times, within in packing.plan(counts, 64):
        for rank in range(low, high):
            seen[length][rank] += 1
            rooms[sequence + (rank - low) // times] += length
            assert within + (rank - low) % times * length + length <= 64
    assert all(x == 1 for n in seen.values() for x in n)
    assert all(v <= 64 for v in rooms.values())


def test_least_squares_never_goes_negative_and_fits():
    counts = {10: 30, 54: 20, 22: 9, 32: 5}
    columns = packing.combinations(counts, 64)
    x = packing.least_squares(columns, counts)
    assert all(v >= 0 for v in x)
    fitted = Counter()
    for c, v in zip(columns, x, strict=True):
        for a in c:
            fitted[a] += v
    assert all(abs(fitted[k] - n) < 10 for k, n in counts.items())


def test_words_get_the_tokenizers_own_ids():
    import random

    tokenizer, words = tokenizers.Tokenizer.from_file(PATH), packing._Words(PATH)
    rng = random.Random(4)
    letters = "abcdefgzéüßñÉÜßĳŉſŁłŒœªºµ'.,;:!?-…İı0123ǅǆ\u0301ſtÅΩ<|>’“"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(20000)] + [chr(i) + x for i in range(0x21, 0x250) for x in ("", ".", "b,")]
    for text in texts + ["<|endoftext|>", "<|ENDOFTEXT|>.", "it's", "IT'S,", "e\u0301."]:
        if text.split() == [text]:
            assert words[text.encode()] == np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_a_tokenizer_that_joins_words_is_refused(tmp_path):
    import pytest

    other = tokenizers.Tokenizer(tokenizers.models.WordLevel({"ab cd": 0, "?": 1}, unk_token="?"))
    other.save(str(tmp_path / "other.json"))
    with pytest.raises(ValueError):
        packing._Words(str(tmp_path / "other.json"))
