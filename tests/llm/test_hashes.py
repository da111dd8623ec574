"""Words and strings made to collide in sums of powers: the parities of a counter's bits."""

import numpy as np
import pytest

from panelkit.llm import jaccard, kneser, suffixes
from panelkit.llm.words import word_hashes

FIRST = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
OTHER = FIRST.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("size", [1, 7, 8, 9, 16, 64, 100, 128, 168, 1024])
def test_words_of_parities_differ(size):
    own, starts = word_hashes(np.frombuffer(f"{FIRST[:size]} {OTHER[:size]} {FIRST[:size].upper()}\n".encode(), np.uint8), True)
    assert starts.tolist() == [0, size + 1, 2 * size + 2]
    assert own[0] == own[2] != own[1]
    # No more bits agree than by chance.
    assert 10 < bin(int(own[0] ^ own[1])).count("1") < 54


def test_hash_of_a_word_does_not_depend_on_its_place():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcé"), n)) for n in rng.integers(1, 40, 2000)]
    own, _ = word_hashes(np.frombuffer((" ".join(words) + "\n").encode(), np.uint8), False)
    by_word = {}
    for w, h in zip(words, own.tolist(), strict=True):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)
    assert len(word_hashes(np.frombuffer(b" \n\t", np.uint8), True)[0]) == 0


@pytest.mark.parametrize("size", [1, 5, 8, 32, 50, 64, 100, 128, 167, 168])
def test_strings_of_parities_differ(size):
    text = suffixes.Text(f"{FIRST[:size]}{OTHER[:size]}x{FIRST[:size]}".encode())
    starts = np.array([0, size, 2 * size + 1])
    own = text.ranks(starts, starts + size)
    assert own[0] == own[2] != own[1]
    assert 10 < bin(int(own[0] ^ own[1])).count("1") < 54


def test_ranks_are_equal_where_strings_are():
    rng = np.random.default_rng(2)
    data = bytes(rng.choice(np.frombuffer(b"ab\x80\xff", np.uint8), 3000).tolist())
    text = suffixes.Text(data)
    for size in (2, 6, 9, 12):
        at = np.arange(len(data) - size + 1)
        seen = {}
        for i, rank in zip(at.tolist(), text.ranks(at, at + size).tolist(), strict=True):
            assert seen.setdefault(data[i:i + size], rank) == rank
        assert len(set(seen.values())) == len(seen)


def test_operators_tell_such_words_apart(spark, tmp_path):
    rest = "one two three four five six"
    docs = spark.createDataFrame([(1, f"{FIRST} {rest}"), (2, f"{OTHER} {rest}"), (3, FIRST), (4, OTHER)], "doc_id long, text string")
    joined = {r.doc_id: r.component_id for r in jaccard.join(docs, k=4, percent=85).collect()}
    assert joined == {1: 1, 2: 2, 3: 3, 4: 4}
    model = kneser.train(docs.where("doc_id = 3"), order=2)
    known = {r.doc_id: r.n_known for r in kneser.score_frame(docs.where("doc_id > 2"), model).collect()}
    assert known == {3: 2, 4: 1}
    twice = spark.createDataFrame([(1, FIRST[:168]), (2, OTHER[:168]), (3, FIRST[:168])], "doc_id long, text string")
    removed = {r.doc_id: r.n_removed for r in suffixes.cleaned(twice).collect()}
    whole = {1: 0, 2: 0, 3: 168}
    for d, (text, before) in {1: (FIRST[:168], []), 2: (OTHER[:168], [FIRST[:168]])}.items():
        seen, covered = {b[i:i + 100] for b in before for i in range(69)}, set()
        for i in range(69):
            if text[i:i + 100] in seen:
                covered |= set(range(i, i + 100))
            seen.add(text[i:i + 100])
        whole[d] = len(covered)
    assert removed == whole
