import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sigspark.llm import packing, token_counts
from sigspark.llm.queries import vocabulary

from .conftest import odd_texts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def bpe():
    return token_counts.Bpe(vocabulary())


def counted(bpe, texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    return bpe.counts(data, np.cumsum([0, *[len(t.encode()) for t in texts]]))


def listed(library, texts):
    return [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


pieces = st.lists(st.sampled_from(["'", "s", "t", "r", "e", "v", "l", "m", "d", " ", "\n", "\t", "a", "Z", "é", "1", "²", "!", "　", "漢", "😀", "́", "\xa0", "<|endoftext|>", "'re", "  "]), max_size=25).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(pieces, min_size=1, max_size=8))
def test_counts_equal_the_library(bpe, library, texts):
    assert counted(bpe, texts).tolist() == listed(library, texts)


def test_classes_of_code_points(bpe, library):
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and (c < 0x3000 or c % 11 == 0)]
    texts = [f"a{chr(c)}a1{chr(c)}1!{chr(c)}! {chr(c)}  {chr(c)}{chr(c)}" for c in points]
    assert counted(bpe, texts).tolist() == listed(library, texts)


def test_chunks_compose(bpe):
    rng = np.random.default_rng(1)
    classes = rng.integers(0, 12, 5 * token_counts.CHUNK + 7).astype(np.uint8)
    state, mark = token_counts.START, np.zeros(len(classes), bool)
    for i, c in enumerate(classes):
        said = token_counts.OUT[12 * state + c]
        mark[i] |= bool(said & token_counts.HERE)
        if said & token_counts.BEFORE:
            mark[i - 1] = True
        state = token_counts.STEP[12 * state + c]
    assert (token_counts.begins(classes) == mark).all()


def test_table_of_transitions_is_bounded(library, monkeypatch):
    small = token_counts.Bpe(vocabulary())
    texts = [t or "" for _, t in odd_texts()]
    alone = []
    for t in texts:
        small._empty(1 << 12)
        counted(small, [t])
        alone.append(small.held)
    monkeypatch.setattr(token_counts, "TRANSITIONS", 50)
    small._empty(1 << 12)
    for t in texts:
        counted(small, [t])
        assert small.held <= max(50, *alone) + 50  # a block's own transitions at most
    assert counted(small, texts).tolist() == listed(library, texts)


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(["ab", "aeiou", "theingran", "0123456789", "=-_*#!", "中文字符", "éèê", " \n\t", "etaoin shrdlu"]).flatmap(lambda x: st.lists(st.text(x, max_size=200), min_size=1, max_size=6)))
def test_runs_of_few_characters(bpe, library, texts):
    assert counted(bpe, texts).tolist() == listed(library, texts)


def unbroken():
    """Long texts that are one pre-token or nearly so, and words whose polynomial hashes are equal modulo a power of two."""
    rng = np.random.default_rng(4)
    thue = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = thue.translate(str.maketrans("ab", "ba"))
    et = str.maketrans("ab", "et")
    return {
        "letters": "".join(map(chr, rng.integers(97, 123, 10**6))), "cjk": "".join(map(chr, rng.integers(0x4E00, 0x9FFF, 350_000))), "one letter": "a" * 10**6,
        "spaces and a letter": " " * 2_000_000 + "x", "spaces": " " * 1_500_000, "lines and a letter": "\n" * 1_200_000 + "x", "mixed": "a" + " \n\t\u3000" * 20_000 + "'s b",
        "special": "a " + " " * 5000 + "<|endoftext|>" + " " * 5000 + "<|endoftext|>" + "\n" * 5000 + " 7", "marks": "!" * 1_500_000 + "a", "thue": thue.translate(et), "other": other.translate(et),
        "both": thue.translate(et) + "\n" + other.translate(et), "control": "\xa0" * 5000 + "é" + "\x85" * 4096 + "\x1f" * 5000 + " x",
    }


@pytest.mark.parametrize("name", list(unbroken()))
def test_long_unbroken_texts(bpe, library, name):
    text = unbroken()[name]
    ids = library.encode(text, add_special_tokens=False).ids
    assert counted(bpe, [text]).tolist() == [len(ids)]
    assert packing.encode(packing.encoder(vocabulary()), text) == ids


def test_token_counts_of_odd_rows(odd, empty, library):
    rows = token_counts.token_counts(odd, vocabulary()).collect()
    texts = [t or "" for _, t in odd_texts()]
    expected = Counter((i, len(t.encode()), n, n > 512) for (i, _), t, n in zip(odd_texts(), texts, listed(library, texts), strict=True))
    assert Counter(tuple(r) for r in rows) == expected
    assert token_counts.token_counts(empty, vocabulary()).collect() == []


def test_encoder_equals_the_library(library):
    texts = [t or "" for _, t in odd_texts()]
    encode = packing.encoder(vocabulary()).encode
    assert [encode(t, allowed_special="all") for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 1023), max_size=60))
def test_windows_are_full_but_one(lengths):
    windows = packing.pack(lengths)
    seen = defaultdict(list)
    for size, placed in windows:
        assert sum(n for _, _, n in placed) <= size
        for i, at, n in placed:
            seen[i].append((at, n))
    for i, n in enumerate(lengths):
        at = 0
        for begin, size in sorted(seen[i]):
            assert begin == at and size > 0
            at += size
        assert at == n
    assert sum(sum(n for _, _, n in placed) < size for size, placed in windows) <= 1


def test_tiers_and_gaps():
    """Short tails fill the gaps of long windows first; what is left is packed in windows of its own tier, filled by cutting."""
    windows = packing.pack([900, 700, 124, 324, 200, 100])
    assert [size for size, _ in windows] == [1024, 1024, 256, 256]
    assert sorted(n for _, _, n in windows[0][1]) == [124, 900] and sorted(n for _, _, n in windows[1][1]) == [324, 700]
    assert sorted(n for _, _, n in windows[2][1]) == [56, 200] and [n for _, _, n in windows[3][1]] == [44]


def test_step_groups_are_balanced(spark):
    rng = np.random.default_rng(9)
    docs = spark.createDataFrame([(i, "word " * int(n)) for i, n in enumerate(rng.integers(1, 900, 600))], "doc_id long, text string")
    rows = packing.pack_documents(docs, vocabulary()).collect()
    cost, window = defaultdict(Counter), {}
    for r in rows:
        cost[r.step_group][r.sequence_id] += r.length**2
        window[r.step_group] = r.window
    whole = [sum(c.values()) for g, c in cost.items() if window[g] == 1024 and len(c) == packing.STEP]
    assert len(whole) > 20 and max(whole) < 1.3 * min(whole)


def test_packing_of_odd_rows(odd, empty, library):
    rows = packing.pack_documents(odd, vocabulary()).collect()
    ids = Counter()
    for (i, t), e in zip(odd_texts(), library.encode_batch([t or "" for _, t in odd_texts()], add_special_tokens=False), strict=True):
        ids[i, np.array([*e.ids, 0], "<u4").tobytes()] += 1
    once = {i: x for (i, x), n in ids.items() if sum(m for (j, _), m in ids.items() if j == i) == 1}
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
    assert sum(r.length for r in rows) == sum(len(x) // 4 * n for (_, x), n in ids.items())
    for i, x in once.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(x) // 4, zlib.crc32(x[4 * at : 4 * (at + r.length)]))
            at += r.length
        assert at == len(x) // 4
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    padding = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 1024
    assert max(Counter({s: own[0].step_group for s, own in sequences.items()}.values()).values()) <= packing.STEP
    assert packing.pack_documents(empty, vocabulary()).collect() == []
