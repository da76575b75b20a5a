import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgrid.llm import packing, tokens

PARTS = ["the ", " cat", "don't", "I'LL", "<|endoftext|>", "<|startoftext|>", "\n", "\n\n", "  ", "\t", "é", "É", "é", "ß", "İ", "Σ", "ς", "中文", "🙂", " ", " ", "　", "\x1c", "\x85", "42", "x9y", "%%%", "a.b", "...", "'", "`", "ﬁ", "½", "ª", "µ", "̸", "=", "ǅ", "한", "\x00", "|", "WORD", "wörter"]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return {name: Tokenizer.from_file(tokens.tokenizer_path(name)) for name in (tokens.BYTE_BPE, tokens.WORD_BPE)}


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PARTS), max_size=14).map("".join)))
def test_ids_are_the_librarys(plain, text):
    for name, own in plain.items():
        wanted = own.encode(text, add_special_tokens=False).ids
        assert sum(tokens.lookup(name, "count").each(text)) == len(wanted)
        assert b"".join(tokens.lookup(name, "bytes").each(text)) == np.array(wanted, "<u4").tobytes()


def test_cache_is_bounded():
    cache = tokens._Cache(str.upper, 10)
    for k in range(1000):
        assert cache[f"a{k % 37}"] == f"A{k % 37}"
    assert len(cache) + len(cache.old) <= 21


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_tokens bigint, length int")


def test_counts(spark, plain):
    rng = random.Random(1)
    rows = [(k, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 50)))) for k in range(200)] + [(None, None), (7, "word " * 40_000), (7, "")]
    out = tokens.token_counts(table(spark, rows), limit=20).collect()
    own = plain[tokens.BYTE_BPE]
    wanted = Counter((i, len((t or "").encode()), n := len(own.encode(t or "").ids), n > 20) for i, t in rows)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in out) == wanted
    assert tokens.token_counts(table(spark, rows).limit(0)).count() == 0


def checked_runs(counts, length):
    runs, sequences = packing.pack_histogram(counts, length)
    filled = {k: [] for k in range(sequences)}
    for size, n in counts.items():
        own = runs[size]
        assert own[0][0] == 0
        for (first, start, offset), (stop, _, _) in zip(own, [*own[1:], (n, 0, 0)]):
            for rank in range(first, stop):
                filled[start + rank - first].append((offset, size))
    for parts in filled.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert 0 < at <= length
    return sequences


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 40), max_size=20))
def test_histogram_packing(counts):
    sequences = checked_runs(counts, 30) if counts else 0
    total = sum(s * n for s, n in counts.items())
    assert sequences * 30 >= total and (sequences <= 2 * -(-total // 30) + 1)


def test_lengths_that_do_not_fit():
    with pytest.raises(ValueError):
        packing.pack_histogram({31: 1}, 30)
    assert packing.pack_histogram({}, 30) == ({}, 0)


def test_packing(spark, plain):
    rng = random.Random(2)
    words = "the cat sat on a mat and looked at 42 birds .".split()
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 30, 200, 900])))) for k in range(300)] + [(None, None), (3, ""), (3, "the cat")]
    out = packing.pack_documents(table(spark, rows).repartition(5), length=128).collect()
    own = plain[tokens.WORD_BPE]
    wanted = Counter()
    for i, t in rows:
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        for start in range(0, len(ids), 128):
            piece = np.array(ids[start : start + 128], "<u4")
            wanted[i, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == wanted
    sequences = {}
    for r in out:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    used = 0
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= 128
        used += at
    assert used / (128 * len(sequences)) > 0.95
    assert packing.pack_documents(table(spark, rows).limit(0)).count() == 0
