import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from loglake.llm import alignment as al
from loglake.llm import tokens


@pytest.fixture(scope="module")
def encoders():
    return al.Encoders(al.Vocabularies.load())


def cut_groups(a, b):
    """Groups by walking both lists of (id, length) side by side."""
    groups, left, right, i, j = [], [], [], 0, 0
    at_a = at_b = 0
    while i < len(a) or j < len(b):
        if at_a <= at_b and i < len(a):
            left.append(a[i][0])
            at_a += a[i][1]
            i += 1
        else:
            right.append(b[j][0])
            at_b += b[j][1]
            j += 1
        if at_a == at_b and left and right:
            groups.append((left, right))
            left, right = [], []
    return groups


def brute_force(texts, encoders):
    exact = Tokenizer.from_file(al.BYTE_LEVEL)
    exact.encode_special_tokens = True
    told, links = [], []
    for text in texts:
        a = exact.encode(" " + text, add_special_tokens=False).ids if text else []
        b = encoders._pieces.encode(text) if text else []
        whole = (" " + (text or "")).encode()
        if any(b"".join(table[t] for t in ids) != whole for ids, table in ((a, encoders.a_bytes), (b, encoders.b_bytes))):
            a, b = [], []
        groups = cut_groups([(t, len(encoders.a_bytes[t])) for t in a], [(t, len(encoders.b_bytes[t])) for t in b])
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        pairs = [(x[-1], y[-1]) for x, y in groups]
        told.append((len(a), len(b), len(groups), written, pairs))
        links += pairs
    count = {pair: links.count(pair) for pair in set(links)}
    most = {}
    for (_, b), n in count.items():
        most[b] = max(most.get(b, 0), n)
    return [
        (n_a, n_b, n_groups, len(pairs), sum(count[p] == most[p[1]] for p in pairs), sum(count[p] for p in pairs), written)
        for n_a, n_b, n_groups, written, pairs in told]


TEXTS = [
    "The tokenizers disagree, don't they?", None, "", "l'été à Noël œuvre", "日本語 text 🙂 mixed", "▁already here", "a",
    "<|endoftext|> and <s> are plain", "  two  spaces\n\n\ttabs ", "naïve " * 40, "the the the", "the the the", "\x00null"]


def test_documents_match_brute_force(spark, documents, encoders):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("abcde ñ日.\n") for _ in range(rng.randint(1, 80))) for _ in range(40)]
    docs = documents([(at if at % 9 else None, text) for at, text in enumerate(texts)])
    expected = brute_force(texts, encoders)
    for head in (1 << 20, 5, 0):
        found = al.alignment(docs, digest=False, head_pairs=head).collect()
        assert sorted((r[1:] for r in map(tuple, found)), key=repr) == sorted(expected, key=repr)
    digests = {row.groups for row in al.alignment(docs).collect()}
    assert digests == {hashlib.sha256(e[-1].encode()).hexdigest() if e[-1] else "" for e in expected}


def test_empty_table(spark, documents):
    assert al.alignment(documents([(1, "x")]).filter("false")).collect() == []


def test_pointers_end_at_the_last_token_of_a_group():
    rng = np.random.default_rng(5)
    for _ in range(50):
        size = int(rng.integers(1, 400))
        a, b = (np.append(np.flatnonzero(rng.random(size - 1) < 0.5) + 1, size) for _ in range(2))
        last_a, last_b = al.last_tokens(a, b)
        shared = np.intersect1d(a, b)
        assert (b[last_a] == shared[np.searchsorted(shared, a)]).all()
        assert (b[last_b] == shared[np.searchsorted(shared, b)]).all()


def test_both_encoders_of_the_byte_vocabulary_agree(encoders):
    exact = Tokenizer.from_file(al.BYTE_LEVEL)
    exact.encode_special_tokens = True
    for text in (t for t in TEXTS if t):
        assert encoders.encode(text)[0] in ([], exact.encode(" " + text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000 + "x", "x" * 2_000_000, "é \t" * 500_000])
def test_very_long_texts(spark, documents, text):
    row = al.alignment(documents([(1, text)])).first()
    assert row.n_groups >= 1 and row.n_links == row.n_groups <= min(row.n_a, row.n_b)


def test_long_runs_of_white_space_are_encoded_as_the_pattern_does():
    encoding = tokens.encoder()
    for text in (" " * 9000, "\n" * 9000 + "a", "x" + " \n" * 9000 + "  b c", " " * 5000 + "a" + "\t" * 6000 + "é"):
        assert tokens.encode_text(encoding, text) == encoding.encode_ordinary(text)
