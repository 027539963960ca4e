import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from spendkit.llm import alignment as al, queries

A, B = f"{queries.TOKENIZERS}/{al.A_FILE}", f"{queries.TOKENIZERS}/{al.B_FILE}"


@pytest.fixture(scope="module")
def plain():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B), {i: w for w, i in a.get_vocab().items()}


def groups_of(plain, text):
    """Groups (A ids, B ids) by walking both lists token by token; None without tokens."""
    a, b, words = plain
    letters = al._byte_letters()
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(letters[c] for c in words[i]) for i in x]
    bytes_b = [bytes([int(m[1], 16)]) if (m := re.fullmatch("<0x(..)>", b.id_to_piece(i))) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    whole = (" " + text).encode()
    if not text or b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return None
    out, begin, i, j, p, q = [], (0, 0), 0, 0, 0, 0
    while i < len(x) or j < len(y):
        if p <= q and i < len(x):
            p, i = p + len(bytes_a[i]), i + 1
        else:
            q, j = q + len(bytes_b[j]), j + 1
        if p == q:
            out.append((x[begin[0] : i], y[begin[1] : j]))
            begin = i, j
    return out


def brute(plain, rows):
    every = [(i, groups_of(plain, t or "")) for i, t in rows]
    held, top = Counter(), Counter()
    for _, groups in every:
        held.update({(p, q) for x, y in groups or [] for p in x for q in y})
    for (p, _), n in held.items():
        top[p] = max(top[p], n)
    out = []
    for i, groups in every:
        if groups is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = [(p, q) for x, y in groups for p in x for q in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            i, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
            sum(held[k] == top[k[0]] for k in links), sum(held[k] for k in links), hashlib.sha256(text.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def result(docs, **sizes):
    return sorted((tuple(r) for r in al.align(docs, A, B, **sizes).collect()), key=str)


ROWS = [
    (1, "Hello world, this is a test of alignment."), (2, "Straße über Köln – naïve façade"), (3, "漢字かな交じり文 и кириллица 🙂🙂"),
    (4, None), (5, ""), (6, " "), (7, "   indented\n\n\ttext  with   blanks "), (8, "<|endoftext|> and <s> and </s> <unk> <0x41>"),
    (9, "▁ is not a blank"), (10, "a\r\nb\x00c\x7f"), (11, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (12, "1234567890 3.14159 0xDEADBEEF"),
    (1, "Hello world, this is a test of alignment."), (None, "Hello world"), (13, "é decomposed, ﬁ ligature, ½"),
]


@pytest.mark.parametrize("piece", [al.PIECE_ENDS, 1, 2, 7])
def test_against_a_walk_over_both(docs_of, plain, piece):
    assert result(docs_of(ROWS), piece_ends=piece) == brute(plain, ROWS)


def test_long_texts_are_tokenized_in_parts(docs_of, plain, monkeypatch):
    long = " ".join(t for _, t in ROWS if t) * 400
    both = al.load(A, B)
    assert both.cuttable
    monkeypatch.setattr(al, "CALL_BYTES", 50)
    assert len(both.parts(long)) > 100
    for text in (long, "short", "x" * 200, " " * 200):
        a, b = both.encode(text)
        assert a.tolist() == plain[0].encode(" " + text, add_special_tokens=False).ids and b.tolist() == plain[1].encode(text)


def test_tokens_are_those_of_the_file(plain):
    """Each character in several surroundings, against the library that the file is written for."""
    both = al.load(A, B)
    chars = [chr(c) for c in [*range(0, 0x3000), *range(0x3000, 0xD800, 97), *range(0xE000, 0x110000, 9777)]]
    texts = [f" a{c}b 1{c}2 .{c}! {c}{c} {c}  x{c} {c}'s\n{c}\t{c}'{c}" for c in chars]
    texts += ["a" * 20_000, " " * 20_000, "\n " * 9_000, "it's we'LL I'd'd", "<|endoftext|>"]
    for text, want in zip(texts, plain[0].encode_batch([" " + t for t in texts], add_special_tokens=False)):
        assert both._a.encode_ordinary(" " + text) == want.ids


def test_other_kinds_of_files_are_refused(tmp_path):
    import json

    spec = json.loads(open(A, encoding="utf-8").read())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "a.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="byte-level BPE"):
        al.Tokenizers(str(tmp_path / "a.json"), B)


def test_a_very_long_text(docs_of, plain):
    rows = [(1, "The quick brown fox jumps over the lazy dog; naïve façade 漢字. " * 3000), (2, "The quick brown fox")]
    assert result(docs_of(rows)) == brute(plain, rows)


def test_empty_table(docs_of):
    assert result(docs_of([])) == []


def test_blocks_of_one_document(docs_of, plain, monkeypatch):
    rows = ROWS * 2
    monkeypatch.setattr(al, "BLOCK_PAIRS", 1)
    assert result(docs_of(rows)) == brute(plain, rows)


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(1, 200), min_size=1), st.sets(st.integers(1, 200), min_size=1), st.integers(1, 50))
def test_merge_path(a, b, piece):
    a, b = np.array(sorted(a)), np.array(sorted(b))
    i, j = al.merge_path(a, b, piece)
    merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
    for p, q in zip(i, j):
        assert [side for _, side in merged[: p + q]].count(0) == p
    assert i[-1] == len(a) and j[-1] == len(b) and (np.diff(i + j)[:-1] == piece).all()


def test_links_of_large_groups(monkeypatch):
    pick = np.random.default_rng(1)
    n_a, n_b, owner = pick.integers(1, 30, 20), pick.integers(1, 30, 20), np.sort(pick.integers(0, 4, 20))
    a, b = pick.integers(0, 9, n_a.sum()), pick.integers(0, 9, n_b.sum())
    whole = al.links(a, b, n_a, n_b, owner, 10)
    monkeypatch.setattr(al, "LINKS_AT_ONCE", 100)
    for x, y in zip(whole, al.links(a, b, n_a, n_b, owner, 10)):
        assert (x == y).all()
    assert whole[2].sum() == (n_a * n_b).sum()
