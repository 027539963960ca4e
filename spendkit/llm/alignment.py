"""Cross-tokenizer alignment: the tokens of two tokenizers over the same bytes, cut into groups where both end.

Tokenizer A ends a token at some byte offsets, B at others. Merging the two sorted lists gives the groups: a
group closes where both end. The merge is divided by merge path: on the diagonal d a binary search finds how many
of the first d ends of the merged list come from A, so a text of any length falls into pieces of equal work that
know nothing of each other. Each piece labels its tokens by the ends that A and B share. What lies before the first
and after the last of them is open, and the open ends of neighbouring pieces are stitched into groups.

Counting pairs. Documents are put together in blocks. A block holds the distinct pairs of its documents once; only
these are shuffled, counted over the corpus and brought back to their block, not the links of every document.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .storage import shared_path

A_FILE = "byte_bpe_50k.json"
B_FILE = "piece_bpe_32k.model"
#: Ends of A and B that one piece merges; a text with more is divided among tasks.
PIECE_ENDS = 1 << 16
#: Bytes of text that one call of a tokenizer gets; a longer text is cut where no token of either can cross.
CALL_BYTES = 1 << 18
#: Links that are expanded at once, and distinct pairs of documents that a block holds.
LINKS_AT_ONCE = 1 << 20
BLOCK_PAIRS = 1 << 18
#: Bytes of ids that are merged at once.
MERGE_BYTES = 1 << 18

PIECES = "row long, doc_id long, piece int, pieces int, a binary, b binary, a_from long, b_from long"
OPEN = "open_a binary, open_b binary, tail_a binary, tail_b binary, closes boolean"
LINKED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"
MERGED = f"{LINKED}, groups binary, piece int, pieces int, {OPEN}"
BLOCKS = (
    "block long, pairs array<long>, held array<int>, doc_ids array<long>, groups_sha256 array<string>, "
    "counts binary, bounds binary, at binary, times binary"
)
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


class Strings:
    """A list of byte strings, joined by number."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.data = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all strings, where each ends)."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ids):
            return np.zeros(0, np.uint8), ends
        return self.data[np.repeat(self.starts[ids] - (ends - sizes), sizes) + np.arange(ends[-1])], ends


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write a byte as its own printable Latin-1 letter, others as letters from 256 on in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


#: Fixed value: how byte-level vocabularies of this kind cut a text before they merge bytes.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokenizers:
    """Both tokenizers, with the bytes of every token.

    A is a byte-level BPE file whose ids follow the order of its merges, so that an id is the rank of its merge; its
    special tokens are plain text.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as file:
            spec = json.load(file)
        vocabulary, cut = spec["model"]["vocab"], spec["pre_tokenizer"] or {}
        merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in spec["model"]["merges"]]
        plain = (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True)) == ("ByteLevel", False, True)
        if not plain or spec["normalizer"] or any(vocabulary[m] != 256 + k for k, m in enumerate(merges)):
            raise ValueError(f"{a_path} is no byte-level BPE in the order of its merges")
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in w): k for w, k in vocabulary.items() if k < 256 + len(merges)}
        words = {k: w for w, k in ranks.items()}
        self._a = tiktoken.Encoding("A", pat_str=CUT, mergeable_ranks=ranks, special_tokens={})
        self._b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a = Strings([words[k] for k in range(len(words))])
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        byte = re.compile(r"<0x([0-9A-F]{2})>")
        self.b = Strings([bytes([int(m[1], 16)]) if (m := byte.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces])
        #: A blank between two letters begins a token of A; of B too, if no piece goes on over a blank.
        self.cuttable = not any(re.search("[^▁]▁", p) for p in pieces)

    def parts(self, text: str) -> list[str]:
        """`text` in parts that were joined by a blank; tokens of the parts are the tokens of the text."""
        out, begin = [], 0
        while self.cuttable and len(text) - begin > CALL_BYTES and (m := BETWEEN.search(text, begin + CALL_BYTES)):
            out.append(text[begin : m.start()])
            begin = m.end()
        return [*out, text[begin:]]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        parts = self.parts(text)
        a = [np.array(self._a.encode_ordinary(" " + p), np.int64) for p in parts]
        b = [np.array(self._b.encode(p), np.int64) for p in parts]
        return np.concatenate(a), np.concatenate(b)


BETWEEN = re.compile("(?<=[a-z]) (?=[a-z])")


@lru_cache(maxsize=2)
def load(a_path: str, b_path: str) -> Tokenizers:
    return Tokenizers(a_path, b_path)


def _calls(sizes: list[int], most: int = CALL_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of about `most` in sum, one item at least."""
    begin, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > most:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(sizes):
        yield begin, len(sizes)


def merge_path(a_ends: np.ndarray, b_ends: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """How many ends of A and of B lie before each multiple of `piece` in the merged list, and before its end.

    All diagonals are searched at once. Of equal ends that of A comes first.
    """
    n, m = len(a_ends), len(b_ends)
    d = np.append(np.arange(0, n + m, piece), n + m)
    low, high = np.maximum(0, d - m), np.minimum(d, n)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        first = a_ends[np.minimum(middle, n - 1)] <= b_ends[np.clip(d - middle - 1, 0, m - 1)]
        low, high = np.where(open_ & first, middle + 1, low), np.where(open_ & ~first, middle, high)
    return low, d - low


def _int32(x: np.ndarray) -> bytes:
    return x.astype(np.int32).tobytes()


def id_type(ids: int) -> type:
    """The least type that holds the ids of a vocabulary."""
    return np.uint16 if ids <= 1 << 16 else np.int32


def _tokens(batches: Iterator[pa.RecordBatch], a_path: str, b_path: str, piece: int) -> Iterator[pa.RecordBatch]:
    """The pieces of every text; a text without tokens is one piece without any."""
    both = load(a_path, b_path)
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
    for batch in batches:
        rows, ids, texts = batch["row"].to_pylist(), batch["doc_id"].to_pylist(), batch["text"].to_pylist()
        for begin, end in _calls([len(t or "") for t in texts]):
            out = []
            for row, doc, text in zip(rows[begin:end], ids[begin:end], texts[begin:end]):
                text = text or ""
                a, b = both.encode(text)
                raw = np.frombuffer(b" " + text.encode(), np.uint8)
                (a_bytes, a_ends), (b_bytes, b_ends) = both.a.join(a), both.b.join(b)
                if not text or not np.array_equal(a_bytes, raw) or not np.array_equal(b_bytes, raw):
                    out.append((row, doc, 0, 1, b"", b"", 0, 0))
                    continue
                i, j = merge_path(a_ends, b_ends, piece)
                a, b = a.astype(id_type(len(both.a.sizes))), b.astype(id_type(len(both.b.sizes)))
                for k in range(len(i) - 1):
                    out.append((
                        row, doc, k, len(i) - 1, a[i[k] : i[k + 1]].tobytes(), b[j[k] : j[k + 1]].tobytes(),
                        int(a_ends[i[k] - 1]) if i[k] else 0, int(b_ends[j[k] - 1]) if j[k] else 0,
                    ))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], _names(PIECES))


@lru_cache(maxsize=4)
def _decimals(n: int) -> Strings:
    return Strings([f"{i},".encode() for i in range(n)])


def written(
    a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, groups: int, ids: int,
) -> tuple[np.ndarray, np.ndarray]:
    """`a1,a2|b1;` for every group, as bytes, and where each group ends. Tokens stand in the order of their groups."""
    n_a, n_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    until_a, until_b = np.cumsum(n_a), np.cumsum(n_b)
    stream = np.empty(len(a) + len(b), np.int64)
    stream[np.arange(len(a)) + (until_b - n_b)[group_a]] = a
    stream[np.arange(len(b)) + until_a[group_b]] = b
    data, ends = _decimals(ids).join(stream)
    closing = np.append(ends, 0)[until_a + until_b - 1]
    data[closing[n_a + n_b > 0] - 1] = ord(";")
    data[np.append(ends, 0)[until_b - n_b + until_a - 1][n_a > 0] - 1] = ord("|")
    return data, np.where(until_a + until_b > 0, closing, 0)


def links(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, pair) of all links, sorted, and how often each occurs; a pair is a * width + b.

    Group g has n_a[g] of the tokens a and n_b[g] of b, in order. Groups that are large by themselves are multiplied by
    their distinct ids.
    """
    sizes = n_a * n_b
    from_a, from_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    keys, owners, times = [], [], []
    large = sizes > LINKS_AT_ONCE
    for g in np.flatnonzero(large):
        x, nx = np.unique(a[from_a[g] : from_a[g] + n_a[g]], return_counts=True)
        y, ny = np.unique(b[from_b[g] : from_b[g] + n_b[g]], return_counts=True)
        keys.append((x[:, None] * width + y[None, :]).ravel())
        times.append((nx[:, None] * ny[None, :]).ravel())
        owners.append(np.full(len(x) * len(y), owner[g]))
    small = np.flatnonzero(~large)
    until = np.append(0, np.cumsum(sizes[small]))
    edges = np.unique(np.append(np.searchsorted(until, np.arange(0, until[-1], LINKS_AT_ONCE)), len(small)))
    for begin, end in _spans(edges):
        some = small[begin:end]
        n, ends = sizes[some], np.cumsum(sizes[some])
        place = np.arange(ends[-1]) - np.repeat(ends - n, n)
        by = np.repeat(n_b[some], n)
        keys.append(a[np.repeat(from_a[some], n) + place // by] * width + b[np.repeat(from_b[some], n) + place % by])
        owners.append(np.repeat(owner[some], n))
        times.append(np.ones(len(place), np.int64))
    if not keys:
        return (np.zeros(0, np.int64),) * 3
    key, of, time = np.concatenate(keys), np.concatenate(owners), np.concatenate(times)
    order = np.lexsort((key, of))
    key, of, time = key[order], of[order], time[order]
    new = np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1]))
    return of[new], key[new], np.add.reduceat(time, np.flatnonzero(new))


def _spans(firsts: np.ndarray) -> list[tuple[int, int]]:
    return list(zip(firsts[:-1].tolist(), firsts[1:].tolist()))


def _merge_pieces(rows: pd.DataFrame, sizes_a: np.ndarray, sizes_b: np.ndarray) -> pa.RecordBatch:
    """The groups that close inside each piece, written and linked, and what is open before and after them."""
    n, width = len(rows), len(sizes_b)
    a_lists = [np.frombuffer(x, id_type(len(sizes_a))) for x in rows["a"]]
    b_lists = [np.frombuffer(x, id_type(width)) for x in rows["b"]]
    a, b = (np.concatenate(x).astype(np.int64) for x in (a_lists, b_lists))
    many_a, many_b = np.array([len(x) for x in a_lists]), np.array([len(x) for x in b_lists])
    piece_a, piece_b = np.repeat(np.arange(n), many_a), np.repeat(np.arange(n), many_b)
    first_a, first_b = np.append(0, np.cumsum(many_a)), np.append(0, np.cumsum(many_b))
    from_a, from_b = rows["a_from"].to_numpy(np.int64), rows["b_from"].to_numpy(np.int64)

    def ends(sizes: np.ndarray, ids: np.ndarray, first: np.ndarray, origin: np.ndarray, piece: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(sizes[ids]))
        return sums[1:] - sums[first[:-1]][piece] + origin[piece]

    ends_a, ends_b = ends(sizes_a, a, first_a, from_a, piece_a), ends(sizes_b, b, first_b, from_b, piece_b)
    # Pieces are laid one behind the other, so that one sorted list holds the ends of all of them.
    last = np.maximum(from_a, from_b)
    np.maximum.at(last, piece_a, ends_a)
    np.maximum.at(last, piece_b, ends_b)
    base = np.cumsum(last + 2) - (last + 2)
    ends_a, ends_b = ends_a + base[piece_a], ends_b + base[piece_b]
    # B ends where A ends in this piece, or where A ended last before it: of equal ends that of A comes first.
    known = np.sort(np.concatenate([ends_a, (base + from_a)[from_a > 0]]))
    at = np.searchsorted(known, ends_b)
    shared = ends_b[(at < len(known)) & (known[np.minimum(at, max(len(known) - 1, 0))] == ends_b)] if len(known) else ends_b[:0]
    cuts = np.sort(np.concatenate([shared, base + last + 1]))  # a false cut behind every piece holds its open end
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    group_piece = np.searchsorted(base, cuts, "right") - 1
    false = np.append(group_piece[1:] != group_piece[:-1], True)
    opening = np.append(True, group_piece[1:] != group_piece[:-1]) & (rows["piece"].to_numpy() > 0)[group_piece]
    inner = ~false & ~opening

    in_a, in_b = inner[group_a], inner[group_b]
    number = np.cumsum(inner) - 1
    total = int(inner.sum())
    owner = group_piece[inner]
    x, y, gx, gy = a[in_a], b[in_b], number[group_a[in_a]], number[group_b[in_b]]
    text, until = written(x, y, gx, gy, total, max(len(sizes_a), width))
    per_piece = np.searchsorted(owner, np.arange(n + 1))
    text_at = np.append(0, until)[per_piece]
    n_a, n_b = np.bincount(gx, minlength=total), np.bincount(gy, minlength=total)
    of, pairs, times = links(x, y, n_a, n_b, owner, width)
    pair_at = np.searchsorted(of, np.arange(n + 1))
    n_links = np.zeros(n, np.int64)
    np.add.at(n_links, owner, n_a * n_b)

    def cut(ids: np.ndarray, chosen: np.ndarray, piece: np.ndarray) -> list[bytes]:
        kept, where = ids[chosen].astype(np.int32), np.searchsorted(piece[chosen], np.arange(n + 1))
        return [kept[i:j].tobytes() for i, j in _spans(where)]

    tail_a, tail_b = cut(a, false[group_a] & ~opening[group_a], piece_a), cut(b, false[group_b] & ~opening[group_b], piece_b)
    open_a, open_b = cut(a, opening[group_a], piece_a), cut(b, opening[group_b], piece_b)
    closes = np.zeros(n, bool)
    closes[group_piece[~false]] = True
    texts = [text[i:j].tobytes() for i, j in _spans(text_at)]
    alone = (rows["pieces"] == 1).tolist()
    arrays = [
        pa.array(rows["row"], pa.int64()), rows["doc_id"].array.__arrow_array__(), pa.array(many_a, pa.int64()), pa.array(many_b, pa.int64()),
        pa.array(np.diff(per_piece), pa.int64()), pa.array(n_links, pa.int64()), pa.array([digest(t) if x else None for t, x in zip(texts, alone)], pa.string()),
        pa.array([pairs[i:j].tobytes() for i, j in _spans(pair_at)], pa.binary()),
        pa.array([times[i:j].tobytes() for i, j in _spans(pair_at)], pa.binary()),
        pa.array([None if x else t for t, x in zip(texts, alone)], pa.binary()), pa.array(rows["piece"], pa.int32()), pa.array(rows["pieces"], pa.int32()),
        pa.array(open_a, pa.binary()), pa.array(open_b, pa.binary()), pa.array(tail_a, pa.binary()), pa.array(tail_b, pa.binary()),
        pa.array(closes),
    ]
    return pa.RecordBatch.from_arrays(arrays, _names(MERGED))


def digest(groups: bytes) -> str:
    """SHA-256 of the groups without the last `;`, empty if there are none."""
    return hashlib.sha256(groups[:-1]).hexdigest() if groups else ""


def _merge(batches: Iterator[pa.RecordBatch], sizes_a: np.ndarray, sizes_b: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = pc.add(pc.binary_length(batch["a"]), pc.binary_length(batch["b"])).to_pylist()
        for begin, end in _calls(lengths, MERGE_BYTES):
            rows = batch.slice(begin, end - begin).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
            yield _merge_pieces(rows, sizes_a, sizes_b)


def _stitch(key: tuple, rows: pd.DataFrame, width: int, ids: int) -> pd.DataFrame:
    """One text from its pieces: the open ends of neighbours are groups, between the groups of the pieces."""
    rows = rows.sort_values("piece", ignore_index=True)
    none, texts = np.zeros(0, np.int32), []
    held = {"a": none, "b": none}
    pairs, times, n_groups, n_links = [], [], int(rows["n_groups"].sum()), int(rows["n_links"].sum())
    for row in rows.itertuples():
        for side in held:
            held[side] = np.concatenate([held[side], np.frombuffer(getattr(row, f"open_{side}"), np.int32)])
        if row.closes and row.piece:
            a, b = held["a"].astype(np.int64), held["b"].astype(np.int64)
            zero = np.zeros(1, np.int64)
            texts.append(written(a, b, np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), 1, ids)[0].tobytes())
            _, p, t = links(a, b, zero + len(a), zero + len(b), zero, width)
            pairs.append(p)
            times.append(t)
            n_groups, n_links = n_groups + 1, n_links + len(a) * len(b)
            held = {"a": none, "b": none}
        texts.append(row.groups)
        pairs.append(np.frombuffer(row.pairs, np.int64))
        times.append(np.frombuffer(row.times, np.int64))
        for side in held:
            held[side] = np.concatenate([held[side], np.frombuffer(getattr(row, f"tail_{side}"), np.int32)])
    pair, where = np.unique(np.concatenate(pairs), return_inverse=True)
    time = np.zeros(len(pair), np.int64)
    np.add.at(time, where, np.concatenate(times))
    return pd.DataFrame([{
        "row": key[0], "doc_id": rows["doc_id"].iloc[0], "n_a": rows["n_a"].sum(), "n_b": rows["n_b"].sum(), "n_groups": n_groups,
        "n_links": n_links, "groups_sha256": digest(b"".join(texts)), "pairs": pair.tobytes(), "times": time.tobytes(),
    }])


def _blocks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Documents in blocks: their distinct pairs once, and every document's pairs as places among these."""
    part, number, rows, held = TaskContext.get().partitionId(), 0, [], 0
    names, types = _names(BLOCKS), [
        pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.binary()] * 4,
    ]

    def done() -> pa.RecordBatch:
        lists = [np.frombuffer(r["pairs"], np.int64) for r in rows]
        pairs, at = np.unique(np.concatenate(lists), return_inverse=True)
        counts = np.array([[r["n_a"], r["n_b"], r["n_groups"], r["n_links"]] for r in rows], np.int64)
        values = [
            (part << 32) + number, pairs, np.bincount(at, minlength=len(pairs)).astype(np.int32), [r["doc_id"] for r in rows], [r["groups_sha256"] for r in rows],
            counts.tobytes(), np.cumsum([0, *map(len, lists)]).astype(np.int64).tobytes(), _int32(at), b"".join(r["times"] for r in rows),
        ]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

    for batch in batches:
        for row in (r for k in range(0, len(batch), 256) for r in batch.slice(k, 256).to_pylist()):
            rows.append(row)
            held += len(row["pairs"]) // 8 + 1
            if held >= most:
                yield done()
                number, rows, held = number + 1, [], 0
    if rows:
        yield done()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document the corpus counts of its links, from those of the pairs of its block."""
    for batch in batches:
        for row in batch.to_pylist():
            counts = np.frombuffer(row["counts"], np.int64).reshape(-1, 4)
            bounds, at, times = np.frombuffer(row["bounds"], np.int64), np.frombuffer(row["at"], np.int32), np.frombuffer(row["times"], np.int64)
            told = row["told"] or []
            n, best = np.array([t["n"] for t in told], np.int64), np.array([t["best"] for t in told], np.int64)
            sums = []
            for each in (best, n):
                until = np.append(0, np.cumsum(times * each[at])) if len(at) else np.zeros(1, np.int64)
                sums.append(until[bounds[1:]] - until[bounds[:-1]])
            arrays = [pa.array(row["doc_ids"], pa.int64()), *(pa.array(counts[:, k]) for k in range(4)), *map(pa.array, sums), pa.array(row["groups_sha256"], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, _names(RESULT))


def aligned(docs: DataFrame, a_path: str, b_path: str, piece_ends: int = PIECE_ENDS) -> DataFrame:
    """One row per row of `docs` (LINKED): `pairs` are its distinct pairs as numbers, `times` how often each is linked.

    Texts of one piece are merged where they were read; pieces of longer ones go to tasks of their own and are stitched.
    """
    spark, both = docs.sparkSession, load(a_path, b_path)
    sizes_a, sizes_b = both.a.sizes.astype(np.int32), both.b.sizes.astype(np.int32)
    width, ids = len(sizes_b), max(len(sizes_a), len(sizes_b))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
    )
    stored = shared_path(spark, "pieces")
    rows.mapInArrow(lambda batches: _tokens(batches, a_path, b_path, piece_ends), PIECES).write.option("compression", "zstd").parquet(stored)
    pieces = spark.read.parquet(stored)
    merge = lambda some: some.mapInArrow(lambda batches: _merge(batches, sizes_a, sizes_b), MERGED)
    names = _names(LINKED)
    alone = merge(pieces.where("pieces = 1")).select(*names)
    # Ids go through pandas as text, which keeps nulls and every digit.
    parts = merge(pieces.where("pieces > 1").repartition("row", "piece")).withColumn("doc_id", F.col("doc_id").cast("string"))
    stitched = parts.groupBy("row").applyInPandas(
        lambda key, some: _stitch(key, some, width, ids), LINKED.replace("doc_id long", "doc_id string")
    )
    return alone.unionByName(stitched.withColumn("doc_id", F.col("doc_id").cast("long")).select(*names))


def align(docs: DataFrame, a_path: str, b_path: str, piece_ends: int = PIECE_ENDS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A encodes a space and the text, B the text, to which it adds the space itself. A link is a pair of token
    occurrences of one group; the count of a pair of ids is the number of rows that hold it linked. n_best are the links
    whose pair has the highest count of its A id, count_sum sums the counts of all links. Null and empty texts, and those
    that either tokenizer does not give back byte by byte, have no tokens: zeros and an empty groups_sha256. Rows
    that repeat count each. Other columns are not read. An empty table gives no rows. A text is tokenized whole by one task.
    """
    spark, width = docs.sparkSession, len(load(a_path, b_path).b.sizes)
    stored = shared_path(spark, "alignment")
    aligned(docs, a_path, b_path, piece_ends).mapInArrow(lambda batches: _blocks(batches, BLOCK_PAIRS), BLOCKS).write.option(
        "compression", "zstd"
    ).parquet(stored)
    blocks = spark.read.parquet(stored)
    held = blocks.select("block", F.explode(F.arrays_zip("pairs", "held")).alias("x")).select("block", "x.pairs", "x.held")
    # An id of A meets at most as many ids of B as its vocabulary has.
    top = F.max("n").over(Window.partitionBy(F.expr(f"pairs div {width}")))
    counted = held.groupBy("pairs").agg(F.sum("held").alias("n")).withColumn("best", F.col("n") == top)
    told = held.drop("held").join(counted, "pairs").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("pairs", "n", "best"))).alias("told"))
    return blocks.drop("pairs", "held").join(told, "block", "left").mapInArrow(_count, RESULT)
