import hashlib
import random
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fleetgauge.llm import token_links as T

FIELDS = "doc_id long, text string"
ODD = [
    "", " ", "  ", "a  b", " lead", "trail ", "\n\n x", "<|endoftext|> <s></s> <unk>", "日本語 テキスト", "▁x", "a▁b", "é é",
    "\x00\x01 a", "ﬁ", "🙂🙂 a", "x" * 30_000, "ab " * 20_000, "  " * 15_000 + "a b", "word\r\n" * 9_000, "a \n b", "a   b",
    "it's 's  'll", "\x1c b", "   z",
]


@pytest.fixture(scope="module")
def plain():
    """Both ids and the aligned groups of a text, by the json form of the vocabulary, whole texts and plain lists."""
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    known = T.aligner(T.default_vocabulary(), T.default_pieces())
    entries = known.a_bytes.to_pylist()

    def align(text):
        if not text:
            return [], [], []
        a, b = whole.encode(f" {text}", add_special_tokens=False).ids, model.encode(text)
        a_bytes = [entries[i] for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, model.id_to_piece(b))]
        if not b"".join(a_bytes) == b"".join(b_bytes) == f" {text}".encode():
            return [], [], []
        a_ends, b_ends = list(accumulate(map(len, a_bytes))), list(accumulate(map(len, b_bytes)))
        groups, i, j = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            x, y = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        return a, b, groups

    return align


def expected(rows, align):
    aligned = [(i, *align(t)) for i, t in rows]
    counts = Counter((x[-1], y[-1]) for _, _, _, groups in aligned for x, y in groups)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for i, a, b, groups in aligned:
        pairs = [(x[-1], y[-1]) for x, y in groups]
        spelt = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append(
            (i, len(a), len(b), len(groups), len(pairs), sum(counts[p] == best[p[1]] for p in pairs),
             sum(counts[p] for p in pairs), hashlib.sha256(spelt.encode()).hexdigest() if groups else "")
        )
    return sorted(out)


def test_agrees_with_plain_alignment(spark, plain):
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()
    rows = list(enumerate([None, *ODD, *(r.text for r in given), *(r.text for r in given[:5])]))
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], f"{FIELDS}, n_a int, pairs string").repartition(3)
    assert sorted(tuple(r) for r in T.align_tokens(table).collect()) == expected(rows, plain)


def test_long_texts_are_encoded_in_stretches_alike(plain, monkeypatch):
    draw = random.Random(3)
    texts = ["".join(draw.choices(["a", "b ", " ", "\n", "\t", "é", "the ", " ", "日"], k=k)) for k in (0, 1, 5, 50, 500, 5000)]
    monkeypatch.setattr(T, "STRETCH_CHARS", 7)
    assert T.pieces_of(T.default_pieces()).encode(texts) == [plain(t)[1] or [] for t in texts]


def test_batches_are_cut_by_size(monkeypatch):
    monkeypatch.setattr(T, "BATCH_CHARS", 10)
    batch = pa.record_batch({"doc_id": pa.array(range(6)), "text": pa.array(["a" * 6, "b" * 5, None, "c" * 30, "d", ""])})
    assert [b.column("doc_id").to_pylist() for b in T.by_chars(batch)] == [[0], [1, 2], [3], [4, 5]]


def test_empty_table_repeated_rows_and_pair_bound(spark, empty):
    assert T.align_tokens(empty(FIELDS)).collect() == []
    rows = spark.createDataFrame([("k", "one two"), ("k", "one two"), (None, None)], "doc_id string, text string")
    found = sorted(((r[0] or ""), *r[1:7]) for r in T.align_tokens(rows).collect())
    assert found == [("", 0, 0, 0, 0, 0, 0), *[("k", 2, 2, 2, 2, 2, 4)] * 2]
    assert T.possible_pairs([b"ab", b"b"], [b"b", b"ab", b"b", b"cab"]) == sum(
        x.endswith(y) or y.endswith(x) for x in (b"ab", b"b") for y in (b"b", b"ab", b"b", b"cab")
    )
