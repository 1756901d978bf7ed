"""Alignment of two tokenizers over a corpus: where their tokens end together, and which ids go together how often.

Each text is encoded by a byte-level vocabulary (A) and by a piece vocabulary (B) and both token lists are placed on the bytes of the
text with a space before it. The work on tokens is done on Arrow columns: the lists of a batch are flattened with their
parents' indices, token lengths are summed up within each document, and a hash join on (document, end) finds the tokens of A
and B that end together: the links. They cut both lists into groups. ``Table.group_by`` counts the id pairs of each document and of each
batch; Spark sums the batches' counts.

A second pass joins the pairs of each document with the corpus-wide counts. That table goes to every task: of two tokens that end
together one is the end of the other, so it has at most as many rows as the vocabularies have such pairs,
``MAX_PAIRS`` at most, whatever the corpus.

Texts are encoded in batches of ``BATCH_CHARS`` characters; a longer text is a batch of its own. B's pieces have spaces only at
their start (checked on loading), so B encodes a long text in stretches cut at spaces.

Null and empty texts, and texts whose bytes B does not give back, have no tokens: all counts are 0 and the hash is ''. Repeated
rows count each on their own, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.shared import configure, drop_written, written
from fleetgauge.llm.tokens import default_vocabulary, token_ids

BATCH_CHARS = 1_000_000
STRETCH_CHARS = 20_000
MAX_PAIRS = 4_000_000
SPACE = "▁"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_NONE = np.zeros(0, np.int32)

_PAIRS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))
_FIELDS = pa.schema(
    [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64())]
    + [("groups_sha256", pa.string()), ("pairs", _PAIRS), ("is_document", pa.bool_())]
)
_LINKED = (
    "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, "
    "pairs array<struct<a:int,b:int,n:bigint>>, is_document boolean"
)


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Encodes texts by a piece vocabulary; ``token_bytes`` has the bytes of each id."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.token_bytes = [
            bytes([int(name[3:5], 16)]) if self.model.is_byte(i) else name.replace(SPACE, " ").encode()
            for i, name in enumerate(names)
        ]
        if not all(self.token_bytes):
            raise ValueError("a piece without bytes")
        if any(b" " in t.lstrip(b" ") for t in self.token_bytes):
            raise ValueError("a piece with a space after something else: stretches could not be encoded alone")

    def encode(self, texts: list[str]) -> list[list[int]]:
        found = self.model.encode([t if len(t) <= STRETCH_CHARS else "" for t in texts], num_threads=1)
        for i, text in enumerate(texts):
            if len(text) > STRETCH_CHARS:
                found[i] = [t for ids in self.model.encode(list(stretches(text)), num_threads=1) for t in ids]
        return found


def stretches(text: str) -> Iterator[str]:
    """Parts of ``text``, cut at spaces between two characters that are no white space: the space at a cut is the one that
    the encoder adds. No piece reaches over such a cut, as pieces have spaces at their start only."""
    at = 0
    for cut in _CUT.finditer(text):
        if cut.start() - at >= STRETCH_CHARS:
            yield text[at : cut.start()]
            at = cut.end()
    yield text[at:]


class Aligner:
    """Links and groups of the texts of a batch, as Arrow tables."""

    def __init__(self, vocabulary: str, pieces: str):
        self.ids, self.pieces = token_ids(vocabulary), pieces_of(pieces)
        encoder = self.ids.encoder
        entries = [encoder.decode_single_token_bytes(rank) for rank in range(len(self.ids.token_bytes))]
        self.a_bytes = pa.array(entries, pa.binary())
        self.b_bytes = pa.array(self.pieces.token_bytes, pa.binary())
        self.a_sizes, self.b_sizes = (pc.cast(pc.binary_length(x), pa.int64()) for x in (self.a_bytes, self.b_bytes))
        if possible_pairs(entries, self.pieces.token_bytes) > MAX_PAIRS:
            raise ValueError(f"vocabularies with over {MAX_PAIRS} pairs of tokens that can end together")
        self.names = pa.array([str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))])

    def encoded(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        """Lists of ids of A and B; empty for texts whose bytes either does not give back."""
        bodies = [f" {t}".encode() if t else b"" for t in texts]
        both = [self.ids.encode(b.decode()) if b else () for b in bodies], self.pieces.encode(texts)
        fits = [bool(t) for t in texts]
        for lists, entries in zip(both, (self.a_bytes, self.b_bytes)):
            spelt = entries.take(pa.array(np.concatenate([np.zeros(0, np.int32), *lists]).astype(np.int32)))
            data, ends = memoryview(spelt.buffers()[2] or b"").cast("B"), np.frombuffer(spelt.buffers()[1], np.int32)
            at = ends[np.cumsum([0, *map(len, lists)])]
            fits = [f and data[at[i] : at[i + 1]] == bodies[i] for i, f in enumerate(fits)]
        return tuple(_lists([np.asarray(x, np.int32) if f else _NONE for x, f in zip(lists, fits)]) for lists in both)

    def placed(self, lists: pa.Array, sizes: pa.Array, name: str) -> pa.Table:
        """A row per token: its document, id, place in the batch, and the key (document, end) it shares with one that ends there."""
        ids, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
        ends = pc.cumulative_sum(sizes.take(ids))
        before = pa.concat_arrays([pa.array([0], pa.int64()), ends]).take(lists.offsets)
        within = pc.subtract(ends, before.take(parent))
        key = pc.add(pc.shift_left(pc.cast(parent, pa.int64()), 40), within)
        return pa.table({"key": key, "document": parent, name: ids, f"{name}_place": pa.array(np.arange(len(ids)))})

    def align(self, texts: list[str]) -> tuple[pa.Array, pa.Array, pa.Table, pa.Array]:
        """Both lists of ids, the links ``key, document, a, b, a_place, b_place`` in order of the text, and the documents' group texts."""
        a, b = self.encoded(texts)
        left, right = self.placed(a, self.a_sizes, "a"), self.placed(b, self.b_sizes, "b").drop_columns("document")
        links = left.join(right, "key", join_type="inner", use_threads=False).sort_by("key").combine_chunks()
        sides = []
        for table, name in ((left, "a"), (right, "b")):
            last = pc.unique(links[f"{name}_place"])
            offsets = pa.concat_arrays([pa.array([0]), pc.add(last, 1)]).cast(pa.int32())
            ids = self.names.take(table[name].combine_chunks())
            sides.append(pc.binary_join(pa.ListArray.from_arrays(offsets, ids), ","))
        groups = pc.binary_join_element_wise(*sides, "|")
        owner = links.group_by("key", use_threads=False).aggregate([("document", "min")])["document_min"]
        per_text = np.bincount(owner.to_numpy(), minlength=len(texts))
        offsets = pa.array(np.concatenate([[0], np.cumsum(per_text)]), pa.int32())
        return a, b, links, pc.binary_join(pa.ListArray.from_arrays(offsets, groups), ";")

    def rows(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """A row per document, and one that holds the pairs of the whole batch and no document."""
        texts = [t or "" for t in batch.column("text").to_pylist()]
        a, b, links, groups = self.align(texts)
        counted = pa.TableGroupBy(links, ["document", "a", "b"], use_threads=False).aggregate([([], "count_all")])
        counted = counted.sort_by("document").combine_chunks()
        summed = pa.TableGroupBy(counted, ["a", "b"], use_threads=False).aggregate([("count_all", "sum")])
        n_links = np.bincount(links["document"].to_numpy(), minlength=len(texts))
        n_pairs = np.bincount(counted["document"].to_numpy(), minlength=len(texts))
        fields = ["a", "b", "n"]
        pairs = pa.concat_arrays(
            pa.StructArray.from_arrays([pc.cast(c, t) for c, t in zip(cs, (pa.int32(), pa.int32(), pa.int64()))], fields)
            for cs in (
                (_one(counted["a"]), _one(counted["b"]), _one(counted["count_all"])),
                (_one(summed["a"]), _one(summed["b"]), _one(summed["count_all_sum"])),
            )
        )
        offsets = np.concatenate([[0], np.cumsum(n_pairs), [len(pairs)]])
        hashed = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups.to_pylist()]
        n_groups = [g.count(";") + 1 if g else 0 for g in groups.to_pylist()]
        columns = [
            pa.array([*pc.list_value_length(a).to_pylist(), None], pa.int64()),
            pa.array([*pc.list_value_length(b).to_pylist(), None], pa.int64()),
            pa.array([*n_groups, None], pa.int64()),
            pa.array([*n_links.tolist(), None], pa.int64()),
            pa.array([*hashed, None], pa.string()),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs).cast(_PAIRS),
            pa.array([True] * len(texts) + [False]),
        ]
        owner = batch.column("doc_id")
        owner = pa.concat_arrays([owner, pa.nulls(1, owner.type)])
        return pa.RecordBatch.from_arrays([owner, *columns], ["doc_id", *_FIELDS.names])


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = pa.array(np.cumsum([0, *map(len, ids)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([_NONE, *ids])))


def _one(column: pa.ChunkedArray) -> pa.Array:
    whole = column.combine_chunks()
    return whole if isinstance(whole, pa.Array) else pa.concat_arrays(whole.chunks)


def possible_pairs(a: list[bytes], b: list[bytes]) -> int:
    """How many pairs of an entry of ``a`` and one of ``b`` can end together: one is the end of the other."""
    whole_a, whole_b = Counter(a), Counter(b)
    ends = sum(whole_b[x[i:]] for x in a for i in range(len(x)))
    return ends + sum(whole_a[x[i:]] for x in b for i in range(1, len(x)))


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


@lru_cache(maxsize=2)
def aligner(vocabulary: str, pieces: str) -> Aligner:
    return Aligner(vocabulary, pieces)


def by_chars(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``BATCH_CHARS`` characters, or one row."""
    start = chars = 0
    for i, size in enumerate(pc.utf8_length(batch.column("text")).to_pylist()):
        if i > start and chars + (size or 0) > BATCH_CHARS:
            yield batch.slice(start, i - start)
            start, chars = i, 0
        chars += size or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def linked(docs: DataFrame, vocabulary: str, pieces: str) -> DataFrame:
    """Per document of ``docs(doc_id, text)`` its counts, hash and distinct id pairs; per batch a row with its pairs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = aligner(vocabulary, pieces)
        for batch in batches:
            for part in by_chars(batch):
                yield known.rows(part)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {_LINKED}")


def pair_counts(links: DataFrame) -> DataFrame:
    """``a, b, n_links, is_best`` of every id pair of the corpus; best are the pairs with the highest count of their ``b``."""
    pairs = links.filter("NOT is_document").select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b")
    pairs = pairs.agg(F.sum("p.n").alias("n_links"))
    highest = pairs.groupBy("b").agg(F.max("n_links").alias("highest"))
    return pairs.join(highest, "b").selectExpr("a", "b", "n_links", "n_links = highest AS is_best")


def align_tokens(docs: DataFrame, vocabulary: str | None = None, pieces: str | None = None) -> DataFrame:
    """Per document: ``n_a, n_b, n_groups, n_links``, ``n_best`` links of a best pair, ``count_sum`` over its links, ``groups_sha256``."""
    spark = configure(docs.sparkSession)
    vocabulary, pieces = vocabulary or default_vocabulary(), pieces or default_pieces()
    links = written(linked(docs, vocabulary, pieces), "links")
    counted = written(pair_counts(links), "pairs")
    # bounded by the vocabularies, see above
    table = pa.Table.from_batches(counted.toArrow().to_batches(), pa.schema(
        [("a", pa.int32()), ("b", pa.int32()), ("n_links", pa.int64()), ("is_best", pa.bool_())]
    ))
    drop_written(counted)
    shared = spark.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            owned = pa.Table.from_struct_array(pc.list_flatten(lists)).append_column("row", pc.list_parent_indices(lists))
            found = owned.join(known, ["a", "b"], join_type="inner", use_threads=False)
            found = found.append_column("best", pc.if_else(found["is_best"], found["n"], 0))
            found = found.append_column("total", pc.multiply(found["n"], found["n_links"]))
            sums = found.group_by("row", use_threads=False).aggregate([("best", "sum"), ("total", "sum")])
            at = sums["row"].to_numpy()
            columns = {n: batch.column(n) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}
            for name, source in (("n_best", "best_sum"), ("count_sum", "total_sum")):
                whole = np.zeros(batch.num_rows, np.int64)
                whole[at] = sums[source].to_numpy()
                columns[name] = pa.array(whole)
            yield pa.RecordBatch.from_pydict(columns | {"groups_sha256": batch.column("groups_sha256")})

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, "
        "groups_sha256 string"
    )
    return links.filter("is_document").mapInArrow(run, schema)
