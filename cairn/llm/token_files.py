"""Token ids in fixed-width packed blocks.

File format: a Parquet data set, one file for each range of ``doc_id``, one row for each block. A
block holds whole documents in ascending order until it has ``BLOCK_TOKENS`` ids (a longer document
has a block of its own):

    part     int          range of the file, ascending with doc_id
    block    int          number of the block in the part
    start    bigint       ids of the part before this block
    n_tokens bigint       ids in the block
    bits     int          width of an id
    doc_ids  array<bigint>, lengths array<bigint>   the documents and their ids
    payload  binary       ids, little-endian bit order, ``bits`` bits each, padded to 8 bytes

Id ``k`` of a block lies at bit ``k * bits``, so ``unpack`` reads any slice without what precedes
it, and the block rows' statistics on ``part`` and ``start`` lead a reader to the block: ``read_range``
fetches any stretch of the whole stream from the blocks that hold it.

Writing is one range shuffle of the texts; the file commit is Spark's, so lost executors and
repeated tasks leave no half-written or doubled blocks. Only the sums of the parts, one row for each
file, come to the driver. Texts are encoded some megabytes and blocks read one at a time.

Defined cases: a null or empty text has the end id only; null ``doc_id`` comes first; equal ids are
ordered by text and stay separate documents; other columns are ignored; an empty table writes no block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import claim, list_array, no_collector, prepare, text_bytes, text_of

BLOCK_TOKENS = 1 << 18
#: New runs that are encoded as one text.
GROUP = 200
#: Bytes of the texts that are encoded together; a longer one is encoded alone.
ENCODE_BYTES = 4 << 20
SCHEMA = "part int, block int, start bigint, n_tokens bigint, bits int, doc_ids array<bigint>, lengths array<bigint>, payload binary"


def width_of(vocabulary: int) -> int:
    """The fewest bits that hold ids below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    n = len(ids)
    size = (n * bits + 7) // 8
    padding = b"\0" * (-size % 8 + 8)
    if bits == 16:
        return ids.astype("<u2").tobytes() + padding
    out = np.zeros(size, np.uint8)
    step = 1 << 16  # a multiple of 8 ids ends on a byte
    for a in range(0, n, step):
        part = ids[a : a + step].astype("<u4")
        each = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
        packed = np.packbits(each.ravel(), bitorder="little")
        at = a * bits // 8
        out[at : at + len(packed)] = packed
    return out.tobytes() + padding


def unpack(payload: bytes, bits: int, start: int, count: int) -> np.ndarray:
    """Ids ``start`` to ``start + count`` of a block."""
    raw = np.frombuffer(payload, np.uint8)
    if bits == 16:
        return raw[2 * start : 2 * (start + count)].view("<u2").astype(np.uint32)
    at = (np.arange(start, start + count, dtype=np.int64)) * bits
    byte = at >> 3
    value = np.zeros(count, np.uint64)
    for k in range((bits + 14) // 8):
        value |= raw[byte + k].astype(np.uint64) << np.uint64(8 * k)
    return ((value >> (at & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


#: Marks that are a pre-token of their own after a letter (fixed values).
PUNCTUATION = ".,;:!?"
#: One word of Latin letters, alone or with one mark after it.
_WORD = f"^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[{PUNCTUATION}]?$"


def places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all members of stretches, one stretch after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class WordTokenizer:
    """The tokenizers library, asked once for each distinct run between ASCII white space of some texts.

    The vocabulary's pre-tokens hold no white space and its normaliser joins nothing across it, so
    the ids of a text are those of its runs in order. Arrow splits the texts and numbers their
    distinct runs; numpy puts the runs' ids in the texts' order. Nothing is kept from batch to batch.

    Most runs are one word of Latin letters, alone or with one mark of punctuation after it. Such a word
    is one pre-token which the normaliser only lowers: the distinct words go through the
    library's model together, cut at white space only, and each ends at an id whose token has the
    word-end suffix. All other runs go through the whole tokenizer with a special string between them.
    """

    def __init__(self, path: str, separator: str = "<|endoftext|>"):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = self.library.model.end_of_word_suffix
        self.ends = np.zeros(self.library.get_vocab_size(), bool)
        for token, k in self.library.get_vocab().items():
            self.ends[k] = token.endswith(suffix)
        self.separator = f" {separator} "
        self.separator_id = self.library.token_to_id(separator)
        marks = [self._one(m) for m in PUNCTUATION]
        self.mark_ids = np.concatenate(marks)
        self.mark_sizes = np.array([len(m) for m in marks])
        self.mark_of = np.full(256, -1)
        self.mark_of[list(PUNCTUATION.encode())] = np.arange(len(marks))

    def _one(self, run: str) -> np.ndarray:
        return np.array(self.library.encode(run, add_special_tokens=False).ids, "<u4")

    @staticmethod
    def _ids(tokenizer, texts: list[str]) -> np.ndarray:
        found = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return np.concatenate([np.array(e.ids, "<u4") for e in found]) if found else np.zeros(0, "<u4")

    def _words(self, stems: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and the number of each word's."""
        ids = self._ids(self.words, [" ".join(stems[a : a + GROUP]) for a in range(0, len(stems), GROUP)])
        return ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)

    def _others(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of any runs, and the number of each run's."""
        special = {i: self._one(r) for i, r in enumerate(runs) if "<|" in r}
        plain = ["" if i in special else r for i, r in enumerate(runs)] if special else runs
        ids = self._ids(self.library, [self.separator.join([*plain[a : a + GROUP], ""]) for a in range(0, len(plain), GROUP)])
        stops = np.flatnonzero(ids == self.separator_id)
        sizes = np.diff(stops, prepend=-1) - 1
        ids = np.delete(ids, stops)
        if special:
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i, found in special.items():
                parts[i], sizes[i] = found, len(found)
            ids = np.concatenate(parts)
        return ids, sizes

    def _runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct runs, and the number of each run's."""
        if not len(runs):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        simple = pc.match_substring_regex(runs, _WORD)
        is_word = simple.to_numpy(zero_copy_only=False)
        words = runs.filter(simple)
        stems = pc.utf8_lower(pc.utf8_rtrim(words, characters=PUNCTUATION)).dictionary_encode()
        stem_ids, stem_sizes = self._words(stems.dictionary.to_pylist())
        other_ids, other_sizes = self._others(runs.filter(pc.invert(simple)).to_pylist())
        which = stems.indices.to_numpy()
        data, at = text_bytes(words)
        mark = self.mark_of[data[at[1:] - 1]] if len(words) else np.zeros(0, np.int64)
        marked = mark >= 0
        own = stem_sizes[which] if len(which) else np.zeros(0, np.int64)
        sizes = np.zeros(len(runs), np.int64)
        sizes[is_word] = own + np.where(marked, self.mark_sizes[mark], 0)
        sizes[~is_word] = other_sizes
        starts = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), "<u4")
        begins = starts[is_word]
        out[places(begins, own)] = stem_ids[places((np.cumsum(stem_sizes) - stem_sizes)[which], own)]
        mark = mark[marked]
        out[places((begins + own)[marked], self.mark_sizes[mark])] = self.mark_ids[places((np.cumsum(self.mark_sizes) - self.mark_sizes)[mark], self.mark_sizes[mark])]
        out[places(starts[~is_word], other_sizes)] = other_ids
        return out, sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        ids, counts = self.encode_array(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of each text's ids."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        runs = pc.ascii_split_whitespace(texts.fill_null("") if texts.null_count else texts)
        at = runs.offsets.to_numpy() - runs.offsets[0].as_py()
        numbered = runs.flatten().dictionary_encode()
        with no_collector():
            ids, sizes = self._runs(numbered.dictionary)
        which = numbered.indices.to_numpy()
        each = sizes[which]
        return ids[places((np.cumsum(sizes) - sizes)[which], each)], np.diff(np.concatenate([[0], np.cumsum(each)])[at])


def some_texts(texts: pa.Array, most: int = ENCODE_BYTES) -> Iterator[pa.Array]:
    """The texts in stretches of at most so many bytes, or of one text."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy()
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield texts.slice(start, i - start)
            start, total = i, 0
        total += n
    if len(texts) > start:
        yield texts.slice(start)


_loaded: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    claim("word-bpe")
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def blocks_of(docs: DataFrame, path: str, end_id: int, text: str = "text", parts: int | None = None) -> DataFrame:
    """The rows of the files, not yet written."""
    spark = prepare(docs.sparkSession)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", text_of(text).alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        tokens = word_tokenizer(path)
        bits = width_of(tokens.library.get_vocab_size())
        narrow = "<u2" if bits <= 16 else "<u4"  # of what waits for its block to be full
        end = np.array([end_id], narrow)
        ids: list[np.ndarray] = []
        doc_ids: list[int | None] = []
        block = start = size = 0

        def close() -> pa.RecordBatch:
            values = [part, block, start, size, bits, doc_ids, [len(x) for x in ids], pack(np.concatenate(ids), bits)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.record_batch([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])

        for b in batches:
            names = iter(b.column(0).to_pylist())
            for texts in some_texts(b.column(1)):
                flat, counts = tokens.encode_array(texts)
                for found in np.split(flat, np.cumsum(counts)[:-1]):
                    if size and size + len(found) + 1 > BLOCK_TOKENS:
                        yield close()
                        block, start, size = block + 1, start + size, 0
                        ids, doc_ids = [], []
                    ids.append(np.concatenate([found.astype(narrow), end]))
                    doc_ids.append(next(names))
                    size += len(found) + 1
        if ids:
            yield close()

    return ordered.mapInArrow(run, SCHEMA)


def write(docs: DataFrame, target: str, path: str, end_id: int = 2, text: str = "text", parts: int | None = None) -> None:
    """Encode and write; ``target`` is any folder that Spark can write."""
    blocks_of(docs, path, end_id, text, parts).write.parquet(target)


def read_blocks(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(target)


def read(spark: SparkSession, target: str) -> DataFrame:
    """``doc_id, start, ids``: each document's ids and its place in the whole stream."""
    return _documents(spark, target, "doc_id bigint, start bigint, ids array<bigint>", _whole)


def _whole(doc_ids, starts, ids, lengths):
    return [doc_ids, starts, list_array(ids.astype(np.int64), lengths, pa.int64())]


def _checksums(doc_ids, starts, ids, lengths):
    raw = memoryview(ids.astype("<u4").tobytes())
    at = np.concatenate([[0], np.cumsum(lengths)]) * 4
    return [doc_ids, starts, pa.array(lengths, pa.int64()), pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())]


def checksums(spark: SparkSession, target: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` from the files."""
    return _documents(spark, target, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint", _checksums)


def _before(blocks: DataFrame) -> dict[int, int]:
    """For each part the ids of all parts before it."""
    before, total = {}, 0
    for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():  # one row for each file
        before[r.part] = total
        total += r.n
    return before


def read_range(spark: SparkSession, target: str, start: int, count: int) -> DataFrame:
    """``at, ids``: ids ``start`` to ``start + count`` of the whole stream, a row for each block that holds some of them.

    Only blocks that hold some are read, and of those only the slices are unpacked.
    """
    prepare(spark)
    blocks, stop = read_blocks(spark, target), start + count
    before = _before(blocks)
    parts = sorted(before)
    ends = {p: before[q] for p, q in zip(parts, parts[1:], strict=False)}
    holding = None
    for p in [p for p in parts if before[p] < stop and ends.get(p, stop) >= start]:
        first = F.col("start") + F.lit(before[p])
        some = blocks.filter((F.col("part") == p) & (F.col("start") < stop - before[p]) & (F.col("start") + F.col("n_tokens") > start - before[p]))
        some = some.select(first.alias("at"), "n_tokens", "bits", "payload")
        holding = some if holding is None else holding.unionByName(some)
    if holding is None:
        return spark.createDataFrame([], "at bigint, ids array<bigint>")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                at, n, bits = (b.column(k)[i].as_py() for k in range(3))
                low, high = max(start, at), min(stop, at + n)
                ids = unpack(b.column(3)[i].as_buffer(), bits, low - at, high - low).astype(np.int64)
                yield pa.record_batch([pa.array([low]), list_array(ids, [len(ids)], pa.int64())], ["at", "ids"])

    return holding.mapInArrow(each, "at bigint, ids array<bigint>")


def _documents(spark: SparkSession, target: str, schema: str, make) -> DataFrame:
    prepare(spark)
    blocks = read_blocks(spark, target)
    before = _before(blocks)

    names = [c.split()[0] for c in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                part, start, n, bits = (b.column(k)[i].as_py() for k in range(4))
                lengths = b.column(5)[i].values.to_numpy().astype(np.int64)
                starts = before[part] + start + np.concatenate([[0], np.cumsum(lengths)[:-1]])
                ids = unpack(b.column(6)[i].as_buffer(), bits, 0, n)
                yield pa.record_batch(make(b.column(4)[i].values, pa.array(starts, pa.int64()), ids, lengths), names)

    return blocks.select("part", "start", "n_tokens", "bits", "doc_ids", "lengths", "payload").mapInArrow(each, schema)
