"""Token-ID / binary output: fixed-width bit packing in blocks.

A token file is a Parquet folder whose rows are blocks. A block holds whole
documents: their ids, each stored in the fewest bits that the vocabulary
needs, in one binary field, with the documents' offsets beside it. Shards are
ranges of doc_id, so blocks in (shard, block) order hold all ids in ascending
doc_id order. Parquet is only the container: it gives the blocks a committed,
splittable file on any file system that Spark can write.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.llm import words
from framewright.llm.common import shared_path, table, width

BLOCK_IDS = 1 << 16
#: Bytes of text whose words are looked up together.
CHUNK = 1 << 19
#: Distinct words, and bytes of them, whose ids a worker remembers; then it starts again.
REMEMBERED, SPELLED = 1 << 20, 1 << 26
BLOCKS = "shard int, block int, bits int, first long, n_ids long, payload binary, doc_ids array<bigint>, doc_starts array<bigint>, doc_ends array<bigint>"


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """``ids`` in ``bits`` bits each, lowest bit first, without gaps."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(spread.astype(np.uint8), bitorder="little").tobytes()


def unpack(payload: bytes, bits: int, start: int, end: int) -> np.ndarray:
    """Ids ``start`` to ``end`` of a packed block; only their bytes are looked at."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", end - start, start * bits // 8).astype("<u4")
    low = start * bits // 8
    flat = np.unpackbits(np.frombuffer(payload, np.uint8)[low : -(-end * bits // 8)], bitorder="little")
    flat = flat[start * bits - 8 * low :][: (end - start) * bits].reshape(end - start, bits)
    return (flat.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32).astype("<u4")


_LATIN = re.compile("[a-zß-öø-ÿ]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Words in one text for the tokenizer.
TOGETHER = 500
#: How a tokenizer file says that it lower-cases, drops white space and never merges across words.
_NORMALIZERS = ({"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"})
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_END = "</w>"


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next free one from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return {b: chr(b if b in plain else next(free)) for b in range(256)}


def goes_by_words(file: dict) -> bool:
    """Whether a tokenizer file lower-cases, drops white space and merges only inside words of letters, each closed by an end mark."""
    split = (file.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    model = file.get("model") or {}
    return (
        tuple((file.get("normalizer") or {}).get("normalizers") or ()) == _NORMALIZERS
        and split[0] == _SPLIT
        and [(x.get("type"), x.get("use_regex")) for x in split[1:]] == [("ByteLevel", False)]
        and (model.get("type"), model.get("end_of_word_suffix"), model.get("continuing_subword_prefix"), model.get("dropout")) == ("BPE", _END, None, None)
    )


class WordIds:
    """Ids of texts from a tokenizer file.

    For a tokenizer that goes by words, a text's ids are those of its words in
    turn. Words are found by a 64-bit hash and compared by their bytes before
    ids are used again; texts of a part in which two words share a hash are
    encoded whole. Each new word of a part of a batch is encoded once: words of
    small Latin letters together, as one text that needs no normalizing, every
    other one by the whole tokenizer. For any other tokenizer whole texts are
    encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        file = json.loads(self.whole.to_str())
        self.by_words = goes_by_words(file)
        if self.by_words:
            self.words = Tokenizer.from_file(path)
            self.words.normalizer, self.words.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
            self.letters = {b: letter for b, letter in _byte_letters().items() if b != 32}  # words are joined by spaces
            self.ends = np.zeros(self.whole.get_vocab_size(), bool)
            self.ends[[i for word, i in self.whole.get_vocab().items() if word.endswith(_END)]] = True
            #: Special tokens are matched in texts before letters are lowered, and go on as they are spelled.
            self.special = re.compile(b"|".join(re.escape(x["content"].encode()) for x in file["added_tokens"]) or b"(?!)", re.IGNORECASE)
            self.tails: dict[bytes, bytes] = {}
            self._forget()

    def _forget(self) -> None:
        self.keys = np.empty(0, np.uint64)
        self.first, self.count = np.empty(0, np.int32), np.empty(0, np.int32)
        self.pool = np.empty(0, "<u4")
        self.at, self.size = np.empty(0, np.int32), np.empty(0, np.int32)
        self.spelled = np.empty(0, np.uint8)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _new_words(self, new: list[bytes]) -> list[bytes]:
        """The ids of each of ``new``, in small letters."""
        out: list[bytes] = [b""] * len(new)
        latin, others = [], []
        for k, word in enumerate(new):
            core = word.rstrip(b".,")
            if _LATIN.fullmatch(core.decode()):
                latin.append((k, core, word[len(core) :]))
            else:
                others.append(k)
        for k, ids in zip(others, self._encoded([new[k].decode() for k in others]), strict=True):
            out[k] = ids
        if tails := {t for _, _, t in latin} - self.tails.keys():
            self.tails.update(zip(tails, self._encoded([t.decode() for t in tails]), strict=True))
        texts = [" ".join([c.decode("latin-1") for _, c, _ in latin[k : k + TOGETHER]]).translate(self.letters) for k in range(0, len(latin), TOGETHER)]
        for n, e in enumerate(self.words.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, "<u4")
            blob, a = ids.tobytes(), 0
            for (k, _, tail), b in zip(latin[n * TOGETHER : (n + 1) * TOGETHER], (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist(), strict=True):
                out[k] = blob[a:b] + self.tails[tail] if tail else blob[a:b]
                a = b
        return out

    def _of_part(self, data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, bool]:
        """The ids of texts that follow each other, how many each has, and whether all words are spelled as those whose ids they got."""
        h, start, last = words.word_hashes(data, begins)
        each, sample, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) + len(each) > REMEMBERED or len(self.spelled) > SPELLED:
            self._forget()
        at = np.searchsorted(self.keys, each)
        new = np.flatnonzero(each != self.keys[np.minimum(at, len(self.keys) - 1)]) if len(self.keys) else np.arange(len(each))
        if len(new):
            lower = data.tobytes().translate(_LOWER)
            spelled = [lower[a : b + 1] for a, b in zip(start[sample[new]].tolist(), last[sample[new]].tolist(), strict=True)]
            found = self._new_words(spelled)
            count = np.array([len(x) // 4 for x in found], np.int32)
            keys = np.append(self.keys, each[new])
            order = np.argsort(keys, kind="stable")
            after = lambda held, sizes: (len(held) + np.cumsum(sizes) - sizes).astype(np.int32)
            self.first = np.append(self.first, after(self.pool, count))[order]
            self.count, self.keys = np.append(self.count, count)[order], keys[order]
            self.pool = np.append(self.pool, np.frombuffer(b"".join(found), "<u4"))
            size = np.array([len(x) for x in spelled], np.int32)
            self.at = np.append(self.at, after(self.spelled, size))[order]
            self.size = np.append(self.size, size)[order]
            self.spelled = np.append(self.spelled, np.frombuffer(b"".join(spelled), np.uint8))
            at = np.searchsorted(self.keys, each)
        size = self.size[at][which].astype(np.int64)
        same = bool((size == last - start + 1).all())
        if same and len(size):
            held = self.spelled[np.repeat(self.at[at][which] - np.cumsum(size) + size, size) + np.arange(size.sum())]
            same = np.array_equal(held, words.spelled(data))
        n = self.count[at][which].astype(np.int64)
        total = np.cumsum(n)
        ids = self.pool[np.repeat(self.first[at][which] - total + n, n) + np.arange(total[-1] if len(n) else 0)]
        ends = np.append(0, total)[np.cumsum(words.counts(start, begins))]
        return ids, np.diff(np.append(0, ends)), same

    def of(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; none for null."""
        if not self.by_words:
            for x in self._encoded([t or "" for t in texts.to_pylist()]):
                yield np.frombuffer(x, "<u4")
            return
        for at, upto, found in words.parts(texts, CHUNK):
            coded = [self._of_part(*part) for part in found]
            n = coded[0][1] if len(coded) == 1 else [sum(len(ids) for ids, *_ in coded)]
            ids = np.concatenate([ids for ids, *_ in coded])
            whole = not all(same for *_, same in coded)
            special = any(self.special.search(data.tobytes()) for data, _ in found)
            for k, x in zip(range(at, upto), np.split(ids, np.cumsum(n)[:-1]), strict=True):
                if whole or special and self.special.search((texts[k].as_py() or "").encode()):
                    x = np.frombuffer(self._encoded([texts[k].as_py() or ""])[0], "<u4")
                yield x


_held: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    if path not in _held:
        _held[path] = WordIds(path)
    return _held[path]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, partitions: int | None = None, block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text of ``docs(doc_id, text)`` and write the ids to ``path`` in ascending doc_id order.

    Each document's ids are followed by ``end_id``. A null or empty text gives
    ``end_id`` alone. Rows with the same doc_id are each written, next to each
    other, in the order of their texts; a null doc_id comes first. Other
    columns are left out. An empty table gives an empty folder. A block is
    closed after the document that brings it to ``block_ids`` ids, so a very
    long document makes one long block and no document is cut.
    """
    parts = partitions or width(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _word_ids(tokenizer)
        bits = bits_for(coder.whole.get_vocab_size())
        end = np.array([end_id], "<u4").tobytes()
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        held, doc_ids, ends = [], [], [0]

        def close() -> pa.RecordBatch:
            nonlocal block, first
            ids = np.frombuffer(b"".join(held), "<u4")
            row = {"shard": shard, "block": block, "bits": bits, "first": first, "n_ids": len(ids), "payload": pack(ids, bits), "doc_ids": list(doc_ids), "doc_starts": ends[:-1], "doc_ends": ends[1:]}
            block, first = block + 1, first + len(ids)
            held.clear(), doc_ids.clear()
            ends[:] = [0]
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("bits", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())), ("doc_ends", pa.list_(pa.int64()))])
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.of(batch.column(1)), strict=True):
                held.append(ids.tobytes() + end)
                doc_ids.append(doc_id)
                ends.append(ends[-1] + len(ids) + 1)
                if ends[-1] >= block_ids:
                    yield close()
        if doc_ids:
            yield close()

    ordered = docs.select("doc_id", "text").repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, BLOCKS).write.option("compression", "none").parquet(path)


def shard_starts(blocks: DataFrame) -> DataFrame:
    """shard, base: the ids in all shards before it. One row for each shard, read from the blocks' counts alone."""
    counts = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids of every document, from the files alone. start: the ids of all documents before it."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["bits"], 0, row["n_ids"])
                cuts = np.append(row["doc_starts"], row["n_ids"]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(row["doc_ids"]), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(np.array(row["doc_starts"]) + row["first"], pa.int64()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(ids.astype(np.int64)))], ["shard", "doc_id", "at", "ids"])

    blocks = spark.read.schema(BLOCKS).parquet(path)
    rows = blocks.select("shard", "bits", "first", "n_ids", "payload", "doc_ids", "doc_starts").mapInArrow(decode, "shard int, doc_id long, at long, ids array<bigint>")
    return rows.join(F.broadcast(shard_starts(blocks)), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "ids")


def read_range(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """position, id for the ids ``start`` to ``end`` of the whole sequence: only blocks that hold some of them are unpacked."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = max(0, start - row["at"]), min(row["n_ids"], end - row["at"])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b) + row["at"], pa.int64()), pa.array(unpack(row["payload"], row["bits"], a, b).astype(np.int64))], ["position", "id"])

    blocks = spark.read.schema(BLOCKS).parquet(path)
    at = blocks.join(F.broadcast(shard_starts(blocks)), "shard").withColumn("at", F.col("base") + F.col("first"))
    return at.filter((F.col("at") < end) & (F.col("at") + F.col("n_ids") > start)).select("at", "n_ids", "bits", "payload").mapInArrow(cut, "position long, id long")


def document_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["payload"], row["bits"], 0, row["n_ids"])
                spans = list(zip(row["doc_starts"], row["doc_ends"], strict=True))
                crcs = [zlib.crc32(ids[a:b]) for a, b in spans]
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(spans), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array([a + row["first"] for a, _ in spans], pa.int64()), pa.array([b - a for a, b in spans], pa.int64()), pa.array(crcs, pa.int64())], ["shard", "doc_id", "at", "n_tokens", "ids_crc32"])

    blocks = spark.read.schema(BLOCKS).parquet(path)
    rows = blocks.select("shard", "bits", "first", "n_ids", "payload", "doc_ids", "doc_starts", "doc_ends").mapInArrow(digest, "shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(shard_starts(blocks)), "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, end_id: int = 2, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` as a token file in the shared folder and read it back: doc_id, start, n_tokens, ids_crc32."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write_token_files(docs, path, tokenizer, end_id)
    return document_digests(spark, path)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, as ids in files and read back from them."""
    return token_table(table(spark, sf_dir, "documents"))
