"""Token ids in Arrow files of equal-length sequences.

Documents are dealt out by ranges of their id, encoded, and packed in order into sequences of ``LENGTH``
ids; an end id follows each document. Each task writes one Arrow file of fixed-size-list batches:

- ``tokens``: fixed_size_list<uint16 or uint32>[LENGTH]
- ``mask``: fixed_size_list<uint8>[LENGTH / 8]: a bit for each id, 0 where the last sequence is filled up
- ``docs``: list<struct<doc, at, n>>: documents that begin in the sequence: id, place in it, number of ids

The buffers are not compressed, so that a memory-mapped file gives any sequence without a copy. Files have
names of their own for each attempt of a task; only those in the manifest of finished tasks are read, so a
lost executor leaves nothing that counts.

Null texts are empty: their only id is the end. Null ids come first. Documents with equal ids are ordered
by a hash of their text and then by the text, so that many rows of one id can be dealt to many tasks; only
repeated rows can't, and they stand one after the other. An empty table gives no files and no rows.
"""

from __future__ import annotations

import codecs
import json
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import bound_batches, make_dir, materialize, new_path

LENGTH, END_ID = 2048, 2
#: Sequences in a batch of a file.
BATCH = 256
#: Words whose ids a worker remembers, in two halves; when one is full, it forgets the older.
REMEMBERED = 300_000
#: Bytes of texts that are encoded at once, so that each of their different words is looked up once.
ENCODED = 16 << 20


@cache
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: ASCII characters that are neither letter, digit nor white space: a run of them after a word is a piece of its own.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def byte_letters() -> dict[int, str]:
    """For each byte the character that byte-level vocabularies write it as: itself if it is printable, else the next from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


#: The same as a table for decoding; blanks stay, they stand between pieces.
LETTERS = "".join(" " if b == 32 else c for b, c in sorted(byte_letters().items()))
#: The steps before the model in vocabularies whose words stand for themselves.
BY_WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)


class Encoder:
    """Encodes texts, word by word with a memory where the vocabulary allows it, else whole.

    A tokenizer with the steps BY_WORDS drops ASCII white space and makes no token across it, so a text's ids
    are its words' ids one after the other (tests hold this against encoding whole texts). Words are kept as UTF-8. A word of
    composed letters is normalised by lower case alone and is one piece, whose last token alone has the suffix
    of words' ends. So many such words go to the tokenizer's model at once, and their ids are cut at these
    tokens; so do such words before a run of marks. Every other word takes the whole way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = tokenizer(path)
        #: Ids of words met of late, and of those met before them.
        self.known, self.older = {}, {}
        steps = json.loads(self.tokenizer.to_str())
        suffix = steps["model"].get("end_of_word_suffix")
        self.by_words = (steps["normalizer"], steps["pre_tokenizer"]) == BY_WORDS and bool(suffix)
        if self.by_words:
            self.pieces = Tokenizer(self.tokenizer.model)
            self.pieces.pre_tokenizer = WhitespaceSplit()
            vocabulary = self.tokenizer.get_vocab()
            self.last = np.zeros(max(vocabulary.values()) + 1, bool)
            self.last[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def whole(self, words: list[bytes]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, np.uint32).tobytes() for e in got]

    def letters(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of letters in lower case."""
        piece = codecs.charmap_decode(b" ".join(words), "strict", LETTERS)[0]
        ids = np.array(self.pieces.encode_batch_fast([piece], add_special_tokens=False)[0].ids, np.uint32)
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        if len(ends) != len(words):  # a byte that the vocabulary lacks
            return self.whole(words)
        flat = ids.tobytes()
        return [flat[i:j] for i, j in zip([0, *ends], ends, strict=False)]

    def learn(self, words: list[bytes]) -> None:
        known, lows, mine, rest = self.known, {}, [], []
        for w in words:
            base = w.rstrip(MARKS)
            low = lower(base)
            if low is None:
                rest.append(w)
            else:
                mine.append((w, lows.setdefault(low, len(lows)), w[len(base) :]))
        rest += {end for _, _, end in mine if end and end not in known}
        for part in spans(rest):
            known.update(zip(part, self.whole(part), strict=True))
        ids = [x for part in spans(list(lows)) for x in self.letters(part)]
        for w, i, end in mine:
            known[w] = ids[i] + known[end] if end else ids[i]

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of different words."""
        if len(self.known) + len(words) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = []
        for w in words:
            if w not in known:
                if (ids := older.get(w)) is None:
                    new.append(w)
                else:
                    known[w] = ids
        self.learn(new)
        return [known[w] for w in words]

    def flat(self, texts: pa.Array, end: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings without null) one after the other, each with these after it, and how many each has."""
        if not self.by_words:
            got = [np.array(e.ids + end, np.uint32) for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.empty(0, np.uint32), *got]), np.array([len(e) for e in got], np.int64)
        lists = pc.ascii_split_whitespace(texts.cast(pa.string()))
        told = lists.flatten().cast(pa.binary()).dictionary_encode()
        place, different = told.indices.to_numpy(), values(told.dictionary)
        # splitting leaves empty words at the edges of texts: they have no ids; the ids after each text are one more word
        ids = [*self.words(list(filter(None, different))), np.array(end, np.uint32).tobytes()]
        if b"" in different:
            ids.insert(different.index(b""), b"")
        edges = lists.offsets.to_numpy().astype(np.int64)
        edges -= edges[0]
        place = np.insert(place, edges[1:], len(ids) - 1)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin, n = (np.cumsum(size) - size)[place], size[place]
        upto = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat((begin - upto[:-1]).astype(np.int32 if upto[-1] < 1 << 31 else np.int64), n)
        at += np.arange(upto[-1], dtype=at.dtype)
        return np.frombuffer(b"".join(ids), np.uint32)[at], np.diff(upto[edges + np.arange(len(edges))])

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        flat, n = self.flat(pa.array(texts, pa.string()), [])
        return np.split(flat, np.cumsum(n)[:-1])


def lower(word: bytes) -> bytes | None:
    """A word of composed letters in lower case, as the vocabularies' steps make it; None for every other word."""
    if len(word) > 60:
        return None
    if word.isalpha():
        return word.lower()
    if word.isascii():
        return None
    low = (text := word.decode()).replace("Σ", "σ").lower()  # a last sigma is like others there
    return low.encode() if text.isalpha() and low.isalpha() and unicodedata.is_normalized("NFC", text) else None


def values(words: pa.Array) -> list[bytes]:
    """The values of a binary array without null."""
    edges = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].tolist() if len(words) else [0]
    data = words.buffers()[2].to_pybytes() if len(words) else b""
    return [data[i:j] for i, j in zip(edges, edges[1:], strict=False)]


def spans(words: list[bytes], n: int = 5000) -> Iterator[list[bytes]]:
    return (words[i : i + n] for i in range(0, len(words), n))


@cache
def encoder(path: str) -> Encoder:
    """One for all tasks of a worker, which go on with the words of those before."""
    return Encoder(path)


def gathered(batches: Iterator[pa.RecordBatch], limit: int = ENCODED) -> Iterator[list[pa.RecordBatch]]:
    """Batches in lists of at most so many bytes, or of one batch; empty ones are left out."""
    held, load = [], 0
    for b in batches:
        if held and load + b.nbytes > limit:
            yield held
            held, load = [], 0
        if b.num_rows:
            held.append(b)
            load += b.nbytes
    if held:
        yield held


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class Packer:
    """Writes ids to one Arrow file, batch by batch."""

    def __init__(self, path: str, id_type: pa.DataType, width: pa.DataType, length: int):
        self.fs, self.path = filesystem(path)
        self.width, self.length, self.id_type = width, length, id_type
        self.doc = pa.struct([("doc", id_type), ("at", pa.int32()), ("n", pa.int64())])
        self.schema = pa.schema([("tokens", pa.list_(width, length)), ("mask", pa.list_(pa.uint8(), length // 8)), ("docs", pa.list_(self.doc))])
        self.sink = self.fs.open_output_stream(self.path)
        self.writer = pa.ipc.new_file(self.sink, self.schema)
        self.held, self.load, self.starts, self.total, self.docs = [], 0, [], 0, 0

    def add(self, doc, ids: np.ndarray) -> None:
        self.starts.append((self.load, doc, len(ids)))
        self.held.append(ids)
        self.load += len(ids)
        self.total += len(ids)
        self.docs += 1
        if self.load >= BATCH * self.length:
            self.flush(False)

    def flush(self, last: bool) -> None:
        flat = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        # all batches but the last of a file hold BATCH sequences
        full = -(-len(flat) // self.length) if last else len(flat) // self.length // BATCH * BATCH
        if not full:
            return
        cut = full * self.length
        body = np.zeros(cut, self.width.to_pandas_dtype())
        have = min(cut, len(flat))
        body[:have] = flat[:have]
        mask = np.packbits(np.arange(cut) < have, bitorder="little")
        here = [s for s in self.starts if s[0] < cut]
        row = [[] for _ in range(full)]
        for at, doc, n in here:
            row[at // self.length].append({"doc": doc, "at": at % self.length, "n": n})
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(body), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length // 8), pa.array(row, pa.list_(self.doc))]
        for i in range(0, full, BATCH):
            self.writer.write_batch(pa.record_batch([a.slice(i, BATCH) for a in arrays], schema=self.schema))
        self.starts = [(at - cut, doc, n) for at, doc, n in self.starts if at >= cut]
        self.held, self.load = [flat[have:]] if have < len(flat) else [], len(flat) - have

    def close(self) -> None:
        self.flush(True)
        self.writer.close()
        self.sink.close()


def write_tokens(docs: DataFrame, path: str, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Write Arrow files under path; return the manifest: part, file, n_docs, n_tokens, base (ids in the parts before)."""
    spark = docs.sparkSession
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    # bounds come from ids and hashes, so that a span of equal ids can be cut too
    rows = rows.withColumn("_h", F.xxhash64("_t"))
    rows = rows.repartitionByRange("_id", "_h").sortWithinPartitions("_id", "_h", "_t").select("_id", "_t")
    id_type = rows.schema["_id"].dataType
    make_dir(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encode, packer = TaskContext.get().partitionId(), None, None
        for held in gathered(batches):
            b = held[0]
            if packer is None:
                encode = encoder(vocabulary)
                width = pa.uint16() if encode.tokenizer.get_vocab_size() <= 1 << 16 else pa.uint32()
                file = f"{path}/part-{part:05d}-{uuid.uuid4().hex}.arrow"
                packer = Packer(file, b.schema.field(0).type, width, length)
            ids = [i for b in held for i in b.column(0).to_pylist()]
            flat, n = encode.flat(pa.concat_arrays([b.column(1) for b in held]), [end_id])
            upto = np.cumsum(n)
            for doc, at, end in zip(ids, (upto - n).tolist(), upto.tolist(), strict=True):
                packer.add(doc, flat[at:end])
        if packer is not None:
            packer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [file], "n_docs": [packer.docs], "n_tokens": [packer.total]})

    assert isinstance(id_type, T.DataType)
    manifest = materialize(rows.mapInArrow(run, "part int, file string, n_docs long, n_tokens long"), "manifest", "gathered")
    # a row for each file, not for each document
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("base", F.coalesce(before, F.lit(0)))


def each_file(files: DataFrame) -> DataFrame:
    """A table with a row for each file (file and more), dealt out so that each file has a task of its own: a number of partitions is kept by adaptive execution, which would join those of so small a table."""
    return files.repartitionByRange(max(1, files.count()), "file")


def open_file(path: str) -> pa.ipc.RecordBatchFileReader:
    """A reader of one file: memory-mapped, and so without copies, where the file system is local."""
    fs, name = filesystem(path)
    return pa.ipc.open_file(pa.memory_map(name) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(name))


def sequence(reader: pa.ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence i of a file, as a view of its bytes, and its mask. Its batch follows from its number: all but the last hold BATCH."""
    batch, i = reader.get_batch(i // BATCH), i % BATCH
    length = batch.schema.field("tokens").type.list_size
    tokens = batch.column("tokens").values.to_numpy(zero_copy_only=True)
    mask = batch.column("mask").values.to_numpy(zero_copy_only=True)
    return tokens[i * length : (i + 1) * length], mask[i * length // 8 : (i + 1) * length // 8]


def read_documents(manifest: DataFrame, id_type: T.DataType) -> DataFrame:
    """A row for each document in the files: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader = open_file(file)
                place, crc, left, now = base, 0, 0, None
                for k in range(reader.num_record_batches):
                    batch = reader.get_batch(k)
                    length = batch.schema.field("tokens").type.list_size
                    offset = batch.column("tokens").offset
                    flat = batch.column("tokens").values.to_numpy(zero_copy_only=True)[offset * length : (offset + batch.num_rows) * length]
                    done, at = [], 0
                    begins = [(i * length + d["at"], d["doc"], d["n"]) for i, row in enumerate(batch.column("docs").to_pylist()) for d in row]
                    for begin, doc, n in [*begins, (len(flat), None, 0)]:
                        if now is not None:
                            take = flat[at : at + left]
                            crc = zlib.crc32(take.astype("<u4").tobytes(), crc)
                            left -= len(take)
                            if not left:
                                done.append((now[0], now[1], now[2], crc))
                                now = None
                        if begin < len(flat):
                            now, at, left, crc = (doc, place, n), begin, n, 0
                            place += n
                    if done:
                        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], batch.schema.field("docs").type.value_type.field("doc").type), *(pa.array([d[i] for d in done], pa.int64()) for i in (1, 2, 3))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return each_file(manifest.select("file", "base")).mapInArrow(run, f"doc_id {id_type.simpleString()}, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, as read back from the files."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path("word_bpe_49k.json")
    manifest = write_tokens(docs, new_path(docs.sparkSession, "tokens"), vocabulary)
    return read_documents(manifest, docs.schema["doc_id"].dataType)
