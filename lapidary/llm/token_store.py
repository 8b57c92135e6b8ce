"""Token ids in binary blocks: each document compressed alone with one shared zstandard dictionary.

``write`` makes three Parquet tables in one folder, so that any store Spark can write to will do and a lost task is
written again by Spark's commit:

* ``dictionary``: one row with the dictionary, its SHA-256 (the dictionary hash) and the id type;
* ``blocks``: one row per block of neighbouring documents with ``shard, block``, the dictionary hash, the first and
  last doc_id, the ids in the shard before it, the payload (the compressed frames one after another) and the offset
  index: ``doc_ids``, ``n_tokens`` and ``offsets`` (one more than documents) as columns of their own, so that a look-up
  reads the index without payloads and then decompresses one frame;
* ``shards``: the number of ids per shard.

Documents are dealt by ranges of doc_id and sorted within them, so shard, block and place in the block give ascending
doc_id order. A document's start is the ids of all shards before, known from the small ``shards`` table, plus the ids
before it in its shard. Frames hold little-endian ids, 16 bits wide where the vocabulary allows it, else 32.

The dictionary is trained on at most ``samples`` pieces of ``piece`` ids, taken from the documents first in a seeded
hash order; too small a corpus for training gives a raw dictionary of the pieces themselves.

Defined results: null texts are empty, empty texts hold the end id alone. Null doc_ids come first; rows that tie in
doc_id are ordered by a hash of the text and all written. Very long texts are encoded whole, in pieces cut where the
tokenizer cuts. An empty table gives a store without blocks. Only id and text are read, so names of other columns
cannot clash.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel

from lapidary.llm.common import first_by

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
BLOCK_DOCUMENTS, BLOCK_BYTES = 1024, 4 << 20
DICTIONARY_BYTES, SAMPLES, PIECE, SEED, LEVEL = 64 << 10, 2000, 2048, 5, 3
#: Pieces of text whose ids a worker remembers (about 250 bytes each).
REMEMBERED = 1_000_000

#: The tokenizer's own rule cuts a text before a blank that a visible character follows, and around a single line
#: break between visible characters. Pieces cut there can be encoded apart.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_ODD = ("  ", " \n", "\n ", "\n\n", "\0", "\t", "\r", "\x0b", "\x0c")
_WIDE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def pieces_of(text: str) -> list[str]:
    """Pieces of a text: ``\\0`` before one without a blank before it; else the blank is left out, line breaks apart."""
    plain = not (text[:1] in " \n" or text[-1:] in " \n" or any(x in text for x in _ODD))
    if plain and (text.isascii() or not _WIDE.search(text)):
        return f"\0{text}".replace("\n", " \n \0").split(" ")
    return [f"\0{x}" for x in _PIECE.findall(text)]


#: ASCII marks that the tokenizer cuts from a word before them. An apostrophe is none: the tokenizer knows endings with it.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Letters beyond ASCII up to U+024F, which words of Latin script consist of.
_LETTERS = [x for x in map(chr, range(0x80, 0x250)) if x.isalpha()]
#: Runs of marks whose ids a worker remembers.
MARKS = 4096


def _text_of(piece: str) -> str:
    return piece[1:] if piece[0] == "\0" else piece if piece == "\n" else f" {piece}"


class Encoder:
    """Texts to id bytes. The tokenizers library encodes each distinct piece once while it is remembered.

    Pieces are remembered in two halves: when the newer is full it becomes the older, and a piece that is met again moves
    to the newer, so that frequent pieces stay known and rare ones go. A word of Latin letters with marks behind it, which
    the tokenizer itself cuts between the two, goes to the library's BPE model, other pieces to the whole tokenizer.
    With ``special`` the strings of added tokens get those tokens' ids, as the library does by default; such texts are
    encoded whole. Without it they are ordinary text.
    """

    def __init__(self, name: str = TOKENIZER, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = not special
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        self.type = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        # typecodes H and I are 2 and 4 bytes
        self.code = "H" if self.type == "<u2" else "I"
        self.model, cut = self.tokenizer.model, self.tokenizer.pre_tokenizer
        rule = self.tokenizer.normalizer is None and isinstance(cut, ByteLevel) and cut.use_regex and not cut.add_prefix_space
        #: Whether a word's ids are those that the model gives for its bytes as the pre-tokenizer writes them.
        self.by_word = rule and isinstance(self.model, BPE)
        self.blank, self.letters = "", {}
        if self.by_word:
            self.blank, *written = ("".join(x for x, _ in cut.pre_tokenize_str(c)) for c in (" ", *_LETTERS))
            self.letters = dict(zip(map(ord, _LETTERS), written))
        self.marks = lru_cache(MARKS)(self._word)
        self.known, self.older = _Pieces(self), {}
        self.remembered = REMEMBERED
        self.end = np.array([END_ID], self.type).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """All ids of each text and the end id."""
        if len(self.known) > self.remembered // 2:
            self.known, self.older = _Pieces(self), self.known
        return [(self._text(t) if t else b"") + self.end for t in texts]

    def _text(self, text: str) -> bytes:
        if any(x in text for x in self.added):
            return self._whole(text)
        return b"".join(map(self.known.__getitem__, pieces_of(text)))

    def piece(self, piece: str) -> bytes:
        word = piece.rstrip(_MARKS)
        bare = word[1:] if word[:1] == "\0" else word
        if not self.by_word or not bare.isalpha() or not (bare.isascii() or max(bare) <= _LETTERS[-1]):
            return self._whole(_text_of(piece))
        coded = bare if bare.isascii() else bare.translate(self.letters)
        ids = self._word(coded if bare is not word else self.blank + coded)
        return ids + self.marks(piece[len(word) :]) if len(word) < len(piece) else ids

    def _word(self, word: str) -> bytes:
        return array(self.code, [t.id for t in self.model.tokenize(word)]).tobytes()

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()


class _Pieces(dict):
    """Ids of pieces; a piece that is not there is taken from the encoder's older half, else encoded."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, piece: str) -> bytes:
        found = self.encoder.older.get(piece)
        if found is None:
            found = self.encoder.piece(piece)
        self[piece] = found
        return found


_encoders: dict[str, Encoder] = {}


def _encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name, special=True)
    return _encoders[name]


def train_dictionary(docs: DataFrame, tokenizer: str = TOKENIZER, samples: int = SAMPLES, piece: int = PIECE) -> bytes:
    """The shared dictionary; ``docs`` has ``doc_id, text``. At most ``samples`` pieces reach the driver."""
    order = F.xxhash64(F.lit(SEED), "doc_id", "text")
    first = first_by(docs.select("doc_id", "text"), order, samples).select("text", "order")

    def run(batches):
        width = piece * np.dtype(_encoder(tokenizer).type).itemsize
        for batch in batches:
            coded = _encoder(tokenizer).encode(batch.column("text").to_pylist())
            for order, data in zip(batch.column("order").to_pylist(), coded):
                pieces = [data[i : i + width] for i in range(0, len(data), width)]
                columns = [pa.array([order] * len(pieces)), pa.array(range(len(pieces))), pa.array(pieces, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["order", "place", "piece"])

    cut = first.mapInArrow(run, "order long, place long, piece binary").orderBy("place", "order").limit(samples)
    pieces = [bytes(r.piece) for r in cut.collect()]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=9).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(pieces)[-DICTIONARY_BYTES:] or b"\0" * 8


_BLOCKS = (
    "shard int, block int, dictionary_hash string, first_id {id}, last_id {id}, tokens_before long, tokens long, "
    "doc_ids array<{id}>, n_tokens array<long>, offsets array<long>, payload binary"
)


def _coded(batch: pa.RecordBatch, encoder: Encoder, step: int = 500):
    """Ids and id bytes of the documents of a batch, some hundred texts at a time."""
    for i in range(0, batch.num_rows, step):
        part = batch.slice(i, step)
        yield from zip(part.column("doc_id").to_pylist(), encoder.encode(part.column("text").to_pylist()))


def _blocks(tokenizer: str, dictionary: bytes, digest: str, id_type: pa.DataType, remembered: int):
    def run(batches):
        encoder, shard = _encoder(tokenizer), TaskContext.get().partitionId()
        encoder.remembered = remembered
        shared = zstandard.ZstdCompressionDict(dictionary)
        shared.precompute_compress(level=LEVEL)  # else it is digested anew for each document
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared)
        width = np.dtype(encoder.type).itemsize
        before, block, ids, sizes, frames, held = 0, 0, [], [], [], 0

        def row():
            tokens = [s // width for s in sizes]
            offsets = np.cumsum([0, *map(len, frames)])
            numbers = (pa.array([x], t) for x, t in ((shard, pa.int32()), (block, pa.int32())))
            lists = (pa.array([x], pa.list_(t)) for x, t in ((ids, id_type), (tokens, pa.int64()), (offsets.tolist(), pa.int64())))
            ends = (pa.array([x], id_type) for x in (ids[0], ids[-1]))
            sums = (pa.array([x], pa.int64()) for x in (before, sum(tokens)))
            columns = [*numbers, pa.array([digest]), *ends, *sums, *lists, pa.array([b"".join(frames)], pa.binary())]
            names = "shard block dictionary_hash first_id last_id tokens_before tokens doc_ids n_tokens offsets payload"
            return pa.RecordBatch.from_arrays(columns, names.split()), sum(tokens)

        for batch in batches:
            for doc_id, data in _coded(batch, encoder):
                ids.append(doc_id)
                sizes.append(len(data))
                frames.append(press.compress(data))
                held += len(data)
                if len(ids) >= BLOCK_DOCUMENTS or held >= BLOCK_BYTES:
                    made, tokens = row()
                    yield made
                    before, block, ids, sizes, frames, held = before + tokens, block + 1, [], [], [], 0
        if ids:
            yield row()[0]

    return run


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, remembered: int = REMEMBERED) -> None:
    """Write the store of ``docs`` (``doc_id, text``) into the folder ``path``.

    A worker keeps the ids of up to ``remembered`` pieces, after its last task too: fewer take less memory from stages
    that follow in the same workers, and more time.
    """
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, tokenizer)
    digest = hashlib.sha256(dictionary).hexdigest()
    kind = _encoder(tokenizer).type
    spark.createDataFrame([(digest, bytearray(dictionary), kind)], "hash string, dictionary binary, id_type string").write.parquet(f"{path}/dictionary")
    tie = F.xxhash64("text")
    dealt = docs.select("doc_id", "text", tie.alias("tie")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    id_field = docs.schema["doc_id"].dataType
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_field.simpleString()]
    made = dealt.select("doc_id", "text").mapInArrow(
        _blocks(tokenizer, dictionary, digest, arrow, remembered), _BLOCKS.format(id=id_field.simpleString())
    )
    made.write.parquet(f"{path}/blocks")
    blocks = spark.read.parquet(f"{path}/blocks")
    blocks.groupBy("shard").agg(F.sum("tokens").alias("tokens")).write.parquet(f"{path}/shards")


def _read_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes, str]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row.dictionary).hexdigest() != row.hash:
        raise ValueError(f"the dictionary in {path} does not have its hash")
    return row.hash, bytes(row.dictionary), row.id_type


def _frames(blocks: DataFrame, digest: str, dictionary: bytes, kind: str, out: StructType, emit) -> DataFrame:
    """``emit(block row as dict, ids of a document, its place)`` gives a tuple of ``out`` for each document."""

    def run(batches):
        unpress = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
        for batch in batches:
            for block in batch.to_pylist():
                if block["dictionary_hash"] != digest:
                    raise ValueError(f"block {block['shard']}/{block['block']} was written with another dictionary")
                payload, offsets = memoryview(block["payload"]), block["offsets"]
                found = []
                for place in range(len(block["doc_ids"])) if block.get("place") is None else [block["place"]]:
                    frame = payload[offsets[place] : offsets[place + 1]]
                    found.append(emit(block, np.frombuffer(unpress.decompress(frame), kind), place))
                columns = [pa.array(x) for x in zip(*found)]
                yield pa.RecordBatch.from_arrays(columns, out.names)

    return blocks.mapInArrow(run, out)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from its ids in the files: ``doc_id, start, n_tokens, ids_crc32``."""
    digest, dictionary, kind = _read_dictionary(spark, path)
    shards = spark.read.parquet(f"{path}/shards")
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each shard, that is for each task of the writer: bounded by the number of partitions.
    bases = shards.select("shard", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("base"))
    blocks = spark.read.parquet(f"{path}/blocks").join(F.broadcast(bases), "shard")
    out = StructType([StructField("doc_id", blocks.schema["first_id"].dataType), *(StructField(n, LongType()) for n in ("start", "n_tokens", "ids_crc32"))])

    def emit(block, ids, place):
        if not place:
            block["next"] = block["base"] + block["tokens_before"]
        start = block["next"]
        block["next"] += len(ids)
        return block["doc_ids"][place], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())

    return _frames(blocks, digest, dictionary, kind, out, emit)


def read_documents(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """``doc_id, ids`` of the documents named in the column ``doc_id`` of ``ids``; one frame each is decompressed.

    The index columns find the places; payloads are read for those blocks alone.
    """
    digest, dictionary, kind = _read_dictionary(spark, path)
    blocks = spark.read.parquet(f"{path}/blocks")
    index = blocks.select("shard", "block", F.posexplode("doc_ids").alias("place", "doc_id"))
    places = index.join(ids.select("doc_id").distinct(), "doc_id").select("shard", "block", "place")
    wanted = blocks.join(places, ["shard", "block"])
    out = StructType([StructField("doc_id", blocks.schema["first_id"].dataType)]).add("ids", ArrayType(LongType()))
    return _frames(wanted, digest, dictionary, kind, out, lambda b, x, p: (b["doc_ids"][p], x.tolist()))
