"""Token ids as flat unsigned integer files with 64-bit document offsets (operator 8).

Format. A folder holds, for each non-empty partition ``p`` of the documents in ascending order:

* ``part-p.tokens``: the ids of its documents, end id included, as little-endian unsigned integers of one width
  (2 bytes if every id of the vocabulary fits, else 4), nothing between documents;
* ``part-p.offsets``: unsigned 64-bit positions, in ids from the start of the part: one per document and the end;
* ``part-p.ids``: signed 64-bit document ids in the same order, null as the smallest number;

and a table ``manifest`` with one row per part: its counts, and its bases, the prefix sums of the counts of all parts
before it. The id of document ``d`` of a part at local position ``i`` has the global position ``base_tokens + i``.

A part is written under the name of its task attempt and then renamed, so attempts that die or run twice do no harm.
Files are reached through ``pyarrow.fs`` by the scheme of the folder; a folder without one is a mounted path.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyspark.llm.common import id_bounds, kept_in_worker, partitions
from storyspark.llm.pieces import Answers, byte_letters, keys, literal

#: Pieces whose ids a Python worker keeps, about 200 bytes each.
KEPT_PIECES = 300_000
#: Stands for a null document id in the files.
NO_ID = -(2**63)
_PARTS = "part bigint, n_docs bigint, n_tokens bigint, width int"


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


class _Encoder:
    """Ids of a text as bytes, with the library's answers kept by piece."""

    def __init__(self, tokenizer_path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 2**16 else 4
        self.kind = f"<u{self.width}"
        spec = json.loads(self.tokenizer.to_str())
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        #: Only a plain byte-level BPE is known to treat pieces apart.
        self.by_piece = (
            spec["normalizer"] is None
            and {k: (spec["pre_tokenizer"] or {}).get(k) for k in byte_level} == byte_level
            and spec["model"]["type"] == "BPE"
            and not any(t[k] for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word"))
            and not any(" " in t["content"] or "\n" in t["content"] for t in spec["added_tokens"])
        )
        if self.by_piece:
            self.letters = byte_letters()
            self.line_end = len(self.whole("\n"))
        self.answers = Answers(self.piece, KEPT_PIECES)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def piece(self, key: str) -> bytes:
        if key.isalpha():  # one pre-token, so the model alone gives the same
            symbols = f" {key}".encode().decode("latin-1").translate(self.letters)
            return np.array([t.id for t in self.tokenizer.model.tokenize(symbols)], self.kind).tobytes()
        return self.whole(literal(key))

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_piece:
            return self.whole(text)
        head, rest = keys(text)
        body = b"".join(map(self.answers.__getitem__, rest))
        return body[self.line_end :] if head is None else self.whole(head) + body


class _Part:
    """One part that is being written."""

    def __init__(self, folder: str, place: int, attempt: int, encoder: _Encoder, end_id: int) -> None:
        self.place, self.encoder = place, encoder
        self.files, root = _filesystem(folder)
        self.files.create_dir(root, recursive=True)
        self.names = {kind: (f"{root}/_attempt-{attempt}-{place}.{kind}", f"{root}/{_name(place)}.{kind}") for kind in ("tokens", "offsets", "ids")}
        self.out = {kind: self.files.open_output_stream(mine) for kind, (mine, _) in self.names.items()}
        self.end = np.array([end_id], encoder.kind).tobytes()
        self.at = self.n_docs = 0

    def add(self, ids: list[int | None], texts: list[str]) -> None:
        encoded = [self.encoder.ids(text) + self.end for text in texts]
        ends = np.cumsum([len(x) // self.encoder.width for x in encoded], dtype=np.int64) + self.at
        self.out["tokens"].write(b"".join(encoded))
        self.out["offsets"].write(np.concatenate([[self.at], ends[:-1]]).astype("<u8").tobytes())
        self.out["ids"].write(np.array([NO_ID if i is None else i for i in ids], "<i8").tobytes())
        self.at, self.n_docs = int(ends[-1]), self.n_docs + len(encoded)

    def close(self) -> pa.RecordBatch:
        self.out["offsets"].write(np.array([self.at], "<u8").tobytes())
        for kind, (mine, final) in self.names.items():
            self.out[kind].close()
            self.files.move(mine, final)
        row = {"part": self.place, "n_docs": self.n_docs, "n_tokens": self.at, "width": self.encoder.width}
        return pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]))


def _name(part: int) -> str:
    return f"part-{part:06d}" if part >= 0 else f"part-null-{-part:06d}"


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, n_parts: int | None = None) -> DataFrame:
    """Encode every text of ``docs (doc_id, text)`` into the files above and return the manifest.

    Documents go in ascending order of ``doc_id``, null first; rows of one id follow each other by a hash of their text,
    then by the text. A null text is empty and has the end id alone. Other columns are not used. Texts move once, packed, to
    ranges of ids (of hashes, where the id is null); what the driver gets is one row per part.
    """
    spark = docs.sparkSession
    n_parts = n_parts or partitions(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    bounds = np.array(id_bounds(texts, 2 * n_parts), np.int64)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            ids, ties = batch.column(0), batch.column(1).to_numpy()
            known = np.array(ids.is_valid())
            by_id = np.searchsorted(bounds, ids.fill_null(0).to_numpy(), side="right")
            by_tie = np.floor((ties / 2.0**64 + 0.5) * n_parts).astype(np.int64) - n_parts - 1
            packed = pa.array((squeeze(text.encode("utf-8", "surrogatepass")) for text in batch.column(2).to_pylist()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.where(known, by_id, by_tie)), ids, batch.column(1), packed], ["range", "doc_id", "tie", "packed"])

    packed = texts.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(pack, "range bigint, doc_id bigint, tie bigint, packed binary")
    # One text always packs to the same bytes, so equal ones stay together.
    ordered = packed.repartition(n_parts, "range").sortWithinPartitions("range", "doc_id", "tie", "packed").select("range", "doc_id", "packed")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept_in_worker("encoder", tokenizer_path, lambda: _Encoder(tokenizer_path))
        unpack = zstandard.ZstdDecompressor().decompress
        part = None
        for batch in batches:
            places = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(places)) + 1).tolist(), len(places)]
            for first, last in zip(cuts, cuts[1:], strict=False):
                if part is not None and part.place != places[first]:
                    yield part.close()
                    part = None
                part = part or _Part(folder, int(places[first]), TaskContext.get().taskAttemptId(), encoder, end_id)
                for start in range(first, last, 500):
                    some = batch.slice(start, min(500, last - start))
                    part.add(some.column(1).to_pylist(), [unpack(x).decode("utf-8", "surrogatepass") for x in some.column(2).to_pylist()])
        if part is not None:
            yield part.close()

    parts = sorted(ordered.mapInArrow(write, _PARTS).collect())
    base_docs = [0, *accumulate(p.n_docs for p in parts)]
    base_tokens = [0, *accumulate(p.n_tokens for p in parts)]
    rows = [(*p, d, t) for p, d, t in zip(parts, base_docs, base_tokens, strict=False)]
    spark.createDataFrame(rows, f"{_PARTS}, base_docs bigint, base_tokens bigint").coalesce(1).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document of a folder of token files, read by mapping the files into memory.

    ``doc_id``, ``part``, ``start`` (ids of all documents before it), ``n_tokens`` (end id included) and
    ``ids_crc32`` (of its ids as little-endian unsigned 32-bit integers). A folder without parts gives no rows.
    """
    manifest = spark.read.parquet(f"{folder}/manifest").select("part", "width", "n_docs", "base_tokens")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        local = isinstance(files, pafs.LocalFileSystem)

        def mapped(name: str, kind: str) -> np.ndarray:
            if local:
                return np.memmap(f"{root}/{name}", dtype=kind, mode="r")
            with files.open_input_file(f"{root}/{name}") as source:
                return np.frombuffer(source.read_buffer(), kind)

        for batch in batches:
            for row in batch.to_pylist():
                name = _name(row["part"])
                tokens = mapped(f"{name}.tokens", f"<u{row['width']}")
                offsets, ids = mapped(f"{name}.offsets", "<u8").astype(np.int64), mapped(f"{name}.ids", "<i8")
                for first in range(0, row["n_docs"], 10_000):
                    some = range(first, min(first + 10_000, row["n_docs"]))
                    crc = [zlib.crc32(tokens[offsets[k] : offsets[k + 1]].astype("<u4").tobytes()) for k in some]
                    own, begin, end = np.array(ids[some.start : some.stop]), offsets[some.start : some.stop], offsets[some.start + 1 : some.stop + 1]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(own, mask=own == NO_ID),
                            pa.array(np.full(len(own), row["part"], np.int64)),
                            pa.array(begin + row["base_tokens"]),
                            pa.array(end - begin),
                            pa.array(crc, pa.int64()),
                        ],
                        ["doc_id", "part", "start", "n_tokens", "ids_crc32"],
                    )

    spread = manifest.repartition(partitions(spark), "part")
    return spread.mapInArrow(read, "doc_id bigint, part bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
