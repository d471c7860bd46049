"""Token ids as flat binary files: encode, write, read back memory-mapped.

A range of ascending doc_id is one part: ``.ids`` (all ids, little-endian
unsigned, 16 bits wide where the vocabulary allows it, else 32), ``.off`` (64-bit document offsets, one more than documents)
and ``.doc`` (64-bit document ids).  A part's base in the whole sequence is the
prefix sum of the parts before it, taken over one manifest row a part.  Each
task attempt writes names of its own and the manifest names what counts, so
retries and speculative copies do no harm.

Texts are cut where the byte-level pre-tokenizer always cuts (around runs of
white space); distinct cuts are encoded once per worker by the tokenizers
library, and a bounded dictionary keeps their ids.

Defined results: null text is empty and gives the end id alone; rows without
doc_id are left out of files that are addressed by it -- they come first, as
doc_id null; repeated ids follow each other in order of their texts; texts of any length are
encoded whole, a task holds the ids of its part; empty tables give no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

MANIFEST = "part int, name string, width int, n_docs long, n_ids long"
NULL_ID = -(1 << 63)
#: The pre-tokenizer's own pattern where letters and digits are of these ranges; elsewhere runs between white space.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
PRETOKENS = re.compile(rf" ?[{LETTERS}]+|'(?:[stmd]|re|ve|ll)| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+")
OTHER = re.compile(rf"[^\t\n\r\x20-\x7e{LETTERS}]")
CUTS = re.compile(r" ?\S+|\s+(?!\S)|\s+")
#: Where Python's idea of white space and the tokenizer's differ (all of these are OTHER), and special tokens: such texts are encoded whole.
WHOLE, SPECIAL = re.compile("[\x1c-\x1f\x85\u180e\u200b\u2060\ufeff]"), "<|"
CACHED = 300_000


class Words(dict):
    """Ids of words; what is missing is taken from the words before, or encoded."""

    def __init__(self, older: dict[str, bytes], encode):
        self.older, self.encode = older, encode

    def __missing__(self, word: str) -> bytes:
        self[word] = x = self.older.get(word) or self.encode(word)
        return x


class Encoder:
    """ids of texts as little-endian bytes, by the tokenizers library."""

    def __init__(self, tokenizer_json: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        plain = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        seen = [plain.pre_tokenize_str(chr(b))[0][0] if b < 128 else None for b in range(256)]
        for code in range(128, 0x250):  # every byte over 127 that these letters use
            for byte, char in zip(chr(code).encode(), plain.pre_tokenize_str(chr(code))[0][0], strict=True):
                seen[byte] = char
        self.shown = {b: c for b, c in enumerate(seen) if c}
        self.width = 2 if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self.bytes = [i.to_bytes(self.width, "little") for i in range(1 + max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0))]
        self.known = Words({}, self._word)

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """One pre-token of the ranges above: the library's merges alone."""
        shown = word.encode().decode("latin-1").translate(self.shown)
        return b"".join([self.bytes[t.id] for t in self.model.tokenize(shown)])

    def _of(self, cuts: list[str]) -> bytes:
        """Cuts that are not of the ranges above; the new ones are encoded in one call."""
        known, old = self.known, self.known.older
        new = {w for w in cuts if w not in known}
        known.update((w, old[w]) for w in new if w in old)
        new = [w for w in new if w not in old]
        known.update(zip(new, self._raw(new), strict=True))
        return b"".join(map(known.__getitem__, cuts))

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHED:  # words not seen since the last turn but one are forgotten
            self.known.older, self.known = {}, Words(self.known, self._word)
        out = []
        for text in texts:
            other = OTHER.search(text)
            if SPECIAL in text or other and WHOLE.search(text, other.start()):
                out.append(self._raw([text])[0])
            elif other:
                out.append(self._of(CUTS.findall(text)))
            else:
                out.append(b"".join(map(self.known.__getitem__, PRETOKENS.findall(text))))
        return out


_encoders: dict[int, Encoder] = {}


def encoder(tokenizer_json: str) -> Encoder:
    """One for each worker process and tokenizer."""
    key = zlib.crc32(tokenizer_json.encode())
    if key not in _encoders:
        _encoders[key] = Encoder(tokenizer_json)
    return _encoders[key]


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None = 2, text: str = "text") -> list[tuple[str, int, int, int, int]]:
    """Writes the parts; returns (name, bytes an id, documents, ids, base) of each, in order."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        model = spark.sparkContext.broadcast(f.read())

    def part(batches):
        enc = encoder(model.value)
        end = b"" if end_id is None else end_id.to_bytes(enc.width, "little")
        name = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        chunks, offsets, ids, n = [], [np.zeros(1, np.int64)], [], 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                codes = [x + end for x in enc.encode([t or "" for t in some.column(1).to_pylist()])]
                ends = n + np.cumsum([len(x) // enc.width for x in codes])
                n = int(ends[-1])
                offsets.append(ends)
                chunks.append(b"".join(codes))
                ids.append(some.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False))
        if ids:
            shared.put(f"{name}.ids", chunks)
            shared.put(f"{name}.off", np.concatenate(offsets).astype("<i8"))
            shared.put(f"{name}.doc", np.concatenate(ids).astype("<i8"))
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([enc.width], pa.int32()), pa.array([sum(map(len, ids))]), pa.array([n])], names=["part", "name", "width", "n_docs", "n_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = shared.written(rows.mapInArrow(part, MANIFEST), "manifest").orderBy("part").collect()  # a few numbers a part
    out, base = [], 0
    for m in manifest:
        out.append((m["name"], m["width"], m["n_docs"], m["n_ids"], base))
        base += m["n_ids"]
    return out


def read(spark: SparkSession, parts: list[tuple[str, int, int, int, int]], with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def documents(batches):
        for b in batches:
            for name, width, base in zip(*(b.column(i).to_pylist() for i in (0, 1, 4)), strict=True):
                codes, offsets, ids = (shared.mapped(f"{name}{x}", t) for x, t in ((".ids", f"<u{width}"), (".off", "<i8"), (".doc", "<i8")))
                for at in range(0, len(ids), 4096):
                    cut = np.asarray(offsets[at : at + 4097])
                    some = np.asarray(ids[at : at + 4096])
                    own = [np.asarray(codes[i:j]).astype("<u4") for i, j in zip(cut[:-1], cut[1:], strict=True)]
                    cols = [pa.array(some, mask=some == NULL_ID), pa.array(base + cut[:-1]), pa.array(np.diff(cut)), pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())]
                    cols += [pa.array([x.astype(np.int64) for x in own], pa.list_(pa.int64()))] * with_ids
                    yield pa.record_batch(cols, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    table = spark.createDataFrame(parts, "name string, width int, n_docs long, n_ids long, base long")
    return table.repartition(max(1, len(parts))).mapInArrow(documents, schema)


def token_files(docs: DataFrame, tokenizer_path: str, end_id: int | None = 2, text: str = "text") -> DataFrame:
    """Encode and write to the shared folder, then read back."""
    spark = docs.sparkSession
    return read(spark, write(docs, shared.fresh(spark, "ids"), tokenizer_path, end_id, text))
