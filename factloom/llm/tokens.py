"""Token ids and their flat binary files.

Files. Documents are range-partitioned by id and sorted; partition p writes, in the shared folder,

    part-ppppp.ids      the ids, unsigned little-endian, 16 bits if the vocabulary allows, else 32
    part-ppppp.offsets  unsigned 64-bit starts of its documents within the part, and the end
    part-ppppp.docs     signed 64-bit document ids

A file is written under a name of its own attempt and then renamed, so a retried task leaves the same file.
The parts' sizes come back as one row each; their prefix sums give the bases, kept in ``bases.json``:
document d of part p starts at ``base[p] + offsets[d]``. Readers map the files into memory.

Tokenising. Word tokenizers that drop white space give a text the ids of its words in order, so a
worker keeps the ids of the words it has seen, up to ``CACHED_WORDS``, and encodes only new ones, in batches.
A text is first cut around the tokenizer's special tokens, which have their own ids as in the library's plain call.

Defined cases: null or empty text has no ids but the end id; rows that repeat an id are neighbours, each
a document of its own; a null id sorts first and is written as the smallest 64-bit number, null when read; an empty table gives no parts
and an empty result.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from factloom.operators.staging import Staging

CACHED_WORDS = 1_000_000
#: Characters that byte-level vocabularies write for bytes: the byte's own if it is printable, else the next from U+0100.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in PRINTABLE)}
MARKS = b".,;:!?"
NO_ID = -(2**63)


class WordTokenizer:
    """Encodes texts with a lower-casing tokenizer whose tokens never span ASCII white space.

    New words are encoded as one text with the digit 0 between them, a token of its own in such
    vocabularies, and told apart by its id; words that hold a 0 are encoded singly.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.inner = Tokenizer.from_file(path)
        self.special = {t.content: np.array([i], "<u4").tobytes() for i, t in self.inner.get_added_tokens_decoder().items() if t.special}
        if any(t.normalized or t.single_word or t.lstrip or t.rstrip for t in self.inner.get_added_tokens_decoder().values()):
            raise ValueError("the tokenizer's added tokens aren't plain literals")
        self.cut = re.compile("|".join(f"({re.escape(t)})" for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.inner.encode_special_tokens = True  # words hold none of them once the text is cut
        self.known: dict[bytes, bytes] = {}
        self.tails: dict[bytes, bytes] = {}
        self.mark = self._ids("0")
        if len(self.mark) != 1 or self._ids("a 0 b") != [*self._ids("a"), *self.mark, *self._ids("b")]:
            raise ValueError("the tokenizer doesn't keep the digit 0 apart")
        self.model, self.direct = self.inner.model, True
        probes = ("the", "\xe9t\xe9", "\xdcber", "stra\xdfe", "ni\xf1o", "zzxqj")
        self.direct = all(np.frombuffer(self._letters(x.encode()), "<u4").tolist() == self._ids(x) for x in probes)

    def _ids(self, text: str) -> list[int]:
        return self.inner.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def _letters(self, word: bytes) -> bytes | None:
        """The ids of a word of letters up to U+00FF, from the model alone: such a word is one piece, already
        in normal form once lower-cased. None for other words, or if this tokenizer doesn't work so."""
        if not self.direct:
            return None
        if not word.isalpha():
            text = word.decode()
            if not text.isalpha() or max(text) > "\xff":
                return None
            word = text.lower().encode()
        return array("I", [t.id for t in self.model.tokenize(word.decode("latin-1").translate(BYTE_CHARS))]).tobytes()

    @property
    def dtype(self) -> str:
        return "<u2" if self.inner.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4"

    def _learn(self, fresh: set[bytes]) -> None:
        """Adds the ids of new words. Closing marks after a letter or digit are tokens of their own."""
        known, tails, bodies = self.known, self.tails, {}
        for w in fresh:
            body = w.rstrip(MARKS)
            if len(body) < len(w) and body[-1:].isalnum():
                tail = w[len(body) :]
                if tail not in tails:
                    tails[tail] = np.array(self._ids(tail.decode()), "<u4").tobytes()
                bodies[w] = body
            else:
                bodies[w] = w
        new = {b for b in bodies.values() if b not in known}
        plain = []
        for b in new:
            if (direct := self._letters(b)) is not None:
                known[b] = direct
            elif b"0" not in b:
                plain.append(b)
        if plain:
            ids = np.array(self._ids(" 0 ".join([b.decode() for b in plain])), "<u4")
            cuts = np.flatnonzero(ids == self.mark[0]).tolist()
            if len(cuts) != len(plain) - 1:
                raise ValueError("the separator doesn't come back once a word")
            data = ids.tobytes()
            for b, start, end in zip(plain, [0, *(c + 1 for c in cuts)], [*cuts, len(ids)]):
                known[b] = data[4 * start : 4 * end]
        for b in new.difference(known):
            known[b] = np.array(self._ids(b.decode()), "<u4").tobytes()
        for w, body in bodies.items():
            if w is not body:
                known[w] = known[body] + tails[w[len(body) :]]
        if len(tails) > 10_000:
            tails.clear()

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one whole text, as unsigned 32-bit integers."""
        text = text or ""
        if any(t in text for t in self.special):
            parts = [x for x in self.cut.split(text) if x]
            return np.frombuffer(b"".join(self.special[x] if x in self.special else self._plain(x) for x in parts), "<u4")
        return np.frombuffer(self._plain(text), "<u4")

    def _plain(self, text: str) -> bytes:
        """The ids of a text without special tokens."""
        words = text.encode("utf-8", "replace").lower().split()
        if len(self.known) > CACHED_WORDS:  # the words met first are the frequent ones
            self.known = dict(islice(self.known.items(), CACHED_WORDS // 2))
        parts = list(map(self.known.get, words))
        try:
            data = b"".join(parts)
        except TypeError:  # some word is new
            places = [i for i, p in enumerate(parts) if p is None]
            self._learn({words[i] for i in places})
            for i in places:
                parts[i] = self.known[words[i]]
            data = b"".join(parts)
        return data


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.FileSystem.from_uri(folder.replace("file:", "file://", 1)) if folder.startswith("file:") else (pafs.LocalFileSystem(), folder))


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, staging: Staging, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Writes the files and returns ``bases.json``: dtype and, for each part, its base, ids and documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        words, context = WordTokenizer(tokenizer), TaskContext.get()
        name, mine = f"{root}/part-{context.partitionId():05d}", f".{context.taskAttemptId()}"
        out, offsets, ids, total = None, [0], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{name}.ids{mine}")
                found = words.encode(text).astype(words.dtype).tobytes() + np.array([end_id], words.dtype).tobytes()
                out.write(found)
                total += len(found) // int(words.dtype[2])
                offsets.append(total)
                ids.append(NO_ID if doc is None else doc)
        if out is None:
            return
        out.close()
        for kind, values in (("offsets", np.array(offsets, "<u8")), ("docs", np.array(ids, "<i8"))):
            with fs.open_output_stream(f"{name}.{kind}{mine}") as f:
                f.write(values.tobytes())
        for kind in ("ids", "offsets", "docs"):
            fs.move(f"{name}.{kind}{mine}", f"{name}.{kind}")
        yield pa.RecordBatch.from_arrays([pa.array([context.partitionId()], pa.int32()), pa.array([total], pa.int64()), pa.array([len(ids)], pa.int64())], names=["part", "ids", "docs"])

    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).repartitionByRange("id").sortWithinPartitions("id")
    parts = staging.write(ordered.mapInArrow(run, "part int, ids long, docs long"), "parts").orderBy("part").collect()  # one row a part
    base, listed = 0, []
    for p in parts:
        listed.append({"part": p["part"], "base": base, "ids": p["ids"], "docs": p["docs"]})
        base += p["ids"]
    index = {"dtype": WordTokenizer(tokenizer).dtype, "parts": listed}
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    with fs.open_output_stream(f"{root}/bases.json") as f:
        f.write(json.dumps(index).encode())
    return index


def mapped(fs: pafs.FileSystem, path: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where it is local, else read."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)


def read_ids(docs: DataFrame, folder: str, index: dict, rows: int = 4096) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, from the files."""
    parts, dtype = index["parts"], index["dtype"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    spark = docs.sparkSession
    if not parts:
        return spark.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                part = parts[i]
                name = f"{root}/part-{part['part']:05d}"
                ids, offsets, own = mapped(fs, f"{name}.ids", dtype), mapped(fs, f"{name}.offsets", "<u8").astype(np.int64), mapped(fs, f"{name}.docs", "<i8")
                for at in range(0, len(own), rows):
                    cut = offsets[at : at + rows + 1]
                    sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(cut[:-1], cut[1:])]
                    block = np.asarray(own[at : at + rows])
                    yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64(), mask=block == NO_ID), pa.array(cut[:-1] + part["base"]), pa.array(np.diff(cut)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.range(0, len(parts), 1, len(parts)).mapInArrow(run, schema)
