"""Vector bin packing of token sequences.

Documents are tokenised and packed where they are read: no shuffle, and nothing larger than a window of
pending pieces is held.  A piece as long as a sequence is one; what is left of each document waits in the
window.  A sequence under construction has three limits: tokens, segments and loss-bearing tokens.  It takes the
pending piece whose demand vector has the greatest dot product with what is left of the limits; when none
fits, a piece is cut to fill it.  So only the last sequence of a partition is padded (or one that has reached its
segment or loss limit).

Sequence numbers hold the partition number above a count, so a partition that is computed again after the loss
of an executor gives the same sequences.

Tokenisation splits at the white-space boundaries where the byte-level pattern always splits and caches the
ids of the chunks between them in a bounded table.

Defined cases: a null or empty text is the end token alone; repeated rows are packed each; null ids stay null;
extra columns are not read; an empty table gives no pieces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import KEPT, give_back, lean, read, small_batches

CAPACITY, MAX_SEGMENTS = 1024, 128
#: Pieces that wait, and chunks whose ids are kept, in each task.
WINDOW, CACHE = 512, 100_000
END = 0
SPACES = "\t-\r \x85\xa0  -     　"  # white space of the tokenizer's pattern
CHUNK = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+")
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def tokenizer_path() -> tuple[str, str]:
    """The tokenizer, and the same vocabulary as ranks."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


#: Encoders of this Python worker; tasks that follow one another share the cached chunks.
ENCODERS: dict = {}
KEPT["packing"] = ENCODERS


class Encoder:
    """Little-endian 32-bit ids of a text, as Tokenizer.encode(text, add_special_tokens=False) gives them.

    Chunks that are not cached go through the rank form of the vocabulary, many at once between separators;
    a text that holds a special token's string goes through the tokenizer itself.
    """

    SEPARATOR = "<|chunk|>"

    def __init__(self, paths: tuple[str, str]):
        import base64
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(paths[1], "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.gap = max(ranks.values()) + 1
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={self.SEPARATOR: self.gap})
        self.path, self.tokenizer, self.known = paths[0], None, {}
        self.special = [t.content for t in Tokenizer.from_file(paths[0]).get_added_tokens_decoder().values()] + [self.SEPARATOR]
        del ranks
        give_back()

    def _direct(self, text: str) -> bytes:
        import numpy as np

        if self.tokenizer is None:  # few texts need it
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, chunks: list[str]) -> None:
        import numpy as np

        ids = np.asarray(self.ranks.encode_to_numpy(self.SEPARATOR.join(chunks), allowed_special="all"), "<u4")
        ends = np.append(np.flatnonzero(ids == self.gap), len(ids)) * 4
        starts, raw = np.append(0, ends[:-1] + 4), ids.tobytes()
        self.known.update(zip(chunks, [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]))

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = [any(s in t for s in self.special) for t in texts]
        parts = [[] if w else CHUNK.findall(t) for t, w in zip(texts, whole)]
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        new = list({c for p in parts for c in p if c not in known})
        for k in range(0, len(new), 8192):
            self._learn(new[k : k + 8192])
        return [self._direct(t) if w else b"".join([known[c] for c in p]) for t, w, p in zip(texts, whole, parts)]


def encoder(paths: tuple[str, str]) -> Encoder:
    if paths not in ENCODERS:
        ENCODERS[paths] = Encoder(paths)
    return ENCODERS[paths]


class Packer:
    """Sequences from a stream of (doc_id, ids, prompt tokens)."""

    def __init__(self, first: int, capacity: int, segments: int, loss: int):
        import numpy as np

        self.np, self.next, self.limits = np, first, np.array([capacity, segments, loss], float)
        self.pieces: list[tuple] = []  # doc_id, start, length, ids, doc_tokens, prompt
        self.out: list[tuple] = []

    @staticmethod
    def loss(start: int, length: int, prompt: int) -> int:
        return max(0, start + length - max(start, prompt))

    def add(self, doc_id, ids: bytes, prompt: int = 0) -> None:
        n, capacity, most = len(ids) // 4, int(self.limits[0]), int(self.limits[2])
        start = 0
        while n - start >= capacity and self.loss(start, capacity, prompt) <= most:
            self.out.append((doc_id, start, capacity, ids[4 * start : 4 * (start + capacity)], n, self.next, 0))
            self.next += 1
            start += capacity
        while start < n:  # more than a sequence only if the loss limit is the tighter one
            length = min(n - start, capacity)
            if self.loss(start, length, prompt) > most:
                length = max(1, prompt + most - start) if prompt > start else most
            self.pieces.append((doc_id, start, length, ids[4 * start : 4 * (start + length)], n, prompt))
            start += length

    def pack(self, leave: int) -> None:
        np = self.np
        if len(self.pieces) <= leave:
            return
        pieces = self.pieces
        need = np.array([[p[2], 1, self.loss(p[1], p[2], p[5])] for p in pieces], float)
        waits = np.ones(len(pieces), bool)
        left = len(pieces)
        while left > leave:
            room, offset = self.limits.copy(), 0
            while room.min() > 0 or (room[0] > 0 and room[1] > 0):
                fits = waits & (need <= room).all(1)
                if fits.any():
                    k = int(np.argmax(np.where(fits, (need / self.limits) @ (room / self.limits), -1.0)))
                    cut = pieces[k][2]
                elif left and room[2] > 0:
                    k = int(np.argmax(waits))
                    doc_id, start, length, ids, n, prompt = pieces[k]
                    cut = int(min(room[0], length))
                    if self.loss(start, cut, prompt) > room[2]:
                        cut = int(max(prompt - start, 0) + room[2])
                else:
                    break
                doc_id, start, length, ids, n, prompt = pieces[k]
                self.out.append((doc_id, start, cut, ids[: 4 * cut], n, self.next, offset))
                room -= (cut, 1, self.loss(start, cut, prompt))
                offset += cut
                if cut < length:
                    pieces[k] = (doc_id, start + cut, length - cut, ids[4 * cut :], n, prompt)
                    need[k] = (length - cut, 1, self.loss(start + cut, length - cut, prompt))
                else:
                    waits[k] = False
                    left -= 1
                if not left:
                    break
            self.next += 1
        self.pieces = [p for p, w in zip(pieces, waits) if w]


def pack(docs: DataFrame, paths: tuple[str, str] | None = None, capacity: int = CAPACITY, segments: int = MAX_SEGMENTS, loss: int = CAPACITY, prompt: str | None = None) -> DataFrame:
    """Pieces of packed sequences.  `prompt` names a column with the number of leading tokens without loss."""
    paths = paths or tokenizer_path()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode, end = encoder(paths).encode, np.array([END], "<u4").tobytes()
        packer = Packer(TaskContext.get().partitionId() << 36, capacity, segments, loss)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def flush():
            columns = list(zip(*packer.out)) or [()] * len(names)
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                prompts = part.column(2).to_pylist() if prompt else [0] * len(texts)
                for doc_id, ids, skip in zip(part.column(0).to_pylist(), encode(texts), prompts):
                    packer.add(doc_id, ids + end, skip or 0)
                packer.pack(WINDOW)
                yield flush()
        packer.pack(0)
        yield flush()

    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    if prompt:
        columns.append(F.col(prompt).cast("long").alias("prompt"))
    return small_batches(docs).select(*columns).mapInArrow(lean(run, "packing"), SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(pack(read(spark, sf_dir, "documents")))
