"""Token ids of a whole corpus by a public byte-level BPE, through forced boundaries.

A merge only ever builds vocabulary tokens, so two neighbouring bytes that never stand side by side
inside any token of the vocabulary are never merged across: a cut between them is certain. Texts are cut
there, the fragments are encoded each on its own, and their ids are put together again. Fragments are
short and repeat all over a corpus, so a worker encodes most of them once and then looks them up.

The split into words that precedes the merges must not notice the cut either. A cut is made only

* before white space that follows something else: every rule of the pattern ends there, and the rest
  starts as a text of its own would; or
* between two characters that are no white space, if neither of them nor the one before is an
  apostrophe: a run of letters, of digits or of other characters goes on in the next fragment as a run of the same
  kind, and only the rules for ``'s``, ``'re`` and the like look across kinds.

In both cases the two bytes at the cut must be a pair that occurs in no token.

Defined cases: null and empty texts have no ids (an empty list); strings that look like special tokens
are ordinary text; texts are taken whole, whatever their length; every input row gives one output row.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import spread

#: Where the public vocabularies lie; only the driver reads it, executors get the file's bytes.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
#: The pattern that precedes the merges of the byte-level vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Code points with the property White_Space (fixed values).
WHITE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: A vocabulary file is sent to every executor up to this size; beyond it the call fails.
VOCABULARY_BYTES = 32 << 20
#: Fragments kept by a worker, and the longest fragment worth keeping or left uncut inside a word.
KEPT, LONG = 1 << 19, 64


def vocabulary(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> bytes:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        raw = f.read(VOCABULARY_BYTES + 1)
    if len(raw) > VOCABULARY_BYTES:
        raise ValueError(f"{name} is larger than {VOCABULARY_BYTES} bytes")
    return raw


class Encoder:
    """Encodes texts fragment by fragment; one to a worker process."""

    def __init__(self, raw: bytes):
        import numpy as np
        import tiktoken

        ranks = {base64.b64decode(t): int(n) for t, n in (line.split() for line in raw.splitlines() if line)}
        self._whole = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        inside = np.zeros((256, 256), dtype=bool)
        for t in ranks:
            b = np.frombuffer(t, dtype=np.uint8)
            inside[b[:-1], b[1:]] = True
        #: forced[x, y]: no token has byte x followed by byte y
        self.forced = ~inside
        ascii_white = [ord(c) for c in WHITE if c < "\x80"]
        solid = [c for c in range(128) if c not in ascii_white]
        self._plain = bool(self.forced[np.ix_(solid, ascii_white)].all())
        self._words = re.compile(f"[{WHITE}]+[^{WHITE}]*|[^{WHITE}]+")
        self._white = np.zeros(0x3001, dtype=bool)
        self._white[[ord(c) for c in WHITE]] = True
        self._kept: dict = {}

    def _starts(self, text: str) -> tuple[bytes, list[int]]:
        """The text's bytes and where fragments start, 0 left out."""
        import numpy as np

        raw = text.encode("utf-8", "replace")
        b = np.frombuffer(raw, dtype=np.uint8)
        at = np.flatnonzero((b & 0xC0) != 0x80)
        code = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), dtype=np.uint32)
        white = self._white[np.minimum(code, 0x3000)]
        apostrophe = code == 39
        near = apostrophe[1:] | apostrophe[:-1]
        near[1:] |= apostrophe[:-2]
        i = at[1:]
        cut = self.forced[b[i - 1], b[i]] & ~white[:-1] & (white[1:] | ~near)
        return raw, i[cut].tolist()

    def fragments(self, text: str) -> list[str]:
        if self._plain and text.isascii():
            found = self._words.findall(text)
            if len(found) * LONG > len(text) and max(map(len, found), default=0) <= LONG:
                return found
            return [x for f in found for x in (self.fragments_of_bytes(f) if len(f) > LONG else (f,))]
        return self.fragments_of_bytes(text)

    def fragments_of_bytes(self, text: str) -> list[str]:
        raw, starts = self._starts(text)
        return [raw[a:b].decode("utf-8") for a, b in zip([0, *starts], [*starts, len(raw)])]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        kept, out = self._kept, []
        for f in self.fragments(text):
            ids = kept.get(f)
            if ids is None:
                ids = self._whole(f)
                if len(f) <= LONG:
                    if len(kept) >= KEPT:
                        kept.clear()
                    kept[f] = ids
            out += ids
        return out


_ENCODERS: dict[int, Encoder] = {}


def _encoder(raw: bytes) -> Encoder:
    key = hash(raw)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(raw)
    return _ENCODERS[key]


def encoded(docs: DataFrame, text: str = "text", into: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Every other column of the input as it was, and the ids of ``text`` (array of int) as ``into``."""
    import pyarrow as pa

    raw = docs.sparkSession.sparkContext.broadcast(vocabulary(name, folder))
    others = [c for c in docs.columns if c not in (text, into)]

    def run(batches: Iterator) -> Iterator:
        import numpy as np

        enc = _encoder(raw.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            # a few texts at a time, so that ids of very long texts are not held for a whole batch
            for start in range(0, len(texts), 256):
                ids = [enc.encode(t) for t in texts.slice(start, 256).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=ends[-1])
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                part = batch.slice(start, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], column], [*others, into])

    src = spread(docs).select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{fields}{', ' if others else ''}`{into}` array<int>")


def counted(docs: DataFrame, text: str = "text", into: str = "n_tokens", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """As ``encoded``, with the number of ids only."""
    import pyarrow as pa

    raw = docs.sparkSession.sparkContext.broadcast(vocabulary(name, folder))
    others = [c for c in docs.columns if c not in (text, into)]

    def run(batches: Iterator) -> Iterator:
        enc = _encoder(raw.value)
        for batch in batches:
            n = pa.array([len(enc.encode(t.as_py())) for t in batch.column(batch.num_columns - 1)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*others, into])

    src = spread(docs).select(*[F.col(f"`{c}`") for c in others], F.col(f"`{text}`").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{fields}{', ' if others else ''}`{into}` long")
